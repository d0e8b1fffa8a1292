"""Token counts by an exact length histogram: suffix sums over it answer every context limit."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from panelith.llm.bpe import token_counts
from panelith.llm.common import stored

#: Lengths whose suffix sums one task makes; sums of whole blocks are made apart.
BLOCK = 1024


def histogram(docs: DataFrame, path: str | None = None) -> DataFrame:
    """Documents by encoded length: ``length long, n_docs long``.

    Null and empty texts have length 0; repeated rows count each; other columns, null ids
    included, play no part; an empty table has no lengths. The counts combine in each task
    before the shuffle, so one common length is one row a task.
    """
    return token_counts(docs, path).groupBy(F.col("n_tokens").alias("length")).agg(F.count(F.lit(1)).alias("n_docs"))


def suffix_sums(lengths: DataFrame) -> DataFrame:
    """For each length L that occurs, what a context limit of L means for all documents.

    ``docs_ge`` and ``tokens_ge`` count documents of at least L tokens and their tokens,
    ``truncated_total`` the tokens left if each document is cut to L, ``docs_cut`` the documents
    cut by it and ``quantile`` the share of documents of at most L tokens. Blocks of lengths are
    summed first: only as many rows as blocks, at most the longest length / 1024, meet in one task.
    """
    # Written once: both the blocks and the lengths read it, and texts are encoded a single time.
    held = stored(lengths.withColumn("block", F.expr(f"length div {BLOCK}")), "lengths")
    blocks = held.groupBy("block").agg(F.sum("n_docs").alias("docs"), F.sum(F.col("n_docs") * F.col("length")).alias("tokens"))
    later = Window.orderBy(F.col("block").desc()).rowsBetween(Window.unboundedPreceding, -1)
    whole = Window.orderBy(F.col("block").desc()).rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    blocks = blocks.select(
        "block",
        F.coalesce(F.sum("docs").over(later), F.lit(0)).alias("docs_later"),
        F.coalesce(F.sum("tokens").over(later), F.lit(0)).alias("tokens_later"),
        F.sum("docs").over(whole).alias("total_docs"),
        F.sum("tokens").over(whole).alias("total_tokens"),
    )
    within = Window.partitionBy("block").orderBy(F.col("length").desc()).rowsBetween(Window.unboundedPreceding, 0)
    sums = held.join(blocks, "block").select(
        "length",
        "n_docs",
        (F.sum("n_docs").over(within) + F.col("docs_later")).alias("docs_ge"),
        (F.sum(F.col("n_docs") * F.col("length")).over(within) + F.col("tokens_later")).alias("tokens_ge"),
        "total_docs",
        "total_tokens",
    )
    cut = F.col("docs_ge") - F.col("n_docs")
    beyond = F.col("tokens_ge") - F.col("n_docs") * F.col("length")
    return sums.select(
        "length",
        "n_docs",
        "docs_ge",
        "tokens_ge",
        cut.alias("docs_cut"),
        (F.col("total_tokens") - beyond + cut * F.col("length")).alias("truncated_total"),
        "total_docs",
        "total_tokens",
        ((F.col("total_docs") - cut) / F.col("total_docs")).alias("quantile"),
    )


def truncated_total(lengths: DataFrame, limit: int) -> DataFrame:
    """``total_tokens`` and ``truncated_total`` for any limit, whether or not a document has that length."""
    kept: Column = F.least(F.col("length"), F.lit(limit)) * F.col("n_docs")
    return lengths.agg(F.coalesce(F.sum(F.col("length") * F.col("n_docs")), F.lit(0)).alias("total_tokens"), F.coalesce(F.sum(kept), F.lit(0)).alias("truncated_total"))


def quantiles(sums: DataFrame, shares: list[float]) -> DataFrame:
    """The least length at which at least each share of documents fits: ``share double, length long``."""
    return sums.select(F.explode(F.array(*[F.when(F.col("quantile") >= q, F.struct(F.lit(float(q)).alias("share"), "length")) for q in shares])).alias("x")).where("x is not null").groupBy("x.share").agg(F.min("x.length").alias("length"))

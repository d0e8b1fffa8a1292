"""The corpus pipeline: quality rules, near-dedup, substring dedup, best-fit packing.

Every stage but the last keeps the columns of documents. An empty table stays empty through all stages.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from panelith.llm import minhash, packing, quality, substrings
from panelith.llm.common import documents, drop, stored


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that neither the base rule nor a certified rule of their language rejects. Null, empty and short texts fail the base rule; null languages are one; repeated rows stay or go together; null ids have no label."""
    return quality.filtered(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates: that of the least id. Repeated rows are copies; documents without words all stay; of groups whose ids are all null one row stays; texts that are not alike stay whether or not they share an id."""
    return minhash.deduplicated(docs)


def substring_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, without the passages of 35 words or more that occur elsewhere. Null and empty texts stay as they are; a text may lose all its words and stays as an empty one."""
    return substrings.cleaned(docs)


def best_fit_packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The place of every document's pieces in sequences of at most 4096 tokens. Null and empty texts are their end id alone; null ids stay null."""
    return packing.pack(packing.cut_pieces(docs)).select("doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset")


STAGES = [("quality_rules", quality_rules), ("near_dedup", near_dedup), ("substring_dedup", substring_dedup), ("best_fit_packing", best_fit_packing)]
#: Packing can't be expressed in SQL; tests hold every stage against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents. What a stage keeps is written, and goes when the next one's is there."""
    docs = documents(spark, sf_dir)
    for i, (name, stage) in enumerate(STAGES):
        before, docs = docs, stage(spark, docs, sf_dir)
        if i < len(STAGES) - 1:
            docs = stored(docs, name)
            drop(before)
    return docs

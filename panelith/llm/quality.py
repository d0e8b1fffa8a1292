"""Quality rules whose cutoffs are certified against false rejection.

Features are exact integer counts over whole texts. For every stratum and rule, cutoffs run
from lenient to strict in a fixed sequence; each is tested on labelled holdout documents by
an exact binomial bound on the share of good documents it would reject, and the sequence ends
at the first cutoff that fails. The error rate is shared by all strata and rules, so that
with probability ``1 - error`` no stratum's certified rules reject a greater share than ``max_false_rejection`` of its good
documents that pass the base rule. What the base rule rejects is fixed beforehand and not part of the guarantee.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from panelith.llm.common import frugal, mixed, stored, unused, utf8, window_hashes, word_hashes
from panelith.llm.repeats import covered, window_starts

SYMBOLS, WHITE = b"#*$%&|<>", b" \t\n\v\f\r"
UPPER, LOWER = bytes(range(65, 91)), bytes(range(97, 123))
COUNTS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines", "n_upper", "n_cased", "n_exclaims")
FEATURES = "quality_counts"


@dataclass(frozen=True)
class Rule:
    """Rejects where numerator > cutoff * denominator; cutoffs in order from lenient to strict."""

    name: str
    numerator: str
    denominator: str
    cutoffs: tuple[float, ...]


RULES = (
    Rule("symbols", "n_symbols", "word_chars", (0.4, 0.3, 0.2, 0.15, 0.1, 0.07, 0.05, 0.03, 0.02)),
    Rule("exclaims", "n_exclaims", "n_words", (3.0, 2.0, 1.5, 1.0, 0.7, 0.5, 0.3)),
    Rule("upper", "n_upper", "n_cased", (0.95, 0.9, 0.8, 0.7, 0.6, 0.5, 0.4, 0.3)),
    Rule("duplicate_lines", "n_dup_lines", "n_lines", (0.9, 0.8, 0.7, 0.6, 0.5, 0.4, 0.3)),
    Rule("repeats", "n_repeat_words", "n_words", (0.9, 0.8, 0.7, 0.6, 0.5, 0.4, 0.3, 0.2)),
    Rule("word_length", "word_chars", "n_words", (40.0, 30.0, 20.0, 15.0, 12.0)),
)


@dataclass(frozen=True)
class Risk:
    """What the guarantee says, and the words under and the repeats over which the base rule rejects."""

    max_false_rejection: float = 0.05
    error: float = 0.05
    least_words: int = 50
    rules: tuple[Rule, ...] = field(default=RULES)


def repeated(keys: np.ndarray) -> np.ndarray:
    """Whether each key occurs at least twice."""
    order = np.argsort(keys)
    held = keys[order]
    same = held[1:] == held[:-1]
    found = np.zeros(len(keys), bool)
    found[1:] |= same
    found[:-1] |= same
    out = np.empty(len(keys), bool)
    out[order] = found
    return out


def counts(texts: list[bytes], characters: list[int]) -> dict[str, np.ndarray]:
    hashes, ends = word_hashes(texts)
    n_words = np.diff(ends)
    starts = np.flatnonzero(window_starts(ends, 3))
    marks = np.zeros(len(hashes), bool)
    if len(starts):
        of = np.repeat(np.arange(len(texts), dtype=np.uint64), n_words)
        keys = window_hashes(hashes, 3)[starts] ^ mixed(of[starts])
        marks[starts] = repeated(keys)
    sums = np.concatenate(([0], np.cumsum(covered(marks, 3))))
    out = {k: np.zeros(len(texts), np.int64) for k in COUNTS}
    out["n_words"], out["n_repeat_words"] = n_words, sums[ends[1:]] - sums[ends[:-1]]
    for i, text in enumerate(texts):
        out["word_chars"][i] = characters[i] - len(text) + len(text.translate(None, WHITE))
        out["n_symbols"][i] = len(text) - len(text.translate(None, SYMBOLS))
        lines = [x for x in text.split(b"\n") if x.strip(WHITE)]
        out["n_lines"][i], out["n_dup_lines"][i] = len(lines), len(lines) - len(set(lines))
        upper = len(text) - len(text.translate(None, UPPER))
        out["n_upper"][i], out["n_cased"][i] = upper, upper + len(text) - len(text.translate(None, LOWER))
        out["n_exclaims"][i] = text.count(b"!")
    return out


def with_counts(docs: DataFrame, name: str = FEATURES) -> DataFrame:
    """``docs`` with all its columns and a struct ``name`` of the counts, row by row, without a shuffle.

    A null text counts as an empty one. A worker takes texts apart a few megabytes at a time.
    """
    schema = T.StructType([*docs.schema.fields, T.StructField(name, T.StructType([T.StructField(c, T.LongType()) for c in COUNTS]))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            text = batch.column(batch.schema.get_field_index("text"))
            found = counts(utf8(text), pc.fill_null(pc.utf8_length(text), 0).to_pylist())
            made = pa.StructArray.from_arrays([pa.array(found[c], pa.int64()) for c in COUNTS], names=list(COUNTS))
            yield pa.RecordBatch.from_arrays([*batch.columns, made], names=[*batch.schema.names, name])

    return docs.mapInArrow(frugal(run, "text"), schema)


def base_failed(risk: Risk = Risk(), name: str = FEATURES) -> Column:
    c = F.col(name)
    return (c["n_words"] < risk.least_words) | (100 * c["n_repeat_words"] > 50 * c["n_words"])


def rejects(rule: Rule, cutoff: float, name: str = FEATURES) -> Column:
    c = F.col(name)
    return c[rule.numerator] > F.lit(cutoff) * F.greatest(c[rule.denominator], F.lit(1))


def stratum(name: str) -> Column:
    return F.coalesce(F.col(name).cast("string"), F.lit(""))


def binomial_tail(rejected: int, n: int, p: float) -> float:
    """The probability of ``rejected`` or fewer of n at share p."""
    if p <= 0 or rejected >= n:
        return 1.0
    if p >= 1:
        return 0.0
    k = np.arange(1, rejected + 1, dtype=np.float64)
    logs = np.concatenate(([0.0], np.cumsum(np.log((n - k + 1) / k) + math.log(p) - math.log1p(-p)))) + n * math.log1p(-p)
    most = logs.max()
    return min(1.0, math.exp(most) * float(np.exp(logs - most).sum()))


def binomial_upper(rejected: int, n: int, error: float) -> float:
    """The exact (Clopper-Pearson) upper bound of a share: the p at which ``rejected`` or fewer of n have probability ``error``."""
    if rejected >= n:
        return 1.0
    low, high = rejected / n, 1.0
    while high - low > 1e-12:
        middle = (low + high) / 2
        if binomial_tail(rejected, n, middle) > error:
            low = middle
        else:
            high = middle
    return high


def calibrate(counted: DataFrame, labels: DataFrame, by: str = "lang", risk: Risk = Risk(), name: str = FEATURES) -> list[dict]:
    """Certified cutoffs as rows ``stratum, rule, cutoff, n_good, false_rejects, bound, bad_rejected``.

    ``labels`` is ``doc_id, quality``; a document with several labels counts by the lowest, null
    labels and ids by none. All labelled documents of ``counted`` that pass the base rule are the holdout: no
    cutoff depends on them but through its test. Of the certified cutoffs, the one that rejects most bad
    documents is taken, the most lenient of equals; a rule that finds no bad document in a stratum has no cutoff there.
    Only strata with enough good documents to certify anything come to the driver.
    """
    share = risk.max_false_rejection / len(risk.rules)
    held = labels.where(F.col("doc_id").isNotNull() & F.col("quality").isNotNull()).groupBy("doc_id").agg(F.min("quality").alias("least"))
    joined = counted.where(~base_failed(risk, name)).select("doc_id", stratum(by).alias("stratum"), F.col(name).alias(FEATURES)).join(held, "doc_id")
    good = F.col("least") >= 1
    sums = [F.sum((good & rejects(r, c)).cast("long")).alias(f"g{i}_{j}") for i, r in enumerate(risk.rules) for j, c in enumerate(r.cutoffs)]
    sums += [F.sum((~good & rejects(r, c)).cast("long")).alias(f"b{i}_{j}") for i, r in enumerate(risk.rules) for j, c in enumerate(r.cutoffs)]
    fewest = math.ceil(math.log(risk.error / len(risk.rules)) / math.log1p(-share))
    rows = joined.groupBy("stratum").agg(F.sum(good.cast("long")).alias("n"), *sums).where(F.col("n") >= fewest).orderBy("stratum").collect()
    error = risk.error / max(1, len(rows) * len(risk.rules))
    out = []
    for row in rows:
        for i, rule in enumerate(risk.rules):
            best = None
            for j, cutoff in enumerate(rule.cutoffs):
                # One tail sum tells whether the upper bound is at most the share.
                if binomial_tail(row[f"g{i}_{j}"], row["n"], share) > error:
                    break
                if row[f"b{i}_{j}"] > (best["bad_rejected"] if best else 0):
                    best = {"stratum": row["stratum"], "rule": rule.name, "cutoff": cutoff, "n_good": row["n"], "false_rejects": row[f"g{i}_{j}"], "bad_rejected": row[f"b{i}_{j}"]}
            if best:
                best["bound"] = binomial_upper(best["false_rejects"], best["n_good"], error)
                out.append(best)
    return out


def rejected_by(cutoffs: list[dict], by: str = "lang", risk: Risk = Risk(), name: str = FEATURES) -> Column:
    """Whether a certified rule of the row's own stratum rejects it."""
    rules = {r.name: r for r in risk.rules}
    out = F.lit(False)
    for x in cutoffs:
        out = out | ((stratum(by) == x["stratum"]) & rejects(rules[x["rule"]], x["cutoff"], name))
    return out


def judged(docs: DataFrame, labels: DataFrame, by: str = "lang", risk: Risk = Risk()) -> DataFrame:
    """Per row of ``docs``: ``doc_id``, the counts, ``base_failed`` and ``kept``.

    Null and empty texts have no words and fail the base rule; null strata form one of
    their own; repeated rows are judged each; clashing names do no harm, as only doc_id, text and the stratum are read.
    Without labels, or with too few, the base rule decides alone; an empty table gives no rows.
    """
    plain = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"), F.col(by).cast("string").alias(by))
    counted = stored(with_counts(plain).drop("text"), "quality")
    cutoffs = calibrate(counted, labels, by, risk)
    failed = base_failed(risk)
    return counted.select("doc_id", *[F.col(FEATURES)[c].alias(c) for c in COUNTS[:5]], failed.alias("base_failed"), (~failed & ~rejected_by(cutoffs, by, risk)).alias("kept"))


def filtered(docs: DataFrame, labels: DataFrame, by: str = "lang", risk: Risk = Risk()) -> DataFrame:
    """The rows of ``docs`` that pass, with all their columns unchanged.

    Null, empty and short texts fail the base rule and go; repeated rows stay or go together; null strata form one of their
    own; column names can't clash; an empty table gives no rows. The rows are written once with their counts, so that
    texts are taken apart once and never shuffled.
    """
    name = unused(docs.columns, FEATURES)
    counted = stored(with_counts(docs, name), "quality")
    cutoffs = calibrate(counted, labels, by, risk, name)
    return counted.where(~base_failed(risk, name) & ~rejected_by(cutoffs, by, risk, name)).drop(name)

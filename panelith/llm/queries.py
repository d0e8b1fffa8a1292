"""The queries that apply the operators of this subpackage to whole tables, and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

import corpus_pipeline
from panelith.llm import bpe, hmm, media, minhash, oracle, packing, quality, sharding, substrings, suffixes, token_lengths
from panelith.llm.common import documents


def op1_minhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Near-duplicate classes of all documents. Null and empty texts stand alone; repeated rows share a class; null ids count in no minimum; an empty table gives no rows."""
    return minhash.near_duplicates(documents(spark, sf_dir))


def op2_media_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Payloads stored, read back and described. A null text is empty; repeated rows and null ids give rows of their own; an empty table gives none."""
    return media.stored_features(documents(spark, sf_dir))


def op3_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Repeated 35-word passages. A null text has no words; texts shorter than a window lose none; repeated rows lose what they share; null ids stay null."""
    return substrings.digests(documents(spark, sf_dir))


def op4_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Packed pieces of all documents. A null text is its end id alone; repeated rows and null ids are packed each; an empty table gives no rows."""
    return packing.pack(packing.cut_pieces(documents(spark, sf_dir))).select("doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset")


def op5_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Shards of near equal bytes. A null text is empty; equal texts share a shard; null ids and repeated rows take slots each; an empty table gives no rows."""
    return sharding.shard(documents(spark, sf_dir), shards=16)


def op6_suffix_array_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Repeated 200-byte strings. A null text has no bytes; shorter texts lose none; repeated rows lose what they share; null ids stay null."""
    return suffixes.digests(documents(spark, sf_dir))


def op7_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counts and verdicts. A null text has no words and fails the base rule; null languages are a stratum of their own; repeated rows are judged each."""
    return quality.judged(documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/labels.parquet"))


def op8_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Scores of all documents. A null text is its end alone; null ids are trained on; repeated rows count and are scored each; an empty table gives no rows."""
    return hmm.scored(documents(spark, sf_dir))


def op9_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What every context limit costs. Null and empty texts have length 0; repeated rows count each; ids play no part; an empty table gives no rows."""
    return token_lengths.suffix_sums(token_lengths.histogram(documents(spark, sf_dir)))


def op10_bpe_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Digests of ids and of the decoded texts. A null text is empty; repeated rows and null ids give rows of their own; an empty table gives none."""
    return bpe.round_trip(documents(spark, sf_dir))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f
    for f in (
        op1_minhash_near_dedup,
        op2_media_columns,
        op3_substring_dedup,
        op4_best_fit_packing,
        op5_sharding,
        op6_suffix_array_dedup,
        op7_quality_rules,
        op8_lm_scoring,
        op9_token_counts,
        op10_bpe_round_trip,
    )
} | {"pipeline": corpus_pipeline.run}
SQL: dict[str, str] = oracle.SQL | ({"pipeline": corpus_pipeline.ORACLE_SQL} if corpus_pipeline.ORACLE_SQL else {})

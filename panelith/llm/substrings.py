"""Removal of repeated passages by Rabin-Karp hashes of every fixed-length word window.

Every window's hash is dealt out by its leading bits, so that equal windows meet and are
counted; repeated windows are reported back to where they start and merged into maximal
intervals. Hashes travel packed (see ``repeats``), which keeps the shuffle near twice the input.
"""

from __future__ import annotations

from collections.abc import Iterator
from hashlib import sha256

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from panelith.llm.common import frugal, unused, utf8, window_hashes, word_hashes
from panelith.llm.repeats import covered_spans, repeated_places, window_starts

WIDTH = 35


def repeated_spans(docs: DataFrame, width: int = WIDTH) -> DataFrame:
    """``key long, spans binary`` for each document that loses words: maximal runs ``[from, to)`` of its
    words as pairs of little-endian 64-bit integers. The key is ``xxhash64(doc_id, text)``."""

    def windows(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        hashes, ends = word_hashes(texts)
        starts = np.flatnonzero(window_starts(ends, width))
        return window_hashes(hashes, width)[starts] if len(starts) else np.empty(0, np.uint64), starts, ends

    keyed = docs.select(F.xxhash64("doc_id", "text").alias("key"), F.col("text").cast("string").alias("text"))
    return repeated_places(keyed, windows, lambda marks, ends: covered_spans(marks, ends, width))


def kept_words(text: bytes, spans: bytes | None) -> tuple[list[bytes], int]:
    """The words outside the spans, and how many words there were."""
    words = text.split()
    if spans is None:
        return words, len(words)
    out, at = [], 0
    for a, b in np.frombuffer(spans, "<i8").reshape(-1, 2).tolist():
        out += words[at:a]
        at = b
    return out + words[at:], len(words)


def digests(docs: DataFrame, width: int = WIDTH) -> DataFrame:
    """Per row: ``doc_id, n_words, n_removed, kept_sha256``.

    Null and empty texts have no words; texts shorter than a window lose none; rows repeated with their id
    and text count as further documents, so both lose what they share; null ids stay null; other
    columns are ignored; an empty table gives no rows. Equality of windows is that of 64-bit hashes.
    """
    spans = repeated_spans(docs, width)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for text, own in zip(utf8(batch.column("text")), batch.column("spans").to_pylist(), strict=True):
                kept, n = kept_words(text, own)
                rows.append((n, n - len(kept), sha256(b" ".join(kept)).hexdigest()))
            n_words, n_removed, digest = zip(*rows, strict=True) if rows else ([], [], [])
            yield pa.record_batch([batch.column("doc_id"), pa.array(n_words, pa.int64()), pa.array(n_removed, pa.int64()), pa.array(digest, pa.string())], names=["doc_id", "n_words", "n_removed", "kept_sha256"])

    plain = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"), F.xxhash64("doc_id", "text").alias("key"))
    return plain.join(spans, "key", "left").select("doc_id", "text", "spans").mapInArrow(frugal(run, "text"), "doc_id long, n_words long, n_removed long, kept_sha256 string")


def cleaned(docs: DataFrame, width: int = WIDTH) -> DataFrame:
    """``docs`` with all columns; a text that loses words becomes its kept words joined by one space, and
    ``n_chars``, where there is such a column, its new length. Other texts stay as they are, null included; rows repeated with their id and text
    both lose what they share; other column names can't clash; an empty table gives no rows."""
    names = docs.columns
    key, held = unused(names, "row_key"), unused(names, "row_spans")
    spans = repeated_spans(docs, width)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column("text").to_pylist()
            spans = batch.column(held).to_pylist()
            lost = {i: b" ".join(kept_words(texts[i].encode(), s)[0]).decode() for i, s in enumerate(spans) if s is not None}
            columns = {n: batch.column(n) for n in names}
            columns["text"] = pa.array([lost.get(i, t) for i, t in enumerate(texts)], batch.schema.field("text").type)
            if "n_chars" in columns:
                chars = columns["n_chars"].to_pylist()
                columns["n_chars"] = pa.array([len(lost[i]) if i in lost else n for i, n in enumerate(chars)], batch.schema.field("n_chars").type)
            yield pa.record_batch(list(columns.values()), names=list(columns))

    joined = docs.withColumn(key, F.xxhash64("doc_id", "text")).join(spans.select(F.col("key").alias(key), F.col("spans").alias(held)), key, "left").drop(key)
    return joined.mapInArrow(frugal(run, "text"), T.StructType(docs.schema.fields))

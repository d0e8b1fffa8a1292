"""Finding values that occur at least twice among very many, each with its place.

Values are dealt out by their leading bits, so that equal ones meet and are counted, and the
places of repeated ones are reported back. They travel packed, a block of documents and a
bucket at a time: seven bytes and a two-byte step for each, whatever the number of documents.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame

from panelith.llm.common import PIECE_BYTES, frugal, partitions, utf8

STEP = 0xFFFF


def packed(values: np.ndarray) -> bytes:
    """The low seven bytes of each value; the leading byte is implied by the bucket."""
    return values.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :7].tobytes()


def unpacked(data: bytes) -> np.ndarray:
    out = np.zeros((len(data) // 7, 8), np.uint8)
    out[:, :7] = np.frombuffer(data, np.uint8).reshape(-1, 7)
    return out.view("<u8").reshape(-1)


def steps(places: np.ndarray) -> bytes:
    """Rising places as two-byte differences; 0xFFFF stands for a step of 65,535 that ends at no place."""
    d = np.diff(places, prepend=-1)
    long = (d - 1) // STEP
    if (d < STEP).all():
        return d.astype("<u2").tobytes()
    out = np.full(len(d) + int(long.sum()), STEP, np.int64)
    out[np.cumsum(long + 1) - 1] = d - long * STEP
    # A last step of exactly 65,535 can't occur: (d - 1) // STEP leaves 1 to 65,535, and 65,535 is written as 65,535 + 0.
    exact = np.flatnonzero(d - long * STEP == STEP)
    if len(exact):
        out = np.insert(out, np.cumsum(long + 1)[exact], 0)
    return out.astype("<u2").tobytes()


def unsteps(data: bytes) -> np.ndarray:
    d = np.frombuffer(data, "<u2").astype(np.int64)
    return (np.cumsum(d) - 1)[d != STEP]


def bucket_bits(parts: int) -> int:
    """Leading bits that name a bucket: about four buckets a shuffle partition, and at least the byte that packing leaves out."""
    return max(8, int(4 * parts - 1).bit_length())


BLOCK_SCHEMA = "bucket int, block long, hashes binary, places binary, repeats binary, keys binary, ends binary, local binary"


def block_rows(keys: np.ndarray, values: np.ndarray, starts: np.ndarray, ends: np.ndarray, bits: int) -> Iterator[tuple]:
    """A block's rows for each bucket, and one row that says which documents it holds.

    Values that recur inside the block are known to be repeated: they are sent once, without a place.
    """
    name = np.int64(xxhash.xxh3_64_intdigest(keys.tobytes()) >> 1)
    local = np.empty(0, np.int64)
    if len(starts):
        order = np.argsort(values, kind="stable")
        held = values[order]
        heads = np.concatenate(([True], held[1:] != held[:-1]))
        tails = np.concatenate((heads[1:], [True]))
        alone = heads & tails
        local = np.sort(starts[order[~alone]])
        repeats = held[heads & ~tails]
        single, places = held[alone], starts[order[alone]]
        buckets = (single >> np.uint64(64 - bits)).astype(np.int64)
        cuts = np.flatnonzero(np.diff(buckets, prepend=-1, append=-1))
        more = np.searchsorted(repeats >> np.uint64(64 - bits), np.arange((1 << bits) + 1, dtype=np.uint64))
        sent = set()
        for a, b in zip(cuts[:-1].tolist(), cuts[1:].tolist(), strict=True):
            bucket = int(buckets[a])
            rising = np.argsort(places[a:b], kind="stable")
            sent.add(bucket)
            yield bucket, name, packed(single[a:b][rising]), steps(places[a:b][rising]), packed(repeats[more[bucket] : more[bucket + 1]]), None, None, None
        for bucket in np.flatnonzero(np.diff(more)).tolist():
            if bucket not in sent:
                yield bucket, name, b"", b"", packed(repeats[more[bucket] : more[bucket + 1]]), None, None, None
    yield int(name % (1 << bits)), name, None, None, None, keys.astype("<i8").tobytes(), ends.astype("<i8").tobytes(), local.astype("<i8").tobytes()


def to_batches(rows: Iterator[tuple]) -> Iterator[pa.RecordBatch]:
    kinds = [pa.int32(), pa.int64(), *[pa.binary()] * 6]
    names = ["bucket", "block", "hashes", "places", "repeats", "keys", "ends", "local"]
    columns = list(zip(*rows, strict=True))
    yield pa.record_batch([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names=names)


def counted_bucket(rows: list[tuple]) -> Iterator[tuple[int, bytes]]:
    """The places of repeated windows of each block, from all rows of one bucket."""
    parts = [(block, unpacked(h), p, unpacked(r)) for block, h, p, r in rows]
    values = np.concatenate([x[1] for x in parts])
    known = np.sort(np.concatenate([x[3] for x in parts]))
    order = np.argsort(values, kind="stable")
    held = values[order]
    same = held[1:] == held[:-1]
    found = np.zeros(len(held), bool)
    found[1:] |= same
    found[:-1] |= same
    if len(known):
        at = np.minimum(np.searchsorted(known, held), len(known) - 1)
        found |= known[at] == held
    again = np.zeros(len(values), bool)
    again[order[found]] = True
    at = 0
    for block, own, places, _ in parts:
        marks = again[at : at + len(own)]
        at += len(own)
        if marks.any():
            yield block, unsteps(places)[marks].astype("<i8").tobytes()


def repeated_places(keyed: DataFrame, make: Callable[[list[bytes]], tuple[np.ndarray, np.ndarray, np.ndarray]], finish: Callable[[np.ndarray, np.ndarray], Iterator[tuple[int, bytes]]], block_bytes: int = PIECE_BYTES) -> DataFrame:
    """``key long, spans binary`` of documents (``key long, text string``) in which a value repeats.

    ``make`` gives the values of a block of texts, their rising places, and the offset of each text among
    all places. ``finish`` gets a mark for each place of a block and the same offsets, and gives the number of a
    document in the block and what is to be said of it. A block has ``block_bytes`` of text, or one text.
    """
    n = partitions(keyed.sparkSession)
    bits = bucket_bits(n)

    def blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield from to_batches(block_rows(batch.column("key").to_numpy(), *make(utf8(batch.column("text"))), bits))

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """One bucket at a time: rows come sorted by bucket."""
        now, held = None, []

        def answers() -> pa.RecordBatch:
            found = list(counted_bucket(held))
            empty = pa.nulls(len(found), pa.binary())
            return pa.record_batch([pa.array([x[0] for x in found], pa.int64()), pa.array([x[1] for x in found], pa.binary()), empty, empty], names=["block", "places", "keys", "ends"])

        for batch in batches:
            for row in zip(*[batch.column(c).to_pylist() for c in ("bucket", "block", "hashes", "places", "repeats", "keys", "ends", "local")], strict=True):
                if row[5] is not None:
                    yield pa.record_batch([pa.array([row[1]], pa.int64()), pa.array([row[7]], pa.binary()), pa.array([row[5]], pa.binary()), pa.array([row[6]], pa.binary())], names=["block", "places", "keys", "ends"])
                    continue
                if row[0] != now and held:
                    yield answers()
                    held.clear()
                now = row[0]
                held.append(row[1:5])
        if held:
            yield answers()

    def gather(pdf: pd.DataFrame) -> pd.DataFrame:
        named = pdf[pdf["keys"].notna()].iloc[0]
        keys, ends = np.frombuffer(named["keys"], "<i8"), np.frombuffer(named["ends"], "<i8")
        marks = np.zeros(ends[-1], bool)
        for places in pdf["places"]:
            marks[np.frombuffer(places, "<i8")] = True
        return pd.DataFrame([(int(keys[i]), data) for i, data in finish(marks, ends)], columns=["key", "spans"])

    dealt = keyed.select("key", "text").mapInArrow(frugal(blocks, "text", block_bytes), BLOCK_SCHEMA).repartition(n, "bucket").sortWithinPartitions("bucket")
    replies = dealt.mapInArrow(frugal(count), "block long, places binary, keys binary, ends binary")
    return replies.groupBy("block").applyInPandas(gather, "key long, spans binary").dropDuplicates(["key"])


def covered(starts: np.ndarray, width: int) -> np.ndarray:
    """Which places lie in a window of ``width`` whose start is marked."""
    sums = np.cumsum(starts, dtype=np.int64)
    sums[width:] -= sums[:-width].copy()
    return sums > 0


def window_starts(ends: np.ndarray, width: int) -> np.ndarray:
    """Which places start a whole window of their own text; ``ends`` are the texts' offsets."""
    left = np.repeat(ends[1:], np.diff(ends)) - np.arange(ends[-1])
    return left >= width


def covered_spans(marks: np.ndarray, ends: np.ndarray, width: int) -> Iterator[tuple[int, bytes]]:
    """For each text with a marked window: its number and the maximal covered runs ``[from, to)`` as 64-bit pairs."""
    edges = np.diff(covered(marks, width).astype(np.int8), prepend=0, append=0)
    starts, stops = np.flatnonzero(edges == 1), np.flatnonzero(edges == -1)
    # A run that goes on from one text into the next is cut at their border.
    borders = np.unique(ends[1:-1])
    inner = borders[np.searchsorted(starts, borders, "left") > np.searchsorted(stops, borders, "right")]
    starts, stops = np.sort(np.concatenate((starts, inner))), np.sort(np.concatenate((stops, inner)))
    of = np.searchsorted(ends, starts, "right") - 1
    pairs = np.stack((starts - ends[of], stops - ends[of]), axis=1).astype("<i8")
    cuts = np.flatnonzero(np.diff(of, prepend=-1, append=-1))
    for a, b in zip(cuts[:-1].tolist(), cuts[1:].tolist(), strict=True):
        yield int(of[a]), pairs[a:b].tobytes()

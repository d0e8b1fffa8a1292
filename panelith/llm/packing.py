"""Best-fit packing of documents into sequences by hierarchical residual packing.

Partitions pack their own pieces best-fit; nearly full bins are final, the others become
the items of a next round over fewer, larger groups, and so on up a tree. A group is never
larger than ``group_items``, whatever the input, and rounds end when merging no longer pays.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from panelith.llm import word_tokens
from panelith.llm.common import frugal, partitions, stored, text_only, unused

CAPACITY = 4096
#: Id that ends each document.
END_ID = 1
#: Bins with at most so much room are final.
NEARLY_FULL = 8
#: Bins that one task of a round packs at most.
GROUP_ITEMS = 100_000
#: Groups of one round that make one group of the next.
FAN_IN = 8


def cut_pieces(docs: DataFrame, capacity: int = CAPACITY, path: str | None = None, with_ids: bool = False) -> DataFrame:
    """Whole documents as token ids plus the end id, in pieces of at most ``capacity``.

    Returns ``doc_id, piece int, start long, length long, ids_crc32 long`` and, if asked,
    ``ids binary`` (little-endian unsigned 32-bit). A null text is empty and gives one piece, the
    end id alone; repeated rows give their pieces each; null ids stay null; only documents longer
    than ``capacity`` are cut; an empty table gives no rows.
    """
    path = path or word_tokens.default_path()
    schema = "doc_id long, piece int, start long, length long, ids_crc32 long" + ", ids binary" * with_ids
    end = END_ID.to_bytes(4, "little")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = word_tokens.codec(path)
        for batch in batches:
            rows: list[tuple] = []
            for doc_id, text in zip(batch.column("doc_id").to_pylist(), batch.column("text").to_pylist(), strict=True):
                ids = codec.encode(text or "") + end
                for piece, at in enumerate(range(0, len(ids), 4 * capacity)):
                    own = ids[at : at + 4 * capacity]
                    rows.append((doc_id, piece, at // 4, len(own) // 4, zlib.crc32(own), own))
            columns = list(zip(*rows, strict=True)) or [[]] * 6
            kinds = [pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64()] + [pa.binary()] * with_ids
            names = ["doc_id", "piece", "start", "length", "ids_crc32"] + ["ids"] * with_ids
            yield pa.record_batch([pa.array(c, k) for c, k in zip(columns, kinds, strict=False)], names=names)

    return text_only(docs).mapInArrow(frugal(run, "text", keep=True), schema)


def best_fit(ids: np.ndarray, lengths: np.ndarray, capacity: int) -> tuple[np.ndarray, np.ndarray]:
    """Best-fit decreasing: for each item the id of its bin, which is the id of the bin's first item, and its offset.

    ``room`` holds the open bins by what is left in them and ``open_rooms`` which of these
    are not empty, one bit each, so that the tightest bin is found by bit operations.
    """
    order = np.argsort(-lengths, kind="stable")
    bins, offsets = np.empty(len(ids), np.int64), np.empty(len(ids), np.int64)
    room: list[list[int]] = [[] for _ in range(capacity + 1)]
    open_rooms = 0
    named, sizes = ids.tolist(), lengths.tolist()
    for i in order.tolist():
        size = sizes[i]
        fitting = open_rooms >> size
        if fitting:
            left = size + (fitting & -fitting).bit_length() - 1
            bin_id = room[left].pop()
            if not room[left]:
                open_rooms &= ~(1 << left)
        else:
            left, bin_id = capacity, named[i]
        bins[i], offsets[i] = bin_id, capacity - left
        left -= size
        if left:
            room[left].append(bin_id)
            open_rooms |= 1 << left
    return bins, offsets


def packed_locally(items: DataFrame, capacity: int, group_items: int) -> DataFrame:
    """Best-fit within each partition, in groups of at most ``group_items``: ``item, bin, offset, length``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []

        def packed() -> pa.RecordBatch:
            table = pa.Table.from_batches(held)
            ids, lengths = table.column("item").to_numpy(), table.column("length").to_numpy()
            bins, offsets = best_fit(ids, lengths, capacity)
            return pa.record_batch([pa.array(ids), pa.array(bins), pa.array(offsets), pa.array(lengths)], names=["item", "bin", "offset", "length"])

        for batch in batches:
            if held and sum(b.num_rows for b in held) + batch.num_rows > group_items:
                yield packed()
                held = []
            held.append(batch)
        if held:
            yield packed()

    return items.select("item", "length").mapInArrow(run, "item long, bin long, offset long, length long")


def pack(pieces: DataFrame, capacity: int = CAPACITY, nearly_full: int = NEARLY_FULL, group_items: int = GROUP_ITEMS, fan_in: int = FAN_IN) -> DataFrame:
    """``pieces`` with ``sequence_id long`` and ``offset long``: no sequence longer than ``capacity``, each gapless from 0.

    ``pieces`` needs a ``length`` from 1 to ``capacity`` and keeps its other columns (but not ones of the two new names); it is
    written once, so that pieces have lasting numbers. Nulls and repeated rows in other
    columns make no difference; without rows there are no sequences.
    """
    names = [c for c in pieces.columns if c not in ("sequence_id", "offset")]
    item, bin_, place, next_, shift = (unused([*names, "sequence_id", "offset"], n) for n in ("item", "bin", "place", "next_bin", "shift"))
    items = stored(pieces.withColumn(item, F.monotonically_increasing_id()), "pieces")
    rounds: list[DataFrame] = []
    level = items.select(F.col(item).alias("item"), F.col("length").cast("long").alias("length"))
    groups = partitions(items.sparkSession)
    before, stuck = None, 0
    while True:
        placed = stored(packed_locally(level, capacity, group_items), "packed")
        rounds.append(placed)
        bins = placed.groupBy("bin").agg(F.sum("length").alias("length"))
        level = stored(bins.where(F.col("length") < capacity - nearly_full).withColumnRenamed("bin", "item"), "underfull")
        left = level.count()
        # A group of the last round has met every other bin that is left. Rounds over several groups that merge next to nothing,
        # twice and dealt anew in between, show that the bins left don't fit together; if one group can hold them, it has the last word.
        stuck = stuck + 1 if before is not None and left > 0.999 * before else 0
        if groups == 1 or left < 2 or (stuck > 1 and left > group_items):
            break
        before = left
        groups = 1 if stuck and left <= group_items else max(-(-left // group_items), groups // fan_in, 1)
        level = level.repartition(groups, F.xxhash64("item", F.lit(len(rounds))))
    first = rounds[0].select(F.col("item").alias(item), F.col("bin").alias(bin_), F.col("offset").alias(place))
    out = items.join(first, item)
    for later in rounds[1:]:
        moved = later.select(F.col("item").alias(bin_), F.col("bin").alias(next_), F.col("offset").alias(shift))
        out = out.join(moved, bin_, "left").withColumns({place: F.col(place) + F.coalesce(shift, F.lit(0)), bin_: F.coalesce(next_, bin_)}).drop(next_, shift)
    return out.select(*names, F.col(bin_).alias("sequence_id"), F.col(place).alias("offset"))


def sequences(packed: DataFrame) -> DataFrame:
    """The token ids of each sequence, from packed pieces that carry ``ids``: ``sequence_id, ids binary, n_pieces``.

    A sequence has at most ``capacity`` ids, which bounds its group.
    """
    parts = packed.groupBy("sequence_id").agg(F.sort_array(F.collect_list(F.struct("offset", "ids"))).alias("parts"))
    return parts.select("sequence_id", F.expr("aggregate(parts, cast('' as binary), (a, p) -> concat(a, p.ids))").alias("ids"), F.size("parts").alias("n_pieces"))

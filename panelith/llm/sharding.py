"""Sharding by minimax contiguous partition of ordered groups.

Rows of equal text form one atomic group; groups are ordered by their text's digest. The
smallest capacity at which a greedy pass needs no more shards than asked is found by binary
search, and the shards are cut there. The search runs on the driver over a summary of the
prefix sums: a bounded number of blocks, refined only where a cut may lie.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from panelith.llm.common import partitions, stored, text_only

#: Blocks of prefix sums that the driver asks for in each step of refinement; it holds a few times as many.
BLOCKS = 32_768


@dataclass
class Prefixes:
    """Blocks of the sorted group ends: the least and greatest end in each block, and how many there are.

    Within a block that holds one end, or from its greatest end on, places are known exactly.
    """

    least: np.ndarray
    most: np.ndarray
    count: np.ndarray

    def before(self, x: int) -> tuple[int, int]:
        """Bounds of the greatest group end that is at most x."""
        i = int(np.searchsorted(self.least, x, "right")) - 1
        if i < 0:
            return 0, 0
        if x >= self.most[i]:
            return int(self.most[i]), int(self.most[i])
        if self.count[i] == 2:
            return int(self.least[i]), int(self.least[i])
        return int(self.least[i]), x

    def cuts(self, capacity: int, shards: int, cautious: bool) -> list[int] | None:
        """Ends of a greedy pass by the lower or the upper bounds; None if it needs more shards."""
        ends, at, total = [], 0, int(self.most[-1]) if len(self.most) else 0
        while at < total:
            if len(ends) == shards:
                return None
            to = self.before(at + capacity)[0 if cautious else 1]
            if to <= at:
                return None
            ends.append(to)
            at = to
        return ends


def least_capacity(p: Prefixes, shards: int, low: int, high: int, cautious: bool) -> int:
    """The smallest capacity in low..high that a greedy pass finds feasible; high is known to be."""
    while low < high:
        middle = (low + high) // 2
        if p.cuts(middle, shards, cautious) is None:
            low = middle + 1
        else:
            high = middle
    return low


def summary(ends: DataFrame, spans: list[tuple[int, int]], width: int) -> Prefixes:
    """Blocks of ``width`` over the group ends that lie in the spans, brought to the driver."""
    wanted = F.lit(False)
    for a, b in spans:
        wanted = wanted | F.col("end").between(a, b)
    rows = ends.where(wanted).groupBy(F.expr(f"end div {width}L").alias("block")).agg(F.min("end").alias("least"), F.max("end").alias("most"), F.count(F.lit(1)).alias("count")).orderBy("block").toPandas()
    return Prefixes(rows["least"].to_numpy(np.int64), rows["most"].to_numpy(np.int64), rows["count"].to_numpy(np.int64))


def merged(spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    out: list[tuple[int, int]] = []
    for a, b in sorted(spans):
        if out and a <= out[-1][1] + 1:
            out[-1] = (out[-1][0], max(b, out[-1][1]))
        else:
            out.append((a, b))
    return out


def minimax_cuts(ends: DataFrame, total: int, largest: int, shards: int, blocks: int = BLOCKS) -> tuple[int, list[int]]:
    """The minimax capacity over the table of group ends (``end long``, distinct), and the shards' ends.

    Each step brackets the capacity by cautious and hopeful greedy passes over the blocks
    held, then refines only blocks that some capacity in the bracket can cut. It ends when
    both passes agree and no cut is in doubt.

    Widths are powers of two, so a finer block lies in one coarser block and bounds only tighten: what is in doubt
    after a step lies in what that step refined. As each step at least halves the width, and blocks of width one hold one
    end, there are no more steps than the total has binary digits.
    """
    if not total:
        return 0, []
    low, high = max(-(-total // shards), largest), -(-total // shards) + largest
    width = 1 << (-(-total // blocks) - 1).bit_length()
    held = summary(ends, [(1, total)], width)
    while True:
        low = least_capacity(held, shards, low, high, cautious=False)
        high = least_capacity(held, shards, low, high, cautious=True)
        cautious, hopeful = held.cuts(high, shards, True), held.cuts(low, shards, False)
        if low == high and cautious == hopeful:
            return high, cautious
        # Where a greedy pass of any capacity in the bracket can end its i-th shard, by bounds that follow each other.
        spans, a, b = [], 0, 0
        for _ in range(shards):
            a, b = held.before(a + low)[0], min(total, held.before(b + high)[1])
            i, j = np.searchsorted(held.least, [a, b], "right") - 1
            doubt = max(i, 0) + np.flatnonzero(held.count[max(i, 0) : j + 1] > 2)
            if len(doubt):
                spans.append((int(held.least[doubt[0]]), int(held.most[doubt[-1]])))
        spans = merged(spans)
        assert spans and width > 1, "bounds agree wherever blocks hold at most two ends"
        wanted = -(-sum(y - x + 1 for x, y in spans) // blocks)
        width = min(width // 2, 1 << (wanted - 1).bit_length())
        finer = summary(ends, spans, width)
        outside = np.ones(len(held.least), bool)
        for x, y in spans:
            outside &= ~((held.least >= x) & (held.most <= y))
        parts = [np.concatenate((getattr(held, k)[outside], getattr(finer, k))) for k in ("least", "most", "count")]
        order = np.argsort(parts[0], kind="stable")
        held = Prefixes(*[p[order] for p in parts])


def shard(docs: DataFrame, shards: int = 16, blocks: int = BLOCKS) -> DataFrame:
    """Every row's shard under the law ``bytes``: ``doc_id, size, text_crc32, law, shard, slot, grown_shard``.

    ``size`` is the text's UTF-8 bytes plus one; a null text counts as an empty one and shares
    its group. Equal texts share a shard, so a group larger than a fair share makes its shard
    that large. Repeated rows and null ids take slots like any other row; with fewer groups than shards
    the last shards are empty; an empty table gives no rows. ``grown_shard`` is null under this law.

    One shuffle brings digests (never texts) into order; everything after it reads the
    table written then. Rows of one text are spread over tasks by their ids.
    """
    spark = docs.sparkSession
    text = F.coalesce("text", F.lit(""))
    rows = text_only(docs).select(
        "doc_id",
        (F.octet_length(text).cast("long") + 1).alias("size"),
        F.crc32(text.cast("binary")).alias("text_crc32"),
        F.unhex(F.sha2(text.cast("binary"), 256)).alias("key"),
    )
    keyed = stored(rows, "sizes")
    dealt = stored(
        keyed.repartitionByRange(partitions(spark), "key", F.col("doc_id").asc_nulls_first()).sortWithinPartitions("key", F.col("doc_id").asc_nulls_first()).withColumn("part", F.spark_partition_id()),
        "ordered",
    )
    # Groups end to end: sums by part and key first, so a text that spans parts is one group.
    groups = dealt.groupBy("key").agg(F.sum("size").alias("bytes"), F.min("part").alias("part"))
    groups = stored(groups, "groups")
    sums = {r["part"]: (r["bytes"], r["largest"]) for r in groups.groupBy("part").agg(F.sum("bytes").alias("bytes"), F.max("bytes").alias("largest")).collect()}
    starts, at = [], 0
    for part in sorted(sums):
        starts.append((part, at))
        at += sums[part][0]
    total, largest = at, max((x[1] for x in sums.values()), default=0)
    offsets = spark.createDataFrame(starts, "part int, before long")
    # One row a part, and parts are as many as shuffle partitions: that bounds the broadcast.
    upto = Window.partitionBy("part").orderBy("key").rowsBetween(Window.unboundedPreceding, 0)
    ends = stored(groups.join(F.broadcast(offsets), "part").select("key", (F.col("before") + F.sum("bytes").over(upto)).alias("end")), "ends")
    _, cuts = minimax_cuts(ends, total, largest, shards, blocks)
    last_keys = sorted(bytes(r["key"]) for r in ends.where(F.col("end").isin(cuts[:-1])).select("key").collect()) if len(cuts) > 1 else []
    number = F.lit(0)
    for key in last_keys:
        number = number + (F.col("key") > F.lit(key)).cast("int")
    placed = dealt.withColumn("shard", number)
    counts = placed.groupBy("part", "shard").agg(F.count(F.lit(1)).alias("n")).collect()
    before: list[tuple[int, int, int]] = []
    filled: dict[int, int] = {}
    for part, number_, n in sorted((r["part"], r["shard"], r["n"]) for r in counts):
        before.append((part, number_, filled.get(number_, 0)))
        filled[number_] = filled.get(number_, 0) + n
    slots = spark.createDataFrame(before, "part int, shard int, first long")
    place = Window.partitionBy("part", "shard").orderBy("key", F.col("doc_id").asc_nulls_first())
    return placed.join(F.broadcast(slots), ["part", "shard"]).select(
        "doc_id",
        "size",
        "text_crc32",
        F.lit("bytes").alias("law"),
        "shard",
        (F.row_number().over(place) - 1 + F.col("first")).alias("slot"),
        F.lit(None).cast("int").alias("grown_shard"),
    )

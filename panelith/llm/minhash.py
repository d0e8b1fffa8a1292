"""Near-duplicates by MinHash: banding, signature verification, exact verification, components.

Texts with equal shingle sets are one class from the start. Classes that share a band are
candidates. A band's bucket is never expanded into all its pairs. Its members are compared in full with one of
them, its center. What two members in different components can still have in common is bounded by what each
shares with the center, unless they also share a shingle that the center lacks; so only pairs that share a
rare shingle outside the center, or whose shares of the center alone could suffice, are made and verified.
That drops no candidate which could be a link.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from panelith.llm.common import drop, frugal, mixed, partitions, powers, stored, text_only, unused, utf8, window_hashes, word_hashes
from panelith.llm.components import components

SHINGLE = 5
#: A link needs so many percent of the union in the intersection, which is 7 shared shingles to 3 of both sets together.
PERCENT = 75
#: 64 bands of 6 minima: a pair at similarity 0.75 is missed with probability (1 - 0.75^6)^64, about 4e-6, while one at 0.3 meets in a band in 5 of 100 cases.
BANDS, ROWS = 64, 6
PERMUTATIONS = BANDS * ROWS
#: Agreement of the one-byte minima below which a candidate is dropped unread: 5.9 standard errors under 0.75, which loses a link with probability under 1e-6.
LEAST_AGREEMENT = 0.62
#: Members that are compared with one copy of their center's set.
GROUP_MEMBERS = 500
#: Counters of shingles by hash, to put rare ones first. Any order gives the same links; a good one makes fewer candidates.
COUNTERS = 1 << 18

_seeds = np.random.default_rng(20240229).integers(1, 2**31, (2, PERMUTATIONS), dtype=np.uint32)
MULTIPLIERS, ADDENDS = _seeds[0] * np.uint32(2) + np.uint32(1), _seeds[1]


def shingle_sets(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct shingle hashes of each text, one text after the other, and their offsets."""
    hashes, ends = word_hashes([t.lower() for t in texts])
    windows = window_hashes(hashes, SHINGLE)
    parts, sizes = [], [0]
    for a, b in zip(ends[:-1].tolist(), ends[1:].tolist(), strict=True):
        if b - a >= SHINGLE:
            own = np.unique(windows[a : b - SHINGLE + 1])
        elif b > a:
            own = window_hashes(hashes[a:b], b - a)
        else:
            own = windows[:0]
        parts.append(own)
        sizes.append(len(own))
    return np.concatenate(parts) if parts else windows[:0], np.cumsum(sizes)


def minima(values: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """The least of each universal hash over each non-empty set: one row a set, one column a hash.

    The hashes are multiply-add modulo 2^32 over the well-mixed high halves of the shingles' hashes.
    """
    out = np.empty((len(ends) - 1, PERMUTATIONS), np.uint32)
    values = (values >> np.uint64(32)).astype(np.uint32)
    start = 0
    while start < len(ends) - 1:
        # Blocks that stay in the processor's cache.
        stop = max(start + 1, int(np.searchsorted(ends, ends[start] + 65_536, "right")) - 1)
        own, heads = values[ends[start] : ends[stop]], ends[start:stop] - ends[start]
        work = np.empty_like(own)
        for j in range(PERMUTATIONS):
            np.multiply(own, MULTIPLIERS[j], out=work)
            np.add(work, ADDENDS[j], out=work)
            out[start:stop, j] = np.minimum.reduceat(work, heads)
        start = stop
    return out


def sketches(docs: DataFrame) -> DataFrame:
    """Per row: ``doc_id, key long, n_shingles long, node binary, bands array<long>, signature binary``; the key is the text's, the last three are null for an empty set."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from map(sketched, batches)

    return text_only(docs).withColumn("key", F.xxhash64("text")).mapInArrow(frugal(run, "text"), "doc_id long, key long, n_shingles long, node binary, bands array<long>, signature binary")


def nodes_of(values: np.ndarray, ends: np.ndarray) -> list[bytes]:
    """128 bits that name each set."""
    return [xxhash.xxh3_128_digest(values[a:b].data) for a, b in zip(ends[:-1].tolist(), ends[1:].tolist(), strict=True)]


def sketched(batch: pa.RecordBatch) -> pa.RecordBatch:
    values, ends = shingle_sets(utf8(batch.column("text")))
    sizes = np.diff(ends)
    full = np.flatnonzero(sizes)
    own_ends = np.concatenate(([0], np.cumsum(sizes[full])))
    least = minima(values, own_ends)
    nodes = nodes_of(values, own_ends)
    keys = least.reshape(len(full), BANDS, ROWS).astype(np.uint64) * powers(0xD6E8FEB86659FD93, ROWS + 1)[1:]
    bands = mixed(keys.sum(axis=2, dtype=np.uint64) + np.arange(BANDS, dtype=np.uint64)).view(np.int64)
    bytes_ = mixed(least.astype(np.uint64)).astype(np.uint8)
    place = np.full(batch.num_rows, -1)
    place[full] = np.arange(len(full))
    take = pa.array(place, pa.int32(), mask=place < 0)
    lists = pa.ListArray.from_arrays(pa.array(np.arange(len(full) + 1, dtype=np.int32) * BANDS), pa.array(bands.reshape(-1)))
    signatures = pa.array([x.tobytes() for x in bytes_], pa.binary())
    return pa.record_batch([batch.column("doc_id"), batch.column("key"), pa.array(sizes, pa.int64()), pa.array(nodes, pa.binary()).take(take), lists.take(take), signatures.take(take)], names=["doc_id", "key", "n_shingles", "node", "bands", "signature"])


def agreeing(pairs: DataFrame, signatures: DataFrame) -> DataFrame:
    """The pairs ``a, b`` whose signatures agree well enough to be worth reading in full."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            one, two = (np.frombuffer(b"".join(batch.column(k).to_pylist()), np.uint8).reshape(-1, PERMUTATIONS) for k in ("sa", "sb"))
            share = ((one == two).mean(axis=1) - 1 / 256) / (255 / 256)
            yield pa.RecordBatch.from_arrays([batch.column("a"), batch.column("b")], names=["a", "b"]).filter(pa.array(share >= LEAST_AGREEMENT))

    with_one = pairs.join(signatures.select(F.col("node").alias("a"), F.col("signature").alias("sa")), "a")
    with_both = with_one.join(signatures.select(F.col("node").alias("b"), F.col("signature").alias("sb")), "b")
    return with_both.select("a", "b", "sa", "sb").mapInArrow(frugal(run), "a binary, b binary")


def class_sets(docs: DataFrame, classes: DataFrame) -> DataFrame:
    """``node, shingles binary`` of ``classes`` (``node, doc_id, key``): sorted 64-bit hashes, from one whole text of each."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            values, ends = shingle_sets(utf8(batch.column("text")))
            sets = pa.array([values[a:b].tobytes() for a, b in zip(ends[:-1].tolist(), ends[1:].tolist(), strict=True)], pa.binary())
            yield pa.record_batch([batch.column("node"), sets], names=["node", "shingles"])

    names = classes.select(F.col("doc_id").alias("own_id"), F.col("key").alias("own_key"), "node")
    own = text_only(docs).withColumn("key", F.xxhash64("text"))
    # Rows of one id and one text are one: any of them tells the set.
    found = own.join(names, F.col("doc_id").eqNullSafe(F.col("own_id")) & (F.col("key") == F.col("own_key"))).select("node", "text").dropDuplicates(["node"])
    return found.mapInArrow(frugal(run, "text"), "node binary, shingles binary")


COMPARED = "center binary, node binary, size int, shared int, linked boolean, rest binary"


def compared(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """Pairs ``center, node`` in full: ``size`` of the node's set, how many shingles are ``shared``, whether that makes a link, and the node's other shingles.

    A center's set is sent once for every ``GROUP_MEMBERS`` members, so neither a text in many pairs nor a center of
    very many members meets in one task.
    """
    counts = pairs.groupBy("center").agg(F.ceil(F.count(F.lit(1)) / GROUP_MEMBERS).cast("int").alias("salts"))
    members = pairs.join(counts, "center").select("center", F.pmod(F.xxhash64("node"), F.col("salts")).cast("int").alias("salt"), "node")
    heads = counts.select("center", F.explode(F.sequence(F.lit(0), F.col("salts") - 1)).alias("salt"), F.col("center").alias("node"))
    rows = members.unionByName(heads).join(sets, "node").withColumn("member", F.col("node") != F.col("center"))
    dealt = rows.repartition(partitions(sets.sparkSession), "center", "salt").sortWithinPartitions("center", "salt", "member")
    names = [x.split()[0] for x in COMPARED.split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        whole = np.empty(0, np.uint64)
        for batch in batches:
            out: list[tuple] = []
            for center, node, shingles, member in zip(*[batch.column(c).to_pylist() for c in ("center", "node", "shingles", "member")], strict=True):
                own = np.frombuffer(shingles, np.uint64)
                if not member:
                    whole = own
                    continue
                hit = whole[np.minimum(np.searchsorted(whole, own), len(whole) - 1)] == own
                both = int(hit.sum())
                out.append((center, node, len(own), both, 100 * both >= PERCENT * (len(own) + len(whole) - both), own[~hit].tobytes()))
            columns = list(zip(*out, strict=True)) or [[]] * 6
            kinds = [pa.binary(), pa.binary(), pa.int32(), pa.int32(), pa.bool_(), pa.binary()]
            yield pa.record_batch([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names=names)

    return dealt.select("center", "node", "shingles", "member").mapInArrow(frugal(run), COMPARED)


def rarity(held: DataFrame) -> np.ndarray:
    """Counts of the shingles in ``rest``, by the leading bits of their hash; counters that one task finds nearly empty are left at nothing."""
    shift = np.uint64(64 - (COUNTERS.bit_length() - 1))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found = np.zeros(COUNTERS, np.int64)
        for batch in batches:
            found += np.bincount((np.frombuffer(b"".join(batch.column("rest").to_pylist()), np.uint64) >> shift).astype(np.int64), minlength=COUNTERS)
        many = np.flatnonzero(found > max(2, 2 * found.mean()))
        yield pa.record_batch([pa.array(many), pa.array(found[many])], names=["slot", "n"])

    out = np.zeros(COUNTERS, np.int64)
    # At most one row a counter.
    rows = held.select("rest").mapInArrow(frugal(run, "rest"), "slot long, n long").groupBy("slot").agg(F.sum("n").alias("n")).toPandas()
    out[rows["slot"].to_numpy(np.int64)] = rows["n"].to_numpy(np.int64)
    return out


def rare_shingles(held: DataFrame, counts: np.ndarray) -> DataFrame:
    """One row for each of a node's rarest shingles outside the center that a link needs to share one of.

    A link shares at least three quarters of each set. In any order of all shingles in which the center's come last, the first
    one that two linked sets share is among the first ``size - ceil(3/4 size) + 1`` of both; if they share
    any outside the center, that first one lies outside it.
    """
    shared = held.sparkSession.sparkContext.broadcast(counts)
    shift = np.uint64(64 - (COUNTERS.bit_length() - 1))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counters = shared.value
        for batch in batches:
            picks, places, takes, rests = [], [], [], batch.column("rest").to_pylist()
            for center, size, rest in zip(batch.column("center").to_pylist(), batch.column("size").to_pylist(), rests, strict=True):
                own = np.frombuffer(rest, np.uint64)
                own = own[np.lexsort((own, counters[(own >> shift).astype(np.int64)]))][: size + (-3 * size) // 4 + 1]
                picks.append(mixed(own ^ np.uint64(xxhash.xxh3_64_intdigest(center))))
                places.append(np.arange(1, len(own) + 1, dtype=np.int32))
                takes.append(len(own))
            if picks:
                of = pa.array(np.repeat(np.arange(len(takes)), takes))
                outside = pa.array(np.repeat([len(x) // 8 for x in rests], takes).astype(np.int32))
                columns = [pa.array(np.concatenate(picks).view(np.int64)), batch.column("node").take(of), batch.column("side").take(of), batch.column("size").take(of), batch.column("shared").take(of), pa.array(np.concatenate(places)), outside]
                yield pa.record_batch(columns, names=["slot", "node", "side", "size", "shared", "place", "outside"])

    return held.select("center", "node", "side", "size", "shared", "rest").mapInArrow(frugal(run, "rest"), "slot long, node binary, side long, size int, shared int, place int, outside int")


def pairs_left(members: DataFrame, found: DataFrame, joined: DataFrame) -> DataFrame:
    """Pairs ``a, b`` in different components that share a live bucket and could be linked, neither being the bucket's center.

    With A and B compared with center C, the intersection of A and B has at most min(|A and C|, |B and C|)
    shingles of C. If they share none outside C, that bound alone must reach 3/7 (|A| + |B|); otherwise both hold the
    rarest shared one among their ``rare_shingles``.
    """
    of = members.join(joined, "node", "left").select("band", "center", "node", F.xxhash64(F.coalesce("component", "node")).alias("side"))
    live = stored(of.groupBy("band").agg(F.min("side").alias("low"), F.max("side").alias("high")).where("low < high").select("band"), "live")
    own = stored(of.join(live, "band"), "own")
    held = stored(found.join(own.select("center", "node", "side").distinct(), ["center", "node"]), "held")
    rare = rare_shingles(held, rarity(held))
    slots = stored(rare.groupBy("slot").agg(F.min("side").alias("low"), F.max("side").alias("high")).where("low < high").select("slot"), "slots")
    common = stored(rare.join(slots, "slot"), "common")

    def sides(rows: DataFrame) -> tuple[DataFrame, DataFrame]:
        return rows.alias("x"), rows.alias("y")

    sizes = "x.side <> y.side and 4 * least(x.size, y.size) >= 3 * greatest(x.size, y.size)"
    x, y = sides(common)
    bound = "7 * (least(x.shared, y.shared) + 1 + least(x.outside - x.place, y.outside - y.place)) >= 3 * (x.size + y.size)"
    sharing = x.join(y, F.expr(f"x.slot = y.slot and x.node < y.node and {sizes} and {bound}")).select(F.col("x.node").alias("a"), F.col("y.node").alias("b"))
    # Sets that lie in the center but for a quarter; of a pair, one at least is not in the center's component.
    inner = own.join(held.where("4 * shared >= 3 * size").select("center", "node", "size", "shared"), ["center", "node"])
    homes = joined.select(F.col("node").alias("center"), F.xxhash64("component").alias("home"))
    inner = stored(inner.join(homes, "center", "left").select("band", "node", "side", "size", "shared", (F.col("side") != F.coalesce("home", F.xxhash64("center"))).alias("stray")), "inner")
    x, y = sides(inner)
    near = x.where("stray").alias("x").join(y, F.expr(f"x.band = y.band and {sizes} and 7 * least(x.shared, y.shared) >= 3 * (x.size + y.size)"))
    near = near.select(F.least("x.node", "y.node").alias("a"), F.greatest("x.node", "y.node").alias("b"))
    out = stored(sharing.union(near).distinct(), "pairs")
    drop(live, own, held, slots, common, inner)
    return out


def merged(old: DataFrame, links: DataFrame) -> DataFrame:
    """``node, component`` after further links between nodes; only links between components are gone through."""
    name = lambda c, to: old.select(F.col("node").alias(c), F.col("component").alias(to))
    between = links.join(name("a", "ca"), "a", "left").join(name("b", "cb"), "b", "left").select(F.coalesce("ca", "a").alias("u"), F.coalesce("cb", "b").alias("v"))
    above = stored(components(between), "above")
    lifted = old.join(above.select(F.col("node").alias("component"), F.col("component").alias("to")), "component", "left").select("node", F.coalesce("to", "component").alias("component"))
    fresh = above.join(old.select("node"), "node", "left_anti")
    out = stored(lifted.union(fresh), "components")
    drop(above)
    return out


def classes_joined(rows: DataFrame, docs: DataFrame) -> DataFrame:
    """``node, component`` of all classes with a link to another."""
    spread = rows.where("node is not null").select("node", F.explode("bands").alias("band"))
    buckets = stored(spread.groupBy("band").agg(F.min("node").alias("low"), F.max("node").alias("high")).where("low < high").select("band"), "buckets")
    members = stored(spread.join(buckets, "band").select("band", "node").distinct(), "members")
    # The text that others were made from stands in more, and in larger, buckets than its copies: it makes the best center.
    sizes = members.groupBy("band").agg(F.count(F.lit(1)).alias("n"))
    weights = stored(members.join(sizes, "band").groupBy("node").agg(F.sum("n").alias("weight")), "weights")
    centers = members.join(weights, "node").groupBy("band").agg(F.max(F.struct("weight", "node"))["node"].alias("center"))
    grouped = stored(members.join(centers, "band").where("node <> center"), "grouped")
    # Copies of one set become a row a task before anything is shuffled by their node.
    named = rows.where("node is not null").groupBy("node").agg(F.min(F.struct("doc_id", "key")).alias("x"), F.first("signature").alias("signature"))
    classes = stored(named.join(weights.select("node"), "node", "left_semi").select("node", "x.*", "signature"), "classes")
    drop(buckets, members, weights)
    sets = stored(class_sets(docs, classes), "sets")
    found = stored(compared(grouped.select("center", "node").distinct(), sets), "compared")
    joined = stored(components(found.where("linked").select(F.col("center").alias("u"), F.col("node").alias("v"))), "components")
    pairs = pairs_left(grouped, found, joined)
    drop(grouped, found)
    likely = stored(agreeing(pairs, classes).withColumnsRenamed({"a": "center", "b": "node"}), "likely")
    links = stored(compared(likely, sets).where("linked").select(F.col("center").alias("a"), F.col("node").alias("b")), "links")
    out = merged(joined, links)
    drop(classes, sets, joined, pairs, likely, links)
    return out


def clustered(docs: DataFrame) -> DataFrame:
    """Per row of ``docs``: ``doc_id, key, n_shingles, component, component_id, kept``; the component is null for an empty set."""
    rows = stored(sketches(docs), "sketches")
    joined = classes_joined(rows, docs)
    slim = stored(rows.select("doc_id", "key", "n_shingles", "node"), "slim")
    drop(rows)
    named = stored(slim.where("node is not null").groupBy("node").agg(F.min("doc_id").alias("doc_id")).join(joined, "node", "left").select("node", "doc_id", F.coalesce("component", "node").alias("component")), "named")
    least = named.groupBy("component").agg(F.min("doc_id").alias("component_id"))
    ids = stored(named.join(least, "component").select("node", "component", "component_id"), "ids")
    drop(joined, named)
    out = slim.join(ids, "node", "left")
    component = F.when(F.col("node").isNull(), F.col("doc_id")).otherwise(F.col("component_id"))
    return out.select("doc_id", "key", "n_shingles", "component", component.alias("component_id"), F.col("doc_id").eqNullSafe(component).alias("kept"))


def near_duplicates(docs: DataFrame) -> DataFrame:
    """Per row of ``docs``: ``doc_id, n_shingles, component_id, kept``.

    Words are lower-cased in A-Z and split at ASCII white space; a text of fewer than five words
    is one shingle. Null and empty texts have no shingles, link with nothing and are kept. Equal sets
    are linked; repeated rows share their component; a null id counts in no minimum and is kept
    only where its whole component has none. Other columns are ignored; an empty table gives no rows.

    Classes are named by 128 bits of their set's digest. No bucket, class or component is ever
    collected in one task: hot buckets are aggregated before they are shuffled, joins on them read plain
    shuffles, which adaptive execution splits, and all intermediate tables are written to the shared folder.
    The pairs made grow with the square of a group only where its members share rare shingles that their center lacks and yet are no links.
    """
    return clustered(docs).select("doc_id", "n_shingles", "component_id", "kept")


def deduplicated(docs: DataFrame) -> DataFrame:
    """The rows of ``docs`` that stay, all columns unchanged: one of each component, of its least id and, of several texts under that id, the one of least hash.

    Rows without shingles all stay. Texts of different components stay whether or not they share an id or have none.
    Column names of ``docs`` can't clash; an empty table gives no rows.
    """
    first = clustered(docs).where("kept and component is not null").groupBy("component").agg(F.min(F.struct("doc_id", "key")).alias("x"))
    own_id, own_key = unused(docs.columns, "row_id"), unused(docs.columns, "row_key")
    kept_id, kept_key = unused([*docs.columns, own_id], "kept_id"), unused([*docs.columns, own_key], "kept_key")
    kept = stored(first.select(F.col("x.doc_id").alias(kept_id), F.col("x.key").alias(kept_key)), "kept")
    text = F.col("text").cast("string")
    bare = F.coalesce(text, F.lit("")).rlike(r"\A[ \t\n\x0B\f\r]*\z")
    own = docs.where(~bare).withColumns({own_id: F.col("doc_id").cast("long"), own_key: F.xxhash64(text)})
    once = own.join(kept, F.col(own_id).eqNullSafe(F.col(kept_id)) & (F.col(own_key) == F.col(kept_key)), "left_semi").dropDuplicates([own_id, own_key])
    return once.drop(own_id, own_key).unionByName(docs.where(bare))

"""A hidden Markov language model: Baum-Welch over partitions, exact likelihood by the scaled forward recursion.

Every word of the training texts has emissions of its own in every state; words never trained on
share one. The most frequent words are a table of bounded size that every task holds. Documents are
dealt once into parts of bounded size, whose texts become word numbers. A part's other words are dealt out by their
hash, packed, so that the parts' expected counts meet and their sums return to each part's own file in every iteration.

Words are told apart by 64-bit hashes. Posteriors are rounded to 1/1024 where they are made, so that their sums are the same in
any order and short to send; the likelihood is that of the model, without rounding.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.parquet as pq
import xxhash
from pyarrow import fs
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from panelith.llm.common import delete, drop, frugal, mixed, partitions, scratch_path, stored, utf8
from panelith.llm.repeats import bucket_bits

STATES = 4
#: Words whose emissions every task holds, at most; those of the others reach each part by file. It makes no difference to the result.
HEAD = 131_072
#: Tokens after which a part of the documents ends.
PART_TOKENS = 4_000_000
#: Steps of Baum-Welch.
ITERATIONS = 3
#: Tokens whose forward and backward values are held at once.
SLICE_TOKENS = 200_000
#: Pseudo-counts, spread as all words are, that each state starts a maximization with.
PRIOR = 100.0
#: The end of a text: no word is empty.
END = b""
#: What an occurrence's posteriors sum to.
UNITS = 1024
#: Frequent words whose sums travel in one row.
CHUNK = 8192


def held_out() -> Column:
    """Whether a row is not trained on: CRC-32 of the id's decimal text leaves 1 modulo 5. A null id is trained on."""
    return F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5 == 1, F.lit(False))


def keyed(docs: DataFrame) -> DataFrame:
    own = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return own.select("doc_id", "text", held_out().alias("held_out"))


def word_hash(word: bytes) -> int:
    """Signed, as columns are."""
    value = xxhash.xxh3_64_intdigest(word)
    return value - (1 << 64) if value >> 63 else value


def word_counts(texts: DataFrame) -> DataFrame:
    """``wid long, c long`` of all tokens, the end of each text as the empty word. Counts combine in each piece and each task."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found: Counter[bytes] = Counter()
            for text in utf8(batch.column("text")):
                found.update(text.lower().split())
            found[END] += batch.num_rows
            yield pa.record_batch([pa.array(list(map(word_hash, found)), pa.int64()), pa.array(list(found.values()), pa.int64())], names=["wid", "n"])

    return texts.select("text").mapInArrow(frugal(run, "text", 16_000_000), "wid long, n long").groupBy("wid").agg(F.sum("n").alias("c"))


@dataclass
class Vocabulary:
    """The frequent words' hashes and counts, and the sums over all words and the counts of all."""

    counts: np.ndarray
    hashes: np.ndarray
    total: int
    distinct: int
    table: DataFrame

    @property
    def whole(self) -> float:
        """All tokens and half a one for each word, unseen ones together counting as one."""
        return self.total + 0.5 * (self.distinct + 1)


def vocabulary(counts: DataFrame, head: int = HEAD) -> Vocabulary:
    """Words of the greatest counts, all words of a count or none, so that there are at most ``head`` and the end."""
    sums = counts.agg(F.coalesce(F.sum("c"), F.lit(0)).alias("total"), F.count(F.lit(1)).alias("distinct")).first()
    # Distinct counts are at most about the root of twice the number of tokens; those beyond the head are left out of what comes to the driver.
    levels = counts.groupBy("c").agg(F.count(F.lit(1)).alias("n")).orderBy(F.col("c").desc()).limit(head).collect()
    least, taken = None, 0
    for row in levels:
        taken += row["n"]
        if taken > head:
            break
        least = row["c"]
    end = F.col("wid") == word_hash(END)
    wanted = end if least is None else (F.col("c") >= least) | end
    rows = counts.where(wanted).orderBy(F.col("c").desc(), "wid").toPandas()
    return Vocabulary(rows["c"].to_numpy(np.int64), rows["wid"].to_numpy(np.int64), int(sums["total"]), int(sums["distinct"]), counts)


@dataclass
class Model:
    start: np.ndarray
    step: np.ndarray
    emit: np.ndarray  # one row a frequent word, the last for all others together; each state's column sums to one
    norm: np.ndarray | None = None  # what each state's unscaled emissions over all words sum to


def unscaled(counts: np.ndarray, hashes: np.ndarray, sums: np.ndarray | None, whole: float, states: int) -> np.ndarray:
    """Emissions of words up to each state's ``norm``: expected counts and the prior or, at the start, shares tilted by a hash of word and state."""
    share = ((counts + 0.5) / whole)[:, None]
    if sums is not None:
        return sums + PRIOR * share
    keys = hashes.view(np.uint64)[:, None] * np.uint64(states) + np.arange(states, dtype=np.uint64)
    tilt = 0.5 + mixed(keys + np.uint64(1)).astype(np.float64) / 2.0**64
    return share * np.where((counts > 0)[:, None], tilt, 1.0)


def with_others(own: np.ndarray, norm: np.ndarray) -> np.ndarray:
    """Scaled emissions of the frequent words and, last, what is left for all others."""
    emit = own / norm
    return np.vstack((emit, np.maximum(1.0 - emit.sum(axis=0), 1e-12)))


def first_model(v: Vocabulary, states: int) -> Model:
    """States that stay with high probability, and emissions tilted by a hash of word and state."""
    names, whole = [f"s{i}" for i in range(states)], v.whole

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sums = unscaled(batch.column("c").to_numpy(), batch.column("wid").to_numpy(), None, whole, states).sum(axis=0)
            yield pa.record_batch([pa.array([x]) for x in sums], names=names)

    tilted = v.table.select("c", "wid").mapInArrow(frugal(run), ", ".join(f"{n} double" for n in names))
    sums = tilted.agg(*[F.coalesce(F.sum(n), F.lit(0.0)) for n in names]).first()
    norm = np.array(sums) + 0.5 / whole
    step = np.full((states, states), 0.02 / max(1, states - 1))
    np.fill_diagonal(step, 0.98 if states > 1 else 1.0)
    return Model(np.full(states, 1 / states), step, with_others(unscaled(v.counts, v.hashes, None, whole, states), norm), norm)


class Ids(dict):
    """Numbers of frequent words; any other word has the next free number of its part."""

    def __init__(self, known: dict[int, int]):
        super().__init__()
        self.known = known
        self.others: list[int] = []

    def __missing__(self, word: bytes) -> int:
        wid = word_hash(word)
        value = self.known.get(wid)
        if value is None:
            value = len(self.known) + len(self.others)
            self.others.append(wid)
        self[word] = value
        return value


BASE_SCHEMA = "doc_id long, held_out boolean, ids binary, bucket int, wids binary, uses binary, part long"
BASE_FIELDS = pa.schema([("doc_id", pa.int64()), ("held_out", pa.bool_()), ("ids", pa.binary()), ("bucket", pa.int32()), ("wids", pa.binary()), ("uses", pa.binary()), ("part", pa.int64())])


def numbered(texts: DataFrame, v: Vocabulary, part_tokens: int = PART_TOKENS) -> str:
    """Writes documents in a folder for each part: rows ``doc_id, held_out, ids`` with a text's word numbers, its end included, and rows ``bucket, wids, uses``
    with the hashes of the part's words that are not frequent and how often it trains on them. These words' numbers follow the frequent ones' in the order of the rows."""
    spark = texts.sparkSession
    shared, bits = spark.sparkContext.broadcast(v.hashes), bucket_bits(partitions(spark))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = {w: i for i, w in enumerate(shared.value.tolist())}
        part, tokens, ids = TaskContext.get().partitionId() << 32, 0, Ids(known)
        held: list[tuple] = []

        def finished() -> Iterator[pa.RecordBatch]:
            wids = np.array(ids.others, np.int64)
            buckets = (wids.view(np.uint64) >> np.uint64(64 - bits)).astype(np.int64)
            order = np.argsort(buckets, kind="stable")
            place = np.arange(len(known) + len(wids), dtype=np.int32)
            place[len(known) + order] = len(known) + np.arange(len(wids), dtype=np.int32)
            uses = np.zeros(len(place), np.int64)
            for doc_ids, out, values, ends in held:
                values = place[values]
                n = len(doc_ids)
                uses += np.bincount(values[np.repeat(~out.to_numpy(zero_copy_only=False), np.diff(ends))], minlength=len(place))
                texts_ = pa.Array.from_buffers(pa.binary(), n, [None, pa.py_buffer((4 * ends).astype(np.int32)), pa.py_buffer(values)])
                yield pa.record_batch([doc_ids, out, texts_, *[pa.nulls(n, x.type) for x in list(BASE_FIELDS)[3:6]], pa.array(np.full(n, part))], schema=BASE_FIELDS)
            cuts = np.flatnonzero(np.diff(buckets[order], prepend=-1, append=-1)).tolist()
            own, uses = wids[order], uses[len(known) :].astype("<u4")
            for a, b in zip(cuts[:-1], cuts[1:], strict=True):
                yield pa.record_batch([*[pa.nulls(1, x.type) for x in list(BASE_FIELDS)[:3]], pa.array([int(buckets[order[a]])], pa.int32()), pa.array([own[a:b].astype("<i8").tobytes()], pa.binary()), pa.array([uses[a:b].tobytes()], pa.binary()), pa.array([part])], schema=BASE_FIELDS)

        for batch in batches:
            values, ends = sequences(utf8(batch.column("text")), ids)
            held.append((batch.column("doc_id"), batch.column("held_out"), values.astype(np.int32), ends))
            tokens += len(values)
            if tokens >= part_tokens:
                yield from finished()
                part, tokens, ids = part + 1, 0, Ids(known)
                held.clear()
        if held:
            yield from finished()

    path = scratch_path(spark, "numbered")
    # A task writes the parts it makes.
    texts.select("doc_id", "held_out", "text").mapInArrow(frugal(run, "text", 1_000_000), BASE_SCHEMA).write.option("compression", "zstd").partitionBy("part").parquet(path)
    return path


def read(spark: SparkSession, path: str, schema: str) -> DataFrame:
    return spark.read.schema(schema).parquet(path)


def narrow(values: np.ndarray) -> bytes:
    """Numbers of at least 0 in two, four or eight bytes each, as the greatest needs; the first byte tells which."""
    most = int(values.max()) if values.size else 0
    width = 2 if most < 1 << 16 else 4 if most < 1 << 32 else 8
    return bytes([width]) + np.ascontiguousarray(values).astype(f"<u{width}").tobytes()


def wide(data: bytes) -> np.ndarray:
    return np.frombuffer(data, f"<u{data[0]}", offset=1).astype(np.int64)


SENT, BACK = "bucket int, part long, ranks binary, uses binary, units binary", "bucket int, ranks binary, units binary, part long"
SENT_KINDS, BACK_KINDS = [pa.int32(), pa.int64(), *[pa.binary()] * 3], [pa.int32(), pa.binary(), pa.binary(), pa.int64()]


def rows_of(rows: list[tuple], kinds: list, schema: str) -> pa.RecordBatch:
    columns = list(zip(*rows, strict=True)) or [[]] * len(kinds)
    return pa.record_batch([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names=[x.split()[0] for x in schema.split(", ")])


def exchanged(sent: DataFrame, total: Callable[[int, list[tuple]], Iterator[tuple]]) -> str:
    """Brings the rows of each bucket together, a bucket at a time, and writes what ``total`` makes of them in a folder for each part."""
    spark = sent.sparkSession

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, held = None, []
        for batch in batches:
            for bucket, *row in zip(*[c.to_pylist() for c in batch.columns], strict=True):
                if bucket != now and held:
                    yield rows_of(list(total(now, held)), BACK_KINDS, BACK)
                    held = []
                now = bucket
                held.append(tuple(row))
        if held:
            yield rows_of(list(total(now, held)), BACK_KINDS, BACK)

    dealt = sent.repartition(partitions(spark), "bucket").sortWithinPartitions("bucket")
    path = scratch_path(spark, "part-words")
    dealt.mapInArrow(frugal(run), BACK).repartition("part").write.option("compression", "zstd").partitionBy("part").parquet(path)
    return path


def first_counts(spark: SparkSession, base: str) -> str:
    """For each part's other words: their rank among all of their bucket, and how often all parts train on them."""

    def total(bucket: int, rows: list[tuple]) -> Iterator[tuple]:
        wids = [np.frombuffer(x[2], "<i8") for x in rows]
        distinct, inverse = np.unique(np.concatenate(wids), return_inverse=True)
        counts = np.zeros(len(distinct), np.int64)
        np.add.at(counts, inverse, np.concatenate([np.frombuffer(x[3], "<u4") for x in rows]).astype(np.int64))
        at = 0
        for (part, *_), own in zip(rows, wids, strict=True):
            ranks = inverse[at : at + len(own)]
            at += len(own)
            yield bucket, narrow(ranks), narrow(counts[ranks]), part

    words = read(spark, base, BASE_SCHEMA).where("bucket is not null")
    return exchanged(words.select("bucket", "part", F.lit(None).cast("binary").alias("ranks"), F.col("wids"), F.col("uses")), total)


@dataclass
class Part:
    """A part's words that are not frequent, in the order of their numbers: bucket by bucket, with expected units over all parts if there are any."""

    number: int
    buckets: list[int]
    sizes: list[int]
    ranks: list[bytes]
    hashes: np.ndarray
    counts: np.ndarray
    sums: np.ndarray | None


def part_rows(path: str, part: int, columns: list[str]) -> list[dict]:
    """A part's rows that have a bucket, by bucket."""
    system, folder = fs.FileSystem.from_uri(path)
    folder = f"{folder}/part={part}"
    if system.get_file_info(folder).type == fs.FileType.NotFound:
        return []
    out: list[dict] = []
    for file in system.get_file_info(fs.FileSelector(folder)):
        if file.path.endswith(".parquet"):
            with system.open_input_file(file.path) as handle:
                table = pq.ParquetFile(handle).read(columns=["bucket", *columns])
                out += table.filter(table.column("bucket").is_valid()).to_pylist()
    return sorted(out, key=lambda x: x["bucket"])


def joined(parts: list[np.ndarray], kind: type = np.int64) -> np.ndarray:
    return np.concatenate(parts) if parts else np.empty(0, kind)


def read_part(paths: tuple[str, str, str | None], part: int, states: int) -> Part:
    base, first, last = paths
    words, found = part_rows(base, part, ["wids"]), part_rows(first, part, ["ranks", "units"])
    hashes = [np.frombuffer(x["wids"], "<i8") for x in words]
    counts = joined([wide(x["units"]) for x in found])
    sums = None
    if last:
        units = joined([wide(x["units"]) for x in part_rows(last, part, ["units"])]).reshape(-1, states - 1)
        sums = np.column_stack((units, UNITS * counts - units.sum(axis=1))) / UNITS
    return Part(part, [x["bucket"] for x in words], [len(x) for x in hashes], [x["ranks"] for x in found], joined(hashes), counts, sums)


def part_model(model: Model, part: Part, whole: float) -> Model:
    """The model over the numbers of a part: frequent words, then the part's own."""
    own = unscaled(part.counts, part.hashes, part.sums, whole, len(model.start)) / model.norm
    return Model(model.start, model.step, np.vstack((model.emit[:-1], own)))


def runs(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int, pa.RecordBatch]]:
    """Rows of one part each, with its number."""
    for batch in batches:
        if batch.num_rows:
            parts = batch.column("part").to_numpy()
            cuts = [0, *(np.flatnonzero(np.diff(parts)) + 1).tolist(), len(parts)]
            for a, b in zip(cuts[:-1], cuts[1:], strict=True):
                yield int(parts[a]), batch.slice(a, b - a)


def unpacked(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Word numbers of all rows and the rows' offsets."""
    held = column.to_pylist()
    return np.frombuffer(b"".join(held), np.int32).astype(np.int64), np.concatenate(([0], np.cumsum([len(x) // 4 for x in held])))


def sequences(texts: list[bytes], ids: Ids) -> tuple[np.ndarray, np.ndarray]:
    """Word numbers of all texts, each with its end, and the texts' offsets."""
    words: list[bytes] = []
    ends = [0]
    for text in texts:
        words += text.lower().split()
        words.append(END)
        ends.append(len(words))
    return np.fromiter(map(ids.__getitem__, words), np.int64, len(words)), np.array(ends)


def slices(lengths: np.ndarray) -> Iterator[np.ndarray]:
    """Texts from long to short, in groups of bounded size; texts of like length step together."""
    order = np.argsort(-lengths, kind="stable")
    sums = np.cumsum(lengths[order])
    start = 0
    while start < len(order):
        before = sums[start - 1] if start else 0
        stop = max(start + 1, int(np.searchsorted(sums, before + SLICE_TOKENS, "right")))
        yield order[start:stop]
        start = stop


def by_step(ids: np.ndarray, ends: np.ndarray, picks: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The picked texts' words by step, then text; and the offsets of the steps. Texts must come from long to short."""
    lengths = ends[picks + 1] - ends[picks]
    active = np.searchsorted(-lengths, -np.arange(lengths[0]), "left")
    offsets = np.concatenate(([0], np.cumsum(active)))
    text = np.repeat(np.arange(len(picks)), lengths)
    at = np.arange(len(text)) - np.repeat(np.cumsum(lengths) - lengths, lengths)
    out = np.empty(len(text), np.int64)
    out[offsets[at] + text] = ids[ends[picks][text] + at]
    return out, offsets


def forward(model: Model, words: np.ndarray, offsets: np.ndarray, keep: bool = False) -> tuple[np.ndarray, np.ndarray | None, np.ndarray | None, np.ndarray]:
    """Log-likelihood of each text; if asked, the scaled forward values and scales of every step; and the emissions."""
    emit = model.emit[words]
    cuts = offsets.tolist()
    now = model.start * emit[: cuts[1]]
    out = np.zeros(cuts[1])
    values = np.empty_like(emit) if keep else None
    scales = np.empty(len(words)) if keep else None
    for t in range(len(cuts) - 1):
        a, b = cuts[t], cuts[t + 1]
        if t:
            now = now[: b - a] @ model.step
            now *= emit[a:b]
        scale = now.sum(axis=1)
        now /= scale[:, None]
        out[: b - a] += np.log(scale)
        if keep:
            values[a:b], scales[a:b] = now, scale
    return out, values, scales, emit


def rounded(values: np.ndarray) -> np.ndarray:
    """Posteriors of occurrences as whole units that sum to ``UNITS`` and are never less than 0."""
    out = np.rint(values * UNITS)
    out[:, -1] = UNITS - out[:, :-1].sum(axis=1)
    short = np.flatnonzero(out[:, -1] < 0)
    out[short, out[short].argmax(axis=1)] += out[short, -1]
    out[short, -1] = 0
    return out


def expected(model: Model, words: np.ndarray, offsets: np.ndarray, into: tuple[np.ndarray, np.ndarray, np.ndarray]) -> float:
    """Adds expected starts, steps and emissions of the texts; returns their log-likelihood."""
    starts, steps, emissions = into
    likelihood, values, scales, emit = forward(model, words, offsets, keep=True)
    cuts = offsets.tolist()
    ahead = None
    moves = np.zeros_like(steps)
    for t in range(len(cuts) - 2, -1, -1):
        a, b = cuts[t], cuts[t + 1]
        back = np.ones((b - a, len(starts)))
        if ahead is not None:
            n = len(ahead)
            moves += values[a : a + n].T @ ahead
            back[:n] = ahead @ model.step.T
        ahead = emit[a:b] * back
        ahead /= scales[a:b, None]
        values[a:b] *= back
    steps += moves * model.step
    starts += values[: cuts[1]].sum(axis=0)
    units = rounded(values)
    for s in range(len(starts)):
        emissions[:, s] += np.bincount(words, weights=units[:, s], minlength=len(emissions)) / UNITS
    return float(likelihood.sum())


def maximized(sums: np.ndarray, spent: np.ndarray, steps: np.ndarray, starts: np.ndarray, v: Vocabulary) -> Model:
    """``sums`` are the frequent words' expected counts, ``spent`` those of all words together."""
    norm = spent + PRIOR
    steps, starts = steps + 1e-3, starts + 1e-3
    emit = with_others(unscaled(v.counts, v.hashes, sums, v.whole, len(starts)), norm)
    return Model(starts / starts.sum(), steps / steps.sum(axis=1, keepdims=True), emit, norm)


def fitted(spark: SparkSession, base: str, v: Vocabulary, states: int, iterations: int) -> tuple[Model, list[float], tuple[str, str, str | None]]:
    """Baum-Welch over the ``numbered`` rows not held out: each task adds up its expected counts a part, and buckets of words add the parts'.

    What returns to the driver is one row a frequent word, which ``HEAD`` bounds. The second result is the
    log-likelihood before each maximization, the third where the parts' words, their counts and their expected counts are.
    """
    whole, n_known, k = v.whole, len(v.counts), states
    texts = read(spark, base, BASE_SCHEMA).where("ids is not null").select("part", "held_out", "ids")
    paths = base, first_counts(spark, base), None
    model, course = first_model(v, states), []
    # Rows of other sums: starts, steps, what each state spends, and the likelihood.
    rest = -1 - -(-n_known // CHUNK)

    def total(bucket: int, rows: list[tuple]) -> Iterator[tuple]:
        if bucket < 0:
            kind = "<f8" if bucket == rest else "<i8"
            yield bucket, None, sum(np.frombuffer(x[3], kind) for x in rows).astype(kind).tobytes(), -1
            return
        ranks = [wide(x[1]) for x in rows]
        sums = np.zeros((max(int(x.max()) for x in ranks) + 1, k - 1), np.int64)
        for own, row in zip(ranks, rows, strict=True):
            np.add.at(sums, own, wide(row[3]).reshape(len(own), k - 1))
        # Rows of a part that several tasks read are one.
        for part, own in {row[0]: own for own, row in zip(ranks, rows, strict=True)}.items():
            yield bucket, None, narrow(sums[own]), part

    for _ in range(iterations):
        shared = spark.sparkContext.broadcast((model, paths))

        def run(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            whole_model, places = shared.value
            common, steps, starts, spent = np.zeros((n_known, k)), np.zeros((k, k)), np.zeros(k), np.zeros(k)
            likelihood, now = 0.0, None

            def sums_of(part: Part, found: np.ndarray) -> Iterator[pa.RecordBatch]:
                nonlocal common, spent
                common += found[:n_known]
                spent += found.sum(axis=0)
                units = np.rint(found[n_known:, : k - 1] * UNITS).astype(np.int64)
                at, out = 0, []
                for bucket, size, ranks in zip(part.buckets, part.sizes, part.ranks, strict=True):
                    out.append((bucket, part.number, ranks, None, narrow(units[at : at + size])))
                    at += size
                yield rows_of(out, SENT_KINDS, SENT)

            for number, batch in runs(batches):
                if now is None or now.number != number:
                    if now is not None:
                        yield from sums_of(now, into[2])
                    now = read_part(places, number, k)
                    own = part_model(whole_model, now, whole)
                    into = starts, steps, np.zeros((len(own.emit), k))
                words, ends = unpacked(batch.filter(pa.array(~batch.column("held_out").to_numpy(zero_copy_only=False))).column("ids"))
                for picks in slices(np.diff(ends)):
                    likelihood += expected(own, *by_step(words, ends, picks), into)
            if now is not None:
                yield from sums_of(now, into[2])
                units = np.rint(common * UNITS).astype("<i8")
                out = [(-1 - at // CHUNK, -1, None, None, units[at : at + CHUNK].tobytes()) for at in range(0, n_known, CHUNK)]
                out.append((rest, -1, None, None, np.concatenate((starts, steps.reshape(-1), spent, [likelihood])).astype("<f8").tobytes()))
                yield rows_of(out, SENT_KINDS, SENT)

        path = exchanged(texts.mapInArrow(frugal(run, "ids"), SENT), total)
        found = {x["bucket"]: bytes(x["units"]) for x in read(spark, path, BACK).where("part = -1").collect()}
        emissions = np.zeros((n_known, k))
        starts, steps, spent, likelihood = np.zeros(k), np.zeros((k, k)), np.zeros(k), 0.0
        if found:
            emissions = np.concatenate([np.frombuffer(found[b], "<i8") for b in range(-1, rest, -1)] or [np.empty(0)]).reshape(n_known, k) / UNITS
            other = np.frombuffer(found[rest], "<f8")
            starts, steps, spent, likelihood = other[:k], other[k : k + k * k].reshape(k, k), other[k + k * k : -1], float(other[-1])
        course.append(likelihood)
        model = maximized(emissions, spent, steps, starts, v)
        delete(spark, paths[2])
        paths = paths[0], paths[1], path
        shared.unpersist()
    return model, course, paths


def train(texts: DataFrame, v: Vocabulary, states: int = STATES, iterations: int = ITERATIONS) -> tuple[Model, list[float]]:
    """Baum-Welch over all texts, and the log-likelihood before each maximization. Null and empty texts are their end alone."""
    return fitted(texts.sparkSession, numbered(texts.withColumn("held_out", F.lit(False)), v), v, states, iterations)[:2]


def scored(docs: DataFrame, states: int = STATES, iterations: int = ITERATIONS, head: int = HEAD, part_tokens: int = PART_TOKENS) -> DataFrame:
    """Per row: ``doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score``.

    A null or empty text is its end alone; null ids are trained on; repeated rows count and are scored each; other
    columns are ignored; without training rows every word is unknown, and an empty table gives no rows. Both
    scores are log10 probabilities over the same words, unseen ones together counting as one.
    """
    spark = docs.sparkSession
    texts = keyed(docs)
    counts = stored(word_counts(texts.where(~F.col("held_out"))), "words")
    v = vocabulary(counts, head)
    base = numbered(texts, v, part_tokens)
    model, _, paths = fitted(spark, base, v, states, iterations)
    drop(counts)
    whole, common_counts = v.whole, v.counts
    shared = spark.sparkContext.broadcast((model, common_counts, paths))

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        whole_model, common, places = shared.value
        now = None
        for number, batch in runs(batches):
            if now is None or now.number != number:
                now = read_part(places, number, states)
                own = part_model(whole_model, now, whole)
                counts = np.concatenate((common, now.counts))
                logs = np.log10((counts + 0.5) / whole)
            words, ends = unpacked(batch.column("ids"))
            likelihood = np.empty(batch.num_rows)
            for picks in slices(np.diff(ends)):
                likelihood[picks] = forward(own, *by_step(words, ends, picks))[0]
            known = np.add.reduceat((counts[words] > 0).astype(np.int64), ends[:-1])
            base_ = np.add.reduceat(logs[words], ends[:-1])
            columns = [batch.column("doc_id"), batch.column("held_out"), pa.array(np.diff(ends)), pa.array(known), pa.array(base_), pa.array(likelihood / np.log(10))]
            yield pa.record_batch(columns, names=["doc_id", "held_out", "n_tokens", "n_known", "base_score", "score"])

    rows = read(spark, base, BASE_SCHEMA).where("ids is not null").select("part", "doc_id", "held_out", "ids")
    out = rows.mapInArrow(frugal(score, "ids"), "doc_id long, held_out boolean, n_tokens long, n_known long, base_score double, score double")
    return out.select("doc_id", "held_out", "n_tokens", "n_known", F.lit(v.total).cast("long").alias("train_tokens"), "base_score", "score")

"""Suffix-array dedup: repeated byte strings by breadth-first search on a Burrows-Wheeler transform.

A first pass finds which parts of the texts can hold a repeated string at all: every window's
least 128-byte hash names a group, and equal windows share their group, so windows whose group
has one member are unique. What remains is cut into parts and dealt out by the windows' least 32-byte hash
in the same way; each task sorts the suffixes of its parts, and a threshold-bounded interval expansion on
the transform finds common prefixes of increasing length, stopping at the least length that matters.
Suffixes no expansion has told apart by then share a prefix of at least that length.
"""

from __future__ import annotations

from collections.abc import Iterator
from hashlib import sha256

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from panelith.llm.common import frugal, inside, mixed, partitions, utf8, window_hashes
from panelith.llm.repeats import bucket_bits, covered_spans, repeated_places, window_starts

LENGTH = 200
#: Bytes hashed to find whether a window may recur, and to deal windows out: long ones tell more, short ones make longer parts.
FILTER_GRAM, DEAL_GRAM = 128, 32
#: Bytes of text in one block, and bytes whose suffixes are sorted together.
BLOCK_BYTES, SORT_BYTES = 2_000_000, 1_000_000

_BYTE_VALUES = mixed(np.arange(1, 257, dtype=np.uint64))


def sliding_least(values: np.ndarray, width: int) -> np.ndarray:
    """The least of every ``width`` consecutive values, by running minima from both ends of each block."""
    n = len(values) - width + 1
    if n <= 0:
        return values[:0]
    padded = np.full(-(-len(values) // width) * width, np.iinfo(np.uint64).max, np.uint64)
    padded[: len(values)] = values
    blocks = padded.reshape(-1, width)
    rising = np.minimum.accumulate(blocks, axis=1).reshape(-1)
    falling = np.minimum.accumulate(blocks[:, ::-1], axis=1)[:, ::-1].reshape(-1)
    return np.minimum(falling[:n], rising[width - 1 : width - 1 + n])


def runs(texts: list[bytes], length: int, gram: int, among: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Runs of consecutive windows with one and the same least gram: groups (its hash), first windows and numbers of windows; the offsets of the
    texts among the runs and among the bytes; the bytes. ``among`` marks the windows to look at, all by default."""
    data = np.frombuffer(b"".join(texts), np.uint8)
    ends = np.concatenate(([0], np.cumsum([len(t) for t in texts]))).astype(np.int64)
    none = np.empty(0, np.int64)
    if len(data) < length:
        return np.empty(0, np.uint64), none, none, np.zeros(len(ends), np.int64), ends, data
    gram = min(gram, length)
    hashes = window_hashes(_BYTE_VALUES[data], gram)
    least = sliding_least(hashes, length - gram + 1)
    valid = window_starts(ends, length)[: len(least)]
    if among is not None:
        valid &= among[: len(least)]
    new = valid.copy()
    # A run ends where its least gram does, so that windows which repeat at a short distance fall into two runs.
    new[1:] &= ~valid[:-1] | (least[1:] != least[:-1]) | (hashes[: len(least) - 1] == least[:-1])
    starts = np.flatnonzero(new)
    seen = np.cumsum(valid)
    sizes = np.diff(np.append(seen[starts] - 1, seen[-1] if len(seen) else 0))
    # Least hashes are small; mixed, they are dealt out evenly by their leading bits.
    return mixed(least[starts]), starts, sizes, np.searchsorted(starts, ends), ends, data


def sorted_suffixes(codes: np.ndarray, depth: int) -> np.ndarray:
    """Suffixes in the order of their first ``depth`` codes, by prefix doubling over those not yet told apart."""
    n = len(codes)
    key = codes.astype(np.uint64)
    held = 1
    for shift in (8, 16, 32):
        later = np.zeros(n, np.uint64)
        later[: n - held] = key[held:]
        key = (key << np.uint64(shift)) | later
        held *= 2
    order = np.argsort(key)
    own = key[order]
    heads = np.concatenate(([True], own[1:] != own[:-1]))
    rank = np.empty(n, np.int32)
    at = np.flatnonzero(heads)
    rank[order] = at[np.cumsum(heads) - 1]
    while held < depth:
        tails = np.concatenate((heads[1:], [True]))
        open_ = np.flatnonzero(~(heads & tails))
        if not len(open_):
            break
        mine = order[open_]
        later = np.full(len(mine), -1, np.int64)
        inner = mine + held < n
        later[inner] = rank[mine[inner] + held]
        both = (rank[mine].astype(np.uint64) << np.uint64(32)) | (later + 1).astype(np.uint64)
        way = np.argsort(both)
        order[open_] = mine[way]
        both = both[way]
        heads[open_[1:]] |= both[1:] != both[:-1]
        at = np.flatnonzero(heads)
        rank[order] = at[np.cumsum(heads) - 1]
        held *= 2
    return order


def expansion(codes: np.ndarray, order: np.ndarray, length: int) -> np.ndarray:
    """Which neighbours in suffix order share at least ``length`` codes: entry p is that of ranks p-1 and p.

    ``told`` marks the ends of intervals found so far. A step takes each end found by the step before, and for
    every code the end of the interval one code longer, which is one rank query; ends not met before have a
    common prefix one longer than the step before. After ``length`` steps what is left shares ``length`` codes.
    """
    n = len(codes)
    transform = codes[order - 1]
    symbols = int(codes.max()) + 1  # codes are small integers
    first = np.concatenate(([0], np.cumsum(np.bincount(codes, minlength=symbols))))
    words = -(-n // 64) + 1
    bits, before = [], []
    for c in range(symbols):
        raw = np.zeros(words * 8, np.uint8)
        flags = np.packbits(transform == c, bitorder="little")
        raw[: len(flags)] = flags
        own = raw.view("<u8")
        bits.append(own)
        before.append(first[c] + np.concatenate(([0], np.cumsum(np.bitwise_count(own[:-1]), dtype=np.int64))))
    told = np.zeros(n + 1, bool)
    told[[0, n]] = True
    front = np.array([0], np.int64)
    for _ in range(length):
        word, mask = front >> 6, (np.uint64(1) << (front & 63).astype(np.uint64)) - np.uint64(1)
        found = []
        for c in range(symbols):
            at = before[c][word] + np.bitwise_count(bits[c][word] & mask)
            at = at[~told[at]]
            if len(at):
                if len(at) > 1:
                    at = at[np.concatenate(([True], at[1:] != at[:-1]))]
                told[at] = True
                found.append(at)
        if not found:
            break
        front = np.concatenate(found)
    return ~told


def repeated_starts(parts: list[bytes], length: int) -> list[np.ndarray]:
    """For each distinct part, the starts of its ``length``-byte strings that occur at another place of any part too."""
    data = np.frombuffer(b"".join(x + b"\0" for x in parts), np.uint8)
    sizes = np.array([len(x) + 1 for x in parts])
    ends = np.concatenate(([0], np.cumsum(sizes)))
    # UTF-8 has at most 243 byte values, so there is room for a code of its own, 0, that ends each part.
    present = np.bincount(data, minlength=256) > 0
    table = np.zeros(256, np.uint8)
    table[present] = np.arange(1, present.sum() + 1)
    codes = table[data]
    codes[ends[1:] - 1] = 0
    order = sorted_suffixes(codes, length)
    alike = expansion(codes, order, length)
    both = np.zeros(len(codes), bool)
    both[order] = alike[:-1] | alike[1:]
    # Strings that reach beyond their part are not the text's; none of them equals one that does not.
    both &= window_starts(ends, length + 1)
    at = np.flatnonzero(both)
    cuts = np.searchsorted(at, ends)
    return [at[a:b] - start for a, b, start in zip(cuts[:-1].tolist(), cuts[1:].tolist(), ends[:-1].tolist(), strict=True)]


def searched_starts(parts: list[bytes], length: int, sort_bytes: int, gram: int) -> list[np.ndarray]:
    """``repeated_starts`` of distinct parts that are whole groups by their least ``gram``-byte string; too many to sort at once are dealt out anew by a longer one.

    Equal windows have the same least string of any length, so they stay together. At the full length a group's windows are equal.
    """
    if sum(map(len, parts)) <= sort_bytes or gram >= length:
        return repeated_starts(parts, length)
    gram = min(length, gram + max(1, (length - gram + 1) // 2))
    groups, of, at, counts = [], [], [], []
    a = size = 0
    for b in range(len(parts) + 1):
        if b == len(parts) or size + len(parts[b]) > sort_bytes and b > a:
            own, starts, sizes, _, ends, _ = runs(parts[a:b], length, gram)
            text = np.searchsorted(ends, starts, "right") - 1
            groups.append(own)
            of.append(text + a)
            at.append(starts - ends[text])
            counts.append(sizes)
            a, size = b, 0
        if b < len(parts):
            size += len(parts[b])
    groups, of, at, counts = (np.concatenate(x) for x in (groups, of, at, counts))
    order = np.argsort(groups, kind="stable")
    cuts = np.flatnonzero(np.concatenate(([True], groups[order][1:] != groups[order][:-1], [True])))
    out: list[list[np.ndarray]] = [[] for _ in parts]
    held: list[bytes] = []
    uses: list[list[int]] = []

    def settle() -> None:
        for found, runs_ in zip(searched_starts(held, length, sort_bytes, gram) if held else [], uses, strict=True):
            if len(found):
                for i in runs_:
                    out[of[i]].append(found + at[i])
        held.clear()
        uses.clear()

    size = 0
    for a, b in zip(cuts[:-1].tolist(), cuts[1:].tolist(), strict=True):
        if b - a < 2:
            continue
        own: dict[bytes, list[int]] = {}
        for i in order[a:b].tolist():
            own.setdefault(parts[of[i]][at[i] : at[i] + counts[i] + length - 1], []).append(i)
        if len(own) > 1:
            more = sum(map(len, own))
            if size + more > sort_bytes:
                settle()
                size = 0
            size += more
        for part, runs_ in own.items():
            if len(runs_) > 1:
                for i in runs_:
                    out[of[i]].append(np.arange(counts[i]) + at[i])
            if len(own) > 1:
                held.append(part)
                uses.append(runs_)
    settle()
    none = np.empty(0, np.int64)
    return [np.unique(np.concatenate(x)) if x else none for x in out]


PART_SCHEMA = "bucket int, block long, groups binary, sizes binary, data binary, numbers binary, many binary, keys binary, ends binary, windows binary, uses binary, starts binary"
PART_NAMES = [x.split()[0] for x in PART_SCHEMA.split(", ")]
PART_KINDS = [pa.int32(), pa.int64(), *[pa.binary()] * 10]


def part_rows(keys: np.ndarray, texts: list[bytes], wanted: list[bytes], length: int, bits: int) -> Iterator[tuple]:
    """The distinct parts of a block of texts for each bucket, and one row with their places."""
    _, starts, sizes, run_ends, ends, data = runs(texts, length, FILTER_GRAM)
    picks = np.concatenate([np.frombuffer(w, "<i8") + run_ends[i] for i, w in enumerate(wanted)])
    among = np.zeros(len(data), bool)
    among[inside(starts[picks], sizes[picks])] = True
    groups, starts, sizes, run_ends, ends, data = runs(texts, length, DEAL_GRAM, among)
    name = np.int64(xxhash.xxh3_64_intdigest(keys.tobytes()) >> 1)
    raw = data.tobytes()
    known: dict[bytes, int] = {}
    parts: list[bytes] = []
    own_groups, windows, times, uses = [], [], [], np.empty(len(starts), np.int64)
    for i, (start, size, group) in enumerate(zip(starts.tolist(), sizes.tolist(), groups.tolist(), strict=True)):
        part = raw[start : start + size + length - 1]
        number = known.get(part)
        if number is None:
            number = known[part] = len(parts)
            parts.append(part)
            own_groups.append(group)
            windows.append(size)
            times.append(0)
        times[number] += 1
        uses[i] = number
    of = np.array(own_groups, np.uint64)
    buckets = (of >> np.uint64(64 - bits)).astype(np.int64)
    order = np.argsort(buckets, kind="stable")
    cuts = np.flatnonzero(np.diff(buckets[order], prepend=-1, append=-1))
    many = np.array(times, np.int64) > 1
    for a, b in zip(cuts[:-1].tolist(), cuts[1:].tolist(), strict=True):
        own = order[a:b]
        held = [parts[i] for i in own.tolist()]
        yield int(buckets[own[0]]), name, of[own].astype("<u8").tobytes(), np.array([len(x) for x in held], "<i8").tobytes(), b"".join(held), own.astype("<i8").tobytes(), many[own].tobytes(), *[None] * 5
    yield int(name % (1 << bits)), name, *[None] * 5, keys.astype("<i8").tobytes(), ends.astype("<i8").tobytes(), np.array(windows, "<i8").tobytes(), uses.astype("<i8").tobytes(), starts.astype("<i8").tobytes()


def found_in(rows: list[tuple], length: int, sort_bytes: int = SORT_BYTES) -> Iterator[tuple[int, bytes, bytes]]:
    """For the rows of some whole groups: each block's parts with repeated strings, as the parts' numbers and starts.

    A part used more than once is repeated as a whole. The windows of one part differ from each other, so a group with
    one distinct part needs no search.
    """
    ids: dict[bytes, int] = {}
    parts: list[bytes] = []
    times: list[int] = []
    uses: list[tuple[int, int, int]] = []
    of_group: dict[int, set[int]] = {}
    for group, block, part, number, many in rows:
        i = ids.setdefault(part, len(parts))
        if i == len(parts):
            parts.append(part)
            times.append(0)
        times[i] += 1 + many
        uses.append((block, number, i))
        of_group.setdefault(group, set()).add(i)
    searched = sorted({i for own in of_group.values() if len(own) > 1 for i in own})
    none = np.empty(0, np.int64)
    starts = dict(zip(searched, searched_starts([parts[i] for i in searched], length, sort_bytes, DEAL_GRAM), strict=True)) if searched else {}
    whole = {i: np.arange(len(p) - length + 1) for i, p in enumerate(parts) if times[i] > 1}
    by_block: dict[int, tuple[list, list]] = {}
    for block, number, i in uses:
        own = whole.get(i) if i in whole else starts.get(i, none)
        if len(own):
            a, b = by_block.setdefault(block, ([], []))
            a.append(np.full(len(own), number))
            b.append(own)
    for block, (a, b) in by_block.items():
        yield block, np.concatenate(a).astype("<i8").tobytes(), np.concatenate(b).astype("<i8").tobytes()


def repeated_spans(docs: DataFrame, length: int = LENGTH, sort_bytes: int = SORT_BYTES) -> DataFrame:
    """``key, spans`` of the documents (``doc_id, text, key``) that hold a repeated string: maximal byte runs ``[from, to)``."""
    n = partitions(docs.sparkSession)
    bits = bucket_bits(n)

    def group_runs(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        groups, _, _, run_ends, _, _ = runs(texts, length, FILTER_GRAM)
        return groups, np.arange(len(groups)), run_ends

    def marked(marks: np.ndarray, ends: np.ndarray) -> Iterator[tuple[int, bytes]]:
        at = np.flatnonzero(marks)
        cuts = np.searchsorted(at, ends)
        for i in np.flatnonzero(np.diff(cuts)).tolist():
            yield i, (at[cuts[i] : cuts[i + 1]] - ends[i]).astype("<i8").tobytes()

    def split(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keys, texts, wanted = batch.column("key").to_numpy(), utf8(batch.column("text")), batch.column("spans").to_pylist()
            a = size = 0
            for b in range(len(texts) + 1):
                if b == len(texts) or size + len(texts[b]) > BLOCK_BYTES and b > a:
                    if b > a:
                        rows = list(zip(*part_rows(keys[a:b], texts[a:b], wanted[a:b], length, bits), strict=True))
                        yield pa.record_batch([pa.array(c, k) for c, k in zip(rows, PART_KINDS, strict=True)], names=PART_NAMES)
                    a, size = b, 0
                if b < len(texts):
                    size += len(texts[b])

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Rows come sorted by bucket; whole groups are sorted together until they make ``sort_bytes``."""
        now, held, size = None, [], 0
        ready: list[tuple] = []

        def answer(rows: list[tuple]) -> pa.RecordBatch:
            found = list(zip(*found_in(rows, length, sort_bytes), strict=True)) or [[], [], []]
            empty = pa.nulls(len(found[0]), pa.binary())
            return pa.record_batch([pa.array(found[0], pa.int64()), pa.array(found[1], pa.binary()), pa.array(found[2], pa.binary()), *[empty] * 5], names=names)

        def bucket_done() -> Iterator[pa.RecordBatch]:
            nonlocal size
            held.sort(key=lambda x: x[0])
            last = None
            for group, *row in held:
                if group != last and size >= sort_bytes // 2:
                    yield answer(ready)
                    ready.clear()
                    size = 0
                last = group
                ready.append((group, *row))
                size += len(row[1])
            held.clear()

        names = ["block", "numbers", "places", "keys", "ends", "windows", "uses", "starts"]
        for batch in batches:
            for row in zip(*[batch.column(c).to_pylist() for c in PART_NAMES], strict=True):
                bucket, block, groups, sizes, data, numbers, many, *rest = row
                if rest[0] is not None:
                    yield pa.record_batch([pa.array([block], pa.int64()), pa.nulls(1, pa.binary()), pa.nulls(1, pa.binary()), *[pa.array([x], pa.binary()) for x in rest]], names=names)
                    continue
                if bucket != now:
                    yield from bucket_done()
                now = bucket
                at = np.concatenate(([0], np.cumsum(np.frombuffer(sizes, "<i8")))).tolist()
                for i, (group, number, more) in enumerate(zip(np.frombuffer(groups, "<u8").tolist(), np.frombuffer(numbers, "<i8").tolist(), np.frombuffer(many, bool).tolist(), strict=True)):
                    held.append((group, block, data[at[i] : at[i + 1]], number, more))
        yield from bucket_done()
        if ready:
            yield answer(ready)

    def gather(pdf: pd.DataFrame) -> pd.DataFrame:
        named = pdf[pdf["keys"].notna()].iloc[0]
        keys, ends, windows, uses, starts = (np.frombuffer(named[c], "<i8") for c in ("keys", "ends", "windows", "uses", "starts"))
        offsets = np.concatenate(([0], np.cumsum(windows)))
        found = np.zeros(offsets[-1], bool)
        for numbers, places in zip(pdf["numbers"], pdf["places"], strict=True):
            if numbers is not None:
                found[offsets[np.frombuffer(numbers, "<i8")] + np.frombuffer(places, "<i8")] = True
        marks = np.zeros(ends[-1], bool)
        marks[inside(starts, windows[uses])] = found[inside(offsets[uses], windows[uses])]
        return pd.DataFrame([(int(keys[i]), data) for i, data in covered_spans(marks, ends, length)], columns=["key", "spans"])

    suspects = repeated_places(docs, group_runs, marked, BLOCK_BYTES)
    # doc_id is read so that this shuffle of texts is the very one that the caller's join reuses.
    texts = docs.join(suspects, "key").select("doc_id", "text", "key", "spans")
    dealt = texts.mapInArrow(frugal(split), PART_SCHEMA).repartition(n, "bucket").sortWithinPartitions("bucket")
    replies = dealt.mapInArrow(frugal(search), "block long, numbers binary, places binary, keys binary, ends binary, windows binary, uses binary, starts binary")
    return replies.groupBy("block").applyInPandas(gather, "key long, spans binary").dropDuplicates(["key"])


def kept_bytes(text: bytes, spans: bytes | None) -> tuple[bytes, int]:
    """The bytes outside the spans, and the number of spans."""
    if spans is None:
        return text, 0
    out, at = [], 0
    pairs = np.frombuffer(spans, "<i8").reshape(-1, 2).tolist()
    for a, b in pairs:
        out.append(text[at:a])
        at = b
    return b"".join(out) + text[at:], len(pairs)


def keyed(docs: DataFrame) -> DataFrame:
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"), F.xxhash64("doc_id", "text").alias("key"))


def cut(docs: DataFrame, length: int = LENGTH) -> DataFrame:
    """Per row: ``doc_id``, ``kept binary`` (the bytes left) and ``spans array<struct<start, stop>>`` (what was removed)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            spans = batch.column("spans").to_pylist()
            kept = [kept_bytes(t, s)[0] for t, s in zip(utf8(batch.column("text")), spans, strict=True)]
            pairs = [[{"start": a, "stop": b} for a, b in np.frombuffer(s or b"", "<i8").reshape(-1, 2).tolist()] for s in spans]
            yield pa.record_batch([batch.column("doc_id"), pa.array(kept, pa.binary()), pa.array(pairs, pa.list_(pa.struct([("start", pa.int64()), ("stop", pa.int64())])))], names=["doc_id", "kept", "spans"])

    own = keyed(docs)
    return own.join(repeated_spans(own, length), "key", "left").select("doc_id", "text", "spans").mapInArrow(frugal(run, "text"), "doc_id long, kept binary, spans array<struct<start:long,stop:long>>")


def digests(docs: DataFrame, length: int = LENGTH) -> DataFrame:
    """Per row: ``doc_id, n_bytes, n_removed, n_spans, kept_sha256``.

    A null text has no bytes; texts shorter than ``length`` lose none; rows repeated with their id and text count as
    further documents; null ids stay null; other columns are ignored; an empty table gives no rows. Windows of
    different documents never touch, as every part ends with its document or before.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for text, spans in zip(utf8(batch.column("text")), batch.column("spans").to_pylist(), strict=True):
                kept, n = kept_bytes(text, spans)
                rows.append((len(text), len(text) - len(kept), n, sha256(kept).hexdigest()))
            columns = list(zip(*rows, strict=True)) or [[]] * 4
            yield pa.record_batch([batch.column("doc_id"), *[pa.array(c, k) for c, k in zip(columns, [pa.int64()] * 3 + [pa.string()], strict=True)]], names=["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256"])

    own = keyed(docs)
    found = own.join(repeated_spans(own, length), "key", "left").select("doc_id", "text", "key", "spans")
    return found.mapInArrow(frugal(run, "text"), "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string")

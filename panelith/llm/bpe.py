"""BPE encoding and decoding with a public byte-level vocabulary, by contiguous rank arrays.

The vocabulary is a ``tokenizers`` JSON file whose path is a parameter. A text is split by
the file's added tokens, then by the byte-level pattern; every piece is merged by its own
rank array and remembered, as most pieces of a corpus recur.
"""

from __future__ import annotations

import heapq
import json
import re
from collections.abc import Callable, Iterator
from itertools import chain

import pyarrow as pa
import regex
from pyspark.sql import DataFrame

from panelith.llm.common import CACHE_ENTRIES, CACHES, frugal, text_only

#: The pattern of byte-level pre-tokenization, a fixed value.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
#: Letters, numbers and white space below U+0100, for the standard library's faster ``re``.
LETTERS, NUMBERS, SPACES = "A-Za-zªµºÀ-ÖØ-öø-ÿ", "0-9²³¹¼-¾", "\t-\r \x85\xa0"
NARROW = f" ?[{LETTERS}]+|'(?:s|t|re|ve|m|ll|d)| ?[{NUMBERS}]+| ?[^{SPACES}{LETTERS}{NUMBERS}]+|[{SPACES}]+(?![^{SPACES}])|[{SPACES}]+"
#: Pieces up to so many bytes are merged by scanning their rank array; longer ones with a heap, as scanning is quadratic.
SHORT = 96
NEVER = 1 << 60


def default_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def byte_characters() -> dict[int, str]:
    """The printable character that stands for each byte: itself where it is printable, else 256 onwards in order."""
    printable = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    held = {b: chr(b) for b in printable}
    for b in range(256):
        held.setdefault(b, chr(256 + len(held) - len(printable)))
    return held


def splitter(pattern: str, narrow: str) -> Callable[[str], list[str]]:
    """``findall`` of a pattern; texts without characters above U+00FF take its equivalent over those alone."""
    wide, fast = regex.compile(pattern).findall, re.compile(narrow).findall

    def split(text: str) -> list[str]:
        try:
            text.encode("latin-1")
        except UnicodeEncodeError:
            return wide(text)
        return fast(text)

    return split


class Remembered(dict):
    """Results of a function of short strings; it starts afresh when full."""

    def __init__(self, make: Callable[[str], object], longest: int):
        super().__init__()
        self.make, self.longest = make, longest

    def __missing__(self, key: str) -> object:
        value = self.make(key)
        if len(key) <= self.longest:
            if len(self) >= CACHE_ENTRIES:
                self.clear()
            self[key] = value
        return value


class ByteBpe:
    """An encoder and decoder over one vocabulary file."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        to_byte = {c: b for b, c in byte_characters().items()}
        raw = lambda token: bytes(to_byte[c] for c in token)
        vocabulary = {raw(token): i for token, i in spec["model"]["vocab"].items()}
        pairs = [tuple(m.split(" ")) if isinstance(m, str) else tuple(m) for m in spec["model"]["merges"]]
        self.ranks = {(raw(a), raw(b)): r for r, (a, b) in enumerate(pairs)}
        self.ids = vocabulary
        self.added = {x["content"]: x["id"] for x in spec.get("added_tokens", [])}
        size = 1 + max([*vocabulary.values(), *self.added.values()])
        self.tokens: list[bytes] = [b""] * size
        for token, i in vocabulary.items():
            self.tokens[i] = token
        for token, i in self.added.items():
            self.tokens[i] = token.encode()
        self.pieces = splitter(PATTERN, NARROW)
        self.cut = regex.compile("(" + "|".join(map(regex.escape, sorted(self.added, key=len, reverse=True))) + ")") if self.added else None
        self.piece_ids = Remembered(lambda piece: self.merge(piece.encode()), SHORT).__getitem__

    def merge(self, piece: bytes) -> tuple[int, ...]:
        """Ids of one piece. ``bounds`` holds where its parts begin, ``ranks`` the rank of each adjacent pair."""
        if len(piece) > SHORT:
            return self.merge_long(piece)
        of = self.ranks
        bounds = list(range(len(piece) + 1))
        ranks = [of.get((piece[i : i + 1], piece[i + 1 : i + 2]), NEVER) for i in range(len(piece) - 1)]
        while ranks:
            least = min(ranks)
            if least == NEVER:
                break
            i = ranks.index(least)
            del bounds[i + 1], ranks[i]
            start, end = bounds[i], bounds[i + 1]
            if i < len(ranks):
                ranks[i] = of.get((piece[start:end], piece[end : bounds[i + 2]]), NEVER)
            if i:
                ranks[i - 1] = of.get((piece[bounds[i - 1] : start], piece[start:end]), NEVER)
        return tuple(self.ids[piece[a:b]] for a, b in zip(bounds, bounds[1:], strict=False))

    def merge_long(self, piece: bytes) -> tuple[int, ...]:
        """The same merges by a heap over linked parts, in n log n."""
        n = len(piece)
        end, before = list(range(1, n + 1)), list(range(-1, n - 1))
        alive = [True] * n
        heap = [(r, i, i + 2) for i in range(n - 1) if (r := self.ranks.get((piece[i : i + 1], piece[i + 1 : i + 2]))) is not None]
        heapq.heapify(heap)
        while heap:
            _, i, stop = heapq.heappop(heap)
            j = end[i]
            if not alive[i] or j >= n or end[j] != stop:
                continue
            if (middle := self.ranks.get((piece[i:j], piece[j:stop]))) is None or middle != _:
                continue
            alive[j] = False
            end[i] = stop
            if stop < n:
                before[stop] = i
                if (r := self.ranks.get((piece[i:stop], piece[stop : end[stop]]))) is not None:
                    heapq.heappush(heap, (r, i, end[stop]))
            if (h := before[i]) >= 0 and (r := self.ranks.get((piece[h:i], piece[i:stop]))) is not None:
                heapq.heappush(heap, (r, h, stop))
        return tuple(self.ids[piece[i : end[i]]] for i in range(n) if alive[i])

    def encode(self, text: str) -> list[int]:
        """Ids of a whole text; added tokens in the text become their own ids."""
        if self.cut is None or not any(token in text for token in self.added):
            return list(chain.from_iterable(map(self.piece_ids, self.pieces(text))))
        ids: list[int] = []
        for i, part in enumerate(self.cut.split(text)):
            ids += [self.added[part]] if i % 2 else chain.from_iterable(map(self.piece_ids, self.pieces(part)))
        return ids

    def decode_bytes(self, ids: list[int]) -> bytes:
        return b"".join(map(self.tokens.__getitem__, ids))

    def decode(self, ids: list[int]) -> str:
        """The text of the ids, special tokens included; bytes that are no UTF-8 become U+FFFD."""
        return self.decode_bytes(ids).decode("utf-8", "replace")


_held: dict[str, ByteBpe] = {}
CACHES.append(_held)


def codec(path: str) -> ByteBpe:
    """This worker's encoder for a vocabulary file, loaded once."""
    if path not in _held:
        _held[path] = ByteBpe(path)
    return _held[path]


def encode(docs: DataFrame, path: str | None = None) -> DataFrame:
    """``doc_id`` and the token ids of every whole text, as ``ids array<int>``.

    Every input row gives one row. Null and empty texts have no ids; a null doc_id stays null;
    repeated rows are encoded each; other columns are ignored; an empty table gives no rows.
    """
    path = path or default_path()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = codec(path)
        for batch in batches:
            for at in range(0, batch.num_rows, 500):
                part = batch.slice(at, 500)
                ids = [bpe.encode(x or "") for x in part.column("text").to_pylist()]
                yield pa.record_batch([part.column("doc_id"), pa.array(ids, pa.list_(pa.int32()))], names=["doc_id", "ids"])

    return text_only(docs).mapInArrow(frugal(run, "text", keep=True), "doc_id long, ids array<int>")


def decode(encoded: DataFrame, path: str | None = None) -> DataFrame:
    """``doc_id`` and ``text``, the decoded ids; null ids give null."""
    path = path or default_path()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = codec(path)
        for batch in batches:
            for at in range(0, batch.num_rows, 500):
                part = batch.slice(at, 500)
                texts = [None if x is None else bpe.decode(x) for x in part.column("ids").to_pylist()]
                yield pa.record_batch([part.column("doc_id"), pa.array(texts, pa.string())], names=["doc_id", "text"])

    return encoded.select("doc_id", "ids").mapInArrow(run, "doc_id long, text string")


def round_trip(docs: DataFrame, path: str | None = None) -> DataFrame:
    """Per document: the number of ids, the SHA-256 of the decimal ids joined by commas and of the decoded text.

    Digests are taken where the ids are made, so neither ids nor texts leave the task.
    """
    path = path or default_path()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from hashlib import sha256

        bpe = codec(path)
        decimal = [str(i).encode() for i in range(len(bpe.tokens))]
        for batch in batches:
            counts, named, decoded = [], [], []
            for text in batch.column("text").to_pylist():
                ids = bpe.encode(text or "")
                counts.append(len(ids))
                named.append(sha256(b",".join(map(decimal.__getitem__, ids))).hexdigest())
                decoded.append(sha256(bpe.decode(ids).encode()).hexdigest())
            yield pa.record_batch([batch.column("doc_id"), pa.array(counts, pa.int64()), pa.array(named), pa.array(decoded)], names=["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])

    return text_only(docs).mapInArrow(frugal(run, "text", keep=True), "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string")


def token_counts(docs: DataFrame, path: str | None = None) -> DataFrame:
    """``n_tokens long`` of every whole text, one row per input row; null and empty texts have 0."""
    path = path or default_path()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = codec(path)
        for batch in batches:
            counts = [len(bpe.encode(x or "")) for x in batch.column(0).to_pylist()]
            yield pa.record_batch([pa.array(counts, pa.int64())], names=["n_tokens"])

    return text_only(docs).select("text").mapInArrow(frugal(run, "text", keep=True), "n_tokens long")

"""Tokenization, packing, lengths and sharding."""

from __future__ import annotations

import random
import zlib
from collections import Counter
from hashlib import sha256

import numpy as np
import pytest
from tokenizers import Tokenizer

from panelith.llm import bpe, packing, sharding, token_lengths, word_tokens


@pytest.fixture(scope="module")
def byte_library():
    return Tokenizer.from_file(bpe.default_path())


def test_bpe_equals_the_library(byte_library):
    own, r = bpe.ByteBpe(bpe.default_path()), random.Random(1)
    letters = " \n\t  aAbé'sx1٣漢🎉ñtrel#$%&|<>endoftext\x1c\x85"
    for _ in range(1500):
        text = "".join(r.choice(letters) for _ in range(r.randint(0, 200))) + "a" * r.choice([0, 0, 200]) + r.choice(["", "<|endoftext|>"])
        ids = byte_library.encode(text, add_special_tokens=False).ids
        assert own.encode(text) == ids and own.decode(ids) == byte_library.decode(ids, skip_special_tokens=False) == text
    assert own.decode([own.ids[b"\xc3"]]) == "�"


def test_word_ids_equal_the_library():
    library, own, r = Tokenizer.from_file(word_tokens.default_path()), word_tokens.WordTokens(word_tokens.default_path()), random.Random(2)
    letters = " \n aAbé'sxΣΑ1٣漢🎉ñTRELl#$%&|<>endoftextİJ̌\x1c\x85՘\U00010940"
    for _ in range(1500):
        text = "".join(r.choice(letters) for _ in range(r.randint(0, 100))) + r.choice(["", "<|endoftext|>x"])
        assert np.frombuffer(own.encode(text), "<u4").tolist() == library.encode(text, add_special_tokens=False).ids


def test_round_trip_rows(docs, rows, nothing, byte_library):
    expected = Counter()
    for r in rows:
        ids = byte_library.encode(r[1] or "", add_special_tokens=False).ids
        expected[(r[0], len(ids), sha256(",".join(map(str, ids)).encode()).hexdigest(), sha256((r[1] or "").encode()).hexdigest())] += 1
    assert Counter(tuple(x) for x in bpe.round_trip(docs).collect()) == expected
    assert Counter((x["doc_id"], x["text"]) for x in bpe.decode(bpe.encode(docs)).collect()) == Counter((r[0], r[1] or "") for r in rows)
    assert bpe.round_trip(nothing).count() == 0


def test_lengths_answer_every_limit(docs, rows, nothing, byte_library):
    lengths = [len(byte_library.encode(r[1] or "", add_special_tokens=False).ids) for r in rows]
    held = token_lengths.histogram(docs)
    for x in token_lengths.suffix_sums(held).collect():
        n = x["length"]
        assert x["n_docs"] == lengths.count(n) and x["docs_ge"] == sum(v >= n for v in lengths) and x["tokens_ge"] == sum(v for v in lengths if v >= n)
        assert x["truncated_total"] == sum(min(v, n) for v in lengths) and x["total_tokens"] == sum(lengths) and x["quantile"] == pytest.approx(sum(v <= n for v in lengths) / len(lengths))
    assert tuple(token_lengths.truncated_total(held, 77).first()) == (sum(lengths), sum(min(v, 77) for v in lengths))
    medians = {x["share"]: x["length"] for x in token_lengths.quantiles(token_lengths.suffix_sums(held), [0.5, 1.0]).collect()}
    assert medians == {0.5: sorted(lengths)[-(-len(lengths) // 2) - 1], 1.0: max(lengths)}
    assert token_lengths.suffix_sums(token_lengths.histogram(nothing)).count() == 0


@pytest.mark.parametrize(("capacity", "group"), [(4096, 100_000), (64, 100_000), (64, 20)])
def test_packing(docs, rows, nothing, capacity, group):
    library = Tokenizer.from_file(word_tokens.default_path())
    pieces = packing.cut_pieces(docs, capacity, with_ids=True)
    got = packing.pack(pieces, capacity, group_items=group).cache()
    found = got.collect()
    expected = Counter()
    for r in rows:
        ids = library.encode(r[1] or "", add_special_tokens=False).ids + [1]
        for k in range(0, len(ids), capacity):
            own = np.array(ids[k : k + capacity], "<u4").tobytes()
            expected[(r[0], k // capacity, k, len(own) // 4, zlib.crc32(own))] += 1
    assert Counter(tuple(x)[:5] for x in got.select("doc_id", "piece", "start", "length", "ids_crc32").collect()) == expected
    by = {}
    for x in found:
        by.setdefault(x["sequence_id"], []).append((x["offset"], x["length"]))
    for own in by.values():
        at = 0
        for offset, length in sorted(own):
            assert offset == at
            at += length
        assert at <= capacity
    assert len(by) <= (1.02 if group == 100_000 else 1.25) * -(-sum(x["length"] for x in found) // capacity) + 1
    joined = packing.sequences(got).collect()
    assert sum(len(x["ids"]) for x in joined) == 4 * sum(x["length"] for x in found)
    assert packing.pack(packing.cut_pieces(nothing)).count() == 0


def test_packing_keeps_columns_of_any_name(spark, docs):
    frame = spark.createDataFrame([(i % 5 + 1, i, "x", 0.5) for i in range(40)], "length int, item int, bin string, Place double")
    got = packing.pack(frame, 10).collect()
    assert sorted(x["item"] for x in got) == list(range(40)) and len({x["sequence_id"] for x in got}) == 12 and got[0]["bin"] == "x"


def least_capacity(sizes, shards):
    low, high = max(sizes), sum(sizes)
    while low < high:
        middle, used, now = (low + high) // 2, 1, 0
        for s in sizes:
            if now + s > middle:
                used, now = used + 1, 0
            now += s
        low, high = (low, middle) if used <= shards else (middle + 1, high)
    return low


@pytest.mark.parametrize(("shards", "blocks"), [(16, 32_768), (4, 8), (7, 3)])
def test_sharding_is_minimax(docs, rows, nothing, shards, blocks):
    found = sharding.shard(docs, shards, blocks).collect()
    assert Counter((x["doc_id"], x["size"], x["text_crc32"]) for x in found) == Counter((r[0], len((r[1] or "").encode()) + 1, zlib.crc32((r[1] or "").encode())) for r in rows)
    groups = Counter()
    for r in rows:
        groups[sha256((r[1] or "").encode()).digest()] += len((r[1] or "").encode()) + 1
    ordered = [groups[k] for k in sorted(groups)]
    loads, slots = Counter(), {}
    for x in found:
        loads[x["shard"]] += x["size"]
        slots.setdefault(x["shard"], []).append(x["slot"])
    assert max(loads.values()) == least_capacity(ordered, shards) and max(loads) < shards
    assert all(sorted(s) == list(range(len(s))) for s in slots.values())
    assert sharding.shard(nothing, shards).count() == 0

"""Near-duplicates, repeated passages and repeated strings against brute force."""

from __future__ import annotations

import random
from collections import Counter
from hashlib import sha256

import numpy as np
import pytest

from panelith.llm import components, minhash, repeats, substrings, suffixes


def shingles(text: str | None) -> frozenset:
    w = (text or "").encode().lower().split()
    return frozenset(tuple(w[i : i + 5]) for i in range(len(w) - 4)) if len(w) >= 5 else frozenset([tuple(w)] if w else [])


def test_near_duplicates_equal_brute_force(docs, rows, nothing):
    sets = [shingles(r[1]) for r in rows]
    root = list(range(len(rows)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in range(len(rows)):
        for j in range(i):
            if sets[i] and sets[j] and 100 * len(sets[i] & sets[j]) >= 75 * len(sets[i] | sets[j]):
                root[find(i)] = find(j)
    expected = Counter()
    for i, r in enumerate(rows):
        ids = [rows[j][0] for j in range(len(rows)) if find(j) == find(i) and rows[j][0] is not None]
        c = (min(ids) if ids else None) if sets[i] else r[0]
        expected[(r[0], len(sets[i]), c, r[0] == c)] += 1
    got = Counter(tuple(x) for x in minhash.near_duplicates(docs).select("doc_id", "n_shingles", "component_id", "kept").collect())
    assert got == expected
    assert minhash.near_duplicates(nothing).count() == 0
    stay = minhash.deduplicated(docs)
    assert stay.columns == docs.columns
    ids = [r["doc_id"] for r in stay.collect()]
    assert sorted(i for i in ids if i is not None) == sorted({k[0] for k in expected if k[3]})


def test_ids_null_or_shared_lose_no_clean_document(spark, docs):
    r = random.Random(5)
    texts = [" ".join(r.choice("abcdefgh") * r.randint(1, 9) + str(r.randint(0, 99)) for _ in range(60)) for _ in range(6)]
    copy = lambda t: t + " more"
    rows = [(None, texts[0]), (None, copy(texts[0])), (None, texts[1]), (1, texts[2]), (None, copy(texts[2])), (2, texts[3]), (2, texts[4]), (2, texts[4]), (3, texts[5]), (4, copy(texts[5])), (4, texts[1]), (None, ""), (None, " \n"), (None, None), (2, "")]
    got = [tuple(x) for x in minhash.deduplicated(spark.createDataFrame(rows, "doc_id long, text string")).collect()]
    zero = [x for x in got if x[1] in (texts[0], copy(texts[0]))]
    assert len(zero) == 1 and zero[0][0] is None
    assert Counter(x for x in got if x not in zero) == Counter([(1, texts[2]), (2, texts[3]), (2, texts[4]), (3, texts[5]), (4, texts[1]), (None, ""), (None, " \n"), (None, None), (2, "")])


def test_buckets_of_several_components(spark, docs):
    """A chain of texts, each near the next alone, and strays that share much of it."""
    r = random.Random(3)
    base = [f"w{i}" for i in range(200)]
    texts, now = [], base
    for k in range(12):
        now = now[:]
        for i in range(k * 5, k * 5 + 5):
            now[i * 3 % 200] = f"c{k}_{i}"
        texts.append(" ".join(now))
    texts += [" ".join(base[:100] + [f"z{r.random()}" for _ in range(60)]) for _ in range(6)]
    frame = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    sets = [shingles(t) for t in texts]
    links = [(i, j) for i in range(len(texts)) for j in range(i) if 100 * len(sets[i] & sets[j]) >= 75 * len(sets[i] | sets[j])]
    least = list(range(len(texts)))
    for _ in texts:
        for i, j in links:
            least[i] = least[j] = min(least[i], least[j])
    assert {x["doc_id"]: x["component_id"] for x in minhash.near_duplicates(frame).collect()} == dict(enumerate(least))


def test_components_of_chains_and_stars(spark, docs):
    edges = [(i, i + 1) for i in range(30)] + [(100, 100 + i) for i in range(1, 20)] + [(300, 200), (300, 200), (200, 200), (None, 1)]
    got = {r["node"]: r["component"] for r in components.components(spark.createDataFrame(edges, "u long, v long")).collect()}
    assert got == {i: 0 for i in range(31)} | {100 + i: 100 for i in range(20)} | {200: 200, 300: 200}


def expected_words(rows, width):
    texts = [(r[1] or "").encode().split() for r in rows]
    seen = Counter(tuple(w[i : i + width]) for w in texts for i in range(len(w) - width + 1))
    out = Counter()
    for r, w in zip(rows, texts, strict=True):
        gone = set()
        for i in range(len(w) - width + 1):
            if seen[tuple(w[i : i + width])] > 1:
                gone |= set(range(i, i + width))
        out[(r[0], len(w), len(gone), sha256(b" ".join(x for i, x in enumerate(w) if i not in gone)).hexdigest())] += 1
    return out


def test_repeated_passages_equal_brute_force(docs, rows, nothing):
    got = Counter(tuple(x) for x in substrings.digests(docs).collect())
    assert got == expected_words(rows, 35) and sum(n for k, n in got.items() if k[2]) > 5
    assert substrings.digests(nothing).count() == 0
    cleaned = substrings.cleaned(docs)
    assert cleaned.columns == docs.columns and cleaned.where("n_chars <> length(text)").count() == 0


@pytest.mark.parametrize("length", [200, 40])
def test_repeated_strings_equal_brute_force(docs, rows, nothing, length):
    texts = [(r[1] or "").encode() for r in rows]
    seen = Counter(t[i : i + length] for t in texts for i in range(len(t) - length + 1))
    expected = Counter()
    for r, t in zip(rows, texts, strict=True):
        gone = np.zeros(len(t) + 2, bool)
        for i in range(len(t) - length + 1):
            if seen[t[i : i + length]] > 1:
                gone[i + 1 : i + 1 + length] = True
        kept = bytes(b for b, g in zip(t, gone[1:-1], strict=True) if not g)
        expected[(r[0], len(t), int(gone.sum()), int((np.diff(gone.astype(int)) == 1).sum()), sha256(kept).hexdigest())] += 1
    assert Counter(tuple(x) for x in suffixes.digests(docs, length).collect()) == expected
    assert suffixes.digests(nothing, length).count() == 0


def test_expansion_equals_brute_force():
    r = random.Random(3)
    for turn in range(120):
        length = r.choice([3, 5, 8, 20])
        parts = list({bytes(r.choice(b"ab" if turn % 2 else b"abcd\0") for _ in range(r.randint(length, 120))) for _ in range(r.randint(1, 6))})
        seen = Counter(p[i : i + length] for p in parts for i in range(len(p) - length + 1))
        assert [x.tolist() for x in suffixes.repeated_starts(parts, length)] == [[i for i in range(len(p) - length + 1) if seen[p[i : i + length]] > 1] for p in parts]


@pytest.mark.parametrize("places", [[], [0], [65534], [65535], [0, 65535, 65536, 200000], [131069], [131070, 131071], list(range(50))])
def test_packed_places(places):
    assert repeats.unsteps(repeats.steps(np.array(places, np.int64))).tolist() == places


@pytest.mark.parametrize("sort_bytes", [300, 2_000, 1 << 30])
def test_groups_too_large_to_sort_at_once(sort_bytes):
    r = random.Random(4)
    base = bytes(r.choice(b"abcdefgh ") for _ in range(400))
    parts = set()
    for _ in range(150):
        own = bytearray(base)
        for _ in range(r.randint(1, 4)):
            own[r.randrange(len(own))] = r.choice(b"XYZ")
        a = r.randint(0, 100)
        parts.add(bytes(own[a : a + r.randint(210, 300)]))
    parts = sorted(parts)
    seen = Counter(p[i : i + 200] for p in parts for i in range(len(p) - 199))
    assert [x.tolist() for x in suffixes.searched_starts(parts, 200, sort_bytes, 32)] == [[i for i in range(len(p) - 199) if seen[p[i : i + 200]] > 1] for p in parts]


def test_ten_thousand_near_copies_of_one_passage(spark, docs):
    r = random.Random(5)
    base = bytes(r.choice(b"abcdefgh ") for _ in range(300))
    rows = []
    for i in range(10_000):
        own = bytearray(base)
        own[r.randrange(300)] = r.choice(b"STUVWXYZ")
        rows.append((i, own.decode()))
    frame = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    seen = Counter(t[i : i + 200] for _, t in rows for i in range(101))
    expected = {}
    for i, t in rows:
        gone = np.zeros(300, bool)
        for k in range(101):
            if seen[t[k : k + 200]] > 1:
                gone[k : k + 200] = True
        expected[i] = int(gone.sum())
    own = suffixes.keyed(frame)
    spans = suffixes.repeated_spans(own, 200, sort_bytes=50_000)
    got = {x["doc_id"]: sum(b - a for a, b in np.frombuffer(x["spans"], "<i8").reshape(-1, 2).tolist()) if x["spans"] else 0 for x in own.join(spans, "key", "left").select("doc_id", "spans").collect()}
    assert got == expected


def test_near_copies_of_a_hub_equal_brute_force(spark, docs):
    """Copies of one text at many distances: some linked to it, some to each other alone, some to none; and excerpts."""
    r = random.Random(6)
    base = [f"w{i}" for i in range(120)]
    texts = [" ".join(base)]
    for _ in range(160):
        own = base[:]
        for _ in range(r.randint(1, 9)):
            own[r.randrange(120)] = f"e{r.randint(0, 40)}"
        a = r.choice([0, 0, 0, r.randint(0, 40)])
        texts.append(" ".join(own[a : r.choice([120, 120, r.randint(80, 120)])]))
    frame = spark.createDataFrame([(i, t, 1, "x") for i, t in enumerate(texts)], "doc_id long, text string, row_id long, Kept_key string")
    sets = [shingles(t) for t in texts]
    least = list(range(len(texts)))
    links = [(i, j) for i in range(len(texts)) for j in range(i) if 100 * len(sets[i] & sets[j]) >= 75 * len(sets[i] | sets[j])]
    for _ in texts:
        for i, j in links:
            least[i] = least[j] = min(least[i], least[j])
    assert {x["doc_id"]: x["component_id"] for x in minhash.near_duplicates(frame).collect()} == dict(enumerate(least)) and len(set(least)) > 5
    assert {x["doc_id"] for x in minhash.deduplicated(frame).collect()} == set(least)

"""Certified quality rules, the hidden Markov model, media archives and the pipeline."""

from __future__ import annotations

import itertools
import math
import random
import struct
import zipfile
import zlib
from collections import Counter
from hashlib import sha256

import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from panelith.llm import hmm, media, minhash, quality, substrings, suffixes


def test_binomial_bound():
    assert quality.binomial_upper(0, 100, 0.05) == pytest.approx(1 - 0.05 ** (1 / 100))
    p = quality.binomial_upper(3, 50, 0.01)
    assert sum(math.comb(50, k) * p**k * (1 - p) ** (50 - k) for k in range(4)) == pytest.approx(0.01, rel=1e-6)
    assert quality.binomial_upper(5, 5, 0.1) == 1.0


def test_counts_equal_brute_force(docs, rows, nothing, spark):
    expected = Counter()
    for r in rows:
        text, w = r[1] or "", (r[1] or "").encode().split()
        seen = Counter(tuple(w[i : i + 3]) for i in range(len(w) - 2))
        again = {j for i in range(len(w) - 2) if seen[tuple(w[i : i + 3])] > 1 for j in range(i, i + 3)}
        lines = [x for x in text.split("\n") if x.encode().strip(b" \t\n\v\f\r")]
        failed = len(w) < 50 or 100 * len(again) > 50 * len(w)
        expected[(r[0], len(w), sum(len(x.decode()) for x in w), sum(c in "#*$%&|<>" for c in text), len(lines) - len(set(lines)), len(again), failed, not failed)] += 1
    none = spark.createDataFrame([], "doc_id long, quality int")
    assert Counter(tuple(x) for x in quality.judged(docs, none).collect()) == expected
    assert quality.judged(nothing, none).count() == 0


def test_rules_reject_bad_and_keep_good(spark, docs):
    good, bad = "plain words of a text that goes on and on without end " * 1, "bad### words%%% of$$$ noise&&& "
    rows = [(i, " ".join(f"{w}{i % 97}{k}" for k, w in enumerate((bad if i % 10 == 0 else good).split() * 20)), "en") for i in range(3000)]
    frame = spark.createDataFrame(rows, "doc_id long, text string, lang string").repartition(4)
    labels = spark.createDataFrame([(i, int(i % 10 != 0)) for i in range(2500)] + [(None, 0), (3, None)], "doc_id long, quality int")
    got = quality.judged(frame, labels).collect()
    assert all(r["kept"] == (r["doc_id"] % 10 != 0) for r in got)
    cut = quality.calibrate(quality.with_counts(frame), labels)
    assert cut and all(x["bound"] <= 0.05 / len(quality.RULES) and x["false_rejects"] == 0 for x in cut)
    few = labels.where("doc_id < 100")
    assert quality.calibrate(quality.with_counts(frame), few) == []
    assert quality.filtered(frame, labels).columns == frame.columns


def brute(model: hmm.Model, words: list[int]) -> float:
    total = 0.0
    for path in itertools.product(range(len(model.start)), repeat=len(words)):
        p = model.start[path[0]] * model.emit[words[0], path[0]]
        for a, b, w in zip(path, path[1:], words[1:], strict=False):
            p *= model.step[a, b] * model.emit[w, b]
        total += p
    return math.log(total)


def test_forward_equals_the_sum_over_paths():
    r = np.random.default_rng(1)
    model = hmm.Model(np.array([0.3, 0.7]), np.array([[0.9, 0.1], [0.4, 0.6]]), r.dirichlet(np.ones(5), 2).T)
    texts = [r.integers(0, 5, n).tolist() for n in (1, 7, 3, 7)]
    ids, ends = np.array(sum(texts, [])), np.concatenate(([0], np.cumsum([len(t) for t in texts])))
    (picks,) = list(hmm.slices(np.diff(ends)))
    got = hmm.forward(model, *hmm.by_step(ids, ends, picks))[0]
    assert got.tolist() == pytest.approx([brute(model, texts[i]) for i in picks])
    into = np.zeros(2), np.zeros((2, 2)), np.zeros((5, 2))
    hmm.expected(model, *hmm.by_step(ids, ends, picks), into)
    assert into[0].sum() == pytest.approx(4) and into[1].sum() == pytest.approx(len(ids) - 4) and into[2].sum(axis=1) == pytest.approx(np.bincount(ids, minlength=5))


@pytest.mark.parametrize("head", [65_536, 30, 0])
def test_scores(docs, rows, nothing, head):
    texts = [(r[1] or "").encode().lower().split() + [b""] for r in rows]
    out = [r[0] is not None and zlib.crc32(str(r[0]).encode()) % 5 == 1 for r in rows]
    c = Counter(w for t, o in zip(texts, out, strict=True) if not o for w in t)
    n, v = sum(c.values()), len(c)
    expected = sorted((str(r[0]), o, len(t), sum(c[w] > 0 for w in t), n, round(sum(math.log10((c[w] + 0.5) / (n + 0.5 * (v + 1))) for w in t), 6)) for r, t, o in zip(rows, texts, out, strict=True))
    got = hmm.scored(docs, head=head).collect()
    assert sorted((str(x["doc_id"]), x["held_out"], x["n_tokens"], x["n_known"], x["train_tokens"], round(x["base_score"], 6)) for x in got) == expected
    assert all(x["score"] < 0 for x in got)
    assert hmm.scored(nothing).count() == 0


def test_every_training_word_has_its_own_emissions(docs):
    """Neither the number of words every task holds nor the parts' size changes a score."""
    key = lambda x: (str(x["doc_id"]), x["n_tokens"], x["score"])
    whole = sorted(map(key, hmm.scored(docs).collect()))
    for head, tokens in ((30, 500), (0, hmm.PART_TOKENS)):
        got = sorted(map(key, hmm.scored(docs, head=head, part_tokens=tokens).collect()))
        assert [g[:2] for g in got] == [w[:2] for w in whole] and np.allclose([g[2] for g in got], [w[2] for w in whole], rtol=1e-9)


def test_training_raises_the_likelihood(docs):
    texts = hmm.keyed(docs)
    v = hmm.vocabulary(hmm.word_counts(texts))
    model, course = hmm.train(texts, v, 3, 4)
    assert course == sorted(course) and np.allclose(model.emit.sum(axis=0), 1) and np.allclose(model.step.sum(axis=1), 1)


def test_media_round_trip(docs, rows, nothing, tmp_path):
    expected = Counter()
    for r in rows:
        t = (r[1] or "").encode()
        p = t + b"\xff" * (max(1, -(-len(t) // 576)) * 576 - len(t))
        m = media.to_png(p, len(t))
        assert media.from_png(m) == (p, len(t))
        expected[(r[0], len(t), len(p), sha256(p).hexdigest(), zlib.crc32(p[-32:]), len(m), sha256(m).hexdigest(), media.feature(p))] += 1
    path = f"file://{tmp_path}/archive"
    media.write_archives(docs, path, archive_bytes=4000)
    for span in (700, 10_000_000):
        assert Counter(tuple(x) for x in media.features(media.read_archives(docs.sparkSession, path, span)).collect()) == expected
    assert media.stored_features(nothing).count() == 0


def test_a_second_write_adds_and_short_reads_are_retried(docs, tmp_path, monkeypatch):
    path = f"file://{tmp_path}/archive"
    for _ in range(2):
        media.write_archives(docs.limit(5), path)
    assert media.read_archives(docs.sparkSession, path).count() == 10
    reader = media.ArchiveReader({"path": path})
    failures, whole = [zipfile.BadZipFile("short"), struct.error("short")], media.directory
    monkeypatch.setattr(media, "PAUSE_S", 0)

    def directory(handle):
        if failures:
            raise failures.pop()
        return whole(handle)

    monkeypatch.setattr(media, "directory", directory)
    assert sum(b.num_rows for p in reader.partitions() for b in reader.read(p)) == 10 and not failures


def long_rows(n: int) -> list[tuple]:
    r = random.Random(9)
    words = ["".join(r.choice("abcdefghij") for _ in range(6)) for _ in range(5000)]
    text = " ".join(r.choice(words) for _ in range(n))
    return [(1, text), (2, text + " more"), (3, "x" * 700_000), (4, " \n" * 300_000)]


def test_very_long_texts(spark, docs):
    """Texts of hundreds of thousands of words, of one word and of none, through every operator that takes texts apart."""
    rows = long_rows(200_000)
    frame = spark.createDataFrame(rows, "doc_id long, text string").repartition(2)
    near = {x["doc_id"]: x["component_id"] for x in minhash.near_duplicates(frame).collect()}
    assert near == {1: 1, 2: 1, 3: 3, 4: 4}
    assert {x["doc_id"]: x["n_removed"] for x in substrings.digests(frame).collect()} == {1: 200_000, 2: 200_000, 3: 0, 4: 0}
    size = len(rows[0][1])
    assert {x["doc_id"]: x["n_removed"] for x in suffixes.digests(frame).collect()} == {1: size, 2: size, 3: 700_000, 4: 600_000}
    none = spark.createDataFrame([], "doc_id long, quality int")
    assert {x["doc_id"]: x["n_words"] for x in quality.judged(frame.withColumn("lang", F.lit("en")), none).collect()} == {1: 200_000, 2: 200_001, 3: 1, 4: 0}
    assert {x["doc_id"]: x["n_tokens"] for x in hmm.scored(frame).collect()} == {1: 200_001, 2: 200_002, 3: 2, 4: 1}


def test_scores_equal_the_recursion_word_by_word(spark, docs):
    """Every score against a plain forward recursion with a model trained on the same texts."""
    r = random.Random(2)
    rows = [(i, " ".join(r.choice("abcdefg") for _ in range(r.randint(0, 12)))) for i in range(40)]
    frame = spark.createDataFrame(rows, "doc_id long, text string")
    texts = hmm.keyed(frame)
    v = hmm.vocabulary(hmm.word_counts(texts.where(~F.col("held_out"))))
    base = hmm.numbered(texts, v)
    model, _, _ = hmm.fitted(spark, base, v, 2, 2)
    place = {w: i for i, w in enumerate(v.hashes.tolist())}
    got = {x["doc_id"]: x["score"] for x in hmm.scored(frame, 2, 2).collect()}
    unseen = (hmm.PRIOR * 0.5 / v.whole) / model.norm
    for i, text in rows:
        at = None
        total = 0.0
        for word in [*text.encode().split(), b""]:
            k = place.get(hmm.word_hash(word))
            emit = model.emit[k] if k is not None else unseen
            at = (model.start if at is None else at @ model.step) * emit
            total += math.log10(at.sum())
            at = at / at.sum()
        assert got[i] == pytest.approx(total, rel=1e-9)


def test_a_member_is_retried_alone():
    left = [2]

    def act():
        if left[0]:
            left[0] -= 1
            raise OSError("gone")
        return b"data"

    assert media.retried(act, lambda: None) == b"data"
    with pytest.raises(ValueError):
        media.retried(lambda: media.member(__import__("io").BytesIO(b"x" * 60), 0, 3, 0), lambda: None, tries=2)


def test_pipeline_stages(docs, spark, tmp_path):
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    now = spark.read.parquet(f"{tmp_path}/documents.parquet")
    assert [n for n, _ in corpus_pipeline.STAGES] == ["quality_rules", "near_dedup", "substring_dedup", "best_fit_packing"]
    for i, (name, stage) in enumerate(corpus_pipeline.STAGES):
        out = stage(spark, now, str(tmp_path))
        if i < 3:
            assert out.columns == docs.columns
            out.write.parquet(f"{tmp_path}/{name}")
            now = spark.read.parquet(f"{tmp_path}/{name}")
    assert out.select("doc_id").distinct().count() == now.select("doc_id").distinct().count()
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == out.count()

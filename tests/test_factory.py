"""The whole catalogue scored and selected, and what is built on the scores."""

from __future__ import annotations

import datetime

import numpy as np
import pytest

from panelith import panel_queries as q
from panelith import queries as core
from panelith.functions import signals
from panelith.operators import evaluation as ev
from panelith.operators import boosting, models


def test_every_signal_is_tested(spark, small):
    got = {r["family"]: r["tested"] for r in core.QUERIES["factory_family_counts"](spark, small).collect()}
    assert sum(got.values()) == len(signals.CATALOGUE) == 227


def test_scoring_in_a_larger_catalogue_changes_no_signal(spark, small):
    extra = tuple(n for n in q.ALL if n not in q.NAMES)[:20]
    rows = lambda names: {(r["date"], r["signal"], r["ic"], r["n"]) for r in q.tidy(q.stats(spark, small, names)).where(q.F.col("signal").isin(*q.NAMES)).collect()}
    assert rows((*q.NAMES, *extra)) == rows(q.NAMES)


def test_trees_are_the_references_size_unless_asked(spark):
    whole = boosting.Settings()
    assert (whole.rounds, whole.leaves, whole.rate, whole.l2) == (300, 31, 0.05, 10.0)
    train = spark.createDataFrame([(float(i % 7), float(i % 7 > 3)) for i in range(400)] + [(1.0, None), (None, 0.0)], "x double, y double")
    got = {n: models.regression(train, train, ["x"], "y", "p", {"rounds": n, "leaves": 2}).where("x = 6").first()["p"] for n in (1, 300)}
    assert abs(got[300] - 1) < 0.02 < abs(got[1] - 1)
    sure = models.winner_probability(train, train, ["x"], "y").where("x = 6 or x = 0").groupBy("x").agg({"p": "max"}).collect()
    assert {r[0]: round(r[1]) for r in sure} == {6.0: 1, 0.0: 0}


def test_trees_learn_what_no_single_feature_tells():
    r = np.random.default_rng(1)
    x = r.uniform(-0.5, 0.5, (6000, 4)).astype(np.float32)
    y = np.sign(x[:, 0] * x[:, 1]) * 0.3 + 0.2 * x[:, 2] + r.normal(0, 0.05, 6000)
    model = boosting.fitted(x[:5000], y[:5000], boosting.Settings(rounds=80))
    left = y[5000:] - model.predict(x[5000:])
    assert left.var() < 0.15 * y[5000:].var() and model.importance()[3] < 0.05 and all(t.feature.count(-1) <= 31 for t in model.trees)
    assert boosting.fitted(x[:0], y[:0], boosting.Settings(rounds=3)).predict(x[:2]).tolist() == [0, 0]
    flat = boosting.fitted(np.zeros((100, 2), np.float32), np.arange(100.0), boosting.Settings(rounds=3))
    assert flat.predict(x[:1, :2])[0] == pytest.approx(49.5, abs=5)


def test_deflation_uses_the_trials_of_the_data(spark):
    days = [datetime.date(y, 1, 1) + datetime.timedelta(k) for y in (1997, 1998) for k in range(60)]
    rows = [(c, d, 0.01 * a * ((k * 7919 + i) % 11 - 4), 0.1) for i, (c, a) in enumerate((("one", 1.0), ("two", -1.0), ("three", 0.5))) for k, d in enumerate(days)]
    daily = spark.createDataFrame(rows, "config string, date date, net double, ls_to double")
    trials = q.ranked_configurations(daily).collect()
    series = daily.where((q.F.col("config") == trials[0]["config"]) & (q.F.year("date") == 1998))
    assert q.deflated(daily).first() == ev.deflated_sharpe(series, "net", [r["val_sharpe"] for r in trials]).first()
    assert q.deflated(daily.where("config <> 'two'")).first()["dsr"] != q.deflated(daily).first()["dsr"]


def test_the_study_reads_the_order_lines_once_and_leaves_no_tables(spark, small, tmp_path, monkeypatch):
    read, panel = [], q.source.panel
    monkeypatch.setattr(q.source, "panel", lambda *a: read.append(a) or panel(*a))
    monkeypatch.setattr(q.store, "scratch", lambda _, name: f"{tmp_path}/{name}")
    monkeypatch.setattr(boosting, "settings_of", lambda trees, **fixed: boosting.Settings(rounds=2, **fixed))
    row = core.QUERIES["deflated_sharpe"](spark, small).first()
    assert row["days"] > 0 and len(read) == 1 and not list(tmp_path.iterdir())


def test_the_study_scans_the_order_lines_once_and_caches_nothing(spark, small, tmp_path, monkeypatch):
    scans, cached, held = [], q.store.cached, lambda: set(spark._jsc.getPersistentRDDs())

    def watched(spark, path, make):
        df = make()
        scans.append(df._jdf.queryExecution().sparkPlan().toString().count("lineitem.parquet"))
        return cached(spark, path, lambda: df)

    monkeypatch.setattr(q.store, "cached", watched)
    monkeypatch.setattr(q.store, "scratch", lambda _, name: f"{tmp_path}/{name}")
    monkeypatch.setattr(boosting, "settings_of", lambda trees, **fixed: boosting.Settings(rounds=2, **fixed))
    before = held()
    core.QUERIES["deflated_sharpe"](spark, small)
    assert sum(scans) == 1 and held() == before


def test_a_years_models_get_their_signals_in_the_order_of_names(spark, monkeypatch):
    r, names, got = np.random.default_rng(3), [f"s{i}" for i in range(9)], []
    days = [datetime.date(1996, 1, 1) + datetime.timedelta(7 * k) for k in range(60)]
    rows = spark.createDataFrame([(d, t, 0.01, 0.1, *r.uniform(-0.5, 0.5, 9).tolist()) for d in days for t in range(6)], f"date date, ticker long, target double, y_rank double, {', '.join(f'{n} double' for n in names)}")
    strength = {n: (i * 4 % 9 + 1) / 20 for i, n in enumerate(names)}
    ic = spark.createDataFrame([(d, n, s * (-1) ** i + 0.02 * r.normal()) for d in days for i, (n, s) in enumerate(strength.items())], "date date, signal string, ic double")
    monkeypatch.setattr(models, "regression", lambda train, test, names, label, out, trees=None: got.append((train.count(), test.count(), names)) or test.withColumn(out, q.F.lit(0.0)))
    out = models.walk_forward(rows, ic, names, 1997, 1997, 5, 0.5, 3, 0.8)
    # 53 dates come before 1997; 48 are left of them, every other one is trained on, and 7 are predicted.
    assert [g[:2] for g in got] == [(24 * 6, 7 * 6)] * 2 and out.count() == 7 * 6
    assert got[0][2] == got[1][2] == names

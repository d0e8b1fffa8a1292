"""Signals and operators on a synthetic panel, against brute force in pandas and against the future."""

from __future__ import annotations

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from panelith.functions import expr as e
from panelith.functions import signals
from panelith.operators import evaluation as ev
from panelith.operators import portfolio as pf
from panelith.plans.stages import XS, evaluate, plan

DAYS, NAMES, HOLE = 300, 8, slice(100, 105)


def world(seed: int = 0) -> dict[str, np.ndarray]:
    r = np.random.default_rng(seed)
    c = 50 * np.exp(np.cumsum(r.normal(0.0003, 0.02, (DAYS, NAMES)), axis=0))
    o = c * (1 + r.normal(0, 0.005, c.shape))
    h = np.maximum(o, c) * (1 + abs(r.normal(0, 0.01, c.shape)))
    low = np.minimum(o, c) * (1 - abs(r.normal(0, 0.01, c.shape)))
    c[HOLE, 3] = np.nan
    return {"o": o, "h": h, "l": low, "c": c, "dv": np.exp(r.normal(17, 0.5, c.shape))}


def to_spark(spark, w: dict[str, np.ndarray]):
    close = pd.DataFrame(w["c"])
    market = close.pct_change(fill_method=None).mean(axis=1)
    target = w["o"][2:] / w["o"][1:-1] - 1
    rows = []
    dates = pd.bdate_range("2010-01-01", periods=DAYS)
    for t in range(DAYS):
        for k in range(NAMES):
            known = lambda x: None if x is None or np.isnan(x) else float(x)
            rows.append((dates[t].date(), t, k, *[known(w[n][t, k]) for n in ("o", "h", "l", "c", "dv")], t >= 30, known(target[t, k]) if t < DAYS - 2 else None, known(market[t])))
    return spark.createDataFrame(rows, "date date, t int, ticker int, o double, h double, l double, c double, dv double, universe boolean, target double, m double")


@pytest.fixture(scope="module")
def panel(spark):
    return to_spark(spark, world()).cache()


def wide(df, name: str) -> pd.DataFrame:
    return df.select("t", "ticker", name).toPandas().pivot(index="t", columns="ticker", values=name).astype(float)


ROLLING = {
    "mean": (lambda x: e.ts_mean(x, 21), lambda p: p.rolling(21, min_periods=17).mean()),
    "std": (lambda x: e.ts_std(x, 10), lambda p: p.rolling(10, min_periods=8).std()),
    "rank": (lambda x: e.ts_rank(x, 9), lambda p: p.rolling(9, min_periods=8).rank(pct=True)),
    "skew": (lambda x: e.ts_skew(x, 21), lambda p: p.rolling(21, min_periods=17).skew()),
    "kurt": (lambda x: e.ts_kurt(x, 21), lambda p: p.rolling(21, min_periods=17).kurt()),
    "ewm": (lambda x: e.ewm(x, 0.2, 5), lambda p: p.ewm(alpha=0.2, min_periods=5).mean()),
    "max": (lambda x: e.ts_max(x, 5), lambda p: p.rolling(5, min_periods=4).max()),
    "lag": (lambda x: e.lag(x, 3), lambda p: p.shift(3)),
}


@pytest.mark.parametrize("name", ROLLING)
def test_windows_equal_pandas(panel, name):
    node, expected = ROLLING[name]
    got = wide(evaluate(panel, {"v": node(e.field("c"))}), "v")
    np.testing.assert_allclose(got, expected(pd.DataFrame(world()["c"])), rtol=1e-8, atol=1e-10)


def test_ages_and_decay(panel):
    c = pd.DataFrame(world()["c"])
    got = evaluate(panel, {"age": e.days_since_max(e.field("c"), 10), "decay": e.decay_linear(e.field("c"), 4)}).cache()
    filled = c.fillna(-np.inf).to_numpy()
    age = np.full(c.shape, np.nan)
    for t in range(9, DAYS):
        age[t] = 9 - filled[t - 9 : t + 1].argmax(axis=0)
    age[c.isna().to_numpy()] = np.nan
    np.testing.assert_allclose(wide(got, "age"), age)
    np.testing.assert_allclose(wide(got, "decay"), sum(c.shift(i) * (4 - i) for i in range(4)) / 10, rtol=1e-10)


def test_rank_within_the_universe(panel):
    got = wide(evaluate(panel, {"v": e.xs_rank(e.field("c"))}), "v")
    c = pd.DataFrame(world()["c"])
    c[c.index < 30] = np.nan
    np.testing.assert_allclose(got, c.rank(axis=1, pct=True), rtol=1e-12)


@pytest.mark.parametrize("family", ["momentum", "risk", "technical", "liquidity", "worldquant", "interaction", "seasonal"])
def test_no_signal_looks_ahead(spark, panel, family):
    cut = 200
    changed = world()
    r = np.random.default_rng(9)
    for x in ("o", "h", "l", "c", "dv"):
        changed[x][cut + 1 :] *= np.exp(r.normal(0, 0.3, changed[x][cut + 1 :].shape))
    nodes = signals.family(family)
    one, two = (evaluate(p.drop("target"), nodes).where(F.col("t") <= cut).toPandas().sort_values(["t", "ticker"]) for p in (panel, to_spark(spark, changed)))
    for n in nodes:
        np.testing.assert_allclose(one[n].astype(float), two[n].astype(float), rtol=1e-9, atol=1e-12, err_msg=n)


def test_catalogue():
    assert len(signals.CATALOGUE) == 227
    with pytest.raises(ValueError):
        signals.register("ret_1", "momentum", signals.R)


def test_stages_share_shuffles(panel):
    stages = plan(signals.family("worldquant").values())
    switches = sum(a.axis != b.axis for a, b in zip(stages, stages[1:], strict=False))
    assert switches <= 5 and any(s.axis == XS for s in stages)
    text = evaluate(panel, signals.family("momentum"))._jdf.queryExecution().executedPlan().toString()
    assert text.count("Exchange hashpartitioning(ticker") <= 1


def long(rows, spark):
    return spark.createDataFrame(rows, "date int, t int, ticker int, universe boolean, value double, target double").withColumn("signal", F.lit("s"))


def test_ic_of_the_target_itself_is_one(spark):
    r = np.random.default_rng(2)
    rows = [(d, d, k, True, x, x) for d in range(5) for k, x in enumerate(r.normal(size=20).tolist())]
    got = ev.daily_stats(long(rows, spark), 0.2, 5).toPandas()
    assert np.allclose(got["ic"], 1) and (got["ls"] > 0).all()


def test_turnover_and_neutral_weights(spark):
    r = np.random.default_rng(3)
    scores = spark.createDataFrame([(d, d, k, None if x > 2 else x, 0.01) for d in range(6) for k, x in enumerate(r.normal(size=25).tolist())], "date int, t int, ticker int, score double, target double")
    w = ev.quantile_weights(scores, 0.2, "date").groupBy("date").agg(F.sum("weight").alias("net"), F.sum(F.abs("weight")).alias("gross")).toPandas()
    assert np.allclose(w["net"], 0) and np.allclose(w["gross"], 2)
    fixed = spark.createDataFrame([(t, k, x) for t, row in enumerate([[0.5, -0.5, 0.0], [0.5, -0.5, 0.0], [0.0, -0.5, 0.5]]) for k, x in enumerate(row)], "t int, ticker int, w double")
    got = fixed.withColumn("x", ev.trades("w")).groupBy("t").agg(F.sum("x").alias("x")).orderBy("t").toPandas()["x"].tolist()
    assert got == [1.0, 0.0, 1.0]


def test_banded_weights_equal_the_loop(spark):
    r = np.random.default_rng(4)
    s = pd.DataFrame(r.normal(size=(60, 12)).cumsum(axis=0))
    s[r.random(s.shape) < 0.1] = np.nan
    pct = s.rank(axis=1, pct=True).to_numpy()
    longs, shorts, expected = np.zeros(12, bool), np.zeros(12, bool), np.zeros(s.shape)
    for i, p in enumerate(pct):
        ok = ~np.isnan(p)
        longs, shorts = ok & ((p > 0.8) | longs & (p > 0.6)), ok & ((p <= 0.2) | shorts & (p <= 0.4))
        expected[i] = longs / max(1, longs.sum()) - shorts / max(1, shorts.sum())
    frame = spark.createDataFrame([(i, i, k, None if np.isnan(x) else float(x), 0.0) for i, row in enumerate(s.to_numpy()) for k, x in enumerate(row)], "date int, t int, ticker int, score double, target double")
    got = pf.banded_weights(frame, 0.2, 0.4).toPandas().pivot(index="t", columns="ticker", values="weight")
    np.testing.assert_allclose(got, expected, atol=1e-12)
    plain, banded = (pf.portfolio(frame, 0.2, 0, leave).agg(F.avg("ls_to")).first()[0] for leave in (None, 0.4))
    assert banded < plain


def test_newey_west_of_white_noise(spark):
    x = np.random.default_rng(5).normal(0.1, 1, 5000)
    got = ev.newey_west(spark.createDataFrame([("s", i, float(v)) for i, v in enumerate(x)], "signal string, date int, ic double"), "ic", 10, "signal").first()["t"]
    assert abs(got / (x.mean() / x.std() * np.sqrt(len(x))) - 1) < 0.1


def test_greedy_choice_drops_near_copies(spark):
    r = np.random.default_rng(6)
    a = r.normal(size=500)
    frame = spark.createDataFrame([(float(x), float(x + 0.01 * y), float(z)) for x, y, z in zip(a, r.normal(size=500), r.normal(size=500), strict=True)], "a double, b double, c double")
    assert ev.greedy_distinct(frame, ["a", "b", "c"], 0.8) == ["a", "c"]


def test_embargo_gap(spark):
    dates = spark.createDataFrame([(d.date(),) for d in pd.bdate_range("2014-01-01", "2016-12-31")], "date date")
    parts = ev.embargo_split(dates, 2016, 5).toPandas()
    every = [d.date() for d in pd.bdate_range("2014-01-01", "2016-12-31")]
    gap = every.index(parts[parts.part == "test"].date.min()) - every.index(parts[parts.part == "train"].date.max())
    assert gap == 6

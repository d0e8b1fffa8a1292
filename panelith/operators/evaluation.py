"""Scoring signals: ranks against forward returns, daily long-short books, and statistics of daily series."""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator
from statistics import NormalDist

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from panelith.plans.stages import average_rank

DAYS = 252
EULER = 0.5772156649


def long_form(wide: DataFrame, names: list[str], keep: tuple[str, ...] = ("date", "t", "ticker", "universe", "target")) -> DataFrame:
    """One row a signal: ``keep``, ``signal``, ``value``."""
    return wide.unpivot(list(keep), names, "signal", "value")


def valid(df: DataFrame) -> Column:
    return F.col("universe") & F.col("value").isNotNull() & F.col("target").isNotNull()


def quantile_weights(df: DataFrame, q: float, *by: str, score: str = "score") -> DataFrame:
    """``weight``: equal long over the top share q, equal short over the bottom one, 0 for all where a side is empty.

    The top is strict (rank share > 1 - q) and the bottom is not (rank share <= q).
    """
    day = Window.partitionBy(*by)
    pct = average_rank(F.col(score), *by) / F.count(score).over(day)
    ranked = df.withColumn("pct", pct)
    top, bottom = (F.col("pct") > 1 - q).cast("int"), (F.col("pct") <= q).cast("int")
    longs, shorts = F.sum(top).over(day), F.sum(bottom).over(day)
    weight = F.when((longs > 0) & (shorts > 0), F.coalesce(top, F.lit(0)) / longs - F.coalesce(bottom, F.lit(0)) / shorts).otherwise(0.0)
    return ranked.withColumn("weight", F.coalesce(weight, F.lit(0.0)))


def trades(weight: str, *series: str) -> Column:
    """Change of a weight since the row before of the same ticker; the first is the purchase itself."""
    return F.abs(F.col(weight) - F.coalesce(F.lag(weight).over(Window.partitionBy(*series, "ticker").orderBy("t")), F.lit(0.0)))


def correlation(x: str, y: str) -> Column:
    """Correlation of rows where both are known; NULL where either does not vary."""
    a, b = F.when(F.col(y).isNotNull(), F.col(x)), F.when(F.col(x).isNotNull(), F.col(y))
    return F.try_divide(F.covar_pop(a, b), F.stddev_pop(a) * F.stddev_pop(b))


def daily_stats(values: DataFrame, q: float, least: int) -> DataFrame:
    """``date, signal, ic, ls, to, n`` of long signals on a dense grid.

    ``ic`` is the correlation of ranks, ``ls`` the long-short return, both NULL on days of fewer than ``least``
    names; turnover stays.
    """
    day = ("date", "signal")
    held = values.withColumns({"s": F.when(valid(values), F.col("value")), "y": F.when(valid(values), F.col("target"))})
    ranked = quantile_weights(held, q, *day, score="s").withColumns({"rs": average_rank(F.col("s"), *day), "ry": average_rank(F.col("y"), *day)})
    traded = ranked.withColumn("trade", trades("weight", "signal"))
    out = traded.groupBy(*day).agg(correlation("rs", "ry").alias("ic"), F.sum(F.col("weight") * F.coalesce("y", F.lit(0.0))).alias("ls"), F.sum("trade").alias("to"), F.count("s").alias("n"))
    enough = F.col("n") >= least
    return out.withColumns({"ic": F.when(enough, F.col("ic")), "ls": F.when(enough, F.col("ls"))})


def placebo(values: DataFrame, seed: int = 0) -> DataFrame:
    """``values`` with each date's targets permuted among its valid names, by a digest of ticker, date and seed."""
    day = ("date", "signal")
    digest = F.md5(F.concat_ws("|", F.col("ticker").cast("string"), F.col("date").cast("string"), F.lit(str(seed))).cast("binary"))
    held = values.where(valid(values))
    by_name = held.withColumn("place", F.row_number().over(Window.partitionBy(*day).orderBy("ticker")))
    by_digest = held.select(*day, F.col("target").alias("other"), F.row_number().over(Window.partitionBy(*day).orderBy(digest)).alias("place"))
    return by_name.join(by_digest, [*day, "place"]).drop("place", "target").withColumnRenamed("other", "target")


def rank_ic(values: DataFrame, least: int) -> DataFrame:
    """``date, signal, ic, n`` of the valid rows alone."""
    day = ("date", "signal")
    held = values.where(valid(values))
    ranked = held.select(*day, average_rank(F.col("value"), *day).alias("rs"), average_rank(F.col("target"), *day).alias("ry"))
    return ranked.groupBy(*day).agg(correlation("rs", "ry").alias("ic"), F.count(F.lit(1)).alias("n")).withColumn("ic", F.when(F.col("n") >= least, F.col("ic")))


def horizon_labels(panel: DataFrame, h: int, bound: float = 0.75) -> DataFrame:
    """``date, ticker, target_h, y_rank_h``: return from the next open over h rows, and its centred rank among the rows that count."""
    own = Window.partitionBy("ticker").orderBy("t")
    ahead = F.try_divide(F.lead("o", h + 1).over(own), F.lead("o", 1).over(own)) - 1
    rows = panel.withColumn("target_h", F.when(ahead.isNotNull(), F.greatest(F.lit(-bound), F.least(F.lit(bound), ahead)))).where(F.col("universe") & F.col("target").isNotNull())
    return rows.select("date", "ticker", "target_h", (average_rank(F.col("target_h"), "date") / F.count("target_h").over(Window.partitionBy("date")) - 0.5).alias("y_rank_h"))


def horizon_ic(features: DataFrame, labels: DataFrame, least: int) -> DataFrame:
    """``date, signal, ic, n``: correlation of stored ranks (as floats) with the label's rank, without ranking anew."""
    both = features.join(labels, ["date", "ticker"]).where(F.col("feature").isNotNull() & F.col("y_rank_h").isNotNull())
    both = both.withColumn("x", F.col("feature").cast("double"))
    out = both.groupBy("date", "signal").agg(correlation("x", "y_rank_h").alias("ic"), F.count(F.lit(1)).alias("n"))
    return out.withColumn("ic", F.when(F.col("n") >= least, F.col("ic")))


def newey_west(series: DataFrame, value: str, lags: int, *by: str, least: int = 30) -> DataFrame:
    """``by, n, mean, t``: t-statistic with Bartlett weights over the known values in date order; NULL under ``least`` values."""
    held = series.where(F.col(value).isNotNull())
    own = Window.partitionBy(*by)
    e = held.withColumn("e", F.col(value) - F.avg(value).over(own)).withColumn("n", F.count(F.lit(1)).over(own))
    ordered = Window.partitionBy(*by).orderBy("date")
    products = e.withColumns({f"g{k}": F.col("e") * F.lag("e", k).over(ordered) for k in range(1, lags + 1)})
    sums = products.groupBy(*by).agg(
        F.count(F.lit(1)).alias("n"),
        F.avg(value).alias("mean"),
        (F.sum(F.col("e") * F.col("e")) / F.count(F.lit(1))).alias("g0"),
        *[(F.coalesce(F.sum(f"g{k}"), F.lit(0.0)) / F.count(F.lit(1))).alias(f"g{k}") for k in range(1, lags + 1)],
    )
    spread = F.col("g0")
    for k in range(1, lags + 1):
        spread = spread + 2 * (1 - k / (lags + 1)) * F.col(f"g{k}")
    t = F.when((F.col("n") >= least) & (spread > 0), F.col("mean") / F.sqrt(spread / F.col("n")))
    return sums.select(*by, "n", "mean", t.alias("t"))


def sharpe(x: str, per_year: int = DAYS) -> Column:
    """Yearly mean over deviation; NULL for fewer than two values or no spread."""
    return F.when(F.stddev_samp(x) > 0, F.avg(x) / F.stddev_samp(x) * math.sqrt(per_year))


def with_drawdown(series: DataFrame, value: str, *by: str) -> DataFrame:
    """``wealth`` and ``drawdown`` of a daily return; unknown returns are 0. The peak starts at the first wealth."""
    upto = Window.partitionBy(*by).orderBy("date").rowsBetween(Window.unboundedPreceding, 0)
    wealth = series.withColumn("wealth", F.product(1 + F.coalesce(value, F.lit(0.0))).over(upto))
    return wealth.withColumn("drawdown", F.col("wealth") / F.max("wealth").over(upto) - 1)


def performance(series: DataFrame, value: str, *by: str, turnover: str | None = None) -> DataFrame:
    """Yearly return and deviation, Sharpe ratio, drawdown, hit rate, days and, if given, mean turnover of the known values."""
    held = with_drawdown(series.where(F.col(value).isNotNull()), value, *by)
    return held.groupBy(*by).agg(
        (F.avg(value) * DAYS).alias("ann_return"),
        (F.stddev_samp(value) * math.sqrt(DAYS)).alias("ann_vol"),
        sharpe(value).alias("sharpe"),
        F.min("drawdown").alias("max_drawdown"),
        F.avg((F.col(value) > 0).cast("double")).alias("hit_rate"),
        F.count(F.lit(1)).alias("days"),
        *([F.avg(turnover).alias("turnover")] if turnover else []),
    )


def summary(stats: DataFrame, cost_bps: float, lags: int) -> DataFrame:
    """A signal's summary: mean IC and its t, how often it has its mean's sign, long-short return, Sharpe ratios, turnover."""
    mean = stats.groupBy("signal").agg(F.coalesce(F.signum(F.avg("ic")), F.lit(0.0)).alias("sign"))
    signed = stats.join(mean, "signal").withColumn("gross", F.col("ls") * F.col("sign")).withColumn("net", F.col("gross") - F.col("to") * cost_bps / 1e4)
    sums = signed.groupBy("signal").agg(
        F.avg("ic").alias("ic_mean"),
        F.avg((F.signum(F.round("ic", 12)) == F.col("sign")).cast("double")).alias("ic_hit"),
        (F.avg("gross") * DAYS).alias("ls_ann_gross"),
        sharpe("gross").alias("sharpe_gross"),
        sharpe("net").alias("sharpe_net"),
        F.avg("to").alias("turnover"),
        F.count("ic").alias("days"),
    )
    return sums.join(newey_west(stats, "ic", lags, "signal").select("signal", F.col("t").alias("ic_t_nw")), "signal", "left")


def deflated_sharpe(series: DataFrame, value: str, trial_sharpes: list[float]) -> DataFrame:
    """``days, sharpe_day, dsr``: the chance that the true ratio exceeds the best of so many unskilled trials.

    The moments come from Spark; the few trials' spread and the normal law are one number each.
    """
    normal = NormalDist()
    n = max(len(trial_sharpes), 2)
    daily = [x / math.sqrt(DAYS) for x in trial_sharpes]
    mean = sum(daily) / max(1, len(daily))
    spread = math.sqrt(sum((x - mean) ** 2 for x in daily) / (len(daily) - 1)) if len(daily) > 1 else 0.0
    bar = spread * ((1 - EULER) * normal.inv_cdf(1 - 1 / n) + EULER * normal.inv_cdf(1 - 1 / (n * math.e)))
    row = series.where(F.col(value).isNotNull()).agg(F.count(value).alias("days"), F.try_divide(F.avg(value), F.stddev_samp(value)).alias("sr"), F.skewness(value).alias("skew"), (F.kurtosis(value) + 3).alias("kurt")).first()
    dsr = None
    if row["sr"] is not None and row["skew"] is not None:
        under = 1 - row["skew"] * row["sr"] + (row["kurt"] - 1) / 4 * row["sr"] ** 2
        dsr = normal.cdf((row["sr"] - bar) * math.sqrt(row["days"] - 1) / math.sqrt(under)) if under > 0 else None
    return series.sparkSession.createDataFrame([(row["days"], row["sr"], dsr)], "days long, sharpe_day double, dsr double")


def correlations(rows: DataFrame, names: list[str]) -> np.ndarray:
    """The correlation matrix of columns over all rows, unknown values as 0; NaN where a column doesn't vary.

    Each partition makes one matrix of products, and these add up to one of as many cells as there are pairs of names.
    """
    held = rows.select(*[F.coalesce(F.col(n).cast("double"), F.lit(0.0)).alias(n) for n in names])
    k = len(names)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        # Sums about 0 serve: ranks are centred. A leading 1 gives counts and sums in the same product.
        total = np.zeros((k + 1, k + 1))
        for batch in batches:
            x = np.column_stack((np.ones(len(batch)), batch.to_numpy(np.float64)))
            total += x.T @ x
        i, j = np.triu_indices(k + 1)
        yield pd.DataFrame({"i": i, "j": j, "v": total[i, j]})

    sums = held.mapInPandas(run, "i int, j int, v double").groupBy("i", "j").agg(F.sum("v").alias("v")).toPandas()
    whole = np.zeros((k + 1, k + 1))
    whole[sums["i"], sums["j"]] = whole[sums["j"], sums["i"]] = sums["v"]
    n, means = max(whole[0, 0], 1.0), whole[0, 1:] / max(whole[0, 0], 1.0)
    cov = whole[1:, 1:] / n - np.outer(means, means)
    spread = np.sqrt(np.diag(cov))
    with np.errstate(divide="ignore", invalid="ignore"):
        return np.where(np.outer(spread, spread) > 1e-15, cov / np.outer(spread, spread), np.nan)


def greedy_distinct(features: DataFrame, candidates: list[str], most: float) -> list[str]:
    """Candidates from the strongest on, each kept if its correlation with all kept so far is below ``most``.

    ``features`` is ``date, ticker, <one column a candidate>``; unknown values count as 0, and a column that doesn't vary is
    like any other. The walk over at most a few hundred names is the driver's.
    """
    if not candidates:
        return []
    table = np.abs(correlations(features, candidates))
    kept: list[int] = []
    for i in range(len(candidates)):
        if all(table[k, i] < most for k in kept):
            kept.append(i)
    return [candidates[i] for i in kept]


def select(ic: DataFrame, features: DataFrame | Callable[[list[str]], DataFrame], threshold: float, lags: int, most: float, stride: int = 10) -> DataFrame:
    """``signal, t, ic, sign, passed, kept``: signals beyond the threshold, strongest first, without near copies.

    Correlations are taken over every ``stride``-th date of the training window that ``ic`` covers. ``features`` may
    be a function of the signals beyond the threshold, so that only theirs are computed.
    """
    tests = newey_west(ic, "ic", lags, "signal")
    means = ic.groupBy("signal").agg(F.avg("ic").alias("ic"))
    ranked = means.join(tests.select("signal", "t"), "signal", "left").orderBy(F.abs("t").desc(), "signal").withColumn("strong", F.abs("t") > threshold).collect()
    table = ic.sparkSession.createDataFrame([(r["signal"], r["t"], r["ic"]) for r in ranked], "signal string, t double, ic double")
    strong = [r["signal"] for r in ranked if r["strong"]]
    days = every(ic.select("date").distinct(), stride)
    if callable(features):
        kept = greedy_distinct(features(strong).join(days, "date", "left_semi"), strong, most) if strong else []
    else:
        kept = greedy_distinct(features.join(days, "date", "left_semi"), strong, most)
    return table.select("signal", "t", "ic", F.signum("ic").alias("sign"), F.col("signal").isin(strong).alias("passed"), F.col("signal").isin(kept).alias("kept"))


def every(dates: DataFrame, stride: int) -> DataFrame:
    """Every stride-th date, from the first."""
    return dates.select("date", F.row_number().over(Window.orderBy("date")).alias("n")).where((F.col("n") - 1) % stride == 0).select("date")


def embargo_split(dates: DataFrame, year: int, embargo: int) -> DataFrame:
    """``date, part``: ``test`` in the year, ``train`` up to ``embargo`` dates before its first; other dates are in neither."""
    numbered = dates.select("date", F.row_number().over(Window.orderBy("date")).alias("n"))
    first = numbered.where(F.year("date") >= year).agg(F.min("n").alias("first"))
    part = F.when(F.col("n") < F.col("first") - embargo, "train").when(F.year("date") == year, "test")
    return numbered.join(F.broadcast(first)).select("date", part.alias("part")).where("part is not null")

"""Walk-forward combiners: the signed vote and boosted trees."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from panelith.operators import boosting
from panelith.operators import evaluation as ev
from panelith.operators.portfolio import vote


def regression(train: DataFrame, test: DataFrame, names: list[str], label: str, out: str, trees: dict | None = None) -> DataFrame:
    """``test`` with the prediction of trees boosted on ``train``, as column ``out``; ``trees`` replaces fields of ``boosting.Settings``."""
    return boosting.predicted(test, boosting.fit(train, names, label, boosting.settings_of(trees)), names, out)


def walk_forward(rows: DataFrame, ic: DataFrame, names: list[str], first_year: int, last_year: int, embargo: int, threshold: float, lags: int, most: float, stride: int = 2, trees: dict | None = None, keep: Callable[[str, DataFrame], DataFrame] = lambda name, df: df.persist()) -> DataFrame:
    """``date, ticker, target, simple, trees_selected, trees_all`` for every row of the test years.

    For each year: dates before it less the embargo select the signals and train on every ``stride``-th date. The
    loop is over years; each step is distributed, and features are computed once for all. Each row carries its date's
    place among all, so that a year's parts (those of ``ev.embargo_split``) are filters of what ``keep`` has kept.
    """
    rows = keep("rows", rows)
    days = keep("days", rows.select("date").distinct().withColumn("place", F.row_number().over(Window.orderBy("date"))))
    rows, ic = keep("placed-rows", rows.join(days, "date")), keep("placed-ic", ic.select("date", "signal", "ic").join(days, "date"))
    firsts = days.groupBy(F.year("date").alias("year")).agg(F.min("place").alias("first")).collect()
    out = None
    for year in range(first_year, last_year + 1):
        first = min((r["first"] for r in firsts if r["year"] >= year), default=0)  # without later dates, there is nothing to predict nor to train on
        past = F.col("place") < first - embargo
        table = ev.select(ic.where(past), rows.select("date", "ticker", *names), threshold, lags, most).where("kept").collect()
        signs = {r["signal"]: r["sign"] for r in table}
        # In the order of names: what trees learn, and the last digit of a vote, depend on it.
        kept = {n: signs[n] for n in names if n in signs} or {n: 1.0 for n in names[:1]}
        train = rows.where(past & ((F.col("place") - 1) % stride == 0))
        test = rows.where(F.year("date") == year)
        voted = vote(test, kept).select("date", "ticker", F.col("score").alias("simple"))
        scored = regression(train, regression(train, test, list(kept), "y_rank", "trees_selected", trees), names, "y_rank", "trees_all", trees)
        year_rows = scored.join(voted, ["date", "ticker"]).select("date", "ticker", "target", "simple", "trees_selected", "trees_all")
        out = year_rows if out is None else out.unionByName(year_rows)
    return out


def winners(rows: DataFrame, names: list[str], split: str, horizon: int, trees: dict | None = None) -> boosting.Boosted:
    """A classifier of ``win``, trained on dates whose labels end before the split."""
    train = rows.where(F.col("date") < F.date_sub(F.lit(split).cast("date"), int(horizon * 1.5))).withColumn("y", F.col("win").cast("double"))
    return boosting.fit(train, names, "y", boosting.settings_of(trees, binary=True))


def winner_importance(rows: DataFrame, names: list[str], split: str, horizon: int, trees: dict | None = None) -> DataFrame:
    """``signal, importance``: each signal's share of the gains of the classifier of winners."""
    shares = winners(rows, names, split, horizon, trees).importance().tolist()
    return rows.sparkSession.createDataFrame(list(zip(names, shares, strict=True)), "signal string, importance double")


def winner_probability(train: DataFrame, test: DataFrame, names: list[str], label: str, trees: dict | None = None) -> DataFrame:
    """``test`` with ``p``, the classifier's probability of the label."""
    return boosting.predicted(test, boosting.fit(train, names, label, boosting.settings_of(trees, binary=True)), names, "p")

"""From daily scores to costed portfolios."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from panelith.operators.evaluation import quantile_weights, trades
from panelith.plans.stages import average_rank


def vote(features: DataFrame, signs: dict[str, float]) -> DataFrame:
    """``date, ticker, score``: mean of the known signed features."""
    terms = [F.col(n) * s for n, s in signs.items()]
    total = sum((F.coalesce(x, F.lit(0.0)) for x in terms[1:]), F.coalesce(terms[0], F.lit(0.0)))
    count = sum((x.isNotNull().cast("int") for x in terms[1:]), terms[0].isNotNull().cast("int"))
    return features.select("date", "ticker", F.try_divide(total, count.cast("double")).alias("score"))


def smoothed(scores: DataFrame, halflife: float | str, by: tuple[str, ...] = ()) -> DataFrame:
    """``score`` smoothed along each ticker's known values; unknown stays unknown. A half-life of 0 changes nothing.

    The half-life is a number, or the name of a column that tells it for each series; ``by`` keys the series beside the ticker.
    A ticker's history is as long as the calendar, which bounds the group.
    """
    if not halflife:
        return scores

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("t")
        span = float(pdf[halflife].iloc[0]) if isinstance(halflife, str) else halflife
        if span:
            mean = pdf["score"].astype("float64").ewm(halflife=span, ignore_na=True).mean()
            pdf["score"] = mean.where(pdf["score"].notna())
        return pdf

    return scores.groupBy(*by, "ticker").applyInPandas(run, T.StructType(scores.schema.fields))


def banded_weights(scores: DataFrame, enter: float, leave: float, by: tuple[str, ...] = ()) -> DataFrame:
    """``weight`` with hysteresis: a name enters a side at the share ``enter`` and stays until it is beyond ``leave``.

    A name's state depends on itself alone: it is set where it enters, cleared where it cannot stay, and else the last of these.
    """
    own = Window.partitionBy(*by, "ticker").orderBy("t").rowsBetween(Window.unboundedPreceding, 0)
    day = Window.partitionBy(*by, "date")
    pct = scores.withColumn("pct", average_rank(F.col("score"), *by, "date") / F.count("score").over(day))
    p = F.col("pct")
    into_long, stay_long = F.coalesce(p > 1 - enter, F.lit(False)), F.coalesce(p > 1 - leave, F.lit(False))
    into_short, stay_short = F.coalesce(p <= enter, F.lit(False)), F.coalesce(p <= leave, F.lit(False))
    event = lambda into, stay: F.when(into, 1).when(~stay, 0)
    held = pct.withColumns({"long": event(into_long, stay_long), "short": event(into_short, stay_short)})
    held = held.withColumns({side: F.coalesce(F.last(side, ignorenulls=True).over(own), F.lit(0)) for side in ("long", "short")})
    side = lambda c: F.when(F.sum(c).over(day) > 0, F.col(c) / F.sum(c).over(day)).otherwise(0.0)
    return held.withColumn("weight", side("long") - side("short"))


def portfolio(scores: DataFrame, q: float, halflife: float | str = 0, leave: float | None = None, by: tuple[str, ...] = ()) -> DataFrame:
    """Per ``by`` and date ``ls_gross, ls_to, long_gross, long_to, bench_ew`` of scores on a dense grid (``date, t, ticker, score, target``).

    An unknown target earns 0 where a weight is held; the benchmark is the mean target of names with a score.
    """
    s = smoothed(scores, halflife, by)
    weighted = banded_weights(s, q, leave, by) if leave else quantile_weights(s, q, *by, "date")
    held = weighted.withColumn("long_weight", F.greatest("weight", F.lit(0.0)))
    traded = held.withColumns({"trade": trades("weight", *by), "long_trade": trades("long_weight", *by)})
    y = F.coalesce("target", F.lit(0.0))
    return traded.groupBy(*by, "date").agg(
        F.sum(F.col("weight") * y).alias("ls_gross"),
        F.sum("trade").alias("ls_to"),
        F.sum(F.col("long_weight") * y).alias("long_gross"),
        F.sum("long_trade").alias("long_to"),
        F.avg(F.when(F.col("score").isNotNull(), F.col("target"))).alias("bench_ew"),
    )


def with_benchmark(daily: DataFrame, prices: DataFrame) -> DataFrame:
    """``daily`` with ``benchmark``: the return of one name's closes (``date, t, c``), 0 on dates without one."""
    r = prices.select("date", (F.try_divide(F.col("c"), F.lag("c", 1).over(Window.orderBy("t"))) - 1).alias("benchmark"))
    return daily.join(r, "date", "left").fillna(0.0, subset=["benchmark"])


def net_of_costs(daily: DataFrame, bps: list[float]) -> DataFrame:
    """One row a date and cost: ``cost_bps, ls_net, long_net`` beside the gross series."""
    costs = F.explode(F.array(*[F.lit(float(b)) for b in bps]))
    priced = daily.withColumn("cost_bps", costs)
    c = F.col("cost_bps") / 1e4
    return priced.withColumns({"ls_net": F.col("ls_gross") - F.col("ls_to") * c, "long_net": F.col("long_gross") - F.col("long_to") * c})


def config_grid(scores: DataFrame, q: float, halflives: list[float], bands: dict[str, float | None]) -> DataFrame:
    """Daily series of every model, half-life and band, keyed ``config`` as model|hlH|band.

    ``scores`` has a row for each ``model`` and cell of the grid. All configurations run in the same few shuffles, as keys.
    """
    keys = ("model", "halflife")
    each = scores.withColumn("halflife", F.explode(F.array(*[F.lit(float(h)) for h in halflives])))
    smooth = smoothed(each, "halflife", keys)
    out = None
    for band, leave in bands.items():
        one = portfolio(smooth, q, 0, leave, keys).withColumn("config", F.format_string(f"%s|hl%s|{band}", "model", F.regexp_replace(F.col("halflife").cast("string"), r"\.0$", "")))
        out = one if out is None else out.unionByName(one)
    return out.drop(*keys)


def weekly_books(panel: DataFrame, vol: DataFrame, sizes: dict[str, int], least: int, cost_bps: float) -> DataFrame:
    """``date, book, ret``: names of the greatest (and least) volatility at each week's last date, held from the next week's
    first open to the following week's. Weeks run from Saturday to Friday. Names without that return are left out."""
    week = F.date_trunc("week", F.date_add("date", 2)).cast("date")
    days = panel.select("date").distinct().withColumn("week", week).groupBy("week").agg(F.min("date").alias("first"), F.max("date").alias("last"))
    order = Window.orderBy("week")
    weeks = days.select("last", F.lead("first", 1).over(order).alias("entry"), F.lead("first", 2).over(order).alias("leave"), F.row_number().over(order).alias("w")).where("leave is not null")
    opens = panel.select("date", "ticker", "o")
    rows = (
        panel.where("universe")
        .select("date", "ticker")
        .join(vol.where("vol is not null"), ["date", "ticker"])
        .join(weeks, F.col("date") == F.col("last"))
        .join(opens.toDF("entry", "ticker", "o_in"), ["entry", "ticker"])
        .join(opens.toDF("leave", "ticker", "o_out"), ["leave", "ticker"])
        .withColumn("r", F.try_divide(F.col("o_out"), F.col("o_in")) - 1)
        .where("r is not null")
    )
    down = F.row_number().over(Window.partitionBy("w").orderBy(F.col("vol").desc(), "ticker"))
    up = F.row_number().over(Window.partitionBy("w").orderBy("vol", "ticker"))
    ranked = rows.withColumns({"down": down, "up": up})
    books = [F.when(F.col("down") <= n, F.lit(b)) for b, n in sizes.items()] + [F.when(F.col("up") <= least, F.lit("least")), F.lit("all")]
    held = ranked.select("w", "entry", "ticker", "r", F.explode(F.array(*books)).alias("book")).where("book is not null")
    held = held.withColumn("weight", 1 / F.count(F.lit(1)).over(Window.partitionBy("w", "book")))
    # Buying and selling against the week before: a name in one of two weeks trades its whole weight.
    now = held.withColumnRenamed("w", "k")
    before = now.select((F.col("k") + 1).alias("k"), "book", "ticker", F.col("weight").alias("old"))
    moves = now.select("k", "book", "ticker", "weight").join(before, ["k", "book", "ticker"], "full").groupBy("k", "book").agg(F.sum(F.abs(F.coalesce("weight", F.lit(0.0)) - F.coalesce("old", F.lit(0.0)))).alias("to"))
    gross = now.groupBy("k", "book").agg(F.first("entry").alias("date"), F.avg("r").alias("gross"))
    return gross.join(moves, ["k", "book"]).select("date", "book", (F.col("gross") - F.col("to") * cost_bps / 1e4).alias("ret"))

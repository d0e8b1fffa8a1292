"""Bars, membership and the dense panel, derived from the order lines.

Prices are order lines by week (or day) and supplier group; everything downstream takes any
bars of the same columns.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F


@dataclass(frozen=True)
class PanelConfig:
    """Every number that shapes the panel."""

    tickers: int = 20
    unit: str = "week"
    min_history: int = 26
    min_price: float = 3.0
    target_clip: float = 0.5
    stray_share: float = 0.5
    stray_window: int = 10


WEEKLY = PanelConfig()
DAILY = PanelConfig(tickers=5, unit="day")


def bars(spark: SparkSession, sf_dir: str, cfg: PanelConfig = WEEKLY) -> DataFrame:
    """``date, ticker, open, high, low, close, adj_close, volume, dvol``: one row a date and ticker that traded."""
    lines = spark.read.parquet(f"{sf_dir}/lineitem.parquet").select("l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", "l_quantity", "l_extendedprice", "l_shipdate")
    priced = lines.select(
        F.date_trunc(cfg.unit, "l_shipdate").cast("date").alias("date"),
        (F.col("l_suppkey") % cfg.tickers).alias("ticker"),
        (F.col("l_extendedprice") / F.col("l_quantity")).alias("px"),
        "l_quantity",
        "l_extendedprice",
        "l_shipdate",
        "l_orderkey",
        "l_linenumber",
        "l_partkey",
    )
    place = F.struct("l_shipdate", "l_orderkey", "l_linenumber", "l_partkey", "px")
    out = priced.groupBy("date", "ticker").agg(
        F.min_by("px", place).alias("open"), F.max("px").alias("high"), F.min("px").alias("low"), F.max_by("px", place).alias("close"), F.sum("l_quantity").alias("volume"), F.sum("l_extendedprice").alias("dvol")
    )
    # A two-for-one split in some tickers, for the adjustment to have something to do.
    split = (F.col("ticker") % 7 == 0) & (F.col("date") < F.lit("1995-01-01").cast("date"))
    return out.withColumn("adj_close", F.when(split, F.col("close") * 0.5).otherwise(F.col("close")))


def adjusted(bars_: DataFrame) -> DataFrame:
    """Prices times adj_close / close; value traded only where there was volume."""
    factor = F.try_divide(F.col("adj_close"), F.col("close"))
    return bars_.select(
        "date", "ticker", (F.col("open") * factor).alias("o"), (F.col("high") * factor).alias("h"), (F.col("low") * factor).alias("l"), F.col("adj_close").alias("c"), F.col("close").alias("raw_close"), F.when(F.col("volume") > 0, F.col("dvol")).alias("dv")
    )


def repaired(adjusted_: DataFrame) -> DataFrame:
    """High and low that bracket open and close; unknown where any of the three is."""
    whole = F.col("o").isNotNull() & F.col("c").isNotNull()
    return adjusted_.withColumns(
        {"h": F.when(whole & F.col("h").isNotNull(), F.greatest("h", "o", "c")), "l": F.when(whole & F.col("l").isNotNull(), F.least("l", "o", "c"))}
    )


def trading_dates(bars_: DataFrame, cfg: PanelConfig = WEEKLY) -> DataFrame:
    """``date, n, typical``: dates with at least half the centred median of bars; a stray row makes no date."""
    per = bars_.groupBy("date").agg(F.count(F.lit(1)).alias("n"))
    around = Window.orderBy("date").rowsBetween(-cfg.stray_window, cfg.stray_window)
    return per.withColumn("typical", F.expr("percentile(n, 0.5)").over(around)).where(F.col("n") >= cfg.stray_share * F.col("typical"))


def membership(bars_: DataFrame) -> DataFrame:
    """``ticker, start, end``: when a ticker counts as a member, [start, end); a null end is open. Some have two intervals."""
    span = bars_.groupBy("ticker").agg(F.min("date").alias("first"), F.max("date").alias("last"))
    main = span.select("ticker", F.date_add("first", (F.col("ticker") % 3 * 28).cast("int")).alias("start"), F.when(F.col("ticker") % 4 == 3, F.date_sub("last", 84)).alias("end"))
    again = span.where("ticker % 8 = 3").select("ticker", F.date_sub("last", 42).alias("start"), F.col("last").alias("end"))
    return main.unionByName(again)


def recycled(bars_: DataFrame) -> DataFrame:
    """Tickers whose history is not one company's."""
    return bars_.select("ticker").distinct().where("ticker % 19 = 18")


def members_on(rows: DataFrame, intervals: DataFrame) -> DataFrame:
    """The rows (``date, ticker, ...``) inside an interval of their ticker: a range join that keeps each row once."""
    i = intervals.select(F.col("ticker").alias("i_ticker"), "start", "end")
    return rows.join(i, (F.col("ticker") == F.col("i_ticker")) & (F.col("date") >= F.col("start")) & (F.col("end").isNull() | (F.col("date") < F.col("end"))), "left_semi")


def dense(bars_: DataFrame, dates: DataFrame) -> DataFrame:
    """One row for every ticker and trading date, ``t`` counting dates from 0; unknown values are NULL.

    The calendar is one row a date, whatever the number of tickers; each ticker generates its own row of places.
    """
    calendar = dates.select("date", (F.row_number().over(Window.orderBy("date")) - 1).alias("t"))
    length = dates.count()
    places = bars_.select("ticker").distinct().select("ticker", F.explode(F.sequence(F.lit(0), F.lit(max(length - 1, 0)))).alias("t"))
    return places.join(calendar, "t").join(bars_, ["date", "ticker"], "left")


def panel(spark: SparkSession, sf_dir: str, cfg: PanelConfig = WEEKLY, keep: Callable[[str, DataFrame], DataFrame] = lambda name, df: df) -> DataFrame:
    """The dense panel: ``date, t, ticker, o, h, l, c, dv, raw_close, universe, target, m``.

    ``keep`` may store the bars, dates and cells, which are needed in several places: else each of these reads the order
    lines and plans all steps before it anew.
    """
    raw = keep("bars", bars(spark, sf_dir, cfg))
    held = raw.join(recycled(raw), "ticker", "left_anti")
    dates = keep("dates", trading_dates(held, cfg))
    grid = keep("cells", dense(repaired(adjusted(held.join(dates.select("date"), "date", "left_semi"))), dates))
    member = members_on(grid.select("date", "ticker"), membership(held)).withColumn("member", F.lit(True))
    grid = grid.join(member, ["date", "ticker"], "left")
    history = Window.partitionBy("ticker").orderBy("t")
    upto = history.rowsBetween(Window.unboundedPreceding, 0)
    target = F.try_divide(F.lead("o", 2).over(history), F.lead("o", 1).over(history)) - 1
    clip = cfg.target_clip
    grid = grid.withColumns(
        {
            "universe": F.coalesce(F.col("member"), F.lit(False)) & F.col("c").isNotNull() & F.col("o").isNotNull() & (F.count("c").over(upto) >= cfg.min_history) & F.coalesce(F.col("raw_close") >= cfg.min_price, F.lit(False)),
            "target": F.when(target.isNotNull(), F.greatest(F.lit(-clip), F.least(F.lit(clip), target))),
            "r": F.try_divide(F.col("c"), F.lag("c", 1).over(history)) - 1,
        }
    )
    grid = grid.withColumn("m", F.avg(F.when(F.coalesce(F.lag("universe").over(history), F.lit(False)), F.col("r"))).over(Window.partitionBy("date")))
    return grid.select("date", "t", "ticker", "o", "h", "l", "c", "dv", "raw_close", "universe", "target", "m")


def complete(rows: DataFrame, since: str | None = None) -> DataFrame:
    """Panel rows from a date on, without the last two dates: their returns to come are not known yet."""
    last = rows.agg((F.max("t") - 2).alias("last_t"))
    kept = rows.where(F.col("date") >= F.lit(since).cast("date")) if since else rows
    # One row.
    return kept.join(F.broadcast(last), F.col("t") <= F.col("last_t")).drop("last_t")


def panel_sql(cfg: PanelConfig = WEEKLY) -> list[str]:
    """The panel for DuckDB, as CTEs that end in ``panel``."""
    return [
        f"""bars AS (SELECT date_trunc('{cfg.unit}', l_shipdate)::DATE AS date, l_suppkey % {cfg.tickers} AS ticker,
            arg_min(px, k) AS open, max(px) AS high, min(px) AS low, arg_max(px, k) AS close, sum(l_quantity) AS volume, sum(l_extendedprice) AS dvol
          FROM (SELECT *, l_extendedprice / l_quantity AS px, row(l_shipdate, l_orderkey, l_linenumber, l_partkey, l_extendedprice / l_quantity) AS k FROM lineitem) GROUP BY 1, 2)""",
        "bars_adj AS (SELECT *, close * CASE WHEN ticker % 7 = 0 AND date < DATE '1995-01-01' THEN 0.5 ELSE 1 END AS adj_close FROM bars)",
        "held AS (SELECT * FROM bars_adj WHERE ticker % 19 <> 18)",
        f"per AS (SELECT date, n, quantile_cont(n, 0.5) OVER (ORDER BY date ROWS BETWEEN {cfg.stray_window} PRECEDING AND {cfg.stray_window} FOLLOWING) AS typical FROM (SELECT date, count(*) AS n FROM held GROUP BY date))",
        f"calendar AS (SELECT date, n, typical, row_number() OVER (ORDER BY date) - 1 AS t FROM per WHERE n >= {cfg.stray_share} * typical)",
        "span AS (SELECT ticker, min(date) AS f, max(date) AS e FROM held GROUP BY ticker)",
        "membership AS (SELECT ticker, (f + ((ticker % 3) * 28)::INT)::DATE AS start, CASE WHEN ticker % 4 = 3 THEN (e - 84)::DATE END AS stop FROM span UNION ALL SELECT ticker, (e - 42)::DATE, e FROM span WHERE ticker % 8 = 3)",
        """grid AS (SELECT c.date, c.t, s.ticker, b.open * (b.adj_close / nullif(b.close, 0)) AS o, b.high * (b.adj_close / nullif(b.close, 0)) AS h0, b.low * (b.adj_close / nullif(b.close, 0)) AS l0,
            b.adj_close AS c, b.close AS raw_close, CASE WHEN b.volume > 0 THEN b.dvol END AS dv
          FROM calendar c CROSS JOIN span s LEFT JOIN held b ON b.date = c.date AND b.ticker = s.ticker)""",
        """grid2 AS (SELECT *, greatest(h0, o, c) AS h, least(l0, o, c) AS l,
            lead(o, 2) OVER (PARTITION BY ticker ORDER BY t) / nullif(lead(o, 1) OVER (PARTITION BY ticker ORDER BY t), 0) - 1 AS raw_target,
            c / nullif(lag(c) OVER (PARTITION BY ticker ORDER BY t), 0) - 1 AS r,
            count(c) OVER (PARTITION BY ticker ORDER BY t ROWS UNBOUNDED PRECEDING) AS history,
            EXISTS (SELECT 1 FROM membership m WHERE m.ticker = grid.ticker AND grid.date >= m.start AND (m.stop IS NULL OR grid.date < m.stop)) AS member FROM grid)""",
        f"grid3 AS (SELECT *, coalesce(member AND c IS NOT NULL AND o IS NOT NULL AND history >= {cfg.min_history} AND raw_close >= {cfg.min_price}, false) AS universe, CASE WHEN raw_target > {cfg.target_clip} THEN {cfg.target_clip} WHEN raw_target < -{cfg.target_clip} THEN -{cfg.target_clip} ELSE raw_target END AS target FROM grid2)",
        "grid4 AS (SELECT *, lag(universe) OVER (PARTITION BY ticker ORDER BY t) AS was FROM grid3)",
        "panel AS (SELECT date, t, ticker, o, h, l, c, dv, raw_close, universe, target, avg(CASE WHEN was THEN r END) OVER (PARTITION BY date) AS m FROM grid4)",
    ]

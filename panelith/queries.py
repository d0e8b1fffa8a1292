"""The registered queries on panels and markets, and their DuckDB twins."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from panelith.functions import expr as e
from panelith.functions import signals
from panelith.functions.expr import Node
from panelith.plans import duck
from panelith.plans.stages import evaluate
from panelith.sources import panel as source

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}
#: Digits after which engines may differ by the order of their sums.
DIGITS = 6


def query(sql: str | None = None, name: str | None = None) -> Callable:
    """Registers a function of (spark, sf_dir) under its own or the given name, with its SQL."""

    def add(f: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
        key = name or f.__name__
        QUERIES[key] = f
        if sql:
            SQL[key] = sql
        return f

    return add


def tidy(df: DataFrame, digits: int = DIGITS) -> DataFrame:
    """Doubles rounded, -0.0 as 0.0."""
    return df.select(*[(F.round(c, digits) + 0.0).alias(c) if t == "double" else F.col(c) for c, t in df.dtypes])


def with_(ctes: list[str], select: str) -> str:
    return "WITH " + ",\n".join(ctes) + "\n" + select


def rounded(columns: list[str], digits: int = DIGITS) -> str:
    return ", ".join(f"round({c}, {digits}) + 0.0 AS {c}" for c in columns)


def node_query(name: str, outputs: dict[str, Node], cfg: source.PanelConfig = source.WEEKLY, digits: int = DIGITS) -> None:
    """One query that evaluates nodes over the panel, in Spark and in DuckDB."""

    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        return tidy(evaluate(source.panel(spark, sf_dir, cfg), outputs, keep=("date", "ticker")), digits)

    ctes, select = duck.program("panel", outputs, keep=("date", "ticker"))
    QUERIES[name] = run
    SQL[name] = with_([*source.panel_sql(cfg), *ctes, f"evaluated AS ({select})"], f"SELECT date, ticker, {rounded(list(outputs), digits)} FROM evaluated")


PANEL_SQL = source.panel_sql()
for _family in ("momentum", "seasonal", "risk", "technical", "liquidity", "worldquant", "interaction"):
    node_query(f"signals_{_family}", signals.family(_family))
node_query("signals_seasonal_daily", signals.family("seasonal"), source.DAILY)

_C, _H, _L, _O, _DV, _R, _M = signals.C, signals.H, signals.L, signals.O, signals.DV, signals.R, signals.MARKET
for _name, _outputs in {
    "ts_mean": {"v5": e.ts_mean(_C, 5), "v63": e.ts_mean(_C, 63), "v252": e.ts_mean(_C, 252)},
    "ts_sum": {"v5": e.ts_sum(_R, 5), "v63": e.ts_sum(_R, 63)},
    "ts_std": {"v5": e.ts_std(_R, 5), "v63": e.ts_std(_R, 63), "weekly": e.ts_std(_R, 63, 50)},
    "ts_minmax": {"high": e.ts_max(_H, 21), "low": e.ts_min(_L, 21)},
    "ts_rank": {"v5": e.ts_rank(_C, 5), "v10": e.ts_rank(_DV, 10)},
    "ts_corr": {"v10": e.ts_corr(_C, _DV, 10), "v63": e.ts_corr(_R, _M, 63)},
    "ts_cov": {"v21": e.ts_cov(_R, _M, 21), "v63": e.ts_cov(_R, _M, 63)},
    "ts_argmax_age": {"high": e.days_since_max(_H, 21), "low": e.days_since_min(_L, 21)},
    "decay_linear": {"v5": e.decay_linear(_R, 5), "v7": e.decay_linear(_C, 7)},
    "delta_shift": {"delta1": e.delta(_C, 1), "delta5": e.delta(_C, 5), "lag3": e.lag(_C, 3), "lead2": e.lag(_O, -2)},
    "pct_change": {"r": _R},
    "ret_skip": {"ret": e.change(_C, 21, 5)},
    "rolling_skew": {"v": e.ts_skew(_R, 21)},
    "rolling_kurt": {"v": e.ts_kurt(_R, 21)},
    "ewm_mean": {"v": e.ewm(_R, 0.1, 10)},
    "rsi": {"v2": signals.rsi(2), "v14": signals.rsi(14)},
    "trend_line": {"t": signals.trend(21, "t"), "r2": signals.trend(21, "r2")},
    "streak": {"v": e.streak(_R)},
    "seasonal": {"v": signals.seasonal(1, 21)},
    "beta": {"v": signals.beta(63)},
    "resid": {"v": signals.RESIDUAL},
    "volatility": {"vol": e.ts_std(_R, 21), "ldv": signals.LOG_DV, "vwap": signals.TYPICAL, "shock": signals.dv_shock(21)},
    "xs_rank": {"close": e.xs_rank(_C), "volume": e.xs_rank(_DV)},
    "interaction": {"v": signals.crossed(_R, signals.dv_shock(21))},
    "math_functions": {"ln": e.ln(_C), "sqrt": e.sqrt(_C), "abs": e.absolute(_R), "sign": e.sign(_R), "pow": e.power(_R, 5), "clip": e.clipped(_R, -0.05, 0.05), "flag": e.positive_flag(_R)},
}.items():
    node_query(_name, _outputs)


@query(with_(PANEL_SQL[:2], f"SELECT date, ticker, volume, {rounded(['open', 'high', 'low', 'close', 'adj_close', 'dvol'], 9)} FROM bars_adj"))
def bars(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = source.bars(spark, sf_dir)
    return df.select("date", "ticker", "volume", *[(F.round(c, 9) + 0.0).alias(c) for c in ("open", "high", "low", "close", "adj_close", "dvol")])


@query(with_(PANEL_SQL, f"SELECT date, t, ticker, universe, {rounded(['o', 'h', 'l', 'c', 'dv', 'target', 'm'], 9)} FROM panel"))
def panel(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = source.panel(spark, sf_dir).drop("raw_close")
    return tidy(df.withColumn("t", F.col("t").cast("long")), 9)


@query(with_(PANEL_SQL, "SELECT date, n, typical FROM calendar"))
def trading_dates(spark: SparkSession, sf_dir: str) -> DataFrame:
    raw = source.bars(spark, sf_dir)
    return source.trading_dates(raw.join(source.recycled(raw), "ticker", "left_anti"))


@query(with_(PANEL_SQL, "SELECT DISTINCT h.date, h.ticker FROM held h JOIN membership m ON m.ticker = h.ticker AND h.date >= m.start AND (m.stop IS NULL OR h.date < m.stop)"))
def membership_range_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    raw = source.bars(spark, sf_dir)
    held = raw.join(source.recycled(raw), "ticker", "left_anti")
    return source.members_on(held.select("date", "ticker"), source.membership(held))


@query(with_(PANEL_SQL, "SELECT date, sum(universe::INT) AS members, round(avg(m), 8) AS market FROM panel GROUP BY date"))
def universe_market(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = source.panel(spark, sf_dir)
    return df.groupBy("date").agg(F.sum(F.col("universe").cast("int")).alias("members"), F.round(F.avg("m"), 8).alias("market"))

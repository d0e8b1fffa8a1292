"""The two stages of a study: a choice made on validation dates alone, and its evaluation on dates held out."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from panelith.operators import evaluation as ev
from panelith.operators import portfolio as pf
from panelith.sources import store


def ranking(daily: DataFrame, before: int, cost_bps: float) -> DataFrame:
    """``config, val_sharpe, ann, turnover`` over the years before one: ``daily`` has ``config, date, ls_gross, ls_to``."""
    net = F.col("ls_gross") - F.col("ls_to") * cost_bps / 1e4
    rows = daily.where(F.year("date") < before).withColumn("net", net)
    return rows.groupBy("config").agg(ev.sharpe("net").alias("val_sharpe"), (F.avg("net") * 252).alias("ann"), F.avg("ls_to").alias("turnover"))


def validation(daily: DataFrame, before: int, cost_bps: float, path: str) -> dict:
    """Ranks all configurations before the held-out years and freezes the best at ``path``; a frozen one stays."""
    return store.freeze(ranking(daily, before, cost_bps), path)


def final(daily: DataFrame, start: int, cost_bps: float, path: str, costs: tuple[float, ...] = (0, 2, 5, 10, 20)) -> dict[str, DataFrame]:
    """The frozen configuration from ``start`` on: ``costs``, ``years`` and its ``deflated`` ratio, and the ``holdout`` ratios of all. Without a frozen choice it raises."""
    spark = daily.sparkSession
    chosen = store.frozen(spark, path)["config"]
    held = daily.where(F.year("date") >= start)
    own = held.where(F.col("config") == chosen).withColumns({c: F.lit(0.0) for c in ("long_gross", "long_to") if c not in daily.columns})
    net = held.withColumn("net", F.col("ls_gross") - F.col("ls_to") * cost_bps / 1e4)
    trials = [r["val_sharpe"] for r in ranking(daily, start, cost_bps).collect() if r["val_sharpe"] is not None]
    mine = net.where(F.col("config") == chosen)
    return {
        "costs": pf.net_of_costs(own, list(costs)).groupBy("cost_bps").agg(ev.sharpe("ls_net").alias("sharpe")),
        "years": mine.groupBy(F.year("date").alias("year")).agg(F.sum("net").alias("net"), F.avg("ls_to").alias("turnover")),
        "deflated": ev.deflated_sharpe(mine, "net", trials),
        "holdout": net.groupBy("config").agg(ev.sharpe("net").alias("hold_sharpe"), (F.avg("net") * 252).alias("hold_ann"), F.avg("ls_to").alias("hold_turnover")),
    }

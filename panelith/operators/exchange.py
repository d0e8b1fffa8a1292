"""Betting exchange: catalogues and books as JSON, quotes by runner, forecasts by id, the ledger."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from panelith.operators import markets as mk

CATALOGUE_LINE = (
    "marketId string, marketName string, totalMatched double, marketStartTime string, event struct<name:string>, "
    "description struct<rules:string,marketTime:string>, runners array<struct<selectionId:long,runnerName:string>>"
)
BOOK_LINE = (
    "marketId string, status string, runners array<struct<selectionId:long,status:string,lastPriceTraded:double,"
    "ex:struct<availableToBack:array<struct<price:double,size:double>>,availableToLay:array<struct<price:double,size:double>>>>>"
)


def question(event: Column, name: Column) -> Column:
    """What is asked: the event and the market, or the market alone."""
    return F.when(F.coalesce(event, F.lit("")) != "", F.concat(event, F.lit(": "), name)).otherwise(name)


def parse_catalogue(lines: DataFrame, column: str = "value") -> DataFrame:
    """One market a line: ``market_id, name, event, question, rules, close, total_matched`` and its ``runners`` (id and name, in order)."""
    c = lines.select(F.from_json(column, CATALOGUE_LINE).alias("c")).select("c.*")
    name, event = F.coalesce("marketName", F.lit("")), F.coalesce(F.col("event.name"), F.lit(""))
    named = F.transform(F.coalesce("runners", F.array().cast("array<struct<selectionId:bigint,runnerName:string>>")), lambda r: F.struct(r["selectionId"].alias("selection_id"), F.coalesce(r["runnerName"], r["selectionId"].cast("string")).alias("runner")))
    return c.select(
        F.col("marketId").alias("market_id"), name.alias("name"), event.alias("event"), question(event, name).alias("question"), F.coalesce(F.col("description.rules"), F.lit("")).alias("rules"),
        F.try_to_timestamp(F.coalesce(F.col("description.marketTime"), "marketStartTime")).alias("close"), F.coalesce("totalMatched", F.lit(0.0)).alias("total_matched"), named.alias("runners"),
    )


def parse_books(lines: DataFrame, column: str = "value") -> DataFrame:
    """One runner a row: ``market_id, market_status, selection_id, status, ltp`` and the best back and lay with their sizes (no price and size 0 where a ladder is empty)."""
    b = lines.select(F.from_json(column, BOOK_LINE).alias("b")).select(F.col("b.marketId").alias("market_id"), F.col("b.status").alias("market_status"), F.explode("b.runners").alias("r"))
    first = lambda side: F.try_element_at(F.col(f"r.ex.{side}"), F.lit(1))
    back, lay = first("availableToBack"), first("availableToLay")
    return b.select(
        "market_id", "market_status", F.col("r.selectionId").alias("selection_id"), F.col("r.status").alias("status"), F.col("r.lastPriceTraded").alias("ltp"),
        back["price"].alias("back"), F.coalesce(back["size"], F.lit(0.0)).alias("back_size"), lay["price"].alias("lay"), F.coalesce(lay["size"], F.lit(0.0)).alias("lay_size"),
    )


def quoted(markets: DataFrame, books: DataFrame) -> DataFrame:
    """The catalogue's runners with their quotes: runners that only a book knows are ignored, those without a quote are active and have none."""
    listed = markets.select("market_id", F.posexplode("runners").alias("pos", "r")).select("market_id", "pos", "r.*")
    both = listed.join(books.drop("market_status"), ["market_id", "selection_id"], "left")
    return both.withColumns({"status": F.coalesce("status", F.lit("ACTIVE")), "back_size": F.coalesce("back_size", F.lit(0.0)), "lay_size": F.coalesce("lay_size", F.lit(0.0))})


def eligible(markets: DataFrame, now: Column, cfg: mk.MarketConfig = mk.MARKETS) -> DataFrame:
    """Markets that close in time, have two runners or more but not too many, and enough money matched."""
    days = mk.days_until(F.col("close"), now)
    return markets.where(F.size("runners").between(2, cfg.max_runners) & days.between(cfg.min_days, cfg.max_exchange_days) & (F.col("total_matched") >= cfg.min_matched))


def chances_by_id(markets: DataFrame, forecasts: DataFrame) -> DataFrame:
    """``market_id, selection_id, q`` from forecasts by name (``market_id, probabilities map``); names that are not listed are dropped.

    Of runners with one name the last listed takes its chance.
    """
    listed = markets.select("market_id", F.posexplode("runners").alias("pos", "r"))
    last = listed.groupBy("market_id", F.col("r.runner").alias("runner")).agg(F.max_by("r.selection_id", "pos").alias("selection_id"))
    given = forecasts.select("market_id", F.explode("probabilities").alias("runner", "q"))
    return given.join(last, ["market_id", "runner"]).select("market_id", "selection_id", "q")


#: A row of the ledger: what was bet on a market, and what the forecast and the market said of each runner.
LEDGER = "market_id string, selection_id long, side string, odds double, stake double, risk double, model map<string,double>, market map<string,double>, runners array<bigint>, status string, winners array<bigint>, pnl double, settled_at timestamp"


def settle(ledger: DataFrame, books: DataFrame, now: Column, cfg: mk.MarketConfig = mk.MARKETS) -> DataFrame:
    """Open rows whose market is closed with a winner take its winners and their profit; rows without a bet settle at 0, others stay."""
    results = books.groupBy("market_id").agg(F.max(F.col("market_status") == "CLOSED").alias("over"), F.array_sort(F.collect_set(F.when(F.col("status") == "WINNER", F.col("selection_id")))).alias("found"))
    results = results.where(F.col("over") & (F.size("found") > 0)).select(F.col("market_id").alias("closed_market"), "found")
    both = ledger.join(results, F.col("market_id") == F.col("closed_market"), "left")
    settles = (F.col("status") == "open") & F.col("found").isNotNull()
    won = F.array_contains("found", F.col("selection_id"))
    profit = F.when(F.col("side").isNotNull(), mk.settle_pnl(F.col("side"), F.col("odds"), F.col("stake"), won, cfg.commission)).otherwise(0.0)
    out = {"winners": F.when(settles, F.col("found")).otherwise(F.col("winners")), "pnl": F.when(settles, profit).otherwise(F.col("pnl")), "settled_at": F.when(settles, now).otherwise(F.col("settled_at")), "status": F.when(settles, "settled").otherwise(F.col("status"))}
    return both.withColumns(out).select(*ledger.columns)


def score(ledger: DataFrame) -> DataFrame:
    """Brier and log scores of forecasts and market over settled rows that have a forecast, and the bets' money: ``bets, risked, pnl, roi``."""
    rows = ledger.where((F.col("status") == "settled") & (F.size("model") > 0))
    chance = lambda side: F.coalesce(F.try_element_at(F.col(side), F.col("id").cast("string")), F.lit(0.0))
    each = rows.select("market_id", "model", "market", "winners", F.explode("runners").alias("id")).withColumn("won", F.array_contains("winners", F.col("id")).cast("int"))
    accuracy = mk.score_runners(each.select("market_id", chance("model").alias("model"), chance("market").alias("market"), "won"))
    bet = F.col("side").isNotNull()
    money = rows.agg(F.count(F.when(bet, 1)).alias("bets"), F.coalesce(F.sum(F.when(bet, F.col("risk"))), F.lit(0.0)).alias("risked"), F.coalesce(F.sum(F.when(bet, F.col("pnl"))), F.lit(0.0)).alias("pnl"), F.try_divide(F.sum(F.when(bet, F.col("pnl"))), F.sum(F.when(bet, F.col("risk")))).alias("roi"))
    return accuracy.crossJoin(money)  # one row each


def by_market(rows: DataFrame, value: str) -> DataFrame:
    """``market_id`` and a map from runner to ``value``, known values only. A market has few runners."""
    return rows.where(F.col(value).isNotNull()).groupBy("market_id").agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct(F.col("selection_id").cast("string").alias("runner_key"), value)))).alias(value))


def booked(quotes: DataFrame, cfg: mk.MarketConfig = mk.MARKETS, open_risk: float = 0.0) -> DataFrame:
    """New ledger rows from quotes with forecasts (``quoted`` with ``q``): the best bet of each market within the cap on all open risk, in order of market."""
    wants = mk.capped(mk.decide_exchange(quotes, cfg), ["market_id"], open_risk, cfg, stake="risk")
    implied = by_market(mk.implied_probabilities(quotes).withColumnRenamed("implied", "market"), "market")
    listed = quotes.groupBy("market_id").agg(F.array_sort(F.collect_list("selection_id")).alias("runners"))
    held = wants.join(listed, "market_id").join(by_market(quotes.withColumnRenamed("q", "model"), "model"), "market_id", "left").join(implied, "market_id", "left")
    takes = F.col("side").isNotNull() & (F.col("risk") > 0)
    stake = F.when(F.col("side") == "BACK", F.col("risk")).otherwise(F.col("risk") / (F.col("odds") - 1))
    nothing = F.create_map().cast("map<string,double>")
    keep = lambda c: F.when(takes, F.col(c)).alias(c)
    return held.select(
        "market_id", keep("selection_id"), keep("side"), keep("odds"), F.when(takes, stake).otherwise(0.0).alias("stake"), F.when(takes, F.col("risk")).otherwise(0.0).alias("risk"), F.coalesce("model", nothing).alias("model"), F.coalesce("market", nothing).alias("market"), "runners",
        F.lit("open").alias("status"), F.lit(None).cast("array<bigint>").alias("winners"), F.lit(None).cast("double").alias("pnl"), F.lit(None).cast("timestamp").alias("settled_at"),
    )


def latest(rows: DataFrame, order: str, *keys: str) -> DataFrame:
    """The last row of each key."""
    return rows.withColumn("place", F.row_number().over(Window.partitionBy(*keys).orderBy(F.col(order).desc()))).where("place = 1").drop("place")

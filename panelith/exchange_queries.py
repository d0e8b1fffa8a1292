"""Queries on parsing, the exchange's books and ledger, prompts and streams, with their DuckDB twins.

JSON lines are made from the markets and runners of ``market_queries``; the twins compute what parsing must give from these tables directly.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from panelith.market_queries import BASE, EXCHANGE, NOW, RUNNERS, events, markets, runners
from panelith.operators import exchange as ex
from panelith.operators import markets as mk
from panelith.queries import query, rounded, tidy, with_
from panelith.sources import store
from panelith.streaming import jobs

LATER = "2024-03-01 00:00:00"
QUOTE_COLUMNS = ["back", "back_size", "lay", "lay_size", "ltp"]


def catalogue(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A catalogue line a market."""
    listed = runners(spark, sf_dir).groupBy("market_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("pos", "selection_id", "runner"))), lambda r: F.struct(r["selection_id"].alias("selectionId"), r["runner"].alias("runnerName"))).alias("runners"))
    m = markets(spark, sf_dir).join(listed, "market_id")
    line = F.struct(
        F.col("market_id").cast("string").alias("marketId"), F.col("question").alias("marketName"), F.col("volume").alias("totalMatched"), F.struct(F.coalesce("category", F.lit("")).alias("name")).alias("event"),
        F.struct(F.lit("As announced.").alias("rules"), F.date_format("end", "yyyy-MM-dd'T'HH:mm:ss.SSSSSS'Z'").alias("marketTime")).alias("description"), "runners",
    )
    return m.select(F.to_json(line).alias("value"))


def books(spark: SparkSession, sf_dir: str, over: bool = False) -> DataFrame:
    """A book line a market, with a runner that no catalogue lists; if ``over``, with winners in two markets of three."""
    closed = (F.col("market_id") % 3 != 0) & F.lit(over)
    status = F.when(closed, F.when(F.col("pos") == F.col("market_id") % 5, "WINNER").otherwise("LOSER")).otherwise(F.col("status"))
    ladder = lambda price, size: F.when(F.col(price).isNotNull(), F.array(F.struct(F.col(price).alias("price"), F.col(size).alias("size")), F.struct(F.lit(1.01).alias("price"), F.lit(1.0).alias("size")))).otherwise(F.array().cast("array<struct<price:double,size:double>>"))
    one = F.struct(F.col("selection_id").alias("selectionId"), status.alias("status"), F.col("ltp").alias("lastPriceTraded"), F.struct(ladder("back", "back_size").alias("availableToBack"), ladder("lay", "lay_size").alias("availableToLay")).alias("ex"))
    held = runners(spark, sf_dir).withColumn("one", one)
    lines = held.groupBy("market_id").agg(F.collect_list("one").alias("ones"), F.max(closed).alias("over"))
    unknown = F.transform(F.slice("ones", 1, 1), lambda x: F.struct(F.lit(99).alias("selectionId"), F.lit("LOSER").alias("status"), x["lastPriceTraded"].alias("lastPriceTraded"), x["ex"].alias("ex")))
    return lines.select(F.to_json(F.struct(F.col("market_id").cast("string").alias("marketId"), F.when(F.col("over"), "CLOSED").otherwise("OPEN").alias("status"), F.concat("ones", unknown.cast(lines.schema["ones"].dataType)).alias("runners"))).alias("value"))


def quotes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ex.quoted(ex.parse_catalogue(catalogue(spark, sf_dir)), ex.parse_books(books(spark, sf_dir)))


@query(with_(RUNNERS, "SELECT market_id::VARCHAR AS market_id, pos, pos AS selection_id, runner, status, " + ", ".join(f"round(coalesce({c}, {0.0 if 'size' in c else 'NULL'}), 6) + 0.0 AS {c}" for c in ("back", "lay", "ltp")) + ", CASE WHEN back IS NULL THEN 0.0 ELSE back_size END AS back_size, CASE WHEN lay IS NULL THEN 0.0 ELSE lay_size END AS lay_size FROM runners"))
def exchange_quotes(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = quotes(spark, sf_dir).withColumn("pos", F.col("pos").cast("long"))
    return tidy(out.select("market_id", "pos", "selection_id", "runner", "status", *QUOTE_COLUMNS))


@query(with_([*RUNNERS, "listed AS (SELECT market_id, count(*) AS n FROM runners GROUP BY 1)"], f"SELECT market_id::VARCHAR AS market_id, CASE WHEN coalesce(category, '') <> '' THEN category || ': ' || question ELSE question END AS question FROM markets JOIN listed USING (market_id) WHERE n BETWEEN 2 AND 20 AND volume >= 5000 AND date_diff('microsecond', {NOW}, \"end\") / 1e6 / 86400 BETWEEN 1 AND 120"))
def exchange_eligible(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ex.eligible(ex.parse_catalogue(catalogue(spark, sf_dir)), F.expr(NOW)).select("market_id", "question")


def forecasts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Answers with a first block of no use and a last one that names all runners and a stranger."""
    per = runners(spark, sf_dir).groupBy("market_id").agg(F.map_from_entries(F.collect_list(F.struct(F.upper("runner").alias("runner"), "q"))).alias("given"), F.collect_list("runner").alias("names"))
    block = F.concat(F.lit("```json\n"), F.to_json(F.struct(F.map_concat("given", F.create_map(F.lit("stranger"), F.lit(0.5))).alias("probabilities"))), F.lit("\n```"))
    return per.select(F.col("market_id").cast("string").alias("market_id"), "names", F.concat(F.lit('First thoughts: ```json\n{"probabilities": {"nobody": 1.0}}\n``` and then '), block).alias("answer"))


@query(with_([*RUNNERS, "weighed AS (SELECT *, greatest(q, 0.005) AS w FROM runners)"], "SELECT market_id::VARCHAR AS market_id, pos AS selection_id, round(w / sum(w) OVER (PARTITION BY market_id), 6) + 0.0 AS q FROM weighed"))
def forecast_by_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    parsed = forecasts(spark, sf_dir).select("market_id", mk.parse_runner_forecast(F.col("answer"), F.col("names")).alias("probabilities"))
    return tidy(ex.chances_by_id(ex.parse_catalogue(catalogue(spark, sf_dir)), parsed))


BOOKED = [
    *EXCHANGE,
    "capped AS (SELECT *, least(3000, sum(want) OVER w) - least(3000, sum(want) OVER w - want) AS granted FROM exdec WINDOW w AS (ORDER BY market_id::VARCHAR ROWS UNBOUNDED PRECEDING))",
    "exledger AS (SELECT c.market_id, CASE WHEN granted > 0 THEN selection_id END AS selection_id, CASE WHEN granted > 0 THEN side END AS side, odds, CASE WHEN granted > 0 AND side IS NOT NULL THEN granted ELSE 0 END AS risk FROM capped c)",
    "fate AS (SELECT l.*, (l.market_id % 3 <> 0 AND EXISTS (SELECT 1 FROM runners r WHERE r.market_id = l.market_id AND r.pos = l.market_id % 5)) AS over, CASE side WHEN 'BACK' THEN risk WHEN 'LAY' THEN risk / (odds - 1) ELSE 0 END AS stake FROM exledger l)",
    "exsettled AS (SELECT *, CASE WHEN over THEN 'settled' ELSE 'open' END AS status, CASE WHEN NOT over THEN NULL WHEN side IS NULL THEN 0 WHEN side = 'BACK' THEN CASE WHEN selection_id = market_id % 5 THEN stake * (odds - 1) * 0.95 ELSE -stake END ELSE CASE WHEN selection_id = market_id % 5 THEN -stake * (odds - 1) ELSE stake * 0.95 END END AS pnl FROM fate)",
]


def settled(spark: SparkSession, sf_dir: str) -> DataFrame:
    chances = runners(spark, sf_dir).select(F.col("market_id").cast("string").alias("market_id"), F.col("selection_id").cast("long").alias("selection_id"), "q")
    ledger = ex.booked(quotes(spark, sf_dir).join(chances, ["market_id", "selection_id"]))
    return ex.settle(ledger, ex.parse_books(books(spark, sf_dir, over=True)), F.lit(LATER).cast("timestamp"))


@query(with_(BOOKED, f"SELECT market_id::VARCHAR AS market_id, selection_id, side, status, {rounded(['stake', 'risk', 'pnl'])} FROM exsettled"))
def exchange_ledger(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tidy(settled(spark, sf_dir).select("market_id", "selection_id", "side", "status", "stake", "risk", "pnl"))


@query(with_([*BOOKED, "im AS (SELECT *, CASE WHEN status = 'ACTIVE' THEN CASE WHEN back IS NOT NULL AND lay IS NOT NULL THEN (1 / back + 1 / lay) / 2 ELSE 1 / ltp END END AS raw FROM runners)", "pr AS (SELECT market_id, pos, q AS model, raw / sum(raw) OVER (PARTITION BY market_id) AS market FROM im)",
    "sm AS (SELECT market_id, sum((model - (pos = market_id % 5)::INT) ** 2) AS bm, sum((coalesce(market, 0) - (pos = market_id % 5)::INT) ** 2) AS bk, -ln(greatest(sum(model * (pos = market_id % 5)::INT), 1e-6)) AS lm, -ln(greatest(sum(coalesce(market, 0) * (pos = market_id % 5)::INT), 1e-6)) AS lk FROM pr SEMI JOIN (SELECT market_id FROM exsettled WHERE over) o USING (market_id) GROUP BY 1)",
    "money AS (SELECT count(side) AS bets, coalesce(sum(CASE WHEN side IS NOT NULL THEN risk END), 0) AS risked, coalesce(sum(CASE WHEN side IS NOT NULL THEN pnl END), 0) AS pnl FROM exsettled WHERE over)"],
    "SELECT count(*) AS settled, round(avg(bm), 6) AS brier_model, round(avg(bk), 6) AS brier_market, round(avg(lm), 6) AS logscore_model, round(avg(lk), 6) AS logscore_market, any_value(bets) AS bets, round(any_value(risked), 6) AS risked, round(any_value(pnl), 6) + 0.0 AS pnl, round(any_value(pnl) / nullif(any_value(risked), 0), 6) + 0.0 AS roi FROM sm, money"))
def scorecard_exchange(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tidy(ex.score(settled(spark, sf_dir)))


def market_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Markets as a listing's JSON: numbers as text, lists as text within text, tags in events, some outcomes reversed."""
    m = markets(spark, sf_dir)
    reversed_ = F.col("market_id") % 4 == 1
    won, lost = F.when(F.col("market_id") % 7 == 2, "0.6").otherwise("1"), F.when(F.col("market_id") % 7 == 2, "0.4").otherwise("0")
    yes, no = F.when(F.col("yes_won") == 1, won).otherwise(lost), F.when(F.col("yes_won") == 1, lost).otherwise(won)
    listed = lambda a, b: F.to_json(F.when(reversed_, F.array(b, a)).otherwise(F.array(a, b)))
    line = F.struct(
        F.col("market_id").cast("string").alias("id"), "question", F.date_format("end", "yyyy-MM-dd'T'HH:mm:ss.SSSSSS'Z'").alias("endDate"), (F.col("market_id") % 11 != 3).alias("closed"), F.lit(True).alias("active"), listed(F.lit("Yes"), F.lit("No")).alias("outcomes"), listed(yes, no).alias("outcomePrices"), F.to_json(F.array(F.lit("a"), F.lit("b"))).alias("clobTokenIds"),
        F.when(F.col("market_id") % 13 == 0, "much").otherwise(F.col("volume").cast("string")).alias("volumeNum"), F.array(F.struct(F.array(F.struct(F.col("category").alias("label"))).alias("tags"))).alias("events"),
    )
    return m.select(F.to_json(line).alias("value"))


@query(with_(BASE, """SELECT market_id::VARCHAR AS id, question, "end", lower(category) AS category, CASE WHEN market_id % 4 = 1 THEN 1 ELSE 0 END::INT AS yes_index, CASE WHEN market_id % 13 = 0 THEN 0.0 ELSE volume END AS volume,
    CASE WHEN yes_won = 1 THEN CASE WHEN market_id % 7 = 2 THEN 0.6 ELSE 1 END ELSE CASE WHEN market_id % 7 = 2 THEN 0.4 ELSE 0 END END::DOUBLE AS yes_price, CASE WHEN market_id % 11 <> 3 AND market_id % 7 <> 2 THEN yes_won = 1 END AS resolved_yes, true AS is_binary FROM markets"""))
def parsed_markets(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = mk.parse_markets(market_lines(spark, sf_dir)).withColumn("end", F.col("end").cast("timestamp_ntz"))
    return tidy(out.select("id", "question", "end", "category", "yes_index", "volume", "yes_price", "resolved_yes", "is_binary"))


@query(with_(BASE, "SELECT market_id, CASE WHEN market_id % 6 = 5 THEN NULL ELSE round(greatest(0.01, least(0.99, (market_id % 999 + 0.5) / 1000)), 6) END AS q FROM markets"))
def parsed_forecasts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last usable block of answers in several forms: fenced, bare, followed by one of no use, or without any."""
    p = F.to_json(F.struct(((F.col("market_id") % 999 + 0.5) / 1000).alias("probability")))
    fenced = F.concat(F.lit("```json\n"), p, F.lit("\n```"))
    kind = F.col("market_id") % 6
    text = F.when(kind == 5, "I can't tell.").when(kind == 4, F.concat(F.lit("So: "), p)).when(kind == 3, F.concat(fenced, F.lit('\nor ```json\n{"probability": 2}\n```'))).when(kind == 2, F.concat(F.lit('```json\n{"probability": 0.111}\n```\n'), fenced)).otherwise(fenced)
    return tidy(markets(spark, sf_dir).select("market_id", mk.parse_forecast(text).alias("q")))


@query(with_(BASE, f"""SELECT market_id, 'It is now ' || strftime({NOW}, '%-d %B %Y, %H:%M') || ' (UTC).' || chr(10) || 'To be forecast: ' || question || chr(10) || 'It will end as one of: Yes; No.' || chr(10) || 'It is decided on ' || strftime("end", '%-d %B %Y, %H:%M') || '.' || chr(10)
    || CASE WHEN market_id % 2 = 0 THEN 'It is decided by these rules:' || chr(10) || 'As announced.' ELSE 'No rules are given beyond the question.' END AS prompt FROM markets"""))
def prompts(spark: SparkSession, sf_dir: str) -> DataFrame:
    rules = F.when(F.col("market_id") % 2 == 0, " As announced. ").otherwise(" ")
    return markets(spark, sf_dir).select("market_id", mk.prompt(F.col("question"), rules, F.col("end"), F.expr(NOW), F.array(F.lit("Yes"), F.lit("No"))).alias("prompt"))


@query("SELECT user_id AS market_id, count(*) AS n, round(max(value), 6) AS most FROM events GROUP BY 1")
def stream_ingest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events through a stream into a table, twice, of which the second run finds nothing new."""
    path = store.scratch(spark, "stream-ingest")
    schema = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in events(spark, sf_dir).schema.fields)
    # As a pattern, the place may be one file or a folder of them.
    place = f"{sf_dir}/events.parque[t]"
    for turn in range(2):
        jobs.ingest(jobs.arriving(spark, place, schema, "parquet"), f"{path}/table", f"{path}/checkpoint{turn}", "event_id")
    return tidy(spark.read.parquet(f"{path}/table").groupBy(F.col("user_id").alias("market_id")).agg(F.count(F.lit(1)).alias("n"), F.max("value").alias("most")))

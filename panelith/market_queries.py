"""Queries on markets, stakes and ledgers over the events table, with their DuckDB twins.

Each user's events are a market's ticks: price = value / 500, category = the last event's type;
the market ends at its last event and resolves by the parity of its number.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from panelith.operators import markets as mk
from panelith.queries import query, rounded, tidy, with_

DAYS = mk.MARKETS.snapshot_days
NOW = "TIMESTAMP '2024-01-20 00:00:00'"


def events(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/events.parquet")


def ticks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return events(spark, sf_dir).select(F.col("user_id").alias("market_id"), "ts", (F.col("value") / 500).alias("price"), "event_type", "event_id")


def markets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``market_id, end, category, volume, yes_won, question``."""
    names = F.create_map(*[F.lit(x) for kv in {"click": "Politics", "view": "sports", "purchase": "crypto", "signup": "geopolitics"}.items() for x in kv])
    per = ticks(spark, sf_dir).groupBy("market_id").agg(F.max("ts").alias("end"), F.max_by("event_type", F.struct("ts", "event_id")).alias("kind"), (F.count(F.lit(1)) * 500.0).alias("volume"))
    return per.select("market_id", "end", F.try_element_at(names, F.col("kind")).alias("category"), "volume", (F.col("market_id") % 2).cast("int").alias("yes_won"), F.concat(F.lit("Will market "), F.col("market_id").cast("string"), F.when(F.col("market_id") % 5 == 0, " vs. the other one?").otherwise(" close higher?")).alias("question"))


BASE = [
    "ticks AS (SELECT user_id AS market_id, ts, value / 500 AS price, event_type, event_id FROM events)",
    "mk0 AS (SELECT market_id, max(ts) AS \"end\", arg_max(event_type, row(ts, event_id)) AS kind, count(*) * 500.0::DOUBLE AS volume FROM ticks GROUP BY 1)",
    "markets AS (SELECT market_id, \"end\", CASE kind WHEN 'click' THEN 'Politics' WHEN 'view' THEN 'sports' WHEN 'purchase' THEN 'crypto' WHEN 'signup' THEN 'geopolitics' END AS category, volume, (market_id % 2)::INT AS yes_won, 'Will market ' || market_id || CASE WHEN market_id % 5 = 0 THEN ' vs. the other one?' ELSE ' close higher?' END AS question FROM mk0)",
]
SNAPS = [
    *BASE,
    f"cuts AS (SELECT *, \"end\" - to_days(d) AS cut, d AS days_before FROM markets, (SELECT unnest({list(DAYS)}) AS d))",
    "priced AS (SELECT c.*, t.price AS yes_price, row_number() OVER (PARTITION BY c.market_id, c.days_before ORDER BY t.ts DESC, t.price DESC) AS n FROM cuts c JOIN ticks t ON t.market_id = c.market_id AND t.ts <= c.cut)",
    "snaps AS (SELECT * FROM priced WHERE n = 1 AND yes_price > 0 AND yes_price < 1)",
]
RATE = "CASE lower(coalesce(category, '')) WHEN 'politics' THEN 0.04 WHEN 'sports' THEN 0.05 WHEN 'crypto' THEN 0.07 WHEN 'geopolitics' THEN 0.0 ELSE 0.05 END::DOUBLE"
BUCKET = "CASE WHEN price < 0 THEN NULL " + " ".join(f"WHEN price <= {x} THEN {x}" for x in mk.EDGES[1:]) + " END::DOUBLE"
CONTRACTS = [
    *SNAPS,
    "both_sides AS (SELECT market_id, days_before, category, \"end\", 'YES' AS side, yes_price AS price, yes_won::DOUBLE AS won FROM snaps UNION ALL SELECT market_id, days_before, category, \"end\", 'NO', 1 - yes_price, 1 - yes_won FROM snaps)",
    f"contracts AS (SELECT *, {RATE} * price * (1 - price) AS fee, won / (price + {RATE} * price * (1 - price)) - 1 AS ret, {BUCKET} AS bucket FROM both_sides)",
]
CALIBRATION = "count(*) AS {n}, round(avg(price), 6) + 0.0 AS avg_price, round(avg(won), 6) + 0.0 AS win_rate, round(avg(ret), 6) + 0.0 AS mean_return, round(stddev_samp(ret) / sqrt(count(*)), 6) + 0.0 AS se, round(avg(won) - avg(price), 6) + 0.0 AS gap"


def snaps(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mk.snapshots(ticks(spark, sf_dir).select("market_id", "ts", "price"), markets(spark, sf_dir))


@query(with_(SNAPS, f"SELECT market_id, days_before, category, yes_won, {rounded(['yes_price'])} FROM snaps"))
def asof_snapshot(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tidy(snaps(spark, sf_dir).select("market_id", "days_before", "category", "yes_won", "yes_price"))


@query(with_(CONTRACTS, f"SELECT market_id, days_before, side, bucket, {rounded(['price', 'won', 'fee', 'ret'])} FROM contracts"))
def contracts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tidy(mk.contracts(snaps(spark, sf_dir)).select("market_id", "days_before", "side", "bucket", "price", "won", "fee", "ret"))


@query(with_(CONTRACTS, f"SELECT days_before, bucket, {CALIBRATION.format(n='contracts')} FROM contracts GROUP BY 1, 2"))
def calibration(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tidy(mk.calibration(mk.contracts(snaps(spark, sf_dir)), "days_before"))


@query(with_([*CONTRACTS, "ordered AS (SELECT \"end\", row_number() OVER (ORDER BY \"end\") - 1 AS k, count(*) OVER () AS n FROM snaps WHERE days_before = 7)", "cut AS (SELECT \"end\" AS cut FROM ordered WHERE k = floor(n * 0.5))"],
    "SELECT CASE WHEN \"end\" < cut THEN 'first half' ELSE 'second half' END AS half, count(*) AS bets, round(avg(won), 6) + 0.0 AS win_rate, round(avg(ret), 6) + 0.0 AS mean_return, CASE WHEN count(*) > 1 THEN round(stddev_samp(ret) / sqrt(count(*)), 6) + 0.0 END AS se, round(avg(ret) / 7, 6) + 0.0 AS return_per_day FROM contracts, cut WHERE days_before = 7 AND price BETWEEN 0.9 AND 0.98 GROUP BY 1"))
def strategy_test(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tidy(mk.strategy_test(snaps(spark, sf_dir), 0.9, 0.98, 7))


@query(with_(SNAPS, f"SELECT market_id, days_before, round({RATE} * yes_price * (1 - yes_price), 8) + 0.0 AS fee FROM snaps"))
def fees(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tidy(snaps(spark, sf_dir).select("market_id", "days_before", mk.fee_per_share(F.col("yes_price"), F.col("category")).alias("fee")), 8)


def quotes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A quote a market from its price a day before the end, and a forecast from its number."""
    one = snaps(spark, sf_dir).where("days_before = 1")
    return one.select("market_id", "category", "yes_won", "yes_price", (F.col("market_id") * 37 % 100 / 100).alias("q"), F.greatest(F.lit(0.0), F.col("yes_price") - 0.01).alias("bid"), F.least(F.lit(1.0), F.col("yes_price") + 0.01).alias("ask"))


QUOTES = [
    *SNAPS,
    "quotes AS (SELECT market_id, category, yes_won, yes_price, (market_id * 37 % 100) / 100 AS q, greatest(0, yes_price - 0.01) AS bid, least(1, yes_price + 0.01) AS ask FROM snaps WHERE days_before = 1)",
    f"opt AS (SELECT *, ask + {RATE} * ask * (1 - ask) AS yes_cost, (1 - bid) + {RATE} * (1 - bid) * bid AS no_cost FROM quotes)",
    "chosen AS (SELECT *, CASE WHEN q - yes_cost >= (1 - q) - no_cost THEN 'YES' ELSE 'NO' END AS best, greatest(q - yes_cost, (1 - q) - no_cost) AS raw_edge FROM opt)",
    """decided AS (SELECT market_id, category, yes_won, yes_price, q, CASE WHEN raw_edge >= 0.05 THEN best END AS side, CASE WHEN raw_edge >= 0.05 THEN CASE best WHEN 'YES' THEN ask ELSE 1 - bid END END AS price, CASE WHEN raw_edge >= 0.05 THEN CASE best WHEN 'YES' THEN yes_cost ELSE no_cost END END AS cost, raw_edge AS edge,
        CASE WHEN raw_edge >= 0.05 THEN least(0.25 * raw_edge / (1 - CASE best WHEN 'YES' THEN yes_cost ELSE no_cost END), 0.02) * 10000 ELSE 0 END AS want FROM chosen)""",
    "granted AS (SELECT *, greatest(500, least(3000, 500 + sum(want) OVER (ORDER BY market_id ROWS UNBOUNDED PRECEDING))) - greatest(500, least(3000, 500 + sum(want) OVER (ORDER BY market_id ROWS UNBOUNDED PRECEDING) - want)) AS stake FROM decided)",
]


@query(with_(QUOTES, f"SELECT market_id, side, {rounded(['price', 'cost', 'edge', 'want'])} FROM decided"))
def kelly_decide(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tidy(mk.decide(quotes(spark, sf_dir)).select("market_id", "side", "price", "cost", "edge", "want"))


def granted(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mk.capped(mk.decide(quotes(spark, sf_dir)), ["market_id"], open_stake=500.0)


@query(with_(QUOTES, f"SELECT market_id, {rounded(['want', 'stake'])} FROM granted"))
def exposure_cap(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tidy(granted(spark, sf_dir).select("market_id", "want", "stake"))


def ledger(spark: SparkSession, sf_dir: str) -> DataFrame:
    side = F.when(F.col("stake") > 0, F.col("side"))
    return granted(spark, sf_dir).select(
        "market_id", "q", F.col("yes_price").alias("mid"), side.alias("side"), F.when(side.isNotNull(), F.col("stake")).otherwise(0.0).alias("stake"), F.coalesce(F.try_divide(F.col("stake"), F.col("cost")), F.lit(0.0)).alias("shares"), F.lit("open").alias("status"), F.lit(None).cast("int").alias("yes_won"), F.lit(None).cast("double").alias("pnl"), F.lit(None).cast("timestamp").alias("settled_at")
    )


def settled(spark: SparkSession, sf_dir: str) -> DataFrame:
    outcomes = markets(spark, sf_dir).select("market_id", (F.col("market_id") % 11 != 3).alias("closed"), F.when((F.col("market_id") % 11 != 3) & (F.col("market_id") % 7 != 2), F.col("yes_won") == 1).alias("resolved_yes"))
    return mk.settle_binary(ledger(spark, sf_dir), outcomes, F.lit("2024-03-01 00:00:00").cast("timestamp"))


LEDGER = [
    *QUOTES,
    "ledger AS (SELECT market_id, yes_won AS truth, q, yes_price AS mid, CASE WHEN stake > 0 THEN side END AS side, CASE WHEN stake > 0 AND side IS NOT NULL THEN stake ELSE 0 END AS stake, coalesce(stake / cost, 0) AS shares FROM granted)",
    "fates AS (SELECT *, CASE WHEN market_id % 11 = 3 THEN 'open' WHEN market_id % 7 = 2 THEN 'void' ELSE 'settled' END AS status FROM ledger)",
    "settled AS (SELECT *, CASE status WHEN 'settled' THEN truth END AS yes_won, CASE status WHEN 'void' THEN 0.0 WHEN 'settled' THEN CASE WHEN side IS NULL THEN 0.0 ELSE shares * ((side = 'YES') = (truth = 1))::INT - stake END END AS pnl FROM fates)",
]


@query(with_(LEDGER, f"SELECT market_id, side, status, yes_won, {rounded(['stake', 'shares', 'pnl'])} FROM settled"))
def settle_ledger(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tidy(settled(spark, sf_dir).select("market_id", "side", "status", "yes_won", "stake", "shares", "pnl"))


@query(with_(LEDGER, """SELECT count(*) AS settled, round(avg((q - yes_won) ** 2), 6) AS brier_model, round(avg((mid - yes_won) ** 2), 6) AS brier_market,
    round(-avg(yes_won * ln(greatest(1e-6, least(1 - 1e-6, q))) + (1 - yes_won) * ln(1 - greatest(1e-6, least(1 - 1e-6, q)))), 6) AS logloss_model, round(-avg(yes_won * ln(greatest(1e-6, least(1 - 1e-6, mid))) + (1 - yes_won) * ln(1 - greatest(1e-6, least(1 - 1e-6, mid)))), 6) AS logloss_market,
    round(avg(((q - yes_won) ** 2 < (mid - yes_won) ** 2)::INT), 6) AS model_beats_market_share, count(CASE WHEN stake > 0 THEN 1 END) AS bets, round(coalesce(sum(CASE WHEN stake > 0 THEN stake END), 0), 6) AS staked, round(coalesce(sum(CASE WHEN stake > 0 THEN pnl END), 0), 6) + 0.0 AS pnl,
    round(sum(CASE WHEN stake > 0 THEN pnl END) / sum(CASE WHEN stake > 0 THEN stake END), 6) AS roi, round(avg(CASE WHEN stake > 0 THEN (pnl > 0)::INT END), 6) AS bet_hit_rate FROM settled WHERE status = 'settled'"""))
def scorecard_binary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tidy(mk.score_binary(settled(spark, sf_dir)))


def runners(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The event types of a market as its runners, with ladders from their mean and last prices."""
    per = ticks(spark, sf_dir).groupBy("market_id", "event_type").agg(F.avg("price").alias("p"), F.max_by("price", F.struct("ts", "event_id")).alias("last"), F.count(F.lit(1)).alias("n"))
    pos = F.row_number().over(Window.partitionBy("market_id").orderBy("event_type")) - 1
    return per.select(
        "market_id", pos.alias("pos"), pos.alias("selection_id"), F.col("event_type").alias("runner"), F.when((F.col("n") + F.col("market_id")) % 9 == 0, "REMOVED").otherwise("ACTIVE").alias("status"), ((F.col("market_id") * 13 + F.col("n") * 7) % 50 / 100 + 0.01).alias("q"),
        F.when(F.col("n") % 4 != 0, 1 / (F.col("p") + 0.02)).alias("back"), F.when(F.col("n") % 5 != 0, 1 / (F.col("p") + 0.01)).alias("lay"), (F.col("n") * 5.0).alias("back_size"), (F.col("n") * 4.0).alias("lay_size"), (1 / (F.col("last") + 0.01)).alias("ltp"),
    )


RUNNERS = [
    *BASE,
    "r0 AS (SELECT market_id, event_type, avg(price) AS p, arg_max(price, row(ts, event_id)) AS last, count(*) AS n FROM ticks GROUP BY 1, 2)",
    """runners AS (SELECT market_id, row_number() OVER (PARTITION BY market_id ORDER BY event_type) - 1 AS pos, event_type AS runner, CASE WHEN (n + market_id) % 9 = 0 THEN 'REMOVED' ELSE 'ACTIVE' END AS status, (market_id * 13 + n * 7) % 50 / 100 + 0.01 AS q,
        CASE WHEN n % 4 <> 0 THEN 1 / (p + 0.02) END AS back, CASE WHEN n % 5 <> 0 THEN 1 / (p + 0.01) END AS lay, n * 5.0::DOUBLE AS back_size, n * 4.0::DOUBLE AS lay_size, 1 / (last + 0.01) AS ltp FROM r0)""",
]


@query(with_([*RUNNERS, "raw AS (SELECT *, CASE WHEN status = 'ACTIVE' THEN CASE WHEN back IS NOT NULL AND lay IS NOT NULL THEN (1 / back + 1 / lay) / 2 ELSE 1 / ltp END END AS raw FROM runners)"], "SELECT market_id, pos, round(raw / sum(raw) OVER (PARTITION BY market_id), 6) AS implied FROM raw"))
def implied_probs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tidy(mk.implied_probabilities(runners(spark, sf_dir)).select("market_id", F.col("pos").cast("long").alias("pos"), "implied"))


EXCHANGE = [
    *RUNNERS,
    "bets AS (SELECT market_id, pos, 0 AS k, 'BACK' AS side, back AS odds, q * (back - 1) * 0.95 - (1 - q) AS ev, (back - 1) * 0.95 AS b FROM runners WHERE status = 'ACTIVE' AND back > 1 AND back_size >= 20 UNION ALL SELECT market_id, pos, 1, 'LAY', lay, (1 - q) * (0.95 / (lay - 1)) - q, 0.95 / (lay - 1) FROM runners WHERE status = 'ACTIVE' AND lay > 1 AND lay_size >= 20)",
    "bestbet AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY market_id ORDER BY ev DESC, pos, k) AS n FROM bets) WHERE n = 1)",
    "exdec AS (SELECT m.market_id, CASE WHEN ev >= 0.05 THEN pos END AS selection_id, CASE WHEN ev >= 0.05 THEN side END AS side, CASE WHEN ev >= 0.05 THEN odds END AS odds, coalesce(ev, 0) AS ev, CASE WHEN ev >= 0.05 THEN least(0.25 * ev / b, 0.02) * 10000 ELSE 0 END AS want FROM (SELECT DISTINCT market_id FROM runners) m LEFT JOIN bestbet USING (market_id))",
]


@query(with_(EXCHANGE, f"SELECT market_id, selection_id, side, {rounded(['odds', 'ev', 'want'])} FROM exdec"))
def back_lay_decide(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tidy(mk.decide_exchange(runners(spark, sf_dir)).withColumn("selection_id", F.col("selection_id").cast("long")))


@query(with_([*EXCHANGE, "pl AS (SELECT *, CASE side WHEN 'BACK' THEN want ELSE want / (odds - 1) END AS stake, selection_id = market_id % 5 AS won FROM exdec WHERE side IS NOT NULL)"],
    "SELECT market_id, side, round(CASE side WHEN 'BACK' THEN CASE WHEN won THEN stake * (odds - 1) * 0.95 ELSE -stake END ELSE CASE WHEN won THEN -stake * (odds - 1) ELSE stake * 0.95 END END, 6) + 0.0 AS pnl FROM pl"))
def settle_exchange(spark: SparkSession, sf_dir: str) -> DataFrame:
    bets = mk.decide_exchange(runners(spark, sf_dir)).where("side is not null")
    stake = F.when(F.col("side") == "BACK", F.col("want")).otherwise(F.col("want") / (F.col("odds") - 1))
    return tidy(bets.select("market_id", "side", mk.settle_pnl(F.col("side"), F.col("odds"), stake, F.col("selection_id") == F.col("market_id") % 5).alias("pnl")))


@query(with_([*RUNNERS, "sc AS (SELECT market_id, CASE WHEN status = 'ACTIVE' THEN q END AS model, 1 / ltp AS market, (pos = market_id % 5)::INT AS won FROM runners)", "per_market AS (SELECT market_id, sum((coalesce(model, 0) - won) ** 2) AS bm, sum((market - won) ** 2) AS bk, -ln(greatest(sum(coalesce(model, 0) * won), 1e-6)) AS lm, -ln(greatest(sum(market * won), 1e-6)) AS lk FROM sc GROUP BY 1)"],
    "SELECT count(*) AS settled, round(avg(bm), 6) AS brier_model, round(avg(bk), 6) AS brier_market, round(avg(lm), 6) AS logscore_model, round(avg(lk), 6) AS logscore_market FROM per_market"))
def scorecard_multi(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = runners(spark, sf_dir).select("market_id", F.when(F.col("status") == "ACTIVE", F.col("q")).alias("model"), (1 / F.col("ltp")).alias("market"), (F.col("pos") == F.col("market_id") % 5).cast("int").alias("won"))
    return tidy(mk.score_runners(rows))


@query(with_([*RUNNERS, f"ex AS (SELECT 1 / ltp AS price, (pos = market_id % 5)::INT::DOUBLE AS won, CASE WHEN pos = market_id % 5 THEN (ltp - 1) * 0.95 ELSE -1.0 END AS ret FROM runners)"], f"SELECT {BUCKET} AS bucket, {CALIBRATION.format(n='runners')} FROM ex GROUP BY 1"))
def exchange_calibration(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tidy(mk.exchange_calibration(runners(spark, sf_dir).select(F.col("ltp").alias("odds"), (F.col("pos") == F.col("market_id") % 5).cast("int").alias("won"))))


@query(with_(BASE, f"SELECT market_id FROM markets WHERE date_diff('microsecond', {NOW}, \"end\") / 1e6 / 86400 BETWEEN 1 AND 60 AND volume >= 10000 AND NOT regexp_matches(lower(question), '\\bup or down\\b|\\bvs\\.?\\b|\\bo/u\\b|\\bspread\\b')"))
def eligible_markets(spark: SparkSession, sf_dir: str) -> DataFrame:
    flags = {"active": F.lit(True), "closed": F.lit(False), "is_binary": F.lit(True)}
    return mk.eligible(markets(spark, sf_dir).withColumns(flags), F.expr(NOW)).select("market_id")


@query(with_(BASE, "SELECT market_id, volume FROM (SELECT market_id, volume FROM markets WHERE market_id % 3 <> 0 ORDER BY abs(log10(greatest(volume, 1)) - 5), market_id LIMIT 15)"))
def scan_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The run's fifteen markets: none already open, of volume near 100,000."""
    m = markets(spark, sf_dir)
    return mk.picked(m, m.where("market_id % 3 = 0").select("market_id")).select("market_id", "volume")


@query("SELECT (props->>'$.k')::BIGINT AS k, count(*) AS n, round(avg(value), 6) AS mean_value, count(DISTINCT user_id) AS users FROM events GROUP BY 1")
def json_props(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.from_json("props", "k long")["k"]
    return tidy(events(spark, sf_dir).groupBy(k.alias("k")).agg(F.count(F.lit(1)).alias("n"), F.avg("value").alias("mean_value"), F.countDistinct("user_id").alias("users")))


@query("SELECT e.event_id, e.user_id FROM events e WHERE NOT EXISTS (SELECT 1 FROM events s WHERE s.user_id = e.user_id AND s.event_type = 'signup' AND s.event_id < 100)")
def incremental_antijoin(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What is new: events of markets that an earlier batch has not seen."""
    e = events(spark, sf_dir)
    return e.join(e.where("event_type = 'signup' and event_id < 100").select("user_id"), "user_id", "left_anti").select("event_id", "user_id")


def stream_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as an exchange's stream messages: a price a line, and a last line that closes the market."""
    t = ticks(spark, sf_dir).where("price > 0").withColumn("runner_id", F.length("event_type").cast("long"))
    pos = F.row_number().over(Window.partitionBy("market_id").orderBy("ts", "event_id"))
    price = F.to_json(F.struct(F.lit("mcm").alias("op"), F.unix_millis(F.col("ts").cast("timestamp")).alias("pt"), F.array(F.struct(F.array(F.struct(F.col("runner_id").alias("id"), (1 / F.col("price")).alias("ltp"))).alias("rc"))).alias("mc")))
    prices = t.select("market_id", pos.alias("pos"), price.alias("value"))
    won = F.when(F.col("market_id") % 2 == 0, F.lit("4")).otherwise(F.lit("5"))
    one = lambda i: F.struct(F.lit(i).cast("long").alias("id"), F.lit(f"r{i}").alias("name"), F.when(F.lit(str(i)) == won, "WINNER").otherwise("LOSER").alias("status"))
    definition = F.struct(F.lit("CLOSED").alias("status"), F.date_format("end", "yyyy-MM-dd'T'HH:mm:ss.SSS'Z'").alias("marketTime"), F.array(one(4), one(5), one(6)).alias("runners"))
    last = ticks(spark, sf_dir).groupBy("market_id").agg(F.max("ts").alias("end"), (F.count(F.lit(1)) + 1).cast("int").alias("pos"))
    closing = last.select("market_id", "pos", F.to_json(F.struct(F.lit("mcm").alias("op"), F.unix_millis(F.col("end").cast("timestamp")).alias("pt"), F.array(F.struct(definition.alias("marketDefinition"))).alias("mc"))).alias("value"))
    return prices.unionByName(closing)


@query(with_([*BASE,
    "lt AS (SELECT market_id, length(event_type) AS rid, epoch_ms(ts) AS pt, 1 / price AS ltp, row_number() OVER (PARTITION BY market_id ORDER BY ts, event_id) AS pos FROM ticks WHERE price > 0)",
    f"lc AS (SELECT market_id, epoch_ms(\"end\") - d::BIGINT * 86400000 AS cut, d AS days_before FROM markets, (SELECT unnest({list(DAYS)}) AS d))",
    "la AS (SELECT market_id, days_before, rid, arg_max(ltp, pos) AS odds FROM lt JOIN lc USING (market_id) WHERE pt <= cut AND rid IN (4, 5, 6) GROUP BY 1, 2, 3)"],
    "SELECT market_id, days_before, 'r' || rid AS runner, (rid = CASE WHEN market_id % 2 = 0 THEN 4 ELSE 5 END)::INT AS won, round(odds, 6) AS odds FROM la WHERE odds > 1"))
def stream_replay(spark: SparkSession, sf_dir: str) -> DataFrame:
    final, prices = mk.replay(stream_lines(spark, sf_dir))
    return tidy(mk.stream_snapshots(final, prices).select("market_id", "days_before", "runner", "won", "odds"))


@query(with_(BASE, "SELECT user_id, event_id, (ts::DATE + CASE WHEN (ts AT TIME ZONE 'UTC' AT TIME ZONE 'America/New_York')::TIME > TIME '16:00:00' THEN 1 ELSE 0 END + CASE WHEN (ts AT TIME ZONE 'UTC' AT TIME ZONE 'America/New_York')::DATE < ts::DATE THEN -1 ELSE 0 END)::DATE AS usable FROM events"))
def news_availability(spark: SparkSession, sf_dir: str) -> DataFrame:
    return events(spark, sf_dir).select("user_id", "event_id", mk.news_date(F.col("ts"), F.lit(False)).alias("usable"))

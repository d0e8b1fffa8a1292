"""Prediction markets and betting exchanges: parsing, prices as of a time, calibration, stakes, ledgers."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Edges of the price buckets: closed on the right, the lowest included. Fixed values.
EDGES = (0.0, 0.05, 0.10, 0.20, 0.35, 0.50, 0.65, 0.80, 0.90, 0.95, 1.0)
DAY_S = 86_400


@dataclass(frozen=True)
class MarketConfig:
    """Every tunable number, by what uses it; defaults are fixed values, which results depend on."""

    fee_rates: dict = field(default_factory=lambda: {"politics": 0.04, "sports": 0.05, "crypto": 0.07, "geopolitics": 0.0})
    default_fee_rate: float = 0.05
    min_volume: float = 10_000
    min_days: float = 1.0
    max_days: float = 60.0
    skip_patterns: tuple = (r"\bup or down\b", r"\bvs\.?\b", r"\bo/u\b", r"\bspread\b")
    per_run: int = 15
    bankroll: float = 10_000.0
    min_edge: float = 0.05
    kelly_fraction: float = 0.25
    max_stake_share: float = 0.02
    max_open_share: float = 0.30
    commission: float = 0.05
    min_liquidity: float = 20.0
    max_runners: int = 20
    max_exchange_days: float = 120
    min_matched: float = 5_000
    snapshot_days: tuple = (1, 7, 30)


MARKETS = MarketConfig()


# --- parsing ----------------------------------------------------------------

RAW_MARKET = (
    "id string, question string, description string, category string, endDate string, endDateIso string, closed boolean, active boolean, negRisk boolean, outcomes string, outcomePrices string, "
    "clobTokenIds string, volumeNum string, volume string, liquidityNum string, liquidity string, bestBid string, bestAsk string, events array<struct<tags:array<struct<label:string,slug:string>>>>"
)


def number(x: Column, default: float | None = 0.0) -> Column:
    """A lenient number: the default where the text is none."""
    return F.coalesce(x.try_cast("double"), F.lit(default).cast("double"))


def strings(x: Column) -> Column:
    """A list of strings, given as JSON text or as a JSON list; empty if it is neither."""
    return F.coalesce(F.from_json(x, "array<string>"), F.array().cast("array<string>"))


def parse_markets(lines: DataFrame, column: str = "value") -> DataFrame:
    """One market a row of JSON text: typed fields, the index of the yes outcome, the yes price and a tri-state outcome."""
    m = lines.select(F.from_json(column, RAW_MARKET).alias("m")).select("m.*")
    labels = F.flatten(F.transform(F.coalesce("events", F.array().cast("array<struct<tags:array<struct<label:string,slug:string>>>>")), lambda ev: F.coalesce(ev["tags"], F.array().cast("array<struct<label:string,slug:string>>"))))
    named = F.filter(F.transform(labels, lambda t: F.lower(F.coalesce(F.nullif(t["label"], F.lit("")), t["slug"]))), lambda x: x.isNotNull() & (x != ""))
    out = m.select(
        "id",
        F.coalesce("question", F.lit("")).alias("question"),
        F.coalesce("description", F.lit("")).alias("rules"),
        F.try_to_timestamp(F.coalesce("endDate", "endDateIso")).alias("end"),
        F.coalesce("closed", F.lit(False)).alias("closed"),
        F.coalesce("active", F.lit(False)).alias("active"),
        F.coalesce("negRisk", F.lit(False)).alias("neg_risk"),
        strings(F.col("outcomes")).alias("outcomes"),
        F.transform(strings(F.col("outcomePrices")), lambda x: F.coalesce(x.try_cast("double"), F.lit(0.0))).alias("prices"),
        strings(F.col("clobTokenIds")).alias("token_ids"),
        number(F.coalesce("volumeNum", "volume")).alias("volume"),
        number(F.coalesce("liquidityNum", "liquidity")).alias("liquidity"),
        F.col("bestBid").try_cast("double").alias("best_bid"),
        F.col("bestAsk").try_cast("double").alias("best_ask"),
        named.alias("tags"),
        F.lower(F.coalesce(F.nullif("category", F.lit("")), F.try_element_at(named, F.lit(1)))).alias("category"),
    )
    place = F.array_position(F.transform("outcomes", F.lower), F.lit("yes"))
    out = out.withColumn("yes_index", F.when(place > 0, place - 1).otherwise(0).cast("int"))
    price = F.when(F.size("prices") == 2, F.try_element_at("prices", F.col("yes_index") + 1))
    out = out.withColumn("yes_price", price)
    return out.withColumns(
        {"is_binary": (F.size("outcomes") == 2) & (F.size("token_ids") == 2), "resolved_yes": F.when(F.col("closed") & (F.col("yes_price") >= 0.99), True).when(F.col("closed") & (F.col("yes_price") <= 0.01), False)}
    )


def fenced_blocks(text: Column) -> Column:
    return F.regexp_extract_all(text, F.lit(r"(?s)```json\s*(\{.*?\})\s*```"), F.lit(1))


def parse_forecast(text: Column) -> Column:
    """The probability of the last usable JSON object of an answer, kept within 0.01 and 0.99; NULL if there is none."""
    bare = F.regexp_extract_all(text, F.lit(r"(?s)(\{[^{}]*\"probability\"[^{}]*\})"), F.lit(1))
    found = F.when(F.size(fenced_blocks(text)) > 0, fenced_blocks(text)).otherwise(bare)
    given = F.transform(found, lambda j: F.from_json(j, "probability double")["probability"])
    usable = F.filter(given, lambda p: p.isNotNull() & (p > 0) & (p < 1))
    last = F.try_element_at(usable, F.lit(-1))
    return F.when(last.isNotNull(), F.greatest(F.lit(0.01), F.least(F.lit(0.99), last)))


def parse_runner_forecast(text: Column, names: Column) -> Column:
    """Probabilities by listed name from the last usable block: matched without case, at least 0.005, summing to 1.

    A block that names fewer than half of the runners is no use; NULL if none is.
    """
    blocks = F.regexp_extract_all(text, F.lit(r"(?s)```json\s*(\{.*?\}\s*\}|\{.*?\})\s*```"), F.lit(1))

    def weights(block: Column) -> Column:
        given = F.map_from_entries(F.transform(F.map_entries(F.coalesce(F.from_json(block, "probabilities map<string,double>")["probabilities"], F.create_map().cast("map<string,double>"))), lambda kv: F.struct(F.lower(F.trim(kv["key"])), kv["value"])))
        return F.transform(names, lambda n: F.struct(n.alias("name"), F.greatest(F.coalesce(F.try_element_at(given, F.lower(F.trim(n))), F.lit(0.0)), F.lit(0.005)).alias("p"), F.map_contains_key(given, F.lower(F.trim(n))).alias("named")))

    candidates = F.filter(F.transform(blocks, weights), lambda ws: F.size(F.filter(ws, lambda w: w["named"])) >= F.size(names) / 2)
    chosen = F.try_element_at(candidates, F.lit(-1))
    total = F.aggregate(chosen, F.lit(0.0), lambda s, w: s + w["p"])
    return F.map_from_entries(F.transform(chosen, lambda w: F.struct(w["name"], w["p"] / total)))


def prompt(question: Column, rules: Column, end: Column, now: Column, outcomes: Column | None = None) -> Column:
    """The question as it is put to a forecaster: the date, the question, its possible outcomes if given, when it is settled and by which rules; never a price."""
    stamp = "d MMMM yyyy, HH:mm"
    lines = [
        F.format_string("It is now %s (UTC).", F.date_format(now, stamp)),
        F.format_string("To be forecast: %s", question),
        F.when(F.size(outcomes) > 0, F.format_string("It will end as one of: %s.", F.array_join(outcomes, "; "))) if outcomes is not None else F.lit(None).cast("string"),
        F.format_string("It is decided on %s.", F.coalesce(F.date_format(end, stamp), F.lit("a date not known"))),
        F.when(F.trim(rules) != "", F.concat(F.lit("It is decided by these rules:\n"), F.trim(rules))).otherwise("No rules are given beyond the question."),
    ]
    return F.concat_ws("\n", *lines)


# --- eligibility ------------------------------------------------------------


def days_until(end: Column, now: Column) -> Column:
    return (F.unix_micros(end.cast("timestamp")) - F.unix_micros(now.cast("timestamp"))) / 1e6 / DAY_S


def eligible(markets: DataFrame, now: Column, cfg: MarketConfig = MARKETS) -> DataFrame:
    """Open binary markets of enough volume that end in time and whose question matches no skipped pattern."""
    days = days_until(F.col("end"), now)
    skip = "|".join(f"(?:{p})" for p in cfg.skip_patterns)
    return markets.where(F.col("active") & ~F.col("closed") & F.col("is_binary") & days.between(cfg.min_days, cfg.max_days) & (F.col("volume") >= cfg.min_volume) & ~F.lower("question").rlike(skip))


def picked(markets: DataFrame, taken: DataFrame, cfg: MarketConfig = MARKETS) -> DataFrame:
    """The run's markets: none already open, those of volume near 100,000 first."""
    order = F.abs(F.log10(F.greatest(F.col("volume"), F.lit(1.0))) - 5)
    return markets.join(taken, "market_id", "left_anti").orderBy(order, "market_id").limit(cfg.per_run)


# --- prices as of a time ----------------------------------------------------


def snapshots(ticks: DataFrame, markets: DataFrame, days: tuple[int, ...] = MARKETS.snapshot_days) -> DataFrame:
    """The last price at or before ``days`` before each market's end, strictly between 0 and 1.

    ``ticks`` is ``market_id, ts, price``; ``markets`` has ``market_id, end`` and more columns to keep. Of prices at
    one time the greatest counts. One pass aggregates all horizons.
    """
    held = ticks.join(markets.select("market_id", "end"), "market_id")
    asof = [F.max(F.when(F.col("ts") <= F.col("end") - F.expr(f"INTERVAL {d} DAYS"), F.struct("ts", "price")))["price"].alias(f"d{d}") for d in days]
    wide = held.groupBy("market_id").agg(*asof)
    stack = F.expr("stack({}, {}) AS (days_before, yes_price)".format(len(days), ", ".join(f"{d}, d{d}" for d in days)))
    rows = wide.select("market_id", stack).where((F.col("yes_price") > 0) & (F.col("yes_price") < 1))
    return rows.join(markets, "market_id")


STREAM_LINE = "op string, pt long, mc array<struct<id:string,marketDefinition:struct<status:string,marketTime:string,suspendTime:string,eventTypeId:string,name:string,eventName:string,runners:array<struct<id:long,name:string,status:string>>>,rc:array<struct<id:long,ltp:double>>>>"


def replay(lines: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Stream files as lines (``market_id, pos, value``): each market's last definition, and its last traded prices in order."""
    messages = lines.select("market_id", "pos", F.from_json("value", STREAM_LINE).alias("m")).select("market_id", "pos", "m.pt", F.posexplode("m.mc").alias("k", "mc"))
    place = F.struct("pos", "k")
    final = messages.where("mc.marketDefinition is not null").groupBy("market_id").agg(F.max_by("mc.marketDefinition", place).alias("definition"))
    prices = messages.select("market_id", "pos", "k", "pt", F.posexplode("mc.rc").alias("j", "rc")).where("rc.ltp is not null").select("market_id", "pos", "k", "j", "pt", F.col("rc.id").alias("runner_id"), F.col("rc.ltp").alias("ltp"))
    return final, prices


def read_stream_files(spark, folder: str) -> DataFrame:
    """Lines of all stream files below a folder, those that end in .bz2 or start with ``1.``, with their market and place.

    A line's place is the file's block and the line's number in the rows that Spark reads of it, in order; no file is held whole.
    """
    lines = spark.read.option("recursiveFileLookup", "true").text(folder).select("value", F.col("_metadata.file_name").alias("file"), (F.col("_metadata.file_block_start")).alias("block"), F.monotonically_increasing_id().alias("row"))
    wanted = lines.where((F.col("file").endswith(".bz2") | F.col("file").startswith("1.")) & (F.trim("value") != ""))
    return wanted.select(F.regexp_replace("file", r"\.bz2.*$", "").alias("market_id"), F.struct("block", "row").alias("pos"), "value")


def stream_snapshots(final: DataFrame, prices: DataFrame, days: tuple[int, ...] = MARKETS.snapshot_days) -> DataFrame:
    """One row a runner and horizon of closed markets with a winner: the last price in file order not after the cut."""
    d = F.col("definition")
    closed = final.where((d["status"] == "CLOSED") & F.exists(d["runners"], lambda r: r["status"] == "WINNER")).withColumn("end", F.coalesce(F.try_to_timestamp(d["marketTime"]), F.try_to_timestamp(d["suspendTime"]))).where("end is not null")
    runners = closed.select("market_id", "end", F.coalesce(d["eventName"], F.lit("")).alias("event"), F.coalesce(d["name"], F.lit("")).alias("market"), d["eventTypeId"].alias("event_type"), F.explode(d["runners"]).alias("r")).where(F.col("r.status").isin("WINNER", "LOSER"))
    known = runners.select("market_id", "end", "event", "market", "event_type", F.col("r.id").alias("runner_id"), F.coalesce("r.name", F.col("r.id").cast("string")).alias("runner"), (F.col("r.status") == "WINNER").cast("int").alias("won"))
    cuts = known.select("*", F.explode(F.array(*[F.lit(x) for x in days])).alias("days_before"))
    past = cuts.join(prices, ["market_id", "runner_id"]).where(F.col("pt") <= F.unix_millis("end") - F.col("days_before").cast("long") * DAY_S * 1000)
    keys = ["market_id", "event", "market", "event_type", "runner", "end", "days_before", "won", "runner_id"]
    return past.groupBy(*keys).agg(F.max_by("ltp", F.struct("pos", "k", "j")).alias("odds")).where("odds > 1").drop("runner_id")


def news_date(ts: Column, date_only: Column) -> Column:
    """The New York date from which news may be used: its own up to 16:00, else the next; a bare date counts as after the close."""
    local = F.from_utc_timestamp(ts, "America/New_York")
    # To the microsecond: a fraction of a second past the close is past it.
    late = date_only | (F.date_format(local, "HH:mm:ss.SSSSSS") > "16:00:00.000000")
    return F.when(late, F.date_add(F.to_date(local), 1)).otherwise(F.to_date(local))


# --- calibration ------------------------------------------------------------


def bucket(price: Column) -> Column:
    """The upper edge of a price's bucket; NULL outside 0..1."""
    out = F.lit(None).cast("double")
    for edge in reversed(EDGES[1:]):
        out = F.when(price <= edge, edge).otherwise(out)
    return F.when(price >= EDGES[0], out)


def fee_per_share(price: Column, category: Column, cfg: MarketConfig = MARKETS) -> Column:
    rates = F.create_map(*[F.lit(x) for kv in cfg.fee_rates.items() for x in kv])
    rate = F.coalesce(F.try_element_at(rates, F.lower(F.coalesce(category, F.lit("")))), F.lit(cfg.default_fee_rate))
    return rate * price * (1 - price)


def contracts(snaps: DataFrame, cfg: MarketConfig = MARKETS) -> DataFrame:
    """Two contracts a snapshot, yes and no: price, won, fee and return per unit of money."""
    both = F.explode(F.array(F.struct(F.lit("YES").alias("side"), F.col("yes_price").alias("price"), F.col("yes_won").cast("double").alias("won")), F.struct(F.lit("NO").alias("side"), (1 - F.col("yes_price")).alias("price"), (1 - F.col("yes_won")).cast("double").alias("won"))))
    out = snaps.withColumn("x", both).select("*", "x.*").drop("x")
    out = out.withColumn("fee", fee_per_share(F.col("price"), F.col("category"), cfg))
    return out.withColumns({"ret": F.col("won") / (F.col("price") + F.col("fee")) - 1, "bucket": bucket(F.col("price"))})


def calibration(rows: DataFrame, *by: str, count: str = "contracts") -> DataFrame:
    """Per bucket: how many, mean price, win rate, mean return with its standard error, and the gap; empty buckets are absent."""
    out = rows.groupBy(*by, "bucket").agg(F.count(F.lit(1)).alias(count), F.avg("price").alias("avg_price"), F.avg("won").alias("win_rate"), F.avg("ret").alias("mean_return"), (F.stddev_samp("ret") / F.sqrt(F.count(F.lit(1)))).alias("se"))
    return out.withColumn("gap", F.col("win_rate") - F.col("avg_price"))


def exchange_calibration(rows: DataFrame, cfg: MarketConfig = MARKETS) -> DataFrame:
    """The same for runners backed at their odds, after commission."""
    priced = rows.withColumns({"price": F.try_divide(F.lit(1.0), F.col("odds")), "won": F.col("won").cast("double"), "ret": F.when(F.col("won") == 1, (F.col("odds") - 1) * (1 - cfg.commission)).otherwise(-1.0)})
    return calibration(priced.withColumn("bucket", bucket(F.col("price"))), count="runners")


def end_at(rows: DataFrame, place: int) -> object:
    """The ``end`` at a place (from 0) in order of end: sorted ranges tell which of them holds it, and only that one is numbered."""
    ends = rows.groupBy("end").agg(F.count(F.lit(1)).alias("n"))
    ranged = ends.repartitionByRange(F.col("end")).withColumn("part", F.spark_partition_id()).persist()
    try:
        for row in sorted(ranged.groupBy("part").agg(F.sum("n").alias("n")).collect()):
            if place < row["n"]:
                upto = F.sum("n").over(Window.orderBy("end").rowsBetween(Window.unboundedPreceding, 0))
                return ranged.where(F.col("part") == row["part"]).withColumn("upto", upto).where(F.col("upto") > place).agg(F.min("end")).first()[0]
            place -= row["n"]
        return None
    finally:
        ranged.unpersist()


def strategy_test(snaps: DataFrame, low: float, high: float, days_before: int, share: float = 0.5, cfg: MarketConfig = MARKETS) -> DataFrame:
    """Buying every contract priced in [low, high]: bets and returns of markets that end before the cut and of the others.

    The cut is the end of the market at place ``int(n * share)`` in order of end. Without rows there are no halves.
    """
    rows = snaps.where(F.col("days_before") == days_before)
    cut = end_at(rows, int(rows.count() * share))
    halves = rows.withColumn("half", F.when(F.col("end") < F.lit(cut), "first half").otherwise("second half"))
    took = contracts(halves, cfg).where(F.col("price").between(low, high))
    return took.groupBy("half").agg(F.count(F.lit(1)).alias("bets"), F.avg("won").alias("win_rate"), F.avg("ret").alias("mean_return"), F.when(F.count(F.lit(1)) > 1, F.stddev_samp("ret") / F.sqrt(F.count(F.lit(1)))).alias("se"), (F.avg("ret") / days_before).alias("return_per_day"))


# --- stakes -----------------------------------------------------------------


def decide(quotes: DataFrame, cfg: MarketConfig = MARKETS) -> DataFrame:
    """The better of buying yes at the ask and no at one less the bid: ``side, price, cost, edge, want``.

    ``quotes`` has ``q, bid, ask, category``. ``want`` is the stake before the cap on all open stakes: a share of Kelly,
    at most a share of the bankroll; 0 without a valid quote or with too little edge. Of equal edges yes wins.
    """
    ask, bid, q = F.col("ask"), F.col("bid"), F.col("q")
    good = F.coalesce((ask > 0) & (ask <= 1) & (bid >= 0) & (bid < 1) & (bid <= ask), F.lit(False))

    def option(side: str, chance: Column, price: Column) -> Column:
        cost = price + fee_per_share(price, F.col("category"), cfg)
        return F.struct((chance - cost).alias("edge"), F.lit(side).alias("side"), price.alias("price"), cost.alias("cost"))

    best = quotes.withColumn("best", F.when(good, F.array_max(F.array(option("YES", q, ask), option("NO", 1 - q, 1 - bid)))))
    takes = F.coalesce(F.col("best.edge") >= cfg.min_edge, F.lit(False))
    kelly = F.try_divide(F.col("best.edge"), 1 - F.col("best.cost"))
    want = F.when(takes, F.least(cfg.kelly_fraction * kelly, F.lit(cfg.max_stake_share)) * cfg.bankroll).otherwise(0.0)
    return best.select(*quotes.columns, F.when(takes, F.col("best.side")).alias("side"), F.when(takes, F.col("best.price")).alias("price"), F.when(takes, F.col("best.cost")).alias("cost"), F.coalesce("best.edge", F.lit(0.0)).alias("edge"), want.alias("want"))


def capped(wants: DataFrame, order: list[str], open_stake: float = 0.0, cfg: MarketConfig = MARKETS, want: str = "want", stake: str = "stake") -> DataFrame:
    """``stake``: wants granted in order until all open stakes reach their cap.

    As no want is negative, what is open after i wants is max(E0, min(cap, E0 + their sum)); a stake is the difference. Sums
    run within ranges of the order, on top of the ranges before, so no task sees all rows.
    """
    cap, part, before_ = cfg.max_open_share * cfg.bankroll, "range_part", "range_before"
    ranged = wants.repartitionByRange(*[F.col(c) for c in order]).withColumn(part, F.spark_partition_id()).persist()
    sums, at = [], 0.0
    for row in sorted(ranged.groupBy(part).agg(F.sum(want).alias("n")).collect()):
        sums.append((row[part], at))
        at += row["n"] or 0.0
    # One row a range.
    placed = ranged.join(F.broadcast(wants.sparkSession.createDataFrame(sums, f"{part} int, {before_} double")), part)
    upto = F.sum(want).over(Window.partitionBy(part).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)) + F.col(before_)
    open_ = lambda x: F.greatest(F.lit(float(open_stake)), F.least(F.lit(cap), open_stake + x))
    return placed.withColumn(stake, open_(upto) - open_(upto - F.col(want))).drop(part, before_)


def implied_probabilities(runners: DataFrame) -> DataFrame:
    """``implied`` of active runners: the mean of 1/back and 1/lay, else 1/last price, summing to 1 within the market."""
    raw = F.when(F.col("status") == "ACTIVE", F.when((F.col("back") != 0) & (F.col("lay") != 0), (1 / F.nullif("back", F.lit(0.0)) + 1 / F.nullif("lay", F.lit(0.0))) / 2).when(F.col("ltp") != 0, 1 / F.nullif("ltp", F.lit(0.0))))
    own = runners.withColumn("raw", raw)
    return own.withColumn("implied", F.col("raw") / F.sum("raw").over(Window.partitionBy("market_id"))).drop("raw")


def decide_exchange(runners: DataFrame, cfg: MarketConfig = MARKETS) -> DataFrame:
    """Each market's best back or lay: ``market_id, selection_id, side, odds, ev, want`` (money at risk before the cap).

    ``runners`` has ``market_id, pos, selection_id, status, q, back, back_size, lay, lay_size``. The first runner wins
    ties, and its back before its lay; a market without enough value has its best ``ev`` and no side.
    """

    def bet(side: str, chance: Column, odds: str, size: str, gain: Column, place: int) -> Column:
        ev = chance * gain - (1 - chance)
        ok = (F.col("status") == "ACTIVE") & F.col("q").isNotNull() & (F.col(odds) > 1) & (F.col(size) >= cfg.min_liquidity)
        return F.when(ok, F.struct(ev.alias("ev"), (-F.col("pos") * 2 - place).alias("first"), F.lit(side).alias("side"), F.col("selection_id"), F.col(odds).alias("odds"), (ev / gain).alias("kelly")))

    back = bet("BACK", F.col("q"), "back", "back_size", (F.col("back") - 1) * (1 - cfg.commission), 0)
    lay = bet("LAY", 1 - F.col("q"), "lay", "lay_size", F.try_divide(F.lit(1 - cfg.commission), F.col("lay") - 1), 1)
    best = runners.groupBy("market_id").agg(F.max(F.greatest(back, lay)).alias("b"))
    takes = F.coalesce(F.col("b.ev") >= cfg.min_edge, F.lit(False))
    pick = lambda c: F.when(takes, F.col(f"b.{c}")).alias(c)
    want = F.when(takes, F.least(cfg.kelly_fraction * F.col("b.kelly"), F.lit(cfg.max_stake_share)) * cfg.bankroll).otherwise(0.0)
    return best.select("market_id", pick("selection_id"), pick("side"), pick("odds"), F.coalesce("b.ev", F.lit(0.0)).alias("ev"), want.alias("want"))


def settle_pnl(side: Column, odds: Column, stake: Column, won: Column, commission: float = MARKETS.commission) -> Column:
    """Profit of a back or lay once the runner's result is known."""
    back = F.when(won, stake * (odds - 1) * (1 - commission)).otherwise(-stake)
    lay = F.when(won, -stake * (odds - 1)).otherwise(stake * (1 - commission))
    return F.when(side == "BACK", back).otherwise(lay)


# --- ledgers ----------------------------------------------------------------


def settle_binary(ledger: DataFrame, markets: DataFrame, now: Column) -> DataFrame:
    """Open rows take their market's outcome: settled with a profit, or void where it closed without a clear one.

    ``markets`` is ``market_id, closed, resolved_yes``. Rows without a bet settle at 0; other rows stay as they are.
    """
    names = ledger.columns
    m = markets.select("market_id", F.col("closed").alias("market_closed"), F.col("resolved_yes").alias("market_yes"))
    both = ledger.join(m, "market_id", "left")
    open_ = F.col("status") == "open"
    settles, voids = open_ & F.col("market_yes").isNotNull(), open_ & F.col("market_yes").isNull() & F.coalesce("market_closed", F.lit(False))
    won = (F.col("side") == "YES") == F.col("market_yes")
    profit = F.when(F.col("side").isNotNull(), F.col("shares") * won.cast("double") - F.col("stake")).otherwise(0.0)
    out = both.withColumns(
        {
            "yes_won": F.when(settles, F.col("market_yes").cast("int")).otherwise(F.col("yes_won")),
            "pnl": F.when(settles, profit).when(voids, 0.0).otherwise(F.col("pnl")),
            "settled_at": F.when(settles | voids, now).otherwise(F.col("settled_at")),
            "status": F.when(settles, "settled").when(voids, "void").otherwise(F.col("status")),
        }
    )
    return out.select(*names)


def score_binary(ledger: DataFrame) -> DataFrame:
    """Accuracy of forecasts and of the market on settled rows (``q, mid, yes_won, stake, pnl, status``), and the money."""
    rows = ledger.where((F.col("status") == "settled") & F.col("q").isNotNull() & F.col("mid").isNotNull() & F.col("yes_won").isNotNull())
    y = F.col("yes_won").cast("double")

    def logloss(p: str) -> Column:
        held = F.greatest(F.lit(1e-6), F.least(F.lit(1 - 1e-6), F.col(p)))
        return -F.avg(y * F.ln(held) + (1 - y) * F.ln(1 - held))

    off = lambda p: (F.col(p) - y) * (F.col(p) - y)
    bet = F.col("stake") > 0
    return rows.agg(
        F.count(F.lit(1)).alias("settled"),
        F.avg(off("q")).alias("brier_model"),
        F.avg(off("mid")).alias("brier_market"),
        logloss("q").alias("logloss_model"),
        logloss("mid").alias("logloss_market"),
        F.avg((off("q") < off("mid")).cast("double")).alias("model_beats_market_share"),
        F.count(F.when(bet, 1)).alias("bets"),
        F.coalesce(F.sum(F.when(bet, F.col("stake"))), F.lit(0.0)).alias("staked"),
        F.coalesce(F.sum(F.when(bet, F.col("pnl"))), F.lit(0.0)).alias("pnl"),
        F.try_divide(F.sum(F.when(bet, F.col("pnl"))), F.sum(F.when(bet, F.col("stake")))).alias("roi"),
        F.avg(F.when(bet, (F.col("pnl") > 0).cast("double"))).alias("bet_hit_rate"),
    )


def score_runners(rows: DataFrame) -> DataFrame:
    """Brier and log scores over whole markets from rows of runners (``market_id, model, market, won``)."""
    z = lambda c: F.coalesce(F.col(c), F.lit(0.0))
    w = F.col("won").cast("double")
    per = rows.groupBy("market_id").agg(
        *[F.sum((z(c) - w) * (z(c) - w)).alias(f"b_{c}") for c in ("model", "market")],
        *[(-F.ln(F.greatest(F.sum(z(c) * w), F.lit(1e-6)))).alias(f"l_{c}") for c in ("model", "market")],
    )
    return per.agg(F.count(F.lit(1)).alias("settled"), F.avg("b_model").alias("brier_model"), F.avg("b_market").alias("brier_market"), F.avg("l_model").alias("logscore_model"), F.avg("l_market").alias("logscore_market"))



#: A row of the ledger of binary markets.
LEDGER = "market_id string, q double, mid double, side string, stake double, shares double, status string, yes_won int, pnl double, settled_at timestamp"

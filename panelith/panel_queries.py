"""Queries on evaluation, selection, portfolios and studies, with their DuckDB twins."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from panelith.functions import expr as e
from panelith.functions import signals
from panelith.operators import evaluation as ev
from panelith.operators import models
from panelith.operators import portfolio as pf
from panelith.plans import duck
from panelith.plans.stages import average_rank, evaluate
from panelith.queries import PANEL_SQL, query, rounded, tidy, with_
from panelith.sources import panel as source
from panelith.sources import store

#: The signals that the queries on evaluation run over, and what suits a panel of twenty names.
NAMES = ("ret_5", "vol_21", "dv_shock_21", "clv_5", "dist_high_21", "pv_corr_10")
NODES = {n: signals.CATALOGUE[n].node for n in NAMES}
Q, LEAST, LAGS, COST, THRESHOLD = 0.2, 5, 10, 5.0, 0.5
KEEP = ("date", "t", "ticker", "universe", "target", "o")


def wide(spark: SparkSession, sf_dir: str, names: tuple[str, ...] = NAMES) -> DataFrame:
    return evaluate(source.panel(spark, sf_dir), {n: signals.CATALOGUE[n].node for n in names}, keep=KEEP)


def long_values(spark: SparkSession, sf_dir: str, names: tuple[str, ...] = NAMES) -> DataFrame:
    return ev.long_form(wide(spark, sf_dir, names).drop("o"), list(names))


def stats(spark: SparkSession, sf_dir: str, names: tuple[str, ...] = NAMES) -> DataFrame:
    return ev.daily_stats(long_values(spark, sf_dir, names), Q, LEAST)


def features(spark: SparkSession, sf_dir: str, names: tuple[str, ...] = NAMES) -> DataFrame:
    """Centred ranks of the rows that count, one column a signal."""
    return centred(wide(spark, sf_dir, names), names)


def centred(df: DataFrame, names: tuple[str, ...] = NAMES) -> DataFrame:
    day = Window.partitionBy("date")
    member = lambda n: F.when(F.col("universe"), F.col(n))
    return df.withColumns({n: average_rank(member(n), "date") / F.count(member(n)).over(day) - 0.5 for n in names}).where("universe and target is not null").select("date", "ticker", "target", *names)


def scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The vote of all signals on the dense grid."""
    voted = pf.vote(features(spark, sf_dir), {n: (-1.0 if i % 2 else 1.0) for i, n in enumerate(NAMES)})
    grid = source.panel(spark, sf_dir).select("date", "t", "ticker", "target", "o", "c")
    return grid.join(voted, ["date", "ticker"], "left")


_CTES, _SELECT = duck.program("panel", NODES, keep=KEEP)
RANK = "(rank() OVER (PARTITION BY {by} ORDER BY {x} NULLS LAST) + (count({x}) OVER (PARTITION BY {by}, {x}) - 1) / 2.0)"


def rank_sql(x: str, by: str, share: bool = False) -> str:
    out = f"CASE WHEN {x} IS NOT NULL THEN {RANK.format(x=x, by=by)}" + (f" / count({x}) OVER (PARTITION BY {by})" if share else "") + " END"
    return out


WIDE = [*PANEL_SQL, *_CTES, f"wide AS ({_SELECT})"]
LONG = [*WIDE, "long AS (" + " UNION ALL ".join(f"SELECT date, t, ticker, universe, target, '{n}' AS signal, {n} AS value FROM wide" for n in NAMES) + ")"]
BY = "date, signal"
STATS = [
    *LONG,
    "sy AS (SELECT *, CASE WHEN universe AND value IS NOT NULL AND target IS NOT NULL THEN value END AS s, CASE WHEN universe AND value IS NOT NULL AND target IS NOT NULL THEN target END AS y FROM long)",
    f"ranked AS (SELECT *, {rank_sql('s', BY)} AS rs, {rank_sql('y', BY)} AS ry, {rank_sql('s', BY, True)} AS pct FROM sy)",
    f"sides AS (SELECT *, sum((pct > 1 - {Q})::INT) OVER (PARTITION BY {BY}) AS nl, sum((pct <= {Q})::INT) OVER (PARTITION BY {BY}) AS ns FROM ranked)",
    f"weighted AS (SELECT *, CASE WHEN nl > 0 AND ns > 0 THEN coalesce((pct > 1 - {Q})::INT, 0) / nl - coalesce((pct <= {Q})::INT, 0) / ns ELSE 0.0 END AS weight FROM sides)",
    "traded AS (SELECT *, abs(weight - coalesce(lag(weight) OVER (PARTITION BY signal, ticker ORDER BY t), 0)) AS trade FROM weighted)",
    f"stats AS (SELECT date, signal, CASE WHEN count(s) >= {LEAST} AND var_pop(rs) > 0 AND var_pop(ry) > 0 THEN corr(rs, ry) END AS ic, CASE WHEN count(s) >= {LEAST} THEN sum(weight * coalesce(y, 0)) END AS ls, sum(trade) AS \"to\", count(s) AS n FROM traded GROUP BY date, signal)",
]
FEATURES = [*WIDE, "member AS (SELECT date, ticker, universe, target, " + ", ".join(f"CASE WHEN universe THEN {n} END AS {n}" for n in NAMES) + " FROM wide)",
            "centred AS (SELECT date, ticker, universe, target, " + ", ".join(f"{rank_sql(n, 'date', True)} - 0.5 AS {n}" for n in NAMES) + " FROM member)",
            "features AS (SELECT date, ticker, target, " + ", ".join(NAMES) + " FROM centred WHERE universe AND target IS NOT NULL)"]
_VOTES = [f"{'-' if i % 2 else ''}{n}" for i, n in enumerate(NAMES)]
SCORES = [*FEATURES, f"voted AS (SELECT date, ticker, ({' + '.join(f'coalesce({v}, 0)' for v in _VOTES)}) / nullif({' + '.join(f'({v} IS NOT NULL)::INT' for v in _VOTES)}, 0) AS score FROM features)",
          "scores AS (SELECT p.date, p.t, p.ticker, p.target, p.o, p.c, v.score FROM panel p LEFT JOIN voted v ON v.date = p.date AND v.ticker = p.ticker)"]


def nw_sql(table: str, value: str, by: str, lags: int = LAGS) -> list[str]:
    products = ", ".join(f"e * lag(e, {k}) OVER (PARTITION BY {by} ORDER BY date) AS g{k}" for k in range(1, lags + 1))
    sums = " + ".join(f"{2 * (1 - k / (lags + 1))!r} * coalesce(sum(g{k}), 0) / count(*)" for k in range(1, lags + 1))
    return [
        f"nw_e AS (SELECT {by}, date, {value} AS x, {value} - avg({value}) OVER (PARTITION BY {by}) AS e FROM {table} WHERE {value} IS NOT NULL)",
        f"nw_p AS (SELECT *, {products} FROM nw_e)",
        f"nw_v AS (SELECT {by}, count(*) AS n, avg(x) AS mean, sum(e * e) / count(*) + {sums} AS spread FROM nw_p GROUP BY {by})",
        f"nw AS (SELECT {by}, n, mean, CASE WHEN n >= 30 AND spread > 0 THEN mean / sqrt(spread / n) END AS t FROM nw_v)",
    ]


DAILY_STATS = f"SELECT date, signal, n, {rounded(['ic', 'ls', 'to'])} FROM stats".replace("round(to,", 'round("to",').replace("AS to ", 'AS "to" ')


@query(with_(STATS, DAILY_STATS))
def daily_signal_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tidy(stats(spark, sf_dir))


@query(with_(STATS, f"SELECT date, signal, ticker, {rounded(['weight'])} FROM weighted WHERE weight <> 0"))
def quantile_weights(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = long_values(spark, sf_dir)
    held = df.withColumn("s", F.when(ev.valid(df), F.col("value")))
    return tidy(ev.quantile_weights(held, Q, "date", "signal", score="s").where("weight <> 0").select("date", "signal", "ticker", "weight"))


@query(with_(STATS, "SELECT date, signal, round(sum(trade), 6) + 0.0 AS turnover FROM traded GROUP BY date, signal"))
def turnover(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tidy(stats(spark, sf_dir).select("date", "signal", F.col("to").alias("turnover")))


@query(with_(STATS, "SELECT date, signal, round(ic, 6) + 0.0 AS ic, n FROM stats WHERE n > 0"))
def daily_ic(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tidy(ev.rank_ic(long_values(spark, sf_dir), LEAST))


@query(with_([*STATS,
    "kept AS (SELECT * FROM sy WHERE s IS NOT NULL)",
    f"a AS (SELECT *, row_number() OVER (PARTITION BY {BY} ORDER BY ticker) AS p FROM kept)",
    f"b AS (SELECT date, signal, y AS other, row_number() OVER (PARTITION BY {BY} ORDER BY md5(concat_ws('|', ticker::VARCHAR, date::VARCHAR, '0'))) AS p FROM kept)",
    f"ab AS (SELECT a.date, a.signal, {rank_sql('s', 'a.date, a.signal')} AS rs, {rank_sql('other', 'a.date, a.signal')} AS ry FROM a JOIN b ON a.date = b.date AND a.signal = b.signal AND a.p = b.p)",
    ], f"SELECT date, signal, CASE WHEN count(*) >= {LEAST} AND var_pop(rs) > 0 AND var_pop(ry) > 0 THEN round(corr(rs, ry), 6) + 0.0 END AS ic, count(*) AS n FROM ab GROUP BY date, signal"))
def placebo_ic(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tidy(ev.rank_ic(ev.placebo(long_values(spark, sf_dir)), LEAST))


@query(with_([*STATS, *nw_sql("stats", "ic", "signal")], f"SELECT signal, n, {rounded(['mean', 't'])} FROM nw"))
def newey_west(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tidy(ev.newey_west(stats(spark, sf_dir), "ic", LAGS, "signal"))


@query(with_(STATS, "SELECT signal, CASE WHEN stddev_samp(ls) > 0 THEN round(avg(ls) / stddev_samp(ls) * sqrt(252), 6) END AS sharpe FROM stats GROUP BY signal"))
def sharpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tidy(stats(spark, sf_dir).groupBy("signal").agg(ev.sharpe("ls").alias("sharpe")))


_WEALTH = ["wealth AS (SELECT signal, date, ls, \"to\", exp(sum(ln(1 + coalesce(ls, 0))) OVER (PARTITION BY signal ORDER BY date ROWS UNBOUNDED PRECEDING)) AS w FROM {table})",
           "drawn AS (SELECT *, w / max(w) OVER (PARTITION BY signal ORDER BY date ROWS UNBOUNDED PRECEDING) - 1 AS dd FROM wealth)"]


@query(with_([*STATS, *[x.format(table="stats") for x in _WEALTH]], "SELECT signal, round(min(dd), 6) + 0.0 AS max_drawdown FROM drawn GROUP BY signal"))
def max_drawdown(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tidy(ev.with_drawdown(stats(spark, sf_dir), "ls", "signal").groupBy("signal").agg(F.min("drawdown").alias("max_drawdown")))


_PERF = "round(avg({x}) * 252, 6) + 0.0 AS ann_return, round(stddev_samp({x}) * sqrt(252), 6) AS ann_vol, round(avg({x}) / nullif(stddev_samp({x}), 0) * sqrt(252), 6) + 0.0 AS sharpe, round(min(dd), 6) + 0.0 AS max_drawdown, round(avg(({x} > 0)::INT), 6) AS hit_rate, count(*) AS days"


@query(with_([*STATS, *[x.format(table="(SELECT * FROM stats WHERE ls IS NOT NULL)") for x in _WEALTH]], f"SELECT signal, {_PERF.format(x='ls')}, round(avg(\"to\"), 6) AS turnover FROM drawn GROUP BY signal"))
def perf_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tidy(ev.performance(stats(spark, sf_dir), "ls", "signal", turnover="to"))


SIGNED = ["sg AS (SELECT signal, coalesce(sign(avg(ic)), 0) AS sg FROM stats GROUP BY signal)",
          f"net AS (SELECT s.*, sg, ls * sg AS gross, ls * sg - \"to\" * {COST} / 1e4 AS net FROM stats s JOIN sg USING (signal))"]
SUMMARY = (
    "SELECT signal, round(avg(ic), 6) + 0.0 AS ic_mean, round(avg((sign(round(ic, 12)) = sg)::INT), 6) AS ic_hit, round(avg(gross) * 252, 6) + 0.0 AS ls_ann_gross, round(avg(gross) / stddev_samp(gross) * sqrt(252), 6) + 0.0 AS sharpe_gross, "
    "round(avg(net) / stddev_samp(net) * sqrt(252), 6) + 0.0 AS sharpe_net, round(avg(\"to\"), 6) AS turnover, count(ic) AS days, round(any_value(t), 6) + 0.0 AS ic_t_nw FROM net LEFT JOIN nw USING (signal) GROUP BY signal"
)


@query(with_([*STATS, *nw_sql("stats", "ic", "signal"), *SIGNED], SUMMARY))
def summarize_signal(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tidy(ev.summary(stats(spark, sf_dir), COST, LAGS))


MOST = 0.8
#: The greedy walk: signals beyond the threshold by strength, each kept unless it correlates with one kept before.
CHOSEN = [
    *STATS, *nw_sql("stats", "ic", "signal"),
    *FEATURES[len(WIDE):],
    "tenth AS (SELECT date FROM (SELECT date, row_number() OVER (ORDER BY date) - 1 AS n FROM (SELECT DISTINCT date FROM stats)) WHERE n % 10 = 0)",
    "sampled AS (SELECT f.* FROM features f SEMI JOIN tenth USING (date))",
    "pairs AS (" + " UNION ALL ".join(f"SELECT '{a}' AS a, '{b}' AS b, corr(coalesce({a}, 0), coalesce({b}, 0)) AS r FROM sampled" for a in NAMES for b in NAMES if a != b) + ")",
    f"alike AS (SELECT a AS signal, list(b) FILTER (WHERE r IS NULL OR isnan(r) OR abs(r) >= {MOST}) AS near FROM pairs GROUP BY a)",
    f"strongest AS (SELECT signal, near, row_number() OVER (ORDER BY abs(t) DESC, signal) AS k FROM nw JOIN alike USING (signal) WHERE abs(t) > {THRESHOLD})",
    "walk AS (SELECT 0::BIGINT AS k, []::VARCHAR[] AS kept UNION ALL SELECT s.k, CASE WHEN len(list_intersect(kept, coalesce(near, []))) = 0 THEN list_append(kept, signal) ELSE kept END FROM walk JOIN strongest s ON s.k = walk.k + 1)",
    "chosen AS (SELECT kept FROM walk ORDER BY k DESC LIMIT 1)",
]


SELECTION = "SELECT signal, round(t, 6) + 0.0 AS t, round(ic, 6) + 0.0 AS ic, sign(ic)::DOUBLE AS sign, coalesce(abs(t) > {threshold}, false) AS passed, list_contains((SELECT kept FROM chosen), signal) AS kept FROM (SELECT signal, avg(ic) AS ic FROM stats GROUP BY signal) LEFT JOIN nw USING (signal)"


@query(with_(CHOSEN, SELECTION.format(threshold=THRESHOLD)).replace("WITH", "WITH RECURSIVE", 1))
def signal_selection(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tidy(ev.select(stats(spark, sf_dir), features(spark, sf_dir).select("date", "ticker", *NAMES), THRESHOLD, LAGS, MOST))


@query(with_(CHOSEN, "SELECT signal, round(t, 6) + 0.0 AS t FROM nw WHERE list_contains((SELECT kept FROM chosen), signal)").replace("WITH", "WITH RECURSIVE", 1))
def signal_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tidy(ev.select(stats(spark, sf_dir), features(spark, sf_dir).select("date", "ticker", *NAMES), THRESHOLD, LAGS, MOST).where("kept").select("signal", "t"))


@query(with_(FEATURES, "SELECT 'a' AS x, " + ", ".join(f"round(corr(coalesce({a}, 0), coalesce({b}, 0)), 6) AS {a}__{b}" for i, a in enumerate(NAMES) for b in NAMES[:i]) + " FROM features"))
def correlation_matrix(spark: SparkSession, sf_dir: str) -> DataFrame:
    filled = features(spark, sf_dir).fillna(0.0, subset=list(NAMES))
    return filled.agg(F.lit("a").alias("x"), *[F.round(ev.correlation(a, b), 6).alias(f"{a}__{b}") for i, a in enumerate(NAMES) for b in NAMES[:i]])


@query(with_([*PANEL_SQL, "numbered AS (SELECT date, row_number() OVER (ORDER BY date) AS n FROM (SELECT DISTINCT date FROM panel))", "first AS (SELECT min(n) AS f FROM numbered WHERE year(date) >= 1997)"],
    "SELECT date, CASE WHEN n < f - 5 THEN 'train' ELSE 'test' END AS part FROM numbered, first WHERE n < f - 5 OR year(date) = 1997"))
def embargo_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ev.embargo_split(source.panel(spark, sf_dir).select("date").distinct(), 1997, 5)


@query(with_([*PANEL_SQL, "d AS (SELECT date, row_number() OVER (ORDER BY date) AS n FROM (SELECT DISTINCT date FROM panel))"], "SELECT p.date, count(*) AS rows FROM panel p JOIN d ON d.date = p.date AND (n - 1) % 10 = 0 GROUP BY p.date"))
def stride_sample(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = source.panel(spark, sf_dir).select("date")
    return df.join(ev.every(df.distinct(), 10), "date", "left_semi").groupBy("date").agg(F.count(F.lit(1)).alias("rows"))


@query(with_(FEATURES, f"SELECT date, ticker, {rounded(['target', *NAMES])} FROM features"))
def feature_ranks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tidy(features(spark, sf_dir))


HORIZON = ["ahead AS (SELECT date, ticker, universe, target, lead(o, 6) OVER w / nullif(lead(o, 1) OVER w, 0) - 1 AS raw FROM panel WINDOW w AS (PARTITION BY ticker ORDER BY t))",
           "rows_h AS (SELECT date, ticker, CASE WHEN raw > 0.75 THEN 0.75 WHEN raw < -0.75 THEN -0.75 ELSE raw END AS target_h FROM ahead WHERE universe AND target IS NOT NULL)",
           f"labels_h AS (SELECT date, ticker, target_h, {rank_sql('target_h', 'date', True)} - 0.5 AS y_rank_h FROM rows_h)"]


@query(with_([*PANEL_SQL, *HORIZON], f"SELECT date, ticker, {rounded(['target_h', 'y_rank_h'])} FROM labels_h"))
def horizon_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tidy(ev.horizon_labels(source.panel(spark, sf_dir), 5))


@query(with_([*FEATURES, *HORIZON, "stacked AS (" + " UNION ALL ".join(f"SELECT date, ticker, '{n}' AS signal, {n}::FLOAT AS feature FROM features" for n in NAMES) + ")"],
    f"SELECT date, signal, CASE WHEN count(*) >= {LEAST} AND var_pop(feature::DOUBLE) > 0 AND var_pop(y_rank_h) > 0 THEN round(corr(feature::DOUBLE, y_rank_h), 6) + 0.0 END AS ic, count(*) AS n FROM stacked JOIN labels_h USING (date, ticker) WHERE feature IS NOT NULL AND y_rank_h IS NOT NULL GROUP BY date, signal"))
def horizon_ic(spark: SparkSession, sf_dir: str) -> DataFrame:
    stacked = features(spark, sf_dir).unpivot(["date", "ticker"], list(NAMES), "signal", "feature").withColumn("feature", F.col("feature").cast("float"))
    return tidy(ev.horizon_ic(stacked, ev.horizon_labels(source.panel(spark, sf_dir), 5), LEAST))


@query(with_(SCORES, "SELECT date, ticker, round(score, 6) + 0.0 AS score FROM voted WHERE score IS NOT NULL"))
def simple_vote(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tidy(scores(spark, sf_dir).where("score is not null").select("date", "ticker", "score"))


def smooth_sql(halflife: float) -> list[str]:
    d = 0.5 ** (1 / halflife)
    return [
        "known AS (SELECT *, row_number() OVER (PARTITION BY ticker ORDER BY t) AS k FROM scores WHERE score IS NOT NULL)",
        f"smoothed AS (SELECT a.date, a.ticker, sum(b.score * pow({d!r}, a.k - b.k)) / sum(pow({d!r}, a.k - b.k)) AS score FROM known a JOIN known b ON a.ticker = b.ticker AND b.k <= a.k GROUP BY 1, 2)",
        "smooth_grid AS (SELECT s.date, s.t, s.ticker, s.target, m.score FROM scores s LEFT JOIN smoothed m ON m.date = s.date AND m.ticker = s.ticker)",
    ]


def banded_sql(table: str, enter: float, leave: float) -> list[str]:
    hold = "coalesce(last_value({c} IGNORE NULLS) OVER (PARTITION BY ticker ORDER BY t ROWS UNBOUNDED PRECEDING), 0)"
    return [
        f"shares AS (SELECT *, {rank_sql('score', 'date', True)} AS pct FROM {table})",
        f"marks AS (SELECT *, CASE WHEN pct > 1 - {enter} THEN 1 WHEN pct IS NULL OR NOT pct > 1 - {leave} THEN 0 END AS ml, CASE WHEN pct <= {enter} THEN 1 WHEN pct IS NULL OR NOT pct <= {leave} THEN 0 END AS ms FROM shares)",
        f"held_sides AS (SELECT *, {hold.format(c='ml')} AS hl, {hold.format(c='ms')} AS hs FROM marks)",
        "pweights AS (SELECT *, coalesce(hl / nullif(sum(hl) OVER (PARTITION BY date), 0), 0) - coalesce(hs / nullif(sum(hs) OVER (PARTITION BY date), 0), 0) AS weight FROM held_sides)",
    ]


def daily_sql() -> list[str]:
    return [
        "ptraded AS (SELECT *, greatest(weight, 0) AS lw, abs(weight - coalesce(lag(weight) OVER (PARTITION BY ticker ORDER BY t), 0)) AS tr, abs(greatest(weight, 0) - coalesce(lag(greatest(weight, 0)) OVER (PARTITION BY ticker ORDER BY t), 0)) AS ltr FROM pweights)",
        "daily AS (SELECT date, sum(weight * coalesce(target, 0)) AS ls_gross, sum(tr) AS ls_to, sum(lw * coalesce(target, 0)) AS long_gross, sum(ltr) AS long_to, avg(CASE WHEN score IS NOT NULL THEN target END) AS bench_ew FROM ptraded GROUP BY date)",
    ]


DAILY_COLUMNS = ["ls_gross", "ls_to", "long_gross", "long_to", "bench_ew"]
BANDED = [*SCORES, *smooth_sql(5), *banded_sql("smooth_grid", 0.2, 0.4), *daily_sql()]


@query(with_([*SCORES, *smooth_sql(5)], "SELECT date, ticker, round(score, 6) + 0.0 AS score FROM smoothed"))
def ewm_smooth(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tidy(pf.smoothed(scores(spark, sf_dir), 5).where("score is not null").select("date", "ticker", "score"))


@query(with_([*SCORES, *banded_sql("scores", 0.2, 0.4)], "SELECT date, ticker, round(weight, 6) + 0.0 AS weight FROM pweights WHERE weight <> 0"))
def banded_weights(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tidy(pf.banded_weights(scores(spark, sf_dir), 0.2, 0.4).where("weight <> 0").select("date", "ticker", "weight"))


@query(with_(BANDED, f"SELECT date, {rounded(DAILY_COLUMNS)} FROM daily"))
def portfolio_daily(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tidy(pf.portfolio(scores(spark, sf_dir), 0.2, 5, 0.4))


@query(with_([*BANDED, "costs AS (SELECT unnest([0.0, 2.0, 5.0, 10.0, 20.0])::DOUBLE AS cost_bps)"],
    "SELECT cost_bps, round(avg(ls_gross - ls_to * cost_bps / 1e4) / stddev_samp(ls_gross - ls_to * cost_bps / 1e4) * sqrt(252), 6) + 0.0 AS sharpe, round(avg(long_gross - long_to * cost_bps / 1e4) * 252, 6) + 0.0 AS long_ann FROM daily, costs GROUP BY cost_bps"))
def cost_grid(spark: SparkSession, sf_dir: str) -> DataFrame:
    daily = pf.net_of_costs(pf.portfolio(scores(spark, sf_dir), 0.2, 5, 0.4), [0, 2, 5, 10, 20])
    return tidy(daily.groupBy("cost_bps").agg(ev.sharpe("ls_net").alias("sharpe"), (F.avg("long_net") * 252).alias("long_ann")))


@query(with_(BANDED, f"SELECT year(date)::INT AS year, round(sum(ls_gross - ls_to * {COST} / 1e4), 6) + 0.0 AS ls_net, round(avg(ls_to), 6) AS turnover, round(exp(sum(ln(1 + ls_gross))) - 1, 6) + 0.0 AS compounded FROM daily GROUP BY 1"))
def yearly_returns(spark: SparkSession, sf_dir: str) -> DataFrame:
    daily = pf.portfolio(scores(spark, sf_dir), 0.2, 5, 0.4)
    net = F.col("ls_gross") - F.col("ls_to") * COST / 1e4
    return tidy(daily.groupBy(F.year("date").alias("year")).agg(F.sum(net).alias("ls_net"), F.avg("ls_to").alias("turnover"), (F.product(1 + F.col("ls_gross")) - 1).alias("compounded")))


_SERIES = {"long_short_net": f"ls_gross - ls_to * {COST} / 1e4", "long_short_gross": "ls_gross", "long_only_net": f"long_gross - long_to * {COST} / 1e4", "long_only_excess_vs_ew": f"long_gross - long_to * {COST} / 1e4 - bench_ew", "equal_weight_universe": "bench_ew"}


@query(with_([*BANDED, "series5 AS (" + " UNION ALL ".join(f"SELECT date, CASE WHEN year(date) < 1996 THEN 'before' ELSE 'after' END AS period, '{n}' AS series, {x} AS ls FROM daily" for n, x in _SERIES.items()) + ")",
    "wealth5 AS (SELECT *, product(1 + ls) OVER (PARTITION BY period, series ORDER BY date ROWS UNBOUNDED PRECEDING) AS w FROM series5 WHERE ls IS NOT NULL)",
    "drawn5 AS (SELECT *, w / max(w) OVER (PARTITION BY period, series ORDER BY date ROWS UNBOUNDED PRECEDING) - 1 AS dd FROM wealth5)"], f"SELECT period, series, {_PERF.format(x='ls')} FROM drawn5 GROUP BY period, series"))
def period_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Five series before and from 1996, as performance tables."""
    daily = pf.net_of_costs(pf.portfolio(scores(spark, sf_dir), 0.2, 5, 0.4), [COST])
    series = daily.select(
        "date", F.when(F.year("date") < 1996, "before").otherwise("after").alias("period"), F.col("ls_net").alias("long_short_net"), F.col("ls_gross").alias("long_short_gross"), F.col("long_net").alias("long_only_net"), (F.col("long_net") - F.col("bench_ew")).alias("long_only_excess_vs_ew"), F.col("bench_ew").alias("equal_weight_universe")
    )
    stacked = series.unpivot(["date", "period"], ["long_short_net", "long_short_gross", "long_only_net", "long_only_excess_vs_ew", "equal_weight_universe"], "series", "value")
    return tidy(ev.performance(stacked, "value", "period", "series"))


@query(with_([*STATS], "SELECT signal, round(avg(CASE WHEN year(date) < 1996 THEN ic END), 6) + 0.0 AS ic_before, round(avg(CASE WHEN year(date) >= 1996 THEN ic END), 6) + 0.0 AS ic_after, coalesce(sign(avg(CASE WHEN year(date) < 1996 THEN ic END)) = sign(avg(CASE WHEN year(date) >= 1996 THEN ic END)), false) AS same_sign, round(avg(CASE WHEN year(date) >= 1996 THEN ic END) / avg(CASE WHEN year(date) < 1996 THEN ic END), 6) + 0.0 AS retained FROM stats GROUP BY signal"))
def signal_decay(spark: SparkSession, sf_dir: str) -> DataFrame:
    before, after = F.avg(F.when(F.year("date") < 1996, F.col("ic"))), F.avg(F.when(F.year("date") >= 1996, F.col("ic")))
    return tidy(stats(spark, sf_dir).groupBy("signal").agg(before.alias("ic_before"), after.alias("ic_after"), F.coalesce(F.signum(before) == F.signum(after), F.lit(False)).alias("same_sign"), (after / before).alias("retained")))


@query(with_([*SCORES, f"r AS (SELECT date, {rank_sql('score', 'date')} AS rs, {rank_sql('target', 'date')} AS rt FROM scores WHERE score IS NOT NULL AND target IS NOT NULL)", "d AS (SELECT date, CASE WHEN var_pop(rs) > 0 AND var_pop(rt) > 0 THEN corr(rs, rt) END AS ic FROM r GROUP BY date)"], "SELECT year(date)::INT AS year, round(avg(ic), 6) + 0.0 AS ic FROM d GROUP BY 1"))
def model_ic(spark: SparkSession, sf_dir: str) -> DataFrame:
    held = scores(spark, sf_dir).where("score is not null and target is not null")
    ranked = held.select("date", average_rank(F.col("score"), "date").alias("rs"), average_rank(F.col("target"), "date").alias("rt"))
    return tidy(ranked.groupBy("date").agg(ev.correlation("rs", "rt").alias("ic")).groupBy(F.year("date").alias("year")).agg(F.avg("ic").alias("ic")))


_FAMILIES = ", ".join(f"('{n}', '{signals.CATALOGUE[n].family}')" for n in NAMES)


@query(with_([*STATS, *nw_sql("stats", "ic", "signal"), f"fam AS (SELECT * FROM (VALUES {_FAMILIES}) v(signal, family))"], f"SELECT family, count(*) AS tested, sum((abs(t) > {THRESHOLD})::INT)::BIGINT AS passed FROM nw JOIN fam USING (signal) GROUP BY family"))
def family_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    meta = spark.createDataFrame([(n, signals.CATALOGUE[n].family) for n in NAMES], "signal string, family string")
    tests = ev.newey_west(stats(spark, sf_dir), "ic", LAGS, "signal").join(meta, "signal")
    return tests.groupBy("family").agg(F.count(F.lit(1)).alias("tested"), F.sum((F.abs("t") > THRESHOLD).cast("long")).alias("passed"))


# --- the whole catalogue ------------------------------------------------------

ALL = tuple(signals.CATALOGUE)
#: The reference's threshold of t.
STRONG = 3.0


_WIDE_ALL = duck.program("panel", {n: s.node for n, s in signals.CATALOGUE.items()}, keep=KEEP)
_NAMED = ", ".join(f"'{n}'" for n in ALL)
STATS_ALL = [*PANEL_SQL, *_WIDE_ALL[0], f"wide AS ({_WIDE_ALL[1]})",
             f"long AS (SELECT date, t, ticker, universe, target, unnest([{_NAMED}]) AS signal, unnest([{', '.join(f'{n}::DOUBLE' for n in ALL)}]) AS value FROM wide)",
             *STATS[len(LONG):]]
TESTS_ALL = [*STATS_ALL, *nw_sql("stats", "ic", "signal")]
CHOSEN_ALL = [
    *TESTS_ALL,
    "tenth AS (SELECT date FROM (SELECT date, row_number() OVER (ORDER BY date) - 1 AS n FROM (SELECT DISTINCT date FROM stats)) WHERE n % 10 = 0)",
    f"members AS (SELECT date, ticker, universe, target, signal, CASE WHEN universe THEN value END AS x FROM long SEMI JOIN tenth USING (date) SEMI JOIN (SELECT signal FROM nw WHERE abs(t) > {STRONG}) USING (signal))",
    f"shares AS (SELECT date, ticker, universe, target, signal, coalesce({rank_sql('x', BY, True)} - 0.5, 0) AS f FROM members)",
    "sampled AS (SELECT * FROM shares WHERE universe AND target IS NOT NULL)",
    "pairs AS (SELECT a.signal, b.signal AS other, corr(a.f, b.f) AS r FROM sampled a JOIN sampled b USING (date, ticker) WHERE a.signal <> b.signal GROUP BY ALL)",
    f"alike AS (SELECT signal, list(other) FILTER (WHERE r IS NULL OR isnan(r) OR abs(r) >= {MOST}) AS near FROM pairs GROUP BY signal)",
    f"strongest AS (SELECT signal, near, row_number() OVER (ORDER BY abs(t) DESC, signal) AS k FROM nw LEFT JOIN alike USING (signal) WHERE abs(t) > {STRONG})",
    *CHOSEN[-2:],
]
_FAMILIES_ALL = ", ".join(f"('{n}', '{s.family}')" for n, s in signals.CATALOGUE.items())


@query(with_(STATS_ALL, DAILY_STATS))
def factory_daily_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``daily_signal_stats`` of all signals."""
    return tidy(stats(spark, sf_dir, ALL))


@query(with_([*TESTS_ALL, *SIGNED], SUMMARY))
def factory_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``summarize_signal`` of all signals: IC, its t, Sharpe ratios and turnover."""
    return tidy(ev.summary(stats(spark, sf_dir, ALL), COST, LAGS))


@query(with_(CHOSEN_ALL, SELECTION.format(threshold=STRONG)).replace("WITH", "WITH RECURSIVE", 1))
def factory_selection(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All signals with t, whether beyond the threshold, and whether kept beside stronger ones they correlate with."""
    daily = stats(spark, sf_dir, ALL)
    return tidy(ev.select(daily, lambda strong: features(spark, sf_dir, tuple(strong)).select("date", "ticker", *strong), STRONG, LAGS, MOST))


@query(with_([*TESTS_ALL, f"fam AS (SELECT * FROM (VALUES {_FAMILIES_ALL}) v(signal, family))"], f"SELECT family, count(*) AS tested, sum(coalesce(abs(t) > {STRONG}, false)::INT)::BIGINT AS passed FROM fam LEFT JOIN nw USING (signal) GROUP BY family"))
def factory_family_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How many signals of each family are tested, and pass."""
    meta = spark.createDataFrame([(n, s.family) for n, s in signals.CATALOGUE.items()], "signal string, family string")
    tests = meta.join(ev.newey_west(stats(spark, sf_dir, ALL), "ic", LAGS, "signal"), "signal", "left")
    return tests.groupBy("family").agg(F.count(F.lit(1)).alias("tested"), F.sum(F.coalesce(F.abs("t") > STRONG, F.lit(False)).cast("long")).alias("passed"))


# --- winners and losers -----------------------------------------------------

H, TAIL, SPLIT = 21, 0.1, "1996-01-01"
FORWARD = ["fw AS (SELECT date, ticker, lead(c, 21) OVER w / nullif(lead(o, 1) OVER w, 0) - 1 AS fwd FROM panel WINDOW w AS (PARTITION BY ticker ORDER BY t))",
           f"tails AS (SELECT f.*, fwd, {rank_sql('fwd', 'f.date', True)} AS pct FROM features f JOIN fw ON fw.date = f.date AND fw.ticker = f.ticker)",
           f"flags AS (SELECT *, coalesce(pct > 1 - {TAIL}, false) AS win, coalesce(pct <= {TAIL}, false) AS lose FROM tails WHERE fwd IS NOT NULL)"]


def tails(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows with a forward return over H, flagged if in the day's top or bottom tail."""
    own = Window.partitionBy("ticker").orderBy("t")
    fwd = source.panel(spark, sf_dir).select("date", "ticker", (F.try_divide(F.lead("c", H).over(own), F.lead("o", 1).over(own)) - 1).alias("fwd"))
    rows = features(spark, sf_dir).join(fwd, ["date", "ticker"])
    pct = average_rank(F.col("fwd"), "date") / F.count("fwd").over(Window.partitionBy("date"))
    return rows.withColumn("pct", pct).where("fwd is not null").withColumns({"win": F.col("pct") > 1 - TAIL, "lose": F.col("pct") <= TAIL})


@query(with_([*FEATURES, *FORWARD], "SELECT date, ticker, round(fwd, 6) + 0.0 AS fwd, win, lose FROM flags"))
def tail_flags(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tidy(tails(spark, sf_dir).select("date", "ticker", "fwd", "win", "lose"))


_PROFILE = [*FEATURES, *FORWARD, "st AS (" + " UNION ALL ".join(f"SELECT '{n}' AS signal, {n} AS v, win, lose FROM flags WHERE date < DATE '{SPLIT}'" for n in NAMES) + ")",
            "prof AS (SELECT signal, avg(CASE WHEN win THEN v END) - avg(v) AS winners_vs_all, avg(CASE WHEN lose THEN v END) - avg(v) AS losers_vs_all FROM st GROUP BY signal)"]


def profiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = tails(spark, sf_dir).where(F.col("date") < SPLIT).unpivot(["win", "lose"], list(NAMES), "signal", "v")
    return rows.groupBy("signal").agg((F.avg(F.when(F.col("win"), F.col("v"))) - F.avg("v")).alias("winners_vs_all"), (F.avg(F.when(F.col("lose"), F.col("v"))) - F.avg("v")).alias("losers_vs_all"))


@query(with_(_PROFILE, "SELECT signal, round(winners_vs_all, 6) + 0.0 AS winners_vs_all, round(losers_vs_all, 6) + 0.0 AS losers_vs_all, round(winners_vs_all - losers_vs_all, 6) + 0.0 AS winners_vs_losers FROM prof"))
def winner_profile(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tidy(profiles(spark, sf_dir).withColumn("winners_vs_losers", F.col("winners_vs_all") - F.col("losers_vs_all")))


@query(with_(_PROFILE, "SELECT round(corr(winners_vs_all, losers_vs_all), 6) AS correlation FROM prof"))
def profile_correlation(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tidy(profiles(spark, sf_dir).agg(ev.correlation("winners_vs_all", "losers_vs_all").alias("correlation")))


@query(with_([*FEATURES, *FORWARD, "top AS (SELECT date, ticker, fwd FROM flags WHERE win ORDER BY fwd DESC, date, ticker LIMIT 400)", "best AS (SELECT *, row_number() OVER (PARTITION BY ticker ORDER BY fwd DESC, date) AS n FROM top)"], "SELECT date, ticker, round(fwd, 6) + 0.0 AS fwd FROM best WHERE n = 1 ORDER BY fwd DESC LIMIT 10"))
def top_examples(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The report's ten best names: of the 400 greatest returns, each ticker's best."""
    top = tails(spark, sf_dir).where("win").select("date", "ticker", "fwd").orderBy(F.col("fwd").desc(), "date", "ticker").limit(400)
    best = top.withColumn("n", F.row_number().over(Window.partitionBy("ticker").orderBy(F.col("fwd").desc(), "date"))).where("n = 1")
    return tidy(best.orderBy(F.col("fwd").desc()).limit(10).drop("n"))


BANDS = (("top", 0.9, 1.01), ("next", 0.8, 0.9), ("rest", 0.0, 0.8))
_BUCKET = "CASE " + " ".join(f"WHEN b > {lo} AND b <= {hi} THEN '{n}'" for n, lo, hi in BANDS) + " END"


@query(with_([*SCORES, *FORWARD, f"sb AS (SELECT g.*, {rank_sql('v.score', 'g.date', True)} AS b FROM flags g JOIN voted v ON v.date = g.date AND v.ticker = g.ticker)"],
    f"SELECT {_BUCKET} AS bucket, count(*) AS n, round(avg(win::INT), 6) AS winner_rate, round(avg(lose::INT), 6) AS loser_rate, round(avg(fwd), 6) AS mean_fwd, round(median(fwd), 6) AS median_fwd FROM sb WHERE b IS NOT NULL GROUP BY 1"))
def bucket_test(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = tails(spark, sf_dir).join(scores(spark, sf_dir).where("score is not null").select("date", "ticker", "score"), ["date", "ticker"])
    b = rows.withColumn("b", average_rank(F.col("score"), "date") / F.count("score").over(Window.partitionBy("date")))
    label = F.lit(None)
    for name, lo, hi in reversed(BANDS):
        label = F.when((F.col("b") > lo) & (F.col("b") <= hi), name).otherwise(label)
    out = b.groupBy(label.alias("bucket")).agg(F.count(F.lit(1)).alias("n"), F.avg(F.col("win").cast("int")).alias("winner_rate"), F.avg(F.col("lose").cast("int")).alias("loser_rate"), F.avg("fwd").alias("mean_fwd"), F.expr("percentile(fwd, 0.5)").alias("median_fwd"))
    return tidy(out)


BOOKS = {"top1": 1, "top2": 2}
_DAILY_PANEL = source.panel_sql(source.DAILY)
_VOL_CTES, _VOL_SELECT = duck.program("panel", {"vol": e.ts_std(signals.R, 63, 50)}, keep=("date", "ticker", "o", "universe"))
WEEKLY = [*_DAILY_PANEL, *_VOL_CTES, f"pv AS ({_VOL_SELECT})",
    "wk AS (SELECT date_trunc('week', date + 2)::DATE AS week, min(date) AS first, max(date) AS last FROM (SELECT DISTINCT date FROM panel) GROUP BY 1)",
    "weeks AS (SELECT * FROM (SELECT last, lead(first, 1) OVER (ORDER BY week) AS entry, lead(first, 2) OVER (ORDER BY week) AS leave, row_number() OVER (ORDER BY week) AS w FROM wk) WHERE leave IS NOT NULL)",
    "wr AS (SELECT w, entry, s.ticker, s.vol, x.o / nullif(i.o, 0) - 1 AS r FROM weeks JOIN pv s ON s.date = last AND s.universe AND s.vol IS NOT NULL JOIN pv i ON i.date = entry AND i.ticker = s.ticker JOIN pv x ON x.date = leave AND x.ticker = s.ticker)",
    "wn AS (SELECT *, row_number() OVER (PARTITION BY w ORDER BY vol DESC, ticker) AS d, row_number() OVER (PARTITION BY w ORDER BY vol, ticker) AS u FROM wr WHERE r IS NOT NULL)",
    "wb AS (SELECT *, 'top1' AS book FROM wn WHERE d <= 1 UNION ALL SELECT *, 'top2' FROM wn WHERE d <= 2 UNION ALL SELECT *, 'least' FROM wn WHERE u <= 2 UNION ALL SELECT *, 'all' FROM wn)",
    "ww AS (SELECT *, 1 / count(*) OVER (PARTITION BY w, book) AS weight FROM wb)",
    "wm AS (SELECT coalesce(a.w, b.w + 1) AS w, coalesce(a.book, b.book) AS book, sum(abs(coalesce(a.weight, 0) - coalesce(b.weight, 0))) AS turn FROM ww a FULL JOIN ww b ON a.w = b.w + 1 AND a.book = b.book AND a.ticker = b.ticker GROUP BY 1, 2)",
    f"wg AS (SELECT w, book, min(entry) AS date, avg(r) AS gross FROM ww GROUP BY w, book)",
    f"books AS (SELECT date, book, gross - turn * {COST} / 1e4 AS ret FROM wg JOIN wm USING (w, book))"]


def books(spark: SparkSession, sf_dir: str) -> DataFrame:
    panel = source.panel(spark, sf_dir, source.DAILY)
    vol = evaluate(panel, {"vol": e.ts_std(signals.R, 63, 50)}, keep=("date", "ticker"))
    return pf.weekly_books(panel, vol, BOOKS, 2, COST)


@query(with_(WEEKLY, "SELECT date, book, round(ret, 6) + 0.0 AS ret FROM books"))
def weekly_books(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tidy(books(spark, sf_dir))


@query(with_([*WEEKLY, "bw AS (SELECT *, exp(sum(ln(1 + ret)) OVER (PARTITION BY book ORDER BY date ROWS UNBOUNDED PRECEDING)) AS wealth FROM books)", "bd AS (SELECT *, wealth / max(wealth) OVER (PARTITION BY book ORDER BY date ROWS UNBOUNDED PRECEDING) - 1 AS dd FROM bw)"],
    "SELECT book, round(avg(ret), 6) AS avg_week, round(median(ret), 6) AS median_week, round(pow(arg_max(wealth, date), 52.0 / count(*)) - 1, 6) AS cagr, round(stddev_samp(ret) * sqrt(52), 6) AS vol, round(avg(ret) / stddev_samp(ret) * sqrt(52), 6) AS sharpe, round(min(dd), 6) AS max_dd, round(min(ret), 6) AS worst_week, round(max(ret), 6) AS best_week, round(avg((ret > 0)::INT), 6) AS up_weeks, round(arg_max(wealth, date), 4) AS x_money FROM bd GROUP BY book"))
def weekly_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    held = ev.with_drawdown(books(spark, sf_dir), "ret", "book")
    out = held.groupBy("book").agg(
        F.avg("ret").alias("avg_week"), F.expr("percentile(ret, 0.5)").alias("median_week"), (F.pow(F.max_by("wealth", "date"), 52.0 / F.count(F.lit(1))) - 1).alias("cagr"), (F.stddev_samp("ret") * 52**0.5).alias("vol"), ev.sharpe("ret", 52).alias("sharpe"), F.min("drawdown").alias("max_dd"), F.min("ret").alias("worst_week"), F.max("ret").alias("best_week"), F.avg((F.col("ret") > 0).cast("int")).alias("up_weeks"), F.round(F.max_by("wealth", "date"), 4).alias("x_money")
    )
    return tidy(out)


# --- scans, storage and the benchmark ----------------------------------------


@query("SELECT date_trunc('week', l_shipdate)::DATE AS date, round(sum(l_extendedprice), 4) AS dvol, count(*) AS n FROM lineitem WHERE l_suppkey = 1 AND l_shipdate >= TIMESTAMP '1995-01-01' GROUP BY 1")
def benchmark_bars(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One supplier's weeks from a date on: both predicates and four columns reach the scan."""
    lines = store.at_point(spark.read.parquet(f"{sf_dir}/lineitem.parquet"), "l_suppkey", 1).where(F.col("l_shipdate") >= F.lit("1995-01-01").cast("timestamp_ntz"))
    return tidy(lines.groupBy(F.date_trunc("week", "l_shipdate").cast("date").alias("date")).agg(F.sum("l_extendedprice").alias("dvol"), F.count(F.lit(1)).alias("n")), 4)


@query(with_(PANEL_SQL, "SELECT date, ticker, t, round(target, 6) + 0.0 AS target FROM panel WHERE date >= DATE '1997-01-01' AND t <= (SELECT max(t) - 2 FROM panel)"))
def complete_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The panel from a start date on, without the last two dates, whose targets can't be known."""
    rows = source.complete(source.panel(spark, sf_dir), since="1997-01-01")
    return tidy(rows.select("date", "ticker", F.col("t").cast("long").alias("t"), "target"))


@query(with_([*BANDED, "bench AS (SELECT date, c / nullif(lag(c) OVER (ORDER BY t), 0) - 1 AS r FROM panel WHERE ticker = 1)"], f"SELECT date, round(ls_gross - ls_to * {COST} / 1e4, 6) + 0.0 AS ls_net, round(coalesce(r, 0), 6) + 0.0 AS benchmark FROM daily LEFT JOIN bench USING (date)"))
def portfolio_vs_benchmark(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The portfolio's dates with one name's returns beside them, 0 where it has none."""
    daily = pf.net_of_costs(pf.portfolio(scores(spark, sf_dir), 0.2, 5, 0.4), [COST])
    return tidy(pf.with_benchmark(daily, store.at_point(source.panel(spark, sf_dir), "ticker", 1)).select("date", "ls_net", "benchmark"))


@query(with_(FEATURES, f"SELECT date, ticker, target::FLOAT::DOUBLE AS target, {', '.join(f'{n}::FLOAT::DOUBLE AS {n}' for n in NAMES[:2])} FROM features WHERE year(date) BETWEEN 1996 AND 1997").replace("SELECT date, ticker, target::FLOAT", "SELECT date, ticker, target::FLOAT"))
def feature_store(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Features written as 32-bit columns by year, and two of them read back for two years."""
    path = store.scratch(spark, "features")
    store.write_features(features(spark, sf_dir), list(NAMES), path)
    out = store.read_features(spark, path, list(NAMES[:2]), 1996, 1997)
    return out.select("date", "ticker", *[F.col(c).cast("double").alias(c) for c in ("target", *NAMES[:2])])


@query(with_(STATS, f"SELECT date, signal, n, {rounded(['ic', 'ls'])} FROM stats"))
def cached_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Daily statistics from the table that the first call writes and later ones read."""
    path = store.scratch(spark, "daily-stats")
    for _ in range(2):
        out = store.cached(spark, path, lambda: stats(spark, sf_dir))
    return tidy(out.select("date", "signal", "n", "ic", "ls"))


# --- models -----------------------------------------------------------------


FIRST, LAST, AHEAD = 1997, 1998, 5
MODELS = ("simple", "trees_selected", "trees_all")


def predictions(table: DataFrame, h: int = 1, trees: dict | None = None, keep: Callable[[str, DataFrame], DataFrame] = lambda name, df: df.persist()) -> DataFrame:
    """Out-of-sample predictions of the vote and two boosted-tree combiners, fitted on returns over ``h`` dates.

    ``table`` is ``wide``; ``keep`` keeps the rows and statistics that every year's models start from.
    """
    rows = centred(table)
    embargo = 5
    if h == 1:
        labelled = rows.withColumn("y_rank", average_rank(F.col("target"), "date") / F.count("target").over(Window.partitionBy("date")) - 0.5)
        daily = ev.daily_stats(ev.long_form(table, list(NAMES)), Q, LEAST)
    else:
        labels = ev.horizon_labels(table, h)
        labelled = rows.join(labels.select("date", "ticker", F.col("y_rank_h").alias("y_rank")), ["date", "ticker"], "left")
        stacked = rows.unpivot(["date", "ticker"], list(NAMES), "signal", "feature").withColumn("feature", F.col("feature").cast("float"))
        daily, embargo = ev.horizon_ic(stacked, labels, LEAST), max(embargo, h + 2)
    own = lambda name, df: keep(f"{name}-{h}", df)
    return models.walk_forward(labelled, daily, list(NAMES), first_year=FIRST, last_year=LAST, embargo=embargo, threshold=THRESHOLD, lags=LAGS, most=0.8, trees=trees, keep=own)


@query()
def walk_forward(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Out-of-sample predictions of the vote and two boosted-tree combiners, year by year."""
    return tidy(predictions(wide(spark, sf_dir)))


def configurations(spark: SparkSession, sf_dir: str, path: str, trees: dict | None = None) -> DataFrame:
    """Daily net series of the 36 configurations, as a table at ``path``: three models at two horizons, half-lives and bands.

    Each step is a table from which the next is planned. Planned from the order lines, every one of the many jobs would
    read them anew and carry all plans before it, which the driver's memory doesn't hold.
    """
    place = store.scratch(spark, "study")
    keep = lambda name, df: store.cached(spark, f"{place}/{name}", lambda: df)
    try:
        panel = keep("panel", source.panel(spark, sf_dir, source.WEEKLY, keep))
        table = keep("signals", evaluate(panel, NODES, keep=(*KEEP, "c")))
        grid = table.where(F.year("date").between(FIRST, LAST)).select("date", "t", "ticker", "target", "o", "c")
        frames = []
        for h in (1, AHEAD):
            both = grid.join(keep(f"predictions-{h}", predictions(table, h, trees, keep)).drop("target"), ["date", "ticker"], "left")
            named = both.withColumnsRenamed({m: f"h{h}_{m}" for m in MODELS} if h > 1 else {})
            frames.append(named.unpivot(grid.columns, [c for c in named.columns if c not in grid.columns], "model", "score"))
        scored = keep("scores", frames[0].unionByName(frames[1]))
        daily = pf.config_grid(scored, 0.2, [0, 3, 10], {"noband": None, "band40": 0.4})
        return store.cached(spark, path, lambda: daily.withColumn("net", F.col("ls_gross") - F.col("ls_to") * COST / 1e4).select("config", "date", "net", "ls_to"))
    finally:
        store.delete(spark, place)


def ranked_configurations(daily: DataFrame) -> DataFrame:
    """Configurations by their net Sharpe ratio before the last year, which is held out."""
    before = daily.where(F.year("date") < LAST)
    return before.groupBy("config").agg(ev.sharpe("net").alias("val_sharpe"), (F.avg("net") * 252).alias("ann"), F.avg("ls_to").alias("turnover")).orderBy(F.col("val_sharpe").desc_nulls_last(), "config")


def deflated(daily: DataFrame) -> DataFrame:
    """The chosen configuration's series of the held-out year, deflated by the ratios of all."""
    trials = ranked_configurations(daily).collect()
    chosen = daily.where((F.col("config") == trials[0]["config"]) & (F.year("date") == LAST))
    return ev.deflated_sharpe(chosen, "net", [r["val_sharpe"] for r in trials if r["val_sharpe"] is not None])


@query()
def config_grid(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every model, half-life and band, best net Sharpe ratio first."""
    return tidy(ranked_configurations(configurations(spark, sf_dir, store.scratch(spark, "configurations"))))


@query()
def deflated_sharpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = store.scratch(spark, "configurations")
    try:
        return tidy(deflated(configurations(spark, sf_dir, path)))  # a row of its own, which reads no table
    finally:
        store.delete(spark, path)


@query()
def winner_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Importance of each signal in telling the top tail from the rest."""
    return tidy(models.winner_importance(tails(spark, sf_dir), list(NAMES), SPLIT, H))

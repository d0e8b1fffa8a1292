"""Market parsing, prices as of a time, stakes and ledgers on small fixtures."""

from __future__ import annotations

import bz2
import json
from datetime import datetime, timedelta

import pytest
from compare import TABLES, differences
from pyspark.sql import functions as F

from panelith import market_queries
from panelith.operators import markets as mk


def lines(spark, *values):
    return spark.createDataFrame([(json.dumps(v),) for v in values], "value string")


def market(**changes):
    return {"id": 7, "question": "Q?", "endDate": "2026-01-31T12:00:00Z", "closed": True, "outcomes": '["Yes","No"]', "outcomePrices": '["1","0"]', "clobTokenIds": '["a","b"]', "volumeNum": 5e4, "bestBid": 0.4, "events": [{"tags": [{"label": "Politics"}]}]} | changes


def test_parse_and_resolve(spark):
    got = mk.parse_markets(lines(spark, market(), market(outcomePrices='["0.5","0.5"]'), market(outcomes='["No","Yes"]'), market(outcomes=None, volumeNum="x", closed=False), {"id": 1})).collect()
    assert [r["resolved_yes"] for r in got] == [True, None, False, None, None]
    assert got[0]["category"] == "politics" and got[0]["is_binary"] and got[0]["best_ask"] is None and got[2]["yes_index"] == 1
    assert got[3]["volume"] == 0 and got[4]["outcomes"] == []


@pytest.mark.parametrize(("text", "expected"), [('```json\n{"probability": 0.37}\n```', 0.37), ('```json\n{"probability": 0.999}\n```', 0.99), ('x {"probability": 0.2, "a": 1} y', 0.2), ('```json\n{"probability": 0.3}\n``` ```json\n{"probability": 7}\n```', 0.3), ("none", None), (None, None)])
def test_forecast_text(spark, text, expected):
    got = spark.createDataFrame([(text,)], "t string").select(mk.parse_forecast(F.col("t"))).first()[0]
    assert got == expected


def test_runner_forecast_text(spark):
    text = '```json\n{"probabilities": {"a": 0.5, "B": 0.3, "c": 0.1}}\n```'
    got = spark.createDataFrame([(text, ["A", "B", "C"])], "t string, n array<string>").select(mk.parse_runner_forecast(F.col("t"), F.col("n"))).first()[0]
    assert got == pytest.approx({"A": 0.5 / 0.9, "B": 0.3 / 0.9, "C": 0.1 / 0.9})


def test_snapshots(spark):
    end = datetime(2026, 2, 1)
    at = lambda d, p: ("m", end - timedelta(days=d), p)
    ticks = spark.createDataFrame([at(31, 0.1), at(5, 0.6), at(1, 0.6), at(0.5, 0.9)], "market_id string, ts timestamp, price double")
    got = mk.snapshots(ticks, spark.createDataFrame([("m", end)], "market_id string, end timestamp")).collect()
    assert {r["days_before"]: r["yes_price"] for r in got} == {1: 0.6, 7: 0.1, 30: 0.1}


def test_fee_and_decision(spark):
    rows = [(0.7, 0.4, 0.5, "politics"), (0.2, 0.4, 0.5, "politics"), (0.47, 0.44, 0.5, None), (0.9, 0.6, 0.5, None), (0.9, None, 0.5, None)]
    got = mk.decide(spark.createDataFrame(rows, "q double, bid double, ask double, category string")).collect()
    assert [r["side"] for r in got] == ["YES", "NO", None, None, None]
    assert got[0]["cost"] == pytest.approx(0.51) and got[0]["want"] <= 200
    granted = mk.capped(spark.createDataFrame([(i, 200.0) for i in range(20)], "i int, want double"), ["i"], 500.0).orderBy("i").collect()
    assert sum(r["stake"] for r in granted) == pytest.approx(2500) and granted[12]["stake"] == pytest.approx(100)


def test_exchange_decision_and_settlement(spark):
    fields = "market_id string, pos int, selection_id int, status string, q double, back double, back_size double, lay double, lay_size double"
    got = mk.decide_exchange(spark.createDataFrame([("m", 0, 11, "ACTIVE", 0.2, 1.8, 500.0, 1.9, 500.0), ("m", 1, 12, "ACTIVE", 0.55, 3.0, 500.0, 3.2, 500.0), ("n", 0, 13, "REMOVED", 0.9, 3.0, 500.0, 3.2, 500.0)], fields)).orderBy("market_id").collect()
    best = max(0.55 * 2 * 0.95 - 0.45, 0.8 * 0.95 / 0.9 - 0.2)
    assert got[0]["ev"] == pytest.approx(best) and got[1]["side"] is None
    bets = spark.createDataFrame([("BACK", 3.0, 10.0, True), ("BACK", 3.0, 10.0, False), ("LAY", 3.0, 10.0, True), ("LAY", 3.0, 10.0, False)], "side string, odds double, stake double, won boolean")
    assert [r[0] for r in bets.select(mk.settle_pnl(F.col("side"), F.col("odds"), F.col("stake"), F.col("won"))).collect()] == pytest.approx([19, -10, -20, 9.5])


def test_stream_files(spark, tmp_path):
    end = datetime(2026, 2, 1)
    ms = lambda d: int((end - timedelta(days=d)).timestamp() * 1000)
    definition = {"status": "CLOSED", "marketTime": "2026-02-01T00:00:00.000Z", "name": "Winner", "runners": [{"id": 1, "name": "A", "status": "LOSER"}, {"id": 2, "name": "B", "status": "WINNER"}]}
    messages = [{"pt": ms(8), "mc": [{"rc": [{"id": 2, "ltp": 3.0}]}]}, {"pt": ms(2), "mc": [{"rc": [{"id": 2, "ltp": 1.7}, {"id": 1, "ltp": 2.5}]}]}, {"pt": ms(0.1), "mc": [{"rc": [{"id": 1, "ltp": 9.0}]}, {"marketDefinition": definition}]}]
    text = "\n".join(json.dumps(m) for m in messages)
    (tmp_path / "deep").mkdir()
    (tmp_path / "deep" / "1.23.bz2").write_bytes(bz2.compress(text.encode()))
    (tmp_path / "1.24").write_text(text)
    (tmp_path / "other").write_text(text)
    final, prices = mk.replay(mk.read_stream_files(spark, str(tmp_path)))
    got = {(r["market_id"], r["days_before"], r["runner"]): (r["odds"], r["won"]) for r in mk.stream_snapshots(final, prices).collect()}
    one = {(1, "B"): (1.7, 1), (1, "A"): (2.5, 0), (7, "B"): (3.0, 1)}
    assert got == {(m, *k): v for m in ("1.23", "1.24") for k, v in one.items()}


def test_prompt_has_no_price(spark):
    row = spark.createDataFrame([("Will it?", " ", datetime(2026, 1, 1), datetime(2025, 12, 1))], "q string, r string, e timestamp, n timestamp")
    text = row.select(mk.prompt(F.col("q"), F.col("r"), F.col("e"), F.col("n"))).first()[0]
    assert "Will it?" in text and "No rules are given" in text and "price" not in text.lower()


def test_news_a_fraction_of_a_second_past_the_close(spark, small, tmp_path):
    """The query beside its SQL where New York's close falls between two microseconds, in winter and in summer."""
    close = (datetime(2024, 1, 15, 21), datetime(2024, 7, 15, 20))
    steps = (-1, 0, 1, 198_996, 999_999, 1_000_000)
    rows = [(10 * i + k, c + timedelta(microseconds=s), 1, "view", 1.0, "{}") for i, c in enumerate(close) for k, s in enumerate(steps)] + [(99, None, 1, "view", 1.0, "{}"), (98, datetime(2024, 1, 16, 3), 1, "view", 1.0, "{}")]
    spark.createDataFrame(rows, "event_id long, ts timestamp_ntz, user_id long, event_type string, value double, props string").coalesce(1).write.parquet(str(tmp_path / "written"))
    (tmp_path / "events.parquet").symlink_to(next((tmp_path / "written").glob("*.parquet")))
    for t in TABLES:
        if t != "events":
            (tmp_path / f"{t}.parquet").symlink_to(f"{small}/{t}.parquet")
    assert differences(spark, str(tmp_path), "news_availability") == ""
    got = {r["event_id"]: r["usable"] and (r["usable"].month, r["usable"].day) for r in market_queries.news_availability(spark, str(tmp_path)).collect()}
    assert [got[10 * i + k] for i in range(2) for k in range(6)] == [(1, 15)] * 2 + [(1, 16)] * 4 + [(7, 15)] * 2 + [(7, 16)] * 4
    assert got[99] is None and got[98] == (1, 16)

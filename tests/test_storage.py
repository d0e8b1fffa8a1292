"""Storage, ledgers, the frozen choice, exchange parsing, and the streaming jobs beside their batch forms."""

from __future__ import annotations

import hashlib
import json
from datetime import date, datetime

import pytest
from pyspark.sql import functions as F

from panelith.operators import exchange as ex
from panelith.operators import markets as mk
from panelith.operators import study
from panelith.sources import store
from panelith.streaming import jobs


def test_cached_tables_are_made_once(spark, tmp_path):
    calls = []

    def make():
        calls.append(1)
        return spark.range(3)

    for _ in range(2):
        assert store.cached(spark, str(tmp_path / "t"), make).count() == 3
    assert len(calls) == 1


def test_features_are_pruned_by_year_and_name(spark, tmp_path):
    rows = spark.createDataFrame([(date(y, 3, 1), "a", 0.1, 1.5, None) for y in range(2001, 2005)], "date date, ticker string, target double, x double, y double")
    store.write_features(rows, ["x", "y"], str(tmp_path / "f"))
    got = store.read_features(spark, str(tmp_path / "f"), ["x"], 2002, 2003)
    plan = got._jdf.queryExecution().toString()
    assert got.count() == 2 and got.schema["x"].dataType.simpleString() == "float" and "PartitionFilters: [isnotnull(year" in plan and "y:float" not in plan.split("ReadSchema")[-1]


def test_prices_are_filtered_in_the_scan(spark, tmp_path):
    spark.createDataFrame([("SPY", date(2020, 1, d), float(d)) for d in range(1, 9)] + [("X", date(2020, 1, 1), 1.0)], "ticker string, date date, close double").write.parquet(str(tmp_path / "p"))
    got = store.read_prices(spark, str(tmp_path / "p"), ["SPY"], "2020-01-05")
    plan = got._jdf.queryExecution().toString()
    assert got.count() == 4 and "EqualTo(ticker,SPY)" in plan and "GreaterThanOrEqual(date" in plan


def test_csv_of_tickers_and_file_hashes(spark, tmp_path):
    (tmp_path / "deep").mkdir()
    path = tmp_path / "deep" / "recycled.csv"
    path.write_text("ticker\nABC\n  \n XY \n")
    assert sorted(r[0] for r in store.read_tickers(spark, str(path)).collect()) == ["ABC", "XY"]
    (row,) = store.file_hashes(spark, str(tmp_path)).collect()
    assert row["sha256"] == hashlib.sha256(path.read_bytes()).hexdigest() and row["length"] == path.stat().st_size


def test_reports(spark, tmp_path):
    store.write_report(spark.createDataFrame([("a", 1.25, None), ("b", None, 2)], "name string, x double, n int"), str(tmp_path), "small", "A small one")
    text = spark.read.text(str(tmp_path / "small.md"), wholetext=True).first()[0]
    assert text.startswith("# A small one") and "| a | 1.250 |" in text
    assert spark.read.json(str(tmp_path / "small.json")).count() == spark.read.csv(str(tmp_path / "small.csv"), header=True).count() == 2
    with pytest.raises(ValueError, match="more than"):
        store.write_report(spark.range(store.REPORT_ROWS + 1), str(tmp_path), "large")


def test_a_choice_is_frozen_once(spark, tmp_path):
    path = str(tmp_path / "choice")
    with pytest.raises(FileNotFoundError):
        store.frozen(spark, path)
    ranked = lambda *rows: spark.createDataFrame(rows, "config string, val_sharpe double")
    with pytest.raises(ValueError, match="no configuration"):
        store.freeze(ranked(("a", None)), path)
    assert store.freeze(ranked(("a", 0.1), ("b", 0.4), ("c", None)), path)["config"] == "b"
    assert store.freeze(ranked(("z", 9.0)), path)["config"] == store.frozen(spark, path)["config"] == "b"


def test_ledger_lines(spark, tmp_path):
    path, now = str(tmp_path / "ledger"), F.lit("2026-02-01").cast("timestamp")
    assert store.load_ledger(spark, path, mk.LEDGER).count() == 0
    row = lambda m, side: (m, 0.6, 0.5, side, 10.0, 20.0, "open", None, None, None)
    store.append_ledger(spark.createDataFrame([row("a", "YES")], mk.LEDGER), path)
    store.append_ledger(spark.createDataFrame([row("b", "NO"), row("c", None), row("d", "YES")], mk.LEDGER), path)
    outcomes = spark.createDataFrame([("a", True, True), ("b", True, None), ("c", True, False)], "market_id string, closed boolean, resolved_yes boolean")
    for _ in range(2):
        store.save_ledger(mk.settle_binary(store.load_ledger(spark, path, mk.LEDGER), outcomes, now), path)
    got = {r["market_id"]: (r["status"], r["pnl"]) for r in store.load_ledger(spark, path, mk.LEDGER).collect()}
    assert got == {"a": ("settled", 10.0), "b": ("void", 0.0), "c": ("settled", 0.0), "d": ("open", None)}


def test_ingestion_is_idempotent(spark, tmp_path):
    path = str(tmp_path / "t")
    for ids in ((1, 2, 2), (2, 3), (1, 2, 3)):
        store.ingest(spark.createDataFrame([(i, "x") for i in ids], "id int, v string"), path, "id")
    assert sorted(r["id"] for r in spark.read.parquet(path).collect()) == [1, 2, 3]


def lines(spark, *values):
    return spark.createDataFrame([(json.dumps(v),) for v in values], "value string")


CATALOGUE = {"marketId": "1.9", "marketName": "Who wins", "totalMatched": 9000.0, "event": {"name": "Cup"}, "description": {"rules": "R", "marketTime": "2026-01-31T12:00:00.000Z"}, "runners": [{"selectionId": 5, "runnerName": "Ann"}, {"selectionId": 6, "runnerName": "Bo"}, {"selectionId": 7}]}
BOOK = {"marketId": "1.9", "status": "OPEN", "runners": [{"selectionId": 5, "status": "ACTIVE", "lastPriceTraded": 2.5, "ex": {"availableToBack": [{"price": 2.4, "size": 90.0}, {"price": 2.3, "size": 1.0}], "availableToLay": []}}, {"selectionId": 6, "status": "REMOVED"}, {"selectionId": 99, "status": "ACTIVE", "lastPriceTraded": 9.0}]}


def test_catalogue_and_book(spark):
    listed = ex.parse_catalogue(lines(spark, CATALOGUE, {"marketId": "1.8", "marketName": "Alone"}))
    assert {r["market_id"]: r["question"] for r in listed.collect()} == {"1.9": "Cup: Who wins", "1.8": "Alone"}
    got = {r["selection_id"]: r for r in ex.quoted(listed, ex.parse_books(lines(spark, BOOK))).collect()}
    assert sorted(got) == [5, 6, 7] and (got[5]["back"], got[5]["back_size"], got[5]["lay"], got[5]["lay_size"], got[5]["ltp"]) == (2.4, 90.0, None, 0.0, 2.5)
    assert got[6]["status"] == "REMOVED" and got[7]["status"] == "ACTIVE" and got[7]["runner"] == "7"
    now = lambda d: F.lit(datetime(2026, 1, d)).cast("timestamp")
    assert [r["market_id"] for r in ex.eligible(listed, now(1)).collect()] == ["1.9"] and ex.eligible(listed, now(31)).count() == 0
    names = spark.createDataFrame([("1.9", {"Ann": 0.7, "Bo": 0.2, "Cy": 0.1})], "market_id string, probabilities map<string,double>")
    assert {r["selection_id"]: r["q"] for r in ex.chances_by_id(listed, names).collect()} == {5: 0.7, 6: 0.2}


def test_exchange_ledger_by_stream(spark, tmp_path):
    """Books that arrive in several files settle each row once; the scorecard has the money."""
    row = lambda m, side, sel, odds, stake, risk: (m, sel, side, odds, stake, risk, {"5": 0.6, "6": 0.4}, {"5": 0.5, "6": 0.5}, [5, 6], "open", None, None, None)
    rows = [row("a", "BACK", 5, 3.0, 10.0, 10.0), row("b", "LAY", 5, 3.0, 10.0, 20.0), row("c", None, None, None, 0.0, 0.0), row("d", "BACK", 5, 3.0, 10.0, 10.0)]
    path, folder = str(tmp_path / "ledger"), tmp_path / "books"
    store.append_ledger(spark.createDataFrame(rows, ex.LEDGER), path)
    folder.mkdir()
    book = lambda m, status, winner: json.dumps({"marketId": m, "status": status, "runners": [{"selectionId": i, "status": "WINNER" if i == winner else "LOSER"} for i in (5, 6)]})
    for i, some in enumerate(([book("a", "CLOSED", 5), book("b", "OPEN", None)], [book("b", "CLOSED", 5), book("a", "CLOSED", 6)], [book("c", "CLOSED", 6), book("d", "CLOSED", None)])):
        (folder / f"{i}.json").write_text("\n".join(some))
        jobs.settle(jobs.arriving(spark, str(folder), "value string", "text"), path, str(tmp_path / "checkpoint"), "2026-02-01")
    done = store.load_ledger(spark, path, ex.LEDGER)
    assert {r["market_id"]: (r["status"], r["pnl"], r["winners"]) for r in done.collect()} == {"a": ("settled", 19.0, [5]), "b": ("settled", -20.0, [5]), "c": ("settled", 0.0, [6]), "d": ("open", None, None)}
    (card,) = ex.score(done).collect()
    assert (card["settled"], card["bets"], card["risked"], card["pnl"]) == (3, 2, 30.0, -1.0) and card["roi"] == pytest.approx(-1 / 30)
    assert card["brier_model"] == pytest.approx((0.32 + 0.32 + 0.72) / 3) and card["logscore_market"] == pytest.approx(0.693147, abs=1e-6)


def test_replayed_stream_equals_batch(spark, tmp_path):
    message = lambda **mc: json.dumps({"op": "mcm", "pt": 1_700_000_000_000, "mc": [mc]})
    values = [message(rc=[{"id": 1, "ltp": 2.0}]), message(rc=[{"id": 1, "ltp": 3.0}]), message(marketDefinition={"status": "CLOSED", "name": "W", "runners": [{"id": 1, "name": "A", "status": "WINNER"}]})]
    frame = spark.createDataFrame([("m", i, v) for i, v in enumerate(values)], "market_id string, pos int, value string")
    folder = str(tmp_path / "in")
    for i in range(3):
        frame.where(F.col("pos") <= i).coalesce(1).write.mode("append").json(folder)
        final, prices = jobs.replay(jobs.arriving(spark, folder, "market_id string, pos int, value string", files=1), str(tmp_path / "t"), str(tmp_path / "checkpoint"))
    batch = mk.replay(frame)
    assert [sorted(map(str, x.collect())) for x in (final, prices)] == [sorted(map(str, x.collect())) for x in batch]


def test_windows_take_late_rows_within_the_watermark(spark, tmp_path):
    folder = tmp_path / "in"
    folder.mkdir()
    row = lambda m, day, hour, p: json.dumps({"market_id": m, "ts": f"2026-01-{day:02d}T{hour:02d}:00:00Z", "price": p})
    for i, some in enumerate(([row("m", 1, 5, 0.1)], [row("m", 1, 9, 0.2), row("m", 2, 1, 0.3)], [row("m", 1, 7, 0.15)], [row("m", 9, 1, 0.9)], [row("m", 10, 1, 0.8)])):
        (folder / f"{i}.json").write_text("\n".join(some))
        jobs.ticks(jobs.arriving(spark, str(folder), "market_id string, ts timestamp, price double"), str(tmp_path / "out"), str(tmp_path / "checkpoint"))
    got = {r["start"].day: (r["last_price"], r["n"]) for r in spark.read.parquet(str(tmp_path / "out")).collect()}
    assert got[1] == (0.2, 3) and got[2] == (0.3, 1)


def test_paged_listing_ends_with_its_short_page(spark, tmp_path):
    for offset, items in ((0, [{"id": 1}, {"id": 2}]), (2, [{"id": 3}]), (4, [{"id": 9}, {"id": 9}])):
        (tmp_path / f"{offset}.json").write_text(json.dumps(items))
    (tmp_path / "notes.txt").write_text("x")
    got = store.read_pages(spark, str(tmp_path), 2).select("offset", "place", F.get_json_object("value", "$.id").alias("id")).collect()
    assert sorted(map(tuple, got)) == [(0, 0, "1"), (0, 1, "2"), (2, 0, "3")]


def test_final_evaluation_needs_a_frozen_choice(spark, tmp_path):
    path = str(tmp_path / "choice")
    days = [date(y, 1, d) for y in (2018, 2019, 2020) for d in range(1, 29)]
    rows = [(c, d, a * (((i * 37) % 11) - 4) / 1000, 0.2) for c, a in (("one", 1.0), ("two", -1.0), ("three", 0.5)) for i, d in enumerate(days)]
    daily = spark.createDataFrame(rows, "config string, date date, ls_gross double, ls_to double")
    with pytest.raises(FileNotFoundError):
        study.final(daily, 2020, 5, path)
    assert study.validation(daily, 2020, 0, path)["config"] == "one"
    out = study.final(daily, 2020, 5, path)
    assert [out[k].count() for k in ("costs", "years", "deflated", "holdout")] == [5, 1, 1, 3] and 0 <= out["deflated"].first()["dsr"] <= 1
    ratios = [r["sharpe"] for r in out["costs"].orderBy("cost_bps").collect()]
    assert ratios == sorted(ratios, reverse=True)

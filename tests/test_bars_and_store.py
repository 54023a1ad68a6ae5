"""Bars, gaps, guards and the stored table."""

from __future__ import annotations

import datetime as dt

import pytest
from pyspark.sql import functions as F

from barloom.operators import bars as B
from barloom.operators import gates as G
from barloom.operators import quality as Q
from barloom.sources import store

T0 = dt.datetime(2024, 1, 1)


def five_minute(spark, minutes, symbol="A"):
    rows = [(symbol, T0 + dt.timedelta(minutes=m), 1.0 + k, 2.0 + k, 0.5 + k, 1.5 + k, 1.0) for k, m in enumerate(minutes)]
    return spark.createDataFrame(rows, store.BAR)


def test_causal_resample_drops_the_open_bucket(spark):
    bars = five_minute(spark, range(0, 120, 5))
    got = B.causal_resample(bars, "1h", "2024-01-01 01:50:00").collect()
    assert [r["ts"] for r in got] == [T0]
    full = B.causal_resample(bars, "1h", "2024-01-01 01:55:00").count()
    assert full == 2


def test_gap_over_midnight_and_known_outage(spark):
    bars = five_minute(spark, [0, 5, 1500, 1505, 1530])
    edges = Q.gap_edges(bars, "5m").orderBy("prev_ts").collect()
    assert [(r["prev_ts"].day, r["next_ts"].day) for r in edges] == [(1, 2), (2, 2)]
    outage = spark.createDataFrame([(T0, T0 + dt.timedelta(minutes=1500), "known")], "start timestamp_ntz, end timestamp_ntz, reason string")
    kinds = {r["missing"]: r["kind"] for r in Q.classify_steps(bars, outage, "5m").collect()}
    assert kinds == {298: "known_gap", 4: "gap"}


def test_row_index_over_days(spark):
    bars = five_minute(spark, range(0, 4000, 5))
    got = B.row_index(bars).orderBy("ts").select("rn").collect()
    assert [r["rn"] for r in got] == list(range(800))


def test_store_round_trip_and_upsert(spark, tmp_path):
    path = str(tmp_path / "bars")
    store.write_epoch(five_minute(spark, range(0, 60, 5)), path, 0)
    store.write_epoch(five_minute(spark, [0, 5]).withColumn("c", F.lit(99.0)), path, 1)
    store.write_epoch(five_minute(spark, [0, 5]).withColumn("c", F.lit(99.0)), path, 1)  # replay
    rows = store.read_bars(spark, path, "A", "2024-01-01", "2024-02-01").orderBy("ts").collect()
    assert len(rows) == 12 and rows[0]["c"] == 99.0 and rows[2]["c"] != 99.0
    plan = store.read_bars(spark, path, "A")._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(symbol" in plan


def test_manifest_guards_the_install(spark, tmp_path):
    bars = five_minute(spark, range(0, 60, 5))
    expected = store.manifest(bars).select("symbol", "sha256")
    store.install(bars, expected, str(tmp_path / "ok"), 0)
    with pytest.raises(ValueError):
        store.install(bars.withColumn("c", F.col("c") + 1), expected, str(tmp_path / "bad"), 0)


def test_sealed_rows_raise(spark, walk):
    start = dt.date(2019, 1, 1)
    with pytest.raises(Exception, match="sealed span"):
        G.assert_no_holdout(walk, start, "test").count()
    seen = G.seal(start, "test")(lambda rows: rows)(walk)
    assert seen.agg(F.max("day")).first()[0] < start


def test_json_rows(spark):
    lines = spark.createDataFrame([("[1704067200000, 1, 2, 0.5, 1.5, 7]",), ("[1704067500000, 1, 2, 0.5, 1.5]",)], "value string")
    rows = store.rows_from_json(lines).orderBy("ts").collect()
    assert rows[0]["ts"] == T0 and rows[0]["v"] == 7.0 and rows[1]["v"] is None


def test_repeated_times_are_counted_one_by_one(spark):
    at = dt.datetime(2024, 1, 1)
    rows = [("A", at + dt.timedelta(minutes=5 * k)) for k in (0, 1, 1, 1, 2)] + [("B", at)]
    bars = spark.createDataFrame(rows, "symbol string, ts timestamp_ntz")
    outage = spark.createDataFrame([(dt.datetime(2024, 1, 1), dt.datetime(2024, 1, 2), "x")], "start timestamp_ntz, end timestamp_ntz, reason string")
    got = {r["symbol"]: r for r in Q.quality_summary(bars, outage, "5m").collect()}
    assert (got["A"]["duplicates"], got["B"]["duplicates"], got["(all)"]["duplicates"]) == (2, 0, 2)
    assert not got["A"]["monotonic"] and got["B"]["monotonic"]


def test_ticks_of_one_time_keep_the_order_of_their_ids(spark):
    at = dt.datetime(2024, 1, 1, 10)
    ids = [1023, 1024, 5, 2**62, -3]
    ticks = spark.createDataFrame([("A", at, float(k), 1.0, i) for k, i in enumerate(ids)], "symbol string, ts timestamp_ntz, price double, v double, event_id long")
    bar = B.bars_from_ticks(ticks, "1h").first()
    assert (bar["o"], bar["c"]) == (4.0, 3.0)
    two = B.bars_from_ticks(ticks.where("event_id IN (1023, 1024)"), "1h").first()
    assert (two["o"], two["c"]) == (0.0, 1.0)

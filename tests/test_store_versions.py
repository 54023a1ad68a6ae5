"""Compaction, slices, arrival order, frame differences, equity points and decisions made again."""

from __future__ import annotations

import datetime as dt
import random

import pytest
from pyspark.sql import functions as F

from barloom.functions import atoms as A
from barloom.operators import accounts as AC
from barloom.operators import compare as C
from barloom.operators import quality as Q
from barloom.sources import store
from barloom.streaming import live

T0 = dt.datetime(2024, 1, 1)


def bars_of(spark, n, symbol="A", step=60, add=0.0):
    rows = [(symbol, T0 + dt.timedelta(minutes=step * k), 1.0 + k % 7, 9.0 + k % 5, 0.5, 1.5 + k % 11 + add, 1.0) for k in range(n)]
    return spark.createDataFrame(rows, store.BAR)


def plan_of(df):
    return df._jdf.queryExecution().executedPlan().toString()


def rows_of(spark, path, *args):
    return sorted(map(tuple, store.read_bars(spark, path, *args).collect()))


def test_compaction_reads_without_a_shuffle(spark, tmp_path):
    path = str(tmp_path / "bars")
    store.write_epoch(bars_of(spark, 2000).unionByName(bars_of(spark, 50, "B")), path, 0)
    store.write_epoch(bars_of(spark, 10, add=100.0), path, 1)
    before = rows_of(spark, path)
    assert "Exchange" in plan_of(store.read_bars(spark, path, "A"))
    assert store.compact(spark, path) == 1 and rows_of(spark, path) == before
    plan = plan_of(store.read_bars(spark, path, "A", "2024-02-01", "2024-03-01"))
    assert "Exchange" not in plan and "month" in plan.split("PartitionFilters: ")[1].split("PushedFilters")[0]
    store.write_epoch(bars_of(spark, 5, add=200.0), path, 2)
    store.write_epoch(bars_of(spark, 5, add=200.0), path, 2)  # a replay
    newer = rows_of(spark, path)
    assert newer != before and len(newer) == len(before) and newer[0][5] == 201.5
    assert store.compact(spark, path) == 2 and rows_of(spark, path) == newer


def test_crash_between_base_and_manifest(spark, tmp_path):
    path = str(tmp_path / "bars")
    store.write_epoch(bars_of(spark, 100), path, 0)
    before = rows_of(spark, path)
    store.write_base(bars_of(spark, 3, add=5.0), path, 1)  # written, but never named
    assert store.live_base(spark, path) is None and rows_of(spark, path) == before
    assert store.compact(spark, path) == 1 and rows_of(spark, path) == before
    store.publish_base(spark, path, 1, 0)  # the manifest's write is replayed
    assert rows_of(spark, path) == before


def test_slice_is_pruned_and_long_enough(spark, tmp_path):
    path = str(tmp_path / "bars")
    rng = random.Random(2)
    rows, c = [], 100.0
    for k in range(4000):
        c *= rng.uniform(0.98, 1.021)
        if k % 97 > 30:
            rows.append(("A", T0 + dt.timedelta(hours=k), c, c * 1.01, c * 0.99, c, 1.0))
    store.write_epoch(spark.createDataFrame(rows, store.BAR), path, 0)
    store.write_epoch(spark.createDataFrame(rows[-300:], store.BAR), path, 1)
    store.compact(spark, path)
    names = ["don_hi_20&mom_12b_gt1pc", "sma_abv_150", "rsi_14_<40"]
    part = store.signal_slice(spark, path, "A", names, 20)
    assert "month" in plan_of(part) and part.count() < len(rows) / 4
    newest = lambda df: {(r.day, r.config): r.signal for r in A.long_flags(df.withColumnRenamed("ts", "day"), names).collect() if r.day >= rows[-20][1]}
    assert newest(part) == newest(store.read_bars(spark, path, "A")) and len(newest(part)) == 60
    assert store.signal_slice(spark, path, "A", ["ema_abv_20"], 20).count() == len(rows)
    assert store.slice_since(spark, path, "A", 10**6) is None


def test_lookbacks():
    assert A.lookback(["don_hi_20"]) == 20 and A.lookback(["mom_12b_gt1pc"]) == 12 and A.lookback(["sma_abv_50"]) == 50
    assert A.lookback(["sma_abv_50&mom_60b_gt1pc", "don_hi_20"]) == 60
    assert A.lookback(["ema_abv_20"]) is None and A.lookback(["ema_abv_20&don_hi_20"]) is None


def test_arrival_order(spark, monkeypatch):
    monkeypatch.setattr(Q, "ARRIVAL_CHUNK", 7)
    rng = random.Random(5)
    rows, at = [], 0
    for k in range(200):
        at += rng.choice([1, 1, 1, 2, 0, -3, 5])
        rows.append((rng.choice("AB"), T0 + dt.timedelta(minutes=5 * at), k))
    df = spark.createDataFrame(rows, "symbol string, ts timestamp_ntz, arrival long").repartition(3)
    outage = spark.createDataFrame([(T0, T0 + dt.timedelta(hours=4), "down")], "start timestamp_ntz, end timestamp_ntz, reason string")
    got = {(r.symbol, r.arrival): (r.kind, r.missing, r.behind) for r in Q.classify_arrivals(df, outage, "5m").collect()}
    want, last, top = {}, {}, {}
    for s, ts, k in rows:
        if s in last:
            step = int((ts - last[s]).total_seconds())
            known = T0 <= last[s] + dt.timedelta(minutes=5) and max(ts - dt.timedelta(minutes=5), last[s] + dt.timedelta(minutes=5)) < T0 + dt.timedelta(hours=4)
            kind = "non_monotonic" if step < 0 else "duplicate" if step == 0 else "known_gap" if known else "gap"
            if step != 300:
                want[s, k] = (kind, max(1, step // 300 - 1) if step > 300 else 0, max(0, int((top[s] - ts).total_seconds())))
        last[s], top[s] = ts, max(top.get(s, ts), ts)
    assert got == want
    per = {r.symbol: r for r in Q.arrival_summary(df, outage, "5m").collect()}
    assert per["A"].non_monotonic == sum(v[0] == "non_monotonic" and k[0] == "A" for k, v in want.items()) > 0 and not per["A"].monotonic


def test_frame_diff(spark):
    left = spark.createDataFrame([("a", 1, 1.0, "x"), ("a", 2, None, "x"), ("a", 3, 3.0, "x"), ("b", 1, 1.0, None), ("b", 2, float("nan"), "z")], "g string, k int, v double, s string")
    right = spark.createDataFrame([("a", 1, 1.0 + 1e-12, "x"), ("a", 2, 2.0, "x"), ("a", 4, 3.0, "x"), ("b", 1, 1.0, None), ("b", 2, float("nan"), "z")], "g string, k int, v double, s string")
    diff = C.frame_diff(left, right, ["g"], ["k"])
    got = {r.g: r for r in diff.collect()}
    assert (got["a"].n, got["a"].same, got["a"].differs, got["a"].left_only, got["a"].right_only) == (4, 1, 1, 1, 1)
    assert got["a"]["first"].k == 2 and got["a"]["first"].columns == ["v"] and got["b"].same == 2 and got["b"]["first"] is None
    assert C.agree(diff.where("g = 'b'")).count() == 1
    with pytest.raises(Exception, match="frames differ"):
        C.agree(diff).collect()


def test_replayed_equity_points(spark, tmp_path):
    rows = [(a, T0 + dt.timedelta(hours=h), 1.0 * h, 10.0) for a in (1, 2) for h in range(20)]
    df = spark.createDataFrame(rows, "account long, ts timestamp_ntz, equity double, baseline double")
    for k in range(3):
        df.where(F.hour("ts") % 3 == k).unionByName(df.where("hour(ts) = 0")).coalesce(1).write.parquet(str(tmp_path / f"in/{k}"))
    stream = spark.readStream.schema(df.schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in/*"))
    out = live.drain(live.equity_snapshots(stream, "n", "2 days"))
    assert out.count() == 40 and out.select("account", "ts").distinct().count() == 40


def test_decisions_are_made_again_once(spark, tmp_path):
    path = str(tmp_path / "log")
    cols = "name string, seq long, tested_at timestamp_ntz, n_windows long, trades long, sharpe double, test_pnl double, sma_stack_oos_pnl double, gate string, ops_park boolean, qualified boolean, reasons array<string>, score double, attested boolean, requalified_at timestamp_ntz"
    row = lambda name, seq, **k: {**dict(name=name, seq=seq, tested_at=T0, n_windows=18, trades=40, sharpe=0.5, test_pnl=9.0, sma_stack_oos_pnl=1.0, gate="now", ops_park=False, qualified=False, reasons=["window veto"], score=None, attested=True, requalified_at=None), **k}
    rows = [row("a", 1), row("a", 2), row("b", 1, sharpe=0.1), row("c", 1, gate="old"), row("d", 1, attested=False), row("e", 1, ops_park=True), row("f", 1), row("f", 2, qualified=True), row("g", 1), row("h", 3, qualified=True), row("h", 4)]
    names = [c.split()[0] for c in cols.split(", ")]
    store.append_log(spark.createDataFrame([tuple(r[n] for n in names) for r in rows], cols), path, 0)
    taken = spark.createDataFrame([("g",)], "name string")
    assert AC.merge_requalified(spark, path, taken, "now", 18, "2024-05-01", 1) == 2
    again = sorted(map(str, store.read_log(spark, path).collect()))
    assert AC.merge_requalified(spark, path, taken, "now", 18, "2024-05-02", 2) == 0
    assert sorted(map(str, store.read_log(spark, path).collect())) == again and len(again) == len(rows) + 2
    flips = {(r.name, r.seq, r.qualified, r.score, len(r.reasons)) for r in store.read_log(spark, path).where("epoch = 1").collect()}
    assert flips == {("a", 2, True, 14.0, 0), ("h", 4, True, 14.0, 0)}


def test_account_tables(spark, tmp_path):
    path = str(tmp_path / "t")
    one = spark.range(3).select("id", *[F.lit(None).cast("string").alias(f.split()[0]) for f in store.TRADES.split(", ")[1:]])
    store.write_rows(one, path, "trades", 0)
    store.write_rows(one.where("id = 1").withColumn("symbol", F.lit("X")), path, "trades", 1)
    got = {r.id: r.symbol for r in store.read_rows(spark, path, "trades").collect()}
    assert got == {0: None, 1: "X", 2: None}

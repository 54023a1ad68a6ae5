"""Values of a fund against a walk over its dates."""

from __future__ import annotations

import datetime as dt
import random

import pytest

from pyspark.sql import functions as F

from barloom.functions import stats as S
from barloom.operators import portfolio as P
from barloom.operators import rebalance as RB

DAY = dt.date(2020, 1, 1)


def test_affine_scan_is_the_walk(spark):
    rng = random.Random(3)
    rows = [(DAY + dt.timedelta(days=3 * i), rng.uniform(0.9, 1.12), rng.choice([0.0, -2.0, 50.0])) for i in range(1500)]
    value, peak, want = 1000.0, 1000.0, []
    for d, a, b in rows:
        value = a * value + b
        peak = max(peak, value)
        want.append((d, value, peak))
    got = RB.affine_scan(spark.createDataFrame(rows, "date date, a double, b double").repartition(7), 1000.0).orderBy("date").collect()
    assert [r.date for r in got] == [w[0] for w in want]
    assert [r.nav for r in got] == pytest.approx([w[1] for w in want], rel=1e-9) and [r.peak for r in got] == pytest.approx([w[2] for w in want], rel=1e-9)


def test_a_ruined_fund_stays_at_zero(spark):
    rows = [(DAY + dt.timedelta(days=400 * i), a, 5.0) for i, a in enumerate((1.1, -0.2, 1.5, 2.0))]
    got = RB.affine_scan(spark.createDataFrame(rows, "date date, a double, b double"), 10.0).orderBy("date").collect()
    assert [round(r.nav, 9) for r in got] == [16.0, 0.0, 0.0, 0.0] and got[-1].peak == pytest.approx(16.0)


def test_cadences(spark):
    days = [(DAY + dt.timedelta(days=i),) for i in range(0, 100) if (DAY + dt.timedelta(days=i)).weekday() < 5 and i not in (30, 31)]
    df = spark.createDataFrame(days, "day date")
    month = {max(d for (d,) in days if (d.year, d.month) == k) for k in {(d.year, d.month) for (d,) in days}}
    week = {max(d for (d,) in days if d.isocalendar()[:2] == k) for k in {d.isocalendar()[:2] for (d,) in days}}
    assert {r.date for r in RB.rebalance_dates(df, "monthly").collect()} == month
    assert {r.date for r in RB.rebalance_dates(df, "weekly").collect()} == week
    assert RB.rebalance_dates(df, "daily").count() == len(days)
    with pytest.raises(ValueError):
        RB.rebalance_dates(df, "yearly")


def test_fund_against_a_book_of_holdings(spark):
    rng = random.Random(9)
    dates = [DAY + dt.timedelta(days=20 * i) for i in range(40)]
    prices = {}
    for t in "abcde":
        p = 50.0
        for i in range(-5, 800):
            p *= rng.uniform(0.97, 1.033)
            if rng.random() < 0.5 and not (t == "e" and i > 300) and not (t == "d" and i < 200):
                prices[t, DAY + dt.timedelta(days=i)] = p
    targets = {(d, t): rng.uniform(-0.1, 0.3) for d in dates for t in "abcde" if rng.random() < 0.9}
    flows = {dates[7]: 500.0, dates[20]: -300.0}
    last = lambda t, d: max((x for x in prices if x[0] == t and x[1] <= d), key=lambda x: x[1], default=None)
    cash, held, want = 10_000.0, {}, []
    for d in dates:
        marks = {t: (prices[last(t, d)], (d - last(t, d)[1]).days <= 10) for t in "abcde" if last(t, d)}
        value = cash + sum(q * marks[t][0] for t, q in held.items())
        orders, turnover = 0, 0.0
        for t, (m, fresh) in marks.items():
            goal = targets.get((d, t), 0.0) * value if fresh else 0.0
            trade = goal - held.get(t, 0.0) * m
            if abs(trade) > 1e-9 * value:
                orders, turnover = orders + 1, turnover + abs(trade)
            held[t], cash = goal / m, cash - trade
        cost = turnover * 0.002 + orders * 1.0
        after = value - cost + flows.get(d, 0.0)
        # what costs and flows change is spread over all holdings and cash
        scale = after / value
        held, cash = {t: q * scale for t, q in held.items()}, cash * scale
        want.append((d, orders, after))
    px = spark.createDataFrame([(t, d, c) for (t, d), c in prices.items()], "ticker string, day date, c double")
    grid = spark.createDataFrame([(d,) for d in dates], "date date")
    tg = spark.createDataFrame([(d, t, w) for (d, t), w in targets.items()], "date date, ticker string, weight double")
    bench = spark.createDataFrame([(d, 100.0 + i) for i, d in enumerate(dates)], "day date, c double")
    fl = spark.createDataFrame(list(flows.items()), "date date, flow double")
    path = RB.fund_path(tg, RB.grid_marks(px, grid, 10), bench, 10_000.0, 0.002, 1.0, fl)
    got = path.orderBy("date").collect()
    assert [(r.date, r.orders) for r in got] == [(d, n) for d, n, _ in want]
    assert [r.nav for r in got] == pytest.approx([v for _, _, v in want], rel=1e-9)
    assert got[-1].benchmark_nav == pytest.approx(13_900.0)
    m = RB.fund_metrics(path, 10_000.0, "monthly").first()
    assert m.n_cycles == 40 and m.total_return == pytest.approx(want[-1][2] / 10_000 - 1) and m.excess_return == pytest.approx(m.total_return - 0.39)


def test_nav_after_a_day_that_loses_all(spark):
    import datetime as dt
    import math

    day = [dt.date(2020, 1, k) for k in range(1, 5)]
    weights = spark.createDataFrame([(d, "a", 1.0) for d in day], "date date, ticker string, weight double")
    returns = spark.createDataFrame([(d, "a", r) for d, r in zip(day, (0.5, -0.5, -1.0, 0.5))], "date date, ticker string, ret double")
    got = P.nav(weights, returns).orderBy("date").select("nav", S.log_growth(F.col("nav")).alias("log_nav")).collect()
    assert [r.nav for r in got] == pytest.approx([1.5, 0.75, 0.0, 0.0])
    assert [r.log_nav for r in got[2:]] == [-math.inf, -math.inf]


def test_blend_and_limits_read_their_signals_once(spark, tmp_path):
    rows = [(DAY, f"t{k}", m, (k - 3) * v, False) for k in range(8) for m, v in (("a", 1.0), ("b", 0.5))]
    spark.createDataFrame(rows, "date date, ticker string, model string, value double, abstained boolean").write.parquet(str(tmp_path / "signals"))
    signals = spark.read.parquet(str(tmp_path / "signals"))
    weights = spark.createDataFrame([("a", 2.0), ("b", 1.0)], "model string, weight double")
    out = P.apply_limits(P.blend(signals, weights, 1.0, True), 0.2, 0.5)
    assert not [f for f in out.inputFiles() if "/signals/" in f]
    x = [(2 * (k - 3) + 0.5 * (k - 3)) / 3 for k in range(8)]
    c = [v - sum(x) / 8 for v in x]
    w = [max(-0.2, min(0.2, v / sum(map(abs, c)))) for v in c]
    got = {r.ticker: r.weight for r in out.collect()}
    assert [got[f"t{k}"] for k in range(8)] == pytest.approx([v * 0.5 / sum(map(abs, w)) for v in w])


def test_orders_deal_each_side_once(spark):
    targets = spark.createDataFrame([(DAY, "a", 0.5), (DAY, "b", 0.1), (DAY, "x", 0.1)], "date date, ticker string, weight double")
    held = spark.createDataFrame([(DAY, "b", 10), (DAY, "c", 4)], "date date, ticker string, shares int")
    # d has no target, no position and no price: it is not priced
    marks = spark.createDataFrame([(DAY, "a", 10.0), (DAY, "b", 10.0), (DAY, "c", 10.0), (DAY, "d", 0.0)], "date date, ticker string, mark double")
    keep = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        out = P.build_orders(targets, held, marks, F.lit(1000.0))
        assert out._jdf.queryExecution().executedPlan().toString().count("Exchange hashpartitioning") == 3
        assert sorted((r.ticker, r.side, r.quantity) for r in out.collect()) == [("a", "buy", 50), ("c", "sell", 4)]
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", keep)

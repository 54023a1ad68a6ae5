"""Normal distribution, deflated Sharpe locks, CSCV, tests on counts."""

from __future__ import annotations

import math
from statistics import NormalDist

import numpy as np
import pytest
from pyspark.sql import functions as F

from barloom.functions import stats as S
from barloom.operators import results as R

N = NormalDist()


def test_normal_pair(spark):
    xs = [-8.0, -3.5, -1.0, -0.1, 0.0, 0.3, 1.7, 4.0, 7.5]
    got = spark.createDataFrame([(x,) for x in xs], "x double").select("x", S.norm_cdf(F.col("x")).alias("p")).collect()
    for r in got:
        assert r["p"] == pytest.approx(N.cdf(r["x"]), rel=1e-9, abs=1e-13)
    ps = [1e-12, 1e-4, 0.02, 0.3, 0.5, 0.8, 0.999, 1 - 1e-9]
    for r in spark.createDataFrame([(p,) for p in ps], "p double").select("p", S.norm_ppf(F.col("p")).alias("z")).collect():
        assert r["z"] == pytest.approx(N.inv_cdf(r["p"]), rel=1e-12)


@pytest.mark.parametrize("trials, locked", [(2, 0.605934612902), (100, 0.040744699110)])
def test_deflated_sharpe_locks(spark, trials, locked):
    m = spark.createDataFrame([(0.05, 250, 0.0, 3.0)], "sharpe double, n long, skew double, kurtosis double")
    assert S.with_deflated_sharpe(m, F.lit(trials)).first()["dsr"] == pytest.approx(locked, abs=1e-9)


def _perf(spark, rows):
    data = [("k", b, f"c{j}", float(v)) for b, row in enumerate(rows) for j, v in enumerate(row)]
    return spark.createDataFrame(data, "key string, block long, ord string, value double")


def test_overfitting_probability_extremes(spark):
    steady = [[2.0 + 0.1 * k, 1.0 + 0.1 * k, 0.0 + 0.1 * k] for k in (0, 1, 0, 1)]
    assert S.overfitting_probability(_perf(spark, steady), ["key"]).first()["pbo"] == 0.0
    swapped = [[1.0, -1.0], [1.1, -1.1], [-1.0, 1.0], [-1.1, 1.1]]
    assert S.overfitting_probability(_perf(spark, swapped), ["key"]).first()["pbo"] >= 1 / 3


@pytest.mark.parametrize("blocks", [5, 6, 7])
def test_overfitting_probability_takes_all_even_blocks(spark, blocks):
    from itertools import combinations

    rng = np.random.default_rng(blocks)
    rows = rng.normal(size=(blocks, 4)).tolist()
    s = blocks - blocks % 2
    used, low = np.array(rows[:s]), 0
    halves = list(combinations(range(s), s // 2))
    for half in halves:
        inside, outside = used[list(half)], used[[b for b in range(s) if b not in half]]
        sharpe = lambda x: x.mean(axis=0) / x.std(axis=0, ddof=1)
        best = sharpe(inside).argmax()
        rank = (sharpe(outside) <= sharpe(outside)[best]).sum()
        low += rank / 5 <= 0.5
    got = S.overfitting_probability(_perf(spark, rows), ["key"]).first()
    assert got["splits"] == len(halves) and got["pbo"] == pytest.approx(low / len(halves))


@pytest.mark.parametrize("s", [2, 4, 6, 12])
def test_cscv_splits_are_all_halves(spark, s):
    sizes = spark.createDataFrame([("a", s), ("b", 0)], "key string, s int")
    got = [r.mask for r in S.cscv_splits(sizes, ["key"], s).collect()]
    assert sorted(got) == [m for m in range(2**s) if m.bit_count() == s // 2]


def test_cscv_of_twenty_blocks(spark):
    import itertools

    import numpy as np

    rng = np.random.default_rng(5)
    v = rng.normal(0.01, 1, (6, 20))
    rows = [("k", b, f"c{c}", float(v[c, b])) for c in range(6) for b in range(20)] + [("odd", b, f"c{c}", float(v[c, b])) for c in range(3) for b in range(5)]
    got = {r.key: r for r in S.overfitting_probability(spark.createDataFrame(rows, "key string, block int, ord string, value double"), ["key"]).collect()}
    inside = np.zeros((184_756, 20), bool)
    inside[np.arange(len(inside))[:, None], np.array(list(itertools.combinations(range(20), 10)))] = True

    def sharpe(mask):
        t, tt = mask @ v.T, mask @ (v.T**2)
        return np.round(t / 10 / np.sqrt((tt / 10 - (t / 10) ** 2) * 10 / 9), 9)

    ins, oos = sharpe(inside.astype(float)), sharpe((~inside).astype(float))
    win = oos[np.arange(len(oos)), ins.argmax(1)]
    assert got["k"].splits == 184_756 and got["odd"].splits == 6
    assert got["k"].pbo == pytest.approx(((oos <= win[:, None]).sum(1) / 7 <= 0.5).mean(), abs=1e-4)


def test_t_quantile_and_sign_test():
    import pandas as pd

    assert R.t_quantile_975(10) == pytest.approx(2.228138852, abs=1e-6)
    assert R.t_quantile_975(2) == pytest.approx(4.302652730, abs=1e-6)
    assert R._sign_test(pd.Series([8]), pd.Series([2]))[0] == pytest.approx(2 * 56 / 1024)
    assert R._sign_test(pd.Series([5]), pd.Series([5]))[0] == 1.0


def test_log_of_a_lost_book(spark):
    rows = spark.createDataFrame([(0, 1.0), (1, math.e), (2, 0.0), (3, -0.5)], "k int, f double")
    got = [r.g for r in rows.select("k", S.log_growth(F.col("f")).alias("g")).orderBy("k").collect()]
    assert got == [0.0, 1.0, -math.inf, None]


def test_book_columns_keep_a_lost_book(spark):
    from queries import books

    lost = spark.createDataFrame([(0.0,)], "final_equity double")
    text = next(c for c in books._cols(books.LN) if c.endswith("log_growth"))
    assert lost.selectExpr(text).first()[0] == -math.inf

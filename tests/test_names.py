"""Names: parsing, rules, families and candidates against small plain answers."""

from __future__ import annotations

from pyspark.sql import functions as F

from barloom.functions import atoms as A
from barloom.functions.sheet import Sheet
from barloom.operators import names as N
from barloom.operators import results as R
from barloom.operators import sampling as SP

import pytest


def frame(spark, names):
    return spark.createDataFrame([(n,) for n in names], "name string")


@pytest.fixture(scope="module")
def caps(spark):
    return spark.createDataFrame([], "lookback int, cap double")


def test_bound_reasons(spark):
    rows = N.atom_rows(frame(spark, ["rsi_14_>50&rsi_14_>60", "rsi_14_>70&rsi_14_<40", "rsi_14_>50&rsi_14_<80", "mom_6b_gt2pc"]))
    got = {r["name"]: r["bound_reason"] for r in N.bound_reasons(rows).collect()}
    assert got == {"rsi_14_>50&rsi_14_>60": "redundant_threshold", "rsi_14_>70&rsi_14_<40": "empty_band"}


def test_canonical_keeps_the_strictest(spark):
    got = {r["name"]: r["canonical"] for r in N.canonical_names(frame(spark, ["rsi_14_>60&rsi_14_>50", "sma_abv_50&mom_6b_gt2pc&odd", "rsi_14_>50_<90&rsi_14_<80"])).collect()}
    assert got["rsi_14_>60&rsi_14_>50"] == "rsi_14_>60"
    assert got["sma_abv_50&mom_6b_gt2pc&odd"] == "mom_6b_gt2pc&odd&sma_abv_50"
    assert got["rsi_14_>50_<90&rsi_14_<80"] == "rsi_14_<80&rsi_14_>50"


def test_block_order(spark, caps):
    names = ["mom_6b_gt15pc", "dip_24b_lt6pc", "mom_6b_gt5pc", "mom_6b_gt2pc", "h1_ema_abv_50&sma_abv_20"]
    got = {r["name"]: r["reason"] for r in N.block_reasons(frame(spark, names), caps).collect()}
    assert got == {"mom_6b_gt15pc": "dead_mom_threshold", "dip_24b_lt6pc": "dead_dip", "mom_6b_gt5pc": "unreachable_threshold",
                   "mom_6b_gt2pc": None, "h1_ema_abv_50&sma_abv_20": "filler_atom"}


def test_family_plan_equals_the_greedy_walk(spark):
    names = [f"sma_abv_{n}&mom_{k}b_gt2pc" for n in (100, 110, 125, 150, 180) for k in (6, 7, 12)] + ["rsi_14_>50", "rsi_16_>50", "rsi_14_>55"]
    ranked = spark.createDataFrame([(n, i + 1) for i, n in enumerate(names)], "name string, rank long")
    got = {r["name"]: r["winner"] for r in N.plan_families(ranked).collect()}

    def same_atoms(a, b):
        import re

        if [re.sub(r"\d+", "N", x) for x in a] != [re.sub(r"\d+", "N", x) for x in b]:
            return False
        for x, y in zip(a, b):
            for m, n in zip(re.finditer(r"([<>]?)(\d+)(pc)?", x), re.finditer(r"([<>]?)(\d+)(pc)?", y)):
                p, q = int(m[2]), int(n[2])
                if (m[1] or m[3]) and p != q:
                    return False
                if not (m[1] or m[3]) and abs(p - q) > 0.2 * max(p, q):
                    return False
        return True

    winners, want = [], {}
    for n in names:
        w = next((w for w in winners if same_atoms(sorted(w.split("&")), sorted(n.split("&")))), None)
        want[n] = w or n
        if w is None:
            winners.append(n)
    assert got == want


def test_neighbours_move_one_number(spark, caps):
    got = {r["neighbour"] for r in N.neighbour_names(frame(spark, ["sma_abv_100"]), caps).collect()}
    assert got == {"sma_abv_80", "sma_abv_90", "sma_abv_110", "sma_abv_120"}


def test_stack_keys(spark):
    got = frame(spark, ["h4_ema_abv_50&mom_6b_gt2pc", "don_hi_20&mom_6b_gt2pc", "sma_abv_50"]).select("name", R.stack_keys(F.col("name")).alias("k")).collect()
    keys = {r["name"]: list(r["k"]) for r in got}
    assert keys["h4_ema_abv_50&mom_6b_gt2pc"] == ["h4×mom", "h4_ema_abv_50×mom"]
    assert keys["don_hi_20&mom_6b_gt2pc"] == ["struct×mom", "don_hi×mom"]
    assert keys["sma_abv_50"] == ["other", "plain×flat"]


def test_expression_rules():
    s = Sheet()
    assert A.predicate(s, "nonsense_1") == "false"
    assert A.predicate(s, 5) == "false"
    with pytest.raises(ValueError):
        A.predicate(s, "mfi_14_>20")
    with pytest.raises(ValueError):
        A.predicate(s, "h1(sma_abv_20)")
    assert " AND " in A.predicate(s, "sma_abv_20&ema_abv_10") and " OR " in A.predicate(s, "sma_abv_20|ema_abv_10")


def test_close_only_table_is_refused(walk):
    with pytest.raises(ValueError):
        A.flags(walk.select("symbol", "day", "c"), ["don_hi_20"])


def test_sampling_repeats(spark):
    pool = ["mom_6b_gt2pc", "sma_abv_50", "rsi_14_<40", "don_hi_20", "ema_abv_20", "vol_lowsm_10_30"]
    a = SP.random_stacks(spark, pool, 200, 3)
    b = SP.random_stacks(spark.newSession(), pool, 200, 3)
    assert a.orderBy("index").collect() == b.orderBy("index").collect()
    assert a.where(F.size(F.split("name", "&")) != F.col("depth")).isEmpty()
    assert SP.split_counts(16, 0.25, 0.5) == (4, 6, 6)


def test_ridge_small_system(spark):
    rows = spark.createDataFrame([("a&b", 3.0), ("a", 1.0), ("b", 2.0), ("c", 0.0)], "name string, target double")
    import numpy as np

    x = np.array([[1, 1, 1, 0], [1, 1, 0, 0], [1, 0, 1, 0], [1, 0, 0, 1]], float)
    y = np.array([3.0, 1.0, 2.0, 0.0])
    want = np.linalg.solve(x.T @ x + np.diag([0, 25, 25, 25]), x.T @ y)
    got = {r["atom"]: r["coef"] for r in R.ridge_coefficients(rows).collect()}
    assert [got[k] for k in "abc"] == pytest.approx(want[1:])


def test_ridge_keeps_every_atom(spark):
    rows = spark.createDataFrame([(f"mom_{k}b_gt2pc&dip_{k + 1}b_lt3pc", float(k % 7)) for k in range(1, 520)], "name string, target double")
    atoms = {a for k in range(1, 520) for a in (f"mom_{k}b_gt2pc", f"dip_{k + 1}b_lt3pc")}
    assert {r["atom"] for r in R.ridge_coefficients(rows).collect()} == atoms

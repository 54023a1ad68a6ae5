"""Ridge by conjugate gradients, exact sign tests and reason keys against plain computations."""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from barloom.operators import results as R


def solved(rows, lam):
    atoms = sorted({a for n, _ in rows for a in n.split("&")})
    x = np.zeros((len(rows), len(atoms) + 1))
    x[:, 0] = 1
    for i, (n, _) in enumerate(rows):
        for a in n.split("&"):
            x[i, 1 + atoms.index(a)] = 1
    m = x.T @ x + lam * np.diag([0.0] + [1.0] * len(atoms))
    beta = np.linalg.solve(m, x.T @ np.array([t for _, t in rows]))
    return dict(zip(atoms, beta[1:]))


def test_ridge_of_five_thousand_atoms(spark):
    rng = np.random.default_rng(2)
    rows = [("&".join(sorted({f"a{k}" for k in rng.integers(0, 5000, rng.integers(1, 5))} | {f"a{i % 5000}"})), float(rng.normal(3, 10))) for i in range(12_000)]
    want = solved(rows, R.RIDGE)
    df = spark.createDataFrame([*rows, ("a1", None)], "name string, target double")
    got = {r.atom: r.coef for r in R.ridge_coefficients(df).collect()}
    assert len(want) == 5000 and got.keys() == want.keys()
    assert max(abs(got[a] - want[a]) for a in want) < 1e-7


def test_ridge_of_few_rows(spark):
    df = spark.createDataFrame([("a&b", 1.0)], "name string, target double")
    assert R.ridge_coefficients(df).count() == R.ridge_coefficients(df.limit(0)).count() == 0
    rows = [("a", 2.0), ("a&b", 2.0), ("b", 2.0)]
    got = {r.atom: r.coef for r in R.ridge_coefficients(spark.createDataFrame(rows, "name string, target double")).collect()}
    assert got == pytest.approx({"a": 0, "b": 0}, abs=1e-9)


def test_sign_test_has_one_form_at_every_size():
    def whole(p, q):
        n, k = p + q, min(p, q)
        return 1.0 if p == q else min(1.0, 2 * sum(math.comb(n, i) for i in range(k + 1)) / 2**n)

    cases = [(0, 1), (1, 0), (3, 5), (5, 5), (600, 500), (1030, 1010), (3000, 2800), (40, 900)]
    got = R._sign_test(pd.Series([p for p, _ in cases]), pd.Series([q for _, q in cases]))
    assert list(got) == pytest.approx([whole(*c) for c in cases], rel=1e-9)
    assert R._sign_test(pd.Series([0, 10**9]), pd.Series([0, 10**9 - 100_000]))[0] != 0


def test_reason_keys(spark):
    want = {
        "windows 3 != expected 18": "windows", "oos_trades 3 < 30": "trades", "oos_sharpe 0.1 < 0.3": "sharpe", "sma_stack missing": "baseline",
        "oos_pnl 1.00 <= sma_stack 2.00": "baseline", "oos_pnl 1.00 < 0": "profit", "oos_pnl 1 <= buy-and-hold 2": "bh_legacy", "holdout_pnl 1 <= sma_stack 2": "holdout",
        " DSR 0.1 < 0.95": "dsr", "pbo undefined": "pbo", "neighbours 1/4 = 25% < 50%": "perturb", "no parameter neighbours (lone spike)": "perturb",
        "cost stress sharpe 0.1 < 0.3": "cost", "bh_pnl": "bh_legacy", "below B&H": "bh_legacy", "parked": "ops", "": "ops",
    }
    df = spark.createDataFrame([(k,) for k in want], "r string")
    assert {r.r: r.k for r in df.select("r", R.classify_reason(F.col("r")).alias("k")).collect()} == want


def test_lifts_read_the_log_once(spark, tmp_path):
    rows = [(n, p, 0.0, 0.5, 10) for n, p in (("mom_6b_gt2pc", 1.0), ("mom_6b_gt2pc&sma_abv_50", 3.0), ("sma_abv_50", 2.0))]
    spark.createDataFrame(rows, "name string, test_pnl double, bh_oos_pnl double, sharpe double, trades long").write.parquet(str(tmp_path / "log"))
    out = R.estimate_lifts(spark.read.parquet(str(tmp_path / "log")))
    assert not [f for f in out.inputFiles() if "/log/" in f]
    assert {r.atom: (r.name_count, r.support) for r in out.collect()} == {"mom_6b_gt2pc": (2, 1), "sma_abv_50": (2, 1)}

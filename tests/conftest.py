from __future__ import annotations

import sys
from pathlib import Path

import pytest

ROOT = Path(__file__).resolve().parents[1]
sys.path.insert(0, str(ROOT))

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def spark():
    from barloom.session import local_session

    session = local_session(4, "tests")
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()


@pytest.fixture(scope="session")
def sf():
    return SF


@pytest.fixture(scope="session")
def walk(spark):
    """640 seeded days of a random walk for two symbols, open = prior close."""
    import datetime as dt

    import numpy as np

    rows = []
    for name, seed in (("A", 19), ("B", 23)):
        rng = np.random.default_rng(seed)
        close = 100 * np.exp(np.cumsum(rng.normal(0, 0.02, 640)))
        open_ = np.concatenate(([100.0], close[:-1]))
        high = np.maximum(open_, close) * (1 + rng.uniform(0, 0.01, 640))
        low = np.minimum(open_, close) * (1 - rng.uniform(0, 0.01, 640))
        for k in range(640):
            rows.append((name, dt.date(2018, 1, 1) + dt.timedelta(days=k), float(open_[k]), float(high[k]), float(low[k]), float(close[k]), 1.0))
    return spark.createDataFrame(rows, "symbol string, day date, o double, h double, l double, c double, v double")

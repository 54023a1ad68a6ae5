"""Catalog shape, causality and warm-up of every rule."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import functions as F

from barloom.plans import library
from barloom.plans.rules import RULES, variant_name

CUT = dt.date(2019, 6, 1)


def test_catalog_size():
    assert len(RULES) == 251
    names = {variant_name(k, p) for k, r in RULES.items() for p in r.configs()}
    assert len(names) == 988


def test_variant_names():
    r = RULES["sma200"]
    assert variant_name("sma200", r.center) == "lib.sma200"
    assert variant_name("sma200", {"short": 1, "long": 150}) == "lib.sma200.1_150"


def test_every_rule_is_causal(spark, walk):
    """Changing later days never changes an earlier signal."""
    factor = F.when((F.col("day") > F.lit(CUT)), 1.37).otherwise(1.0)
    other = walk.select("symbol", "day", *[(F.col(x) * factor).alias(x) for x in ("o", "h", "l", "c")], "v")
    # Only masks that look at the whole tape by definition may move: readiness of period rules.
    keys = list(RULES)
    for at in range(0, len(keys), 84):
        group = keys[at : at + 84]
        a = library.signals(walk, group, grid=False).where(F.col("day") <= F.lit(CUT)).select("symbol", "day", "config", "signal")
        b = library.signals(other, group, grid=False).where(F.col("day") <= F.lit(CUT)).select("symbol", "day", "config", "signal")
        assert a.exceptAll(b).isEmpty()


def test_warm_ups_end(spark, walk):
    start = library.score_start(library.signals(walk, ["sma200", "hi52", "rsi14", "wkswing"], grid=False))
    for row in start.collect():
        assert row["score_t"] == 252 and row["unwarmed_configs"] == 0


def test_grid_and_neighbours(spark):
    grid = library.grid_frame(spark)
    assert library.trial_count(grid).first()["n_trials"] == 988
    assert library.claim_names(grid).count() == 251
    nb = library.neighbours(grid.where("rule = 'turtle20'"))
    assert nb.where("config = 'lib.turtle20'").count() == 4
    bad = library.parse_variant(spark.createDataFrame([("lib.sma200.1_200",)], "config string"), grid).first()
    assert bad["rule"] is None
    assert library.manifest(grid).where("rule = 'macd'").first()["center_params"] == {"fast": 12, "slow": 26, "signal": 9}


def test_log_returns_are_those_of_sql(spark):
    """To the last bit: estimates of equal windows tie up to rounding, and the hampel rule compares them."""
    import random

    import duckdb

    from barloom.functions import indicators
    from barloom.functions.sheet import Sheet
    from oracle import sheet_sql

    rng = random.Random(5)
    rows = [("a", dt.date(2000, 1, 1) + dt.timedelta(days=i), rng.choice([0.0, -1.0]) if i % 97 == 96 else rng.uniform(20, 90_000)) for i in range(2000)]
    bars = spark.createDataFrame(rows, "symbol string, day date, c double")
    s = Sheet()
    r = indicators.log_return(s)
    got = {x.day: x[r] for x in s.run(bars).collect()}
    con = duckdb.connect()
    con.execute("CREATE TABLE given (symbol VARCHAR, day DATE, c DOUBLE)")
    con.executemany("INSERT INTO given VALUES (?, ?, ?)", rows)
    head, last = sheet_sql.with_clause(s, "SELECT * FROM given")
    assert got == dict(con.execute(f"{head} SELECT day, {r} FROM {last}").fetchall())

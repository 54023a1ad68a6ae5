"""Market regime: six component scores and their composite.

Components read daily closes (symbol, day, c); each keeps the newest day.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from barloom.functions import indicators as ind
from barloom.functions.sheet import Sheet, rows

# Fixed values.
WEIGHTS = {"trend": 0.25, "breadth": 0.20, "dominance": 0.15, "funding": 0.15, "drawdown": 0.15, "thrust": 0.10}
ZONES = ((80, "RISK_ON"), (40, "NEUTRAL"), (0, "RISK_OFF"))
ALLOWED = ("RISK_ON", "NEUTRAL")
MIN_COMPONENTS, MIN_WEIGHT, MIN_UNIVERSE, FLAT = 4, 0.65, 5, 1e-12


def _clamp(x: Column) -> Column:
    return F.greatest(F.lit(0), F.least(F.lit(100), x))


def _newest(df: DataFrame, day: str = "day") -> DataFrame:
    rest = [c for c in df.columns if c != "symbol"]
    return df.groupBy("symbol").agg(F.max_by(F.struct(*rest), day).alias("r")).select("symbol", "r.*")


def _steps(x: Column, edges: list[tuple[float, int]], last: int, ge: bool = True) -> Column:
    out = None
    for edge, score in edges:
        test = x >= edge if ge else x <= edge
        out = F.when(test, score) if out is None else out.when(test, score)
    return out.otherwise(last)


def trend(bars: DataFrame) -> DataFrame:
    """Price against the 50- and 200-day averages, and the long slope."""
    s = Sheet()
    m50, m200 = ind.sma(s, "c", 50), ind.sma(s, "c", 200)
    old = ind.prev(s, m200, 20)
    last = _newest(s.run(bars).selectExpr("symbol", "day", f"{s.t} AS t", "c", f"{m50} AS ma50", f"{m200} AS ma200", f"{old} AS ma200_old"))
    near = lambda a, b: F.abs(a - b) <= FLAT * F.greatest(F.abs(a), F.abs(b))
    c, a, b, o = (F.col(x) for x in ("c", "ma50", "ma200", "ma200_old"))
    way = F.when(near(b, o), "flat").when(b > o, "rising").otherwise("falling")
    base = (
        F.when(near(c, b) & near(a, b), 50)
        .when((c > a) & (a > b), 90)
        .when((c > b) & (c <= a) & (a > b), 65)
        .when((c <= b) & (c <= a) & (a > b), 55)
        .when((c > a) & (a <= b), 45)
        .otherwise(15)
    )
    ready = F.col("t") >= 219
    score = _clamp(base + F.when(way == "rising", 10).when(way == "falling", -10).otherwise(0))
    return last.select("symbol", F.when(ready, score).otherwise(50).alias("score"), ready.alias("available"), way.alias("direction"))


def drawdown(bars: DataFrame) -> DataFrame:
    """Drawdown from the one-year high, and where 30-day volatility sits in its year (weekly samples)."""
    s = Sheet()
    r = s.put("ln(c) - ln(lag(c) OVER (PARTITION BY symbol ORDER BY day))")
    vol = s.put(f"CASE WHEN {s.t} >= 29 THEN stddev_samp({r}) {rows(29)} * {math.sqrt(365)!r} END")
    top = s.put(f"max(c) {rows(365)}")
    n = s.put("count(*) OVER (PARTITION BY symbol)")
    full = s.run(bars).selectExpr("symbol", "day", f"{s.t} AS t", "c", f"{vol} AS vol", f"{top} AS top", f"{n} AS n")
    last = full.where("t = n - 1").select("symbol", F.col("vol").alias("now"), (1 - F.col("c") / F.col("top")).alias("dd"), "n")
    # Position inside the year's window: weekly samples start at its 30th row.
    pos = F.col("t") - (F.col("n") - 365)
    samples = full.where((pos >= 30) & ((pos - 30) % 7 == 0)).select("symbol", "vol")
    share = samples.join(last, "symbol").groupBy("symbol", "now", "dd", "n").agg(F.avg((F.col("vol") <= F.col("now")).cast("double")).alias("pctile"))
    base = _steps(F.col("dd"), [(0.10, 90), (0.20, 75), (0.35, 55), (0.50, 35), (0.65, 20)], 10, ge=False)
    p = F.col("pctile")
    score = base + F.when(p <= 1 / 3, 10).when(p >= 2 / 3, -10).otherwise(0)
    score = F.when((F.col("dd") > 0.65) & (p >= 2 / 3), F.greatest(score, F.lit(15))).otherwise(score)
    ready = F.col("n") >= 365
    return share.select("symbol", F.when(ready, _clamp(score)).otherwise(50).alias("score"), ready.alias("available"), "dd", F.round("pctile", 4).alias("pctile"))


def breadth(bars: DataFrame) -> DataFrame:
    """Share of series above their 200- and 50-day averages."""
    s = Sheet()
    a, b = ind.sma(s, "c", 200), ind.sma(s, "c", 50)
    last = _newest(s.run(bars).selectExpr("symbol", "day", f"c > {a} AS up200", f"c > {b} AS up50")).where("up200 IS NOT NULL")
    agg = last.agg(
        F.count(F.lit(1)).alias("universe"), (F.avg(F.col("up200").cast("double")) * 100).alias("pct_200"), (F.avg(F.col("up50").cast("double")) * 100).alias("pct_50")
    )
    base = _steps(F.col("pct_200"), [(80, 95), (65, 80), (50, 65), (35, 45), (20, 25)], 10)
    lead = F.when(F.col("pct_50") >= F.col("pct_200") + 15, 5).when(F.col("pct_50") <= F.col("pct_200") - 15, -5).otherwise(0)
    ready = F.col("universe") >= MIN_UNIVERSE
    return agg.select(F.when(ready, _clamp(base + lead)).otherwise(50).alias("score"), ready.alias("available"), "universe", "pct_200", "pct_50")


def thrust(bars: DataFrame) -> DataFrame:
    """Share of series up over 30 days."""
    s = Sheet()
    old = ind.prev(s, "c", 30)
    last = _newest(s.run(bars).selectExpr("symbol", "day", f"c > {old} AS up")).where("up IS NOT NULL")
    agg = last.agg(F.count(F.lit(1)).alias("universe"), (F.avg(F.col("up").cast("double")) * 100).alias("pct"))
    ready = F.col("universe") >= MIN_UNIVERSE
    score = _steps(F.col("pct"), [(85, 90), (65, 75), (45, 55), (25, 35), (10, 20)], 35)
    return agg.select(F.when(ready, score).otherwise(50).alias("score"), ready.alias("available"), "universe", "pct")


def dominance(series: DataFrame, trend_up: Column) -> DataFrame:
    """30-day change of a share series against the trend's direction; ``series`` is (day, share)."""
    n = series.select(F.lit("all").alias("symbol"), "day", F.col("share").alias("c"))
    s = Sheet()
    old = ind.prev(s, "c", 30)
    last = _newest(s.run(n).selectExpr("symbol", "day", "c", f"{old} AS old"))
    d = F.col("c") - F.col("old")
    way = F.when(d > 0.5, "rising").when(d < -0.5, "falling").otherwise("flat")
    up = F.when(way == "falling", 90).when(way == "rising", 65).otherwise(75) - F.when(F.col("c") <= 40, 5).otherwise(0)
    down = F.when(way == "rising", 30).when(way == "falling", 10).otherwise(25) + F.when(F.col("c") >= 62, 5).otherwise(0)
    ready = F.col("old").isNotNull()
    return last.select(F.when(ready, _clamp(F.when(trend_up, up).otherwise(down))).otherwise(50).alias("score"), ready.alias("available"), way.alias("direction"))


def funding(rates: DataFrame) -> DataFrame:
    """Mean of the latest rates; a rate beyond one voids the component."""
    agg = rates.where("rate IS NOT NULL").agg(
        F.avg("rate").alias("avg"), F.count(F.lit(1)).alias("n"), F.bool_or((F.abs("rate") > 1) | F.isnan("rate")).alias("bad")
    )
    a = F.col("avg")
    score = F.when(a <= -0.0001, 80).when(a < 0, 65).when(a <= 0.0001, 75).when(a <= 0.0003, 55).when(a <= 0.0006, 30).otherwise(10)
    ready = (F.col("n") >= 2) & ~F.coalesce(F.col("bad"), F.lit(False))
    return agg.select(F.when(ready, score).otherwise(50).alias("score"), ready.alias("available"), "avg")


def composite(components: DataFrame) -> DataFrame:
    """Weighted mean of available (component, score, available) rows, its zone, and the gate."""
    weight = F.create_map(*[F.lit(x) for kv in WEIGHTS.items() for x in kv])[F.col("component")]
    ok = F.col("available")
    agg = components.withColumn("_w", F.when(ok, weight)).agg(
        F.count_if(ok).alias("components"), F.sum("_w").alias("weight"), (F.sum(F.col("_w") * F.col("score")) / F.sum("_w")).alias("_s")
    )
    known = (F.col("components") >= MIN_COMPONENTS) & (F.col("weight") >= MIN_WEIGHT - 1e-12)
    score = F.when(known, F.round(_clamp(F.col("_s")), 1))
    zone = F.when(~known | score.isNull(), "UNKNOWN").when(score >= ZONES[0][0], ZONES[0][1]).when(score >= ZONES[1][0], ZONES[1][1]).otherwise(ZONES[2][1])
    return agg.select("components", F.round("weight", 4).alias("weight"), score.alias("score"), zone.alias("zone"), F.coalesce(zone.isin(*ALLOWED), F.lit(False)).alias("allowed"))


def checked_snapshot(series: DataFrame) -> DataFrame:
    """Snapshot closes (symbol, closes array) as rows; a non-positive or missing close fails the job."""
    rows_ = series.select("symbol", F.posexplode("closes").alias("pos", "c"))
    ok = F.assert_true((F.col("c") > 0) & ~F.isnan("c"), F.lit("snapshot close must be positive"))
    return rows_.where(ok.isNull())

"""Bars, alignment, splits, gaps and coverage over the event stream."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from barloom.operators import bars as B
from barloom.operators import quality as Q
from barloom.operators import windows as WN
from barloom.sources import tables
from queries.registry import TICKS, bars_cte, query


def bars(spark, sf, tf):
    return B.bars_from_ticks(tables.ticks(spark, sf), tf)


def rounded(df, *cols, digits=6):
    return df.select(*[F.round(c, digits).alias(c) if c in cols else F.col(c) for c in df.columns])


@query("bars_hourly_resample", f"WITH {bars_cte(3600)} SELECT * FROM bars")
def _hourly(spark, sf):
    return bars(spark, sf, "1h")


_TIED = TICKS.replace("event_type AS symbol, ts,", "event_type AS symbol, date_trunc('hour', ts) AS ts,")


@query(
    "bars_tick_ties",
    f"""WITH {_TIED} SELECT symbol, time_bucket(INTERVAL 4 HOUR, ts, TIMESTAMP '1970-01-01') AS ts, first(price ORDER BY ts, event_id) AS o,
  max(price) AS h, min(price) AS l, last(price ORDER BY ts, event_id) AS c, sum(v) AS v FROM ticks GROUP BY 1, 2""",
)
def _ties(spark, sf):
    """Many ticks share a time, so their whole ids decide opens and closes."""
    ticks = tables.ticks(spark, sf)
    return B.bars_from_ticks(ticks.withColumn("ts", F.date_trunc("hour", "ts").cast(ticks.schema["ts"].dataType)), "4h")


@query(
    "bars_resample_bars_to_4h",
    f"""WITH {bars_cte(300)} SELECT symbol, time_bucket(INTERVAL 4 HOUR, ts, TIMESTAMP '1970-01-01') AS ts,
  arg_min(o, ts) AS o, max(h) AS h, min(l) AS l, arg_max(c, ts) AS c, sum(v) AS v FROM bars GROUP BY 1, 2""",
)
def _four_hours(spark, sf):
    return B.resample(bars(spark, sf, "5m"), "4h")


AS_OF = "2024-01-20 13:25:00"


@query(
    "bars_causal_resample",
    f"""WITH {bars_cte(300)}, seen AS (SELECT * FROM bars WHERE ts <= TIMESTAMP '{AS_OF}'), up AS (
SELECT symbol, time_bucket(INTERVAL 1 HOUR, ts, TIMESTAMP '1970-01-01') AS ts,
  arg_min(o, ts) AS o, max(h) AS h, min(l) AS l, arg_max(c, ts) AS c, sum(v) AS v FROM seen GROUP BY 1, 2)
SELECT * FROM up WHERE ts + INTERVAL 55 MINUTE <= TIMESTAMP '{AS_OF}'""",
)
def _causal(spark, sf):
    return B.causal_resample(bars(spark, sf, "5m"), "1h", AS_OF)


@query(
    "bars_multi_timeframe",
    f"""WITH {bars_cte(300)}, tfs AS (SELECT * FROM (VALUES ('15m', 900), ('1h', 3600), ('4h', 14400), ('1d', 86400)) t(tf, n)),
p AS (SELECT symbol, tf, TIMESTAMP '1970-01-01' + to_seconds(CAST(floor(epoch(ts)) AS BIGINT) - CAST(floor(epoch(ts)) AS BIGINT) % n) AS b0, b.*
  FROM (SELECT ts AS t2, * FROM bars) b, tfs)
SELECT symbol, tf, b0 AS ts, arg_min(o, t2) AS o, max(h) AS h, min(l) AS l, arg_max(c, t2) AS c,
  round(sum(abs(h - l) + 1), 4) AS v FROM (SELECT symbol, tf, b0, t2, o, h, l, c FROM p) GROUP BY 1, 2, 3""",
)
def _multi(spark, sf):
    return rounded(B.multi_timeframe(bars(spark, sf, "5m").drop("v")), "v", digits=4)


@query(
    "bars_completed_days",
    f"""WITH {bars_cte(300)}, d AS (SELECT symbol, CAST(ts AS DATE) AS day, arg_min(o, ts) AS o, max(h) AS h, min(l) AS l,
  arg_max(c, ts) AS c, sum(v) AS v FROM bars GROUP BY 1, 2)
SELECT * FROM d QUALIFY day < max(day) OVER (PARTITION BY symbol)""",
)
def _days(spark, sf):
    return B.daily_bars(bars(spark, sf, "5m"))


@query(
    "bars_aligned_history",
    f"""WITH {bars_cte(900)}, up AS (SELECT symbol, time_bucket(INTERVAL 4 HOUR, ts, TIMESTAMP '1970-01-01') AS htf_ts,
  arg_max(c, ts) AS htf_c FROM bars GROUP BY 1, 2)
SELECT b.symbol, b.ts, b.c, u.htf_ts, u.htf_c FROM bars b ASOF LEFT JOIN
  (SELECT symbol, htf_ts + INTERVAL 225 MINUTE AS at, htf_ts, htf_c FROM up) u ON b.symbol = u.symbol AND b.ts >= u.at""",
)
def _aligned(spark, sf):
    return B.aligned_history(bars(spark, sf, "15m"), "4h", "15m")


@query(
    "bars_keep_latest_upsert",
    """WITH r AS (SELECT o_custkey AS k, o_orderkey AS seq, o_totalprice AS price, o_orderstatus AS status FROM orders)
SELECT k, seq, price, status FROM r QUALIFY row_number() OVER (PARTITION BY k ORDER BY seq DESC) = 1""",
)
def _latest(spark, sf):
    rows = tables.table(spark, sf, "orders").select(
        F.col("o_custkey").alias("k"), F.col("o_orderkey").alias("seq"),
        F.col("o_totalprice").alias("price"), F.col("o_orderstatus").alias("status"),
    )
    return B.keep_latest(rows, ["k"], "seq")


@query(
    "bars_row_index_split",
    f"""WITH {TICKS}, n AS (SELECT symbol, ts, price, row_number() OVER (PARTITION BY symbol ORDER BY ts, event_id) - 1 AS rn,
  count(*) OVER (PARTITION BY symbol) AS rows_total FROM ticks)
SELECT symbol, ts, price, rn, CASE WHEN rn < floor(rows_total * 0.7) THEN 'fit'
  WHEN rn < floor(rows_total * (CAST(0.7 AS DOUBLE) + CAST(0.15 AS DOUBLE))) THEN 'valid' ELSE 'test' END AS part FROM n""",
)
def _split(spark, sf):
    out = B.split_label(tables.ticks(spark, sf), order="ts", tie="event_id")
    return out.select("symbol", "ts", "price", "rn", "part")


@query(
    "bars_downsample",
    f"""WITH {TICKS} SELECT symbol, ts, price FROM ticks
QUALIFY (row_number() OVER (PARTITION BY symbol ORDER BY ts, event_id) - 1) % 6 = 0""",
)
def _downsample(spark, sf):
    return B.downsample(tables.ticks(spark, sf), 6, order="ts", tie="event_id").select("symbol", "ts", "price")


@query(
    "bars_newest_rows",
    f"WITH {bars_cte(300)} SELECT * FROM bars QUALIFY row_number() OVER (PARTITION BY symbol ORDER BY ts DESC) <= 50",
)
def _tail(spark, sf):
    return B.newest_rows(bars(spark, sf, "5m"), 50)


@query(
    "bars_bounds",
    f"WITH {bars_cte(300)} SELECT symbol, count(*) AS n, min(ts) AS first_ts, max(ts) AS last_ts FROM bars GROUP BY 1",
)
def _bounds(spark, sf):
    return Q.bounds(bars(spark, sf, "5m"))


@query(
    "bars_index_of",
    f"WITH {bars_cte(3600)} SELECT symbol, count(*) FILTER (ts < TIMESTAMP '2024-01-15') AS at FROM bars GROUP BY 1",
)
def _index_of(spark, sf):
    return B.index_of(bars(spark, sf, "1h"), "2024-01-15", "ts")


@query(
    "bars_gap_edges",
    f"""WITH {bars_cte(3600)}, s AS (SELECT symbol, lag(ts) OVER (PARTITION BY symbol ORDER BY ts) AS prev_ts, ts AS next_ts FROM bars)
SELECT * FROM s WHERE prev_ts IS NOT NULL AND next_ts - prev_ts <> INTERVAL 1 HOUR""",
)
def _gaps(spark, sf):
    return Q.gap_edges(bars(spark, sf, "1h"), "1h")


def _outages(ticks):
    """Sunday mornings of the data stand in for the documented outage list."""
    days = ticks.select(F.to_date("ts").alias("d")).distinct().where("weekday(d) = 6")
    return days.select(
        F.col("d").cast("timestamp_ntz").alias("start"),
        (F.col("d").cast("timestamp_ntz") + F.expr("INTERVAL 12 HOURS")).alias("end"),
        F.concat(F.lit("maintenance "), F.col("d").cast("string")).alias("reason"),
    )


_OUTAGES = """outages AS (SELECT CAST(d AS TIMESTAMP) AS s, CAST(d AS TIMESTAMP) + INTERVAL 12 HOUR AS e,
  'maintenance ' || CAST(d AS VARCHAR) AS reason FROM (SELECT DISTINCT CAST(ts AS DATE) AS d FROM ticks) WHERE isodow(d) = 7)"""
_STEPS = f"""{bars_cte(3600)}, {_OUTAGES},
g AS (SELECT * FROM (SELECT symbol, lag(ts) OVER (PARTITION BY symbol ORDER BY ts) AS prev_ts, ts AS next_ts FROM bars)
  WHERE prev_ts IS NOT NULL AND next_ts - prev_ts <> INTERVAL 1 HOUR),
steps AS (SELECT g.symbol, prev_ts, next_ts, arg_min(o.reason, o.s) AS reason FROM g LEFT JOIN outages o
  ON prev_ts + INTERVAL 1 HOUR < o.e AND prev_ts + INTERVAL 2 HOUR > o.s
  AND greatest(next_ts - INTERVAL 1 HOUR, prev_ts + INTERVAL 1 HOUR) < o.e
  AND greatest(next_ts - INTERVAL 1 HOUR, prev_ts + INTERVAL 1 HOUR) + INTERVAL 1 HOUR > o.s GROUP BY 1, 2, 3)"""


@query(
    "bars_gap_classes",
    f"""WITH {_STEPS} SELECT *, CASE WHEN reason IS NOT NULL THEN 'known_gap' ELSE 'gap' END AS kind,
  CAST(greatest(1, floor(epoch(next_ts - prev_ts) / 3600) - 1) AS BIGINT) AS missing FROM steps""",
)
def _classes(spark, sf):
    t = tables.ticks(spark, sf)
    return Q.classify_steps(B.bars_from_ticks(t, "1h"), _outages(t), "1h")


@query(
    "bars_quality_rollup",
    f"""WITH {_STEPS}, p AS (SELECT b.symbol, max(b.ts) AS last_ts FROM bars b GROUP BY 1),
q AS (SELECT p.symbol, last_ts, count(s.symbol) FILTER (s.reason IS NULL) AS gap_count,
  count(s.symbol) FILTER (s.reason IS NOT NULL) AS known_gap_count FROM p LEFT JOIN steps s ON s.symbol = p.symbol GROUP BY 1, 2)
SELECT coalesce(symbol, '(all)') AS symbol, CAST(sum(gap_count) AS BIGINT) AS gap_count,
  CAST(sum(known_gap_count) AS BIGINT) AS known_gap_count, CAST(0 AS BIGINT) AS duplicates, TRUE AS monotonic,
  min(last_ts) AS last_ts FROM q GROUP BY ROLLUP (symbol)""",
)
def _quality(spark, sf):
    t = tables.ticks(spark, sf)
    return Q.quality_summary(B.bars_from_ticks(t, "1h"), _outages(t), "1h")


_ARRIVED = f"""{TICKS}, {_OUTAGES},
r AS (SELECT symbol, event_id AS arrival, date_trunc('hour', ts) AS ts FROM ticks),
p AS (SELECT symbol, arrival, lag(ts) OVER w AS prev_ts, ts AS next_ts, max(ts) OVER (PARTITION BY symbol ORDER BY arrival ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS high FROM r WINDOW w AS (PARTITION BY symbol ORDER BY arrival)),
i AS (SELECT *, epoch(next_ts - prev_ts) AS d FROM p WHERE prev_ts IS NOT NULL AND next_ts - prev_ts <> INTERVAL 1 HOUR),
cl AS (SELECT i.symbol, arrival, prev_ts, next_ts, d, high, CASE WHEN d > 3600 THEN arg_min(o.reason, o.s) END AS reason FROM i LEFT JOIN outages o ON prev_ts + INTERVAL 1 HOUR < o.e AND prev_ts + INTERVAL 2 HOUR > o.s
  AND greatest(next_ts - INTERVAL 1 HOUR, prev_ts + INTERVAL 1 HOUR) < o.e AND greatest(next_ts - INTERVAL 1 HOUR, prev_ts + INTERVAL 1 HOUR) + INTERVAL 1 HOUR > o.s GROUP BY i.symbol, arrival, prev_ts, next_ts, d, high),
ac AS (SELECT *, CASE WHEN d < 0 THEN 'non_monotonic' WHEN d = 0 THEN 'duplicate' WHEN d < 3600 THEN 'short_step' WHEN reason IS NOT NULL THEN 'known_gap' ELSE 'gap' END AS kind,
  CAST(CASE WHEN d > 3600 THEN greatest(1, floor(d / 3600) - 1) ELSE 0 END AS BIGINT) AS missing, CAST(greatest(0, epoch(high - next_ts)) AS BIGINT) AS behind FROM cl)"""


def _arrived(spark, sf):
    t = tables.ticks(spark, sf)
    return t.select("symbol", F.date_trunc("hour", "ts").cast("timestamp_ntz").alias("ts"), F.col("event_id").alias("arrival")), _outages(t)


@query("bars_arrival_breaks", f"WITH {_ARRIVED} SELECT symbol, arrival, prev_ts, next_ts, reason, kind, missing, behind FROM ac")
def _arrival_breaks(spark, sf):
    return Q.classify_arrivals(*_arrived(spark, sf), "1h")


@query(
    "bars_arrival_summary",
    f"""WITH {_ARRIVED} SELECT r.symbol, r.n, r.last_ts, count(*) FILTER (kind = 'gap') AS gap, count(*) FILTER (kind = 'known_gap') AS known_gap, count(*) FILTER (kind = 'duplicate') AS duplicate,
  count(*) FILTER (kind = 'non_monotonic') AS non_monotonic, count(*) FILTER (behind > 0) AS late, max(behind) AS most_behind, count(*) FILTER (kind IN ('duplicate', 'non_monotonic')) = 0 AS monotonic
FROM (SELECT symbol, count(*) AS n, max(ts) AS last_ts FROM r GROUP BY 1) r LEFT JOIN ac ON ac.symbol = r.symbol GROUP BY 1, 2, 3""",
)
def _arrival_summary(spark, sf):
    return Q.arrival_summary(*_arrived(spark, sf), "1h")


@query(
    "bars_coverage_ready",
    f"""WITH {bars_cte(3600)} SELECT symbol, min(ts) <= TIMESTAMP '2024-01-01 06:00:00' AND max(ts) >= TIMESTAMP '2024-01-30 00:00:00' AS ready
FROM bars GROUP BY 1""",
)
def _ready(spark, sf):
    return Q.coverage_ready(bars(spark, sf, "1h"), "2024-01-01 06:00:00", "2024-01-30 00:00:00")


@query(
    "bars_last_closed_open",
    f"""WITH {TICKS} SELECT event_id, CAST(floor(epoch(ts)) AS BIGINT) - CAST(floor(epoch(ts)) AS BIGINT) % 300 - 300 AS open_s FROM ticks""",
)
def _last_closed(spark, sf):
    now = F.expr("timestampdiff(SECOND, TIMESTAMP_NTZ'1970-01-01 00:00:00', ts)")
    return tables.ticks(spark, sf).select("event_id", B.last_closed_open(now, "5m").alias("open_s"))


@query(
    "bars_rebalance_days",
    """WITH d AS (SELECT DISTINCT l_returnflag || l_linestatus AS symbol, CAST(l_shipdate AS DATE) AS day FROM lineitem)
SELECT symbol, 'weekly' AS cadence, max(day) AS day FROM d GROUP BY symbol, date_trunc('week', day)
UNION ALL SELECT symbol, 'monthly', max(day) FROM d GROUP BY symbol, date_trunc('month', day)""",
)
def _rebalance(spark, sf):
    days = tables.flag_days(spark, sf)
    parts = [B.rebalance_days(days, k).select("symbol", F.lit(k).alias("cadence"), "day") for k in ("weekly", "monthly")]
    return parts[0].unionByName(parts[1])


_SPAN = """span AS (SELECT symbol, CAST(epoch(min(day)) AS BIGINT) AS s0, CAST(epoch(max(day)) AS BIGINT) + 86400 AS s1
  FROM (SELECT l_returnflag || l_linestatus AS symbol, CAST(CAST(l_shipdate AS DATE) AS TIMESTAMP) AS day FROM lineitem) GROUP BY 1)"""


def _spans(spark, sf):
    sec = F.expr("unix_date(day) * 86400L")
    return tables.flag_days(spark, sf).groupBy("symbol").agg(
        F.min(sec).cast("long").alias("s0"), (F.max(sec) + 86400).cast("long").alias("s1")
    )


@query(
    "windows_tile_blocks",
    f"""WITH {_SPAN}, n AS (SELECT *, greatest(1, CAST(round_even((s1 - s0) / (390 * 86400.0), 0) AS BIGINT)) AS n FROM span)
SELECT symbol, s0, s1, k AS block, s0 + (s1 - s0) * k // n AS block_start, s0 + (s1 - s0) * (k + 1) // n AS block_end
FROM n, LATERAL (SELECT unnest(range(n)) AS k)""",
)
def _blocks(spark, sf):
    return WN.tile_blocks(_spans(spark, sf), "s0", "s1")


_SEGS = f"""{_SPAN}, segs AS (SELECT symbol, k AS seg, s0 + k * 87 * 86400 AS oos_start,
  CASE WHEN k = n - 1 THEN s1 ELSE s0 + (k + 1) * 87 * 86400 END AS oos_end
  FROM (SELECT *, greatest(1, (s1 - s0) // (87 * 86400)) AS n FROM span), LATERAL (SELECT unnest(range(n)) AS k))"""


@query(
    "windows_label_segments",
    f"""WITH {_SEGS}, d AS (SELECT DISTINCT l_returnflag || l_linestatus AS symbol, CAST(l_shipdate AS DATE) AS day FROM lineitem),
p AS (SELECT d.symbol, seg, CASE WHEN sec >= oos_start THEN 'oos' WHEN sec >= oos_start - 63 * 86400 THEN 'train' ELSE 'warm' END AS role
  FROM (SELECT *, CAST(epoch(CAST(day AS TIMESTAMP)) AS BIGINT) AS sec FROM d) d JOIN segs s
  ON s.symbol = d.symbol AND sec >= oos_start - 77 * 86400 AND sec < oos_end)
SELECT symbol, seg, role, count(*) AS n FROM p GROUP BY 1, 2, 3""",
)
def _segments(spark, sf):
    segs = WN.segments(_spans(spark, sf), "s0", "s1").select("symbol", "seg", "oos_start", "oos_end")
    days = tables.flag_days(spark, sf).select("symbol", F.expr("unix_date(day) * 86400L").alias("sec"))
    return WN.label_segments(days, segs).groupBy("symbol", "seg", "role").agg(F.count(F.lit(1)).alias("n"))


@query(
    "windows_end_aligned",
    f"""WITH {bars_cte(3600)}, n AS (SELECT symbol, ts, row_number() OVER (PARTITION BY symbol ORDER BY ts) - 1 AS rn,
  count(*) OVER (PARTITION BY symbol) AS total FROM bars),
p AS (SELECT symbol, w, rn - (total - (4 - w) * 40) AS pos, total - (4 - w) * 40 AS a FROM n, (SELECT unnest(range(4)) AS w))
SELECT symbol, w, CASE WHEN pos < 0 THEN 'warm' WHEN pos < 28 THEN 'train' ELSE 'test' END AS role, count(*) AS n
FROM p WHERE a >= 0 AND pos >= -10 AND pos < 40 GROUP BY 1, 2, 3""",
)
def _end_windows(spark, sf):
    out = WN.end_windows(bars(spark, sf, "1h"), 40, 4, 10)
    return out.groupBy("symbol", F.col("w").cast("long").alias("w"), "role").agg(F.count(F.lit(1)).alias("n"))

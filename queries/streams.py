"""Streams drained over the event files, and the stored-bar operators."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from barloom.functions import atoms as A
from barloom.operators import bars as B
from barloom.operators import books as K
from barloom.plans import library
from barloom.session import shared_dir
from barloom.sources import store, tables
from barloom.streaming import live
from queries.books import _sig_sql, book_sql
from queries.registry import TICKS, bars_cte, query


def ticks(spark, sf):
    schema = tables.table(spark, sf, "events").schema
    return live.tick_stream(live.file_stream(spark, sf, "events.parquet", schema))


_CLOSED = "SELECT * FROM bars WHERE ts + INTERVAL {n} SECOND <= (SELECT max(ts) - INTERVAL {d} SECOND FROM ticks)"


@query("stream_hourly_bars", f"WITH {bars_cte(3600)} {_CLOSED.format(n=3600, d=600)}")
def _hourly(spark, sf):
    return live.drain(live.bar_stream(ticks(spark, sf), "1h"))


@query("stream_completed_days", f"WITH {bars_cte(86400)} {_CLOSED.format(n=86400, d=3600)}")
def _days(spark, sf):
    return live.drain(live.daily_stream(ticks(spark, sf))).drop("day")


def stored(spark, sf):
    """Five-minute bars streamed into a bar table, then a corrected epoch on top."""
    path = f"{shared_dir(spark)}/barloom/bars-{uuid.uuid4().hex}"
    live.run_available(live.upsert_sink(live.bar_stream(ticks(spark, sf), "5m"), path, f"{path}-check"))
    fixed = store.read_bars(spark, path).where("minute(ts) = 0").withColumn("v", F.col("v") + 1000)
    store.write_epoch(fixed, path, 1000)
    return path


_STORED = f"""WITH {bars_cte(300, 'raw')}, bars AS (SELECT symbol, ts, o, h, l, c, CASE WHEN minute(ts) = 0 THEN v + 1000 ELSE v END AS v FROM raw
  WHERE ts + INTERVAL 300 SECOND <= (SELECT max(ts) - INTERVAL 600 SECOND FROM ticks))"""


@query("stream_upsert_store", f"{_STORED} SELECT * FROM bars")
def _upsert(spark, sf):
    return store.read_bars(spark, stored(spark, sf))


@query("store_read_range", f"{_STORED} SELECT * FROM bars WHERE symbol = 'click' AND ts >= TIMESTAMP '2024-01-05' AND ts < TIMESTAMP '2024-01-12'")
def _range(spark, sf):
    return store.read_bars(spark, stored(spark, sf), "click", "2024-01-05", "2024-01-12")


@query("store_compacted", f"{_STORED} SELECT symbol, ts, o, h, l, c, CASE WHEN minute(ts) = 30 THEN v + 5 ELSE v END AS v FROM bars")
def _compacted(spark, sf):
    """A compacted table, a corrected epoch on top, and a second compaction that takes it in."""
    path = stored(spark, sf)
    store.compact(spark, path)
    fixed = store.read_bars(spark, path).where("minute(ts) = 30").withColumn("v", F.col("v") + 5)
    store.write_epoch(fixed, path, 1001)
    store.compact(spark, path)
    return store.read_bars(spark, path)


@query("store_compacted_range", f"{_STORED} SELECT * FROM bars WHERE symbol = 'click' AND ts >= TIMESTAMP '2024-01-05' AND ts < TIMESTAMP '2024-01-12'")
def _compacted_range(spark, sf):
    path = stored(spark, sf)
    store.compact(spark, path)
    return store.read_bars(spark, path, "click", "2024-01-05", "2024-01-12")


_SLICE_NAMES = ["don_hi_20&mom_12b_gt1pc", "sma_abv_50"]


@query(
    "store_signal_slice",
    f"""{_STORED}, x AS (SELECT *, row_number() OVER w AS t, max(h) OVER (PARTITION BY symbol ORDER BY ts ROWS BETWEEN 20 PRECEDING AND 1 PRECEDING) AS top, lag(c, 12) OVER w AS back, avg(c) OVER (PARTITION BY symbol ORDER BY ts ROWS 49 PRECEDING) AS mean,
  row_number() OVER (PARTITION BY symbol ORDER BY ts DESC) AS r FROM bars WHERE symbol = 'click' WINDOW w AS (PARTITION BY symbol ORDER BY ts))
SELECT ts, 'don_hi_20&mom_12b_gt1pc' AS config, c > top AND c / back - 1 > 0.01 AS signal FROM x WHERE r <= 200 UNION ALL SELECT ts, 'sma_abv_50', c > mean FROM x WHERE r <= 200""",
)
def _slice(spark, sf):
    """Signals of the last 200 bars from a slice as long as the names look back; the rest of the history is not read."""
    path = stored(spark, sf)
    store.compact(spark, path)
    rows = store.signal_slice(spark, path, "click", _SLICE_NAMES, 200)
    flags = A.long_flags(rows.withColumnRenamed("ts", "day"), _SLICE_NAMES)
    newest = flags.select("day").distinct().orderBy(F.desc("day")).limit(200)
    return flags.join(newest, "day", "left_semi").select(F.col("day").alias("ts"), "config", "signal")


@query(
    "stream_equity_points",
    """SELECT DISTINCT o_custkey % 50 AS account, CAST(o_orderdate AS TIMESTAMP) AS ts, arg_min(o_totalprice, o_orderkey) OVER (PARTITION BY o_custkey % 50, o_orderdate) AS equity, CAST(10000 AS DOUBLE) AS baseline, 'cycle' AS note FROM orders""",
)
def _equity(spark, sf):
    """Equity points with every batch sent twice: the second time they add nothing."""
    path = f"{shared_dir(spark)}/barloom/points-{uuid.uuid4().hex}"
    o = tables.table(spark, sf, "orders")
    first = o.groupBy((F.col("o_custkey") % 50).alias("account"), F.col("o_orderdate").cast("timestamp").alias("ts")).agg(F.min_by("o_totalprice", "o_orderkey").alias("equity"))
    points = first.withColumn("baseline", F.lit(10_000.0))
    for part in range(3):
        for again in "ab":
            points.where(F.pmod(F.xxhash64("account"), F.lit(3)) == part).coalesce(1).write.parquet(f"{path}/{part}{again}")
    stream = spark.readStream.schema(points.schema).option("maxFilesPerTrigger", 1).parquet(f"{path}/*")
    return live.drain(live.equity_snapshots(stream, "cycle", "10000 days"))


@query("store_tail", f"{_STORED} SELECT * FROM bars WHERE symbol = 'click' ORDER BY ts DESC LIMIT 25")
def _tail(spark, sf):
    return store.tail(spark, stored(spark, sf), "click", 25)


@query(
    "store_manifest",
    f"""WITH {bars_cte(3600)}, d AS (SELECT symbol, CAST(ts AS DATE) AS d, count(*) AS n, min(ts) AS lo, max(ts) AS hi FROM bars GROUP BY 1, 2)
SELECT symbol, CAST(sum(n) AS BIGINT) AS bars, min(lo) AS first_ts, max(hi) AS last_ts, 64 AS hash_length FROM d GROUP BY 1""",
)
def _manifest(spark, sf):
    m = store.manifest(B.bars_from_ticks(tables.ticks(spark, sf), "1h"))
    return m.select("symbol", "bars", "first_ts", "last_ts", F.length("sha256").alias("hash_length"))


@query("store_pinned", f"WITH {bars_cte(3600)} SELECT * FROM bars b WHERE ts < (SELECT date_trunc('day', max(ts)) FROM bars x WHERE x.symbol = b.symbol)")
def _pinned(spark, sf):
    return store.pinned(B.bars_from_ticks(tables.ticks(spark, sf), "1h"))


@query("store_json_rows", f"WITH {bars_cte(3600)} SELECT symbol, ts, o, h, l, c, v FROM bars")
def _json(spark, sf):
    rows = store.rows_to_arrays(B.bars_from_ticks(tables.ticks(spark, sf), "1h"))
    lines = rows.select("symbol", F.to_json("row").alias("value"))
    return store.rows_from_json(lines)


@query(
    "store_backfill",
    f"""WITH {bars_cte(3600)}, kept AS (SELECT * FROM bars WHERE hour(ts) % 5 <> 0), b AS (SELECT symbol, min(ts) AS lo, max(ts) AS hi FROM kept GROUP BY 1)
SELECT x.symbol, x.ts, c FROM bars x JOIN b ON b.symbol = x.symbol WHERE hour(x.ts) % 5 = 0 AND x.ts BETWEEN lo AND hi""",
)
def _backfill(spark, sf):
    bars = B.bars_from_ticks(tables.ticks(spark, sf), "1h")
    return live.backfill(bars.where("hour(ts) % 5 <> 0"), bars, "1h").select("symbol", "ts", "c")


@query(
    "store_fresh_bars",
    f"WITH {bars_cte(3600)} SELECT symbol, ts, c FROM bars b WHERE ts > (SELECT max(ts) FROM bars x WHERE x.symbol = b.symbol AND x.ts < TIMESTAMP '2024-01-20')",
)
def _fresh(spark, sf):
    bars = B.bars_from_ticks(tables.ticks(spark, sf), "1h")
    return live.fresh_bars(bars.where("ts < TIMESTAMP_NTZ'2024-01-20 00:00:00'"), bars).select("symbol", "ts", "c")


_ACC = ["sma200", "turtle20"]


def account_days(spark, sf):
    from pyspark.sql import Window

    bars = tables.flag_days(spark, sf)
    sig = library.signals(bars, _ACC, grid=False)
    w = Window.partitionBy("symbol", "config").orderBy("day")
    on = F.coalesce(F.lag("signal").over(w), F.lit(False))
    rows = sig.withColumn("on", on).join(bars, ["symbol", "day"])
    return rows.select(F.concat_ws("|", "symbol", "config").alias("account"), "day", "o", "l", "c", F.col("on").alias("signal"), "t")


@query(
    "stream_account_machine",
    f"""{_sig_sql(_ACC, score_from=1)}, {book_sql()}, fills AS (SELECT symbol || '|' || config AS account, entry_day AS day, 'enter' AS action, entry_price AS price FROM trades
  UNION ALL SELECT symbol || '|' || config, exit_day, reason, exit_price FROM trades WHERE NOT at_end)
SELECT account, day, action, round(price + 1.3e-7, 5) AS price FROM fills""",
)
def _machine(spark, sf):
    """Days come in six files by hash, so out of order; a clock row far ahead closes the stream's last days."""
    path = f"{shared_dir(spark)}/barloom/days-{uuid.uuid4().hex}"
    days = account_days(spark, sf).drop("t")
    days.repartition(6, F.xxhash64("account", "day")).write.parquet(f"{path}/a")
    clock = days.agg(F.lit("clock").alias("account"), F.date_add(F.max("day"), 20_000).alias("day"), *[F.lit(1.0).alias(x) for x in "olc"], F.lit(False).alias("signal"))
    clock.write.parquet(f"{path}/b")
    schema = spark.read.parquet(f"{path}/a").schema
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).option("latestFirst", "false").parquet(f"{path}/*")
    out = live.drain(live.account_stream(stream, "10000 days"))
    return out.select("account", "day", "action", F.round(F.col("price") + 1.3e-7, 5).alias("price"))


@query(
    "stream_stop_watch",
    f"""WITH {TICKS}, lots AS (SELECT symbol, avg(price) AS stop FROM ticks GROUP BY 1) SELECT t.symbol, count(*) AS hits FROM ticks t JOIN lots l ON l.symbol = t.symbol WHERE price <= stop GROUP BY 1""",
)
def _watch(spark, sf):
    lots = tables.ticks(spark, sf).groupBy("symbol").agg(F.avg("price").alias("stop"))
    return live.drain(live.stop_watch(ticks(spark, sf), lots)).groupBy("symbol").agg(F.count(F.lit(1)).alias("hits"))


@query(
    "stream_live_results",
    """WITH a AS (SELECT o_custkey % 100 AS account, count(*) AS closed, sum(floor(o_totalprice) - 250000) AS pnl FROM orders GROUP BY 1)
SELECT account, closed, round(pnl, 2) AS pnl, CASE WHEN closed < 80 THEN 'RUNNING' WHEN pnl > 0 THEN 'GRADUATED_PAPER' ELSE 'REJECTED_NEGATIVE_PNL' END AS status FROM a""",
)
def _live(spark, sf):
    schema = tables.table(spark, sf, "orders").schema
    closed = live.file_stream(spark, sf, "orders.parquet", schema).select(
        (F.col("o_custkey") % 100).alias("account"), (F.floor("o_totalprice") - 250000).cast("double").alias("pnl")
    )
    out = live.drain(live.live_results(closed), mode="complete")
    newest = out.agg(F.max("epoch").alias("epoch"))
    return out.join(F.broadcast(newest), "epoch").select("account", "closed", F.round("pnl", 2).alias("pnl"), "status")

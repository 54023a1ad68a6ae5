"""Streams: bars with a watermark, idempotent upserts, account machines, live results."""

from __future__ import annotations

import calendar
import sys
import uuid
from collections.abc import Iterator
from types import SimpleNamespace

import pandas as pd
from pyspark import cloudpickle
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from barloom.operators.bars import SECONDS, tick_order
from barloom.session import broadcast_if_small, shared_dir
from barloom.sources import store

cloudpickle.register_pickle_by_value(sys.modules[__name__])

FEE, SLIP, STOP_FRAC, START_CASH = 0.001, 0.0002, 0.20, 10_000.0
GRADUATE_CLOSED = 80


def file_stream(spark: SparkSession, folder: str, glob: str, schema, files_per_trigger: int | None = None) -> DataFrame:
    """New files of a folder as a stream; ``files_per_trigger`` bounds one step."""
    reader = spark.readStream.schema(schema).option("pathGlobFilter", glob)
    if files_per_trigger:
        reader = reader.option("maxFilesPerTrigger", files_per_trigger)
    return reader.parquet(folder)


def tick_stream(events: DataFrame) -> DataFrame:
    return events.where("value > 0").select(
        F.col("event_type").alias("symbol"), F.col("ts").cast("timestamp").alias("ts"), F.col("value").alias("price"), "event_id"
    )


def bar_stream(ticks: DataFrame, tf: str, delay: str = "10 minutes") -> DataFrame:
    """Bars that close once the watermark passes their end; later ticks are dropped."""
    seq = tick_order()
    w = F.window("ts", f"{SECONDS[tf]} seconds")
    return (
        ticks.withWatermark("ts", delay).groupBy("symbol", w.alias("w"))
        .agg(F.min_by("price", seq).alias("o"), F.max("price").alias("h"), F.min("price").alias("l"),
             F.max_by("price", seq).alias("c"), F.count(F.lit(1)).cast("double").alias("v"))
        .select("symbol", F.col("w.start").cast("timestamp_ntz").alias("ts"), "o", "h", "l", "c", "v")
    )


def daily_stream(ticks: DataFrame, delay: str = "1 hour") -> DataFrame:
    """Completed UTC days; the forming day is held back by the watermark."""
    return bar_stream(ticks, "1d", delay).withColumn("day", F.to_date("ts"))


def upsert_sink(bars: DataFrame, path: str, checkpoint: str):
    """Write each micro-batch as its own epoch; a replayed batch replaces itself."""
    return (
        bars.writeStream.outputMode("append").option("checkpointLocation", checkpoint)
        .foreachBatch(lambda batch, epoch: store.write_epoch(batch, path, epoch))
    )


def run_available(writer) -> None:
    """Process what is there and stop."""
    q = writer.trigger(availableNow=True).start()
    q.awaitTermination()
    if q.exception():
        raise q.exception()


def drain(stream: DataFrame, mode: str = "append") -> DataFrame:
    """Run a stream over what is available into the shared folder and read it back."""
    spark = stream.sparkSession
    base = f"{shared_dir(spark)}/barloom/stream-{uuid.uuid4().hex}"
    schema = stream.schema
    if mode == "append":
        writer = stream.writeStream.outputMode("append").format("parquet").option("path", f"{base}/out")
    else:
        writer = stream.writeStream.outputMode(mode).foreachBatch(
            lambda batch, epoch: batch.withColumn("epoch", F.lit(epoch)).write.mode("overwrite").parquet(f"{base}/out/batch={epoch}")
        )
    run_available(writer.option("checkpointLocation", f"{base}/check"))
    if mode == "append":
        return spark.read.schema(schema).parquet(f"{base}/out")
    return spark.read.parquet(f"{base}/out")


def backfill(stored: DataFrame, source: DataFrame, tf: str) -> DataFrame:
    """Source bars the store lacks between its bounds, found per (symbol, day)."""
    b = stored.groupBy("symbol").agg(F.min("ts").alias("_lo"), F.max("ts").alias("_hi"))
    wanted = source.join(broadcast_if_small(b), "symbol").where("ts >= _lo AND ts <= _hi").drop("_lo", "_hi")
    return wanted.join(stored.select("symbol", "ts"), ["symbol", "ts"], "left_anti")


def fresh_bars(stored: DataFrame, source: DataFrame) -> DataFrame:
    """Source bars newer than the last stored bar of their symbol."""
    last = stored.groupBy("symbol").agg(F.max("ts").alias("_hi"))
    return source.join(broadcast_if_small(last), "symbol", "left").where("_hi IS NULL OR ts > _hi").drop("_hi")


# --- account machine ------------------------------------------------------------

STATE = "day date, long boolean, lockout boolean, stop_pending boolean, cash double, qty double, stop double, entry double"
EVENTS = "account string, day date, action string, price double, cash double, equity double"


def account_step(state: tuple | None, row) -> tuple[tuple, list[tuple]]:
    """One completed day of one account: pending stop, signal, stop watch.

    The first day an account sees only starts its clock: a fresh book waits
    for the next open. Days already applied are ignored.
    """
    if state is None:
        return (row.day, False, False, False, START_CASH, 0.0, 0.0, 0.0), []
    last, long, lockout, pending, cash, qty, stop, entry = state
    if row.day <= last:
        return state, []
    out = []

    def sell(reason):
        nonlocal long, pending, cash, qty
        cash += qty * row.o * (1 - SLIP) * (1 - FEE)
        long, pending, qty = False, False, 0.0
        out.append((row.day, reason, row.o * (1 - SLIP), cash))

    if pending and long:
        sell("safety_stop")
        lockout = True
    if long and not row.signal:
        sell("signal")
    elif not long and row.signal and not lockout:
        entry = row.o * (1 + SLIP)
        qty = cash / (entry * (1 + FEE))
        cash, long, stop = 0.0, True, entry * (1 - STOP_FRAC)
        out.append((row.day, "enter", entry, cash))
    if not row.signal:
        lockout = False
    if long and row.l <= stop:
        pending = True
    return (row.day, long, lockout, pending, cash, qty, stop, entry), [(*e, cash + qty * row.c) for e in out]


WAITING = "w_day array<date>, w_o array<double>, w_l array<double>, w_c array<double>, w_signal array<boolean>"


def _accounts(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
    """Hold days until the watermark has passed them, then apply them in order; repeats of a day are ignored. Days behind
    the watermark never get here: Spark drops them and counts them in the query's progress."""
    *now, days, opens, lows, closes, signals = state.get if state.exists else (None, *[None] * 7, [], [], [], [], [])
    waiting = {r[0]: r for r in zip(days, opens, lows, closes, signals)}
    applied, out = (tuple(now) if now[0] is not None else None), []
    for part in batches:
        for row in part.itertuples(index=False):
            if applied is None or row.day > applied[0]:
                waiting.setdefault(row.day, (row.day, row.o, row.l, row.c, bool(row.signal)))
    mark = state.getCurrentWatermarkMs()
    at = lambda day: calendar.timegm(day.timetuple()) * 1000
    for day in sorted(waiting):
        if at(day) <= mark:
            applied, events = account_step(applied, SimpleNamespace(**dict(zip(("day", "o", "l", "c", "signal"), waiting.pop(day)))))
            out += [(key[0], *e) for e in events]
    if waiting:
        state.setTimeoutTimestamp(max(mark + 1, at(min(waiting))))
    held = [list(x) for x in zip(*[waiting[d] for d in sorted(waiting)])] or [[], [], [], [], []]
    state.update((*(applied or [None] * 8), *held))
    yield pd.DataFrame(out, columns=["account", "day", "action", "price", "cash", "equity"])


def account_stream(days: DataFrame, delay: str = "10 days") -> DataFrame:
    """Fills of every account from (account, day, o, l, c, signal), where ``signal`` is the rule at the close before the
    day. Days may come up to ``delay`` out of order; what waits is bounded by the delay, the rest is a few numbers."""
    timed = days.withColumn("at", F.col("day").cast("timestamp")).withWatermark("at", delay)
    return timed.select("account", "at", "day", "o", "l", "c", "signal").groupBy("account").applyInPandasWithState(
        _accounts, EVENTS, f"{STATE}, {WAITING}", "append", GroupStateTimeout.EventTimeTimeout
    )


def stop_watch(prices: DataFrame, lots: DataFrame) -> DataFrame:
    """Price stream against the stored open lots: those at or below their stop."""
    return prices.join(broadcast_if_small(lots), "symbol").where("price <= stop")


def live_results(closed: DataFrame) -> DataFrame:
    """Closed trades per account as a running aggregate, with the graduation status."""
    agg = closed.groupBy("account").agg(F.count(F.lit(1)).alias("closed"), F.sum("pnl").alias("pnl"))
    done = F.col("closed") >= GRADUATE_CLOSED
    status = F.when(done & (F.col("pnl") > 0), "GRADUATED_PAPER").when(done, "REJECTED_NEGATIVE_PNL").otherwise("RUNNING")
    return agg.withColumn("status", status)


def equity_snapshots(marks: DataFrame, note: str, delay: str = "1 hour") -> DataFrame:
    """One equity point per account and cycle, for an append sink.

    A point that comes again within ``delay``, as after a replayed batch, is dropped; the state it takes ends with the
    watermark.
    """
    timed = marks.withColumn("ts", F.col("ts").cast("timestamp")).withWatermark("ts", delay)
    return timed.select("account", "ts", "equity", "baseline", F.lit(note).alias("note")).dropDuplicatesWithinWatermark(["account", "ts"])

"""Building bars: resample, completed days, alignment, row indexes and splits.

Ticks may put a third of all rows on one symbol, so nothing here orders raw
rows inside a symbol: buckets use partial aggregates, and row order is taken
inside (symbol, day) chunks that are stitched through a per-day table.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from barloom.session import broadcast_if_small

SECONDS = {"1m": 60, "5m": 300, "15m": 900, "1h": 3600, "4h": 14400, "1d": 86400}


def bucket(ts: Column | str, seconds: int) -> Column:
    """Start of the left-closed bucket, aligned to the epoch."""
    return F.window(ts, f"{seconds} seconds")["start"]


def tick_order(ts: str = "ts", tie: str = "event_id") -> Column:
    """Order of ticks as one exact number: microseconds, then the whole signed 64-bit id.

    A struct order would push the aggregate from hash to sort; a decimal has a fixed width, so ``min_by`` and
    ``max_by`` stay in the hash aggregate with map-side combine.
    """
    micros = F.unix_micros(F.col(ts).cast("timestamp")).cast("decimal(18,0)")
    return (micros * F.lit("20000000000000000000").cast("decimal(20,0)") + F.col(tie).cast("decimal(19,0)")).cast("decimal(38,0)")


def bars_from_ticks(ticks: DataFrame, tf: str) -> DataFrame:
    """OHLCV bars of ticks, labelled by their open; empty buckets are absent."""
    seq = tick_order()
    return ticks.groupBy("symbol", bucket("ts", SECONDS[tf]).alias("ts")).agg(
        F.min_by("price", seq).alias("o"),
        F.max("price").alias("h"),
        F.min("price").alias("l"),
        F.max_by("price", seq).alias("c"),
        F.sum("v").alias("v"),
    )


def _roll(bars: DataFrame, keys: list) -> DataFrame:
    return bars.groupBy(*keys).agg(
        F.min_by("o", "ts").alias("o"),
        F.max("h").alias("h"),
        F.min("l").alias("l"),
        F.max_by("c", "ts").alias("c"),
        F.sum("v").alias("v"),
        F.min("ts").alias("_first"),
    )


def resample(bars: DataFrame, tf: str) -> DataFrame:
    """Higher bars from bars."""
    out = _roll(bars, ["symbol", bucket("ts", SECONDS[tf]).alias("bucket")])
    return out.select("symbol", F.col("bucket").alias("ts"), "o", "h", "l", "c", "v")


def causal_resample(bars: DataFrame, tf: str, as_of: str, base: str = "5m") -> DataFrame:
    """Higher bars seen at ``as_of``: a bucket counts once its last base bar opened."""
    limit = F.lit(as_of).cast(bars.schema["ts"].dataType)
    out = resample(bars.where(F.col("ts") <= limit), tf)
    gap = SECONDS[tf] - SECONDS[base]
    return out.where(F.col("ts") + F.expr(f"INTERVAL {gap} SECONDS") <= limit)


def multi_timeframe(bars: DataFrame, tfs: tuple[str, ...] = ("15m", "1h", "4h", "1d")) -> DataFrame:
    """All views in one job. A table without volume gets ``abs(h - l) + 1``."""
    if "v" not in bars.columns:
        bars = bars.withColumn("v", F.abs(F.col("h") - F.col("l")) + 1)
    # window() may appear once per projection, so buckets come from arithmetic.
    second = F.expr("timestampdiff(SECOND, TIMESTAMP_NTZ'1970-01-01 00:00:00', CAST(ts AS TIMESTAMP_NTZ))")
    views = F.array(
        *[F.struct(F.lit(tf).alias("tf"), (second - second % SECONDS[tf]).alias("at")) for tf in tfs]
    )
    out = _roll(
        bars.select("*", F.explode(views).alias("w")),
        ["symbol", F.col("w.tf").alias("tf"), F.col("w.at").alias("at")],
    )
    start = F.expr("timestampadd(SECOND, at, TIMESTAMP_NTZ'1970-01-01 00:00:00')")
    return out.select("symbol", "tf", start.alias("ts"), "o", "h", "l", "c", "v")


def daily_bars(bars: DataFrame) -> DataFrame:
    """Completed UTC days. The newest day of a symbol may still grow, so it is dropped."""
    days = _roll(bars, ["symbol", F.to_date("ts").alias("day")])
    newest = Window.partitionBy("symbol")
    return (
        days.withColumn("_last", F.max("day").over(newest))
        .where(F.col("day") < F.col("_last"))
        .select("symbol", "day", "o", "h", "l", "c", "v")
    )


def keep_latest(rows: DataFrame, keys: list[str], seq: str) -> DataFrame:
    """One row per key: the one ingested last. Partial aggregates, no window."""
    rest = [c for c in rows.columns if c not in keys]
    best = rows.groupBy(*keys).agg(F.max_by(F.struct(*rest), F.col(seq)).alias("_row"))
    return best.select(*keys, *[F.col(f"_row.{c}").alias(c) for c in rest]).select(*rows.columns)


def before(bars: DataFrame, ts, col: str = "day") -> DataFrame:
    return bars.where(F.col(col) < F.lit(ts))


def index_of(bars: DataFrame, ts, col: str = "day") -> DataFrame:
    """Zero-based index of the first row at or after ``ts`` per symbol: the rows before it."""
    return bars.groupBy("symbol").agg(F.count_if(F.col(col) < F.lit(ts)).alias("at"))


def _chunk_table(rows: DataFrame, order: str) -> DataFrame:
    return rows.groupBy("symbol", F.to_date(order).alias("_chunk")).agg(
        F.count(F.lit(1)).alias("_n"), F.min(order).alias("_lo"), F.max(order).alias("_hi")
    )


def row_index(rows: DataFrame, order: str = "ts", tie: str | None = None) -> DataFrame:
    """Zero-based row number per symbol and the symbol's row count.

    Rows are numbered inside (symbol, day) and shifted by the rows of earlier
    days, so one heavy symbol spreads over its days.
    """
    w = Window.partitionBy("symbol").orderBy("_chunk")
    shift = _chunk_table(rows, order).select(
        F.col("symbol"),
        F.col("_chunk"),
        F.coalesce(F.sum("_n").over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("_shift"),
        F.sum("_n").over(Window.partitionBy("symbol")).alias("rows_total"),
    )
    inside = Window.partitionBy("symbol", "_chunk").orderBy(order, *([tie] if tie else []))
    numbered = rows.withColumn("_chunk", F.to_date(order)).withColumn("_k", F.row_number().over(inside) - 1)
    return (
        numbered.join(broadcast_if_small(shift), ["symbol", "_chunk"])
        .withColumn("rn", F.col("_k") + F.col("_shift"))
        .drop("_k", "_shift", "_chunk")
    )


def downsample(rows: DataFrame, stride: int, **kw) -> DataFrame:
    """Every ``stride``-th row, the first one included."""
    if stride <= 1:
        return rows
    return row_index(rows, **kw).where(F.col("rn") % stride == 0).drop("rows_total")


def split_label(rows: DataFrame, fit: float = 0.70, valid: float = 0.15, **kw) -> DataFrame:
    """fit / valid / test by row position, cut at the floors of the fractions."""
    n = F.col("rows_total")
    part = (
        F.when(F.col("rn") < F.floor(n * fit), "fit")
        .when(F.col("rn") < F.floor(n * (fit + valid)), "valid")
        .otherwise("test")
    )
    return row_index(rows, **kw).withColumn("part", part)


def newest_rows(rows: DataFrame, n: int, order: str = "ts") -> DataFrame:
    """Newest ``n`` rows per symbol. Spark limits each group before the shuffle."""
    w = Window.partitionBy("symbol").orderBy(F.desc(order))
    return rows.withColumn("_k", F.row_number().over(w)).where(F.col("_k") <= n).drop("_k")


def asof_carry(left: DataFrame, right: DataFrame, values: list[str], at: str = "ts") -> DataFrame:
    """Each left row with the latest right row of its symbol at or before it.

    Both sides are bars, bounded per symbol by the calendar. ``right`` must
    carry its availability time in ``at``; the matched time comes back as
    ``matched_ts``.
    """
    own = [c for c in left.columns if c not in ("symbol", at)]
    tagged_l = left.select("symbol", at, *own, F.lit(1).alias("_side"), F.lit(None).alias("_r"))
    payload = F.struct(F.col(at).alias("matched_ts"), *values)
    tagged_r = right.select(
        "symbol", at, *[F.lit(None).cast(left.schema[c].dataType).alias(c) for c in own],
        F.lit(0).alias("_side"), payload.alias("_r"),
    )
    tagged_l = tagged_l.withColumn("_r", F.lit(None).cast(tagged_r.schema["_r"].dataType))
    w = Window.partitionBy("symbol").orderBy(at, "_side").rowsBetween(Window.unboundedPreceding, 0)
    return (
        tagged_l.unionByName(tagged_r)
        .withColumn("_m", F.last("_r", ignorenulls=True).over(w))
        .where("_side = 1")
        .select("symbol", at, *own, "_m.*")
    )


def aligned_history(base: DataFrame, tf: str, base_tf: str) -> DataFrame:
    """Each base bar with the last higher bar that is complete when it is seen."""
    high = resample(base, tf)
    gap = SECONDS[tf] - SECONDS[base_tf]
    seen = high.select(
        "symbol", (F.col("ts") + F.expr(f"INTERVAL {gap} SECONDS")).alias("ts"),
        F.col("ts").alias("htf_ts"), F.col("c").alias("htf_c"),
    )
    return asof_carry(base.select("symbol", "ts", "c"), seen, ["htf_ts", "htf_c"]).drop("matched_ts")


def rebalance_days(days: DataFrame, cadence: str) -> DataFrame:
    """Last trading day of each ISO week or month, or every day."""
    if cadence == "daily":
        return days.select("symbol", "day").distinct()
    if cadence not in ("weekly", "monthly"):
        raise ValueError(f"unknown rebalance cadence {cadence!r}")
    unit = {"weekly": "week", "monthly": "month"}[cadence]
    return (
        days.groupBy("symbol", F.date_trunc(unit, F.col("day").cast("timestamp")).alias("_p"))
        .agg(F.max("day").alias("day"))
        .drop("_p")
    )


def last_closed_open(now_s: Column, tf: str) -> Column:
    """Epoch second at which the newest closed bar opened."""
    n = SECONDS[tf]
    return now_s - now_s % n - n

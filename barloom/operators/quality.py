"""Gaps, duplicates, outages and coverage of a bar table."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from barloom.operators.bars import SECONDS, _chunk_table
from barloom.session import broadcast_if_small


def seconds_between(a: str, b: str) -> Column:
    return F.expr(f"timestampdiff(SECOND, {a}, {b})")


def missing_bars(delta: Column, tf_s: int) -> Column:
    """Bars missing in a step: 0 up to one bar, else at least 1."""
    return F.when(delta <= tf_s, 0).otherwise(F.greatest(F.lit(1), F.floor(delta / tf_s) - 1))


def step_pairs(rows: DataFrame) -> DataFrame:
    """Consecutive (prev_ts, next_ts) per symbol.

    Ordered inside (symbol, day); a day's first row takes the last time of the
    previous day that has rows, from a table of one row per symbol and day.
    """
    w = Window.partitionBy("symbol").orderBy("_chunk")
    edges = _chunk_table(rows, "ts").select("symbol", "_chunk", F.lag("_hi").over(w).alias("_before"))
    inside = Window.partitionBy("symbol", "_chunk").orderBy("ts")
    stepped = rows.select("symbol", "ts", F.to_date("ts").alias("_chunk")).withColumn(
        "_lag", F.lag("ts").over(inside)
    )
    return (
        stepped.join(broadcast_if_small(edges), ["symbol", "_chunk"])
        .select("symbol", F.coalesce("_lag", "_before").alias("prev_ts"), F.col("ts").alias("next_ts"))
        .where("prev_ts IS NOT NULL")
    )


def gap_edges(rows: DataFrame, tf: str) -> DataFrame:
    """Steps that are not exactly one bar."""
    return step_pairs(rows).where(seconds_between("prev_ts", "next_ts") != SECONDS[tf])


def known_outages(gaps: DataFrame, outages: DataFrame, tf: str) -> DataFrame:
    """Gaps with the first outage that covers both of their missing ends.

    ``outages`` is a short documented list (start, end, reason). It is
    broadcast only after a count; a longer one is joined by day of the gap.
    """
    n = SECONDS[tf]
    step = F.expr(f"INTERVAL {n} SECONDS")
    ends = gaps.withColumn("_a", F.col("prev_ts") + step).withColumn(
        "_b", F.greatest(F.col("next_ts") - step, F.col("prev_ts") + step)
    )

    def overlaps(at: str) -> Column:
        return (F.col(at) < F.col("end")) & (F.col(at) + step > F.col("start"))

    # An outage that holds the gap's first missing bar lies on that bar's day, or started a step before it.
    days = F.sequence(F.to_date(F.col("start") - step), F.to_date("end"))
    by_day = outages.withColumn("_day", F.explode(days))
    keyed = ends.withColumn("_day", F.to_date("_a")).withColumn("_row", F.monotonically_increasing_id())
    joined = keyed.join(by_day, (keyed["_day"] == by_day["_day"]) & overlaps("_a") & overlaps("_b"), "left")
    # Equal steps stay apart by their row.
    return joined.groupBy("_row", *gaps.columns).agg(F.min_by("reason", "start").alias("reason")).drop("_row")


def classify_steps(rows: DataFrame, outages: DataFrame, tf: str) -> DataFrame:
    """Every irregular step with its class and the bars it lacks."""
    delta = seconds_between("prev_ts", "next_ts")
    kind = (
        F.when(delta < 0, "non_monotonic")
        .when(delta == 0, "duplicate")
        .when(F.col("reason").isNotNull(), "known_gap")
        .otherwise("gap")
    )
    return known_outages(gap_edges(rows, tf), outages, tf).select(
        "symbol", "prev_ts", "next_ts", "reason", kind.alias("kind"),
        missing_bars(delta, SECONDS[tf]).alias("missing"),
    )


def quality_summary(rows: DataFrame, outages: DataFrame, tf: str) -> DataFrame:
    """Counts per symbol and in total; the total's last bar is the oldest of the lasts."""
    steps = classify_steps(rows, outages, tf).groupBy("symbol").agg(
        F.count_if(F.col("kind") == "gap").alias("gap_count"),
        F.count_if(F.col("kind") == "known_gap").alias("known_gap_count"),
        F.count_if(F.col("kind") == "duplicate").alias("duplicates"),
    )
    lasts = rows.groupBy("symbol").agg(F.max("ts").alias("last_ts"))
    per = lasts.join(steps, "symbol", "left").fillna(0)
    return per.rollup("symbol").agg(
        F.sum("gap_count").alias("gap_count"),
        F.sum("known_gap_count").alias("known_gap_count"),
        F.sum("duplicates").alias("duplicates"),
        F.min("last_ts").alias("last_ts"),
    ).select(
        F.coalesce("symbol", F.lit("(all)")).alias("symbol"), "gap_count", "known_gap_count", "duplicates",
        (F.col("duplicates") == 0).alias("monotonic"), "last_ts",
    )


#: Arrival numbers that one task orders.
ARRIVAL_CHUNK = 1 << 16


def arrival_pairs(rows: DataFrame, order: str = "arrival") -> DataFrame:
    """(symbol, order, prev_ts, next_ts, high): each row with the row that arrived before it and the latest time seen so far.

    Rows keep the order they came in, so a time may step back. Order and running maximum are taken inside (symbol, chunk
    of arrivals); a table of one row per symbol and chunk hands each chunk the last and the highest time before it.
    """
    chunk = F.floor(F.col(order) / ARRIVAL_CHUNK).cast("long")
    keyed = rows.select("symbol", F.col(order).alias("arrival"), "ts", chunk.alias("_chunk"))
    edges = keyed.groupBy("symbol", "_chunk").agg(F.max_by("ts", "arrival").alias("_last"), F.max("ts").alias("_top"))
    w = Window.partitionBy("symbol").orderBy("_chunk")
    before = edges.select("symbol", "_chunk", F.lag("_last").over(w).alias("_before"), F.max("_top").over(w.rowsBetween(Window.unboundedPreceding, -1)).alias("_high"))
    inside = Window.partitionBy("symbol", "_chunk").orderBy("arrival")
    seen = keyed.withColumn("_lag", F.lag("ts").over(inside)).withColumn("_max", F.max("ts").over(inside.rowsBetween(Window.unboundedPreceding, -1)))
    joined = seen.join(before, ["symbol", "_chunk"])
    return joined.select(
        "symbol", "arrival", F.coalesce("_lag", "_before").alias("prev_ts"), F.col("ts").alias("next_ts"), F.greatest("_max", "_high").alias("high")
    ).where("prev_ts IS NOT NULL")


def classify_arrivals(rows: DataFrame, outages: DataFrame, tf: str, order: str = "arrival") -> DataFrame:
    """Every irregular step in arrival order: its class, the bars it lacks, and by how many seconds it lies behind the latest time.

    A step back is non-monotonic, an equal time a duplicate; a longer step is a gap, known where one outage covers it.
    """
    delta = seconds_between("prev_ts", "next_ts")
    odd = arrival_pairs(rows, order).where(delta != SECONDS[tf])
    kind = (
        F.when(delta < 0, "non_monotonic").when(delta == 0, "duplicate").when(delta < SECONDS[tf], "short_step")
        .when(F.col("reason").isNotNull(), "known_gap").otherwise("gap")
    )
    behind = F.greatest(F.lit(0), F.expr("timestampdiff(SECOND, next_ts, high)"))
    forward = delta > SECONDS[tf]
    return known_outages(odd, outages, tf).select(
        "symbol", "arrival", "prev_ts", "next_ts", F.when(forward, F.col("reason")).alias("reason"), kind.alias("kind"),
        F.when(forward, missing_bars(delta, SECONDS[tf])).otherwise(0).alias("missing"), behind.alias("behind"),
    )


def arrival_summary(rows: DataFrame, outages: DataFrame, tf: str, order: str = "arrival") -> DataFrame:
    """Counts of the classes per symbol; monotonic where no step goes back or stands still."""
    kinds = ("gap", "known_gap", "duplicate", "non_monotonic")
    steps = classify_arrivals(rows, outages, tf, order).groupBy("symbol").agg(
        *[F.count_if(F.col("kind") == k).alias(k) for k in kinds], F.count_if(F.col("behind") > 0).alias("late"), F.max("behind").alias("most_behind"))
    every = rows.groupBy("symbol").agg(F.count(F.lit(1)).alias("n"), F.max("ts").alias("last_ts"))
    out = every.join(steps, "symbol", "left").fillna(0)
    return out.withColumn("monotonic", (F.col("duplicate") == 0) & (F.col("non_monotonic") == 0))


def bounds(rows: DataFrame) -> DataFrame:
    return rows.groupBy("symbol").agg(
        F.count(F.lit(1)).alias("n"), F.min("ts").alias("first_ts"), F.max("ts").alias("last_ts")
    )


def coverage_ready(rows: DataFrame, start: str, recent: str) -> DataFrame:
    """Each symbol reaches back to ``start`` and forward to ``recent``."""
    b = bounds(rows)
    kind = rows.schema["ts"].dataType
    return b.select(
        "symbol",
        ((F.col("first_ts") <= F.lit(start).cast(kind)) & (F.col("last_ts") >= F.lit(recent).cast(kind))).alias("ready"),
    )

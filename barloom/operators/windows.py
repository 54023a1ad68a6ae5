"""Evaluation windows: equal blocks, out-of-sample segments, end-aligned windows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from barloom.operators.bars import row_index
from barloom.session import broadcast_if_small

# Fixed values.
BLOCK_DAYS = 390
SEGMENT_DAYS = 87
TRAIN_DAYS = 63
WARMUP_DAYS = 14


def tile_blocks(spans: DataFrame, start: str, end: str, days: int = BLOCK_DAYS) -> DataFrame:
    """Equal [block_start, block_end) blocks over each span of epoch seconds.

    There are ``round(span / days)`` of them, at least one, and the last edge
    is the span's end exactly. Half counts round to even.
    """
    span = F.col(end) - F.col(start)
    n = F.greatest(F.lit(1), F.bround(span / (days * 86400.0)).cast("long"))
    return (
        spans.withColumn("_n", n)
        .withColumn("block", F.explode(F.sequence(F.lit(0).cast("long"), F.col("_n") - 1)))
        .select(
            *spans.columns,
            "block",
            F.expr(f"{start} + ({end} - {start}) * block div _n").alias("block_start"),
            F.expr(f"{start} + ({end} - {start}) * (block + 1) div _n").alias("block_end"),
        )
    )


def segments(bounds: DataFrame, start: str, end: str, days: int = SEGMENT_DAYS) -> DataFrame:
    """Out-of-sample segments of fixed length; the last one runs to the end."""
    n = F.greatest(F.lit(1), F.floor((F.col(end) - F.col(start)) / (days * 86400)))
    ks = bounds.withColumn("_n", n).withColumn("seg", F.explode(F.sequence(F.lit(0).cast("long"), F.col("_n") - 1)))
    lo = F.col(start) + F.col("seg") * days * 86400
    hi = F.when(F.col("seg") == F.col("_n") - 1, F.col(end)).otherwise(lo + days * 86400)
    return ks.select(*bounds.columns, "seg", lo.alias("oos_start"), hi.alias("oos_end"))


def label_segments(bars: DataFrame, segs: DataFrame, second: str = "sec", days: int = SEGMENT_DAYS) -> DataFrame:
    """Bars placed in segments with a role: warm, train or oos.

    The lead (train and warm-up) is shorter than a segment, so a bar can only
    be in the segment it falls in and the next one: two candidates per bar,
    then an equi-join on (symbol, segment).
    """
    lead = (TRAIN_DAYS + WARMUP_DAYS) * 86400
    first = segs.groupBy("symbol").agg(F.min("oos_start").alias("_s0"), F.max("seg").alias("_top"))
    k = F.floor((F.col(second) - F.col("_s0")) / (days * 86400))
    near = F.array_distinct(F.array(F.least(k, F.col("_top")), F.least(k + 1, F.col("_top"))))
    placed = bars.join(broadcast_if_small(first), "symbol").withColumn("seg", F.explode(near)).drop("_s0", "_top")
    role = (
        F.when(F.col(second) >= F.col("oos_start"), "oos")
        .when(F.col(second) >= F.col("oos_start") - TRAIN_DAYS * 86400, "train")
        .otherwise("warm")
    )
    inside = (F.col(second) >= F.col("oos_start") - lead) & (F.col(second) < F.col("oos_end"))
    return placed.join(broadcast_if_small(segs), ["symbol", "seg"]).where(inside).withColumn("role", role)


def window_count(n_bars: Column, window_bars: int) -> Column:
    return F.greatest(F.lit(0), F.floor(n_bars / window_bars))


def end_windows(rows: DataFrame, size: int, n_windows: int, warmup: int, cut: float = 0.70, **kw) -> DataFrame:
    """End-aligned windows of ``size`` rows with a warm-up lead and a train/test cut."""
    numbered = row_index(rows, **kw)
    ks = F.explode(F.sequence(F.lit(0), F.lit(n_windows - 1)))
    first = F.col("rows_total") - (n_windows - F.col("w")) * size
    pos = F.col("rn") - F.col("_a")
    return (
        numbered.withColumn("w", ks)
        .withColumn("_a", first)
        .where((F.col("_a") >= 0) & (pos >= -warmup) & (pos < size))
        .withColumn("role", F.when(pos < 0, "warm").when(pos < int(size * cut), "train").otherwise("test"))
        .drop("_a")
    )

"""Two keyed frames side by side: what one of them lacks, what differs, and where it differs first."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def unlike(a: Column, b: Column, kind: str, tolerance: float) -> Column:
    """Whether two values differ: numbers by more than ``tolerance`` of the larger (or of one), the rest at all; nulls equal nulls."""
    if kind in ("double", "float"):
        far = F.abs(a - b) > F.lit(tolerance) * F.greatest(F.abs(a), F.abs(b), F.lit(1.0))
        return F.when(a.isNull() | b.isNull(), ~a.eqNullSafe(b)).when(F.isnan(a) | F.isnan(b), ~(F.isnan(a) & F.isnan(b))).otherwise(far)
    return ~a.eqNullSafe(b)


def side_by_side(left: DataFrame, right: DataFrame, keys: list[str], tolerance: float = 1e-9) -> DataFrame:
    """Keys, ``state`` (same, differs, left_only, right_only), the columns that differ, and both rows as structs."""
    values = [c for c in left.columns if c not in keys]
    kinds = {f.name: f.dataType.typeName() for f in left.schema}
    a = left.select(*keys, F.struct(*values).alias("left"))
    b = right.select(*keys, F.struct(*values).alias("right"))
    both = a.join(b, keys, "full_outer")
    found = F.array_compact(F.array(*[F.when(unlike(F.col("left")[c], F.col("right")[c], kinds[c], tolerance), F.lit(c)) for c in values]))
    state = F.when(F.col("right").isNull(), "left_only").when(F.col("left").isNull(), "right_only").when(F.size(found) > 0, "differs").otherwise("same")
    return both.select(*keys, state.alias("state"), F.when(state == "differs", found).otherwise(F.array().cast("array<string>")).alias("columns"), "left", "right")


def frame_diff(left: DataFrame, right: DataFrame, group: list[str], order: list[str], tolerance: float = 1e-9) -> DataFrame:
    """One row a group: rows compared, missing on either side, differing, and the first that is not the same with both values."""
    rows = side_by_side(left, right, [*group, *order], tolerance)
    bad = F.col("state") != "same"
    counts = [F.count_if(F.col("state") == s).alias(s) for s in ("same", "differs", "left_only", "right_only")]
    first = F.min_by(F.struct(*order, "state", "columns", F.to_json("left").alias("left"), F.to_json("right").alias("right")), F.when(bad, F.struct(*order)))
    return rows.groupBy(*group).agg(F.count(F.lit(1)).alias("n"), *counts, first.alias("first"))


def agree(diff: DataFrame) -> DataFrame:
    """``diff`` unchanged; a group that is not the same on both sides fails the job."""
    ok = reduce(lambda x, y: x & y, [F.col(c) == 0 for c in ("differs", "left_only", "right_only")])
    return diff.where(F.assert_true(ok, F.concat(F.lit("frames differ: "), F.to_json("first"))).isNull())

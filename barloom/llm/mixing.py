"""Mixing sources to target weights by entropy balancing, in DataFrame functions alone.

Rates of documents stay as close as they can, in token-weighted relative entropy, to one copy each while every source's
tokens meet its target. The dual is convex with one multiplier a constraint; its gradient and curvature are sums over
documents, so a Newton step is one aggregate and the tilt exp(multiplier) is the rate. Rates are rounded into copies:
a source's largest documents one by one, carrying the remainder, the others in descending size at even steps of the rate
that meets what is left, and two rounds of one swapped document a source remove what rounding leaves over.

Null texts and texts without words have size 0 and no words to take. Null sources form a source of their own, weighted
last. Ties and repeated rows are told apart by a rank within equal keys, so reruns agree. An empty table gives an empty
result. Input columns travel in a struct, so names cannot clash.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from barloom.llm.common import bucket_of, running, written
from barloom.session import broadcast_if_small

#: Rows of a source that are rounded one after the other, the largest first.
LARGE = 64

WORD = r"[^\x20\x09-\x0D]+"


def source_targets(sizes: DataFrame, weights: tuple[float, ...] = (5.0, 2.0, 1.0), share: float = 1.5, cap: float = 2.0) -> DataFrame:
    """(source, source_size, target) of ``sizes(source, size)``: weights repeat over sources by code point, null last.

    Targets over ``cap`` times their source's size stop there and the excess goes to the others by weight, until none
    is above. In order of size per weight the capped sources come first, so one running sum finds them all.
    """
    per = sizes.groupBy("source").agg(F.coalesce(F.sum("size"), F.lit(0)).alias("source_size"))
    place = Window.orderBy(F.col("source").isNull(), F.col("source"))  # one row per source
    weight = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), F.pmod(F.row_number().over(place) - 1, F.lit(len(weights))) + 1)
    per = per.withColumn("w", weight).withColumn("u", F.col("source_size") / F.col("w"))
    by = Window.orderBy("u", F.col("source").isNull(), "source")
    before = by.rowsBetween(Window.unboundedPreceding, -1)
    all_ = Window.partitionBy(F.lit(0))
    total = F.sum("source_size").over(all_) * share
    left = total - cap * F.coalesce(F.sum("source_size").over(before), F.lit(0))
    weight_left = F.sum("w").over(all_) - F.coalesce(F.sum("w").over(before), F.lit(0.0))
    per = per.withColumn("level", left / weight_left)
    per = per.withColumn("capped", F.col("level") >= cap * F.col("u"))
    # Capped ones form a prefix; the rest share at the level of the first that is not capped.
    free_level = F.min(F.when(~F.col("capped"), F.struct("u", "level"))).over(all_)["level"]
    target = F.when(F.col("capped"), cap * F.col("source_size")).otherwise(F.col("w") * free_level)
    return per.select("source", "source_size", F.coalesce(target, F.lit(0.0)).alias("target"))


def tilt(sizes: DataFrame, targets: DataFrame, steps: int = 30) -> DataFrame:
    """(source, target, source_size, rate): Newton steps on the dual; each source's multiplier is its own coordinate.

    The constraint of a source touches its own documents alone, so the curvature matrix is diagonal and the sums a step
    needs are the source's tokens at the current tilt: rate times its size. The step is damped to 1 so that a far start
    cannot overshoot, and 30 steps from any target within 1e-9 to ``cap`` of the size end at machine precision.
    """
    start = targets.withColumn("m", F.lit(0.0))
    step = f"""aggregate(sequence(1, {int(steps)}), 0D, (m, i) ->
        m - greatest(-1D, least(1D, (exp(m) * source_size - target) / nullif(exp(m) * source_size, 0D))))"""
    return start.withColumn("m", F.expr(step)).withColumn("rate", F.when((F.col("source_size") > 0) & (F.col("target") > 0), F.exp("m")).otherwise(0.0)).drop("m")


def mix(docs: DataFrame, text_col="text", source_col="source", id_col="doc_id", weights=(5.0, 2.0, 1.0), share=1.5, cap=2.0, keep_row=False) -> DataFrame:
    """(doc_id, source, size, source_size, target, copies), one row per input row; with ``keep_row`` also ``row``."""
    size = F.size(F.regexp_extract_all(F.coalesce(F.col(f"row.{text_col}").cast("string"), F.lit("")), F.lit(WORD), F.lit(0))).cast("long")
    thin = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row")).select(
        *(["row"] if keep_row else []),
        F.col(f"row.{id_col}").alias("doc_id"), F.col(f"row.{source_col}").cast("string").alias("source"), size.alias("size"),
        F.xxhash64(F.col(f"row.{id_col}"), F.col(f"row.{text_col}")).alias("tie"), F.monotonically_increasing_id().alias("nth"),
    )
    thin = written(thin)
    rates = written(tilt(thin, source_targets(thin, weights, share, cap)))
    known = thin.drop("row").withColumnRenamed("source", "s")
    rated = known.join(broadcast_if_small(rates, 100_000), known["s"].eqNullSafe(rates["source"])).drop("s")
    octave = F.floor(F.log2(F.col("size") + 1) * 8)
    bucket = ((F.lit(200) - octave) * 64 + bucket_of("tie", n=64)).cast("int")
    ranked = written(running(rated, ["source"], [F.desc("size"), "tie", "nth"], F.lit(1), "rank", bucket))
    now = written(_rounded(ranked, cap))
    for _ in range(2):
        now = written(_swap_one(now, cap))
    out = now.select("doc_id", "source", "size", "source_size", "target", "copies", "nth")
    # Rows with their texts are joined by a shuffle at every size, never by a broadcast.
    return out.hint("merge").join(thin.select("nth", "row"), "nth").drop("nth") if keep_row else out.drop("nth")


def _rounded(ranked: DataFrame, cap: float) -> DataFrame:
    """Copies of every row: the largest ``LARGE`` of a source one by one, carrying what rounding leaves to the next; the
    rest at even steps of the rate that meets what is still wanted of them."""
    large = (
        ranked.where((F.col("rank") < LARGE) & (F.col("size") > 0)).groupBy("source")
        .agg(*[F.first(c).alias(c) for c in ("rate", "target", "source_size")], F.array_sort(F.collect_list(F.struct("rank", "nth", "size"))).alias("rows"))
    )
    # The copies nearest to the running want; one more where the smaller rows could not make up for what is missing.
    near = "greatest(0L, cast(floor((a.want + rate * x.size - a.got) / x.size + 0.5D) AS bigint))"
    short = f"target - a.got - {near} * x.size > {float(cap)}D * (source_size - a.sizes - x.size)"
    copies = f"least({int(cap)}L, {near} + CASE WHEN {short} THEN 1L ELSE 0L END)"
    walk = F.expr(f"""aggregate(rows, named_struct('want', 0D, 'got', 0D, 'sizes', 0L, 'picks', cast(array() AS array<struct<nth: bigint, copies: bigint>>)), (a, x) ->
        named_struct('want', a.want + rate * x.size, 'got', a.got + cast({copies} * x.size AS double), 'sizes', a.sizes + x.size,
            'picks', concat(a.picks, array(named_struct('nth', x.nth, 'copies', {copies})))))""")
    walked = written(large.withColumn("w", walk).drop("rows"))
    rest = F.try_divide(F.col("target") - F.col("w.got"), (F.col("source_size") - F.col("w.sizes")).cast("double"))
    rates = walked.select(F.col("source").alias("s"), F.greatest(F.lit(0.0), F.least(F.lit(cap), F.coalesce(rest, F.lit(0.0)))).alias("f"))
    picks = walked.select(F.explode("w.picks").alias("p")).select("p.nth", F.col("p.copies").alias("picked"))
    joined = ranked.join(broadcast_if_small(rates, 100_000), ranked["source"].eqNullSafe(rates["s"]), "left").join(broadcast_if_small(picks, 100_000), "nth", "left")
    step = lambda n: F.floor(n * (F.col("f") - F.floor("f")) + 0.5)
    even = F.floor("f") + step(F.col("rank") + 1) - step(F.col("rank"))
    return joined.withColumn("copies", F.coalesce("picked", even, F.lit(0)).cast("long")).drop("s", "f", "picked", "rank", "rate")


def _swap_one(now: DataFrame, cap: float) -> DataFrame:
    """Add or take away one copy of the document that best removes each source's remainder."""
    off = now.groupBy("source").agg((F.first("target") - F.sum(F.col("copies") * F.col("size"))).alias("off"))
    off = written(off)
    key = now["source"].eqNullSafe(off["source"])
    near = now.join(broadcast_if_small(off, 100_000), key).select(now["source"], "size", "tie", "nth", "copies", "off")
    sign = F.when(F.col("off") > 0, 1).otherwise(-1)
    can = F.when(F.col("off") > 0, F.col("copies") + 1 <= cap).otherwise(F.col("copies") >= 1)
    best = (
        near.where(can & (F.col("size") > 0) & (F.abs(F.col("off") - sign * F.col("size")) < F.abs("off")))
        .groupBy("source")
        .agg(F.min_by(F.struct("nth", sign.alias("sign")), F.struct(F.abs(F.col("off") - sign * F.col("size")).alias("rest"), "tie", "nth")).alias("pick"))
        .select(F.col("pick.nth").alias("nth"), F.col("pick.sign").alias("sign"))
    )
    return now.join(broadcast_if_small(written(best), 100_000), "nth", "left").withColumn("copies", F.col("copies") + F.coalesce("sign", F.lit(0))).drop("sign")


def taken(docs: DataFrame, **how) -> DataFrame:
    """As ``mix`` with ``taken``: the words the mix takes from the row, repeats counted."""
    return mix(docs, **how).withColumn("taken", F.col("copies") * F.col("size"))


def repeated(docs: DataFrame, **how) -> DataFrame:
    """The rows of ``docs``, each as often as the mix takes it."""
    made = mix(docs, keep_row=True, **how)
    return made.where("copies > 0").select("row", F.explode(F.sequence(F.lit(1), F.col("copies").cast("int")))).select("row.*")

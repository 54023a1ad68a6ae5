"""Stated probabilities against outcomes: Brier score, buckets, posteriors."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

WARMUP_TRIALS = 20


def brier(records: DataFrame) -> DataFrame:
    """Mean squared gap of ``prob`` and ``hit``."""
    return records.agg(F.avg(F.pow(F.col("prob") - F.col("hit").cast("double"), 2)).alias("brier"), F.count(F.lit(1)).alias("n"))


def reliability(records: DataFrame) -> DataFrame:
    """Tenth-wide buckets; a probability of exactly 1 falls in none."""
    edge = lambda k: F.lit(k) / 100.0
    lo = None
    for k in range(0, 100, 10):
        inside = (F.col("prob") >= edge(k)) & (F.col("prob") < edge(k + 10))
        lo = F.when(inside, k) if lo is None else lo.when(inside, k)
    return (
        records.withColumn("lo", lo).where("lo IS NOT NULL").groupBy("lo")
        .agg(F.count(F.lit(1)).alias("n"), F.avg("prob").alias("avg_prob"), F.avg(F.col("hit").cast("double")).alias("hit_rate"))
    )


def condition_key(symbol: str, timeframe: str, condition: str) -> Column:
    return F.concat_ws("|", symbol, timeframe, condition)


def posteriors(records: DataFrame) -> DataFrame:
    """Beta posterior per key from a uniform prior; ``strength`` weighs an outcome."""
    w = F.col("strength") if "strength" in records.columns else F.lit(1.0)
    hit = F.col("hit").cast("double")
    a, b = F.col("alpha"), F.col("beta")
    total = a + b
    return records.groupBy("key").agg((1 + F.sum(hit * w)).alias("alpha"), (1 + F.sum((1 - hit) * w)).alias("beta")).select(
        "key", "alpha", "beta", (a / total).alias("mean"),
        F.when(total <= 2, 0.25).otherwise(a * b / (total * total * (total + 1))).alias("variance"),
        F.sqrt(F.when(total <= 2, 0.25).otherwise(a * b / (total * total * (total + 1)))).alias("std"),
        (total - 2).cast("long").alias("trials"),
    ).withColumn("level", learning_level(F.col("trials")))


def learning_level(trials: Column) -> Column:
    return F.when(trials < 5, "learning").when(trials < 20, "developing").when(trials < 50, "trained").otherwise("established")


def calibrated(proposals: DataFrame, posterior: DataFrame, weight: float = 1.0) -> DataFrame:
    """Posterior mean; below the warm-up it is blended with the proposal. No history is the prior."""
    p = proposals.join(posterior.select("key", "mean", "trials", "std"), "key", "left")
    mean, trials = F.coalesce("mean", F.lit(0.5)), F.coalesce("trials", F.lit(0))
    blended = (mean * trials + F.col("proposed") * weight) / (trials + weight)
    use = F.col("proposed").isNull() | (trials >= WARMUP_TRIALS)
    return p.select(*proposals.columns, F.when(use, mean).otherwise(blended).alias("probability"), F.coalesce("std", F.lit(0.5)).alias("std"))


def calibration_records(trades: DataFrame) -> DataFrame:
    return trades.where("hit IS NOT NULL AND stated_prob IS NOT NULL").select(F.col("stated_prob").alias("prob"), "hit")


def per_condition(trades: DataFrame) -> DataFrame:
    """Hits against stated probability per condition."""
    hit_rate, avg_prob = F.avg(F.col("hit").cast("double")), F.coalesce(F.avg("stated_prob"), F.lit(0.0))
    return trades.where("hit IS NOT NULL").groupBy(F.coalesce("condition", F.lit("unknown")).alias("condition")).agg(
        F.count(F.lit(1)).alias("n"), avg_prob.alias("avg_prob"), hit_rate.alias("hit_rate"), F.abs(avg_prob - hit_rate).alias("gap")
    )


def trade_stats(trades: DataFrame) -> DataFrame:
    closed = F.col("exit_ts").isNotNull()
    return trades.agg(
        F.count_if(closed).alias("closed"), F.count_if(closed & (F.col("pnl") > 0)).alias("wins"),
        F.coalesce(F.sum(F.when(closed, F.col("pnl"))), F.lit(0.0)).alias("pnl"), F.count_if(~closed).alias("open"),
    )

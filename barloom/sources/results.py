"""A log of evaluation results derived from the order table.

Names are stacks of one to three atoms picked by the customer key, so parents
and children of a stack both occur. Metrics are arithmetic on the keys.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from barloom.operators import gates
from barloom.sources.tables import table

EXPECTED_WINDOWS = 18
POOL = (
    "mom_6b_gt2pc", "mom_12b_gt3pc", "mom_24b_gt5pc", "mom_48b_gt16pc", "dip_6b_lt2pc", "dip_12b_lt3pc", "dip_24b_lt5pc",
    "dip_18b_lt6pc", "sma_abv_50", "sma_abv_55", "ema_abv_20", "ema_abv_100", "rsi_14_>50", "rsi_14_>60_<80", "rsi_14_<40",
    "rsi_30_>55", "don_hi_20", "don_lo_24", "near_swing_lo_12", "near_swing_hi_120", "h1_ema_abv_50", "h4_sma_abv_20",
    "sma_stack_7_25_50", "nonsense_9",
)


def stack_name(key, depth):
    pool = F.array(*[F.lit(a) for a in POOL])
    n = len(POOL)
    spots = [key % n, (F.floor(key / n) * 7 + 5) % n, (F.floor(key / 7) * 11 + 17) % n]
    picks = [F.element_at(pool, k.cast("int") + 1) for k in spots]
    chosen = F.slice(F.array(*picks), F.lit(1), depth)
    return F.array_join(F.array_sort(F.array_distinct(chosen)), "&")


def eval_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = table(spark, sf_dir, "orders")
    k, cust = F.col("o_orderkey"), F.col("o_custkey")
    rows = o.select(
        stack_name(cust.cast("int"), (k % 3 + 1).cast("int")).alias("name"),
        k.alias("seq"),
        F.col("o_orderdate").alias("tested_at"),
        cust.alias("account"),
        (F.floor(F.col("o_totalprice") / 100) - 2200).cast("double").alias("test_pnl"),
        (F.floor(F.col("o_totalprice") / 200) - 500).cast("double").alias("train_pnl"),
        ((k * 37 % 200) / 100.0 - 0.7).cast("double").alias("sharpe"),
        (k % 90).alias("trades"),
        ((k * 53 % 300) / 100.0 - 1.0).cast("double").alias("daily_sharpe"),
        ((cust % 100) * 30 - 1000).cast("double").alias("bh_oos_pnl"),
        F.when(cust % 11 != 0, ((cust % 70) * 20 - 500).cast("double")).alias("sma_stack_oos_pnl"),
        F.when(k % 13 == 0, 17).otherwise(18).cast("long").alias("n_windows"),
        (k % 29 == 0).alias("ops_park"),
        F.when(F.col("o_orderstatus") == "O", "older").otherwise("current").alias("gate"),
    )
    return gates.decide(rows, EXPECTED_WINDOWS).withColumnRenamed("passed", "qualified")

"""Driver tables read as ticks, bars, calibration records and result logs."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

OHLC = ["symbol", "day", "o", "h", "l", "c"]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def ticks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row per event: symbol, ts, price and a unit volume. Free of zero prices."""
    return (
        table(spark, sf_dir, "events")
        .where("value > 0")
        .select(
            F.col("event_type").alias("symbol"),
            "ts",
            F.col("value").alias("price"),
            F.lit(1.0).alias("v"),
            "event_id",
            "user_id",
        )
    )


def _from_lines(lines: DataFrame, symbol) -> DataFrame:
    price = F.col("l_extendedprice") / F.col("l_quantity")
    # One exact number orders the lines: order, line, then price, as (order, line) repeats.
    line = F.col("l_orderkey").cast("decimal(19,0)") * F.lit(100_000).cast("decimal(6,0)") + F.col("l_linenumber").cast("decimal(5,0)")
    seq = (line.cast("decimal(25,0)") * F.lit("10000000000000").cast("decimal(14,0)") + F.floor(price * 1000).cast("decimal(13,0)")).cast("decimal(38,0)")
    return (
        lines.select(
            symbol.alias("symbol"),
            F.to_date("l_shipdate").alias("day"),
            price.alias("p"),
            seq.alias("seq"),
            F.col("l_quantity").cast("double").alias("q"),
        )
        .groupBy("symbol", "day")
        .agg(
            F.min_by("p", "seq").alias("o"),
            F.max("p").alias("h"),
            F.min("p").alias("l"),
            F.max_by("p", "seq").alias("c"),
            F.sum("q").alias("v"),
        )
    )


def flag_days(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Long daily bars: one series per return flag and line status."""
    lines = table(spark, sf_dir, "lineitem")
    return _from_lines(lines, F.concat("l_returnflag", "l_linestatus"))


def supplier_days(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Daily bars of every supplier: many shorter series."""
    lines = table(spark, sf_dir, "lineitem")
    return _from_lines(lines, F.col("l_suppkey").cast("string"))


def part_days(spark: SparkSession, sf_dir: str, tickers: int = 1000) -> DataFrame:
    """Daily bars of parts, dealt to ``tickers`` series that trade on few days each."""
    lines = table(spark, sf_dir, "lineitem")
    return _from_lines(lines, (F.col("l_partkey") % tickers).cast("string"))

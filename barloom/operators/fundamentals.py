"""Point-in-time fundamentals and the earnings-surprise signal."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

MIN_PERIODS, MAX_PERIODS = 4, 20
WINDOW_DAYS, STALE_DAYS = 4, 45


def point_in_time(filings: DataFrame, asof: DataFrame, periods: int = MAX_PERIODS) -> DataFrame:
    """Newest ``periods`` filed rows per (ticker, as_of); later filings are invisible."""
    joined = asof.join(filings, "ticker").where("filing_date <= as_of")
    w = Window.partitionBy("ticker", "as_of").orderBy(F.desc("report_period"), F.desc("filing_date"))
    return joined.withColumn("k", F.row_number().over(w)).where(F.col("k") <= periods)


def snapshot(rows: DataFrame, average: list[str], trend: list[str], growth: list[str], latest: list[str]) -> DataFrame:
    """One row per (ticker, as_of) with at least four periods, and a content hash."""
    c = F.col
    last = lambda x: F.min_by(x, F.when(c(x).isNotNull(), c("k")))
    first = lambda x: F.max_by(x, F.when(c(x).isNotNull(), c("k")))
    grow = lambda x: F.when(
        (F.count(x) >= 2) & (first(x) > 0) & (last(x) > 0), F.round(F.pow(last(x) / first(x), 4.0 / (F.count(x) - 1)) - 1, 4)
    )
    out = rows.groupBy("ticker", "as_of").agg(
        F.count(F.lit(1)).alias("periods"),
        *[F.round(F.avg(x), 4).alias(f"{x}_avg") for x in average],
        *[F.when(F.count(x) >= 2, F.round(last(x) - first(x), 4)).alias(f"{x}_trend") for x in trend],
        *[grow(x).alias(f"{x}_cagr") for x in growth],
        *[F.min_by(x, "k").alias(f"{x}_latest") for x in latest],
    ).where(c("periods") >= MIN_PERIODS)
    return out.withColumn("content_hash", F.sha2(F.to_json(F.struct(*out.columns)), 256))


SOURCE_ORDER = {"8-K": 0, "10-Q": 1, "10-K": 2, "20-F": 3}


def qualifying_events(earnings: DataFrame) -> DataFrame:
    """One filing per report period, earliest kind first; stale and neutral ones drop out."""
    rank = F.lit(99)
    for kind, k in SOURCE_ORDER.items():
        rank = F.when(F.col("source_type") == kind, k).otherwise(rank)
    lag = F.datediff("filing_date", "report_period")
    good = earnings.where(F.col("eps_surprise").isin("BEAT", "MISS")).where(lag < STALE_DAYS)
    body = F.struct("filing_date", "source_type", "eps_surprise")
    return good.groupBy("ticker", "report_period").agg(F.min_by(body, F.struct(rank, "filing_date")).alias("e")).select("ticker", "report_period", "e.*")


def surprise_signal(events: DataFrame, asof: DataFrame, days: int = WINDOW_DAYS) -> DataFrame:
    """+-1 while the latest filing is at most ``days`` old, else 0.

    A filing only matters for the few dates after it, so filings explode to
    those dates and meet the dates by an equi-join.
    """
    live = events.withColumn("as_of", F.explode(F.sequence("filing_date", F.date_add("filing_date", days))))
    newest = live.groupBy("ticker", "as_of").agg(F.max_by("eps_surprise", F.struct("filing_date", "report_period")).alias("s"))
    value = F.when(F.col("s") == "BEAT", 1.0).when(F.col("s") == "MISS", -1.0).otherwise(0.0)
    return asof.join(newest, ["ticker", "as_of"], "left").select("ticker", "as_of", value.alias("value"))

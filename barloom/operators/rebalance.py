"""A fund over a grid of rebalance dates: netted sleeves, drift, costs, and the value against a benchmark.

Between two dates weights drift with prices, and what is traded back is a share of the fund's value. So one date turns
the value V before it into a V + b: a holds the growth of the weights in force and the proportional costs of the
turnover, b holds flat fees of orders and flows of cash. Such maps compose, so the values of all dates are a prefix
scan: maps are composed inside chunks of the calendar, then over chunks, and no task walks over all dates.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from barloom.session import cut_lineage

CADENCES = {"daily": 252.0, "weekly": 52.0, "monthly": 12.0}
#: Calendar days whose maps one task composes.
CHUNK_DAYS = 512


def rebalance_dates(days: DataFrame, cadence: str) -> DataFrame:
    """(date) of a table of trading ``day``s: every day, or the last one of each ISO week or calendar month."""
    if cadence not in CADENCES:
        raise ValueError(f"unknown rebalance cadence {cadence!r}")
    if cadence == "daily":
        return days.select(F.col("day").alias("date")).distinct()
    period = F.date_trunc("week" if cadence == "weekly" else "month", F.col("day").cast("timestamp"))
    return days.groupBy(period.alias("_p")).agg(F.max("day").alias("date")).select("date")


def grid_marks(prices: DataFrame, dates: DataFrame, stale_days: int) -> DataFrame:
    """(date, ticker, mark, fresh): the last close at or before each date; fresh if it is at most ``stale_days`` old.

    A ticker without any close yet has no row. Dates are a calendar, so the rows are tickers times dates, which weights
    need anyway.
    """
    names = prices.select("ticker").distinct()
    wanted = names.join(F.broadcast(dates)).select("ticker", "date", F.lit(1).alias("ask"), F.lit(None).cast("date").alias("day"), F.lit(None).cast("double").alias("c"))  # calendar rows
    seen = prices.select("ticker", F.col("day").alias("date"), F.lit(0).alias("ask"), "day", "c")
    w = Window.partitionBy("ticker").orderBy("date", "ask").rowsBetween(Window.unboundedPreceding, 0)
    filled = seen.unionByName(wanted).select("ticker", "date", "ask", F.last("day", True).over(w).alias("day"), F.last("c", True).over(w).alias("mark"))
    return filled.where("ask = 1 AND mark IS NOT NULL").select("date", "ticker", "mark", (F.datediff("date", "day") <= stale_days).alias("fresh"))


def net_sleeves(weights: DataFrame, slices: dict[str, float]) -> DataFrame:
    """(date, ticker, weight): sleeves of a fund added up by their share of its capital."""
    total = sum(slices.values())
    share = F.create_map(*[F.lit(x) for name, s in slices.items() for x in (name, s / total)])
    return weights.groupBy("date", "ticker").agg(F.sum(F.try_element_at(share, F.col("sleeve")) * F.col("weight")).alias("weight"))


def date_maps(targets: DataFrame, marks: DataFrame, rate: float, ticket: float = 0.0, flows: DataFrame | None = None, least_trade: float = 1e-9) -> DataFrame:
    """(date, growth, turnover, orders, a, b): the map of each date for ``targets`` (date, ticker, weight).

    A ticker without a fresh mark is sold at its last one. ``rate`` is charged on the traded share of the value,
    ``ticket`` on each order, ``flows`` (date, flow) come in after trading.
    """
    w = Window.partitionBy("ticker").orderBy("date")
    held = marks.join(targets, ["date", "ticker"], "left").select(
        "date", "ticker", "mark", F.when(F.col("fresh"), F.coalesce("weight", F.lit(0.0))).otherwise(0.0).alias("weight"))
    moved = cut_lineage(held.select(
        "date", "ticker", "weight", F.coalesce(F.lag("weight").over(w), F.lit(0.0)).alias("before"), F.coalesce(F.col("mark") / F.lag("mark").over(w), F.lit(1.0)).alias("rel")))
    growth = moved.groupBy("date").agg((1 + F.sum(F.col("before") * (F.col("rel") - 1))).alias("growth"))
    traded = F.abs(F.col("weight") - F.coalesce(F.try_divide(F.col("before") * F.col("rel"), F.col("growth")), F.lit(0.0)))
    per = moved.join(growth, "date").groupBy("date").agg(
        F.first("growth").alias("growth"), F.sum(F.when(traded > least_trade, traded).otherwise(0.0)).alias("turnover"), F.count_if(traded > least_trade).alias("orders"))
    flow = F.lit(0.0)
    if flows is not None:
        per, flow = per.join(flows, "date", "left"), F.coalesce("flow", F.lit(0.0))
    return per.select("date", "growth", "turnover", "orders", (F.col("growth") * (1 - rate * F.col("turnover"))).alias("a"), (flow - ticket * F.col("orders")).alias("b"))


def _chunk(date: Column) -> Column:
    return F.floor(F.unix_date(date) / CHUNK_DAYS).cast("int")


def affine_scan(maps: DataFrame, start: float) -> DataFrame:
    """``maps`` (date, a, b) with ``nav``, the value after each date from ``start``, and ``peak``, its running maximum.

    V_t = A_t (V_0 + sum of b_s / A_s) inside a chunk, with A the running product of a. A growth of zero or less ends the
    fund: its value is zero from there on.
    """
    inside = Window.partitionBy("_k").orderBy("date").rowsBetween(Window.unboundedPreceding, 0)
    keyed = maps.withColumn("_k", _chunk(F.col("date"))).withColumn("_bust", F.max((F.col("a") <= 0).cast("int")).over(inside))
    scaled = keyed.withColumn("_A", F.exp(F.sum(F.log(F.when(F.col("a") > 0, F.col("a")).otherwise(1.0))).over(inside)))
    local = cut_lineage(scaled.withColumn("_B", F.sum(F.col("b") / F.col("_A")).over(inside)))
    ends = local.groupBy("_k").agg(F.max_by(F.struct("_A", "_B"), "date").alias("m"), F.max("_bust").alias("_bust"))
    # a row a chunk of the calendar: the same scan over the composed maps
    over = Window.orderBy("_k").rowsBetween(Window.unboundedPreceding, 0)
    before = Window.orderBy("_k").rowsBetween(Window.unboundedPreceding, -1)
    chunked = ends.withColumn("_P", F.exp(F.sum(F.log("m._A")).over(over))).withColumn("_Q", F.sum(F.col("m._B") * F.col("m._A") / F.col("_P")).over(over))
    after = F.col("_P") * (start + F.col("_Q"))
    entries = chunked.select("_k", F.coalesce(F.lag(after).over(Window.orderBy("_k")), F.lit(float(start))).alias("_V"), F.coalesce(F.max("_bust").over(before), F.lit(0)).alias("_gone"))
    nav = F.when((F.col("_bust") > 0) | (F.col("_gone") > 0), 0.0).otherwise(F.col("_A") * (F.col("_V") + F.col("_B")))
    valued = cut_lineage(local.join(F.broadcast(entries), "_k").withColumn("nav", nav))
    tops = valued.groupBy("_k").agg(F.max("nav").alias("_t"))
    high = tops.select("_k", F.coalesce(F.max("_t").over(before), F.lit(float(start))).alias("_h"))
    peak = F.greatest(F.max("nav").over(inside), F.col("_h"), F.lit(float(start)))
    return valued.join(F.broadcast(high), "_k").withColumn("peak", peak).select(*maps.columns, "nav", "peak")


def fund_path(targets: DataFrame, marks: DataFrame, benchmark: DataFrame, capital: float, rate: float, ticket: float = 0.0, flows: DataFrame | None = None) -> DataFrame:
    """One row a date: orders, turnover, the fund's value after trading, its drawdown, and the benchmark on the same capital.

    ``benchmark`` has day and c and a row on every date of the grid.
    """
    path = affine_scan(date_maps(targets, marks, rate, ticket, flows), capital)
    closes = benchmark.select(F.col("day").alias("date"), F.col("c").alias("_c"))
    joined = path.join(closes, "date")
    base = joined.agg(F.min_by("_c", "date")).first()[0]  # one number
    return joined.select(
        "date", "growth", "turnover", "orders", "nav", ((F.col("peak") - F.col("nav")) / F.col("peak")).alias("drawdown"), (F.lit(capital) * F.col("_c") / F.lit(base)).alias("benchmark_nav"))


def fund_metrics(path: DataFrame, capital: float, cadence: str) -> DataFrame:
    """One row: returns, annual Sharpe over the periods, drawdown and excess over the benchmark."""
    before = Window.partitionBy("_k").orderBy("date")
    keyed = path.withColumn("_k", _chunk(F.col("date")))
    last = keyed.groupBy("_k").agg(F.max_by("nav", "date").alias("_e"))
    entry = last.select("_k", F.coalesce(F.lag("_e").over(Window.orderBy("_k")), F.lit(float(capital))).alias("_v"))  # a row a chunk
    rets = keyed.join(F.broadcast(entry), "_k").withColumn("ret", F.try_divide("nav", F.coalesce(F.lag("nav").over(before), F.col("_v"))) - 1)
    agg = rets.agg(
        F.count(F.lit(1)).alias("n_cycles"), F.sum("orders").alias("n_orders"), (F.max_by("nav", "date") / capital - 1).alias("total_return"),
        (F.max_by("benchmark_nav", "date") / capital - 1).alias("benchmark_return"), F.max("drawdown").alias("max_drawdown"),
        F.avg("ret").alias("_m"), F.stddev_samp("ret").alias("_s"), F.greatest(F.datediff(F.max("date"), F.min("date")) / 365.25, F.lit(0.01)).alias("_y"))
    return agg.select(
        "n_cycles", "n_orders", "total_return", (F.pow(1 + F.col("total_return"), 1 / F.col("_y")) - 1).alias("annualized_return"),
        F.when(F.col("_s") > 0, F.col("_m") / F.col("_s") * F.sqrt(F.lit(CADENCES[cadence]))).otherwise(0.0).alias("sharpe"), "max_drawdown", "benchmark_return",
        (F.col("total_return") - F.col("benchmark_return")).alias("excess_return"))

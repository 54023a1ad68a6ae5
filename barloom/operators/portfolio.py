"""Signals to weights to orders to fills, for every rebalance date at once."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from barloom.session import broadcast_if_small, cut_lineage

FEE, SLIP = 0.001, 0.0002


def blend(signals: DataFrame, weights: DataFrame, gross: float = 1.0, neutral: bool = False) -> DataFrame:
    """Weighted mean of non-abstaining models per (date, ticker), scaled to ``gross`` per date."""
    s = signals.join(broadcast_if_small(weights), "model")
    w = F.when(~F.coalesce(F.col("abstained"), F.lit(False)), F.col("weight"))
    total = F.sum(w)
    conviction = F.coalesce(F.when(total != 0, F.sum(w * F.col("value")) / total), F.lit(0.0))
    # Read once for the means, once for the gross and once for the result.
    per = cut_lineage(s.groupBy("date", "ticker").agg(conviction.alias("conviction")))
    # Means and gross per date come back by a join: a date may hold every ticker there is.
    scaled = per
    if neutral:
        means = cut_lineage(per.groupBy("date").agg(F.avg("conviction").alias("_m")))
        scaled = per.join(broadcast_if_small(means), "date").withColumn("_c", F.col("conviction") - F.col("_m")).drop("_m")
    else:
        scaled = per.withColumn("_c", F.col("conviction"))
    sums = cut_lineage(scaled.groupBy("date").agg(F.sum(F.abs("_c")).alias("_g")))
    return scaled.join(broadcast_if_small(sums), "date").select(
        "date", "ticker", "conviction", F.when(F.col("_g") < 1e-9, 0.0).otherwise(F.col("_c") / F.col("_g") * gross).alias("weight")
    )


def apply_limits(weights: DataFrame, max_position: float, max_gross: float) -> DataFrame:
    """Clamp each name, then scale the date down to the gross limit. ``weights`` is read twice."""
    w = F.col("weight")
    clamped = weights.withColumn("_w", F.greatest(F.lit(-max_position), F.least(F.lit(max_position), w)))
    gross = cut_lineage(clamped.groupBy("date").agg(F.sum(F.abs("_w")).alias("_g")))
    scale = F.when(F.col("_g") > max_gross, max_gross / F.col("_g")).otherwise(1.0)
    return clamped.join(broadcast_if_small(gross), "date").select(
        "date", "ticker", F.col("weight").alias("before"), (F.col("_w") * scale).alias("weight"),
        (F.abs(w) > max_position).alias("clamped"), (F.col("_g") > max_gross).alias("scaled"),
    )


def clamp_events(limited: DataFrame, max_position: float) -> DataFrame:
    """One row per name clamp and one per scaled date."""
    names = limited.where("clamped").select("date", F.lit("max_position_pct").alias("limit"), "ticker", "before")
    dates = limited.where("scaled").select("date").distinct().select(
        "date", F.lit("max_gross_exposure").alias("limit"), F.lit(None).cast("string").alias("ticker"), F.lit(None).cast("double").alias("before")
    )
    return names.unionByName(dates)


def build_orders(targets: DataFrame, positions: DataFrame, marks: DataFrame, equity: Column) -> DataFrame:
    """Share deltas from truncated targets against the book; sells sort before buys."""
    # Marks lead, so all three are dealt by (date, ticker) once; only names with a target or a position are priced.
    known = lambda df, flag: df.withColumn(flag, F.lit(True))
    both = marks.join(known(targets, "_t"), ["date", "ticker"], "left").join(known(positions, "_p"), ["date", "ticker"], "left")
    ours = F.coalesce("_t", "_p").isNotNull()
    want = F.when(ours, F.coalesce("weight", F.lit(0.0)) * equity / F.col("mark")).cast("long")
    delta = want - F.coalesce("shares", F.lit(0))
    return both.withColumn("delta", delta).where("delta <> 0").select(
        "date", "ticker", F.when(F.col("delta") > 0, "buy").otherwise("sell").alias("side"), F.abs("delta").alias("quantity"), F.col("mark").alias("price"),
        F.when(F.col("delta") > 0, 1).otherwise(0).alias("priority"),
    )


def signed_fills(orders: DataFrame, fee: float = FEE, slip: float = SLIP) -> DataFrame:
    """Fill prices, fees and signed cash of orders."""
    buy = F.col("side") == "buy"
    fill = F.col("price") * F.when(buy, 1 + slip).otherwise(1 - slip)
    gross = fill * F.col("quantity")
    return orders.withColumn("fill", fill).withColumn("fee", gross * fee).withColumn(
        "cash_flow", F.when(buy, -(gross * (1 + fee))).otherwise(gross * (1 - fee))
    ).withColumn("signed", F.when(buy, F.col("quantity")).otherwise(-F.col("quantity")))


def positions_over_time(fills: DataFrame) -> DataFrame:
    """Position and cash spent per (account, ticker) after each date, one row per date."""
    # Dealt by the window's keys, which the groups can use as well.
    per = fills.repartition("account", "ticker").groupBy("account", "ticker", "date").agg(F.sum("signed").alias("_q"), F.sum("cash_flow").alias("_c"))
    w = Window.partitionBy("account", "ticker").orderBy("date")
    return per.select("account", "ticker", "date", F.sum("_q").over(w).alias("shares"), F.sum("_c").over(w).alias("cash"))


def account_equity(cash: DataFrame, lots: DataFrame, prices: DataFrame) -> DataFrame:
    """Cash plus marked lots per account."""
    held = lots.join(broadcast_if_small(prices), "symbol").groupBy("account").agg(F.sum(F.col("qty") * F.col("price")).alias("_v"))
    return cash.join(held, "account", "left").select("account", (F.col("cash") + F.coalesce("_v", F.lit(0.0))).alias("equity"))


def stopped_lots(lots: DataFrame, prices: DataFrame) -> DataFrame:
    """Lots whose price is at or below their stop."""
    return lots.join(broadcast_if_small(prices), "symbol").where("price <= stop")


def open_risk(lots: DataFrame) -> DataFrame:
    return lots.groupBy("account").agg(F.greatest(F.lit(0.0), F.sum((F.col("entry") - F.col("stop")) * F.col("qty"))).alias("open_risk"))


def path_in_trade(mark: Column, stop: Column, target: Column) -> Column:
    """struct(path, pct): where a mark sits between stop and target."""
    span = target - stop
    pct = F.when(span == 0, 0.5).otherwise(F.least(F.lit(1.0), F.greatest(F.lit(0.0), (mark - stop) / F.when(span != 0, span))))
    return F.struct(F.when(span == 0, "mid").when(pct <= 0.30, "near_stop").when(pct >= 0.70, "near_tp").otherwise("mid").alias("path"), F.round(pct, 4).alias("pct"))


def drawdown_halt(equity: DataFrame, limit: float = 0.15) -> DataFrame:
    """Running peak and the sticky halt of each account."""
    w = Window.partitionBy("account").orderBy("ts").rowsBetween(Window.unboundedPreceding, 0)
    dd = equity.withColumn("peak", F.max("equity").over(w)).withColumn("dd", (F.col("peak") - F.col("equity")) / F.col("peak"))
    return dd.withColumn("halted", F.max("dd").over(w) >= limit)


def fixed_hold_trades(signals: DataFrame, hold: int, threshold: float = 0.0, dollars: float = 10_000.0) -> DataFrame:
    """Edge-triggered trades held ``hold`` rows, never overlapping, equal dollars.

    An entry needs |value| over the threshold while armed. A trade disarms;
    it re-arms on a row at or under the threshold seen outside a trade. That
    greedy walk is the entry rows' own recurrence per ticker, over rows that
    one market calendar bounds.
    """
    from barloom.functions import recur

    w = Window.partitionBy("symbol").orderBy("day")
    n = F.count(F.lit(1)).over(Window.partitionBy("symbol"))
    rows = signals.withColumn("_t", F.row_number().over(w)).withColumn("_on", F.when(F.abs("value") > threshold, 1.0).otherwise(0.0)).withColumn(
        "_room", F.when(F.col("_t") + hold <= n, 1.0).otherwise(0.0)
    )
    out = recur.attach(rows, [("_enter", ("armed_entry", ("_on", "_room"), (("hold", hold),)), "v")])
    w2 = Window.partitionBy("symbol").orderBy("day")
    long = F.col("value") > 0
    trades = out.withColumn("exit_day", F.lead("day", hold).over(w2)).withColumn("exit_price", F.lead("c", hold).over(w2)).where("_enter = 1")
    ret = F.when(long, F.col("exit_price") / F.col("c") - 1).otherwise(1 - F.col("exit_price") / F.col("c"))
    return trades.select(
        "symbol", F.when(long, "long").otherwise("short").alias("direction"), F.col("day").alias("entry_day"), "exit_day",
        F.col("c").alias("entry_price"), "exit_price", (F.lit(dollars) / F.col("c")).alias("shares"), ret.alias("return_pct"), (ret * dollars).alias("pnl"),
    )


def trade_metrics(trades: DataFrame, capital: float = 100_000.0) -> DataFrame:
    """Return, Sharpe by trades per year, drawdown and win rate per symbol."""
    w = Window.partitionBy("symbol").orderBy("entry_day").rowsBetween(Window.unboundedPreceding, 0)
    path = trades.withColumn("_e", capital + F.sum("pnl").over(w)).withColumn("_p", F.greatest(F.max("_e").over(w), F.lit(capital)))
    agg = path.groupBy("symbol").agg(
        F.count(F.lit(1)).alias("n_trades"), (F.sum("pnl") / capital).alias("total_return"),
        F.avg("return_pct").alias("avg_return"), F.stddev_samp("return_pct").alias("_sd"),
        F.max((F.col("_p") - F.col("_e")) / F.col("_p")).alias("max_drawdown"),
        F.avg((F.col("return_pct") > 0).cast("double")).alias("win_rate"), F.count_if(F.col("direction") == "long").alias("n_long"),
        F.greatest(F.datediff(F.max("exit_day"), F.min("entry_day")) / 365.25, F.lit(0.01)).alias("_y"),
    )
    return agg.select(
        "symbol", "n_trades", "n_long", (F.col("n_trades") - F.col("n_long")).alias("n_short"), "total_return", "avg_return", "max_drawdown", "win_rate",
        F.when(F.col("_sd") > 0, F.col("avg_return") / F.col("_sd") * F.sqrt(F.col("n_trades") / F.col("_y"))).otherwise(0.0).alias("sharpe"),
        (F.pow(1 + F.col("total_return"), 1 / F.col("_y")) - 1).alias("annualized"),
    )


def nav(weights: DataFrame, returns: DataFrame) -> DataFrame:
    """Daily portfolio return of the weights in force and the compounded value; a day that loses all ends it at zero."""
    day = weights.join(returns, ["date", "ticker"]).groupBy("date").agg(F.sum(F.col("weight") * F.col("ret")).alias("ret"))
    # One row per date: bounded by the calendar.
    w = Window.orderBy("date").rowsBetween(Window.unboundedPreceding, 0)
    grown = F.when(F.col("ret") <= -1, F.lit(float("-inf"))).otherwise(F.log1p("ret"))
    return day.withColumn("nav", F.exp(F.sum(grown).over(w)))

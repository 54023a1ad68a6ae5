"""Long/flat books from a signal: one trade per island, costs, stop, equity, metrics.

The parallel unit is (symbol, config). A book acts on a day's open with the
signal of the day before; a stop seen on a low fills at the next open and
blocks re-entry until the signal has been off, which is why every island of
the lagged signal is exactly one trade.
"""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from barloom.session import broadcast_if_small, cut_lineage

# Fixed values.
START_CASH = 10_000.0
TAKER_FEE = 0.001
SLIPPAGE = 0.0002
STRESS = (0.002, 0.0007)  # fee doubled, five basis points more slippage
DAYS_PER_YEAR = 365

KEYS = ["symbol", "config"]


def _by_day():
    return Window.partitionBy(*KEYS).orderBy("day")


def trades(signals: DataFrame, fee: float = TAKER_FEE, slip: float = SLIPPAGE, stop: float = 0.20) -> DataFrame:
    """One row per trade of ``signals`` (symbol, config, day, o, h, l, c, signal, scored).

    Only rows with ``scored`` take part; the signal of the row before the
    first scored one may open the first trade.
    """
    w = _by_day()
    lagged = signals.withColumn("on", F.coalesce(F.lag("signal").over(w), F.lit(False))).where("scored")
    marked = (
        lagged.withColumn("_edge", F.when(F.coalesce(F.lag("on").over(w), F.lit(False)) != F.col("on"), 1).otherwise(0))
        .withColumn("island", F.sum("_edge").over(w))
        .withColumn("next_o", F.lead("o").over(w))
        .withColumn("next_day", F.lead("day").over(w))
        .where("on")
    )
    inside = Window.partitionBy(*KEYS, "island").orderBy("day")
    fill = F.first("o").over(inside.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)) * (1 + slip)
    held = marked.withColumn("entry_price", fill).withColumn("_k", F.row_number().over(inside))
    if stop > 0:
        hit = F.when(F.col("l") <= F.col("entry_price") * (1 - stop), F.col("_k"))
    else:
        hit = F.lit(None).cast("int")
    held = held.withColumn("_hit", hit)
    row = F.struct("day", "c", "next_day", "next_o")
    one = held.groupBy(*KEYS, "island").agg(
        F.min("day").alias("entry_day"),
        F.first("entry_price").alias("entry_price"),
        F.min("_hit").alias("_hit_k"),
        F.min_by(row, F.when(F.col("_hit").isNotNull(), F.col("_k"))).alias("_hit_row"),
        F.max_by(row, F.col("_k")).alias("_last"),
        F.max("_k").alias("_n"),
    )
    stopped = F.col("_hit_k").isNotNull()
    at = F.when(stopped, F.col("_hit_row")).otherwise(F.col("_last"))
    ended = at["next_o"].isNull()
    exit_ref = F.when(ended, at["c"]).otherwise(at["next_o"])
    gain = exit_ref * (1 - slip) * (1 - fee) / (F.col("entry_price") * (1 + fee))
    return one.select(
        *KEYS,
        "island",
        "entry_day",
        "entry_price",
        F.when(ended, at["day"]).otherwise(at["next_day"]).alias("exit_day"),
        (exit_ref * (1 - slip)).alias("exit_price"),
        F.when(stopped, "safety_stop").when(ended, "window_end").otherwise("signal").alias("reason"),
        F.when(stopped, F.col("_hit_k")).otherwise(F.col("_n")).alias("days"),
        gain.alias("factor"),
        ended.alias("at_end"),
    )


def cash_path(trade_rows: DataFrame, start_cash: float = START_CASH) -> DataFrame:
    """Trades with quantity, fees, P&L and the cash before and after each."""
    w = Window.partitionBy(*KEYS).orderBy("entry_day")
    grown = F.exp(F.sum(F.log("factor")).over(w.rowsBetween(Window.unboundedPreceding, 0)))
    after = F.lit(start_cash) * grown
    return (
        trade_rows.withColumn("cash_after", after)
        .withColumn("cash_before", F.col("cash_after") / F.col("factor"))
        .withColumn("pnl", F.col("cash_after") - F.col("cash_before"))
        .withColumn("pnl_pct", F.col("exit_price") / F.col("entry_price") - 1)
    )


def equity_curve(
    signals: DataFrame, paths: DataFrame, fee: float = TAKER_FEE, start_cash: float = START_CASH
) -> DataFrame:
    """Equity at each scored close: cash when flat, marked quantity when long.

    Trades are carried over the days of their own (symbol, config) by window,
    so no range join is needed.
    """
    days = signals.where("scored").select(*KEYS, "day", "c")
    opened = paths.select(*KEYS, F.col("entry_day").alias("day"), F.struct(
        "cash_before", "cash_after", "entry_price", "exit_day", "at_end").alias("tr"))
    w = _by_day().rowsBetween(Window.unboundedPreceding, 0)
    carried = days.join(opened, [*KEYS, "day"], "left").withColumn("tr", F.last("tr", ignorenulls=True).over(w))
    qty = F.col("tr.cash_before") / (F.col("tr.entry_price") * (1 + fee))
    long = (F.col("day") < F.col("tr.exit_day")) | (F.col("tr.at_end") & (F.col("day") == F.col("tr.exit_day")))
    is_last = F.lead("day").over(_by_day()).isNull()
    settled = F.col("tr.at_end") & is_last
    equity = (
        F.when(F.col("tr").isNull(), F.lit(start_cash))
        .when(settled, F.col("tr.cash_after"))
        .when(long, qty * F.col("c"))
        .otherwise(F.col("tr.cash_after"))
    )
    return carried.select(*KEYS, "day", equity.alias("equity"), F.coalesce(long, F.lit(False)).alias("long"))


def equity_returns(curve: DataFrame, start_cash: float = START_CASH) -> DataFrame:
    prev = F.coalesce(F.lag("equity").over(_by_day()), F.lit(start_cash))
    return curve.withColumn("ret", F.when(prev > 0, F.col("equity") / prev - 1))


def sharpe(ret, per_year: int = DAYS_PER_YEAR):
    """Mean over sample deviation, annualised; 0 without variation."""
    sd = F.stddev_samp(ret)
    return F.when(sd > 1e-12, F.avg(ret) / sd * math.sqrt(per_year)).otherwise(0.0)


def book_metrics(curve: DataFrame, paths: DataFrame, start_cash: float = START_CASH) -> DataFrame:
    """Per (symbol, config): P&L, return, Sharpe, drawdown, exposure, trades, win rate, exits."""
    w = _by_day().rowsBetween(Window.unboundedPreceding, 0)
    rets = equity_returns(curve, start_cash).withColumn(
        "_peak", F.greatest(F.max("equity").over(w), F.lit(start_cash))
    )
    per_day = rets.groupBy(*KEYS).agg(
        F.max_by("equity", "day").alias("final_equity"),
        sharpe(F.col("ret")).alias("daily_sharpe"),
        F.max((F.col("_peak") - F.col("equity")) / F.col("_peak")).alias("max_drawdown"),
        F.avg(F.col("long").cast("double")).alias("exposure"),
        F.count(F.lit(1)).alias("days"),
    )
    per_trade = paths.groupBy(*KEYS).agg(
        F.count(F.lit(1)).alias("trades"),
        F.avg((F.col("pnl") > 0).cast("double")).alias("win_rate"),
        F.avg("days").alias("avg_hold_days"),
        *[F.count_if(F.col("reason") == r).alias(f"exits_{r}") for r in ("signal", "safety_stop", "window_end")],
    )
    return (
        per_day.join(per_trade, KEYS, "left")
        .withColumn("pnl", F.col("final_equity") - start_cash)
        .withColumn("total_return", F.col("final_equity") / start_cash - 1)
        .fillna(0, ["trades", "exits_signal", "exits_safety_stop", "exits_window_end"])
        .fillna(0.0, ["win_rate"])
    )


def run_books(
    signals: DataFrame, fee: float = TAKER_FEE, slip: float = SLIPPAGE, stop: float = 0.20
) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(trades with cash, equity curve, metrics).

    Signals feed the trades and the curve, and trades feed the curve and the
    metrics, so each is written once instead of being computed again.
    """
    signals = cut_lineage(signals.select(*KEYS, "day", "o", "h", "l", "c", "signal", "scored"))
    paths = cut_lineage(cash_path(trades(signals, fee, slip, stop)))
    curve = equity_curve(signals, paths, fee)
    return paths, curve, book_metrics(curve, paths)


def segment_metrics(curve: DataFrame, paths: DataFrame, blocks: DataFrame, start_cash: float = START_CASH) -> DataFrame:
    """P&L of each block on a fresh start of ``start_cash`` and the trades that exit in it.

    ``blocks`` is (symbol, block, block_day, block_end_day), a few rows per symbol.
    """
    small = broadcast_if_small(blocks)
    prev = equity_returns(curve, start_cash).withColumn(
        "_open", F.coalesce(F.lag("equity").over(_by_day()), F.lit(start_cash))
    )
    days = prev.join(small, "symbol").where("day >= block_day AND day < block_end_day")
    pnl = days.groupBy(*KEYS, "block").agg(
        (start_cash * (F.max_by("equity", "day") / F.min_by("_open", "day") - 1)).alias("block_pnl"),
        F.avg("ret").alias("mean_ret"),
    )
    done = (
        paths.join(small, "symbol")
        .where("exit_day >= block_day AND exit_day < block_end_day")
        .groupBy(*KEYS, "block")
        .agg(F.count(F.lit(1)).alias("block_trades"))
    )
    return pnl.join(done, [*KEYS, "block"], "left").fillna(0, ["block_trades"])


def with_bars(sig: DataFrame, bars: DataFrame, score_from: int = 1) -> DataFrame:
    """Signal rows with prices and the scored flag from row index ``score_from``."""
    return sig.join(bars.select("symbol", "day", "o", "h", "l", "c"), ["symbol", "day"]).withColumn(
        "scored", F.col("t") >= score_from
    )


# --- buy and hold ---------------------------------------------------------------

def hold_pnl(ends: DataFrame, by: list[str], start_cash: float = START_CASH, fee: float = TAKER_FEE, slip: float = SLIPPAGE) -> DataFrame:
    """Equal-weight round trip of (first_price, last_price) rows, costs on both sides."""
    share = F.lit(start_cash) / F.count(F.lit(1)).over(Window.partitionBy(*by))
    qty = share / (F.col("first_price") * (1 + slip) * (1 + fee))
    out = qty * F.col("last_price") * (1 - slip) * (1 - fee)
    mark = qty * F.col("last_price")
    return (
        ends.where("first_price > 0 AND last_price > 0")
        .withColumn("_out", out)
        .withColumn("_mark", mark)
        .groupBy(*by)
        .agg((F.sum("_out") - start_cash).alias("realized_pnl"), F.sum("_mark").alias("marked_equity"))
    )


def price_ends(bars: DataFrame, by: list[str], at: str = "day") -> DataFrame:
    """First and last close per symbol and group; a single bar is no span."""
    return (
        bars.groupBy("symbol", *by)
        .agg(F.min_by("c", at).alias("first_price"), F.max_by("c", at).alias("last_price"), F.count(F.lit(1)).alias("_n"))
        .where("_n >= 2")
        .drop("_n")
    )


def year_drawdowns(levels: DataFrame, years: list[int], level: str = "equity") -> DataFrame:
    """(symbol, config, year, days, ret, max_drawdown) of a daily level inside calendar years, each on its own."""
    inside = Window.partitionBy(*KEYS, "year").orderBy("day").rowsBetween(Window.unboundedPreceding, 0)
    rows = levels.withColumn("year", F.year("day")).where(F.col("year").isin(*years)).withColumn("_top", F.max(level).over(inside))
    return rows.groupBy(*KEYS, "year").agg(
        F.count(F.lit(1)).alias("days"), (F.max_by(level, "day") / F.min_by(level, "day") - 1).alias("ret"), F.max((F.col("_top") - F.col(level)) / F.col("_top")).alias("max_drawdown"))


def hold_sampled(indexed: DataFrame, every: int, cash: float = START_CASH, fee: float = TAKER_FEE, slip: float = SLIPPAGE) -> DataFrame:
    """(rn, equity): buy and hold of every symbol on its own ``cash``, sampled at every ``every``-th bar, sold at the last one.

    ``indexed`` has symbol, rn (0-based), c. Symbols of one bar, or without a positive first and last close, are left out;
    the series ends with the shortest of the others. The first point, at rn -1, is the cash.
    """
    ends = indexed.groupBy("symbol").agg(F.min_by("c", "rn").alias("_p"), F.max_by("c", "rn").alias("_e"), F.max("rn").alias("_m")).where("_m >= 1 AND _p > 0 AND _e > 0")
    last = ends.agg(F.min("_m")).first()[0]  # one number
    if last is None:
        return indexed.select("rn", F.col("c").alias("equity")).limit(0)
    held = ends.select("symbol", (F.lit(cash) / (F.col("_p") * (1 + slip) * (1 + fee))).alias("_q"))
    sampled = indexed.where((F.col("rn") <= last) & ((F.col("rn") % every == every - 1) | (F.col("rn") == last))).join(broadcast_if_small(held), "symbol")
    net = F.when(F.col("rn") == last, (1 - slip) * (1 - fee)).otherwise(1.0)
    points = sampled.groupBy("rn").agg(F.sum(F.col("_q") * F.col("c") * net).alias("equity"))
    start = ends.agg(F.lit(-1).cast("long").alias("rn"), (F.count(F.lit(1)) * cash).alias("equity"))
    return start.unionByName(points.withColumn("rn", F.col("rn").cast("long")))


def points_sharpe(points: DataFrame) -> DataFrame:
    """One row: the annual Sharpe of a sampled equity curve, a row a day."""
    rets = points.select((F.col("equity") / F.lag("equity").over(Window.orderBy("rn")) - 1).alias("ret"))
    return rets.agg(F.count("ret").alias("n"), sharpe(F.col("ret")).alias("daily_sharpe"))


def hold_marked(anchors: DataFrame, prices: DataFrame, cash: float = START_CASH, fee: float = TAKER_FEE, slip: float = SLIPPAGE) -> DataFrame:
    """One row: equal shares of ``cash`` bought at the anchor prices with costs, marked at the newest ones.

    Both frames are (symbol, price); a symbol counts where both prices are positive. Without any the equity is null.
    """
    both = anchors.join(prices.select("symbol", F.col("price").alias("_now")), "symbol").where("price > 0 AND _now > 0")
    return both.agg(F.count(F.lit(1)).alias("symbols"), (F.sum(F.col("_now") / (F.col("price") * (1 + slip) * (1 + fee))) / F.count(F.lit(1)) * cash).alias("equity"))

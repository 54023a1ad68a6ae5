"""The whole gate of expression names: windows, sealed span, neighbours, overfitting, cost stress and another asset.

A name and its parameter neighbours become one signal frame. Its rows are exploded by span (each walk-forward window and
the sealed span) and by cost, and (name, span, cost) is the key of a book, so every book of the gate comes out of one
pass over one written frame: the window P&L, the sealed metrics, the stressed ones and the daily returns of all windows
end to end.
"""

from __future__ import annotations

import datetime as dt

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from barloom.functions import atoms as A
from barloom.functions import stats as S
from barloom.operators import books as K
from barloom.operators import gates as G
from barloom.operators import names as N
from barloom.plans import library
from barloom.session import cut_lineage

SEALED = "sealed"
#: Fixed value: trades that the sealed span must hold.
HOLDOUT_MIN_TRADES = 8
CROSS_MIN_SHARPE = 0.0


def window_spans(bars: DataFrame, score_from: int, sealed_from: dt.date, days: int) -> DataFrame:
    """(symbol, span, first_day, end_day): whole windows of ``days`` back from the sealed day, then the sealed span itself."""
    dated = bars.select("symbol", "day", F.row_number().over(Window.partitionBy("symbol").orderBy("day")).alias("_t")).where(F.col("_t") > score_from)
    edge = F.lit(sealed_from)
    known = dated.groupBy("symbol").agg(F.min("day").alias("a"), F.max("day").alias("z"))
    n = F.floor(F.datediff(edge, F.col("a")) / days).cast("int")
    windows = known.select("symbol", F.explode(F.when(n > 0, F.sequence(F.lit(1), n)).otherwise(F.array().cast("array<int>"))).alias("k")).select(
        "symbol", F.format_string("w%04d", "k").alias("span"), F.date_sub(edge, F.col("k") * days).alias("first_day"), F.date_sub(edge, (F.col("k") - 1) * days).alias("end_day"))
    sealed = known.where(F.col("z") >= edge).select("symbol", F.lit(SEALED).alias("span"), edge.alias("first_day"), F.date_add("z", 1).alias("end_day"))
    return windows.unionByName(sealed)


def keyed_books(sig: DataFrame, spans: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(metrics, daily returns) of every (symbol, config, span, cost) of ``sig`` (symbol, config, day, o, h, l, c, signal).

    A book starts flat in its span; the signal of the row before the span may open its first trade. Spans are a few rows
    a symbol; a row stays with those that hold it, and the row before a span with that span.
    """
    dated = sig.withColumn("_next", F.lead("day").over(Window.partitionBy(*K.KEYS).orderBy("day")))
    costs = F.explode(F.array(F.lit("base"), F.lit("stress"))).alias("cost")
    near = dated.join(spans, "symbol").where("day < end_day AND (day >= first_day OR _next >= first_day)").select("*", costs)
    key = F.concat_ws("#", "config", "span", "cost")
    rows = near.select("symbol", key.alias("config"), "day", "o", "h", "l", "c", "signal", (F.col("day") >= F.col("first_day")).alias("scored"))
    stressed = F.col("config").endswith("#stress")
    fee, slip = (F.when(stressed, K.STRESS[i]).otherwise((K.TAKER_FEE, K.SLIPPAGE)[i]) for i in (0, 1))
    paths, curve, metrics = K.run_books(rows, fee, slip)
    parts = F.split("config", "#")
    split = lambda df: df.withColumns({"span": parts[1], "cost": parts[2], "config": parts[0]})
    return cut_lineage(split(metrics)), split(K.equity_returns(curve))


def signal_frame(bars: DataFrame, names: list[str]) -> DataFrame:
    return cut_lineage(A.long_flags(bars, names).select("symbol", "config", "day", "o", "h", "l", "c", F.coalesce("signal", F.lit(False)).alias("signal")))


def expression_gates(
    bars: DataFrame, names: list[str], caps: DataFrame, score_from: int, sealed_from: dt.date, days: int, n_trials: int, cross: dict[str, str] | None = None,
) -> DataFrame:
    """One row per (symbol, name) with every check of the gate, its measures and the failing checks in order.

    ``names`` are a list the caller holds; their neighbours follow from the naming rules. ``cross`` names each symbol's
    other asset; its check is soft and never fails a name.
    """
    spark = bars.sparkSession
    wanted = spark.createDataFrame([(n,) for n in names], "name string")
    pairs = cut_lineage(N.neighbour_names(wanted, caps).select(F.col("name").alias("config"), "neighbour").distinct())
    every = sorted({*names, *[r["neighbour"] for r in pairs.select("neighbour").distinct().collect()]})  # a few a name
    bars = cut_lineage(bars)
    sma = library.sma_stack(bars).select("symbol", "day", F.lit("sma_stack").alias("config"), "signal")
    held = K.with_bars(sma.withColumn("t", F.lit(1)), bars).select("symbol", "config", "day", "o", "h", "l", "c", F.coalesce("signal", F.lit(False)).alias("signal"))
    sig = signal_frame(bars, every).unionByName(held)
    metrics, rets = keyed_books(sig, cut_lineage(window_spans(bars, score_from, sealed_from, days)))
    return decided(metrics, rets, names, pairs, n_trials, cross)


def window_totals(metrics: DataFrame) -> DataFrame:
    """Per (symbol, config, cost): windows, mean Sharpe, trades, P&L and worst drawdown over the windows."""
    return metrics.where(F.col("span") != SEALED).groupBy("symbol", "config", "cost").agg(
        F.count(F.lit(1)).alias("windows"), F.avg("daily_sharpe").alias("sharpe"), F.sum("trades").alias("trades"), F.sum("pnl").alias("pnl"), F.max("max_drawdown").alias("max_drawdown"))


def joined_sharpe(rets: DataFrame) -> DataFrame:
    """Annual Sharpe of the daily returns of all windows end to end, per (symbol, config, cost)."""
    return rets.where(F.col("span") != SEALED).groupBy("symbol", "config", "cost").agg(K.sharpe(F.col("ret")).alias("joined_sharpe"))


def decided(metrics: DataFrame, rets: DataFrame, names: list[str], pairs: DataFrame, n_trials: int, cross: dict[str, str] | None) -> DataFrame:
    keys = ["symbol", "config"]
    mine = F.col("config").isin(names)
    totals = cut_lineage(window_totals(metrics))
    base = totals.where("cost = 'base'").drop("cost")
    ok = G.base_floors_ok().alias("passed")
    near = G.neighbour_fraction(base.select(*keys, ok), pairs).where(mine).select(*keys, "neighbours", "neighbours_pass", "neighbours_ok")
    stress = totals.where(mine & (F.col("cost") == "stress")).select(*keys, F.col("sharpe").alias("stress_sharpe"))
    ends = joined_sharpe(rets.where(mine)).groupBy(*keys).agg(*[F.max(F.when(F.col("cost") == c, F.col("joined_sharpe"))).alias(f"{c}_joined_sharpe") for c in ("base", "stress")])
    moments = S.return_moments(rets.where(mine & (F.col("cost") == "base") & (F.col("span") != SEALED)), keys)
    dsr = S.with_deflated_sharpe(moments, F.lit(n_trials)).select(*keys, "dsr", F.col("n").alias("return_n"))
    # a name's matrix: its own windows and its neighbours'
    both = pairs.select(F.col("config").alias("of"), F.col("neighbour").alias("config")).unionByName(pairs.select(F.col("config").alias("of"), "config").distinct())
    place = F.dense_rank().over(Window.partitionBy("symbol", "of").orderBy("span")) - 1
    cells = metrics.where((F.col("span") != SEALED) & (F.col("cost") == "base")).join(both, "config").select(
        "symbol", F.col("of"), place.alias("block"), F.when(F.col("config") == F.col("of"), "").otherwise(F.col("config")).alias("ord"), F.col("pnl").alias("value"))
    pbo = S.overfitting_probability(cells, ["symbol", "of"]).select("symbol", F.col("of").alias("config"), "pbo")
    sealed = metrics.where((F.col("span") == SEALED) & (F.col("cost") == "base"))
    bench = sealed.where("config = 'sma_stack'").select("symbol", F.col("pnl").alias("sma_sealed_pnl"))
    hold = sealed.where(mine).select(*keys, F.col("pnl").alias("sealed_pnl"), F.col("trades").alias("sealed_trades"), F.col("daily_sharpe").alias("sealed_sharpe"))
    full = base.where(mine)
    for part in (near, stress, ends, dsr, pbo, hold):
        full = full.join(part, keys, "left")
    full = full.join(bench, "symbol", "left")
    if cross:
        other = F.create_map(*[F.lit(x) for pair in cross.items() for x in pair])
        seen = base.where(mine).select(F.col("symbol").alias("other"), "config", F.col("sharpe").alias("cross_sharpe"))
        full = full.withColumn("other", F.try_element_at(other, F.col("symbol"))).join(seen, ["other", "config"], "left").drop("other")
    else:
        full = full.withColumn("cross_sharpe", F.lit(None).cast("double"))
    return checked(full)


def checked(rows: DataFrame) -> DataFrame:
    """Checks in their fixed order; a measure that is missing fails its check, but for the soft one on the other asset."""
    c, yes = F.col, lambda x: F.coalesce(x, F.lit(False))
    checks = {
        "holdout_sharpe": yes(c("sealed_sharpe") >= G.MIN_SHARPE), "holdout_trades": yes(c("sealed_trades") >= HOLDOUT_MIN_TRADES),
        "holdout_pnl": yes(c("sealed_pnl") > c("sma_sealed_pnl")), "dsr": yes(c("dsr") >= G.DSR_MIN), "neighbours": yes(c("neighbours_ok")),
        "pbo": yes(c("pbo") <= G.PBO_MAX), "cost": yes(c("stress_sharpe") >= G.MIN_SHARPE),
    }
    failed = F.array_compact(F.array(*[F.when(~ok, F.lit(name)) for name, ok in checks.items()]))
    cross = F.when(c("cross_sharpe").isNotNull(), c("cross_sharpe") > CROSS_MIN_SHARPE)
    return rows.withColumns({"failed": failed, "cross_pass": cross}).withColumn("passed", F.size("failed") == 0)

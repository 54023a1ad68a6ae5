"""The whole evaluation of rule configs: books, stress, holdout, statistics, verdict.

All configs of all symbols run as one set of frames; nothing loops over names.
The signal frame is written once and every book reads it back.
"""

from __future__ import annotations

import datetime as dt

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from barloom.functions import stats as S
from barloom.operators import books as K
from barloom.operators import gates as G
from barloom.operators import windows as WN
from barloom.plans import library
from barloom.session import broadcast_if_small, cut_lineage


def day_blocks(sig: DataFrame) -> DataFrame:
    """Equal blocks of each symbol's scored span, in whole days."""
    at = F.expr("unix_date(day)")
    spans = sig.where("scored").groupBy("symbol").agg(F.min(at).cast("long").alias("a"), (F.max(at) + 1).cast("long").alias("z"))
    tiled = WN.tile_blocks(spans.selectExpr("symbol", "a * 86400L AS s0", "z * 86400L AS s1"), "s0", "s1")
    edge = "date_add(date_from_unix_date(CAST(s0 div 86400 AS INT)), CAST(({x} - s0) div 86400 AS INT))"
    return tiled.selectExpr("symbol", "block", edge.format(x="block_start") + " AS block_day", edge.format(x="block_end") + " AS block_end_day")


def span(sig: DataFrame, score_from: int, sealed_from: dt.date, sealed: bool) -> DataFrame:
    """Rows of one span with ``scored`` set: discovery cannot see sealed days; the sealed span keeps the days before it to warm up.

    The sealed span is the same dates for every symbol, however long its series is."""
    if not sealed:
        return G.discovery_rows(sig, sealed_from).withColumn("scored", F.col("t") >= score_from)
    return sig.withColumn("scored", (F.col("t") >= score_from) & (F.col("day") >= F.lit(sealed_from)))


def warmed(sig: DataFrame) -> DataFrame:
    """Rows unchanged; a scored day on which a config is not defined yet fails the job."""
    ok = F.assert_true(~F.col("scored") | F.coalesce("ready", F.lit(False)), F.concat(F.lit("scored before it is warm: "), F.col("config")))
    return sig.where(ok.isNull())


def span_books(sig: DataFrame, score_from: int, sealed_from: dt.date) -> DataFrame:
    """Base and stress books on the discovery and the sealed span, side by side per config."""
    out = None
    for tag, sealed, costs in (
        ("oos", False, (K.TAKER_FEE, K.SLIPPAGE)), ("holdout", True, (K.TAKER_FEE, K.SLIPPAGE)), ("stress_oos", False, K.STRESS), ("stress_holdout", True, K.STRESS)
    ):
        rows = span(sig, score_from, sealed_from, sealed)
        m = K.run_books(rows, *costs)[2].select(
            *K.KEYS, F.col("pnl").alias(f"{tag}_pnl"), F.col("trades").alias(f"{tag}_trades"), F.col("daily_sharpe").alias(f"{tag}_sharpe")
        )
        out = m if out is None else out.join(m, K.KEYS)
    return out


def evaluate(bars: DataFrame, keys: list[str], score_from: int, sealed_from: dt.date, n_trials: int | None = None) -> DataFrame:
    """One verdict row per (symbol, config) of the wanted rules."""
    spark = bars.sparkSession
    sig = cut_lineage(warmed(K.with_bars(library.signals(bars, keys), bars, score_from)))
    grid = library.grid_frame(spark).where(F.col("rule").isin(*keys))
    rows = cut_lineage(span_books(sig, score_from, sealed_from))
    profit = F.forall(F.array(*[F.coalesce(F.col(f"{t}_pnl") > 0, F.lit(False)) for t in ("oos", "holdout", "stress_oos", "stress_holdout")]), lambda ok: ok)
    rows = G.neighbour_fraction(rows.withColumn("passed", profit), library.neighbours(grid))
    seen = span(sig, score_from, sealed_from, False)
    paths, curve, _ = K.run_books(seen)
    curve = cut_lineage(curve)
    moments = S.return_moments(K.equity_returns(curve), K.KEYS)
    n = n_trials or sum(1 for k in library.RULES.values() for _ in k.configs())
    dsr = S.with_deflated_sharpe(moments, F.lit(n)).select(*K.KEYS, "dsr")
    blocks = day_blocks(seen)
    perf = cut_lineage(K.segment_metrics(curve, paths, blocks).join(F.broadcast(grid.select("config", "rule")), "config"))
    # The blocks a book was found in, against the blocks that tile its span.
    found = perf.groupBy(*K.KEYS).agg(F.countDistinct("block").cast("int").alias("n_windows"))
    tiles = blocks.groupBy("symbol").agg(F.count(F.lit(1)).cast("int").alias("expected_windows"))
    pbo = S.overfitting_probability(
        perf.select("symbol", "rule", "block", F.col("config").alias("ord"), F.col("block_pnl").alias("value")), ["symbol", "rule"]
    ).select("symbol", "rule", "pbo")
    bench = _benchmarks(bars, score_from, sealed_from)
    full = (
        rows.join(dsr, K.KEYS, "left").join(F.broadcast(grid.select("config", "rule")), "config").join(pbo, ["symbol", "rule"], "left")
        .join(broadcast_if_small(bench), "symbol").join(found, K.KEYS, "left").join(tiles, "symbol", "left").fillna(0, ["n_windows"])
    )
    return G.library_verdict(full)


def _benchmarks(bars: DataFrame, score_from: int, sealed_from: dt.date) -> DataFrame:
    """Buy-and-hold and average-stack P&L of both spans, one row per symbol."""
    stack = library.sma_stack(bars)
    held = stack.withColumn("signal", F.lit(True)).withColumn("config", F.lit("bh"))
    both = K.with_bars(stack.withColumn("config", F.lit("sma")).unionByName(held), bars, score_from)
    out = None
    for tag, sealed in (("oos", False), ("holdout", True)):
        rows = span(both, score_from, sealed_from, sealed)
        m = K.run_books(rows, stop=0)[2].groupBy("symbol").agg(
            F.max(F.when(F.col("config") == "sma", F.col("pnl"))).alias(f"sma_{tag}_pnl"), F.max(F.when(F.col("config") == "bh", F.col("pnl"))).alias(f"bh_{tag}_pnl")
        )
        out = m if out is None else out.join(m, "symbol")
    return out

"""Accounts, their lots and lifecycle: joins of stored rows with latest marks and rules."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from barloom.operators import gates as G
from barloom.operators import portfolio as P
from barloom.operators.results import latest_per_name
from barloom.session import broadcast_if_small, cut_lineage
from barloom.sources import store


def open_lots_by_account(lots: DataFrame) -> DataFrame:
    return lots.groupBy("account").agg(F.count(F.lit(1)).alias("open_lots"))


def attach_open_lots(accounts: DataFrame, lots: DataFrame) -> DataFrame:
    return accounts.join(open_lots_by_account(lots), "account", "left").fillna(0, ["open_lots"])


def momentum_gate(name: Column, returns: Column) -> Column:
    """struct(kind, lookback, ret, threshold) of a single momentum or dip name; ``returns`` maps lookback to return."""
    pattern = r"^(mom|dip)_(\d+)b?_(?:gt|lt)_?(\d+)(?:pc)?$"
    kind, look = F.regexp_extract(name, pattern, 1), F.regexp_extract(name, pattern, 2).try_cast("int")
    thr = F.regexp_extract(name, pattern, 3).try_cast("double") / 100 * F.when(kind == "dip", -1).otherwise(1)
    ret = F.try_element_at(returns, look)
    gate = F.struct(kind.alias("kind"), look.alias("lookback"), F.round(ret, 4).alias("ret"), F.round(thr, 4).alias("threshold"))
    return F.when(name.rlike(pattern) & ret.isNotNull(), gate)


def lot_view(lots: DataFrame, marks: DataFrame, signals: DataFrame) -> DataFrame:
    """Open lots with mark, unrealised P&L, place between stop and target, and rule state.

    ``signals`` is the newest (symbol, config, signal); a lot without one is unknown.
    """
    target = F.col("entry") + 2 * (F.col("entry") - F.col("stop"))
    state = F.when(F.col("signal").isNull(), "unknown").when(F.col("signal"), "on").otherwise("would_exit")
    rows = lots.join(broadcast_if_small(marks), "symbol", "left").join(broadcast_if_small(signals), ["symbol", "config"], "left")
    return (
        rows.withColumn("take_profit", target)
        .withColumn("z", P.path_in_trade(F.col("price"), F.col("stop"), target))
        .select(*lots.columns, "price", "take_profit", ((F.col("price") - F.col("entry")) * F.col("qty")).alias("unrealised"),
                F.col("z.path").alias("path"), F.col("z.pct").alias("pct"), state.alias("state"))
    )


def live_preview(accounts: DataFrame, lots: DataFrame, marks: DataFrame) -> DataFrame:
    """Unrealised P&L and live equity per account with cash."""
    open_ = lots.join(broadcast_if_small(marks), "symbol").groupBy("account").agg(
        F.sum((F.col("price") - F.col("entry")) * F.col("qty")).alias("unrealised"), F.sum(F.col("price") * F.col("qty")).alias("_v"),
        F.count(F.lit(1)).alias("open_lots"),
    )
    return accounts.join(open_, "account", "left").fillna(0, ["unrealised", "_v", "open_lots"]).withColumn("equity", F.col("cash") + F.col("_v")).drop("_v")


def orphans(accounts: DataFrame, *known: DataFrame) -> DataFrame:
    """Accounts that none of the registers knows."""
    return reduce(lambda a, k: a.join(k.select("name"), "name", "left_anti"), known, accounts)


def first_metrics(rows: DataFrame, *sources: DataFrame, value: str) -> DataFrame:
    """The value of each name's own row, else of the first source that has it."""
    out = rows
    for k, s in enumerate(sources):
        out = out.join(s.select("name", F.col(value).alias(f"_v{k}")), "name", "left")
    picked = F.coalesce(F.col(value), *[F.col(f"_v{k}") for k in range(len(sources))])
    return out.withColumn(value, picked).drop(*[f"_v{k}" for k in range(len(sources))])


def training_rows(metrics: DataFrame, results: DataFrame) -> DataFrame:
    """Newest metrics joined with full results; parked rows and rows without any score drop out."""
    m = latest_per_name(metrics).select("name", F.col("sharpe").alias("_s"), F.col("trades").alias("_t"), F.col("ops_park").alias("_p"))
    r = latest_per_name(results).select("name", "sharpe", "trades", "test_pnl", "bh_oos_pnl", "ops_park")
    parked = F.coalesce("_p", F.lit(False)) | F.coalesce("ops_park", F.lit(False))
    sharpe = F.coalesce("_s", "sharpe")
    usable = sharpe.isNotNull() | (F.col("test_pnl").isNotNull() & F.col("bh_oos_pnl").isNotNull())
    return m.join(r, "name", "full_outer").where(~parked & usable & ~F.col("name").startswith("lib.")).select(
        "name", sharpe.alias("sharpe"), F.coalesce("_t", "trades").alias("trades"), "test_pnl", "bh_oos_pnl"
    )


def champion_since(trades: DataFrame, log: DataFrame) -> DataFrame:
    """First trade of a name, else the time it first qualified."""
    first = trades.groupBy("name").agg(F.min("entry_ts").alias("_f"))
    passed = log.where("qualified").groupBy("name").agg(F.min("tested_at").alias("_q"))
    return first.join(passed, "name", "full_outer").select("name", F.coalesce("_f", "_q").alias("since"))


def paper_against_hold(trades: DataFrame, start_cash: float = 10_000.0) -> DataFrame:
    """Paper P&L of each account beside buy-and-hold from its first entry to its last exit."""
    from barloom.operators.books import hold_pnl

    ends = trades.where("exit_price IS NOT NULL").groupBy("account", "symbol").agg(
        F.min_by("entry_price", "entry_ts").alias("first_price"), F.max_by("exit_price", "exit_ts").alias("last_price")
    )
    paper = trades.groupBy("account").agg(F.sum("pnl").alias("paper_pnl"))
    out = paper.join(hold_pnl(ends, ["account"], start_cash), "account")
    return out.select("account", "paper_pnl", F.col("realized_pnl").alias("hold_pnl"), (F.col("paper_pnl") > F.col("realized_pnl")).alias("beats"))


def anchors(prices: DataFrame) -> DataFrame:
    """First seen price per symbol, the anchor of the live benchmark."""
    return prices.groupBy("symbol").agg(F.min_by("price", "ts").alias("first_price"))


def library_table(grid: DataFrame, results: DataFrame, tested: DataFrame, leased: DataFrame) -> DataFrame:
    """Catalog configs with stored results and tested / leased flags."""
    flag = lambda df, n: df.select(F.col("name").alias("config"), F.lit(True).alias(n)).distinct()
    return (
        grid.join(results.withColumnRenamed("name", "config"), "config", "left")
        .join(flag(tested, "tested"), "config", "left").join(flag(leased, "leased"), "config", "left")
        .fillna(False, ["tested", "leased"])
    )


def progress(table: DataFrame) -> DataFrame:
    return table.agg(
        F.count_if("tested").alias("tested"), F.count_if(F.col("leased") & ~F.col("tested")).alias("leased"),
        F.count_if(~F.col("tested") & ~F.col("leased")).alias("remaining"),
    )


def discovery_summary(universe: DataFrame, log: DataFrame, queued: DataFrame, today: str) -> DataFrame:
    """Universe, tested, passed, queued and today's counts in one row."""
    names = universe.select("name").distinct()
    newest = latest_per_name(log).select("name", "qualified", "tested_at")
    joined = names.join(newest, "name", "left").join(queued.select("name", F.lit(True).alias("_q")).distinct(), "name", "left")
    return joined.agg(
        F.count(F.lit(1)).alias("universe"), F.count("qualified").alias("tested"), F.count_if(F.coalesce("qualified", F.lit(False))).alias("passed"),
        F.count_if(F.coalesce("_q", F.lit(False)) & F.col("qualified").isNull()).alias("queued"),
        F.count_if(F.to_date("tested_at") == F.lit(today).cast("date")).alias("tested_today"), F.max("tested_at").alias("newest"),
    )


def lacks_revision(corrected: DataFrame, log: DataFrame) -> DataFrame:
    """Corrected (name, revision) whose newest row is of another revision."""
    return corrected.join(latest_per_name(log).select("name", "revision"), ["name", "revision"], "left_anti")


def requalified(log: DataFrame, taken: DataFrame, gate: str, expected: int, now: str) -> DataFrame:
    """Newest failing rows that pass the floors on their stored figures, as rows to append: qualified, without reasons.

    Parked rows, names that are taken, rows of another gate and rows without the attestation of the later checks stay as
    they are. A name whose newest row passes is left alone, so a second run gives nothing.
    """
    order = ("tested_at", "seq", "epoch") if "epoch" in log.columns else ("tested_at", "seq")
    newest = latest_per_name(log, order).where(~F.col("qualified") & ~F.col("ops_park") & (F.col("gate") == gate) & F.col("attested"))
    fresh = newest.join(taken.select("name").distinct(), "name", "left_anti")
    seen = G.decide(fresh.drop("reasons", "score"), expected).where("passed").drop("passed")
    flipped = {"qualified": F.lit(True), "reasons": F.array().cast("array<string>"), "score": F.round("score", 2), "requalified_at": F.lit(now).cast("timestamp_ntz")}
    return seen.withColumns(flipped).select(*[c for c in log.columns if c != "epoch"], *(["requalified_at"] if "requalified_at" not in log.columns else []))


def merge_requalified(spark, path: str, taken: DataFrame, gate: str, expected: int, now: str, epoch: int) -> int:
    """Append the flipped rows of a stored log as epoch ``epoch``; returns how many there were. A replay writes nothing new."""
    flips = cut_lineage(requalified(store.read_log(spark, path), taken, gate, expected, now))
    n = flips.count()
    if n:
        store.append_log(flips, path, epoch)
    return n


def requeue_candidates(log: DataFrame, gate: str) -> DataFrame:
    """Newest failing rows on ``gate`` whose every reason is a benchmark comparison and that ran no later check."""
    bench = F.forall("reasons", lambda r: F.lower(r).contains("sma_stack") | F.lower(r).contains("buy-and-hold"))
    return latest_per_name(log).where((F.col("gate") == gate) & ~F.col("qualified") & ~F.col("ops_park") & (F.size("reasons") > 0) & bench)


def older_gate_rows(log: DataFrame, gate: str) -> DataFrame:
    return latest_per_name(log).where(F.col("gate") != gate)


def relabel_class(log: DataFrame) -> DataFrame:
    """What a rule change does to each newest row."""
    bench = F.forall("reasons", lambda r: F.lower(r).contains("buy-and-hold"))
    kind = (
        F.when(F.col("qualified"), "already_qualified")
        .when(F.col("ops_park") | (F.size("reasons") == 0) | ~bench, "other_failures")
        .otherwise("relabel")
    )
    return latest_per_name(log).select("name", kind.alias("kind"))


def is_window_veto(reason: Column) -> Column:
    return reason.startswith("window ") | (reason == "window veto")


def registration(rows: DataFrame) -> DataFrame:
    """Forward limits frozen from the evaluation record."""
    return rows.select("name", F.col("tested_at").alias("registered_at"), F.lit(90).alias("min_days"), F.lit(20).alias("min_closed_trades"),
                       F.lit(0.0).alias("live_sharpe_floor"), F.lit(1.5).alias("max_dd_multiple"), "backtest_max_dd", F.lit("flag_only").alias("action"))


def event_log(trades: DataFrame, limit: int) -> DataFrame:
    """Entries and exits newest first, an exit before an entry at one time (a top-k report)."""
    both = F.array(
        F.struct(F.lit("entry").alias("kind"), F.col("entry_ts").alias("ts"), F.col("entry_price").alias("price"), F.lit(1).alias("_o")),
        F.struct(F.lit("exit").alias("kind"), F.col("exit_ts").alias("ts"), F.col("exit_price").alias("price"), F.lit(0).alias("_o")),
    )
    rows = trades.select("account", "symbol", F.explode(both).alias("e")).select("account", "symbol", "e.*").where("ts IS NOT NULL")
    return rows.orderBy(F.desc("ts"), "_o", "account", "symbol", "price").limit(limit).drop("_o")

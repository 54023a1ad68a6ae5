"""Qualification: verdict columns, floors, robustness checks and holdout guards."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Fixed values of the gates.
MIN_SHARPE = 0.30
MIN_TRADES = 30
LIBRARY_MIN_OOS_TRADES = 8
LIBRARY_HOLDOUT_MIN_TRADES = 2
DSR_MIN = 0.95
PBO_MAX = 0.20
NEIGHBOUR_MIN_FRACTION = 0.70
FORWARD_MIN_DAYS = 90
FORWARD_MIN_TRADES = 20
FORWARD_DD_MULTIPLE = 1.5
VETOES = ("windows", "oos_trades", "oos_pnl", "holdout_pnl", "holdout_trades", "cost_stress")
WARNINGS = (
    "oos_sharpe", "beat_sma_stack", "holdout_sharpe", "holdout_beat_sma_stack", "dsr", "pbo", "neighbours", "buy_and_hold",
)
COUNT_CHECKS = ("oos_trades", "holdout_trades")


def _yes(cond: Column) -> Column:
    return F.coalesce(cond, F.lit(False))


def _failing(names, checks: dict[str, Column]) -> Column:
    return F.array_compact(F.array(*[F.when(~checks[k], F.lit(k)) for k in names]))


def library_verdict(rows: DataFrame) -> DataFrame:
    """Six vetoes and eight warnings per row, the failing keys and the outcome.

    A missing holdout fails its vetoes and passes its warnings.
    """
    c = F.col
    held = c("holdout_pnl").isNotNull()
    total = F.coalesce(c("neighbours"), F.lit(0))
    frac = F.when(total > 0, c("neighbours_pass") / total).otherwise(0.0)
    checks = {
        "windows": _yes(c("n_windows") == c("expected_windows")),
        "oos_trades": _yes(c("oos_trades") >= LIBRARY_MIN_OOS_TRADES),
        "oos_pnl": _yes(c("oos_pnl") > 0),
        "holdout_pnl": _yes(c("holdout_pnl") > 0),
        "holdout_trades": held & _yes(c("holdout_trades") >= LIBRARY_HOLDOUT_MIN_TRADES),
        "cost_stress": _yes(c("stress_oos_pnl") > 0) & _yes(c("stress_holdout_pnl") > 0),
        "oos_sharpe": _yes(c("oos_sharpe") >= MIN_SHARPE),
        "beat_sma_stack": _yes(c("oos_pnl") > c("sma_oos_pnl")),
        "holdout_sharpe": ~held | _yes(c("holdout_sharpe") >= MIN_SHARPE),
        "holdout_beat_sma_stack": ~held | _yes(c("holdout_pnl") > c("sma_holdout_pnl")),
        "dsr": _yes(c("dsr") >= DSR_MIN),
        "pbo": _yes(c("pbo") <= PBO_MAX),
        "neighbours": (total > 0) & (frac + 1e-12 >= NEIGHBOUR_MIN_FRACTION),
        "buy_and_hold": _yes(c("oos_pnl") > c("bh_oos_pnl")) & (~held | _yes(c("holdout_pnl") > c("bh_holdout_pnl"))),
    }
    failing = _failing(VETOES, checks)
    return rows.select(
        "*",
        failing.alias("failing_checks"),
        _failing(WARNINGS, checks).alias("warning_checks"),
        (F.size(failing) == 0).alias("qualified"),
        ((F.size(failing) > 0) & F.forall(failing, lambda k: k.isin(*COUNT_CHECKS))).alias("count_only"),
        (held & checks["holdout_pnl"] & checks["holdout_trades"]).alias("holdout_pass"),
        (checks["oos_trades"] & checks["holdout_trades"]).alias("trades_pass"),
        checks["oos_pnl"].alias("oos_pnl_pass"),
        checks["cost_stress"].alias("cost_pass"),
    )


def attestation_ok(rows: DataFrame) -> DataFrame:
    """A stored pass carries every veto flag."""
    flags = ("qualified", "oos_pnl_pass", "trades_pass", "holdout_pass", "cost_pass")
    return rows.withColumn("attested", reduce(lambda a, b: a & b, [_yes(F.col(k)) for k in flags]))


def fail_reasons(n_windows: str, expected: int, trades: str, sharpe: str, pnl: str, sma: str) -> Column:
    """Texts of the aggregate floors a row misses, in order."""
    c = F.col
    parts = [
        F.when(c(n_windows) != expected, F.format_string(f"windows %d != expected {expected}", c(n_windows))),
        F.when(c(trades) < MIN_TRADES, F.format_string(f"oos_trades %d < {MIN_TRADES}", c(trades))),
        F.when(c(sharpe) < MIN_SHARPE, F.format_string(f"oos_sharpe %.2f < {MIN_SHARPE}", c(sharpe))),
        F.when(c(sma).isNull(), F.lit("sma_stack missing")).when(
            c(pnl) <= c(sma), F.format_string("oos_pnl %.2f <= sma_stack %.2f", c(pnl), c(sma))
        ),
    ]
    return F.array_compact(F.array(*parts))


def window_is_nonneg() -> Column:
    """A window that traded and did not lose."""
    return _yes(~F.coalesce(F.col("skipped"), F.lit(False)) & (F.col("test_trades") >= 1) & (F.col("test_pnl") >= 0))


def admission_score(pnl: Column, sharpe: Column) -> Column:
    return pnl + sharpe * 10


def qualification(windows: DataFrame, benchmark: DataFrame, expected: int) -> DataFrame:
    """Decision per name from its window rows and the benchmark's P&L."""
    agg = windows.groupBy("name").agg(
        F.sum("test_pnl").alias("test_pnl"),
        F.sum("train_pnl").alias("train_pnl"),
        F.sum("test_trades").alias("trades"),
        F.avg(F.coalesce("sharpe", F.lit(0.0))).alias("sharpe"),
        F.count(F.lit(1)).alias("n_windows"),
        F.bool_and(window_is_nonneg()).alias("all_windows_nonneg"),
    )
    joined = agg.join(benchmark, "name", "left")
    return decide(joined, expected)


def decide(rows: DataFrame, expected: int) -> DataFrame:
    """Decision on stored aggregates (test_pnl, trades, sharpe, n_windows, sma_stack_oos_pnl)."""
    return rows.withColumn(
        "reasons", fail_reasons("n_windows", expected, "trades", "sharpe", "test_pnl", "sma_stack_oos_pnl")
    ).select(
        "*",
        (F.size("reasons") == 0).alias("passed"),
        admission_score(F.col("test_pnl"), F.col("sharpe")).alias("score"),
    )


def base_floors_ok(sharpe: str = "sharpe", trades: str = "trades") -> Column:
    return _yes((F.col(sharpe) >= MIN_SHARPE) & (F.col(trades) >= MIN_TRADES))


def neighbour_fraction(results: DataFrame, pairs: DataFrame) -> DataFrame:
    """Share of a config's neighbours that pass; a config without any fails."""
    nb = pairs.join(results.select(F.col("config").alias("neighbour"), "symbol", "passed"), "neighbour")
    agg = nb.groupBy("symbol", "config").agg(
        F.count_if("passed").alias("neighbours_pass"), F.count(F.lit(1)).alias("neighbours")
    )
    out = results.join(agg, ["symbol", "config"], "left").fillna(0, ["neighbours", "neighbours_pass"])
    ok = (F.col("neighbours") > 0) & (F.col("neighbours_pass") / F.col("neighbours") + 1e-12 >= NEIGHBOUR_MIN_FRACTION)
    return out.withColumn("neighbours_ok", F.coalesce(ok, F.lit(False)))


def forward_status(live: DataFrame, now: str) -> DataFrame:
    """Live Sharpe and drawdown against the registered limits, once old enough."""
    c = F.col
    days = F.datediff(F.lit(now).cast("date"), c("since"))
    eligible = _yes((days >= FORWARD_MIN_DAYS) & (c("closed") >= FORWARD_MIN_TRADES))
    bad = F.array_compact(
        F.array(
            F.when(c("live_sharpe").isNull(), F.lit("live_sharpe missing")).when(c("live_sharpe") < 0, F.lit("live_sharpe")),
            F.when(c("backtest_max_dd").isNull(), F.lit("backtest_max_dd missing"))
            .when(c("live_max_dd").isNull(), F.lit("live_max_dd missing"))
            .when(c("live_max_dd") > FORWARD_DD_MULTIPLE * c("backtest_max_dd"), F.lit("live_max_dd")),
        )
    )
    reasons = F.when(eligible, bad).otherwise(F.array().cast("array<string>"))
    status = F.when(F.size(reasons) > 0, "flagged").when(eligible, "ok").otherwise("pending")
    return live.select("*", days.alias("days_live"), eligible.alias("eligible"), reasons.alias("reasons")).withColumn("status", status)


# --- sealed span ----------------------------------------------------------------

def in_holdout(ts: Column, start, end) -> Column:
    return (ts >= F.lit(start)) & (ts < F.lit(end))


def discovery_rows(rows: DataFrame, start, col: str = "day") -> DataFrame:
    return rows.where(F.col(col) < F.lit(start))


def holdout_rows(rows: DataFrame, start, end, col: str = "day") -> DataFrame:
    return rows.where(in_holdout(F.col(col), start, end))


def assert_no_holdout(rows: DataFrame, start, purpose: str, col: str = "day") -> DataFrame:
    """Rows unchanged; reading one inside the sealed span fails the job."""
    ok = F.assert_true(F.col(col) < F.lit(start), F.lit(f"{purpose} reads the sealed span"))
    return rows.where(ok.isNull())


def seal(start, purpose: str, col: str = "day"):
    """Decorator: the wrapped frame function cannot see sealed rows."""

    def wrap(fn):
        def run(rows: DataFrame, *args, **kw):
            return fn(assert_no_holdout(discovery_rows(rows, start, col), start, purpose, col), *args, **kw)

        return run

    return wrap

"""Books, benchmarks and their metrics."""

from __future__ import annotations

from pyspark.sql import functions as F

from barloom.operators import bars as B
from barloom.operators import books as K
from barloom.plans import library
from barloom.plans.evaluate import day_blocks
from barloom.sources import tables
from oracle import rules_sql, sheet_sql
from queries.registry import bars_cte, query

METRICS = [
    "log_growth", "daily_sharpe", "max_drawdown", "exposure", "days", "trades",
    "win_rate", "avg_hold_days", "exits_signal", "exits_safety_stop", "exits_window_end",
]


def book_sql(stop: float = 0.2, fee: float = K.TAKER_FEE, slip: float = K.SLIPPAGE) -> str:
    """CTEs trades, paths, curve, metrics over a CTE ``sig``
    (symbol, config, day, o, h, l, c, signal, scored)."""
    hit = f"CASE WHEN l <= entry_price * {1 - stop!r} THEN k END" if stop else "CAST(NULL AS BIGINT)"
    return f"""lagged AS (SELECT *, coalesce(lag(signal) OVER w, FALSE) AS is_on FROM sig WINDOW w AS (PARTITION BY symbol, config ORDER BY day)),
sc AS (SELECT * FROM lagged WHERE scored),
ed AS (SELECT *, lead(o) OVER w AS next_o, lead(day) OVER w AS next_day,
  CASE WHEN coalesce(lag(is_on) OVER w, FALSE) <> is_on THEN 1 ELSE 0 END AS e FROM sc WINDOW w AS (PARTITION BY symbol, config ORDER BY day)),
isl AS (SELECT *, sum(e) OVER (PARTITION BY symbol, config ORDER BY day) AS island FROM ed),
held AS (SELECT *, first(o) OVER (PARTITION BY symbol, config, island ORDER BY day) * {1 + slip!r} AS entry_price,
  row_number() OVER (PARTITION BY symbol, config, island ORDER BY day) AS k FROM isl WHERE is_on),
hits AS (SELECT *, min({hit}) OVER (PARTITION BY symbol, config, island) AS hk, max(k) OVER (PARTITION BY symbol, config, island) AS n,
  min(day) OVER (PARTITION BY symbol, config, island) AS entry_day FROM held),
trades AS (SELECT symbol, config, entry_day, entry_price, CASE WHEN next_o IS NULL THEN day ELSE next_day END AS exit_day,
  coalesce(next_o, c) * {1 - slip!r} AS exit_price,
  CASE WHEN hk IS NOT NULL THEN 'safety_stop' WHEN next_o IS NULL THEN 'window_end' ELSE 'signal' END AS reason,
  k AS days, coalesce(next_o, c) * {1 - slip!r} * {1 - fee!r} / (entry_price * {1 + fee!r}) AS factor, next_o IS NULL AS at_end
  FROM hits WHERE k = coalesce(hk, n)),
paths AS (SELECT *, 10000 * exp(sum(ln(factor)) OVER (PARTITION BY symbol, config ORDER BY entry_day)) AS cash_after FROM trades),
pt AS (SELECT *, cash_after / factor AS cash_before, cash_after - cash_after / factor AS pnl FROM paths),
car AS (SELECT d.symbol, d.config, d.day, d.c, p.cash_before, p.cash_after, p.entry_price, p.exit_day, p.at_end,
  lead(d.day) OVER (PARTITION BY d.symbol, d.config ORDER BY d.day) IS NULL AS is_last
  FROM sc d ASOF LEFT JOIN pt p ON d.symbol = p.symbol AND d.config = p.config AND d.day >= p.entry_day),
curve AS (SELECT symbol, config, day, CASE WHEN cash_after IS NULL THEN 10000 WHEN at_end AND is_last THEN cash_after
  WHEN day < exit_day OR (at_end AND day = exit_day) THEN cash_before / (entry_price * {1 + fee!r}) * c ELSE cash_after END AS equity,
  coalesce(day < exit_day OR (at_end AND day = exit_day), FALSE) AS is_long FROM car),
rets AS (SELECT *, equity / coalesce(lag(equity) OVER w, 10000) - 1 AS ret,
  greatest(max(equity) OVER (PARTITION BY symbol, config ORDER BY day ROWS UNBOUNDED PRECEDING), 10000) AS peak
  FROM curve WINDOW w AS (PARTITION BY symbol, config ORDER BY day)),
per_day AS (SELECT symbol, config, arg_max(equity, day) AS final_equity,
  CASE WHEN stddev_samp(ret) > 1e-12 THEN avg(ret) / stddev_samp(ret) * sqrt(365) ELSE 0 END AS daily_sharpe,
  max((peak - equity) / peak) AS max_drawdown, avg(CASE WHEN is_long THEN 1.0 ELSE 0.0 END) AS exposure, count(*) AS days
  FROM rets GROUP BY 1, 2),
per_trade AS (SELECT symbol, config, count(*) AS trades, avg(CASE WHEN pnl > 0 THEN 1.0 ELSE 0.0 END) AS win_rate, avg(days) AS avg_hold_days,
  count(*) FILTER (reason = 'signal') AS exits_signal, count(*) FILTER (reason = 'safety_stop') AS exits_safety_stop,
  count(*) FILTER (reason = 'window_end') AS exits_window_end FROM pt GROUP BY 1, 2),
metrics AS (SELECT d.symbol, d.config, final_equity, final_equity - 10000 AS pnl, final_equity / 10000 - 1 AS total_return, daily_sharpe,
  max_drawdown, exposure, d.days, coalesce(trades, 0) AS trades, coalesce(win_rate, 0) AS win_rate, avg_hold_days,
  coalesce(exits_signal, 0) AS exits_signal, coalesce(exits_safety_stop, 0) AS exits_safety_stop,
  coalesce(exits_window_end, 0) AS exits_window_end
  FROM per_day d LEFT JOIN per_trade t ON t.symbol = d.symbol AND t.config = d.config)"""


# Spark's ln(0) is null, DuckDB's minus infinity: a book that lost all.
LN = "CASE WHEN {0} = 0 THEN double('-Infinity') ELSE ln({0}) END"


def _cols(ln: str = "ln({0})") -> list[str]:
    kinds = {"days", "trades", "exits_signal", "exits_safety_stop", "exits_window_end"}
    # Compounding over wild test prices spans 13 decades, so growth is compared as a log.
    text = {"log_growth": ln.format("final_equity / 10000")}
    return [
        f"CAST({m} AS BIGINT) AS {m}" if m in kinds else f"round(CAST({text.get(m, m)} AS DOUBLE), 5) AS {m}" for m in METRICS
    ]


def metrics_cols() -> str:
    return ", ".join(_cols())


_HOURLY = f"""WITH {bars_cte(3600)}, a AS (SELECT *, row_number() OVER (PARTITION BY symbol ORDER BY ts) - 1 AS t,
  CASE WHEN count(*) OVER w7 = 7 THEN avg(c) OVER w7 END AS a7, CASE WHEN count(*) OVER w25 = 25 THEN avg(c) OVER w25 END AS a25,
  CASE WHEN count(*) OVER w50 = 50 THEN avg(c) OVER w50 END AS a50 FROM bars
  WINDOW w7 AS (PARTITION BY symbol ORDER BY ts ROWS 6 PRECEDING), w25 AS (PARTITION BY symbol ORDER BY ts ROWS 24 PRECEDING),
  w50 AS (PARTITION BY symbol ORDER BY ts ROWS 49 PRECEDING)),
sig AS (SELECT symbol, 'sma_stack' AS config, ts AS day, o, h, l, c, coalesce(c > a7 AND a7 > a25 AND a25 > a50, FALSE) AS signal, t >= 50 AS scored FROM a),
{book_sql(stop=0)} SELECT symbol, config, {metrics_cols()} FROM metrics"""


@query("books_hourly_sma_stack", _HOURLY)
def hourly_stack(spark, sf):
    """Ticks to hourly bars to a rule to a book: the minimum slice."""
    bars = B.bars_from_ticks(tables.ticks(spark, sf), "1h").withColumnRenamed("ts", "day")
    sig = K.with_bars(library.sma_stack(bars), bars, 50)
    return K.run_books(sig, stop=0)[2].selectExpr("symbol", "config", *_cols(LN))


BOOK_RULES = ["sma200", "rsi2", "turtle20", "macd", "donchian55", "bb_break", "adx14", "tsmom90d", "engulf", "psar"]


def book_signals(spark, sf, keys=BOOK_RULES, grid=False, score_from=300):
    bars = tables.flag_days(spark, sf)
    return K.with_bars(library.signals(bars, keys, grid=grid), bars, score_from)


def _sig_sql(keys=BOOK_RULES, grid=False, score_from=300) -> str:
    head = rules_sql.signals_cte(keys, grid=grid)
    return f"""{head}, sig AS (SELECT g.symbol, g.config, g.day, b.o, b.h, b.l, b.c, g.signal, g.t >= {score_from} AS scored
FROM long g JOIN bars b ON b.symbol = g.symbol AND b.day = g.day)"""


@query("books_rule_metrics", f"{_sig_sql()}, {book_sql()} SELECT symbol, config, {metrics_cols()} FROM metrics")
def _rule_metrics(spark, sf):
    return K.run_books(book_signals(spark, sf))[2].selectExpr("symbol", "config", *_cols(LN))


@query(
    "books_cost_stress",
    f"{_sig_sql(['golden_cross', 'hi52'], True)}, {book_sql(fee=0.002, slip=0.0007)} SELECT symbol, config, {metrics_cols()} FROM metrics",
)
def _stress(spark, sf):
    fee, slip = K.STRESS
    return K.run_books(book_signals(spark, sf, ["golden_cross", "hi52"], True), fee, slip)[2].selectExpr("symbol", "config", *_cols(LN))


@query(
    "books_trades",
    f"""{_sig_sql(['turtle20', 'bb_revert'])}, {book_sql()} SELECT symbol, config, entry_day, round(entry_price, 4) AS entry_price, exit_day,
  round(exit_price, 4) AS exit_price, reason, CAST(days AS BIGINT) AS days, round(ln(cash_after / 10000), 6) AS log_cash, round(exit_price / entry_price - 1, 6) AS pnl_pct FROM pt""",
)
def _trades(spark, sf):
    paths = K.cash_path(K.trades(book_signals(spark, sf, ["turtle20", "bb_revert"])))
    return paths.selectExpr(
        "symbol", "config", "entry_day", "round(entry_price, 4) AS entry_price", "exit_day", "round(exit_price, 4) AS exit_price",
        "reason", "CAST(days AS BIGINT) AS days", f"round({LN.format('cash_after / 10000')}, 6) AS log_cash", "round(pnl_pct, 6) AS pnl_pct",
    )


@query(
    "books_benchmarks",
    f"""WITH bars AS ({sheet_sql.FLAG_DAYS}), sig AS (SELECT symbol, 'buy_and_hold' AS config, day, o, h, l, c, TRUE AS signal,
  row_number() OVER (PARTITION BY symbol ORDER BY day) > 300 AS scored FROM bars), {book_sql(stop=0)} SELECT symbol, config, {metrics_cols()} FROM metrics""",
)
def _bench(spark, sf):
    bars = tables.flag_days(spark, sf)
    stack = library.sma_stack(bars)
    held = stack.withColumn("signal", F.lit(True)).withColumn("config", F.lit("buy_and_hold"))
    return K.run_books(K.with_bars(held, bars, 300), stop=0)[2].selectExpr("symbol", "config", *_cols(LN))


_BLOCK = """blocks AS (SELECT symbol, k AS block, d0 + CAST((span * k) // n AS INTEGER) AS block_day,
  d0 + CAST((span * (k + 1)) // n AS INTEGER) AS block_end_day FROM (SELECT symbol, min(day) AS d0, max(day) + 1 - min(day) AS span,
  greatest(1, CAST(round_even((max(day) + 1 - min(day)) / 390.0, 0) AS BIGINT)) AS n FROM sc GROUP BY 1), LATERAL (SELECT unnest(range(n)) AS k))"""


@query(
    "books_segment_pnl",
    f"""{_sig_sql(['sma200', 'rsi14'])}, {book_sql()}, {_BLOCK},
opened AS (SELECT *, coalesce(lag(equity) OVER (PARTITION BY symbol, config ORDER BY day), 10000) AS opened FROM rets),
x AS (SELECT o.symbol, config, block, 10000 * (arg_max(equity, day) / arg_min(opened, day) - 1) AS block_pnl
  FROM opened o JOIN blocks b ON b.symbol = o.symbol AND day >= block_day AND day < block_end_day GROUP BY 1, 2, 3),
y AS (SELECT p.symbol, config, block, count(*) AS n FROM pt p JOIN blocks b ON b.symbol = p.symbol AND exit_day >= block_day AND exit_day < block_end_day GROUP BY 1, 2, 3)
SELECT x.symbol, x.config, x.block, round(ln(1 + block_pnl / 10000), 6) AS block_log_return, coalesce(n, 0) AS block_trades
FROM x LEFT JOIN y ON y.symbol = x.symbol AND y.config = x.config AND y.block = x.block""",
)
def _segment_pnl(spark, sf):
    sig = book_signals(spark, sf, ["sma200", "rsi14"])
    paths, curve, _ = K.run_books(sig)
    out = K.segment_metrics(curve, paths, day_blocks(sig))
    return out.selectExpr("symbol", "config", "block", f"round({LN.format('(1 + block_pnl / 10000)')}, 6) AS block_log_return", "block_trades")


@query(
    "books_buy_and_hold_windows",
    f"""WITH bars AS ({sheet_sql.FLAG_DAYS}), e AS (SELECT symbol, year(day) AS w, arg_min(c, day) AS p0, arg_max(c, day) AS p1, count(*) AS n FROM bars GROUP BY 1, 2),
q AS (SELECT *, 10000.0 / count(*) OVER (PARTITION BY w) / (p0 * 1.0002 * 1.001) AS qty FROM e WHERE n >= 2)
SELECT CAST(w AS INTEGER) AS w, round(sum(qty * p1 * 0.9998 * 0.999) - 10000, 2) AS realized_pnl, round(sum(qty * p1), 2) AS marked_equity FROM q GROUP BY 1""",
)
def _hold_windows(spark, sf):
    bars = tables.flag_days(spark, sf).withColumn("w", F.year("day"))
    out = K.hold_pnl(K.price_ends(bars, ["w"]), ["w"])
    return out.selectExpr("w", "round(realized_pnl, 2) AS realized_pnl", "round(marked_equity, 2) AS marked_equity")

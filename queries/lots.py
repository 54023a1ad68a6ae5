"""Lot engine, vectorized returns and position sizing."""

from __future__ import annotations

from pyspark.sql import functions as F

from barloom.functions import atoms as A
from barloom.operators import lots as L
from barloom.operators import windows as WN
from barloom.sources import tables
from oracle import sheet_sql
from queries.atoms import day_bars
from queries.registry import TICKS, bars_cte, query

NAMES = ["sma_stack_7_25_50", "mom_12b_gt2pc", "dip_6b_lt3pc", "rsi_14_<40", "don_hi_20", "sma_abv_20&rsi_14_>50"]


def _flat(df):
    return df.selectExpr(
        "symbol", "config", "w", "trades", "wins", "round(total_pnl, 4) AS total_pnl", "round(sharpe, 6) AS sharpe",
        "round(max_drawdown, 6) AS max_drawdown", "round(fees, 4) AS fees", "coalesce(exits['stop'], 0L) AS stops",
        "coalesce(exits['tp'], 0L) AS targets", "coalesce(exits['eod'], 0L) AS eods", "hold_bars",
        "round(min_cash, 4) AS min_cash", "round(max_notional_frac, 6) AS max_notional_frac", "size(daily_equity) AS points",
    )


@query("lots_backtest")
def _lots(spark, sf):
    return _flat(L.backtest(L.whole_window(L.book_signals(day_bars(spark, sf, "15m"), NAMES)), per_day=96))


@query("lots_walk_forward_windows")
def _walk(spark, sf):
    bars = day_bars(spark, sf, "15m")
    days = bars.select("symbol", "day", F.expr("dayofmonth(day)").alias("d"))
    # Four windows of six days with a three-day warm-up and four train days before each.
    marks = days.withColumn("w", F.explode(F.sequence(F.lit(0), F.lit(2)))).withColumn("_a", 8 + F.col("w") * 7)
    role = F.when(F.col("d") >= F.col("_a"), "oos").when(F.col("d") >= F.col("_a") - 4, "train").otherwise("warm")
    labelled = marks.where("d >= _a - 7 AND d < _a + 7").withColumn("role", role).select("symbol", "day", "w", "role")
    out = L.evaluate_windows(L.book_signals(bars, NAMES), labelled, per_day=96)
    return out.selectExpr("config", "w", "round(train_pnl, 4) AS train_pnl", "round(test_pnl, 4) AS test_pnl", "test_trades",
                          "round(sharpe, 6) AS sharpe", "round(max_drawdown, 6) AS max_drawdown")


@query("lots_book_daily_returns")
def _daily(spark, sf):
    res = L.backtest(L.whole_window(L.book_signals(day_bars(spark, sf, "15m"), NAMES[:3])), per_day=96)
    return L.book_daily_returns(res).selectExpr("config", "w", "k", "round(ret, 8) AS ret")


_VEC = f"""WITH bars AS ({sheet_sql.FLAG_DAYS}), a AS (SELECT symbol, day, c, CASE WHEN count(*) OVER w = 20 THEN c > avg(c) OVER w ELSE FALSE END AS sig FROM bars
  WINDOW w AS (PARTITION BY symbol ORDER BY day ROWS 19 PRECEDING)),
p AS (SELECT *, c / lag(c) OVER w - 1 AS ret, coalesce(CASE WHEN lag(sig) OVER w THEN 1.0 ELSE 0.0 END, 0.0) AS pos FROM a WINDOW w AS (PARTITION BY symbol ORDER BY day)),
n AS (SELECT symbol, day, CAST(pos AS DOUBLE) * coalesce(ret, 0) - CASE WHEN abs(pos - lag(pos) OVER (PARTITION BY symbol ORDER BY day)) > 0 THEN CAST(0.001 AS DOUBLE) + CAST(0.0002 AS DOUBLE) ELSE 0 END AS net FROM p)"""


@query(
    "lots_vectorized_metrics",
    f"""{_VEC}, e AS (SELECT *, net AS r, product(1 + net) OVER (PARTITION BY symbol ORDER BY day ROWS UNBOUNDED PRECEDING) AS e FROM n),
f AS (SELECT *, greatest(max(e) OVER (PARTITION BY symbol ORDER BY day ROWS UNBOUNDED PRECEDING), 1) AS pk FROM e)
SELECT symbol, round(avg(r) / stddev_samp(r) * sqrt(365), 5) AS sharpe, round(avg(r) / sqrt(avg(least(r, 0) * least(r, 0))) * sqrt(365), 5) AS sortino,
  round(min(e / pk - 1), 5) AS max_dd, round(count(*) FILTER (r > 0) / count(*) FILTER (r <> 0), 5) AS win_rate,
  round(product(1 + r) - 1, 5) AS total_return, count(*) AS days FROM f GROUP BY 1 HAVING count(*) >= 10""",
)
def _vector(spark, sf):
    bars = A.flags(tables.flag_days(spark, sf), ["sma_abv_20"])
    out = L.vectorized_metrics(L.position_returns(bars, "f0"))
    return out.selectExpr("symbol", "round(sharpe, 5) AS sharpe", "round(sortino, 5) AS sortino", "round(max_dd, 5) AS max_dd",
                          "round(win_rate, 5) AS win_rate", "round(total_return, 5) AS total_return", "days")


@query(
    "lots_position_sizing",
    f"""WITH {TICKS}, x AS (SELECT event_id, price AS entry, CASE WHEN user_id % 7 = 0 THEN NULL ELSE price * ((user_id % 50) / CAST(1000.0 AS DOUBLE)) END AS atr,
  CAST(1000 + user_id * 13 % 9000 AS DOUBLE) AS cash, CAST(user_id % 600 AS DOUBLE) AS open_risk, (event_id % 100) / CAST(100.0 AS DOUBLE) AS p FROM ticks),
s AS (SELECT *, entry - CASE WHEN atr > 0 THEN greatest(entry * CAST(0.015 AS DOUBLE), least(entry * CAST(0.04 AS DOUBLE), 2 * atr)) ELSE entry * CAST(0.025 AS DOUBLE) END AS stop FROM x),
w AS (SELECT *, 10000.0 * CAST(0.01 AS DOUBLE) * greatest(0.5, least(2.0, greatest(0.5, least(2.0, p / 0.5)))) / (entry - stop) AS want,
  cash / (entry * CAST(1.0002 AS DOUBLE) * CAST(1.001 AS DOUBLE)) AS room FROM s),
r AS (SELECT *, CASE WHEN stop <= 0 OR entry <= stop THEN 'stop must be below entry' WHEN open_risk > 0 AND open_risk + (entry - stop) * want > 500 THEN 'open risk'
    WHEN room * entry < 10 THEN 'notional cap' ELSE 'ok' END AS reason FROM w)
SELECT event_id, round(stop, 6) AS stop, round(entry + 2 * (entry - stop), 6) AS target, reason, round(CASE WHEN reason = 'ok' THEN least(want, room) ELSE 0 END + 1.3e-8, 5) AS size FROM r""",
)
def _sizing(spark, sf):
    c = F.col
    x = tables.ticks(spark, sf).select(
        "event_id", c("price").alias("entry"),
        F.when(c("user_id") % 7 != 0, c("price") * ((c("user_id") % 50) / 1000.0)).alias("atr"),
        (1000 + c("user_id") * 13 % 9000).cast("double").alias("cash"), (c("user_id") % 600).cast("double").alias("open_risk"),
        ((c("event_id") % 100) / 100.0).alias("p"),
    )
    x = x.withColumn("stop", L.stop_price(c("entry"), c("atr")))
    sized = L.size_position(F.lit(10000.0), c("entry"), c("stop"), c("open_risk"), c("cash"), L.confidence(c("p")))
    return x.withColumn("z", sized).select(
        "event_id", F.round("stop", 6).alias("stop"), F.round(L.take_profit(c("entry"), c("stop")), 6).alias("target"),
        c("z.reason").alias("reason"), F.round(c("z.size") + 1.3e-8, 5).alias("size"),
    )

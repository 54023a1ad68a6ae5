"""A fund of two sleeves over a thousand tickers, rebalanced monthly with costs, against a benchmark."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from barloom.operators import portfolio as P
from barloom.operators import rebalance as RB
from barloom.session import cut_lineage
from barloom.sources import tables
from oracle import sheet_sql
from queries.registry import query

CAPITAL, RATE, TICKET, STALE, MAX_POSITION, MAX_GROSS = 1_000_000.0, 0.0012, 1.5, 60, 0.004, 0.8
SLICES = {"trend": 3.0, "carry": 2.0}

_PARTS = sheet_sql.FLAG_DAYS.replace("l_returnflag || l_linestatus", "CAST(l_partkey % 1000 AS VARCHAR)")
_TARGETS = f"""bench AS MATERIALIZED (SELECT day, c FROM ({sheet_sql.FLAG_DAYS}) WHERE symbol = 'NO'), px AS MATERIALIZED (SELECT symbol, day, 100 * ln(1 + c) AS c FROM ({_PARTS})),
grid AS (SELECT max(day) AS date FROM bench GROUP BY date_trunc('month', day)), tick AS (SELECT DISTINCT symbol AS ticker FROM px),
mk AS (SELECT g.date, g.ticker, p.c AS mark, date_diff('day', p.day, g.date) <= {STALE} AS fresh FROM (SELECT * FROM grid, tick) g ASOF JOIN px p ON p.symbol = g.ticker AND p.day <= g.date),
lg AS (SELECT *, lag(mark) OVER (PARTITION BY ticker ORDER BY date) AS pm FROM mk),
sg AS (SELECT date, ticker, sign(mark - pm) AS tr, ((CAST(ticker AS BIGINT) * 7 + month(date)) % 11) / 10.0 - 0.5 AS ca FROM lg WHERE fresh AND pm IS NOT NULL),
ce AS (SELECT *, ca - avg(ca) OVER (PARTITION BY date) AS cc FROM sg), ge AS (SELECT *, sum(abs(tr)) OVER (PARTITION BY date) AS gt, sum(abs(cc)) OVER (PARTITION BY date) AS gc FROM ce),
nt AS (SELECT date, ticker, 0.6 * CASE WHEN gt < 1e-9 THEN 0 ELSE tr / gt END + 0.4 * CASE WHEN gc < 1e-9 THEN 0 ELSE cc / gc END AS w FROM ge),
cl AS (SELECT date, ticker, greatest(-{MAX_POSITION}, least({MAX_POSITION}, w)) AS w FROM nt), tg AS (SELECT date, ticker, w * CASE WHEN g > {MAX_GROSS} THEN {MAX_GROSS} / g ELSE 1 END AS w FROM (SELECT *, sum(abs(w)) OVER (PARTITION BY date) AS g FROM cl))"""
_PATH = f"""WITH RECURSIVE {_TARGETS}, hd AS (SELECT m.date, m.ticker, m.mark, CASE WHEN m.fresh THEN coalesce(t.w, 0) ELSE 0 END AS w FROM mk m LEFT JOIN tg t ON t.date = m.date AND t.ticker = m.ticker),
mv AS (SELECT *, coalesce(lag(w) OVER o, 0) AS b, coalesce(mark / lag(mark) OVER o, 1) AS r FROM hd WINDOW o AS (PARTITION BY ticker ORDER BY date)),
gr AS (SELECT date, 1 + sum(b * (r - 1)) AS g FROM mv GROUP BY 1), tv AS (SELECT date, g, abs(w - b * r / g) AS x FROM mv JOIN gr USING (date)),
mp AS (SELECT date, any_value(g) AS g, sum(x) FILTER (x > 1e-9) AS turn, count(*) FILTER (x > 1e-9) AS orders, row_number() OVER (ORDER BY date) AS k FROM tv GROUP BY 1),
wk AS (SELECT CAST(0 AS BIGINT) AS k, CAST({CAPITAL} AS DOUBLE) AS nav, CAST({CAPITAL} AS DOUBLE) AS peak UNION ALL SELECT m.k, v, greatest(peak, v) FROM
  (SELECT m.k, w.peak, w.nav * m.g - {RATE} * coalesce(m.turn, 0) * w.nav * m.g - {TICKET} * m.orders AS v FROM wk w JOIN mp m ON m.k = w.k + 1) m),
pa AS (SELECT m.date, m.g, coalesce(m.turn, 0) AS turn, m.orders, w.nav, (w.peak - w.nav) / w.peak AS dd, {CAPITAL} * b.c / first(b.c) OVER (ORDER BY m.date) AS bnav, coalesce(lag(w.nav) OVER (ORDER BY m.date), {CAPITAL}) AS pv
  FROM mp m JOIN wk w ON w.k = m.k JOIN bench b ON b.day = m.date)"""


def _path(spark, sf):
    bench = cut_lineage(tables.flag_days(spark, sf).where("symbol = 'NO'").select("day", "c"))
    dates = cut_lineage(RB.rebalance_dates(bench, "monthly"))
    # part prices jump by whole factors; their logarithm moves like a price
    prices = tables.part_days(spark, sf).select(F.col("symbol").alias("ticker"), "day", (100 * F.log1p("c")).alias("c"))
    marks = cut_lineage(RB.grid_marks(prices, dates, STALE))

    was = F.lag("mark").over(Window.partitionBy("ticker").orderBy("date"))
    seen = marks.withColumn("_p", was).where("fresh AND _p IS NOT NULL")
    carry = (F.col("ticker").cast("long") * 7 + F.month("date")) % 11 / 10.0 - 0.5
    both = seen.select("date", "ticker", F.signum(F.col("mark") - F.col("_p")).alias("trend"), carry.alias("carry"))
    out = None
    for sleeve, neutral in (("trend", False), ("carry", True)):
        weights = spark.createDataFrame([(sleeve, 1.0)], "model string, weight double")
        rows = both.select("date", "ticker", F.lit(sleeve).alias("model"), F.col(sleeve).alias("value"), F.lit(False).alias("abstained"))
        one = P.blend(rows, weights, 1.0, neutral).select("date", "ticker", F.lit(sleeve).alias("sleeve"), "weight")
        out = one if out is None else out.unionByName(one)
    targets = P.apply_limits(RB.net_sleeves(out, SLICES), MAX_POSITION, MAX_GROSS).select("date", "ticker", "weight")
    return RB.fund_path(targets, marks, bench, CAPITAL, RATE, TICKET)


@query(
    "portfolio_rebalanced_nav",
    _PATH + " SELECT date, round(g, 8) AS growth, round(turn, 8) AS turnover, orders, round(nav, 3) AS nav, round(dd, 8) AS drawdown, round(bnav, 3) AS benchmark_nav FROM pa",
)
def _rebalanced(spark, sf):
    r = lambda c, n: F.round(c, n).alias(c)
    return _path(spark, sf).select("date", r("growth", 8), r("turnover", 8), "orders", r("nav", 3), r("drawdown", 8), r("benchmark_nav", 3))


@query(
    "portfolio_rebalanced_metrics",
    _PATH + f""" SELECT n_cycles, n_orders, round(t, 8) AS total_return, round(power(1 + t, 1 / y) - 1, 8) AS annualized_return, round(CASE WHEN s > 0 THEN m / s * sqrt(12) ELSE 0 END, 6) AS sharpe,
  round(dd, 8) AS max_drawdown, round(bt, 8) AS benchmark_return, round(t - bt, 8) AS excess_return FROM (SELECT count(*) AS n_cycles, CAST(sum(orders) AS BIGINT) AS n_orders, arg_max(nav, date) / {CAPITAL} - 1 AS t,
  arg_max(bnav, date) / {CAPITAL} - 1 AS bt, max(dd) AS dd, avg(nav / pv - 1) AS m, stddev_samp(nav / pv - 1) AS s, greatest(date_diff('day', min(date), max(date)) / 365.25, 0.01) AS y FROM pa)""",
)
def _metrics(spark, sf):
    m = RB.fund_metrics(_path(spark, sf), CAPITAL, "monthly")
    return m.select(*[F.round(c, 6 if c == "sharpe" else 8).alias(c) if c not in ("n_cycles", "n_orders") else c for c in m.columns])

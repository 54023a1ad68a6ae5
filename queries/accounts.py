"""Account views, summaries, sampling and the full evaluation."""

from __future__ import annotations

from pyspark.sql import functions as F

from barloom.functions import atoms as A
from barloom.operators import accounts as AC
from barloom.operators import names as N
from barloom.operators import sampling as SP
from barloom.sources import tables
from barloom.sources.results import POOL, eval_log
from queries.names import LOG, static_caps
from queries.portfolio import _LOT_BASE, lots, marks
from queries.registry import query


@query("accounts_open_lots", "SELECT CAST(l_suppkey % 50 AS BIGINT) AS account, count(*) AS open_lots FROM lineitem GROUP BY 1")
def _open(spark, sf):
    rows = lots(spark, sf)
    return AC.attach_open_lots(rows.select("account").distinct(), rows)


@query(
    "accounts_live_preview",
    f"""WITH {_LOT_BASE} SELECT account, round(sum((price - entry) * qty), 2) AS unrealised, round(10000 + sum(price * qty), 2) AS equity, count(*) AS open_lots
FROM lots JOIN marks USING (symbol) GROUP BY 1""",
)
def _preview(spark, sf):
    rows = lots(spark, sf)
    acc = rows.select("account").distinct().withColumn("cash", F.lit(10_000.0))
    return AC.live_preview(acc, rows, marks(spark, sf)).select("account", F.round("unrealised", 2).alias("unrealised"), F.round("equity", 2).alias("equity"), "open_lots")


@query("accounts_lot_view")
def _view(spark, sf):
    rows = lots(spark, sf).withColumn("config", F.lit("sma_abv_50"))
    newest = A.latest_signal(tables.flag_days(spark, sf), "sma_abv_50").select("symbol", F.lit("sma_abv_50").alias("config"), (F.col("direction") == "long").alias("signal"))
    out = AC.lot_view(rows, marks(spark, sf), newest)
    return out.groupBy("account", "symbol", "path", "state").agg(F.count(F.lit(1)).alias("lots"), F.round(F.sum("unrealised"), 2).alias("unrealised"))


@query(
    "accounts_training_rows",
    f"WITH {LOG} SELECT name, sharpe, trades, test_pnl, bh_oos_pnl FROM latest WHERE NOT ops_park",
)
def _training(spark, sf):
    log = eval_log(spark, sf)
    return AC.training_rows(log, log)


@query(
    "accounts_discovery_summary",
    f"""WITH {LOG}, u AS (SELECT DISTINCT name FROM ev), t AS (SELECT * FROM ev WHERE seq % 3 <> 0 QUALIFY row_number() OVER (PARTITION BY name ORDER BY tested_at DESC, seq DESC) = 1),
q AS (SELECT DISTINCT name FROM ev WHERE seq % 3 = 0) SELECT count(*) AS universe, count(t.name) AS tested, count(*) FILTER (t.qualified) AS passed,
  count(*) FILTER (q.name IS NOT NULL AND t.name IS NULL) AS queued, count(*) FILTER (CAST(t.tested_at AS DATE) = DATE '2001-07-30') AS tested_today, max(t.tested_at) AS newest
FROM u LEFT JOIN t ON t.name = u.name LEFT JOIN q ON q.name = u.name""",
)
def _summary(spark, sf):
    log = eval_log(spark, sf)
    return AC.discovery_summary(log, log.where("seq % 3 <> 0"), log.where("seq % 3 = 0"), "2001-07-30")


@query(
    "accounts_requeue_candidates",
    f"WITH {LOG} SELECT name, seq FROM latest WHERE gate = 'current' AND NOT qualified AND NOT ops_park AND len(reasons) > 0 AND len(list_filter(reasons, lambda r: NOT contains(r, 'sma_stack'))) = 0",
)
def _requeue(spark, sf):
    return AC.requeue_candidates(eval_log(spark, sf), "current").select("name", "seq")


@query("accounts_older_gate", f"WITH {LOG} SELECT name, seq FROM latest WHERE gate <> 'current'")
def _older(spark, sf):
    return AC.older_gate_rows(eval_log(spark, sf), "current").select("name", "seq")


_TR = """tr AS (SELECT o_custkey % 40 AS account, CASE WHEN o_orderkey % 2 = 0 THEN 'A' ELSE 'B' END AS symbol, o_orderdate + o_orderkey * INTERVAL 1 MILLISECOND AS entry_ts, 100 + o_totalprice / 10000 AS entry_price,
  o_orderdate + INTERVAL 30 DAY + o_orderkey * INTERVAL 1 MILLISECOND AS exit_ts, 100 + (o_totalprice % 7919) / 100 AS exit_price FROM orders)"""


def paper_trades(spark, sf):
    o = tables.table(spark, sf, "orders")
    ms = F.make_dt_interval(secs=F.col("o_orderkey") / 1000)
    return o.select(
        (F.col("o_custkey") % 40).alias("account"), F.when(F.col("o_orderkey") % 2 == 0, "A").otherwise("B").alias("symbol"),
        (F.col("o_orderdate") + ms).alias("entry_ts"), (100 + F.col("o_totalprice") / 10000).alias("entry_price"),
        (F.col("o_orderdate") + F.expr("INTERVAL 30 DAYS") + ms).alias("exit_ts"), (100 + (F.col("o_totalprice") % 7919) / 100).alias("exit_price"),
    ).withColumn("pnl", F.col("exit_price") - F.col("entry_price"))


@query(
    "accounts_paper_against_hold",
    f"""WITH {_TR}, e AS (SELECT account, symbol, arg_min(entry_price, entry_ts) AS p0, arg_max(exit_price, exit_ts) AS p1 FROM tr GROUP BY 1, 2),
h AS (SELECT account, sum(q * p1 * 0.9998 * 0.999) - 10000 AS hold FROM (SELECT *, 10000.0 / count(*) OVER (PARTITION BY account) / (p0 * 1.0002 * 1.001) AS q FROM e) GROUP BY 1),
p AS (SELECT account, sum(exit_price - entry_price) AS paper FROM tr GROUP BY 1)
SELECT account, round(paper, 4) AS paper_pnl, round(hold, 4) AS hold_pnl, paper > hold AS beats FROM p JOIN h USING (account)""",
)
def _paper(spark, sf):
    return AC.paper_against_hold(paper_trades(spark, sf)).select("account", F.round("paper_pnl", 4).alias("paper_pnl"), F.round("hold_pnl", 4).alias("hold_pnl"), "beats")


@query(
    "accounts_event_log",
    f"""WITH {_TR}, e AS (SELECT account, symbol, 'entry' AS kind, entry_ts AS ts, entry_price AS price, 1 AS o FROM tr UNION ALL SELECT account, symbol, 'exit', exit_ts, exit_price, 0 FROM tr)
SELECT account, symbol, kind, ts, round(price, 4) AS price FROM e ORDER BY ts DESC, o, account, symbol, e.price LIMIT 200""",
)
def _events(spark, sf):
    return AC.event_log(paper_trades(spark, sf), 200).withColumn("price", F.round("price", 4))


@query("sampling_swaps")
def _swaps(spark, sf):
    names = eval_log(spark, sf).where("qualified").select("name").distinct()
    return SP.one_swap(names, list(POOL[:-1]), 7)


@query("sampling_reject_reasons")
def _reject(spark, sf):
    log = eval_log(spark, sf)
    taken = log.where("qualified").select("name").distinct()
    children = SP.swaps(taken, list(POOL[:-1])).select(F.col("child").alias("name")).distinct()
    out = SP.reject_reasons(children, taken, static_caps(spark, sf))
    return out.groupBy("reason").agg(F.count(F.lit(1)).alias("names"))

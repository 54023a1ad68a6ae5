"""Two results side by side: a rule against its definition, two engines, two years; and rows decided again."""

from __future__ import annotations

import re
import uuid

from pyspark.sql import Window
from pyspark.sql import functions as F

from barloom.functions import stats as S
from barloom.operators import accounts as AC
from barloom.operators import bars as B
from barloom.operators import books as K
from barloom.operators import compare as C
from barloom.operators import results as R
from barloom.plans import library
from barloom.session import shared_dir
from barloom.sources import store, tables
from barloom.sources.results import EXPECTED_WINDOWS, eval_log
from oracle import sheet_sql
from queries.books import _sig_sql, book_signals, book_sql
from queries.names import LOG
from queries.registry import TICKS, bars_cte, query

_DIFF = ["n", "same", "differs", "left_only", "right_only"]


@query(
    "results_sma200_check",
    f"""WITH bars AS MATERIALIZED ({sheet_sql.FLAG_DAYS}), num AS (SELECT *, row_number() OVER (PARTITION BY symbol ORDER BY day) AS t FROM bars),
a AS (SELECT b.symbol, b.t, b.c > avg(p.c) AS on_ FROM num b JOIN num p ON p.symbol = b.symbol AND p.t > b.t - 200 AND p.t <= b.t WHERE b.t >= 200 GROUP BY 1, 2, b.c)
SELECT symbol, count(*) AS n, count(*) AS same, 0 AS differs, 0 AS left_only, 0 AS right_only, count(*) FILTER (on_) AS days_on FROM a GROUP BY 1""",
)
def _sma200(spark, sf):
    """The rule's signal against a mean over a self-join of the bars."""
    bars = tables.flag_days(spark, sf)
    rule = library.signals(bars, ["sma200"], grid=False).where("ready").select("symbol", "day", "signal")
    num = bars.select("symbol", "day", "c", F.row_number().over(Window.partitionBy("symbol").orderBy("day")).alias("t"))
    back = num.select("symbol", F.col("c").alias("_c"), F.explode(F.sequence(F.col("t"), F.col("t") + 199)).alias("t"))
    plain = num.where("t >= 200").join(back, ["symbol", "t"]).groupBy("symbol", "day", "c").agg(F.avg("_c").alias("m")).select("symbol", "day", (F.col("c") > F.col("m")).alias("signal"))
    on = rule.groupBy("symbol").agg(F.count_if("signal").alias("days_on"))
    return C.agree(C.frame_diff(rule, plain, ["symbol"], ["day"])).select("symbol", *_DIFF).join(on, "symbol")


_RULES = ["sma200", "turtle20"]


def _engine(tag: str, stop: float) -> str:
    text = book_sql(stop=stop)
    for n in ("lagged", "sc", "ed", "isl", "held", "hits", "trades", "paths", "pt", "car", "curve", "rets", "per_day", "per_trade", "metrics"):
        text = re.sub(rf"\b{n} AS \(", f"{tag}_{n} AS (", text)
        text = re.sub(rf"\b(FROM|JOIN) {n}\b", rf"\1 {tag}_{n}", text)
    return text


@query(
    "books_both_engines",
    f"""{_sig_sql(_RULES)}, {_engine('a', 0.2)}, {_engine('b', 0)},
j AS (SELECT coalesce(a.symbol, b.symbol) AS symbol, coalesce(a.config, b.config) AS config, coalesce(a.entry_day, b.entry_day) AS entry_day, CASE WHEN b.symbol IS NULL THEN 'left_only' WHEN a.symbol IS NULL THEN 'right_only'
  WHEN a.exit_day <> b.exit_day OR abs(a.factor - b.factor) > 1e-9 * greatest(abs(a.factor), abs(b.factor), 1) THEN 'differs' ELSE 'same' END AS s,
  CASE WHEN a.symbol IS NOT NULL AND b.symbol IS NOT NULL AND a.exit_day <> b.exit_day THEN a.exit_day END AS ax
  FROM a_trades a FULL OUTER JOIN b_trades b ON a.symbol = b.symbol AND a.config = b.config AND a.entry_day = b.entry_day)
SELECT symbol, config, count(*) AS n, count(*) FILTER (s = 'same') AS same, count(*) FILTER (s = 'differs') AS differs, count(*) FILTER (s = 'left_only') AS left_only, count(*) FILTER (s = 'right_only') AS right_only,
  min(entry_day) FILTER (s <> 'same') AS first_entry, arg_min(s, entry_day) FILTER (s <> 'same') AS first_state FROM j GROUP BY 1, 2""",
)
def _engines(spark, sf):
    """The same entries with and without the safety stop."""
    sig = book_signals(spark, sf, _RULES)
    one, other = (K.trades(sig, stop=s).select(*K.KEYS, "entry_day", "exit_day", "factor") for s in (0.20, 0.0))
    return C.frame_diff(one, other, K.KEYS, ["entry_day"]).select(*K.KEYS, *_DIFF, F.col("first.entry_day").alias("first_entry"), F.col("first.state").alias("first_state"))


_YEARS = [1997, 1999]


@query(
    "results_two_years",
    f"""{_sig_sql(["sma200"])}, {book_sql()}, lv AS (SELECT symbol, config, day, equity AS v FROM curve UNION ALL SELECT symbol, 'hold', day, c FROM (SELECT DISTINCT symbol, day, c FROM sc)),
yr AS (SELECT *, year(day) AS y, max(v) OVER (PARTITION BY symbol, config, year(day) ORDER BY day) AS top FROM lv WHERE year(day) IN (1997, 1999)),
g AS (SELECT symbol, config, y, arg_max(v, day) / arg_min(v, day) - 1 AS ret, max((top - v) / top) AS dd FROM yr GROUP BY 1, 2, 3)
SELECT a.symbol, a.config, CAST(a.y AS INTEGER) AS year, round(ln(1 + a.ret), 5) AS growth, round(a.dd, 6) AS max_drawdown, round(ln(1 + b.ret), 5) AS hold_growth, round(b.dd, 6) AS hold_drawdown, a.dd <= b.dd AS calmer
FROM g a JOIN g b ON a.symbol = b.symbol AND a.y = b.y AND b.config = 'hold' AND a.config <> 'hold'""",
)
def _years(spark, sf):
    sig = book_signals(spark, sf, ["sma200"])
    _, curve, _ = K.run_books(sig)
    hold = sig.where("scored").select("symbol", F.lit("hold").alias("config"), "day", F.col("c").alias("equity")).distinct()
    both = K.year_drawdowns(curve.select("symbol", "config", "day", "equity").unionByName(hold), _YEARS)
    bench = both.where("config = 'hold'").select("symbol", "year", F.col("ret").alias("_r"), F.col("max_drawdown").alias("_d"))
    rows = both.where("config <> 'hold'").join(bench, ["symbol", "year"])
    growth = lambda c: F.round(S.log_growth(1 + F.col(c)), 5)
    return rows.select("symbol", "config", "year", growth("ret").alias("growth"), F.round("max_drawdown", 6).alias("max_drawdown"), growth("_r").alias("hold_growth"), F.round("_d", 6).alias("hold_drawdown"),
                       (F.col("max_drawdown") <= F.col("_d")).alias("calmer"))


@query(
    "accounts_requalified",
    f"""WITH {LOG}, stored AS (SELECT * REPLACE (qualified AND seq % 2 = 1 AS qualified), seq % 3 > 0 AS attested FROM ev),
newest AS (SELECT * FROM stored QUALIFY row_number() OVER (PARTITION BY name ORDER BY tested_at DESC, seq DESC) = 1), taken AS (SELECT DISTINCT name FROM ev WHERE account % 7 = 0),
flip AS (SELECT name FROM newest WHERE NOT qualified AND NOT ops_park AND gate = 'current' AND attested AND len(reasons) = 0 AND name NOT IN (SELECT name FROM taken))
SELECT n.name, n.seq, n.qualified OR f.name IS NOT NULL AS qualified, round(n.score, 2) AS score, f.name IS NOT NULL AS flipped, (SELECT count(*) FROM flip) AS first_run, 0 AS second_run FROM newest n LEFT JOIN flip f ON f.name = n.name""",
)
def _requalified(spark, sf):
    """The log is stored, decided again twice, and read back: the second run finds nothing to flip."""
    path = f"{shared_dir(spark)}/barloom/log-{uuid.uuid4().hex}"
    log = eval_log(spark, sf)
    old = log.withColumns({"qualified": F.col("qualified") & (F.col("seq") % 2 == 1), "attested": F.col("seq") % 3 > 0, "requalified_at": F.lit(None).cast("timestamp_ntz")})
    store.append_log(old, path, 0)
    taken = log.where("account % 7 = 0").select("name").distinct()
    runs = [AC.merge_requalified(spark, path, taken, "current", EXPECTED_WINDOWS, "2001-08-01 00:00:00", epoch) for epoch in (1, 2)]
    newest = AC.latest_per_name(store.read_log(spark, path), ("tested_at", "seq", "epoch"))
    return newest.select("name", "seq", "qualified", F.round("score", 2).alias("score"), F.col("requalified_at").isNotNull().alias("flipped"), F.lit(runs[0]).cast("long").alias("first_run"), F.lit(runs[1]).alias("second_run"))


_NEAR = """list_distinct(list_transform(reasons, lambda r: CASE WHEN starts_with(r, 'oos_trades') THEN 'trades' WHEN starts_with(r, 'oos_sharpe') THEN 'sharpe' WHEN contains(r, 'sma_stack') THEN 'baseline'
  WHEN starts_with(r, 'dsr') THEN 'dsr' WHEN starts_with(r, 'pbo') THEN 'pbo' WHEN starts_with(r, 'cost stress') THEN 'cost' WHEN starts_with(r, 'windows') THEN 'windows' ELSE 'ops' END))"""


def late_checks(log):
    """Rows that pass the floors get reasons of the later checks by their number, so near misses exist."""
    k = F.col("seq") % 4
    late = F.array_compact(F.array(F.when(k >= 1, F.lit("dsr 0.10 < 0.95")), F.when(k >= 2, F.lit("pbo 0.50 > 0.2")), F.when(k >= 3, F.lit("cost stress sharpe 0.10 < 0.3"))))
    return log.withColumn("reasons", F.when(F.col("qualified"), late).otherwise(F.col("reasons"))).withColumn("qualified", F.size("reasons") == 0)


@query(
    "results_near_misses",
    f"""WITH {LOG}, lt AS (SELECT * REPLACE (CASE WHEN qualified THEN (['dsr 0.10 < 0.95', 'pbo 0.50 > 0.2', 'cost stress sharpe 0.10 < 0.3'])[1:seq % 4] ELSE reasons END AS reasons) FROM ev),
nw AS (SELECT *, {_NEAR} AS g FROM lt QUALIFY row_number() OVER (PARTITION BY name ORDER BY tested_at DESC, seq DESC) = 1)
SELECT name, seq, array_to_string(g, ',') AS gates FROM nw WHERE gate = 'current' AND len(reasons) > 0 AND NOT list_has_any(g, ['trades', 'profit', 'sharpe', 'baseline', 'windows'])
ORDER BY CASE WHEN len(list_filter(g, lambda x: x IN ('holdout', 'dsr', 'pbo', 'perturb', 'cost'))) = 0 THEN 99 ELSE len(list_filter(g, lambda x: x IN ('holdout', 'dsr', 'pbo', 'perturb', 'cost'))) END, sharpe DESC, name LIMIT 8""",
)
def _near_misses(spark, sf):
    return R.near_misses(late_checks(eval_log(spark, sf)), "current").select("name", "seq", F.array_join(R.failed_gates(F.col("reasons")), ",").alias("gates"))


@query(
    "results_eligible",
    f"""WITH {LOG} SELECT name, seq, daily_sharpe FROM latest WHERE NOT ops_park AND gate IN ('current') AND n_windows = 18 AND tested_at < TIMESTAMP '2000-01-01'""",
)
def _eligible(spark, sf):
    rows = R.latest_per_name(eval_log(spark, sf)).withColumn("window_end", F.col("tested_at").cast("timestamp_ntz"))
    return R.pre_holdout(rows, ["current"], EXPECTED_WINDOWS, "2000-01-01").select("name", "seq", "daily_sharpe")


@query(
    "results_cycle_batch",
    f"""WITH {LOG}, u AS (SELECT name, min(seq) AS ord FROM ev GROUP BY 1), f AS (SELECT * FROM u WHERE name NOT IN (SELECT name FROM ev WHERE trades > 70)), c AS (SELECT ord FROM f ORDER BY ord OFFSET 20 LIMIT 1)
SELECT name, ord FROM f ORDER BY ord < (SELECT ord FROM c), ord LIMIT 50""",
)
def _batch(spark, sf):
    log = eval_log(spark, sf)
    universe = log.groupBy("name").agg(F.min("seq").alias("ord"))
    tested = log.where("trades > 70")
    cursor = R.leftovers(universe, tested).orderBy("ord").offset(20).first()
    return R.cycle_batch(universe, tested, 50, cursor["name"] if cursor else None)


@query("results_retest_trials", f"WITH {LOG} SELECT CASE WHEN count(*) FILTER (NOT ops_park) >= 1 THEN count(*) FILTER (NOT ops_park) END AS n_trials FROM latest")
def _retest(spark, sf):
    return R.retest_trials(R.trial_census(eval_log(spark, sf)))


@query(
    "accounts_relabel_class",
    f"""WITH {LOG}, old AS (SELECT * REPLACE (CASE WHEN seq % 3 = 0 AND NOT qualified THEN ['oos_pnl 1.00 <= buy-and-hold 2.00'] ELSE reasons END AS reasons) FROM latest)
SELECT name, CASE WHEN qualified THEN 'already_qualified' WHEN ops_park OR len(reasons) = 0 OR len(list_filter(reasons, lambda r: NOT contains(lower(r), 'buy-and-hold'))) > 0 THEN 'other_failures' ELSE 'relabel' END AS kind FROM old""",
)
def _relabel(spark, sf):
    rows = R.latest_per_name(eval_log(spark, sf))
    old = F.when((F.col("seq") % 3 == 0) & ~F.col("qualified"), F.array(F.lit("oos_pnl 1.00 <= buy-and-hold 2.00"))).otherwise(F.col("reasons"))
    return AC.relabel_class(rows.withColumn("reasons", old))


_M5 = bars_cte(300)
_Q = f"(1 + {K.SLIPPAGE!r}) * (1 + {K.TAKER_FEE!r})"
_POINTS = f"""WITH {_M5}, x AS (SELECT symbol, c, row_number() OVER (PARTITION BY symbol ORDER BY ts) - 1 AS rn FROM bars), e AS (SELECT symbol, arg_min(c, rn) AS p, arg_max(c, rn) AS z, max(rn) AS m FROM x GROUP BY 1 HAVING max(rn) >= 1),
lm AS (SELECT min(m) AS m, count(*) * 10000.0 AS cash FROM e WHERE p > 0 AND z > 0),
pt AS (SELECT -1 AS rn, cash AS equity FROM lm UNION ALL SELECT rn, sum(10000 / (p * {_Q}) * c * CASE WHEN rn = lm.m THEN (1 - {K.SLIPPAGE!r}) * (1 - {K.TAKER_FEE!r}) ELSE 1 END) FROM x JOIN e USING (symbol), lm
  WHERE rn <= lm.m AND (rn % 48 = 47 OR rn = lm.m) GROUP BY rn, lm.m)"""


def _points(spark, sf):
    indexed = B.row_index(B.bars_from_ticks(tables.ticks(spark, sf), "5m"))
    return K.hold_sampled(indexed, 48)


@query("books_hold_sampled", f"{_POINTS} SELECT rn, round(equity, 6) AS equity FROM pt")
def _hold_sampled(spark, sf):
    return _points(spark, sf).select("rn", F.round("equity", 6).alias("equity"))


@query(
    "books_hold_sampled_sharpe",
    f"""{_POINTS}, r AS (SELECT equity / lag(equity) OVER (ORDER BY rn) - 1 AS ret FROM pt) SELECT count(ret) AS n, round(CASE WHEN stddev_samp(ret) > 1e-12 THEN avg(ret) / stddev_samp(ret) * sqrt(365) ELSE 0 END, 6) AS daily_sharpe FROM r""",
)
def _hold_sharpe(spark, sf):
    return K.points_sharpe(_points(spark, sf)).select("n", F.round("daily_sharpe", 6).alias("daily_sharpe"))


@query(
    "books_hold_marked",
    f"""WITH {_M5}, e AS (SELECT symbol, arg_min(c, ts) AS p, arg_max(c, ts) AS z FROM bars GROUP BY 1) SELECT count(*) AS symbols, round(sum(z / (p * {_Q})) / count(*) * 10000, 6) AS equity FROM e WHERE p > 0 AND z > 0""",
)
def _hold_marked(spark, sf):
    ends = B.bars_from_ticks(tables.ticks(spark, sf), "5m").groupBy("symbol").agg(F.min_by("c", "ts").alias("p"), F.max_by("c", "ts").alias("z"))
    return K.hold_marked(ends.select("symbol", F.col("p").alias("price")), ends.select("symbol", F.col("z").alias("price"))).select("symbols", F.round("equity", 6).alias("equity"))


@query("stats_scaled_mean", f"WITH {TICKS} SELECT symbol, round(avg(price), 9) AS mean FROM ticks GROUP BY 1")
def _scaled(spark, sf):
    """Means of values so large that their plain sum is infinite."""
    huge = tables.ticks(spark, sf).select("symbol", (F.col("price") * 1e304).alias("x"))
    return S.scaled_mean(huge, ["symbol"], "x").select("symbol", F.round(F.col("mean") / 1e304, 9).alias("mean"))

"""Calibration, portfolio, fundamentals, fixed-hold trades and regime."""

from __future__ import annotations

from pyspark.sql import functions as F

from barloom.functions import stats as S
from barloom.operators import calibration as C
from barloom.operators import fundamentals as FN
from barloom.operators import portfolio as P
from barloom.operators import regime as RG
from barloom.session import cut_lineage
from barloom.sources import tables
from oracle import sheet_sql
from queries.registry import TICKS, query

# --- calibration: probability from the value, hit from the event type -------------

_CAL = f"{TICKS}, rec AS (SELECT (event_id % 101) / CAST(100.0 AS DOUBLE) AS prob, symbol = 'purchase' AS hit, symbol || '|1h|' || CAST(user_id % 20 AS VARCHAR) AS key, user_id FROM ticks)"


def records(spark, sf):
    t = tables.ticks(spark, sf)
    return t.select(
        ((F.col("event_id") % 101) / 100.0).alias("prob"), (F.col("symbol") == "purchase").alias("hit"),
        F.concat_ws("|", "symbol", F.lit("1h"), (F.col("user_id") % 20).cast("string")).alias("key"), "user_id", "event_id", "price",
    )


@query("calibration_brier", f"WITH {_CAL} SELECT round(avg(power(prob - CASE WHEN hit THEN 1 ELSE 0 END, 2)), 8) AS brier, count(*) AS n FROM rec")
def _brier(spark, sf):
    return C.brier(records(spark, sf)).withColumn("brier", F.round("brier", 8))


@query(
    "calibration_reliability",
    f"""WITH {_CAL} SELECT CAST(floor((event_k) / 10) * 10 AS INTEGER) AS lo, count(*) AS n, round(avg(prob), 6) AS avg_prob, round(avg(CASE WHEN hit THEN 1.0 ELSE 0 END), 6) AS hit_rate
FROM (SELECT *, CAST(round(prob * 100) AS INTEGER) AS event_k FROM rec) WHERE event_k < 100 GROUP BY 1""",
)
def _reliability(spark, sf):
    return C.reliability(records(spark, sf)).select("lo", "n", F.round("avg_prob", 6).alias("avg_prob"), F.round("hit_rate", 6).alias("hit_rate"))


_POST = f"""{_CAL}, post AS (SELECT key, 1 + count(*) FILTER (hit) AS a, 1 + count(*) FILTER (NOT hit) AS b FROM rec GROUP BY 1)"""


@query(
    "calibration_posteriors",
    f"""WITH {_POST} SELECT key, CAST(a AS DOUBLE) AS alpha, CAST(b AS DOUBLE) AS beta, round(a / (a + b), 8) AS mean, round(sqrt(a * b / (power(a + b, 2) * (a + b + 1))), 8) AS std,
  a + b - 2 AS trials, CASE WHEN a + b - 2 < 5 THEN 'learning' WHEN a + b - 2 < 20 THEN 'developing' WHEN a + b - 2 < 50 THEN 'trained' ELSE 'established' END AS level FROM post""",
)
def _posteriors(spark, sf):
    return C.posteriors(records(spark, sf)).select("key", "alpha", "beta", F.round("mean", 8).alias("mean"), F.round("std", 8).alias("std"), "trials", "level")


@query(
    "calibration_blend",
    f"""WITH {_POST}, small AS (SELECT key, 1 + count(*) FILTER (hit) AS a, 1 + count(*) FILTER (NOT hit) AS b FROM rec WHERE user_id % 9 = 0 GROUP BY 1),
p AS (SELECT DISTINCT key, CAST(0.6 AS DOUBLE) AS proposed FROM rec)
SELECT p.key, round(CASE WHEN coalesce(a + b - 2, 0) >= 20 THEN a / (a + b) ELSE (coalesce(a / (a + b), 0.5) * coalesce(a + b - 2, 0) + proposed) / (coalesce(a + b - 2, 0) + 1) END, 8) AS probability
FROM p LEFT JOIN small s ON s.key = p.key""",
)
def _blend_prob(spark, sf):
    rec = records(spark, sf)
    props = rec.select("key").distinct().withColumn("proposed", F.lit(0.6))
    return C.calibrated(props, C.posteriors(rec.where("user_id % 9 = 0"))).select("key", F.round("probability", 8).alias("probability"))


@query(
    "calibration_per_condition",
    f"""WITH {_CAL} SELECT key AS condition, count(*) AS n, round(avg(prob), 6) AS avg_prob, round(avg(CASE WHEN hit THEN 1.0 ELSE 0 END), 6) AS hit_rate FROM rec GROUP BY 1""",
)
def _condition(spark, sf):
    trades = records(spark, sf).select(F.col("key").alias("condition"), F.col("prob").alias("stated_prob"), "hit")
    return C.per_condition(trades).select("condition", "n", F.round("avg_prob", 6).alias("avg_prob"), F.round("hit_rate", 6).alias("hit_rate"))


# --- portfolio: suppliers' daily moves as three models' signals -------------------

_SIG = f"""days AS ({sheet_sql.SUPPLIER_DAYS}), mods AS (SELECT * FROM (VALUES ('value', 2.0), ('trend', 1.0), ('pead', 0.5)) m(model, weight)),
sig AS (SELECT day AS date, symbol AS ticker, model, CAST(weight AS DOUBLE) AS weight, CASE model WHEN 'value' THEN (o - c) / greatest(o, c) WHEN 'trend' THEN (c - l) / greatest(h, 1) - 0.3 ELSE (h - c) / greatest(h, 1) END AS value,
  model = 'pead' AND CAST(symbol AS BIGINT) % 3 = 0 AS abstained FROM days, mods)"""


def model_signals(spark, sf, days=None):
    d = tables.supplier_days(spark, sf) if days is None else days
    v = {
        "value": (F.col("o") - F.col("c")) / F.greatest("o", "c"), "trend": (F.col("c") - F.col("l")) / F.greatest(F.col("h"), F.lit(1)) - 0.3,
        "pead": (F.col("h") - F.col("c")) / F.greatest(F.col("h"), F.lit(1)),
    }
    one = F.explode(F.array(*[F.struct(F.lit(k).alias("model"), x.alias("value")) for k, x in v.items()]))
    return d.select(F.col("day").alias("date"), F.col("symbol").alias("ticker"), one.alias("m"), "c").select(
        "date", "ticker", "m.model", "m.value", ((F.col("m.model") == "pead") & (F.col("ticker").cast("long") % 3 == 0)).alias("abstained"), "c"
    )


def model_weights(spark):
    return spark.createDataFrame([("value", 2.0), ("trend", 1.0), ("pead", 0.5)], "model string, weight double")


_BL = f"""{_SIG}, cv AS (SELECT date, ticker, coalesce(sum(weight * value) FILTER (NOT abstained) / nullif(sum(weight) FILTER (NOT abstained), 0), 0) AS conviction FROM sig GROUP BY 1, 2),
dm AS (SELECT *, conviction - avg(conviction) OVER (PARTITION BY date) AS x FROM cv),
bl AS (SELECT *, CASE WHEN sum(abs(x)) OVER (PARTITION BY date) < 1e-9 THEN 0 ELSE x / sum(abs(x)) OVER (PARTITION BY date) END AS weight FROM dm)"""


def blended(spark, sf, days=None):
    return P.blend(model_signals(spark, sf, days), model_weights(spark), 1.0, True)


@query("portfolio_blend", f"WITH {_BL} SELECT date, ticker, round(conviction, 6) AS conviction, round(weight, 6) AS weight FROM bl")
def _blend(spark, sf):
    return blended(spark, sf).select("date", "ticker", F.round("conviction", 6).alias("conviction"), F.round("weight", 6).alias("weight"))


_LIM = f"""{_BL}, cl AS (SELECT *, greatest(CAST(-0.047 AS DOUBLE), least(CAST(0.047 AS DOUBLE), weight)) AS w FROM bl), gs AS (SELECT *, sum(abs(w)) OVER (PARTITION BY date) AS g FROM cl),
lim AS (SELECT date, ticker, weight AS before, w * CASE WHEN g > CAST(0.61 AS DOUBLE) THEN CAST(0.61 AS DOUBLE) / g ELSE 1 END AS weight, abs(weight) > CAST(0.047 AS DOUBLE) AS clamped, g > CAST(0.61 AS DOUBLE) AS scaled FROM gs)"""


def limited(spark, sf, days=None):
    return P.apply_limits(blended(spark, sf, days), 0.047, 0.61)


@query("portfolio_limits", f"WITH {_LIM} SELECT date, ticker, round(weight, 6) AS weight, clamped, scaled FROM lim")
def _limits(spark, sf):
    return limited(spark, sf).select("date", "ticker", F.round("weight", 6).alias("weight"), "clamped", "scaled")


@query("portfolio_clamp_events", f"""WITH {_LIM} SELECT "limit", count(*) AS n FROM (SELECT 'max_position_pct' AS "limit" FROM lim WHERE clamped UNION ALL SELECT 'max_gross_exposure' FROM (SELECT DISTINCT date FROM lim WHERE scaled)) GROUP BY 1""")
def _clamps(spark, sf):
    return P.clamp_events(limited(spark, sf), 0.047).groupBy("limit").agg(F.count(F.lit(1)).alias("n"))


_ORD = f"""{_LIM}, tgt AS (SELECT l.date, l.ticker, CAST(trunc(weight * 1000000 / c) AS BIGINT) AS want, CAST(l.ticker AS BIGINT) % 7 AS have, c FROM lim l JOIN days d ON d.symbol = l.ticker AND d.day = l.date),
ord AS (SELECT date, ticker, CASE WHEN want > have THEN 'buy' ELSE 'sell' END AS side, abs(want - have) AS quantity, c AS price FROM tgt WHERE want <> have)"""


def orders(spark, sf):
    bars = cut_lineage(tables.supplier_days(spark, sf))
    days = bars.select(F.col("day").alias("date"), F.col("symbol").alias("ticker"), F.col("c").alias("mark"))
    held = days.select("date", "ticker", (F.col("ticker").cast("long") % 7).alias("shares"))
    return P.build_orders(limited(spark, sf, bars).select("date", "ticker", "weight"), held, days, F.lit(1_000_000.0))


@query("portfolio_orders", f"WITH {_ORD} SELECT date, ticker, side, quantity, round(price + 1.3e-9, 6) AS price FROM ord")
def _orders(spark, sf):
    return orders(spark, sf).select("date", "ticker", "side", "quantity", F.round(F.col("price") + 1.3e-9, 6).alias("price"))


@query(
    "portfolio_positions",
    f"""WITH {_ORD}, f AS (SELECT 'fund' AS account, ticker, date, CASE WHEN side = 'buy' THEN quantity ELSE -quantity END AS q,
  CASE WHEN side = 'buy' THEN -(price * 1.0002 * quantity * 1.001) ELSE price * 0.9998 * quantity * 0.999 END AS cf FROM ord)
SELECT account, ticker, date, CAST(sum(q) OVER (PARTITION BY ticker ORDER BY date) AS BIGINT) AS shares, round(sum(cf) OVER (PARTITION BY ticker ORDER BY date), 2) AS cash FROM f""",
)
def _positions(spark, sf):
    fills = P.signed_fills(orders(spark, sf)).withColumn("account", F.lit("fund"))
    return P.positions_over_time(fills).select("account", "ticker", "date", "shares", F.round("cash", 2).alias("cash"))


# --- lots: line items as open lots, newest prices as marks ------------------------

_LOTS = """lots AS (SELECT CAST(l_suppkey % 50 AS BIGINT) AS account, l_returnflag || l_linestatus AS symbol, l_extendedprice / l_quantity AS entry,
  l_extendedprice / l_quantity * 0.9 AS stop, l_quantity AS qty FROM lineitem), marks AS (SELECT symbol, last(c ORDER BY day) AS price FROM days GROUP BY 1)"""
_LOT_BASE = f"days AS ({sheet_sql.FLAG_DAYS}), {_LOTS}"


def lots(spark, sf):
    li = tables.table(spark, sf, "lineitem")
    entry = F.col("l_extendedprice") / F.col("l_quantity")
    return li.select(
        (F.col("l_suppkey") % 50).cast("long").alias("account"), F.concat("l_returnflag", "l_linestatus").alias("symbol"), entry.alias("entry"),
        (entry * 0.9).alias("stop"), F.col("l_quantity").alias("qty"),
    )


def marks(spark, sf):
    return tables.flag_days(spark, sf).groupBy("symbol").agg(F.max_by("c", "day").alias("price"))


@query("portfolio_stopped_lots", f"WITH {_LOT_BASE} SELECT account, count(*) AS stopped, round(sum(qty), 4) AS qty FROM lots JOIN marks USING (symbol) WHERE price <= stop GROUP BY 1")
def _stopped(spark, sf):
    return P.stopped_lots(lots(spark, sf), marks(spark, sf)).groupBy("account").agg(F.count(F.lit(1)).alias("stopped"), F.round(F.sum("qty"), 4).alias("qty"))


@query(
    "portfolio_equity_and_risk",
    f"""WITH {_LOT_BASE}, v AS (SELECT account, sum(qty * price) AS v, greatest(0, sum((entry - stop) * qty)) AS r FROM lots JOIN marks USING (symbol) GROUP BY 1)
SELECT account, round(10000 + v, 2) AS equity, round(r, 2) AS open_risk FROM v""",
)
def _equity(spark, sf):
    rows = lots(spark, sf)
    cash = rows.select("account").distinct().withColumn("cash", F.lit(10_000.0))
    out = P.account_equity(cash, rows, marks(spark, sf)).join(P.open_risk(rows), "account")
    return out.select("account", F.round("equity", 2).alias("equity"), F.round("open_risk", 2).alias("open_risk"))


@query(
    "portfolio_path_in_trade",
    f"""WITH {_LOT_BASE}, x AS (SELECT account, symbol, greatest(0.0, least(1.0, (price - stop) / (entry + 2 * (entry - stop) - stop))) AS p FROM lots JOIN marks USING (symbol))
SELECT account, symbol, count(*) FILTER (p <= 0.3) AS near_stop, count(*) FILTER (p >= 0.7) AS near_tp, count(*) AS lots FROM x GROUP BY 1, 2""",
)
def _path(spark, sf):
    x = lots(spark, sf).join(F.broadcast(marks(spark, sf)), "symbol")
    z = P.path_in_trade(F.col("price"), F.col("stop"), F.col("entry") + 2 * (F.col("entry") - F.col("stop")))
    return x.withColumn("z", z).groupBy("account", "symbol").agg(
        F.count_if(F.col("z.path") == "near_stop").alias("near_stop"), F.count_if(F.col("z.path") == "near_tp").alias("near_tp"), F.count(F.lit(1)).alias("lots")
    )


@query(
    "portfolio_drawdown_halt",
    f"""WITH days AS ({sheet_sql.FLAG_DAYS}), p AS (SELECT symbol AS account, day AS ts, c AS equity, max(c) OVER (PARTITION BY symbol ORDER BY day) AS peak FROM days),
d AS (SELECT *, (peak - equity) / peak AS dd FROM p) SELECT account, ts, round(peak, 7) AS peak, max(dd) OVER (PARTITION BY account ORDER BY ts) >= 0.15 AS halted FROM d""",
)
def _halt(spark, sf):
    eq = tables.flag_days(spark, sf).select(F.col("symbol").alias("account"), F.col("day").alias("ts"), F.col("c").alias("equity"))
    return P.drawdown_halt(eq).select("account", "ts", F.round("peak", 7).alias("peak"), "halted")


# --- fixed-hold trades ------------------------------------------------------------

def hold_trades(spark, sf):
    d = tables.supplier_days(spark, sf).withColumn("value", F.when(F.col("c") > F.col("o") * 1.2, 1.0).when(F.col("c") < F.col("o") * 0.8, -1.0).otherwise(0.0))
    return P.fixed_hold_trades(d, 5)


@query("portfolio_fixed_hold_trades")
def _hold(spark, sf):
    return hold_trades(spark, sf).select("symbol", "direction", "entry_day", "exit_day", F.round("pnl", 2).alias("pnl"), F.round("return_pct", 6).alias("return_pct"))


@query("portfolio_trade_metrics")
def _metrics(spark, sf):
    return P.trade_metrics(hold_trades(spark, sf))


@query("portfolio_nav", f"""WITH {_LIM}, r AS (SELECT symbol AS ticker, day AS date, c / o - 1 AS ret FROM days), d AS (SELECT date, sum(weight * least(1, greatest(-1, ret))) AS ret FROM lim JOIN r USING (date, ticker) GROUP BY 1)
SELECT date, round(ret, 6) AS ret, round(ln(exp(sum(ln(1 + ret)) OVER (ORDER BY date))), 5) AS log_nav FROM d""")
def _nav(spark, sf):
    ret = F.least(F.lit(1.0), F.greatest(F.lit(-1.0), F.col("c") / F.col("o") - 1))
    bars = cut_lineage(tables.supplier_days(spark, sf))
    r = bars.select(F.col("symbol").alias("ticker"), F.col("day").alias("date"), ret.alias("ret"))
    return P.nav(limited(spark, sf, bars), r).select("date", F.round("ret", 6).alias("ret"), F.round(S.log_growth(F.col("nav")), 5).alias("log_nav"))


# --- fundamentals: suppliers as tickers, order lines as filings -------------------

_FIL = """filings AS (SELECT CAST(l_suppkey AS VARCHAR) AS ticker, date_trunc('quarter', l_shipdate)::DATE AS report_period, max(CAST(l_shipdate AS DATE)) + 20 AS filing_date,
  avg(l_discount) AS roe, avg(l_tax) AS margin, sum(l_quantity) AS bvps FROM lineitem GROUP BY 1, 2),
dates AS (SELECT DISTINCT ticker, make_date(y, 7, 1) AS as_of FROM filings, (SELECT unnest([1996, 1998, 2000]) AS y))"""


def filings(spark, sf):
    li = tables.table(spark, sf, "lineitem")
    return li.groupBy(F.col("l_suppkey").cast("string").alias("ticker"), F.to_date(F.date_trunc("quarter", F.col("l_shipdate").cast("timestamp"))).alias("report_period")).agg(
        F.date_add(F.max(F.to_date("l_shipdate")), 20).alias("filing_date"), F.avg("l_discount").alias("roe"), F.avg("l_tax").alias("margin"), F.sum("l_quantity").alias("bvps")
    )


def asof_dates(df):
    days = F.array(*[F.lit(f"{y}-07-01").cast("date") for y in (1996, 1998, 2000)])
    return df.select("ticker").distinct().select("ticker", F.explode(days).alias("as_of"))


_PIT = f"""{_FIL}, pit AS (SELECT a.as_of, f.*, row_number() OVER (PARTITION BY f.ticker, as_of ORDER BY report_period DESC, filing_date DESC) AS k
  FROM dates a JOIN filings f ON f.ticker = a.ticker AND filing_date <= as_of QUALIFY k <= 20)"""


@query("fundamentals_point_in_time", f"WITH {_PIT} SELECT ticker, as_of, report_period, filing_date, CAST(k AS INTEGER) AS k FROM pit")
def _pit(spark, sf):
    f = filings(spark, sf)
    return FN.point_in_time(f, asof_dates(f)).select("ticker", "as_of", "report_period", "filing_date", "k")


@query(
    "fundamentals_snapshot",
    f"""WITH {_PIT} SELECT ticker, as_of, count(*) AS periods, round(avg(roe), 4) AS roe_avg, round(arg_min(margin, k) - arg_max(margin, k), 4) AS margin_trend,
  round(power(arg_min(bvps, k) / arg_max(bvps, k), 4.0 / (count(*) - 1)) - 1, 4) AS bvps_cagr, arg_min(bvps, k) AS bvps_latest FROM pit GROUP BY 1, 2 HAVING count(*) >= 4""",
)
def _snapshot(spark, sf):
    f = filings(spark, sf)
    out = FN.snapshot(FN.point_in_time(f, asof_dates(f)), ["roe"], ["margin"], ["bvps"], ["bvps"])
    return out.drop("content_hash")


_EARN = """earn AS (SELECT CAST(o_custkey % 200 AS VARCHAR) AS ticker, date_trunc('quarter', o_orderdate)::DATE AS report_period, CAST(o_orderdate AS DATE) AS filing_date,
  CASE o_orderkey % 4 WHEN 0 THEN '8-K' WHEN 1 THEN '10-Q' WHEN 2 THEN '10-K' ELSE '20-F' END AS source_type,
  CASE o_orderkey % 3 WHEN 0 THEN 'BEAT' WHEN 1 THEN 'MISS' ELSE 'MEET' END AS s, o_orderkey FROM orders),
best AS (SELECT * FROM earn WHERE s IN ('BEAT', 'MISS') AND filing_date - report_period < 45 QUALIFY row_number() OVER (PARTITION BY ticker, report_period
  ORDER BY CASE source_type WHEN '8-K' THEN 0 WHEN '10-Q' THEN 1 WHEN '10-K' THEN 2 ELSE 3 END, filing_date, s) = 1)"""


def earnings(spark, sf):
    o = tables.table(spark, sf, "orders")
    k = F.col("o_orderkey")
    rows = o.select(
        (F.col("o_custkey") % 200).cast("string").alias("ticker"), F.to_date(F.date_trunc("quarter", F.col("o_orderdate").cast("timestamp"))).alias("report_period"),
        F.to_date("o_orderdate").alias("filing_date"), F.element_at(F.array(*[F.lit(x) for x in ("8-K", "10-Q", "10-K", "20-F")]), (k % 4 + 1).cast("int")).alias("source_type"),
        F.element_at(F.array(*[F.lit(x) for x in ("BEAT", "MISS", "MEET")]), (k % 3 + 1).cast("int")).alias("eps_surprise"),
    )
    return rows


@query("fundamentals_qualifying_events", f"WITH {_EARN} SELECT ticker, report_period, filing_date, source_type FROM best")
def _events(spark, sf):
    return FN.qualifying_events(earnings(spark, sf)).select("ticker", "report_period", "filing_date", "source_type")


@query(
    "fundamentals_surprise_signal",
    f"""WITH {_EARN}, one AS (SELECT DISTINCT ticker, report_period, first(filing_date ORDER BY filing_date) OVER (PARTITION BY ticker, report_period) AS filing_date FROM earn),
d AS (SELECT DISTINCT ticker, filing_date + 2 AS as_of FROM earn), m AS (SELECT d.ticker, d.as_of, count(*) FILTER (b.ticker IS NOT NULL) AS live FROM d LEFT JOIN best b
  ON b.ticker = d.ticker AND b.filing_date <= d.as_of AND d.as_of - b.filing_date <= 4 GROUP BY 1, 2)
SELECT ticker, as_of, live > 0 AS has_view FROM m""",
)
def _surprise(spark, sf):
    e = earnings(spark, sf)
    dates = e.select("ticker", F.date_add("filing_date", 2).alias("as_of")).distinct()
    out = FN.surprise_signal(FN.qualifying_events(e), dates)
    return out.select("ticker", "as_of", (F.col("value") != 0).alias("has_view"))


# --- regime -----------------------------------------------------------------------

_D = f"bars AS ({sheet_sql.FLAG_DAYS})"


@query(
    "regime_trend",
    f"""WITH {_D}, m AS (SELECT symbol, day, c, avg(c) OVER w50 AS a, avg(c) OVER w200 AS b, row_number() OVER w AS n FROM bars
  WINDOW w AS (PARTITION BY symbol ORDER BY day), w50 AS (PARTITION BY symbol ORDER BY day ROWS 49 PRECEDING), w200 AS (PARTITION BY symbol ORDER BY day ROWS 199 PRECEDING)),
x AS (SELECT *, lag(b, 20) OVER (PARTITION BY symbol ORDER BY day) AS o FROM m QUALIFY row_number() OVER (PARTITION BY symbol ORDER BY day DESC) = 1)
SELECT symbol, CAST(greatest(0, least(100, CASE WHEN c > a AND a > b THEN 90 WHEN c > b AND c <= a AND a > b THEN 65 WHEN c <= b AND c <= a AND a > b THEN 55
  WHEN c > a AND a <= b THEN 45 ELSE 15 END + CASE WHEN b > o THEN 10 ELSE -10 END)) AS INTEGER) AS score, CASE WHEN b > o THEN 'rising' ELSE 'falling' END AS direction FROM x""",
)
def _trend(spark, sf):
    return RG.trend(tables.flag_days(spark, sf)).select("symbol", "score", "direction")


@query(
    "regime_drawdown",
    f"""WITH {_D}, r AS (SELECT *, ln(c) - ln(lag(c) OVER w) AS r, row_number() OVER w - 1 AS t, count(*) OVER (PARTITION BY symbol) AS n FROM bars WINDOW w AS (PARTITION BY symbol ORDER BY day)),
v AS (SELECT *, stddev_samp(r) OVER (PARTITION BY symbol ORDER BY day ROWS 28 PRECEDING) * sqrt(365) AS vol, max(c) OVER (PARTITION BY symbol ORDER BY day ROWS 364 PRECEDING) AS top FROM r),
l AS (SELECT symbol, vol AS now, 1 - c / top AS dd FROM v WHERE t = n - 1), s AS (SELECT v.symbol, vol FROM v WHERE t - (n - 365) >= 30 AND (t - (n - 365) - 30) % 7 = 0),
q AS (SELECT l.symbol, dd, avg(CASE WHEN vol <= now THEN 1.0 ELSE 0 END) AS p FROM s JOIN l USING (symbol) GROUP BY l.symbol, dd),
z AS (SELECT *, CASE WHEN dd <= 0.1 THEN 90 WHEN dd <= 0.2 THEN 75 WHEN dd <= 0.35 THEN 55 WHEN dd <= 0.5 THEN 35 WHEN dd <= 0.65 THEN 20 ELSE 10 END
  + CASE WHEN p <= 1 / 3 THEN 10 WHEN p >= 2 / 3 THEN -10 ELSE 0 END AS sc FROM q)
SELECT symbol, round(dd, 6) AS dd, round(p, 4) AS pctile, CAST(least(100, greatest(0, CASE WHEN dd > 0.65 AND p >= 2 / 3 THEN greatest(sc, 15) ELSE sc END)) AS INTEGER) AS score FROM z""",
)
def _drawdown(spark, sf):
    return RG.drawdown(tables.flag_days(spark, sf)).select("symbol", F.round("dd", 6).alias("dd"), "pctile", "score")


@query(
    "regime_breadth",
    f"""WITH {_D}, m AS (SELECT symbol, day, c > avg(c) OVER w200 AS u2, c > avg(c) OVER w50 AS u5 FROM bars WINDOW w50 AS (PARTITION BY symbol ORDER BY day ROWS 49 PRECEDING),
  w200 AS (PARTITION BY symbol ORDER BY day ROWS 199 PRECEDING)), x AS (SELECT * FROM m QUALIFY row_number() OVER (PARTITION BY symbol ORDER BY day DESC) = 1),
p AS (SELECT count(*) AS universe, avg(CASE WHEN u2 THEN 100.0 ELSE 0 END) AS a, avg(CASE WHEN u5 THEN 100.0 ELSE 0 END) AS b FROM x)
SELECT universe, round(a, 6) AS pct_200, round(b, 6) AS pct_50, CAST(CASE WHEN universe < 5 THEN 50 ELSE least(100, greatest(0,
  CASE WHEN a >= 80 THEN 95 WHEN a >= 65 THEN 80 WHEN a >= 50 THEN 65 WHEN a >= 35 THEN 45 WHEN a >= 20 THEN 25 ELSE 10 END
  + CASE WHEN b >= a + 15 THEN 5 WHEN b <= a - 15 THEN -5 ELSE 0 END)) END AS INTEGER) AS score FROM p""",
)
def _breadth(spark, sf):
    return RG.breadth(tables.flag_days(spark, sf)).select("universe", F.round("pct_200", 6).alias("pct_200"), F.round("pct_50", 6).alias("pct_50"), "score")


@query(
    "regime_thrust",
    f"""WITH days AS ({sheet_sql.SUPPLIER_DAYS}), x AS (SELECT symbol, c > lag(c, 30) OVER (PARTITION BY symbol ORDER BY day) AS up, row_number() OVER (PARTITION BY symbol ORDER BY day DESC) AS k FROM days),
p AS (SELECT count(*) AS universe, avg(CASE WHEN up THEN 100.0 ELSE 0 END) AS a FROM x WHERE k = 1 AND up IS NOT NULL)
SELECT universe, round(a, 6) AS pct, CAST(CASE WHEN universe < 5 THEN 50 WHEN a >= 85 THEN 90 WHEN a >= 65 THEN 75 WHEN a >= 45 THEN 55 WHEN a >= 25 THEN 35
  WHEN a >= 10 THEN 20 ELSE 35 END AS INTEGER) AS score FROM p""",
)
def _thrust(spark, sf):
    return RG.thrust(tables.supplier_days(spark, sf)).select("universe", F.round("pct", 6).alias("pct"), "score")


def _share(spark, sf):
    d = tables.flag_days(spark, sf)
    return d.groupBy("day").agg((F.sum(F.when(F.col("symbol") == "NO", F.col("v")).otherwise(0.0)) / F.sum("v") * 100).alias("share"))


_SH = f"{_D}, sh AS (SELECT day, sum(CASE WHEN symbol = 'NO' THEN v ELSE 0 END) / sum(v) * 100 AS c FROM bars GROUP BY 1)"


@query(
    "regime_dominance",
    f"""WITH {_SH}, x AS (SELECT c, c - lag(c, 30) OVER (ORDER BY day) AS d FROM sh QUALIFY row_number() OVER (ORDER BY day DESC) = 1)
SELECT CAST(CASE WHEN d < -0.5 THEN 90 WHEN d > 0.5 THEN 65 ELSE 75 END - CASE WHEN c <= 40 THEN 5 ELSE 0 END AS INTEGER) AS score, CASE WHEN d > 0.5 THEN 'rising' WHEN d < -0.5 THEN 'falling' ELSE 'flat' END AS direction FROM x""",
)
def _dominance(spark, sf):
    return RG.dominance(_share(spark, sf), F.lit(True)).select("score", "direction")


_RATE = f"""{TICKS}, f AS (SELECT symbol, arg_max((price - 50) / 100000, ts) AS rate FROM ticks GROUP BY 1)"""


def _rates(spark, sf):
    return tables.ticks(spark, sf).groupBy("symbol").agg(F.max_by((F.col("price") - 50) / 100000, "ts").alias("rate"))


@query("regime_funding", f"WITH {_RATE} SELECT CAST(CASE WHEN avg(rate) <= -0.0001 THEN 80 WHEN avg(rate) < 0 THEN 65 WHEN avg(rate) <= 0.0001 THEN 75 WHEN avg(rate) <= 0.0003 THEN 55 WHEN avg(rate) <= 0.0006 THEN 30 ELSE 10 END AS INTEGER) AS score, round(avg(rate), 10) AS avg FROM f")
def _funding(spark, sf):
    return RG.funding(_rates(spark, sf)).select("score", F.round("avg", 10).alias("avg"))


@query("regime_composite")
def _composite(spark, sf):
    days = tables.flag_days(spark, sf)
    one = lambda df, name: df.select(F.lit(name).alias("component"), F.col("score").cast("double").alias("score"), "available")
    lead = lambda df: df.where("symbol = 'NO'")
    parts = [
        one(lead(RG.trend(days)), "trend"), one(lead(RG.drawdown(days)), "drawdown"), one(RG.breadth(days), "breadth"), one(RG.thrust(days), "thrust"),
        one(RG.dominance(_share(spark, sf), F.lit(True)), "dominance"), one(RG.funding(_rates(spark, sf)), "funding"),
    ]
    rows = parts[0]
    for p in parts[1:]:
        rows = rows.unionByName(p)
    return RG.composite(rows)

"""Moments, deflated Sharpe, overfitting probability, verdicts."""

from __future__ import annotations

import datetime as dt
import math
import re

from pyspark.sql import functions as F

from barloom.functions import stats as S
from barloom.operators import books as K
from barloom.operators import gates as G
from barloom.plans import evaluate as EV
from barloom.plans import library
from barloom.plans.rules import RULES
from barloom.session import cut_lineage
from oracle.normal import norm_cdf_text, norm_ppf_text
from queries.books import BOOK_RULES, _BLOCK, _sig_sql, book_signals, book_sql, day_blocks
from queries.registry import query

TRIALS = 988
_MOM = """m AS (SELECT symbol, config, count(ret) AS n, avg(ret) AS mean, stddev_samp(ret) AS std, avg(ret) / stddev_samp(ret) AS sharpe,
  skewness(ret) * (count(ret) - 2) / sqrt(count(ret) * (count(ret) - 1.0)) AS skew, kurtosis_pop(ret) + 3 AS kurtosis
  FROM rets GROUP BY 1, 2 HAVING var_pop(ret) > 0)"""
_HEAD = f"{_sig_sql()}, {book_sql()}, {_MOM}"


def _rets(spark, sf, keys=BOOK_RULES, grid=False):
    sig = book_signals(spark, sf, keys, grid)
    paths, curve, _ = K.run_books(sig)
    return sig, paths, curve, K.equity_returns(curve)


def _round(df, *cols, digits=6):
    return df.select(*[F.round(c, digits).alias(c) if c in cols else c for c in df.columns])


@query(
    "stats_return_moments",
    f"""{_HEAD} SELECT symbol, config, n, round(mean, 6) AS mean, round(std, 6) AS std, round(sharpe, 6) AS sharpe,
  round(skew, 5) AS skew, round(kurtosis, 4) AS kurtosis FROM m""",
)
def _moments(spark, sf):
    m = S.return_moments(_rets(spark, sf)[3], K.KEYS).where("sharpe IS NOT NULL")
    return _round(_round(_round(m, "mean", "std", "sharpe"), "skew", digits=5), "kurtosis", digits=4)


_EMAX = f"({1 - S.EULER_MASCHERONI!r} * z1 + {S.EULER_MASCHERONI!r} * z2)"
_Z = f"z AS (SELECT {norm_ppf_text(f'{1 - 1 / TRIALS:.17e}')} AS z1, {norm_ppf_text(f'{1 - 1 / (TRIALS * math.e):.17e}')} AS z2)"


@query(
    "stats_deflated_sharpe",
    f"""{_HEAD}, {_Z}, v AS (SELECT *, 1 - skew * sharpe + (kurtosis - 1) / 4 * sharpe * sharpe AS var FROM m, z),
b AS (SELECT *, sqrt(var / (n - 1)) AS sr_std, sqrt(var / (n - 1)) * {_EMAX} AS bench FROM v WHERE var > 0),
x AS (SELECT *, (sharpe - bench) * sqrt(n - 1) / sqrt(var) AS zz FROM b)
SELECT symbol, config, round(sr_std, 6) AS sr_std, round(bench, 6) AS sr_benchmark, round({norm_cdf_text("zz")}, 6) AS dsr FROM x""",
)
def _dsr(spark, sf):
    m = S.return_moments(_rets(spark, sf)[3], K.KEYS).where("sharpe IS NOT NULL")
    out = S.with_deflated_sharpe(m, F.lit(TRIALS)).where("sr_std > 0")
    return _round(out.select("symbol", "config", "sr_std", "sr_benchmark", "dsr"), "sr_std", "sr_benchmark", "dsr")


def _need(steps: int) -> str:
    text = "(emax + zc) * sqrt(1.0 / (n - 1))"
    ctes = [f"h0 AS (SELECT *, {_EMAX} AS emax, {norm_ppf_text('9.5e-1')} AS zc FROM m, z)", f"h1 AS (SELECT *, {text} AS r FROM h0)"]
    for k in range(steps):
        ctes.append(
            f"h{k + 2} AS (SELECT * REPLACE ((emax + zc) * sqrt(greatest(1e-12, 1 - skew * r + (kurtosis - 1) / 4 * r * r) / (n - 1)) AS r) FROM h{k + 1})"
        )
    return ", ".join(ctes)


@query(
    "stats_dsr_hurdles",
    f"""{_HEAD}, {_Z}, {_need(20)}, q AS (SELECT *, greatest(1e-12, 1 - skew * sharpe + (kurtosis - 1) / 4 * sharpe * sharpe) AS v FROM h21)
SELECT symbol, config, round(r * sqrt(365), 3) AS required_annual_sharpe,
  CASE WHEN sharpe > 0 THEN CAST(ceil(1 + v * power((emax + zc) / sharpe, 2)) AS BIGINT) END AS days_needed,
  CASE WHEN sharpe > 0 THEN CAST(ceil(1 + v * power(zc / sharpe, 2)) AS BIGINT) END AS psr_days_needed FROM q""",
)
def _hurdles(spark, sf):
    m = S.return_moments(_rets(spark, sf)[3], K.KEYS).where("sharpe IS NOT NULL")
    return S.with_dsr_hurdles(m, F.lit(TRIALS)).select(
        "symbol", "config", "required_annual_sharpe", "days_needed", "psr_days_needed"
    )


_PBO_RULES = ["sma200", "rsi14", "turtle20"]


def _sharpe_sql(total: str, squares: str, n: str) -> str:
    mean = f"({total} / {n})"
    sd = f"sqrt(greatest(0, ({squares} / {n} - {mean} * {mean}) * ({n} / ({n} - 1.0))))"
    return f"CASE WHEN {sd} <= 1e-12 THEN CASE WHEN {mean} > 1e-15 THEN 1e6 WHEN {mean} < -1e-15 THEN -1e6 ELSE 0 END ELSE {mean} / {sd} END"


@query(
    "stats_overfitting_probability",
    f"""{_sig_sql(_PBO_RULES, True)}, {book_sql()}, {_BLOCK},
opened AS (SELECT *, coalesce(lag(equity) OVER (PARTITION BY symbol, config ORDER BY day), 10000) AS opened FROM rets),
perf AS (SELECT o.symbol, regexp_extract(config, '^lib\\.(\\w+)', 1) AS rule, config, block,
  ln(arg_max(equity, day) / arg_min(opened, day)) AS value
  FROM opened o JOIN blocks b ON b.symbol = o.symbol AND day >= block_day AND day < block_end_day GROUP BY 1, 2, 3, 4),
nb AS (SELECT symbol, rule, max(block) + 1 - (max(block) + 1) % 2 AS s FROM perf GROUP BY 1, 2),
used AS (SELECT p.*, nb.s FROM perf p JOIN nb ON nb.symbol = p.symbol AND nb.rule = p.rule WHERE block < nb.s), tot AS (SELECT symbol, rule, config, sum(value) AS t, sum(value * value) AS tt FROM used GROUP BY 1, 2, 3),
sz AS (SELECT DISTINCT s FROM nb WHERE s > 0), mk AS (SELECT s, unnest(range(CAST(2 ** s AS BIGINT))) AS split FROM sz), mb AS (SELECT s, split, unnest(range(s)) AS block FROM mk),
sp AS (SELECT * FROM mb WHERE bit_count(split) = s // 2 AND (split >> block) & 1 = 1),
ins AS (SELECT symbol, rule, config, s, split, sum(value) AS i, sum(value * value) AS ii FROM used JOIN sp USING (s, block) GROUP BY 1, 2, 3, 4, 5),
sc2 AS (SELECT symbol, rule, config, split, round({_sharpe_sql('i', 'ii', '(s / 2.0)')}, 9) AS a, round({_sharpe_sql('(t - i)', '(tt - ii)', '(s / 2.0)')}, 9) AS z
  FROM ins JOIN tot USING (symbol, rule, config)),
rk AS (SELECT symbol, rule, split, row_number() OVER (PARTITION BY symbol, rule, split ORDER BY a DESC, config) AS best,
  row_number() OVER (PARTITION BY symbol, rule, split ORDER BY z, config) AS rank, count(*) OVER (PARTITION BY symbol, rule, split) AS n FROM sc2)
SELECT symbol, rule, round(avg(CASE WHEN rank / (n + 1.0) <= 0.5 THEN 1.0 ELSE 0.0 END), 6) AS pbo, count(*) AS splits
FROM rk WHERE best = 1 GROUP BY 1, 2""",
)
def _pbo(spark, sf):
    sig, paths, curve, _ = _rets(spark, sf, _PBO_RULES, True)
    seg = K.segment_metrics(curve, paths, day_blocks(sig))
    rule = F.regexp_extract("config", r"^lib\.(\w+)", 1)
    perf = seg.select("symbol", rule.alias("rule"), "block", F.col("config").alias("ord"), S.log_growth(1 + F.col("block_pnl") / K.START_CASH).alias("value"))
    return _round(S.overfitting_probability(perf, ["symbol", "rule"]), "pbo")


_V_RULES = ["sma200", "golden_cross", "rsi14"]
SEALED_FROM = dt.date(2000, 3, 1)  # first sealed day, the same for every series


def verdict_rows(spark, sf):
    """Every config's span results side by side, as the verdict reads them."""
    sig = cut_lineage(book_signals(spark, sf, _V_RULES, True, 300))
    rows = EV.span_books(sig, 300, SEALED_FROM)
    ok = (F.col("oos_pnl") > 0) & (F.col("holdout_pnl") > 0) & (F.col("stress_oos_pnl") > 0) & (F.col("stress_holdout_pnl") > 0)
    pairs = library.neighbours(library.grid_frame(spark).where(F.col("rule").isin(*_V_RULES)))
    return G.neighbour_fraction(rows.withColumn("passed", ok), pairs)


def _span_ctes() -> str:
    """Metrics of the four books, each as its own set of CTEs over ``allsig``."""
    out = []
    for tag, cond, fee, slip in (
        ("b", f"t >= 300 AND day < DATE '{SEALED_FROM}'", K.TAKER_FEE, K.SLIPPAGE), ("h", f"t >= 300 AND day >= DATE '{SEALED_FROM}'", K.TAKER_FEE, K.SLIPPAGE),
        ("sb", f"t >= 300 AND day < DATE '{SEALED_FROM}'", *K.STRESS), ("sh", f"t >= 300 AND day >= DATE '{SEALED_FROM}'", *K.STRESS),
    ):
        lim = f"WHERE day < DATE '{SEALED_FROM}'" if "b" in tag else ""
        names = ["sig", "lagged", "sc", "ed", "isl", "held", "hits", "trades", "paths", "pt", "car", "curve", "rets", "per_day", "per_trade", "metrics"]
        text = f"sig AS (SELECT symbol, config, day, o, h, l, c, signal, {cond} AS scored FROM allsig {lim}), " + book_sql(fee=fee, slip=slip)
        for n in names:
            text = re.sub(rf"\b{n} AS \(", f"{tag}_{n} AS (", text)
            text = re.sub(rf"\b(FROM|JOIN) {n}\b", rf"\1 {tag}_{n}", text)
        out.append(text)
    return ", ".join(out)


_GRID_ROWS = ", ".join(
    f"('{library.variant_name(k, p)}', '{library.variant_name(k, q)}')"
    for k in _V_RULES for p in RULES[k].configs() for q in RULES[k].configs()
    if sum(p[x] != q[x] for x in p) == 1
)
_V = f"""{_sig_sql(_V_RULES, True).replace('sig AS (SELECT g.symbol', 'allsig AS (SELECT g.t, g.symbol')}, {_span_ctes()},
r AS (SELECT b.symbol, b.config, b.pnl AS oos_pnl, b.trades AS oos_trades, b.daily_sharpe AS oos_sharpe, h.pnl AS holdout_pnl,
  h.trades AS holdout_trades, h.daily_sharpe AS holdout_sharpe, sb.pnl AS stress_oos_pnl, sh.pnl AS stress_holdout_pnl,
  b.pnl > 0 AND h.pnl > 0 AND sb.pnl > 0 AND sh.pnl > 0 AS passed
  FROM b_metrics b JOIN h_metrics h USING (symbol, config) JOIN sb_metrics sb USING (symbol, config) JOIN sh_metrics sh USING (symbol, config)),
nb AS (SELECT p.symbol, v.a AS config, count(*) FILTER (p.passed) AS np, count(*) AS nn
  FROM (VALUES {_GRID_ROWS}) v(a, b) JOIN r p ON p.config = v.b GROUP BY 1, 2)"""


@query(
    "gates_neighbour_fraction",
    f"""{_V} SELECT r.symbol, r.config, passed, coalesce(np, 0) AS neighbours_pass, coalesce(nn, 0) AS neighbours,
  coalesce(nn > 0 AND np / nn + 1e-12 >= 0.7, FALSE) AS neighbours_ok FROM r LEFT JOIN nb ON nb.symbol = r.symbol AND nb.config = r.config""",
)
def _neighbours(spark, sf):
    return verdict_rows(spark, sf).select("symbol", "config", "passed", "neighbours_pass", "neighbours", "neighbours_ok")


def _list(parts: list[tuple[str, str]]) -> str:
    return "array_to_string(list_filter([" + ", ".join(f"CASE WHEN NOT coalesce({c}, FALSE) THEN '{k}' END" for k, c in parts) + "], lambda x: x IS NOT NULL), ',')"


def _tagged(tag: str, cond: str, lim: str) -> str:
    """Benchmark books without a stop, over ``bsig``."""
    names = ["sig", "lagged", "sc", "ed", "isl", "held", "hits", "trades", "paths", "pt", "car", "curve", "rets", "per_day", "per_trade", "metrics"]
    text = f"sig AS (SELECT symbol, config, day, o, h, l, c, signal, {cond} AS scored FROM bsig {lim}), " + book_sql(stop=0)
    for n in names:
        text = re.sub(rf"\b{n} AS \(", f"{tag}_{n} AS (", text)
        text = re.sub(rf"\b(FROM|JOIN) {n}\b", rf"\1 {tag}_{n}", text)
    return text


def _full_verdict(rules: list[str]) -> str:
    """CTE ``j``: every measure of the verdict, and ``v``: the failing checks by its definitions."""
    grid = ", ".join(
        f"('{library.variant_name(k, p)}', '{library.variant_name(k, q)}')" for k in rules for p in RULES[k].configs() for q in RULES[k].configs() if sum(p[x] != q[x] for x in p) == 1)
    base = _V.replace(_sig_sql(_V_RULES, True).replace('sig AS (SELECT g.symbol', 'allsig AS (SELECT g.t, g.symbol'), _sig_sql(rules, True).replace('sig AS (SELECT g.symbol', 'allsig AS (SELECT g.t, g.symbol')).replace(_GRID_ROWS, grid)
    sealed = f"DATE '{SEALED_FROM}'"
    return f"""{base}, {_BLOCK.replace('FROM sc', 'FROM b_sc')}, {_MOM.replace('FROM rets', 'FROM b_rets')}, {_Z},
dv AS (SELECT *, 1 - skew * sharpe + (kurtosis - 1) / 4 * sharpe * sharpe AS var FROM m, z), dz AS (SELECT *, (sharpe - sqrt(var / (n - 1)) * {_EMAX}) * sqrt(n - 1) / sqrt(var) AS zz FROM dv WHERE var > 0),
ds AS (SELECT symbol, config, {norm_cdf_text("zz")} AS dsr FROM dz),
opened AS (SELECT *, coalesce(lag(equity) OVER (PARTITION BY symbol, config ORDER BY day), 10000) AS opened FROM b_rets),
perf AS (SELECT o.symbol, regexp_extract(config, '^lib\\.(\\w+)', 1) AS rule, config, block, 10000 * (arg_max(equity, day) / arg_min(opened, day) - 1) AS value
  FROM opened o JOIN blocks b ON b.symbol = o.symbol AND day >= block_day AND day < block_end_day GROUP BY 1, 2, 3, 4),
fd AS (SELECT symbol, config, count(DISTINCT block) AS nw FROM perf GROUP BY 1, 2), tl AS (SELECT symbol, count(*) AS ew FROM blocks GROUP BY 1),
ns AS (SELECT symbol, rule, max(block) + 1 - (max(block) + 1) % 2 AS s FROM perf GROUP BY 1, 2), used AS (SELECT p.*, ns.s FROM perf p JOIN ns ON ns.symbol = p.symbol AND ns.rule = p.rule WHERE block < ns.s),
tot AS (SELECT symbol, rule, config, sum(value) AS t, sum(value * value) AS tt FROM used GROUP BY 1, 2, 3), sz AS (SELECT DISTINCT s FROM ns WHERE s > 0), mk AS (SELECT s, unnest(range(CAST(2 ** s AS BIGINT))) AS split FROM sz),
sp AS (SELECT * FROM (SELECT s, split, unnest(range(s)) AS block FROM mk) WHERE bit_count(split) = s // 2 AND (split >> block) & 1 = 1),
ins AS (SELECT symbol, rule, config, s, split, sum(value) AS i, sum(value * value) AS ii FROM used JOIN sp USING (s, block) GROUP BY 1, 2, 3, 4, 5),
scv AS (SELECT symbol, rule, config, split, round({_sharpe_sql('i', 'ii', '(s / 2.0)')}, 9) AS a, round({_sharpe_sql('(t - i)', '(tt - ii)', '(s / 2.0)')}, 9) AS z FROM ins JOIN tot USING (symbol, rule, config)),
rk AS (SELECT symbol, rule, split, row_number() OVER (PARTITION BY symbol, rule, split ORDER BY a DESC, config) AS best, row_number() OVER (PARTITION BY symbol, rule, split ORDER BY z, config) AS rank, count(*) OVER (PARTITION BY symbol, rule, split) AS n FROM scv),
pb AS (SELECT symbol, rule, CASE WHEN max(n) >= 2 THEN avg(CASE WHEN rank / (n + 1.0) <= 0.5 THEN 1.0 ELSE 0.0 END) END AS pbo FROM rk WHERE best = 1 GROUP BY 1, 2),
num AS (SELECT *, row_number() OVER (PARTITION BY symbol ORDER BY day) - 1 AS t FROM bars),
stk AS (SELECT *, CASE WHEN t >= 49 THEN coalesce(c > avg(c) OVER w7 AND avg(c) OVER w7 > avg(c) OVER w25 AND avg(c) OVER w25 > avg(c) OVER w50, FALSE) ELSE FALSE END AS signal FROM num
  WINDOW w7 AS (PARTITION BY symbol ORDER BY day ROWS 6 PRECEDING), w25 AS (PARTITION BY symbol ORDER BY day ROWS 24 PRECEDING), w50 AS (PARTITION BY symbol ORDER BY day ROWS 49 PRECEDING)),
bsig AS (SELECT symbol, 'sma' AS config, day, o, h, l, c, signal, t FROM stk UNION ALL SELECT symbol, 'bh', day, o, h, l, c, TRUE, t FROM stk),
{_tagged('x', f"t >= 300 AND day < {sealed}", f"WHERE day < {sealed}")}, {_tagged('y', f"t >= 300 AND day >= {sealed}", "")},
bench AS (SELECT x.symbol, max(x.pnl) FILTER (x.config = 'sma') AS sma, max(x.pnl) FILTER (x.config = 'bh') AS bh, max(y.pnl) FILTER (y.config = 'sma') AS smah, max(y.pnl) FILTER (y.config = 'bh') AS bhh
  FROM x_metrics x JOIN y_metrics y USING (symbol, config) GROUP BY 1),
j AS (SELECT r.*, coalesce(np, 0) AS np, coalesce(nn, 0) AS nn, sma, bh, smah, bhh, ds.dsr, pb.pbo, coalesce(fd.nw, 0) AS nw, tl.ew FROM r LEFT JOIN nb ON nb.symbol = r.symbol AND nb.config = r.config JOIN bench ON bench.symbol = r.symbol
  LEFT JOIN ds ON ds.symbol = r.symbol AND ds.config = r.config LEFT JOIN pb ON pb.symbol = r.symbol AND pb.rule = regexp_extract(r.config, '^lib\\.(\\w+)', 1) LEFT JOIN fd ON fd.symbol = r.symbol AND fd.config = r.config LEFT JOIN tl ON tl.symbol = r.symbol),
v AS (SELECT *, {_list([("windows", "nw = ew"), ("oos_trades", "oos_trades >= 8"), ("oos_pnl", "oos_pnl > 0"), ("holdout_pnl", "holdout_pnl > 0"), ("holdout_trades", "holdout_trades >= 2"), ("cost_stress", "stress_oos_pnl > 0 AND stress_holdout_pnl > 0")])} AS failing,
{_list([("oos_sharpe", "oos_sharpe >= 0.3"), ("beat_sma_stack", "oos_pnl > sma"), ("holdout_sharpe", "holdout_sharpe >= 0.3"), ("holdout_beat_sma_stack", "holdout_pnl > smah"), ("dsr", "dsr >= 0.95"), ("pbo", "pbo <= 0.2"),
  ("neighbours", "nn > 0 AND np / nn + 1e-12 >= 0.7"), ("buy_and_hold", "oos_pnl > bh AND holdout_pnl > bhh")])} AS warnings FROM j)"""


@query(
    "gates_library_verdict",
    _full_verdict(_V_RULES) + """ SELECT symbol, config, failing AS failing_checks, warnings AS warning_checks, failing = '' AS qualified, failing <> '' AND failing IN ('oos_trades', 'holdout_trades', 'oos_trades,holdout_trades') AS count_only,
  round(ln(1 + sma / 10000), 5) AS sma_growth, round(ln(1 + bhh / 10000), 5) AS bh_holdout_growth, CAST(nw AS INTEGER) AS n_windows, CAST(ew AS INTEGER) AS expected_windows FROM v""",
)
def _verdict(spark, sf):
    from barloom.sources import tables

    growth = lambda c: F.round(S.log_growth(1 + F.col(c) / K.START_CASH), 5)
    return EV.evaluate(tables.flag_days(spark, sf), _V_RULES, 300, SEALED_FROM).select(
        "symbol", "config", F.array_join("failing_checks", ",").alias("failing_checks"), F.array_join("warning_checks", ",").alias("warning_checks"), "qualified", "count_only",
        growth("sma_oos_pnl").alias("sma_growth"), growth("bh_holdout_pnl").alias("bh_holdout_growth"), "n_windows", "expected_windows")


_E_RULES = ["sma200", "turtle20", "rsi14"]


@query(
    "evaluate_rules",
    _full_verdict(_E_RULES) + """ SELECT symbol, config, oos_trades, holdout_trades, round(dsr, 6) AS dsr, round(pbo, 6) AS pbo, nn AS neighbours, np AS neighbours_pass, failing, failing = '' AS qualified FROM v""",
)
def _evaluate(spark, sf):
    from barloom.sources import tables

    return EV.evaluate(tables.flag_days(spark, sf), _E_RULES, 300, SEALED_FROM).select(
        "symbol", "config", "oos_trades", "holdout_trades", F.round("dsr", 6).alias("dsr"), F.round("pbo", 6).alias("pbo"), "neighbours", "neighbours_pass", F.array_join("failing_checks", ",").alias("failing"), "qualified")


@query(
    "gates_sealed_split",
    f"""{_sig_sql(['sma200'])} SELECT symbol, count(*) FILTER (day < DATE '2000-06-01') AS discovery_days,
  count(*) FILTER (day >= DATE '2000-06-01' AND day < DATE '2001-06-01') AS sealed_days FROM sig GROUP BY 1""",
)
def _sealed(spark, sf):
    from barloom.sources import tables

    start, end = dt.date(2000, 6, 1), dt.date(2001, 6, 1)
    days = tables.flag_days(spark, sf)
    seen = G.seal(start, "discovery")(lambda rows: rows.groupBy("symbol").agg(F.count(F.lit(1)).alias("discovery_days")))(days)
    sealed = G.holdout_rows(days, start, end).groupBy("symbol").agg(F.count(F.lit(1)).alias("sealed_days"))
    return seen.join(sealed, "symbol")

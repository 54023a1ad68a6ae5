"""Names, families, results and candidates over the derived evaluation log."""

from __future__ import annotations

from pyspark.sql import functions as F

from barloom.operators import gates as G
from barloom.operators import names as N
from barloom.operators import results as R
from barloom.sources import tables
from barloom.sources.results import EXPECTED_WINDOWS, POOL, eval_log
from oracle import sheet_sql
from queries.registry import query

_POOL = "[" + ", ".join(f"'{a}'" for a in POOL) + "]"
_N = len(POOL)
_PICKS = ", ".join(
    f"{_POOL}[CAST({k} AS BIGINT) + 1]" for k in (f"o_custkey % {_N}", f"(o_custkey // {_N} * 7 + 5) % {_N}", f"(o_custkey // 7 * 11 + 17) % {_N}")
)
LOG = f"""log0 AS (SELECT array_to_string(list_sort(list_distinct(([{_PICKS}])[1:o_orderkey % 3 + 1])), '&') AS name,
  o_orderkey AS seq, o_orderdate AS tested_at, o_custkey AS account, CAST(floor(o_totalprice / 100) - 2200 AS DOUBLE) AS test_pnl,
  CAST(floor(o_totalprice / 200) - 500 AS DOUBLE) AS train_pnl, CAST((o_orderkey * 37 % 200) / 100.0 - 0.7 AS DOUBLE) AS sharpe, o_orderkey % 90 AS trades,
  CAST((o_orderkey * 53 % 300) / 100.0 - 1.0 AS DOUBLE) AS daily_sharpe, CAST((o_custkey % 100) * 30 - 1000 AS DOUBLE) AS bh_oos_pnl,
  CASE WHEN o_custkey % 11 <> 0 THEN CAST((o_custkey % 70) * 20 - 500 AS DOUBLE) END AS sma_stack_oos_pnl,
  CASE WHEN o_orderkey % 13 = 0 THEN 17 ELSE 18 END AS n_windows, o_orderkey % 29 = 0 AS ops_park,
  CASE WHEN o_orderstatus = 'O' THEN 'older' ELSE 'current' END AS gate FROM orders),
log AS (SELECT *, list_filter([CASE WHEN n_windows <> 18 THEN printf('windows %d != expected 18', n_windows) END,
  CASE WHEN trades < 30 THEN printf('oos_trades %d < 30', trades) END, CASE WHEN sharpe < 0.3 THEN printf('oos_sharpe %.2f < 0.3', sharpe) END,
  CASE WHEN sma_stack_oos_pnl IS NULL THEN 'sma_stack missing' WHEN test_pnl <= sma_stack_oos_pnl
    THEN printf('oos_pnl %.2f <= sma_stack %.2f', test_pnl, sma_stack_oos_pnl) END], lambda x: x IS NOT NULL) AS reasons FROM log0),
ev AS (SELECT *, len(reasons) = 0 AS qualified, test_pnl + sharpe * 10 AS score FROM log),
latest AS (SELECT * FROM ev QUALIFY row_number() OVER (PARTITION BY name ORDER BY tested_at DESC, seq DESC) = 1)"""

# Parsed atoms in SQL: (name, pos, atom, family, params, lo, hi).
_CASES = [
    (r"^rsi_(\d+)_>_?(\d+)(?:_<_?(\d+))?$", "'rsi'", "1", "2", "3"), (r"^rsi_(\d+)_<_?(\d+)$", "'rsi'", "1", None, "2"),
    (r"^rsi_(\d+)_(\d+)$", "'rsi'", "1", "2", None), (r"^(mom|dip)_(\d+)b_(?:gt|lt)(\d+)pc$", "1", "2", "3", None),
    (r"^(h[14]_(?:ema|sma)_abv)_(\d+)$", "1", "2", None, None), (r"^(sma_abv|ema_abv)_(\d+)$", "1", "2", None, None),
    (r"^(sma_stack|ema_stack)_([\d_]+)$", "1", "2", None, None),
    (r"^(don_hi|don_lo|near_swing_hi|near_swing_lo|dbl_bot|dbl_top)_(\d+)$", "1", "2", None, None),
]


def _pick(which: int) -> str:
    out = "CASE "
    for case in _CASES:
        pat, got = case[0], case[which]
        val = "NULL" if got is None else got if got.startswith("'") else f"nullif(regexp_extract(atom, '{pat}', {got}), '')"
        out += f"WHEN regexp_matches(atom, '{pat}') THEN {val} "
    return out + "END"


ATOMS = f"""stacks AS (SELECT DISTINCT name FROM ev), parts AS (SELECT name, unnest(string_split(name, '&')) AS atom,
  generate_subscripts(string_split(name, '&'), 1) - 1 AS pos FROM stacks),
atoms AS (SELECT name, pos, atom, {_pick(1)} AS family, {_pick(2)} AS params, CAST({_pick(3)} AS DOUBLE) AS lo, CAST({_pick(4)} AS DOUBLE) AS hi FROM parts)"""


def latest(spark, sf):
    return R.latest_per_name(eval_log(spark, sf))


@query("results_eval_log", f"WITH {LOG} SELECT name, seq, tested_at, test_pnl, sharpe, trades, qualified, round(score, 4) AS score, array_to_string(reasons, '; ') AS reasons FROM ev")
def _log(spark, sf):
    return eval_log(spark, sf).select(
        "name", "seq", "tested_at", "test_pnl", "sharpe", "trades", "qualified", F.round("score", 4).alias("score"),
        F.array_join("reasons", "; ").alias("reasons"),
    )


@query("results_latest_per_name", f"WITH {LOG} SELECT name, seq, tested_at, qualified FROM latest")
def _latest(spark, sf):
    return latest(spark, sf).select("name", "seq", "tested_at", "qualified")


@query("results_counts", f"WITH {LOG} SELECT count(*) AS unique_names, count(*) FILTER (qualified) AS passed, count(*) FILTER (NOT qualified) AS failed FROM latest")
def _counts(spark, sf):
    return R.result_counts(eval_log(spark, sf))


@query(
    "results_trial_census",
    f"""WITH {LOG} SELECT count(*) AS n_metrics, count(*) FILTER (ops_park) AS n_ops_park, count(*) FILTER (NOT ops_park) AS n_backtested,
  count(*) FILTER (NOT ops_park) + 1 AS n_trials, round(stddev_samp(sharpe) FILTER (NOT ops_park), 6) AS trade_sharpe_std FROM latest""",
)
def _census(spark, sf):
    return R.trial_census(eval_log(spark, sf)).withColumn("trade_sharpe_std", F.round("trade_sharpe_std", 6))


@query("results_on_day", f"WITH {LOG} SELECT name, seq FROM ev WHERE CAST(tested_at AS DATE) = DATE '1998-10-03'")
def _on_day(spark, sf):
    return R.on_day(eval_log(spark, sf), "1998-10-03").select("name", "seq")


@query("results_failed_names", f"WITH {LOG} SELECT DISTINCT name FROM ev WHERE NOT qualified")
def _failed(spark, sf):
    return R.failed_names(eval_log(spark, sf))


@query("results_keep_newest", f"WITH {LOG} SELECT seq, name FROM ev ORDER BY tested_at DESC, seq DESC LIMIT 100")
def _newest(spark, sf):
    return R.keep_newest(eval_log(spark, sf), 100).select("seq", "name")


@query("results_page")
def _page(spark, sf):
    return R.page(eval_log(spark, sf), 40, 20, True).select("seq", "name", "tested_at")


@query(
    "results_changed_rows",
    f"""WITH {LOG}, stored AS (SELECT name, CASE WHEN trades % 5 = 0 THEN trades + 1 ELSE trades END AS trades, sharpe FROM latest WHERE trades % 7 <> 0)
SELECT l.name, l.trades, l.sharpe FROM latest l LEFT JOIN stored s ON s.name = l.name AND s.trades = l.trades AND s.sharpe = l.sharpe WHERE s.name IS NULL""",
)
def _changed(spark, sf):
    rows = latest(spark, sf).select("name", "trades", "sharpe")
    stored = rows.where("trades % 7 <> 0").withColumn("trades", F.expr("CASE WHEN trades % 5 = 0 THEN trades + 1 ELSE trades END"))
    return R.changed_rows(rows, stored)


@query(
    "results_overlay_index",
    f"""WITH {LOG}, old AS (SELECT name, FALSE AS qualified FROM latest WHERE trades % 2 = 0), fresh AS (SELECT name, qualified FROM
  (SELECT * FROM ev WHERE trades > 40 QUALIFY row_number() OVER (PARTITION BY name ORDER BY tested_at DESC, seq DESC) = 1))
SELECT coalesce(o.name, f.name) AS name, coalesce(f.qualified, o.qualified) AS qualified FROM old o FULL OUTER JOIN fresh f ON f.name = o.name""",
)
def _overlay(spark, sf):
    index = latest(spark, sf).where("trades % 2 = 0").select("name", F.lit(False).alias("qualified"))
    return R.overlay(index, eval_log(spark, sf).where("trades > 40"), "qualified")


_GATE = """CASE WHEN starts_with(r, 'oos_trades') THEN 'trades' WHEN starts_with(r, 'oos_sharpe') THEN 'sharpe' WHEN contains(r, 'sma_stack') THEN 'baseline'
  WHEN starts_with(r, 'windows') THEN 'windows' ELSE 'ops' END"""


@query(
    "results_gate_failures",
    f"""WITH {LOG}, g AS (SELECT DISTINCT name, {_GATE} AS gate_key FROM (SELECT name, unnest(reasons) AS r FROM latest WHERE gate = 'current'))
SELECT gate_key, count(*) AS names FROM g GROUP BY 1""",
)
def _gate_failures(spark, sf):
    return R.gate_failures(eval_log(spark, sf), "current")


@query("names_parse_atoms", f"WITH {LOG}, {ATOMS} SELECT name, CAST(pos AS INTEGER) AS pos, atom, family, params, lo, hi FROM atoms")
def _parse(spark, sf):
    return N.atom_rows(eval_log(spark, sf).select("name").distinct()).drop("op")


_GROUPED = f"""{LOG}, {ATOMS}, grp AS (SELECT *, max(lo) OVER w AS elo, min(hi) OVER w AS ehi, count(*) OVER w AS n FROM atoms
  WHERE family IS NOT NULL WINDOW w AS (PARTITION BY name, family, params)),
mk AS (SELECT *, count(*) FILTER (lo = elo) OVER w AS nlo, count(*) FILTER (hi = ehi) OVER w AS nhi FROM grp WINDOW w AS (PARTITION BY name, family, params)),
bound AS (SELECT name, family, params, min(pos) AS pos, CASE WHEN max(elo) >= min(ehi) THEN 'empty_band'
  WHEN bool_or(n > 1 AND NOT coalesce(lo = elo AND nlo = 1, FALSE) AND NOT coalesce(hi = ehi AND nhi = 1, FALSE)) THEN 'redundant_threshold' END AS reason
  FROM mk GROUP BY 1, 2, 3),
b1 AS (SELECT name, arg_min(reason, pos) AS br FROM bound WHERE reason IS NOT NULL GROUP BY 1)"""


@query("names_bound_reasons", f"WITH {_GROUPED} SELECT name, br AS bound_reason FROM b1")
def _bounds(spark, sf):
    return N.bound_reasons(N.atom_rows(eval_log(spark, sf).select("name").distinct()))


_DEAD = """z AS (SELECT name, count(*) AS n, min(CASE WHEN (family = 'mom' AND lo >= 14) OR (family = 'dip' AND params IN ('18', '24') AND lo >= 5) THEN pos END) AS dp,
  bool_or(coalesce(regexp_matches(family, '^h[14]_.*_abv$'), FALSE)) AS hh,
  bool_or(coalesce(family IN ('sma_abv', 'ema_abv') OR (family = 'rsi' AND lo IS NOT NULL), FALSE)) AS ff FROM atoms GROUP BY 1),
zone AS (SELECT z.name, CASE WHEN n >= 5 THEN 'dead_depth' WHEN dp IS NOT NULL THEN CASE WHEN a.family = 'mom' THEN 'dead_mom_threshold' ELSE 'dead_dip' END
  WHEN hh AND ff THEN 'filler_atom' END AS zr FROM z LEFT JOIN atoms a ON a.name = z.name AND a.pos = z.dp)"""


@query("names_dead_zone", f"WITH {LOG}, {ATOMS}, {_DEAD} SELECT name, zr AS zone_reason FROM zone WHERE zr IS NOT NULL")
def _dead(spark, sf):
    return N.dead_zone(N.atom_rows(eval_log(spark, sf).select("name").distinct()))


LOOKBACKS = [6, 12, 18, 24, 48]
_CAPS = f"""days AS ({sheet_sql.FLAG_DAYS}), mv AS (SELECT symbol, k AS lookback, abs(c / lag(c, k) OVER (PARTITION BY symbol, k ORDER BY day) - 1) * 100 AS m
  FROM days, (SELECT unnest({LOOKBACKS}) AS k)), cp AS (SELECT symbol, lookback, quantile_cont(m, 0.99) AS p, count(m) AS n FROM mv GROUP BY 1, 2),
caps AS (SELECT lookback, max(p) FILTER (n >= 500) AS cap FROM cp GROUP BY 1)"""


@query("names_move_caps", f"WITH {_CAPS} SELECT CAST(lookback AS INTEGER) AS lookback, round(cap, 4) AS cap FROM caps")
def _caps(spark, sf):
    return N.move_caps(tables.flag_days(spark, sf), LOOKBACKS).select("lookback", F.round("cap", 4).alias("cap"))


def static_caps(spark, sf):
    """No history: every lookback falls to the static table."""
    return spark.createDataFrame([], "lookback int, cap double")


_STATIC = "CASE WHEN l <= 6 THEN 4 WHEN l <= 12 THEN 6 WHEN l <= 36 THEN 8 WHEN l <= 48 THEN 10 ELSE 14 END"
_BLOCK_SQL = f"""{_GROUPED}, {_DEAD}, reach AS (SELECT DISTINCT name FROM (SELECT name, lo, CAST(params AS INTEGER) AS l FROM atoms WHERE family IN ('mom', 'dip')) WHERE lo > {_STATIC}),
blocks AS (SELECT s.name, coalesce(zr, br, CASE WHEN r.name IS NOT NULL THEN 'unreachable_threshold' END) AS reason FROM stacks s
  LEFT JOIN zone z ON z.name = s.name LEFT JOIN b1 ON b1.name = s.name LEFT JOIN reach r ON r.name = s.name)"""


@query("names_block_reasons", f"WITH {_BLOCK_SQL} SELECT name, reason FROM blocks")
def _blocks(spark, sf):
    return N.block_reasons(eval_log(spark, sf), static_caps(spark, sf))


@query("names_block_counts", f"WITH {_BLOCK_SQL}, tested AS (SELECT DISTINCT name FROM ev WHERE seq % 4 = 0) SELECT reason, count(*) AS names FROM blocks WHERE reason IS NOT NULL AND name NOT IN (SELECT name FROM tested) GROUP BY 1")
def _block_counts(spark, sf):
    log = eval_log(spark, sf)
    tested = log.where("seq % 4 = 0").select("name").distinct()
    fresh = log.select("name").distinct().join(tested, "name", "left_anti")
    return N.block_reasons(fresh, static_caps(spark, sf)).where("reason IS NOT NULL").groupBy("reason").agg(F.count(F.lit(1)).alias("names"))


@query(
    "names_canonical",
    f"""WITH {_GROUPED}, per AS (SELECT name, family, params, arg_min(atom, pos) AS f, bool_or(elo IS NOT NULL OR ehi IS NOT NULL) AS bound,
  arg_min(atom, pos) FILTER (lo IS NOT DISTINCT FROM elo AND hi IS NOT DISTINCT FROM ehi) AS exact,
  arg_min(atom, pos) FILTER (lo = elo AND hi IS NULL) AS ol, arg_min(atom, pos) FILTER (hi = ehi AND lo IS NULL) AS oh,
  max(elo) AS lo, min(ehi) AS hi FROM mk GROUP BY 1, 2, 3),
kept AS (SELECT name, unnest(CASE WHEN NOT bound THEN [f] WHEN exact IS NOT NULL THEN [exact] ELSE list_filter([
  CASE WHEN lo IS NOT NULL THEN coalesce(ol, 'rsi_' || params || '_>' || CAST(CAST(lo AS BIGINT) AS VARCHAR)) END,
  CASE WHEN hi IS NOT NULL THEN coalesce(oh, 'rsi_' || params || '_<' || CAST(CAST(hi AS BIGINT) AS VARCHAR)) END], lambda x: x IS NOT NULL) END) AS atom FROM per
  UNION ALL SELECT name, atom FROM atoms WHERE family IS NULL)
SELECT name, array_to_string(list_sort(list(atom)), '&') AS canonical FROM kept GROUP BY 1""",
)
def _canonical(spark, sf):
    return N.canonical_names(eval_log(spark, sf).select("name").distinct())


@query(
    "names_shape_tests",
    f"""WITH {LOG}, {ATOMS} SELECT name, bool_or(regexp_matches(atom, '^mom_.*_gt')) AND bool_or(regexp_matches(atom, '^dip_')) AS mom_and_dip,
  bool_and(family IS NOT NULL) AS parseable, CASE WHEN max(CASE WHEN family IN ('don_hi', 'don_lo', 'near_swing_hi', 'near_swing_lo', 'dbl_bot', 'dbl_top')
  THEN CAST(params AS INTEGER) END) > 96 THEN 'lookback_too_expensive ' || CAST(max(CASE WHEN starts_with(family, 'near') OR starts_with(family, 'don')
  THEN CAST(params AS INTEGER) END) AS VARCHAR) || '>96' END AS expensive FROM atoms GROUP BY 1""",
)
def _shapes(spark, sf):
    n = F.col("name")
    return eval_log(spark, sf).select("name").distinct().select(
        n, N.has_momentum_and_dip(n).alias("mom_and_dip"), N.is_parseable(n).alias("parseable"), N.lookback_too_expensive(n).alias("expensive")
    )


def _period(v: str) -> str:
    return f"CASE WHEN {v} < 8 THEN 5 WHEN {v} < 10 THEN 10 WHEN {v} < 40 THEN CAST(round_even({v} / 5.0, 0) * 5 AS INTEGER) ELSE CAST(round_even({v} / 10.0, 0) * 10 AS INTEGER) END"


@query(
    "names_near_duplicate_key",
    f"""WITH {LOG}, {ATOMS}, soft AS (SELECT name, CASE WHEN regexp_matches(atom, '^(h[14]_)?(sma|ema)(_abv|_stack)_[\\d_]+$') THEN
  regexp_extract(atom, '^(.*?_(?:abv|stack))_', 1) || '_' || array_to_string(list_transform(string_split(regexp_extract(atom, '_(?:abv|stack)_([\\d_]+)$', 1), '_'),
  lambda x: CAST({_period('CAST(x AS INTEGER)')} AS VARCHAR)), '_') ELSE atom END AS a FROM atoms)
SELECT name, array_to_string(list_sort(list(a)), '&') AS key FROM soft GROUP BY 1""",
)
def _near(spark, sf):
    return eval_log(spark, sf).select("name").distinct().select("name", N.near_duplicate_key(F.col("name")).alias("key"))


_SIG = f"""{LOG}, {ATOMS}, bd AS (SELECT name, atom, regexp_extract(atom, '^(h\\d+_)', 1) AS hd FROM atoms),
rs AS (SELECT name, atom, hd, substr(atom, length(hd) + 1) AS rest FROM bd),
tk AS (SELECT name, atom, hd || regexp_replace(rest, '\\d+', 'N', 'g') AS shape, regexp_extract_all(rest, '([<>]?\\d+(?:pc)?)', 1) AS toks FROM rs),
sg AS (SELECT name, string_agg(shape, '&' ORDER BY atom) AS template, flatten(list(toks ORDER BY atom)) AS toks FROM tk GROUP BY 1),
sig AS (SELECT name, template, array_to_string(list_transform(list_filter(toks, lambda t: regexp_matches(t, '^[<>]|pc$')), lambda t: regexp_extract(t, '(\\d+)', 1)), ',') AS exact,
  list_transform(list_filter(toks, lambda t: NOT regexp_matches(t, '^[<>]|pc$')), lambda t: CAST(t AS INTEGER)) AS loose FROM sg)"""


@query("names_family_signature", f"WITH {_SIG} SELECT name, template, exact, array_to_string(loose, ',') AS loose FROM sig")
def _signature(spark, sf):
    out = N.family_signature(eval_log(spark, sf).select("name").distinct())
    return out.withColumn("loose", F.array_join(F.transform("loose", lambda x: x.cast("string")), ","))


@query(
    "names_family_pairs",
    f"""WITH {_SIG} SELECT x.name AS a, y.name AS b FROM sig x JOIN sig y ON x.template = y.template AND x.exact = y.exact AND x.name < y.name AND len(x.loose) = len(y.loose)
WHERE len(list_filter(range(1, len(x.loose) + 1), lambda i: abs(x.loose[i] - y.loose[i]) > 0.2 * greatest(x.loose[i], y.loose[i]))) = 0""",
)
def _pairs(spark, sf):
    return N.family_pairs(eval_log(spark, sf))


@query("names_family_plan")
def _plan(spark, sf):
    return N.plan_families(R.ranked(latest(spark, sf)))


@query("names_neighbours")
def _neighbours(spark, sf):
    return N.neighbour_names(latest(spark, sf).where("qualified"), static_caps(spark, sf))


@query(
    "results_block_report",
    f"""WITH {LOG}, {ATOMS}, t AS (SELECT count(*) AS n, count(*) FILTER (qualified) AS q, sum(daily_sharpe) AS ds, sum(sharpe) AS sh, sum(trades) AS tr FROM latest),
m AS (SELECT DISTINCT a.name, family AS block FROM atoms a WHERE family IS NOT NULL), j AS (SELECT m.block, l.*, len(string_split(l.name, '&')) AS depth FROM m JOIN latest l ON l.name = m.name),
g AS (SELECT block, count(*) AS w, count(*) FILTER (qualified) AS wq, sum(daily_sharpe) AS wds, sum(sharpe) AS wsh, sum(trades) AS wtr FROM j GROUP BY 1),
dd AS (SELECT len(string_split(name, '&')) AS depth, sum(daily_sharpe) AS ts, count(*) AS tc FROM latest GROUP BY 1),
bd AS (SELECT block, depth, sum(daily_sharpe) AS ws, count(*) AS wc FROM j GROUP BY 1, 2),
mt AS (SELECT block, sum(least(wc, tc - wc) * (ws / wc - (ts - ws) / (tc - wc))) / sum(least(wc, tc - wc)) AS dc FROM bd JOIN dd USING (depth) WHERE tc > wc GROUP BY 1)
SELECT g.block, w AS n_with, n - w AS n_without, round(wds / w, 6) AS mean_daily_sharpe_with, round((ds - wds) / (n - w), 6) AS mean_daily_sharpe_without,
  round(wq / w, 6) AS pass_rate_with, round((q - wq) / (n - w), 6) AS pass_rate_without, round(dc, 6) AS depth_controlled FROM g JOIN t ON TRUE LEFT JOIN mt ON mt.block = g.block""",
)
def _report(spark, sf):
    return R.block_report(latest(spark, sf)).where("level = 'family'").select(
        "block", "n_with", "n_without", "mean_daily_sharpe_with", "mean_daily_sharpe_without", "pass_rate_with", "pass_rate_without", "depth_controlled"
    )


_PAIRED = f"""{LOG}, st AS (SELECT name, list_sort(string_split(name, '&')) AS a FROM latest WHERE contains(name, '&')), ls AS (SELECT name AS child, unnest(a) AS atom, a FROM st),
pp AS (SELECT child, atom, array_to_string(list_filter(a, lambda x: x <> atom), '&') AS parent FROM ls),
pr AS (SELECT atom, c.daily_sharpe - p.daily_sharpe AS delta, c.sharpe - p.sharpe AS dsh, (c.test_pnl - c.bh_oos_pnl) - (p.test_pnl - p.bh_oos_pnl) AS dex, c.trades - p.trades AS dtr
  FROM pp JOIN latest c ON c.name = child JOIN latest p ON p.name = parent)"""


@query(
    "results_paired_effects",
    f"""WITH {_PAIRED} SELECT atom, count(*) AS n, round(avg(delta), 6) AS mean_delta, count(*) FILTER (delta > 0) AS positive, count(*) FILTER (delta < 0) AS negative FROM pr GROUP BY 1""",
)
def _paired(spark, sf):
    return R.paired_effects(latest(spark, sf)).select("atom", "n", F.round("mean_delta", 6).alias("mean_delta"), "positive", "negative")


@query("results_paired_significance")
def _significance(spark, sf):
    return R.paired_effects(latest(spark, sf))


@query(
    "results_atom_lifts",
    f"""WITH {_PAIRED}, u AS (SELECT atom, count(*) AS name_count, avg(CASE WHEN trades = 0 THEN 1.0 ELSE 0.0 END) AS zr FROM (SELECT unnest(string_split(name, '&')) AS atom, trades FROM latest) GROUP BY 1),
g AS (SELECT atom, count(*) AS n, avg(dex) AS me, avg(dsh) AS ms FROM pr GROUP BY 1)
SELECT u.atom, name_count, round(zr, 6) AS zero_trade_rate, coalesce(n, 0) AS support, round(n / (n + 5.0) * me, 4) AS score_lift, round(n / (n + 5.0) * ms, 6) AS sharpe_lift
FROM u JOIN g ON g.atom = u.atom WHERE n >= 5""",
)
def _lifts(spark, sf):
    return R.estimate_lifts(latest(spark, sf)).where("source = 'paired'").select(
        "atom", "name_count", F.round("zero_trade_rate", 6).alias("zero_trade_rate"), "support",
        F.round("score_lift", 4).alias("score_lift"), F.round("sharpe_lift", 6).alias("sharpe_lift"),
    )


@query("results_lift_top_bottom")
def _top(spark, sf):
    return R.top_bottom(R.estimate_lifts(latest(spark, sf)), 5)


_RIDGE = f"""WITH RECURSIVE {LOG}, inc AS (SELECT name, test_pnl - bh_oos_pnl AS t, unnest(list_distinct(string_split(name, '&')) || ['']) AS atom FROM latest),
pr AS (SELECT x.atom AS l, y.atom AS r, CAST(count(*) AS DOUBLE) + CASE WHEN x.atom = y.atom AND x.atom <> '' THEN 25 ELSE 0 END AS n FROM inc x JOIN inc y USING (name) GROUP BY 1, 2),
al AS (SELECT DISTINCT atom FROM inc), sq AS (SELECT l.atom AS l, list(coalesce(n, 0) ORDER BY r.atom) AS w FROM al l JOIN al r ON TRUE LEFT JOIN pr ON pr.l = l.atom AND pr.r = r.atom GROUP BY 1),
m AS (SELECT list(w ORDER BY l) AS a FROM sq), b AS (SELECT list(s ORDER BY atom) AS b, list(atom ORDER BY atom) AS atoms FROM (SELECT atom, sum(t) AS s FROM inc GROUP BY 1)),
cg AS (SELECT 0 AS k, list_transform(b, lambda v: CAST(0 AS DOUBLE)) AS x, b AS r, b AS p, list_inner_product(b, b) AS rr FROM b UNION ALL
  SELECT k + 1, x, r, list_transform(range(1, len(r) + 1), lambda i: r[i] + list_inner_product(r, r) / rr * p[i]), list_inner_product(r, r) FROM (
    SELECT k, rr, p, list_transform(range(1, len(x) + 1), lambda i: x[i] + step * p[i]) AS x, list_transform(range(1, len(x) + 1), lambda i: r[i] - step * q[i]) AS r FROM (
      SELECT *, rr / list_inner_product(p, q) AS step FROM (SELECT cg.*, list_transform(m.a, lambda w: list_inner_product(w, cg.p)) AS q FROM cg, m WHERE k < 300 AND rr > 1e-12)))),
z AS (SELECT unnest(atoms) AS atom, unnest(x) AS v FROM b, (SELECT x FROM cg ORDER BY k DESC LIMIT 1)) SELECT atom, round(v, 4) AS coef FROM z WHERE atom <> ''"""


@query("results_ridge", _RIDGE)
def _ridge(spark, sf):
    rows = latest(spark, sf).select("name", (F.col("test_pnl") - F.col("bh_oos_pnl")).alias("target"))
    return R.ridge_coefficients(rows).select("atom", F.round("coef", 4).alias("coef"))


@query("results_steer_candidates")
def _steer(spark, sf):
    rows = latest(spark, sf)
    cands = rows.where("NOT qualified").select("name", F.col("seq").alias("ord"))
    return R.steer(cands, R.score_names(cands, R.estimate_lifts(rows)), 40)


@query("results_zero_trades", f"WITH {LOG} SELECT name FROM latest WHERE NOT ops_park AND trades = 0")
def _zero(spark, sf):
    return R.zero_trade_names(eval_log(spark, sf))


@query("results_seeds", f"WITH {LOG} SELECT name, seq FROM latest WHERE n_windows = 18 AND trades >= 30 ORDER BY test_pnl - bh_oos_pnl DESC, sharpe DESC, name LIMIT 50")
def _seeds(spark, sf):
    return R.order_seeds(latest(spark, sf), EXPECTED_WINDOWS, 50).select("name", "seq")


@query(
    "results_forward_candidates",
    f"WITH {LOG}, taken AS (SELECT DISTINCT name FROM ev WHERE account % 4 = 0) SELECT name, daily_sharpe FROM latest WHERE qualified AND name NOT IN (SELECT name FROM taken) ORDER BY daily_sharpe DESC, sharpe DESC, test_pnl DESC, name LIMIT 20",
)
def _forward(spark, sf):
    log = eval_log(spark, sf)
    return R.forward_candidates(R.latest_per_name(log), log.where("account % 4 = 0").select("name").distinct(), 20).select("name", "daily_sharpe")


@query("results_rank", f"WITH {LOG} SELECT name, row_number() OVER (ORDER BY daily_sharpe DESC, sharpe DESC, test_pnl DESC, tested_at, name) AS rank FROM latest")
def _rank(spark, sf):
    return R.ranked(latest(spark, sf)).select("name", "rank")


@query("results_leftovers", f"WITH {LOG} SELECT DISTINCT name FROM ev WHERE name NOT IN (SELECT name FROM ev WHERE trades > 20)")
def _leftovers(spark, sf):
    log = eval_log(spark, sf)
    return R.leftovers(R.tested_names(log), log.where("trades > 20"))


@query("results_rotate", f"WITH {LOG} SELECT DISTINCT name FROM ev")
def _rotate(spark, sf):
    return R.rotate(R.tested_names(eval_log(spark, sf)), "mom_12b_gt3pc")


@query(
    "names_atom_stacks",
    f"""WITH {LOG}, {ATOMS}, m AS (SELECT DISTINCT atom FROM atoms WHERE family = 'mom'), a AS (SELECT DISTINCT atom FROM atoms WHERE ends_with(family, '_abv')), r AS (SELECT DISTINCT atom FROM atoms WHERE family = 'rsi')
SELECT DISTINCT array_to_string(list_sort([m.atom, a.atom, r.atom]), '&') AS name FROM m, a, r""",
)
def _stacks(spark, sf):
    rows = N.atom_rows(eval_log(spark, sf).select("name").distinct())
    return N.atom_stacks(rows, ["family = 'mom'", "family LIKE '%_abv'", "family = 'rsi'"])


@query(
    "gates_qualification_windows",
    f"""WITH {LOG}, w AS (SELECT name, sum(test_pnl) AS p, sum(train_pnl) AS tp, sum(trades) AS t, avg(sharpe) AS s, count(*) AS n,
  bool_and(NOT ops_park AND trades >= 1 AND test_pnl >= 0) AS nn, max(sma_stack_oos_pnl) AS sma FROM ev GROUP BY 1)
SELECT name, round(p, 2) AS test_pnl, CAST(t AS BIGINT) AS trades, n AS n_windows, nn AS all_windows_nonneg,
  n = 18 AND t >= 30 AND s >= 0.3 AND coalesce(p > sma, FALSE) AS passed, round(p + s * 10, 4) AS score FROM w""",
)
def _qualification(spark, sf):
    log = eval_log(spark, sf).withColumn("skipped", F.col("ops_park")).withColumn("test_trades", F.col("trades"))
    bench = log.groupBy("name").agg(F.max("sma_stack_oos_pnl").alias("sma_stack_oos_pnl"))
    out = G.qualification(log, bench, EXPECTED_WINDOWS)
    return out.select("name", F.round("test_pnl", 2).alias("test_pnl"), "trades", "n_windows", "all_windows_nonneg", "passed", F.round("score", 4).alias("score"))

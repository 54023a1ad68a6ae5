"""The whole gate of expression names, against SQL written from the naming rules and the definitions of the checks."""

from __future__ import annotations

import datetime as dt
import math
import re

from pyspark.sql import functions as F

from barloom.functions import stats as S
from barloom.operators import books as K
from barloom.plans import expressions as X
from barloom.sources import tables
from oracle import sheet_sql
from oracle.normal import norm_cdf_text, norm_ppf_text
from queries.books import book_sql
from queries.names import _period, static_caps
from queries.registry import query

NAMES = ["mom_24b_gt4pc&sma_abv_50", "mom_48b_gt8pc&sma_abv_100", "mom_12b_gt4pc", "sma_abv_20"]
SCORE_FROM, SEALED_FROM, DAYS, TRIALS = 120, dt.date(2000, 3, 1), 365, 988
CROSS = {"AF": "RF", "RF": "AF", "AO": "RO", "RO": "AO", "NO": "NF"}


def _moved(value: str, grid: int, high: int) -> str:
    """A number moved by 10 and 20 percent either way on its grid, itself left out."""
    n = "CAST(round_even({v} * (1 + b) / {g}, 0) * {g} AS INTEGER)".format(v=value, g=grid)
    return f"list_filter(list_transform([-0.1, 0.1, -0.2, 0.2], lambda b: {n}), lambda x: x BETWEEN {grid} AND {high} AND x <> {value})"


_PERIODS = f"list_filter(list_transform([-0.1, 0.1, -0.2, 0.2], lambda b: {_period('CAST(round_even(n * (1 + b), 0) AS INTEGER)')}), lambda x: x <> n)"
_NAME = "concat_ws('&', CASE WHEN k IS NOT NULL THEN 'mom_' || k || 'b_gt' || p || 'pc' END, CASE WHEN n IS NOT NULL THEN 'sma_abv_' || n END)"
_RECIPES = "(24, 4, 50), (48, 8, 100), (12, 4, NULL), (NULL, NULL, 20)"
_BOOKS = ["lagged", "sc", "ed", "isl", "held", "hits", "trades", "paths", "pt", "car", "curve", "rets", "per_day", "per_trade", "metrics"]


def _tagged(tag: str, fee: float, slip: float) -> str:
    text = book_sql(fee=fee, slip=slip)
    for n in _BOOKS:
        text = re.sub(rf"\b{n} AS \(", f"{tag}_{n} AS (", text)
        text = re.sub(rf"\b(FROM|JOIN) {n}\b", rf"\1 {tag}_{n}", text)
    return text


def _parts(tag: str) -> str:
    return f"SELECT * EXCLUDE (config), split_part(config, '#', 1) AS config, split_part(config, '#', 2) AS span, '{tag}' AS cost FROM {tag}_"


_SR = "CASE WHEN stddev_samp(ret) > 1e-12 THEN avg(ret) / stddev_samp(ret) * sqrt(365) ELSE 0 END"
_PBO_SR = "CASE WHEN sqrt(greatest(0, ({q} / 2.0 - ({t} / 2.0) * ({t} / 2.0)) * 2.0)) <= 1e-12 THEN CASE WHEN {t} / 2.0 > 1e-15 THEN 1e6 WHEN {t} / 2.0 < -1e-15 THEN -1e6 ELSE 0 END ELSE ({t} / 2.0) / sqrt(greatest(0, ({q} / 2.0 - ({t} / 2.0) * ({t} / 2.0)) * 2.0)) END"
_EMAX = f"({1 - S.EULER_MASCHERONI!r} * {norm_ppf_text(f'{1 - 1 / TRIALS:.17e}')} + {S.EULER_MASCHERONI!r} * {norm_ppf_text(f'{1 - 1 / (TRIALS * math.e):.17e}')})"
_SQL = f"""WITH bars AS MATERIALIZED ({sheet_sql.FLAG_DAYS}), own AS (SELECT *, {_NAME} AS name FROM (VALUES {_RECIPES}) v(k, p, n)),
moved AS (SELECT name AS config, unnest({_moved('k', 6, 2**31 - 1)}) AS k, p, n FROM own UNION ALL SELECT name, k, unnest({_moved('p', 2, 40)}), n FROM own UNION ALL SELECT name, k, p, unnest({_PERIODS}) FROM own),
pairs AS (SELECT DISTINCT config, {_NAME} AS neighbour FROM moved WHERE {_NAME} <> config), recipes AS (SELECT DISTINCT {_NAME} AS name, k, p, n FROM (SELECT k, p, n FROM own UNION ALL SELECT k, p, n FROM moved)),
num AS (SELECT *, row_number() OVER w AS t FROM bars WINDOW w AS (PARTITION BY symbol ORDER BY day)),
backs AS (SELECT b.symbol, b.day, r.k, b.c / p.c - 1 AS move FROM num b JOIN (SELECT DISTINCT k FROM recipes WHERE k IS NOT NULL) r ON TRUE JOIN num p ON p.symbol = b.symbol AND p.t = b.t - r.k),
means AS (SELECT b.symbol, b.day, r.n, b.c > avg(p.c) AS above FROM num b JOIN (SELECT DISTINCT n FROM recipes WHERE n IS NOT NULL UNION SELECT unnest([7, 25, 50])) r ON b.t >= r.n
  JOIN num p ON p.symbol = b.symbol AND p.t > b.t - r.n AND p.t <= b.t GROUP BY 1, 2, 3, b.c),
stk AS (SELECT *, CASE WHEN t >= 50 THEN coalesce(c > avg(c) OVER w7 AND avg(c) OVER w7 > avg(c) OVER w25 AND avg(c) OVER w25 > avg(c) OVER w50, FALSE) ELSE FALSE END AS signal FROM num
  WINDOW w7 AS (PARTITION BY symbol ORDER BY day ROWS 6 PRECEDING), w25 AS (PARTITION BY symbol ORDER BY day ROWS 24 PRECEDING), w50 AS (PARTITION BY symbol ORDER BY day ROWS 49 PRECEDING)),
allsig AS (SELECT b.*, r.name, (r.k IS NULL OR coalesce(m.move > r.p / 100.0, FALSE)) AND (r.n IS NULL OR coalesce(a.above, FALSE)) AS signal FROM num b JOIN recipes r ON TRUE
    LEFT JOIN backs m ON m.symbol = b.symbol AND m.day = b.day AND m.k = r.k LEFT JOIN means a ON a.symbol = b.symbol AND a.day = b.day AND a.n = r.n
  UNION ALL SELECT * EXCLUDE (signal), 'sma_stack' AS name, signal FROM stk),
sd AS (SELECT symbol, min(day) FILTER (t > {SCORE_FROM}) AS a, max(day) AS z FROM num GROUP BY 1),
spans AS (SELECT symbol, printf('w%04d', k) AS span, CAST(DATE '{SEALED_FROM}' - k * {DAYS} AS DATE) AS fd, CAST(DATE '{SEALED_FROM}' - (k - 1) * {DAYS} AS DATE) AS ed FROM
    (SELECT symbol, CAST(unnest(range(1, CAST(floor(date_diff('day', a, DATE '{SEALED_FROM}') / {DAYS}.0) AS BIGINT) + 1)) AS INTEGER) AS k FROM sd)
  UNION ALL SELECT symbol, 'sealed', DATE '{SEALED_FROM}', CAST(z + 1 AS DATE) FROM sd WHERE z >= DATE '{SEALED_FROM}'),
sig AS (SELECT s.symbol, s.name || '#' || p.span AS config, s.day, o, h, l, c, signal, s.day >= p.fd AS scored FROM
  (SELECT *, lead(day) OVER (PARTITION BY symbol, name ORDER BY day) AS nd FROM allsig) s JOIN spans p ON p.symbol = s.symbol AND s.day < p.ed AND (s.day >= p.fd OR s.nd >= p.fd)),
{_tagged('base', K.TAKER_FEE, K.SLIPPAGE)}, {_tagged('stress', *K.STRESS)},
mt AS ({_parts('base')}metrics UNION ALL {_parts('stress')}metrics), rt AS ({_parts('base')}rets UNION ALL {_parts('stress')}rets),
tot AS (SELECT symbol, config, cost, count(*) AS windows, avg(daily_sharpe) AS sharpe, sum(trades) AS trades, sum(pnl) AS pnl, max(max_drawdown) AS dd FROM mt WHERE span <> 'sealed' GROUP BY 1, 2, 3),
base AS (SELECT * FROM tot WHERE cost = 'base'), nb AS (SELECT v.config, b.symbol, count(*) AS nn, count(*) FILTER (b.sharpe >= 0.3 AND b.trades >= 30) AS np FROM pairs v JOIN base b ON b.config = v.neighbour GROUP BY 1, 2),
js AS (SELECT symbol, config, cost, {_SR} AS s FROM rt WHERE span <> 'sealed' GROUP BY 1, 2, 3),
mo AS (SELECT symbol, config, count(ret) AS n, avg(ret) / stddev_samp(ret) AS sr, skewness(ret) * (count(ret) - 2) / sqrt(count(ret) * (count(ret) - 1.0)) AS sk, kurtosis_pop(ret) + 3 AS ku
  FROM rt WHERE cost = 'base' AND span <> 'sealed' GROUP BY 1, 2 HAVING var_pop(ret) > 0),
dv AS (SELECT *, 1 - sk * sr + (ku - 1) / 4 * sr * sr AS v FROM mo), dz AS (SELECT *, (sr - sqrt(v / (n - 1)) * {_EMAX}) * sqrt(n - 1) / sqrt(v) AS zz FROM dv WHERE v > 0),
dsr AS (SELECT symbol, config, {norm_cdf_text('zz')} AS dsr FROM dz),
cells AS (SELECT m.symbol, x.of, CASE WHEN x.of = x.config THEN '' ELSE x.config END AS ord, dense_rank() OVER (PARTITION BY m.symbol, x.of ORDER BY m.span) - 1 AS block, m.pnl AS value
  FROM mt m JOIN (SELECT config AS of, neighbour AS config FROM pairs UNION SELECT config, config FROM pairs) x ON x.config = m.config WHERE m.cost = 'base' AND m.span <> 'sealed'),
ct AS (SELECT symbol, of, ord, sum(value) AS t, sum(value * value) AS tt FROM cells WHERE block < 4 GROUP BY 1, 2, 3),
ci AS (SELECT symbol, of, ord, m, sum(value) AS i, sum(value * value) AS ii FROM cells JOIN (SELECT unnest([3, 5, 6, 9, 10, 12]) AS m) h ON (m >> block) & 1 = 1 WHERE block < 4 GROUP BY 1, 2, 3, 4),
cs AS (SELECT symbol, of, ord, m, round({_PBO_SR.format(t='i', q='ii')}, 9) AS a, round({_PBO_SR.format(t='(t - i)', q='(tt - ii)')}, 9) AS z FROM ci JOIN ct USING (symbol, of, ord)),
cr AS (SELECT symbol, of, m, row_number() OVER (PARTITION BY symbol, of, m ORDER BY a DESC, ord) AS best, row_number() OVER (PARTITION BY symbol, of, m ORDER BY z, ord) AS rk, count(*) OVER (PARTITION BY symbol, of, m) AS n FROM cs),
pb AS (SELECT symbol, of AS config, avg(CASE WHEN rk / (n + 1.0) <= 0.5 THEN 1.0 ELSE 0.0 END) AS pbo FROM cr WHERE best = 1 GROUP BY 1, 2),
f AS (SELECT b.symbol, b.config, b.windows, b.sharpe, b.trades, b.pnl, b.dd, coalesce(nb.nn, 0) AS nn, coalesce(nb.np, 0) AS np, st.sharpe AS ss, j1.s AS js, j2.s AS jss, dsr.dsr, pb.pbo, h.pnl AS hp, h.trades AS ht, h.daily_sharpe AS hs, q.pnl AS sp, x.sharpe AS xs
  FROM base b JOIN own ON own.name = b.config LEFT JOIN nb USING (symbol, config) LEFT JOIN tot st ON st.symbol = b.symbol AND st.config = b.config AND st.cost = 'stress'
  LEFT JOIN js j1 ON j1.symbol = b.symbol AND j1.config = b.config AND j1.cost = 'base' LEFT JOIN js j2 ON j2.symbol = b.symbol AND j2.config = b.config AND j2.cost = 'stress'
  LEFT JOIN dsr ON dsr.symbol = b.symbol AND dsr.config = b.config LEFT JOIN pb ON pb.symbol = b.symbol AND pb.config = b.config
  LEFT JOIN mt h ON h.symbol = b.symbol AND h.config = b.config AND h.cost = 'base' AND h.span = 'sealed' LEFT JOIN mt q ON q.symbol = b.symbol AND q.config = 'sma_stack' AND q.cost = 'base' AND q.span = 'sealed'
  LEFT JOIN (VALUES {', '.join(f"('{a}', '{b}')" for a, b in CROSS.items())}) v(s, other) ON v.s = b.symbol LEFT JOIN base x ON x.symbol = v.other AND x.config = b.config),
g AS (SELECT *, list_filter([CASE WHEN coalesce(hs >= 0.3, FALSE) THEN '' ELSE 'holdout_sharpe' END, CASE WHEN coalesce(ht >= 8, FALSE) THEN '' ELSE 'holdout_trades' END, CASE WHEN coalesce(hp > sp, FALSE) THEN '' ELSE 'holdout_pnl' END,
  CASE WHEN coalesce(dsr >= 0.95, FALSE) THEN '' ELSE 'dsr' END, CASE WHEN nn > 0 AND np / nn + 1e-12 >= 0.7 THEN '' ELSE 'neighbours' END, CASE WHEN coalesce(pbo <= 0.2, FALSE) THEN '' ELSE 'pbo' END,
  CASE WHEN coalesce(ss >= 0.3, FALSE) THEN '' ELSE 'cost' END], lambda x: x <> '') AS failed FROM f)
"""


@query(
    "gates_expressions",
    _SQL + """SELECT symbol, config, windows, round(sharpe, 6) AS sharpe, CAST(trades AS BIGINT) AS trades, CAST(nn AS BIGINT) AS neighbours, CAST(np AS BIGINT) AS neighbours_pass, round(dsr, 6) AS dsr, round(pbo, 6) AS pbo,
  round(ss, 6) AS stress_sharpe, round(xs, 6) AS cross_sharpe, xs > 0 AS cross_pass, array_to_string(failed, ',') AS failed, len(failed) = 0 AS passed FROM g""",
)
def _gates(spark, sf):
    return _run(spark, sf).select(
        "symbol", "config", "windows", F.round("sharpe", 6).alias("sharpe"), "trades", "neighbours", "neighbours_pass", F.round("dsr", 6).alias("dsr"), F.round("pbo", 6).alias("pbo"),
        F.round("stress_sharpe", 6).alias("stress_sharpe"), F.round("cross_sharpe", 6).alias("cross_sharpe"), "cross_pass", F.array_join("failed", ",").alias("failed"), "passed")


@query(
    "gates_expression_sealed",
    _SQL + """SELECT symbol, config, round(ln(1 + hp / 10000), 6) AS sealed_growth, CAST(ht AS BIGINT) AS sealed_trades, round(hs, 6) AS sealed_sharpe, round(ln(1 + sp / 10000), 6) AS sma_sealed_growth,
  round(js, 6) AS joined_sharpe, round(jss, 6) AS stress_joined_sharpe, round(dd, 6) AS max_drawdown FROM g""",
)
def _sealed(spark, sf):
    growth = lambda c: F.round(S.log_growth(1 + F.col(c) / K.START_CASH), 6)
    return _run(spark, sf).select(
        "symbol", "config", growth("sealed_pnl").alias("sealed_growth"), "sealed_trades", F.round("sealed_sharpe", 6).alias("sealed_sharpe"), growth("sma_sealed_pnl").alias("sma_sealed_growth"),
        F.round("base_joined_sharpe", 6).alias("joined_sharpe"), F.round("stress_joined_sharpe", 6).alias("stress_joined_sharpe"), F.round("max_drawdown", 6).alias("max_drawdown"))


def _run(spark, sf):
    return X.expression_gates(tables.flag_days(spark, sf), NAMES, static_caps(spark, sf), SCORE_FROM, SEALED_FROM, DAYS, TRIALS, CROSS)

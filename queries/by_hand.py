"""Rules against SQL written from their sentences alone; nothing here comes from the expression sheets."""

from __future__ import annotations

from barloom.plans import library
from barloom.plans.rules import RULES
from barloom.sources import tables
from queries.registry import query

_W = "OVER (PARTITION BY symbol ORDER BY day ROWS {n} PRECEDING)"


def _over(agg: str, x: str, n: int) -> str:
    """An aggregate of the last ``n`` values."""
    return f"{agg}({x}) {_W.format(n=n - 1)}"


def _prior(agg: str, x: str, n: int, skip: int = 1) -> str:
    return f"{agg}({x}) OVER (PARTITION BY symbol ORDER BY day ROWS BETWEEN {n + skip - 1} PRECEDING AND {skip} PRECEDING)"


def _mean(n: int, x: str = "c") -> str:
    return _over("avg", x, n)


def _back(n: int, x: str = "c") -> str:
    return f"lag({x}, {n}) OVER (PARTITION BY symbol ORDER BY day)"


def _middle(n: int) -> str:
    return f"({_over('max', 'h', n)} + {_over('min', 'l', n)}) / 2"


#: rule -> (first defined row, signal), each for the centre of its grid.
BY_HAND = {
    "sma200": (199, f"c > {_mean(200)}"),
    "sma5x150": (149, f"{_mean(5)} > {_mean(150)}"),
    "sma100": (99, f"c > {_mean(100)}"),
    "golden_cross": (199, f"{_mean(50)} > {_mean(200)}"),
    "detzel2w": (13, f"ln(c) > {_mean(14, 'ln(c)')}"),
    "tsmom30d": (30, f"c > {_back(30)}"),
    "tsmom90d": (90, f"c > {_back(90)}"),
    "tsmom180d": (180, f"c > {_back(180)}"),
    "tsmom12_1": (273, f"{_back(21)} > {_back(273)}"),
    "hi52": (251, f"c >= 0.95 * {_over('max', 'c', 252)}"),
    "tsmom_vote": (252, f"(c > {_back(21)})::INT + (c > {_back(63)})::INT + (c > {_back(252)})::INT >= 2"),
    "dow": (0, "isodow(day) = 7"),
    "halloween": (0, "month(day + 1) IN (11, 12, 1, 2, 3, 4)"),
    "tom": (0, "dayofmonth(day + 1) <= 3 OR month(day + 2) <> month(day + 1)"),
    "ichimoku_tk": (25, f"{_middle(9)} > {_middle(26)}"),
    "qstick": (7, f"{_mean(8, 'c - o')} > 0"),
    "dpo": (19, f"{_back(11)} > {_mean(20)}"),
    "cci": (19, f"(h + l + c) / 3 > {_mean(20, '(h + l + c) / 3')}"),
    "vortex": (14, f"{_over('sum', 'abs(h - pl)', 14)} > {_over('sum', 'abs(l - ph)', 14)}"),
    "cmo": (20, f"c > {_back(20)}"),
    "floor_pivot": (199, f"c > (ph + pl + pc) / 3 AND c > {_mean(200)}"),
    "woodie": (199, f"c > (ph + pl + 2 * pc) / 4 AND c > {_mean(200)}"),
    "camarilla": (199, f"c > pc + 1.1 * (ph - pl) / 4 AND c > {_mean(200)}"),
    "fibhold": (199, f"c > {_mean(200)} AND c > {_prior('min', 'l', 20)} + 0.618 * ({_prior('max', 'h', 20)} - {_prior('min', 'l', 20)})"),
    "weekend": (0, "isodow(day + 1) NOT IN (6, 7)"),
    "first_half": (0, "dayofmonth(day + 1) <= 15"),
    "awesome": (33, f"{_mean(5, '(h + l) / 2')} > {_mean(34, '(h + l) / 2')}"),
    "bop": (13, f"{_mean(14, 'CASE WHEN h > l THEN (c - o) / (h - l) ELSE 0 END')} > 0"),
    "psych": (12, f"100 * {_over('sum', '(c > pc)::INT', 12)} > 50 * 12"),
    "mom_mid": (252, f"{_back(126)} > {_back(252)}"),
    "oops": (1, "l < pl AND c > pl"),
    "twobar": (1, "l < pl AND c > ph"),
    "linreg": (19, f"regr_slope(c, t) {_W.format(n=19)} > 0"),
    "regline": (19, f"c > regr_intercept(c, t) {_W.format(n=19)} + regr_slope(c, t) {_W.format(n=19)} * t"),
    "rsquared": (19, f"regr_r2(c, t) {_W.format(n=19)} > 0.4 AND regr_slope(c, t) {_W.format(n=19)} > 0"),
    "er_sign": (10, f"(c - {_back(10)}) / {_over('sum', 'abs(c - pc)', 10)} > 0.3"),
    "eratio": (199, f"abs(c - {_back(10)}) / {_over('sum', 'abs(c - pc)', 10)} > 0.3 AND c > {_mean(200)}"),
    "imi": (13, f"{_over('sum', 'greatest(c - o, 0)', 14)} > 0.5 * {_over('sum', 'abs(c - o)', 14)}"),
    "stoch50": (13, f"c - {_over('min', 'l', 14)} > 0.5 * ({_over('max', 'h', 14)} - {_over('min', 'l', 14)})"),
    "bar8020": (199, f"h > l AND o <= l + 0.2 * (h - l) AND c >= l + 0.8 * (h - l) AND c > {_mean(200)}"),
    "nr7": (199, f"ph - pl < {_prior('min', 'h - l', 6, 2)} AND c > ph AND c > {_mean(200)}"),
}
_PARTS = " UNION ALL ".join(
    f"SELECT symbol, day, t, '{library.variant_name(k, RULES[k].center)}' AS config, t >= {first} AS ready, t >= {first} AND coalesce({on}, FALSE) AS signal FROM x" for k, (first, on) in BY_HAND.items())
#: The long daily series, stated once more: the first and last line of a day by order, line and price.
_BARS = """SELECT l_returnflag || l_linestatus AS symbol, CAST(l_shipdate AS DATE) AS day, arg_min(l_extendedprice / l_quantity, {k}) AS o, max(l_extendedprice / l_quantity) AS h, min(l_extendedprice / l_quantity) AS l,
  arg_max(l_extendedprice / l_quantity, {k}) AS c FROM lineitem GROUP BY 1, 2""".format(k="{'a': l_orderkey, 'b': l_linenumber, 'c': l_extendedprice / l_quantity}")
_SQL = f"""WITH b AS ({_BARS}), x AS MATERIALIZED (SELECT *, row_number() OVER w - 1 AS t, lag(h) OVER w AS ph, lag(l) OVER w AS pl, lag(c) OVER w AS pc FROM b WINDOW w AS (PARTITION BY symbol ORDER BY day)), s AS ({_PARTS})
SELECT symbol, config, count(*) FILTER (ready) AS ready_days, count(*) FILTER (signal) AS on_days, CAST(coalesce(sum(t) FILTER (signal), 0) AS BIGINT) AS on_index_sum,
  CAST(coalesce(sum(t * t) FILTER (signal), 0) AS BIGINT) AS on_index_sq, min(day) FILTER (signal) AS first_on FROM s GROUP BY 1, 2"""


@query("rules_by_hand", _SQL)
def _by_hand(spark, sf):
    return library.signal_summary(library.signals(tables.flag_days(spark, sf), list(BY_HAND), grid=False))

"""The rule catalog on the long daily series, every grid config."""

from __future__ import annotations

from barloom.plans import library
from barloom.plans.rules import RULES
from barloom.sources import tables
from oracle import rules_sql, sheet_sql
from queries.registry import query

SIZE = 10


def _has_sql(key: str) -> bool:
    return sheet_sql.expressible(library.sheet_for([key])[0])


def _register(name: str, keys: list[str], sql: str | None):
    @query(name, sql)
    def run(spark, sf):
        return library.signal_summary(library.signals(tables.flag_days(spark, sf), keys))


STATED = [k for k in RULES if _has_sql(k)]
STATEFUL = [k for k in RULES if k not in STATED]
for _at in range(0, len(STATED), SIZE):
    _keys = STATED[_at : _at + SIZE]
    _register(f"rules_{_keys[0]}_to_{_keys[-1]}", _keys, rules_sql.summary(_keys))
_register("rules_chart_state", STATEFUL, None)


def _stack_sql() -> str:
    base = sheet_sql.FLAG_DAYS
    avg = ", ".join(
        f"CASE WHEN count(*) OVER w{n} = {n} THEN avg(c) OVER w{n} END AS a{n}" for n in (7, 25, 50)
    )
    frames = ", ".join(
        f"w{n} AS (PARTITION BY symbol ORDER BY day ROWS BETWEEN {n - 1} PRECEDING AND CURRENT ROW)" for n in (7, 25, 50)
    )
    return f"""WITH a AS (SELECT symbol, day, c, {avg} FROM ({base}) WINDOW {frames})
SELECT symbol, day, coalesce(c > a7 AND a7 > a25 AND a25 > a50, FALSE) AS signal, a50 IS NOT NULL AS ready FROM a"""


@query("rules_sma_stack_benchmark", _stack_sql())
def _stack(spark, sf):
    return library.sma_stack(tables.flag_days(spark, sf)).select("symbol", "day", "signal", "ready")


_SCORE = ["sma200", "hi52", "rsi14", "tsmom12m", "wkswing"]


@query(
    "rules_score_start",
    rules_sql.signals_cte(_SCORE)
    + """, per AS (SELECT symbol, config, min(t) FILTER (ready) AS first, max(t) FILTER (NOT ready) AS lastun, max(t) AS last
  FROM long GROUP BY 1, 2)
SELECT symbol, max(first) + 1 AS score_t, count(*) FILTER (first IS NULL OR coalesce(lastun, -1) > first OR first + 1 > last) AS unwarmed_configs
FROM per GROUP BY 1""",
)
def _score_start(spark, sf):
    return library.score_start(library.signals(tables.flag_days(spark, sf), _SCORE)).selectExpr(
        "symbol", "CAST(score_t AS BIGINT) AS score_t", "unwarmed_configs"
    )

"""DuckDB text of a rule group's signal summary."""

from __future__ import annotations

from barloom.plans.library import sheet_for
from oracle import sheet_sql


def signals_cte(keys: list[str], base: str = sheet_sql.FLAG_DAYS, grid: bool = True) -> str:
    """WITH clause ending in ``long``: (symbol, day, t, config, signal, ready)."""
    s, configs = sheet_for(keys, grid)
    head, last = sheet_sql.with_clause(s, base)
    long = " UNION ALL ".join(
        f"SELECT symbol, day, CAST({s.t} AS BIGINT) AS t, '{name}' AS config, {on} AS signal, {ready} AS ready FROM {last}"
        for name, on, ready in configs
    )
    return f"{head}, long AS ({long})"


def summary(keys: list[str], base: str = sheet_sql.FLAG_DAYS) -> str | None:
    if not sheet_sql.expressible(sheet_for(keys)[0]):
        return None
    return f"""{signals_cte(keys, base)}
SELECT symbol, config, count(*) FILTER (ready) AS ready_days, count(*) FILTER (signal) AS on_days,
  CAST(coalesce(sum(t) FILTER (signal), 0) AS BIGINT) AS on_index_sum,
  CAST(coalesce(sum(t * t) FILTER (signal), 0) AS BIGINT) AS on_index_sq,
  min(day) FILTER (signal) AS first_on
FROM long GROUP BY symbol, config"""

"""Registered queries and, where SQL can say the same, their DuckDB text."""

from __future__ import annotations

import functools

QUERIES: dict = {}
ORACLE: dict[str, str] = {}


def _in_utc(fn):
    """Times are UTC throughout, whatever zone the session came with."""
    @functools.wraps(fn)
    def run(spark, sf_dir):
        spark.conf.set("spark.sql.session.timeZone", "UTC")
        return fn(spark, sf_dir)

    return run


def query(name: str, sql: str | None = None):
    def register(fn):
        if name in QUERIES:
            raise ValueError(f"query {name} registered twice")
        QUERIES[name] = _in_utc(fn)
        if sql:
            ORACLE[name] = sql
        return fn

    return register


# Base relations of the DuckDB texts.
TICKS = """ticks AS (SELECT event_type AS symbol, ts, value AS price, CAST(1.0 AS DOUBLE) AS v, event_id, user_id
  FROM events WHERE value > 0)"""


def bars_cte(seconds: int, name: str = "bars") -> str:
    return f"""{TICKS}, {name} AS (SELECT symbol, time_bucket(INTERVAL {seconds} SECOND, ts, TIMESTAMP '1970-01-01') AS ts,
  first(price ORDER BY ts, event_id) AS o, max(price) AS h, min(price) AS l,
  last(price ORDER BY ts, event_id) AS c, sum(v) AS v FROM ticks GROUP BY 1, 2)"""

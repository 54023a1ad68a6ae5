"""DuckDB text of a sheet, with its own statement of every recurrence.

Window entries differ from Spark's only in dialect. Recurrences are stated a
second time here as recursive queries, so the grouped maps are checked against
SQL and not against themselves.
"""

from __future__ import annotations

import re

from barloom.functions.sheet import Sheet

FLAG_DAYS = """
SELECT symbol, day, first(p ORDER BY l_orderkey, l_linenumber, p) AS o, max(p) AS h, min(p) AS l,
  last(p ORDER BY l_orderkey, l_linenumber, p) AS c, sum(q) AS v
FROM (SELECT l_returnflag || l_linestatus AS symbol, CAST(l_shipdate AS DATE) AS day,
  l_extendedprice / l_quantity AS p, CAST(l_quantity AS DOUBLE) AS q, l_orderkey, l_linenumber FROM lineitem)
GROUP BY symbol, day"""

SUPPLIER_DAYS = FLAG_DAYS.replace(
    "l_returnflag || l_linestatus", "CAST(l_suppkey AS VARCHAR)"
)


def dialect(text: str) -> str:
    """Spark text in DuckDB's dialect."""
    text = re.sub(r"\bpercentile\(", "quantile_cont(", text)
    text = re.sub(r"(?<![\w.])(\d+(?:\.\d+)?(?:[eE][+-]?\d+)?)D\b", r"CAST(\1 AS DOUBLE)", text)
    return text


def _smooth(k, x, n, alpha, depth=1):
    state, lets, value = {}, [], x
    for d in range(depth):
        p = f"{k}_{d}"
        none = "CAST(NULL AS DOUBLE)"
        state |= {f"{p}_n": "0", f"{p}_s": "CAST(0 AS DOUBLE)", f"{p}_v": none, f"{p}_y": none}
        lets += [
            (f"{p}_n", f"r_{p}_n + CASE WHEN {value} IS NOT NULL THEN 1 ELSE 0 END"),
            (f"{p}_s", f"CASE WHEN n_{p}_n <= {n} THEN r_{p}_s + coalesce({value}, 0) ELSE r_{p}_s END"),
            (f"{p}_v", f"CASE WHEN {value} IS NULL THEN r_{p}_v WHEN n_{p}_n < {n} THEN NULL WHEN n_{p}_n = {n}"
                       f" THEN n_{p}_s / {n} ELSE r_{p}_v + {alpha!r} * ({value} - r_{p}_v) END"),
            (f"{p}_y", f"CASE WHEN {value} IS NOT NULL THEN n_{p}_v END"),
        ]
        value = f"n_{p}_y"
    return state, lets, {"v": f"{k}_{depth - 1}_y"}


def _adaptive(k, x, step):
    v = f"{k}_v"
    return (
        {v: "CAST(NULL AS DOUBLE)"},
        [(v, f"CASE WHEN {step} IS NULL THEN r_{v} WHEN r_{v} IS NULL THEN {x} ELSE {step} * {x} + (1 - {step}) * r_{v} END")],
        {"v": f"CASE WHEN {{{step}}} IS NOT NULL THEN {v} END"},
    )


def _two_pole(k, x, seed, a1, a2):
    v, u = f"{k}_v", f"{k}_u"
    y = f"coalesce({seed}, {x} + {a1!r} * r_{v} + {a2!r} * r_{u})"
    return (
        {v: "CAST(0 AS DOUBLE)", u: "CAST(0 AS DOUBLE)", f"{k}_y": "CAST(NULL AS DOUBLE)"},
        [(f"{k}_y", y), (u, f"CASE WHEN n_{k}_y IS NULL THEN r_{u} ELSE r_{v} END"), (v, f"coalesce(n_{k}_y, r_{v})")],
        {"v": f"{k}_y"},
    )


def _laguerre(k, x, gamma):
    g = repr(gamma)
    state = {f"{k}_{j}": "CAST(NULL AS DOUBLE)" for j in range(4)}
    lets = [(f"{k}_0", f"coalesce({1 - gamma!r} * {x} + {g} * r_{k}_0, {x})")]
    for j in (1, 2, 3):
        lets.append((f"{k}_{j}", f"coalesce(-{g} * n_{k}_{j - 1} + r_{k}_{j - 1} + {g} * r_{k}_{j}, {x})"))
    return state, lets, {f"l{j}": f"{k}_{j}" for j in range(4)}


def _mcginley(k, x, n):
    return (
        {f"{k}_n": "0", f"{k}_s": "CAST(0 AS DOUBLE)", f"{k}_v": "CAST(NULL AS DOUBLE)"},
        [
            (f"{k}_n", f"r_{k}_n + 1"),
            (f"{k}_s", f"r_{k}_s + {x}"),
            (f"{k}_v", f"CASE WHEN n_{k}_n < {n} THEN NULL WHEN n_{k}_n = {n} THEN n_{k}_s / {n}"
                       f" WHEN r_{k}_v <= 0 OR {x} <= 0 THEN r_{k}_v ELSE r_{k}_v + ({x} - r_{k}_v) / ({n} * power({x} / r_{k}_v, 4)) END"),
        ],
        {"v": f"{k}_v"},
    )


def _supertrend(k, up, down, c):
    return (
        {f"{k}_h": "CAST(NULL AS DOUBLE)", f"{k}_l": "CAST(NULL AS DOUBLE)", f"{k}_c": "CAST(NULL AS DOUBLE)", f"{k}_v": "0"},
        [
            (f"{k}_h", f"CASE WHEN r_{k}_h IS NULL OR {up} < r_{k}_h OR r_{k}_c > r_{k}_h THEN {up} ELSE r_{k}_h END"),
            (f"{k}_l", f"CASE WHEN r_{k}_l IS NULL OR {down} > r_{k}_l OR r_{k}_c < r_{k}_l THEN {down} ELSE r_{k}_l END"),
            (f"{k}_v", f"CASE WHEN {up} IS NULL THEN 0 WHEN r_{k}_v = 1 THEN CASE WHEN {c} < n_{k}_l THEN 0 ELSE 1 END"
                       f" WHEN {c} > n_{k}_h THEN 1 ELSE 0 END"),
            (f"{k}_c", c),
        ],
        {"v": f"{k}_v"},
    )


def _trail(k, enter, c, h, band):
    peak = f"{k}_p"
    return (
        {peak: "CAST(NULL AS DOUBLE)"},
        [(peak, f"CASE WHEN r_{peak} IS NULL THEN CASE WHEN {enter} = 1 THEN {h} END"
                f" WHEN {c} < greatest(r_{peak}, {h}) - {band} THEN NULL ELSE greatest(r_{peak}, {h}) END")],
        {"v": f"CASE WHEN {peak} IS NULL THEN 0 ELSE 1 END"},
    )


def _ratchet(k, c, raw):
    stop = f"{k}_p"
    level = f"CASE WHEN r_{stop} IS NULL THEN {raw} ELSE greatest(r_{stop}, {raw}) END"
    return (
        {stop: "CAST(NULL AS DOUBLE)"},
        [(stop, f"CASE WHEN {raw} IS NULL OR {c} <= {level} THEN NULL ELSE {level} END")],
        {"v": f"CASE WHEN {stop} IS NULL THEN 0 ELSE 1 END"},
    )


def _greedy_hold(k, hit, hold):
    left = f"{k}_n"
    return (
        {left: "0"},
        [(left, f"CASE WHEN r_{left} > 1 THEN r_{left} - 1 WHEN {hit} = 1 THEN {hold} ELSE 0 END")],
        {"v": f"CASE WHEN {left} > 0 THEN 1 ELSE 0 END"},
    )


def _bulge(k, x, above, below, top, back):
    return (
        {f"{k}_a": "FALSE", f"{k}_f": "FALSE", f"{k}_v": "FALSE", f"{k}_x": "CAST(NULL AS DOUBLE)"},
        [
            (f"{k}_f", f"coalesce({x} <= {top!r} AND r_{k}_a AND r_{k}_x >= {back!r} AND {x} < {back!r}, FALSE)"),
            (f"{k}_a", f"CASE WHEN n_{k}_f THEN FALSE ELSE r_{k}_a OR coalesce({x} > {top!r}, FALSE) END"),
            (f"{k}_v", f"(r_{k}_v OR (n_{k}_f AND {above} = 1)) AND NOT {below} = 1"),
            (f"{k}_x", x),
        ],
        {"v": f"CASE WHEN {k}_v THEN 1 ELSE 0 END"},
    )


def _kagi(k, c, rev):
    up, down = f"{c} >= r_{k}_e * {1 + rev!r}", f"{c} <= r_{k}_e * {1 - rev!r}"
    return (
        {f"{k}_w": "0", f"{k}_e": "CAST(NULL AS DOUBLE)", f"{k}_v": "0"},
        [
            (f"{k}_w", f"CASE WHEN r_{k}_w <= 0 AND {up} THEN 1 WHEN r_{k}_w >= 0 AND {down} THEN -1 ELSE r_{k}_w END"),
            (f"{k}_v", f"CASE WHEN n_{k}_w = 1 AND r_{k}_w = -1 THEN 1 WHEN n_{k}_w = -1 THEN 0 ELSE r_{k}_v END"),
            (f"{k}_e", f"CASE WHEN r_{k}_e IS NULL OR n_{k}_w <> r_{k}_w OR n_{k}_w * ({c} - r_{k}_e) > 0 THEN {c} ELSE r_{k}_e END"),
        ],
        {"v": f"{k}_v"},
    )


def _parabolic(k, h, l, start, step, cap):
    p = {x: f"r_{k}_{x}" for x in ("s", "e", "g", "w", "h1", "h2", "l1", "l2", "n")}
    state = {f"{k}_n": "0", f"{k}_w": "1"} | {
        f"{k}_{x}": "CAST(NULL AS DOUBLE)" for x in ("s", "e", "g", "h1", "h2", "l1", "l2", "b")
    } | {f"{k}_t": "FALSE", f"{k}_f": "FALSE"}
    raw = f"{p['s']} + {p['g']} * ({p['e']} - {p['s']})"
    lets = [
        (f"{k}_n", f"{p['n']} + 1"),
        (f"{k}_b", f"CASE WHEN {p['w']} = 1 THEN least({raw}, {p['l1']}, {p['l2']}) ELSE greatest({raw}, {p['h1']}, {p['h2']}) END"),
        (f"{k}_t", f"{p['n']} > 0 AND CASE WHEN {p['w']} = 1 THEN {l} < n_{k}_b ELSE {h} > n_{k}_b END"),
        (f"{k}_f", f"{p['n']} > 0 AND CASE WHEN {p['w']} = 1 THEN {h} > {p['e']} ELSE {l} < {p['e']} END"),
        (f"{k}_s", f"CASE WHEN {p['n']} = 0 THEN {l} WHEN n_{k}_t THEN {p['e']} ELSE n_{k}_b END"),
        (f"{k}_g", f"CASE WHEN {p['n']} = 0 OR n_{k}_t THEN {start!r} WHEN n_{k}_f THEN least({p['g']} + {step!r}, {cap!r}) ELSE {p['g']} END"),
        (f"{k}_e", f"CASE WHEN {p['n']} = 0 THEN {h} WHEN n_{k}_t THEN CASE WHEN {p['w']} = 1 THEN {l} ELSE {h} END"
                   f" WHEN n_{k}_f THEN CASE WHEN {p['w']} = 1 THEN {h} ELSE {l} END ELSE {p['e']} END"),
        (f"{k}_w", f"CASE WHEN n_{k}_t THEN 1 - {p['w']} ELSE {p['w']} END"),
        (f"{k}_h2", p["h1"]), (f"{k}_l2", p["l1"]), (f"{k}_h1", h), (f"{k}_l1", l),
    ]
    return state, lets, {"v": f"CASE WHEN {k}_n > 1 THEN {k}_w ELSE 0 END"}


STEPS = {
    "smooth": _smooth, "adaptive": _adaptive, "two_pole": _two_pole, "laguerre": _laguerre,
    "mcginley": _mcginley, "supertrend": _supertrend, "trail": _trail, "ratchet": _ratchet,
    "greedy_hold": _greedy_hold, "bulge": _bulge, "kagi": _kagi, "parabolic": _parabolic,
}


def expressible(s: Sheet) -> bool:
    """Every recurrence of the sheet has a statement here."""
    return all(e.fold is None or e.fold[0][0] in STEPS for e in s.entries)


def _recursion(prev: str, here: str, entries, t: str) -> list[str]:
    states, stages, outs, calls = {}, {}, [], {}
    for e in entries:
        call, out = e.fold
        if call not in calls:
            kind, inputs, args = call
            st, le, ou = STEPS[kind](f"f{len(calls)}", *[f"i_{x}" for x in inputs], **dict(args))
            states |= st
            for stage, let in enumerate(le):
                stages.setdefault(stage, []).append(let)
            calls[call] = ou
        text = re.sub(r"\{i_(\w+)\}", r"p.\1", calls[call][out])
        text = re.sub(r"\b(f\d+_\w+)\b", r"q.\1", text)
        outs.append(f"CAST({text} AS DOUBLE) AS {e.name}")
    inputs = sorted({x for call in calls for x in call[1]})
    init = ", ".join(f"{v} AS {k}" for k, v in states.items())
    step = (
        f"SELECT n.symbol, n.{t} AS tt, {', '.join(f'r.{k} AS r_{k}' for k in states)},"
        f" {', '.join(f'n.{x} AS i_{x}' for x in inputs)}"
        f" FROM {here}_r r JOIN {here}_i n ON n.symbol = r.symbol AND n.{t} = r.tt + 1"
    )
    for stage in sorted(stages):
        made = ", ".join(f"{text} AS n_{name}" for name, text in stages[stage])
        step = f"SELECT *, {made} FROM ({step})"
    renamed = ", ".join(f"n_{k} AS {k}" for k in states)
    return [
        f"{here}_i AS MATERIALIZED (SELECT symbol, {t}, {', '.join(inputs)} FROM {prev})",
        f"{here}_r AS (SELECT DISTINCT symbol, -1 AS tt, {init} FROM {prev} UNION ALL"
        f" SELECT symbol, tt, {renamed} FROM ({step}))",
        f"{here} AS MATERIALIZED (SELECT p.*, {', '.join(outs)} FROM {prev} p"
        f" JOIN {here}_r q ON q.symbol = p.symbol AND q.tt = p.{t})",
    ]


def with_clause(s: Sheet, base: str = FLAG_DAYS) -> tuple[str, str]:
    """(WITH clause, name of its last relation) holding every entry of the sheet."""
    ctes, last = [f"bars AS MATERIALIZED ({base})"], "bars"
    for k, entries in enumerate(s.levels()):
        here = f"s{k}"
        if entries[0].fold is None:
            cols = ", ".join(f"{dialect(e.duck or e.text)} AS {e.name}" for e in entries)
            ctes.append(f"{here} AS MATERIALIZED (SELECT *, {cols} FROM {last})")
        else:
            ctes += _recursion(last, here, entries, s.t)
        last = here
    return "WITH RECURSIVE " + ",\n".join(ctes), last

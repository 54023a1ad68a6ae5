"""DuckDB texts of the conversation and url operators, stated from their contracts and not from the Spark plans."""

from __future__ import annotations

WS = "(' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13))"


def crc32(text: str) -> str:
    """CRC-32 of an ASCII expression: a byte is eight conditional shifts."""
    return (
        f"xor(list_reduce(list_prepend(4294967295::BIGINT, list_transform(string_split({text}, ''), lambda x: CAST(ascii(x) AS BIGINT))), "
        "lambda c, b: list_reduce(list_prepend(xor(c, b), [0, 0, 0, 0, 0, 0, 0, 0]::BIGINT[]), lambda x, z: xor(x >> 1, 3988292384 * (x & 1)))), 4294967295)"
    )


def _step(state: str, cost: str, letter: str, line: str | None) -> str:
    """A path with one edit more: k is the cost in nine digits and then the edits, so the least k is the wanted path."""
    text = f"{state}.t" if line is None else f"CASE WHEN {state}.t IS NULL THEN {line} ELSE {state}.t || chr(10) || {line} END"
    key = f"lpad(CAST(CAST(left({state}.k, 9) AS INT) + {cost} AS VARCHAR), 9, '0') || substr({state}.k, 10) || '{letter}'"
    return f"CASE WHEN {state} IS NOT NULL THEN {{'k': {key}, 't': {text}}} END"


def _least(*paths: str) -> str:
    return "least(" + ", ".join(paths) + ")" if len(paths) > 1 else paths[0]


def _when(test: str, path: str) -> str:
    return f"CASE WHEN {test} THEN {path} END"


_KEEP, _CUT = "r.role || ':' || r.text", "(CASE WHEN r.cut THEN 3 ELSE 0 END)"
_GONE = {q: _step(f"v.s{q}", "4", "D", None) for q in "0123"}
_AS = {role: f"'{role}:' || r.text" for role in ("user", "assistant")}


def _to_user(state: str) -> list[str]:
    return [_when("r.i = 'u' AND NOT r.gone", _step(state, _CUT, "K", _KEEP)), _when("NOT r.gone", _step(state, f"3 + {_CUT}", "R", _AS["user"]))]


def _to_assistant(state: str) -> list[str]:
    return [_when("r.i = 'a' AND NOT r.gone", _step(state, _CUT, "K", _KEEP)), _when("NOT r.gone", _step(state, f"3 + {_CUT}", "R", _AS["assistant"]))]


OP11_SQL = f"""WITH RECURSIVE z AS (SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text,
  {crc32("coalesce(CAST(conv_id AS VARCHAR), ' ') || ':' || coalesce(CAST(turn AS VARCHAR), ' ')")} % 20 AS k FROM conversations),
d AS (SELECT conv_id, turn, CASE WHEN k = 4 THEN 'user' ELSE role END AS role, CASE k WHEN 1 THEN '' WHEN 2 THEN translate(text, '.!?', '') ELSE text END AS text,
  unnest(range(CASE k WHEN 0 THEN 0 WHEN 3 THEN 2 ELSE 1 END)) AS copy FROM z),
o AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, sha256(text)) AS p, rtrim(text, {WS}) AS bare FROM d),
m AS (SELECT conv_id, turn, role, text, p, left(role, 1) AS i, bare = '' AS blank, bare <> '' AND row_number() OVER (PARTITION BY conv_id, role, text ORDER BY p) > 1 AS again,
  right(bare, 1) NOT IN ('.', '!', '?') AS mute, lag(left(role, 1)) OVER (PARTITION BY conv_id ORDER BY p) || left(role, 1) AS pair FROM o),
r AS (SELECT *, blank OR again AS gone, mute AND NOT blank AND NOT again AS cut FROM m),
g AS (SELECT conv_id, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps, count(*) FILTER (blank) AS blank, count(*) FILTER (again) AS duplicate,
  count(*) FILTER (cut) AS truncated, count(*) FILTER (pair IS NOT NULL AND pair NOT IN ('su', 'ua', 'au')) AS illegal, count(*) AS n FROM r GROUP BY 1),
i AS (SELECT * REPLACE (v.s0 AS s0), {_step('v.s0', '3', 'I', "'user:'")} AS u0, {_step('v.s1', '3', 'I', "'user:'")} AS u1,
  {_step('v.s2', '3', 'I', "'assistant:'")} AS a2, {_step('v.s3', '3', 'I', "'user:'")} AS u3
  FROM (SELECT conv_id, CAST(0 AS BIGINT) AS p, {{'k': '000000000', 't': CAST(NULL AS VARCHAR)}} AS s0, CAST(NULL AS STRUCT(k VARCHAR, t VARCHAR)) AS s1, CAST(NULL AS STRUCT(k VARCHAR, t VARCHAR)) AS s2,
    CAST(NULL AS STRUCT(k VARCHAR, t VARCHAR)) AS s3 FROM g) v
  UNION ALL SELECT *, {_step('v.s0', '3', 'I', "'user:'")}, {_step('v.s1', '3', 'I', "'user:'")}, {_step('v.s2', '3', 'I', "'assistant:'")}, {_step('v.s3', '3', 'I', "'user:'")} FROM (
  SELECT v.conv_id, r.p, {_GONE['0']} AS s0, {_least(_GONE['1'], _when("r.i = 's' AND NOT r.gone", _step('v.s0', _CUT, 'K', _KEEP)))} AS s1,
    {_least(_GONE['2'], *[x for s in ('v.s0', 'v.s1', 'v.s3', 'v.a2') for x in _to_user(s)])} AS s2,
    {_least(_GONE['3'], *[x for s in ('v.s2', 'v.u0', 'v.u1', 'v.u3') for x in _to_assistant(s)])} AS s3
  FROM i v JOIN r ON r.conv_id IS NOT DISTINCT FROM v.conv_id AND r.p = v.p + 1) v),
b AS (SELECT v.conv_id, g.* EXCLUDE (conv_id), {_least('v.s0', 'v.s3', 'v.a2', _step('v.u1', '3', 'I', "'assistant:'"))} AS best FROM i v JOIN g ON g.conv_id IS NOT DISTINCT FROM v.conv_id AND v.p = g.n),
e AS (SELECT DISTINCT conv_id FROM conversations)
SELECT e.conv_id, CAST(coalesce(gaps, 0) AS BIGINT) AS gaps, coalesce(blank, 0) AS blank, coalesce(duplicate, 0) AS duplicate, coalesce(truncated, 0) AS truncated, coalesce(illegal, 0) AS illegal,
  CAST(coalesce(left(best.k, 9), '0') AS BIGINT) AS cost, coalesce(substr(best.k, 10), '') AS audit, sha256(coalesce(best.t, '')) AS repaired_sha256
FROM e LEFT JOIN b ON b.conv_id IS NOT DISTINCT FROM e.conv_id"""

OP12_SQL = f"""WITH t AS (SELECT conv_id, coalesce(role, '') AS r, coalesce(text, '') AS t, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role NULLS FIRST, sha256(coalesce(text, ''))) AS p
  FROM conversations WHERE conv_id IS NOT NULL),
q AS (SELECT conv_id, list({{'r': r, 't': t}} ORDER BY p) AS l, {crc32("CAST(conv_id AS VARCHAR)")} % 6 AS h FROM t GROUP BY 1),
b AS (SELECT q.conv_id, list_concat(coalesce(f.l[1:q.h], []), q.l[q.h + 1:]) AS l FROM q LEFT JOIN q f ON f.conv_id = q.conv_id - q.conv_id % 100),
x AS (SELECT conv_id, len(l) AS n, d, l[1:d] AS key FROM (SELECT *, unnest(range(0, len(l) + 1)) AS d FROM b)),
v AS (SELECT key, d, min(conv_id) AS conv_id, count(*) AS n_convs, sha256(coalesce(string_agg(conv_id, ',' ORDER BY conv_id) FILTER (n = d), '')) AS ends_sha256 FROM x GROUP BY 1, 2),
c AS (SELECT key[1:d - 1] AS key, d - 1 AS d, count(*) AS n_children FROM v WHERE d > 0 GROUP BY 1, 2),
w AS (SELECT v.*, coalesce(n_children, 0) AS n_children, coalesce((n_convs - 1) * length(v.key[v.d].t), 0) AS own FROM v LEFT JOIN c ON c.key = v.key AND c.d = v.d),
s AS (SELECT u[1:k] AS key, k AS d, count(*) FILTER (n_children = 0) AS n_leaves, sum(own) AS saved_tokens FROM (SELECT key AS u, n_children, own, unnest(range(0, d + 1)) AS k FROM w) GROUP BY 1, 2)
SELECT w.conv_id, w.d AS depth, p.conv_id AS parent_conv_id, w.n_convs, w.n_children, s.n_leaves, CAST(s.saved_tokens AS BIGINT) AS saved_tokens, w.ends_sha256
FROM w JOIN s ON s.key = w.key AND s.d = w.d LEFT JOIN v p ON w.d > 0 AND p.d = w.d - 1 AND p.key = w.key[1:w.d - 1]"""

_CANON_HOST = r"regexp_replace(regexp_replace(host, ':(80|443)\z', ''), '^(www|m)\.', '')"
OP13_SQL = rf"""WITH u AS (SELECT page_id, CASE WHEN instr(url, '://') > 0 THEN substr(url, instr(url, '://') + 3) ELSE '' END AS rest FROM pages),
s AS (SELECT page_id, translate(regexp_extract(rest, '^[^/?#]*'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host, regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) AS path,
  list_sort(list_filter(string_split(regexp_extract(rest, '^[^?#]*\?([^#]*)', 1), '&'), lambda p: p <> '' AND NOT starts_with(p, 'utm_') AND split_part(p, '=', 1) NOT IN ('ref', 'fbclid', 'gclid', 'sessionid'))) AS q FROM u),
k AS (SELECT page_id, host, path, CASE WHEN host = '' THEN '' ELSE {_CANON_HOST} || regexp_replace(path, '/+\z', '') || CASE WHEN len(q) > 0 THEN '?' || array_to_string(q, '&') ELSE '' END END AS key FROM s),
l AS (SELECT DISTINCT key FROM k WHERE key <> '' AND regexp_matches(host, '(^|[.-])(casino|bets|pills|adult)([.-]|\z)')),
r(verdict, rh, rp) AS (VALUES ('allow', 'com', '/'), ('block', 'example.com', '/en/'), ('allow', 'www.example.com', '/en/'), ('block', 'net', '/es/'), ('block', 'net', '/fr/'))
SELECT page_id, host, path, w.rule AS rule, coalesce(w.verdict, CASE WHEN l.key IS NULL THEN 'allow' ELSE 'block' END) AS verdict, l.key IS NOT NULL AS listed
FROM (SELECT k.*, (SELECT max({{'n': length(rh || rp), 'rule': rh || rp, 'verdict': r.verdict}}) FROM r WHERE (host = rh OR ends_with(host, '.' || rh)) AND starts_with(path, rp)) AS w FROM k) x LEFT JOIN l USING (key)"""

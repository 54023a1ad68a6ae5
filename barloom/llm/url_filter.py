"""Verdicts on urls: host and path rules first, then a list of canonical urls behind a blocked Bloom filter.

The filter is a table of 512-bit blocks. A listed url sets one bit in each of the eight words of one block, so a page
meets a single block. Pages that meet all eight bits go to an exact join with the list, which removes false positives;
the others never leave their task. The filter never has more than ``MAX_BLOCKS`` blocks (16 MB of bits), which bounds
the broadcast. A longer list fills it more densely: more pages reach the exact join, and the result stays the same.

Defined cases: a null url, or one without ``://``, has an empty host, path and canonical form, fits no rule and is never
listed, so it is allowed. Host letters A-Z are lower-cased, others are kept. Very long urls are compared whole. Repeated
pages and null page ids keep their rows. Equal lengths cannot tie among rules of one url, as two rules that both fit and
have the same length are the same text. An empty table gives no rows, an empty list blocks nothing. Extra columns are not
read. A url that a third of all pages share is salted over ``SALTS`` keys in the exact join.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from barloom.llm.common import written

MAX_BLOCKS = 1 << 18
#: Listed urls a block holds on average: 16 bits each.
PER_BLOCK = 32
WORDS = 8
SALTS = 8

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: Query parameters that name where a visitor came from, not what the page is.
TRACKING = ("ref", "fbclid", "gclid", "sessionid")

#: (verdict, host, path); a rule fits the host and its subdomains where the path starts with the rule's.
RULES = (
    ("allow", "com", "/"),
    ("block", "example.com", "/en/"),
    ("allow", "www.example.com", "/en/"),
    ("block", "net", "/es/"),
    ("block", "net", "/fr/"),
)


def _rest(url: Column) -> Column:
    at = F.instr(url, "://")
    return F.when(at > 0, F.substring(url, at + 3, F.length(url))).otherwise("")


def host_of(url: Column) -> Column:
    return F.translate(F.regexp_extract(_rest(url), r"^[^/?#]*", 0), UPPER, LOWER)


def path_of(url: Column) -> Column:
    return F.regexp_extract(_rest(url), r"^[^/?#]*([^?#]*)", 1)


def canonical(url: Column) -> Column:
    """Host without ``www.``, ``m.`` and default port, path without end slashes, sorted query without tracking; or ''."""
    host = F.regexp_replace(F.regexp_replace(host_of(url), r":(80|443)\z", ""), r"^(www|m)\.", "")
    path = F.regexp_replace(path_of(url), r"/+\z", "")
    query = F.regexp_extract(_rest(url), r"^[^?#]*\?([^#]*)", 1)
    name = lambda p: F.split_part(p, F.lit("="), F.lit(1))
    kept = F.array_sort(F.filter(F.split(query, "&"), lambda p: (p != "") & ~name(p).startswith("utm_") & ~name(p).isin(*TRACKING)))
    tail = F.when(F.size(kept) > 0, F.concat(F.lit("?"), F.array_join(kept, "&"))).otherwise("")
    return F.when(host == "", "").otherwise(F.concat(host, path, tail))


def rule_of(host: Column, path: Column, rules=RULES) -> tuple[Column, Column]:
    """(rule text, verdict) of the longest rule that fits, both null where none does."""
    text, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for word, rule_host, rule_path in sorted(rules, key=lambda r: len(r[1] + r[2])):
        fits = ((host == rule_host) | host.endswith("." + rule_host)) & path.startswith(rule_path)
        text, verdict = F.when(fits, rule_host + rule_path).otherwise(text), F.when(fits, word).otherwise(verdict)
    return text, verdict


def _place(key: str, blocks: int) -> list[Column]:
    """Block number and one bit for each word."""
    bits = F.xxhash64(F.lit(1), key)
    word = lambda i: F.shiftrightunsigned(bits, 6 * i).bitwiseAND(F.lit(63)).cast("int")
    masks = [F.call_function("shiftleft", F.lit(1).cast("long"), word(i)).alias(f"m{i}") for i in range(WORDS)]
    return [F.pmod(F.xxhash64(key), F.lit(blocks)).cast("int").alias("block"), *masks]


def bloom(listed: DataFrame, blocks: int) -> DataFrame:
    """(block, w0..w7) of the keys in ``listed(key)``; at most ``blocks`` rows."""
    placed = listed.select(*_place("key", blocks))
    return placed.groupBy("block").agg(*[F.bit_or(f"m{i}").alias(f"w{i}") for i in range(WORDS)])


def possible(keyed: DataFrame, filter_: DataFrame, blocks: int) -> DataFrame:
    """``keyed`` with ``maybe``: false only where ``key`` is certainly not in the filter."""
    placed = keyed.select("*", *_place("key", blocks)).join(F.broadcast(filter_), "block", "left")
    hit = reduce(lambda a, b: a & b, [F.col(f"w{i}").bitwiseAND(F.col(f"m{i}")) != 0 for i in range(WORDS)])
    maybe = F.coalesce(hit & (F.col("key") != ""), F.lit(False)).alias("maybe")
    return placed.select(*keyed.columns, maybe)


def listed_keys(urls: DataFrame, url_col: str = "url") -> DataFrame:
    """Distinct canonical forms of a list of urls, written once."""
    return written(urls.select(canonical(F.col(url_col)).alias("key")).where("key <> ''").distinct())


def judge(pages: DataFrame, keys: DataFrame, rules=RULES, max_blocks: int = MAX_BLOCKS) -> DataFrame:
    """(page_id, host, path, rule, verdict, listed) of every page, for ``keys`` from ``listed_keys``."""
    blocks = min(max_blocks, max(1, -(-keys.count() // PER_BLOCK)))
    url = F.col("url")
    split = pages.select("page_id", host_of(url).alias("host"), path_of(url).alias("path"), canonical(url).alias("key"))
    seen = possible(split, bloom(keys, blocks), blocks)
    salt = F.pmod(F.xxhash64("page_id"), F.lit(SALTS)).cast("int")
    salted = keys.select("key", F.explode(F.array(*map(F.lit, range(SALTS)))).alias("salt"), F.lit(True).alias("listed"))
    hits = seen.where("maybe").withColumn("salt", salt).join(salted, ["key", "salt"], "left")
    cols = ["page_id", "host", "path", F.coalesce("listed", F.lit(False)).alias("listed")]
    both = hits.select(*cols).unionByName(seen.where("not maybe").select(*cols[:3], F.lit(False).alias("listed")))
    rule, verdict = rule_of(F.col("host"), F.col("path"), rules)
    method = F.when(F.col("listed"), "block").otherwise("allow")
    return both.select("page_id", "host", "path", rule.alias("rule"), F.coalesce(verdict, method).alias("verdict"), "listed")


#: Labels of host names that sell what no corpus wants.
SPAM = r"(^|[.-])(casino|bets|pills|adult)([.-]|\z)"


def spam_list(pages: DataFrame) -> DataFrame:
    """Canonical urls of the pages whose host carries a label of ``SPAM``."""
    return listed_keys(pages.where(host_of(F.col("url")).rlike(SPAM)))

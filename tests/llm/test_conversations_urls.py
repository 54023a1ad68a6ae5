"""Conversation repair, the prefix trie and url filters against enumeration, plain loops and their SQL."""

from __future__ import annotations

import hashlib
import itertools
import random
import re
import zlib

import duckdb
import pytest
from pyspark.sql import functions as F

from barloom.llm import repair, trie, url_filter
from barloom.llm.oracles import OP11_SQL, OP12_SQL, OP13_SQL

GOOD = re.compile(r"(s?(ua)+)?\Z")


def cheapest(rows):
    """(cost, edits) over all edit strings with at most two insertions in a place."""
    best = None

    def go(i, cost, edits, said):
        nonlocal best
        for n in range(3):
            for made in itertools.product("ua", repeat=n):
                c, e, s = cost + 3 * n, edits + "I" * n, said + "".join(made)
                if best and c > best[0]:
                    continue
                if i == len(rows):
                    if GOOD.match(s) and (best is None or (c, e) < best):
                        best = (c, e)
                    continue
                initial, gone, cut = rows[i]
                go(i + 1, c + 4, e + "D", s)
                if not gone:
                    go(i + 1, c + 3 * cut, e + "K", s + initial)
                    for role in "ua":
                        go(i + 1, c + 3 + 3 * cut, e + "R", s + role)

    go(0, 0, "", "")
    return best


def plain(rows):
    """The same by a table of whole strings."""
    paths = {0: (0, "")}
    for r in rows:
        made = {}
        for a, b, cost, letters in repair.moves(*r):
            if a in paths:
                found = (paths[a][0] + cost, paths[a][1] + letters)
                made[b] = min(found, made.get(b, found))
        paths = made
    return min((c + 3 * len(repair.TAIL[s]), e + repair.TAIL[s]) for s, (c, e) in paths.items())


def in_blocks(rows, size):
    scan, strings = repair.Blocks(), {}
    for k in range(0, len(rows), size):
        cells = []
        for entry in range(4):
            run = repair.Viterbi(entry)
            for r in rows[k : k + size]:
                run.step(repair.moves(*r))
            for leave, cost, rank, letters in run.exits():
                cells.append((entry, leave, cost, rank))
                strings[k, entry, leave] = letters
        scan.step(k, cells)
    chosen, tail, cost = scan.end()
    return cost, "".join(strings[s] for s in chosen) + tail


def test_repair_is_the_cheapest_and_least():
    rng = random.Random(4)
    for _ in range(400):
        rows = [(rng.choice("suuaaax"), rng.random() < 0.2, rng.random() < 0.2) for _ in range(rng.randint(0, 4))]
        want = cheapest(rows)
        assert plain(rows) == want
        assert in_blocks(rows, 1) == in_blocks(rows, 3) == want
    for _ in range(60):
        letters = rng.choice(["sua", "x", "uaux", "ssua", "u", "a", "s", "uax"])
        rows = [(rng.choice(letters), rng.random() < 0.1, rng.random() < 0.1) for _ in range(rng.randint(0, 150))]
        assert in_blocks(rows, 7) == in_blocks(rows, 1000) == plain(rows)


def test_survivors_coalesce():
    run = repair.Viterbi(repair.NOTHING)
    for i in range(4000):
        run.step(repair.moves("ua"[i % 2], i % 50 == 49, i % 30 == 29))
        held, stack = 0, [run.tree.root]
        while stack:
            node = stack.pop()
            held += 1
            assert node[2] == len(node[3]) + sum(leaf is node for leaf in run.tree.leaves.values())
            stack += node[3]
        assert held < 150
    assert len(run.tree.emitted) > 3900


def conversations():
    rng = random.Random(8)
    words = ["yes.", "no", "", "  ", "why?", "stop!", "é\nß.", "tell me", "\t\x0b"]
    rows = []
    for conv in [*range(0, 60), 100, 101, 199, 203, 250, -7, 5000]:
        for turn in range(rng.randint(1, 9)):
            rows.append((conv, turn * rng.choice([1, 1, 1, 2]), rng.choice(["user", "assistant", "user", "assistant", "system", "tool", "", None]), rng.choice(words + [None])))
    for conv in range(300, 360):
        rows += [(conv, t, ["user", "assistant"][t % 2], f"same {t}.") for t in range(12)]
    for conv in (400, 401):
        rows += [(conv, t, ["user", "assistant"][t % 2], f"long {t if t < 2500 else t * conv}.") for t in range(2600)]
    rows += [(7, None, "user", "first?"), (7, None, "user", "first?"), (9, 3, "user", "x" * 300_000 + "."), (11, 1, "user", "tie."), (11, 1, "assistant", "tie.")]
    rows += [(None, 0, "user", "nobody."), (None, 1, "assistant", None)]
    return [(*r, "h", 1, "p", 2) for r in rows]


SCHEMA = "conv_id long, turn long, role string, text string, h string, block long, pos string, n int"


@pytest.fixture(scope="module")
def talk(spark, tmp_path_factory):
    path = str(tmp_path_factory.mktemp("talk") / "c.parquet")
    spark.createDataFrame(conversations(), SCHEMA).repartition(3).write.parquet(path)
    return spark.read.parquet(path), path


def from_sql(sql, **paths):
    con = duckdb.connect()
    for name, path in paths.items():
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{path}/*.parquet'")
    made = con.execute(sql)
    names = [d[0] for d in made.description]
    return names, made.fetchall()


def same(df, names, want):
    assert sorted(map(repr, map(tuple, df.select(*names).collect()))) == sorted(map(repr, want))


def by_loop(rows):
    """Op11 by plain loops and the table of whole strings."""
    by = {}
    for conv, turn, role, text, *_ in rows:
        by.setdefault(conv, [])
        shown = [" " if x is None else str(x) for x in (conv, turn)]
        kind = zlib.crc32(":".join(shown).encode()) % 20
        role, text = " " if role is None else role, " " if text is None else text
        text = "" if kind == 1 else re.sub("[.!?]", "", text) if kind == 2 else text
        by[conv] += [(turn, "user" if kind == 4 else role, text)] * (0 if kind == 0 else 2 if kind == 3 else 1)
    out = []
    for conv, found in by.items():
        found.sort(key=lambda x: (x[0] is not None, x[0] or 0, x[1], hashlib.sha256(x[2].encode()).hexdigest()))
        seen, coded, counts = set(), [], [0, 0, 0, 0]
        for i, (_, role, text) in enumerate(found):
            bare = re.sub(r"[\x20\x09-\x0D]+\Z", "", text)
            fault = 0 if not bare else 1 if (role, text) in seen else 2 if bare[-1] not in ".!?" else 3
            seen.add((role, text))
            counts[fault] += 1
            coded.append((role[:1], fault < 2, fault == 2))
        bad = sum((a[1][:1] + b[1][:1]) not in ("su", "ua", "au") for a, b in zip(found, found[1:]))
        cost, edits = plain(coded)
        said, i, lines = "", 0, []
        for e in edits:
            need = "assistant" if said.endswith("u") else "user"
            role, text = (need, "") if e == "I" else found[i][1:]
            i += e != "I"
            if e == "D":
                continue
            role = role if e == "K" else need
            said += role[0]
            lines.append(f"{role}:{text}")
        turns = {x[0] for x in found} - {None}
        gaps = max(turns) - min(turns) + 1 - len(turns) if turns else 0
        out.append((conv, gaps, *counts[:3], bad, cost, edits, hashlib.sha256("\n".join(lines).encode()).hexdigest()))
    return out


NAMES = ["conv_id", "gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit", "repaired_sha256"]


def test_repair_report(spark, talk):
    df, path = talk
    want = by_loop(conversations())
    got = repair.report(df)
    assert got.where("conv_id = 400").first().cost >= 0 and df.where("conv_id = 400").count() > 2 * repair.BLOCK
    same(got, NAMES, want)
    short = spark.createDataFrame([r for r in conversations() if r[0] not in (400, 401)], SCHEMA)
    where = path + "-short"
    short.write.parquet(where)
    names, rows = from_sql(OP11_SQL, conversations=where)
    assert set(names) == set(NAMES)
    same(repair.report(short), names, rows)


def test_repaired_rows_follow_the_shape(talk):
    df, _ = talk
    rows = repair.repaired(df).orderBy("conv_id", "block", "place").collect()
    said = {}
    for r in rows:
        assert r.edit in "KRID" and (r.edit != "I" or (r.text == "" and r.turn is None))
        said.setdefault(r.conv_id, []).append("" if r.edit == "D" else r.role[0])
    assert all(GOOD.match("".join(x)) for x in said.values())
    assert sum(r.edit != "I" for r in rows) == df.count()


@pytest.mark.parametrize("chunk,size", [(32, 4096), (2, 5), (3, 40)])
def test_trie(spark, talk, chunk, size):
    df, path = talk
    if chunk < 32:
        df = df.where("conv_id NOT IN (400, 401)")
        path = f"{path}-trie-{chunk}"
        df.write.parquet(path)
    else:
        path, df = path + "-short", spark.read.parquet(path + "-short")
    names, want = from_sql(OP12_SQL, conversations=path)
    same(trie.prefix_trie(df, chunk, size), names, want)


def test_trie_of_long_conversations(talk):
    df, _ = talk
    got = {(r.conv_id, r.depth): r for r in trie.prefix_trie(df.where("conv_id IN (400, 401)"), 32, 6).collect()}
    assert got[400, 0].n_leaves == 2 and got[400, 0].n_convs == 2
    shared = [r for r in got.values() if r.n_convs == 2]
    assert len(shared) == 2501 and max(r.depth for r in shared) == 2500
    assert got[400, 0].saved_tokens == sum(len(f"long {t}.") for t in range(2500))
    assert got[400, 2500].saved_tokens == len("long 2499.") and got[400, 2500].n_children == 2
    assert got[401, 2600].parent_conv_id == 401 and got[401, 2501].parent_conv_id == 400


PAGES = [
    "http://www.Example.COM/en/1", "http://blog.example.com/en/1", "http://a.net/es/x?y#z", "http://a.net/esx", "http://net/fr/", "https://com", "https://x.com/",
    "http://a.org/p?b=2&a=1", "https://www.a.org:443/p/?a=1&utm_x=3&b=2&ref=q#top", "http://m.a.org/p?a=1", "no scheme", "", None, "x://", "://a.org/p", "http://a.org/" + "q" * 200_000,
    "http://user@a.org:80/p", "http://free-bets.org/1", "http://www.free-bets.org/1/", "http://free-bets.org/2", "http://xcom/", "http://A.org/?", "http://a.org/p?b=2&a=1", "http://www.example.com/en", "http://a.net?/es/", "http://a.org/\nq",
]


def test_url_filter(spark, tmp_path):
    rows = [(i, u, "<p>", "k", True) for i, u in enumerate(PAGES)] + [(None, PAGES[7], None, None, None), (3, PAGES[3], None, None, None)]
    path = str(tmp_path / "pages")
    spark.createDataFrame(rows, "page_id long, url string, html string, key string, listed boolean").write.parquet(path)
    df = spark.read.parquet(path)
    names, want = from_sql(OP13_SQL, pages=path)
    for blocks in (1, 1 << 18):
        same(url_filter.judge(df, url_filter.spam_list(df), max_blocks=blocks), names, want)
    listed = url_filter.listed_keys(spark.createDataFrame([(PAGES[8],), (None,), ("x",)], "url string"))
    got = {r.page_id: r for r in url_filter.judge(df, listed).collect() if r.page_id is not None}
    assert sorted(i for i, r in got.items() if r.listed) == [7, 8, 22]
    assert got[0].rule == "www.example.com/en/" and got[0].verdict == "allow" and got[1].verdict == "block" and got[4].rule == "net/fr/" and got[5].rule is None


def test_bloom_has_no_false_negatives_and_few_positives(spark):
    keys = spark.range(20_000).select(F.concat(F.lit("a.org/"), "id").alias("key"))
    blocks = 20_000 // url_filter.PER_BLOCK
    both = spark.range(40_000).select(F.concat(F.lit("a.org/"), "id").alias("key"), (F.col("id") < 20_000).alias("in"))
    got = url_filter.possible(both, url_filter.bloom(keys, blocks), blocks).groupBy("in").agg(F.avg(F.col("maybe").cast("int")).alias("m")).collect()
    rate = {r["in"]: r.m for r in got}
    assert rate[True] == 1 and rate[False] < 0.02


def test_empty_tables(spark):
    none = spark.createDataFrame([], SCHEMA)
    assert repair.report(none).count() == repair.repaired(none).count() == trie.prefix_trie(none).count() == 0
    pages = spark.createDataFrame([], "page_id long, url string")
    assert url_filter.judge(pages, url_filter.spam_list(pages)).count() == 0

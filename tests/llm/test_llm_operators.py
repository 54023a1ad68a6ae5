"""Operators against brute force on small tables with nulls, empty and long texts, ties, repeats and clashing columns."""

from __future__ import annotations

import collections
import hashlib
import random
import re
import zlib

import numpy as np
import pyarrow as pa
import pytest

from barloom.llm import common, language, mixing, neardup, orc_ids, packing, passages, pii, quality, sharding, vectors
from barloom.llm.queries import ORACLE, QUERIES, vocabulary

WORD = re.compile(r"[^\x20\x09-\x0D]+")
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, size long, row string, node long, kept boolean, words string, ids int"


def corpus():
    rng = random.Random(5)
    vocab = ["".join(rng.choice("abcdeéß") for _ in range(rng.randint(1, 7))) for _ in range(400)]
    texts = [" ".join(rng.choice(vocab) for _ in range(rng.randint(1, 300))) for _ in range(60)]
    base = texts[0].split()
    near = [" ".join(base[: i * 3] + ["new"] + base[i * 3 + 1 :]) for i in range(1, 8)]
    texts += near + [texts[1]] * 3 + [texts[1].upper(), None, "", "   ", "\n\t", "ab", "AB", "a b", "A  b", "a\nb c", "1234 !?", "word " * 30, "x" * 5000 + " y", "long " + " ".join(vocab) * 20]
    rows = [(i, t, rng.choice(["en", "fr", None]), rng.choice(["s1", "s2", "s0", None]), None, 7, "r", 3, None, "w", 1) for i, t in enumerate(texts)]
    return [*rows, rows[3], rows[3], (None, texts[2], None, None, 1, None, None, None, True, None, None)]


@pytest.fixture(scope="module")
def rows():
    return corpus()


@pytest.fixture(scope="module")
def docs(spark, rows):
    return spark.createDataFrame(rows, SCHEMA).repartition(5)


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


def test_registered():
    assert sorted(int(n[2:].split("_")[0]) for n in QUERIES) == list(range(1, 14))
    assert set(ORACLE) <= set(QUERIES)


@pytest.mark.parametrize("name", ["byte_bpe_50k.json", "word_bpe_49k.json"])
def test_encoder_is_the_library(name):
    from tokenizers import Tokenizer

    tok = Tokenizer.from_file(vocabulary(name))
    tok.encode_special_tokens = True
    encode, batched, rng = common.encoder(vocabulary(name)), common.batch_encoder(vocabulary(name), b"", 500), random.Random(3)
    letters = list("abcXYZé ß  \n\t.,'’1234!?<|>σΣ́\x1c\x85 　日本 's") + [" "] * 10
    texts = ["".join(rng.choice(letters) for _ in range(rng.randint(0, 30))) for _ in range(3000)]
    for text in [*texts, "<|endoftext|> a <|endoftext|>", "x" * 4000, " a", "a ", "don't we've"]:
        assert encode(text) == batched(text) == np.asarray(tok.encode(text, add_special_tokens=False).ids, "<u4").tobytes(), text
    flat, sizes = batched.batch(pa.chunked_array([pa.array([*texts[:400], None, ""]), pa.array(texts[400:800])]))
    assert flat.tobytes() == b"".join(map(encode, texts[:800])) and sizes.sum() == len(flat) and list(sizes[400:402]) == [0, 0]


def library_ids(name, text, end):
    from tokenizers import Tokenizer

    return [*Tokenizer.from_file(vocabulary(name)).encode(text or "", add_special_tokens=False).ids, end]


def test_packing(docs, empty, rows):
    got = packing.pack_documents(docs, vocabulary("byte_bpe_50k.json"), 0, 256).collect()
    by, bins = collections.defaultdict(list), collections.defaultdict(list)
    for x in got:
        by[x.doc_id].append(x)
        bins[x.sequence_id].append((x.offset, x.length))
    for doc, n in collections.Counter(r[0] for r in rows).items():
        ids = library_ids("byte_bpe_50k.json", next(r[1] for r in rows if r[0] == doc), 0)
        parts = sorted(by[doc], key=lambda x: x.piece)
        assert len(parts) == n * -(-len(ids) // 256)
        if n == 1:
            assert b"".join(bytes(x.ids) for x in parts) == np.array(ids, "<u4").tobytes()
            assert [x.start for x in parts] == list(np.cumsum([0] + [x.length for x in parts])[:-1])
            assert all(x.length == 256 for x in parts[1:])
    for spans in bins.values():
        assert sum(n for _, n in spans) <= 256
        assert [o for o, _ in sorted(spans)] == list(np.cumsum([0] + [n for _, n in sorted(spans)])[:-1])
    assert packing.pack_documents(empty, vocabulary("byte_bpe_50k.json"), 0, 256).count() == 0


def test_two_fit_is_near_the_bound():
    rng = np.random.default_rng(4)
    for low, high in ((1, 100), (30, 60), (34, 100)):
        counts = np.bincount(rng.integers(low, high, 5000), minlength=101)
        runs = packing.two_fit_runs(counts, 100)
        placed = np.zeros(101, int)
        used = collections.Counter()
        for size, first, n, seq, each, offset in runs.tolist():
            assert first == placed[size]
            placed[size] += n
            for i in range(n):
                used[seq + i // each] += size
        assert (placed == counts).all() and max(used.values()) <= 100
        large = sum(counts[51:])
        assert len(used) <= 1.03 * max(large, -(-int((counts * np.arange(101)).sum()) // 100)) + 1 or low == 30


def test_orc_round_trip(spark, docs, empty, rows):
    path = orc_ids.new_folder(spark)
    orc_ids.write(docs, path, vocabulary("word_bpe_49k.json"), 1)
    got = orc_ids.digest(spark, path).collect()
    want, start = [], 0
    for doc, text in sorted(((r[0], r[1]) for r in rows), key=lambda x: (x[0] is not None, x[0] or 0)):
        ids = library_ids("word_bpe_49k.json", text, 1)
        want.append((doc, start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
        start += len(ids)
    assert sorted(map(tuple, got), key=lambda x: x[1]) == want
    assert {tuple(x.ids) for x in orc_ids.lookup(spark, path, [3]).collect()} == {tuple(library_ids("word_bpe_49k.json", rows[3][1], 1))}
    assert sum(x.start for x in orc_ids.read(spark, path).collect()) == sum(w[1] for w in want)
    path = orc_ids.new_folder(spark)
    orc_ids.write(empty, path, vocabulary("word_bpe_49k.json"), 1)
    assert orc_ids.digest(spark, path).count() == 0


def lowered(text):
    return WORD.findall((text or "").translate({i: i + 32 for i in range(65, 91)}))


def shingles(text, k):
    w = lowered(text)
    return frozenset(tuple(w[i : i + k]) for i in range(max(1, len(w) - k + 1))) if w else frozenset()


class Classes:
    def __init__(self):
        self.up = {}

    def find(self, x):
        while self.up.get(x, x) != x:
            x = self.up[x]
        return x

    def join(self, a, b):
        a, b = self.find(a), self.find(b)
        self.up[max(a, b)] = min(a, b)


def test_near_duplicates(docs, empty, rows):
    sets, classes = {r[0]: shingles(r[1], 3) for r in rows if r[0] is not None}, Classes()
    for a in sets:
        for b in sets:
            both = len(sets[a] & sets[b])
            if a < b and both and 100 * both >= 85 * (len(sets[a]) + len(sets[b]) - both):
                classes.join(a, b)
    got = neardup.classes(docs, k=3, percent=85).collect()
    assert len(got) == len(rows)
    for x in got:
        if x.doc_id is None:
            assert x.component_id is None and x.kept
        else:
            assert (x.n_shingles, x.component_id) == (len(sets[x.doc_id]), classes.find(x.doc_id))
            assert x.kept == (x.doc_id == x.component_id)
    left = neardup.without_copies(docs, k=3, percent=85)
    assert left.columns == docs.columns
    assert sorted(r.doc_id for r in left.collect() if r.doc_id is not None) == sorted({classes.find(d) for d in sets})
    assert neardup.classes(empty).count() == 0


def test_near_duplicates_over_many_blocks(spark, monkeypatch):
    monkeypatch.setattr(neardup, "BLOCK_SHINGLES", 500)
    rng = random.Random(8)
    base = [f"w{i}" for i in range(60)]
    texts = []
    for _ in range(150):
        t = list(base)
        for _ in range(rng.randint(0, 5)):
            t[rng.randrange(60)] = f"v{rng.randrange(50)}"
        texts.append(" ".join(t))
    sets, classes = [shingles(t, 3) for t in texts], Classes()
    for a in range(150):
        for b in range(a):
            both = len(sets[a] & sets[b])
            if 100 * both >= 85 * (len(sets[a]) + len(sets[b]) - both):
                classes.join(a, b)
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    assert {x.doc_id: x.component_id for x in neardup.classes(df, k=3, percent=85).collect()} == {i: classes.find(i) for i in range(150)}


def test_components(spark):
    rng = random.Random(1)
    pairs = [(rng.randrange(400), rng.randrange(400)) for _ in range(300)] + [(i, i + 1) for i in range(1000, 1060)]
    classes = Classes()
    for a, b in pairs:
        classes.join(a, b)
    got = common.components(spark.createDataFrame(pairs, "a long, b long")).collect()
    assert {x.node: x.label for x in got} == {n: classes.find(n) for a, b in pairs if a != b for n in (a, b)}
    assert common.components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_vectors(spark):
    rng = np.random.default_rng(3)
    centres = rng.normal(size=(20, 3))
    vecs = [(centres[i % 20] + rng.normal(size=3) * 0.1 * (i % 4)).tolist() for i in range(400)]
    vecs += [None, [], [0.0, 0.0, 0.0], [1.0, None, 2.0], [float("nan"), 1.0, 1.0], [1.0, 1.0], [2.0, 2.0]] + vecs[:50]
    fine = [i for i, v in enumerate(vecs) if v and all(x is not None and np.isfinite(x) for x in v) and any(v)]
    links, classes = collections.Counter(), Classes()
    for a in fine:
        for b in fine:
            if a != b and len(vecs[a]) == len(vecs[b]) and np.dot(vecs[a], vecs[b]) / np.linalg.norm(vecs[a]) / np.linalg.norm(vecs[b]) >= 0.95:
                links[a] += 1
                classes.join(a, b)
    rows = [(i, v, 5) for i, v in enumerate(vecs)] + [(None, vecs[0], 1)]
    got = vectors.classes(spark.createDataFrame(rows, "vec_id long, embedding array<double>, node int")).collect()
    assert {(x.vec_id, x.n_links, x.component_id, x.kept) for x in got if x.vec_id is not None} == {(i, links[i], classes.find(i), classes.find(i) == i) for i in range(len(vecs))}
    assert vectors.classes(spark.createDataFrame([], "vec_id long, embedding array<float>")).count() == 0


def test_sharding(docs, empty, rows):
    got = sharding.shard_documents(docs, 5, fine=10).collect()
    assert len(got) == len(rows)
    slots, groups, sums = collections.defaultdict(list), collections.defaultdict(set), collections.Counter()
    texts = {r[0]: r[1] for r in rows}
    for x in got:
        slots[x.shard].append(x.slot)
        groups[texts[x.doc_id]].add(x.shard)
        sums[x.shard] += x.size
        assert x.size == len((texts[x.doc_id] or "").encode()) + 16 and x.text_crc32 == zlib.crc32((texts[x.doc_id] or "").encode())
    assert all(sorted(s) == list(range(len(s))) for s in slots.values()) and all(len(g) == 1 for g in groups.values())
    assert sharding.shard_documents(empty, 5).count() == 0
    even = [(i, "y" * (50 + i % 90)) for i in range(3000)]
    sums = collections.Counter()
    for x in sharding.shard_documents(docs.sparkSession.createDataFrame(even, "doc_id long, text string"), 8).collect():
        sums[x.shard] += x.size
    assert len(sums) == 8


def test_best_fit_decreasing():
    rng = random.Random(6)
    sizes = sorted((rng.randint(1, 100) for _ in range(500)), reverse=True)
    places, gaps = sharding.best_fit_decreasing(sizes, 100)
    left: list[int] = []
    for s in sizes:
        fits = [(g, i) for i, g in enumerate(left) if g >= s]
        if fits:
            left[min(fits)[1]] -= s
        else:
            left.append(100 - s)
    assert sorted(left) == sorted(gaps)


def counted(text):
    w = WORD.findall(text or "")
    lines = [x for x in (text or "").split("\n") if WORD.search(x)]
    grams = collections.Counter(tuple(w[i : i + 5]) for i in range(len(w) - 4))
    cover = {j for i in range(len(w) - 4) if grams[tuple(w[i : i + 5])] > 1 for j in range(i, i + 5)}
    return len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", text or "")), len(lines) - len(set(lines)), len(cover)


def test_quality_counts(spark, docs, empty, rows):
    labels = spark.createDataFrame([(3, 1, None), (3, 0, 0), (None, 1, 0), (4, None, 0)], "doc_id long, quality int, toxic int")
    texts = {r[0]: r[1] for r in rows}
    got = quality.judge(docs, labels).collect()
    assert len(got) == len(rows)
    for x in got:
        want = counted(texts[x.row.doc_id])
        assert (x.n_words, x.word_chars, x.n_symbols, x.n_dup_lines, x.n_repeat_words) == want
        assert x.base_failed == (want[0] < 10 or 100 * want[4] > 20 * want[0]) and x.kept == (not x.base_failed)
    assert quality.judge(empty, labels).count() == 0


def test_binomial_tail(spark):
    from math import comb

    cases = [(n, k) for n in (1, 5, 40, 300, 5000) for k in (0, 1, 2, 5, 24) if k <= n]
    df = spark.createDataFrame(cases, "n long, k long").withColumn("p", quality.binomial_tail("n", "k", 0.005))
    for x in df.collect():
        want = sum(comb(x.n, j) * 0.005**j * 0.995 ** (x.n - j) for j in range(x.k + 1)) if x.k <= x.n * 0.005 else 1.0
        assert x.p == pytest.approx(want, rel=1e-6)


def test_cutoffs_hold_false_rejections(spark):
    rng = random.Random(9)
    words = lambda n: " ".join(f"w{rng.randrange(10**6)}" for _ in range(n))
    rows = [(i, words(15) if i % 5 else words(12) + " ###$$$%%% ###$$$%%%", "en" if i < 6000 else "xx") for i in range(6200)]
    labels = [(i, int(i % 5 > 0)) for i in range(6200)]
    judged = quality.judge(spark.createDataFrame(rows, "doc_id long, text string, lang string"), spark.createDataFrame(labels, "doc_id long, quality int"))
    tally = collections.Counter((x.row.lang, x.row.doc_id % 5 > 0, x.kept) for x in judged.collect())
    assert tally["en", True, False] == 0 and tally["en", False, True] == 0
    assert tally["xx", False, False] == 0  # too few labels certify nothing


def luhn(digits):
    return sum(int(c) if i % 2 == 0 else int(c) * 2 - 9 * (int(c) > 4) for i, c in enumerate(reversed(digits))) % 10 == 0


PATTERNS = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+",
    "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    "card": r"[0-9]([\x20-]?[0-9])+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}


def base_spans(text):
    def fine(kind, m):
        d = re.sub("[^0-9]", "", m)
        return {"email": True, "ip": kind != "ip" or all(int(x) <= 255 for x in m.split(".")), "card": 16 <= len(d) <= 19 and luhn(d), "phone": 8 <= len(d) <= 15}[kind]

    return [(k, m.start(), m.end()) for k, p in PATTERNS.items() for m in re.finditer(p, text or "") if fine(k, m.group())]


def test_personal_data(spark, docs, empty):
    rng = random.Random(7)
    odd = ["a@b.co_x@y.com z", "1.2.3.4.5 256.1.1.1 001.002.003.0004", "4111 1111 1111 1111 4111-1111-1111-1112", "+49 (30) 123456 +1-2 é +1 (017) 555-7713", None, ""]
    odd += ["x.@@a@b.c..d@e.f", "1" * 50 + " 4111111111111111é", "日本 a@b.c 日 12 34.5.6.7", "7" * 30_000, "a." * 9_000, "1.2.3." * 3000, "a@b.c " * 500]
    odd += ["".join(rng.choice("ab@.+1234 -()é") for _ in range(60)) for _ in range(1500)]
    df = spark.createDataFrame(list(enumerate(odd)) + [(0, odd[0])], "doc_id long, text string")
    for x in pii.digest(df).collect():
        spans = base_spans(odd[x.doc_id])
        text = ",".join(f"{k}:{s}:{e}" for k, s, e in spans)
        assert x.base_sha256 == hashlib.sha256(text.encode()).hexdigest(), odd[x.doc_id]
        assert [x.n_email, x.n_ip, x.n_card, x.n_phone] == [sum(k == kind for k, _, _ in spans) for kind in PATTERNS]
        assert set(text.split(",")) - {""} <= set(x.spans.split(","))
    masked = {x.doc_id: x.text for x in pii.masked(df).collect()}
    assert masked[8] == "日本 <email> 日 12 <ip>" and masked[4] is None and masked[5] == ""
    assert pii.masked(docs).columns == docs.columns and pii.digest(empty).count() == 0


def test_mixing(docs, empty, rows):
    size = [len(WORD.findall(r[1] or "")) for r in rows]
    per = collections.Counter()
    for r, s in zip(rows, size):
        per[r[3]] += s
    names = sorted((n for n in per if n is not None)) + [None]
    weight = {n: (5, 2, 1)[i % 3] for i, n in enumerate(names)}
    target, capped = {}, set()
    while True:
        left = 1.5 * sum(per.values()) - sum(2 * per[n] for n in capped)
        free = [n for n in names if n not in capped]
        target = {n: 2.0 * per[n] if n in capped else left * weight[n] / sum(weight[m] for m in free) for n in names}
        over = {n for n in free if target[n] > 2 * per[n]}
        if not over:
            break
        capped |= over
    got = mixing.taken(docs).collect()
    assert sorted((x.size for x in got)) == sorted(size)
    took = collections.Counter()
    for x in got:
        assert x.source_size == per[x.source] and x.target == pytest.approx(target[x.source]) and x.taken <= 2 * x.size
        took[x.source] += x.taken
    assert all(abs(took[n] - target[n]) <= max(3, 0.01 * target[n]) for n in names)
    key = lambda x: (x.doc_id or -1, x.source or "", x.copies)
    assert sorted(map(key, got)) == sorted(map(key, mixing.taken(docs).collect()))
    again = mixing.repeated(docs)
    assert again.columns == docs.columns and again.count() == sum(x.copies for x in got)
    assert mixing.taken(empty).count() == 0


def test_language(spark, docs, empty):
    rng = random.Random(2)
    speech = {"aa": ["the", "then", "thing", "and", "of"], "bb": ["der", "und", "nicht", "zeit", "wenn"]}
    made = [(i, " ".join(rng.choice(speech[k]) for _ in range(20)), k) for i, k in enumerate(["aa", "bb"] * 100)]
    odd = [(900, None, "aa"), (901, "", None), (902, "123 !!", "bb"), (903, "q" * 9000, None), (None, "the and", "aa"), (1, made[1][1], "bb")]
    df = spark.createDataFrame(made + odd, "doc_id long, text string, lang string")
    got = language.identify(df, vocabulary("piece_bpe_32k.model")).collect()
    assert len(got) == 206
    truth = {i: k for i, _, k in made}
    for x in got:
        assert 0 <= x.score <= 1 and x.held_out == (x.doc_id is not None and zlib.crc32(str(x.doc_id).encode()) % 4 == 2)
        assert x.lang_pred == ("und" if x.doc_id in (900, 901, 902) else truth.get(x.doc_id, x.lang_pred))
    unlabelled = language.identify(df.withColumn("lang", common.F.lit(None).cast("string")), vocabulary("piece_bpe_32k.model"))
    assert {(x.lang_pred, x.score) for x in unlabelled.collect()} == {("und", 0.0)}
    assert language.identify(empty, vocabulary("piece_bpe_32k.model")).count() == 0


def test_forward_sums_all_segmentations():
    pieces = ["a", "ab", "b", "ba", "abab"]
    prob = np.array([[0.2], [0.3], [0.1], [0.15], [0.05], [language.UNKNOWN], [0.0]])

    def total(word):
        return 1.0 if not word else sum(prob[i][0] * total(word[len(p) :]) for i, p in enumerate(pieces) if word.startswith(p)) + (language.UNKNOWN * total(word[1:]) if word[0] not in "ab" else 0)

    lattice = language.Lattice(pieces)
    for word in ("a", "abab", "babab", "axb"):
        assert lattice.scores([word], len(word), prob)[0, 0] == pytest.approx(np.log(total(word)))
    uses = lattice.expected(["abab"], np.array([2.0]), 4, prob[:, 0])
    assert (uses[:5] * [1, 2, 1, 2, 4]).sum() == pytest.approx(8.0)


def test_passages(spark, empty):
    rng = random.Random(2)
    words = lambda n: [f"w{rng.randrange(100000)}" for _ in range(n)]
    p, q = words(60), words(80)
    fuzzy = list(q)
    fuzzy[20] = "zz"
    del fuzzy[50]
    fuzzy.insert(65, "yy")
    texts = [words(100) + p + words(50), words(30) + p, words(200), words(20) + q + words(10), fuzzy + words(100), words(40) + p + words(3) + fuzzy, words(45) + p[:30] + words(30), words(20) + q[:30]]
    rows = [(i, "  ".join(t).upper() if i == 1 else " ".join(t)) for i, t in enumerate(texts)]
    rows += [(8, rows[2][1]), (100, None), (101, ""), (None, rows[0][1]), (102, "z " * 30_000)]
    got = {(x.doc_id, x.start_word, x.end_word, x.first_doc_id) for x in passages.repeated(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == {(0, 100, 160, 0), (1, 30, 90, 0), (2, 0, 200, 2), (8, 0, 200, 2), (3, 20, 100, 3), (4, 0, 80, 3), (5, 40, 100, 0), (5, 103, 183, 3)}
    assert passages.repeated(empty).count() == 0


def test_passages_around_unlike_text(spark):
    rng = random.Random(12)
    words = lambda n: [f"w{rng.randrange(100000)}" for _ in range(n)]
    head, foot, p, q = words(60), words(60), words(60), words(60)
    texts = [head + words(80) + foot, head + words(80) + foot, words(30) + p + q, p + words(120) + q + words(9)]
    got = {(x.doc_id, x.start_word, x.end_word, x.first_doc_id) for x in passages.repeated(spark.createDataFrame([(i, " ".join(t)) for i, t in enumerate(texts)], "doc_id long, text string")).collect()}
    assert got == {(0, 0, 60, 0), (0, 140, 200, 0), (1, 0, 60, 0), (1, 140, 200, 0), (2, 30, 90, 2), (2, 90, 150, 2), (3, 0, 60, 2), (3, 180, 240, 2)}


def test_passages_of_other_holders(spark):
    rng = random.Random(31)
    words = lambda n: [f"w{rng.randrange(100000)}" for _ in range(n)]
    p, q, r = words(60), words(60), words(60)
    texts = [words(30) + p[:45] + words(9), words(40) + p + words(20), words(10) + p + words(20)]
    texts += [words(30) + q[:30] + words(9), words(30) + q[30:] + words(9), words(40) + q + words(20), words(10) + q + words(20)]
    texts += [words(20) + r + words(70) + r + words(10), words(10) + r]
    got = {(x.doc_id, x.start_word, x.end_word, x.first_doc_id) for x in passages.repeated(spark.createDataFrame([(i, " ".join(t)) for i, t in enumerate(texts)], "doc_id long, text string")).collect()}
    assert got == {(1, 40, 100, 1), (2, 10, 70, 1), (5, 40, 100, 5), (6, 10, 70, 5), (7, 20, 80, 7), (7, 150, 210, 7), (8, 10, 70, 7)}


def test_fuzzy_passages(spark):
    rng = random.Random(21)
    words = lambda n: [f"w{rng.randrange(100000)}" for _ in range(n)]
    rows, want = [], {}
    for i in range(60):
        n, agree = (60, 200)[i % 2], (82, 85, 90)[i % 3]
        p = words(n)
        bad = range(7, n, 8) if i < 10 else rng.sample(range(1, n - 1), n * (100 - agree) // 100)
        rows += [(2 * i, " ".join(words(60) + p + words(60))), (2 * i + 1, " ".join(words(50) + [f"z{i}x{j}" if j in bad else w for j, w in enumerate(p)] + words(70)))]
        want[2 * i + 1] = (50, 50 + n)
    got = collections.defaultdict(int)
    for x in passages.repeated(spark.createDataFrame(rows, "doc_id long, text string")).collect():
        if x.doc_id in want:
            s, e = want[x.doc_id]
            assert x.start_word >= s and x.end_word <= e
            got[x.doc_id] += x.n_words
    assert all(got[2 * i + 1] >= 0.9 * (60, 200)[i % 2] for i in range(10) if i % 2)
    assert sum(got.values()) >= 0.9 * sum(e - s for s, e in want.values())


def test_stretches_match_all_pairs():
    rng = random.Random(4)
    for _ in range(100):
        f, beside, at = [], [(np.empty(0, np.uint64),) * 2], [0, 0]
        for i in range(rng.randint(1, 9)):
            gap = [np.array([rng.randrange(10**9) for _ in range(rng.randint(0, 20))], np.uint64) for _ in at] if i else beside[0]
            beside += [tuple(gap)] if i else []
            n = rng.randint(4, 40)
            at = [at[0] + len(gap[0]), at[1] + len(gap[1])]
            f.append([at[0], at[0] + n, at[1]])
            at = [at[0] + n, at[1] + n]
        beside.append(beside[0])
        good = set()
        for i in range(len(f)):
            for j in range(i, len(f)):
                s, e, a, z = f[i][0], f[j][1], f[i][2], f[j][2] + f[j][1] - f[j][0]
                same = sum(x[1] - x[0] for x in f[i : j + 1])
                if min(e - s, z - a) >= 50 and 100 * same >= 80 * max(e - s, z - a):
                    good.add((s, e, a, z))
        want = {x for x in good if not any(y != x and y[0] <= x[0] and x[1] <= y[1] for y in good)}
        assert set(passages.stretches(np.array(f), beside, 50, 80)) == want


def test_texts_hashed_together_have_the_seeds_of_each_alone():
    rng = random.Random(8)
    texts = ["", "a", "a b c", "a b c d", "a b c d e", "z " * 500, "x y " * 300] + [" ".join(rng.choice("abcd") for _ in range(rng.randint(0, 40))) for _ in range(300)]
    raws = [t.encode() for t in texts]
    text, h, pos, first = passages.text_seeds(raws, 4, 3)
    at = 0
    for i, raw in enumerate(raws):
        alone = passages.text_seeds([raw], 4, 3)
        n = len(alone[0])
        assert (text[at : at + n] == i).all() and all((x[at : at + n] == y).all() for x, y in zip((h, pos, first), alone[1:]))
        kmers = common.windows_hash(common.word_hashes(texts[i]), 4)
        want = {int(a + kmers[a : a + 3].argmin()) for a in range(max(len(kmers) - 2, 1))} if len(kmers) else set()
        assert set(alone[2].tolist()) == want
        at += n
    assert at == len(text)


def test_shared_seeds_travel_in_few_rows(spark, monkeypatch):
    rng = random.Random(17)
    texts = [" ".join(rng.choice("abcdefgh") for _ in range(rng.randint(0, 60))) for _ in range(400)] + ["z " * 300] * 2
    docs = [rng.randrange(-5, 10**6) for _ in texts]
    docs[7] = docs[6]
    each = [(d, *row) for d, t in zip(docs, texts) for row in zip(*(x.tolist() for x in passages.placed_seeds([t.encode()], 4, 3)[1:]))]
    of = collections.defaultdict(list)
    for d, h, at in each:
        of[h].append((d, at))
    signed = lambda h: h - (1 << 64) * (h >> 63)
    want = sorted((d, signed(h), at, *min(of[h])) for d, h, at in each if len({x for x, _ in of[h]}) > 1)
    frame = spark.createDataFrame(list(zip(docs, texts)), "doc long, text string").repartition(2)
    assert passages.seeds(frame, 4, 3, 64).count() <= 2 * 64 < len(each) / 20
    assert sorted(map(tuple, passages.shared_seeds(frame, 4, 3).collect())) == want
    # A bucket that is too large for memory waits in a file; rows of a bucket come in several parts.
    monkeypatch.setattr(passages, "ROW_SEEDS", 50)
    doc, h, pos = (np.array(x, t) for x, t in zip(zip(*each), (np.int64, np.uint64, np.int32)))
    dealt = [b for i in range(0, len(h), 999) for b in passages.dealt_seeds(doc[i : i + 999], h[i : i + 999], pos[i : i + 999], 3)]
    whole = pa.Table.from_batches(dealt).sort_by("bucket")
    for held in (1 << 21, 700, 1):
        monkeypatch.setattr(passages, "HELD", held)
        assert sorted(tuple(r.values()) for b in passages.find_shared(whole.to_batches(max_chunksize=7)) for r in b.to_pylist()) == want


def test_runs_and_documents_come_together_in_tasks(monkeypatch):
    rng = random.Random(6)
    for held in (1, 6, 10**6):
        monkeypatch.setattr(passages, "WHOLE_ROWS", held)
        for _ in range(60):
            rows = sorted(((rng.randrange(8), rng.randrange(300)) for _ in range(rng.randint(0, 60))), key=lambda x: x[0])
            batches = pa.table({"doc": pa.array([x for x, _ in rows], pa.int64()), "pos": pa.array([x for _, x in rows], pa.int32())}).to_batches(max_chunksize=rng.randint(1, 9))
            parts = list(passages.whole_documents(batches, ("doc", "pos")))
            assert [tuple(x) for part in parts for x in zip(*(c.tolist() for c in part))] == rows
            assert sum(len(set(part[0].tolist())) for part in parts) == len({d for d, _ in rows})
            want = []
            for doc in {d for d, _ in rows}:
                runs = []
                for at in sorted(p for d, p in rows if d == doc):
                    if runs and at - runs[-1][1] <= 7:
                        runs[-1][1] = at
                    else:
                        runs.append([at, at])
                want += [(doc, max(a - 7, 0), z + 11) for a, z in runs if z + 11 - max(a - 7, 0) >= 20]
            assert sorted(tuple(x.values()) for b in passages.find_runs(7, 4, 20)(batches) for x in b.to_pylist()) == sorted(want)
    for n in (1, 2, 3, 50):
        words = [np.array([rng.randrange(2) for _ in range(rng.randint(0, 120))], np.uint64) for _ in range(9)]
        doc, h, place = passages.hashed_runs(list(range(9)), [10 * i for i in range(9)], words, n)
        alone = [passages.periodic_rank(common.windows_hash(w, n), passages.FLANK) for w in words]
        assert list(zip(doc.tolist(), place.tolist())) == [(i, 10 * i + j) for i, x in enumerate(alone) for j in range(len(x))]
        pairs = set(zip(h.tolist(), np.concatenate(alone).tolist()))
        assert len(pairs) == len({x for x, _ in pairs}) == len({y for _, y in pairs})


def test_common_words_match_the_table():
    rng = random.Random(9)
    for _ in range(300):
        a, b = ([rng.randrange(rng.choice((3, 20))) for _ in range(rng.randint(0, 30))] for _ in range(2))
        table = [[0] * (len(b) + 1)]
        for x in a:
            table.append([0])
            for j, y in enumerate(b):
                table[-1].append(max(table[-2][j + 1], table[-1][j], table[-2][j] + (x == y)))
        assert passages.common_words(a, b) == table[-1][-1]


def test_an_edit_next_to_an_end_of_a_short_passage():
    none, of = np.empty(0, np.uint64), lambda *x: np.array(x, np.uint64)
    f = np.array([[10, 58, 20]])
    assert passages.stretches(f, [(none, none), (of(1, 2, 3, 4), of(9, 2, 8, 7))], 50, 80) == [(10, 60, 20, 70)]
    assert passages.stretches(f, [(of(5, 2, 3), of(6, 2, 7)), (none, none)], 50, 80) == [(8, 58, 18, 68)]
    assert passages.stretches(f, [(none, none), (of(1, 2, 3, 4), of(9, 8, 7, 6))], 50, 80) == []


def test_fenwick_chains_match_all_pairs():
    rng = random.Random(4)
    for _ in range(50):
        frags = np.array([(s, s + rng.randint(8, 20), rng.randint(0, 300)) for s in (rng.randint(0, 300) for _ in range(25))])
        frags = frags[np.lexsort((frags[:, 2], frags[:, 0]))]
        n, score = len(frags), [0.0] * len(frags)
        for i in range(n):
            s, e, o = frags[i]
            best = max([0.0] + [score[j] - passages.GAP_COST * (s - frags[j][1] + o - frags[j][2] - frags[j][1] + frags[j][0]) for j in range(i) if frags[j][1] <= s and frags[j][2] + frags[j][1] - frags[j][0] <= o])
            score[i] = e - s + best
        top = passages.chains(frags)[0]
        gaps = sum((b[0] - a[1]) + (b[2] - a[2] - a[1] + a[0]) for a, b in zip(top, top[1:]))
        assert sum(f[1] - f[0] for f in top) - passages.GAP_COST * gaps == pytest.approx(max(score))


def test_pipeline(spark, sf):
    import corpus_pipeline
    from barloom.llm.common import table, written

    docs = table(spark, sf, "documents")
    names = docs.columns
    for name, stage in corpus_pipeline.STAGES:
        out = written(stage(spark, docs, sf))
        if name != "packing":
            assert out.columns == names
        if name in ("quality_rules", "near_duplicates"):
            assert 0 < out.count() <= docs.count()
        if name == "personal_data":
            assert out.count() == docs.count() and not any(base_spans(r.text) for r in out.collect())
        docs = out
    assert docs.agg({"length": "max"}).first()[0] <= 2048

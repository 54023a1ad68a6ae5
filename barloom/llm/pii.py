"""Personal data by weak supervision, in DataFrame functions alone.

Four kinds of base spans (email, ip, card, phone) are found by fixed patterns and checks and always stay. Wider patterns
add candidates: written-out emails and national phone numbers. Five labelers vote on every candidate: its format, its
checksum or range, a gazetteer of endings and prefixes, cue words before it, and its borders. Expectation-maximisation
over the counts of vote patterns (a bounded table) estimates each labeler's reliability by kind and the share of true
spans; a logistic span classifier is fitted to those soft labels, and candidates it scores at ``threshold`` or more are
added unless they overlap a span of their kind. The classifier is a bounded lookup of vote patterns, so scoring needs no join.

Null texts are empty and have no spans. Ties and repeated rows are judged alike, and so are different texts of one id,
row by row. Very long texts and texts of very many spans take time in proportion to their length (times its logarithm):
patterns are possessive, ends and overlaps are array scans, and masked texts are joined from pieces. An empty table gives
an empty result and no model. Input columns travel in a struct, so names cannot clash.
"""

from __future__ import annotations

import itertools
import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from barloom.llm.common import written

KINDS = ("email", "ip", "card", "phone")
#: Base patterns. Possessive repeats and the borders only keep the matcher from trying again; the matches are the same.
BASE = {
    "email": r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    "card": r"[0-9](?:[\x20-]?[0-9])++",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
WIDE = {
    "email": r"(?<![A-Za-z0-9._%+-])[A-Za-z0-9._%+-]{1,64}+\x20?[\[(]at[\])]\x20?[A-Za-z0-9-]++(?:(?:\.|\x20?[\[(]dot[\])]\x20?)[A-Za-z0-9-]++)++",
    "phone": r"(?<![0-9+.-])\(?[0-9]{3}\)?[\x20.-][0-9]{3}[\x20.-][0-9]{4}(?![0-9])",
}
MAY = {"email": r"@|[\[(]at[\])]", "ip": r"[0-9]\.[0-9]", "card": r"[0-9][\x20-]?[0-9]", "phone": r"\+[0-9]|[0-9]{3}\)?[\x20.-][0-9]{3}"}
STRICT = {
    "email": r"^[A-Za-z0-9][A-Za-z0-9._%+-]*+@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++(?<=\.[A-Za-z]{2,63})$|[\[(]at[\])].*[\[(]dot[\])]",
    "ip": r"^[0-9]{1,3}(\.[0-9]{1,3}){3}$",
    "card": r"^[0-9]{4}([\x20-]?[0-9]{4}){3}$",
    "phone": r"^(\+[0-9]{1,3}[\x20.-]?)?\(?[0-9]{2,4}\)?([\x20.-][0-9]{2,4}){2,3}$",
}
GAZETTEER = {
    "email": r"(?i)(\.|dot[\])]\x20?)(com|org|net|edu|gov|info|io|de|fr|es|uk|eu)$",
    "ip": r"^(10|127|172|192|8|1)\.",
    "card": r"^(4|5[1-5]|2[2-7]|3[47]|6011|65)",
    "phone": r"^\+?(1|33|34|44|49)[\x20(]|\(?[2-9][0-9]{2}\)?[\x20.-]",
}
CUES = {
    "email": r"(?i)(mail|contact|write|reach)",
    "ip": r"(?i)(\bip\b|host|server|address|login)",
    "card": r"(?i)(card|visa|master|account|pay)",
    "phone": r"(?i)(tel|phone|call|mobile|fax)",
}
LABELERS = 5
SPAN = "array<struct<s: int, e: int, base: boolean, votes: string>>"


def valid(kind: str, m: Column) -> Column:
    """The base check of a match."""
    if kind == "ip":
        bare = lambda p: F.regexp_replace(p, "^0+", "")
        number = lambda p: F.concat(F.lit("0"), F.substring(bare(p), 1, 3)).cast("int")
        return F.forall(F.split(m, r"\."), lambda p: (F.length(bare(p)) <= 3) & (number(p) <= 255))
    digits = F.regexp_replace(m, "[^0-9]", "")
    if kind == "card":
        return F.length(digits).between(16, 19) & F.call_function("luhn_check", digits)
    if kind == "phone":
        return F.length(digits).between(8, 15)
    return F.lit(True)


def let(value: Column, use) -> Column:
    """``use`` of a value that is computed once, however often a lambda inside reads it."""
    return F.transform(F.array(value), use)[0]


def scan(values: Column, op, zero) -> Column:
    """Running ``op`` of an array, in as many passes as its length has binary digits."""
    steps = F.filter(F.transform(F.sequence(F.lit(0), F.lit(30)), lambda i: F.call_function("shiftleft", F.lit(1), i)), lambda k: k < F.size(values))
    shifted = lambda a, k: F.concat(F.array_repeat(F.lit(zero), k), F.slice(a, 1, F.size(a) - k))
    return F.aggregate(steps, values, lambda a, k: F.zip_with(a, shifted(a, k), lambda x, y: op(x, y)))


def _votes(kind: str, m: Column, before: Column, after: Column, ok: Column) -> Column:
    """One letter a labeler: y, n or - (abstains). A failed check digit says little, as numbers are often mistyped."""
    said = lambda yes, no: F.when(yes, "y").when(no, "n").otherwise("-")
    inside = F.substring(before, -1, 1).rlike(r"[\p{L}\p{N}]") | F.substring(after, 1, 1).rlike(r"[\p{L}\p{N}]")
    strict = m.rlike(STRICT[kind])
    return F.concat(
        said(strict, ~strict), said(ok, F.lit(False) if kind == "card" else ~ok), said(m.rlike(GAZETTEER[kind]), F.lit(False)), said(before.rlike(CUES[kind]), F.lit(False)), said(~inside, inside)
    )


def _spans(kind: str, matches: Column, pieces: Column, base: bool) -> Column:
    """Matches with their code-point spans; a base match is a span of its own only if it passes its check.

    ``pieces`` are the texts between the matches. Ends are running sums of both lengths, and a match's neighbourhood is
    read from the pieces next to it, so no step goes back to the start of the text.
    """
    def placed(v):
        steps = F.transform(v["m"], lambda m, i: F.length(m) + F.length(F.get(v["p"], i)))
        return let(F.struct(v["m"].alias("m"), v["p"].alias("p"), let(steps, lambda n: scan(n, lambda x, y: x + y, 0)).alias("e")), spanned)

    def spanned(v):
        near = lambda name, i: F.coalesce(F.get(v[name], i), F.lit(""))

        def span(m, i):
            end = F.get(v["e"], i)
            before = F.concat(*[near(n, i - k) for k in (3, 2, 1) for n in "pm"], near("p", i))
            after = F.concat(near("p", i + 1), near("m", i + 1))
            ok = valid(kind, m)
            votes = _votes(kind, m, F.substring(before, -24, 24), after, ok)
            return F.struct((end - F.length(m)).alias("s"), end.alias("e"), (ok if base else F.lit(False)).alias("base"), votes.alias("votes"))

        return F.transform(v["m"], span)

    return let(F.struct(matches.alias("m"), pieces.alias("p")), placed)


def candidates(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """(row, email, ip, card, phone): each kind's candidate spans with votes; ``row`` holds the input."""
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"))
    rows = rows.withColumn("text", F.coalesce(F.col(f"row.{text_col}").cast("string"), F.lit("")))
    found, spans = [], {}
    for kind in KINDS:
        for name, patterns, base in ((f"{kind}_b", BASE, True), (f"{kind}_w", WIDE, False)):
            if kind in patterns:
                may = F.col("text").rlike(MAY[kind])
                empty = F.array().cast("array<string>")
                found.append(F.when(may, F.regexp_extract_all("text", F.lit(patterns[kind]), F.lit(0))).otherwise(empty).alias(f"{name}m"))
                found.append(F.when(may, F.split("text", patterns[kind], -1)).otherwise(empty).alias(f"{name}p"))
                one = _spans(kind, F.col(f"{name}m"), F.col(f"{name}p"), base)
                spans.setdefault(kind, []).append(F.when(F.size(f"{name}m") > 0, one).otherwise(F.array().cast(SPAN)))
    cut = rows.select("row", "text", *found)
    return cut.select("row", *[(F.concat(*s) if len(s) > 1 else s[0]).alias(k) for k, s in spans.items()])


def fit(found: DataFrame, rounds: int = 50) -> dict[str, float]:
    """Score of each "kind votes" pattern: Dawid-Skene EM over pattern counts, then a logistic classifier on its labels."""
    parts = F.concat(*[_named(k) for k in KINDS])
    counts = {r["p"]: r["n"] for r in found.select(F.explode(parts).alias("p")).groupBy("p").agg(F.count(F.lit(1)).alias("n")).collect()}  # at most 4 * 3 ** 5 rows
    scores = {}
    for kind in KINDS:
        mine = {p.split(" ")[1]: n for p, n in counts.items() if p.startswith(kind + " ")}
        if mine:
            scores |= {f"{kind} {v}": s for v, s in _classifier(mine, _expectation(mine, rounds)).items()}
    return scores


def _named(kind: str) -> Column:
    return F.transform(kind, lambda x: F.concat(F.lit(kind + " "), x["votes"]))


def _expectation(counts: dict[str, int], rounds: int) -> dict[str, float]:
    """Posterior of each vote pattern; it starts from the majority and each labeler's table is smoothed by one."""
    post = {v: (1 + v.count("y")) / (2 + v.count("y") + v.count("n")) for v in counts}
    for _ in range(rounds):
        true = sum(n * post[v] for v, n in counts.items())
        total = sum(counts.values())
        share = (true + 1) / (total + 2)
        table = {}
        for i, c in itertools.product(range(LABELERS), "yn-"):
            hit = sum(n * post[v] for v, n in counts.items() if v[i] == c)
            miss = sum(n * (1 - post[v]) for v, n in counts.items() if v[i] == c)
            table[i, c] = math.log((hit + (2 if c == "y" else 1)) / (true + 4)) - math.log((miss + (2 if c == "n" else 1)) / (total - true + 4))
        for v in counts:
            z = math.log(share / (1 - share)) + sum(table[i, c] for i, c in enumerate(v))
            post[v] = 1 / (1 + math.exp(-max(-30.0, min(30.0, z))))
    return post


def _classifier(counts: dict[str, int], soft: dict[str, float], steps: int = 300) -> dict[str, float]:
    """Logistic regression on the votes as features, by gradient steps over the patterns; returns each pattern's score."""
    code = {"y": 1.0, "n": -1.0, "-": 0.0}
    total = sum(counts.values())
    w = [0.0] * (LABELERS + 1)
    feats = {v: [1.0, *(code[c] for c in v)] for v in counts}
    score = lambda x: 1 / (1 + math.exp(-max(-30.0, min(30.0, sum(a * b for a, b in zip(w, x))))))
    for _ in range(steps):
        grad = [0.001 * a for a in w]
        for v, n in counts.items():
            off = (score(feats[v]) - soft[v]) * n / total
            grad = [g + off * x for g, x in zip(grad, feats[v])]
        w = [a - 2.0 * g for a, g in zip(w, grad)]
    return {v: score(feats[v]) for v in counts}


def detect(docs: DataFrame, text_col: str = "text", threshold: float = 0.9, thin: list[str] | None = None) -> DataFrame:
    """(row, email, ip, card, phone): the spans (s, e, base) of each kind in order, base ones and added ones."""
    found = candidates(docs, text_col)
    if thin:
        found = found.withColumn("row", F.struct(*[F.col(f"row.{c}").alias(c) for c in thin]))
    found = written(found)
    chosen = [p for p, s in fit(found).items() if s >= threshold]
    good = F.array(*[F.lit(p) for p in chosen]) if chosen else F.array().cast("array<string>")

    def kept(kind):
        more = lambda x: ~x["base"] & F.array_contains(good, F.concat(F.lit(kind + " "), x["votes"]))
        every = F.array_sort(F.transform(F.filter(kind, lambda x: x["base"] | more(x)), lambda x: F.struct(x["s"].alias("s"), x["e"].alias("e"), x["base"].alias("base"))))
        return F.when(F.size(kind) > 0, let(every, alone)).otherwise(every)

    def alone(every):
        """Base spans, and added ones that neither an earlier base span reaches nor a later one starts in."""
        ends = scan(F.transform(every, lambda x: F.when(x["base"], x["e"]).otherwise(0)), F.greatest, 0)
        far = (1 << 31) - 1
        starts = F.reverse(scan(F.reverse(F.transform(every, lambda x: F.when(x["base"], x["s"]).otherwise(far))), F.least, far))
        return let(F.struct(every.alias("x"), ends.alias("e"), starts.alias("s")), lambda v: F.filter(
            v["x"], lambda x, i: x["base"] | ((F.get(v["e"], i) <= x["s"]) & (F.get(v["s"], i) >= x["e"]))))

    return found.select("row", *[kept(k).alias(k) for k in KINDS])


def listed(base_only: bool) -> Column:
    """kind:start:end by kind, then start, comma-joined."""
    def one(kind):
        spans = F.filter(kind, lambda x: x["base"]) if base_only else F.col(kind)
        return F.transform(spans, lambda x: F.concat_ws(":", F.lit(kind), x["s"].cast("string"), x["e"].cast("string")))

    return F.array_join(F.concat(*[one(k) for k in KINDS]), ",")


def digest(docs: DataFrame) -> DataFrame:
    spans = detect(docs, thin=["doc_id"])
    counts = [F.size(F.filter(k, lambda x: x["base"])).cast("long").alias(f"n_{k}") for k in KINDS]
    return spans.select("row.doc_id", *counts, F.sha2(listed(True).cast("binary"), 256).alias("base_sha256"), listed(False).alias("spans"))


#: Code points of a piece of text from which spans are cut.
PIECE = 1024


def masked(docs: DataFrame, text_col: str = "text", length_col: str | None = None) -> DataFrame:
    """``docs`` with every span replaced by its kind in angle brackets; overlapping spans become one, named by the first."""
    spans = detect(docs, text_col)
    every = F.array_sort(F.concat(*[_tagged(k) for k in KINDS]))
    text = F.col(f"row.{text_col}")

    def cut(parts, a, b):
        """Code points a to b, from the pieces that hold them."""
        few = F.slice(parts, F.floor(a / PIECE).cast("int") + 1, (F.floor((b - 1) / PIECE) - F.floor(a / PIECE)).cast("int") + 1)
        return F.when(b > a, F.substring(F.array_join(few, ""), a % PIECE + 1, b - a)).otherwise("")

    def joined(v):
        before = lambda i: F.coalesce(F.get(v["e"], i - 1), F.lit(0))
        named = lambda x, i: F.concat(cut(v["t"], before(i), x["s"]), F.lit("<"), x["kind"], F.lit(">"))
        heads = F.transform(v["x"], lambda x, i: F.when(x["s"] >= before(i), named(x, i)).otherwise(""))
        return F.concat(F.array_join(heads, ""), cut(v["t"], F.element_at(v["e"], -1), v["n"]))

    reach = let(F.transform("every", lambda x: x["e"]), lambda e: scan(e, F.greatest, 0))
    parts = F.regexp_extract_all(text, F.lit(f"(?s).{{1,{PIECE}}}"), F.lit(0))
    clean = let(F.struct(F.col("every").alias("x"), reach.alias("e"), parts.alias("t"), F.length(text).alias("n")), joined)
    made = spans.withColumn("every", every).withColumn("clean", F.when(F.size("every") > 0, clean).otherwise(text))
    new = {text_col: F.col("clean")} | ({length_col: F.when(F.col("clean").isNotNull() & (F.size("every") > 0), F.length("clean").cast("long")).otherwise(F.col(f"row.{length_col}"))} if length_col else {})
    return made.select(*[(new[c] if c in new else F.col(f"row.`{c}`")).alias(c) for c in docs.columns])


def _tagged(kind: str) -> Column:
    return F.transform(kind, lambda x: F.struct(x["s"].alias("s"), x["e"].alias("e"), F.lit(kind).alias("kind")))

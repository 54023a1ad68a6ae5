"""Quality rules with risk-controlled cutoffs, in DataFrame functions alone.

Every document gets counts of its words, symbols, repeated lines and repeated 5-word windows. Each rule is a share of
the text (symbols, marks, repeated lines, repeated words); a document is rejected where a share is over its stratum's
cutoff. A cutoff is certified on the labelled holdout of its stratum: among good documents that pass the base rules, the
exact binomial tail at the observed false rejections must be at most ``delta`` over the number of (stratum, rule) pairs
for a true rate of ``alpha`` over the number of rules. Cutoffs of one rule are tried from the mildest on and testing
stops at the first failure (fixed sequence), so the grid needs no further correction. Of the certified cutoffs the one
with the most rejected bad documents is taken, at ``good_cost`` times the share of rejected good ones; ties take the
mildest. A stratum with too few labels certifies nothing and only the base rules act there.

Null and empty texts have no words and fail the base rules. Null strata form a stratum of their own. Of several labels
of one document the lowest quality counts; null labels are ignored. An empty table gives an empty result, and without
labels nothing is certified. Repeated rows are judged alike. Input columns travel in a struct, so names cannot clash.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from barloom.llm.common import written
from barloom.session import broadcast_if_small

WORD = r"[^\x20\x09-\x0D]+"
RULES = ("symbols", "marks", "lines", "repeats")
#: Cutoffs tried, mildest first: a share over the cutoff rejects.
GRID = tuple(round(1.0 - 0.02 * i, 2) for i in range(50))


def features(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """(row, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, n_lines, n_marks); ``row`` holds the input."""
    text = F.coalesce(F.col(f"row.{text_col}").cast("string"), F.lit(""))
    base = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row")).select(
        "row",
        F.regexp_extract_all(text, F.lit(WORD), F.lit(0)).alias("words"),
        F.filter(F.split(text, "\n"), lambda x: x.rlike(WORD)).alias("lines"),
        F.length(F.regexp_replace(text, r"[^#*$%&|<>]+", "")).cast("long").alias("n_symbols"),
        F.length(F.regexp_replace(text, r"[^!?]+", "")).cast("long").alias("n_marks"),
    )
    keyed = base.select(
        "row", "n_symbols", "n_marks",
        F.size("words").cast("long").alias("n_words"),
        F.length(F.array_join("words", "")).cast("long").alias("word_chars"),
        F.size("lines").cast("long").alias("n_lines"),
        (F.size("lines") - F.size(F.array_distinct("lines"))).cast("long").alias("n_dup_lines"),
        F.expr("CASE WHEN size(words) >= 6 THEN transform(sequence(1, size(words) - 4), i -> xxhash64(slice(words, i, 5))) ELSE array() END").alias("windows"),
    )
    # Only texts with a repeated window sort theirs.
    sorted_ = keyed.withColumn(
        "sorted",
        F.expr("CASE WHEN size(array_distinct(windows)) < size(windows) THEN array_sort(transform(windows, (h, i) -> struct(h AS h, i AS i))) ELSE array() END"),
    ).drop("windows")
    placed = sorted_.withColumn(
        "places",
        F.expr("""array_sort(transform(filter(sorted, (p, j) ->
            coalesce(get(sorted, j - 1).h = p.h, false) OR coalesce(get(sorted, j + 1).h = p.h, false)), p -> p.i))"""),
    ).drop("sorted")
    covered = F.expr("aggregate(transform(places, (p, j) -> least(5, coalesce(get(places, j + 1) - p, 5))), 0L, (s, x) -> s + x)")
    return placed.withColumn("n_repeat_words", covered).drop("places")


def base_failed() -> Column:
    return (F.col("n_words") < 10) | (100 * F.col("n_repeat_words") > 20 * F.col("n_words"))


def shares() -> dict[str, Column]:
    part = lambda a, b: F.coalesce(F.try_divide(F.col(a).cast("double"), F.col(b)), F.lit(0.0))
    return {
        "symbols": part("n_symbols", "word_chars"),
        "marks": part("n_marks", "n_words"),
        "lines": part("n_dup_lines", "n_lines"),
        "repeats": part("n_repeat_words", "n_words"),
    }


def _log_gamma(x: str) -> str:
    """Stirling's series at x + 9, carried back to x."""
    y = f"({x} + 9)"
    series = f"1 / (12 * {y}) - 1 / (360 * pow({y}, 3)) + 1 / (1260 * pow({y}, 5))"
    back = " + ".join(f"ln({x} + {i})" for i in range(9))
    return f"(({y} - 0.5) * ln({y}) - {y} + 0.9189385332046727 + {series} - ({back}))"


def binomial_tail(n: str, k: str, rate: float) -> Column:
    """P(Binomial(n, rate) <= k) for k under the mean, 1 above it. After 20,000 terms a geometric series bounds the rest."""
    top = f"({_log_gamma(f'({n} + 1)')} - {_log_gamma(f'({k} + 1)')} - {_log_gamma(f'({n} - {k} + 1)')} + {k} * ln({rate}D) + ({n} - {k}) * ln(1 - {rate}D))"
    ratio = f"({k} - i + 1) / ({n} - {k} + i) * {(1 - rate) / rate}D"
    total = f"""aggregate(sequence(1L, least({k}, 20000L)), named_struct('t', 1D, 's', 1D),
        (a, i) -> named_struct('t', a.t * ({ratio}), 's', a.s + a.t * ({ratio})),
        a -> a.s + CASE WHEN {k} > 20000 THEN a.t / greatest(1e-9D, 1 - ({k} - 20000D) / ({n} - {k} + 20001D) * {(1 - rate) / rate}D) ELSE 0D END)"""
    return F.expr(f"CASE WHEN {k} > {n} * {rate}D THEN 1D WHEN {k} = 0 THEN exp({n} * ln(1 - {rate}D)) ELSE least(1D, exp({top}) * {total}) END")


def certified_cutoffs(
    scored: DataFrame, labels: DataFrame, strata: Column, alpha: float = 0.02, delta: float = 0.05, good_cost: float = 10.0, id_col: str = "doc_id"
) -> DataFrame:
    """(stratum, cutoffs map rule -> cutoff) from a written table of features."""
    known = labels.where("quality IS NOT NULL AND doc_id IS NOT NULL").groupBy("doc_id").agg(F.min("quality").alias("quality"))
    passed = lambda share: F.size(F.filter(F.array(*[F.lit(g) for g in GRID]), lambda g: share <= g))
    levels = F.array(*[F.struct(F.lit(r).alias("rule"), passed(s).alias("clear")) for r, s in shares().items()])
    held = (
        scored.where(~base_failed())
        .select(F.col(f"row.{id_col}").alias("doc_id"), strata.alias("stratum"), levels.alias("levels"))
        .join(known, "doc_id")
        .select("stratum", F.explode("levels").alias("l"), "quality")
        .groupBy("stratum", F.col("l.rule").alias("rule"), F.col("l.clear").alias("clear"))
        .agg(F.count_if(F.col("quality") == 1).alias("good"), F.count_if(F.col("quality") == 0).alias("bad"))
    )
    # A document passes the first ``clear`` cutoffs, so it is rejected at cutoff number j (from 0) when clear <= j.
    grid = F.posexplode(F.array(*[F.lit(g) for g in GRID])).alias("j", "cutoff")
    totals = held.groupBy("stratum", "rule").agg(F.sum("good").alias("n"), F.sum("bad").alias("n_bad"), F.collect_list(F.struct("clear", "good", "bad")).alias("by"))
    over = "aggregate(filter(by, x -> x.clear <= j), 0L, (s, x) -> s + x.{0})"
    tried = totals.select("stratum", "rule", "n", "n_bad", "by", grid).select(
        "stratum", "rule", "j", "cutoff", "n", "n_bad", F.expr(over.format("good")).alias("k"), F.expr(over.format("bad")).alias("hit")
    )
    pairs = Window.partitionBy(F.lit(0))  # (stratum, rule, cutoff) rows: strata times rules times the grid
    level = delta / F.size(F.collect_set(F.struct("stratum", "rule")).over(pairs))
    tested = tried.withColumn("level", level).withColumn("ok", (F.col("n") > 0) & (binomial_tail("n", "k", alpha / len(RULES)) <= F.col("level")))
    held_so_far = Window.partitionBy("stratum", "rule").orderBy("j").rowsBetween(Window.unboundedPreceding, 0)
    gain = F.coalesce(F.try_divide(F.col("hit"), F.col("n_bad")), F.lit(0.0)) - good_cost * F.col("k") / F.col("n")
    return (
        tested.withColumn("ok", F.min("ok").over(held_so_far)).where("ok")
        .groupBy("stratum", "rule").agg(F.max_by("cutoff", F.struct(gain.alias("g"), (-F.col("j")).alias("j"))).alias("cutoff"))
        .groupBy("stratum").agg(F.map_from_entries(F.collect_list(F.struct("rule", "cutoff"))).alias("cutoffs"))
    )


def judge(docs: DataFrame, labels: DataFrame, stratum_col: str = "lang", text_col: str = "text", thin: list[str] | None = None, **risk) -> DataFrame:
    """Features of every row of ``docs`` with base_failed and kept; ``row`` holds the input (or its ``thin`` columns)."""
    scored = features(docs, text_col)
    stratum = F.coalesce(F.col(f"row.{stratum_col}").cast("string"), F.lit("-"))
    scored = scored.withColumn("stratum", stratum)
    if thin:
        scored = scored.withColumn("row", F.struct(*[F.col(f"row.{c}").alias(c) for c in thin]))
    scored = written(scored)
    cutoffs = written(certified_cutoffs(scored, labels, F.col("stratum"), **risk))
    joined = scored.join(broadcast_if_small(cutoffs, 10_000), "stratum", "left")
    over = [F.coalesce(s > F.col("cutoffs")[r], F.lit(False)) for r, s in shares().items()]
    rejected = over[0] | over[1] | over[2] | over[3]
    return joined.withColumn("base_failed", base_failed()).withColumn("kept", ~base_failed() & ~rejected).drop("cutoffs")

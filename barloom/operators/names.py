"""Expression names as data: parsing, canonical forms, blocking rules, families, neighbours.

Everything is columns and joins over a table of names, so a list of millions
of candidates is checked in one job.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from barloom.session import broadcast_if_small, cut_lineage

# Fixed values of the naming rules.
DEAD_DEPTH, DEAD_MOM_PCT, DEAD_DIP_PCT, DEAD_DIP_LOOKBACKS = 5, 14, 5, (18, 24)
MAX_ATOMS, LOOKBACK_CAP, MIN_MOVES, FAMILY_TOL = 7, 96, 500, 0.20
WORDS = ("wt_cross_up_os", "wt_below_os", "wt_cross_down_ob", "sma_stack")
STRUCTURES = ("don_hi", "don_lo", "near_swing_hi", "near_swing_lo", "dbl_bot", "dbl_top")

#: Numbers of an atom; the digit of h1 and h4 belongs to the word.
NUMBER = r"(?<![h0-9])[0-9]+"


def _shapes() -> dict[str, tuple]:
    """Shape of an atom (# for a number) -> family, what goes before its parameters, which numbers those are, and which are the bounds."""
    out = {}
    for gt in (">", ">_"):
        out[f"rsi_#_{gt}#"] = ("rsi", "", (0,), 1, None)
        for lt in ("<", "<_"):
            out[f"rsi_#_{gt}#_{lt}#"] = ("rsi", "", (0,), 1, 2)
            out[f"rsi_#_{lt}#"] = ("rsi", "", (0,), None, 1)
    out["rsi_#_#"] = ("rsi", "", (0,), 1, None)
    for move in ("mom", "dip"):
        for way in ("gt", "lt"):
            out[f"{move}_#b_{way}#pc"] = (move, "", (0,), 1, None)
    means = [f"{kind}_abv" for kind in ("sma", "ema")]
    for word in [*means, *[f"{frame}_{m}" for frame in ("h1", "h4") for m in means], *STRUCTURES]:
        out[f"{word}_#"] = (word, "", (0,), None, None)
    for side in ("lower", "upper"):
        out[f"bb_{side}_#_#"] = ("bb", f"{side}_", (0, 1), None, None)
    out["vol_lowsm_#_#"] = ("vol_lowsm", "", (0, 1), None, None)
    for word in WORDS:
        out[word] = (word, "", (), None, None)
    return out


def atoms(name: Column | str) -> Column:
    """Trimmed non-empty atoms of a stack."""
    return F.filter(F.transform(F.split(name, "&"), lambda a: F.trim(a)), lambda a: a != "")


def parsed(a: Column) -> Column:
    """struct(family, params, lo, hi) of an atom, null when unknown: its shape is looked up, its numbers are placed."""
    numbers = F.regexp_extract_all(a, F.lit(NUMBER), F.lit(0))
    shape = F.regexp_replace(a, NUMBER, "#")
    kind = "struct<family: string, before: string, params: array<int>, lo: int, hi: int>"
    row = lambda v: F.struct(F.lit(v[0]), F.lit(v[1]), F.array(*[F.lit(i) for i in v[2]]), F.lit(v[3]), F.lit(v[4])).cast(kind)
    known = F.try_element_at(F.create_map(*[x for k, v in _shapes().items() for x in (F.lit(k), row(v))]), shape)
    number = lambda i: F.get(numbers, i)
    params = F.concat(known["before"], F.array_join(F.transform(known["params"], number), "_"))
    made = F.struct(known["family"].alias("family"), params.alias("params"), number(known["lo"]).cast("double").alias("lo"), number(known["hi"]).cast("double").alias("hi"))
    none = F.lit(None).cast("double")
    stack = F.struct(F.substring(a, 1, 9).alias("family"), F.substring(a, 11, 1_000).alias("params"), none.alias("lo"), none.alias("hi"))
    return F.when(known.isNotNull(), made).when(a.rlike(r"^[se]ma_stack_[0-9_]+$"), stack)


def atom_rows(names: DataFrame) -> DataFrame:
    """(name, pos, atom, family, params, lo, hi, op) for every atom of every name."""
    rows = names.select("name", F.posexplode(atoms("name")).alias("pos", "atom")).withColumn("p", parsed(F.col("atom")))
    op = (
        F.when(F.col("lo").isNotNull() & F.col("hi").isNotNull(), "band")
        .when(F.col("lo").isNotNull(), "gt")
        .when(F.col("hi").isNotNull(), "lt")
        .when(F.col("family").endswith("_abv"), "abv")
        .when(F.col("family").isNotNull(), "eq")
    )
    return rows.select("name", "pos", "atom", "p.*").withColumn("op", op)


def family_key(a: Column) -> Column:
    """Family and parameters without the threshold."""
    p = parsed(a)
    return F.concat_ws("|", p["family"], p["params"])


def _groups(rows: DataFrame) -> DataFrame:
    g = Window.partitionBy("name", "family", "params")
    return (
        rows.where("family IS NOT NULL")
        .withColumn("low_edge", F.max("lo").over(g))
        .withColumn("high_edge", F.min("hi").over(g))
        .withColumn("n_lo", F.count_if(F.col("lo") == F.col("low_edge")).over(g))
        .withColumn("n_hi", F.count_if(F.col("hi") == F.col("high_edge")).over(g))
        .withColumn("n", F.count(F.lit(1)).over(g))
    )


def bound_reasons(rows: DataFrame) -> DataFrame:
    """First same-family bound problem per name: an empty band or a redundant threshold."""
    g = _groups(rows)
    holds_lo = F.coalesce((F.col("lo") == F.col("low_edge")) & (F.col("n_lo") == 1), F.lit(False))
    holds_hi = F.coalesce((F.col("hi") == F.col("high_edge")) & (F.col("n_hi") == 1), F.lit(False))
    spare = (F.col("n") > 1) & ~holds_lo & ~holds_hi
    per = g.withColumn("_spare", spare).groupBy("name", "family", "params").agg(
        F.min("pos").alias("pos"), F.max("low_edge").alias("lo"), F.min("high_edge").alias("hi"), F.bool_or("_spare").alias("spare")
    )
    reason = F.when(F.col("lo") >= F.col("hi"), "empty_band").when(F.col("spare"), "redundant_threshold")
    return per.withColumn("reason", reason).where("reason IS NOT NULL").groupBy("name").agg(F.min_by("reason", "pos").alias("bound_reason"))


def static_cap(lookback: Column) -> Column:
    """Largest plausible move in percent when no history tells."""
    n = F.greatest(F.lit(1), lookback.cast("int"))
    far = F.greatest(F.lit(14), F.least(F.ceil(2.0 * F.sqrt(n) / 2.0) * 2, F.lit(40)))
    return F.when(n <= 6, 4).when(n <= 12, 6).when(n <= 36, 8).when(n <= 48, 10).when(n <= 96, 14).otherwise(far).cast("double")


def move_caps(bars: DataFrame, lookbacks: list[int]) -> DataFrame:
    """99th percentile of absolute k-bar moves in percent, the larger over symbols."""
    w = Window.partitionBy("symbol").orderBy("day")
    wide = bars.select("symbol", *[(F.abs(F.col("c") / F.lag("c", k).over(w) - 1) * 100).alias(f"m{k}") for k in lookbacks])
    cells = ", ".join(f"{k}, m{k}" for k in lookbacks)
    long = wide.selectExpr("symbol", f"stack({len(lookbacks)}, {cells}) AS (lookback, move)")
    per = long.groupBy("symbol", "lookback").agg(
        F.expr("percentile(move, 0.99)").alias("p"), F.count("move").alias("n")
    )
    return per.groupBy("lookback").agg(F.max(F.when(F.col("n") >= MIN_MOVES, F.col("p"))).alias("cap"))


def unreachable(rows: DataFrame, caps: DataFrame) -> DataFrame:
    """Names asking for a move beyond the observed cap."""
    moves = rows.where(F.col("family").isin("mom", "dip")).withColumn("lookback", F.col("params").cast("int"))
    limit = F.coalesce(F.col("cap"), static_cap(F.col("lookback")))
    return (
        moves.join(broadcast_if_small(caps), "lookback", "left")
        .where(F.col("lo") > limit)
        .select("name").distinct()
        .withColumn("reach_reason", F.lit("unreachable_threshold"))
    )


def dead_zone(rows: DataFrame) -> DataFrame:
    """Zones that never trade: too deep, too far, or a filler atom beside a higher average."""
    htf = F.col("family").rlike("^h[14]_.*_abv$")
    filler = F.col("family").isin("sma_abv", "ema_abv") | ((F.col("family") == "rsi") & F.col("lo").isNotNull())
    pct, look = F.col("lo"), F.col("params").cast("int")
    dead = F.when((F.col("family") == "mom") & (pct >= DEAD_MOM_PCT), "dead_mom_threshold").when(
        (F.col("family") == "dip") & look.isin(*DEAD_DIP_LOOKBACKS) & (pct >= DEAD_DIP_PCT), "dead_dip"
    )
    agg = rows.withColumn("_dead", dead).groupBy("name").agg(
        F.count(F.lit(1)).alias("n"),
        F.min_by("_dead", F.when(F.col("_dead").isNotNull(), F.col("pos"))).alias("_dead"),
        F.bool_or(F.coalesce(htf, F.lit(False))).alias("_h"),
        F.bool_or(F.coalesce(filler, F.lit(False))).alias("_f"),
    )
    reason = F.when(F.col("n") >= DEAD_DEPTH, "dead_depth").when(F.col("_dead").isNotNull(), F.col("_dead")).when(
        F.col("_h") & F.col("_f"), "filler_atom"
    )
    return agg.select("name", reason.alias("zone_reason")).where("zone_reason IS NOT NULL")


def canonical_names(names: DataFrame) -> DataFrame:
    """(name, canonical): one strictest atom per family and parameters, sorted."""
    rows = atom_rows(names)
    g = _groups(rows)
    lo, hi = F.col("lo"), F.col("hi")
    has = F.col("low_edge").isNotNull() | F.col("high_edge").isNotNull()
    pick = lambda cond: F.min_by("atom", F.when(cond, F.col("pos")))
    per = g.groupBy("name", "family", "params").agg(
        F.min_by("atom", "pos").alias("first"),
        F.bool_or(has).alias("bound"),
        pick(lo.eqNullSafe(F.col("low_edge")) & hi.eqNullSafe(F.col("high_edge"))).alias("exact"),
        pick((lo == F.col("low_edge")) & hi.isNull()).alias("only_lo"),
        pick((hi == F.col("high_edge")) & lo.isNull()).alias("only_hi"),
        F.max("low_edge").alias("lo"),
        F.min("high_edge").alias("hi"),
    )
    as_int = lambda c: F.format_string("%d", F.col(c).cast("long"))
    word = F.when(F.col("family") == "mom", "gt").otherwise("lt")
    made_lo = F.when(F.col("family") == "rsi", F.concat(F.lit("rsi_"), "params", F.lit("_>"), as_int("lo"))).otherwise(
        F.concat("family", F.lit("_"), "params", F.lit("b_"), word, as_int("lo"), F.lit("pc"))
    )
    made_hi = F.concat(F.lit("rsi_"), "params", F.lit("_<"), as_int("hi"))
    strict = F.when(~F.col("bound"), F.array("first")).when(F.col("exact").isNotNull(), F.array("exact")).otherwise(
        F.array_compact(F.array(
            F.when(F.col("lo").isNotNull(), F.coalesce("only_lo", made_lo)),
            F.when(F.col("hi").isNotNull(), F.coalesce("only_hi", made_hi)),
        ))
    )
    known = per.select("name", F.explode(strict).alias("atom"))
    unknown = rows.where("family IS NULL").select("name", "atom")
    return known.unionByName(unknown).groupBy("name").agg(
        F.array_join(F.array_sort(F.collect_list("atom")), "&").alias("canonical")
    )


def block_reasons(names: DataFrame, caps: DataFrame, tested: DataFrame | None = None) -> DataFrame:
    """(name, reason): the first rule that blocks each distinct name, null when none does."""
    names = names.select("name").distinct()
    rows = atom_rows(names)
    out = names
    for part in (dead_zone(rows), bound_reasons(rows), unreachable(rows, caps)):
        out = out.join(part, "name", "left")
    order = ["zone_reason", "bound_reason", "reach_reason"]
    if tested is not None:
        keys = canonical_names(tested.select("name").distinct()).select("canonical").distinct()
        hit = canonical_names(names).join(keys, "canonical", "left_semi")
        out = out.join(hit.select("name", F.lit("canonical_tested").alias("tested_reason")), "name", "left")
        order.append("tested_reason")
    return out.select("name", F.coalesce(*order).alias("reason"))


def count_blocks(names: DataFrame, caps: DataFrame, tested: DataFrame) -> DataFrame:
    fresh = names.select("name").distinct().join(tested.select("name"), "name", "left_anti")
    return block_reasons(fresh, caps, tested).where("reason IS NOT NULL").groupBy("reason").agg(F.count(F.lit(1)).alias("names"))


# --- shape tests ----------------------------------------------------------------

def has_momentum_and_dip(name: Column) -> Column:
    a = atoms(name)
    mom = F.exists(a, lambda x: x.rlike(r"^mom_.*_gt"))
    dip = F.exists(a, lambda x: x.rlike(r"^dip_\d+b?_lt_?\d+(pc)?$"))
    return mom & dip


def is_parseable(name: Column) -> Column:
    a = atoms(name)
    return (F.size(a) >= 1) & (F.size(a) <= MAX_ATOMS) & F.forall(a, lambda x: parsed(x).isNotNull())


def structure_lookbacks(name: Column) -> Column:
    return F.regexp_extract_all(name, F.lit(rf"(?:^|&)\s*({'|'.join(STRUCTURES)})_(\d+)\s*(?=&|$)"), F.lit(2)).cast("array<int>")


def lookback_too_expensive(name: Column, cap: int = LOOKBACK_CAP) -> Column:
    worst = F.array_max(structure_lookbacks(name))
    return F.when(worst > cap, F.format_string(f"lookback_too_expensive %d>{cap}", worst))


def normalize_symbol(raw: Column) -> Column:
    return F.upper(F.trim(F.regexp_replace(raw, r"[-_]", "/")))


def rounded_period(n: Column) -> Column:
    """Nearest 5 under 40, nearest 10 from there, small ones 5 or 10."""
    return (
        F.when(n < 8, 5).when(n < 10, 10).when(n < 40, (F.bround(n / 5.0) * 5).cast("int")).otherwise((F.bround(n / 10.0) * 10).cast("int"))
    )


def near_duplicate_key(name: Column) -> Column:
    """Stack with its moving-average periods rounded, atoms sorted."""
    def soft(a: Column) -> Column:
        ma = a.rlike(r"^(h[14]_)?(sma|ema)(_abv|_stack)_[\d_]+$")
        head = F.regexp_extract(a, r"^(.*?_(?:abv|stack))_", 1)
        tail = F.transform(F.split(F.regexp_extract(a, r"_(?:abv|stack)_([\d_]+)$", 1), "_"), lambda x: rounded_period(x.try_cast("int")).cast("string"))
        return F.when(ma, F.concat_ws("_", head, F.array_join(tail, "_"))).otherwise(a)

    return F.array_join(F.array_sort(F.transform(atoms(name), soft)), "&")


# --- families -------------------------------------------------------------------

TOKEN = r"([<>]?\d+(?:pc)?)"


def family_signature(names: DataFrame) -> DataFrame:
    """(name, template, exact, loose): numbers out of the template; thresholds must match exactly."""
    head = lambda a: F.regexp_extract(a, r"^(h\d+_)", 1)
    rest = lambda a: F.substring(a, F.length(head(a)) + 1, F.length(a))
    ordered = F.array_sort(atoms("name"))
    template = F.array_join(F.transform(ordered, lambda a: F.concat(head(a), F.regexp_replace(rest(a), r"\d+", "N"))), "&")
    tokens = F.flatten(F.transform(ordered, lambda a: F.regexp_extract_all(rest(a), F.lit(TOKEN), F.lit(1))))
    is_exact = lambda t: t.rlike(r"^[<>]|pc$")
    number = lambda t: F.regexp_extract(t, r"(\d+)", 1).cast("int")
    return names.select("*", template.alias("template"), tokens.alias("_t")).select(
        *names.columns, "template",
        F.array_join(F.transform(F.filter("_t", is_exact), lambda t: number(t).cast("string")), ",").alias("exact"),
        F.transform(F.filter("_t", lambda t: ~is_exact(t)), number).alias("loose"),
    )


def family_pairs(names: DataFrame, tol: float = FAMILY_TOL) -> DataFrame:
    """(a, b) with a < b in one family: same template, equal thresholds, lookbacks within ``tol``.

    Two values within ``tol`` fall in the same or neighbouring steps of a log
    scale, so the join key holds the step of the sum of lookbacks (sums of
    values within a ratio stay within it) and only near names ever meet.
    """
    sig = family_signature(names.select("name").distinct())
    total = F.aggregate("loose", F.lit(0), lambda acc, x: acc + x)
    step = F.floor(F.log(F.greatest(total, F.lit(1)).cast("double")) / F.log(F.lit(1 / (1 - tol))))
    keyed = sig.withColumn("step", step)
    left = keyed.withColumn("step", F.explode(F.array(F.col("step") - 1, F.col("step"), F.col("step") + 1)))
    a, b = left.alias("a"), keyed.alias("b")
    close = F.forall(
        F.zip_with("a.loose", "b.loose", lambda x, y: (F.greatest(x, y) == 0) | (F.abs(x - y) <= tol * F.greatest(x, y))), lambda ok: ok
    )
    same = [F.col(f"a.{k}") == F.col(f"b.{k}") for k in ("template", "exact", "step")]
    return (
        a.join(b, reduce(lambda x, y: x & y, same))
        .where((F.col("a.name") < F.col("b.name")) & (F.size("a.loose") == F.size("b.loose")) & close)
        .select(F.col("a.name").alias("a"), F.col("b.name").alias("b"))
    )


def plan_families(ranked: DataFrame) -> DataFrame:
    """(name, winner): the best of each family, and the winner every other name points to.

    ``ranked`` has name and a unique rank (1 is best). Greedy in rank order:
    a name wins when no better winner is its family. Each round settles every
    name that has no undecided better neighbour, so rounds grow with chains of
    neighbours and not with names; state is a written table between rounds.
    """
    pairs = family_pairs(ranked)
    both = pairs.unionByName(pairs.select(F.col("b").alias("a"), F.col("a").alias("b")))
    r = ranked.select("name", "rank")
    edges = cut_lineage(
        both.join(r.withColumnsRenamed({"name": "a", "rank": "rank_a"}), "a")
        .join(r.withColumnsRenamed({"name": "b", "rank": "rank_b"}), "b")
        .where("rank_b < rank_a")
        .select("a", "b", "rank_b")
    )
    state = cut_lineage(r.select("name", F.lit(None).cast("string").alias("winner")))
    while True:  # the best open name settles in every round
        known = state.select(F.col("name").alias("b"), F.col("winner").alias("b_winner"))
        open_ = state.where("winner IS NULL").select(F.col("name").alias("a"))
        if open_.isEmpty():
            return state
        seen = edges.join(open_, "a", "left_semi").join(known, "b")
        verdict = seen.groupBy("a").agg(
            F.min_by("b", F.when(F.col("b_winner") == F.col("b"), F.col("rank_b"))).alias("first_winner"),
            F.min(F.when(F.col("b_winner") == F.col("b"), F.col("rank_b"))).alias("win_rank"),
            F.min(F.when(F.col("b_winner").isNull(), F.col("rank_b"))).alias("open_rank"),
        )
        settled = open_.join(verdict, "a", "left").select(
            F.col("a").alias("name"),
            F.when(F.col("open_rank").isNull() & F.col("win_rank").isNull(), F.col("a"))
            .when(F.coalesce(F.col("win_rank") < F.coalesce("open_rank", F.lit(2**62)), F.lit(False)), F.col("first_winner"))
            .alias("winner"),
        )
        state = cut_lineage(state.where("winner IS NOT NULL").unionByName(settled))


# --- neighbours -----------------------------------------------------------------

STEPS = (0.10, 0.20)
# How a number of each kind moves: rounding step, floor, ceiling. Periods round to usual periods from 5 on.
GRIDS = {"lookback": (6, 6, 2**31), "percent": (2, 2, 40), "level": (5, 5, 95), "reach": (6, 6, 96)}


def _kinds() -> dict[str, tuple]:
    """Shape of an atom -> the kind of each of its numbers."""
    out = {}
    for shape, (family, *_) in _shapes().items():
        if family in ("mom", "dip"):
            out[shape] = ("lookback", "percent")
        elif family.endswith("_abv"):
            out[shape] = ("period",)
        elif family == "rsi":
            bounds = shape.split("_")[2:]
            out[shape] = ("period", *["level" if x[0] in "<>" and x.endswith("#") and len(x) > 1 else "fixed" for x in bounds if "#" in x])
        elif family in STRUCTURES and family != "dbl_top":
            out[shape] = ("reach",)
    return out


def _moved(value: Column, kind: Column, by: float) -> Column:
    """The number moved by a share of itself, null where its kind does not allow that."""
    raw = value * (1.0 + by)
    period = F.bround(raw).cast("int")
    out = F.when((kind == "period") & (period >= 5), rounded_period(period))
    for name, (step, low, high) in GRIDS.items():
        n = (F.bround(raw / step) * step).cast("int")
        out = out.when((kind == name) & n.between(low, high), n)
    return out


def neighbour_names(names: DataFrame, caps: DataFrame) -> DataFrame:
    """(name, neighbour): one number of one atom moved by 10 or 20 percent and rounded.

    Numbers of stacks move one period at a time; results that a rule blocks
    are dropped.
    """
    rows = names.select("name").distinct().select("name", atoms("name").alias("_all"), F.posexplode(atoms("name")).alias("pos", "atom"))
    numbers = F.transform(F.regexp_extract_all("atom", F.lit(NUMBER), F.lit(0)), lambda x: x.cast("int"))
    between = F.split("atom", NUMBER, -1)
    kinds = F.create_map(*[x for k, v in _kinds().items() for x in (F.lit(k), F.array(*[F.lit(y) for y in v]))])
    stack = F.when(F.col("atom").rlike(r"^(sma|ema)_stack_[0-9_]+$"), F.transform("numbers", lambda _: F.lit("period")))
    rows = rows.withColumn("numbers", numbers).withColumn("between", between)
    rows = rows.withColumn("kinds", F.coalesce(F.try_element_at(kinds, F.regexp_replace("atom", NUMBER, "#")), stack))

    def swaps(value: Column, at: Column) -> Column:
        def swap(by):
            new = _moved(value, F.get("kinds", at), by)
            texts = F.transform("numbers", lambda x, i: F.when(i == at, new).otherwise(x).cast("string"))
            pieces = F.zip_with("between", texts, lambda gap, n: F.concat(gap, F.coalesce(n, F.lit(""))))
            return F.when(new != value, F.array_join(pieces, ""))

        return F.array(*[swap(sign * step) for step in STEPS for sign in (-1.0, 1.0)])

    every = F.array_distinct(F.array_compact(F.flatten(F.transform("numbers", swaps))))
    rows = rows.where("kinds IS NOT NULL")
    made = rows.withColumn("swap", F.explode(every)).select(
        F.col("name").alias("parent"),
        F.array_join(F.transform("_all", lambda a, i: F.when(i == F.col("pos"), F.col("swap")).otherwise(a)), "&").alias("name"),
    ).where("name <> parent").distinct()
    fine = made.where(~has_momentum_and_dip(F.col("name")) & lookback_too_expensive(F.col("name")).isNull() & is_parseable(F.col("name")))
    blocked = block_reasons(fine, caps).where("reason IS NOT NULL")
    return fine.join(blocked, "name", "left_anti").select(F.col("parent").alias("name"), F.col("name").alias("neighbour"))


def atom_stacks(rows: DataFrame, tests: list[str]) -> DataFrame:
    """Every stack of one atom per test, from the distinct atoms that pass each test.

    The combinations are the feature, so the rows grow as the product of the
    atom lists; the lists themselves are one row of arrays.
    """
    pools = rows.agg(*[F.array_sort(F.collect_set(F.when(F.expr(t), F.col("atom")))).alias(f"p{k}") for k, t in enumerate(tests)])
    out = pools
    for k in range(len(tests)):
        out = out.withColumn(f"a{k}", F.explode(f"p{k}"))
    cols = F.array(*[F.col(f"a{k}") for k in range(len(tests))])
    return out.select(F.array_join(F.array_sort(F.array_distinct(cols)), "&").alias("name")).distinct()


def untested(universe: DataFrame, blocked: DataFrame, caps: DataFrame) -> DataFrame:
    """Universe names that are not blocked, not near a blocked name, and pass the rules.

    Of near-duplicates among the rest the first by ``ord`` stays.
    """
    fresh = universe.join(blocked.select("name"), "name", "left_anti")
    bad = block_reasons(fresh, caps).where("reason IS NOT NULL")
    keyed = fresh.join(bad, "name", "left_anti").withColumn("key", near_duplicate_key(F.col("name")))
    taken = blocked.select(near_duplicate_key(F.col("name")).alias("key")).distinct()
    left = keyed.join(taken, "key", "left_anti")
    return left.groupBy("key").agg(F.min_by("name", "ord").alias("name"), F.min("ord").alias("ord")).select("name", "ord")

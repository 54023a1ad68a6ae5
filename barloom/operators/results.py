"""Analytics over evaluation results: newest rows, gate counts, atom effects, lifts."""

from __future__ import annotations

import math
import sys

import pandas as pd
from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame, Observation, Window
from pyspark.sql import functions as F

from barloom.operators import names as N
from barloom.session import broadcast_if_small, cut_lineage

cloudpickle.register_pickle_by_value(sys.modules[__name__])

# Fixed values.
BASE_GATES = ("trades", "profit", "sharpe", "baseline", "windows")
ROBUST_GATES = ("holdout", "dsr", "pbo", "perturb", "cost")
MIN_SUPPORT, PRIOR, RIDGE, EXPLORE_SHARE = 5, 5.0, 25.0, 0.25
BURNED_MIN_TESTED = 30


# --- newest rows and counts -----------------------------------------------------

def latest_per_name(log: DataFrame, at: tuple[str, ...] = ("tested_at", "seq")) -> DataFrame:
    """Newest row of every name, by a partial aggregate."""
    rest = [c for c in log.columns if c != "name"]
    best = log.groupBy("name").agg(F.max_by(F.struct(*rest), F.struct(*at)).alias("r"))
    return best.select("name", "r.*").select(*log.columns)


def result_counts(log: DataFrame) -> DataFrame:
    """Unique names, passing and failing by their newest row."""
    return latest_per_name(log).agg(
        F.count(F.lit(1)).alias("unique_names"), F.count_if("qualified").alias("passed"), F.count_if(~F.col("qualified")).alias("failed")
    )


def on_day(log: DataFrame, day: str) -> DataFrame:
    return log.where(F.to_date("tested_at") == F.lit(day).cast("date"))


def tested_names(log: DataFrame) -> DataFrame:
    return log.select("name").distinct()


def failed_names(log: DataFrame) -> DataFrame:
    return log.where(~F.col("qualified")).select("name").distinct()


def trial_census(log: DataFrame) -> DataFrame:
    """Trials, parked names and the spread of Sharpe over newest rows."""
    ran = ~F.col("ops_park")
    return latest_per_name(log).agg(
        F.count(F.lit(1)).alias("n_metrics"),
        F.count_if("ops_park").alias("n_ops_park"),
        F.count_if(ran).alias("n_backtested"),
        (F.count_if(ran) + 1).alias("n_trials"),
        F.stddev_samp(F.when(ran, F.col("sharpe"))).alias("trade_sharpe_std"),
    )


def retest_trials(census: DataFrame) -> DataFrame:
    """Trials of a name that the census already holds; null where nothing was backtested, so that later checks fail closed."""
    return census.select(F.when(F.col("n_backtested") >= 1, F.col("n_backtested")).alias("n_trials"))


def pre_holdout(rows: DataFrame, gates: list[str], expected: int, sealed_from) -> DataFrame:
    """Rows that may feed effect analytics: ran under one of ``gates`` over the expected windows, none of which reaches the
    sealed span (``window_end``), not parked, and with at least one metric."""
    measured = F.coalesce(*[F.col(c).cast("double") for c in ("daily_sharpe", "sharpe", "test_pnl")]).isNotNull()
    counted = F.coalesce(F.col("n_windows") == expected, F.lit(True))
    inside = F.coalesce(F.col("window_end") < F.lit(sealed_from).cast("timestamp_ntz"), F.lit(True))
    return rows.where(~F.col("ops_park") & F.col("gate").isin(*gates) & counted & inside & measured)


def keep_newest(log: DataFrame, cap: int) -> DataFrame:
    """Newest ``cap`` rows of an append-only log (a top-k report)."""
    return log.orderBy(F.desc("tested_at"), F.desc("seq")).limit(cap)


def page(log: DataFrame, offset: int, limit: int, qualified: bool | None = None) -> DataFrame:
    """One page, newest first, ties by a hash of the name."""
    rows = log if qualified is None else log.where(F.col("qualified") == qualified)
    return rows.orderBy(F.desc("tested_at"), F.xxhash64("name"), F.desc("seq")).offset(offset).limit(limit)


def changed_rows(rows: DataFrame, stored: DataFrame) -> DataFrame:
    """Rows whose content differs from what is stored under their name."""
    body = [c for c in rows.columns if c != "name"]
    digest = F.sha2(F.to_json(F.struct(*body)), 256).alias("_h")
    return (
        rows.withColumn("_h", digest)
        .join(stored.select("name", digest), ["name", "_h"], "left_anti")
        .drop("_h")
    )


def overlay(index: DataFrame, rows: DataFrame, value: str) -> DataFrame:
    """Newest values laid over an index; names absent from ``rows`` keep theirs."""
    fresh = latest_per_name(rows).select("name", F.col(value).alias("_new"))
    return index.join(fresh, "name", "full_outer").select("name", F.coalesce("_new", value).alias(value))


# --- gates ----------------------------------------------------------------------

# Marks of a fail reason, each with its gate. A mark in START must begin the text, one in NAMED may stand
# anywhere. The heaviest mark that is found decides: what a reason begins with tells most, a benchmark it names comes
# next, and a bare P&L only counts where no benchmark is named.
START = {
    9: {"holdout": "holdout", "oos_trades": "trades", "oos_sharpe": "sharpe"},
    7: {"dsr": "dsr", "pbo": "pbo"},
    5: {"cost stress": "cost", "windows": "windows"},
    3: {"bh": "bh_legacy"},
    2: {"oos_pnl": "profit"},
}
NAMED = {8: {"sma_stack": "baseline"}, 6: {"neighbour": "perturb", "neighbor": "perturb"}, 4: {"b&h": "bh_legacy", "buy-and-hold": "bh_legacy", "buy_and_hold": "bh_legacy"}}


def classify_reason(reason: Column) -> Column:
    """Fail-reason text to a gate key, "ops" where no mark is found."""
    text = F.lower(F.trim(reason))
    tests = [(w, text.startswith(m), key) for w, marks in START.items() for m, key in marks.items()]
    tests += [(w, text.contains(m), key) for w, marks in NAMED.items() for m, key in marks.items()]
    found = [F.when(test, F.struct(F.lit(w).alias("w"), F.lit(key).alias("key"))) for w, test, key in tests]
    return F.coalesce(F.greatest(*found)["key"], F.lit("ops"))


def failed_gates(reasons: Column) -> Column:
    return F.array_distinct(F.transform(reasons, classify_reason))


def gate_failures(log: DataFrame, gate: str) -> DataFrame:
    """How many current names fail each gate; a name can fail several."""
    rows = latest_per_name(log).where(F.col("gate") == gate)
    return rows.select(F.explode(failed_gates(F.col("reasons"))).alias("gate_key")).groupBy("gate_key").agg(F.count(F.lit(1)).alias("names"))


def near_misses(log: DataFrame, gate: str, k: int = 8) -> DataFrame:
    """Failing names that clear every base floor, fewest robust failures first."""
    g = failed_gates(F.col("reasons"))
    rows = latest_per_name(log).where((F.col("gate") == gate) & ~F.col("qualified")).withColumn("_g", g)
    base = F.exists("_g", lambda x: x.isin(*BASE_GATES))
    robust = F.size(F.filter("_g", lambda x: x.isin(*ROBUST_GATES)))
    return rows.where(~base).orderBy(F.when(robust == 0, 99).otherwise(robust), F.desc("sharpe"), "name").limit(k).drop("_g")


# --- atom effects ---------------------------------------------------------------

# Upper limits and labels of each family's first number, and of a move in percent.
REACH = {"short": 24, "mid": 96, "long": None}
PACE = {"fast": 40, "mid": 100, "slow": None}
DEPTH = {"le24": 24, "le48": 48, "le96": 96, "gt96": None}
WIDTH = {"fast": 100, "slow": None}
PERCENT = {"2": 2, "4": 4, "6": 6, "8plus": None}
SCALES = {
    **dict.fromkeys(("mom", "dip"), REACH),
    **dict.fromkeys(("sma_abv", "ema_abv", "h1_sma_abv", "h1_ema_abv", "h4_sma_abv", "h4_ema_abv"), PACE),
    **dict.fromkeys(("don_hi", "don_lo", "near_swing_hi", "near_swing_lo", "dbl_bot"), DEPTH),
    **dict.fromkeys(("sma_stack", "ema_stack"), WIDTH),
}


def _steps(scale: dict) -> Column:
    return F.array(*[F.struct(F.lit(float("inf") if top is None else float(top)).alias("top"), F.lit(label).alias("label")) for label, top in scale.items()])


def _label(steps: Column, value: Column) -> Column:
    """Label of the first step that holds the value; of the last one where there is no value."""
    return F.get(F.filter(steps, lambda x: F.coalesce(value <= x["top"], x["top"] == float("inf"))), F.lit(0))["label"]


def bucket(p: Column) -> Column:
    """Coarse bucket of a parsed atom (family, params, lo, hi, op): its family, the step of its numbers, its percent."""
    fam = p["family"]
    numbers = F.transform(F.split(p["params"], "_"), lambda x: x.try_cast("int"))
    first = F.try_element_at(numbers, F.lit(1))
    thr = F.coalesce(p["lo"], p["hi"])
    scales = F.create_map(*[x for k, v in SCALES.items() for x in (F.lit(k), _steps(v))])
    size = F.when(fam.endswith("_stack"), F.array_max(numbers)).otherwise(first)
    percent = F.when(fam.isin("mom", "dip"), F.concat(_label(_steps(PERCENT), thr), F.lit("pc")))
    ten = F.when(p["op"] != "band", (F.bround(thr / 10.0) * 10).cast("int").cast("string"))
    rsi = F.concat_ws(":", F.lit("rsi"), p["op"], ten)
    return F.when(fam == "rsi", rsi).otherwise(F.concat_ws(":", fam, _label(F.try_element_at(scales, fam), size), percent))


def block_members(rows: DataFrame) -> DataFrame:
    """(name, level, block): the families and buckets a stack belongs to."""
    a = N.atom_rows(rows.select("name").distinct()).where("family IS NOT NULL")
    one = a.select("name", F.explode(F.array(
        F.struct(F.lit("family").alias("level"), F.col("family").alias("block")),
        F.struct(F.lit("bucket").alias("level"), bucket(F.struct("family", "params", "lo", "hi", "op")).alias("block")),
    )).alias("m"))
    return one.select("name", "m.*").distinct()


def block_report(rows: DataFrame) -> DataFrame:
    """Marginal effect of each block on newest rows: means with and without, pass rates,
    and the within-depth matched difference weighted by the smaller side."""
    fields = ("daily_sharpe", "sharpe", "trades")
    rows = cut_lineage(rows)
    base = rows.withColumn("depth", F.size(N.atoms("name")))
    depth_of = base.select("name", "depth", "qualified", *fields)
    members = block_members(rows).join(depth_of, "name")
    totals = base.agg(
        F.count(F.lit(1)).alias("t_n"), F.count_if("qualified").alias("t_q"),
        *[F.sum(f).alias(f"t_{f}") for f in fields], *[F.count(f).alias(f"tc_{f}") for f in fields],
    )
    agg = members.groupBy("level", "block").agg(
        F.count(F.lit(1)).alias("n_with"), F.count_if("qualified").alias("q"),
        *[F.sum(f).alias(f"w_{f}") for f in fields], *[F.count(f).alias(f"wc_{f}") for f in fields],
    )
    ratio = lambda a, b: F.when(b > 0, F.round(a / b, 6))
    c = F.col
    known = totals.first().asDict()  # one row of sums
    out = agg.withColumns({k: F.lit(v).cast(totals.schema[k].dataType) for k, v in known.items()}).select(
        "level", "block", "n_with", (c("t_n") - c("n_with")).alias("n_without"),
        *[ratio(c(f"w_{f}"), c(f"wc_{f}")).alias(f"mean_{f}_with") for f in fields],
        *[ratio(c(f"t_{f}") - c(f"w_{f}"), c(f"tc_{f}") - c(f"wc_{f}")).alias(f"mean_{f}_without") for f in fields],
        ratio(c("q"), c("n_with")).alias("pass_rate_with"),
        ratio(c("t_q") - c("q"), c("t_n") - c("n_with")).alias("pass_rate_without"),
    )
    by_depth = base.groupBy("depth").agg(F.sum("daily_sharpe").alias("ts"), F.count("daily_sharpe").alias("tc"))
    inside = members.groupBy("level", "block", "depth").agg(F.sum("daily_sharpe").alias("ws"), F.count("daily_sharpe").alias("wc"))
    weight = F.least("wc", c("tc") - c("wc"))
    gap = c("ws") / c("wc") - (c("ts") - c("ws")) / (c("tc") - c("wc"))
    matched = (
        inside.join(broadcast_if_small(by_depth), "depth").where("wc > 0 AND tc > wc")
        .groupBy("level", "block").agg(F.round(F.sum(weight * gap) / F.sum(weight), 6).alias("depth_controlled"))
    )
    return out.join(matched, ["level", "block"], "left")


def paired_rows(rows: DataFrame, pairs: DataFrame) -> DataFrame:
    """Child and parent results side by side with the difference."""
    take = lambda p: rows.select(F.col("name").alias(p), F.col("daily_sharpe").alias(f"{p}_sharpe"), F.col("trades").alias(f"{p}_trades"))
    return pairs.join(take("child"), "child").join(take("parent"), "parent").withColumn("delta", F.col("child_sharpe") - F.col("parent_sharpe"))


def parent_pairs(rows: DataFrame) -> DataFrame:
    """(child, atom, parent): each stack with each of its atoms removed, where that stack exists."""
    stacks = rows.select("name", F.array_sort(N.atoms("name")).alias("a")).where(F.size("a") > 1)
    less = stacks.select(F.col("name").alias("child"), F.explode("a").alias("atom"), "a").select(
        "child", "atom", F.array_join(F.array_remove("a", F.col("atom")), "&").alias("parent")
    )
    return less.join(rows.select(F.col("name").alias("parent")), "parent", "left_semi")


def _sign_test(positive: pd.Series, negative: pd.Series) -> pd.Series:
    """Two-sided exact sign test on counts, at every size: terms are summed down from the largest until they add nothing."""
    def one(pos, neg):
        n, k = int(pos + neg), int(min(pos, neg))
        if n <= 0:
            return None
        term = math.exp(math.lgamma(n + 1) - math.lgamma(k + 1) - math.lgamma(n - k + 1) - n * math.log(2.0))
        total = 0.0
        while k >= 0 and term > total * 1e-17:
            total += term
            term *= k / (n - k + 1)
            k -= 1
        return min(1.0, 2.0 * total)

    return pd.Series([one(p, q) for p, q in zip(positive, negative)], dtype="float64")


def t_quantile_975(df: float) -> float:
    """97.5% quantile of Student's t by bisection on its CDF (Simpson's rule)."""
    def cdf_half(x: float) -> float:  # P(0 < T < x)
        m = 400
        k = math.exp(math.lgamma((df + 1) / 2) - math.lgamma(df / 2)) / math.sqrt(df * math.pi)
        f = lambda u: k * (1 + u * u / df) ** (-(df + 1) / 2)
        h = x / m
        return h / 3 * (f(0) + f(x) + sum((4 if i % 2 else 2) * f(i * h) for i in range(1, m)))

    lo, hi = 0.0, 13.0
    for _ in range(60):
        mid = (lo + hi) / 2
        lo, hi = (mid, hi) if cdf_half(mid) < 0.475 else (lo, mid)
    return (lo + hi) / 2


def _t_half_width(n: pd.Series, sd: pd.Series) -> pd.Series:
    """Half width of the 95% t interval of a mean."""
    known: dict = {}

    def q(k):
        if k not in known:
            known[k] = t_quantile_975(float(k))
        return known[k]

    return pd.Series([q(int(k) - 1) * s / math.sqrt(k) if k >= 2 and s == s else None for k, s in zip(n, sd)], dtype="float64")


def paired_effects(rows: DataFrame) -> DataFrame:
    """Per added atom: mean child-minus-parent Sharpe, its 95% interval and the sign test."""
    d = paired_rows(rows, parent_pairs(rows))
    agg = d.groupBy("atom").agg(
        F.count("delta").alias("n"), F.avg("delta").alias("mean_delta"), F.stddev_samp("delta").alias("sd"),
        F.count_if(F.col("delta") > 0).alias("positive"), F.count_if(F.col("delta") < 0).alias("negative"),
    )
    half = F.pandas_udf(_t_half_width, "double")(F.col("n"), F.col("sd"))
    sign_test = F.pandas_udf(_sign_test, "double")
    return agg.select(
        "atom", "n", "mean_delta", (F.col("mean_delta") - half).alias("ci_low"), (F.col("mean_delta") + half).alias("ci_high"),
        "positive", "negative", sign_test(F.col("positive"), F.col("negative")).alias("p_value"),
    )


# --- lifts ----------------------------------------------------------------------

def shrunk(mean: Column, n: Column, prior: float = PRIOR) -> Column:
    return F.when(n > 0, n / (n + prior) * mean).otherwise(0.0)


#: Name of the free intercept among the atoms; no atom is empty.
INTERCEPT = ""


def normal_equations(records: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(gram(l, r, n), rhs(l, s)) of the target on atom indicators and an intercept, one row a pair of atoms that meet."""
    lists = records.where("target IS NOT NULL").select("target", F.concat(F.array(F.lit(INTERCEPT)), F.array_distinct(N.atoms("name"))).alias("a"))
    rhs = lists.select("target", F.explode("a").alias("l")).groupBy("l").agg(F.sum("target").alias("s"))
    left = lists.select("a", F.explode("a").alias("l"))
    gram = left.select("l", F.explode("a").alias("r")).groupBy("l", "r").agg(F.count(F.lit(1)).cast("double").alias("n"))
    return gram, rhs


def ridge_coefficients(records: DataFrame, lam: float = RIDGE, tolerance: float = 1e-10) -> DataFrame:
    """(atom, coef): ridge of the target on atom indicators with a free intercept, over all atoms.

    Preconditioned conjugate gradients. The counts of atom pairs are aggregated once; every step is one join of them with
    the direction and one aggregate, written as a table whose four dot products are observed on the way. The driver holds
    those four numbers, never a vector, so there is no bound on the number of atoms. Null targets and names without
    records give no rows; fewer than two records give none at all.
    """
    gram, rhs = (cut_lineage(x) for x in normal_equations(records))
    size = gram.where((F.col("l") == INTERCEPT) & (F.col("r") == INTERCEPT)).agg(F.sum("n")).first()[0]
    if not size or size < 2:
        return rhs.select(F.col("l").alias("atom"), F.col("s").cast("double").alias("coef")).limit(0)
    ridge = F.when(F.col("l") != INTERCEPT, lam).otherwise(0.0)
    diagonal = gram.where("l = r").select("l", (F.col("n") + ridge).alias("d"))
    b = F.col("s").cast("double")
    state = rhs.join(diagonal, "l").select("l", "d", F.lit(0.0).alias("x"), b.alias("r"), (b / F.col("d")).alias("p"))
    first = None
    while True:
        pushed = gram.join(state.select(F.col("l").alias("r"), F.col("p").alias("_p")), "r").groupBy("l").agg(F.sum(F.col("n") * F.col("_p")).alias("_q"))
        full = state.join(pushed, "l").withColumn("q", F.col("_q") + ridge * F.col("p")).drop("_q")
        seen = Observation()
        dot = lambda x, y: F.sum(F.col(x) * F.col(y) / F.col("d"))
        state = cut_lineage(full.observe(seen, F.sum(F.col("p") * F.col("q")).alias("pq"), dot("r", "r").alias("rr"), dot("r", "q").alias("rq"), dot("q", "q").alias("qq")))
        got = seen.get
        first = got["rr"] if first is None else first
        if not got["pq"] or got["rr"] <= first * tolerance**2:
            return state.where(F.col("l") != INTERCEPT).select(F.col("l").alias("atom"), F.col("x").alias("coef"))
        step = got["rr"] / got["pq"]
        left = max(0.0, got["rr"] - 2 * step * got["rq"] + step * step * got["qq"])
        r = F.col("r") - step * F.col("q")
        state = state.select("l", "d", (F.col("x") + step * F.col("p")).alias("x"), r.alias("r"), (r / F.col("d") + left / got["rr"] * F.col("p")).alias("p"))


def estimate_lifts(rows: DataFrame) -> DataFrame:
    """Per atom: shrunk paired excess where supported, else the ridge coefficient.

    ``rows`` is one row per name with test_pnl, bh_oos_pnl, sharpe, trades.
    """
    # One row a name, read by six sides: written once, so the log behind it is grouped once.
    base = cut_lineage(rows.select("name", "sharpe", "trades", (F.col("test_pnl") - F.col("bh_oos_pnl")).alias("excess")))
    pairs = parent_pairs(base)
    take = lambda p: base.select(F.col("name").alias(p), *[F.col(x).alias(f"{p}_{x}") for x in ("excess", "sharpe", "trades")])
    d = pairs.join(take("child"), "child").join(take("parent"), "parent")
    diff = lambda x: F.col(f"child_{x}") - F.col(f"parent_{x}")
    paired = d.groupBy("atom").agg(
        *[F.avg(diff(x)).alias(f"m_{x}") for x in ("excess", "sharpe", "trades")], *[F.count(diff(x)).alias(f"n_{x}") for x in ("excess", "sharpe", "trades")]
    )
    use = base.select("name", "trades", F.explode(F.array_distinct(N.atoms("name"))).alias("atom")).groupBy("atom").agg(
        F.count(F.lit(1)).alias("name_count"), F.avg((F.col("trades") == 0).cast("double")).alias("zero_trade_rate")
    )
    ridge = ridge_coefficients(base.where("excess IS NOT NULL").select("name", F.col("excess").alias("target")))
    c = F.col
    support = F.coalesce(c("n_excess"), F.lit(0))
    strong = support >= MIN_SUPPORT
    return (
        use.join(paired, "atom", "left").join(broadcast_if_small(ridge), "atom", "left").select(
            "atom", "name_count", "zero_trade_rate", support.alias("support"),
            F.when(strong, shrunk(c("m_excess"), c("n_excess"))).otherwise(F.coalesce(c("coef"), F.lit(0.0))).alias("score_lift"),
            F.coalesce(shrunk(c("m_sharpe"), c("n_sharpe")), F.lit(0.0)).alias("sharpe_lift"),
            F.coalesce(shrunk(c("m_trades"), c("n_trades")), F.lit(0.0)).alias("trades_lift"),
            F.when(strong, "paired").when(c("coef").isNotNull(), "ridge").otherwise("none").alias("source"),
        )
    )


def score_names(names: DataFrame, lifts: DataFrame) -> DataFrame:
    """Sum of a stack's atom lifts."""
    a = names.select("name", F.explode(F.array_distinct(N.atoms("name"))).alias("atom"))
    return a.join(broadcast_if_small(lifts), "atom", "left").groupBy("name").agg(
        F.coalesce(F.sum("score_lift"), F.lit(0.0)).alias("score"), F.coalesce(F.sum("sharpe_lift"), F.lit(0.0)).alias("sharpe_score")
    )


def top_bottom(lifts: DataFrame, k: int = 10) -> DataFrame:
    """Best and worst atoms, disjoint lists."""
    order = [F.desc("score_lift"), F.desc("sharpe_lift"), F.desc("support"), F.col("atom")]
    back = [F.asc("score_lift"), F.asc("sharpe_lift"), F.asc("support"), F.desc("atom")]
    top = lifts.orderBy(*order).limit(k).withColumn("side", F.lit("top"))
    bottom = lifts.join(top.select("atom"), "atom", "left_anti").orderBy(*back).limit(k).withColumn("side", F.lit("bottom"))
    return top.unionByName(bottom)


def steer(candidates: DataFrame, scores: DataFrame, n: int, seed: int = 7063) -> DataFrame:
    """First ``n`` candidates: best by lift, the last quarter of slots a seeded shuffle of the rest."""
    ranked = candidates.join(scores, "name", "left").fillna(0.0, ["score", "sharpe_score"])
    explore = int(round(n * EXPLORE_SHARE))
    head = ranked.orderBy(F.desc("score"), F.desc("sharpe_score"), "ord").limit(n - explore).withColumn("slot", F.lit("exploit"))
    rest = ranked.join(head.select("name"), "name", "left_anti")
    tail = rest.orderBy(F.xxhash64(F.lit(seed), "name"), "name").limit(explore).withColumn("slot", F.lit("explore"))
    return head.unionByName(tail)


# --- keys, candidates, order ----------------------------------------------------

# What an atom's first word stands for.
ROLES = {"h4": "h4", "h1": "h1", "mom": "mom", "dip": "dip", "don": "struct", "near": "struct", "dbl": "struct"}


def stack_keys(name: Column) -> Column:
    """Family, spine and extra keys of a stack, from the roles its atoms play.

    A higher frame leads before structure, the longer frame first, and structure leads only with an entry. The spine goes
    the same way, but without momentum the shorter frame comes first.
    """
    role_of = F.create_map(*[F.lit(x) for pair in ROLES.items() for x in pair])
    played = F.filter(F.transform(N.atoms(name), lambda a: F.struct(F.try_element_at(role_of, F.substring_index(a, "_", 1)).alias("role"), a.alias("atom"))), lambda x: x["role"].isNotNull())
    has = lambda role: F.exists(played, lambda x: x["role"] == role)
    first = lambda *roles: F.coalesce(*[F.when(has(r), F.lit(r)) for r in roles])
    entry = F.coalesce(first("mom", "dip"), F.lit("flat"))
    backed = has("struct") & (entry != "flat")
    lead = F.coalesce(first("h4", "h1"), F.when(backed, F.lit("struct")))
    spine = F.when(entry == "mom", first("h4", "h1", "struct")).otherwise(first("h1", "h4", "struct"))
    atom = F.get(F.filter(played, lambda x: x["role"] == spine), F.lit(0))["atom"]
    head = F.when(spine == "struct", F.regexp_replace(atom, r"_\d+$", "")).when(spine.isNotNull(), N.near_duplicate_key(atom)).otherwise("plain")
    alone = F.when(entry == "flat", "other").otherwise(entry)
    crossed = lambda x: F.concat(x, F.lit("×"), entry)
    return F.array_distinct(F.array_compact(F.array(F.coalesce(crossed(lead), alone), crossed(head), F.when(backed, crossed(F.lit("struct"))))))


def burned_keys(index: DataFrame) -> DataFrame:
    """Keys tested often without a pass, and the fixed one."""
    k = index.select(F.explode(stack_keys(F.col("name"))).alias("key"), "qualified")
    bad = k.groupBy("key").agg(F.count(F.lit(1)).alias("n"), F.count_if("qualified").alias("p")).where(f"n >= {BURNED_MIN_TESTED} AND p = 0")
    fixed = index.sparkSession.createDataFrame([("h4×mom",)], "key string")
    return bad.select("key").unionByName(fixed).distinct()


def zero_trade_names(log: DataFrame) -> DataFrame:
    return latest_per_name(log).where("NOT ops_park AND trades = 0").select("name")


def order_seeds(rows: DataFrame, expected: int, cap: int) -> DataFrame:
    """Names that traded enough in full windows, best excess first (a capped report)."""
    excess = F.col("test_pnl") - F.col("bh_oos_pnl")
    return (
        rows.where((F.col("n_windows") == expected) & (F.col("trades") >= 30))
        .orderBy(F.desc_nulls_last(excess), F.desc("sharpe"), "name").limit(cap)
    )


def forward_candidates(rows: DataFrame, taken: DataFrame, limit: int) -> DataFrame:
    """Qualified names no account holds, ranked, nulls last."""
    return (
        rows.where("qualified").join(taken.select("name"), "name", "left_anti")
        .orderBy(F.desc_nulls_last("daily_sharpe"), F.desc_nulls_last("sharpe"), F.desc_nulls_last("test_pnl"), "name").limit(limit)
    )


def rotate(names: DataFrame, cursor: str) -> DataFrame:
    """Names ordered from the cursor on, wrapping round."""
    return names.orderBy((F.col("name") < F.lit(cursor)).cast("int"), "name")


def leftovers(universe: DataFrame, log: DataFrame) -> DataFrame:
    return universe.join(tested_names(log), "name", "left_anti")


def cycle_batch(universe: DataFrame, log: DataFrame, k: int, cursor: str | None = None) -> DataFrame:
    """First ``k`` names (name, ord) never tested or failed, in their order from the cursor on, wrapping round.

    A tested name is never queued again. An unknown or tested cursor leaves the order as it is.
    """
    fresh = leftovers(universe, log)
    start = fresh.where(F.col("name") == F.lit(cursor)).agg(F.min("ord")).first()[0] if cursor else None
    before = F.lit(False) if start is None else F.col("ord") < start
    return fresh.orderBy(before, "ord").limit(k)


def ranked(rows: DataFrame) -> DataFrame:
    """Rank 1..n by daily Sharpe, Sharpe, P&L, then age and name; range-partitioned, not one task."""
    order = [F.desc_nulls_last("daily_sharpe"), F.desc_nulls_last("sharpe"), F.desc_nulls_last("test_pnl"), F.asc("tested_at"), F.asc("name")]
    keyed = rows.repartitionByRange(*order).withColumn("_p", F.spark_partition_id())
    keyed = keyed.withColumn("_k", F.row_number().over(Window.partitionBy("_p").orderBy(*order)))
    held = cut_lineage(keyed)  # partition ids must not be drawn again
    counts = held.groupBy("_p").agg(F.count(F.lit(1)).alias("_n"))
    shift = counts.withColumn("_s", F.coalesce(F.sum("_n").over(Window.orderBy("_p").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    return held.join(F.broadcast(shift.select("_p", "_s")), "_p").withColumn("rank", F.col("_k") + F.col("_s")).drop("_p", "_k", "_s")

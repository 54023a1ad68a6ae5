"""Seeded stacks of atoms: random draws, single swaps, and the mix of sources.

Draws come from hashes of (seed, index), so a row's draw does not depend on
its partition and a lost task repeats the same names. The distribution is the
depth table's; the byte sequence of any other generator is not reproduced.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from barloom.operators import names as N

# Share of each depth; depths the dead zone refuses are left out.
DEPTHS = ((2, 30), (3, 30), (4, 20))
AXES = ("timeframe", "ma_kind", "remove_atom", "add_atom")


def _draw(seed: int, salt: str, n: Column) -> Column:
    """Uniform integer in [0, n) for a row's ``index``."""
    return F.pmod(F.xxhash64(F.lit(seed), F.lit(salt), "index"), n.cast("long")).cast("int")


def split_counts(n: int, random_share: float, paired_share: float) -> tuple[int, int, int]:
    """(random, paired, recipe) slots of a batch."""
    clip = lambda x: min(1.0, max(0.0, x))
    n_random = min(n, round(n * clip(random_share)))
    n_paired = min(n - n_random, round((n - n_random) * clip(paired_share)))
    return n_random, n_paired, n - n_random - n_paired


def random_stacks(spark: SparkSession, atoms: list[str], count: int, seed: int, start: int = 0) -> DataFrame:
    """(index, depth, name): ``count`` seeded proposals, atoms distinct by family."""
    total = sum(w for _, w in DEPTHS)
    spot, depth, acc = _draw(seed, "depth", F.lit(total)), None, 0
    for d, w in DEPTHS:
        acc += w
        depth = F.when(spot < acc, d) if depth is None else depth.when(spot < acc, d)
    pool = F.array(*[F.lit(a) for a in atoms])
    ranked = F.array_sort(F.transform(pool, lambda a: F.struct(F.xxhash64(F.lit(seed), "index", a).alias("k"), a.alias("a"))))
    # Walk the shuffled pool and keep the first atom of each family.
    kept = F.aggregate(
        ranked, F.array().cast("array<struct<f:string,a:string>>"),
        lambda acc, x: F.when(F.exists(acc, lambda y: y["f"] == N.parsed(x["a"])["family"]), acc).otherwise(
            F.concat(acc, F.array(F.struct(N.parsed(x["a"])["family"].alias("f"), x["a"].alias("a"))))
        ),
    )
    rows = spark.range(start, start + count).withColumnRenamed("id", "index").withColumn("depth", depth.cast("int"))
    chosen = F.slice(F.transform(kept, lambda x: x["a"]), F.lit(1), F.col("depth"))
    return rows.select("index", "depth", F.array_join(F.array_sort(chosen), "&").alias("name"))


def swaps(parents: DataFrame, atoms: list[str]) -> DataFrame:
    """(parent, axis, child): every child one atom away along an axis."""
    rows = parents.select(F.col("name").alias("parent"), F.array_sort(N.atoms("name")).alias("a"))
    at = rows.select("parent", "a", F.posexplode("a").alias("i", "x"))
    put = lambda y: F.transform("a", lambda v, k: F.when(k == F.col("i"), y).otherwise(v))
    tf = F.when(F.col("x").startswith("h4_"), F.concat(F.lit("h1"), F.substring("x", 3, 200))).when(
        F.col("x").startswith("h1_"), F.concat(F.lit("h4"), F.substring("x", 3, 200)))
    kind = F.when(F.col("x").rlike("(^|_)sma_"), F.regexp_replace("x", "(^|_)sma_", "$1ema_")).when(
        F.col("x").rlike("(^|_)ema_"), F.regexp_replace("x", "(^|_)ema_", "$1sma_"))
    moved = [
        at.where(y.isNotNull()).select("parent", F.lit(axis).alias("axis"), put(y).alias("c"), "a", y.alias("y"))
        for axis, y in (("timeframe", tf), ("ma_kind", kind))
    ]
    moved = [m.where(~F.array_contains("a", F.col("y"))).select("parent", "axis", "c") for m in moved]
    less = at.where(F.size("a") > 1).select("parent", F.lit("remove_atom").alias("axis"), F.array_remove("a", F.col("x")).alias("c"))
    fam = lambda v: N.parsed(v)["family"]
    more = rows.select("parent", "a", F.explode(F.array(*[F.lit(v) for v in atoms])).alias("y")).where(
        ~F.exists("a", lambda v: fam(v) == fam(F.col("y")))
    ).select("parent", F.lit("add_atom").alias("axis"), F.concat("a", F.array("y")).alias("c"))
    out = moved[0].unionByName(moved[1]).unionByName(less).unionByName(more)
    return out.select("parent", "axis", F.array_join(F.array_sort("c"), "&").alias("child")).distinct()


def one_swap(parents: DataFrame, atoms: list[str], seed: int) -> DataFrame:
    """One seeded child per parent; the axis is drawn first, then the change."""
    s = swaps(parents, atoms)
    key = F.struct(F.xxhash64(F.lit(seed), "parent", "axis"), F.xxhash64(F.lit(seed), "parent", "child"))
    return s.groupBy("parent").agg(F.min_by(F.struct("axis", "child"), key).alias("c")).select("parent", "c.axis", "c.child")


def reject_reasons(names: DataFrame, taken: DataFrame, caps: DataFrame, min_atoms: int = 2) -> DataFrame:
    """(name, reason): why a sampled name is refused, null when it may run."""
    n = F.col("name")
    base = names.select("name").distinct()
    depth = F.size(N.atoms(n))
    shape = (
        F.when(~N.is_parseable(n), "unparseable").when(depth < min_atoms, "too_few_atoms")
        .when(N.has_momentum_and_dip(n), "mom_and_dip").when(n.rlike(r"(^|&)h4_") & n.rlike(r"(^|&)mom_"), "h4_mom")
        .when(N.lookback_too_expensive(n).isNotNull(), "lookback")
    )
    blocked = N.block_reasons(base, caps, taken).withColumnRenamed("reason", "_b")
    held = taken.select("name", F.lit("taken").alias("_t")).distinct()
    keys = taken.select(N.near_duplicate_key(n).alias("_k"), F.lit("near_duplicate").alias("_n")).distinct()
    return (
        base.withColumn("_s", shape).withColumn("_k", N.near_duplicate_key(n)).join(blocked, "name").join(held, "name", "left").join(keys, "_k", "left")
        .select("name", F.coalesce("_s", "_b", "_t", "_n").alias("reason"))
    )


def mix(*sources: DataFrame) -> DataFrame:
    """Union of (name) frames in priority order without duplicates."""
    tagged = [s.select("name", F.lit(k).alias("source")) for k, s in enumerate(sources)]
    out = tagged[0]
    for t in tagged[1:]:
        out = out.unionByName(t)
    return out.groupBy("name").agg(F.min("source").alias("source"))


def normalize_universe(tickers: DataFrame) -> DataFrame:
    """Upper-cased tickers once each, in first-seen order (``ord``)."""
    return tickers.groupBy(F.upper(F.trim("ticker")).alias("ticker")).agg(F.min("ord").alias("ord")).orderBy("ord")

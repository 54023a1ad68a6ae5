"""Combinations around passing stacks, counted off lazily until enough allowed names are found.

Every passing stack spans a product: each of its atoms or one of that atom's alternatives. A combination is a mixed-radix
number within its stack, and stacks follow one another, so any block of numbers can be made on its own. Blocks are made,
checked against the naming rules and against names and keys already taken, and the search ends with the block that
completes the wanted count. The product is never written out.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from barloom.operators import names as N
from barloom.operators import results as R
from barloom.session import cut_lineage

#: Numbers that one row of a block stands for before it is spread over tasks.
STRIDE = 4096
RANK = "decimal(38,0)"


def family_swaps(atoms: DataFrame) -> DataFrame:
    """(atom, alt): every known atom of the same family, from ``atoms`` with atom and family."""
    known = atoms.where("family IS NOT NULL").select("atom", "family").distinct()
    return known.join(known.select(F.col("atom").alias("alt"), "family"), "family").where("alt <> atom").select("atom", "alt")


def products(seeds: DataFrame, swaps: DataFrame) -> DataFrame:
    """(ord, pools, strides, total): the alternatives of each atom of a stack, its own atom first, and their radices.

    ``seeds`` has name and a unique ord. A stack's total must fit 63 bits; there is no limit on their sum.
    """
    spots = seeds.select("ord", F.posexplode(N.atoms("name")).alias("pos", "atom"))
    alts = swaps.groupBy("atom").agg(F.array_sort(F.collect_set("alt")).alias("alts"))
    pooled = spots.join(alts, "atom", "left").select("ord", "pos", F.concat(F.array("atom"), F.coalesce("alts", F.array().cast("array<string>"))).alias("pool"))
    stacks = pooled.groupBy("ord").agg(F.transform(F.array_sort(F.collect_list(F.struct("pos", "pool"))), lambda x: x["pool"]).alias("pools"))
    after = lambda i: F.aggregate(F.slice("pools", i + 2, F.size("pools")), F.lit(1).cast("long"), lambda acc, p: acc * F.size(p))
    radix = stacks.withColumn("strides", F.transform("pools", lambda p, i: after(i)))
    return radix.withColumn("total", F.get("strides", F.lit(0)) * F.size(F.get("pools", F.lit(0))))


def started(made: DataFrame) -> DataFrame:
    """``products`` with ``start``, the combinations in all stacks before; only totals of a stride of stacks meet in one window."""
    block = F.floor(F.col("ord") / F.lit(STRIDE))
    keyed = made.withColumn("_b", block)
    inside = Window.partitionBy("_b").orderBy("ord").rowsBetween(Window.unboundedPreceding, 0)
    total = F.col("total").cast(RANK)
    local = keyed.withColumn("_in", (F.sum(total).over(inside) - total).cast(RANK))
    sums = keyed.groupBy("_b").agg(F.sum(total).cast(RANK).alias("_t"))
    before = Window.orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)
    shift = sums.select("_b", F.coalesce(F.sum("_t").over(before), F.lit(0)).cast(RANK).alias("_s"))
    return local.join(shift, "_b").withColumn("start", (F.col("_in") + F.col("_s")).cast(RANK)).drop("_b", "_in", "_s")


def block_of(stacks: DataFrame, low: int, size: int) -> DataFrame:
    """(rank, name) of the combinations ``low`` to ``low + size - 1`` of ``started`` stacks."""
    lo, hi = F.lit(str(low)).cast(RANK), F.lit(str(low + size)).cast(RANK)
    first = F.greatest(lo - F.col("start"), F.lit(0).cast(RANK)).cast("long")
    last = F.least(hi - F.col("start"), F.col("total").cast(RANK)).cast("long") - 1
    met = stacks.where((F.col("start") < hi) & (F.col("start") + F.col("total") > lo)).withColumns({"a": first, "z": last})
    runs = met.select("start", "pools", "strides", "z", F.explode(F.sequence("a", "z", F.lit(STRIDE).cast("long"))).alias("a")).repartition("start", "a")
    one = runs.select("start", "pools", "strides", F.explode(F.sequence("a", F.least(F.col("a") + STRIDE - 1, "z"))).alias("local"))
    return one.select(
        (F.col("start") + F.col("local")).cast(RANK).alias("rank"),
        F.expr("array_join(transform(pools, (p, i) -> p[cast((local div strides[i]) % size(p) AS int)]), '&')").alias("name"),
    )


def allowed(made: DataFrame, taken: DataFrame, caps: DataFrame, burned: DataFrame) -> DataFrame:
    """(rank, name, key): canonical names that parse, break no rule, meet no burned key and are not, or nearly, taken.

    ``taken`` has name and key. Of names with one key the first by rank stays.
    """
    canon = N.canonical_names(made.select("name").distinct())
    first = made.join(canon, "name").groupBy("canonical").agg(F.min("rank").alias("rank")).withColumnRenamed("canonical", "name")
    n = F.col("name")
    fine = first.where(N.is_parseable(n) & ~N.has_momentum_and_dip(n) & N.lookback_too_expensive(n).isNull())
    keyed = fine.withColumn("key", N.near_duplicate_key(n)).join(taken.select("name").distinct(), "name", "left_anti").join(taken.select("key").distinct(), "key", "left_anti")
    keyed = cut_lineage(keyed.select("rank", "name", "key"))
    hit = keyed.select("name", F.explode(R.stack_keys(n)).alias("_k")).join(burned.select(F.col("key").alias("_k")), "_k", "left_semi").select("name").distinct()
    bad = N.block_reasons(keyed, caps).where("reason IS NOT NULL").select("name")
    left = keyed.join(hit, "name", "left_anti").join(bad, "name", "left_anti")
    return left.groupBy("key").agg(F.min(F.struct("rank", "name")).alias("m")).select("m.rank", "m.name", "key")


def placed(found: DataFrame) -> DataFrame:
    """(place, rank, name) of unique ranks; a window meets the finds of a stride of ranks or one count a stride."""
    keyed = found.select("rank", "name", F.floor(F.col("rank") / F.lit(STRIDE)).alias("_b"))
    sums = keyed.groupBy("_b").agg(F.count(F.lit(1)).alias("_n"))
    before = F.coalesce(F.sum("_n").over(Window.orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    inside = F.row_number().over(Window.partitionBy("_b").orderBy("rank"))
    return keyed.withColumn("_k", inside).join(sums.select("_b", before.alias("_s")), "_b").select((F.col("_k") + F.col("_s")).cast("int").alias("place"), "rank", "name")


def first_allowed(seeds: DataFrame, swaps: DataFrame, taken: DataFrame, caps: DataFrame, burned: DataFrame, n: int | None, block: int = 1 << 14) -> DataFrame:
    """(place, rank, name): the first ``n`` allowed combinations; fewer only where the product is exhausted. None: all of it.

    Blocks double, so a search that ends late takes few rounds. Each round's finds are a written table; the driver sees
    their count.
    """
    stacks = cut_lineage(started(products(seeds, swaps)))
    every = int(stacks.agg(F.sum(F.col("total").cast(RANK))).first()[0] or 0)
    held = cut_lineage(taken.select("name", N.near_duplicate_key(F.col("name")).alias("key")).distinct())
    found, count, low = None, 0, 0
    while low < every and (n is None or count < n):
        known = held if found is None else held.unionByName(found.select("name", "key"))
        new = cut_lineage(allowed(block_of(stacks, low, block), known, caps, burned))
        count += new.count()
        found = new if found is None else found.unionByName(new)
        low, block = low + block, block * 2
    if found is None:
        found = held.select(F.lit(None).cast(RANK).alias("rank"), "name", "key").limit(0)
    if n is None:
        return placed(found).withColumn("rank", F.col("rank").cast("string"))
    top = found.orderBy("rank").limit(n)
    return top.select(F.row_number().over(Window.orderBy("rank")).alias("place"), F.col("rank").cast("string").alias("rank"), "name")

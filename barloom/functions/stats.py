"""Statistics of return series: moments, deflated Sharpe, overfitting probability.

The normal distribution is plain arithmetic here, so it stays in generated
code: Hart's rational form for the CDF and algorithm AS241 for the quantile.
"""

from __future__ import annotations

import math
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from barloom.session import cut_lineage

EULER_MASCHERONI = 0.5772156649015328606

# Fixed values of the two published approximations, highest power first.
CDF_NUM = (3.52624965998911e-02, 0.700383064443688, 6.37396220353165, 33.912866078383, 112.079291497871, 221.213596169931, 220.206867912376)
CDF_DEN = (8.83883476483184e-02, 1.75566716318264, 16.064177579207, 86.7807322029461, 296.564248779674, 637.333633378831, 793.826512519948, 440.413735824752)
PPF_MID_NUM = (2.5090809287301226727e3, 3.3430575583588128105e4, 6.7265770927008700853e4, 4.5921953931549871457e4, 1.3731693765509461125e4, 1.9715909503065514427e3, 1.3314166789178437745e2, 3.3871328727963666080e0)
PPF_MID_DEN = (5.2264952788528545610e3, 2.8729085735721942674e4, 3.9307895800092710610e4, 2.1213794301586595867e4, 5.3941960214247511077e3, 6.8718700749205790830e2, 4.2313330701600911252e1, 1.0)
PPF_NEAR_NUM = (7.74545014278341407640e-4, 2.27238449892691845833e-2, 2.41780725177450611770e-1, 1.27045825245236838258e0, 3.64784832476320460504e0, 5.76949722146069140550e0, 4.63033784615654529590e0, 1.42343711074968357734e0)
PPF_NEAR_DEN = (1.05075007164441684324e-9, 5.47593808499534494600e-4, 1.51986665636164571966e-2, 1.48103976427480074590e-1, 6.89767334985100004550e-1, 1.67638483018380384940e0, 2.05319162663775882187e0, 1.0)
PPF_FAR_NUM = (2.01033439929228813265e-7, 2.71155556874348757815e-5, 1.24266094738807843860e-3, 2.65321895265761230930e-2, 2.96560571828504891230e-1, 1.78482653991729133580e0, 5.46378491116411436990e0, 6.65790464350110377720e0)
PPF_FAR_DEN = (2.04426310338993978564e-15, 1.42151175831644588870e-7, 1.84631831751005468180e-5, 7.86869131145613259100e-4, 1.48753612908506148525e-2, 1.36929880922735805310e-1, 5.99832206555887937690e-1, 1.0)


def log_growth(factor: Column) -> Column:
    """Log of a growth factor: minus infinity where all is lost (Spark's own log gives null), null below that."""
    return F.when(factor == 0, F.lit(float("-inf"))).otherwise(F.log(factor))


def _poly_col(x: Column, terms) -> Column:
    out = F.lit(float(terms[0]))
    for k in terms[1:]:
        out = out * x + float(k)
    return out


def norm_cdf(x: Column) -> Column:
    """Normal CDF of a column."""
    a = F.abs(x)
    e = F.exp(-a * a / 2)
    tail = e / (a + 1 / (a + 2 / (a + 3 / (a + 4 / (a + 0.65))))) / 2.506628274631
    low = (
        F.when(a > 37, 0.0)
        .when(a < 7.07106781186547, e * _poly_col(a, CDF_NUM) / _poly_col(a, CDF_DEN))
        .otherwise(tail)
    )
    return F.when(x > 0, 1.0 - low).otherwise(low)


def norm_ppf(p: Column) -> Column:
    """Normal quantile of a column."""
    q = p - 0.5
    m = 0.180625 - q * q
    r = F.sqrt(-F.log(F.least(p, 1.0 - p)))
    side = F.when(q < 0, -1.0).otherwise(1.0)
    return (
        F.when(F.abs(q) <= 0.425, q * _poly_col(m, PPF_MID_NUM) / _poly_col(m, PPF_MID_DEN))
        .when(r <= 5.0, side * _poly_col(r - 1.6, PPF_NEAR_NUM) / _poly_col(r - 1.6, PPF_NEAR_DEN))
        .otherwise(side * _poly_col(r - 5.0, PPF_FAR_NUM) / _poly_col(r - 5.0, PPF_FAR_DEN))
    )


def return_moments(rets: DataFrame, keys: list[str], ret: str = "ret") -> DataFrame:
    """n, mean, sample deviation, Sharpe, skew and raw kurtosis; null without variance."""
    x = F.col(ret)
    ok = (F.count(x) >= 2) & (F.var_pop(x) > 0)
    keep = lambda c: F.when(ok, c)
    return rets.groupBy(*keys).agg(
        F.count(x).alias("n"),
        keep(F.avg(x)).alias("mean"),
        keep(F.stddev_samp(x)).alias("std"),
        keep(F.avg(x) / F.stddev_samp(x)).alias("sharpe"),
        keep(F.skewness(x)).alias("skew"),
        keep(F.kurtosis(x) + 3).alias("kurtosis"),
    )


def _variance_term(sr: Column, skew: Column, kurt: Column) -> Column:
    return 1 - skew * sr + (kurt - 1) / 4 * sr * sr


def sharpe_estimator_std(sr: Column, n: Column, skew: Column, kurt: Column) -> Column:
    v = _variance_term(sr, skew, kurt)
    return F.when((n >= 2) & (v > 0), F.sqrt(v / (n - 1))).otherwise(0.0)


def expected_max_multiplier(n_trials: Column) -> Column:
    """E[max] of N standard normals; 0 for a single trial."""
    n = n_trials.cast("double")
    z1, z2 = norm_ppf(1 - 1 / n), norm_ppf(1 - 1 / (n * math.e))
    return F.when(n <= 1, 0.0).otherwise((1 - EULER_MASCHERONI) * z1 + EULER_MASCHERONI * z2)


def expected_maximum_sharpe(n_trials: Column, std: Column) -> Column:
    return F.when(std == 0, 0.0).otherwise(std * expected_max_multiplier(n_trials))


def probabilistic_sharpe(sr: Column, benchmark: Column, n: Column, skew: Column, kurt: Column) -> Column:
    v = _variance_term(sr, skew, kurt)
    z = (sr - benchmark) * F.sqrt(n - 1) / F.sqrt(v)
    return F.when((n >= 2) & (v > 0), norm_cdf(z)).otherwise(0.0)


def with_deflated_sharpe(moments: DataFrame, n_trials: Column) -> DataFrame:
    """Moments with the Sharpe benchmark of N trials and the deflated Sharpe probability."""
    sr, n, sk, ku = (F.col(c) for c in ("sharpe", "n", "skew", "kurtosis"))
    return (
        moments.withColumn("sr_std", sharpe_estimator_std(sr, n, sk, ku))
        .withColumn("sr_benchmark", expected_maximum_sharpe(n_trials, F.col("sr_std")))
        .withColumn("dsr", F.when(sr.isNotNull(), probabilistic_sharpe(sr, F.col("sr_benchmark"), n, sk, ku)))
    )


def with_dsr_hurdles(moments: DataFrame, n_trials: Column, confidence: float = 0.95, steps: int = 20) -> DataFrame:
    """Annual Sharpe that would pass at this length, and days needed at this Sharpe."""
    z = norm_ppf(F.lit(confidence))
    ask = expected_max_multiplier(n_trials) + z
    sr, sk, ku = F.col("sharpe"), F.col("skew"), F.col("kurtosis")
    left = F.greatest(F.lit(1.0), F.col("n") - 1.0)
    var = lambda s: F.greatest(F.lit(1e-12), _variance_term(s, sk, ku))
    base = moments.withColumn("_ask", ask).withColumn("_z", z)
    need = F.aggregate(
        F.sequence(F.lit(1), F.lit(steps)),
        F.col("_ask") * F.sqrt(1 / left),
        lambda acc, _: F.col("_ask") * F.sqrt(var(acc) / left),
    )
    days = lambda a: F.when(sr > 0, F.ceil(1 + var(sr) * F.pow(a / sr, 2)))
    return base.select(
        *moments.columns,
        F.when(sr.isNotNull(), F.round(need * math.sqrt(365), 3)).alias("required_annual_sharpe"),
        days(F.col("_ask")).alias("days_needed"),
        days(F.col("_z")).alias("psr_days_needed"),
    )


def sharpe_from_sums(total: Column, squares: Column, count: Column) -> Column:
    """Sharpe from a sum and a sum of squares of ``count`` values; +-1e6 where nothing varies."""
    mean = total / count
    flat = F.when(mean > 1e-15, 1e6).when(mean < -1e-15, -1e6).otherwise(0.0)
    sd = F.sqrt(F.greatest(F.lit(0.0), (squares / count - mean * mean) * F.try_divide(count, count - 1.0)))
    return F.when((count < 2) | (sd <= 1e-12), flat).otherwise(mean / sd)


def scaled_mean(rows: DataFrame, keys: list[str], value: str) -> DataFrame:
    """(keys, mean): a mean whose sum cannot overflow, as values are divided by the group's largest size first."""
    top = rows.groupBy(*keys).agg(F.max(F.abs(value)).alias("_s"))
    share = F.when(F.col("_s") > 0, F.col(value) / F.col("_s")).otherwise(0.0)
    return rows.where(F.col(value).isNotNull()).join(top, keys).groupBy(*keys, "_s").agg(F.avg(share).alias("_m")).select(*keys, (F.col("_s") * F.col("_m")).alias("mean"))


def halves(most: int) -> Column:
    """C(s, s/2) of the column ``s``, for even s up to ``most``."""
    return F.get(F.array(*[F.lit(math.comb(s, s // 2)).cast("long") for s in range(most + 1)]), F.col("s"))


def half_mask(rank: Column, s: Column, binomials: Column) -> Column:
    """The ``rank``-th of the C(s, s/2) halves of ``s`` blocks as a bit mask: the largest block first, by its binomial."""
    def step(acc, i):
        skip = F.get(F.get(binomials, i), acc["k"])
        bit = F.call_function("shiftleft", F.lit(1).cast("long"), i)
        taken = F.struct((acc["r"] - skip).alias("r"), (acc["k"] - 1).alias("k"), acc["m"].bitwiseOR(bit).alias("m"))
        return F.when((acc["k"] > 0) & (acc["r"] >= skip), taken).otherwise(acc)

    start = F.struct(rank.cast("long").alias("r"), (s / 2).cast("int").alias("k"), F.lit(0).cast("long").alias("m"))
    return F.aggregate(F.sequence(s - 1, F.lit(0), F.lit(-1)), start, step, lambda acc: acc["m"])


#: Splits that one task ranks together.
SPLIT_CHUNK = 512


def split_chunks(sizes: DataFrame, keys: list[str], most: int) -> DataFrame:
    """(keys, s, chunk): the first number of every run of ``SPLIT_CHUNK`` splits."""
    first = F.sequence(F.lit(0).cast("long"), halves(most) - 1, F.lit(SPLIT_CHUNK).cast("long"))
    return sizes.where("s > 0").select(*keys, "s", F.explode(first).alias("chunk"))


def cscv_splits(sizes: DataFrame, keys: list[str], most: int) -> DataFrame:
    """(keys, s, chunk, split, mask) of every in-sample half, for (keys, s): made by number, hash-partitioned by (keys, chunk)."""
    spread = split_chunks(sizes, keys, most).repartition(*keys, "chunk")
    last = F.least(F.col("chunk") + SPLIT_CHUNK, halves(most)) - 1
    one = spread.select(*keys, "s", "chunk", F.explode(F.sequence("chunk", last)).alias("split"))
    table = F.array(*[F.array(*[F.lit(math.comb(i, k)).cast("long") for k in range(most // 2 + 1)]) for i in range(most + 1)])
    return one.withColumn("mask", half_mask(F.col("split"), F.col("s"), table))


def overfitting_probability(perf: DataFrame, keys: list[str]) -> DataFrame:
    """Share of CSCV splits whose in-sample winner ranks in the lower half out of sample.

    ``perf`` is (keys, block, ord, value), one row per block and config, with blocks 0, 1, ... of each key. All blocks of
    a key are used, but for the last one where their number is odd. Ties go to the lowest ``ord``. Undefined (null)
    with fewer than two configs; a key with one block has no split and no row.

    Only C(s, s/2) halves are made, by unranking their numbers. A config travels as one row of block values a chunk of
    splits, its half sums are plain arithmetic on the mask, and a split's configs already sit in one task when ranked.
    """
    perf = cut_lineage(perf)
    counts = perf.groupBy(*keys).agg((F.max("block") + 1).cast("int").alias("n")).select(*keys, (F.col("n") - F.col("n") % 2).alias("s"))
    most = max([r["s"] for r in counts.select("s").distinct().collect()], default=0)  # a row per number of blocks
    cells = F.map_from_entries(F.collect_list(F.when(F.col("block") < F.col("s"), F.struct(F.col("block").cast("int"), F.coalesce("value", F.lit(0.0))))))
    rows = perf.join(counts, keys).groupBy(*keys, "s", "ord").agg(cells.alias("_m"))
    place = Window.partitionBy(*keys).orderBy("ord")
    rows = rows.select(
        *keys, "s", F.row_number().over(place).alias("place"),
        F.transform(F.sequence(F.lit(0), F.lit(max(most, 1) - 1)), lambda b: F.coalesce(F.try_element_at("_m", b), F.lit(0.0))).alias("v"),
    )
    total = lambda square: F.aggregate("v", F.lit(0.0), lambda acc, x: acc + (x * x if square else x))
    rows = cut_lineage(rows.withColumns({"_t": total(False), "_tt": total(True)}))
    splits = cscv_splits(counts, keys, most)
    wide = rows.drop("s").join(split_chunks(counts, keys, most).drop("s"), keys)
    bit = lambda b: F.expr(f"(shiftright(mask, {b}) & 1) = 1")
    half = lambda square: reduce(lambda x, y: x + y, [F.when(bit(b), F.get("v", F.lit(b)) ** 2 if square else F.get("v", F.lit(b))).otherwise(0.0) for b in range(most)] or [F.lit(0.0)])
    summed = splits.join(wide, [*keys, "chunk"]).select(*keys, "chunk", "split", "s", "place", "_t", "_tt", half(False).alias("_i"), half(True).alias("_ii"))
    n = (F.col("s") / 2).cast("double")
    # Equal configs must tie whatever order their sums were taken in.
    ins = F.round(sharpe_from_sums(F.col("_i"), F.col("_ii"), n), 9)
    oos = F.round(sharpe_from_sums(F.col("_t") - F.col("_i"), F.col("_tt") - F.col("_ii"), n), 9)
    per = summed.groupBy(*keys, "chunk", "split").agg(F.collect_list(F.struct(ins.alias("ins"), (-F.col("place")).alias("n"), oos.alias("oos"))).alias("c"))
    best = per.select(*keys, "c", F.array_max("c").alias("w"))
    under = F.size(F.filter("c", lambda x: (x["oos"] < F.col("w")["oos"]) | ((x["oos"] == F.col("w")["oos"]) & (x["n"] >= F.col("w")["n"]))))
    relative = under / (F.size("c") + 1.0)
    return best.groupBy(*keys).agg(
        F.when(F.max(F.size("c")) >= 2, F.avg((relative <= 0.5).cast("double"))).alias("pbo"),
        F.count(F.lit(1)).alias("splits"),
    )

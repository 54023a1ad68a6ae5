"""The rule library as frames: signals per config, the config grid, the manifest."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from barloom.functions import indicators as ind
from barloom.functions.sheet import Sheet
from barloom.plans.rules import RULES, columns, variant_name

RULES_PER_PLAN = 12  # rules that share one indicator sheet and one plan


def sheet_for(keys: list[str], grid: bool = True) -> tuple[Sheet, list[tuple[str, str, str]]]:
    """A sheet with every config of ``keys`` and its (name, signal, ready) columns."""
    s, out = Sheet(), []
    for key in keys:
        for params in RULES[key].configs() if grid else [RULES[key].center]:
            out.append((variant_name(key, params), *columns(s, key, params)))
    return s, out


def _long(df: DataFrame, t: str, configs) -> DataFrame:
    cells = ", ".join(f"'{name}', {on}, {ready}" for name, on, ready in configs)
    return df.selectExpr(
        "symbol", "day", f"{t} AS t", f"stack({len(configs)}, {cells}) AS (config, signal, ready)"
    )


def signals(bars: DataFrame, keys: list[str] | None = None, grid: bool = True) -> DataFrame:
    """(symbol, day, t, config, signal, ready) for every config of the wanted rules.

    Rules run in plans of ``RULES_PER_PLAN``: one plan over all 988 configs
    would not compile. Pass bars read from a written table.
    """
    keys = list(keys or RULES)
    parts = []
    for at in range(0, len(keys), RULES_PER_PLAN):
        s, configs = sheet_for(keys[at : at + RULES_PER_PLAN], grid)
        parts.append(_long(s.run(bars), s.t, configs))
    return reduce(DataFrame.unionByName, parts)


def signal_summary(sig: DataFrame) -> DataFrame:
    """Per series and config: days ready, days long, long days' index sum, first long day."""
    on = F.col("signal")
    return sig.groupBy("symbol", "config").agg(
        F.count_if("ready").alias("ready_days"),
        F.count_if(on).alias("on_days"),
        F.coalesce(F.sum(F.when(on, F.col("t").cast("long"))), F.lit(0)).alias("on_index_sum"),
        F.coalesce(F.sum(F.when(on, F.col("t").cast("long") * F.col("t"))), F.lit(0)).alias("on_index_sq"),
        F.min(F.when(on, F.col("day"))).alias("first_on"),
    )


def sma_stack(bars: DataFrame) -> DataFrame:
    """The benchmark rule: close > SMA(7) > SMA(25) > SMA(50)."""
    s = Sheet()
    a, b, c = (ind.sma(s, "c", n) for n in (7, 25, 50))
    on = s.put(f"coalesce(c > {a} AND {a} > {b} AND {b} > {c}, false)")
    return s.run(bars).selectExpr(
        "symbol", "day", f"{s.t} AS t", "'sma_stack' AS config", f"{on} AS signal", f"{c} IS NOT NULL AS ready"
    )


def score_index(sig: DataFrame) -> DataFrame:
    """First scored row per series, as ``score_start``; a config that is undefined for good, or again later, fails the job."""
    starts = score_start(sig)
    fine = F.assert_true(F.col("unwarmed_configs") == 0, F.concat(F.lit("configs that are not defined throughout: "), F.col("symbol")))
    return starts.where(fine.isNull())


def score_start(sig: DataFrame) -> DataFrame:
    """First scored row per series: every config is ready on the row before and stays so."""
    per = sig.groupBy("symbol", "config").agg(
        F.min(F.when(F.col("ready"), F.col("t"))).alias("first"),
        F.max(F.when(~F.col("ready"), F.col("t"))).alias("last_unready"),
        F.max("t").alias("last"),
    )
    bad = F.col("first").isNull() | (F.coalesce("last_unready", F.lit(-1)) > F.col("first"))
    return (
        per.select("*", (bad | (F.col("first") + 1 > F.col("last"))).alias("bad"))
        .groupBy("symbol")
        .agg(
            (F.max("first") + 1).alias("score_t"),
            F.count_if("bad").alias("unwarmed_configs"),
        )
    )


def grid_frame(spark: SparkSession) -> DataFrame:
    """One row per config: rule, parameters and whether it is the center."""
    rows = [
        (variant_name(r.key, p), r.key, r.family, r.cadence, {k: int(v) for k, v in p.items()}, p == r.center, i)
        for i, r in enumerate(RULES.values())
        for p in r.configs()
    ]
    schema = "config string, rule string, family string, cadence string, params map<string,int>, center boolean, ord int"
    return spark.createDataFrame(rows, schema)


def trial_count(grid: DataFrame) -> DataFrame:
    """Number of distinct configs, the N of the multiple-testing correction."""
    return grid.agg(F.count_distinct("config").alias("n_trials"))


def claim_names(grid: DataFrame) -> DataFrame:
    return grid.where("center").orderBy("ord").select("config")


def manifest(grid: DataFrame) -> DataFrame:
    """The catalog as nested rows: one per rule with its grid."""
    return grid.groupBy("rule", "family", "cadence", "ord").agg(
        F.first(F.when(F.col("center"), F.col("params")), ignorenulls=True).alias("center_params"),
        F.sort_array(F.collect_list("config")).alias("grid"),
        F.lit(20.0).alias("safety_stop_pct"),
    )


def neighbours(grid: DataFrame) -> DataFrame:
    """Config pairs of one rule that differ in exactly one parameter."""
    a, b = grid.alias("a"), grid.alias("b")
    moved = F.size(
        F.filter(F.map_keys("a.params"), lambda k: F.element_at("a.params", k) != F.element_at("b.params", k))
    )
    return (
        a.join(b, F.col("a.rule") == F.col("b.rule"))
        .where(moved == 1)
        .select(F.col("a.config").alias("config"), F.col("b.config").alias("neighbour"))
    )


def parse_variant(names: DataFrame, grid: DataFrame) -> DataFrame:
    """Config names resolved to rule and parameters; anything non-canonical is null."""
    return names.join(F.broadcast(grid.select("config", "rule", "params")), "config", "left")

"""User models and rules: registered functions over DataFrames and sheets."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from barloom.plans.rules import RULES, Rule

MODELS: dict[str, Callable[[DataFrame], DataFrame]] = {}


def model(name: str):
    """Register ``DataFrame -> DataFrame[ticker, date, value]``; values stay in [-1, 1]."""
    def register(fn):
        MODELS[name] = fn
        return fn

    return register


def run_models(bars: DataFrame, names: list[str]) -> DataFrame:
    """(model, ticker, date, value, abstained) of the named models; a null value abstains."""
    def one(name):
        got = MODELS[name](bars)
        value = F.greatest(F.lit(-1.0), F.least(F.lit(1.0), F.col("value")))
        return got.select(F.lit(name).alias("model"), "ticker", "date", F.coalesce(value, F.lit(0.0)).alias("value"), F.col("value").isNull().alias("abstained"))

    return reduce(DataFrame.unionByName, [one(n) for n in names])


def add_rule(key: str, family: str, signal: Callable, warm: Callable, **grid) -> Rule:
    """A user rule beside the catalog: predicate text of (sheet, params), warm-up and grid."""
    if key in RULES:
        raise ValueError(f"rule {key} exists")
    RULES[key] = Rule(key, family, signal, warm, "daily", grid)
    return RULES[key]

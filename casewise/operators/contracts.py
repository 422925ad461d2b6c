"""Checks that a table keeps its promise; each counts breaches as an aggregate and raises if there are any."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


class ContractError(ValueError):
    pass


def duplicates(df: DataFrame, keys: list[str]) -> DataFrame:
    """keys and how often they occur, if more than once."""
    return df.groupBy(*keys).agg(F.count("*").alias("copies")).where("copies > 1")


def require_unique(df: DataFrame, keys: list[str]) -> DataFrame:
    found = duplicates(df, keys).limit(3).collect()
    if found:
        raise ContractError(f"keys {keys} occur more than once, such as {found}")
    return df


def require(df: DataFrame, **rules: Column) -> DataFrame:
    """Each rule must hold for every row."""
    broken = df.agg(*(F.sum(F.when(F.coalesce(rule, F.lit(False)), 0).otherwise(1)).alias(name) for name, rule in rules.items())).first().asDict()
    broken = {k: v for k, v in broken.items() if v}
    if broken:
        raise ContractError(f"rows that break a rule: {broken}")
    return df


def require_columns(df: DataFrame, names: list[str]) -> DataFrame:
    missing = [n for n in names if n not in df.columns]
    if missing:
        raise ContractError(f"columns {missing} are missing")
    return df


def key_unique_join(left: DataFrame, right: DataFrame, on: list[str], kind: str = "one_to_one", how: str = "inner") -> DataFrame:
    """A join whose declared kind (one_to_one or many_to_one) is checked first."""
    require_unique(right, on)
    if kind == "one_to_one":
        require_unique(left, on)
    return left.join(right, on, how)

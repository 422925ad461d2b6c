"""Feature specs: what is included, why not, and a manifest of all."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from casewise.operators.contracts import ContractError


@dataclass(frozen=True)
class Feature:
    name: str
    source: str
    kind: str = "dynamic"
    how: str = "median"
    required: bool = False
    derived: bool = False
    unit: str = ""
    window: int | None = None
    eligible: bool = False


def specs_table(spark, specs: list[Feature]) -> DataFrame:
    return spark.createDataFrame([(k, s.name, s.source, s.kind, s.how, s.required, s.derived, s.unit, s.window, s.eligible) for k, s in enumerate(specs)], "place int, feature string, source string, kind string, how string, required boolean, derived boolean, unit string, window_seconds int, eligible boolean")


def resolve(df: DataFrame, specs: list[Feature]) -> DataFrame:
    """place, feature, included, reason. One aggregate over all columns tells which have data."""
    have = [s.source for s in specs if s.source in df.columns]
    seen = df.agg(*(F.count(c).alias(c) for c in dict.fromkeys(have))).first().asDict() if have else {}
    rows = []
    for k, s in enumerate(specs):
        reason = "" if s.derived else "column absent" if s.source not in seen else "all null" if not seen[s.source] else ""
        if reason and s.required:
            raise ContractError(f"{s.name}: {reason}")
        rows.append((k, s.name, not reason, reason))
    return df.sparkSession.createDataFrame(rows, "place int, feature string, included boolean, reason string")


def require_profile(resolved: DataFrame, names: list[str], refused: tuple[str, ...] = (), version: int | None = None, found_version: int | None = None) -> DataFrame:
    """The included features are exactly the profile's, in its order, none that it refuses, and of its version."""
    if version != found_version:
        raise ContractError(f"the table's profile has version {found_version}, not {version}")
    found = [r.feature for r in resolved.where("included").orderBy("place").collect()]
    if found != names or set(found) & set(refused):
        raise ContractError(f"{found} is not the profile {names}")
    return resolved


def manifest(df: DataFrame, specs: list[Feature]) -> DataFrame:
    """feature, source, kind, how, missing_pct (100 if absent), included, reason, unit, window_seconds, eligible."""
    have = [s.source for s in specs if s.source in df.columns]
    shares = df.agg(*((100 * F.avg(F.col(c).isNull().cast("double"))).alias(c) for c in dict.fromkeys(have))).unpivot([], list(dict.fromkeys(have)), "source", "missing_pct")
    return specs_table(df.sparkSession, specs).join(resolve(df, specs).drop("feature"), "place").join(F.broadcast(shares), "source", "left").select("feature", "source", "kind", "how", F.coalesce("missing_pct", F.lit(100.0)).alias("missing_pct"), "included", "reason", "unit", "window_seconds", "eligible")

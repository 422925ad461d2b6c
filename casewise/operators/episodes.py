"""Analytics of recorded trajectories."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def episode_metrics(df: DataFrame, episode: str, time: str, value: str, action: str, step: float, low: float = 40, high: float = 60, target: float = 50, deep: float = 30, change: float = 1.0, limit: float | None = None) -> DataFrame:
    v, a = F.col(value), F.col(action)
    w = Window.partitionBy(episode).orderBy(time)
    e = v - target
    moved = df.withColumn("_da", F.abs(a - F.lag(action).over(w)))
    time_in = lambda rule: F.sum(F.when(rule, step).otherwise(0.0))
    return moved.groupBy(episode).agg(
        time_in(v.between(low, high)).alias("in_range"),
        time_in(v < low).alias("below"),
        time_in(v > high).alias("above"),
        time_in(v < deep).alias("deep"),
        F.avg(F.abs(e)).alias("mae"),
        F.sqrt(F.avg(e * e)).alias("rmse"),
        (F.sum(F.abs(e)) * step).alias("integrated_error"),
        (F.sum(a) * step).alias("dose"),
        F.avg(a).alias("rate_mean"),
        F.max(a).alias("rate_max"),
        F.avg("_da").alias("smoothness"),
        F.count(F.when(F.col("_da") > change, 1)).alias("large_changes"),
        F.count(F.when(a >= (limit if limit is not None else float("inf")) - 1e-6, 1)).alias("saturated"),
    )


def episode_extras(df: DataFrame, episode: str, time: str, value: str, action: str, step: float, floor: float = 0.0, ceiling: float | None = None, levels: list[str] | None = None, effect: str | None = None, threshold: float | None = None, reward: str | None = None, components: list[str] | None = None, low: float = 40, high: float = 60, target: float = 50, deep: float = 30, tolerance: float = 1e-6) -> DataFrame:
    """Per episode: steps, duration, shares of time by range, largest error, spread of value and action, squared changes,
    saturation at both ends, mean and largest of concentrations, time with an effect over a threshold, rewards and why it
    ended (the last `reason`, where df has one).
    """
    v, a, n = F.col(value), F.col(action), F.count("*")
    w = Window.partitionBy(episode).orderBy(time)
    moved = df.withColumn("_da", a - F.lag(action).over(w))
    share = lambda rule: F.avg(F.when(rule, 1.0).otherwise(0.0))
    near = lambda end: F.count(F.when(F.abs(a - end) <= tolerance, 1)) if end is not None else F.lit(0).cast("long")
    out = [
        n.alias("steps"), (n * step).alias("duration"), share(v.between(low, high)).alias("in_range_share"), share(v < low).alias("below_share"), share(v > high).alias("above_share"), share(v < deep).alias("deep_share"),
        F.max(F.abs(v - target)).alias("largest_error"), F.stddev_pop(v).alias("value_std"), F.stddev_pop(a).alias("action_std"), F.coalesce(F.sum(F.abs("_da")), F.lit(0.0)).alias("change_sum"), F.coalesce(F.sum(F.col("_da") ** 2), F.lit(0.0)).alias("squared_change_sum"),
        near(floor).alias("at_floor"), (near(floor) / n).alias("at_floor_share"), near(ceiling).alias("at_ceiling"), (near(ceiling) / n).alias("at_ceiling_share"),
    ]
    out += [x for c in levels or [] for x in (F.avg(c).alias(f"{c}_mean"), F.max(c).alias(f"{c}_max"))]
    if effect and threshold is not None:
        out.append(F.sum(F.when(F.col(effect) > threshold, step).otherwise(0.0)).alias("over_threshold"))
    out += [F.coalesce(F.sum(c), F.lit(0.0)).alias(f"{c}_total") for c in ([reward] if reward else []) + (components or [])]
    if "reason" in df.columns:
        out.append(F.max_by("reason", time).alias("ended"))
    return moved.groupBy(episode).agg(*out)


def settling(df: DataFrame, episode: str, time: str, value: str, low: float = 40, high: float = 60) -> DataFrame:
    """First time in range after any time out of it, and earliest time from which all later rows are in range."""
    w = Window.partitionBy(episode).orderBy(time)
    out = (~F.col(value).between(low, high)).cast("int")
    marked = df.withColumn("_out", out)
    marked = marked.withColumns({"_before": F.max("_out").over(w.rowsBetween(Window.unboundedPreceding, -1)), "_after": F.max("_out").over(w.rowsBetween(0, Window.unboundedFollowing))})
    return marked.groupBy(episode).agg(F.min(F.when((F.col("_before") == 1) & (F.col("_out") == 0), F.col(time))).alias("reentry"), F.min(F.when(F.col("_after") == 0, F.col(time))).alias("settled"))


def scenarios(cases: DataFrame, split: str, seed: int, case: str = "caseid") -> DataFrame:
    """One scenario for each case of a split, with an id and the seed base + its place."""
    at = F.row_number().over(Window.partitionBy(split).orderBy(case)) - 1
    return cases.select(case, split, at.alias("place")).select(F.concat_ws("_", split, F.lpad(F.col("place").cast("string"), 4, "0")).alias("scenario"), case, split, (F.lit(seed) + F.col("place")).alias("seed"))


def trajectory_difference(df: DataFrame, profile: str, reference, keys: list[str], variables: list[str]) -> DataFrame:
    """Largest absolute difference to the reference profile per profile and variable; pass if it is 0."""
    long = df.select(profile, *keys, *(F.col(v).cast("double").alias(v) for v in variables)).unpivot([profile, *keys], variables, "variable", "value")
    base = long.where(F.col(profile) == reference).select(*keys, "variable", F.col("value").alias("_r"))
    return long.where(F.col(profile) != reference).join(base, [*keys, "variable"]).groupBy(profile, "variable").agg(F.max(F.abs(F.col("value") - F.col("_r"))).alias("difference")).withColumn("passed", F.col("difference") == 0)

"""Alignment of runs and paired comparisons."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def alignment(one: DataFrame, other: DataFrame, keys: list[str], values: list[str], tolerance: float = 0.0, order: str | None = None) -> DataFrame:
    """One row: keys missing in either table, copies in either, and rows whose values differ (as 32-bit floats, null-safe).

    order: a column of both that gives the rows' places; then also rows that stand elsewhere in the other table, and
    the first place of the one table at which anything is amiss.
    """
    place = [order] if order else []
    a = one.select(*keys, *(F.col(v).alias(f"_a_{v}") for v in [*values, *place]), F.lit(1).alias("_a"))
    b = other.select(*(F.col(k).alias(f"_k_{k}") for k in keys), *(F.col(v).alias(f"_b_{v}") for v in [*values, *place]), F.lit(1).alias("_b"))
    on = None
    for k in keys:
        on = F.col(k).eqNullSafe(F.col(f"_k_{k}")) if on is None else on & F.col(k).eqNullSafe(F.col(f"_k_{k}"))
    both = a.join(b, on, "full_outer")
    paired = F.col("_a").isNotNull() & F.col("_b").isNotNull()

    def differs(v: str):
        x, y = F.col(f"_a_{v}").cast("float"), F.col(f"_b_{v}").cast("float")
        return F.when(x.isNull() | y.isNull(), ~x.eqNullSafe(y)).otherwise(F.abs(x - y) > tolerance)

    extra = []
    if order:
        moved = F.col(f"_a_{order}") != F.col(f"_b_{order}")
        amiss = F.col("_b").isNull() | moved
        for v in values:
            amiss = amiss | differs(v)
        extra = [F.count(F.when(paired & moved, 1)).alias("moved"), F.min(F.when(amiss, F.col(f"_a_{order}"))).alias("first_mismatch")]
    counts = both.agg(F.count(F.when(F.col("_a").isNull(), 1)).alias("missing_left"), F.count(F.when(F.col("_b").isNull(), 1)).alias("missing_right"), *(F.count(F.when(paired & differs(v), 1)).alias(f"differ_{v}") for v in values), *extra)
    copies = lambda df, name: df.groupBy(*keys).count().agg(F.coalesce(F.sum(F.col("count") - 1), F.lit(0)).alias(name))
    return counts.join(F.broadcast(copies(one, "copies_left"))).join(F.broadcast(copies(other, "copies_right")))  # one row each


def mismatches(one: DataFrame, other: DataFrame, keys: list[str], value: str, most: int = 10, tolerance: float = 0.0) -> DataFrame:
    """keys, left and right: the first rows, by key, whose values differ; `most` of them at most, to be shown."""
    b = other.select(*keys, F.col(value).cast("float").alias("right"))
    both = one.select(*keys, F.col(value).cast("float").alias("left")).join(b, keys)
    differs = F.coalesce(F.abs(F.col("left") - F.col("right")) > tolerance, ~F.col("left").eqNullSafe(F.col("right")))
    return both.where(differs).orderBy(*keys).limit(most)


def metadata_alignment(predictions: DataFrame, metadata: DataFrame, key: str, agree: list[str]) -> DataFrame:
    """One row: keys that occur more than once, keys of either table that the other lacks, and rows that disagree in a column."""
    copies = predictions.groupBy(key).count().agg(F.count(F.when(F.col("count") > 1, 1)).alias("repeated"))
    a = predictions.select(F.col(key).alias("_k"), *(F.col(c).alias(f"_a_{c}") for c in agree))
    both = a.join(metadata.select(key, *agree), F.col("_k") == F.col(key), "full_outer")
    paired = F.col("_k").isNotNull() & F.col(key).isNotNull()
    counts = both.agg(F.count(F.when(F.col("_k").isNull(), 1)).alias("uncovered"), F.count(F.when(F.col(key).isNull(), 1)).alias("unknown"), *(F.count(F.when(paired & ~F.col(f"_a_{c}").eqNullSafe(F.col(c)), 1)).alias(f"differ_{c}") for c in agree))
    return counts.join(F.broadcast(copies))  # one row


def paired_difference(df: DataFrame, keys: list[str], side: str, left, right, value: str) -> DataFrame:
    """keys, left, right, difference (left - right), relative % and which wins (the smaller)."""
    v = lambda s: F.max(F.when(F.col(side) == s, F.col(value)))
    wide = df.where(F.col(side).isin(left, right)).groupBy(*keys).agg(v(left).alias("left"), v(right).alias("right")).where("left is not null and right is not null")
    d = F.col("left") - F.col("right")
    return wide.select("*", d.alias("difference"), F.when(F.col("right") != 0, 100 * d / F.col("right")).alias("relative_pct"), (d < 0).cast("int").alias("left_wins"))


def best_and_worst(df: DataFrame, value: str, keys: list[str], n: int = 5) -> DataFrame:
    """The n smallest and n largest rows, marked by `end`; each a top-k without a full sort."""
    low = df.orderBy(F.col(value).asc(), *keys).limit(n).withColumn("end", F.lit("best"))
    high = df.orderBy(F.col(value).desc(), *keys).limit(n).withColumn("end", F.lit("worst"))
    return low.unionByName(high)


def against_reference(runs: DataFrame, keys: list[str], condition: str, reference, metric: str) -> DataFrame:
    """Runs with the reference run's metric by keys: delta and relative %."""
    base = runs.where(F.col(condition) == reference).select(*keys, F.col(metric).alias("reference"))
    d = F.col(metric) - F.col("reference")
    return runs.where(F.col(condition) != reference).join(base, keys).withColumns({"delta": d, "relative_pct": 100 * d / F.col("reference")})


def delta_summary(paired: DataFrame, by: list[str], lower_is_better: bool = True) -> DataFrame:
    d = F.col("delta")
    better = d < 0 if lower_is_better else d > 0
    return paired.groupBy(*by).agg(F.count(d).alias("pairs"), F.avg(d).alias("mean"), F.stddev_samp(d).alias("std"), F.median(d).alias("median"), F.min(d).alias("min"), F.max(d).alias("max"), F.count(F.when(better, 1)).alias("better"))


def long_pairs(one: DataFrame, other: DataFrame, keys: list[str], metrics: list[str]) -> DataFrame:
    """One row per key and metric with both values and the difference."""
    long = lambda df, name: df.select(*keys, *(F.col(m).cast("double").alias(m) for m in metrics)).unpivot(keys, metrics, "metric", name)
    return long(one, "left").join(long(other, "right"), [*keys, "metric"]).withColumn("difference", F.col("left") - F.col("right"))


def inventory(present: DataFrame, dimensions: list[DataFrame]) -> DataFrame:
    """Key columns with status missing, unexpected or duplicate, against the grid of all dimensions."""
    grid = dimensions[0]
    for d in dimensions[1:]:
        grid = grid.crossJoin(F.broadcast(d))  # a list of conditions, models or seeds
    keys = grid.columns
    seen = present.groupBy(*keys).agg(F.count("*").alias("_n"))
    missing = grid.join(seen, keys, "left_anti").select(*keys, F.lit("missing").alias("status"))
    extra = seen.join(grid, keys, "left_anti").select(*keys, F.lit("unexpected").alias("status"))
    return missing.unionByName(extra).unionByName(seen.where("_n > 1").select(*keys, F.lit("duplicate").alias("status")))


def constant_columns(df: DataFrame, by: list[str], columns: list[str]) -> DataFrame:
    """by, column, distinct values (a null counts as one) and whether the group holds one only."""
    wide = df.groupBy(*by).agg(*((F.count_distinct(c) + F.max(F.col(c).isNull().cast("int"))).alias(c) for c in columns))
    return wide.unpivot(by, columns, "column", "distinct_values").withColumn("constant", F.col("distinct_values") == 1)


def setting_agreement(runs: DataFrame, settings: list[str]) -> DataFrame:
    """Per setting, how many distinct values the runs have and whether they agree."""
    wide = runs.agg(*((F.count_distinct(s) + F.max(F.col(s).isNull().cast("int"))).alias(s) for s in settings))
    return wide.unpivot([], settings, "setting", "distinct_values").withColumn("agrees", F.col("distinct_values") == 1)


def setting_faults(runs: DataFrame, run: list[str], expected: dict) -> DataFrame:
    """run, setting, found (as text): the runs whose setting is not the expected value; a null is a fault."""
    wrong = F.array_compact(F.array(*(F.when(~F.col(s).eqNullSafe(F.lit(v)), F.struct(F.lit(s).alias("setting"), F.col(s).cast("string").alias("found"))) for s, v in expected.items())))
    return runs.select(*run, F.explode(wrong).alias("_w")).select(*run, "_w.setting", "_w.found")


def schedule_faults(steps: DataFrame, run: list[str], step: str, schedule: list[int]) -> DataFrame:
    """run, missing and extra (sorted steps) and repeated: the runs whose steps are not the schedule, each exactly once."""
    wanted = F.array(*(F.lit(s) for s in schedule)).cast("array<bigint>")
    # a run has at most as many distinct steps as it was evaluated at
    per = steps.groupBy(*run).agg(F.array_sort(F.collect_set(F.col(step).cast("bigint"))).alias("_found"), (F.count("*") - F.count_distinct(step)).alias("repeated"))
    return per.select(*run, F.array_except(wanted, "_found").alias("missing"), F.array_except("_found", wanted).alias("extra"), "repeated").where("size(missing) > 0 or size(extra) > 0 or repeated > 0")


def cases_with_all(tracks: DataFrame, wanted: list[str], first: int | None = None, case: str = "caseid", track: str = "track", fewer: list[str] | None = None, least: int = 20) -> DataFrame:
    """Cases that hold every wanted track; where they are fewer than `least`, those that hold every one of `fewer`."""
    if fewer and cases_with_all(tracks, wanted, None, case, track).limit(least).count() < least:
        return cases_with_all(tracks, fewer, first, case, track)
    found = tracks.where(F.col(track).isin(wanted)).groupBy(case).agg(F.count_distinct(track).alias("_n")).where(F.col("_n") == len(set(wanted))).select(case)
    return found.orderBy(case).limit(first) if first else found


def rank_in_group(df: DataFrame, by: list[str], value: str, ascending: bool = False) -> DataFrame:
    """df with `rank`, ties sharing their average."""
    order = F.col(value).asc() if ascending else F.col(value).desc()
    return df.withColumn("rank", F.rank().over(Window.partitionBy(*by).orderBy(order)) + (F.count("*").over(Window.partitionBy(*by, value)) - 1) / 2)


def ordered_rank(df: DataFrame, by: list[str], keys: list[Column]) -> DataFrame:
    """df with `rank`, its place in the group by several sort keys; the last of them tells rows apart."""
    return df.withColumn("rank", F.row_number().over(Window.partitionBy(*by).orderBy(*keys)))


def rank_summary(ranked: DataFrame, by: list[str], rank: str = "rank") -> DataFrame:
    """How often each was first, and its mean rank."""
    return ranked.groupBy(*by).agg(F.count(F.when(F.col(rank) == 1, 1)).alias("wins"), F.avg(rank).alias("mean_rank"))

"""Imputation and scaling learnt from training rows only, and audits of what they meet elsewhere."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from casewise.operators.contracts import ContractError
from casewise.operators.order import modes, quantiles


def fit_scaling(train: DataFrame, features: list[str], categorical: list[str] | None = None, static: list[str] | None = None, case: str = "caseid", time: str = "time_sec") -> DataFrame:
    """feature, categorical, fill, mean, scale, seen. Means and deviations are those after filling.

    Fills are exact medians, or the lowest most frequent value; the moments of the filled columns follow from those of
    what is seen, since all that is filled in is one value. static: features that count once for each case, by its
    first row.
    """
    categorical, static = categorical or [], static or []
    fill: dict[str, float | None] = {}
    for some, rows in (([c for c in features if c not in static], train), (static, train.groupBy(case).agg(*(F.min_by(c, time).alias(c) for c in static)) if static else None)):
        if not some:
            continue
        of = {c: F.when(~F.isnan(F.col(c).cast("double")), F.col(c).cast("double")) for c in some}
        fill |= rows.agg(*(x for c, v in of.items() for x in (F.count("*").alias(f"_rows_{c}"), F.count(v).alias(f"_n_{c}"), F.avg(v).alias(f"_m_{c}"), F.var_pop(v).alias(f"_v_{c}")))).first().asDict()
        numbers = [c for c in some if c not in categorical]
        fill |= {c: x[0] for c, x in quantiles(rows, numbers, [0.5]).items()} if numbers else {}
        fill |= modes(rows, [c for c in some if c in categorical]) if len(numbers) < len(some) else {}
    missing = [c for c in features if not fill[f"_n_{c}"]]
    if missing:
        raise ValueError(f"nothing seen of {missing}")
    rows = []
    for c in features:
        seen, total, own = fill[f"_n_{c}"], fill[f"_rows_{c}"], fill[f"_m_{c}"]
        mean = own + (fill[c] - own) * (total - seen) / total
        variance = (seen * (fill[f"_v_{c}"] + (own - mean) ** 2) + (total - seen) * (fill[c] - mean) ** 2) / total
        # what rounding leaves of a constant column's variance is none
        scale = math.sqrt(variance) if variance > 1e-24 * max(1.0, mean * mean) else 1.0
        rows.append((c, c in categorical, fill[c], mean, scale, seen))
    return train.sparkSession.createDataFrame(rows, "feature string, categorical boolean, fill double, mean double, scale double, seen long")


def apply_scaling(df: DataFrame, statistics: DataFrame) -> DataFrame:
    """df with each feature filled and, unless categorical, standardised, and its <feature>_observed flag."""
    out = {}
    for s in statistics.collect():  # one row for each feature
        c = F.col(s.feature)
        filled = F.coalesce(c.cast("double"), F.lit(s.fill))
        out[f"{s.feature}_observed"] = c.isNotNull()
        out[s.feature] = filled if s.categorical else (filled - s.mean) / s.scale
    flags = {k: v for k, v in out.items() if k.endswith("_observed")}
    return df.withColumns(flags).withColumns({k: v for k, v in out.items() if k not in flags})


def invert_scaling(value: Column, statistics: DataFrame, feature: str) -> Column:
    s = statistics.where(F.col("feature") == feature).first()
    return value if s.categorical else value * s.scale + s.mean


def target_summary(df: DataFrame, y: str = "y", by: list[str] | None = None, low: float = 40, high: float = 60) -> DataFrame:
    v = F.col(y)

    def pct(rule: Column) -> Column:
        return 100 * F.count(F.when(rule, 1)) / F.count(v)

    return df.groupBy(*(by or [])).agg(F.count(v).alias("n"), F.avg(v).alias("mean"), F.stddev_pop(v).alias("std"), F.min(v).alias("min"), F.max(v).alias("max"), pct(v < low).alias("low_pct"), pct(v.between(low, high)).alias("mid_pct"), pct(v > high).alias("high_pct"))


def drift_audit(df: DataFrame, features: list[str], statistics: DataFrame, ranges: DataFrame, split: str = "split", case: str = "caseid") -> DataFrame:
    """Per feature and split: share of nulls, cases without any value, range, share outside the training range, large z.

    ranges: feature, train_min, train_max. Both small tables have one row for each feature.
    """
    long = df.select(split, case, *(F.col(c).cast("double").alias(c) for c in features)).unpivot([split, case], features, "feature", "value")
    per_case = long.groupBy(split, "feature", case).agg(F.count("value").alias("_seen")).groupBy(split, "feature").agg(F.count(F.when(F.col("_seen") == 0, 1)).alias("empty_cases"))
    known = F.broadcast(statistics.select("feature", "mean", "scale").join(ranges, "feature"))
    z = F.abs((F.col("value") - F.col("mean")) / F.col("scale"))
    outside = (F.col("value") < F.col("train_min")) | (F.col("value") > F.col("train_max"))
    main = long.join(known, "feature").groupBy(split, "feature").agg(
        (100 * F.avg(F.col("value").isNull().cast("double"))).alias("missing_pct"),
        F.min("value").alias("min"),
        F.max("value").alias("max"),
        (100 * F.count(F.when(outside, 1)) / F.count("value")).alias("outside_pct"),
        F.count(F.when(z > 5, 1)).alias("large_z"),
        F.max(z).alias("max_z"),
        F.var_pop("value").alias("variance"),
    )
    out = main.join(per_case, [split, "feature"])
    return out.withColumns({"much_missing": F.col("missing_pct") > 30, "flat": F.coalesce(F.col("variance") < 1e-8, F.lit(True)), "far_outside": F.coalesce(F.col("outside_pct") > 5, F.lit(False))})


def case_targets(df: DataFrame, y: str = "y", split: str = "split", case: str = "case_id", time: str = "target_ts", low: float = 40, high: float = 60) -> DataFrame:
    v = F.col(y)
    return df.groupBy(split, case).agg(F.count("*").alias("windows"), F.avg(v).alias("mean"), F.min(time).alias("first_target"), F.max(time).alias("last_target"), F.avg((v < low).cast("double")).alias("low"), F.avg(v.between(low, high).cast("double")).alias("mid"), F.avg((v > high).cast("double")).alias("high"))


def require_all_cases(cases: DataFrame, splits: DataFrame, split: str = "split", case: str = "case_id") -> DataFrame:
    """case_targets(), in which each case of each split must appear."""
    absent = splits.select(split, case).join(cases, [split, case], "left_anti").limit(3).collect()
    if absent:
        raise ContractError(f"cases of a split without windows, such as {absent}")
    return cases


def duplicate_check(df: DataFrame, statistics: DataFrame, one: str, other: str, offset: float, by: str = "split", tolerance: float = 1e-10) -> DataFrame:
    """Whether `other` is `one` less offset, in original units: by group and (null) over all: values, largest difference,
    correlation, and exact, the difference within the tolerance.

    df holds scaled values as rows of `by`, one and other; they are scaled back by the stored statistics first.
    """
    a, b = (invert_scaling(F.col(c), statistics, c) for c in (one, other))
    back = df.select(by, a.alias("_a"), b.alias("_b"))
    wrong = F.max(F.abs(F.col("_b") - (F.col("_a") - offset)))
    return back.cube(by).agg(F.count("*").alias("values"), wrong.alias("difference"), F.corr("_a", "_b").alias("correlation"), (wrong <= tolerance).alias("exact"))


def event_coverage(cases: DataFrame, split: str = "split") -> DataFrame:
    """Of case_targets: cases with any high or low target per split, their share, median prevalence, warning if none."""
    out = cases.groupBy(split).agg(F.count("*").alias("cases"), *(x for k in ("high", "low") for x in (F.count(F.when(F.col(k) > 0, 1)).alias(f"{k}_cases"), F.avg((F.col(k) > 0).cast("double")).alias(f"{k}_share"), F.median(k).alias(f"{k}_median"))))
    return out.withColumn("warning", (F.col("high_cases") == 0) | (F.col("low_cases") == 0))


def split_balance(cases: DataFrame, split: str = "split", case: str = "case_id") -> DataFrame:
    """Of case_targets: shares of cases and windows, windows per case, and the share of the largest one and two cases."""
    at = F.row_number().over(Window.partitionBy(split).orderBy(F.desc("windows"), case))
    per = cases.withColumn("_at", at).groupBy(split).agg(F.count("*").alias("cases"), F.sum("windows").alias("windows"), F.avg("windows").alias("mean_windows"), F.median("windows").alias("median_windows"), (F.sum(F.when(F.col("_at") <= 1, F.col("windows"))) / F.sum("windows")).alias("top1"), (F.sum(F.when(F.col("_at") <= 2, F.col("windows"))) / F.sum("windows")).alias("top2"))
    all_ = Window.partitionBy()
    return per.withColumns({"case_share": F.col("cases") / F.sum("cases").over(all_), "window_share": F.col("windows") / F.sum("windows").over(all_)})


def standardized_difference(df: DataFrame, value: str, group: str, one: str, other: str) -> DataFrame:
    """Mean difference over the root of the mean of the population variances; 0 if there is no variance."""
    v = lambda g: F.when(F.col(group) == g, F.col(value))
    s = df.agg(F.avg(v(one)).alias("a"), F.avg(v(other)).alias("b"), F.sqrt((F.var_pop(v(one)) + F.var_pop(v(other))) / 2).alias("s"))
    return s.select((F.col("a") - F.col("b")).alias("difference"), F.when(F.col("s") > 0, (F.col("a") - F.col("b")) / F.col("s")).otherwise(0.0).alias("smd"))


def target_differences(df: DataFrame, y: str = "y", split: str = "split", train: str = "train", low: float = 40, high: float = 60) -> DataFrame:
    """For each split but `train`: its differences to it of the shares of high and low targets, and the standardised one of their means."""
    v = F.col(y)
    each = df.where(v.isNotNull()).groupBy(split).agg(F.avg((v > high).cast("double")).alias("high"), F.avg((v < low).cast("double")).alias("low"), F.avg(v).alias("mean"), F.var_pop(v).alias("var"))
    own = each.where(F.col(split) == train).select(*(F.col(c).alias(f"_{c}") for c in ("high", "low", "mean", "var")))
    s = F.sqrt((F.col("_var") + F.col("var")) / 2)
    smd = F.when(s > 0, (F.col("_mean") - F.col("mean")) / s).otherwise(0.0)
    return each.where(F.col(split) != train).crossJoin(F.broadcast(own)).select(split, (F.col("_high") - F.col("high")).alias("high_difference"), (F.col("_low") - F.col("low")).alias("low_difference"), smd.alias("smd"))


def acceptance(balance: DataFrame, coverage: DataFrame, split: str = "split", cases: int = 10, events: int = 2, top2: float = 0.5, differences: DataFrame | None = None, drift: DataFrame | None = None, prevalence: float = 0.1, smd: float = 0.5) -> DataFrame:
    """One row for each split with its checks.

    differences: target_differences(), which the training split, having none, passes. drift: drift_audit(); a feature
    much missing in any split fails all. Without them `accepted` does not cover their rules.
    """
    both = balance.join(coverage.drop("cases"), split)
    checks = {"enough_cases": F.col("cases") >= cases, "enough_events": F.least("high_cases", "low_cases") >= events, "not_dominated": F.col("top2") < top2}
    if differences is not None:
        both = both.join(differences, split, "left")
        near = (F.abs("high_difference") <= prevalence) & (F.abs("low_difference") <= prevalence) & (F.abs("smd") <= smd)
        checks["targets_alike"] = F.coalesce(near, F.lit(True))
    if drift is not None:
        both = both.crossJoin(F.broadcast(drift.agg(F.coalesce(F.max("much_missing"), F.lit(False)).alias("_missing"))))
        checks["features_available"] = ~F.col("_missing")
    accepted = F.lit(True)
    for c in checks.values():
        accepted = accepted & c
    return both.select(split, *(v.alias(k) for k, v in checks.items()), accepted.alias("accepted"))


def window_faults(df: DataFrame, length: int, interval: int, horizon: int, low: float = 40, high: float = 60) -> DataFrame:
    """How many windows break each rule: sizes, mask, times, labels."""
    rules = {
        "steps": (F.size("x") == length) & (F.size("mask") == length),
        "finite": F.forall("x", lambda r: F.forall(r, lambda v: v.isNull() | (~F.isnan(v) & (F.abs(v) < float("inf"))))),
        "mask": F.forall(F.arrays_zip("x", "mask"), lambda p: F.forall(F.arrays_zip(p["x"], p["mask"]), lambda q: q["x"].isNotNull() == q["mask"])),
        "offset": F.col("target_ts") - F.col("final_ts") == horizon,
        "span": F.col("final_ts") - F.col("first_ts") == (length - 1) * interval,
        "labels": (F.col("y_high") == (F.col("y") > high).cast("int")) & (F.col("y_low") == (F.col("y") < low).cast("int")),
    }
    return df.agg(F.count("*").alias("windows"), *(F.count(F.when(~F.coalesce(r, F.lit(False)), 1)).alias(k) for k, r in rules.items()))


def target_faults(df: DataFrame, grid: DataFrame, value: str, y: str = "y", case: str = "caseid", time: str = "timestamp", tolerance: float = 1e-6) -> DataFrame:
    """One row: windows, those whose target time the resampled table lacks, and those whose target is not its value there."""
    truth = grid.select(F.col(case).alias("_case"), F.col(time).alias("_time"), F.col(value).alias("_value"))
    both = df.join(truth, (F.col("case_id") == F.col("_case")) & (F.col("target_ts") == F.col("_time")), "left")
    wrong = F.col("_case").isNotNull() & ~F.coalesce(F.abs(F.col(y) - F.col("_value")) <= tolerance, F.col(y).isNull() & F.col("_value").isNull())
    return both.agg(F.count("*").alias("windows"), F.count(F.when(F.col("_case").isNull(), 1)).alias("absent"), F.count(F.when(wrong, 1)).alias("wrong"))

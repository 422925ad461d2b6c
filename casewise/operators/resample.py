"""Fixed-bin resampling of a case and features derived from the past alone."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from casewise.operators.contracts import ContractError


def resample(df: DataFrame, how: dict[str, str], interval: int = 10, case: str = "caseid", time: str = "time_sec", static: list[str] | None = None) -> DataFrame:
    """One row for each case and bin; how: median, last or first of each column, nulls skipped.

    Static columns must not vary in a case; a null counts as a value of its own.
    """
    if static:
        vary = [((F.count_distinct(c) + F.max(F.col(c).isNull().cast("int"))) > 1).alias(c) for c in static]
        bad = df.groupBy(case).agg(*vary).where(" or ".join(f"`{c}`" for c in static)).limit(3).collect()
        if bad:
            raise ContractError(f"static columns vary in a case: {bad}")
    t = F.col(time)
    make = {
        "median": lambda c: F.median(c),
        "last": lambda c: F.max_by(c, F.when(F.col(c).isNotNull(), t)),
        "first": lambda c: F.min_by(c, F.when(F.col(c).isNotNull(), t)),
    }
    timestamp = (F.floor(t / interval) * interval).cast("long").alias("timestamp")
    return df.groupBy(case, timestamp).agg(*(make[kind](c).alias(c) for c, kind in how.items()), *(F.first(c, ignorenulls=True).alias(c) for c in static or []))


def by_time(case: str = "caseid", time: str = "timestamp"):
    return Window.partitionBy(case).orderBy(time)


def guarded_delta(column: str, interval: int, case: str = "caseid", time: str = "timestamp") -> Column:
    """Difference to the row before, only if that is exactly one interval back."""
    w = by_time(case, time)
    return F.when(F.col(time) - F.lag(time).over(w) == interval, F.col(column) - F.lag(column).over(w))


def pump_rate(rate: Column, concentration: float = 20, minutes: float = 60) -> Column:
    """mL/h to mg/min; a negative rate is an error."""
    return F.when(rate < 0, F.raise_error(F.lit("negative pump rate")).cast("double")).otherwise(rate * concentration / minutes)


def cumulative_dose(df: DataFrame, volume: str, concentration: float = 1.0, tolerance: float = 1e-6, case: str = "caseid", time: str = "timestamp") -> DataFrame:
    """df with `reset` and `cumulative`: the first value seen adds nothing, a drop is a reset and adds the new value."""
    w = by_time(case, time)
    before = F.last(volume, ignorenulls=True).over(w.rowsBetween(Window.unboundedPreceding, -1))
    v = F.col(volume)
    reset = F.coalesce(v < before - tolerance, F.lit(False))
    step = F.when(v.isNull() | before.isNull(), 0.0).when(reset, v).otherwise(F.greatest(v - before, F.lit(0.0)))
    out = df.withColumns({"reset": reset, "_step": step})
    total = F.sum("_step").over(w.rowsBetween(Window.unboundedPreceding, 0)) * concentration
    return out.withColumn("cumulative", F.when(v.isNotNull(), total)).drop("_step")


def recent_dose(df: DataFrame, cumulative: str, span: int, case: str = "caseid", time: str = "timestamp") -> DataFrame:
    """df with `recent`: cumulative now less that at exactly max(t - span, case start); null if that bin is absent."""
    w = by_time(case, time)
    start = F.min(time).over(Window.partitionBy(case))
    then = F.first(cumulative).over(w.rangeBetween(-span, -span))
    at_start = F.first(cumulative).over(w.rowsBetween(Window.unboundedPreceding, 0))
    return df.withColumn("recent", F.col(cumulative) - F.when(F.col(time) - span <= start, at_start).otherwise(then))


def gap_counts(df: DataFrame, interval: int, by: list[str], case: str = "caseid", time: str = "timestamp") -> DataFrame:
    gap = F.col(time) - F.lag(time).over(by_time(case, time))
    return df.withColumn("_gap", gap).groupBy(*by).agg(F.sum(F.when(F.col("_gap") != interval, 1).otherwise(0)).alias("irregular_gaps"))


def agreement(df: DataFrame, one: str, other: str, by: list[str] | None = None) -> DataFrame:
    """Paired count, coverage, MAE, RMSE, mean difference and Pearson of two columns."""
    from casewise.functions import pearson

    a, b = F.col(one), F.col(other)
    d = a - b
    return df.groupBy(*(by or [])).agg(F.count(d).alias("pairs"), (F.count(d) / F.count(b)).alias("coverage"), F.avg(F.abs(d)).alias("mae"), F.sqrt(F.avg(d * d)).alias("rmse"), F.avg(d).alias("bias"), pearson(a, b).alias("pearson"))

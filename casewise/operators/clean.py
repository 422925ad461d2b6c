"""Cleaning of raw signals, one exchange by case for all window steps."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from casewise.operators.order import quantiles


def first_available(df: DataFrame, targets: dict[str, list[str]]) -> DataFrame:
    """Each target from the first of its tracks that has a value; tracks that df lacks are passed over."""
    have = set(df.columns)
    return df.select("*", *(F.coalesce(F.lit(None).cast("double"), *(F.col(t) for t in tracks if t in have)).alias(name) for name, tracks in targets.items()))


def bounded_fill(df: DataFrame, columns: list[str], rows: int = 10, case: str = "caseid", time: str = "time_sec") -> DataFrame:
    """Fill from the last value at most `rows` rows back in the case."""
    w = Window.partitionBy(case).orderBy(time).rowsBetween(-rows, 0)
    return df.withColumns({c: F.last(c, ignorenulls=True).over(w) for c in columns})


def quality_filter(df: DataFrame, value: str = "bis", index: str | None = None, low: float = 10, high: float = 100, least: float = 50) -> DataFrame:
    ok = F.col(value).between(low, high)
    return df.where(ok & (F.col(index).isNull() | (F.col(index) >= least)) if index else ok)


def kept_fraction(before: DataFrame, kept: Column) -> DataFrame:
    return before.agg(F.count("*").alias("rows"), F.count(F.when(kept, 1)).alias("kept"), (F.count(F.when(kept, 1)) / F.count("*")).alias("fraction"))


def crop_active(df: DataFrame, active: Column, case: str = "caseid", time: str = "time_sec") -> DataFrame:
    """Rows from the first to the last active one of a case; cases without any go."""
    w = Window.partitionBy(case)
    at = F.when(F.coalesce(active, F.lit(False)), F.col(time))
    return df.withColumns({"_first": F.min(at).over(w), "_last": F.max(at).over(w)}).where(F.col(time).between(F.col("_first"), F.col("_last"))).drop("_first", "_last")


def minimum_length(df: DataFrame, rows: int = 300, case: str = "caseid") -> DataFrame:
    return df.withColumn("_n", F.count("*").over(Window.partitionBy(case))).where(F.col("_n") >= rows).drop("_n")


def encode_sex(text: Column) -> Column:
    t = F.lower(F.trim(text.cast("string")))
    return F.when(t.isin("m", "male", "1", "1.0"), 1).when(t.isin("f", "female", "0", "0.0"), 0)


def strict_sex(df: DataFrame, column: str) -> DataFrame:
    """encode_sex that raises where a text is none of the known ones."""
    code = encode_sex(F.col(column))
    bad = F.raise_error(F.concat(F.lit("unknown sex: "), F.col(column).cast("string"))).cast("int")
    return df.withColumn("sex_male", F.when(F.col(column).isNotNull() & code.isNull(), bad).otherwise(code))


def value_report(df: DataFrame, value: str, label: Column) -> DataFrame:
    """count, mean, std, min, exact quartiles, max of a value and the share of a label."""
    v = F.col(value)
    parts = zip((25, 50, 75), quantiles(df, [value], [0.25, 0.5, 0.75])[value], strict=True)
    return df.agg(F.count(v).alias("n"), F.avg(v).alias("mean"), F.stddev_samp(v).alias("std"), F.min(v).alias("low"), *(F.lit(x).cast("double").alias(f"q{q}") for q, x in parts), F.max(v).alias("high"), F.avg(label.cast("double")).alias("label_share"))


def label_distribution(df: DataFrame, labels: dict[str, Column]) -> DataFrame:
    """label, value (text, null where it is missing), rows and share of the label's rows that are not missing."""
    marks = F.explode(F.array(*(F.struct(F.lit(k).alias("label"), v.cast("string").alias("value")) for k, v in labels.items())))
    counts = df.select(marks.alias("x")).groupBy("x.label", "x.value").agg(F.count("*").alias("rows"))
    seen = F.when(F.col("value").isNotNull(), F.col("rows"))
    return counts.withColumn("share", seen / F.sum(seen).over(Window.partitionBy("label")))


def missing_summary(df: DataFrame, most: int = 30) -> DataFrame:
    """feature and missing: the share of nulls of each column, the largest `most` of them, largest first."""
    return missing_rates(df, df.columns).orderBy(F.desc("missing"), "feature").limit(most)


def missing_rates(df: DataFrame, columns: list[str], by: list[str] | None = None) -> DataFrame:
    """One row for each column (and group) with its share of nulls."""
    by = by or []
    wide = df.groupBy(*by).agg(*(F.avg(F.col(c).isNull().cast("double")).alias(c) for c in columns))
    return wide.unpivot(by or [F.lit(0).alias("_g")], columns, "feature", "missing").drop("_g")

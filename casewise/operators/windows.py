"""History/target windows by exact timestamps."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from casewise.operators.order import quantiles


def endpoints(df: DataFrame, target: str, length: int = 6, interval: int = 10, horizon: int = 30, case: str = "caseid", time: str = "timestamp") -> DataFrame:
    """df with `has_history` (all grid times back to t-(length-1)*interval exist), `target` and `target_ts`.

    Grid times are distinct, so the row length-1 back tells whether any is missing; the target is looked up by time.
    """
    w = Window.partitionBy(case).orderBy(time)
    span = (length - 1) * interval
    history = F.coalesce(F.lag(time, length - 1).over(w) == F.col(time) - span, F.lit(False))
    return df.withColumns({"has_history": history, "target": F.first(target).over(w.rangeBetween(horizon, horizon)), "target_ts": F.col(time) + horizon, "_start": F.min(time).over(Window.partitionBy(case))})


def windows(df: DataFrame, features: list[str], target: str, static: list[str] | None = None, length: int = 6, interval: int = 10, horizon: int = 30, low: float = 40, high: float = 60, case: str = "caseid", time: str = "timestamp") -> DataFrame:
    """One row per window: x and mask (oldest step first), s, y, y_high, y_low and the times."""
    w = Window.partitionBy(case).orderBy(time).rowsBetween(-(length - 1), 0)
    step = F.struct(*(F.col(c).cast("double").alias(c) for c in features))
    marked = endpoints(df, target, length, interval, horizon, case, time).withColumn("_steps", F.collect_list(step).over(w))
    found = marked.where(F.col("has_history") & F.col("target").isNotNull())
    y = F.col("target")
    return found.select(
        F.col(case).alias("case_id"),
        (F.col(time) - (length - 1) * interval).alias("first_ts"),
        F.col(time).alias("final_ts"),
        "target_ts",
        F.transform("_steps", lambda s: F.array(*(s[c] for c in features))).alias("x"),
        F.transform("_steps", lambda s: F.array(*(s[c].isNotNull() for c in features))).alias("mask"),
        F.array(*(F.col(c).cast("double") for c in static or [])).alias("s"),
        y.alias("y"),
        (y > high).cast("int").alias("y_high"),
        (y < low).cast("int").alias("y_low"),
    )


def removed_windows(marked: DataFrame) -> DataFrame:
    """Endpoints with full history and no target."""
    return marked.agg(F.count(F.when(F.col("has_history") & F.col("target").isNull(), 1)).alias("removed"))


def eligible_cases(marked: DataFrame, first: int | None = None, case: str = "caseid") -> DataFrame:
    """Cases with a valid window; the first n by id if asked for."""
    found = marked.groupBy(case).agg(F.max(F.col("has_history") & F.col("target").isNotNull()).alias("_ok")).where("_ok").select(case)
    return found.orderBy(case).limit(first) if first else found


def candidate_audit(marked: DataFrame, length: int, interval: int, case: str = "caseid", time: str = "timestamp") -> DataFrame:
    """Per case: candidates (at least the history's span after the first row), split into included, gap and no future."""
    kind = F.when(~F.col("has_history"), "gap").when(F.col("target").isNull(), "no_future").otherwise("included")
    late = marked.where(F.col(time) >= F.col("_start") + (length - 1) * interval).withColumn("_kind", kind)
    counts = late.groupBy(case).agg(F.count("*").alias("candidates"), *(F.count(F.when(F.col("_kind") == k, 1)).alias(k) for k in ("included", "gap", "no_future")))
    return counts.withColumn("excluded_pct", 100 * (1 - F.col("included") / F.col("candidates")))


def outlier_cases(audit: DataFrame, value: str = "excluded_pct", top: int = 10) -> DataFrame:
    """Cases above the third quartile + 1.5 interquartile ranges, the largest first."""
    q1, q3 = quantiles(audit, [value], [0.25, 0.75])[value]
    if q1 is None:
        return audit.limit(0)
    return audit.where(F.col(value) > q3 + 1.5 * (q3 - q1)).orderBy(F.desc(value), "caseid").limit(top)


def flatten_lags(df: DataFrame, features: int, lags: int, feature_major: bool = True) -> DataFrame:
    """df with `flat`: all steps of the first feature, then of the next (or all features of the oldest step first), static last."""
    x = F.col("x")
    order = [(l, f) for f in range(features) for l in range(lags)] if feature_major else [(l, f) for l in range(lags) for f in range(features)]
    return df.withColumn("flat", F.concat(F.array(*(F.get(F.get(x, F.lit(l)), F.lit(f)) for l, f in order)), F.col("s")))


def select_features(df: DataFrame, names: list[str], include: list[str] | None = None, exclude: list[str] | None = None) -> tuple[DataFrame, list[str]]:
    """x and mask with some of the features, in the order asked for."""
    if (include is None) == (exclude is None):
        raise ValueError("either include or exclude")
    asked = include if include is not None else exclude
    if not asked or len(set(asked)) != len(asked) or set(asked) - set(names):
        raise ValueError(f"unknown, repeated or no features: {asked}")
    keep = include if include is not None else [n for n in names if n not in exclude]
    at = [names.index(n) for n in keep]
    pick = lambda row: F.array(*(row[i] for i in at))
    return df.withColumns({"x": F.transform("x", pick), "mask": F.transform("mask", pick)}), keep


def padded_history(df: DataFrame, columns: list[str], length: int = 6, case: str = "caseid", time: str = "timestamp") -> DataFrame:
    """df with `history` of the last rows, before the start the first one repeated, and its `present` mask."""
    w = Window.partitionBy(case).orderBy(time).rowsBetween(-(length - 1), 0)
    rows = F.collect_list(F.struct(*columns)).over(w)
    n = length - F.size("_rows")
    return df.withColumn("_rows", rows).withColumns({"history": F.concat(F.array_repeat(F.col("_rows")[0], n), F.col("_rows")), "present": F.concat(F.array_repeat(F.lit(0), n), F.array_repeat(F.lit(1), F.size("_rows")))}).drop("_rows")


def session_history(df: DataFrame, value: str, doses: dict[str, str] | None = None, length: int = 6, interval: int = 10, case: str = "caseid", time: str = "timestamp") -> DataFrame:
    """case, time, `session`, `history` and `present` as the stream gives them, `delta` and doses, for each row.

    A session ends where the next row does not come after exactly the interval; the row that breaks it has no history and
    begins the next one. doses: name -> column of a cumulative dose; <name>_interval is what was given since the row
    before, <name>_recent since the row `length` before, or the session's first where it is younger.
    """
    w = Window.partitionBy(case).orderBy(time)
    broken = F.coalesce(F.col(time) - F.lag(time).over(w) != interval, F.lit(False)).cast("int")
    rows = df.withColumn("_broken", broken).withColumn("session", F.sum("_broken").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    s = Window.partitionBy(case, "session").orderBy(time)
    recent = s.rowsBetween(-(length - 1), 0)
    out = rows.withColumn("_values", F.collect_list(F.col(value).cast("double")).over(recent))
    pad = length - F.size("_values")
    out = out.withColumns({
        "history": F.when(F.col("_broken") == 0, F.concat(F.array_repeat(F.col("_values")[0], pad), F.col("_values"))),
        "present": F.concat(F.array_repeat(F.lit(0), pad), F.array_repeat(F.lit(1), F.size("_values"))),
        "delta": F.col(value) - F.coalesce(F.lag(value).over(s), F.col(value)),
    })
    for name, c in (doses or {}).items():
        # the first row of a frame that reaches `length` rows back is the one to compare with
        out = out.withColumns({f"{name}_interval": F.col(c) - F.coalesce(F.lag(c).over(s), F.col(c)), f"{name}_recent": F.col(c) - F.first(c).over(s.rowsBetween(-length, 0))})
    return out.drop("_broken", "_values")


def split_audit(audit: DataFrame, splits: DataFrame, case: str = "caseid") -> DataFrame:
    """Of candidate_audit(), for each split: counts and what share of its candidates each reason excludes."""
    sums = audit.join(splits, case).groupBy("split").agg(*(F.sum(c).alias(c) for c in ("candidates", "included", "gap", "no_future")))
    return sums.withColumns({f"{c}_pct": 100 * F.col(c) / F.col("candidates") for c in ("gap", "no_future")})

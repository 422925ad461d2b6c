"""Forecast metrics, pooled and per case; ranks over all rows without a single-task sort."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from casewise.operators.contracts import ContractError


def errors(df: DataFrame, observed: str = "observed", predicted: str = "predicted", low: float = 40, high: float = 60) -> DataFrame:
    from casewise.functions import region

    e = F.col(predicted) - F.col(observed)
    return df.withColumns({"error": e, "abs_error": F.abs(e), "sq_error": e * e, "region": region(F.col(observed), low, high), "is_high": (F.col(observed) > high).cast("int"), "is_low": (F.col(observed) < low).cast("int")})


def regression_columns(observed: str = "observed", predicted: str = "predicted") -> list[Column]:
    y, p = F.col(observed), F.col(predicted)
    e = p - y
    spread = F.var_pop(y) * F.count(y)
    r2 = F.when((F.count(y) > 1) & (spread > 0), 1 - F.sum(e * e) / spread)
    return [F.count(y).alias("n"), F.avg(F.abs(e)).alias("mae"), F.sqrt(F.avg(e * e)).alias("rmse"), r2.alias("r2")]


def regression(df: DataFrame, by: list[str] | None = None, observed: str = "observed", predicted: str = "predicted") -> DataFrame:
    return df.groupBy(*(by or [])).agg(*regression_columns(observed, predicted))


def region_columns(observed: str = "observed", predicted: str = "predicted", low: float = 40, high: float = 60) -> list[Column]:
    y, a = F.col(observed), F.abs(F.col(predicted) - F.col(observed))
    return [F.avg(F.when(rule, a)).alias(f"mae_{k}") for k, rule in (("low", y < low), ("mid", y.between(low, high)), ("high", y > high))]


def threshold_columns(label: Column, positive: Column, prefix: str = "") -> list[Column]:
    """F1, sensitivity and specificity at a fixed threshold; a zero denominator gives 0."""
    count = lambda c: F.count(F.when(c, 1))
    tp, fp, fn, tn = count((label == 1) & positive), count((label == 0) & positive), count((label == 1) & ~positive), count((label == 0) & ~positive)
    ratio = lambda a, b: F.when(b > 0, a / b).otherwise(0.0)
    return [ratio(2 * tp, 2 * tp + fp + fn).alias(f"{prefix}f1"), ratio(tp, tp + fn).alias(f"{prefix}sensitivity"), ratio(tn, tn + fp).alias(f"{prefix}specificity")]


def score_levels(df: DataFrame, label: str, score: str, by: list[str] | None = None) -> DataFrame:
    """Per score level: positives and negatives at it (p, n) and at all levels from it upwards (tp, fp), and the totals.

    Within groups (`by`) a window adds up. Over all rows, levels are dealt by ranges of the score, added up inside
    each range, and shifted by what the ranges above hold, one row each.
    """
    by = by or []
    levels = df.where(F.col(label).isNotNull() & F.col(score).isNotNull()).groupBy(*by, score).agg(F.sum(F.col(label).cast("long")).alias("p"), F.sum(1 - F.col(label).cast("long")).alias("n"))
    return summed_levels(levels, score, by)


def summed_levels(levels: DataFrame, score: str, by: list[str] | None = None) -> DataFrame:
    """score_levels() of levels with p and n."""
    if by:
        above = Window.partitionBy(*by).orderBy(F.desc(score)).rowsBetween(Window.unboundedPreceding, 0)
        total = Window.partitionBy(*by)
        return levels.withColumns({"tp": F.sum("p").over(above), "fp": F.sum("n").over(above), "positives": F.sum("p").over(total), "negatives": F.sum("n").over(total)})
    ranges = int(levels.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    borders = levels.agg(F.percentile_approx(score, [k / ranges for k in range(1, ranges)], 1000)).first()[0] or []
    borders = sorted(set(borders))

    def part(low: int = 0, high: int = len(borders)):
        """How many borders are at most the score, by halving."""
        if low == high:
            return F.lit(low)
        mid = (low + high) // 2
        return F.when(F.col(score) < F.lit(borders[mid]), part(low, mid)).otherwise(part(mid + 1, high))

    placed = levels.withColumn("_part", part())
    sums = placed.groupBy("_part").agg(F.sum("p").alias("_p"), F.sum("n").alias("_n"))
    higher = Window.orderBy(F.desc("_part")).rowsBetween(Window.unboundedPreceding, -1)  # one row for each range
    everything = Window.partitionBy()
    shift = sums.select("_part", F.coalesce(F.sum("_p").over(higher), F.lit(0)).alias("_tp"), F.coalesce(F.sum("_n").over(higher), F.lit(0)).alias("_fp"), F.sum("_p").over(everything).alias("positives"), F.sum("_n").over(everything).alias("negatives"))
    inside = Window.partitionBy("_part").orderBy(F.desc(score)).rowsBetween(Window.unboundedPreceding, 0)
    return placed.withColumns({"_a": F.sum("p").over(inside), "_b": F.sum("n").over(inside)}).join(F.broadcast(shift), "_part").select(score, "p", "n", (F.col("_a") + F.col("_tp")).alias("tp"), (F.col("_b") + F.col("_fp")).alias("fp"), "positives", "negatives")


def ranking(levels: DataFrame, by: list[str] | None = None) -> DataFrame:
    """auroc and average precision from score levels; null with one class."""
    good = (F.max("positives") > 0) & (F.max("negatives") > 0)
    area = F.sum(F.col("p") * (F.col("negatives") - F.col("fp") + F.col("n") / 2))  # negatives below, ties by half
    precision = F.col("tp") / (F.col("tp") + F.col("fp"))
    return levels.groupBy(*(by or [])).agg(F.when(good, area / (F.max("positives") * F.max("negatives"))).alias("auroc"), F.when(good, F.sum(F.col("p") * precision) / F.max("positives")).alias("ap"))


def best_threshold(levels: DataFrame, score: str) -> DataFrame:
    """The level with the largest F1, the lowest of equals. ContractError with one class."""
    if not levels.where("positives > 0 and negatives > 0").limit(1).count():
        raise ContractError("a threshold needs both classes")
    f1 = 2 * F.col("tp") / (F.col("tp") + F.col("fp") + F.col("positives"))
    best = levels.where("positives > 0 and negatives > 0").withColumn("f1", f1).agg(F.max(F.struct("f1", (-F.col(score)).alias("t"))).alias("best"))
    return best.select((-F.col("best.t")).alias("threshold"), F.col("best.f1").alias("f1"))


def pooled(df: DataFrame, observed: str = "observed", predicted: str = "predicted", low: float = 40, high: float = 60) -> DataFrame:
    """One row: regression, regions, ranking and thresholds for high and low targets.

    Both rankings come from the same table of score levels.
    """
    marked = errors(df, observed, predicted, low, high)
    one = marked.agg(*regression_columns(observed, predicted), *region_columns(observed, predicted, low, high), *threshold_columns(F.col("is_high"), F.col(predicted) > high, "high_"), *threshold_columns(F.col("is_low"), F.col(predicted) < low, "low_"))
    known = marked.where(F.col("is_high").isNotNull() & F.col(predicted).isNotNull())
    sides = [F.sum(F.col(c).cast("long")).alias(c) for c in ("is_high", "is_low")]
    levels = known.groupBy(predicted).agg(*sides, F.count("*").alias("_all"))

    def side(label: str, sign: int) -> DataFrame:
        return summed_levels(levels.select((sign * F.col(predicted)).alias("_score"), F.col(label).alias("p"), (F.col("_all") - F.col(label)).alias("n")), "_score")

    up = ranking(side("is_high", 1)).toDF("high_auroc", "high_ap")
    down = ranking(side("is_low", -1)).toDF("low_auroc", "low_ap")
    return one.join(F.broadcast(up)).join(F.broadcast(down))  # one row each


def per_case(df: DataFrame, case: str = "case_id", observed: str = "observed", predicted: str = "predicted", low: float = 40, high: float = 60) -> DataFrame:
    marked = errors(df, observed, predicted, low, high)
    main = marked.groupBy(case).agg(*regression_columns(observed, predicted), *region_columns(observed, predicted, low, high))
    return main.join(ranking(score_levels(marked, "is_high", predicted, [case]), [case]).withColumnRenamed("auroc", "high_auroc").withColumnRenamed("ap", "high_ap"), case, "left")


def over_cases(cases: DataFrame, metrics: list[str]) -> DataFrame:
    """Each case counts once: per metric how many define it, mean, median, population std, interquartile range."""
    long = cases.select(*(F.col(m).cast("double").alias(m) for m in metrics)).unpivot([], metrics, "metric", "value")
    v = F.col("value")
    return long.groupBy("metric").agg(F.count(v).alias("cases"), F.avg(v).alias("mean"), F.median(v).alias("median"), F.stddev_pop(v).alias("std"), (F.percentile(v, 0.75) - F.percentile(v, 0.25)).alias("iqr"))


def bias_summary(df: DataFrame, by: list[str] | None = None, observed: str = "observed", predicted: str = "predicted", high: float = 60) -> DataFrame:
    from casewise.functions import pearson

    y, p = F.col(observed), F.col(predicted)
    return df.groupBy(*(by or [])).agg(F.avg(p).alias("mean"), F.stddev_pop(p).alias("std"), F.min(p).alias("min"), F.max(p).alias("max"), pearson(y, p).alias("pearson"), F.avg(p - y).alias("bias"), F.avg(F.when(y > high, p - y)).alias("high_bias"))


def score_with(df: DataFrame, predict, features: str = "flat", column: str = "predicted") -> DataFrame:
    """df with a user model's predictions: an object with MLlib's transform, or a callable from a 2-d array to a 1-d one."""
    import numpy as np

    if hasattr(predict, "transform"):
        return predict.transform(df)

    @F.pandas_udf("double")
    def of(rows):
        return type(rows)(np.asarray(predict(np.stack(rows.to_numpy())), float), index=rows.index)

    return df.withColumn(column, of(features))


def case_diagnostics(df: DataFrame, cases: list, feature_at: list[int], case: str = "case_id") -> DataFrame:
    """For named cases: windows, whether a feature group is never observed, finite predictions, mean error."""
    unseen = F.forall("mask", lambda row: ~F.array_max(F.array(*(row[i].cast("int") for i in feature_at))).cast("boolean"))
    return df.where(F.col(case).isin(cases)).groupBy(case).agg(F.count("*").alias("windows"), F.bool_and(unseen).alias("never_observed"), F.bool_and(~F.isnan("predicted") & F.col("predicted").isNotNull()).alias("finite"), F.avg(F.abs(F.col("predicted") - F.col("y"))).alias("mae"))

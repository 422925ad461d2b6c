"""Compositions of operators: raw tracks to a clean table, a clean table to windows, many runs to contrasts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from casewise.operators import bootstrap, clean, metrics, prep, resample, runs, splits, windows


def clean_table(raw: DataFrame, clinical: DataFrame, signals: list[str], active: Column, value: str = "bis", low: float = 10, high: float = 100, rows: int = 300, fill: int = 10) -> DataFrame:
    """Fill, then quality, crop and length, then the clinical join and labels. The fill comes first: it counts raw rows."""
    filled = clean.bounded_fill(raw, signals, fill)
    kept = clean.minimum_length(clean.crop_active(clean.quality_filter(filled, value, low=low, high=high), active), rows)
    return kept.join(clinical, "caseid", "left").withColumn("inadequate", (F.col(value) > 60).cast("int"))


def window_dataset(grid: DataFrame, features: list[str], target: str, length: int, interval: int, horizon: int, seed: int = 42) -> tuple[DataFrame, DataFrame]:
    """(windows with their split, statistics). The target is kept from before scaling; statistics are those of training cases."""
    marked = windows.endpoints(grid, target, length, interval, horizon)
    split = splits.case_split(windows.eligible_cases(marked), seed)
    rows = grid.join(split, "caseid")
    statistics = prep.fit_scaling(rows.where("split = 'train'"), features)
    scaled = prep.apply_scaling(rows.withColumn("_target", F.col(target)), statistics)
    return windows.windows(scaled, features, "_target", length=length, interval=interval, horizon=horizon).join(split, F.col("case_id") == F.col("caseid")).drop("caseid"), statistics


def persistence(grid: DataFrame, value: str, length: int, interval: int, horizon: int) -> DataFrame:
    """case_id, final_ts, target_ts, observed and predicted, the last value of each window."""
    found = windows.windows(grid, [value], value, length=length, interval=interval, horizon=horizon)
    return found.select("case_id", "final_ts", "target_ts", F.col("y").alias("observed"), F.element_at("x", -1)[0].alias("predicted")).where("predicted is not null")


def persistence_by_split(grid: DataFrame, value: str, length: int, interval: int, horizon: int, seed: int = 42) -> DataFrame:
    """Case-balanced error of the last-value forecast in each split."""
    forecast = persistence(grid, value, length, interval, horizon)
    split = splits.case_split(forecast, seed, case="case_id")
    cases = metrics.regression(forecast, ["case_id"]).join(split, "case_id")
    return cases.groupBy("split").agg(F.count("*").alias("cases"), F.avg("mae").alias("mae_mean"), F.median("mae").alias("mae_median"), F.stddev_pop("mae").alias("mae_std"), F.sum("n").alias("windows"))


def contrasts(cells: DataFrame, condition: str, reference, model: str, seed_column: str, case: str, value: str, replicates: int) -> DataFrame:
    """All contrasts of run tables with their hierarchical bootstrap intervals."""
    paired = bootstrap.all_contrasts(cells, condition, reference, model, [seed_column, case], value)
    return bootstrap.interval(bootstrap.hierarchical_bootstrap(paired, ["contrast"], seed_column, case, "difference", replicates), ["contrast"])


__all__ = ["clean_table", "contrasts", "persistence", "persistence_by_split", "resample", "runs", "window_dataset"]

"""Resampling inference; draws are made where they are used, and each replicate is one row before quantiles."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from casewise.functions import draw, draws
from casewise.operators.order import numbered

#: Cases whose values a task of the case bootstrap holds.
BLOCK = 1 << 22


def interval(replicates: DataFrame, by: list[str], value: str = "value") -> DataFrame:
    v = F.col(value)
    return replicates.groupBy(*by).agg(F.avg(v).alias("mean"), F.percentile(v, 0.025).alias("low"), F.percentile(v, 0.975).alias("high"), F.count("*").alias("replicates"))


def case_bootstrap(cases: DataFrame, value: str, key: str, replicates: int, seed: int = 42) -> DataFrame:
    """(replicate, value): means of n cases drawn with replacement, nulls left out. cases: one row for each case.

    A task gets some replicates and the values of at most BLOCK cases, and adds up what its replicates draw of these.
    Draws, as draw() makes them from the seed, the replicate and the place, are never rows: with more than BLOCK cases
    each block's tasks make them anew.
    """
    placed = numbered(cases.select(key, F.col(value).cast("double").alias("_v")), [key], "_i")
    n = cases.count()
    groups = min(replicates, max(64, 4 * cases.sparkSession.sparkContext.defaultParallelism))
    blocks = placed.groupBy(F.floor(F.col("_i") / BLOCK).alias("_block")).agg(F.transform(F.array_sort(F.collect_list(F.struct("_i", "_v"))), lambda x: x["_v"]).alias("_values"))
    # a piece keeps its nulls apart from NaN, which makes a mean NaN
    pieces = blocks.select("_block", F.transform("_values", lambda v: F.coalesce(v, F.lit(0.0))).alias("_values"), F.transform("_values", lambda v: v.isNotNull()).alias("_held"), F.explode(F.sequence(F.lit(0), F.lit(groups - 1))).alias("_group"))

    def add_up(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in batches:
            for block, values, held, group in zip(frame["_block"], frame["_values"], frame["_held"], frame["_group"], strict=True):
                values, held, low, out = np.asarray(values, float), np.asarray(held, bool), int(block) * BLOCK, []
                for replicate in range(int(group), replicates, groups):
                    total, count = 0.0, 0
                    for drawn in draws(f"{seed}:{replicate}:", n):
                        at = (drawn % np.uint32(n)).astype(np.int64) - low
                        if n > BLOCK:
                            at = at[(at >= 0) & (at < len(values))]
                        total, count = total + values[at].sum(), count + int(held[at].sum())
                    out.append((replicate, total, count))
                yield pd.DataFrame(out, columns=["replicate", "_sum", "_n"])

    dealt = pieces.repartition(groups, "_group", "_block")
    sums = dealt.mapInPandas(add_up, "replicate long, _sum double, _n long").groupBy("replicate").agg(F.sum("_sum").alias("_sum"), F.sum("_n").alias("_n"))
    return sums.select("replicate", F.when(F.col("_n") > 0, F.col("_sum") / F.col("_n")).alias("value"))


def hierarchical_bootstrap(cells: DataFrame, contrast: list[str], seed_column: str, case: str, value: str, replicates: int, seed: int = 42, cells_mean: bool = False) -> DataFrame:
    """(contrast, replicate, value): seeds drawn with replacement, then cases in each drawn seed; mean of seed means, or
    with cells_mean the mean of all drawn cells.

    What `case` names (cases, scenarios) is drawn within a seed; `contrast` may hold a metric's name among its columns.

    cells: one row for each contrast, seed and case; each seed of a contrast holds the same cases. Draws are keyed by
    contrast, replicate, and the places of seed and case, so that all contrasts are one job.
    """
    seeds = cells.select(*contrast, seed_column).distinct().withColumn("_s", F.row_number().over(Window.partitionBy(*contrast).orderBy(seed_column)) - 1)
    at = cells.withColumn("_c", F.row_number().over(Window.partitionBy(*contrast, seed_column).orderBy(case)) - 1).join(seeds, [*contrast, seed_column])
    at = at.select(*contrast, "_s", "_c", F.col(value).alias("_v"))
    sizes = at.groupBy(*contrast).agg((F.max("_s") + 1).alias("_ns"), (F.max("_c") + 1).alias("_nc"))
    name = F.concat_ws("|", *(F.col(c).cast("string") for c in contrast))
    slots = sizes.select(*contrast, "_ns", "_nc", F.explode(F.sequence(F.lit(0), F.lit(replicates - 1))).alias("replicate"))
    slots = slots.select("*", F.explode(F.sequence(F.lit(0), F.col("_ns") - 1)).alias("_slot")).withColumn("_s", (draw(seed, name, "s", F.col("replicate"), F.col("_slot")) % F.col("_ns")).cast("int"))
    # replicates are dealt before their cases are drawn, else all draws of a contrast would be made where its sizes are
    dealt = slots.repartition(int(cells.sparkSession.conf.get("spark.sql.shuffle.partitions")), *contrast, "replicate")
    picks = dealt.select("*", F.explode(F.sequence(F.lit(0), F.col("_nc") - 1)).alias("_place")).withColumn("_c", (draw(seed, name, "c", F.col("replicate"), F.col("_slot"), F.col("_place")) % F.col("_nc")).cast("int"))
    drawn = picks.join(at, [*contrast, "_s", "_c"])
    if cells_mean:
        return drawn.groupBy(*contrast, "replicate").agg(F.avg("_v").alias("value"))
    per_slot = drawn.groupBy(*contrast, "replicate", "_slot").agg(F.avg("_v").alias("_m"))
    return per_slot.groupBy(*contrast, "replicate").agg(F.avg("_m").alias("value"))


def all_contrasts(runs: DataFrame, condition: str, reference, model: str, keys: list[str], value: str) -> DataFrame:
    """contrast, keys, difference: every condition against the reference per model, and every pair of models per condition."""
    a = runs.select(condition, model, *keys, F.col(value).alias("_a"))
    base = runs.where(F.col(condition) == reference).select(model, *keys, F.col(value).alias("_b"))
    one = a.where(F.col(condition) != reference).join(base, [model, *keys]).select(F.concat_ws("|", F.lit("condition"), condition, model).alias("contrast"), *keys, (F.col("_a") - F.col("_b")).alias("difference"))
    other = runs.select(condition, F.col(model).alias("_m"), *keys, F.col(value).alias("_b"))
    two = a.join(other, [condition, *keys]).where(F.col(model) < F.col("_m")).select(F.concat_ws("|", F.lit("model"), condition, model, "_m").alias("contrast"), *keys, (F.col("_a") - F.col("_b")).alias("difference"))
    return one.unionByName(two)

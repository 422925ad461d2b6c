"""Case-level splits, folds, draws and weights; all draws follow from a seed and ids alone."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from casewise.functions import draw
from casewise.operators.contracts import ContractError
from casewise.operators.order import numbered


def split_counts(n: int, shares: tuple[float, ...] = (0.70, 0.15, 0.15)) -> list[int]:
    """Whole counts by largest remainder; none is 0 if there are enough cases."""
    exact = [n * s for s in shares]
    out = [int(x) for x in exact]
    for k in sorted(range(len(shares)), key=lambda k: (out[k] - exact[k], k))[: n - sum(out)]:
        out[k] += 1
    if n >= len(shares):
        while 0 in out:
            out[out.index(max(out))] -= 1
            out[out.index(0)] += 1
    return out


def ordered_cases(df: DataFrame, seed: int, case: str = "caseid") -> DataFrame:
    """Distinct cases with their place `nth` (from 1) in a seeded order."""
    cases = df.select(case).where(F.col(case).isNotNull()).distinct().withColumn("_draw", draw(seed, F.col(case)))
    return numbered(cases, ["_draw", case], "nth").select(case, (F.col("nth") + 1).alias("nth"))


def case_split(df: DataFrame, seed: int = 42, names: tuple[str, ...] = ("train", "val", "test"), shares: tuple[float, ...] = (0.70, 0.15, 0.15), case: str = "caseid") -> DataFrame:
    """(case, split)."""
    placed = ordered_cases(df, seed, case)
    sizes, split, upto = split_counts(placed.count(), shares), F.lit(names[-1]), 0
    for name, size in reversed(list(zip(names, [sum(sizes[: k + 1]) for k in range(len(sizes))], strict=True))):
        split = F.when(F.col("nth") <= size, name).otherwise(split)
    return placed.select(case, split.alias("split"))


def split_faults(splits: DataFrame, wanted: DataFrame, case: str = "caseid") -> DataFrame:
    """case and fault: in several splits, in none, or not asked for."""
    several = splits.groupBy(case).agg(F.count_distinct("split").alias("_n")).where("_n > 1").select(case, F.lit("several").alias("fault"))
    none = wanted.select(case).distinct().join(splits, case, "left_anti").select(case, F.lit("uncovered").alias("fault"))
    extra = splits.select(case).distinct().join(wanted, case, "left_anti").select(case, F.lit("unexpected").alias("fault"))
    return several.unionByName(none).unionByName(extra)


def require_split(splits: DataFrame, wanted: DataFrame, case: str = "caseid") -> DataFrame:
    found = split_faults(splits, wanted, case).limit(3).collect()
    if found:
        raise ContractError(f"split faults: {found}")
    return splits


def folds(df: DataFrame, n: int, seed: int = 42, case: str = "caseid") -> DataFrame:
    """(case, fold): n near-equal groups of cases in seeded order, the first ones with one more where they differ."""
    cases = df.select(case).distinct().withColumn("_draw", draw(seed, F.col(case)))
    size, more = divmod(cases.count(), n)
    at, long = F.col("_i"), more * (size + 1)
    fold = F.when(at < long, F.floor(at / (size + 1))).otherwise(more + F.floor((at - long) / max(size, 1)))
    return numbered(cases, ["_draw", case], "_i").select(case, fold.cast("int").alias("fold"))


def balanced_folds(df: DataFrame, n: int, case: str = "caseid") -> DataFrame:
    """(case, rows, fold): cases from the largest down, dealt back and forth, so that folds have similar row counts."""
    sizes = numbered(df.groupBy(case).agg(F.count("*").alias("rows")).withColumn("_less", -F.col("rows")), [case], "_i", levels=["_less"])
    turn, place = F.floor(F.col("_i") / n), F.col("_i") % n
    return sizes.select(case, "rows", F.when(turn % 2 == 0, place).otherwise(n - 1 - place).cast("int").alias("fold"))


def subsample(df: DataFrame, fraction: float, runs: int, seed: int = 42, case: str = "caseid") -> DataFrame:
    """(run, case, chosen): round(n * fraction) cases of each run, at least 1 and at most n - 1."""
    cases = df.select(case).distinct()
    spread = cases.withColumn("run", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(runs - 1).cast("long"))))
    n = cases.count()
    # halves are rounded up, as SQL does
    wanted = max(1, min(n - 1, int(n * fraction + 0.5)))
    placed = numbered(spread.withColumn("_draw", draw(seed, F.col("run"), F.col(case))), ["_draw", case], "_i", by=["run"])
    return placed.select("run", case, (F.col("_i") < wanted).alias("chosen"))


def multiplicities(df: DataFrame, replicates: int, seed: int = 42, case: str = "caseid") -> DataFrame:
    """(replicate, case, copies): n draws with replacement from n cases for each replicate."""
    cases = df.select(case).distinct()
    placed = numbered(cases, [case], "_i")
    n = cases.count()
    draws = cases.sparkSession.range(replicates * n).select(F.floor(F.col("id") / n).alias("replicate"), (F.col("id") % n).alias("_d"))
    drawn = draws.withColumn("_i", draw(seed, F.col("replicate"), F.col("_d")) % n).groupBy("replicate", "_i").agg(F.count("*").alias("copies"))
    return drawn.join(placed, "_i").select("replicate", case, "copies")


def case_weights(df: DataFrame, copies: str | None = None, case: str = "case_id") -> DataFrame:
    """df with `weight`: equal in all for each case (times its copies), scaled so that weights sum to the row count."""
    raw = (F.col(copies) if copies else F.lit(1.0)) / F.count("*").over(Window.partitionBy(case))
    total = df.select(raw.alias("_w")).agg(F.count("*").alias("_n"), F.sum("_w").alias("_t"))
    return df.withColumn("_raw", raw).join(F.broadcast(total)).withColumn("weight", F.col("_raw") * F.col("_n") / F.col("_t")).drop("_raw", "_n", "_t")  # one row


def balanced_draws(df: DataFrame, draws: int, key: str, seed: int = 42, case: str = "case_id") -> DataFrame:
    """(draw, case, key): a case uniformly, then one of its rows uniformly."""
    cases = df.groupBy(case).agg(F.count("*").alias("_n"))
    placed = numbered(cases, [case], "_c")
    count = cases.count()
    wanted = df.sparkSession.range(draws).select(F.col("id").alias("draw"), (draw(seed, "case", F.col("id")) % count).alias("_c"))
    picked = wanted.join(placed, "_c").withColumn("_r", draw(seed, "row", F.col("draw")) % F.col("_n"))
    rows = df.select(case, key, (F.row_number().over(Window.partitionBy(case).orderBy(key)) - 1).alias("_r"))
    return picked.join(rows, [case, "_r"]).select("draw", case, key)


def first_cases(df: DataFrame, n: int, case: str = "caseid") -> DataFrame:
    return df.join(df.select(case).distinct().orderBy(case).limit(n), case, "left_semi")

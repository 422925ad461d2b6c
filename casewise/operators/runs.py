"""Tables over many runs: aggregates, Pareto sets, rule classes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from casewise.functions import once
from casewise.operators.order import least_before

#: Fixed value: the 97.5 % point of Student's t with 4 degrees of freedom (five seeds).
T4 = 2.776445105


def case_errors(df: DataFrame, run: list[str], case: str, error: Column) -> DataFrame:
    """Mean absolute error and rows by run and case."""
    return df.groupBy(*run, case).agg(F.avg(F.abs(error)).alias("mae"), F.count("*").alias("windows"))


def run_means(cases: DataFrame, run: list[str]) -> DataFrame:
    """Each case counts once."""
    return cases.groupBy(*run).agg(F.avg("mae").alias("case_mae"), F.count("*").alias("cases"))


def over_seeds(runs: DataFrame, by: list[str], metric: str, t: float = T4, epoch: str | None = None) -> DataFrame:
    """Summary of a metric over seeds with its t interval; with `epoch`, also the mean of the best epochs."""
    v = F.col(metric)
    epochs = [F.avg(epoch).alias("mean_best_epoch")] if epoch else []
    se = F.stddev_samp(v) / F.sqrt(F.count(v))
    return runs.groupBy(*by).agg(F.count(v).alias("seeds"), F.avg(v).alias("mean"), F.stddev_samp(v).alias("std"), F.median(v).alias("median"), F.min(v).alias("min"), F.max(v).alias("max"), se.alias("se"), (F.avg(v) - t * se).alias("low"), (F.avg(v) + t * se).alias("high"), *epochs)


def metric_summaries(runs: DataFrame, by: list[str], metrics: list[str]) -> DataFrame:
    """Long: mean, sample std (0 for one), min and max per group and metric."""
    long = runs.select(*by, *(F.col(m).cast("double").alias(m) for m in metrics)).unpivot(by, metrics, "metric", "value")
    return long.groupBy(*by, "metric").agg(F.avg("value").alias("mean"), F.coalesce(F.stddev_samp("value"), F.lit(0.0)).alias("std"), F.min("value").alias("min"), F.max("value").alias("max"))


def run_summary(history: DataFrame, run: list[str], epoch: str, metric: str, planned: int) -> DataFrame:
    """Best epoch (the first with the least metric), its metric, last epoch and whether the run stopped before `planned`."""
    best = F.min(F.struct(F.col(metric), F.col(epoch)))
    return history.groupBy(*run).agg(best.alias("_b"), F.max(epoch).alias("last_epoch")).select(*run, F.col(f"_b.{epoch}").alias("best_epoch"), F.col(f"_b.{metric}").alias("best"), "last_epoch", (F.col("last_epoch") < planned).alias("stopped_early"))


def against_row(candidates: DataFrame, name: str, reference, metrics: list[str]) -> DataFrame:
    """Each candidate minus the reference candidate's row; null if that is absent."""
    base = candidates.where(F.col(name) == reference).agg(*(F.max(m).alias(f"_r_{m}") for m in metrics))
    return candidates.join(F.broadcast(base)).select(*candidates.columns, *((F.col(m) - F.col(f"_r_{m}")).alias(f"delta_{m}") for m in metrics))  # one row


def front(candidates: DataFrame, group: str, cost: str, error: str) -> DataFrame:
    """candidates with `on_front`: no other of the group is no worse in both and better in one.

    A cost's least error is compared with the least of all lower costs, which comes by ranges of the cost.
    """
    levels = candidates.groupBy(group, cost).agg(F.min(error).alias("_own"))
    below = least_before(levels, cost, "_own", "_cheaper", [group])
    beaten = (F.col(error) > F.col("_own")) | F.coalesce(F.col("_cheaper") <= F.col(error), F.lit(False))
    return candidates.join(below, [group, cost]).select(*candidates.columns, (~beaten).alias("on_front"))


def pareto(candidates: DataFrame, group: str, name: str, cost: str, error: str) -> DataFrame:
    """Candidates with those that dominate them: no worse in both, better in one; and flags for best and simplest.

    Only candidates off the front are set against others, since only they have dominators to list. All branches compare
    the same values, so that candidates are evaluated one time.
    """
    candidates = once(candidates.select(group, name, cost, error))
    marked = front(candidates, group, cost, error)
    other = candidates.select(F.col(group).alias("_g"), F.col(name).alias("_o"), F.col(cost).alias("_c"), F.col(error).alias("_e"))
    beats = (F.col("_g") == F.col(group)) & (F.col("_c") <= F.col(cost)) & (F.col("_e") <= F.col(error)) & ((F.col("_c") < F.col(cost)) | (F.col("_e") < F.col(error)))
    lists = marked.where("not on_front").join(other, beats).groupBy(group, name, cost, error).agg(F.array_sort(F.collect_set("_o")).alias("dominators"))
    off = lists.select(group, name, cost, error, "dominators", F.lit(False).alias("on_front"))
    front_ = marked.where("on_front").select(group, name, cost, error, F.array().cast("array<string>").alias("dominators"), "on_front").unionByName(off)
    least = marked.where("on_front").groupBy(group).agg(F.min(error).alias("_best"), F.min(cost).alias("_least"))
    return front_.join(least, group).withColumns({"is_best": F.col("on_front") & (F.col(error) == F.col("_best")), "is_simplest": F.col("on_front") & (F.col(cost) == F.col("_least"))}).drop("_best", "_least")



def case_stability(deltas: DataFrame, case: str, delta: str = "difference") -> DataFrame:
    """Per case over seeds: mean, sample std, seeds won, range, sign change, and whether it is sensitive."""
    d = F.col(delta)
    out = deltas.groupBy(case).agg(F.avg(d).alias("mean"), F.stddev_samp(d).alias("std"), F.count(F.when(d < 0, 1)).alias("won"), F.count("*").alias("seeds"), F.min(d).alias("min"), F.max(d).alias("max"))
    change = (F.col("min") < 0) & (F.col("max") > 0)
    return out.withColumns({"sign_change": change, "sensitive": F.coalesce(F.col("std") > 0.2, F.lit(False)) | change})


def extremes(df: DataFrame, value: str, key: str, most: int = 5, by: list[str] | None = None) -> DataFrame:
    """df with `side` and `place`: the `most` lowest rows (best) and highest (worst) of a value, equal ones by key.

    Taken by a running top list, so that no task sorts all rows of a group that is the whole table.
    """
    if by:
        at = lambda order: F.row_number().over(Window.partitionBy(*by).orderBy(order, key))
        low = df.withColumn("place", at(F.asc(value))).where(F.col("place") <= most).withColumn("side", F.lit("best"))
        return low.unionByName(df.withColumn("place", at(F.desc(value))).where(F.col("place") <= most).withColumn("side", F.lit("worst")))
    out = None
    for side, order in (("best", F.asc(value)), ("worst", F.desc(value))):
        top = df.orderBy(order, key).limit(most)
        one = top.withColumn("place", F.row_number().over(Window.orderBy(order, key))).withColumn("side", F.lit(side))  # `most` rows
        out = one if out is None else out.unionByName(one)
    return out


def learning_curve(df: DataFrame, by: list[str], step: str, metrics: list[str]) -> DataFrame:
    """by, step, runs and <metric>_mean and <metric>_std (sample) of each metric."""
    return df.groupBy(*by, step).agg(F.count("*").alias("runs"), *(x for m in metrics for x in (F.avg(m).alias(f"{m}_mean"), F.stddev_samp(m).alias(f"{m}_std"))))


def evidence(aggregate: DataFrame, front_: DataFrame, contrasts: DataFrame, keys: list[str]) -> DataFrame:
    """Aggregates with their place on the front and their contrast to the reference (null for the reference itself).

    Each table has one row for each key; another number is an error.
    """
    from casewise.operators.contracts import key_unique_join

    both = key_unique_join(aggregate, front_.select(*keys, *(c for c in front_.columns if c not in aggregate.columns)), keys)
    return key_unique_join(both, contrasts, keys, how="left")


def result_class(mean: Column, won_seeds: Column, seeds: Column, won_cases: Column, cases: Column) -> Column:
    """A: better on average, in all seeds and in most cases; B: better on average and in most seeds; else C."""
    return F.when((mean < 0) & (won_seeds == seeds) & (won_cases * 2 > cases), "A").when((mean < 0) & (won_seeds * 2 > seeds), "B").otherwise("C")


def bias_label(bias: Column, tolerance: float = 1.0) -> Column:
    return F.when(bias < -tolerance, "under").when(bias > tolerance, "over").otherwise("balanced")


def checkpoint_trend(df: DataFrame, by: list[str], step: str, early, late, metric: str, tolerance: float = 0.05, lower_is_better: bool = True) -> DataFrame:
    """Late minus early and its class: improving, worsening or plateau (within a share of the early value)."""
    at = lambda s: F.max(F.when(F.col(step) == s, F.col(metric)))
    wide = df.groupBy(*by).agg(at(early).alias("early"), at(late).alias("late")).where("early is not null and late is not null")
    d = F.col("late") - F.col("early")
    gain = -d if lower_is_better else d
    trend = F.when(gain > tolerance * F.abs(F.col("early")), "improving").when(gain < -tolerance * F.abs(F.col("early")), "worsening").otherwise("plateau")
    return wide.withColumns({"change": d, "trend": trend})


def difference_summary(df: DataFrame, by: list[str], difference: str, lower_is_better: bool = True) -> DataFrame:
    d = F.col(difference)
    up, down = F.count(F.when(d > 0, 1)), F.count(F.when(d < 0, 1))
    return df.groupBy(*by).agg(F.avg(d).alias("mean"), F.median(d).alias("median"), F.percentile(d, 0.025).alias("low"), F.percentile(d, 0.975).alias("high"), (down if lower_is_better else up).alias("improved"), (up if lower_is_better else down).alias("worsened"), F.count(F.when(d == 0, 1)).alias("tied"))


def subgroup_summary(df: DataFrame, bands: dict[str, Column], by: list[str], value: str) -> DataFrame:
    """Each banding in turn: count, mean and sample std of a value by band."""
    long = df.select(*by, value, *(c.alias(k) for k, c in bands.items())).unpivot([*by, value], list(bands), "grouping", "band")
    return long.where("band is not null").groupBy(*by, "grouping", "band").agg(F.count(value).alias("n"), F.avg(value).alias("mean"), F.stddev_samp(value).alias("std"))


def across_seeds(df: DataFrame, by: list[str], seed: str, difference: str, direction: str) -> DataFrame:
    """direction: a column, -1 where lower is better and 1 where higher is. Seeds that improve, best and worst seed."""
    gain = F.col(difference) * F.col(direction)
    return df.groupBy(*by).agg(F.avg(difference).alias("mean"), F.stddev_samp(difference).alias("std"), F.count(F.when(gain > 0, 1)).alias("improved"), F.max(F.struct(gain.alias("g"), (-F.col(seed)).alias("s"))).alias("_b"), F.min(F.struct(gain.alias("g"), F.col(seed).alias("s"))).alias("_w")).select(*by, "mean", "std", "improved", (-F.col("_b.s")).alias("best_seed"), F.col("_w.s").alias("worst_seed"))


def subset_bias(df: DataFrame, by: list[str], seed: str, observed: str, predicted: str, above: float = 60) -> DataFrame:
    """Bias on targets above a value: per group, mean over seeds and whether it is negative in every seed."""
    per = df.where(F.col(observed) > above).groupBy(*by, seed).agg(F.avg(observed).alias("observed"), F.avg(predicted).alias("predicted"))
    b = F.col("predicted") - F.col("observed")
    return per.groupBy(*by).agg(F.count("*").alias("seeds"), F.avg("observed").alias("observed"), F.avg("predicted").alias("predicted"), F.avg(b).alias("bias"), F.bool_and(b < 0).alias("always_under"))


def better_on_subset(df: DataFrame, by: list[str], seed: str, observed: str, predicted: str, baseline: str, above: float = 60) -> DataFrame:
    """Mean absolute error on targets above a value against a baseline forecast: mean difference over seeds, and seeds where it is lower."""
    error = lambda c: F.avg(F.abs(F.col(c) - F.col(observed)))
    per = df.where(F.col(observed) > above).groupBy(*by, seed).agg((error(predicted) - error(baseline)).alias("_d"))
    return per.groupBy(*by).agg(F.count("*").alias("seeds"), F.avg("_d").alias("difference"), F.count(F.when(F.col("_d") < 0, 1)).alias("better"))


def collect_runs(planned: DataFrame, status: DataFrame, results: DataFrame, run: list[str], state: str = "status") -> DataFrame:
    """Planned runs with their results and an outcome: done, failed, incomplete (no results) or pending (no status).

    status and results have one row for each run at most; run columns come from file paths or from the rows.
    """
    from casewise.operators.contracts import require_unique

    for df in (planned, status, results):
        require_unique(df, run)
    marked = planned.join(status, run, "left").join(results.withColumn("_r", F.lit(1)), run, "left")
    outcome = F.when(F.col(state).isNull(), "pending").when(F.col(state) == "failed", "failed").when(F.col("_r").isNull(), "incomplete").otherwise("done")
    return marked.withColumn("outcome", outcome).drop("_r")


def collect_nested(planned: DataFrame, completions: DataFrame, statuses: DataFrame, best: DataFrame, validation: DataFrame, run: list[str], means: dict[str, Column], seal: str = "test_cohort_accessed", protocol: str = "protocol_hash") -> tuple[DataFrame, DataFrame]:
    """Planned runs with what their result files hold, and a table of those that failed or are pending.

    A run with a completion file is complete: it must name the plan's protocol, say that the sealed cohort was not read,
    and have one best checkpoint and validation rows, of which `means` are aggregates. Others are failed if their status
    says so, with its exception, else pending. Raises ContractError where a complete run breaks a rule or none is
    complete.
    """
    from casewise.operators.contracts import ContractError, require_unique

    for df in (planned, completions, statuses, best):
        require_unique(df, run)
    done = completions.select(*run, F.col(protocol).alias("_protocol"), F.col(seal).alias("_seal"), F.lit(True).alias("_complete"))
    summary = validation.groupBy(*run).agg(F.count("*").alias("validation_rows"), *(v.alias(k) for k, v in means.items()))
    chosen = best.select(*run, *(F.col(c) for c in best.columns if c not in run), F.lit(True).alias("_best"))
    complete = planned.join(done, run).join(chosen, run, "left").join(summary, run, "left")
    rules = {"another protocol": ~F.col("_protocol").eqNullSafe(F.col(protocol)), "the seal is not explicit": ~F.col("_seal").eqNullSafe(F.lit(False)), "no best checkpoint": F.col("_best").isNull(), "no validation rows": F.col("validation_rows").isNull()}
    counts = complete.agg(F.count("*").alias("complete"), *(F.count(F.when(v, 1)).alias(k) for k, v in rules.items())).first().asDict()
    if not counts["complete"] or any(counts[k] for k in rules):
        raise ContractError(f"complete runs and those that break a rule: {counts}")
    open_ = planned.join(done.select(*run), run, "left_anti").join(statuses, run, "left")
    failed = F.coalesce(F.col("status") == "failed", F.lit(False))
    rest = open_.select(*run, F.when(failed, "failed").otherwise("pending").alias("outcome"), *(F.when(failed, F.col(c)).alias(c) for c in statuses.columns if c not in (*run, "status")))
    return complete.drop("_protocol", "_seal", "_complete", "_best"), rest

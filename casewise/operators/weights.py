"""Perturbation of windows, and analytics of long weight tables (run, sample, case, lag, feature, weight, observed)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from casewise.operators.contracts import ContractError
from casewise.functions import mid_rank, pearson


def ablate(df: DataFrame, at: list[int]) -> DataFrame:
    """x and mask of some features set to 0 and false in every step."""
    gone = F.array(*map(F.lit, at))
    zero = lambda row, value: F.transform(row, lambda v, i: F.when(F.array_contains(gone, i), value).otherwise(v))
    return df.withColumns({"x": F.transform("x", lambda r: zero(r, F.lit(0.0))), "mask": F.transform("mask", lambda r: zero(r, F.lit(False)))})


def circular_shift(df: DataFrame, columns: list[str], seed: int, repeat: int, case: str = "case_id", time: str = "final_ts") -> DataFrame:
    """Columns moved around inside their case by a shift that follows from seed, repeat and case; single rows stay."""
    w = Window.partitionBy(case)
    placed = df.withColumns({"_i": F.row_number().over(w.orderBy(time)) - 1, "_n": F.count("*").over(w)})
    shift = F.when(F.col("_n") > 1, 1 + F.pmod(F.lit(seed) * 31 + F.lit(repeat) * 17 + F.col(case), F.col("_n") - 1)).otherwise(0)
    from_ = placed.select(F.col(case).alias("_case"), F.col("_i").alias("_j"), *(F.col(c).alias(f"_new_{c}") for c in columns))
    moved = placed.withColumn("_from", F.pmod(F.col("_i") - shift, F.col("_n"))).join(from_, (F.col(case) == F.col("_case")) & (F.col("_from") == F.col("_j")))
    return moved.select(*(F.col(f"_new_{c}").alias(c) if c in columns else F.col(c) for c in df.columns))


def delta_metrics(perturbed: DataFrame, original: DataFrame, keys: list[str], metrics: list[str]) -> DataFrame:
    base = original.select(*keys, *(F.col(m).alias(f"_o_{m}") for m in metrics))
    return perturbed.join(base, keys).select(*keys, *((F.col(m) - F.col(f"_o_{m}")).alias(f"delta_{m}") for m in metrics))


def pairwise_vectors(df: DataFrame, by: list[str], run: str, item: str, value: str, top: int = 5) -> DataFrame:
    """For each pair of runs in a group: Spearman (ordinal ranks), Pearson, cosine, Jaccard and overlap of the top items."""
    order = Window.partitionBy(*by, run).orderBy(F.desc(value), item)
    ranked = df.select(*by, F.col(run).alias("a"), item, F.col(value).alias("va"), F.row_number().over(order).alias("ra"))
    other = ranked.toDF(*by, "b", item, "vb", "rb")
    both = ranked.join(other, [*by, item]).where("a < b")
    hits = F.count(F.when((F.col("ra") <= top) & (F.col("rb") <= top), 1))
    either = F.count(F.when((F.col("ra") <= top) | (F.col("rb") <= top), 1))
    va, vb = F.col("va"), F.col("vb")
    return both.groupBy(*by, "a", "b").agg(pearson(F.col("ra").cast("double"), F.col("rb").cast("double")).alias("spearman"), pearson(va, vb).alias("pearson"), (F.sum(va * vb) / F.sqrt(F.sum(va * va) * F.sum(vb * vb))).alias("cosine"), (hits / either).alias("jaccard"), hits.alias("overlap"))


def contribution_stability(df: DataFrame, by: list[str], seed: str, item: str, delta: str, least: int = 4, noise: float = 1e-6) -> DataFrame:
    """Per item over seeds: mean, sample std, seeds with a positive delta, range of average-tie ranks.

    `agreement` is the mean Spearman of all pairs of seeds of a group. An item is stable if its delta is positive in
    `least` seeds and its mean is above `noise`.
    """
    ranked = df.withColumn("_rank", mid_rank([*by, seed], delta, True))
    items = ranked.groupBy(*by, item).agg(F.avg(delta).alias("mean"), F.stddev_samp(delta).alias("std"), F.count(F.when(F.col(delta) > 0, 1)).alias("positive"), F.min("_rank").alias("rank_min"), F.max("_rank").alias("rank_max"))
    mine, theirs = ranked.select(*by, item, F.col(seed).alias("_a"), F.col("_rank").alias("_ra")), ranked.select(*by, item, F.col(seed).alias("_b"), F.col("_rank").alias("_rb"))
    pairs = mine.join(theirs, [*by, item]).where("_a < _b").groupBy(*by, "_a", "_b").agg(pearson(F.col("_ra"), F.col("_rb")).alias("_s"))
    agreement = pairs.groupBy(*by).agg(F.avg("_s").alias("agreement"))
    joined = items.join(agreement, by, "left") if by else items.join(F.broadcast(agreement))  # one row
    return joined.withColumn("stable", (F.col("positive") >= least) & (F.col("mean") > noise))


def contribution_agreement(df: DataFrame, by: list[str], seed: str, item: str, weight: str, delta: str, tops: tuple[int, ...] = (5, 10)) -> DataFrame:
    """For each seed: Spearman (average ties) of weights and contributions, overlap and Jaccard of their top items.

    Equal values are taken by item. Mean, sample std and count of positive correlations over the seeds of a group
    stand beside each.
    """
    df = df.where(F.col(weight).isNotNull() & F.col(delta).isNotNull())
    place = lambda c: F.row_number().over(Window.partitionBy(*by, seed).orderBy(F.desc(c), item))
    ranked = df.withColumns({"_w": mid_rank([*by, seed], weight), "_d": mid_rank([*by, seed], delta), "_pw": place(weight), "_pd": place(delta)})
    parts = [pearson(F.col("_w"), F.col("_d")).alias("spearman")]
    for k in tops:
        both = F.count(F.when((F.col("_pw") <= k) & (F.col("_pd") <= k), 1))
        either = F.count(F.when((F.col("_pw") <= k) | (F.col("_pd") <= k), 1))
        parts += [both.alias(f"overlap_{k}"), (both / either).alias(f"jaccard_{k}")]
    group = Window.partitionBy(*by)  # one row for each seed
    s = F.col("spearman")
    return ranked.groupBy(*by, seed).agg(*parts).withColumns({"mean": F.avg(s).over(group), "std": F.stddev_samp(s).over(group), "positive": F.count(F.when(s > 0, 1)).over(group)})


def normalization_audit(df: DataFrame, keys: list[str], weight: str = "weight", observed: str = "observed", tolerance: float = 1e-5) -> DataFrame:
    per = df.groupBy(*keys).agg(F.sum(weight).alias("_s"), F.min(weight).alias("_m"), F.sum(F.when(~F.col(observed) & (F.col(weight) != 0), 1).otherwise(0)).alias("_u"))
    return per.agg(F.count("*").alias("vectors"), F.min("_m").alias("least"), F.count(F.when(F.abs(F.col("_s") - 1) > tolerance, 1)).alias("not_one"), F.sum("_u").alias("weight_on_unobserved"))


def normalized_entropy(df: DataFrame, keys: list[str], weight: str = "weight", observed: str = "observed") -> DataFrame:
    """Entropy over the log of the observed count; 0 for one. ContractError if a vector has none observed."""
    if df.groupBy(*keys).agg(F.max(F.col(observed).cast("int")).alias("_o")).where("coalesce(_o, 0) = 0").limit(1).count():
        raise ContractError("the entropy of a vector with nothing observed is not defined")
    w = F.col(weight)
    n = F.count(F.when(F.col(observed), 1))
    total = F.sum(F.when(F.col(observed) & (w > 0), -w * F.ln(w)).otherwise(0.0))
    return df.groupBy(*keys).agg(n.alias("observed"), F.when(n > 1, total / F.ln(n)).when(n == 1, 0.0).alias("entropy"))


def concentration(df: DataFrame, keys: list[str], item: str, weight: str = "weight") -> DataFrame:
    at = F.row_number().over(Window.partitionBy(*keys).orderBy(F.desc(weight), item))
    top = lambda k: F.sum(F.when(F.col("_at") <= k, F.col(weight)).otherwise(0.0)).alias(f"top{k}")
    return df.withColumn("_at", at).groupBy(*keys).agg(top(1), top(3), top(5))


def concentration_summary(top: DataFrame, collapse: float = 0.8) -> DataFrame:
    v = F.col("top1")
    return top.agg(F.count("*").alias("vectors"), *(F.percentile(v, q).alias(f"q{int(100 * q)}") for q in (0.25, 0.5, 0.75)), *(F.avg((v > t).cast("double")).alias(f"over_{int(100 * t)}") for t in (0.5, 0.75, 0.9)), (F.avg((v > 0.9).cast("double")) >= collapse).alias("collapsed"))


def balanced_summary(df: DataFrame, item: str, weight: str = "weight", sample: str = "sample", case: str = "case", by: list[str] | None = None) -> DataFrame:
    """Mean in the sample, then in the case, then over cases; each case counts once."""
    by = by or []
    v = F.col("_v")
    samples = df.groupBy(*by, item, case, sample).agg(F.avg(weight).alias("_v"))
    cases = samples.groupBy(*by, item, case).agg(F.avg("_v").alias("_v"))
    out = cases.groupBy(*by, item).agg(F.avg(v).alias("mean"), F.stddev_samp(v).alias("std"), F.median(v).alias("median"), F.min(v).alias("min"), F.max(v).alias("max"))
    return out.withColumn("rank", F.row_number().over(Window.partitionBy(*by).orderBy(F.desc("mean"), item)))


def region_shift(by_region: DataFrame, overall: DataFrame, item: str, region: str = "region") -> DataFrame:
    return by_region.select(region, item, F.col("mean").alias("region_mean")).join(overall.select(item, F.col("mean").alias("overall_mean")), item).withColumn("shift", F.col("region_mean") - F.col("overall_mean"))


def largest(df: DataFrame, by: list[str], value: str, item: str, most: int = 5) -> DataFrame:
    """The rows with the largest values of each group, numbered by `place`; equal values by item."""
    return df.withColumn("place", F.row_number().over(Window.partitionBy(*by).orderBy(F.desc(value), item))).where(F.col("place") <= most)


def joint_shift(shifts: DataFrame, by: list[str], item: str, items: list) -> DataFrame:
    """The shift of several items together."""
    return shifts.where(F.col(item).isin(items)).groupBy(*by).agg(F.sum("shift").alias("shift"))


def shift_over_seeds(shifts: DataFrame, by: list[str]) -> DataFrame:
    s = F.col("shift")
    return shifts.groupBy(*by).agg(F.avg(s).alias("mean"), F.count(F.when(s > 0, 1)).alias("positive"), F.count("*").alias("seeds"), (F.bool_and(s > 0) | F.bool_and(s < 0)).alias("same_direction"))


def weight_stability(df: DataFrame, by: list[str], run: str, item: str, value: str) -> DataFrame:
    """Per item over runs: mean, std, variation, ranks, and flags of instability."""
    at = F.row_number().over(Window.partitionBy(*by, run).orderBy(F.desc(value), item))
    out = df.withColumn("_at", at).groupBy(*by, item).agg(F.avg(value).alias("mean"), F.stddev_samp(value).alias("std"), F.avg("_at").alias("rank_mean"), F.stddev_samp("_at").alias("rank_std"), (F.max("_at") - F.min("_at")).alias("rank_range"))
    cv = F.when(F.col("mean") != 0, F.col("std") / F.col("mean"))
    return out.withColumns({"cv": cv, "moves": F.col("rank_range") > 5, "varies": F.coalesce(cv > 0.5, F.lit(False)), "small": F.col("mean") < 0.01})


def stability_class(item_pairs: DataFrame, group_pairs: DataFrame, groups: DataFrame) -> DataFrame:
    """One row: mean likeness over pairs of runs of items and of groups, the largest range of a group's ranks, the class.

    The pairs are those of pairwise_vectors(), the groups those of weight_stability(). Items are stable from a mean
    Spearman of 0.7 and a mean Jaccard of the top of 0.6; groups from a Spearman of 0.7 and a cosine of 0.9, with no
    rank moving by more than 2.
    """
    items = item_pairs.agg(F.avg("spearman").alias("item_spearman"), F.avg("jaccard").alias("item_jaccard"))
    both = group_pairs.agg(F.avg("spearman").alias("group_spearman"), F.avg("cosine").alias("group_cosine"))
    moved = groups.agg(F.max("rank_range").alias("group_range"))
    one = items.join(F.broadcast(both)).join(F.broadcast(moved))  # one row each
    alone = (F.col("item_spearman") >= 0.7) & (F.col("item_jaccard") >= 0.6)
    together = (F.col("group_spearman") >= 0.7) & (F.col("group_cosine") >= 0.9) & (F.col("group_range") <= 2)
    return one.withColumn("class", F.when(alone, "items").when(together, "groups").otherwise("unstable"))


def run_shift(df: DataFrame, item: str, run: str, one, other, value: str) -> DataFrame:
    """The other run's value minus the first one's."""
    at = lambda r: F.avg(F.when(F.col(run) == r, F.col(value)))
    return df.groupBy(item).agg(at(one).alias("first"), at(other).alias("second")).withColumn("shift", F.col("second") - F.col("first"))


def grouped_weights(df: DataFrame, keys: list[str], item: str, groups: DataFrame, weight: str = "weight") -> DataFrame:
    """keys, group and weight: the weight of a group's items together. groups: item and group, a short list."""
    return df.join(F.broadcast(groups), item).groupBy(*keys, "group").agg(F.sum(weight).alias(weight))


def prediction_metrics(df: DataFrame, by: list[str], case: str = "case_id", observed: str = "observed", predicted: str = "predicted", low: float = 40, high: float = 60) -> DataFrame:
    """by, pooled_mae, case_mae (each case counts once), rmse, and the mean absolute errors on low, middle and high targets."""
    o, e = F.col(observed), F.abs(F.col(predicted) - F.col(observed))
    sums = {"": F.lit(True), "_low": o < low, "_mid": o.between(low, high), "_high": o > high}
    parts = [x for k, rule in sums.items() for x in (F.sum(F.when(rule, e)).alias(f"_e{k}"), F.count(F.when(rule, e)).alias(f"_n{k}"))]
    cases = df.groupBy(*by, case).agg(*parts, F.sum(e * e).alias("_sq"))
    ratio = lambda k: F.sum(f"_e{k}") / F.nullif(F.sum(f"_n{k}"), F.lit(0))
    return cases.groupBy(*by).agg(ratio("").alias("pooled_mae"), F.avg(F.col("_e") / F.col("_n")).alias("case_mae"), F.sqrt(F.sum("_sq") / F.sum("_n")).alias("rmse"), *(ratio(f"_{k}").alias(f"{k}_mae") for k in ("low", "mid", "high")))


def joint_audit(df: DataFrame, feature: str, temporal: str, joint: str, observed: str, tolerance: float = 1e-5) -> DataFrame:
    """One row over arrays of weights: of features in each step, of steps, and joint ones that must be their products.

    feature, joint and observed are arrays of steps with an array of features each, temporal an array of steps. For each:
    the least weight, the largest error of its sum and how many sums are off by more than the tolerance; weights on what
    was not observed; and the largest error and count of the product rule. Nothing is exploded.
    """
    total = lambda a: F.aggregate(a, F.lit(0.0), lambda s, v: s + v)
    steps = F.transform(feature, lambda row: F.abs(total(row) - 1))
    pairs = F.flatten(F.zip_with(F.col(feature), F.col(observed), lambda w, o: F.zip_with(w, o, lambda x, y: F.when(~y, F.abs(x)))))
    products = F.zip_with(F.col(feature), F.col(temporal), lambda row, t: F.transform(row, lambda v: v * t))
    wrong = F.flatten(F.zip_with(F.col(joint), products, lambda a, b: F.zip_with(a, b, lambda x, y: F.abs(x - y))))
    one = F.abs(total(F.col(temporal)) - 1)
    both = F.abs(total(F.flatten(joint)) - 1)
    over = lambda a: F.size(F.filter(a, lambda v: v > tolerance)).cast("long")
    per = df.select(
        F.array_min(F.flatten(feature)).alias("feature_least"), F.array_max(steps).alias("feature_error"), over(steps).alias("feature_off"),
        F.coalesce(F.array_max(pairs), F.lit(0.0)).alias("unobserved_most"), F.size(F.filter(pairs, lambda v: v > 0)).cast("long").alias("unobserved"),
        F.array_min(temporal).alias("temporal_least"), one.alias("temporal_error"), (one > tolerance).cast("long").alias("temporal_off"),
        F.array_min(F.flatten(joint)).alias("joint_least"), both.alias("joint_error"), (both > tolerance).cast("long").alias("joint_off"),
        F.array_max(wrong).alias("product_error"), over(wrong).alias("product_off"),
    )
    how = {"least": F.min, "error": F.max, "most": F.max}
    return per.agg(F.count("*").alias("vectors"), *(how.get(c.rsplit("_", 1)[-1], F.sum)(c).alias(c) for c in per.columns))


def aligned_weights(weights: DataFrame, predictions: DataFrame, metadata: DataFrame, key: str, agree: list[str], feature: str, temporal: str, joint: str, observed: str) -> DataFrame:
    """One row of faults of weight arrays against the predictions and the metadata of the same samples.

    missing, extra: samples of the predictions without weights, and weights without one; repeated: further rows of a
    sample; differ_<column>: predictions that do not agree with the metadata; case: weights of another case; shape: arrays
    that have not the mask's steps and features; not_finite: samples with a weight or a prediction that is no number.
    """
    finite = lambda a: F.forall(a, lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < float("inf")))
    sizes = lambda c: F.transform(c, F.size)
    # what a row of arrays tells by itself is settled before any join
    shape = sizes(F.col(feature)).eqNullSafe(sizes(F.col(observed))) & sizes(F.col(joint)).eqNullSafe(sizes(F.col(observed))) & F.size(temporal).eqNullSafe(F.size(observed))
    own = weights.select(F.col(key).alias("_k"), F.col(agree[0]).alias("_case"), (~shape).alias("_shape"), (~(finite(F.flatten(feature)) & finite(F.flatten(joint)) & finite(F.col(temporal)))).alias("_inf"))
    number = F.col("predicted").isNotNull() & ~F.isnan("predicted") & (F.abs("predicted") < float("inf"))
    mine = predictions.select(F.col(key).alias("_p"), *(F.col(c).alias(f"_p_{c}") for c in agree), (~number).alias("_bad"))
    both = own.join(mine, F.col("_k") == F.col("_p"), "full_outer").join(metadata.select(F.col(key).alias("_m"), *(F.col(c).alias(f"_m_{c}") for c in agree)), F.col("_p") == F.col("_m"), "left")
    paired = F.col("_k").isNotNull() & F.col("_p").isNotNull()
    count = lambda rule: F.count(F.when(F.coalesce(rule, F.lit(False)), 1))
    copies = weights.groupBy(key).agg((F.count("*") - 1).alias("_n")).agg(F.coalesce(F.sum("_n"), F.lit(0)).alias("repeated"))
    faults = both.agg(
        count(F.col("_k").isNull()).alias("missing"), count(F.col("_p").isNull()).alias("extra"),
        *(count(F.col("_p").isNotNull() & ~F.col(f"_p_{c}").eqNullSafe(F.col(f"_m_{c}"))).alias(f"differ_{c}") for c in agree),
        count(paired & ~F.col("_case").eqNullSafe(F.col(f"_p_{agree[0]}"))).alias("case"), count(F.col("_shape")).alias("shape"), count(F.col("_inf") | F.col("_bad")).alias("not_finite"),
    )
    return faults.join(F.broadcast(copies))  # one row each

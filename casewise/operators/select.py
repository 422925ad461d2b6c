"""Feature selection by stability of sparse fits over case bootstraps.

Rows are read once: each case becomes its moment matrix, and folds, bootstraps and subsamples are sums of these. What
a fit needs is as wide as the features squared, whatever the number of rows.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from casewise.functions import draw
from casewise.operators.order import numbered

#: Cases whose moment matrices are added up by one product.
TOGETHER = 256


def case_moments(df: DataFrame, features: str, target: str, weight: str | None = None, case: str = "case_id") -> DataFrame:
    """case, n, and `gram`: the flat weighted moment matrix of (1, features, target), summed inside each task first."""

    def sum_up(batches):
        total: dict = {}
        for frame in batches:
            for key, group in frame.groupby(case):
                z = np.column_stack([np.ones(len(group)), np.stack(group[features].to_numpy()), group[target].to_numpy(float)])
                w = group[weight].to_numpy(float) if weight else np.ones(len(group))
                n, g = total.get(key, (0, 0))
                total[key] = (n + len(group), g + (z * w[:, None]).T @ z)
            if len(total) > 500:
                yield flush(total)
                total = {}
        # a column of lists without a row has no type that Arrow could turn into one of arrays
        if total:
            yield flush(total)

    def flush(total: dict) -> pd.DataFrame:
        return pd.DataFrame({case: list(total), "n": [n for n, _ in total.values()], "v": [g.ravel() for _, g in total.values()]})

    kind = df.schema[case].dataType.simpleString()
    parts = df.select(case, features, target, *([weight] if weight else [])).mapInPandas(sum_up, f"{case} {kind}, n long, v array<double>")
    # a case has a row from each task that met it
    met = parts.groupBy(case).agg(F.sum("n").alias("n"), F.collect_list("v").alias("_vs"))
    whole = F.aggregate(F.slice("_vs", 2, F.greatest(F.size("_vs") - 1, F.lit(0))), F.element_at("_vs", 1), lambda a, v: F.zip_with(a, v, lambda x, y: x + y))
    return met.select(case, "n", whole.alias("gram"))


def summed_moments(moments: DataFrame, draws: DataFrame, by: str, case: str = "case_id") -> DataFrame:
    """by and gram, a row from each task; those of a group add up to its cases' moment matrices, each times its copies.

    draws: by (an integer), case, copies. A case meets all its draws in one row, and a task adds up by one product of
    matrices for each few cases, so that what is shuffled is a matrix for each task and group, whatever the number of
    cases and draws. A task holds one matrix for each group. Cases that moments lacks and groups without any are left out.
    """
    of_case = draws.groupBy(case).agg(F.collect_list(F.struct(F.col(by).cast("long").alias("group"), F.col("copies").cast("double").alias("copies"))).alias("_draws"))
    rows = moments.join(of_case, case).select("gram", F.col("_draws.group").alias("groups"), F.col("_draws.copies").alias("copies"))

    def add_up(batches):
        total: dict = {}
        for frame in batches:
            for at in range(0, len(frame), TOGETHER):
                part = frame.iloc[at : at + TOGETHER]
                row = np.repeat(np.arange(len(part)), part["groups"].map(len))
                groups, place = np.unique(np.concatenate(part["groups"].to_numpy()), return_inverse=True)
                copies = np.zeros((len(groups), len(part)))
                np.add.at(copies, (place, row), np.concatenate(part["copies"].to_numpy()))
                for g, gram in zip(groups.tolist(), copies @ np.stack(part["gram"].to_numpy()), strict=True):
                    total[g] = total.get(g, 0.0) + gram
        if total:
            yield pd.DataFrame({by: list(total), "gram": list(total.values())})

    return rows.mapInPandas(add_up, f"{by} long, gram array<double>")


def added(frame: pd.DataFrame) -> pd.DataFrame:
    """One row from a group's parts: its key and the sum of their matrices."""
    return pd.DataFrame([[frame.iloc[0, 0], np.stack(frame["gram"].to_numpy()).sum(0)]])


def elastic_net(gram: np.ndarray, penalized: np.ndarray, alpha: float, l1: float, steps: int = 500, tolerance: float = 1e-8) -> np.ndarray:
    """Coefficients of (1, features) that minimise squared loss over 2 x total weight plus alpha penalties.

    The intercept and features that are not penalized are projected out (a Schur complement), the others found by
    coordinate descent on what is left, and the former then refitted.
    """
    p = len(gram) - 1
    free = np.concatenate([[True], ~penalized])
    total = gram[0, 0]
    a, b, y = np.flatnonzero(free), np.flatnonzero(~free), p
    inner = np.linalg.pinv(gram[np.ix_(a, a)])
    s = (gram[np.ix_(b, b)] - gram[np.ix_(b, a)] @ inner @ gram[np.ix_(a, b)]) / total
    c = (gram[b, y] - gram[np.ix_(b, a)] @ inner @ gram[a, y]) / total
    w = np.zeros(len(b))
    for _ in range(steps):
        most = 0.0
        for j in range(len(b)):
            rho = c[j] - s[j] @ w + s[j, j] * w[j]
            new = np.sign(rho) * max(0.0, abs(rho) - alpha * l1) / (s[j, j] + alpha * (1 - l1) + 1e-15)
            most, w[j] = max(most, abs(new - w[j])), new
        if most < tolerance:
            break
    out = np.zeros(p)
    out[b] = w
    out[a] = inner @ (gram[a, y] - gram[np.ix_(a, b)] @ w)
    return out


def mean_loss(gram: np.ndarray, coefficients: np.ndarray) -> float:
    """Weighted mean squared error of coefficients on a moment matrix."""
    v = np.append(coefficients, -1.0)
    return float(v @ gram @ v / gram[0, 0])


def cv_grid(moments: DataFrame, folds: DataFrame, alphas: list[float], l1s: list[float], penalized: list[bool], case: str = "case_id") -> DataFrame:
    """alpha, l1, loss (mean over folds), best first. A fold's training matrix is the total less its own."""
    grams = summed_moments(moments, folds.select("fold", case, F.lit(1).alias("copies")), "fold", case).groupBy("fold").applyInPandas(added, "fold long, gram array<double>")
    whole = grams.withColumn("fold", F.lit(0).cast("long")).groupBy("fold").applyInPandas(added, "fold long, whole array<double>").select("whole")
    grid = moments.sparkSession.createDataFrame([(a, l) for a in alphas for l in l1s], "alpha double, l1 double")
    tasks = grams.join(F.broadcast(whole)).join(F.broadcast(grid))  # one row; the grid
    mask = np.array(penalized)

    def fit(frame: pd.DataFrame) -> pd.DataFrame:
        out = []
        for r in frame.itertuples():
            own, all_ = np.array(r.gram), np.array(r.whole)
            k = int(round(len(own) ** 0.5))
            own, all_ = own.reshape(k, k), all_.reshape(k, k)
            out.append((r.fold, r.alpha, r.l1, mean_loss(own, elastic_net(all_ - own, mask, r.alpha, r.l1))))
        return pd.DataFrame(out, columns=["fold", "alpha", "l1", "loss"])

    losses = tasks.groupBy("fold", "alpha", "l1").applyInPandas(fit, "fold long, alpha double, l1 double, loss double")
    return losses.groupBy("alpha", "l1").agg(F.avg("loss").alias("loss")).orderBy("loss", "alpha", "l1")


def bootstrap_fits(moments: DataFrame, draws: DataFrame, names: list[str], penalized: list[bool], alpha: float, l1: float, case: str = "case_id", threshold: float = 1e-6) -> DataFrame:
    """replicate, feature, coefficient, selected. draws: replicate, case, copies."""
    mask = np.array(penalized)

    def fit(frame: pd.DataFrame) -> pd.DataFrame:
        g = np.stack(frame["gram"].to_numpy()).sum(0)
        k = int(round(len(g) ** 0.5))
        c = elastic_net(g.reshape(k, k), mask, alpha, l1)[1:]
        out = [(frame["replicate"].iloc[0], n, float(x), bool(abs(x) > threshold)) for n, x, m in zip(names, c, mask, strict=True) if m]
        return pd.DataFrame(out, columns=["replicate", "feature", "coefficient", "selected"])

    return summed_moments(moments, draws, "replicate", case).groupBy("replicate").applyInPandas(fit, "replicate long, feature string, coefficient double, selected boolean")


def stability_summary(fits: DataFrame) -> DataFrame:
    """Per feature: frequency, size, dominant sign and its consistency, ranks."""
    c = F.col("coefficient")
    ranked = fits.withColumn("_rank", F.row_number().over(Window.partitionBy("replicate").orderBy(F.desc(F.abs(c)), "feature")))
    pos, neg = F.count(F.when(c > 0, 1)), F.count(F.when(c < 0, 1))
    return ranked.groupBy("feature").agg(F.avg(F.col("selected").cast("double")).alias("frequency"), F.avg(F.abs(c)).alias("mean_abs"), F.median(F.abs(c)).alias("median_abs"), F.when(pos >= neg, 1).otherwise(-1).alias("sign"), F.when(pos + neg > 0, F.greatest(pos, neg) / (pos + neg)).alias("consistency"), F.avg("_rank").alias("rank_mean"), F.stddev_samp("_rank").alias("rank_std"))


def threshold_sets(summary: DataFrame, order: DataFrame, anchor: str, thresholds: tuple[float, ...] = (0.8, 0.6, 0.4)) -> DataFrame:
    """threshold, place, feature: features at least as frequent, the anchor always, in source order (feature, place)."""
    cuts = F.explode(F.array(*map(F.lit, thresholds)))
    known = order.join(summary, "feature", "left").select("feature", "place", F.coalesce("frequency", F.lit(0.0)).alias("f"), cuts.alias("threshold"))
    return known.where((F.col("f") >= F.col("threshold")) | (F.col("feature") == anchor)).select("threshold", "place", "feature")


def block_permutation(cases: DataFrame, seed: int, case: str = "case_id") -> DataFrame:
    """case and the case whose block it gets: the next one in a seeded order."""
    placed = numbered(cases.select(case).distinct().withColumn("_draw", draw(seed, F.col(case))), ["_draw", case], "_i").select(case, "_i")
    n = cases.select(case).distinct().count()
    return placed.join(placed.select(F.col(case).alias("donor"), F.pmod(F.col("_i") - 1, F.lit(n)).alias("_i")), "_i").select(case, "donor")


def permute_blocks(df: DataFrame, columns: list[str], donors: DataFrame, case: str = "case_id", time: str = "final_ts") -> DataFrame:
    """df with columns taken from the donor case, places stretched over its length in time order."""
    w = Window.partitionBy(case)
    placed = df.withColumns({"_i": F.row_number().over(w.orderBy(time)) - 1, "_n": F.count("*").over(w)})
    source = placed.select(F.col(case).alias("donor"), F.col("_i").alias("_j"), *(F.col(c).alias(f"_new_{c}") for c in columns))
    sizes = placed.groupBy(F.col(case).alias("donor")).agg(F.count("*").alias("_m"))
    stretched = placed.join(donors, case).join(sizes, "donor")
    at = F.when(F.col("_n") > 1, F.round(F.col("_i") * (F.col("_m") - 1) / (F.col("_n") - 1))).otherwise(0).cast("int")
    moved = stretched.withColumn("_j", at).join(source, ["donor", "_j"])
    return moved.select(*(F.col(f"_new_{c}").alias(c) if c in columns else F.col(c) for c in df.columns))


def importance_summary(scores: DataFrame) -> DataFrame:
    """scores: feature, repeat, baseline, permuted. Gain per feature over repeats; stable if positive in 70 % of them."""
    g = F.col("permuted") - F.col("baseline")
    return scores.groupBy("feature").agg(F.avg(g).alias("mean"), F.stddev_samp(g).alias("std"), F.median(g).alias("median"), F.avg((g > 0).cast("double")).alias("positive")).withColumn("stable", F.col("positive") >= 0.7)


def mid_ranks(long: DataFrame, feature: str, value: str) -> DataFrame:
    """The rows with `_rank`, the average rank of ties within a feature, and `_middle`, the mean of the feature's ranks.

    Each feature's values are dealt by ranges between its quantiles; ranks inside a range are shifted by what the
    ranges below hold, so no task sorts a whole feature. Rows without a value are left out.
    """
    rows = long.where(F.col(value).isNotNull() & ~F.isnan(value))
    ranges = max(2, int(long.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    quantiles = rows.groupBy(feature).agg(F.array_distinct(F.percentile_approx(value, [k / ranges for k in range(1, ranges)], 10_000)).alias("_borders"))
    levels = rows.groupBy(feature, value).agg(F.count("*").alias("_n")).join(F.broadcast(quantiles), feature)  # one row for each feature
    placed = levels.withColumn("_part", F.size(F.filter("_borders", lambda x: x <= F.col(value)))).drop("_borders")
    below = Window.partitionBy(feature).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    parts = placed.groupBy(feature, "_part").agg(F.sum("_n").alias("_m")).select(feature, "_part", F.coalesce(F.sum("_m").over(below), F.lit(0)).alias("_before"), F.sum("_m").over(Window.partitionBy(feature)).alias("_all"))
    inside = Window.partitionBy(feature, "_part").orderBy(value).rowsBetween(Window.unboundedPreceding, 0)
    ranked = placed.withColumn("_upto", F.sum("_n").over(inside)).join(parts, [feature, "_part"])
    rank = F.col("_before") + F.col("_upto") - (F.col("_n") - 1) / 2
    return rows.join(ranked.select(feature, value, rank.alias("_rank"), ((F.col("_all") + 1) / 2).alias("_middle")), [feature, value])


def correlations(df: DataFrame, columns: list[str], key: list[str]) -> DataFrame:
    """a, b, pearson, spearman of every pair of columns (a list of features) over the rows that hold both.

    `key` tells rows apart and is unique. Null and NaN are missing; a rank counts all rows that hold its column.
    Null where fewer than two rows hold both, or one of them does not vary. Each task adds up the moments of all
    pairs; only these sums are shuffled.
    """
    size = len(columns)
    pairs = [(i, j) for i in range(size) for j in range(i + 1, size)]
    values = df.select(*key, *(F.col(c).cast("double").alias(f"_{k}") for k, c in enumerate(columns)))
    long = values.select(*key, F.posexplode(F.array(*(f"_{k}" for k in range(size)))).alias("_at", "_value"))
    # about an element of the column, so that one that does not vary gives exact zeros
    middle = long.where(F.col("_value").isNotNull() & ~F.isnan("_value")).groupBy("_at").agg(F.percentile_approx("_value", 0.5).alias("_centre"))
    ranked = mid_ranks(long, "_at", "_value").join(F.broadcast(middle), "_at")  # one row for each feature
    centred = ranked.select(*key, "_at", (F.col("_value") - F.col("_centre")).alias("_v"), (F.col("_rank") - F.col("_middle")).alias("_r"))
    of = lambda c: F.array(*(F.max(F.when(F.col("_at") == k, F.col(c))) for k in range(size)))
    rows = centred.groupBy(*key).agg(of("_v").alias("v"), of("_r").alias("r")).select("v", "r")
    names = [f"{kind}{m}" for kind in "vr" for m in ("x", "y", "xx", "yy", "xy")]

    def add_up(batches):
        total = None
        for frame in batches:
            if len(frame):
                found = [np.stack(frame[kind].to_numpy()).astype(float) for kind in "vr"]
                held = (~np.isnan(found[0])).astype(float)
                parts = [held.T @ held]
                for z in found:
                    z = np.nan_to_num(z)
                    s, q = z.T @ held, (z * z).T @ held
                    parts += [s, s.T, q, q.T, z.T @ z]
                total = parts if total is None else [a + b for a, b in zip(total, parts, strict=True)]
        if total is not None and pairs:
            i, j = np.array(pairs).T
            yield pd.DataFrame({"i": i, "j": j} | {n: m[i, j] for n, m in zip(["n", *names], total, strict=True)})

    sums = rows.mapInPandas(add_up, "i int, j int, n double, " + ", ".join(f"{n} double" for n in names)).groupBy("i", "j").agg(*(F.sum(c).alias(c) for c in ["n", *names]))

    def ratio(kind: str) -> Column:
        x, y, xx, yy, xy = (F.col(f"{kind}{m}") for m in ("x", "y", "xx", "yy", "xy"))
        n = F.col("n")
        a, b = xx - x * x / n, yy - y * y / n
        return F.when((n > 1) & (a > 0) & (b > 0), (xy - x * y / n) / F.sqrt(a * b))

    name = lambda at: F.element_at(F.array(*(F.lit(c) for c in columns)), F.col(at) + 1)
    return sums.select(name("i").alias("a"), name("j").alias("b"), ratio("v").alias("pearson"), ratio("r").alias("spearman"))


def correlation_clusters(pairs: DataFrame, features: list[str], least: float = 0.8) -> DataFrame:
    """feature and cluster (numbered by its first feature): connected by pairs of at least that absolute correlation.

    The graph has one node for each feature of a list.
    """
    root = {f: f for f in features}

    def find(x: str) -> str:
        while root[x] != x:
            x = root[x]
        return x

    for r in pairs.where(F.greatest(F.abs("pearson"), F.abs("spearman")) >= least).collect():
        x, y = sorted((find(r.a), find(r.b)), key=features.index)
        root[y] = x
    heads = list(dict.fromkeys(find(f) for f in features))
    return pairs.sparkSession.createDataFrame([(f, heads.index(find(f))) for f in features], "feature string, cluster int")


def consensus(selectors: dict[str, DataFrame], features: DataFrame) -> DataFrame:
    """feature, a flag for each selector (feature, stable), and how many agree."""
    out = features.select("feature")
    for name, df in selectors.items():
        out = out.join(df.select("feature", F.col("stable").cast("int").alias(name)), "feature", "left").withColumn(name, F.coalesce(name, F.lit(0)))
    total: Column = F.lit(0)
    for name in selectors:
        total = total + F.col(name)
    return out.withColumn("agreement", total)


def candidate_sets(stable_a: DataFrame, stable_b: DataFrame, clusters: DataFrame, score: DataFrame, protected: list[str], most: int = 6, anchors: dict[str, list[str]] | None = None) -> DataFrame:
    """subset, features (sorted), size: both selectors' sets, their intersection and union, and the best per cluster; equal sets once.

    anchors: named sets that are fixed beforehand, such as nested ones; they come first and get no protected features.
    """
    spark = stable_a.sparkSession
    best = clusters.join(score, "feature").withColumn("_at", F.row_number().over(Window.partitionBy("cluster").orderBy(F.desc("score"), "feature"))).where("_at = 1").select("feature")
    keep = spark.createDataFrame([(p,) for p in protected], "feature string")
    sets = {"a": stable_a.select("feature"), "b": stable_b.select("feature"), "both": stable_a.select("feature").intersect(stable_b.select("feature")), "either": stable_a.select("feature").union(stable_b.select("feature")), "clusters": best}
    out = None
    fixed = {name: spark.createDataFrame([(f,) for f in features], "feature string") for name, features in (anchors or {}).items()}
    for place, (name, df) in enumerate((fixed | sets).items()):
        one = (df if name in fixed else df.union(keep)).distinct().agg(F.array_sort(F.collect_list("feature")).alias("features")).select(F.lit(place).alias("place"), F.lit(name).alias("subset"), "features")
        out = one if out is None else out.unionByName(one)
    first = out.withColumn("_at", F.row_number().over(Window.partitionBy("features").orderBy("place"))).where("_at = 1")
    return first.orderBy("place").limit(most).select("subset", F.array_join("features", ",").alias("features"), F.size("features").alias("size"))

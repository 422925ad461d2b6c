"""Feature selectors that balance cases: sparse paths on fold-scaled moments, and boosted trees by hold-out gain.

Both read a table with one row for each window: case, time, `x` (flat array: lags of all features, then static ones)
and a target. `groups` names a feature and the places that its lags have in x.

Moments and scores follow two passes over the rows, whatever the number of folds, parameters, runs and features: one
sums each case's moment matrix, the other applies all models to a row, and only sums by case leave it. Models are a few
numbers each and go to the tasks with the code.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator
from multiprocessing.pool import ThreadPool

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from casewise.functions import draw, once
from casewise.operators import boosting
from casewise.operators.contracts import ContractError
from casewise.operators.order import numbered, quantiles
from casewise.operators.splits import subsample

#: The parameters that are tried, in the order that decides between equal scores, and selection thresholds.
NET_GRID = tuple((alpha, l1) for alpha in (0.001, 0.01, 0.1) for l1 in (0.1, 0.5, 0.9))
TREE_GRID = ((3, 5, 0.05), (5, 5, 0.05), (3, 10, 0.1))  # depth, rows of a leaf (boosting: their weight, 1 on average), learning rate
THRESHOLDS = (0.6, 0.7, 0.8, 0.9)
STABLE = 0.7
#: Rows of a task of the tree learner.
EACH = 100_000


def filled(df: DataFrame, x: str = "x", fill: list[float] | None = None) -> DataFrame:
    """df whose x has no null or NaN: they get the place's fill, its exact median unless given.

    For medians df is computed once and kept: they are several passes over it, and fits follow.
    """
    if fill is None:
        df = once(df)
        first = df.select(F.size(x)).first()
        wide = df.select(*(F.col(x)[k].cast("double").alias(f"_{k}") for k in range(first[0] if first else 0)))
        fill = [v[0] if v[0] is not None else 0.0 for v in quantiles(wide, wide.columns, [0.5]).values()]
    values = F.array(*(F.lit(float(v)) for v in fill))
    return df.withColumn(x, F.zip_with(F.col(x), values, lambda v, f: F.when(v.isNull() | F.isnan(v), f).otherwise(v.cast("double"))))


def case_sums(keys: pd.DataFrame, wrong: np.ndarray) -> pd.DataFrame:
    """keys, each once, with `n`, the number of their rows, and `wrong`, the sums of these rows."""
    at = keys.groupby(list(keys.columns), sort=False, dropna=False).ngroup().to_numpy()
    found = keys.drop_duplicates()
    sums = np.stack([np.bincount(at, w, len(found)) for w in wrong.T], axis=1)
    return found.assign(n=np.bincount(at, minlength=len(found)), wrong=list(sums))


# sparse linear selector

def group_moments(moments: DataFrame, draws: DataFrame, group: str, case: str = "case_id") -> DataFrame:
    """group, rows, cases and two flat moment matrices of its cases: `plain`, the sum, and `balanced`, with each case as one.

    moments: case_moments() without weights. draws: group and case, once for each case that counts. A task adds up whole
    matrices before anything is shuffled.
    """

    def add_up(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        total: dict = {}
        for frame in batches:
            for g, n, gram in zip(frame[group], frame["n"], frame["gram"], strict=True):
                m = np.array(gram)
                rows, cases, plain, balanced = total.get(g, (0, 0, 0.0, 0.0))
                total[g] = (rows + n, cases + 1, plain + m, balanced + m / n)
        for g, (rows, cases, plain, balanced) in total.items():
            yield pd.DataFrame({group: g, "rows": rows, "cases": cases, "at": range(len(plain)), "plain": plain, "balanced": balanced})

    kind = draws.schema[group].dataType.simpleString()
    parts = moments.join(draws.select(group, case), case).select(group, "n", "gram").mapInPandas(add_up, f"{group} {kind}, rows long, cases long, at int, plain double, balanced double")
    cells = parts.groupBy(group, "at").agg(*(F.sum(c).alias(c) for c in ("rows", "cases", "plain", "balanced")))
    of = lambda c: F.transform(F.array_sort(F.collect_list(F.struct("at", c))), lambda v: v[c])
    return cells.groupBy(group).agg(F.max("rows").alias("rows"), F.max("cases").alias("cases"), of("plain").alias("plain"), of("balanced").alias("balanced"))


def standardised(plain: np.ndarray, balanced: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The balanced moments of features scaled by their unbalanced mean and population deviation, and these two."""
    n = plain[0, 0]
    mean = plain[0, 1:-1] / n
    variance = np.diag(plain)[1:-1] / n - mean**2
    scale = np.where(variance > 1e-14 * np.maximum(1.0, mean**2), np.sqrt(np.maximum(variance, 0)), 1.0)
    change = np.eye(len(plain))
    change[0, 1:-1] = -mean / scale
    change[1:-1, 1:-1] = np.diag(1 / scale)
    return change.T @ balanced @ change, mean, scale


def net_path(gram: np.ndarray, grid: list[tuple[float, float]], steps: int = 10_000, tolerance: float = 1e-10) -> list[np.ndarray]:
    """Coefficients of (1, features) for each (alpha, l1 share) of the grid, the intercept free.

    For each l1 share alphas go from the largest down, each fit starting where the one before it ended.
    """
    total, p = gram[0, 0], len(gram) - 2
    s = (gram[1:-1, 1:-1] - np.outer(gram[1:-1, 0], gram[0, 1:-1]) / total) / total
    c = (gram[1:-1, -1] - gram[1:-1, 0] * gram[0, -1] / total) / total
    out: dict[tuple[float, float], np.ndarray] = {}
    for l1 in {share for _, share in grid}:
        w = np.zeros(p)
        slope = c.copy()
        for alpha in sorted({a for a, share in grid if share == l1}, reverse=True):
            for _ in range(steps):
                most = 0.0
                for j in range(p):
                    rho = slope[j] + s[j, j] * w[j]
                    new = np.sign(rho) * max(0.0, abs(rho) - alpha * l1) / (s[j, j] + alpha * (1 - l1) + 1e-15)
                    if new != w[j]:
                        slope -= s[:, j] * (new - w[j])
                        most, w[j] = max(most, abs(new - w[j])), new
                if most < tolerance:
                    break
            out[alpha, l1] = np.concatenate([[(gram[0, -1] - gram[0, 1:-1] @ w) / total], w])
    return [out[point] for point in grid]


def net_models(moments: DataFrame, draws: DataFrame, group: str, grid: list[tuple[float, float]], case: str = "case_id") -> DataFrame:
    """group, parameter, intercept, coefficients (of standardised features), mean and scale; one task for each group."""

    def fit(frame: pd.DataFrame) -> pd.DataFrame:
        out = []
        for g, plain, balanced in zip(frame[group], frame["plain"], frame["balanced"], strict=True):
            k = int(round(len(plain) ** 0.5))
            gram, mean, scale = standardised(np.array(plain).reshape(k, k), np.array(balanced).reshape(k, k))
            out += [(g, n, w[0], w[1:], mean, scale) for n, w in enumerate(net_path(gram, grid))]
        return pd.DataFrame(out, columns=[group, "parameter", "intercept", "coefficients", "mean", "scale"])

    kind = draws.schema[group].dataType.simpleString()
    sums = group_moments(moments, draws, group, case)
    return sums.groupBy(group).applyInPandas(fit, f"{group} {kind}, parameter int, intercept double, coefficients array<double>, mean array<double>, scale array<double>")


def balanced_errors(rows: DataFrame, models: DataFrame, group: str, x: str = "x", target: str = "y", case: str = "case_id") -> DataFrame:
    """group, parameter and mae (the mean over cases of their mean absolute errors) of linear models on the rows of their group.

    models: net_models(); groups times parameters of them come to the driver and go to every task.
    """
    by: dict = {}
    for r in models.collect():
        by.setdefault(r[group], []).append((r["parameter"], r["intercept"], np.array(r["coefficients"]), np.array(r["mean"]), np.array(r["scale"])))
    flat = {}
    for g, found in by.items():
        found.sort(key=lambda m: m[0])
        weights = np.stack([w / s for _, _, w, _, s in found], axis=1)
        flat[g] = ([m[0] for m in found], weights, np.array([b - (w / s) @ m for _, b, w, m, s in found]))

    def score(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in batches:
            for g, part in frame.groupby(group):
                numbers, weights, free = flat[g]
                found = case_sums(part[[group, case]], np.abs(np.stack(part[x].to_numpy()) @ weights + free - part[target].to_numpy(float)[:, None]))
                yield found.assign(numbers=[numbers] * len(found))

    kinds = ", ".join(f"{c} {rows.schema[c].dataType.simpleString()}" for c in (group, case))
    sums = rows.select(group, case, x, target).mapInPandas(score, f"{kinds}, n long, wrong array<double>, numbers array<int>")
    each = sums.select(group, case, "n", F.explode(F.arrays_zip("numbers", "wrong")).alias("p")).select(group, case, "n", F.col("p.numbers").alias("parameter"), F.col("p.wrong").alias("e"))
    cases = each.groupBy(group, case, "parameter").agg((F.sum("e") / F.sum("n")).alias("mae"))
    return cases.groupBy(group, "parameter").agg(F.avg("mae").alias("mae"), F.count("*").alias("cases"))


def others(folds: DataFrame, case: str = "case_id") -> DataFrame:
    """(fold, case): the cases that are not in a fold, which train it."""
    numbers = F.array(*(F.lit(r[0]) for r in folds.select("fold").distinct().orderBy("fold").collect()))
    return folds.select(F.explode(F.array_except(numbers, F.array("fold"))).alias("fold"), case)


def net_grid(rows: DataFrame, moments: DataFrame, folds: DataFrame, grid: list[tuple[float, float]] | None = None, x: str = "x", target: str = "y", case: str = "case_id") -> tuple[DataFrame, DataFrame]:
    """The scores of a grid over grouped folds, and the coefficient path.

    Scores: parameter, alpha, l1, mae (mean over folds) and best (the first of the least). Path: fold, parameter, column
    (its place in x), coefficient of the standardised column, and selected, over 1e-10.
    """
    grid = list(grid or NET_GRID)
    fitted = net_models(moments, others(folds, case), "fold", grid, case)
    # a row for each fold and point of the grid
    models = rows.sparkSession.createDataFrame(fitted.collect(), fitted.schema)
    scores = balanced_errors(rows.join(folds, case), models, "fold", x, target, case)
    points = rows.sparkSession.createDataFrame([(k, a, s) for k, (a, s) in enumerate(grid)], "parameter int, alpha double, l1 double")
    means = scores.groupBy("parameter").agg(F.avg("mae").alias("mae"))
    # one row for each point of the grid
    first = F.row_number().over(Window.orderBy("mae", "parameter")) == 1
    table = means.join(points, "parameter").select("parameter", "alpha", "l1", "mae", first.alias("best"))
    path = models.select("fold", "parameter", F.posexplode("coefficients").alias("column", "coefficient")).withColumn("selected", F.abs("coefficient") > 1e-10)
    return table, path


def net_stability(moments: DataFrame, groups: dict[str, list[int]], alpha: float, l1: float, runs: int, fraction: float = 0.5, seed: int = 42, case: str = "case_id", threshold: float = 1e-10) -> DataFrame:
    """run, feature, selected, strongest and total: fits on `runs` subsamples of cases, features by their strongest lag."""
    draws = subsample(moments, fraction, runs, seed, case).where("chosen")
    models = net_models(moments, draws, "run", [(alpha, l1)], case)
    members = models.sparkSession.createDataFrame([(f, k) for f, at in groups.items() for k in at], "feature string, column int")
    lags = models.select("run", F.posexplode("coefficients").alias("column", "c")).join(F.broadcast(members), "column")  # a row for each lag
    size = F.abs("c")
    return lags.groupBy("run", "feature").agg(
        (F.max(size) > threshold).alias("selected"),
        # of equally strong lags the first
        F.max_by("c", F.struct(size, -F.col("column"))).alias("strongest"),
        F.sum(size).alias("total"),
    )


def flags(thresholds: tuple[float, ...]) -> list[Column]:
    return [(F.col("probability") >= t).alias(f"selected_at_{t:.1f}".replace(".", "_")) for t in thresholds]


def net_summary(fits: DataFrame, thresholds: tuple[float, ...] = THRESHOLDS) -> DataFrame:
    """Per feature: probability, medians over the runs that select it, sign and its consistency, and a flag for each threshold."""
    chosen = F.when(F.col("selected"), F.col("strongest"))
    plus, minus = F.count(F.when(chosen > 0, 1)), F.count(F.when(chosen < 0, 1))
    out = fits.groupBy("feature").agg(
        F.avg(F.col("selected").cast("double")).alias("probability"),
        # one row for each run
        F.coalesce(F.median(chosen), F.lit(0.0)).alias("median"),
        F.coalesce(F.median(F.abs(chosen)), F.lit(0.0)).alias("median_abs"),
        F.coalesce(F.greatest(plus, minus) / F.nullif(F.count(chosen), F.lit(0)), F.lit(0.0)).alias("consistency"),
        F.when(plus > minus, "positive").when(minus > plus, "negative").otherwise("mixed_or_zero").alias("sign"),
        F.count("*").alias("runs"),
    )
    return out.select("*", *flags(thresholds))


# tree selector

NODE = re.compile(r"^ *(If|Else|Predict)(?: \(feature (\d+) (?:<=|>) ([^)]+)\)|: (.+))$")


def flat_trees(model) -> list[tuple[float, np.ndarray]]:
    """(weight, nodes) of a boosted model of MLlib; a node is feature (-1: a leaf), threshold, left, right, value."""
    out = []
    for weight, tree in zip(model.treeWeights, model.trees, strict=True):
        lines = [m.groups() for m in map(NODE.match, tree.toDebugString.splitlines()) if m]
        nodes: list[list[float]] = []
        at = 0

        def build() -> int:
            nonlocal at
            kind, feature, threshold, value = lines[at]
            at += 1
            me = len(nodes)
            if kind == "Predict":
                nodes.append([-1, 0.0, me, me, float(value)])
                return me
            nodes.append([int(feature), float(threshold), 0, 0, 0.0])
            nodes[me][2] = build()
            at += 1  # its Else
            nodes[me][3] = build()
            return me

        build()
        out.append((float(weight), np.array(nodes)))
    return out


def apply_trees(trees: list[tuple[float, np.ndarray]] | boosting.Boosted, x: np.ndarray) -> np.ndarray:
    """Predictions; for boosting's models x may also be their bins."""
    if isinstance(trees, boosting.Boosted):
        return boosting.apply(trees, np.ascontiguousarray(x.T) if x.dtype == np.uint8 else boosting.binned(trees.borders, x))
    out = np.zeros(len(x))
    rows = np.arange(len(x))
    for weight, nodes in trees:
        feature, left, right = nodes[:, 0].astype(int), nodes[:, 2].astype(int), nodes[:, 3].astype(int)
        at = np.zeros(len(x), int)
        while (feature[at] >= 0).any():
            # a leaf leads to itself
            at = np.where(x[rows, np.maximum(feature[at], 0)] <= nodes[at, 1], left[at], right[at])
        out += weight * nodes[at, 4]
    return out


def fit_trees(rows: DataFrame, groups: list[tuple[object, Column]], parameters: list[tuple[int, int, float]], trees: int, seed: int, x: str = "x", target: str = "y", case: str = "case_id", jobs: int = 4) -> list[list]:
    """Flat trees for each group (a name and which rows train it) and each of its parameters, `jobs` fits at a time.

    Each case of a group weighs the same. The learner is MLlib's boosting, with `trees` trees. It runs a few jobs for
    each level of each tree, and each of their tasks reports to the driver, the counters of all steps that led to its
    rows included: rows are kept without these steps, in one task for EACH of them. Bags are drawn by task and place, so
    that rows are dealt and sorted alike whatever the session's number of partitions.
    """
    from pyspark.ml.functions import array_to_vector
    from pyspark.ml.regression import GBTRegressor

    dealt = rows.repartition(rows.count() // EACH + 1, case).withColumn("_n", F.count("*").over(Window.partitionBy(case))).sortWithinPartitions(case, target, x)
    ready = once(dealt.select(*(c for c in rows.columns if c != x), array_to_vector(x).alias("_v"), (1 / F.col("_n")).alias("_w"))).persist()

    def fit(task) -> list:
        (_, where), (depth, leaf, rate) = task
        learner = GBTRegressor(featuresCol="_v", labelCol=target, weightCol="_w", maxDepth=depth, minInstancesPerNode=leaf, stepSize=rate, maxIter=trees, subsamplingRate=0.9, seed=seed)
        return flat_trees(learner.fit(ready.where(where)))

    try:
        with ThreadPool(jobs) as pool:
            found = pool.map(fit, [(g, p) for g in groups for p in parameters], 1)
    finally:
        ready.unpersist()
    return [found[k * len(parameters) : (k + 1) * len(parameters)] for k in range(len(groups))]


def tree_grid(rows: DataFrame, folds: DataFrame, grid: tuple = TREE_GRID, trees: int = 150, seed: int = 42, x: str = "x", target: str = "y", case: str = "case_id", learner: Callable = fit_trees) -> DataFrame:
    """parameter, depth, leaf, rate, mae (balanced over cases, mean over folds) and best, the first of the least.

    learner: fit_trees() or boosting.fit_together(), which grows all models in the same passes over the rows. All models
    of all folds are applied in one pass.
    """
    joined = rows.join(folds, case)
    names = [r[0] for r in folds.select("fold").distinct().orderBy("fold").collect()]
    models = dict(zip(names, learner(joined, [(f, F.col("fold") != f) for f in names], list(grid), trees, seed, x, target, case), strict=True))

    def score(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in batches:
            if len(frame):
                z, y = np.stack(frame[x].to_numpy()), frame[target].to_numpy(float)
                wrong = np.empty((len(frame), len(grid)))
                for f, at in frame.groupby("fold").indices.items():
                    wrong[at] = np.stack([np.abs(apply_trees(m, z[at]) - y[at]) for m in models[f]], axis=1)
                yield case_sums(frame[["fold", case]], wrong)

    kinds = ", ".join(f"{c} {joined.schema[c].dataType.simpleString()}" for c in ("fold", case))
    sums = joined.select("fold", case, x, target).mapInPandas(score, f"{kinds}, n long, wrong array<double>")
    cases = sums.select("fold", case, "n", F.posexplode("wrong").alias("parameter", "e")).groupBy("fold", case, "parameter").agg((F.sum("e") / F.sum("n")).alias("mae"))
    means = cases.groupBy("fold", "parameter").agg(F.avg("mae").alias("mae")).groupBy("parameter").agg(F.avg("mae").alias("mae"))
    points = rows.sparkSession.createDataFrame([(k, *p) for k, p in enumerate(grid)], "parameter int, depth int, leaf int, rate double")
    # one row for each point of the grid
    return means.join(points, "parameter").select("parameter", "depth", "leaf", "rate", "mae", (F.row_number().over(Window.orderBy("mae", "parameter")) == 1).alias("best"))


def donors(held: DataFrame, seed: int, case: str = "case_id") -> DataFrame:
    """held, the (run, case) that runs leave out, with `_from`: in each run the cases stand in a seeded ring, and each takes
    from the one before it."""
    ring = numbered(held.select("run", case).withColumn("_draw", draw(seed, F.col("run"), F.col(case))), ["_draw", case], "_i", by=["run"]).select("run", case, "_i")
    sizes = held.groupBy("run").agg(F.count("*").alias("_cases"))
    if sizes.where("_cases < 2").limit(1).count():
        raise ContractError("blocks are exchanged between cases, so that each run must hold out two at least")
    ring = ring.join(F.broadcast(sizes), "run")  # a row for each run
    return ring.join(ring.select("run", F.col(case).alias("_from"), F.pmod(F.col("_i") + 1, F.col("_cases")).alias("_i")), ["run", "_i"]).select("run", case, "_from")


def case_blocks(rows: DataFrame, borders: tuple[np.ndarray, ...] | None, x: str, target: str, case: str, time: str) -> DataFrame:
    """case, `n`, and the bytes of its x (its bins if there are borders) and target in time order: a row for each case."""
    lists = rows.groupBy(case).agg(F.array_sort(F.collect_list(F.struct(F.col(time).alias("t"), F.col(x).cast("array<double>").alias("x"), F.col(target).cast("double").alias("y")))).alias("rows"))

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                n, flat = batch.column(1).value_lengths().to_numpy(), batch.column(1).flatten()
                z = flat.field("x").flatten().to_numpy().reshape(len(flat), -1)
                z = z if borders is None else np.ascontiguousarray(boosting.binned(borders, z).T)
                upto = n.cumsum()
                cut = lambda v: pa.array([v[b - k : b].tobytes() for b, k in zip(upto, n, strict=True)], pa.binary())  # noqa: E731, B023
                yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(n, pa.int64()), cut(z), cut(flat.field("y").to_numpy())], ["case", "n", "x", "y"])

    kind = rows.schema[case].dataType.simpleString()
    return lists.mapInArrow(pack, f"case {kind}, n long, x binary, y binary")


def permutation_gains(rows: DataFrame, held: DataFrame, models: dict, groups: dict[str, list[int]], seed: int = 42, x: str = "x", target: str = "y", case: str = "case_id", time: str = "final_ts") -> DataFrame:
    """run, feature, baseline, permuted and gain: balanced errors of a run's model on its held-out cases, as they are and
    with all lags of a feature from another case, whose places are stretched over this one's length in time order.

    held: (run, case). A case travels as one row of bytes and meets its donor once for each run that holds it out; the
    copies of all features are made and scored in that one pass, and only sums by run leave it. Within a run all features
    take the same donors.
    """
    names = list(groups)
    together = all(isinstance(m, boosting.Boosted) for m in models.values())
    borders = next(iter(models.values())).borders if together else None
    kind = np.uint8 if together else np.float64

    def error(run, z: np.ndarray, y: np.ndarray, first: np.ndarray, n: np.ndarray) -> float:
        return float((np.add.reduceat(np.abs(apply_trees(models[run], z) - y), first) / n).sum())

    def scored(frame: pd.DataFrame) -> Iterator[tuple]:
        for run, part in frame.groupby("run"):
            n, y = part["n"].to_numpy(), np.frombuffer(b"".join(part["y"]))
            mine, source = (np.frombuffer(b"".join(part[c]), kind).reshape(k, -1) for c, k in (("x", n.sum()), ("_x", part["_n"].sum())))
            first, lent = n.cumsum() - n, part["_n"].to_numpy()
            rows_of = lambda v: np.repeat(v, n)  # noqa: E731, B023
            step = np.rint((np.arange(len(y)) - rows_of(first)) * rows_of(lent - 1) / np.maximum(rows_of(n) - 1, 1)).astype(int)
            donor = source[rows_of(lent.cumsum() - lent) + step]
            wrong = [error(run, mine, y, first, n)]
            for f in names:
                moved = mine.copy()
                moved[:, groups[f]] = donor[:, groups[f]]
                wrong.append(error(run, moved, y, first, n))
            yield run, len(n), wrong

    def score(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        waiting: list[pd.DataFrame] = []
        size = 0
        for frame in batches:
            waiting.append(frame)
            size += int(frame["x"].map(len).sum() + frame["_x"].map(len).sum())
            # many cases of a run at a time, so that calls of models are few
            if size >= 1 << 26:
                yield pd.DataFrame(scored(pd.concat(waiting)), columns=["run", "cases", "wrong"])
                waiting, size = [], 0
        if size:
            yield pd.DataFrame(scored(pd.concat(waiting)), columns=["run", "cases", "wrong"])

    blocks = once(case_blocks(rows, borders, x, target, case, time))
    source = blocks.select(F.col("case").alias("_from"), F.col("n").alias("_n"), F.col("x").alias("_x"))
    pairs = donors(held, seed, case).join(source, "_from").withColumnRenamed(case, "case").join(blocks, "case")
    sums = pairs.select("run", "n", "x", "y", "_n", "_x").mapInPandas(score, f"run {held.schema['run'].dataType.simpleString()}, cases long, wrong array<double>")
    errors = sums.select("run", "cases", F.posexplode("wrong").alias("at", "e")).groupBy("run", "at").agg((F.sum("e") / F.sum("cases")).alias("e"))
    base = errors.where("at = 0").select("run", F.col("e").alias("baseline"))
    name = F.element_at(F.array(*(F.lit(f) for f in names)), F.col("at"))
    return errors.where("at > 0").join(base, "run").select("run", name.alias("feature"), "baseline", F.col("e").alias("permuted"), (F.col("e") - F.col("baseline")).alias("gain"))


def tree_stability(rows: DataFrame, groups: dict[str, list[int]], parameters: tuple[int, int, float] = TREE_GRID[0], runs: int = 100, fraction: float = 0.5, trees: int = 150, seed: int = 42, x: str = "x", target: str = "y", case: str = "case_id", time: str = "final_ts", learner: Callable = fit_trees) -> DataFrame:
    """permutation_gains() of a model for each of `runs` subsamples of cases, on the cases that it leaves out.

    learner: as in tree_grid().
    """
    drawn = once(subsample(rows, fraction, runs, seed, case))
    joined = rows.join(drawn.where("chosen").groupBy(case).agg(F.collect_set("run").alias("_runs")), case)
    names = [r[0] for r in drawn.select("run").distinct().orderBy("run").collect()]
    found = learner(joined, [(r, F.array_contains("_runs", F.lit(r))) for r in names], [parameters], trees, seed, x, target, case)
    models = {r: m[0] for r, m in zip(names, found, strict=True)}
    held = drawn.where(~F.col("chosen")).select("run", case)
    return permutation_gains(rows, held, models, groups, seed, x, target, case, time)


def gain_summary(gains: DataFrame, thresholds: tuple[float, ...] = THRESHOLDS, stable: float = STABLE) -> DataFrame:
    """Per feature: probability of a gain over 0, its mean, sample deviation and median over runs, flags, and stable."""
    g = F.col("gain")
    out = gains.groupBy("feature").agg(F.avg((g > 0).cast("double")).alias("probability"), F.avg(g).alias("mean"), F.stddev_samp(g).alias("std"), F.median(g).alias("median"), F.count("*").alias("runs"))
    return out.select("*", *flags(thresholds), (F.col("probability") >= stable).alias("stable"))

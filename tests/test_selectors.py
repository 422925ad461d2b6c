"""The balanced selectors against plain restatements in NumPy and pandas."""

import numpy as np
import pandas as pd
import pytest

from casewise.operators import select, selectors, splits
from casewise.operators.contracts import ContractError

GROUPS = {"a": [0, 2], "b": [1, 3], "c": [4]}


@pytest.fixture(scope="module")
def windows(spark):
    r = np.random.default_rng(3)
    rows = []
    for case in range(12):
        n = int(r.integers(3, 40))
        x = r.normal(size=(n, 5)) * [1, 5, 1, 0.2, 1] + [0, 10, 0, case / 10, 0]
        y = 2 * x[:, 0] + 0.5 * x[:, 1] - x[:, 2] ** 2 + r.normal(size=n) * 0.3 + case / 4
        rows += [(case, int(10 * k), [float(v) for v in x[k]], float(y[k])) for k in range(n)]
    frame = pd.DataFrame(rows, columns=["case_id", "final_ts", "x", "y"])
    df = spark.createDataFrame(frame, "case_id long, final_ts long, x array<double>, y double").repartition(3).persist()
    df.count()
    return frame, df


def balanced_mae(frame, predicted):
    return float((frame["y"] - predicted).abs().groupby(frame["case_id"]).mean().mean())


def plain_net(frame, alpha, l1):
    """Proximal gradient on the weighted loss of scaled rows: (mean, scale, intercept, coefficients)."""
    x, y = np.stack(frame["x"].to_numpy()), frame["y"].to_numpy()
    mean, scale = x.mean(0), x.std(0)
    z = (x - mean) / scale
    w = (1 / frame.groupby("case_id")["y"].transform("count")).to_numpy()
    w = w / w.sum()
    zc, yc = z - w @ z, y - w @ y
    s, c = zc.T @ (zc * w[:, None]), zc.T @ (w * yc)
    step = 1 / (np.linalg.eigvalsh(s)[-1] + alpha * (1 - l1))
    b = np.zeros(x.shape[1])
    for _ in range(20_000):
        g = b - step * (s @ b - c + alpha * (1 - l1) * b)
        b = np.sign(g) * np.maximum(np.abs(g) - step * alpha * l1, 0)
    return mean, scale, w @ y - (w @ z) @ b, b


def predict(model, frame):
    mean, scale, free, b = model
    return free + ((np.stack(frame["x"].to_numpy()) - mean) / scale) @ b


def test_net_grid_and_path(spark, windows):
    frame, df = windows
    folds = splits.folds(df, 3, case="case_id")
    of = {r.case_id: r.fold for r in folds.collect()}
    grid = [(0.01, 0.5), (0.3, 0.9), (0.3, 0.1)]
    table, path = selectors.net_grid(df, select.case_moments(df, "x", "y"), folds, grid)
    got = {r.parameter: r for r in table.collect()}
    coefficients = {(r.fold, r.parameter, r.column): r.coefficient for r in path.collect()}
    scores = []
    for k, (alpha, l1) in enumerate(grid):
        found = []
        for f in range(3):
            inside = frame["case_id"].map(of) == f
            model = plain_net(frame[~inside], alpha, l1)
            assert np.allclose([coefficients[f, k, j] for j in range(5)], model[3], atol=1e-6)
            found.append(balanced_mae(frame[inside], predict(model, frame[inside])))
        scores.append(np.mean(found))
        assert abs(got[k].mae - scores[-1]) < 1e-6
    assert [r.parameter for r in got.values() if r.best] == [int(np.argmin(scores))]


def test_net_stability(spark, windows):
    frame, df = windows
    moments = select.case_moments(df, "x", "y")
    fits = selectors.net_stability(moments, GROUPS, 0.5, 0.9, 4).collect()
    drawn = splits.subsample(df, 0.5, 4, case="case_id").where("chosen").collect()
    for run in range(4):
        model = plain_net(frame[frame["case_id"].isin([r.case_id for r in drawn if r.run == run])], 0.5, 0.9)
        for name, at in GROUPS.items():
            mine = next(r for r in fits if r.run == run and r.feature == name)
            b = model[3][at]
            assert mine.selected == bool((np.abs(b) > 1e-10).any())
            assert abs(mine.strongest - b[np.argmax(np.abs(b))]) < 1e-6 and abs(mine.total - np.abs(b).sum()) < 1e-6
    rows = [(k, "a", k != 0, v, 0.0) for k, v in enumerate([0.0, 1.0, -2.0, 3.0])] + [(k, "b", False, 0.0, 0.0) for k in range(4)]
    s = {r.feature: r for r in selectors.net_summary(spark.createDataFrame(rows, "run long, feature string, selected boolean, strongest double, total double")).collect()}
    assert (s["a"].probability, s["a"].median, s["a"].median_abs, s["a"].sign) == (0.75, 1.0, 2.0, "positive") and abs(s["a"].consistency - 2 / 3) < 1e-12
    assert (s["b"].probability, s["b"].median, s["b"].consistency, s["b"].sign) == (0.0, 0.0, 0.0, "mixed_or_zero")
    assert s["a"].selected_at_0_7 and not s["a"].selected_at_0_8


def test_flat_trees_predict_as_the_model(spark, windows):
    from pyspark.ml.functions import array_to_vector
    from pyspark.ml.regression import GBTRegressor

    frame, df = windows
    ready = df.withColumn("_v", array_to_vector("x"))
    model = GBTRegressor(featuresCol="_v", labelCol="y", maxDepth=3, maxIter=5, seed=1).fit(ready)
    want = model.transform(ready).select("case_id", "final_ts", "prediction").toPandas().sort_values(["case_id", "final_ts"])
    ordered = frame.sort_values(["case_id", "final_ts"])
    assert np.allclose(selectors.apply_trees(selectors.flat_trees(model), np.stack(ordered["x"].to_numpy())), want["prediction"], atol=1e-12)


def ring_donors(frame, held, seed, run):
    import hashlib

    at = lambda c: (int(hashlib.md5(f"{seed}:{run}:{c}".encode()).hexdigest()[:8], 16), c)
    order = sorted(held, key=at)
    return {c: order[k - 1] for k, c in enumerate(order)}


def test_gains_of_all_features_in_one_pass(spark, windows):
    frame, df = windows
    tree = [(1.0, np.array([[0, 0.0, 1, 2, 0], [-1, 0, 1, 1, -1.0], [1, 10.0, 3, 4, 0], [-1, 0, 3, 3, 2.0], [-1, 0, 4, 4, 5.0]])), (0.5, np.array([[4, 0.1, 1, 2, 0], [-1, 0, 1, 1, 0.0], [-1, 0, 2, 2, 1.0]]))]
    held = {0: [1, 2, 5, 7], 1: [0, 3, 11]}
    table = spark.createDataFrame([(r, c) for r, cs in held.items() for c in cs], "run long, case_id long")
    got = {(r.run, r.feature): (r.baseline, r.gain) for r in selectors.permutation_gains(df, table, {0: tree, 1: tree[:1]}, GROUPS, seed=9).collect()}
    assert len(got) == 6
    for run, cases in held.items():
        part = frame[frame["case_id"].isin(cases)].sort_values(["case_id", "final_ts"])
        blocks = {c: np.stack(g["x"].to_numpy()) for c, g in part.groupby("case_id")}
        donors = ring_donors(frame, cases, 9, run)
        model = tree if run == 0 else tree[:1]
        base = balanced_mae(part, selectors.apply_trees(model, np.stack(part["x"].to_numpy())))
        for name, at in GROUPS.items():
            moved = []
            for c, z in blocks.items():
                source = blocks[donors[c]]
                z = z.copy()
                z[:, at] = source[np.rint(np.linspace(0, len(source) - 1, len(z))).astype(int)][:, at]
                moved.append(z)
            wrong = balanced_mae(part, selectors.apply_trees(model, np.concatenate(moved)))
            assert np.allclose(got[run, name], (base, wrong - base), atol=1e-9)
    with pytest.raises(ContractError):
        selectors.permutation_gains(df, table.where("case_id = 1"), {0: tree}, GROUPS)


def test_tree_selector_finds_what_counts(spark, windows):
    frame, df = windows
    gains = selectors.tree_stability(df, GROUPS, (3, 1, 0.3), runs=4, trees=8).persist()
    s = {r.feature: r for r in selectors.gain_summary(gains).collect()}
    assert gains.count() == 12 and s["a"].stable and s["a"].mean > 0 and s["a"].mean > s["c"].mean and s["a"].runs == 4
    table = selectors.tree_grid(df, splits.folds(df, 2, case="case_id"), ((1, 1, 0.1), (3, 1, 0.3)), trees=5).collect()
    assert [r.parameter for r in table if r.best] == [min(table, key=lambda r: (r.mae, r.parameter)).parameter] and len(table) == 2


def test_missing_values_are_filled_not_skipped(spark):
    df = spark.createDataFrame([(1, [1.0, None]), (2, [3.0, 5.0]), (3, [float("nan"), 7.0])], "case_id long, x array<double>")
    assert {r.case_id: r.x for r in selectors.filled(df).collect()} == {1: [1.0, 6.0], 2: [3.0, 5.0], 3: [2.0, 7.0]}


def test_case_moments_where_a_task_has_no_case_left(spark):
    """Empty tasks, a case that several tasks meet, and a last batch after which nothing is open."""
    rows = spark.range(1400).selectExpr("id % 700 as case_id", "array(1D, id) as x", "2D as y")
    for df in (rows.coalesce(1), rows.repartition(3), rows.where("case_id < 2").repartition(12)):
        found = select.case_moments(df, "x", "y").collect()
        assert len(found) == len({r.case_id for r in found}) and {r.n for r in found} == {2}
        one = next(r for r in found if r.case_id == 1)
        z = np.array([[1, 1, 1, 2], [1, 1, 701, 2]], float)
        assert np.allclose(one.gram, (z.T @ z).ravel())
    assert select.case_moments(rows.where("false"), "x", "y").count() == 0

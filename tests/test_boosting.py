"""The learner that grows all models together, against a plain restatement."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from casewise.operators import boosting, selectors, splits
from casewise.plans import comparison

GRID = [(2, 3, 0.3), (3, 1, 0.1)]
NAMES = ["even", "all", "few"]


def groups():
    return list(zip(NAMES, [F.col("case_id") % 2 == 0, F.lit(True), F.col("case_id") < 5], strict=True))


def frame():
    r = np.random.default_rng(5)
    rows = []
    for case in range(14):
        for k in range(int(r.integers(2, 30))):
            x = np.round(r.normal(size=5) * [1, 4, 1, 2, 1], 1)
            rows.append((case, k, [float(v) for v in x], float(2 * (x[0] > 0.2) + x[1] * (x[2] > 0) + r.normal() / 4)))
    return rows


@pytest.fixture(scope="module")
def table(spark):
    rows = frame()
    return rows, spark.createDataFrame(rows, "case_id long, final_ts long, x array<double>, y double").repartition(3).persist()


def plain(rows, inside, parameter, model, places, trees, seed, borders):
    """Predictions for all rows of one model; each split is sought among all borders by sums over rows."""
    rows = sorted(rows, key=lambda r: (r[0], r[3], r[2]))
    x, y, case = np.array([r[2] for r in rows]), np.array([r[3] for r in rows]), np.array([r[0] for r in rows])
    one = np.array([1 / np.sum(case == c) for c in case])
    at = np.flatnonzero(inside(case))
    depth, least, rate = parameter
    weight = one[at] * len(at) / one[at].sum()
    out = np.full(len(y), (weight @ y[at]) / weight.sum())
    block = boosting.Block((0, 0), None, y, None, None, [])
    plan = boosting.Plan([], [], [], [], [], [], places, seed, boosting.SHARE)
    for t in range(trees):
        chance = np.random.default_rng([seed, t]).random((len(NAMES) * len(GRID), places))[model]
        columns = np.flatnonzero(chance.argsort().argsort() < int(0.9 * places))
        w = weight * boosting.drawn(plan, model, t, block, len(at))
        g = w * (out[at] - y[at])

        def grow(train, every, left, g=g, w=w, columns=columns):
            """Adds the tree under these rows of the model, for `every` row that comes here."""
            score = lambda k: g[k].sum() ** 2 / (w[k].sum() + 1)
            best, split = 1e-6, None
            for j in columns if left else ():
                for b in borders[j]:
                    low, high = train[x[at[train], j] <= b], train[x[at[train], j] > b]
                    if min(w[low].sum(), w[high].sum()) >= least and score(low) + score(high) - score(train) > best + 1e-9:
                        best, split = score(low) + score(high) - score(train), (j, b)
            if split is None:
                out[every] -= rate * g[train].sum() / (w[train].sum() + 1)
                return
            j, b = split
            for side in (lambda v: v <= b, lambda v: v > b):
                grow(train[side(x[at[train], j])], every[side(x[every, j])], left - 1)

        grow(np.arange(len(at)), np.arange(len(y)), depth)
    return x, out


def test_models_that_grow_together_equal_each_grown_alone(table):
    rows, df = table
    found = boosting.fit_together(df, groups(), GRID, 6, 11)
    inside = [lambda c: c % 2 == 0, lambda c: c >= 0, lambda c: c < 5]
    for k in range(len(NAMES)):
        for p, parameter in enumerate(GRID):
            m = found[k][p]
            x, want = plain(rows, inside[k], parameter, k * len(GRID) + p, 5, 6, 11, m.borders)
            assert np.allclose(selectors.apply_trees(m, x), want, atol=1e-4), (k, p)
            assert m.feature.shape == (6, 2 ** parameter[0] - 1)


def test_models_do_not_follow_partitions_or_block_sums(spark, table):
    _, df = table
    found = []
    for n in ("3", "7"):
        spark.conf.set("spark.sql.shuffle.partitions", n)
        found.append(boosting.fit_together(df.repartition(int(n)), groups(), GRID, 4, 3))
    spark.conf.set("spark.sql.shuffle.partitions", "4")
    for a, b in zip(sum(found[0], []), sum(found[1], []), strict=True):
        assert a.base == b.base and all(np.array_equal(getattr(a, c), getattr(b, c)) for c in ("feature", "cut", "value"))


def test_blocks_and_tasks_add_up(spark, table, monkeypatch):
    """Several blocks: their bags differ, so that all rows are met."""
    _, df = table
    monkeypatch.setattr(boosting, "SHARE", 1.0)
    whole = boosting.fit_together(df, groups(), GRID, 4, 3)
    borders = whole[0][0].borders
    monkeypatch.setattr(boosting, "EACH", 40)
    monkeypatch.setattr(boosting, "borders_of", lambda *_: borders)
    for a, b in zip(sum(whole, []), sum(boosting.fit_together(df, groups(), GRID, 4, 3), []), strict=True):
        assert np.array_equal(a.feature, b.feature) and np.array_equal(a.cut, b.cut) and np.allclose(a.value, b.value, atol=1e-5)


def test_grid_by_models_grown_together(table):
    rows, df = table
    folds = splits.folds(df, 3, case="case_id")
    of = {r.case_id: r.fold for r in folds.collect()}
    got = selectors.tree_grid(df, folds, tuple(GRID), trees=5, learner=boosting.fit_together).collect()
    models = boosting.fit_together(df.join(folds, "case_id"), [(f, F.col("fold") != f) for f in range(3)], GRID, 5, 42)
    for r in got:
        errors = []
        for f in range(3):
            cases = [c for c in of if of[c] == f]
            mine = [[q for q in rows if q[0] == c] for c in cases]
            errors.append(np.mean([np.mean(np.abs(selectors.apply_trees(models[f][r.parameter], np.array([q[2] for q in c])) - [q[3] for q in c])) for c in mine]))
        assert abs(r.mae - np.mean(errors)) < 1e-9
    assert len(got) == 2 and sum(r.best for r in got) == 1


def test_query_of_the_grid_does_the_original_s_job(table, monkeypatch):
    """Three folds, three parameters, 150 trees."""
    _, df = table
    seen = {}
    monkeypatch.setattr(comparison, "flat", lambda *_: df)
    monkeypatch.setattr(selectors, "apply_trees", lambda trees, x: seen.setdefault(1, trees) and np.zeros(len(x)))
    fit = boosting.fit_together
    monkeypatch.setattr(boosting, "fit_together", lambda rows, groups, parameters, trees, *rest: seen.update(job=(len(groups), len(parameters), trees)) or fit(rows, groups, parameters, 1, *rest))
    comparison.QUERIES["f6_tree_grid"](df.sparkSession, "")
    assert seen["job"] == (3, 3, 150)


def test_gains_of_binned_models_equal_those_of_plain_trees(table):
    """Bins travel in place of values; a tree in nodes with the borders as thresholds gives the same gains."""
    _, df = table
    held = df.select((F.col("case_id") % 2).cast("long").alias("run"), "case_id").distinct()
    models = {r: m[0] for r, m in enumerate(boosting.fit_together(df, [(r, F.col("case_id") % 2 != r) for r in (0, 1)], [(2, 1, 0.3)], 3, 1))}

    def nodes_of(m):
        out = [(1.0, np.array([[-1, 0, 0, 0, m.base]]))]
        for feature, cut, value in zip(m.feature, m.cut, m.value, strict=True):
            inner = [[f, m.borders[f][c] if c < 255 else np.inf, 2 * k + 1, 2 * k + 2, 0] for k, (f, c) in enumerate(zip(feature, cut, strict=True))]
            out.append((1.0, np.array(inner + [[-1, 0, k, k, v] for k, v in enumerate(value, len(inner))])))
        return out

    features = {"a": [0, 2], "b": [1, 3], "c": [4]}
    got, want = ({(r.run, r.feature): (r.baseline, r.gain) for r in selectors.permutation_gains(df, held, m, features, seed=4).collect()} for m in (models, {r: nodes_of(m) for r, m in models.items()}))
    assert len(got) == 6 and all(np.allclose(got[k], want[k], atol=1e-9) for k in got) and max(g for _, g in got.values()) > 0.1


def test_query_of_stability_does_the_original_s_job(table, monkeypatch):
    """A hundred subsamples and 150 trees each."""
    _, df = table
    seen = {}
    monkeypatch.setattr(comparison, "flat", lambda *_: df)
    monkeypatch.setattr(comparison, "LAGS", {"a": [0, 2], "b": [1, 3]})
    fit = boosting.fit_together
    monkeypatch.setattr(boosting, "fit_together", lambda rows, groups, parameters, trees, *rest: seen.update(job=(len(groups), trees)) or fit(rows, groups, parameters, 2, *rest))
    found = comparison.QUERIES["f6_tree_stability"](df.sparkSession, "").collect()
    assert seen["job"] == (100, 150) and {r.feature: r.runs for r in found} == {"a": 100, "b": 100}

"""What showed on larger tables only, on small frames."""

import random

import numpy as np
import pandas as pd
from pyspark.sql import functions as F

from casewise.operators import pk, runs, selectors, splits
from casewise.plans import comparison


def test_exponentials_are_those_of_each_matrix():
    r = np.random.default_rng(5)
    a = np.stack([pk.system(*r.uniform(0.1, 9, 7)) * g for g in (0, 1, 10, 500, 40_000)])
    assert np.allclose(pk.exponentials(a), np.stack([pk.exponential(m) for m in a]), atol=1e-12)
    assert pk.exponentials(np.empty((0, 5, 5))).shape == (0, 5, 5)


def test_concentrations_where_batches_cut_chunks(spark):
    r = random.Random(4)
    rows = [(c, t, None if r.random() < 0.3 else r.uniform(0, 90), 0.0) for c in range(6) for t in sorted(r.sample(range(200), 60))]
    df = spark.createDataFrame(rows, "caseid long, time_sec long, rate double, volume double")
    people = spark.createDataFrame([(c, 30.0 + c, c % 2, 170.0, 70.0 + c) for c in range(6)], "caseid long, age double, sex_male int, height double, weight double")
    find = lambda: {(q.caseid, q.time_sec): q for q in pk.concentrations(df, "rate", pk.propofol_parameters(people), ["volume"], hold=30, span=50).collect()}
    whole = find()
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "7")
    try:
        cut = find()
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    assert len(whole) == len(rows) and set(cut) == set(whole)
    for key, q in whole.items():
        other = cut[key]
        assert q.status == other.status and (q.plasma is None) == (other.plasma is None)
        assert q.plasma is None or abs(q.plasma - other.plasma) < 1e-9 and abs(q.effect - other.effect) < 1e-9


def test_front_where_each_evaluation_gives_another_last_digit(spark):
    """As sums of doubles do, whose order differs from one evaluation to the next."""
    jitter = F.udf(lambda k: 5 + k + random.random() * 1e-9, "double").asNondeterministic()
    c = spark.range(8).repartition(3).select((F.col("id") % 2).cast("string").alias("g"), F.col("id").cast("string").alias("name"), F.lit(1).alias("cost"), jitter("id").alias("error"))
    found = runs.pareto(c, "g", "name", "cost", "error").collect()
    assert len(found) == 8 and sorted(r.name for r in found if r.on_front and r.is_best) == ["0", "1"]
    assert all(("0" if r.g == "0" else "1") in r.dominators for r in found if not r.on_front)


def test_cost_of_half_goes_to_the_even_number(spark, monkeypatch):
    """As the SQL's cast does: 2 runs with 39 and 38 cases make 40.5, so 40 (5 modulo 7), not 41."""
    table = spark.createDataFrame([("F", "a", 1.0, 39), ("F", "a", 2.0, 38)], "model string, condition string, case_mae double, cases int")
    monkeypatch.setattr(comparison, "runt", lambda spark, d: table)
    assert [r.cost for r in comparison.cand(spark, "").collect()] == [40 % 7]


def test_case_bootstrap_draws_inside_tasks(spark, monkeypatch):
    import hashlib

    from casewise.functions import draws
    from casewise.operators import bootstrap

    of = lambda k, j: int(hashlib.md5(f"42:{k}:{j}".encode()).hexdigest()[:8], 16)
    assert np.concatenate(list(draws("42:7:", 12_000))).tolist() == [of(7, j) for j in range(12_000)]
    values = [float(k * k % 17) if k % 5 else None for k in range(23)]
    df = spark.createDataFrame(list(enumerate(values)), "case_id long, v double")
    for block in (4, 1 << 22):
        monkeypatch.setattr(bootstrap, "BLOCK", block)
        got = {r.replicate: r.value for r in bootstrap.case_bootstrap(df, "v", "case_id", 70).collect()}
        assert len(got) == 70
        for k, mean in got.items():
            held = [v for j in range(23) if (v := values[of(k, j) % 23]) is not None]
            assert abs(mean - sum(held) / len(held)) < 1e-9


def boosted(spark):
    r = random.Random(8)
    rows = [(c, t, [r.gauss(0, 1), r.gauss(0, 1)], r.gauss(c % 5, 1)) for c in range(30) for t in range(12)]
    return spark.createDataFrame(rows, "case_id long, final_ts long, x array<double>, y double")


def test_learner_has_few_tasks_and_forgets_earlier_steps(spark, monkeypatch):
    """Each task of each of its jobs reports to the driver, for all steps that its rows come from."""
    from pyspark.ml.regression import GBTRegressor

    df, seen, fit = boosted(spark), [], GBTRegressor.fit
    monkeypatch.setattr(GBTRegressor, "fit", lambda self, ready: seen.append((ready.rdd.getNumPartitions(), ready.rdd.toDebugString().decode())) or fit(self, ready))
    # shuffles are not put together here, as is so with those of a large table
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        folds = splits.folds(df, 2, case="case_id")
        found = []
        for n in ("5", "9"):
            spark.conf.set("spark.sql.shuffle.partitions", n)
            found.append(sorted((r.parameter, round(r.mae, 9)) for r in selectors.tree_grid(df, folds, ((2, 1, 0.3), (3, 1, 0.3)), trees=3).collect()))
    finally:
        spark.conf.unset("spark.sql.adaptive.enabled")
        spark.conf.set("spark.sql.shuffle.partitions", "4")
    assert len(seen) == 8 and {n for n, _ in seen} == {1} and not any("Shuffled" in steps for _, steps in seen)
    assert found[0] == found[1]


def test_medians_compute_their_rows_once(spark):
    count = spark.sparkContext.accumulator(0)
    step = F.udf(lambda v: count.add(1) or v, "double").asNondeterministic()
    df = spark.range(40).repartition(2).select(F.array(step(F.col("id").cast("double")), F.lit(None).cast("double")).alias("x"))
    found = selectors.filled(df)
    assert sorted(r.x[0] for r in found.collect()) == list(range(40)) and count.value == 40


def test_models_meet_whole_batches_not_cases(spark, monkeypatch):
    calls, apply = spark.sparkContext.accumulator(0), selectors.apply_trees
    monkeypatch.setattr(selectors, "apply_trees", lambda trees, x: calls.add(1) or apply(trees, x))
    df = boosted(spark)
    stump = [(1.0, np.array([[0, 0.0, 1, 2, 0], [-1, 0, 1, 1, -1.0], [-1, 0, 2, 2, 1.0]]))]
    held = df.select((F.col("case_id") % 2).alias("run"), F.col("case_id")).distinct()
    gains = selectors.permutation_gains(df, held, {0: stump, 1: stump}, {"a": [0], "b": [1]}).collect()
    # a call for each run, feature (and none) and task; there are 15 cases in a run
    assert len(gains) == 4 and all(abs(r.gain) < 1e-12 for r in gains if r.feature == "b") and 0 < calls.value <= 2 * 3 * 4


def test_sums_by_case_are_those_of_each_case():
    r = np.random.default_rng(2)
    keys, wrong = pd.DataFrame({"run": r.integers(0, 3, 200), "case_id": r.integers(0, 9, 200)}), r.uniform(size=(200, 4))
    found = selectors.case_sums(keys, wrong)
    assert len(found) == len(keys.drop_duplicates()) and found["n"].sum() == 200
    for run, case, n, sums in found.itertuples(index=False):
        at = ((keys["run"] == run) & (keys["case_id"] == case)).to_numpy()
        assert n == at.sum() and np.allclose(sums, wrong[at].sum(0))

"""Hand-made frames with known answers."""

import math
import random

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from casewise import plans
from casewise import sources as src
from casewise.functions import nan_to_null, region, zone
from casewise.operators import bootstrap, clean, cohort, contracts, episodes, features, metrics, pairing, pk, prep, resample, runs, select, splits, weights, windows


def rows(df):
    return [tuple(r) for r in df.collect()]


def test_resample_skips_nulls(spark):
    data = [(c, t, 40.0 + 20 * (c - 1) + t, None if t in (3, 9) and c == 1 else float(t), t + 100.0 * (c - 1)) for c in (1, 2) for t in range(10)]
    df = spark.createDataFrame(data, "caseid long, time_sec long, bis double, rate double, volume double")
    got = rows(resample.resample(df, {"bis": "median", "rate": "last", "volume": "last"}, 10).orderBy("caseid"))
    assert got == [(1, 0, 44.5, 8.0, 9.0), (2, 0, 64.5, 9.0, 109.0)]
    with pytest.raises(contracts.ContractError):
        resample.resample(df, {"bis": "median"}, 10, static=["volume"])


def test_gap_guard_and_units(spark):
    df = spark.createDataFrame([(1, 0, 40.0), (1, 10, 50.0), (1, 30, 80.0)], "caseid long, timestamp long, bis double")
    got = rows(df.select("timestamp", (resample.guarded_delta("bis", 10) / 10).alias("slope")).orderBy("timestamp"))
    assert got == [(0, None), (10, 1.0), (30, None)]
    assert df.select(resample.pump_rate(F.lit(3.0)).alias("r")).first().r == 1.0
    with pytest.raises(Exception, match="negative"):
        df.select(resample.pump_rate(-F.col("bis"))).collect()


def test_dose_resets_and_recent(spark):
    df = spark.createDataFrame([(1, 10 * k, v) for k, v in enumerate([1.0, 2.0, 0.0])], "caseid long, timestamp long, v double")
    got = rows(resample.cumulative_dose(df, "v", 20).select("reset", "cumulative").orderBy("timestamp"))
    assert got == [(False, 0.0), (False, 20.0), (True, 20.0)]
    eight = spark.createDataFrame([(1, 10 * k, float(k)) for k in range(8)], "caseid long, timestamp long, v double")
    dose = resample.recent_dose(resample.cumulative_dose(eight, "v", 20), "cumulative", 60)
    assert [r.recent for r in dose.orderBy("timestamp").collect()] == [0, 20, 40, 60, 80, 100, 120, 120]


def test_windows_and_targets(spark):
    data = [(c, t, 61.0 if (c, t) == (1, 80) else 39.0 if (c, t) == (1, 90) else 50.0) for c in (1, 2) for t in range(0, 101, 10)]
    df = spark.createDataFrame(data, "caseid long, timestamp long, bis double")
    w = windows.windows(df, ["bis"], "bis").orderBy("case_id", "final_ts")
    assert w.count() == 6
    got = w.collect()
    assert [r.y_high for r in got[:3]] == [1, 0, 0] and [r.y_low for r in got[:3]] == [0, 1, 0]
    assert all(r.target_ts - r.final_ts == 30 and r.final_ts - r.first_ts == 50 and len(r.x) == 6 for r in got)
    assert windows.removed_windows(windows.endpoints(df, "bis")).first()[0] == 6
    faults = prep.window_faults(w, 6, 10, 30).first().asDict()
    assert faults["windows"] == 6 and sum(faults.values()) == 6
    holes = df.withColumn("bis", F.when(~((F.col("caseid") == 1) & (F.col("timestamp") == 80)), F.col("bis")))
    assert windows.windows(holes, ["bis"], "bis").where("case_id = 1").count() == 2
    gap = df.where("timestamp != 50")
    assert windows.windows(gap, ["bis"], "bis").count() == 0


def test_fit_uses_training_rows_only(spark):
    train = spark.createDataFrame([(1.0, 5.0, 1), (None, 5.0, 1), (3.0, 5.0, 0)], "signal double, constant double, sex int")
    s = {r.feature: r for r in prep.fit_scaling(train, ["signal", "constant", "sex"], ["sex"]).collect()}
    assert (s["signal"].fill, s["signal"].mean, s["constant"].scale, s["sex"].fill) == (2.0, 2.0, 1.0, 1.0)
    val = spark.createDataFrame([(1000.0, 5.0, 0)], train.schema)
    got = prep.apply_scaling(val, prep.fit_scaling(train, ["signal", "constant", "sex"], ["sex"])).first()
    assert got.signal > 100 and got.constant == 0 and got.sex == 0 and got.signal_observed
    with pytest.raises(ValueError, match="nothing seen"):
        prep.fit_scaling(train.withColumn("signal", F.lit(None).cast("double")), ["signal"])


def test_splits_and_folds(spark):
    assert splits.split_counts(3) == [1, 1, 1] and sum(splits.split_counts(11)) == 11
    df = spark.range(40).withColumnRenamed("id", "caseid")
    s = splits.case_split(df)
    assert sorted(rows(s)) == sorted(rows(splits.case_split(df.repartition(7)))) and s.count() == 40
    assert {r["split"]: r["count"] for r in s.groupBy("split").count().collect()} == {"train": 28, "val": 6, "test": 6}
    assert splits.split_faults(s, df).count() == 0
    assert sorted(r["count"] for r in splits.folds(df, 3).groupBy("fold").count().collect()) == [13, 13, 14]
    m = splits.multiplicities(df, 5)
    assert {r[1] for r in m.groupBy("replicate").agg(F.sum("copies")).collect()} == {40}
    w = splits.case_weights(spark.createDataFrame([(1,)] * 9 + [(2,)] * 2, "case_id long"))
    assert abs(w.agg(F.sum("weight")).first()[0] - 11) < 1e-9
    assert all(abs(r[1] - 5.5) < 1e-9 for r in w.groupBy("case_id").agg(F.sum("weight")).collect())


def test_metrics(spark):
    df = spark.createDataFrame([(0.0, 1.0), (2.0, 4.0)], "observed double, predicted double")
    r = metrics.regression(df).first()
    assert (r.mae, r.rmse) == (1.5, math.sqrt(2.5))
    data = [(0, 0.1), (0, 0.2), (1, 0.8), (1, 0.9)]
    levels = metrics.score_levels(spark.createDataFrame(data, "y int, s double"), "y", "s")
    assert rows(metrics.ranking(levels)) == [(1.0, 1.0)]
    one = metrics.score_levels(spark.createDataFrame([(1, 0.1)], "y int, s double"), "y", "s")
    assert rows(metrics.ranking(one)) == [(None, None)]
    rnd = random.Random(3)
    noisy = [(rnd.randrange(2), rnd.randrange(30) / 10) for _ in range(400)]
    pos, neg = [s for y, s in noisy if y], [s for y, s in noisy if not y]
    auc = sum((p > q) + (p == q) / 2 for p in pos for q in neg) / (len(pos) * len(neg))
    levels = metrics.score_levels(spark.createDataFrame(noisy, "y int, s double"), "y", "s")
    assert abs(metrics.ranking(levels).first().auroc - auc) < 1e-12
    f1 = {t: 2 * sum(p >= t for p in pos) / (sum(p >= t for p in pos) + sum(q >= t for q in neg) + len(pos)) for t in {s for _, s in noisy}}
    best = min(f1, key=lambda t: (-f1[t], t))
    got = metrics.best_threshold(levels, "s").first()
    assert got.threshold == best and abs(got.f1 - f1[best]) < 1e-12
    assert metrics.score_levels(spark.createDataFrame([], "y int, s double"), "y", "s").count() == 0


def test_cases_count_once(spark):
    df = spark.createDataFrame([(1, 50.0, 51.0)] * 9 + [(2, 50.0, 55.0)] * 2, "case_id long, observed double, predicted double")
    assert metrics.over_cases(metrics.regression(df, ["case_id"]), ["mae"]).first()["mean"] == 3.0


def test_alignment_finds_faults(spark):
    one = spark.createDataFrame([(1, 0.1), (2, 0.2), (2, 0.2), (None, 0.3)], "k int, v double")
    other = spark.createDataFrame([(1, 0.1), (3, 0.2), (None, 0.4)], "k int, v double")
    r = pairing.alignment(one, other, ["k"], ["v"]).first()
    assert (r.missing_left, r.missing_right, r.differ_v, r.copies_left, r.copies_right) == (1, 2, 1, 1, 0)
    with pytest.raises(contracts.ContractError):
        contracts.key_unique_join(other, one, ["k"])


def test_pareto(spark):
    df = spark.createDataFrame([("m", "a", 17, 1.0), ("m", "b", 13, 0.9), ("m", "c", 15, 1.1), ("m", "d", 11, 0.95)], "model string, name string, cost int, error double")
    got = {r.name: r for r in runs.pareto(df, "model", "name", "cost", "error").collect()}
    assert {k for k, r in got.items() if r.on_front} == {"b", "d"} and got["b"].is_best and got["d"].is_simplest
    assert got["a"].dominators == ["b", "d"]


def test_clean_path(spark):
    data = [(c, t, 50.0 if t % 7 else None, float(t) if t % 3 == 0 else None, 1.0 if 5 <= t <= 50 else 0.0) for c in (1, 2) for t in range(60 if c == 1 else 20)]
    df = spark.createDataFrame(data, "caseid long, time_sec long, bis double, hr double, ce double")
    filled = clean.bounded_fill(df, ["hr"], 1)
    assert filled.where("hr is null").count() == sum(t % 3 == 2 for _, t, *_ in data)
    out = plans.clean_table(df, spark.createDataFrame([(1, 70)], "caseid long, age int"), ["hr"], F.col("ce") > 0.05, rows=20)
    assert {r.caseid for r in out.collect()} == {1} and out.agg(F.min("time_sec"), F.max("time_sec")).first() == (5, 50)
    assert rows(spark.range(1).select(region(F.lit(40.0)), zone(F.lit(40.0)), region(F.lit(60.0)), zone(F.lit(60.5)))) == [("mid", "deep", "mid", "light")]
    codes = spark.createDataFrame([(" M ",), ("f",), ("x",), (None,)], "s string")
    assert [r[0] for r in codes.select(clean.encode_sex(F.col("s"))).collect()] == [1, 0, None, None]
    with pytest.raises(Exception, match="unknown sex"):
        clean.strict_sex(codes, "s").collect()
    assert nan_to_null(spark.createDataFrame([(float("nan"),)], "x double")).first().x is None


def test_sources(spark, tmp_path):
    df = spark.createDataFrame([(1, 0, 50.0), (1, 1, 51.0)], "caseid long, time_sec long, bis double")
    df.write.parquet(f"{tmp_path}/s.parquet")
    assert src.read_signals(spark, f"{tmp_path}/s.parquet").count() == 2
    df.write.option("header", True).csv(f"{tmp_path}/s.csv")
    assert src.read_signals(spark, f"{tmp_path}/s.csv").count() == 2
    for bad in (df.union(df), df.limit(0), df.withColumn("caseid", F.lit(None).cast("long"))):
        with pytest.raises(contracts.ContractError):
            src.signals_contract(bad)
    for run, e in (("a", 1.0), ("b", 2.0)):
        spark.createDataFrame([(0, 50.0, 50.0 + e)], "sample_index int, observed double, predicted double").write.parquet(f"{tmp_path}/runs/{run}/seed_{int(e)}/p.parquet")
    got = src.run_tables(spark, f"{tmp_path}/runs/*/*/p.parquet", r"runs/(?P<model>\w+)/seed_(?P<seed>\d+)/", ["observed", "predicted"], ["sample_index"])
    assert sorted((r.model, r.seed, r.predicted) for r in got.collect()) == [("a", "1", 51.0), ("b", "2", 52.0)]
    w = windows.windows(spark.createDataFrame([(1, t, float(t)) for t in range(0, 100, 10)], "caseid long, timestamp long, bis double"), ["bis"], "bis").withColumn("split", F.lit("train"))
    src.write_windows(w, f"{tmp_path}/w")
    assert src.read_windows(spark, f"{tmp_path}/w", "train").count() == w.count() and src.read_windows(spark, f"{tmp_path}/w", "test").count() == 0
    spark.createDataFrame([(1,), (2,)], "caseid long").write.parquet(f"{tmp_path}/train.parquet")
    spark.createDataFrame([(2,)], "caseid long").write.parquet(f"{tmp_path}/val.parquet")
    with pytest.raises(contracts.ContractError):
        src.split_lists(spark, {"train": f"{tmp_path}/train.parquet", "val": f"{tmp_path}/val.parquet"})
    src.write_report(df, f"{tmp_path}/report")
    assert cohort.file_fingerprints(spark, f"{tmp_path}/report").count() >= 1


def test_feature_specs(spark):
    df = spark.createDataFrame([(1.0, None)], "bis double, hr double")
    specs = [features.Feature("bis", "bis", required=True), features.Feature("hr", "hr"), features.Feature("x", "x")]
    assert [(r.feature, r.reason) for r in features.resolve(df, specs).orderBy("place").collect()] == [("bis", ""), ("hr", "all null"), ("x", "column absent")]
    with pytest.raises(contracts.ContractError):
        features.resolve(df.drop("bis"), specs)
    with pytest.raises(contracts.ContractError):
        features.require_profile(features.resolve(df, specs), ["bis", "hr"])


def concentration_by_steps(parameters, times, rates, hold):
    """Small Euler steps, as a plain restatement."""
    a = pk.system(*parameters)
    state, out, n = np.zeros(5), {}, 2000
    for k, t in enumerate(times):
        if k:
            gap = t - times[k - 1]
            if gap > hold:
                break
            state[4] = rates[k - 1]
            for _ in range(n):
                state = state + a @ state * gap / n
            state[4] = 0
        out[t] = (state[0] / parameters[0], state[3])
    return out


def test_concentrations(spark):
    people = spark.createDataFrame([(1, 40.0, 1, 177.0, 77.0), (2, 40.0, 1, 177.0, 77.0)], "caseid long, age double, sex_male int, height double, weight double")
    parameters = pk.propofol_parameters(people)
    times, rates = [0, 10, 20, 30, 55, 60], [100.0, 50.0, 0.0, 20.0, 20.0, 20.0]
    data = [(1, t, r, 0.0) for t, r in zip(times, rates, strict=True)] + [(2, t, r, 1.0) for t, r in zip(times, rates, strict=True)]
    df = spark.createDataFrame(data, "caseid long, time_sec long, rate double, volume double")
    got = {(r.caseid, r.time_sec): r for r in pk.concentrations(df, "rate", parameters, ["volume"]).collect()}
    p = parameters.where("caseid = 1").first()
    want = concentration_by_steps([p.v1, p.v2, p.v3, p.cl1, p.cl2, p.cl3, p.ke0], times, rates, 10)
    for t, (plasma, effect) in want.items():
        assert abs(got[1, t].plasma - plasma) < 2e-3 * (1 + plasma) and abs(got[1, t].effect - effect) < 2e-3 * (1 + effect)
    assert got[1, 0].plasma == 0  # the rate seen at t acts after t
    assert [got[1, t].status for t in times] == ["ok", "ok", "ok", "ok", "stale", "stale"] and got[2, 0].status == "unknown_start"
    assert abs(spark.range(1).select(pk.predicted_index(F.lit(0.0), F.lit(0.0))).first()[0] - 98) < 1e-9


def test_concentrations_do_not_depend_on_chunks(spark):
    r = np.random.default_rng(4)
    people = spark.createDataFrame([(c, 30.0 + c, c % 2, 170.0, 70.0) for c in range(4)], "caseid long, age double, sex_male int, height double, weight double")
    parameters = pk.remifentanil_parameters(people)
    data, times = [], {}
    for c in range(4):
        at = np.cumsum(r.integers(1, 4, 400)) + 7 * c
        rates = [None if k < 5 or r.random() < 0.5 and c else float(r.uniform(0, 100)) for k in range(400)]
        times[c] = (at, rates)
        data += [(c, int(t), x, 1.0 if c == 3 and k > 300 else 0.0) for k, (t, x) in enumerate(zip(at, rates, strict=True))]
    df = spark.createDataFrame(data, "caseid long, time_sec long, rate double, volume double")
    whole = {(q.caseid, q.time_sec): q for q in pk.concentrations(df, "rate", parameters, ["volume"], hold=9, span=10**6).collect()}
    parts = {(q.caseid, q.time_sec): q for q in pk.concentrations(df, "rate", parameters, ["volume"], hold=9, span=50).collect()}
    assert len(whole) == len(parts) == 1600
    for k, q in whole.items():
        p = parts[k]
        assert p.status == q.status and (q.plasma is None) == (p.plasma is None) and (q.plasma is None or np.allclose([p.plasma, p.effect], [q.plasma, q.effect], atol=1e-10))
    # one step after the other
    for c, (at, rates) in times.items():
        q = parameters.where(f"caseid = {c}").first()
        a, state, start, last, since, before, ended = pk.system(q.v1, q.v2, q.v3, q.cl1, q.cl2, q.cl3, q.ke0), np.zeros(5), None, 0.0, None, None, False
        for t, x in zip(at, rates, strict=True):
            got = whole[c, int(t)]
            if start is not None and not ended:
                ended = t - since > 9
                if not ended:
                    state[4] = last
                    state = pk.exponential(a * (t - before)) @ state
            if start is None and x is not None:
                start = t
            want = "before_start" if start is None else "stale" if ended else "ok"
            assert got.status == want
            if want == "ok":
                assert abs(got.plasma - state[0] / q.v1) < 1e-9 and abs(got.effect - state[3]) < 1e-9
            if x is not None:
                last, since = x, t
            before = t


def test_elastic_net_on_moments(spark):
    r = np.random.default_rng(1)
    x = r.normal(size=(300, 6))
    y = 2 * x[:, 0] - x[:, 2] + 3 * x[:, 5] + 1 + 0.1 * r.normal(size=300)
    data = [(int(k % 10), [float(v) for v in x[k]], float(y[k])) for k in range(300)]
    df = spark.createDataFrame(data, "case_id long, x array<double>, y double")
    m = select.case_moments(df, "x", "y")
    gram = sum(np.array(q.gram).reshape(8, 8) for q in m.collect())
    z = np.column_stack([np.ones(300), x, y])
    assert np.allclose(gram, z.T @ z)
    mask = np.array([True] * 5 + [False])
    c = select.elastic_net(gram, mask, 0.2, 1.0)
    # optimality: zero slope for free columns, |slope| = alpha for selected ones, at most alpha for others
    slope = x.T @ (y - c[0] - x @ c[1:]) / 300
    assert abs(slope[5]) < 1e-6
    for j in range(5):
        assert abs(slope[j] - 0.2 * np.sign(c[1 + j])) < 1e-5 if c[1 + j] else abs(slope[j]) <= 0.2 + 1e-6
    assert abs(select.mean_loss(gram, c) - np.mean((y - c[0] - x @ c[1:]) ** 2)) < 1e-9
    names = [f"f{k}" for k in range(6)]
    fits = select.bootstrap_fits(m, splits.multiplicities(m, 8, case="case_id"), names, list(mask), 0.2, 1.0)
    s = {q.feature: q for q in select.stability_summary(fits).collect()}
    assert s["f0"].frequency == 1 and s["f2"].sign == -1 and s["f1"].frequency == 0 and "f5" not in s
    grid = select.cv_grid(m, splits.folds(m, 3, case="case_id"), [0.01, 1.0], [1.0], list(mask)).collect()
    assert grid[0].alpha == 0.01


def test_sums_of_moments_are_those_of_the_drawn_rows(spark):
    r = np.random.default_rng(4)
    data = [(int(c), [float(v) for v in r.normal(size=2)], float(r.normal())) for c in range(700) for _ in range(1 + c % 3)]
    df = spark.createDataFrame(data, "case_id long, x array<double>, y double")
    draws = [(g, c, int(r.integers(1, 4))) for g in range(5) for c in range(g * 100, 710)] + [(3, 650, 2), (9, 9999, 1)]
    moments = select.case_moments(df, "x", "y").repartition(3)
    parts = select.summed_moments(moments, spark.createDataFrame(draws, "replicate int, case_id long, copies int"), "replicate")
    got: dict = {}
    for q in parts.collect():
        got[q.replicate] = got.get(q.replicate, 0) + np.array(q.gram).reshape(4, 4)
    assert sorted(got) == [0, 1, 2, 3, 4]  # group 9 has no case with rows
    for g, total in got.items():
        copies: dict = {}
        for h, c, n in draws:
            if h == g:
                copies[c] = copies.get(c, 0) + n
        z = np.array([[1, *x, y] for c, x, y in data])
        w = np.array([copies.get(c, 0) for c, _, _ in data], float)
        assert np.allclose(total, (z * w[:, None]).T @ z)
    assert select.summed_moments(moments.limit(0), spark.createDataFrame(draws, "replicate int, case_id long, copies int"), "replicate").count() == 0


def test_weights(spark):
    df = spark.createDataFrame([(1, "a", 0.9, True), (1, "b", 0.1, True), (2, "a", 1.0, True), (2, "b", 0.0, False)], "sample int, feature string, weight double, observed boolean")
    e = {r["sample"]: r.entropy for r in weights.normalized_entropy(df, ["sample"]).collect()}
    assert abs(e[1] - (-(0.9 * math.log(0.9) + 0.1 * math.log(0.1)) / math.log(2))) < 1e-12 and e[2] == 0
    cases = spark.createDataFrame([(k, 1, "a", 1.0) for k in range(9)] + [(10, 2, "a", 0.0)], "sample int, case int, feature string, weight double")
    assert weights.balanced_summary(cases, "feature").first()["mean"] == 0.5
    w = spark.createDataFrame([(1, 10 * k, float(k)) for k in range(5)] + [(2, 0, 9.0)], "case_id long, final_ts long, v double")
    moved = weights.circular_shift(w, ["v"], 1, 1)
    assert sorted(r.v for r in moved.where("case_id = 1").collect()) == [0, 1, 2, 3, 4] and moved.where("case_id = 2").first().v == 9
    assert [r.v for r in moved.where("case_id = 1").orderBy("final_ts").collect()] != [0, 1, 2, 3, 4]


def test_bootstrap_is_repeatable_and_centred(spark):
    cells = spark.createDataFrame([("k", s, c, float(c - 5) + s) for s in range(3) for c in range(11)], "contrast string, seed int, case int, v double")
    b = bootstrap.hierarchical_bootstrap(cells, ["contrast"], "seed", "case", "v", 300)
    again = bootstrap.hierarchical_bootstrap(cells.repartition(5), ["contrast"], "seed", "case", "v", 300)
    assert {k: round(v, 9) for _, k, v in rows(b)} == {k: round(v, 9) for _, k, v in rows(again)} and b.count() == 300
    i = bootstrap.interval(b, ["contrast"]).first()
    assert i.low < 1 < i.high and abs(i["mean"] - 1) < 0.3


def test_episodes(spark):
    df = spark.createDataFrame([(1, 10 * k, v, a) for k, (v, a) in enumerate([(80.0, 0.0), (50.0, 5.0), (70.0, 5.0), (55.0, 2.0), (45.0, 2.0)])], "episode int, t int, v double, a double")
    s = episodes.settling(df, "episode", "t", "v").first()
    assert (s.reentry, s.settled) == (10, 30)
    m = episodes.episode_metrics(df, "episode", "t", "v", "a", 10.0).first()
    assert (m.in_range, m.above, m.dose, m.large_changes) == (30.0, 20.0, 140.0, 2)


def test_cohort_rules(spark):
    df = spark.createDataFrame([(1, "train", 40.0, 1), (1, "train", 40.0, 1), (2, "train", None, 1), (3, "test", 60.0, None)], "caseid int, split string, age double, sex int")
    one = cohort.dedupe_demographics(df)
    assert one.count() == 3
    filled = {r.caseid: r for r in cohort.impute_from_train(one, F.col("split") == "train", ["age"], ["sex"]).collect()}
    assert filled[2].age == 40 and filled[2].imputed == ["age"] and filled[3].sex == 1
    with pytest.raises(contracts.ContractError):
        cohort.sealed(one)
    with pytest.raises(contracts.ContractError):
        cohort.dedupe_demographics(one.unionByName(spark.createDataFrame([(1, "train", 41.0, 1)], one.schema)))
    assert rows(cohort.table_fingerprint(one)) == rows(cohort.table_fingerprint(one.repartition(3)))
    odd = "a string, b string, c array<int>, d binary, `e.f` map<string,int>"
    print_of = lambda *data: rows(cohort.table_fingerprint(spark.createDataFrame(list(data), odd)))[0]
    x = ("p", None, [1, None], b"z", {"k": 1})
    assert print_of(x) == print_of(x) and print_of()[0] == 0 and print_of()[2:] == (0, "0")
    different = [(None, "p", *x[2:]), ("", None, *x[2:]), ("p", "-", *x[2:]), ("p1:", None, *x[2:]), (*x[:2], [1], *x[3:]), (*x[:3], b"Z", x[4]), (*x[:4], None)]
    assert len({print_of(x), *(print_of(y) for y in different)}) == 8
    assert print_of(x, x, different[0]) != print_of(different[0]) and print_of(x, different[0]) == print_of(different[0], x)
    renamed = spark.createDataFrame([x], odd).withColumnRenamed("a", "a0")
    assert rows(cohort.table_fingerprint(renamed))[0][1] != print_of(x)[1]
    assert cohort.canonical_hash({"b": 1, "a": 2}) == cohort.canonical_hash({"a": 2, "b": 1})


def test_window_dataset_scales_inputs_and_not_targets(spark):
    data = [(c, t, 50.0 + c + math.sin(t)) for c in range(12) for t in range(0, 150, 10)]
    grid = spark.createDataFrame(data, "caseid long, timestamp long, bis double")
    w, s = plans.window_dataset(grid, ["bis"], "bis", 6, 10, 30)
    assert w.select("split").distinct().count() == 3 and w.agg(F.min("y")).first()[0] > 45
    assert abs(w.where("split = 'train'").select(F.avg(F.element_at("x", 1)[0])).first()[0]) < 0.5 and s.count() == 1


def test_acceptance_refuses_shifted_targets_and_missing_features(spark):
    from casewise.operators import prep

    rows = [(s, c, t, float(y), None if s == "val" and t < 3 else 1.0) for s in ("train", "val", "test") for c in range(12) for t, y in enumerate([30, 50, 50, 50, 70, 70, 70, 70] if s == "test" else [30, 30, 50, 50, 50, 50, 70, 70])]
    df = spark.createDataFrame(rows, "split string, case_id long, target_ts long, y double, f double")
    cases = prep.case_targets(df)
    balance, coverage, differences = prep.split_balance(cases), prep.event_coverage(cases), prep.target_differences(df)
    assert {r["split"]: (r.high_difference, r.low_difference) for r in differences.collect()} == {"val": (0, 0), "test": (-0.25, 0.125)}
    got = {r["split"]: r for r in prep.acceptance(balance, coverage, differences=differences).collect()}
    assert {k: r.accepted for k, r in got.items()} == {"train": True, "val": True, "test": False} and got["test"].not_dominated
    ranges = spark.createDataFrame([("f", 1.0, 1.0)], "feature string, train_min double, train_max double")
    drift = prep.drift_audit(df, ["f"], prep.fit_scaling(df.where("split = 'train'"), ["f"]), ranges, case="case_id")
    assert not any(r.accepted or r.features_available for r in prep.acceptance(balance, coverage, drift=drift).collect())


def test_correlations_with_gaps_and_ties(spark):
    """Null and NaN are missing, ties share their average rank, a column that does not vary gives null."""
    rng = np.random.default_rng(3)
    frame = pd.DataFrame({"id": range(300), "a": rng.integers(0, 9, 300) / 10 + 1e6, "b": rng.normal(size=300), "flat": 0.1, "gone": np.nan})
    frame["c"] = frame.b.where(rng.random(300) < 0.7) ** 3
    frame["d"] = np.where(rng.random(300) < 0.4, 7.0, frame.b)
    found = {(r.a, r.b): (r.pearson, r.spearman) for r in select.correlations(spark.createDataFrame(frame).repartition(5), ["a", "b", "c", "d", "flat", "gone"], ["id"]).collect()}
    assert len(found) == 15
    for (x, y), (pearson, spearman) in found.items():
        both = frame[[x, y]].dropna()
        if "flat" in (x, y) or "gone" in (x, y):
            assert pearson is None and spearman is None
        else:
            ranks = frame.rank().loc[both.index]
            assert pearson == pytest.approx(both[x].corr(both[y]), abs=1e-9)
            assert spearman == pytest.approx(ranks[x].corr(ranks[y]), abs=1e-9)


def test_contribution_agreement_and_stability(spark):
    rows = [(s, i, w, d) for s in range(5) for i, (w, d) in enumerate([(0.4, 3.0), (0.3, 2.0 - s), (0.2, 1.0), (0.1, 1.0)])]
    df = spark.createDataFrame(rows, "seed int, item int, weight double, delta double")
    got = {r.seed: r for r in weights.contribution_agreement(df, [], "seed", "item", "weight", "delta", (1, 2)).collect()}
    want = {s: pd.Series([0.4, 0.3, 0.2, 0.1]).rank().corr(pd.Series([3.0, 2.0 - s, 1.0, 1.0]).rank()) for s in range(5)}
    for s, r in got.items():
        assert r.spearman == pytest.approx(want[s]) and r.overlap_1 == 1 and r.jaccard_1 == 1
        assert r.overlap_2 == (2 if s < 2 else 1 if 2.0 - s < 1 else 2) and r.positive == sum(v > 0 for v in want.values())
        assert r["mean"] == pytest.approx(np.mean(list(want.values()))) and r["std"] == pytest.approx(np.std(list(want.values()), ddof=1))
    held = {r.item: r for r in weights.contribution_stability(df, [], "seed", "item", "delta").collect()}
    assert [held[i].stable for i in range(4)] == [True, False, True, True] and held[1].positive == 2

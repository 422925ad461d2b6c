"""Rules, rejects and sessions on small tables."""

import json
import os

import numpy as np
import pytest
from pyspark.sql import functions as F

from casewise import sources
from casewise.operators import metrics, order, prep, runs, weights, windows
from casewise.operators.contracts import ContractError


def test_front_is_found_by_ranges(spark):
    r = np.random.default_rng(1)
    rows = [(f"g{k % 2}", f"c{k:03d}", int(r.integers(0, 12)), float(r.integers(0, 40))) for k in range(160)]
    df = spark.createDataFrame(rows, "model string, name string, cost int, error double")
    want = {}
    for g, n, c, e in rows:
        want[n] = sorted(m for h, m, d, f in rows if h == g and d <= c and f <= e and (d < c or f < e))
    got = {q["name"]: q for q in runs.pareto(df, "model", "name", "cost", "error").collect()}
    assert {n: q["dominators"] for n, q in got.items()} == want
    assert all(q["on_front"] == (not want[n]) for n, q in got.items())
    for g in ("g0", "g1"):
        on = [q for q in got.values() if q["model"] == g and q["on_front"]]
        assert {q["name"] for q in on if q["is_simplest"]} == {q["name"] for q in on if q["cost"] == min(x["cost"] for x in on)}


def test_least_of_what_comes_before(spark):
    levels = spark.createDataFrame([("a", k, float((k * 7) % 13)) for k in range(50)], "g string, at int, v double")
    found = {q["at"]: q["m"] for q in order.least_before(levels, "at", "v", "m", ["g"]).collect()}
    values = [float((k * 7) % 13) for k in range(50)]
    assert found == {k: min(values[:k]) if k else None for k in range(50)}


def test_sessions_equal_the_stream(spark, tmp_path):
    from casewise.streaming import streaming_history

    rows = []
    for c, times in {1: [0, 10, 20, 30, 60, 70, 80, 90, 100], 2: [5, 15, 40, 55, 65], 3: [0]}.items():
        rows += [(c, t, float(t + c), 2.0 * k * k) for k, t in enumerate(times)]
    df = spark.createDataFrame(rows, "caseid long, timestamp long, bis double, given double")
    df.write.parquet(f"{tmp_path}/in")
    stream = spark.readStream.schema(df.schema).parquet(f"{tmp_path}/in")
    query = streaming_history(stream, "bis", 3).writeStream.format("memory").queryName("sessions").outputMode("append").option("checkpointLocation", f"{tmp_path}/state").trigger(availableNow=True).start()
    query.awaitTermination(120)
    online = {(q.caseid, q.timestamp): (q.history, q.present) for q in spark.table("sessions").collect()}
    batch = {(q.caseid, q.timestamp): q for q in windows.session_history(df, "bis", {"dose": "given"}, 3).collect()}
    assert {k: (q.history, q.present) for k, q in batch.items()} == online
    # exact offsets inside a session: the row three back, or its first
    assert [batch[1, t].dose_recent for t in (0, 10, 20, 30, 60, 70, 90, 100)] == [0, 2, 8, 18, 0, 18, 66, 128 - 50]
    assert [batch[1, t].dose_interval for t in (0, 10, 30, 60, 70)] == [0, 2, 10, 0, 18] and batch[1, 60].delta == 0 and batch[1, 70].delta == 10


def write(path, text):
    os.makedirs(os.path.dirname(path), exist_ok=True)
    with open(path, "w") as f:
        f.write(text)


def test_run_files_and_their_rejects(spark, tmp_path):
    for run, text in {"a/seed_1": json.dumps({"status": "failed", "config": {"step": 3}}, indent=2), "a/seed_2": "{broken", "b/seed_1": json.dumps({"config": {"step": 4}}), "b/seed_2": "[]"}.items():
        write(f"{tmp_path}/{run}/run_status.json", text)
    good, rejects = sources.run_files(spark, f"{tmp_path}/*/*/run_status.json", r"/(?P<profile>[^/]+)/seed_(?P<seed>[0-9]+)/", "status string, config struct<step: long>", ["status"])
    assert [(q.profile, q.seed, q.status, q.config.step) for q in good.collect()] == [("a", "1", "failed", 3)]
    assert {(q.profile, q.seed): q.reason for q in rejects.collect() if (q.profile, q.seed) != ("b", "2")} == {("a", "2"): "unreadable", ("b", "1"): "lacks status"}


def test_nested_results_keep_their_rules(spark):
    planned = spark.createDataFrame([(k, "p") for k in range(4)], "run long, protocol_hash string")
    done = spark.createDataFrame([(0, "p", False), (1, "p", False)], "run long, protocol_hash string, test_cohort_accessed boolean")
    status = spark.createDataFrame([(2, "failed", "Error"), (3, "running", None)], "run long, status string, exception string")
    best = spark.createDataFrame([(0, 1.5), (1, 2.5)], "run long, mae double")
    rows = spark.createDataFrame([(0, 1.0), (0, 3.0), (1, 5.0)], "run long, e double")
    complete, rest = runs.collect_nested(planned, done, status, best, rows, ["run"], {"e": F.avg("e")})
    assert {q.run: (q.mae, q.validation_rows, q.e) for q in complete.collect()} == {0: (1.5, 2, 2.0), 1: (2.5, 1, 5.0)}
    assert {q.run: (q.outcome, q.exception) for q in rest.collect()} == {2: ("failed", "Error"), 3: ("pending", None)}
    for broken in (done.withColumn("test_cohort_accessed", F.lit(None).cast("boolean")), done.withColumn("protocol_hash", F.lit("q")), done.where("run > 9")):
        with pytest.raises(ContractError):
            runs.collect_nested(planned, broken, status, best, rows, ["run"], {"e": F.avg("e")})
    with pytest.raises(ContractError):
        runs.collect_nested(planned, done, status, best, rows.where("run = 0"), ["run"], {"e": F.avg("e")})


def test_cases_that_fail_are_told(spark, tmp_path):
    write(f"{tmp_path}/case_1.csv", "time_sec,a,b\n0,1.5,2\n1,,3\n")
    write(f"{tmp_path}/case_2.csv", "time_sec,a,b\n0,1,2\nx,1,2\n")
    write(f"{tmp_path}/case_3.csv", "time_sec,a,b\n0,1,2\n0,3,4\n")
    write(f"{tmp_path}/case_4.csv", "time_sec,a,b\n,1,2\n")
    good, rejects = sources.load_cases(spark, f"{tmp_path}/*.csv", r"case_(?P<caseid>[0-9]+)\.csv", ["a", "b"])
    assert sorted(map(tuple, good.collect())) == [(1, 0, 1.5, 2.0), (1, 1, None, 3.0)]
    assert {q.caseid: q.reason for q in rejects.collect()} == {2: "rows that do not parse", 3: "times that occur twice", 4: "rows without a time"}
    with pytest.raises(ContractError):
        sources.load_cases(spark, f"{tmp_path}/case_[234].csv", r"case_(?P<caseid>[0-9]+)\.csv", ["a", "b"])


def test_errors_in_place_of_silence(spark):
    levels = metrics.score_levels(spark.createDataFrame([(1, 0.5), (1, 0.7)], "label int, score double"), "label", "score")
    with pytest.raises(ContractError):
        metrics.best_threshold(levels, "score")
    w = spark.createDataFrame([(1, 0.5, True), (1, 0.5, True), (2, 0.0, False)], "v int, weight double, observed boolean")
    with pytest.raises(ContractError):
        weights.normalized_entropy(w, ["v"])
    cases = spark.createDataFrame([("train", 1)], "split string, case_id int")
    assert prep.require_all_cases(cases, cases) is cases
    with pytest.raises(ContractError):
        prep.require_all_cases(cases, spark.createDataFrame([("train", 1), ("test", 2)], "split string, case_id int"))

"""Queries on splits, scaling, forecasts, runs, weights and episodes; see queries.py for what stands for what."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import functions as F

from casewise import sources as src
from casewise.operators import clean, contracts, metrics, pairing, prep, runs, splits, windows
from casewise.plans.queries import AHEAD, CTE, DAY, DRAW, LENGTH, QUERIES, SQL, R, grid, holes, marked, pred, query, rounded, runt, sig, table, wins, wts

__all__ = ["QUERIES", "SQL"]

# splits and draws

def splitted(spark, d):
    return splits.case_split(grid(spark, d))


@query("SELECT caseid, split FROM splitted")
def l1_case_split(spark, d):
    return splits.require_split(splitted(spark, d), grid(spark, d))


@query("SELECT user_id AS caseid, 'several' AS fault FROM (SELECT DISTINCT user_id, event_type FROM events WHERE user_id % 3 > 0) GROUP BY 1 HAVING count(*) > 1 UNION ALL SELECT DISTINCT user_id, 'uncovered' FROM events WHERE user_id % 3 = 0")
def l2_split_faults(spark, d):
    e = table(spark, d, "events").select(F.col("user_id").alias("caseid"), F.col("event_type").alias("split")).distinct()
    return splits.split_faults(e.where("caseid % 3 > 0"), e)


@query(f"SELECT caseid, CAST(ntile(5) OVER (ORDER BY {DRAW.format("'42:' || caseid")}, caseid) - 1 AS INT) AS fold FROM (SELECT DISTINCT caseid FROM grid)")
def l3_grouped_folds(spark, d):
    return splits.folds(grid(spark, d), 5)


@query("SELECT caseid, rows, CAST(CASE WHEN (place // 4) % 2 = 0 THEN place % 4 ELSE 3 - place % 4 END AS INT) AS fold FROM (SELECT caseid, count(*) AS rows, row_number() OVER (ORDER BY count(*) DESC, caseid) - 1 AS place FROM sig GROUP BY 1)")
def l3_balanced_folds(spark, d):
    return splits.balanced_folds(sig(spark, d), 4)


@query(f"SELECT run, caseid, row_number() OVER (PARTITION BY run ORDER BY {DRAW.format("'42:' || run || ':' || caseid")}, caseid) <= greatest(1, least(n - 1, round(n * 0.5))) AS chosen FROM (SELECT DISTINCT caseid FROM grid), range(3) r(run), (SELECT count(DISTINCT caseid) AS n FROM grid)")
def l4_case_subsample(spark, d):
    return splits.subsample(grid(spark, d), 0.5, 3)


@query(f"SELECT replicate, c.caseid, count(*) AS copies FROM (SELECT replicate, {DRAW.format("'42:' || replicate || ':' || k")} % n AS i FROM range(20) r(replicate), (SELECT unnest(range(n)) AS k, n FROM (SELECT count(DISTINCT caseid) AS n FROM grid))) JOIN (SELECT caseid, row_number() OVER (ORDER BY caseid) - 1 AS i FROM (SELECT DISTINCT caseid FROM grid)) c USING (i) GROUP BY 1, 2")
def l5_bootstrap_multiplicities(spark, d):
    return splits.multiplicities(grid(spark, d), 20)


@query("SELECT case_id, final_ts, round((1.0 / count(*) OVER (PARTITION BY case_id)) * (SELECT count(*) FROM win) / (SELECT count(DISTINCT case_id) FROM win), 6) AS weight FROM win")
def l6_case_weights(spark, d):
    return rounded(splits.case_weights(wins(spark, d)).select("case_id", "final_ts", "weight"))


@query(f"SELECT draw, caseid, timestamp FROM (SELECT id AS draw, {DRAW.format("'42:case:' || id")} % (SELECT count(DISTINCT caseid) FROM grid) AS c FROM range(500) r(id)) JOIN (SELECT caseid, n, row_number() OVER (ORDER BY caseid) - 1 AS c FROM (SELECT caseid, count(*) AS n FROM grid GROUP BY 1)) USING (c) JOIN (SELECT caseid, timestamp, row_number() OVER (PARTITION BY caseid ORDER BY timestamp) - 1 AS i FROM grid) USING (caseid) WHERE i = {DRAW.format("'42:row:' || draw")} % n")
def l7_balanced_draws(spark, d):
    return splits.balanced_draws(grid(spark, d), 500, "timestamp", case="caseid")


@query("SELECT caseid, timestamp FROM grid WHERE caseid IN (SELECT DISTINCT caseid FROM grid ORDER BY 1 LIMIT 3)")
def l8_first_cases(spark, d):
    return splits.first_cases(grid(spark, d), 3).select("caseid", "timestamp")


# scaling and audits

CTE["parts"] = "parts AS (SELECT h.*, s.split FROM holes h JOIN splitted s USING (caseid))"


def parts(spark, d):
    return holes(spark, d).join(splitted(spark, d), "caseid")


CTE["doubled"] = "doubled AS (SELECT split, coalesce(bis, f) AS a, coalesce(CASE WHEN split = 'test' AND caseid % 2 = 0 THEN bis - 49 ELSE bis - 50 END, f - 50) AS b FROM parts, (SELECT median(bis) AS f FROM parts WHERE split = 'train'))"


@query("SELECT split, count(*) AS \"values\", round(max(abs(b - (a - 50))), 6) AS difference, round(corr(a, b), 6) AS correlation, max(abs(b - (a - 50))) <= 1e-9 AS exact FROM doubled GROUP BY GROUPING SETS ((split), ())")
def w9_deterministic_duplicate(spark, d):
    """After scaling and back; the test split has a planted fault in every other case."""
    wrong = (F.col("split") == "test") & (F.col("caseid") % 2 == 0)
    p = parts(spark, d).withColumn("error", F.col("bis") - F.when(wrong, 49).otherwise(50))
    s = prep.fit_scaling(p.where("split = 'train'"), ["bis", "error"])
    return rounded(prep.duplicate_check(prep.apply_scaling(p, s), s, "bis", "error", 50.0, tolerance=1e-9))


@query(f"SELECT split, CAST(sum(candidates) AS BIGINT) AS candidates, CAST(sum(included) AS BIGINT) AS included, CAST(sum(gap) AS BIGINT) AS gap, CAST(sum(no_future) AS BIGINT) AS no_future, {R('100 * sum(gap) / sum(candidates) AS gap_pct', '100 * sum(no_future) / sum(candidates) AS no_future_pct')} FROM aud JOIN splitted USING (caseid) GROUP BY 1")
def w5_split_audit(spark, d):
    return rounded(windows.split_audit(windows.candidate_audit(marked(spark, d), LENGTH, DAY), splitted(spark, d)))


CTE["fitted"] = """fitted AS (SELECT 'bis' AS feature, false AS categorical, f AS fill, (SELECT avg(coalesce(bis, f)) FROM parts WHERE split = 'train') AS mean, (SELECT stddev_pop(coalesce(bis, f)) FROM parts WHERE split = 'train') AS scale, n AS seen FROM (SELECT median(bis) AS f, count(bis) AS n FROM parts WHERE split = 'train')
  UNION ALL SELECT 'aux', true, f, (SELECT avg(coalesce(aux, f)) FROM parts WHERE split = 'train'), (SELECT stddev_pop(coalesce(aux, f)) FROM parts WHERE split = 'train'), (SELECT count(aux) FROM parts WHERE split = 'train') FROM (SELECT aux AS f FROM parts WHERE split = 'train' AND aux IS NOT NULL GROUP BY aux ORDER BY count(*) DESC, aux LIMIT 1))"""


def fitted(spark, d):
    return prep.fit_scaling(parts(spark, d).where("split = 'train'"), ["bis", "aux"], ["aux"])


@query(f"SELECT feature, categorical, {R('fill', 'mean', 'scale')}, seen FROM fitted")
def n1_fit_scaling(spark, d):
    return rounded(fitted(spark, d))


@query("SELECT caseid, time_sec, bis IS NOT NULL AS bis_observed, round((coalesce(bis, b.fill) - b.mean) / b.scale, 6) AS bis, aux IS NOT NULL AS aux_observed, coalesce(aux, a.fill) AS aux FROM parts, (SELECT * FROM fitted WHERE feature = 'bis') b, (SELECT * FROM fitted WHERE feature = 'aux') a")
def n2_apply_scaling(spark, d):
    return rounded(prep.apply_scaling(parts(spark, d), fitted(spark, d)).select("caseid", "time_sec", "bis_observed", "bis", "aux_observed", "aux"))


@query("SELECT split, 'bis' AS feature, round(avg(CASE WHEN bis IS NULL THEN 1.0 ELSE 0.0 END), 6) AS missing FROM parts GROUP BY 1 UNION ALL SELECT split, 'aux', round(avg(CASE WHEN aux IS NULL THEN 1.0 ELSE 0.0 END), 6) FROM parts GROUP BY 1")
def n3_missing_by_split(spark, d):
    return rounded(clean.missing_rates(parts(spark, d), ["bis", "aux"], ["split"]))


def pct(rule, y="y"):
    return f"100.0 * count(*) FILTER (WHERE {rule}) / count({y})"


@query(f"SELECT count(y) AS n, {R('avg(y) AS mean', 'stddev_pop(y) AS std', 'min(y) AS min', 'max(y) AS max', pct('y < 40') + ' AS low_pct', pct('y BETWEEN 40 AND 60') + ' AS mid_pct', pct('y > 60') + ' AS high_pct')} FROM win")
def n4_target_summary(spark, d):
    return rounded(prep.target_summary(wins(spark, d)))


@query("""SELECT split, feature, round(missing_pct, 6) AS missing_pct, min, max, round(outside_pct, 6) AS outside_pct, large_z, round(max_z, 6) AS max_z, round(variance, 4) AS variance, empty_cases, missing_pct > 30 AS much_missing, coalesce(variance < 1e-8, true) AS flat, coalesce(outside_pct > 5, false) AS far_outside FROM (
  SELECT split, feature, 100 * avg(CASE WHEN value IS NULL THEN 1.0 ELSE 0.0 END) AS missing_pct, min(value) AS min, max(value) AS max, 100.0 * count(*) FILTER (WHERE value < lo OR value > hi) / count(value) AS outside_pct, count(*) FILTER (WHERE abs((value - mean) / scale) > 5) AS large_z, max(abs((value - mean) / scale)) AS max_z, var_pop(value) AS variance, count(DISTINCT caseid) - count(DISTINCT CASE WHEN value IS NOT NULL THEN caseid END) AS empty_cases
  FROM (SELECT split, caseid, 'bis' AS feature, bis AS value FROM parts UNION ALL SELECT split, caseid, 'aux', aux FROM parts) JOIN fitted USING (feature) JOIN (SELECT 'bis' AS feature, min(bis) AS lo, max(bis) AS hi FROM parts WHERE split = 'train' UNION ALL SELECT 'aux', min(aux), max(aux) FROM parts WHERE split = 'train') USING (feature) GROUP BY 1, 2)""")
def n5_drift_audit(spark, d):
    p = parts(spark, d)
    train = p.where("split = 'train'")
    ranges = train.select("bis", "aux").unpivot([], ["bis", "aux"], "feature", "value").groupBy("feature").agg(F.min("value").alias("train_min"), F.max("value").alias("train_max"))
    out = prep.drift_audit(p, ["bis", "aux"], fitted(spark, d), ranges)
    return rounded(out.withColumn("variance", F.round("variance", 4)))


CTE["ct"] = "ct AS (SELECT split, case_id, count(*) AS windows, avg(y) AS mean, min(target_ts) AS first_target, max(target_ts) AS last_target, avg(CASE WHEN y < 40 THEN 1.0 ELSE 0.0 END) AS low, avg(CASE WHEN y BETWEEN 40 AND 60 THEN 1.0 ELSE 0.0 END) AS mid, avg(CASE WHEN y > 60 THEN 1.0 ELSE 0.0 END) AS high FROM win JOIN splitted ON caseid = case_id GROUP BY 1, 2)"


def ct(spark, d):
    return prep.case_targets(wins(spark, d).join(splitted(spark, d).withColumnRenamed("caseid", "case_id"), "case_id"))


@query(f"SELECT split, case_id, windows, {R('mean', 'low', 'mid', 'high', digits=9)}, first_target, last_target FROM ct")
def n6_case_targets(spark, d):
    return rounded(ct(spark, d), 9)


CTE["cov"] = "cov AS (SELECT split, count(*) AS cases, count(*) FILTER (WHERE high > 0) AS high_cases, avg(CASE WHEN high > 0 THEN 1.0 ELSE 0.0 END) AS high_share, median(high) AS high_median, count(*) FILTER (WHERE low > 0) AS low_cases, avg(CASE WHEN low > 0 THEN 1.0 ELSE 0.0 END) AS low_share, median(low) AS low_median FROM ct GROUP BY 1)"


@query(f"SELECT split, cases, high_cases, low_cases, {R('high_share', 'high_median', 'low_share', 'low_median')}, high_cases = 0 OR low_cases = 0 AS warning FROM cov")
def n7_event_coverage(spark, d):
    return rounded(prep.event_coverage(ct(spark, d)))


CTE["bal"] = "bal AS (SELECT split, count(*) AS cases, CAST(sum(windows) AS BIGINT) AS windows, avg(windows) AS mean_windows, median(windows) AS median_windows, sum(windows) FILTER (WHERE place <= 1) / sum(windows) AS top1, sum(windows) FILTER (WHERE place <= 2) / sum(windows) AS top2 FROM (SELECT *, row_number() OVER (PARTITION BY split ORDER BY windows DESC, case_id) AS place FROM ct) GROUP BY 1)"


@query(f"SELECT split, cases, windows, {R('mean_windows', 'median_windows', 'top1', 'top2', 'cases / sum(cases) OVER () AS case_share', 'windows / sum(windows) OVER () AS window_share')} FROM bal")
def n8_split_balance(spark, d):
    return rounded(prep.split_balance(ct(spark, d)))


@query("SELECT round(a - b, 6) AS difference, round((a - b) / s, 6) AS smd FROM (SELECT avg(y) FILTER (WHERE split = 'train') AS a, avg(y) FILTER (WHERE split = 'test') AS b, sqrt((var_pop(y) FILTER (WHERE split = 'train') + var_pop(y) FILTER (WHERE split = 'test')) / 2) AS s FROM win JOIN splitted ON caseid = case_id)")
def n8_standardized_difference(spark, d):
    w = wins(spark, d).join(splitted(spark, d).withColumnRenamed("caseid", "case_id"), "case_id")
    return rounded(prep.standardized_difference(w, "y", "split", "train", "test"))


CTE["diffs"] = "diffs AS (SELECT o.split, abs(t.high - o.high) <= 0.1 AND abs(t.low - o.low) <= 0.1 AND abs(coalesce((t.m - o.m) / nullif(sqrt((t.v + o.v) / 2), 0), 0)) <= 0.5 AS alike FROM (SELECT split, avg(CASE WHEN y > 60 THEN 1.0 ELSE 0.0 END) AS high, avg(CASE WHEN y < 40 THEN 1.0 ELSE 0.0 END) AS low, avg(y) AS m, var_pop(y) AS v FROM win JOIN splitted ON caseid = case_id GROUP BY 1) o, (SELECT avg(CASE WHEN y > 60 THEN 1.0 ELSE 0.0 END) AS high, avg(CASE WHEN y < 40 THEN 1.0 ELSE 0.0 END) AS low, avg(y) AS m, var_pop(y) AS v FROM win JOIN splitted ON caseid = case_id WHERE split = 'train') t)"
CTE["gaps"] = "gaps AS (SELECT max(least(share, 1)) <= 0.3 AS available FROM (SELECT split, avg(CASE WHEN bis IS NULL THEN 1.0 ELSE 0.0 END) AS share FROM parts GROUP BY 1 UNION ALL SELECT split, avg(CASE WHEN aux IS NULL THEN 1.0 ELSE 0.0 END) FROM parts GROUP BY 1))"


@query("SELECT split, enough_cases, enough_events, not_dominated, targets_alike, available AS features_available, enough_cases AND enough_events AND not_dominated AND targets_alike AND available AS accepted FROM (SELECT split, b.cases >= 10 AS enough_cases, least(high_cases, low_cases) >= 2 AS enough_events, top2 < 0.5 AS not_dominated, alike AS targets_alike FROM bal b JOIN cov c USING (split) JOIN diffs USING (split)), gaps")
def n9_acceptance(spark, d):
    c = ct(spark, d)
    p = parts(spark, d)
    fit = fitted(spark, d)
    ranges = spark.createDataFrame([("bis", 0.0, 100.0), ("aux", 0.0, 100.0)], "feature string, train_min double, train_max double")
    named = wins(spark, d).join(splitted(spark, d).withColumnRenamed("caseid", "case_id"), "case_id")
    return prep.acceptance(prep.split_balance(c), prep.event_coverage(c), differences=prep.target_differences(named), drift=prep.drift_audit(p, ["bis", "aux"], fit, ranges))


def broken(w):
    """Windows in which each rule is broken for some cases."""
    case = F.col("case_id")
    nan = F.array(F.lit(float("nan")).cast("double"), F.element_at("x", -1)[1].cast("double"))
    x = F.when(case % 4 == 0, F.concat(F.slice("x", 1, LENGTH - 1), F.array(nan))).otherwise(F.col("x"))
    w = w.withColumn("x", x)
    return w.withColumns({"x": F.when(case % 3 == 0, F.slice("x", 2, LENGTH - 1)).otherwise(F.col("x")), "target_ts": F.col("target_ts") + F.when(case % 5 == 0, 1).otherwise(0), "first_ts": F.col("first_ts") - F.when(case % 7 == 0, 1).otherwise(0), "y_high": F.when(case % 11 == 0, 1 - F.col("y_high")).otherwise(F.col("y_high"))})


@query('SELECT count(*) AS windows, count(*) FILTER (WHERE case_id % 3 = 0) AS steps, count(*) FILTER (WHERE case_id % 4 = 0) AS finite, count(*) FILTER (WHERE case_id % 3 = 0) AS mask, count(*) FILTER (WHERE case_id % 5 = 0) AS "offset", count(*) FILTER (WHERE case_id % 7 = 0) AS span, count(*) FILTER (WHERE case_id % 11 = 0) AS labels FROM win')
def n10_window_integrity(spark, d):
    return prep.window_faults(broken(wins(spark, d)), LENGTH, DAY, AHEAD)


@query("SELECT count(*) AS windows, count(*) FILTER (WHERE case_id % 5 = 0) AS absent, count(*) FILTER (WHERE case_id % 6 = 0 AND case_id % 5 <> 0) AS wrong FROM win")
def n10_target_values(spark, d):
    moved = broken(wins(spark, d)).withColumn("y", F.col("y") + F.when(F.col("case_id") % 6 == 0, 1.0).otherwise(0.0))
    return prep.target_faults(moved, grid(spark, d), "bis")


# sinks and what reads them again

def folder(spark):
    """A new folder that driver and executors share; a temporary one only in local sessions without spark.checkpoint.dir."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base and not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    return f"{base or tempfile.mkdtemp(prefix='spark-', dir='/tmp')}/sink-{uuid.uuid4().hex}"


@query("SELECT case_id, final_ts, CAST(s AS INT) AS step, g.bis AS bis, g.aux AS aux, y FROM win JOIN splitted ON caseid = case_id, range(6) r(s) JOIN grid g ON g.caseid = case_id AND g.timestamp = first_ts + s * 86400 WHERE split = 'test'")
def s6_window_sink(spark, d):
    path = folder(spark)
    src.write_windows(wins(spark, d).join(splitted(spark, d).withColumnRenamed("caseid", "case_id"), "case_id"), path)
    return src.read_windows(spark, path, "test").select("case_id", "final_ts", "y", F.posexplode("x").alias("step", "r")).select("case_id", "final_ts", "step", F.col("r")[0].alias("bis"), F.col("r")[1].alias("aux"), "y")


@query("SELECT caseid, split FROM splitted WHERE caseid % 3 <> 0")
def s7_split_sink(spark, d):
    path = folder(spark)
    src.write_split(splitted(spark, d), path)
    return src.read_split(spark, path, grid(spark, d).where("caseid % 3 != 0"), needed=("train",))


@query(f"SELECT feature, categorical, {R('fill', 'mean', 'scale')}, seen, 6 AS steps, (SELECT count(*) FROM splitted) AS cases FROM fitted")
def s9_report_sink(spark, d):
    path = folder(spark)
    manifest = splitted(spark, d).groupBy("split").agg(F.count("*").alias("cases"))
    src.write_dataset_report(path, {"steps": LENGTH, "interval": DAY}, fitted(spark, d), manifest)
    metadata, statistics, counts = src.read_dataset_report(spark, path)
    total = counts.agg(F.sum("cases").alias("cases"))
    return rounded(statistics.crossJoin(F.broadcast(total)).withColumn("steps", F.lit(metadata["steps"])).select("feature", "categorical", "fill", "mean", "scale", "seen", "steps", "cases"))


@query("SELECT model, seed, count(*) AS n, round(avg(abs(predicted - observed)), 6) AS mae FROM (SELECT 'last' AS model, CAST(case_id % 2 AS VARCHAR) AS seed, observed, predicted FROM pred UNION ALL SELECT 'shifted', CAST(case_id % 2 AS VARCHAR), observed, predicted + 1 FROM pred) GROUP BY 1, 2")
def s10_run_tables(spark, d):
    path = folder(spark)
    p = pred(spark, d)
    both = p.withColumn("model", F.lit("last")).unionByName(p.withColumn("predicted", F.col("predicted") + 1).withColumn("model", F.lit("shifted")))
    both.withColumn("seed", F.col("case_id") % 2).write.partitionBy("model", "seed").parquet(path)
    runs_ = src.run_tables(spark, f"{path}/*/*", r"model=(?P<model>[a-z]+)/seed=(?P<seed>[0-9]+)", ["case_id", "target_ts", "observed", "predicted"], ["case_id", "target_ts"])
    return rounded(runs_.groupBy("model", "seed").agg(F.count("*").alias("n"), F.avg(F.abs(F.col("predicted") - F.col("observed"))).alias("mae")))


@query("SELECT caseid, count(*) AS rows, CASE WHEN caseid = 7 THEN 'rows that do not parse' WHEN caseid = 9 THEN 'times that occur twice' END AS reason FROM (SELECT caseid % 40 AS caseid, time_sec FROM sig GROUP BY 1, 2 UNION ALL SELECT 7, 0 UNION ALL SELECT 9, 0 UNION ALL SELECT 9, 0) GROUP BY 1")
def s3_load_cases(spark, d):
    """A file for each of 40 cases; case 7 gets a line that is no row, case 9 a time twice."""
    path = folder(spark)
    s = sig(spark, d).groupBy((F.col("caseid") % 40).alias("caseid"), "time_sec").agg(F.max("bis").alias("bis"), F.max("aux").alias("aux"))
    s.repartition("caseid").write.partitionBy("caseid").option("header", True).csv(path)
    for case, lines in ((7, ["time_sec,bis,aux", "never,1.0,2.0"]), (9, ["time_sec,bis,aux", "0,1.0,2.0", "0,1.0,2.0"])):
        spark.createDataFrame([(x,) for x in lines], "value string").coalesce(1).write.mode("append").text(f"{path}/caseid={case}")
    good, rejects = src.load_cases(spark, f"{path}/*", r"caseid=(?P<caseid>[0-9]+)/", ["bis", "aux"])
    return good.groupBy("caseid").agg(F.count("*").alias("rows")).withColumn("reason", F.lit(None).cast("string")).unionByName(rejects)


def run_folder(spark, d):
    """Nested result files of runs by priority and status, as status.json, completion.json and best.json would hold them."""
    path = folder(spark)
    r = runt(spark, d).groupBy(F.substring("condition", 1, 1).alias("condition"), "model").agg(F.sum("cases").alias("n"), F.avg("case_mae").alias("error"))
    done = r.where("condition in ('1', '2')")
    kinds = {
        "completion": done.select("condition", "model", F.lit("p1").alias("protocol_hash"), F.lit(False).alias("test_cohort_accessed"), F.col("n").alias("timesteps")),
        "best": done.select("condition", "model", F.struct(F.col("error").alias("mae"), F.struct(F.col("n").alias("at")).alias("step")).alias("metrics")),
        "status": r.where("condition in ('3', '4') and not (condition = '3' and model = 'P')").select("condition", "model", F.when(F.col("condition") == "3", "failed").otherwise("running").alias("status"), F.struct(F.lit("Stopped").alias("type"), F.col("n").alias("step")).alias("exception")),
    }
    for kind, df in kinds.items():
        df.repartition("condition", "model").write.partitionBy("condition", "model").json(f"{path}/{kind}")
    spark.createDataFrame([('{"status": "fai',)], "value string").write.text(f"{path}/status/condition=3/model=P")
    spark.createDataFrame([('{"exception": {"type": "none"}}',)], "value string").write.text(f"{path}/status/condition=9/model=Q")
    return path


RUN_PATH = r"condition=(?P<condition>[^/]+)/model=(?P<model>[^/]+)/"


def nested(spark, d):
    path = run_folder(spark, d)
    read = lambda kind, schema, required: src.run_files(spark, f"{path}/{kind}/*/*", RUN_PATH, schema, required)
    planned = runt(spark, d).select(F.substring("condition", 1, 1).alias("condition"), "model").distinct().withColumn("protocol_hash", F.lit("p1"))
    status, rejects = read("status", "status string, exception struct<type: string, step: long>", ["status"])
    completion, _ = read("completion", "protocol_hash string, test_cohort_accessed boolean, timesteps long", ["protocol_hash", "test_cohort_accessed"])
    best, _ = read("best", "metrics struct<mae: double, step: struct<at: long>>", ["metrics"])
    rows = runt(spark, d).select(F.substring("condition", 1, 1).alias("condition"), "model", "case_mae")
    flat = best.select("condition", "model", F.col("metrics.mae").alias("best_mae"), F.col("metrics.step.at").alias("best_step"))
    return planned, completion, status, flat, rows, rejects


@query("SELECT condition, model, 'p1' AS protocol_hash, round(e, 9) AS best_mae, n AS best_step, k AS validation_rows, round(e, 9) AS mean_error, round(m, 9) AS worst FROM (SELECT substr(condition, 1, 1) AS condition, model, CAST(sum(cases) AS BIGINT) AS n, count(*) AS k, avg(case_mae) AS e, max(case_mae) AS m FROM runt GROUP BY 1, 2) WHERE condition IN ('1', '2')")
def a15_nested_runs(spark, d):
    planned, completion, status, best, rows, _ = nested(spark, d)
    complete, _ = runs.collect_nested(planned, completion, status, best, rows, ["condition", "model"], {"mean_error": F.avg("case_mae"), "worst": F.max("case_mae")})
    return rounded(complete, 9)


@query("SELECT DISTINCT substr(condition, 1, 1) AS condition, model, CASE WHEN condition LIKE '3%' AND model <> 'P' THEN 'failed' ELSE 'pending' END AS outcome, CASE WHEN condition LIKE '3%' AND model <> 'P' THEN 'Stopped' END AS \"type\" FROM runt WHERE condition NOT LIKE '1%' AND condition NOT LIKE '2%'")
def a15_open_runs(spark, d):
    planned, completion, status, best, rows, _ = nested(spark, d)
    _, rest = runs.collect_nested(planned, completion, status, best, rows, ["condition", "model"], {"mean_error": F.avg("case_mae")})
    return rest.select("condition", "model", "outcome", F.col("exception.type").alias("type"))


@query("SELECT * FROM (VALUES ('3', 'P', 'unreadable'), ('9', 'Q', 'lacks status')) v(condition, model, reason) WHERE (SELECT count(*) FROM orders) > 0")
def a15_rejected_files(spark, d):
    return nested(spark, d)[5].select("condition", "model", "reason")


# metrics

REG = "count(observed) AS n, round(avg(abs(predicted - observed)), 6) AS mae, round(sqrt(avg((predicted - observed) ^ 2)), 6) AS rmse, round(CASE WHEN count(observed) > 1 AND var_pop(observed) > 0 THEN 1 - sum((predicted - observed) ^ 2) / (var_pop(observed) * count(observed)) END, 6) AS r2"
REGION = "round(avg(abs(predicted - observed)) FILTER (WHERE observed < 40), 6) AS mae_low, round(avg(abs(predicted - observed)) FILTER (WHERE observed BETWEEN 40 AND 60), 6) AS mae_mid, round(avg(abs(predicted - observed)) FILTER (WHERE observed > 60), 6) AS mae_high"


@query(f"SELECT {REG} FROM pred")
def m1_regression(spark, d):
    return rounded(metrics.regression(pred(spark, d)))


@query(f"SELECT {REGION} FROM pred")
def m2_region_error(spark, d):
    return rounded(pred(spark, d).agg(*metrics.region_columns()))


CTE["lvl"] = """lvl AS (SELECT *, sum(p) OVER (ORDER BY s DESC) AS tp, sum(n) OVER (ORDER BY s DESC) AS fp, sum(p) OVER () AS pp, sum(n) OVER () AS nn FROM (
  SELECT n_chars AS s, sum(toxic) AS p, sum(1 - toxic) AS n FROM labels JOIN documents USING (doc_id) GROUP BY 1))"""


def scored(spark, d):
    return table(spark, d, "labels").join(table(spark, d, "documents").select("doc_id", "n_chars"), "doc_id")


@query("SELECT round(sum(p * (nn - fp + n / 2)) / (max(pp) * max(nn)), 6) AS auroc, round(sum(p * tp / (tp + fp)) / max(pp), 6) AS ap FROM lvl")
def m3_ranking(spark, d):
    return rounded(metrics.ranking(metrics.score_levels(scored(spark, d), "toxic", "n_chars")))


@query("SELECT s AS threshold, round(2 * tp / (tp + fp + pp), 6) AS f1 FROM lvl ORDER BY 2 * tp / (tp + fp + pp) DESC, s LIMIT 1")
def m4_best_threshold(spark, d):
    return rounded(metrics.best_threshold(metrics.score_levels(scored(spark, d), "toxic", "n_chars"), "n_chars"))


@query("SELECT round(2.0 * tp / (2 * tp + fp + fn), 6) AS f1, round(tp / (tp + fn), 6) AS sensitivity, round(tn / (tn + fp), 6) AS specificity FROM (SELECT count(*) FILTER (WHERE observed > 60 AND predicted > 60) AS tp, count(*) FILTER (WHERE observed <= 60 AND predicted > 60) AS fp, count(*) FILTER (WHERE observed > 60 AND predicted <= 60) AS fn, count(*) FILTER (WHERE observed <= 60 AND predicted <= 60) AS tn FROM pred)")
def m5_threshold_metrics(spark, d):
    return rounded(metrics.errors(pred(spark, d)).agg(*metrics.threshold_columns(F.col("is_high"), F.col("predicted") > 60)))


def auc(rule: str, score: str, by: str = "") -> str:
    part = f"PARTITION BY {by} " if by else ""
    group = f"{by}, " if by else ""
    return f"(SELECT {group}CASE WHEN max(pp) > 0 AND max(nn) > 0 THEN round(sum(p * (nn - fp + n / 2)) / (max(pp) * max(nn)), 6) END AS auroc, CASE WHEN max(pp) > 0 AND max(nn) > 0 THEN round(sum(p * tp / (tp + fp)) / max(pp), 6) END AS ap FROM (SELECT *, sum(p) OVER ({part}ORDER BY s DESC) AS tp, sum(n) OVER ({part}ORDER BY s DESC) AS fp, sum(p) OVER ({part}) AS pp, sum(n) OVER ({part}) AS nn FROM (SELECT {group}{score} AS s, count(*) FILTER (WHERE {rule}) AS p, count(*) FILTER (WHERE NOT {rule}) AS n FROM pred GROUP BY {group}{score})) {'GROUP BY ' + by if by else ''})"


def fixed(name: str, rule: str, hit: str) -> str:
    tp, fp, fn, tn = (f"count(*) FILTER (WHERE {a}({rule}) AND {b}({hit}))" for a, b in (("", ""), ("NOT ", ""), ("", "NOT "), ("NOT ", "NOT ")))
    return f"round(2.0 * {tp} / (2 * {tp} + {fp} + {fn}), 6) AS {name}_f1, round({tp} / ({tp} + {fn}), 6) AS {name}_sensitivity, round({tn} / ({tn} + {fp}), 6) AS {name}_specificity"


@query(f"SELECT a.*, h.auroc AS high_auroc, h.ap AS high_ap, l.auroc AS low_auroc, l.ap AS low_ap FROM (SELECT {REG}, {REGION}, {fixed('high', 'observed > 60', 'predicted > 60')}, {fixed('low', 'observed < 40', 'predicted < 40')} FROM pred) a, {auc('observed > 60', 'predicted')} h, {auc('observed < 40', '-predicted')} l")
def m6_pooled_evaluation(spark, d):
    return rounded(metrics.pooled(pred(spark, d)))


@query(f"SELECT a.*, h.auroc AS high_auroc, h.ap AS high_ap FROM (SELECT case_id, {REG}, {REGION} FROM pred GROUP BY 1) a JOIN {auc('observed > 60', 'predicted', 'case_id')} h USING (case_id)")
def m7_case_evaluation(spark, d):
    return rounded(metrics.per_case(pred(spark, d)))


@query("SELECT metric, count(value) AS cases, round(avg(value), 6) AS mean, round(median(value), 6) AS median, round(stddev_pop(value), 6) AS std, round(quantile_cont(value, 0.75) - quantile_cont(value, 0.25), 6) AS iqr FROM (SELECT case_id, 'mae' AS metric, avg(abs(predicted - observed)) AS value FROM pred GROUP BY 1 UNION ALL SELECT case_id, 'rmse', sqrt(avg((predicted - observed) ^ 2)) FROM pred GROUP BY 1) GROUP BY 1")
def m7_over_cases(spark, d):
    return rounded(metrics.over_cases(metrics.regression(pred(spark, d), ["case_id"]), ["mae", "rmse"]))


@query(f"SELECT case_id, final_ts, target_ts, {R('observed', 'predicted')} FROM pred")
def m8_persistence(spark, d):
    return rounded(pred(spark, d))


@query(f"SELECT case_id, target_ts, {R('abs(predicted - observed) AS abs_error', '(predicted - observed) ^ 2 AS sq_error')}, CASE WHEN observed < 40 THEN 'low' WHEN observed > 60 THEN 'high' ELSE 'mid' END AS region, CAST(observed > 60 AS INT) AS is_high FROM pred")
def m9_error_table(spark, d):
    return rounded(metrics.errors(pred(spark, d)).select("case_id", "target_ts", "abs_error", "sq_error", "region", "is_high"))


@query(f"SELECT {R('avg(predicted) AS mean', 'stddev_pop(predicted) AS std', 'min(predicted) AS min', 'max(predicted) AS max', 'corr(observed, predicted) AS pearson', 'avg(predicted - observed) AS bias', 'avg(predicted - observed) FILTER (WHERE observed > 60) AS high_bias')} FROM pred")
def m10_bias_summary(spark, d):
    return rounded(metrics.bias_summary(pred(spark, d)))


@query("SELECT case_id, final_ts, round(last_bis * 0.5 + last_aux * 0.25, 6) AS predicted FROM win")
def m11_user_model(spark, d):
    w = wins(spark, d).withColumn("flat", F.element_at("x", -1))
    return rounded(metrics.score_with(w, lambda x: x[:, 0] * 0.5 + x[:, 1] * 0.25).select("case_id", "final_ts", "predicted"))


@query("SELECT case_id, count(*) AS windows, case_id = 5 AS never_observed, bool_and(p IS NOT NULL) AS finite, round(avg(abs(p - y)), 6) AS mae FROM (SELECT *, CASE WHEN case_id <> 9 OR (final_ts // 86400) % 2 = 0 THEN last_bis END AS p FROM win) WHERE case_id IN (1, 5, 9) GROUP BY 1")
def m12_case_diagnostics(spark, d):
    """Case 5 has nothing observed, and case 9 lacks a forecast every other day."""
    w = wins(spark, d).withColumn("predicted", F.when((F.col("case_id") != 9) | (F.floor(F.col("final_ts") / DAY) % 2 == 0), F.element_at("x", -1)[0]))
    w = w.withColumn("mask", F.when(F.col("case_id") == 5, F.transform("mask", lambda r: F.transform(r, lambda v: F.lit(False)))).otherwise(F.col("mask")))
    return rounded(metrics.case_diagnostics(w, [1, 5, 9], [0, 1]))


# joins and pairs

@query("SELECT e.event_id, c.c_mktsegment FROM events e LEFT JOIN customer c ON c.c_custkey = e.user_id * 11")
def j1_clinical_join(spark, d):
    c = table(spark, d, "customer").select((F.col("c_custkey")).alias("k"), "c_mktsegment")
    return table(spark, d, "events").withColumn("k", F.col("user_id") * 11).join(c, "k", "left").select("event_id", "c_mktsegment")


@query("SELECT doc_id, quality, lang FROM labels JOIN documents USING (doc_id)")
def j2_key_unique_join(spark, d):
    return contracts.key_unique_join(table(spark, d, "labels"), table(spark, d, "documents").select("doc_id", "lang"), ["doc_id"]).select("doc_id", "quality", "lang")


COPIES = "CASE WHEN case_id % 11 = 0 THEN 2 ELSE 1 END"


@query(f"""SELECT (SELECT sum({COPIES}) FROM pred WHERE case_id % 7 = 1 AND case_id % 5 <> 1)::BIGINT AS missing_left, (SELECT count(*) FROM pred WHERE case_id % 5 = 1 AND case_id % 7 <> 1) AS missing_right,
  sum(CASE WHEN case_id % 13 = 0 THEN {COPIES} ELSE 0 END)::BIGINT AS differ_observed, sum(CASE WHEN case_id % 3 = 0 THEN {COPIES} ELSE 0 END)::BIGINT AS differ_predicted, sum(CASE WHEN case_id % 17 = 0 THEN {COPIES} ELSE 0 END)::BIGINT AS moved,
  (SELECT min(final_ts) FROM pred WHERE case_id % 7 <> 1 AND (case_id % 5 = 1 OR case_id % 13 = 0 OR case_id % 3 = 0 OR case_id % 17 = 0)) AS first_mismatch,
  0::BIGINT AS copies_left, (SELECT count(*) FROM pred WHERE case_id % 5 <> 1 AND case_id % 11 = 0) AS copies_right FROM pred WHERE case_id % 5 <> 1 AND case_id % 7 <> 1""")
def j3_alignment(spark, d):
    p = pred(spark, d)
    return pairing.alignment(p.where("case_id % 7 != 1"), faulty(p), ["case_id", "target_ts"], ["observed", "predicted"], order="final_ts")


def faulty(p):
    """Forecasts in which cases are missing, twice, moved in time, or changed in either value."""
    case = F.col("case_id")
    other = p.where("case_id % 5 != 1").withColumns({"predicted": F.col("predicted") + F.when(case % 3 == 0, 5.0).otherwise(0.0), "observed": F.col("observed") + F.when(case % 13 == 0, 1.0).otherwise(0.0), "final_ts": F.col("final_ts") + F.when(case % 17 == 0, 1).otherwise(0)})
    return other.unionByName(other.where("case_id % 11 = 0"))


@query("SELECT case_id, target_ts, round(CAST(predicted AS FLOAT)::DOUBLE, 6) AS \"left\", round(CAST(predicted + 5 AS FLOAT)::DOUBLE, 6) AS \"right\" FROM pred WHERE case_id % 5 <> 1 AND case_id % 3 = 0 AND case_id % 11 <> 0 ORDER BY case_id, target_ts LIMIT 10")
def j3_mismatches(spark, d):
    p = pred(spark, d).where("case_id % 11 != 0")
    found = pairing.mismatches(p, faulty(p), ["case_id", "target_ts"], "predicted")
    return rounded(found.withColumns({c: F.col(c).cast("double") for c in ("left", "right")}))


CTE["twice"] = "twice AS (SELECT doc_id, quality FROM labels UNION ALL SELECT doc_id, quality FROM labels WHERE doc_id % 11 = 0)"
CTE["known_docs"] = "known_docs AS (SELECT doc_id, CAST(lang = 'en' AS INT) AS quality FROM documents WHERE doc_id % 7 <> 0)"


@query("SELECT (SELECT count(*) FROM known_docs ANTI JOIN twice USING (doc_id)) AS uncovered, (SELECT count(*) FROM twice ANTI JOIN known_docs USING (doc_id)) AS unknown, (SELECT count(*) FROM twice t JOIN known_docs s USING (doc_id) WHERE t.quality <> s.quality) AS differ_quality, (SELECT count(*) FROM labels WHERE doc_id % 11 = 0) AS repeated")
def j4_prediction_metadata(spark, d):
    """Every seventh document is unknown to the metadata, and every eleventh has its label twice."""
    docs = table(spark, d, "documents").where("doc_id % 7 != 0").select("doc_id", (F.col("lang") == "en").cast("int").alias("quality"))
    known = table(spark, d, "labels")
    return pairing.metadata_alignment(known.unionByName(known.where("doc_id % 11 = 0")), docs, "doc_id", ["quality"])


CTE["pairf"] = "pairf AS (SELECT a.condition, a.seed, a.case_mae AS \"left\", b.case_mae AS \"right\", a.case_mae - b.case_mae AS difference FROM runt a JOIN runt b ON a.condition = b.condition AND a.seed = b.seed AND a.model = 'F' AND b.model = 'O')"


def pairf(spark, d):
    return pairing.paired_difference(runt(spark, d), ["condition", "seed"], "model", "F", "O", "case_mae")


@query('SELECT condition, seed, round("left", 9) AS "left", round("right", 9) AS "right", round(difference, 9) AS difference, round(100 * difference / "right", 9) AS relative_pct, CAST(difference < 0 AS INT) AS left_wins FROM pairf')
def j5_paired_difference(spark, d):
    return rounded(pairf(spark, d), 9)


@query("SELECT * FROM (SELECT condition, seed, round(difference, 9) AS difference, 'best' AS \"end\" FROM pairf ORDER BY pairf.difference, condition, seed LIMIT 5) UNION ALL SELECT * FROM (SELECT condition, seed, round(difference, 9) AS difference, 'worst' AS \"end\" FROM pairf ORDER BY pairf.difference DESC, condition, seed LIMIT 5)")
def j5_best_and_worst(spark, d):
    return rounded(pairing.best_and_worst(pairf(spark, d), "difference", ["condition", "seed"]).select("condition", "seed", "difference", "end"), 9)


CTE["refp"] = "refp AS (SELECT a.condition, a.model, a.seed, a.case_mae - b.case_mae AS delta, 100 * (a.case_mae - b.case_mae) / b.case_mae AS relative_pct FROM runt a JOIN runt b USING (model, seed) WHERE a.condition <> '1-URGENT' AND b.condition = '1-URGENT')"


def refp(spark, d):
    return pairing.against_reference(runt(spark, d), ["model", "seed"], "condition", "1-URGENT", "case_mae")


@query(f"SELECT condition, model, count(delta) AS pairs, {R('avg(delta) AS mean', 'stddev_samp(delta) AS std', 'median(delta) AS median', 'min(delta) AS min', 'max(delta) AS max', digits=9)}, count(*) FILTER (WHERE delta < 0) AS better FROM refp GROUP BY 1, 2")
def j6_reference_pairs(spark, d):
    return rounded(pairing.delta_summary(refp(spark, d), ["condition", "model"]), 9)


@query("SELECT a.condition, a.seed, m AS metric, round(CASE m WHEN 'case_mae' THEN a.case_mae ELSE a.cases END, 9) AS \"left\", round(CASE m WHEN 'case_mae' THEN b.case_mae ELSE b.cases END, 9) AS \"right\", round(CASE m WHEN 'case_mae' THEN a.case_mae - b.case_mae ELSE a.cases - b.cases END, 9) AS difference FROM runt a JOIN runt b USING (condition, seed), (VALUES ('case_mae'), ('cases')) v(m) WHERE a.model = 'F' AND b.model = 'O'")
def j7_long_pairs(spark, d):
    r = runt(spark, d)
    return rounded(pairing.long_pairs(r.where("model = 'F'"), r.where("model = 'O'"), ["condition", "seed"], ["case_mae", "cases"]), 9)


@query("SELECT c AS condition, m AS model, 'missing' AS status FROM (VALUES ('1-URGENT'), ('6-NONE')) a(c), (VALUES ('F'), ('P')) b(m) WHERE (c, m) NOT IN (SELECT (condition, model) FROM runt) UNION ALL SELECT DISTINCT condition, model, 'unexpected' FROM runt WHERE condition <> '1-URGENT' OR model = 'O' UNION ALL SELECT condition, model, 'duplicate' FROM runt GROUP BY 1, 2 HAVING count(*) > 1")
def j8_inventory(spark, d):
    one = spark.createDataFrame([("1-URGENT",), ("6-NONE",)], "condition string")
    two = spark.createDataFrame([("F",), ("P",)], "model string")
    return pairing.inventory(runt(spark, d), [one, two])


CTE["planted"] = "planted AS (SELECT DISTINCT run, feature FROM wts UNION ALL SELECT DISTINCT run, feature FROM wts WHERE feature % 10 = 3)"
CTE["wanted_grid"] = "wanted_grid AS (SELECT run, feature FROM (SELECT DISTINCT run FROM wts), (SELECT unnest(range(2, max(feature) + 2)) AS feature FROM wts))"


@query("SELECT *, 'missing' AS status FROM (SELECT run, feature FROM wanted_grid EXCEPT SELECT run, feature FROM planted) UNION ALL SELECT *, 'unexpected' FROM (SELECT run, feature FROM planted EXCEPT SELECT run, feature FROM wanted_grid) UNION ALL SELECT run, feature, 'duplicate' FROM planted GROUP BY 1, 2 HAVING count(*) > 1")
def j9_grid_completeness(spark, d):
    """Wanted are features from 2 to one beyond the widest; every tenth is planted twice."""
    w = wts(spark, d).select("run", "feature").distinct()
    widest = w.agg(F.max("feature")).first()[0] or 0
    return pairing.inventory(w.unionByName(w.where("feature % 10 = 3")), [w.select("run").distinct(), spark.range(2, widest + 2).withColumnRenamed("id", "feature")])


@query("SELECT sample, c AS \"column\", CASE c WHEN 'caseid' THEN n ELSE m END AS distinct_values, CASE c WHEN 'caseid' THEN n ELSE m END = 1 AS constant FROM (SELECT sample, count(DISTINCT caseid) AS n, count(DISTINCT run) + max(CASE WHEN run IS NULL THEN 1 ELSE 0 END) AS m FROM wts GROUP BY 1), (VALUES ('caseid'), ('run')) v(c)")
def j9_constant_columns(spark, d):
    return pairing.constant_columns(wts(spark, d), ["sample"], ["caseid", "run"])


@query("SELECT 'seed' AS setting, count(DISTINCT seed) AS distinct_values, count(DISTINCT seed) = 1 AS agrees FROM runt UNION ALL SELECT 'model', count(DISTINCT model), count(DISTINCT model) = 1 FROM runt")
def j10_setting_agreement(spark, d):
    return pairing.setting_agreement(runt(spark, d), ["seed", "model"])


@query("SELECT user_id AS caseid FROM events WHERE event_type IN ('click', 'error', 'view') AND value > 100 GROUP BY 1 HAVING count(DISTINCT event_type) = 3")
def j11_cases_with_all(spark, d):
    e = table(spark, d, "events").where("value > 100").select(F.col("user_id").alias("caseid"), F.col("event_type").alias("track"))
    return pairing.cases_with_all(e, ["click", "error", "view"])


@query("SELECT condition, model, seed, 'cases' AS setting, CAST(cases AS VARCHAR) AS found FROM runt WHERE cases <> 40 UNION ALL SELECT condition, model, seed, 'model', model FROM runt WHERE model <> 'F'")
def j10_expected_settings(spark, d):
    return pairing.setting_faults(runt(spark, d), ["condition", "model", "seed"], {"cases": 40, "model": "F"})


@query("SELECT condition, model, array_to_string(list_sort(list_filter([1992, 1993, 1994, 1995, 1996, 1997, 1999], lambda y: NOT list_contains(s, y))), ',') AS missing, array_to_string(list_sort(list_filter(s, lambda y: y NOT IN (1992, 1993, 1994, 1995, 1996, 1997, 1999))), ',') AS extra, n - len(s) AS repeated FROM (SELECT condition, model, list(DISTINCT seed) AS s, count(*) AS n FROM (SELECT condition, model, seed FROM runt UNION ALL SELECT condition, model, seed FROM runt WHERE model = 'P') GROUP BY 1, 2)")
def j10_schedule(spark, d):
    """Years stand for steps; the schedule asks for 1999 in place of 1998, and runs of one model are there twice."""
    r = runt(spark, d).select("condition", "model", "seed")
    out = pairing.schedule_faults(r.unionByName(r.where("model = 'P'")), ["condition", "model"], "seed", [*range(1992, 1998), 1999])
    return out.select("condition", "model", F.array_join("missing", ",").alias("missing"), F.array_join("extra", ",").alias("extra"), "repeated")


@query("SELECT user_id AS caseid FROM events WHERE event_type IN ('click', 'view') GROUP BY 1 HAVING count(DISTINCT event_type) = 2 ORDER BY 1 LIMIT 12")
def j11_fewer_tracks(spark, d):
    """No case has the wanted track that does not exist, so that the shorter list is taken."""
    e = table(spark, d, "events").select(F.col("user_id").alias("caseid"), F.col("event_type").alias("track"))
    return pairing.cases_with_all(e, ["click", "absent"], 12, fewer=["click", "view"])

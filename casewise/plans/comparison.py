"""Queries on run tables, bootstraps, selection, weight tables, episodes and provenance."""

from __future__ import annotations

from pyspark.sql import functions as F

from casewise import plans
from casewise import sources as src
from casewise.operators import boosting, cohort, episodes, metrics, pairing, runs, select, selectors, splits, weights
from casewise.operators import bootstrap as bs
from casewise.plans.evaluation import folder, pairf, parts, refp, splitted
from casewise.plans.queries import AHEAD, CTE, DAY, DRAW, LENGTH, QUERIES, SQL, R, cells, grid, holes, pred, query, rounded, runt, sig, table, wins, wts

__all__ = ["QUERIES", "SQL"]


def r9(df):
    return rounded(df, 9)


@query(f"SELECT condition, model, seed, caseid, {R('mae', digits=9)}, windows FROM cells")
def a1_case_errors(spark, d):
    return r9(cells(spark, d))


def runw(spark, d):
    """Runs with the number of their windows beside their error and cases."""
    return cells(spark, d).groupBy("condition", "model", "seed").agg(F.avg("mae").alias("case_mae"), F.count("*").alias("cases"), F.sum("windows").alias("windows"))


@query(f"SELECT condition, model, count(*) AS seeds, {R('avg(case_mae) AS mean', 'stddev_samp(case_mae) AS std', 'median(case_mae) AS median', 'min(case_mae) AS min', 'max(case_mae) AS max', 'stddev_samp(case_mae) / sqrt(count(*)) AS se', 'avg(case_mae) - 2.776445105 * stddev_samp(case_mae) / sqrt(count(*)) AS low', 'avg(case_mae) + 2.776445105 * stddev_samp(case_mae) / sqrt(count(*)) AS high', 'avg(windows) AS mean_best_epoch', digits=9)} FROM runt GROUP BY 1, 2")
def a2_over_seeds(spark, d):
    """The number of windows stands for the best epoch."""
    return r9(runs.over_seeds(runw(spark, d), ["condition", "model"], "case_mae", epoch="windows"))


@query(f"SELECT model, metric, {R('avg(v) AS mean', 'coalesce(stddev_samp(v), 0) AS std', 'min(v) AS min', 'max(v) AS max', digits=9)} FROM (SELECT model, 'case_mae' AS metric, case_mae AS v FROM runt UNION ALL SELECT model, 'cases', cases FROM runt) GROUP BY 1, 2")
def a3_metric_summaries(spark, d):
    return r9(runs.metric_summaries(runt(spark, d), ["model"], ["case_mae", "cases"]))


@query("SELECT condition, model, arg_min(seed, case_mae) AS best_epoch, round(min(case_mae), 9) AS best, max(seed) AS last_epoch, max(seed) < 2000 AS stopped_early FROM runt GROUP BY 1, 2")
def a4_run_summary(spark, d):
    return r9(runs.run_summary(runt(spark, d), ["condition", "model"], "seed", "case_mae", 2000))


CTE["cdiff"] = "cdiff AS (SELECT caseid, avg(a.mae - b.mae) AS v FROM cells a JOIN cells b USING (condition, seed, caseid) WHERE a.model = 'F' AND b.model = 'O' GROUP BY 1)"


def case_differences(spark, d):
    """Errors of one model less another's for each condition, seed and case."""
    return pairing.paired_difference(cells(spark, d), ["condition", "seed", "caseid"], "model", "F", "O", "mae")


CTE["cand"] = "cand AS (SELECT model, condition, avg(case_mae) AS error, CAST(count(*) + avg(cases) AS INT) % 7 AS cost FROM runt GROUP BY 1, 2)"


def cand(spark, d):
    return runt(spark, d).groupBy("model", "condition").agg(F.avg("case_mae").alias("error"), (F.rint(F.count("*") + F.avg("cases")).cast("int") % 7).alias("cost"))


@query("SELECT model || condition AS name, round(error, 9) AS error, round(error - (SELECT error FROM cand WHERE model = 'F' AND condition = '5-LOW'), 9) AS delta_error FROM cand")
def a5_against_row(spark, d):
    c = cand(spark, d).select(F.concat("model", "condition").alias("name"), "error")
    return r9(runs.against_row(c, "name", "F5-LOW", ["error"]))


CTE["par"] = """par AS (SELECT a.model, a.condition, a.cost, a.error, string_agg(b.condition, ',' ORDER BY b.condition) AS dominators FROM cand a LEFT JOIN cand b ON a.model = b.model AND b.cost <= a.cost AND b.error <= a.error AND (b.cost < a.cost OR b.error < a.error) GROUP BY 1, 2, 3, 4)"""


@query("SELECT p.model, condition, cost, round(error, 9) AS error, coalesce(dominators, '') AS dominators, dominators IS NULL AS on_front, dominators IS NULL AND error = (SELECT min(error) FROM par q WHERE q.model = p.model AND q.dominators IS NULL) AS is_best, dominators IS NULL AND cost = (SELECT min(cost) FROM par q WHERE q.model = p.model AND q.dominators IS NULL) AS is_simplest FROM par p")
def a6_pareto(spark, d):
    return r9(runs.pareto(cand(spark, d), "model", "condition", "cost", "error").withColumn("dominators", F.array_join("dominators", ",")))


@query("SELECT p.model, p.condition, round(p.error, 9) AS error, p.cost, dominators IS NULL AS on_front, dominators IS NULL AND p.error = (SELECT min(error) FROM par q WHERE q.model = p.model AND q.dominators IS NULL) AS is_best, r.mean AS mean_delta FROM par p LEFT JOIN (SELECT condition, model, round(avg(delta), 9) AS mean FROM refp GROUP BY 1, 2) r USING (model, condition)")
def a7_evidence_table(spark, d):
    contrast = pairing.delta_summary(refp(spark, d), ["condition", "model"]).select("condition", "model", F.col("mean").alias("mean_delta"))
    front = runs.pareto(cand(spark, d), "model", "condition", "cost", "error").select("model", "condition", "cost", "error", "on_front", "is_best")
    return r9(runs.evidence(front.select("model", "condition", "cost", "error"), front.drop("cost", "error"), contrast, ["model", "condition"]))


@query("SELECT * FROM (SELECT caseid, round(v, 9) AS mean, CAST(row_number() OVER (ORDER BY v, caseid) AS INT) AS place, 'best' AS side FROM cdiff UNION ALL SELECT caseid, round(v, 9), CAST(row_number() OVER (ORDER BY v DESC, caseid) AS INT), 'worst' FROM cdiff) WHERE place <= 5")
def a8_best_and_worst(spark, d):
    c = case_differences(spark, d).groupBy("caseid").agg(F.avg("difference").alias("mean"))
    return r9(runs.extremes(c, "mean", "caseid"))


@query(f"SELECT condition, {R('avg(difference) AS mean', 'stddev_samp(difference) AS std', 'min(difference) AS min', 'max(difference) AS max', digits=9)}, count(*) FILTER (WHERE difference < 0) AS won, count(*) AS seeds, min(difference) < 0 AND max(difference) > 0 AS sign_change, coalesce(stddev_samp(difference) > 0.2, false) OR (min(difference) < 0 AND max(difference) > 0) AS sensitive FROM pairf GROUP BY 1")
def a8_case_stability(spark, d):
    return r9(runs.case_stability(pairf(spark, d), "condition"))


@query("SELECT condition, CASE WHEN m < 0 AND w = n AND 2 * cw > cn THEN 'A' WHEN m < 0 AND w * 2 > n THEN 'B' ELSE 'C' END AS class, CASE WHEN m < -1 THEN 'under' WHEN m > 1 THEN 'over' ELSE 'balanced' END AS bias, cw AS won_cases, cn AS cases FROM (SELECT condition, avg(difference) AS m, count(*) FILTER (WHERE difference < 0) AS w, count(*) AS n FROM pairf GROUP BY 1) JOIN (SELECT condition, count(*) FILTER (WHERE v < 0) AS cw, count(*) AS cn FROM (SELECT condition, caseid, avg(a.mae - b.mae) AS v FROM cells a JOIN cells b USING (condition, seed, caseid) WHERE a.model = 'F' AND b.model = 'O' GROUP BY 1, 2) GROUP BY 1) USING (condition)")
def a9_rule_classes(spark, d):
    s = runs.case_stability(pairf(spark, d), "condition")
    c = case_differences(spark, d).groupBy("condition", "caseid").agg(F.avg("difference").alias("v")).groupBy("condition").agg(F.count(F.when(F.col("v") < 0, 1)).alias("won_cases"), F.count("*").alias("cases"))
    return s.join(c, "condition").select("condition", runs.result_class(F.col("mean"), F.col("won"), F.col("seeds"), F.col("won_cases"), F.col("cases")).alias("class"), runs.bias_label(F.col("mean")).alias("bias"), "won_cases", "cases")


@query("SELECT condition, model, seed, rank() OVER (PARTITION BY seed ORDER BY cases DESC) + (count(*) OVER (PARTITION BY seed, cases) - 1) / 2 AS rank FROM runt")
def a10_rank_in_group(spark, d):
    return pairing.rank_in_group(runt(spark, d), ["seed"], "cases").select("condition", "model", "seed", "rank")


@query("SELECT condition, model, count(*) FILTER (WHERE r = 1) AS wins, round(avg(r), 9) AS mean_rank FROM (SELECT *, row_number() OVER (PARTITION BY seed ORDER BY cases DESC, windows, condition, model) AS r FROM runt) GROUP BY 1, 2")
def a10_wins_and_mean_rank(spark, d):
    ranked = pairing.ordered_rank(runw(spark, d), ["seed"], [F.desc("cases"), F.asc("windows"), F.asc("condition"), F.asc("model")])
    return r9(pairing.rank_summary(ranked, ["condition", "model"]))


@query("SELECT condition, model, round(e, 9) AS early, round(l, 9) AS late, round(l - e, 9) AS change, CASE WHEN e - l > 0.05 * e THEN 'improving' WHEN e - l < -0.05 * e THEN 'worsening' ELSE 'plateau' END AS trend FROM (SELECT condition, model, max(case_mae) FILTER (WHERE seed = 1995) AS e, max(case_mae) FILTER (WHERE seed = 1998) AS l FROM runt GROUP BY 1, 2) WHERE e IS NOT NULL AND l IS NOT NULL")
def a11_checkpoint_trend(spark, d):
    return r9(runs.checkpoint_trend(runt(spark, d), ["condition", "model"], "seed", 1995, 1998, "case_mae"))


@query(f"SELECT {R('avg(difference) AS mean', 'median(difference) AS median', 'quantile_cont(difference, 0.025) AS low', 'quantile_cont(difference, 0.975) AS high', digits=9)}, count(*) FILTER (WHERE difference < 0) AS improved, count(*) FILTER (WHERE difference > 0) AS worsened, count(*) FILTER (WHERE difference = 0) AS tied FROM pairf")
def a12_difference_summary(spark, d):
    return r9(runs.difference_summary(pairf(spark, d), [], "difference"))


@query("SELECT c_mktsegment, \"grouping\", band, count(v) AS n, round(avg(v), 6) AS mean, round(stddev_samp(v), 6) AS std FROM (SELECT c_mktsegment, 'balance' AS \"grouping\", CASE WHEN c_acctbal < 0 THEN 'debt' WHEN c_acctbal < 5000 THEN 'low' ELSE 'high' END AS band, c_acctbal AS v FROM customer UNION ALL SELECT c_mktsegment, 'nation', CASE WHEN c_nationkey < 12 THEN 'a' ELSE 'b' END, c_acctbal FROM customer) GROUP BY 1, 2, 3")
def a13_subgroups(spark, d):
    c = table(spark, d, "customer")
    bands = {"balance": F.when(F.col("c_acctbal") < 0, "debt").when(F.col("c_acctbal") < 5000, "low").otherwise("high"), "nation": F.when(F.col("c_nationkey") < 12, "a").otherwise("b")}
    return rounded(runs.subgroup_summary(c, bands, ["c_mktsegment"], "c_acctbal"))


@query(f"SELECT model, seed, count(*) AS runs, {R('avg(case_mae) AS case_mae_mean', 'stddev_samp(case_mae) AS case_mae_std', 'avg(cases) AS cases_mean', 'stddev_samp(cases) AS cases_std', digits=9)} FROM runt GROUP BY 1, 2")
def a14_learning_curve(spark, d):
    return r9(runs.learning_curve(runt(spark, d), ["model"], "seed", ["case_mae", "cases"]))


@query("SELECT c AS condition, m AS model, CASE WHEN n IS NULL THEN 'pending' WHEN n % 3 = 0 THEN 'failed' WHEN m = 'P' THEN 'incomplete' ELSE 'done' END AS outcome, CASE WHEN m <> 'P' THEN round(e, 9) END AS error FROM (VALUES ('1-URGENT'), ('2-HIGH'), ('6-NONE')) a(c), (VALUES ('F'), ('P')) b(m) LEFT JOIN (SELECT condition, model, CAST(sum(cases) AS BIGINT) AS n, avg(case_mae) AS e FROM runt GROUP BY 1, 2) r ON r.condition = c AND r.model = m")
def a15_run_collection(spark, d):
    planned = spark.createDataFrame([(c, m) for c in ("1-URGENT", "2-HIGH", "6-NONE") for m in ("F", "P")], "condition string, model string")
    r = runt(spark, d).groupBy("condition", "model").agg(F.sum("cases").alias("n"), F.avg("case_mae").alias("error"))
    status = r.select("condition", "model", F.when(F.col("n") % 3 == 0, "failed").otherwise("finished").alias("status"))
    found = runs.collect_runs(planned, status, r.where("model != 'P'").select("condition", "model", "error"), ["condition", "model"])
    return r9(found.select("condition", "model", "outcome", "error"))


@query("SELECT condition, round(avg(difference), 9) AS mean, round(stddev_samp(difference), 9) AS std, count(*) FILTER (WHERE difference < 0) AS improved, arg_min(seed, difference) AS best_seed, arg_max(seed, difference) AS worst_seed FROM pairf GROUP BY 1")
def a16_across_seeds(spark, d):
    return r9(runs.across_seeds(pairf(spark, d).withColumn("direction", F.lit(-1)), ["condition"], "seed", "difference", "direction"))


@query("SELECT model, count(*) AS seeds, round(avg(o), 9) AS observed, round(avg(p), 9) AS predicted, round(avg(p - o), 9) AS bias, bool_and(p < o) AS always_under FROM (SELECT model, seed, avg(case_mae) AS o, avg(windows) AS p FROM runt WHERE case_mae > 60 GROUP BY 1, 2) GROUP BY 1")
def a17_subset_bias(spark, d):
    return r9(runs.subset_bias(runw(spark, d), ["model"], "seed", "case_mae", "windows"))


@query("SELECT model, count(*) AS seeds, round(avg(d), 9) AS difference, count(*) FILTER (WHERE d < 0) AS better FROM (SELECT model, seed, avg(abs(windows - case_mae)) - avg(abs(cases - case_mae)) AS d FROM runt WHERE case_mae > 60 GROUP BY 1, 2) GROUP BY 1")
def a17_better_on_subset(spark, d):
    """Windows stand for the forecast and cases for the baseline."""
    return r9(runs.better_on_subset(runw(spark, d), ["model"], "seed", "case_mae", "windows", "cases"))


# resampling

CTE["cm"] = "cm AS (SELECT case_id, avg(abs(predicted - observed)) AS v, row_number() OVER (ORDER BY case_id) - 1 AS i, count(*) OVER () AS n FROM pred GROUP BY 1)"


@query(f"SELECT {R('avg(v) AS mean', 'quantile_cont(v, 0.025) AS low', 'quantile_cont(v, 0.975) AS high')}, count(*) AS replicates FROM (SELECT replicate, avg(v) AS v FROM (SELECT replicate, {DRAW.format("'42:' || replicate || ':' || k")} % n AS i FROM range(20000) r(replicate), (SELECT unnest(range(n)) AS k, n FROM (SELECT count(*) AS n FROM cm))) JOIN cm USING (i) GROUP BY 1)")
def b1_case_bootstrap(spark, d):
    cases = metrics.regression(pred(spark, d), ["case_id"])
    return rounded(bs.interval(bs.case_bootstrap(cases, "mae", "case_id", 20_000), []))


CTE["con"] = """con AS (SELECT 'condition|' || a.condition || '|' || a.model AS contrast, a.seed, a.caseid, a.mae - b.mae AS v FROM full_ a JOIN full_ b USING (model, seed, caseid) WHERE a.condition <> '1-URGENT' AND b.condition = '1-URGENT'
  UNION ALL SELECT 'model|' || a.condition || '|' || a.model || '|' || b.model, a.seed, a.caseid, a.mae - b.mae FROM full_ a JOIN full_ b USING (condition, seed, caseid) WHERE a.model < b.model)"""
CTE["full_"] = "full_ AS (SELECT o_orderpriority AS condition, o_orderstatus AS model, year(o_orderdate) % 2 AS seed, o_custkey % 5 AS caseid, avg(o_totalprice / 1000) AS mae FROM orders GROUP BY 1, 2, 3, 4)"
CTE["con"] = CTE.pop("con")


def full_cells(spark, d):
    o = table(spark, d, "orders").select(F.col("o_orderpriority").alias("condition"), F.col("o_orderstatus").alias("model"), (F.year("o_orderdate") % 2).alias("seed"), (F.col("o_custkey") % 5).alias("caseid"), "o_totalprice")
    return runs.case_errors(o, ["condition", "model", "seed"], "caseid", F.col("o_totalprice") / 1000).drop("windows")


@query(f"""SELECT contrast, {R('avg(v) AS mean', 'quantile_cont(v, 0.025) AS low', 'quantile_cont(v, 0.975) AS high')}, count(*) AS replicates FROM (
  SELECT k.contrast, k.replicate, avg(c.v) AS v FROM (
    SELECT contrast, replicate, slot, place, {DRAW.format("'42:' || contrast || ':s:' || replicate || ':' || slot")} % 2 AS s, {DRAW.format("'42:' || contrast || ':c:' || replicate || ':' || slot || ':' || place")} % 5 AS i FROM (SELECT DISTINCT contrast FROM con), range(10000) a(replicate), range(2) b(slot), range(5) e(place)) k
    JOIN con c ON c.contrast = k.contrast AND c.seed = k.s AND c.caseid = k.i GROUP BY 1, 2) GROUP BY 1""")
def b2_mean_of_cells(spark, d):
    paired = bs.all_contrasts(full_cells(spark, d), "condition", "1-URGENT", "model", ["seed", "caseid"], "mae")
    return rounded(bs.interval(bs.hierarchical_bootstrap(paired, ["contrast"], "seed", "caseid", "difference", 10_000, cells_mean=True), ["contrast"]))


@query(f"""SELECT contrast, metric, {R('avg(v) AS mean', 'quantile_cont(v, 0.025) AS low', 'quantile_cont(v, 0.975) AS high')}, count(*) AS replicates FROM (
  SELECT contrast, metric, replicate, avg(m) AS v FROM (SELECT k.contrast, k.metric, k.replicate, k.slot, avg(CASE k.metric WHEN 'difference' THEN c.v ELSE abs(c.v) END) AS m FROM (
    SELECT contrast, metric, replicate, slot, place, {DRAW.format("'42:' || contrast || '|' || metric || ':s:' || replicate || ':' || slot")} % 2 AS s, {DRAW.format("'42:' || contrast || '|' || metric || ':c:' || replicate || ':' || slot || ':' || place")} % 5 AS i FROM (SELECT DISTINCT contrast FROM con), (VALUES ('difference'), ('size')) q(metric), range(10000) a(replicate), range(2) b(slot), range(5) e(place)) k
    JOIN con c ON c.contrast = k.contrast AND c.seed = k.s AND c.caseid = k.i GROUP BY 1, 2, 3, 4) GROUP BY 1, 2, 3) GROUP BY 1, 2""")
def b2_for_each_metric(spark, d):
    paired = bs.all_contrasts(full_cells(spark, d), "condition", "1-URGENT", "model", ["seed", "caseid"], "mae").withColumn("size", F.abs("difference"))
    long = paired.unpivot(["contrast", "seed", "caseid"], ["difference", "size"], "metric", "value")
    return rounded(bs.interval(bs.hierarchical_bootstrap(long, ["contrast", "metric"], "seed", "caseid", "value", 10_000), ["contrast", "metric"]))


CONTRASTS = f"""SELECT contrast, {R('avg(v) AS mean', 'quantile_cont(v, 0.025) AS low', 'quantile_cont(v, 0.975) AS high')}, count(*) AS replicates FROM (
  SELECT contrast, replicate, avg(m) AS v FROM (SELECT k.contrast, k.replicate, k.slot, avg(c.v) AS m FROM (
    SELECT contrast, replicate, slot, place, {DRAW.format("'42:' || contrast || ':s:' || replicate || ':' || slot")} % 2 AS s, {DRAW.format("'42:' || contrast || ':c:' || replicate || ':' || slot || ':' || place")} % 5 AS i FROM (SELECT DISTINCT contrast FROM con), range(10000) a(replicate), range(2) b(slot), range(5) e(place)) k
    JOIN con c ON c.contrast = k.contrast AND c.seed = k.s AND c.caseid = k.i GROUP BY 1, 2, 3) GROUP BY 1, 2) GROUP BY 1"""


@query(CONTRASTS + " HAVING contrast LIKE 'model|%'")
def b2_hierarchical_bootstrap(spark, d):
    paired = bs.all_contrasts(full_cells(spark, d), "condition", "1-URGENT", "model", ["seed", "caseid"], "mae").where("contrast like 'model|%'")
    return rounded(bs.interval(bs.hierarchical_bootstrap(paired, ["contrast"], "seed", "caseid", "difference", 10_000), ["contrast"]))


@query(CONTRASTS)
def b3_all_contrasts(spark, d):
    return rounded(plans.contrasts(full_cells(spark, d), "condition", "1-URGENT", "model", "seed", "caseid", "mae", 10_000))


# selection

def moments(spark, d):
    w = splits.case_weights(wins(spark, d))
    flat = w.select("case_id", "y", "weight", F.flatten("x").alias("x"))
    return select.case_moments(flat, "x", "y", "weight")


NAMES = [f"{n}@{k}" for k in range(LENGTH) for n in ("bis", "aux")]


@query(None)
def f1_f2_elastic_net_grid(spark, d):
    m = moments(spark, d)
    return rounded(select.cv_grid(m, splits.folds(m, 3, case="case_id"), [0.1, 1.0, 10.0], [0.5, 1.0], [True] * len(NAMES)))


def fits(spark, d):
    m = moments(spark, d)
    return select.bootstrap_fits(m, splits.multiplicities(m, 100, case="case_id"), NAMES, [True] * len(NAMES), 1.0, 0.5)


@query(None)
def f3_f4_bootstrap_stability(spark, d):
    return rounded(select.stability_summary(fits(spark, d)))


CTE["freq"] = "freq AS (SELECT event_type AS feature, count(DISTINCT user_id) FILTER (WHERE value > 150) / count(DISTINCT user_id) AS frequency FROM events GROUP BY 1)"


def freq(spark, d):
    e = table(spark, d, "events")
    return e.groupBy(F.col("event_type").alias("feature")).agg((F.count_distinct(F.when(F.col("value") > 150, F.col("user_id"))) / F.count_distinct("user_id")).alias("frequency"))


@query("SELECT t AS threshold, p AS place, f AS feature FROM (VALUES ('click', 0), ('error', 1), ('purchase', 2), ('signup', 3), ('view', 4)) o(f, p) JOIN freq ON feature = f, (VALUES (CAST(0.8 AS DOUBLE)), (0.6), (0.4)) x(t) WHERE frequency >= t OR f = 'view'")
def f5_threshold_sets(spark, d):
    order = spark.createDataFrame([("click", 0), ("error", 1), ("purchase", 2), ("signup", 3), ("view", 4)], "feature string, place int")
    return select.threshold_sets(freq(spark, d), order, "view")


LAGS = {n: [k for k, name in enumerate(NAMES) if name.startswith(n)] for n in ("bis", "aux")}


def flat(spark, d):
    """Windows with all lags in one array, none missing."""
    return selectors.filled(wins(spark, d).select("case_id", "final_ts", "y", F.flatten("x").alias("x")))


@query(None)
def f2_balanced_grid(spark, d):
    w = flat(spark, d)
    return rounded(selectors.net_grid(w, select.case_moments(w, "x", "y"), splits.folds(w, 3, case="case_id"))[0])


@query(None)
def f2_coefficient_path(spark, d):
    w = flat(spark, d)
    return rounded(selectors.net_grid(w, select.case_moments(w, "x", "y"), splits.folds(w, 3, case="case_id"))[1])


def net_fits(spark, d):
    return selectors.net_stability(select.case_moments(flat(spark, d), "x", "y"), LAGS, 0.1, 0.9, 20)


@query(None)
def f3_subsample_fits(spark, d):
    return rounded(net_fits(spark, d))


@query(None)
def f4_selection_summary(spark, d):
    return rounded(selectors.net_summary(net_fits(spark, d)))


@query(None)
def f6_tree_grid(spark, d):
    w = flat(spark, d)
    return rounded(selectors.tree_grid(w, splits.folds(w, 3, case="case_id"), learner=boosting.fit_together))


@query(None)
def f6_tree_stability(spark, d):
    return rounded(selectors.gain_summary(selectors.tree_stability(flat(spark, d), LAGS, learner=boosting.fit_together)))


CTE["donor"] = f"donor AS (SELECT caseid, coalesce(lead(caseid) OVER w, first_value(caseid) OVER w) AS donor FROM (SELECT DISTINCT caseid FROM grid) WINDOW w AS (ORDER BY {DRAW.format("'7:' || caseid")}, caseid))"


@query("SELECT a.caseid, a.timestamp, round(b.bis, 6) AS bis FROM (SELECT g.*, donor, row_number() OVER (PARTITION BY caseid ORDER BY timestamp) - 1 AS i, count(*) OVER (PARTITION BY caseid) AS n FROM grid g JOIN donor USING (caseid)) a JOIN (SELECT caseid AS donor, bis, row_number() OVER (PARTITION BY caseid ORDER BY timestamp) - 1 AS j, count(*) OVER (PARTITION BY caseid) AS m FROM grid) b ON a.donor = b.donor AND b.j = CASE WHEN n > 1 THEN round(i * (m - 1) / (n - 1)) ELSE 0 END")
def f7_block_permutation(spark, d):
    g = grid(spark, d)
    donors = select.block_permutation(g, 7, "caseid")
    return rounded(select.permute_blocks(g, ["bis"], donors, "caseid", "timestamp").select("caseid", "timestamp", "bis"))


CTE["ring"] = f"ring AS (SELECT k, case_id, coalesce(lead(case_id) OVER w, first_value(case_id) OVER w) AS donor FROM (SELECT DISTINCT case_id FROM win), range(3) r(k) WINDOW w AS (PARTITION BY k ORDER BY {DRAW.format("(20 + k) || ':' || case_id")}, case_id))"
CTE["placed"] = "placed AS (SELECT case_id, y, last_bis, row_number() OVER (PARTITION BY case_id ORDER BY final_ts) - 1 AS i, count(*) OVER (PARTITION BY case_id) AS n FROM win)"


@query(f"""SELECT 'bis' AS feature, {R('avg(g) AS mean', 'stddev_samp(g) AS std', 'median(g) AS median', 'avg(CASE WHEN g > 0 THEN 1.0 ELSE 0.0 END) AS positive')}, avg(CASE WHEN g > 0 THEN 1.0 ELSE 0.0 END) >= 0.7 AS stable FROM (
  SELECT k, avg(e) - (SELECT avg(e) FROM (SELECT case_id, avg(abs(last_bis - y)) AS e FROM win GROUP BY 1)) AS g FROM (
    SELECT k, a.case_id, avg(abs(b.last_bis - a.y)) AS e FROM placed a JOIN ring USING (case_id) JOIN placed b ON b.case_id = ring.donor AND b.i = CASE WHEN a.n > 1 THEN round(a.i * (b.n - 1) / (a.n - 1)) ELSE 0 END GROUP BY 1, 2) GROUP BY 1)""")
def f8_permutation_importance(spark, d):
    """Gain of a last-value model when the value's block comes from another case, over repeats."""
    w = wins(spark, d).select("case_id", "final_ts", "y", F.element_at("x", -1)[0].alias("bis"))
    error = lambda df: df.groupBy("case_id").agg(F.avg(F.abs(F.col("bis") - F.col("y"))).alias("e")).agg(F.avg("e").alias("e"))
    base = error(w).withColumnRenamed("e", "baseline")
    out = None
    for k in range(3):
        moved = select.permute_blocks(w, ["bis"], select.block_permutation(w, 20 + k))
        one = error(moved).select(F.lit("bis").alias("feature"), F.lit(k).alias("repeat"), F.col("e").alias("permuted")).join(F.broadcast(base))  # one row
        out = one if out is None else out.unionByName(one)
    return rounded(select.importance_summary(out))


CTE["emb"] = "emb AS (SELECT vec_id, i, CAST(embedding[i + 1] AS DOUBLE) AS v FROM (SELECT vec_id, embedding, unnest(range(len(embedding))) AS i FROM embeddings))"
CTE["embr"] = "embr AS (SELECT *, rank() OVER (PARTITION BY i ORDER BY v) + (count(*) OVER (PARTITION BY i, v) - 1) / 2 AS r FROM emb)"
CTE["embc"] = "embc AS (SELECT a.i, b.i AS j, corr(a.v, b.v) AS pearson, corr(a.r, b.r) AS spearman FROM embr a JOIN embr b USING (vec_id) WHERE a.i < b.i GROUP BY 1, 2)"


def components(spark, d):
    """Vectors as columns e0, e1 and so on, as many as the longest has."""
    e = table(spark, d, "embeddings")
    wide = e.agg(F.max(F.size("embedding"))).first()[0] or 0
    return e.select("vec_id", *(F.get("embedding", F.lit(k)).cast("double").alias(f"e{k}") for k in range(wide)))


@query("SELECT 'e' || i AS a, 'e' || j AS b, round(pearson, 6) AS pearson, round(spearman, 6) AS spearman FROM embc")
def f9_correlations(spark, d):
    c = components(spark, d)
    return rounded(select.correlations(c, c.columns[1:], ["vec_id"]))


CTE["casem"] = "casem AS (SELECT caseid, avg(bis) AS bis, avg(aux) AS aux, avg(time_sec) AS time_sec FROM holes GROUP BY 1)"
CTE["caser"] = "caser AS (SELECT *, " + ", ".join(f"rank() OVER (ORDER BY {c}) + (count(*) OVER (PARTITION BY {c}) - 1) / 2 AS r_{c}" for c in ("bis", "aux", "time_sec")) + " FROM casem)"


@query(" UNION ALL ".join(f"SELECT '{a}' AS a, '{b}' AS b, round(corr({a}, {b}), 6) AS pearson, round(corr(r_{a}, r_{b}), 6) AS spearman FROM caser" for a, b in (("bis", "aux"), ("bis", "time_sec"), ("aux", "time_sec"))))
def f9_correlations_of_case_means(spark, d):
    means = holes(spark, d).groupBy("caseid").agg(*(F.avg(c).alias(c) for c in ("bis", "aux", "time_sec")))
    return rounded(select.correlations(means, ["bis", "aux", "time_sec"], ["caseid"]))


@query("""SELECT 'e' || i AS feature, CAST(dense_rank() OVER (ORDER BY head) - 1 AS INT) AS cluster FROM (SELECT i, min(j) AS head FROM (
    WITH RECURSIVE edge AS (SELECT i, j FROM embc WHERE greatest(abs(pearson), abs(spearman)) >= 0.12), link AS (SELECT i, j FROM edge UNION ALL SELECT j, i FROM edge),
    reach(i, j) AS (SELECT DISTINCT i, i FROM emb UNION SELECT r.i, k.j FROM reach r JOIN link k ON r.j = k.i) SELECT * FROM reach) GROUP BY 1)""")
def f10_correlation_clusters(spark, d):
    """At 0.12, since the components are nearly independent; the operator's own threshold is 0.8."""
    c = components(spark, d)
    return select.correlation_clusters(select.correlations(c, c.columns[1:], ["vec_id"]), c.columns[1:], 0.12)


@query("SELECT feature, CAST(frequency >= 0.6 AS INT) AS high, CAST(feature IN ('click', 'view') AS INT) AS short, CAST(frequency >= 0.6 AS INT) + CAST(feature IN ('click', 'view') AS INT) AS agreement FROM freq")
def f11_consensus(spark, d):
    f = freq(spark, d)
    return select.consensus({"high": f.select("feature", (F.col("frequency") >= 0.6).alias("stable")), "short": f.select("feature", F.col("feature").isin("click", "view").alias("stable"))}, f)


@query("SELECT subset, features, len(string_split(features, ',')) AS size FROM (SELECT subset, features, place, row_number() OVER (PARTITION BY features ORDER BY place) AS k FROM (SELECT s.place, s.subset, string_agg(DISTINCT feature, ',' ORDER BY feature) AS features FROM (VALUES (0, 'a'), (1, 'b'), (2, 'both'), (3, 'either'), (4, 'clusters')) s(place, subset) JOIN freq ON CASE subset WHEN 'a' THEN frequency >= 0.6 WHEN 'b' THEN feature <= 'purchase' WHEN 'both' THEN frequency >= 0.6 AND feature <= 'purchase' WHEN 'either' THEN frequency >= 0.6 OR feature <= 'purchase' ELSE feature IN (SELECT feature FROM (SELECT feature, row_number() OVER (PARTITION BY length(feature) % 2 ORDER BY frequency DESC, feature) AS nth FROM freq) WHERE nth = 1) END OR feature = 'view' GROUP BY 1, 2)) WHERE k = 1")
def f12_candidate_sets(spark, d):
    f = freq(spark, d)
    clusters = f.select("feature", (F.length("feature") % 2).alias("cluster"))
    return select.candidate_sets(f.where("frequency >= 0.6"), f.where("feature <= 'purchase'"), clusters, f.select("feature", F.col("frequency").alias("score")), ["view"])


@query("SELECT * FROM (VALUES ('one', 'view', 1), ('two', 'click,view', 2), ('three', 'click,error,view', 3), ('four', 'click,error,purchase,view', 4), ('five', 'click,error,purchase,signup,view', 5)) v(subset, features, size) WHERE (SELECT count(*) FROM events) > 0")
def f12_nested_anchors(spark, d):
    """Five nested sets that are fixed beforehand; the selectors' own add none that differs."""
    f = freq(spark, d)
    names = ["view", "click", "error", "purchase", "signup"]
    anchors = dict(zip(("one", "two", "three", "four", "five"), (names[: k + 1] for k in range(5)), strict=True))
    everything = f.select("feature")
    return select.candidate_sets(everything, everything, f.select("feature", F.lit(0).alias("cluster")), f.select("feature", F.when(F.col("feature") == "view", 1).otherwise(0).alias("score")), ["view"], anchors=anchors)


@query("SELECT event_type AS feature, CASE WHEN event_type IN ('click', 'view') THEN 'dynamic' ELSE 'static' END AS role, round(avg(CASE WHEN value < 5 THEN 1.0 ELSE 0.0 END), 6) AS missing, event_type = 'error' AS excluded FROM events GROUP BY 1")
def f13_feature_inventory(spark, d):
    roles = spark.createDataFrame([("click", "dynamic"), ("view", "dynamic"), ("error", "static"), ("purchase", "static"), ("signup", "static")], "feature string, role string")
    shares = table(spark, d, "events").groupBy(F.col("event_type").alias("feature")).agg(F.avg((F.col("value") < 5).cast("double")).alias("missing"))
    return rounded(shares.join(roles, "feature").withColumn("excluded", F.col("feature") == "error").select("feature", "role", "missing", "excluded"))


# weights

@query(f"SELECT case_id, final_ts, CAST(s AS INT) AS step, 0.0::DOUBLE AS bis, g.aux AS aux, false AS seen FROM win, range({LENGTH}) r(s) JOIN grid g ON g.caseid = case_id AND g.timestamp = first_ts + s * {DAY}")
def x1_ablation(spark, d):
    w = weights.ablate(wins(spark, d), [0])
    return w.select("case_id", "final_ts", F.posexplode(F.arrays_zip("x", "mask")).alias("step", "r")).select("case_id", "final_ts", "step", F.col("r.x")[0].alias("bis"), F.col("r.x")[1].alias("aux"), F.col("r.mask")[0].alias("seen"))


@query("SELECT a.case_id, a.final_ts, round(b.last_bis, 6) AS bis FROM (SELECT *, CASE WHEN n > 1 THEN 1 + (42 * 31 + 3 * 17 + case_id) % (n - 1) ELSE 0 END AS shift FROM (SELECT *, row_number() OVER (PARTITION BY case_id ORDER BY final_ts) - 1 AS i, count(*) OVER (PARTITION BY case_id) AS n FROM win)) a JOIN (SELECT case_id, last_bis, row_number() OVER (PARTITION BY case_id ORDER BY final_ts) - 1 AS j FROM win) b ON a.case_id = b.case_id AND b.j = (a.i - a.shift + 10 * a.n) % a.n")
def x2_circular_shift(spark, d):
    w = wins(spark, d).select("case_id", "final_ts", F.element_at("x", -1)[0].alias("bis"))
    return rounded(weights.circular_shift(w, ["bis"], 42, 3))


def six(p: str) -> str:
    e = f"abs({p} - observed)"
    return f"SELECT case_id % 3 AS part, sum(s) / sum(n) AS pooled_mae, avg(s / n) AS case_mae, sqrt(sum(q) / sum(n)) AS rmse, sum(sl) / sum(nl) AS low_mae, sum(sm) / sum(nm) AS mid_mae, sum(sh) / sum(nh) AS high_mae FROM (SELECT case_id, sum({e}) AS s, count(*) AS n, sum({e} ^ 2) AS q, sum({e}) FILTER (WHERE observed < 40) AS sl, nullif(count(*) FILTER (WHERE observed < 40), 0) AS nl, sum({e}) FILTER (WHERE observed BETWEEN 40 AND 60) AS sm, nullif(count(*) FILTER (WHERE observed BETWEEN 40 AND 60), 0) AS nm, sum({e}) FILTER (WHERE observed > 60) AS sh, nullif(count(*) FILTER (WHERE observed > 60), 0) AS nh FROM pred GROUP BY 1) GROUP BY 1"


NAMES_OF_SIX = ["pooled_mae", "case_mae", "rmse", "low_mae", "mid_mae", "high_mae"]


@query(f"SELECT part, {', '.join(f'round(a.{m} - b.{m}, 6) AS delta_{m}' for m in NAMES_OF_SIX)} FROM ({six('(predicted + 1 + case_id % 2)')}) a JOIN ({six('predicted')}) b USING (part)")
def x3_delta_metrics(spark, d):
    p = pred(spark, d).withColumn("part", F.col("case_id") % 3)
    moved = p.withColumn("predicted", F.col("predicted") + 1 + F.col("case_id") % 2)
    return rounded(weights.delta_metrics(weights.prediction_metrics(moved, ["part"]), weights.prediction_metrics(p, ["part"]), ["part"], NAMES_OF_SIX))


CTE["rf"] = "rf AS (SELECT run, feature, avg(weight) AS v FROM wts GROUP BY 1, 2)"


def rf(spark, d):
    return wts(spark, d).groupBy("run", "feature").agg(F.avg("weight").alias("v"))


CTE["rfr"] = "rfr AS (SELECT *, rank() OVER (PARTITION BY run ORDER BY v DESC) + (count(*) OVER (PARTITION BY run, v) - 1) / 2 AS r FROM (SELECT run, feature, v - 1 / 64 AS v FROM rf))"


@query("SELECT feature, round(avg(v), 9) AS mean, round(stddev_samp(v), 9) AS std, count(*) FILTER (WHERE v > 0) AS positive, min(r) AS rank_min, max(r) AS rank_max, (SELECT round(avg(s), 9) FROM (SELECT corr(a.r, b.r) AS s FROM rfr a JOIN rfr b USING (feature) WHERE a.run < b.run GROUP BY a.run, b.run)) AS agreement, count(*) FILTER (WHERE v > 0) >= 4 AND avg(v) > 1e-6 AS stable FROM rfr GROUP BY 1")
def x4_contribution_stability(spark, d):
    """The delta of a feature is its weight above an equal share."""
    return r9(weights.contribution_stability(rf(spark, d).withColumn("v", F.col("v") - 1 / 64), [], "run", "feature", "v"))


CTE["wc"] = "wc AS (SELECT run, feature, avg(weight) AS v, max(weight) - avg(weight) AS delta FROM wts GROUP BY 1, 2)"
CTE["wcr"] = "wcr AS (SELECT *, " + ", ".join(f"rank() OVER (PARTITION BY run ORDER BY {c}) + (count(*) OVER (PARTITION BY run, {c}) - 1) / 2 AS m_{c}, row_number() OVER (PARTITION BY run ORDER BY {c} DESC, feature) AS p_{c}" for c in ("v", "delta")) + " FROM wc)"


@query("SELECT *, round(avg(spearman) OVER (), 6) AS mean, round(stddev_samp(spearman) OVER (), 6) AS std, count(*) FILTER (WHERE spearman > 0) OVER () AS positive FROM (SELECT run, round(corr(m_v, m_delta), 6) AS spearman, " + ", ".join(f"count(*) FILTER (WHERE p_v <= {k} AND p_delta <= {k}) AS overlap_{k}, round(count(*) FILTER (WHERE p_v <= {k} AND p_delta <= {k}) / count(*) FILTER (WHERE p_v <= {k} OR p_delta <= {k}), 6) AS jaccard_{k}" for k in (5, 10)) + " FROM wcr GROUP BY 1)")
def x5_contribution_agreement(spark, d):
    w = wts(spark, d).groupBy("run", "feature").agg(F.avg("weight").alias("v"), (F.max("weight") - F.avg("weight")).alias("delta"))
    return rounded(weights.contribution_agreement(w, [], "run", "feature", "v", "delta"))


CTE["ord"] = "ord AS (SELECT *, row_number() OVER (PARTITION BY run ORDER BY v DESC, feature) AS r FROM rf)"
PAIRS = "SELECT a.run AS a, b.run AS b, round(corr(a.r, b.r), 6) AS spearman, round(corr(a.v, b.v), 6) AS pearson, round(sum(a.v * b.v) / sqrt(sum(a.v * a.v) * sum(b.v * b.v)), 6) AS cosine, round(count(*) FILTER (WHERE a.r <= 5 AND b.r <= 5) / count(*) FILTER (WHERE a.r <= 5 OR b.r <= 5), 6) AS jaccard, count(*) FILTER (WHERE a.r <= 5 AND b.r <= 5) AS overlap FROM ord a JOIN ord b USING (feature) WHERE a.run < b.run GROUP BY 1, 2"


@query(PAIRS)
def x5_x11_pairwise_agreement(spark, d):
    return rounded(weights.pairwise_vectors(rf(spark, d), [], "run", "feature", "v"))


@query("SELECT count(*) AS vectors, round(min(m), 9) AS least, count(*) FILTER (WHERE abs(s - 1) > 0.00001) AS not_one, CAST(sum(u) AS BIGINT) AS weight_on_unobserved FROM (SELECT run, sample, sum(weight) AS s, min(weight) AS m, count(*) FILTER (WHERE weight <> 0 AND (feature + sample) % 9 = 0) AS u FROM wts GROUP BY 1, 2)")
def x6_normalization_audit(spark, d):
    return r9(weights.normalization_audit(wts(spark, d).withColumn("observed", (F.col("feature") + F.col("sample")) % 9 != 0), ["run", "sample"]))


@query("SELECT run, sample, count(*) AS observed, round(sum(CASE WHEN weight > 0 THEN -weight * ln(weight) ELSE 0 END) / ln(count(*)), 6) AS entropy FROM wts GROUP BY 1, 2")
def x7_entropy(spark, d):
    return rounded(weights.normalized_entropy(wts(spark, d), ["run", "sample"]))


CTE["tops"] = "tops AS (SELECT run, sample, sum(weight) FILTER (WHERE k <= 1) AS top1, sum(weight) FILTER (WHERE k <= 3) AS top3, sum(weight) FILTER (WHERE k <= 5) AS top5 FROM (SELECT *, row_number() OVER (PARTITION BY run, sample ORDER BY weight DESC, feature) AS k FROM wts) GROUP BY 1, 2)"


@query(f"SELECT run, sample, {R('top1', 'top3', 'top5')} FROM tops")
def x8_concentration(spark, d):
    return rounded(weights.concentration(wts(spark, d), ["run", "sample"], "feature"))


@query(f"SELECT count(*) AS vectors, {R('quantile_cont(top1, 0.25) AS q25', 'quantile_cont(top1, 0.5) AS q50', 'quantile_cont(top1, 0.75) AS q75', 'avg(CASE WHEN top1 > 0.5 THEN 1.0 ELSE 0.0 END) AS over_50', 'avg(CASE WHEN top1 > 0.75 THEN 1.0 ELSE 0.0 END) AS over_75', 'avg(CASE WHEN top1 > 0.9 THEN 1.0 ELSE 0.0 END) AS over_90')}, avg(CASE WHEN top1 > 0.9 THEN 1.0 ELSE 0.0 END) >= 0.8 AS collapsed FROM tops")
def x8_concentration_summary(spark, d):
    return rounded(weights.concentration_summary(weights.concentration(wts(spark, d), ["run", "sample"], "feature")))


CTE["cw"] = "cw AS (SELECT run, feature, caseid, avg(weight) AS v FROM wts GROUP BY 1, 2, 3)"


@query(f"SELECT feature, {R('avg(v) AS mean', 'stddev_samp(v) AS std', 'median(v) AS median', 'min(v) AS min', 'max(v) AS max')}, row_number() OVER (ORDER BY avg(v) DESC, feature) AS rank FROM (SELECT feature, caseid, avg(weight) AS v FROM wts GROUP BY 1, 2) GROUP BY 1")
def x9_balanced_summary(spark, d):
    return rounded(weights.balanced_summary(wts(spark, d), "feature", case="caseid"))


CTE["shifted"] = "shifted AS (SELECT a.run, a.feature, a.m AS region_mean, b.m AS overall_mean, a.m - b.m AS shift FROM (SELECT run, feature, avg(v) AS m FROM cw GROUP BY 1, 2) a JOIN (SELECT feature, avg(v) AS m FROM (SELECT feature, caseid, avg(weight) AS v FROM wts GROUP BY 1, 2) GROUP BY 1) b USING (feature))"


def shifted(spark, d):
    w = wts(spark, d)
    per = weights.balanced_summary(w, "feature", case="caseid", by=["run"])
    return weights.region_shift(per, weights.balanced_summary(w, "feature", case="caseid"), "feature", "run")


@query(f"SELECT run, feature, {R('region_mean', 'overall_mean', 'shift')} FROM shifted")
def x10_region_split(spark, d):
    return rounded(shifted(spark, d))


@query("SELECT run, feature, round(shift, 6) AS shift, place FROM (SELECT *, row_number() OVER (PARTITION BY run ORDER BY shift DESC, feature) AS place FROM shifted) WHERE place <= 5")
def x10_largest_shifts(spark, d):
    return rounded(weights.largest(shifted(spark, d), ["run"], "shift", "feature").select("run", "feature", "shift", "place"))


STEPS = 4
CTE["att"] = f"att AS (SELECT *, w / sum(w) OVER (PARTITION BY v, l) AS f, sum(w) OVER (PARTITION BY v, l) / sum(w) OVER (PARTITION BY v) AS t, CASE WHEN v % 7 = 0 THEN 1.01 ELSE 1.0 END AS k, NOT (v % 11 = 0 AND i = 0) AS seen FROM (SELECT vec_id AS v, i, i // (len(embedding) // {STEPS}) AS l, abs(CAST(embedding[i + 1] AS DOUBLE)) AS w FROM (SELECT vec_id, embedding, unnest(range(len(embedding) // {STEPS} * {STEPS})) AS i FROM embeddings)))"


def joint(spark, d):
    """Vectors as weights of four steps, with joint weights that are off for every seventh and a gap in every eleventh."""
    e = table(spark, d, "embeddings").select(F.col("vec_id").alias("sample"), F.transform("embedding", lambda x: F.abs(x.cast("double"))).alias("w"))
    size = (F.size("w") / STEPS).cast("int")
    total = lambda a: F.aggregate(a, F.lit(0.0), lambda s, v: s + v)
    e = e.withColumn("blocks", F.transform(F.sequence(F.lit(0), F.lit(STEPS - 1)), lambda l: F.slice("w", l * size + 1, size)))
    e = e.withColumn("sums", F.transform("blocks", total))
    e = e.withColumns({"feature": F.transform("blocks", lambda row: F.transform(row, lambda v: v / total(row))), "temporal": F.transform("sums", lambda s: s / total(F.col("sums")))})
    off = F.when(F.col("sample") % 7 == 0, 1.01).otherwise(1.0)
    seen = F.transform(F.sequence(F.lit(0), F.lit(STEPS - 1)), lambda l: F.transform(F.sequence(F.lit(0), size - 1), lambda i: ~((F.col("sample") % 11 == 0) & (l == 0) & (i == 0))))
    return e.withColumns({"joint": F.zip_with("feature", "temporal", lambda row, t: F.transform(row, lambda v: v * t * off)), "observed": seen}).drop("w", "blocks", "sums")


@query("""SELECT (SELECT count(*) FROM embeddings) AS vectors, round(min(f), 9) AS feature_least, round(max(fe), 6) AS feature_error, count(*) FILTER (WHERE fe > 1e-5 AND i % 16 = 0) AS feature_off, round(coalesce(max(f) FILTER (WHERE NOT seen), 0), 9) AS unobserved_most, count(*) FILTER (WHERE NOT seen AND f > 0) AS unobserved,
  round(min(t), 9) AS temporal_least, round(max(te), 6) AS temporal_error, count(*) FILTER (WHERE te > 1e-5 AND i = 0) AS temporal_off, round(min(f * t * k), 9) AS joint_least, round(max(je), 6) AS joint_error, count(*) FILTER (WHERE je > 1e-5 AND i = 0) AS joint_off, round(max(abs(f * t * k - f * t)), 9) AS product_error, count(*) FILTER (WHERE abs(f * t * k - f * t) > 1e-5) AS product_off
  FROM (SELECT *, abs(sum(f) OVER (PARTITION BY v, l) - 1) AS fe, abs(sum(f * t) OVER (PARTITION BY v) - 1) AS te, abs(sum(f * t * k) OVER (PARTITION BY v) - 1) AS je FROM att)""")
def x6_joint_audit(spark, d):
    out = weights.joint_audit(joint(spark, d), "feature", "temporal", "joint", "observed")
    six = [c for c in out.columns if c.endswith("_error") and not c.startswith("product")]
    return r9(out.withColumns({c: F.round(c, 6) for c in six}))


CTE["fault"] = "fault AS (SELECT vec_id AS v, vec_id % 17 <> 0 AS o, vec_id % 13 <> 0 AS p, CASE WHEN vec_id % 17 <> 0 AND vec_id % 31 = 0 THEN 2 ELSE 1 END AS k FROM embeddings)"


@query("""SELECT CAST(coalesce(sum(k) FILTER (WHERE p AND NOT o), 0) AS BIGINT) AS missing, CAST(coalesce(sum(k) FILTER (WHERE o AND NOT p), 0) AS BIGINT) AS extra, CAST(coalesce(sum(k) FILTER (WHERE p AND v % 41 = 0), 0) AS BIGINT) AS differ_case_id, CAST(coalesce(sum(k) FILTER (WHERE p AND v % 43 = 0), 0) AS BIGINT) AS differ_target_ts,
  CAST(coalesce(sum(k) FILTER (WHERE o AND p AND v % 19 = 0), 0) AS BIGINT) AS "case", CAST(coalesce(sum(k) FILTER (WHERE o AND v % 23 = 0), 0) AS BIGINT) AS shape, CAST(coalesce(sum(k) FILTER (WHERE o AND v % 29 = 0 OR p AND v % 37 = 0), 0) AS BIGINT) AS not_finite, count(*) FILTER (WHERE o AND v % 31 = 0) AS repeated FROM fault""")
def x12_weights_aligned(spark, d):
    """Weights, predictions and metadata of the vectors, with a fault of each kind at multiples of its own prime."""
    s = F.col("sample")
    w = joint(spark, d).where(s % 17 != 0).withColumn("case_id", s % 20 + F.when(s % 19 == 0, 1).otherwise(0))
    w = w.withColumns({"observed": F.when(s % 23 == 0, F.slice("observed", 1, STEPS - 1)).otherwise(F.col("observed")), "temporal": F.when(s % 29 == 0, F.transform("temporal", lambda v: F.lit(float("nan")))).otherwise(F.col("temporal"))})
    ids = table(spark, d, "embeddings").select(F.col("vec_id").alias("sample"), (F.col("vec_id") % 20).alias("case_id"), (F.col("vec_id") * 10).alias("target_ts"))
    predictions = ids.where(s % 13 != 0).withColumn("predicted", F.when(s % 37 == 0, float("nan")).otherwise(s.cast("double")))
    metadata = ids.withColumns({"case_id": F.col("case_id") + F.when(s % 41 == 0, 1).otherwise(0), "target_ts": F.col("target_ts") + F.when(s % 43 == 0, 1).otherwise(0)})
    return weights.aligned_weights(w.unionByName(w.where(s % 31 == 0)), predictions, metadata, "sample", ["case_id", "target_ts"], "feature", "temporal", "joint", "observed")


@query(f"SELECT lag, {R('avg(v) AS mean', 'stddev_samp(v) AS std', 'median(v) AS median', 'min(v) AS min', 'max(v) AS max')}, row_number() OVER (ORDER BY avg(v) DESC, lag) AS rank FROM (SELECT lag, caseid, avg(v) AS v FROM (SELECT (feature - 1) // 16 AS lag, caseid, sample, avg(weight) AS v FROM wts GROUP BY 1, 2, 3) GROUP BY 1, 2) GROUP BY 1")
def x9_lag_summary(spark, d):
    w = wts(spark, d).withColumn("lag", F.floor((F.col("feature") - 1) / 16))
    return rounded(weights.balanced_summary(w, "lag", case="caseid"))


@query(f"SELECT \"group\", {R('avg(v) AS mean', 'stddev_samp(v) AS std', 'median(v) AS median', 'min(v) AS min', 'max(v) AS max')}, row_number() OVER (ORDER BY avg(v) DESC, \"group\") AS rank FROM (SELECT \"group\", caseid, avg(v) AS v FROM (SELECT 'g' || (feature % 4) AS \"group\", run, caseid, sample, sum(weight) AS v FROM wts GROUP BY 1, 2, 3, 4) GROUP BY 1, 2) GROUP BY 1")
def x9_group_summary(spark, d):
    w = wts(spark, d)
    groups = w.select("feature").distinct().withColumn("group", F.concat(F.lit("g"), F.col("feature") % 4))
    return rounded(weights.balanced_summary(weights.grouped_weights(w, ["run", "sample", "caseid"], "feature", groups), "group", case="caseid"))


@query("SELECT feature, round(avg(v), 6) AS mean, round(stddev_samp(v), 6) AS std, round(avg(r), 6) AS rank_mean, round(stddev_samp(r), 6) AS rank_std, max(r) - min(r) AS rank_range, round(stddev_samp(v) / avg(v), 6) AS cv, max(r) - min(r) > 5 AS moves, stddev_samp(v) / avg(v) > 0.5 AS varies, avg(v) < 0.01 AS small FROM ord GROUP BY 1")
def x13_weight_stability(spark, d):
    return rounded(weights.weight_stability(rf(spark, d), [], "run", "feature", "v"))


@query("SELECT feature, round(avg(shift), 6) AS mean, count(*) FILTER (WHERE shift > 0) AS positive, count(*) AS seeds, bool_and(shift > 0) OR bool_and(shift < 0) AS same_direction FROM shifted GROUP BY 1")
def x14_shift_over_seeds(spark, d):
    return rounded(weights.shift_over_seeds(shifted(spark, d), ["feature"]))


@query("SELECT round(avg(s), 6) AS mean, count(*) FILTER (WHERE s > 0) AS positive, count(*) AS seeds, bool_and(s > 0) OR bool_and(s < 0) AS same_direction FROM (SELECT run, sum(shift) AS s FROM shifted WHERE feature IN (3, 40) GROUP BY 1)")
def x14_joint_shift_over_seeds(spark, d):
    return rounded(weights.shift_over_seeds(weights.joint_shift(shifted(spark, d), ["run"], "feature", [3, 40]), []))


CTE["gw"] = "gw AS (SELECT run, feature % 8 AS grp, sum(v) AS v FROM rf GROUP BY 1, 2)"
CTE["gord"] = "gord AS (SELECT *, row_number() OVER (PARTITION BY run ORDER BY v DESC, grp) AS r FROM gw)"


@query("""SELECT *, CASE WHEN item_spearman >= 0.7 AND item_jaccard >= 0.6 THEN 'items' WHEN group_spearman >= 0.7 AND group_cosine >= 0.9 AND group_range <= 2 THEN 'groups' ELSE 'unstable' END AS class FROM
    (SELECT round(avg(s), 6) AS item_spearman, round(avg(k), 6) AS item_jaccard FROM (SELECT corr(a.r, b.r) AS s, count(*) FILTER (WHERE a.r <= 5 AND b.r <= 5) / count(*) FILTER (WHERE a.r <= 5 OR b.r <= 5) AS k FROM ord a JOIN ord b USING (feature) WHERE a.run < b.run GROUP BY a.run, b.run)),
    (SELECT round(avg(s), 6) AS group_spearman, round(avg(c), 6) AS group_cosine FROM (SELECT corr(a.r, b.r) AS s, sum(a.v * b.v) / sqrt(sum(a.v * a.v) * sum(b.v * b.v)) AS c FROM gord a JOIN gord b USING (grp) WHERE a.run < b.run GROUP BY a.run, b.run)),
    (SELECT max(m) AS group_range FROM (SELECT max(r) - min(r) AS m FROM gord GROUP BY grp))""")
def x13_stability_class(spark, d):
    items = rf(spark, d)
    groups = items.groupBy("run", (F.col("feature") % 8).alias("grp")).agg(F.sum("v").alias("v"))
    pairs = [weights.pairwise_vectors(df, [], "run", item, "v") for df, item in ((items, "feature"), (groups, "grp"))]
    return rounded(weights.stability_class(*pairs, weights.weight_stability(groups, [], "run", "grp", "v")))


@query("SELECT feature, round(avg(weight) FILTER (WHERE run = 0), 6) AS first, round(avg(weight) FILTER (WHERE run = 1), 6) AS second, round(avg(weight) FILTER (WHERE run = 1) - avg(weight) FILTER (WHERE run = 0), 6) AS shift FROM wts GROUP BY 1")
def x15_run_shift(spark, d):
    return rounded(weights.run_shift(wts(spark, d), "feature", "run", 0, 1, "weight"))


# episodes

@query(f"""SELECT caseid, {R('sum(CASE WHEN bis BETWEEN 40 AND 60 THEN 10.0 ELSE 0 END) AS in_range', 'sum(CASE WHEN bis < 40 THEN 10.0 ELSE 0 END) AS below', 'sum(CASE WHEN bis > 60 THEN 10.0 ELSE 0 END) AS above', 'sum(CASE WHEN bis < 30 THEN 10.0 ELSE 0 END) AS deep', 'avg(abs(bis - 50)) AS mae', 'sqrt(avg((bis - 50) ^ 2)) AS rmse', 'sum(abs(bis - 50)) * 10 AS integrated_error', 'sum(aux) * 10 AS dose', 'avg(aux) AS rate_mean', 'max(aux) AS rate_max', 'avg(da) AS smoothness')}, count(*) FILTER (WHERE da > 20) AS large_changes, count(*) FILTER (WHERE aux >= 95 - 0.000001) AS saturated FROM (SELECT *, abs(aux - lag(aux) OVER (PARTITION BY caseid ORDER BY time_sec)) AS da FROM sig) GROUP BY 1""")
def e1_episode_metrics(spark, d):
    return rounded(episodes.episode_metrics(sig(spark, d), "caseid", "time_sec", "bis", "aux", 10.0, change=20.0, limit=95.0))


@query(f"""SELECT caseid, count(*) AS steps, {R('count(*) * 10.0::DOUBLE AS duration', 'avg(CASE WHEN bis BETWEEN 40 AND 60 THEN 1.0 ELSE 0.0 END) AS in_range_share', 'avg(CASE WHEN bis < 40 THEN 1.0 ELSE 0.0 END) AS below_share', 'avg(CASE WHEN bis > 60 THEN 1.0 ELSE 0.0 END) AS above_share', 'avg(CASE WHEN bis < 30 THEN 1.0 ELSE 0.0 END) AS deep_share', 'max(abs(bis - 50)) AS largest_error', 'stddev_pop(bis) AS value_std', 'stddev_pop(aux) AS action_std', 'coalesce(sum(abs(da)), 0) AS change_sum', 'coalesce(sum(da * da), 0) AS squared_change_sum')},
  count(*) FILTER (WHERE abs(aux) <= 1e-6) AS at_floor, round(count(*) FILTER (WHERE abs(aux) <= 1e-6) / count(*), 6) AS at_floor_share, count(*) FILTER (WHERE abs(aux - 95) <= 1e-6) AS at_ceiling, round(count(*) FILTER (WHERE abs(aux - 95) <= 1e-6) / count(*), 6) AS at_ceiling_share, {R('avg(aux) AS aux_mean', 'max(aux) AS aux_max', 'sum(CASE WHEN aux > 50 THEN 10.0::DOUBLE ELSE 0 END) AS over_threshold', 'coalesce(sum(bis), 0) AS bis_total')}, arg_max(kind, time_sec) AS ended
  FROM (SELECT *, aux - lag(aux) OVER (PARTITION BY caseid ORDER BY time_sec) AS da FROM sig) GROUP BY 1""")
def e1_episode_extras(spark, d):
    s = sig(spark, d).withColumnRenamed("kind", "reason")
    return rounded(episodes.episode_extras(s, "caseid", "time_sec", "bis", "aux", 10.0, ceiling=95.0, levels=["aux"], effect="aux", threshold=50.0, reward="bis"))


@query("SELECT caseid, min(time_sec) FILTER (WHERE before = 1 AND o = 0) AS reentry, min(time_sec) FILTER (WHERE after_ = 0) AS settled FROM (SELECT *, max(o) OVER (PARTITION BY caseid ORDER BY time_sec ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS before, max(o) OVER (PARTITION BY caseid ORDER BY time_sec ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS after_ FROM (SELECT *, CASE WHEN bis BETWEEN 20 AND 90 THEN 0 ELSE 1 END AS o FROM sig)) GROUP BY 1")
def e2_settling(spark, d):
    return episodes.settling(sig(spark, d), "caseid", "time_sec", "bis", 20, 90)


@query("SELECT split || '_' || lpad(CAST(k AS VARCHAR), 4, '0') AS scenario, caseid, split, CAST(100 + k AS INT) AS seed FROM (SELECT *, row_number() OVER (PARTITION BY split ORDER BY caseid) - 1 AS k FROM splitted)")
def e3_scenarios(spark, d):
    return episodes.scenarios(splitted(spark, d), "split", 100)


@query("SELECT a.kind AS profile, v AS variable, round(max(abs(CASE v WHEN 'bis' THEN a.bis - b.bis ELSE a.aux - b.aux END)), 6) AS difference, max(abs(CASE v WHEN 'bis' THEN a.bis - b.bis ELSE a.aux - b.aux END)) = 0 AS passed FROM (SELECT caseid % 50 AS step, kind, median(bis) AS bis, median(aux) AS aux FROM sig GROUP BY 1, 2) a JOIN (SELECT caseid % 50 AS step, kind, median(bis) AS bis, median(aux) AS aux FROM sig GROUP BY 1, 2) b ON a.step = b.step AND b.kind = 'click' AND a.kind <> 'click', (VALUES ('bis'), ('aux')) x(v) GROUP BY 1, 2")
def e4_trajectory_difference(spark, d):
    t = sig(spark, d).groupBy((F.col("caseid") % 50).alias("step"), F.col("kind").alias("profile")).agg(F.median("bis").alias("bis"), F.median("aux").alias("aux"))
    return rounded(episodes.trajectory_difference(t, "profile", "click", ["step"], ["bis", "aux"]))


# cohort and provenance

@query("SELECT c_nationkey AS caseid, count(*) AS versions FROM (SELECT DISTINCT c_nationkey, c_mktsegment FROM customer) GROUP BY 1 HAVING count(*) > 1")
def c1_demographic_conflicts(spark, d):
    return cohort.conflicts(table(spark, d, "customer").select(F.col("c_nationkey").alias("caseid"), "c_mktsegment"))


@query("SELECT split, count(*) AS rows, count(*) FILTER (WHERE bis IS NULL) AS missing_bis, count(*) FILTER (WHERE aux IS NULL) AS missing_aux FROM parts GROUP BY 1")
def c2_cohort_cover(spark, d):
    return cohort.missing_counts(parts(spark, d), ["split"], ["bis", "aux"])


@query("SELECT caseid, time_sec, coalesce(bis, (SELECT median(bis) FROM parts WHERE split = 'train')) AS bis, coalesce(aux, (SELECT median(aux) FROM parts WHERE split = 'train')) AS aux, concat_ws(',', CASE WHEN bis IS NULL THEN 'bis' END, CASE WHEN aux IS NULL THEN 'aux' END) AS imputed FROM parts")
def c3_train_imputation(spark, d):
    out = cohort.impute_from_train(parts(spark, d), F.col("split") == "train", ["bis", "aux"], [])
    return out.select("caseid", "time_sec", "bis", "aux", F.array_join("imputed", ",").alias("imputed"))


@query("SELECT split, count(*) AS cases, min(caseid) AS first, max(caseid) AS last FROM splitted GROUP BY 1")
def c4_split_manifest(spark, d):
    """From a list of cases for each split, which must not share any."""
    path, names = folder(spark), ("train", "val", "test")
    for name in names:
        splitted(spark, d).where(F.col("split") == name).select("caseid").write.option("header", True).csv(f"{path}/{name}.csv")
    lists = src.split_lists(spark, {n: f"{path}/{n}.csv" for n in names})
    return lists.groupBy("split").agg(F.count("*").alias("cases"), F.min("caseid").alias("first"), F.max("caseid").alias("last"))


LINE = "l_discount l_extendedprice l_linenumber l_linestatus l_orderkey l_partkey l_quantity l_returnflag l_shipdate l_suppkey l_tax".split()


@query(f"""SELECT count(*) AS rows, sha256('["' || array_to_string({LINE}, '","') || '"]') AS columns, bit_xor(h) AS xor, CAST(sum(h) AS VARCHAR) AS sum FROM (
  SELECT CAST('0x' || substr(md5({" || ".join(f"coalesce(length(CAST({c} AS VARCHAR)) || ':' || CAST({c} AS VARCHAR), '-')" for c in LINE)}), 1, 15) AS BIGINT) AS h FROM lineitem)""")
def v1_table_fingerprint(spark, d):
    return cohort.table_fingerprint(table(spark, d, "lineitem"))


@query("SELECT count(*) AS rows, count(*) FILTER (WHERE split = 'test') AS sealed_rows FROM parts")
def v2_split_seal(spark, d):
    return cohort.seal_counts(parts(spark, d))


@query("SELECT metric, CASE metric WHEN 'mae' THEN (SELECT count(DISTINCT case_id) FROM pred WHERE case_id % 10 = 0) ELSE (SELECT count(DISTINCT case_id) FROM pred WHERE case_id % 10 = 0) END AS unpaired, CASE metric WHEN 'mae' THEN (SELECT count(DISTINCT case_id) FROM pred WHERE case_id % 10 = 3) ELSE 0 END AS differ FROM (VALUES ('mae'), ('rmse')) v(metric)")
def v3_stored_metrics(spark, d):
    computed = metrics.regression(pred(spark, d), ["case_id"])
    stored = computed.where("case_id % 10 != 0").withColumn("mae", F.col("mae") + F.when(F.col("case_id") % 10 == 3, 1.0).otherwise(0.0))
    return cohort.stored_against_recomputed(stored, computed, ["case_id"], ["mae", "rmse"], 1e-9)


@query("SELECT condition, model, arg_min(seed, case_mae) AS best_epoch, round(min(case_mae), 9) AS best, CAST(arg_min(seed, case_mae) + 1 AS INT) AS recorded_epoch, round(min(case_mae), 9) AS recorded FROM runt WHERE model = 'P' GROUP BY 1, 2 UNION ALL SELECT condition, model, arg_min(seed, case_mae), round(min(case_mae), 9), NULL, NULL FROM runt WHERE model = 'O' GROUP BY 1, 2")
def v3_best_epoch(spark, d):
    """Years stand for epochs; one model's record is an epoch off and another's is absent."""
    r = runt(spark, d)
    kept = r.groupBy("condition", "model").agg(F.min("case_mae").alias("case_mae"), F.min_by("seed", "case_mae").alias("seed")).where("model != 'O'")
    record = kept.withColumn("seed", F.col("seed") + F.when(F.col("model") == "P", 1).otherwise(0))
    return r9(cohort.best_epoch_faults(r, record, ["condition", "model"], "seed", "case_mae"))


@query("SELECT 'a' AS run, case_id, CASE WHEN case_id % 4 = 1 THEN 'no predictions' ELSE 'not listed' END AS fault FROM (SELECT DISTINCT case_id FROM pred) WHERE case_id % 4 IN (1, 2)")
def v3_case_lists(spark, d):
    ids = pred(spark, d).select("case_id").distinct().withColumn("run", F.lit("a"))
    return cohort.case_list_faults(ids.where("case_id % 4 != 1"), ids.where("case_id % 4 != 2"), ["run"])


CTE["pnum"] = f"pnum AS (SELECT case_id, row_number() OVER (ORDER BY {DRAW.format("'42:' || case_id")}, case_id) AS nth, count(*) OVER () AS n FROM (SELECT DISTINCT case_id FROM pred))"
CTE["psplit"] = "psplit AS (SELECT case_id, CASE WHEN nth <= a THEN 'train' WHEN nth <= a + b THEN 'val' ELSE 'test' END AS split FROM (SELECT *, floor(0.7 * n) + CASE WHEN 0.7 * n - floor(0.7 * n) >= 0.15 * n - floor(0.15 * n) AND n - floor(0.7 * n) - 2 * floor(0.15 * n) > 0 OR n - floor(0.7 * n) - 2 * floor(0.15 * n) > 1 THEN 1 ELSE 0 END AS a, floor(0.15 * n) + CASE WHEN 0.7 * n - floor(0.7 * n) < 0.15 * n - floor(0.15 * n) AND n - floor(0.7 * n) - 2 * floor(0.15 * n) > 0 OR n - floor(0.7 * n) - 2 * floor(0.15 * n) > 1 THEN 1 ELSE 0 END AS b FROM pnum))"


@query(f"SELECT split, count(*) AS cases, {R('avg(mae) AS mae_mean', 'median(mae) AS mae_median', 'stddev_pop(mae) AS mae_std')}, CAST(sum(n) AS BIGINT) AS windows FROM (SELECT case_id, avg(abs(predicted - observed)) AS mae, count(*) AS n FROM pred GROUP BY 1) JOIN psplit USING (case_id) GROUP BY 1")
def path_persistence_by_split(spark, d):
    return rounded(plans.persistence_by_split(grid(spark, d), "bis", LENGTH, DAY, AHEAD))

"""Operators applied to the driver's tables, each with SQL that states the same result.

Signals: `events`, a case for each user, with the value as the index, `k` of the JSON as a second signal and daily
bins. Forecasts: the last value of a window against the target three days on. Runs: `orders`, priority as condition,
status as model, year as seed and customer as case.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from casewise import plans
from casewise import sources as src
from casewise.functions import zone
from casewise.operators import clean, features, pk, prep, resample, runs, windows

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
SQL: dict[str, str] = {}

DAY, LENGTH = 86_400, 6
AHEAD = 3 * DAY


def query(sql: str | None = None):
    def keep(f: Query) -> Query:
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = ("WITH " + ", ".join(CTE[c] for c in CTE if used(c, sql)) + " " if any(used(c, sql) for c in CTE) else "") + sql
        return f

    return keep


def used(name: str, sql: str, seen: tuple[str, ...] = ()) -> bool:
    import re

    if re.search(rf"\b{name}\b", sql):
        return True
    return any(re.search(rf"\b{name}\b", CTE[c].split(" AS ", 1)[1]) and c != name and used(c, sql, (*seen, name)) for c in CTE if c not in seen and c != name)


DRAW = "CAST(('0x' || substr(md5({}), 1, 8)) AS BIGINT)"
#: Parts that several queries share, in an order in which each needs only those before it.
CTE = {
    "sig": """sig AS (SELECT user_id AS caseid, CAST(floor(epoch(ts)) AS BIGINT) AS time_sec, max(value) AS bis,
        max(CAST(json_extract_string(props, '$.k') AS DOUBLE)) AS aux, max(event_type) AS kind FROM events GROUP BY 1, 2)""",
    "holes": "holes AS (SELECT caseid, time_sec, kind, CASE WHEN CAST(aux AS INT) % 4 = 0 THEN NULL ELSE bis END AS bis, CASE WHEN CAST(aux AS INT) % 5 = 0 THEN NULL ELSE aux END AS aux FROM sig)",
    "grid": f"grid AS (SELECT caseid, (time_sec // {DAY}) * {DAY} AS timestamp, median(bis) AS bis, max_by(aux, time_sec) AS aux FROM sig GROUP BY 1, 2)",
    "ends": f"""ends AS (SELECT g.*, coalesce(h.old = g.timestamp - {(LENGTH - 1) * DAY}, false) AS has_history, n.bis AS target, g.timestamp + {AHEAD} AS target_ts, h.start
        FROM grid g JOIN (SELECT caseid, timestamp, lag(timestamp, {LENGTH - 1}) OVER (PARTITION BY caseid ORDER BY timestamp) AS old, min(timestamp) OVER (PARTITION BY caseid) AS start FROM grid) h USING (caseid, timestamp)
        LEFT JOIN grid n ON n.caseid = g.caseid AND n.timestamp = g.timestamp + {AHEAD})""",
    "win": f"win AS (SELECT caseid AS case_id, timestamp - {(LENGTH - 1) * DAY} AS first_ts, timestamp AS final_ts, target_ts, target AS y, bis AS last_bis, aux AS last_aux FROM ends WHERE has_history AND target IS NOT NULL)",
    "pred": "pred AS (SELECT case_id, final_ts, target_ts, y AS observed, last_bis AS predicted FROM win)",
    "numbered": f"numbered AS (SELECT caseid, row_number() OVER (ORDER BY {DRAW.format("'42:' || caseid")}, caseid) AS nth FROM (SELECT DISTINCT caseid FROM grid))",
    # sizes of a 0.70 / 0.15 / 0.15 split by largest remainder, first the largest
    "share": """share AS (SELECT a + CASE WHEN ra >= rb AND more > 0 OR more > 1 THEN 1 ELSE 0 END AS a, b + CASE WHEN ra < rb AND more > 0 OR more > 1 THEN 1 ELSE 0 END AS b FROM (
        SELECT floor(0.7 * n) AS a, floor(0.15 * n) AS b, 0.7 * n - floor(0.7 * n) AS ra, 0.15 * n - floor(0.15 * n) AS rb, n - floor(0.7 * n) - 2 * floor(0.15 * n) AS more FROM (SELECT count(DISTINCT caseid) AS n FROM grid)))""",
    "splitted": "splitted AS (SELECT caseid, CASE WHEN nth <= a THEN 'train' WHEN nth <= a + b THEN 'val' ELSE 'test' END AS split FROM numbered, share)",
    "cells": "cells AS (SELECT o_orderpriority AS condition, o_orderstatus AS model, year(o_orderdate) AS seed, o_custkey % 40 AS caseid, avg(o_totalprice / 1000) AS mae, count(*) AS windows FROM orders GROUP BY 1, 2, 3, 4)",
    "runt": "runt AS (SELECT condition, model, seed, avg(mae) AS case_mae, count(*) AS cases, sum(windows) AS windows FROM cells GROUP BY 1, 2, 3)",
    "wts": """wts AS (SELECT label AS run, vec_id AS sample, vec_id % 20 AS caseid, i AS feature, abs(embedding[i]) / s AS weight, true AS observed FROM (
        SELECT label, vec_id, embedding, unnest(range(1, len(embedding) + 1)) AS i, list_sum(list_transform(embedding, lambda x: abs(CAST(x AS DOUBLE)))) AS s FROM embeddings))""",
}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def sig(spark: SparkSession, d: str) -> DataFrame:
    e = table(spark, d, "events")
    return e.groupBy(F.col("user_id").alias("caseid"), F.expr("timestampdiff(SECOND, timestamp_ntz'1970-01-01 00:00:00', ts)").alias("time_sec")).agg(F.max("value").alias("bis"), F.max(F.get_json_object("props", "$.k").cast("double")).alias("aux"), F.max("event_type").alias("kind"))


def holes(spark: SparkSession, d: str) -> DataFrame:
    s = sig(spark, d)
    return s.select("caseid", "time_sec", "kind", F.when(F.col("aux").cast("int") % 4 != 0, F.col("bis")).alias("bis"), F.when(F.col("aux").cast("int") % 5 != 0, F.col("aux")).alias("aux"))


def grid(spark: SparkSession, d: str) -> DataFrame:
    return resample.resample(sig(spark, d), {"bis": "median", "aux": "last"}, DAY)


def marked(spark: SparkSession, d: str) -> DataFrame:
    return windows.endpoints(grid(spark, d), "bis", LENGTH, DAY, AHEAD)


def wins(spark: SparkSession, d: str) -> DataFrame:
    return windows.windows(grid(spark, d), ["bis", "aux"], "bis", length=LENGTH, interval=DAY, horizon=AHEAD)


def pred(spark: SparkSession, d: str) -> DataFrame:
    return plans.persistence(grid(spark, d), "bis", LENGTH, DAY, AHEAD)


def cells(spark: SparkSession, d: str) -> DataFrame:
    o = table(spark, d, "orders").select(F.col("o_orderpriority").alias("condition"), F.col("o_orderstatus").alias("model"), F.year("o_orderdate").alias("seed"), (F.col("o_custkey") % 40).alias("caseid"), "o_totalprice")
    return runs.case_errors(o, ["condition", "model", "seed"], "caseid", F.col("o_totalprice") / 1000)


def runt(spark: SparkSession, d: str) -> DataFrame:
    return runs.run_means(cells(spark, d), ["condition", "model", "seed"])


def wts(spark: SparkSession, d: str) -> DataFrame:
    e = table(spark, d, "embeddings").select(F.col("label").alias("run"), F.col("vec_id").alias("sample"), (F.col("vec_id") % 20).alias("caseid"), F.transform("embedding", lambda x: F.abs(x.cast("double"))).alias("w"))
    total = F.aggregate("w", F.lit(0.0), lambda a, x: a + x)
    return e.select("run", "sample", "caseid", total.alias("s"), F.posexplode("w").alias("i", "w")).select("run", "sample", "caseid", (F.col("i") + 1).cast("long").alias("feature"), (F.col("w") / F.col("s")).alias("weight"), F.lit(True).alias("observed"))


def rounded(df: DataFrame, digits: int = 6) -> DataFrame:
    return df.select(*(F.round(f.name, digits).alias(f.name) if f.dataType.typeName() == "double" else F.col(f.name) for f in df.schema.fields))


def R(*names: str, digits: int = 6) -> str:
    return ", ".join(f"round({n.rsplit(' AS ', 1)[0]}, {digits}) AS {n.rsplit(' AS ', 1)[-1]}" for n in names)


# sources

@query("SELECT caseid, time_sec, bis FROM sig")
def s1_read_signals(spark, d):
    return src.signals_contract(sig(spark, d)).select("caseid", "time_sec", "bis")


@query("SELECT c_custkey AS caseid, c_acctbal AS rate, CAST(NULL AS DOUBLE) AS ce FROM customer")
def s2_alias_fallback(spark, d):
    return src.with_aliases(table(spark, d, "customer"), {"caseid": "case_id", "rate": "PUMP_RATE", "ce": "PUMP_CE"}, {"caseid": "c_custkey", "rate": "c_acctbal", "ce": "ce"}, ("ce",))


@query("SELECT caseid, time_sec, max(bis) FILTER (WHERE kind = 'click') AS click, max(bis) FILTER (WHERE kind = 'error') AS error, max(bis) FILTER (WHERE kind = 'view') AS view FROM sig WHERE kind IN ('click', 'error', 'view') GROUP BY 1, 2")
def s3_tracks_to_wide(spark, d):
    return src.tracks_to_wide(sig(spark, d).where(F.col("kind").isin("click", "error", "view")), ["click", "error", "view"], track="kind", value="bis")


@query("SELECT c_custkey, c_nationkey, c_acctbal FROM customer")
def s4_clinical(spark, d):
    return src.present_columns(table(spark, d, "customer"), ["c_custkey", "age", "c_nationkey", "c_acctbal"])


@query("SELECT c_custkey AS caseid, c_acctbal AS weight, c_mktsegment AS sex FROM customer")
def s5_demographics(spark, d):
    return src.rename_by_alias(table(spark, d, "customer"), {"caseid": ["case", "C_CUSTKEY"], "weight": ["c_acctbal"], "sex": ["sex", "c_mktsegment"]})


@query("SELECT 'first' AS feature, (SELECT min(x) FROM (SELECT DISTINCT event_type || '/' || CAST(user_id % 7 AS VARCHAR) AS x FROM events) WHERE x IN ('nothing/0', 'view/3')) AS track UNION ALL SELECT 'second', (SELECT min(event_type || '/' || CAST(user_id % 7 AS VARCHAR)) FROM events WHERE lower(event_type || '/' || CAST(user_id % 7 AS VARCHAR)) LIKE '%purch%') UNION ALL SELECT 'third', NULL")
def s11_track_catalog(spark, d):
    names = table(spark, d, "events").select(F.concat_ws("/", "event_type", (F.col("user_id") % 7).cast("string")).alias("track"))
    wanted = spark.createDataFrame([("first", "nothing/0", 0, "zzz"), ("first", "view/3", 1, "zzz"), ("second", "absent/1", 0, "PURCH"), ("third", "absent/2", 0, "zzz")], "feature string, candidate string, rank int, search string")
    return src.pick_tracks(src.track_catalog(names), wanted)


# cleaning

@query("SELECT caseid, time_sec, coalesce(aux, bis) AS hr FROM holes")
def p1_first_available(spark, d):
    return clean.first_available(holes(spark, d), {"hr": ["HR1", "aux", "bis"]}).select("caseid", "time_sec", "hr")


@query("SELECT caseid, time_sec, last_value(aux IGNORE NULLS) OVER w AS aux FROM holes WINDOW w AS (PARTITION BY caseid ORDER BY time_sec ROWS BETWEEN 10 PRECEDING AND CURRENT ROW)")
def p2_bounded_fill(spark, d):
    return clean.bounded_fill(holes(spark, d), ["aux"]).select("caseid", "time_sec", "aux")


@query("SELECT caseid, time_sec, bis, aux FROM holes WHERE bis BETWEEN 10 AND 100 AND (aux IS NULL OR aux >= 50)")
def p3_quality_filter(spark, d):
    return clean.quality_filter(holes(spark, d), "bis", "aux").select("caseid", "time_sec", "bis", "aux")


@query("SELECT caseid, time_sec, bis FROM (SELECT *, min(CASE WHEN aux > 60 THEN time_sec END) OVER (PARTITION BY caseid) AS a, max(CASE WHEN aux > 60 THEN time_sec END) OVER (PARTITION BY caseid) AS b FROM holes) WHERE time_sec BETWEEN a AND b")
def p4_crop_active(spark, d):
    return clean.crop_active(holes(spark, d), F.col("aux") > 60).select("caseid", "time_sec", "bis")


@query("SELECT caseid, time_sec FROM sig WHERE caseid IN (SELECT caseid FROM sig GROUP BY 1 HAVING count(*) >= 70)")
def p5_minimum_length(spark, d):
    return clean.minimum_length(sig(spark, d), 70).select("caseid", "time_sec")


@query("SELECT c_custkey, CASE WHEN c_nationkey % 3 = 0 THEN 1 WHEN c_nationkey % 3 = 1 THEN 0 END AS sex_male FROM customer")
def p6_sex_encoding(spark, d):
    text = F.element_at(F.array(F.lit(" M "), F.lit("female"), F.lit("?")), F.col("c_nationkey") % 3 + 1)
    return table(spark, d, "customer").select("c_custkey", clean.encode_sex(text).alias("sex_male"))


@query("SELECT caseid, time_sec, CAST(bis > 60 AS INT) AS inadequate, CASE WHEN bis <= 40 THEN 'deep' WHEN bis <= 60 THEN 'adequate' ELSE 'light' END AS zone FROM sig")
def p7_labels_and_zones(spark, d):
    return sig(spark, d).select("caseid", "time_sec", (F.col("bis") > 60).cast("int").alias("inadequate"), zone(F.col("bis")).alias("zone"))


@query(f"SELECT count(bis) AS n, {R('avg(bis) AS mean', 'stddev_samp(bis) AS std')}, min(bis) AS low, {R('quantile_cont(bis, 0.25) AS q25', 'quantile_cont(bis, 0.5) AS q50', 'quantile_cont(bis, 0.75) AS q75')}, max(bis) AS high, round(avg(CASE WHEN bis > 60 THEN 1.0 WHEN bis IS NOT NULL THEN 0.0 END), 6) AS label_share FROM holes")
def p8_value_report(spark, d):
    return rounded(clean.value_report(holes(spark, d), "bis", F.col("bis") > 60))


@query("SELECT label, value, count(*) AS rows, round(CASE WHEN value IS NOT NULL THEN count(*) / sum(CASE WHEN value IS NOT NULL THEN count(*) END) OVER (PARTITION BY label) END, 6) AS share FROM (SELECT 'inadequate' AS label, CAST(bis > 60 AS VARCHAR) AS value FROM holes UNION ALL SELECT 'zone', CASE WHEN bis <= 40 THEN 'deep' WHEN bis <= 60 THEN 'adequate' WHEN bis IS NOT NULL THEN 'light' END FROM holes) GROUP BY 1, 2")
def p8_label_distribution(spark, d):
    return rounded(clean.label_distribution(holes(spark, d), {"inadequate": F.col("bis") > 60, "zone": zone(F.col("bis"))}))


@query("SELECT 'bis' AS feature, round(avg(CASE WHEN bis IS NULL THEN 1.0 ELSE 0.0 END), 6) AS missing FROM holes UNION ALL SELECT 'aux', round(avg(CASE WHEN aux IS NULL THEN 1.0 ELSE 0.0 END), 6) FROM holes")
def p8_missing_summary(spark, d):
    """The two of the four columns with most nulls."""
    return rounded(clean.missing_summary(holes(spark, d).select("bis", "aux", "caseid", "time_sec"), 2))


@query("SELECT caseid, 'bis' AS feature, round(avg(CASE WHEN bis IS NULL THEN 1.0 ELSE 0.0 END), 6) AS missing FROM holes GROUP BY 1 UNION ALL SELECT caseid, 'aux', round(avg(CASE WHEN aux IS NULL THEN 1.0 ELSE 0.0 END), 6) FROM holes GROUP BY 1")
def p9_exploration_missing(spark, d):
    return rounded(clean.missing_rates(holes(spark, d), ["bis", "aux"], ["caseid"]))


SPECS = [features.Feature("bis", "bis", required=True, unit="index", eligible=True), features.Feature("aux", "aux", how="last"), features.Feature("gone", "gone"), features.Feature("delta", "bis_delta", derived=True, window=10, eligible=True)]


@query("SELECT 0 AS place, 'bis' AS feature, true AS included, '' AS reason UNION ALL SELECT 1, 'aux', (SELECT count(aux) > 0 FROM holes), '' UNION ALL SELECT 2, 'gone', false, 'column absent' UNION ALL SELECT 3, 'delta', true, ''")
def p10_feature_resolution(spark, d):
    return features.require_profile(features.resolve(holes(spark, d), SPECS), ["bis", "aux", "delta"], refused=("gone",), version=2, found_version=2)


@query("SELECT feature, source, 'dynamic' AS kind, how, missing_pct, included, reason, unit, CAST(w AS INTEGER) AS window_seconds, eligible FROM (SELECT 'bis' AS feature, 'bis' AS source, 'median' AS how, round(100 * avg(CASE WHEN bis IS NULL THEN 1.0 ELSE 0.0 END), 6) AS missing_pct, true AS included, '' AS reason, 'index' AS unit, NULL AS w, true AS eligible FROM holes UNION ALL SELECT 'aux', 'aux', 'last', round(100 * avg(CASE WHEN aux IS NULL THEN 1.0 ELSE 0.0 END), 6), true, '', '', NULL, false FROM holes UNION ALL SELECT 'gone', 'gone', 'median', 100, false, 'column absent', '', NULL, false UNION ALL SELECT 'delta', 'bis_delta', 'median', 100, true, '', '', 10, true)")
def p11_feature_manifest(spark, d):
    return rounded(features.manifest(holes(spark, d), SPECS))


# time series

@query(f"SELECT caseid, timestamp, {R('bis')}, aux FROM grid")
def t1_resample(spark, d):
    return rounded(grid(spark, d))


@query(f"SELECT caseid, timestamp, CASE WHEN timestamp - lag(timestamp) OVER w = {DAY} THEN round(bis - lag(bis) OVER w, 6) END AS delta, CASE WHEN timestamp - lag(timestamp) OVER w = {DAY} THEN round((bis - lag(bis) OVER w) / {DAY} * 1000, 6) END AS slope FROM grid WINDOW w AS (PARTITION BY caseid ORDER BY timestamp)")
def t2_guarded_delta(spark, d):
    delta = resample.guarded_delta("bis", DAY)
    return rounded(grid(spark, d).select("caseid", "timestamp", delta.alias("delta"), (delta / DAY * 1000).alias("slope")))


@query(f"SELECT caseid, timestamp, {R('bis - 50 AS offset_50', 'aux * 20 / 60 AS rate')} FROM grid")
def t3_t4_offset_and_rate(spark, d):
    return rounded(grid(spark, d).select("caseid", "timestamp", (F.col("bis") - 50).alias("offset_50"), resample.pump_rate(F.col("aux")).alias("rate")))


DOSE = """dose AS (SELECT caseid, time_sec, aux, prev, coalesce(aux < prev - 0.000001, false) AS reset, CASE WHEN aux IS NOT NULL THEN sum(CASE WHEN aux IS NULL OR prev IS NULL THEN 0 WHEN aux < prev - 0.000001 THEN aux ELSE greatest(aux - prev, 0) END) OVER (PARTITION BY caseid ORDER BY time_sec) * 20 END AS cumulative
  FROM (SELECT *, last_value(aux IGNORE NULLS) OVER (PARTITION BY caseid ORDER BY time_sec ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS prev FROM holes))"""
CTE["dose"] = DOSE


@query(f"SELECT caseid, time_sec, reset, {R('cumulative')} FROM dose")
def t5_cumulative_dose(spark, d):
    return rounded(resample.cumulative_dose(holes(spark, d), "aux", 20, time="time_sec").select("caseid", "time_sec", "reset", "cumulative"))


@query(f"""SELECT g.caseid, g.timestamp, round(g.c - CASE WHEN g.timestamp - {AHEAD} <= s.start THEN s.c ELSE p.c END, 6) AS recent FROM (SELECT caseid, timestamp, sum(aux) OVER (PARTITION BY caseid ORDER BY timestamp) AS c FROM grid) g
  JOIN (SELECT caseid, min(timestamp) AS start, min_by(aux, timestamp) AS c FROM grid GROUP BY 1) s USING (caseid) LEFT JOIN (SELECT caseid, timestamp, sum(aux) OVER (PARTITION BY caseid ORDER BY timestamp) AS c FROM grid) p ON p.caseid = g.caseid AND p.timestamp = g.timestamp - {AHEAD}""")
def t6_recent_dose(spark, d):
    g = grid(spark, d)
    run = F.sum("aux").over(resample.by_time().rowsBetween(Window.unboundedPreceding, 0))
    return rounded(resample.recent_dose(g.withColumn("c", run), "c", AHEAD).select("caseid", "timestamp", "recent"))


@query(f"SELECT caseid, CAST(sum(CASE WHEN gap <> {DAY} THEN 1 ELSE 0 END) AS BIGINT) AS irregular_gaps FROM (SELECT caseid, timestamp - lag(timestamp) OVER (PARTITION BY caseid ORDER BY timestamp) AS gap FROM grid) GROUP BY 1")
def t7_gap_counts(spark, d):
    return resample.gap_counts(grid(spark, d), DAY, ["caseid"])


def demographics(spark, d):
    c = table(spark, d, "customer")
    return c.select(F.col("c_custkey").alias("caseid"), (25 + F.col("c_custkey") % 50).cast("double").alias("age"), (F.col("c_nationkey") % 2).alias("sex_male"), (150 + F.col("c_custkey") % 40).cast("double").alias("height"), (50 + F.col("c_custkey") % 45).cast("double").alias("weight"))


CTE["demo"] = "demo AS (SELECT c_custkey AS caseid, CAST(25 + c_custkey % 50 AS DOUBLE) AS age, c_nationkey % 2 AS sex_male, CAST(150 + c_custkey % 40 AS DOUBLE) AS height, CAST(50 + c_custkey % 45 AS DOUBLE) AS weight FROM customer)"
CTE["lean"] = "lean AS (SELECT *, CASE WHEN sex_male = 1 THEN 1.1 * weight - 128 * (weight / height) ^ 2 ELSE 1.07 * weight - 148 * (weight / height) ^ 2 END AS lean_mass FROM demo)"


@query(None)
def t8_concentrations(spark, d):
    """Checked against a plain restatement in the tests."""
    s = sig(spark, d).select("caseid", (F.floor(F.col("time_sec") / 3600) * 10).cast("long").alias("time_sec"), "aux").groupBy("caseid", "time_sec").agg((F.max("aux") / 10).alias("rate")).withColumn("volume", F.lit(0.0))
    return rounded(pk.concentrations(s, "rate", pk.propofol_parameters(demographics(spark, d)), ["volume"], hold=600))


@query(f"SELECT caseid, 'propofol' AS drug, {R('lean_mass', 'CAST(4.27 AS DOUBLE) AS v1', '18.9 - 0.391 * (age - 53) AS v2', 'CAST(238.0 AS DOUBLE) AS v3', '1.89 + 0.0456 * (weight - 77) - 0.0681 * (lean_mass - 59) + 0.0264 * (height - 177) AS cl1', '1.29 - 0.024 * (age - 53) AS cl2', 'CAST(0.836 AS DOUBLE) AS cl3', 'CAST(0.456 AS DOUBLE) AS ke0')} FROM lean UNION ALL SELECT caseid, 'remifentanil', {R('lean_mass', '5.1 - 0.0201 * (age - 40) + 0.072 * (lean_mass - 55) AS v1', '9.82 - 0.0811 * (age - 40) + 0.108 * (lean_mass - 55) AS v2', 'CAST(5.42 AS DOUBLE) AS v3', '2.6 - 0.0162 * (age - 40) + 0.0191 * (lean_mass - 55) AS cl1', '2.05 - 0.030 * (age - 40) AS cl2', '0.076 - 0.00113 * (age - 40) AS cl3', '0.595 - 0.007 * (age - 40) AS ke0')} FROM lean")
def t9_model_parameters(spark, d):
    people = demographics(spark, d)
    of = lambda df, drug: df.select("caseid", F.lit(drug).alias("drug"), "lean_mass", "v1", "v2", "v3", "cl1", "cl2", "cl3", "ke0")
    return rounded(of(pk.propofol_parameters(people), "propofol").unionByName(of(pk.remifentanil_parameters(people), "remifentanil")))


@query("SELECT caseid, time_sec, round(greatest(0, least(100, 98 * pow(1 + bis / 100 / 4.47 + aux / 10 / 19.3, -1.43))), 6) AS predicted FROM sig")
def t10_predicted_index(spark, d):
    return rounded(sig(spark, d).select("caseid", "time_sec", pk.predicted_index(F.col("bis") / 100, F.col("aux") / 10).alias("predicted")))


@query(f"SELECT caseid, count(bis - aux) AS pairs, {R('count(bis - aux) / count(aux) AS coverage', 'avg(abs(bis - aux)) AS mae', 'sqrt(avg((bis - aux) ^ 2)) AS rmse', 'avg(bis - aux) AS bias')}, CASE WHEN count(bis - aux) > 1 THEN round(corr(bis, aux), 6) END AS pearson FROM holes GROUP BY 1")
def t11_agreement(spark, d):
    return rounded(resample.agreement(holes(spark, d), "bis", "aux", ["caseid"]))


# windows

@query(f"SELECT case_id, first_ts, final_ts, target_ts, {R('y')}, CAST(y > 60 AS INT) AS y_high, CAST(y < 40 AS INT) AS y_low, CAST(s AS INT) AS step, round(g.bis, 6) AS x_bis, g.aux AS x_aux FROM win, range({LENGTH}) r(s) JOIN grid g ON g.caseid = case_id AND g.timestamp = first_ts + s * {DAY}")
def w1_w4_windows(spark, d):
    w = wins(spark, d)
    rows = w.select("case_id", "first_ts", "final_ts", "target_ts", "y", "y_high", "y_low", F.posexplode("x").alias("step", "r"))
    return rounded(rows.select("case_id", "first_ts", "final_ts", "target_ts", "y", "y_high", "y_low", "step", F.col("r")[0].alias("x_bis"), F.col("r")[1].alias("x_aux")))


@query("SELECT count(*) AS removed FROM ends WHERE has_history AND target IS NULL")
def w2_removed_windows(spark, d):
    return windows.removed_windows(marked(spark, d))


@query("SELECT DISTINCT caseid FROM ends WHERE has_history AND target IS NOT NULL")
def w3_eligible_cases(spark, d):
    return windows.eligible_cases(marked(spark, d))


CTE["aud"] = f"""aud AS (SELECT caseid, count(*) AS candidates, count(*) FILTER (WHERE has_history AND target IS NOT NULL) AS included, count(*) FILTER (WHERE NOT has_history) AS gap, count(*) FILTER (WHERE has_history AND target IS NULL) AS no_future,
  100 * (1 - count(*) FILTER (WHERE has_history AND target IS NOT NULL) / count(*)) AS excluded_pct FROM ends WHERE timestamp >= start + {(LENGTH - 1) * DAY} GROUP BY 1)"""


@query(f"SELECT caseid, candidates, included, gap, no_future, {R('excluded_pct')} FROM aud")
def w5_candidate_audit(spark, d):
    return rounded(windows.candidate_audit(marked(spark, d), LENGTH, DAY))


CTE["tripled"] = "tripled AS (SELECT caseid, included * CASE WHEN caseid % 37 = 5 THEN 3 ELSE 1 END AS included FROM aud)"


@query("SELECT caseid, included FROM tripled WHERE included > (SELECT quantile_cont(included, 0.75) + 1.5 * (quantile_cont(included, 0.75) - quantile_cont(included, 0.25)) FROM tripled) ORDER BY included DESC, caseid LIMIT 10")
def w5_outlier_counts(spark, d):
    """The same fence about the number of windows, with three times as many planted in some cases; not all of these pass."""
    audit = windows.candidate_audit(marked(spark, d), LENGTH, DAY)
    planted = audit.withColumn("included", F.col("included") * F.when(F.col("caseid") % 37 == 5, 3).otherwise(1))
    return windows.outlier_cases(planted, "included").select("caseid", "included")


@query("SELECT caseid, round(excluded_pct, 6) AS excluded_pct FROM aud WHERE excluded_pct > (SELECT quantile_cont(excluded_pct, 0.75) + 1.5 * (quantile_cont(excluded_pct, 0.75) - quantile_cont(excluded_pct, 0.25)) FROM aud) ORDER BY aud.excluded_pct DESC, caseid LIMIT 10")
def w5_outlier_cases(spark, d):
    return rounded(windows.outlier_cases(windows.candidate_audit(marked(spark, d), LENGTH, DAY)).select("caseid", "excluded_pct"))


@query(f"SELECT case_id, final_ts, CAST(f * {LENGTH} + s AS INT) AS place, round(CASE WHEN f = 0 THEN g.bis ELSE g.aux END, 6) AS value FROM win, range(2) q(f), range({LENGTH}) r(s) JOIN grid g ON g.caseid = case_id AND g.timestamp = first_ts + s * {DAY}")
def w6_lag_matrix(spark, d):
    flat = windows.flatten_lags(wins(spark, d), 2, LENGTH)
    return rounded(flat.select("case_id", "final_ts", F.posexplode("flat").alias("place", "value")))


@query(f"SELECT caseid, timestamp, round(coalesce(lag(bis, 5) OVER w, first_value(bis) OVER w), 6) AS oldest, least(6, row_number() OVER w) AS present FROM grid WINDOW w AS (PARTITION BY caseid ORDER BY timestamp)")
def w7_padded_history(spark, d):
    h = windows.padded_history(grid(spark, d), ["bis"], 6)
    return rounded(h.select("caseid", "timestamp", F.col("history")[0]["bis"].alias("oldest"), F.aggregate("present", F.lit(0).cast("long"), lambda a, x: a + x).alias("present")))


CTE["sess"] = f"sess AS (SELECT *, sum(brk) OVER (PARTITION BY caseid ORDER BY timestamp) AS session FROM (SELECT *, CASE WHEN timestamp - lag(timestamp) OVER w <> {DAY} THEN 1 ELSE 0 END AS brk, sum(aux) OVER w AS dose FROM grid WINDOW w AS (PARTITION BY caseid ORDER BY timestamp)))"


@query(f"SELECT caseid, timestamp, CAST(session AS BIGINT) AS session, CASE WHEN brk = 0 THEN round(coalesce(lag(bis, 5) OVER s, first_value(bis) OVER s), 6) END AS oldest, least(6, row_number() OVER s) AS present, {R('bis - coalesce(lag(bis) OVER s, bis) AS delta', 'dose - coalesce(lag(dose) OVER s, dose) AS dose_interval', 'dose - coalesce(lag(dose, 6) OVER s, first_value(dose) OVER s) AS dose_recent')} FROM sess WINDOW s AS (PARTITION BY caseid, session ORDER BY timestamp)")
def w7_session_history(spark, d):
    given = grid(spark, d).withColumn("dose", F.sum("aux").over(Window.partitionBy("caseid").orderBy("timestamp")))
    h = windows.session_history(given, "bis", {"dose": "dose"}, 6, DAY)
    return rounded(h.select("caseid", "timestamp", "session", F.col("history")[0].alias("oldest"), F.aggregate("present", F.lit(0).cast("long"), lambda a, x: a + x).alias("present"), "delta", "dose_interval", "dose_recent"))


CTE["stat"] = "stat AS (SELECT median(bis) AS fill, avg(coalesce(bis, (SELECT median(bis) FROM holes))) AS mean, stddev_pop(coalesce(bis, (SELECT median(bis) FROM holes))) AS scale FROM holes)"


@query("SELECT caseid, time_sec, round(coalesce(bis, fill), 6) AS bis FROM holes, stat")
def w8_inverse_scaling(spark, d):
    h = holes(spark, d)
    s = prep.fit_scaling(h, ["bis"])
    return rounded(prep.apply_scaling(h, s).select("caseid", "time_sec", prep.invert_scaling(F.col("bis"), s, "bis").alias("bis")))


@query(f"SELECT case_id, final_ts, CAST(s AS INT) AS step, g.aux AS aux FROM win, range({LENGTH}) r(s) JOIN grid g ON g.caseid = case_id AND g.timestamp = first_ts + s * {DAY}")
def s8_feature_subset(spark, d):
    w, _ = windows.select_features(wins(spark, d), ["bis", "aux"], exclude=["bis"])
    return w.select("case_id", "final_ts", F.posexplode("x").alias("step", "r")).select("case_id", "final_ts", "step", F.col("r")[0].alias("aux"))

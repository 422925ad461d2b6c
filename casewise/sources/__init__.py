"""Readers and writers with their contracts; Parquet, CSV and JSON by Spark's own sources."""

from __future__ import annotations

import json
import re

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from casewise.functions import nan_to_null
from casewise.operators.contracts import ContractError, require_columns, require_unique


def read_any(spark: SparkSession, path: str, schema: str | None = None) -> DataFrame:
    """A table by its ending: csv, json or parquet."""
    reader = spark.read.schema(schema) if schema else spark.read
    if path.rstrip("/").endswith(".csv"):
        return reader.option("header", True).csv(path) if schema else reader.options(header=True, inferSchema=True).csv(path)
    return reader.json(path) if path.rstrip("/").endswith(".json") else reader.parquet(path)


def signals_contract(df: DataFrame, value: str = "bis", case: str = "caseid", time: str = "time_sec") -> DataFrame:
    """Required columns, not empty, keys as longs and not null, no (case, time) twice. No sort: order lives in windows."""
    require_columns(df, [case, time, value])
    out = nan_to_null(df).withColumns({case: F.col(case).cast("long"), time: F.col(time).cast("long")})
    seen = out.agg(F.count("*").alias("n"), F.count(F.when(F.col(case).isNull() | F.col(time).isNull(), 1)).alias("bad")).first()
    if not seen.n or seen.bad:
        raise ContractError("no rows" if not seen.n else f"{seen.bad} rows without a key")
    return require_unique(out, [case, time])


def read_signals(spark: SparkSession, path: str, value: str = "bis") -> DataFrame:
    return signals_contract(read_any(spark, path), value)


def with_aliases(df: DataFrame, first: dict[str, str], second: dict[str, str], optional: tuple[str, ...] = ()) -> DataFrame:
    """Columns under their own names, from the first naming if df has all of it, else from the second; absent optional ones are null."""
    for names in (first, second):
        if all(s in df.columns for t, s in names.items() if t not in optional):
            return df.select(*((F.col(s) if s in df.columns else F.lit(None).cast("double")).alias(t) for t, s in names.items()))
    raise ContractError(f"neither {sorted(first.values())} nor {sorted(second.values())}")


def rename_by_alias(df: DataFrame, aliases: dict[str, list[str]]) -> DataFrame:
    """Each target column from the first of its aliases that df has."""
    by_lower = {c.lower(): c for c in df.columns}
    found = {t: next((by_lower[a.lower()] for a in names if a.lower() in by_lower), None) for t, names in aliases.items()}
    if missing := [t for t, s in found.items() if s is None]:
        raise ContractError(f"no column for {missing}")
    return df.select(*(F.col(s).alias(t) for t, s in found.items()))


def present_columns(df: DataFrame, wanted: list[str]) -> DataFrame:
    return df.select([c for c in wanted if c in df.columns])


def tracks_to_wide(long: DataFrame, tracks: list[str], case: str = "caseid", time: str = "time_sec", track: str = "track", value: str = "value") -> DataFrame:
    """One column for each track on the case's time grid; of several values at a time the largest."""
    return long.groupBy(case, time).pivot(track, tracks).agg(F.max(value))


def track_catalog(names: DataFrame, column: str = "track") -> DataFrame:
    """Distinct names that hold a slash."""
    return names.where(F.col(column).contains("/")).select(column).distinct()


def search_tracks(catalog: DataFrame, text: str, column: str = "track") -> DataFrame:
    return catalog.where(F.lower(column).contains(text.lower()))


def pick_tracks(catalog: DataFrame, candidates: DataFrame, column: str = "track") -> DataFrame:
    """feature and the first of its candidates in the catalog, else the first name that contains its search word.

    candidates: feature, candidate, rank, search; one row for each candidate.
    """
    exact = candidates.join(catalog, candidates["candidate"] == catalog[column]).groupBy("feature").agg(F.min_by("candidate", "rank").alias("_exact"))
    words = candidates.select("feature", "search").distinct()
    hit = words.join(catalog, F.lower(column).contains(F.lower("search"))).groupBy("feature").agg(F.min(column).alias("_hit"))
    return words.select("feature").join(exact, "feature", "left").join(hit, "feature", "left").select("feature", F.coalesce("_exact", "_hit").alias("track"))


def write_windows(df: DataFrame, path: str, split: str = "split") -> None:
    df.write.partitionBy(split).parquet(path)


def read_windows(spark: SparkSession, path: str, split: str | None = None) -> DataFrame:
    df = spark.read.parquet(path)
    return df.where(F.col("split") == split) if split else df


def write_report(df: DataFrame, path: str) -> None:
    df.write.json(path)


def run_tables(spark: SparkSession, glob: str, pattern: str, required: list[str], key: list[str]) -> DataFrame:
    """Tables of many runs as one, with the named groups of `pattern` taken from each file's path; no key twice, values finite."""
    df = spark.read.parquet(glob)
    names = list(re.compile(pattern).groupindex)
    java = re.sub(r"\(\?P<", "(?<", pattern)
    path = F.col("_metadata.file_path")
    out = df.select("*", *(F.regexp_extract(path, java, k + 1).alias(n) for k, n in enumerate(names)))
    require_columns(out, required)
    bad: Column = F.lit(False)
    for c in ("observed", "predicted"):
        if c in out.columns:
            bad = bad | F.col(c).isNull() | F.isnan(c) | (F.abs(c) == float("inf"))
    if out.where(bad).limit(1).count():
        raise ContractError("values that are missing or not finite")
    return require_unique(out, [*names, *key])


def write_split(split: DataFrame, path: str, case: str = "caseid") -> None:
    """A folder of case ids for each split."""
    split.select(case, "split").write.partitionBy("split").parquet(path)


def read_split(spark: SparkSession, path: str, cases: DataFrame | None = None, needed: tuple[str, ...] = ("train", "val", "test"), case: str = "caseid") -> DataFrame:
    """(case, split): no case twice, no split empty. cases: only these are kept, and each of them must have a split."""
    out = require_unique(spark.read.parquet(path).select(F.col(case).cast("long").alias(case), "split"), [case])
    if cases is not None:
        wanted = cases.select(F.col(case).cast("long").alias(case)).distinct()
        if uncovered := wanted.join(out, case, "left_anti").count():
            raise ContractError(f"{uncovered} cases are in no split")
        out = out.join(wanted, case, "left_semi")
    found = {r[0] for r in out.select("split").distinct().collect()}  # a few names
    if missing := sorted(set(needed) - found):
        raise ContractError(f"no cases in {missing}")
    return out


def write_dataset_report(path: str, metadata: dict, statistics: DataFrame, manifest: DataFrame) -> None:
    """Small tables beside a data set: metadata.json, statistics.json and manifest.json under path."""
    spark = statistics.sparkSession
    spark.createDataFrame([(json.dumps(metadata, sort_keys=True),)], "metadata string").write.json(f"{path}/metadata.json")
    write_report(statistics, f"{path}/statistics.json")
    write_report(manifest, f"{path}/manifest.json")


def read_dataset_report(spark: SparkSession, path: str) -> tuple[dict, DataFrame, DataFrame]:
    """metadata, statistics and manifest."""
    metadata = json.loads(spark.read.schema("metadata string").json(f"{path}/metadata.json").first()[0])
    return metadata, spark.read.json(f"{path}/statistics.json"), spark.read.json(f"{path}/manifest.json")


def split_lists(spark: SparkSession, paths: dict[str, str], case: str = "caseid") -> DataFrame:
    """(case, split) from one list for each split."""
    out = None
    for name, path in paths.items():
        one = read_any(spark, path).select(F.col(case).cast("long").alias(case), F.lit(name).alias("split"))
        out = one if out is None else out.unionByName(one)
    return require_unique(out, [case])


def keyed(df: DataFrame, pattern: str) -> DataFrame:
    """df, read from files, with the named groups of `pattern` taken from each row's path."""
    java = re.sub(r"\(\?P<", "(?<", pattern)
    return df.select("*", *(F.regexp_extract(F.col("_metadata.file_path"), java, k + 1).alias(n) for k, n in enumerate(re.compile(pattern).groupindex)))


def run_files(spark: SparkSession, glob: str, pattern: str, schema: str, required: list[str]) -> tuple[DataFrame, DataFrame]:
    """One nested JSON object for each file: (rows that hold all `required` fields, rejects).

    Run keys are the named groups of `pattern` in the path. rejects: path, run keys and reason, for files that are no
    JSON object of the schema and for those that lack a field. A reject is a row, so that one bad file stops nothing.
    """
    read = spark.read.schema(f"{schema}, _broken string").options(multiLine=True, mode="PERMISSIVE", columnNameOfCorruptRecord="_broken").json(glob)
    rows = keyed(read.withColumn("_path", F.col("_metadata.file_path")), pattern)
    lacking = F.array_compact(F.array(*(F.when(F.col(c).isNull(), c) for c in required)))
    reason = F.when(F.col("_broken").isNotNull(), "unreadable").when(F.size(lacking) > 0, F.concat(F.lit("lacks "), F.array_join(lacking, ", ")))
    marked = rows.withColumn("_reason", reason)
    names = list(re.compile(pattern).groupindex)
    good = marked.where("_reason is null").drop("_broken", "_path", "_reason")
    return good, marked.where("_reason is not null").select(F.col("_path").alias("path"), *names, F.col("_reason").alias("reason"))


def load_cases(spark: SparkSession, glob: str, pattern: str, tracks: list[str], time: str = "time_sec", case: str = "caseid") -> tuple[DataFrame, DataFrame]:
    """CSV files with a time and a column for each track, one for each case: (case, time and tracks of all that load, rejects).

    A case fails as a whole if a row of its file does not parse, has no time, or a time occurs twice; rejects tell why and
    how many rows. ContractError if no case loads.
    """
    schema = f"{time} long, " + ", ".join(f"`{t}` double" for t in tracks) + ", _broken string"
    read = spark.read.schema(schema).options(header=True, mode="PERMISSIVE", columnNameOfCorruptRecord="_broken", enforceSchema=True).csv(glob)
    rows = keyed(read, pattern).withColumn(case, F.col(case).cast("long"))
    repeated = rows.where(F.col(time).isNotNull()).groupBy(case, time).agg((F.count("*") - 1).alias("_more")).groupBy(case).agg(F.sum("_more").alias("_repeated"))
    faults = rows.groupBy(case).agg(F.count("*").alias("rows"), F.count(F.when(F.col("_broken").isNotNull(), 1)).alias("_unparsed"), F.count(F.when(F.col("_broken").isNull() & F.col(time).isNull(), 1)).alias("_untimed")).join(repeated, case, "left")
    reason = F.when(F.col("_unparsed") > 0, "rows that do not parse").when(F.col("_untimed") > 0, "rows without a time").when(F.col("_repeated") > 0, "times that occur twice")
    rejects = faults.select(case, "rows", reason.alias("reason")).where("reason is not null")
    good = rows.join(rejects, case, "left_anti").select(case, time, *tracks)
    if not good.limit(1).count():
        raise ContractError("no case was loaded")
    return good, rejects

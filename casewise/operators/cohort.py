"""Cohort tables and provenance."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from casewise.operators.contracts import ContractError
from casewise.operators.order import quantiles


def dedupe_demographics(df: DataFrame, case: str = "caseid") -> DataFrame:
    """Equal rows become one; two different rows of a case are an error."""
    out = df.dropDuplicates()
    found = out.groupBy(case).count().where("count > 1").limit(3).collect()
    if found:
        raise ContractError(f"conflicting rows: {found}")
    return out


def conflicts(df: DataFrame, case: str = "caseid") -> DataFrame:
    return df.dropDuplicates().groupBy(case).agg(F.count("*").alias("versions")).where("versions > 1")


def missing_counts(df: DataFrame, by: list[str], fields: list[str]) -> DataFrame:
    return df.groupBy(*by).agg(F.count("*").alias("rows"), *(F.count(F.when(F.col(f).isNull(), 1)).alias(f"missing_{f}") for f in fields))


def uncovered(splits: DataFrame, demographics: DataFrame, case: str = "caseid") -> DataFrame:
    return splits.join(demographics, case, "left_anti")


def impute_from_train(df: DataFrame, train, numbers: list[str], categories: list[str], policy: str = "impute") -> DataFrame:
    """df with nulls filled from training rows (median; mode, a tie is an error) and `imputed`, the names of what was filled."""
    columns = [*numbers, *categories]
    if policy == "error":
        bad = df.where(" or ".join(f"`{c}` is null" for c in columns)).limit(3).collect()
        if bad:
            raise ContractError(f"missing values: {bad}")
        return df.withColumn("imputed", F.array().cast("array<string>"))
    rows = df.where(train)
    fill = {c: x[0] for c, x in quantiles(rows, numbers, [0.5]).items()} if numbers else {}
    for c in categories:
        top = rows.where(F.col(c).isNotNull()).groupBy(c).count().orderBy(F.desc("count"), c).limit(2).collect()
        if not top or len(top) > 1 and top[0]["count"] == top[1]["count"]:
            raise ContractError(f"no single most frequent value of {c}: {top}")
        fill[c] = top[0][c]
    names = F.array_compact(F.array(*(F.when(F.col(c).isNull(), c) for c in columns)))
    return df.withColumn("imputed", names).withColumns({c: F.coalesce(F.col(c), F.lit(fill[c])) for c in columns})


def row_text(df: DataFrame) -> Column:
    """A row's values as one text, by column name: each with its length before it, `-` for null, so that no two rows share one.

    Binary values are in hex, arrays, structs and maps in JSON.
    """
    parts = []
    for f in sorted(df.schema.fields, key=lambda f: f.name):
        c = F.col("`" + f.name.replace("`", "``") + "`")
        kind = f.dataType.typeName()
        text = F.hex(c) if kind == "binary" else F.when(c.isNotNull(), F.to_json(F.struct(c))) if kind in ("array", "struct", "map") else c.cast("string")
        parts.append(F.coalesce(F.concat(F.length(text).cast("string"), F.lit(":"), text), F.lit("-")))
    return F.concat(*parts) if parts else F.lit("")


def table_fingerprint(df: DataFrame) -> DataFrame:
    """rows, `columns` (the hash of the sorted names), and two sums over 60-bit hashes of rows, whatever their order.

    `sum` tells how often a row occurs, which `xor` does not. Of an empty table xor is 0 and sum is "0".
    """
    h = F.conv(F.substring(F.md5(row_text(df)), 1, 15), 16, 10).cast("long")
    sums = [F.coalesce(F.bit_xor("h"), F.lit(0).cast("long")).alias("xor"), F.coalesce(F.sum(F.col("h").cast("decimal(38,0)")), F.lit(0)).cast("decimal(38,0)").cast("string").alias("sum")]
    return df.select(h.alias("h")).agg(F.count("*").alias("rows"), F.lit(canonical_hash(sorted(df.columns))).alias("columns"), *sums)


def file_fingerprints(spark, path: str) -> DataFrame:
    """path, length and SHA-256 of each file."""
    return spark.read.format("binaryFile").load(path).select("path", "length", F.sha2("content", 256).alias("sha256"))


def canonical_hash(value) -> str:
    """SHA-256 of a setting's JSON with sorted keys."""
    import hashlib
    import json

    return hashlib.sha256(json.dumps(value, sort_keys=True, separators=(",", ":")).encode()).hexdigest()


def sealed(df: DataFrame, split: str = "split", test: str = "test") -> DataFrame:
    """df, which must not hold rows of the test split."""
    if df.where(F.col(split) == test).limit(1).count():
        raise ContractError("rows of the sealed split in a selection input")
    return df


def seal_counts(df: DataFrame, split: str = "split", test: str = "test") -> DataFrame:
    return df.agg(F.count("*").alias("rows"), F.count(F.when(F.col(split) == test, 1)).alias("sealed_rows"))


def best_epoch_faults(history: DataFrame, recorded: DataFrame, run: list[str], epoch: str, metric: str, tolerance: float = 1e-5) -> DataFrame:
    """run, best_epoch and recorded_epoch, metric and recorded: runs whose record is not the first epoch of least error, or its error.

    recorded: run, and `epoch` and `metric` as stored. A run without a record, or the other way round, is a fault too.
    """
    best = history.groupBy(*run).agg(F.min(F.struct(F.col(metric).alias("m"), F.col(epoch).alias("e"))).alias("_b")).select(*run, F.col("_b.e").alias("best_epoch"), F.col("_b.m").alias("best"))
    both = best.join(recorded.select(*run, F.col(epoch).alias("recorded_epoch"), F.col(metric).alias("recorded")), run, "full_outer")
    near = F.abs(F.col("best") - F.col("recorded")) <= F.greatest(F.lit(tolerance), tolerance * F.greatest(F.abs("best"), F.abs("recorded")))
    return both.where(~F.coalesce((F.col("best_epoch") == F.col("recorded_epoch")) & near, F.lit(False)))


def case_list_faults(predictions: DataFrame, listed: DataFrame, run: list[str], case: str = "case_id") -> DataFrame:
    """run, case and fault: cases of a run's list without predictions, and predictions of cases that it does not list."""
    a, b = predictions.select(*run, case).distinct(), listed.select(*run, case).distinct()
    return b.join(a, [*run, case], "left_anti").withColumn("fault", F.lit("no predictions")).unionByName(a.join(b, [*run, case], "left_anti").withColumn("fault", F.lit("not listed")))


def stored_against_recomputed(stored: DataFrame, computed: DataFrame, keys: list[str], metrics: list[str], tolerance: float = 1e-12) -> DataFrame:
    """Per metric: keys in one table only, and values that differ by more than the tolerance or are null on one side only."""
    long = lambda df, name: df.select(*keys, *(F.col(m).cast("double").alias(m) for m in metrics)).unpivot(keys, metrics, "metric", name).withColumn(f"_{name}", F.lit(1))
    both = long(stored, "stored").join(long(computed, "computed"), [*keys, "metric"], "full_outer")
    a, b = F.col("stored"), F.col("computed")
    return both.groupBy("metric").agg(F.count(F.when(F.col("_stored").isNull() | F.col("_computed").isNull(), 1)).alias("unpaired"), F.count(F.when(F.col("_stored").isNotNull() & F.col("_computed").isNotNull() & ((a.isNull() != b.isNull()) | (F.abs(a - b) > tolerance)), 1)).alias("differ"))

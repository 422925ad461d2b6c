"""Small helpers that the operators of this subpackage share."""

from __future__ import annotations

import re
import tempfile
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: The white space `[\x20\x09-\x0D]`, which is also what bytes.split() and bytes.strip() take.
SPACES = " \t\n\x0b\x0c\r"

#: Edges that a task makes a star of at a time.
CHUNK = 500_000


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def checkpoint_folder(spark: SparkSession) -> str:
    """The folder spark.checkpoint.dir names; only where a local session has none (tests) a temporary one."""
    context = spark.sparkContext
    if not context.getCheckpointDir():
        folder = spark.conf.get("spark.checkpoint.dir", None)
        if not folder:
            if not re.fullmatch(r"local(\[[^\]]*\])?", context.master):
                raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
            folder = tempfile.mkdtemp(prefix="spark-checkpoint-", dir="/tmp")
        context.setCheckpointDir(folder)
    return context.getCheckpointDir()


def cut(df: DataFrame, rows: int | None = None, each: int = 20_000) -> DataFrame:
    """Write df to the shared checkpoint folder and go on from there, so that a lost executor costs a read.

    rows: about how many it has, if known; then small tables are not spread over more tasks than `each` calls for.
    """
    checkpoint_folder(df.sparkSession)
    return (df if rows is None else df.coalesce(min(partitions(df), rows // each + 1))).checkpoint()


def stored(df: DataFrame) -> DataFrame:
    """As cut(), as a compressed table: for texts."""
    path = f"{checkpoint_folder(df.sparkSession)}/table-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def unused(name: str, *frames: DataFrame) -> str:
    """name, with underscores before it until no column of the frames is called so (names are taken without case)."""
    taken = {c.lower() for df in frames for c in df.columns}
    while name.lower() in taken:
        name = "_" + name
    return name


def hot_join(left: DataFrame, right: DataFrame, keys: list[str], rows: str) -> DataFrame:
    """left with the columns of right (but `rows`) that have the same keys, null where there are none.

    right holds each key once and in `rows` how many rows of left have it. Keys of more than a thousandth of all rows,
    of which there are fewer than 1000, are met by broadcast; rows with these or with a null key are dealt evenly and
    meet nothing in the join of the others, so that no key is a task of its own. right is read more than once.
    """
    total = right.agg(F.sum(rows)).first()[0] or 0
    hot_rows = F.col(rows) > max(1000, total // 1000)
    more = [c for c in right.columns if c not in (*keys, rows)]
    hot = right.where(hot_rows).select(*keys, F.struct(*more).alias("_hot"))
    rest = right.where(~hot_rows).select(*(F.col(k).alias(f"_{n}") for n, k in enumerate(keys)), F.lit(0).cast("long").alias("_rest"), F.struct(*more).alias("_found"))
    met = left.join(F.broadcast(hot), keys, "left")
    done = F.col("_hot").isNotNull()
    for k in keys:
        done = done | F.col(k).isNull()
    met = met.withColumn("_salt", F.when(done, F.shiftleft(F.xxhash64(*left.columns), 1).bitwiseOR(F.lit(1))).otherwise(F.lit(0)))
    same = F.col("_salt") == F.col("_rest")
    for n, k in enumerate(keys):
        met = met.withColumn(f"_key{n}", F.when(~done, F.col(k)))
        same = same & (F.col(f"_key{n}") == F.col(f"_{n}"))
    both = met.join(rest, same, "left")
    return both.select(*(F.col(c) for c in left.columns), *(F.coalesce(F.col("_hot")[c], F.col("_found")[c]).alias(c) for c in more))


def partitions(df: DataFrame) -> int:
    return int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))


def held_out(doc_id: Column) -> Column:
    """True where crc32(doc_id as text) mod 5 is 0; such rows never train a model."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 5 == 0, F.lit(True))


def hash_limit(share: float) -> int:
    """About this share of all 64-bit hashes is at most the limit."""
    return min(2**63 - 1, int(share * 2**64) - 2**63)


def bounded(rows: DataFrame, count: int, most: int) -> DataFrame:
    """About `most` of a checkpointed table's `count` rows, all if they are no more; rows that are equal fall apart too."""
    if count <= most:
        return rows
    return rows.where(F.xxhash64(F.lit("row"), F.monotonically_increasing_id()) <= hash_limit(most / count))


def local_stars(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Edges (v, u) of a task, CHUNK at a time, as stars: each node of a chunk with the smallest it reaches there."""
    waiting: list[pa.RecordBatch] = []

    def star() -> pa.RecordBatch:
        v, u = (np.concatenate([b.column(k).to_numpy() for b in waiting]) for k in (0, 1))
        nodes, at = np.unique(np.concatenate([v, u]), return_inverse=True)
        one, other = at[: len(v)], at[len(v) :]
        name = np.arange(len(nodes))
        while True:
            new = name.copy()
            least = np.minimum(name[one], name[other])
            np.minimum.at(new, name[one], least)
            np.minimum.at(new, name[other], least)
            new = new[new]
            if (new == name).all():
                break
            name = new
        out = name != np.arange(len(nodes))
        return pa.RecordBatch.from_arrays([pa.array(nodes[out]), pa.array(nodes[name[out]])], ["v", "u"])

    rows = 0
    for batch in batches:
        waiting.append(batch)
        rows += batch.num_rows
        if rows >= CHUNK:
            yield star()
            waiting, rows = [], 0
    if rows:
        yield star()


def connected_components(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """(node, component) of longs: the smallest id that a node reaches; only nodes that have an edge.

    Each task makes stars of its own edges. Then two rewritings of the edges alternate until each component is a star.
    In the first each node ties its larger neighbours to the smallest id around it, in the second its smaller ones.
    Rounds grow with the logarithm of the component's size. Every join meets a checkpointed table on both sides, so
    that a hub's edges can be split over tasks.
    """
    first, second = F.col(a).cast("long"), F.col(b).cast("long")
    tied = cut(edges.where(first != second).select(F.greatest(first, second).alias("v"), F.least(first, second).alias("u")))
    rows = tied.count()

    def stars(df: DataFrame) -> DataFrame:
        return cut(df.coalesce(min(partitions(df), rows // 20_000 + 1)).mapInArrow(local_stars, "v long, u long"))

    tied = stars(tied)
    while True:
        sides = tied.select(F.col("v").alias("node"), "u", F.lit(1).alias("side")).unionByName(tied.select(F.col("u").alias("node"), F.lit(None).cast("long").alias("u"), F.lit(2).alias("side")))
        # in a star a leaf has one edge, upwards, and the centre has none upwards
        kinds = sides.groupBy("node").agg(F.bit_or("side").alias("sides"), F.min("u").alias("low"), F.max("u").alias("high"))
        if kinds.where("sides = 3 or low < high").isEmpty():
            break
        near = tied.unionByName(tied.select(F.col("u").alias("v"), F.col("v").alias("u")))
        least = cut(near.groupBy("v").agg(F.min("u").alias("m")).select("v", F.least("v", "m").alias("m")), rows)
        up = cut(near.join(least, "v").where("u > v").select(F.col("u").alias("v"), F.col("m").alias("u")).distinct(), rows)
        least = cut(up.groupBy("v").agg(F.min("u").alias("m")), rows)
        down = up.join(least, "v").where("u != m").select(F.col("u").alias("v"), F.col("m").alias("u"))
        tied = stars(down.unionByName(least.withColumnRenamed("m", "u")))
    return tied.select(F.col("v").alias("node"), F.col("u").alias("component")).unionByName(tied.select(F.col("u").alias("node"), F.col("u").alias("component"))).distinct()

"""Operator 2, sharding by histogram sort, in DataFrame operations only.

A row's key is a long: its high 40 bits hash the text, so equal texts lie side by side, its low 23 bits hash the
document. The rows of one text stay in one shard unless they are more than GROUP of a shard's bytes; a text with more
copies than that can still be cut. Rounds of exact byte counts between probes refine
a histogram of the key where a splitter is not yet within the tolerance, or where an interval holds too many rows.
Then every row goes once to its interval, gets its place there, and with it shard and slot.

A null text has no bytes, so its size is 1; its digest is that of the empty text. Rows without a doc_id and repeated
rows are rows of their own; equal rows take slots side by side in any order.
An empty table gives no rows. Columns to carry along are named by the caller; all others are left behind.
"""

from __future__ import annotations

from bisect import bisect_left
from itertools import groupby

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from casewise.llm.common import cut

KEY_BITS, TEXT_BITS = 63, 40
#: Bits of the first histogram and of each refinement: 4096 and 64 probes.
FIRST_BITS, MORE_BITS = 12, 6
#: A splitter may be off by this part of a shard's bytes; an interval may hold this part of all rows.
TOLERANCE, INTERVAL_ROWS = 0.0005, 1 / 1024
#: Rows of one text that hold at most this part of a shard's bytes are not parted.
GROUP = 0.02


def key_of(text: Column, doc_id: Column) -> Column:
    low = KEY_BITS - TEXT_BITS
    high = F.shiftleft(F.shiftrightunsigned(F.xxhash64(text), 64 - TEXT_BITS), low)
    return high.bitwiseOR(F.shiftrightunsigned(F.xxhash64(F.lit("doc"), doc_id), 64 - low))


def histogram(keyed: DataFrame, shards: int, tolerance: float = TOLERANCE, interval_rows: float = INTERVAL_ROWS) -> list[tuple[int, int, int, int]]:
    """Intervals (low key, bits below it, bytes, rows) in key order; only non-empty ones.

    At most 4096 intervals are counted at first, and in each round at most 64 for every splitter or crowded interval,
    so what comes to the driver is bounded by the number of shards and 1 / interval_rows.
    """

    def count(rows: DataFrame, bits: int) -> dict[int, tuple[int, int]]:
        found = rows.groupBy(F.shiftright("_key", bits).alias("at")).agg(F.sum("_size"), F.count("*")).collect()
        return {r[0] << bits: (r[1], r[2]) for r in found}

    bits = KEY_BITS - FIRST_BITS
    leaves = {(low, bits): x for low, x in count(keyed, bits).items()}
    total, rows = sum(x[0] for x in leaves.values()), sum(x[1] for x in leaves.values())
    targets = [total * k / shards for k in range(1, shards)]
    slack = tolerance * total / shards
    while bits > 0:
        crowded, below = set(), 0
        for leaf in sorted(leaves):
            size, n = leaves[leaf]
            if leaf[1] == bits and n > 1:
                at = bisect_left(targets, below)
                inside = [t for t in targets[at : at + shards] if below < t < below + size]
                whole = bits <= KEY_BITS - TEXT_BITS and size <= GROUP * total / shards
                if n > max(64, rows * interval_rows) or not whole and any(min(t - below, below + size - t) > slack for t in inside):
                    crowded.add(leaf[0])
            below += size
        if not crowded:
            break
        next_bits = max(KEY_BITS - TEXT_BITS if bits > KEY_BITS - TEXT_BITS else 0, bits - MORE_BITS)
        probes = keyed.sparkSession.createDataFrame([(low >> bits,) for low in crowded], "_prefix long")
        part = keyed.withColumn("_prefix", F.shiftright("_key", bits)).join(F.broadcast(probes), "_prefix", "left_semi")
        for low in crowded:
            del leaves[low, bits]
        bits = next_bits
        leaves |= {(low, bits): x for low, x in count(part, bits).items()}
    return [(low, b, *leaves[low, b]) for low, b in sorted(leaves)]


def cut_points(leaves: list[tuple[int, int, int, int]], shards: int) -> list[int]:
    """The shard of each interval: each splitter lies at the interval border nearest to its target.

    Intervals of one text go together, unless they are too large.
    """
    total, below, out = sum(x[2] for x in leaves), 0, []
    for _, group in groupby(leaves, lambda leaf: leaf[0] >> (KEY_BITS - TEXT_BITS)):
        sizes = [size for _, _, size, _ in group]
        if sum(sizes) <= GROUP * total / shards:
            out += [min(shards - 1, int((below + sum(sizes) / 2) * shards / total))] * len(sizes)
            below += sum(sizes)
        else:
            for size in sizes:
                out.append(min(shards - 1, int((below + size / 2) * shards / total)))
                below += size
    return out


def shard_documents(docs: DataFrame, shards: int = 16, columns: dict[str, Column] | None = None, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, size, the given columns (the text unless given), shard and slot; shards near equal in bytes.

    Each row is exchanged once; the histogram is counted on keys and sizes alone.
    """
    columns = {"text": F.col(text)} if columns is None else columns
    body = F.coalesce(F.col(text), F.lit(""))
    keyed = cut(docs.select(F.col(doc_id).alias("doc_id"), (F.octet_length(body) + 1).cast("long").alias("_size"), key_of(body, F.col(doc_id)).alias("_key"), *(c.alias(k) for k, c in columns.items())))
    leaves = histogram(keyed.select("_key", "_size"), shards)
    place, table, first = cut_points(leaves, shards) if leaves else [], {}, [0] * shards
    for k, ((low, _, _, n), shard) in enumerate(zip(leaves, place, strict=True)):
        table.setdefault(low >> (KEY_BITS - FIRST_BITS), []).append((low, k, shard, first[shard]))
        first[shard] += n
    # one row for each of the 4096 first prefixes at most
    lookup = docs.sparkSession.createDataFrame(list(table.items()), "_prefix long, _leaves array<struct<low: long, leaf: int, shard: int, first: long>>")
    leaf = F.element_at(F.filter("_leaves", lambda x: x["low"] <= F.col("_key")), -1)
    found = keyed.withColumn("_prefix", F.shiftright("_key", KEY_BITS - FIRST_BITS)).join(F.broadcast(lookup), "_prefix").withColumn("_leaf", leaf)
    rank = F.row_number().over(Window.partitionBy("_leaf.leaf").orderBy("_key", "doc_id", "_size"))
    return found.select("doc_id", F.col("_size").alias("size"), *columns, F.col("_leaf.shard").alias("shard"), (F.col("_leaf.first") + rank - 1).alias("slot"))


def write_shards(sharded: DataFrame, path: str) -> None:
    """One folder for each shard, rows in slot order inside its files."""
    sharded.repartition("shard", (F.col("slot") / 100_000).cast("long")).sortWithinPartitions("shard", "slot").write.partitionBy("shard").parquet(path)

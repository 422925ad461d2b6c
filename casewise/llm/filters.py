"""Operator 13, filter interaction audit: what each filter of a set removes, in every order, and its Shapley count.

Five filters fail a text: A under 200 words, B few distinct words, C many capitals, D certain signs, E a text that a
smaller doc_id has. All but E look at one text. For E the texts meet in radix tries:

* prefixes are adaptive: FIRST bytes, and where all texts with a prefix weigh over LIGHT of a task's share, four times
  as many, round after round, for those prefixes alone. Each round counts weights by the prefix's hash; what comes to
  the driver is bounded by LIGHT times the number of tasks;
* a heavy prefix that one text alone has cannot be parted by its text. Its rows are dealt by a salt, with the least
  doc_id that the count has found for it;
* rows go by ranges of the prefix, once. A task inserts its texts, whole, into a compressed trie whose terminals hold the
  least doc_id, then goes through its rows again: a row whose doc_id is greater than its terminal's is a duplicate.

A task's memory is its range's texts, about RANGE bytes; the number of ranges grows with the table. What leaves a task is
doc_id, part and a mask of failed filters; masks are counted by part, and the 120 orders are worked out from at most 32
counts of a part.

A null or empty text is empty; both are the same text. A null part is the empty string. A row with a null doc_id is
neither a duplicate nor makes one; among equal doc_ids none is smaller. Labels of repeated rows count once (any 1), those without a doc_id never. Very
long texts are taken whole. Other columns are left behind, whatever their names. An empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import permutations

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from casewise.llm.common import cut, partitions

FILTERS = "ABCDE"
MIN_WORDS, MIN_DISTINCT, MAX_CAPITALS = 200, 50, 2
#: The signs of filter D and the letters of filter C.
SIGNS, CAPITALS = b"#$%&*|", b"ABCDEFGHIJKLMNOPQRSTUVWXYZ"
#: Bytes of the first prefixes; a prefix is heavy over this part of a task's share; a row weighs so many bytes besides its text.
FIRST, LIGHT, ROW = 64, 4, 200
#: Bytes of text that a task's trie may hold.
RANGE = 48_000_000


class Trie:
    """A compressed radix trie over bytes. A node is [label, children by first byte, least id of the texts that end here]."""

    def __init__(self):
        self.root: list = [b"", {}, None]

    def insert(self, text: bytes, least) -> list:
        """The terminal node of the text, with the least id of all that were inserted; None is no id."""
        node, at = self.root, 0
        while at < len(text):
            child = node[1].get(text[at])
            if child is None:
                child = node[1][text[at]] = [text[at:], {}, None]
                node, at = child, len(text)
                break
            label = child[0]
            if not text.startswith(label, at):
                # the label is parted where the text leaves it
                n = shared(label, text[at : at + len(label)])
                upper = [label[:n], {label[n]: child}, None]
                child[0] = label[n:]
                node[1][text[at]] = child = upper
            node, at = child, at + len(child[0])
        if least is not None and (node[2] is None or least < node[2]):
            node[2] = least
        return node


def shared(a: bytes, b: bytes) -> int:
    """The length of the common prefix, by halves."""
    low, high = 0, min(len(a), len(b))
    while low < high:
        mid = (low + high + 1) // 2
        if a[low:mid] == b[low:mid]:
            low = mid
        else:
            high = mid - 1
    return low


def own_mask(text: str) -> int:
    """The filters that a text fails by itself, as bits: A is 1, B is 2 and so on."""
    raw = text.encode()
    words = raw.split()
    capitals = len(raw) - len(raw.translate(None, CAPITALS))
    return (len(words) < MIN_WORDS) | (100 * len(set(words)) < MIN_DISTINCT * len(words)) << 1 | (100 * capitals > MAX_CAPITALS * len(text)) << 2 | (len(raw.translate(None, SIGNS)) < len(raw)) << 3


def dealt(rows: DataFrame) -> DataFrame:
    """rows (doc_id, text, part) by ranges of adaptive prefixes, with `least`: the known least doc_id of a heavy text."""
    body = F.col("text").cast("binary")
    weight = F.octet_length("text") + ROW
    total = rows.agg(F.sum(weight.cast("long")), F.sum(F.octet_length("text").cast("long"))).first()
    ranges = max(partitions(rows), int((total[1] or 0) // RANGE))
    limit = max(1, (total[0] or 0) // (LIGHT * ranges))
    kind = rows.schema["doc_id"].dataType.simpleString()
    spark = rows.sparkSession
    # two hashes tell whether a prefix has one text alone
    texts = (F.xxhash64("text"), F.xxhash64(F.lit("twice"), F.col("text")))
    keyed, part, length = rows, rows, FIRST
    depth, single, copies, least = F.lit(FIRST), F.lit(False), F.lit(1), F.lit(None).cast(kind)
    names: list[str] = []
    while True:
        prefix = F.xxhash64(F.substring(body, 1, length))
        ends = [f(t) for t in texts for f in (F.min, F.max)]
        found = part.groupBy(prefix.alias("at")).agg(F.sum(weight.cast("long")).alias("weight"), (ends[0].eqNullSafe(ends[1]) & ends[2].eqNullSafe(ends[3])).alias("one"), F.min("doc_id").alias("low"))
        heavy = found.where(F.col("weight") > limit).collect()
        if not heavy:
            break
        # at most LIGHT * ranges rows
        name = f"_at{length}"
        names.append(name)
        table = F.broadcast(spark.createDataFrame([(r["at"], (r["one"], r["weight"] // limit + 1, r["low"])) for r in heavy], f"{name} long, {name}_ struct<one: boolean, copies: long, low: {kind}>"))
        keyed = keyed.join(table, prefix == F.col(name), "left")
        here = F.col(f"{name}_")
        depth = F.when(here["one"] == F.lit(False), 4 * length).otherwise(depth)
        single, copies, least = single | F.coalesce(here["one"], F.lit(False)), F.coalesce(F.when(here["one"], here["copies"]), copies), F.coalesce(F.when(here["one"], here["low"]), least)
        more = [r["at"] for r in heavy if not r["one"]]
        if not more:
            break
        part = part.join(F.broadcast(spark.createDataFrame([(x,) for x in more], f"{name} long")), prefix == F.col(name), "left_semi")
        length *= 4
    order = [F.substring(body, 1, FIRST), F.when(depth > FIRST, F.xxhash64(F.expr("cast(text as binary)").substr(F.lit(1), depth))).otherwise(0), F.when(single, F.pmod(F.xxhash64("doc_id", F.spark_partition_id()), copies)).otherwise(0)]
    keys = [f"_key{k}" for k in range(len(order))]
    placed = keyed.select("doc_id", "text", "part", least.alias("least"), *(c.alias(k) for c, k in zip(order, keys, strict=True)))
    return placed.repartitionByRange(ranges, *keys).select("doc_id", "text", "part", "least")


def failed_filters(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", part: str = "source") -> DataFrame:
    """doc_id, part and mask (bits of the filters that the row fails) of every row."""
    rows = docs.select(F.col(doc_id).alias("doc_id"), F.coalesce(F.col(text), F.lit("")).alias("text"), F.coalesce(F.col(part).cast("string"), F.lit("")).alias("part"))

    def masks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        trie, ids, parts, own, ends = Trie(), [], [], [], []
        names: dict[str, str] = {}
        for batch in batches:
            for at in range(0, batch.num_rows, 500):
                small = batch.slice(at, 500)
                for key, body, where, least in zip(*(c.to_pylist() for c in small.columns), strict=True):
                    node = trie.insert(body.encode(), key)
                    if least is not None and least < node[2]:
                        node[2] = least
                    ids.append(key)
                    parts.append(names.setdefault(where, where))
                    own.append(own_mask(body))
                    ends.append(node)
        duplicate = 1 << FILTERS.index("E")
        for at in range(0, len(ids), 20_000):
            cut_ = slice(at, at + 20_000)
            found = [m | duplicate if key is not None and key > node[2] else m for m, key, node in zip(own[cut_], ids[cut_], ends[cut_], strict=True)]
            yield pa.RecordBatch.from_arrays([pa.array(ids[cut_], batch.schema.field(0).type), pa.array(parts[cut_]), pa.array(found, pa.int32())], ["doc_id", "part", "mask"])

    return dealt(rows).mapInArrow(masks, f"doc_id {rows.schema['doc_id'].dataType.simpleString()}, part string, mask int")


def mask_counts(failed: DataFrame, labels: DataFrame) -> DataFrame:
    """part, mask, n, good (rows labelled quality 1) and toxic: at most 32 rows for each part."""
    known = labels.groupBy("doc_id").agg(F.max((F.col("quality") == 1).cast("int")).alias("good"), F.max((F.col("toxic") == 1).cast("int")).alias("toxic"))
    marks = [F.coalesce(F.sum(c), F.lit(0)).cast("long").alias(c) for c in ("good", "toxic")]
    return failed.join(known, "doc_id", "left").groupBy("part", "mask").agg(F.count("*").alias("n"), *marks)


def order_audit(counts: DataFrame) -> DataFrame:
    """The contract's rows from the counts of masks: part, filter_order, step and what the step does."""
    orders = F.array(*(F.lit("".join(p)) for p in permutations(FILTERS)))
    steps = counts.withColumn("filter_order", F.explode(orders)).withColumn("step", F.explode(F.sequence(F.lit(1), F.lit(len(FILTERS)))))
    earlier = F.expr("substring(filter_order, 1, step - 1)")
    bit = lambda where: sum((F.when(F.instr(where, x) > 0, 1 << k).otherwise(0) for k, x in enumerate(FILTERS)), F.lit(0))
    steps = steps.withColumn("filter", F.expr("substring(filter_order, step, 1)")).withColumn("own", bit(F.col("filter"))).withColumn("before", bit(earlier))
    fails, gone = F.col("mask").bitwiseAND(F.col("own")) != 0, F.col("mask").bitwiseAND(F.col("before")) != 0
    total = lambda c, where: F.sum(F.when(where, F.col(c)).otherwise(0)).cast("long")
    found = steps.groupBy("part", "filter_order", "step", "filter").agg(
        total("n", ~gone & ~fails).alias("kept"),
        total("n", ~gone & fails).alias("removed"),
        total("n", gone & fails).alias("redundant"),
        total("n", F.col("mask") == F.col("own")).alias("unique_fails"),
        total("good", ~gone & fails).alias("good_lost"),
        total("toxic", ~gone & fails).alias("toxic_lost"),
    )
    return found.withColumn("shapley", F.sum("removed").over(Window.partitionBy("part", "filter"))).drop("filter")


def filter_audit(docs: DataFrame, labels: DataFrame, doc_id: str = "doc_id", text: str = "text", part: str = "source") -> DataFrame:
    """What each filter removes at each step of all orders, for each part of docs."""
    return order_audit(cut(mask_counts(failed_filters(docs, doc_id, text, part), labels)))

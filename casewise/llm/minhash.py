"""Operator 9, near-dedup by min-max hashing.

A document's set is that of its distinct word 5-grams, as 64-bit hashes. Under each permutation of these both the
least and the greatest are kept: the greatest under x -> a*x is the least under x -> -a*x, so one evaluation gives two
values. Values are banded; documents that agree in a band are candidates, and a candidate pair is a link only if the
full sets say so. With 44 bands of 5 values a pair at similarity 0.75 is missed with probability 7e-6, less above.

Documents with equal sets form a class first, and go on as one. What follows loses no link between classes that meet
in a bucket, and does not compare all pairs of one:

1. Shingles that one class alone has cannot be in an intersection. So with s shingles that others have too, the
   intersection of two sets is at most the smaller s. Documents that only share a passage fall out here.
2. In each bucket all are compared with its hub, the member of which others hold most. The comparison also counts which
   parts (32 stretches of the hub) a member shares with it.
3. Where a bucket still holds several components, members outside its largest one are set against the others. Two
   members have at most the sum over the parts of the smaller count in common, and outside the hub at most the smaller
   number of shingles that others have too. Only pairs which that leaves open are compared.

Null and empty texts have an empty set and no links. Fewer than five words form one shingle. Rows with the same doc_id
are one document, whose links are those of all its rows; it is kept or not with all of them. Rows without a doc_id take
no part: their component is null and they are kept. Very long texts are taken whole. An empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from casewise.llm.common import connected_components, cut, hot_join, stored, unused

WORDS, BANDS, ROWS = 5, 44, 5
#: A link has PART * intersection >= MIN_PART * union.
PART, MIN_PART = 100, 75
#: Stretches of a hub whose shared shingles are counted.
STRETCHES = 32
#: Members of a bucket, or pairs of a hub, that one task takes; more are dealt over several.
TOGETHER = 2000
WORDS_KEPT = 600_000

_WORDS: dict[bytes, int] = {}
_MULTIPLY = np.random.default_rng(5).integers(1, 2**32, (BANDS * ROWS + 1) // 2, dtype=np.uint32) | np.uint32(1)
_MIX = np.random.default_rng(6).integers(1, 2**63, 16, dtype=np.uint64) | np.uint64(1)


def word_hashes(text: str | None) -> np.ndarray:
    """A 64-bit hash for each word of the text, A-Z in lower case."""
    words = (text or "").encode().lower().split()
    if len(_WORDS) > WORDS_KEPT:
        _WORDS.clear()
    kept = _WORDS
    for w in words:
        if w not in kept:
            kept[w] = xxhash.xxh3_64_intdigest(w)
    return np.fromiter(map(kept.__getitem__, words), np.uint64, len(words))


def mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(31))) * np.uint64(0x9E3779B97F4A7C15)
    return x ^ (x >> np.uint64(29))


def shingle_hashes(text: str | None, width: int = WORDS) -> np.ndarray:
    """A hash for each of the text's word 5-grams, in their order; for all its words if there are fewer."""
    words = word_hashes(text)
    n = len(words)
    if not n:
        return words
    width = min(width, n)
    total = np.full(n - width + 1, width, np.uint64)
    for k in range(width):
        total = mixed(total + words[k : n - width + 1 + k] * _MIX[k])
    return total


def shingle_set(text: str | None) -> np.ndarray:
    """Sorted distinct hashes of the text's word 5-grams."""
    return np.unique(shingle_hashes(text))


def bands_of(shingles: np.ndarray) -> np.ndarray:
    """One 64-bit key for each band."""
    low = (shingles >> np.uint64(16)).astype(np.uint32)
    least = np.full(len(_MULTIPLY), 2**32 - 1, np.uint32)
    most = np.zeros(len(_MULTIPLY), np.uint32)
    for at in range(0, len(low), 2048):  # what is multiplied stays in the processor's cache
        values = _MULTIPLY[:, None] * low[None, at : at + 2048]
        np.minimum(least, values.min(1), out=least)
        np.maximum(most, values.max(1), out=most)
    values = np.stack([least, most], 1).ravel()[: BANDS * ROWS].reshape(BANDS, ROWS).astype(np.uint64)
    key = np.arange(1, BANDS + 1, dtype=np.uint64)
    for k in range(ROWS):
        key = mixed(key * _MIX[k] + values[:, k])
    return key.view(np.int64)


def signatures(docs: DataFrame) -> DataFrame:
    """doc_id, n_shingles, set_hash (16 bytes; null for an empty set or without a doc_id), bands."""

    def sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 2000):
                part = batch.slice(at, 2000)
                sizes, hashes, bands = [], [], []
                for doc, text in zip(part.column(0).to_pylist(), part.column(1).to_pylist(), strict=True):
                    shingles = shingle_set(text)
                    used = len(shingles) > 0 and doc is not None
                    sizes.append(len(shingles))
                    hashes.append(xxhash.xxh3_128_digest(shingles.tobytes()) if used else None)
                    bands.append(bands_of(shingles) if used else [])
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(sizes, pa.int64()), pa.array(hashes, pa.binary()), pa.array(bands, pa.list_(pa.int64()))], ["doc_id", "n_shingles", "set_hash", "bands"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(sign, "doc_id long, n_shingles long, set_hash binary, bands array<long>")


def alone(texts: DataFrame) -> DataFrame:
    """id and how many of its shingles no other of the texts has; only where there are any."""

    def explode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for key, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                shingles = shingle_set(text).view(np.int64)
                for at in range(0, len(shingles), 50_000):
                    part = shingles[at : at + 50_000]
                    yield pa.RecordBatch.from_arrays([pa.array(part), pa.array(np.full(len(part), key, np.int64))], ["shingle", "id"])

    rows = texts.select("id", "text").mapInArrow(explode, "shingle long, id long")
    return rows.groupBy("shingle").agg(F.count("*").alias("holders"), F.min("id").alias("id")).where("holders = 1").groupBy("id").agg(F.count("*").alias("alone"))


def compared(pairs: DataFrame, texts: DataFrame, rows: int) -> DataFrame:
    """pairs (a, b), `rows` of them, with `link` and `parts`: how much of each stretch of a's set is in b's. texts: id, text.

    The pairs of one a lie in one task only up to TOGETHER of them or a thousandth of all; others are dealt over several.
    """

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, hub, stretch = None, np.zeros(0, np.uint64), np.zeros(0, int)
        for batch in batches:
            link, parts = [], []
            for a, left, right in zip(batch.column(0).to_pylist(), batch.column(2).to_pylist(), batch.column(3).to_pylist(), strict=True):
                if a != last:
                    last, hub = a, shingle_set(left)
                    stretch = stretches(left, hub)
                other = shingle_set(right)
                shared = np.isin(hub, other, assume_unique=True)
                both = int(shared.sum())
                link.append(PART * both >= MIN_PART * (len(hub) + len(other) - both))
                parts.append(np.bincount(stretch[shared], minlength=STRETCHES))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(link, pa.bool_()), pa.array(parts, pa.list_(pa.int32()))], ["a", "b", "link", "parts"])

    most = max(TOGETHER, rows // 1000)
    hot = pairs.groupBy("a").agg(F.count("*").alias("n")).where(F.col("n") > most).select("a", F.ceil(F.col("n") / most).cast("int").alias("fan"))  # below 1000 rows
    hot = cut(hot, 1)
    fan = F.coalesce("fan", F.lit(1))
    dealt = pairs.join(F.broadcast(hot), "a", "left").withColumn("salt", F.pmod(F.xxhash64("b"), fan).cast("int")).drop("fan")
    left = texts.withColumnRenamed("id", "a").join(F.broadcast(hot), "a", "left").select("a", F.explode(F.sequence(F.lit(0), fan - 1)).alias("salt"), F.col("text").alias("_left"))
    right = texts.select(F.col("id").alias("b"), F.col("text").alias("_right"))
    both = dealt.join(right, "b").join(left, ["a", "salt"]).select("a", "b", "_left", "_right")
    return cut(both.mapInArrow(compare, "a long, b long, link boolean, parts array<int>"), rows, 1000)


def stretches(text: str | None, shingles: np.ndarray) -> np.ndarray:
    """The stretch of the text, from 0, in which each of its sorted shingles stands first."""
    first = np.unique(shingle_hashes(text), return_index=True)[1]
    rank = np.empty(len(first), int)
    rank[first.argsort()] = np.arange(len(first))
    return rank * STRETCHES // max(1, len(shingles))


def enough(both: Column, n: Column, n2: Column) -> Column:
    """Sets of n and n2 shingles with so many in common are a link."""
    return both * (PART + MIN_PART) >= (n + n2) * MIN_PART


def class_links(members: DataFrame, texts: DataFrame) -> DataFrame:
    """(node, component) of all members that similar sets join. members: key (of a bucket), id, n and s, what others have too."""
    rows = members.count()
    hubs = cut(members.groupBy("key").agg(F.min(F.struct((F.lit(1) - F.col("s") / F.col("n")).alias("alone"), "id", "n", "s")).alias("hub")).select("key", F.col("hub.id").alias("hub"), F.col("hub.n").alias("hub_n"), F.col("hub.s").alias("hub_s")), rows)
    met = cut(members.join(hubs, "key"), rows)
    pairs = cut(met.where((F.col("id") != F.col("hub")) & enough(F.least("s", "hub_s"), F.col("n"), F.col("hub_n"))).select(F.col("hub").alias("a"), F.col("id").alias("b")).distinct(), rows)
    tested = compared(pairs, texts, pairs.count())
    groups = cut(connected_components(tested.where("link").select("a", "b")), rows)
    named = cut(met.join(groups, F.col("id") == F.col("node"), "left").select("key", "id", "n", "s", "hub", F.coalesce("component", "id").alias("component")), rows)
    parts_of = named.groupBy("key", "component").agg(F.count("*").alias("size"))
    split = cut(parts_of.groupBy("key").agg(F.max(F.struct("size", "component"))["component"].alias("main"), F.sum("size").alias("size"), F.count("*").alias("parts")).where("parts > 1").select("key", "main", F.ceil(F.col("size") / TOGETHER).cast("int").alias("fan")), rows)
    # how much of each stretch of the hub a member has; the hub has all of it; null where the two were not compared
    whole = F.transform(F.sequence(F.lit(0), F.lit(STRETCHES - 1)), lambda k: (F.ceil((k + 1) * F.col("n") / STRETCHES) - F.ceil(k * F.col("n") / STRETCHES)).cast("int"))
    seen = tested.select(F.col("a").alias("hub"), F.col("b").alias("id"), "parts")
    still = named.join(split, "key").join(seen, ["hub", "id"], "left").withColumn("parts", F.when(F.col("id") == F.col("hub"), whole).otherwise(F.col("parts")))
    still = cut(still.withColumn("rest", F.col("s") - F.aggregate("parts", F.lit(0).cast("long"), lambda a, x: a + x)).drop("hub"), rows)
    outside = still.where("component != main").withColumn("salt", F.explode(F.sequence(F.lit(0), F.col("fan") - 1)))
    other = still.select("key", F.pmod(F.xxhash64("id"), "fan").cast("int").alias("salt"), *(F.col(c).alias(f"{c}2") for c in ("id", "n", "s", "component", "main", "parts", "rest")))
    most = sum((F.least(F.col("parts")[k], F.col("parts2")[k]) for k in range(STRETCHES)), F.least("rest", "rest2"))
    once = (F.col("component2") == F.col("main2")) | (F.col("id") < F.col("id2"))
    left_open = once & (F.col("component") != F.col("component2")) & enough(F.least("s", "s2"), F.col("n"), F.col("n2")) & F.coalesce(enough(most, F.col("n"), F.col("n2")), F.lit(True))
    fresh = outside.join(other, ["key", "salt"]).where(left_open).select(F.least("id", "id2").alias("a"), F.greatest("id", "id2").alias("b")).distinct()
    fresh = cut(fresh.join(tested.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")), ["a", "b"], "left_anti"), rows)
    if not (n := fresh.count()):
        return groups
    more = compared(fresh, texts, n).where("link").select("a", "b")
    names = groups.select("node", "component")
    for end in ("a", "b"):
        more = more.join(names.toDF(end, f"_{end}"), end, "left").withColumn(end, F.coalesce(f"_{end}", end)).drop(f"_{end}")
    above = cut(connected_components(more), n)  # of components
    merged = groups.join(above.toDF("component", "_above"), "component", "left").select("node", F.coalesce("_above", "component").alias("component"))
    fresh_nodes = above.join(groups, "node", "left_anti")
    return cut(merged.unionByName(fresh_nodes), rows)


def repeated_ids(signed: DataFrame) -> DataFrame:
    """doc_ids of which rows have different sets."""
    mark = F.xxhash64("set_hash")
    return cut(signed.groupBy("doc_id").agg(F.min(mark).alias("least"), F.max(mark).alias("most")).where("least != most").select("doc_id"), 1)


def tied_classes(signed: DataFrame, classes: DataFrame, twice: DataFrame) -> DataFrame:
    """(a, b): classes that hold different texts of the same doc_id."""
    held = signed.where("set_hash is not null").join(twice, "doc_id", "left_semi").join(classes.select("set_hash", "id"), "set_hash").select("doc_id", "id").distinct()
    return held.join(held.groupBy("doc_id").agg(F.min("id").alias("a")), "doc_id").select("a", F.col("id").alias("b")).where("a != b")


def class_texts(docs: DataFrame, wanted: DataFrame, twice: DataFrame) -> DataFrame:
    """id and text of each class. wanted: id, doc_id (the smallest of the class), set_hash; twice: doc_ids with more than one set."""

    def own(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sure = [not unsure or xxhash.xxh3_128_digest(shingle_set(text).tobytes()) == mark for text, mark, unsure in zip(*(batch.column(k).to_pylist() for k in (1, 2, 3)), strict=True)]
            mask = pa.array(sure, pa.bool_())
            yield pa.RecordBatch.from_arrays([batch.column(0).filter(mask), batch.column(1).filter(mask)], ["id", "text"])

    wanted = wanted.join(twice.withColumn("unsure", F.lit(True)), "doc_id", "left")
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").join(wanted, "doc_id")
    kept = rows.select("id", "text", "set_hash", F.coalesce("unsure", F.lit(False)).alias("unsure")).mapInArrow(own, "id long, text string")
    return kept.dropDuplicates(["id"])


def near_duplicates(docs: DataFrame) -> DataFrame:
    """doc_id, n_shingles, component_id, kept."""
    signed = cut(signatures(docs))
    # a class has a number of its own, since two of them may share their smallest doc_id
    classes = signed.where("set_hash is not null").groupBy("set_hash").agg(F.min("doc_id").alias("doc_id"), F.max("n_shingles").alias("n"), F.first("bands").alias("bands"), F.count("*").alias("rows"))
    classes = cut(classes.withColumn("id", F.monotonically_increasing_id()))
    in_buckets = classes.select("id", "n", F.explode("bands").alias("key"))
    crowded = in_buckets.groupBy("key").agg(F.count("*").alias("size")).where("size > 1").select("key")
    members = cut(in_buckets.join(crowded, "key").select("key", "id", "n"))
    twice = repeated_ids(signed)
    texts = stored(class_texts(docs, classes.join(members.select("id").distinct(), "id", "left_semi").select("id", "doc_id", "set_hash"), twice))
    shared = F.col("n") - F.coalesce("alone", F.lit(0))
    members = members.join(alone(texts), "id", "left").select("key", "id", "n", shared.alias("s")).where(F.col("s") * PART >= F.col("n") * MIN_PART)
    groups = class_links(cut(members), texts)
    if twice.count():
        stars = groups.where("node != component").toDF("a", "b")
        groups = connected_components(stars.unionByName(tied_classes(signed, classes, twice)))
    named = classes.join(groups.withColumnRenamed("node", "id"), "id", "left").select("set_hash", "doc_id", "rows", F.coalesce("component", "id").alias("component"))
    named = cut(named)
    lowest = named.groupBy("component").agg(F.min("doc_id").alias("component_id"))
    named = cut(named.join(lowest, "component").select("set_hash", "rows", "component_id"))
    out = hot_join(signed.select("doc_id", "n_shingles", "set_hash"), named, ["set_hash"], "rows")
    component = F.coalesce("component_id", "doc_id")
    return out.select("doc_id", "n_shingles", component.alias("component_id"), F.coalesce(F.col("doc_id") == component, F.lit(True)).alias("kept"))


def drop_near_duplicates(docs: DataFrame) -> DataFrame:
    """The rows of docs that stay, with all their columns: of each group of near copies those with the smallest doc_id."""
    name = unused("gone", docs)
    gone = near_duplicates(docs).where("not kept").select(F.col("doc_id").alias(name)).distinct()
    return docs.join(cut(gone), F.col("doc_id").cast("long") == F.col(name), "left_anti").select(docs.columns)

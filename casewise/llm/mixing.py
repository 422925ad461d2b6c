"""Operator 5, mixing sources to target weights by capped water-filling.

Each source has a weight and a size in words. The budget is shared by weight, a source stops at `epochs` times its
size, and what it cannot take is shared again by weight, until none is above. All this is one water level: a source
gets the smaller of its cap and level x weight, and the level follows from running sums over sources in order of
cap / weight. Documents are then repeated as a whole, and a seeded choice of documents once more until the source's
target is met to the word; the last one chosen gives its first words only.

Words are runs of other than [\\x20\\x09-\\x0D]. Null and empty texts have no words and are never taken. Rows with a
null source form one source, the last. Rows without a doc_id and repeated rows are documents of their own; which of
equal rows is chosen does not show. A source without words has target 0. An empty table gives no rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from casewise.llm.common import cut, unused

WEIGHTS, SHARE, EPOCHS, SEED = (5, 2, 1), 1.5, 2, 17
WORD = r"[^\x20\x09-\x0D]+"
#: A source's documents fall into so many buckets of their random number.
BUCKETS = 1024


def water_filling(sizes: DataFrame, weights: tuple[int, ...] = WEIGHTS, share: float = SHARE, epochs: float = EPOCHS) -> DataFrame:
    """sizes (_s, source, source_size) with each source's target. One row for each source meets in one task, no documents."""
    order = Window.orderBy(F.col("source").asc_nulls_last())
    weight = F.element_at(F.array(*map(F.lit, weights)), ((F.row_number().over(order) - 1) % len(weights) + 1).cast("int"))
    everything = Window.partitionBy()
    weighed = sizes.withColumn("_weight", weight).withColumn("_cap", F.col("source_size") * F.lit(epochs)).withColumn("_budget", F.sum("source_size").over(everything) * F.lit(share))
    # sources in order of cap / weight; when those before are full, the rest share what is left
    by_level = Window.orderBy((F.col("_cap") / F.col("_weight")).asc(), F.col("source").asc_nulls_last())
    full = F.coalesce(F.sum("_cap").over(by_level.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    rest = F.sum("_weight").over(by_level.rowsBetween(0, Window.unboundedFollowing))
    level = weighed.withColumn("_level", (F.col("_budget") - full) / rest)
    # the first source in that order whose cap is above its share sets the level for all after it
    first = F.min(F.when(F.col("_level") * F.col("_weight") < F.col("_cap"), F.struct(F.col("_cap") / F.col("_weight"), "_level"))).over(everything)
    target = F.when(first.isNull(), F.col("_cap")).otherwise(F.least(F.col("_cap"), first["_level"] * F.col("_weight")))
    return level.select("_s", "source", "source_size", target.cast("double").alias("target"))


def mix(docs: DataFrame, keep: dict[str, Column] | None = None, weights: tuple[int, ...] = WEIGHTS, share: float = SHARE, epochs: float = EPOCHS, seed: int = SEED) -> DataFrame:
    """doc_id, size, source_size, target, taken (words, repeats counted) and the columns of `keep` for each document."""
    key = F.coalesce(F.concat(F.lit("s"), F.col("source").cast("string")), F.lit("-"))
    drawn = docs.select("doc_id", F.col("source").alias("source"), key.alias("_s"), F.coalesce(F.regexp_count("text", F.lit(WORD)), F.lit(0)).cast("long").alias("size"), F.xxhash64(F.lit(seed), "doc_id", "text").alias("_draw"), *(c.alias(k) for k, c in (keep or {}).items()))
    drawn = drawn.withColumn("_bucket", F.pmod("_draw", F.lit(BUCKETS)))
    counted = drawn if keep else cut(drawn)
    binned = cut(counted.groupBy("_s", "_bucket").agg(F.max("source").alias("source"), F.sum("size").alias("_words")))
    targets = cut(water_filling(binned.groupBy("_s").agg(F.max("source").alias("source"), F.sum("_words").alias("source_size")), weights, share, epochs))
    # whole repetitions for all, and `_extra` words of the source once more
    words = F.round("target").cast("long")
    whole = F.when(F.col("source_size") > 0, F.floor(words / F.col("source_size"))).otherwise(F.lit(0)).cast("long")
    plan = targets.withColumn("_whole", whole).withColumn("_extra", words - F.col("_whole") * F.col("source_size")).drop("source")
    before = Window.partitionBy("_s").orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
    bins = binned.select("_s", "_bucket", F.coalesce(F.sum("_words").over(before), F.lit(0)).alias("_before"))
    plan = cut(bins.join(plan, "_s"))
    own = Window.partitionBy("_s", "_bucket").orderBy("_draw", "doc_id", "size").rowsBetween(Window.unboundedPreceding, -1)
    found = counted.withColumn("_own", F.coalesce(F.sum("size").over(own), F.lit(0))).join(plan, ["_s", "_bucket"])
    extra = F.greatest(F.lit(0), F.least(F.col("size"), F.col("_extra") - F.col("_before") - F.col("_own")))
    return found.select("doc_id", "size", "source_size", "target", (F.col("_whole") * F.col("size") + extra).cast("long").alias("taken"), *(keep or {}))


def mixed_documents(docs: DataFrame, **how) -> DataFrame:
    """The mix itself: rows of docs, repeated, the last repetition of a document cut to its first words if need be.

    Columns of docs stay as they are; where a text is cut, n_chars (if docs has it) follows.
    """
    name = unused("_words", docs)
    taken = mix(docs, keep={"_row": F.struct(*docs.columns)}, **how).where("taken > 0")
    whole, part = F.floor(F.col("taken") / F.col("size")).cast("int"), F.col("taken") % F.col("size")
    none = F.array_repeat(F.lit(0).cast("long"), F.lit(0))
    repeats = F.concat(F.array_repeat(F.lit(0).cast("long"), whole), F.when(part > 0, F.array(part)).otherwise(none))
    copies = taken.select("_row", F.explode(repeats).alias(name)).select("_row.*", name)
    first = F.array_join(F.slice(F.regexp_extract_all("text", F.lit(r"[\x20\x09-\x0D]*[^\x20\x09-\x0D]+"), 0), F.lit(1), F.col(name).cast("int")), "")
    cut_text = copies.withColumn("text", F.when(F.col(name) > 0, first).otherwise(F.col("text")))
    if "n_chars" in docs.columns:
        cut_text = cut_text.withColumn("n_chars", F.when(F.col(name) > 0, F.char_length("text").cast(docs.schema["n_chars"].dataType)).otherwise(F.col("n_chars")))
    return cut_text.select(docs.columns)

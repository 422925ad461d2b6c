"""Operator 7, document fingerprints: a homomorphic multiset hash of paragraphs.

A fingerprint is two wide vectors, both sums over the multiset of a document's paragraphs (its lines). The first adds
8 words of 64 bits hashed from each whole paragraph, modulo 2^64: equal for equal multisets whatever their order, and
for practical purposes for no others. The second adds 256 signs hashed from each piece of a paragraph (48 characters
from its start, so that what follows an edit in other paragraphs keeps its pieces), modulo 2^16; the cosine of two of
these estimates how much of two multisets is the same, within about 0.06. Sums can be updated: `combine` adds or
takes away the paragraphs of another fingerprint without the text.

A null text counts as empty: one empty paragraph. Rows without a doc_id come after all others; rows with the same
doc_id follow each other in the order of their texts, so that the next document is defined for each. Equal texts have
equal fingerprints. Very long texts are taken whole; signs would wrap only beyond 32,767 more of one than the other.
Other columns are left behind. An empty table gives no rows.
"""

from __future__ import annotations

import base64
import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from casewise.llm.common import partitions

WORDS, SIGNS, PIECE = 8, 256, 48


def fingerprint(text: str | None) -> bytes:
    """64 bytes of sums modulo 2^64, then 512 of sums modulo 2^16."""
    lines = (text or "").split("\n")
    whole = np.frombuffer(b"".join([hashlib.blake2b(x.encode("utf-8", "surrogatepass"), digest_size=8 * WORDS).digest() for x in lines]), "<u8").reshape(-1, WORDS)
    pieces = [x[at : at + PIECE] for x in lines for at in range(0, len(x) or 1, PIECE)]
    bits = np.frombuffer(b"".join([hashlib.blake2b(x.encode("utf-8", "surrogatepass"), digest_size=SIGNS // 8).digest() for x in pieces]), np.uint8).reshape(-1, SIGNS // 8)
    ones = np.zeros(SIGNS, np.int64)
    for at in range(0, len(bits), 4096):
        ones += np.unpackbits(bits[at : at + 4096], axis=1).sum(0, dtype=np.int64)
    return whole.sum(0, dtype=np.uint64).astype("<u8").tobytes() + (2 * ones - len(bits)).astype("<i2").tobytes()


def combine(one: bytes, other: bytes, sign: int = 1) -> bytes:
    """The fingerprint after the paragraphs of `other` are added (sign 1) or taken away (-1)."""
    at = 8 * WORDS
    with np.errstate(over="ignore"):
        a, b = np.frombuffer(one[:at], "<u8"), np.frombuffer(other[:at], "<u8")
        c, d = np.frombuffer(one[at:], "<i2"), np.frombuffer(other[at:], "<i2")
        return (a + b if sign > 0 else a - b).tobytes() + (c + d if sign > 0 else c - d).tobytes()


def likeness(one: bytes, other: bytes) -> float:
    """1 for equal fingerprints, else the cosine of the signs' sums, 0 at least and below 1."""
    if one == other:
        return 1.0
    a, b = (np.frombuffer(x[8 * WORDS :], "<i2").astype(float) for x in (one, other))
    size = float(np.sqrt((a @ a) * (b @ b)))
    return min(max(0.0, float(a @ b) / size), 1 - 1e-9) if size else 0.0


def fingerprints(docs: DataFrame, text: str = "text") -> DataFrame:
    """docs with their `fingerprint` (binary)."""

    @F.pandas_udf("binary")
    def of(texts):
        return texts.map(fingerprint)

    return docs.withColumn("fingerprint", of(F.coalesce(text, F.lit(""))))


def edited(text: str, following: str) -> str:
    """The last third of the characters replaced by as many from the start of `following`, or all of it."""
    n = len(text) // 3
    return text[: len(text) - n] + following[:n] if n else text


def next_fingerprints(docs: DataFrame) -> DataFrame:
    """doc_id, n_chars, edited (the text), fingerprint, edited_fingerprint, near_edited, near_next.

    The next document is that with the next smaller doc_id (null is the smallest, equal ones go by text), after the last
    the first. Texts move once: they are dealt by ranges of doc_id, and each range also gets the head of the next one,
    which a count over doc_id alone finds.
    """
    place = F.coalesce(F.col("doc_id").cast("long"), F.lit(-(2**63)))
    ids = docs.select(place.alias("place"))
    ranges = max(16, 4 * partitions(docs))
    found = ids.agg(F.percentile_approx("place", [k / ranges for k in range(1, ranges)], 20 * ranges)).first()[0] or []
    borders = sorted(set(found))  # fewer than `ranges`

    def part(x, low: int = 0, high: int = len(borders)):
        """The number of borders up to x, by halving."""
        if low == high:
            return F.lit(low)
        mid = (low + high) // 2
        return F.when(x < F.lit(borders[mid]), part(x, low, mid)).otherwise(part(x, mid + 1, high))

    heads = {r[0]: r[1] for r in ids.groupBy(part(F.col("place")).alias("part")).agg(F.max("place")).collect() if r[1] is not None}
    order = sorted(heads, reverse=True)
    follows = [(heads[b], a) for a, b in zip(order, [*order[1:], *order[:1]], strict=True)]  # the head of b follows range a
    spark = docs.sparkSession
    body = docs.select(place.alias("place"), F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))
    met = body.join(F.broadcast(spark.createDataFrame(follows, "place long, part int")), "place")  # below `ranges` rows
    extra = met.groupBy("place", "part").agg(F.min("text").alias("text")).withColumn("doc_id", F.lit(None).cast("long"))
    dealt = body.withColumn("part", part(F.col("place"))).withColumn("own", F.lit(True)).unionByName(extra.withColumn("own", F.lit(False)))
    tasks = partitions(docs)
    ordered = dealt.repartition(tasks, "part").sortWithinPartitions(F.col("part"), F.col("own").desc(), F.col("place").desc(), F.col("text")).select("doc_id", "text", "part", "own")

    def walk(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        before: tuple | None = None  # part, doc_id, text, fingerprint
        for batch in batches:
            for start in range(0, batch.num_rows, 500):
                rows = batch.slice(start, 500)
                out: list[tuple] = []
                for doc, text, range_, own in zip(*(rows.column(k).to_pylist() for k in range(4)), strict=True):
                    mark = fingerprint(text)
                    if before and before[0] == range_:
                        other = edited(before[2], text)
                        changed = fingerprint(other)
                        out.append((before[1], len(before[2]), other, before[3], changed, likeness(before[3], changed), likeness(before[3], mark)))
                    before = (range_, doc, text, mark) if own else None
                columns = list(zip(*out, strict=True)) if out else [[]] * 7
                kinds = (pa.int64(), pa.int64(), pa.string(), pa.binary(), pa.binary(), pa.float64(), pa.float64())
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], ["doc_id", "n_chars", "edited", "fingerprint", "edited_fingerprint", "near_edited", "near_next"])

    return ordered.mapInArrow(walk, "doc_id long, n_chars long, edited string, fingerprint binary, edited_fingerprint binary, near_edited double, near_next double")


def as_text(mark: bytes) -> str:
    return base64.b64encode(mark).decode()

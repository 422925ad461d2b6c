"""Operator 4, line dedup: lines that many documents share stay in one of them only.

A line's key is the line without white space at its ends and with A-Z in lower case. Keys of at least `min_chars`
code points are hashed (128 bits), distinct documents are counted for each hash, and keys found in at least
`min_docs` documents lose all their lines except in the largest doc_id that holds them. What to drop is joined back
by document, and the other lines are put together again in their order.

A null or empty text is one empty line, and a null text stays null. Rows with the same doc_id count as one document
and lose the same lines; the largest doc_id decides, so that there are no ties. An empty table gives no rows. Documents
with a null id lose nothing and keep no key alive. Very long texts are taken whole. Other columns of docs stay,
whatever their names.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from casewise.llm.common import cut, hot_join, unused

MIN_CHARS, MIN_DOCS = 40, 5


def key_hash(line: bytes, min_chars: int) -> bytes | None:
    """The hash of a line's key, None where the key is too short to count."""
    key = line.strip().lower()
    if len(key) < min_chars or not key.isascii() and len(key.decode("utf-8", "replace")) < min_chars:
        return None
    return xxhash.xxh3_128_digest(key)


def line_keys(docs: DataFrame, min_chars: int) -> DataFrame:
    """doc_id and key, once for each key of a document."""

    def keys(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, out = [], []
            for doc, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                found = {h for line in (text or "").encode().split(b"\n") if (h := key_hash(line, min_chars))}
                ids += [doc] * len(found)
                out += found
            yield pa.RecordBatch.from_arrays([pa.array(ids, batch.schema.field(0).type), pa.array(out, pa.binary())], ["doc_id", "key"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.where("doc_id is not null").select("doc_id", "text").mapInArrow(keys, f"doc_id {kind}, key binary")


def dropped_keys(docs: DataFrame, min_chars: int = MIN_CHARS, min_docs: int = MIN_DOCS) -> DataFrame:
    """doc_id and the keys it loses, one row for each document that loses any."""
    keys = line_keys(docs, min_chars).groupBy("doc_id", "key").agg(F.lit(1).alias("one"))
    shared = cut(keys.groupBy("key").agg(F.count("*").alias("n"), F.max("doc_id").alias("keeper")).where(F.col("n") >= min_docs).select("key", "keeper", "n"))
    # a line that most documents have is met by broadcast
    hits = hot_join(line_keys(docs, min_chars), shared, ["key"], "n").where("doc_id != keeper")
    return hits.groupBy("doc_id").agg(F.collect_set("key").alias("drop"))


def dedup_lines(docs: DataFrame, min_chars: int = MIN_CHARS, min_docs: int = MIN_DOCS) -> DataFrame:
    """All columns of docs with the text that stays, then n_lines and n_dropped, whose names get underscores where docs has them."""
    lines_name, dropped_name, key, drop_name = (unused(name, docs) for name in ("n_lines", "n_dropped", "_id", "_drop"))
    drops = cut(dropped_keys(docs, min_chars, min_docs)).toDF(key, drop_name)
    joined = docs.join(drops, F.col("doc_id") == F.col(key), "left").select(*docs.columns, drop_name)
    fields = [*docs.schema.fields, T.StructField(lines_name, T.LongType()), T.StructField(dropped_name, T.LongType())]
    at = docs.columns.index("text")

    def rebuild(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts, lines, dropped = [], [], []
            for text, drop in zip(batch.column(at).to_pylist(), batch.column(batch.num_columns - 1).to_pylist(), strict=True):
                parts = (text or "").split("\n")
                lines.append(len(parts))
                if drop:
                    gone = set(drop)
                    parts = [x for x in parts if len(x) < min_chars or key_hash(x.encode(), min_chars) not in gone]
                    text = "\n".join(parts)
                dropped.append(lines[-1] - len(parts))
                texts.append(text)
            columns = list(batch.columns[:-1])
            columns[at] = pa.array(texts, batch.schema.field(at).type)
            yield pa.RecordBatch.from_arrays([*columns, pa.array(lines, pa.int64()), pa.array(dropped, pa.int64())], [*batch.schema.names[:-1], lines_name, dropped_name])

    return joined.mapInArrow(rebuild, T.StructType(fields))

"""A training corpus from raw documents, in five stages; each reads what the one before it kept.

Toxic documents go, lines that many documents share stay in one, of near copies one stays, sources are mixed to their
target weights, and what is left is packed into sequences.

Texts are taken whole. Null and empty texts pass the first three stages; the mix takes words, so that they end there. A
null source is a source of its own. Rows that repeat a doc_id are scored each and count as one document in line dedup and
near-dedup, where they stay or go together. Rows without a doc_id lose no line and are no near copy of others. Ties are
settled by doc_id and content in every stage. Columns beyond those of documents are left behind, whatever their names. An
empty table gives no rows. The stages' tables stay in a pipeline-... folder of spark.checkpoint.dir, whose owner removes
them.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from casewise.llm import linededup, minhash, mixing, packing, toxicity
from casewise.llm.common import checkpoint_folder, read

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that a model fitted to the labelled rows of the whole table does not call toxic."""
    kept = toxicity.drop_toxic(docs, read(spark, sf_dir, "labels"), read(spark, sf_dir, "documents"))
    return kept.select(COLUMNS)


def dedup_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without the lines that other documents keep; n_chars follows. All documents stay."""
    kept = linededup.dedup_lines(docs)
    dropped = F.col(kept.columns[-1])
    return kept.withColumn("n_chars", F.when(dropped > 0, F.char_length("text").cast("long")).otherwise(F.col("n_chars"))).select(COLUMNS)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document, that with the smallest id, of each group of near copies."""
    return minhash.drop_near_duplicates(docs).select(COLUMNS)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents repeated, whole and in part, until each source has its target."""
    return mixing.mixed_documents(docs).select(COLUMNS)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of the documents with the sequence and the place they have in it."""
    import public_tokenizers

    return packing.pack_documents(docs, public_tokenizers.path("word_bpe_49k.json"), keep={"ids_crc32": F.crc32("ids")})


STAGES = [("toxicity", drop_toxic), ("line dedup", dedup_lines), ("near-dedup", drop_near_copies), ("mixing", mix_sources), ("packing", pack)]

#: SQL states neither a fitted model nor a packing; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages on documents; each result but the last is written to the shared folder and read again."""
    folder = f"{checkpoint_folder(spark)}/pipeline-{uuid.uuid4().hex}"
    docs = read(spark, sf_dir, "documents")
    for k, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k < len(STAGES) - 1:
            docs.write.parquet(f"{folder}/{k}")
            docs = spark.read.parquet(f"{folder}/{k}")
    return docs

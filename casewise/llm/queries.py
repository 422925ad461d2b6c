"""Queries op1 to op13 over the whole tables, and SQL for those that SQL can express."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from casewise.llm.common import checkpoint_folder, held_out, read

Query = Callable[[SparkSession, str], DataFrame]


def op1_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    from casewise.llm.packing import pack_documents

    return pack_documents(read(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"), keep={"ids_crc32": F.crc32("ids")})


def op2_histogram_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    from casewise.llm.sharding import shard_documents

    digest = F.crc32(F.coalesce("text", F.lit("")).cast("binary"))
    placed = shard_documents(read(spark, sf_dir, "documents"), 16, {"text_crc32": digest})
    return placed.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))


def op3_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    from casewise.llm.toxicity import toxicity

    return toxicity(read(spark, sf_dir, "documents"), read(spark, sf_dir, "labels"))


def op4_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from casewise.llm.linededup import dedup_lines

    kept = dedup_lines(read(spark, sf_dir, "documents").select("doc_id", "text"))
    return kept.select("doc_id", "n_lines", "n_dropped", F.sha2(F.coalesce("text", F.lit("")), 256).alias("kept_sha256"))


OP4_SQL = r"""
WITH lines AS (
  SELECT doc_id, unnest(parts) AS line, unnest(range(1, len(parts) + 1)) AS pos
  FROM (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS parts FROM documents)),
keyed AS (
  SELECT doc_id, pos, line,
    translate(regexp_replace(regexp_replace(line, '^[\x20\x09-\x0D]+', ''), '[\x20\x09-\x0D]+$', ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS key
  FROM lines),
shared AS (SELECT key, max(doc_id) AS keeper FROM keyed WHERE length(key) >= 40 GROUP BY key HAVING count(DISTINCT doc_id) >= 5),
marked AS (SELECT k.doc_id, k.pos, k.line, s.key IS NOT NULL AND k.doc_id <> s.keeper AS gone FROM keyed k LEFT JOIN shared s ON k.key = s.key)
SELECT doc_id, count(*) AS n_lines, CAST(sum(CASE WHEN gone THEN 1 ELSE 0 END) AS BIGINT) AS n_dropped,
  sha256(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (WHERE NOT gone), '')) AS kept_sha256
FROM marked GROUP BY doc_id
"""


def op5_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    from casewise.llm.mixing import mix

    return mix(read(spark, sf_dir, "documents"))


def op6_vector_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from casewise.llm.vectors import near_vectors

    return near_vectors(read(spark, sf_dir, "embeddings"))


OP6_SQL = """
WITH RECURSIVE usable AS (
  SELECT vec_id, label, list_transform(embedding, lambda x: CAST(x AS DOUBLE)) AS e FROM embeddings
  WHERE label IS NOT NULL AND len(embedding) > 0 AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0 AND len(list_filter(embedding, lambda x: x <> 0)) > 0),
link AS (SELECT a.vec_id AS i, b.vec_id AS j FROM usable a JOIN usable b ON a.label = b.label AND len(a.e) = len(b.e) AND a.vec_id <> b.vec_id WHERE list_cosine_similarity(a.e, b.e) >= 0.93),
reach AS (SELECT vec_id AS i, vec_id AS j FROM embeddings UNION SELECT r.i, l.j FROM reach r JOIN link l ON l.i = r.j)
SELECT vec_id, (SELECT count(*) FROM link WHERE link.i = vec_id) AS n_links, component_id, vec_id = component_id AS kept
FROM (SELECT i AS vec_id, min(j) AS component_id FROM reach GROUP BY 1)
"""


def op7_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    from casewise.llm.fingerprints import next_fingerprints

    found = next_fingerprints(read(spark, sf_dir, "documents"))
    return found.select("doc_id", "n_chars", F.sha2("edited", 256).alias("edited_sha256"), F.base64("fingerprint").alias("fingerprint"), F.base64("edited_fingerprint").alias("edited_fingerprint"), "near_edited", "near_next")


def op8_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    from casewise.llm.quality import quality

    return quality(read(spark, sf_dir, "documents"), read(spark, sf_dir, "labels"))


def op9_minhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from casewise.llm.minhash import near_duplicates

    return near_duplicates(read(spark, sf_dir, "documents"))


OP9_SQL = r"""
WITH RECURSIVE words AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents),
shingle AS (
  SELECT DISTINCT doc_id, array_to_string(w[i : i + 4], ' ') AS s FROM (SELECT doc_id, w, unnest(range(1, greatest(2, len(w) - 3))) AS i FROM words WHERE len(w) > 0)),
size AS (SELECT doc_id, count(*) AS n FROM shingle GROUP BY 1),
link AS (
  SELECT i, j FROM (SELECT a.doc_id AS i, b.doc_id AS j, count(*) AS both_ FROM shingle a JOIN shingle b USING (s) WHERE a.doc_id <> b.doc_id GROUP BY 1, 2)
  JOIN size x ON x.doc_id = i JOIN size y ON y.doc_id = j WHERE 100 * both_ >= 75 * (x.n + y.n - both_)),
reach AS (SELECT doc_id AS i, doc_id AS j FROM documents UNION SELECT r.i, l.j FROM reach r JOIN link l ON l.i = r.j)
SELECT c.doc_id, coalesce(n, 0) AS n_shingles, component_id, c.doc_id = component_id AS kept
FROM (SELECT i AS doc_id, min(j) AS component_id FROM reach GROUP BY 1) c LEFT JOIN size USING (doc_id)
"""


def op10_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    from casewise.llm.secretscan import scan_places

    found = scan_places(read(spark, sf_dir, "documents"))
    return found.select("doc_id", "start", F.char_length("candidate").alias("length"), F.crc32(F.col("candidate").cast("binary")).alias("candidate_crc32"), held_out(F.col("doc_id")).alias("held_out"), F.col("label").cast("int").alias("rule_label"), F.round("score", 6).alias("score"), "secret")


def op11_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    from casewise.llm.tokenfiles import read_digests, token_index, write_token_files

    folder = f"{checkpoint_folder(spark)}/tokens-{uuid.uuid4().hex}"
    docs = read(spark, sf_dir, "documents")
    files = write_token_files(docs, folder, public_tokenizers.path("byte_bpe_50k.json"))
    return read_digests(token_index(files, docs.schema["doc_id"].dataType.simpleString()))


def op12_conversation_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    from casewise.llm.repair import damage, repair_report

    turns = read(spark, sf_dir, "conversations")
    report = repair_report(damage(turns)).withColumnRenamed("conv_id", "_conv")
    # a conversation whose rows were all dropped has nothing to repair
    found = turns.select("conv_id").distinct().join(report, F.col("conv_id").eqNullSafe(F.col("_conv")), "left")
    counts = [F.coalesce(c, F.lit(0).cast("long")).alias(c) for c in ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")]
    return found.select("conv_id", *counts, F.coalesce("audit", F.lit("")).alias("audit"), F.coalesce("repaired_sha256", F.sha2(F.lit(""), 256)).alias("repaired_sha256"))


def op13_filter_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    from casewise.llm.filters import filter_audit

    return filter_audit(read(spark, sf_dir, "documents"), read(spark, sf_dir, "labels"))


OP13_SQL = r"""
WITH body AS (SELECT doc_id, coalesce(source, '') AS part, coalesce(text, '') AS t, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
known AS (SELECT doc_id, max(CASE WHEN quality = 1 THEN 1 ELSE 0 END) AS good, max(CASE WHEN toxic = 1 THEN 1 ELSE 0 END) AS toxic FROM labels GROUP BY doc_id),
fails AS (
  SELECT part, coalesce(good, 0) AS good, coalesce(toxic, 0) AS toxic,
    [len(w) < 200, 100 * len(list_distinct(w)) < 50 * len(w), 100 * (length(t) - length(regexp_replace(t, '[A-Z]', '', 'g'))) > 2 * length(t),
     regexp_matches(t, '[#$%&*|]'), coalesce(b.doc_id > min(b.doc_id) OVER (PARTITION BY t), false)] AS f
  FROM body b LEFT JOIN known k ON b.doc_id = k.doc_id),
counts AS (SELECT part, f, count(*) AS n, sum(good) AS good, sum(toxic) AS toxic FROM fails GROUP BY ALL),
x AS (SELECT unnest([1, 2, 3, 4, 5]) AS k),
orders AS (
  SELECT [a.k, b.k, c.k, d.k, e.k] AS o FROM x a, x b, x c, x d, x e WHERE len(list_distinct([a.k, b.k, c.k, d.k, e.k])) = 5),
steps AS (SELECT o, array_to_string(list_transform(o, lambda i: 'ABCDE'[i]), '') AS filter_order, k AS step, o[k] AS own FROM orders, x),
found AS (
  SELECT part, filter_order, step, own, n, good, toxic, f[own] AS fail, len(list_filter(o[1 : step - 1], lambda i: f[i])) > 0 AS gone, len(list_filter(f, lambda y: y)) = 1 AS alone
  FROM counts, steps),
summed AS (
  SELECT part, filter_order, step, own, sum(CASE WHEN NOT gone AND NOT fail THEN n ELSE 0 END) AS kept, sum(CASE WHEN NOT gone AND fail THEN n ELSE 0 END) AS removed,
    sum(CASE WHEN gone AND fail THEN n ELSE 0 END) AS redundant, sum(CASE WHEN fail AND alone THEN n ELSE 0 END) AS unique_fails,
    sum(CASE WHEN NOT gone AND fail THEN good ELSE 0 END) AS good_lost, sum(CASE WHEN NOT gone AND fail THEN toxic ELSE 0 END) AS toxic_lost
  FROM found GROUP BY ALL)
SELECT part, filter_order, CAST(step AS INTEGER) AS step, CAST(kept AS BIGINT) AS kept, CAST(removed AS BIGINT) AS removed, CAST(redundant AS BIGINT) AS redundant,
  CAST(unique_fails AS BIGINT) AS unique_fails, CAST(good_lost AS BIGINT) AS good_lost, CAST(toxic_lost AS BIGINT) AS toxic_lost,
  CAST(sum(removed) OVER (PARTITION BY part, own) AS BIGINT) AS shapley
FROM summed
"""


def queries() -> dict[str, Query]:
    return {f.__name__: f for f in (op1_best_fit_packing, op2_histogram_sharding, op3_toxicity, op4_line_dedup, op5_mixing, op6_vector_near_dedup, op7_fingerprints, op8_quality, op9_minhash_near_dedup, op10_secret_scan, op11_token_files, op12_conversation_repair, op13_filter_audit)}


def oracle_sql() -> dict[str, str]:
    return {"op4_line_dedup": OP4_SQL, "op6_vector_near_dedup": OP6_SQL, "op9_minhash_near_dedup": OP9_SQL, "op13_filter_audit": OP13_SQL}

"""Operator 10, secret scans: candidates found by pattern, false positives removed by a random forest.

All of it is DataFrame operations. A candidate is a run of at least 16 characters that keys are made of (parts joined
by dots are one), a quoted value of at least 6 characters that is assigned to a secret's name, or the password of a
URL. What the forest sees of it is its length, shares of character kinds, how likely its character transitions are in
the corpus' words, how often the kind of character changes, how many different characters it has, how much of it those
words cover, whether it is part of a path, and which words stand beside it.

The forest learns from labelled findings. Where none are given, `rule_labels` labels findings by what the forest does
not see: assigned to a secret's name or in a well-known format of keys, and so is every other place of that string, on
one side; in the middle of a sentence on the other. So a value that is assigned to `token` but reads like words is
found to be none, which the rule alone would report, and a key in a sentence is found. Stated placeholders are no
secrets whatever the forest says; these are words of the candidate itself.

A finding is a place of a candidate in a document; each place has its own offset, neighbours and score. `scan` gives
one place, the likeliest (the first of equals), for each candidate of a document. Null and empty texts have none.
Texts are scanned whole. Rows with the same doc_id and text give the same finding once; those with the same doc_id and
other texts give theirs, and a null doc_id is one like others. Other columns are left behind, whatever their names. An
empty table, or one without labelled findings of both kinds, gives findings with a null score and the rules' own answer.
"""

from __future__ import annotations

import math

from pyspark.ml.classification import RandomForestClassificationModel, RandomForestClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from casewise.llm.common import cut, hash_limit, held_out, hot_join

#: Words beside a candidate.
SECRET_WORDS = "password|passwd|pwd|token|secret|api.?key|access.?key|auth|bearer|credential|private"
HASH_WORDS = "sha1|sha256|md5|commit|checksum|digest|uuid|revision|etag|hash"
CODE_WORDS = "function|const|import|class|return|def |var "
NUMBER_WORDS = "card|order|phone|iban|isbn|serial|number|ticket"
PLACEHOLDERS = "example|sample|dummy|placeholder|changeme|your|xxxx|test"
#: Formats of keys that are beyond doubt.
FORMATS = r"^(AKIA[0-9A-Z]{16}|gh[pousr]_[A-Za-z0-9]{36}|xox[abprs]-[A-Za-z0-9-]{10,}|AIza[0-9A-Za-z_\-]{35}|sk_live_[0-9a-zA-Z]{24,})$"
KEY = r"[A-Za-z0-9+/_\-]{16,}"
QUOTED = r"(?<=[\"'])(?<=(?i:password|passwd|pwd|token|secret|key)[\"']?\s{0,3}[=:]\s{0,3}[\"'])[^\s\"']{6,}(?=[\"'])"
IN_URL = r"(?<=:)(?<=://[^\s:/@]{1,64}:)[^\s:/@]{6,}(?=@)"
CANDIDATE = rf"{QUOTED}|{IN_URL}|(?<![\p{{L}}\p{{N}}+/_\-]){KEY}(?:\.{KEY})*={{0,2}}(?!\p{{L}})"
#: Characters before and after a candidate that count as beside it, and the fewest of a candidate.
BESIDE, LEAST = 40, 6
#: Words of the dictionary; trees and their depth; labelled findings that a fit takes at most.
DICTIONARY, TREES, DEPTH, SAMPLE = 400, 20, 6, 20_000
#: Candidates whose lengths are summed at a time.
BLOCK = 256

FEATURES = ["length", "digits", "uppers", "lowers", "transitions", "changes", "distinct", "covered", "slashes", "in_path", "hash_word", "code_word", "number_word"]


def dictionary(docs: DataFrame, words: int = DICTIONARY) -> dict[str, int]:
    """The most frequent words of at least three letters with their counts over all documents; a table of fixed size."""
    found = docs.select(F.explode(F.regexp_extract_all(F.lower("text"), F.lit(r"\b\p{L}{3,}\b"), 0)).alias("word"))
    return {r[0]: r[1] for r in found.groupBy("word").count().orderBy(F.desc("count"), "word").limit(words).collect()}


def transition_table(words: dict[str, int]) -> list[float]:
    """Log probability of the kind of a character (a-z, digit, other) after another's, over the words; row by row."""
    kinds = 28
    counts = [[0.5] * kinds for _ in range(kinds)]
    for word, n in words.items():
        at = [ord(c) - 97 if "a" <= c <= "z" else 26 if c.isdigit() else 27 for c in word]
        for a, b in zip(at, at[1:], strict=False):
            counts[a][b] += n
    return [math.log(x / sum(row)) for row in counts for x in row]


def likely(text: Column, table: list[float]) -> Column:
    """Mean of the table's values over the character pairs of text."""
    code = F.transform(F.split(F.lower(text), ""), lambda c: F.ascii(c))
    kind = F.transform(code, lambda c: F.when((c >= 97) & (c <= 122), c - 97).when((c >= 48) & (c <= 57), 26).otherwise(27))
    values = F.array(*(F.lit(round(x, 6)) for x in table))
    pairs = F.zip_with(F.slice(kind, 1, F.size(kind) - 1), F.slice(kind, 2, F.size(kind) - 1), lambda a, b: F.get(values, a * 28 + b))
    return F.aggregate(pairs, F.lit(0.0), lambda t, x: t + x) / (F.size(kind) - 1)


def running(lengths: Column) -> Column:
    """0 and the sums of the first 1, 2, ... of `lengths`."""
    return F.aggregate(lengths, F.array(F.lit(0)), lambda a, x: F.concat(a, F.array(F.element_at(a, -1) + x)))


def findings(docs: DataFrame) -> DataFrame:
    """doc_id, candidate, start (from 0), before and after: every place of a candidate.

    The text is split by the pattern, so that offsets are running lengths of gaps and candidates. These are summed
    in blocks, since each step of a running sum copies what it has.
    """
    pattern = F.lit(CANDIDATE)
    parts = docs.where(F.col("text").rlike(CANDIDATE)).select("doc_id", F.regexp_extract_all("text", pattern, 0).alias("c"), F.split("text", CANDIDATE, -1).alias("g"))
    steps = F.zip_with("c", F.slice("g", 2, F.size("c")), lambda c, g: F.char_length(c) + F.char_length(g))
    parts = parts.withColumn("steps", steps)
    blocks = F.transform(F.sequence(F.lit(0), F.floor((F.size("c") - 1) / BLOCK).cast("int")), lambda k: F.slice("steps", k * BLOCK + 1, BLOCK))
    parts = parts.withColumn("blocks", blocks)
    before_block = F.slice(running(F.transform("blocks", lambda b: F.aggregate(b, F.lit(0), lambda a, x: a + x))), 1, F.size("blocks"))
    offsets = F.flatten(F.zip_with("blocks", before_block, lambda b, at: F.transform(F.slice(running(b), 1, F.size(b)), lambda x: x + at)))
    parts = parts.withColumn("offsets", offsets)

    def text(k: Column, after: bool = False) -> Column:
        """The k-th candidate with the gap before or after it; empty outside the document."""
        gap, own = F.coalesce(F.get("g", k + int(after)), F.lit("")), F.coalesce(F.get("c", k), F.lit(""))
        return F.concat(own, gap) if after else F.concat(gap, own)

    def place(candidate: Column, k: Column) -> Column:
        # so many candidates are more than BESIDE
        more = range(1, BESIDE // LEAST + 2)
        before = F.right(F.concat(*(text(k - n) for n in reversed(more)), F.get("g", k)), F.lit(BESIDE))
        after = F.left(F.concat(F.get("g", k + 1), *(text(k + n, True) for n in more)), F.lit(BESIDE))
        start = F.char_length(F.get("g", F.lit(0))) + F.get("offsets", k)
        return F.struct(candidate.alias("candidate"), start.alias("start"), F.lower(before).alias("before"), F.lower(after).alias("after"))

    return parts.select("doc_id", F.inline(F.transform("c", place))).distinct()


def featured(found: DataFrame, words: dict[str, int]) -> DataFrame:
    text, length = F.col("candidate"), F.char_length("candidate").cast("double")

    def share(pattern: str) -> Column:
        return F.regexp_count(text, F.lit(pattern)) / length

    def has(where: Column, pattern: str) -> Column:
        return F.when(where.rlike(pattern), 1.0).otherwise(0.0)

    rest = F.regexp_replace(F.lower(text), "|".join(sorted(words, key=lambda w: (-len(w), w))), "") if words else text
    around = F.concat_ws(" ", "before", "after")
    made = {
        "length": length,
        "digits": share("[0-9]"),
        "uppers": share("[A-Z]"),
        "lowers": share("[a-z]"),
        "transitions": likely(text, transition_table(words)),
        "changes": share("(?<=[a-z])(?=[A-Z0-9])|(?<=[A-Z])(?=[a-z0-9])|(?<=[0-9])(?=[A-Za-z])"),
        "distinct": F.size(F.array_distinct(F.split(text, ""))) / length,
        "covered": 1 - F.char_length(rest) / length,
        "slashes": share("/"),
        "in_path": has(F.concat("before", F.lower(text)), r"(://|[./\\])[^\s]*/[^\s]*$"),
        "hash_word": has(around, HASH_WORDS),
        "code_word": has(around, CODE_WORDS),
        "number_word": has(around, NUMBER_WORDS),
        "placeholder": has(F.lower(text), rf"(?<!\p{{L}})({PLACEHOLDERS})(?!\p{{L}})"),
    }
    return found.select("*", *(c.alias(k) for k, c in made.items()))


def rule_labels(rows: DataFrame) -> DataFrame:
    """rows with `label`: 1, 0, or null where the rules leave it open. They use nothing of FEATURES."""
    before, after = F.col("before"), F.col("after")
    named = before.rlike(SECRET_WORDS)
    assigned = before.rlike(r"[=:]\s{0,3}[\"']?$")
    sure = F.col("candidate").rlike(FORMATS) | (assigned & named & (F.col("placeholder") == 0))
    in_sentence = (before.rlike(r"\p{L}[.,;!?]*\s$") | (before == "")) & (after.rlike(r"^[.,;!?]*\s+[\p{L}\"]") | after.rlike(r"^[.,;!?]*\s*$")) & ~named
    ruled = cut(rows.withColumn("label", F.when(sure, 1.0).when(in_sentence, 0.0)))
    # a string that is a secret in one place is one in all
    known = ruled.groupBy("candidate").agg(F.max(F.col("label") == 1).alias("_known"), F.count("*").alias("_rows"))
    met = hot_join(ruled, cut(known.where("_known")), ["candidate"], "_rows")
    return met.withColumn("label", F.when(F.col("_known"), 1.0).otherwise(F.col("label"))).drop("_known")


def train(labelled: DataFrame, most: int = SAMPLE, seed: int = 7) -> RandomForestClassificationModel | None:
    """A forest on at most about `most` labelled findings (`label` and the features), chosen by a hash; None without both kinds."""
    counts = {r[0]: r[1] for r in labelled.where("label is not null").groupBy("label").count().collect()}
    if len(counts) < 2:
        return None
    # rare secrets are not thinned by the mass of plain words
    shares = {k: min(1.0, most / 2 / n) for k, n in counts.items()}
    limit = F.when(F.col("label") == 1, hash_limit(shares[1.0])).otherwise(hash_limit(shares[0.0]))
    chosen = cut(labelled.where(F.col("label").isNotNull() & (F.xxhash64(F.lit("finding"), "doc_id", "candidate") <= limit)).select("label", *FEATURES))
    assembled = VectorAssembler(inputCols=FEATURES, outputCol="_vector").transform(chosen)
    return RandomForestClassifier(featuresCol="_vector", labelCol="label", numTrees=TREES, maxDepth=DEPTH, seed=seed).fit(assembled)


def scan(docs: DataFrame, labelled: DataFrame | None = None, words: dict[str, int] | None = None) -> DataFrame:
    """scan_places() with the likeliest place, the first of equals, for each candidate of a document."""
    found = scan_places(docs, labelled, words)
    rank = F.struct(F.col("secret"), F.coalesce("score", F.lit(-1.0)), -F.col("start"), F.col("before"), F.col("after"))
    return found.groupBy("doc_id", "candidate").agg(F.max_by(F.struct(*found.columns), rank).alias("_best")).select("_best.*")


def scan_places(docs: DataFrame, labelled: DataFrame | None = None, words: dict[str, int] | None = None) -> DataFrame:
    """doc_id, candidate, start, before, after, the features, label (the rules' answer or null), score, secret: a row for every place."""
    docs = docs.select("doc_id", "text")
    rows = cut(rule_labels(featured(findings(docs), dictionary(docs) if words is None else words)))
    model = train(rows.where(~held_out(F.col("doc_id"))) if labelled is None else labelled)
    if model is None:
        return rows.withColumn("score", F.lit(None).cast("double")).withColumn("secret", F.coalesce((F.col("label") == 1) & (F.col("placeholder") == 0), F.lit(False)))
    scored = model.transform(VectorAssembler(inputCols=FEATURES, outputCol="_vector").transform(rows))
    return scored.withColumn("score", vector_to_array("probability")[1]).withColumn("secret", (F.col("score") >= 0.5) & (F.col("placeholder") == 0)).select(*rows.columns, "score", "secret")

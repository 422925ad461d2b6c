"""Operator 8, quality: random-indexing word vectors, pooled per document, under a two-layer network.

Each word has a key, a hash of the whole word, and each key a fixed sparse random vector, its index vector. A key's word vector is the sum of the index vectors around its words, over all documents. A document is
the mean of its words' unit vectors, the mean of their squares and the mean of the products of neighbours. The network
(one hidden layer, numpy, Adam) is fitted to a bounded sample of labelled rows; a part of that sample, not used for
the weights, sets the temperature that calibrates its probabilities.

Labels, lang, source and doc_id give no feature. A null or empty text has the zero vector. Texts are taken whole.
Repeated rows are scored each. With labels of one class or none the score is 1 or 0 for that class (0 if there are
none). An empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from casewise.llm.common import bounded, cut, hash_limit, held_out

#: Keys (a power of two; key 0 stands between documents), numbers in a vector, non-zero ones in an index vector, words on each side.
KEYS, WIDTH, NONZERO, AROUND = 2**16, 32, 4, 2
#: Labelled rows that a fit takes at most, part of them for the temperature, hidden units, passes, and rows in a step.
SAMPLE, CALIBRATION, HIDDEN, PASSES, STEP = 20_000, 0.2, 32, 40, 256
WORDS_KEPT = 600_000

_KEYS: dict[bytes, int] = {}


def index_vectors() -> np.ndarray:
    random = np.random.default_rng(11)
    out = np.zeros((KEYS, WIDTH), np.int8)
    places = random.random((KEYS, WIDTH)).argsort(1)[:, :NONZERO]
    out[np.arange(KEYS)[:, None], places] = random.choice(np.array([-1, 1], np.int8), (KEYS, NONZERO))
    out[0] = 0
    return out


def keys_of(text: str) -> list[int]:
    words = text.encode("utf-8", "surrogatepass").split()
    if len(_KEYS) > WORDS_KEPT:
        _KEYS.clear()
    kept = _KEYS
    for w in words:
        if w not in kept:
            kept[w] = 1 + xxhash.xxh3_64_intdigest(w) % (KEYS - 1)
    return [kept[w] for w in words]


def flat_keys(texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
    """Keys of all texts with AROUND zeros after each, and how many each text has."""
    gap = [0] * AROUND
    lists = [keys_of(t or "") for t in texts]
    flat = np.fromiter((k for x in lists for part in (x, gap) for k in part), np.uint16, sum(map(len, lists)) + AROUND * len(lists))
    return flat, np.array([len(x) for x in lists])


def word_vectors(docs: DataFrame) -> np.ndarray:
    """KEYS x WIDTH unit vectors, from the neighbours of every word of docs."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        index, total = index_vectors(), np.zeros((KEYS, WIDTH), np.int64)
        for batch in batches:
            texts = batch.column(0).to_pylist()
            for at in range(0, len(texts), 200):
                flat, _ = flat_keys(texts[at : at + 200])
                own = index[np.concatenate([np.zeros(AROUND, np.uint16), flat, np.zeros(AROUND, np.uint16)])]
                n = len(flat)
                near = np.zeros((n, WIDTH), np.int16)
                for k in range(2 * AROUND + 1):
                    if k != AROUND:
                        near += own[k : k + n]
                order = flat.argsort(kind="stable")
                sorted_keys = flat[order]
                starts = np.flatnonzero(np.diff(sorted_keys, prepend=np.uint16(0)) | (np.arange(n) == 0))
                total[sorted_keys[starts]] += np.add.reduceat(near[order], starts, axis=0, dtype=np.int64)
        found = np.flatnonzero(total.any(1))
        found = found[found > 0]
        yield pa.RecordBatch.from_arrays([pa.array(found, pa.int32()), *(pa.array(total[found, k]) for k in range(WIDTH))], ["key", *(f"v{k}" for k in range(WIDTH))])

    columns = [f"v{k}" for k in range(WIDTH)]
    summed = docs.select("text").mapInArrow(count, "key int, " + ", ".join(f"{c} long" for c in columns)).groupBy("key").agg(*(F.sum(c).alias(c) for c in columns)).toArrow()  # KEYS rows at most
    out = np.zeros((KEYS, WIDTH), np.float32)
    if summed.num_rows:
        out[summed.column("key").to_numpy()] = np.stack([summed.column(c).to_numpy() for c in columns], 1)
    norm = np.linalg.norm(out, axis=1, keepdims=True)
    return np.divide(out, norm, out=out, where=norm > 0)


def pooled(docs: DataFrame, vectors: np.ndarray) -> DataFrame:
    """doc_id and the document's features."""
    sent = docs.sparkSession.sparkContext.broadcast(vectors)

    def pool(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 200):
                part = batch.slice(at, 200)
                flat, sizes = flat_keys(part.column(1).to_pylist())
                own = sent.value[flat]
                starts = np.concatenate([[0], np.cumsum(sizes + AROUND)[:-1]])
                beside = np.zeros_like(own)
                beside[:-1] = own[:-1] * own[1:]
                scale = 1 / np.maximum(sizes, 1)[:, None]
                parts = [np.add.reduceat(x, starts, axis=0) * scale for x in (own, own * own, beside)]
                rows = np.concatenate([*parts, np.log1p(sizes)[:, None]], 1).astype(np.float32)
                values = pa.FixedSizeListArray.from_arrays(pa.array(rows.ravel()), rows.shape[1]).cast(pa.list_(pa.float32()))
                yield pa.RecordBatch.from_arrays([part.column(0), values], ["doc_id", "features"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", "text").mapInArrow(pool, f"doc_id {kind}, features array<float>")


@dataclass
class Network:
    """Two layers and a temperature; mean and scale of its inputs."""

    mean: np.ndarray
    scale: np.ndarray
    first: np.ndarray
    second: np.ndarray
    temperature: float = 1.0

    def logit(self, rows: np.ndarray) -> np.ndarray:
        x = np.clip((rows - self.mean) / self.scale, -8, 8)
        hidden = np.maximum(0, x @ self.first[:-1] + self.first[-1])
        return hidden @ self.second[:-1] + self.second[-1]

    def probability(self, rows: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.logit(rows) / self.temperature, -60, 60)))


def train(rows: np.ndarray, labels: np.ndarray, seed: int = 3) -> Network:
    random = np.random.default_rng(seed)
    order = random.permutation(len(rows))
    apart = int(len(rows) * CALIBRATION)
    hold, use = order[:apart], order[apart:]
    width = rows.shape[1]
    net = Network(rows[use].mean(0), rows[use].std(0) + 1e-6, random.normal(0, (2 / width) ** 0.5, (width + 1, HIDDEN)), random.normal(0, (1 / HIDDEN) ** 0.5, HIDDEN + 1))
    x, y = np.clip((rows[use] - net.mean) / net.scale, -8, 8), labels[use]
    parameters = [net.first, net.second]
    state = [(np.zeros_like(p), np.zeros_like(p)) for p in parameters]
    step = 0
    for _ in range(max(PASSES, min(400, 4000 * STEP // max(1, len(use)) // 8))):
        shuffled = random.permutation(len(use))
        for at in range(0, len(use), STEP):
            pick = shuffled[at : at + STEP]
            hidden = np.maximum(0, x[pick] @ net.first[:-1] + net.first[-1])
            off = (1 / (1 + np.exp(-np.clip(hidden @ net.second[:-1] + net.second[-1], -60, 60))) - y[pick]) / len(pick)
            back = np.outer(off, net.second[:-1]) * (hidden > 0)
            slopes = [np.vstack([x[pick].T @ back, back.sum(0)]) + 1e-4 * net.first, np.append(hidden.T @ off, off.sum()) + 1e-4 * net.second]
            step += 1
            for p, g, (m, v) in zip(parameters, slopes, state, strict=True):
                m += 0.1 * (g - m)
                v += 0.001 * (g * g - v)
                p -= 0.003 * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.999**step)) + 1e-8)
    if len(hold) and 0 < labels[hold].mean() < 1:
        logit, sign = net.logit(rows[hold]), 2 * labels[hold] - 1
        net.temperature = float(min(np.geomspace(0.25, 10, 75), key=lambda t: np.logaddexp(0, -sign * logit / t).mean()))
    return net


def quality(docs: DataFrame, labels: DataFrame, label: str = "quality", sample: int = SAMPLE) -> DataFrame:
    """doc_id, held_out, score, predicted (score at least 0.3)."""
    features = cut(pooled(docs, word_vectors(docs)))
    known = labels.where(F.col(label).isNotNull() & ~held_out(F.col("doc_id"))).groupBy("doc_id").agg(F.max(label).cast("int").alias("label"))
    share = min(1.0, sample / max(1, known.count()))
    chosen = known.where(F.xxhash64(F.lit("sample"), "doc_id") <= hash_limit(share))
    joined = cut(features.join(chosen, "doc_id").select("doc_id", "features", "label"))
    # repeated doc_ids can bring more rows than ids were chosen
    joined = bounded(joined, joined.count(), 2 * sample)
    rows = joined.orderBy("doc_id", "label", "features").select("features", "label").toArrow()  # about twice `sample` rows at most
    y = rows.column("label").to_numpy().astype(float) if rows.num_rows else np.zeros(0)
    held = held_out(F.col("doc_id")).alias("held_out")
    if not len(y) or y.mean() in (0, 1):
        score = F.lit(float(y.mean()) if len(y) else 0.0)
        return features.select("doc_id", held, score.alias("score"), (score >= 0.3).cast("int").alias("predicted"))
    x = np.array(rows.column("features").combine_chunks().flatten().to_numpy(), float).reshape(len(y), -1)
    sent = docs.sparkSession.sparkContext.broadcast(train(x, y))

    @F.pandas_udf("double")
    def of(values):
        return type(values)(sent.value.probability(np.stack(values.to_numpy()).astype(float)) if len(values) else [], index=values.index, dtype=float)

    scored = features.select("doc_id", held, of("features").alias("score"))
    return scored.select("doc_id", "held_out", "score", (F.col("score") >= 0.3).cast("int").alias("predicted"))

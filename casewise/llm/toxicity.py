"""Operator 3, toxicity: a counterfactually regularised linear classifier.

Features of a document are its distinct words and their beginnings of 4, 5 and 6 characters, hashed to 60 bits. Of
those in a bounded sample of labelled rows, the ones that tell the classes apart best are kept, beside those of the
names of groups. A logistic model is fitted to them with two penalties: one on absolute weights, which leaves few of
them, and one on counterfactuals, so that a group's name alone moves no score. Counterfactuals are made of the labelled
sentences. Where one names a group, the name is swapped for the others of its kind in its language; where it names
none, a name that a hash of the sentence picks is put into it, as a neutral mention. The squared change of score is
penalised. Two sentences with the same change count as one of twice the weight, and changes concern features of names
only, so that what is fitted on grows with the list of names and not with the texts.

Labels, lang, source and doc_id give no feature. A null or empty text has none and gets the score of the intercept.
Texts are taken whole. Repeated rows are scored each, rows without a doc_id as well; those are held out. Equal texts
have equal scores; a score of exactly 0.5 is toxic. `mention_change` is the most that a score moves when one of the
names is put into the text; it shows what the penalty leaves. Where rows of a doc_id have both labels it counts as toxic. With
labels of one class or none the score is near 1 or 0 for that class (0 if there are none). Other columns stay,
whatever their names. An empty table gives no rows.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from casewise.llm.common import bounded, cut, hash_limit, held_out, unused

#: Labelled documents that a fit takes at most (rows: twice as many, should doc_ids repeat), features it keeps at most, and rows in which a feature must be.
SAMPLE, FEATURES, LEAST = 20_000, 4096, 3
#: Weights of the counterfactual penalty and of the penalty on absolute weights (over the root of the rows); steps of the fit.
COUNTERFACTUAL, LASSO, STEPS = 10.0, 0.03, 400
#: Words that a worker keeps: with their features while it learns, with their weights while it scores.
LEARNT_KEPT, WORDS_KEPT = 200_000, 500_000
#: Names of groups, by language and kind; those in one list are swapped for each other.
IDENTITY = {
    "en religion": ["muslim", "christian", "jewish", "hindu", "buddhist", "catholic", "atheist"],
    "en gender": ["women", "men", "girls", "boys"],
    "en origin": ["african", "asian", "european", "mexican", "american", "chinese", "arab", "turkish", "polish", "german", "french"],
    "en colour": ["black", "white", "brown"],
    "en orientation": ["gay", "lesbian", "straight", "bisexual", "queer", "transgender", "heterosexual"],
    "en age": ["old", "young", "elderly", "teenage"],
    "en ability": ["blind", "deaf", "disabled", "autistic", "sighted"],
    "de religion": ["muslim", "christ", "jude", "hindu", "buddhist", "katholik", "atheist"],
    "de gender": ["frauen", "männer", "mädchen", "jungen"],
    "de origin": ["afrikaner", "asiate", "europäer", "türke", "pole", "deutscher", "araber", "flüchtlinge"],
    "de orientation": ["schwul", "lesbisch", "hetero", "bisexuell", "queer"],
    "fr religion": ["musulman", "chrétien", "juif", "hindou", "bouddhiste", "catholique", "athée"],
    "fr gender": ["femmes", "hommes", "filles", "garçons"],
    "fr origin": ["africain", "asiatique", "européen", "arabe", "turc", "polonais", "français", "réfugiés"],
    "fr orientation": ["gay", "lesbienne", "hétéro", "bisexuel", "homosexuel"],
    "es religion": ["musulmán", "cristiano", "judío", "hindú", "budista", "católico", "ateo"],
    "es gender": ["mujeres", "hombres", "chicas", "chicos"],
    "es origin": ["africano", "asiático", "europeo", "mexicano", "árabe", "chino", "refugiados"],
    "es orientation": ["gay", "lesbiana", "hetero", "bisexual", "homosexual"],
}
PUNCTUATION = b"!\"#$%&'()*+,-./:;<=>?@[\\]^_`{|}~"


def word_features(word: bytes) -> tuple[int, ...]:
    core = word.strip(PUNCTUATION)
    if not core:
        return ()
    text = core.decode("utf-8", "replace")
    names = ["w " + text, *(f"p {text[:k]}" for k in (4, 5, 6) if len(text) > k)]
    return tuple(xxhash.xxh3_64_intdigest(n) >> 4 for n in names)


_FEATURES: dict[bytes, tuple[int, ...]] = {}


def features(text: str) -> set[int]:
    words = set(text.encode("utf-8", "surrogatepass").lower().split())
    if len(_FEATURES) > LEARNT_KEPT:
        _FEATURES.clear()
    for w in words:
        if w not in _FEATURES:
            _FEATURES[w] = word_features(w)
    return set().union(*map(_FEATURES.__getitem__, words))


def terms_of(identity: dict[str, list[str]]) -> dict[bytes, list[bytes]]:
    """Each name with those that may stand in its place."""
    terms: dict[bytes, set[bytes]] = {}
    for group in identity.values():
        for a in group:
            terms.setdefault(a.encode(), set()).update(b.encode() for b in group if b != a)
    return {a: sorted(others) for a, others in terms.items()}


def counterfactuals(text: str, terms: dict[bytes, list[bytes]]) -> Counter:
    """(features that go, features that come) by how often, over the text's sentences."""
    found: Counter = Counter()
    names = sorted(terms)
    for sentence in text.replace("!", ".").replace("?", ".").replace("\n", ".").split("."):
        words = [w.strip(PUNCTUATION) for w in sentence.encode("utf-8", "surrogatepass").lower().split()]
        if not words or not names:
            continue
        named = [(at, word) for at, word in enumerate(words) if word in terms]
        for at, word in named:
            rest = set().union(*(word_features(x) for k, x in enumerate(words) if k != at))
            own = set(word_features(word)) - rest
            for other in terms[word]:
                new = set(word_features(other)) - rest
                found[tuple(sorted(own - new)), tuple(sorted(new - own))] += 1
        if not named:
            name = names[xxhash.xxh3_64_intdigest(b" ".join(words)) % len(names)]
            # only words that begin like the name can share a feature with it
            there = set().union(*(word_features(x) for x in words if x[:4] == name[:4]))
            found[(), tuple(sorted(set(word_features(name)) - there))] += 1
    return found


@dataclass
class ToxicityModel:
    weights: dict[int, float] = field(default_factory=dict)
    bias: float = 0.0

    def score(self, text: str | None) -> float:
        total = self.bias + sum(self.weights.get(x, 0.0) for x in features(text or ""))
        return 1 / (1 + np.exp(-total))


def learn(at: np.ndarray, which: np.ndarray, labels: np.ndarray, pairs: list[tuple[list[int], list[int], float]], width: int, counterfactual: float = COUNTERFACTUAL, lasso: float = LASSO, steps: int = STEPS) -> tuple[np.ndarray, float]:
    """Weights and intercept by Adam on all rows.

    at, which: the row and the number of each feature of each row; pairs: numbers of features that go and come, and a weight.
    """
    count = len(labels)
    share = np.array([n for _, _, n in pairs], float)
    share /= share.sum() or 1.0
    moves = [(k, x, s) for k, (gone, come, _) in enumerate(pairs) for s, xs in ((-1.0, gone), (1.0, come)) for x in xs]
    pair_at, pair_which, pair_sign = (np.array(x) for x in zip(*moves, strict=True)) if moves else (np.zeros(0, int), np.zeros(0, int), np.zeros(0))
    weights, rate = np.zeros(width + 1), labels.mean()
    weights[-1] = np.log(rate / (1 - rate))
    first, second = np.zeros(width + 1), np.zeros(width + 1)
    for step in range(1, steps + 1):
        margin = np.bincount(at, weights[which], count) + weights[-1]
        off = (1 / (1 + np.exp(-margin)) - labels) / count
        slope = np.bincount(which, off[at], width + 1)
        slope[-1] = off.sum()
        if moves:
            change = share * np.bincount(pair_at, pair_sign * weights[pair_which], len(pairs))
            slope += 2 * counterfactual * np.bincount(pair_which, pair_sign * change[pair_at], width + 1)
        first, second = 0.9 * first + 0.1 * slope, 0.99 * second + 0.01 * slope**2
        pace = 0.1 * min(1.0, 2 * (1 - step / (steps + 1))) / (np.sqrt(second / (1 - 0.99**step)) + 1e-8)
        weights -= pace * first / (1 - 0.9**step)
        weights[:-1] = np.sign(weights[:-1]) * np.maximum(0, np.abs(weights[:-1]) - pace[:-1] * lasso / count**0.5)
    return weights[:-1], float(weights[-1])


def labelled_sample(docs: DataFrame, labels: DataFrame, label: str, most: int) -> DataFrame:
    """text and label of at most about `most` labelled rows; none whose doc_id is held out. The choice hashes doc_id."""
    known = labels.where(F.col(label).isNotNull() & ~held_out(F.col("doc_id"))).groupBy("doc_id").agg(F.max(label).cast("int").alias("label"))
    share = min(1.0, most / max(1, known.count()))
    chosen = known.where(F.xxhash64(F.lit("sample"), "doc_id") <= hash_limit(share))
    return docs.select("doc_id", "text").join(chosen, "doc_id").select("doc_id", "text", "label")


def fit(docs: DataFrame, labels: DataFrame, label: str = "toxic", identity: dict[str, list[str]] | None = None, sample: int = SAMPLE, most: int = FEATURES, counterfactual: float = COUNTERFACTUAL) -> ToxicityModel:
    terms = terms_of(IDENTITY if identity is None else identity)
    always = {x for t in terms for x in word_features(t)}
    kind = pa.list_(pa.struct([("gone", pa.list_(pa.int64())), ("come", pa.list_(pa.int64())), ("n", pa.int64())]))

    def extract(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 500):
                part = batch.slice(at, 500)
                found, moved = [], []
                for text in part.column(0).to_pylist():
                    found.append(sorted(features(text or "")))
                    moved.append([{"gone": g, "come": c, "n": n} for (g, c), n in counterfactuals(text or "", terms).items()])
                yield pa.RecordBatch.from_arrays([part.column(1), pa.array(found, pa.list_(pa.int64())), pa.array(moved, kind)], ["label", "found", "moved"])

    chosen = labelled_sample(docs, labels, label, sample).select("text", "label")
    rows = cut(chosen.mapInArrow(extract, "label int, found array<bigint>, moved array<struct<gone: array<bigint>, come: array<bigint>, n: bigint>>"))
    # repeated doc_ids can bring more rows than ids were chosen
    rows = bounded(rows, rows.count(), 2 * sample)
    n = {r[0]: r[1] for r in rows.groupBy("label").count().collect()}
    toxic, clean = n.get(1, 0), n.get(0, 0)
    if not toxic or not clean:
        share = 1.0 if toxic else 0.0
        return ToxicityModel(bias=20.0 if share else -20.0)
    counts = rows.select("label", F.explode("found").alias("feature")).groupBy("feature").agg(F.sum("label").alias("bad"), F.count("*").alias("n"))
    rate = F.col("n") / (toxic + clean)
    apart = (F.col("bad") / toxic - (F.col("n") - F.col("bad")) / clean) / F.sqrt(rate * (1.0000001 - rate) * (1 / toxic + 1 / clean))
    best = counts.where(F.col("n") >= LEAST).select("feature", F.abs(apart).alias("apart")).orderBy(F.desc("apart"), "feature").limit(most).collect()
    names = sorted({r[0] for r in best} | always)
    number = {x: k for k, x in enumerate(names)}
    wanted = rows.sparkSession.sparkContext.broadcast(number)  # `most` and the identity terms' features at most

    def keep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = wanted.value
        for batch in batches:
            lists = [[known[x] for x in r if x in known] for r in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(lists, pa.list_(pa.int32()))], ["label", "found"])

    training = rows.select("label", "found").mapInArrow(keep, "label int, found array<int>").toArrow()  # about twice `sample` rows at most
    # changes are sets of features of names, so that there are at most as many as the list of names allows
    changes = rows.select(F.inline("moved")).groupBy("gone", "come").agg(F.sum("n")).orderBy("gone", "come").collect()
    pairs = [([number[x] for x in gone], [number[x] for x in come], n) for gone, come, n in changes]
    found = training.column("found").combine_chunks()
    at = np.repeat(np.arange(len(found)), pc.list_value_length(found).to_numpy(zero_copy_only=False))
    weights, bias = learn(at, found.flatten().to_numpy(), training.column("label").to_numpy().astype(float), pairs, len(names), counterfactual)
    return ToxicityModel({x: float(w) for x, w in zip(names, weights, strict=True) if w}, bias)


def moving_names(model: ToxicityModel, identity: dict[str, list[str]] | None = None) -> list[list[int]]:
    """Of each group's name that has features with a weight, these features."""
    found = ([x for x in word_features(t) if x in model.weights] for t in sorted(terms_of(IDENTITY if identity is None else identity)))
    return [xs for xs in found if xs]


def score(docs: DataFrame, model: ToxicityModel, column: str = "score", change: str | None = None) -> DataFrame:
    """docs with the probability that a text is toxic, and in `change`, if named, how far one more name moves it at most."""
    sent = docs.sparkSession.sparkContext.broadcast(model)
    names = moving_names(model)
    local: dict[bytes, tuple[int, ...]] = {}

    def both(texts):
        weights, bias = sent.value.weights, sent.value.bias
        out, low, high = [], [], []
        for text in texts:
            words = set(text.encode("utf-8", "surrogatepass").lower().split())
            if len(local) > WORDS_KEPT:
                local.clear()
            hits: set[int] = set()
            for w in words:
                known = local.get(w)
                if known is None:
                    known = local[w] = tuple(x for x in word_features(w) if x in weights)
                if known:
                    hits.update(known)
            out.append(bias + sum(weights[x] for x in sorted(hits)))
            moves = [sum(weights[x] for x in xs if x not in hits) for xs in names]
            low.append(min(moves, default=0.0))
            high.append(max(moves, default=0.0))
        probability = lambda z: 1 / (1 + np.exp(-np.clip(z, -700, 700)))
        z = np.array(out, float)
        p = probability(z)
        return p, np.maximum(np.abs(probability(z + np.array(low)) - p), np.abs(probability(z + np.array(high)) - p))

    text = F.coalesce("text", F.lit(""))
    if change is None:

        @F.pandas_udf("double")
        def of(texts):
            return type(texts)(both(texts)[0], index=texts.index)

        return docs.withColumn(column, of(text))

    @F.pandas_udf("score double, change double")
    def of_both(texts):
        p, moved = both(texts)
        return pd.DataFrame({"score": p, "change": moved}, index=texts.index)

    name = unused("_both", docs)
    scored = docs.withColumn(name, of_both(text))
    return scored.select(*docs.columns, F.col(f"{name}.score").alias(column), F.col(f"{name}.change").alias(change))


def toxicity(docs: DataFrame, labels: DataFrame, training: DataFrame | None = None) -> DataFrame:
    """doc_id, held_out, score, predicted, mention_change. training: the labelled documents' table, docs itself unless given."""
    model = fit(docs if training is None else training, labels)
    scored = score(docs.select("doc_id", "text"), model, change="mention_change")
    return scored.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"), "mention_change")


def drop_toxic(docs: DataFrame, labels: DataFrame, training: DataFrame) -> DataFrame:
    """The rows of docs that the model does not call toxic, with all their columns."""
    name = unused("_toxic", docs)
    return score(docs, fit(training, labels), name).where(F.col(name) < 0.5).select(docs.columns)

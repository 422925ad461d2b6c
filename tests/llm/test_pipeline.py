"""run() on a small corpus, each of its stages against plain Python on what the stage before it kept."""

import glob
import os
import random
import re
from collections import Counter

from pyspark.sql import functions as F

from casewise.llm import toxicity
from casewise.llm.common import checkpoint_folder

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, _toxic int, gone int, n_lines int"
WORD = re.compile(r"[^\x20\x09-\x0D]+")


def corpus(spark):
    r = random.Random(11)
    words = [f"word{k}" for k in range(300)]
    shared = [f"a line that many documents of this corpus hold, number {k}" for k in range(3)]
    rows, labels = [], []
    for k in range(240):
        toxic = k % 4 == 0
        text = [" ".join(r.choices(words, k=r.randint(3, 60)) + (["vile", "scum"] if toxic else [])) for _ in range(r.randint(1, 4))]
        if k % 3 == 1:
            text.insert(r.randint(0, len(text)), r.choice(shared))
        rows.append((k, "\n".join(text), "en", r.choice(["web", "book", None])))
        labels.append((k, 1, int(toxic)))
    base = [x for x in rows if x[0] % 4 == 1][:20]
    rows += [(1000 + k, x[1] + (" and more" if k % 2 else ""), "en", "web") for k, x in enumerate(base)]
    rows += [(2000, None, "en", "web"), (2001, "", "en", "book"), (2002, "word " * 6000, "en", "book"), (2003, "twice the same id", "en", "web"), (2003, "twice the same id", "en", "web"), (None, "no id at all but some words", "en", "web")]
    docs = spark.createDataFrame([(d, t, lang, s, len(t or ""), 7, 8, 9) for d, t, lang, s in rows], SCHEMA)
    return docs, spark.createDataFrame(labels, "doc_id long, quality int, toxic int")


def lines_kept(rows):
    key = lambda line: line.strip(" \t\n\x0b\x0c\r").lower()
    holders = {}
    for d, t in rows:
        for line in (t or "").split("\n"):
            if len(key(line)) >= 40 and d is not None:
                holders.setdefault(key(line), set()).add(d)
    out = []
    for d, t in rows:
        kept = [x for x in (t or "").split("\n") if d is None or len(holders.get(key(x), ())) < 5 or d == max(holders[key(x)])]
        out.append((d, t if kept == (t or "").split("\n") else "\n".join(kept)))
    return out


def near_kept(rows):
    sets = {}
    for d, t in rows:
        w = WORD.findall((t or "").lower())
        if d is not None:
            sets.setdefault(d, set()).update({tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))} if w else set())
    root = {d: d for d in sets}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    ids = sorted(sets)
    for i, a in enumerate(ids):
        for b in ids[i + 1 :]:
            if sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= 75 * len(sets[a] | sets[b]):
                x, y = sorted((find(a), find(b)))
                root[y] = x
    return [(d, t) for d, t in rows if d is None or find(d) == d]


def targets(sizes):
    weights = {s: (5, 2, 1)[k % 3] for k, s in enumerate(sorted(sizes, key=lambda s: (s is None, s or "")))}
    budget, open_, out = 1.5 * sum(sizes.values()), set(sizes), {}
    while open_:
        level = budget / sum(weights[s] for s in open_)
        full = {s for s in open_ if level * weights[s] > 2 * sizes[s]}
        if not full:
            return out | {s: level * weights[s] for s in open_}
        for s in full:
            out[s] = 2 * sizes[s]
            budget -= out[s]
        open_ -= full
    return out


def test_run_against_its_parts(spark, tmp_path):
    import corpus_pipeline

    docs, labels = corpus(spark)
    docs.repartition(3).write.parquet(f"{tmp_path}/documents.parquet")
    labels.write.parquet(f"{tmp_path}/labels.parquet")
    result = corpus_pipeline.run(spark, str(tmp_path)).collect()
    base = re.sub(r"^file:/*", "/", checkpoint_folder(spark))
    folder = max(glob.glob(f"{base}/pipeline-*"), key=os.path.getmtime)
    stages = []
    for k in range(4):
        stage = spark.read.parquet(f"{folder}/{k}")
        assert stage.columns == corpus_pipeline.COLUMNS
        stages.append([tuple(r) for r in stage.collect()])
    pairs = lambda rows: Counter((r[0], r[1]) for r in rows)

    start = [(r.doc_id, r.text) for r in docs.collect()]
    model = toxicity.fit(spark.read.parquet(f"{tmp_path}/documents.parquet"), labels)
    assert pairs(stages[0]) == pairs([(d, t) for d, t in start if model.score(t) < 0.5]) and len(stages[0]) < len(start)
    kept = lines_kept([r[:2] for r in stages[0]])
    assert pairs(stages[1]) == pairs(kept) and pairs(kept) != pairs(stages[0])
    assert all(n == len(t or "") for _, t, _, _, n in stages[1])
    kept = near_kept([r[:2] for r in stages[1]])
    assert pairs(stages[2]) == pairs(kept) and len(kept) < len(stages[1])

    sizes, taken, whole = Counter(), Counter(), {}
    for d, t, _, s, _ in stages[2]:
        sizes[s] += len(WORD.findall(t or ""))
        whole.setdefault((d, s), []).append(t or "")
    for d, t, _, s, _ in stages[3]:
        taken[s] += len(WORD.findall(t))
        assert any(full.startswith(t) for full in whole[d, s])
    for s, target in targets(sizes).items():
        assert abs(taken[s] - target) <= 1

    by = Counter((r[0]) for r in stages[3])
    assert set(by) == {r["doc_id"] for r in result}
    sequences = {}
    for r in result:
        sequences.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    for parts in sequences.values():
        here = 0
        for offset, length in sorted(parts):
            assert offset == here
            here += length
        assert here <= 2048
    assert Counter(r["doc_id"] for r in result if r["piece"] == 0) == by


def test_run_on_an_empty_table(spark, tmp_path):
    import corpus_pipeline

    docs, labels = corpus(spark)
    docs.where(F.lit(False)).write.parquet(f"{tmp_path}/documents.parquet")
    labels.where(F.lit(False)).write.parquet(f"{tmp_path}/labels.parquet")
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0

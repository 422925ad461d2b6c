"""Operator 13 against brute force over all orders; its tries and adaptive prefixes."""

import itertools
import random
import re

from casewise.llm import filters

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def failing(rows):
    """The filters that each row (doc_id, text, source) fails, by the contract's words."""
    out = []
    for key, text, _ in rows:
        t = text or ""
        words = WORD.findall(t)
        found = {"A"} if len(words) < 200 else set()
        found |= {"B"} if 100 * len(set(words)) < 50 * len(words) else set()
        found |= {"C"} if 100 * len(re.findall("[A-Z]", t)) > 2 * len(t) else set()
        found |= {"D"} if re.search(r"[#$%&*|]", t) else set()
        found |= {"E"} if key is not None and any(k is not None and k < key and (x or "") == t for k, x, _ in rows) else set()
        out.append(found)
    return out


def audit(rows, labels):
    good, toxic = ({d for d, *marks in labels if marks[k] == 1 and d is not None} for k in (0, 1))
    fails, out = failing(rows), []
    for part in {s or "" for _, _, s in rows}:
        mine = [(r[0], f) for r, f in zip(rows, fails, strict=True) if (r[2] or "") == part]
        shapley = dict.fromkeys("ABCDE", 0)
        steps = []
        for order in itertools.permutations("ABCDE"):
            for step, x in enumerate(order, 1):
                earlier = set(order[: step - 1])
                here = [d for d, f in mine if x in f and not f & earlier]
                shapley[x] += len(here)
                steps.append((part, "".join(order), step, sum(not f & (earlier | {x}) for _, f in mine), len(here), sum(x in f and bool(f & earlier) for _, f in mine), sum(f == {x} for _, f in mine), sum(d in good for d in here), sum(d in toxic for d in here)))
        out += [(*s, shapley[s[1][s[2] - 1]]) for s in steps]
    return sorted(out)


def crowd():
    rng = random.Random(7)
    words = [f"w{k}" for k in range(400)] + ["Big", "WORD", "a&b", "é", "日本"]
    base = [" ".join(rng.choices(words[: rng.choice([20, 405])], k=rng.randint(0, 400))) for _ in range(60)]
    rows = [(k, rng.choice(base), rng.choice(["web", "book", None, ""])) for k in range(150)]
    # one text in a third of all rows, and many texts that share 700 bytes
    rows += [(200 + k, "copied text " * 30, "web") for k in range(120)]
    rows += [(400 + k, "shared " * 100 + str(k // 2), "book") for k in range(60)]
    rows += [(None, base[0], "web"), (None, "copied text " * 30, "web"), (150, base[1], "web"), (150, base[1], "web"), (151, None, "x"), (152, "", "x"), (153, " \t\n", "x"), (154, "long " * 40_000, "book"), (155, "A" * 49 + "b" * 2401, "x"), (155, "A" * 50 + "b" * 2450, "x")]
    rng.shuffle(rows)
    labels = [(k, rng.choice([0, 1, None]), rng.choice([0, 1, None])) for k in range(0, 460, 2)] + [(4, 1, 0), (6, 0, 1), (None, 1, 1)]
    return rows, labels


def test_against_brute_force(spark):
    rows, labels = crowd()
    docs = spark.createDataFrame([(*r, 1, "x") for r in rows], "doc_id long, text string, source string, mask int, part string").repartition(5)
    known = spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    columns = ["part", "filter_order", "step", "kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost", "shapley"]
    assert sorted(tuple(r[c] for c in columns) for r in filters.filter_audit(docs, known).collect()) == audit(rows, labels)


def test_masks_of_each_row(spark):
    rows, _ = crowd()
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string")
    want = sorted((str(r[0]), r[2] or "", sum(1 << "ABCDE".index(x) for x in f)) for r, f in zip(rows, failing(rows), strict=True))
    assert sorted((str(r["doc_id"]), r["part"], r["mask"]) for r in filters.failed_filters(docs).collect()) == want


def test_heavy_texts_are_dealt_over_tasks(spark):
    from pyspark.sql import functions as F

    rows = [(k, "one text that everybody copies", "x") for k in range(4000)] + [(k, f"{'the same beginning of all ' * 20}{k}", "x") for k in range(4000, 8000)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, part string")
    tasks = filters.dealt(docs).withColumn("task", F.spark_partition_id())
    counts = {r[0]: r[1] for r in tasks.groupBy("task").count().collect()}
    assert len(counts) == 4 and max(counts.values()) < 4000
    assert tasks.where("text like 'one text%'").select("task").distinct().count() > 1
    assert [r[0] for r in tasks.where("text like 'one text%'").select("least").distinct().collect()] == [0]


def test_trie_keeps_the_least_id():
    rng = random.Random(8)
    trie, least = filters.Trie(), {}
    ends = []
    for _ in range(3000):
        text = bytes(rng.choices(b"ab\x00\xff", k=rng.randint(0, 9)))
        key = rng.choice([None, rng.randint(0, 10**6)])
        ends.append((text, trie.insert(text, key)))
        if key is not None:
            least[text] = min(key, least.get(text, key))
    assert all(node[2] == least.get(text) for text, node in ends)


def test_empty_table(spark):
    docs = spark.createDataFrame([], "doc_id long, text string, source string")
    assert filters.filter_audit(docs, spark.createDataFrame([], "doc_id long, quality int, toxic int")).count() == 0

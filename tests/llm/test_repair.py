"""Operator 12 against trying all edits, against a plain table of states, and on the tables."""

import hashlib
import itertools
import os
import random
import re
import zlib

import pytest

from casewise.llm import queries, repair

FOLDER = "/root/testdata/sf0.001"
LEGAL = re.compile(r"(s?(ua)+)?")


def all_edits(rows):
    """(cost, audit, role initials) by trying everything with at most two inserts in one place."""
    gaps = ["", "u", "a", "ua", "au"]
    best = None
    for inserted in itertools.product(gaps, repeat=len(rows) + 1):
        for edits in itertools.product("KuaD", repeat=len(rows)):
            cost, audit, roles = 0, "", ""
            for k, (role, fault) in enumerate(rows):
                cost, audit, roles = cost + 3 * len(inserted[k]), audit + "I" * len(inserted[k]), roles + inserted[k]
                e = edits[k]
                if fault in ("blank", "duplicate") and e != "D":
                    break
                cost += {"K": 0, "D": 4}.get(e, 3) + 3 * (fault == "truncated" and e != "D")
                audit += e if e in "KD" else "R"
                roles += "" if e == "D" else (role[:1] or "?") if e == "K" else e
            else:
                cost, audit, roles = cost + 3 * len(inserted[-1]), audit + "I" * len(inserted[-1]), roles + inserted[-1]
                if LEGAL.fullmatch(roles) and (best is None or (cost, audit) < best[:2]):
                    best = (cost, audit, roles)
    return best


def by_states(rows):
    """(cost, audit, role initials) with a table of the states of the regular expression, whole audits in each."""
    step = {("", "s"): "s", ("", "u"): "u", ("s", "u"): "u", ("u", "a"): "a", ("a", "u"): "u"}

    def put(table, state, value):
        if state not in table or value < table[state]:
            table[state] = value

    def inserts(table):
        for _ in range(4):
            for state, (cost, audit, roles) in list(table.items()):
                for t in "ua":
                    if (state, t) in step:
                        put(table, step[state, t], (cost + 3, audit + "I", roles + t))

    table = {"": (0, "", "")}
    for role, fault in rows:
        inserts(table)
        new = {}
        for state, (cost, audit, roles) in table.items():
            put(new, state, (cost + 4, audit + "D", roles))
            if fault not in ("blank", "duplicate"):
                for t, price, letter in ((role[:1], 0, "K"), ("u", 3, "R"), ("a", 3, "R")):
                    if (state, t) in step:
                        put(new, step[state, t], (cost + price + 3 * (fault == "truncated"), audit + letter, roles + t))
        table = new
    inserts(table)
    return min(table[s] for s in ("", "a") if s in table)


def faults(rows):
    found, seen = [], set()
    for role, text in rows:
        body = text.strip(" \t\n\x0b\x0c\r")
        found.append("blank" if not body else "duplicate" if (role, text) in seen else "truncated" if body[-1] not in ".!?" else None)
        seen.add((role, text))
    return found


def report(rows):
    """The contract's columns of one conversation, rows (turn, role, text) in order."""
    kinds = faults([r[1:] for r in rows])
    cost, audit, roles = by_states([(r[1], k) for r, k in zip(rows, kinds, strict=True)])
    out, at, used = [], 0, 0
    for letter in audit:
        role, text = (None, "") if letter == "I" else rows[at][1:]
        at += letter != "I"
        if letter != "D":
            out.append(f"{role if letter == 'K' else {'u': 'user', 'a': 'assistant'}[roles[used]]}:{text}")
            used += 1
    turns = [r[0] for r in rows if r[0] is not None]
    initials = [r[1][:1] for r in rows]
    illegal = sum(a + b not in ("su", "ua", "au") for a, b in itertools.pairwise(initials))
    gaps = max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0
    return (gaps, *(kinds.count(f) for f in repair.FAULTS), illegal, cost, audit, hashlib.sha256("\n".join(out).encode()).hexdigest())


def parsed(rows):
    r = repair.Repair()
    out = []
    for k, (role, fault) in enumerate(rows):
        out += r.add(k, role, {None: "x.", "blank": "", "truncated": "x", "duplicate": "x."}[fault], fault == "duplicate")
    cost, more = r.end()
    return cost, "".join(r.audit), "".join(x[1][:1] for x in out + more if x[3] != "D")


def test_tables_accept_the_language():
    for n in range(7):
        for word in itertools.product("sua", repeat=n):
            stack = (0,)
            for t in (*word, "$"):
                stack = stack and repair.shifted(stack, t)
            assert bool(stack) == bool(LEGAL.fullmatch("".join(word)))


def test_against_all_edits():
    rng = random.Random(3)
    for _ in range(40):
        rows = [(rng.choice(["system", "user", "assistant", "tool", ""]), rng.choice([None, None, "truncated", "blank", "duplicate"])) for _ in range(rng.randint(0, 3))]
        assert parsed(rows) == all_edits(rows) == by_states(rows), rows


def test_against_states_on_long_conversations():
    rng = random.Random(4)
    for _ in range(400):
        weights = rng.choice([(8, 1, 1, 1), (1, 4, 1, 1), (1, 1, 1, 1)])
        rows = [(rng.choice(["user", "assistant", "user", "assistant", "system", "x"]), rng.choices([None, "truncated", "blank", "duplicate"], weights)[0]) for _ in range(rng.randint(1, 60))]
        assert parsed(rows) == by_states(rows), rows


def test_open_rows_stay_few():
    rng = random.Random(5)
    r, most = repair.Repair(), 0
    for k in range(20_000):
        r.add(k, rng.choice(["user", "assistant", "system"]), rng.choice(["x.", "x", ""]), rng.random() < 0.1)
        most = max(most, len(r.waiting))
    assert most < 200


def rows_of(df):
    return df.select("conv_id", "turn", "role", "text").collect()


def wanted(rows):
    by = {}
    for c, turn, role, text in rows:
        by.setdefault(c, []).append((turn, role if role is not None else " ", text if text is not None else " "))
    return {c: report(sorted(v, key=lambda r: (r[0] is not None, r[0] or 0, r[1], r[2]))) for c, v in by.items()}


def odd_turns(spark):
    rng = random.Random(6)
    rows = [(1, None, "user", "a."), (1, None, None, None), (1, 5, "user", "a."), (2, 3, "assistant", "long " * 20_000 + "."), (None, 1, "user", "x."), (None, 2, "assistant", "y!"), (None, 2, "assistant", "y!"), (3, 1, "", "?")]
    rows += [(4, k, "user" if k % 2 else "assistant", "same text.") for k in range(300)]
    rows += [(rng.randint(5, 40), rng.choice([None, *range(9)]), rng.choice(["system", "user", "assistant", None]), rng.choice(["One.", "Two", " ", "Drei!", "Vier", None])) for _ in range(400)]
    return spark.createDataFrame([(t, *r) for r, t in zip(rows, itertools.cycle(["x", None]), strict=False)], "since string, conv_id long, turn long, role string, text string")


def test_report_with_nulls_ties_and_repeats(spark):
    turns = odd_turns(spark)
    got = {r["conv_id"]: tuple(r)[1:] for r in repair.repair_report(turns).collect()}
    assert got == wanted(rows_of(turns))


def test_turns_spell_the_grammar(spark):
    turns = odd_turns(spark)
    audits = {r["conv_id"]: r["audit"] for r in repair.repair_report(turns).collect()}
    by = {}
    for r in repair.repaired_turns(turns).collect():
        by.setdefault(r["conv_id"], []).append(r)
    for conv, rows in by.items():
        rows.sort(key=lambda r: r["position"])
        assert "".join(r["edit"] for r in rows) == audits[conv]
        assert LEGAL.fullmatch("".join(r["role"][:1] for r in rows if r["edit"] != "D"))
        assert all(r["text"] == "" for r in rows if r["edit"] == "I")


def test_empty_table(spark):
    none = spark.createDataFrame([], "conv_id long, turn long, role string, text string")
    assert repair.repair_report(repair.damage(none)).count() == 0 and repair.repaired_turns(none).count() == 0


def damaged(rows):
    for c, turn, role, text in rows:
        role, text = (" " if x is None else x for x in (role, text))
        kind = zlib.crc32(f"{' ' if c is None else c}:{' ' if turn is None else turn}".encode()) % 20
        if kind:
            row = (c, turn, "user" if kind == 4 else role, "" if kind == 1 else re.sub("[.!?]", "", text) if kind == 2 else text)
            yield from [row] * (2 if kind == 3 else 1)


def check_query(spark, folder, rows):
    want = wanted(damaged(rows))
    none = (0, 0, 0, 0, 0, 0, "", hashlib.sha256(b"").hexdigest())
    columns = ("gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit", "repaired_sha256")
    got = queries.queries()["op12_conversation_repair"](spark, folder).collect()
    assert len(got) == len({r[0] for r in rows})
    assert {r["conv_id"]: tuple(r[c] for c in columns) for r in got} == {c: want.get(c, none) for c in {r[0] for r in rows}}


@pytest.mark.skipif(not os.path.isdir(FOLDER), reason="no test data")
def test_query_on_the_small_table(spark):
    check_query(spark, FOLDER, rows_of(spark.read.parquet(f"{FOLDER}/conversations.parquet")))


def test_query_with_dropped_conversations(spark, tmp_path):
    turns = odd_turns(spark).select("conv_id", "turn", "role", "text").union(spark.createDataFrame([(k, 0, "user", "Alone.") for k in range(100, 160)], "conv_id long, turn long, role string, text string"))
    turns.write.parquet(f"{tmp_path}/conversations.parquet")
    check_query(spark, str(tmp_path), rows_of(turns))

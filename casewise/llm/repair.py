"""Operator 12, conversation structure repair by generalised LR parsing with weighted edits.

The roles of a conversation must spell C in the grammar below, `(s?(ua)+)?` by their initials. A row is kept, given
another role or deleted, and empty turns may be put in anywhere; the cheapest edits win, of equal ones the audit (the
edits' initials in order) that is least in ASCII. Blank and repeated rows must go.

The parser runs all its stacks at once. SLR tables drive them: before a terminal is shifted, the stack is reduced as the
tables say. Delete leaves a stack as it is, keep and rerole shift a row's terminal, insert shifts one without a row.
Stacks with the same top state are merged by the least (cost, audit). That loses nothing, since here the top state alone
decides what may follow, and at one place of the input neither of two equally dear audits begins with the other. For the
same reason a stack that costs over SLACK more than the cheapest one can never win and goes. Reductions keep stacks
short, so each is a short tuple of states, and stacks share their reductions through a cache.

Spark marks the first of each (role, text) with an aggregate whose hot keys are met apart, deals rows by conversation and
sorts them by turn. A task reads that stream; of a conversation it holds the rows whose edit still differs between
stacks, usually a few, and the audit. Both the parse and the digest of the repaired text are sequential, so that one
conversation is one ordered stream, though never a group in memory.

Rows go by turn, nulls first, and within a turn by role and text. A null role or text is one space. A role's initial is
its first character as it is; only s, u and a can be kept. Rows that repeat are duplicates, also within a turn. A null
conv_id is a conversation like any other. Very long texts are taken whole. Other columns are left behind, whatever their
names. An empty table gives no rows.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import cache
from os.path import commonprefix

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from casewise.llm.common import SPACES, cut, hot_join, partitions

#: The grammar of role initials, and what edits cost.
GRAMMAR = (("C", ()), ("C", ("T",)), ("C", ("s", "T")), ("T", ("u", "a")), ("T", ("T", "u", "a")))
REROLE, DELETE, INSERT, TRUNCATED = 3, 4, 3, 3
ROLES = {"u": "user", "a": "assistant"}
#: From any stack what another one can read is read for at most this much more: two inserts and a deletion.
SLACK = 2 * INSERT + DELETE
FAULTS = ("blank", "duplicate", "truncated")
#: Turns of one output batch.
ROWS = 5000


@cache
def tables() -> tuple[dict, dict]:
    """SLR tables of the grammar: action[state, terminal] = ("shift", state) or ("reduce", left side, length), and goto."""
    rules = (("", ("C",)), *GRAMMAR)
    left = {r[0] for r in rules}
    symbols = {x for _, r in rules for x in r}

    def closure(items: set) -> frozenset:
        while True:
            after = {rules[k][1][dot] for k, dot in items if dot < len(rules[k][1])}
            more = items | {(k, 0) for k, r in enumerate(rules) if r[0] in after}
            if more == items:
                return frozenset(items)
            items = more

    first = {x: {x} for x in symbols - left} | {x: set() for x in left}
    follow = {x: set() for x in left} | {"": {"$"}}
    empty = {name for name, right in rules if not right}
    for _ in rules:
        for name, right in rules:
            rest = set(follow[name])
            for x in reversed(right):
                if x in left:
                    follow[x] |= rest
                rest = rest | first[x] if x in empty else set(first[x])
            for x in right:
                first[name] |= first[x]
                if x not in empty:
                    break
    states = [closure({(0, 0)})]
    action, goto = {}, {}
    for n, state in enumerate(states):
        for x in sorted({rules[k][1][dot] for k, dot in state if dot < len(rules[k][1])}):
            target = closure({(k, dot + 1) for k, dot in state if dot < len(rules[k][1]) and rules[k][1][dot] == x})
            if target not in states:
                states.append(target)
            (goto if x in left else action)[n, x] = states.index(target) if x in left else ("shift", states.index(target))
        for k, dot in state:
            if dot == len(rules[k][1]):
                for x in follow[rules[k][0]]:
                    assert (n, x) not in action, "the grammar is not SLR"
                    action[n, x] = ("reduce", rules[k][0], dot)
    return action, goto


@cache
def shifted(stack: tuple[int, ...], terminal: str) -> tuple[int, ...] | None:
    """The stack after its reductions and a shift of the terminal; of "$": the accepted stack; None where it is an error."""
    action, goto = tables()
    while True:
        kind, *what = action.get((stack[-1], terminal), ("error",))
        if kind == "error":
            return None
        if kind == "shift":
            return (*stack, what[0])
        name, n = what
        stack = stack[: len(stack) - n]
        if not name:
            return stack
        stack = (*stack, goto[stack[-1], name])


class Repair:
    """One conversation; add() its rows in order, then end(). What is decided comes out as (turn, role, text, edit)."""

    def __init__(self):
        self.tops: dict[int, tuple[int, str, tuple[int, ...]]] = {0: (0, "", (0,))}
        self.waiting: list[tuple] = []
        self.audit: list[str] = []
        self.turns_kept, self.system = 0, False
        self.faults = dict.fromkeys(FAULTS, 0)
        self.illegal = self.distinct = 0
        self.least = self.most = self.before = None
        self.initial = None

    def insert(self) -> None:
        """Stacks that inserted turns lead to join the tops."""
        tops, waiting = self.tops, list(self.tops)
        while waiting:
            cost, audit, stack = tops[waiting.pop()]
            for terminal in ROLES:
                if (to := shifted(stack, terminal)) and (to[-1] not in tops or (cost + INSERT, audit + "I") < tops[to[-1]][:2]):
                    tops[to[-1]] = (cost + INSERT, audit + "I", to)
                    waiting.append(to[-1])

    def add(self, turn, role: str, text: str, repeated: bool) -> list[tuple]:
        body = text.strip(SPACES)
        fault = "blank" if not body else "duplicate" if repeated else "truncated" if body[-1] not in ".!?" else None
        if fault:
            self.faults[fault] += 1
        initial = role[:1]
        if self.initial is not None and self.initial + initial not in ("su", "ua", "au"):
            self.illegal += 1
        self.initial = initial
        if turn is not None:
            if self.least is None:
                self.least = turn
            self.distinct += turn != self.most
            self.most = turn
        self.waiting.append((turn, role, text, initial))
        if fault in ("blank", "duplicate"):
            self.tops = {k: (cost + DELETE, audit + "D", stack) for k, (cost, audit, stack) in self.tops.items()}
            return self.decided()
        self.insert()
        more = TRUNCATED if fault else 0
        found = {k: (cost + DELETE, audit + "D", stack) for k, (cost, audit, stack) in self.tops.items()}
        for cost, audit, stack in self.tops.values():
            for terminal, price, letter in ((initial, 0, "K"), ("u", REROLE, "R"), ("a", REROLE, "R")):
                if terminal in ("s", "u", "a") and (to := shifted(stack, terminal)):
                    new = (cost + price + more, audit + letter, to)
                    if to[-1] not in found or new[:2] < found[to[-1]][:2]:
                        found[to[-1]] = new
        limit = min(x[0] for x in found.values()) + SLACK
        self.tops = {k: x for k, x in found.items() if x[0] <= limit}
        return self.decided()

    def decided(self) -> list[tuple]:
        """The rows whose edits all stacks agree on; the audits go on after them."""
        # trailing inserts wait for the row after them
        same = commonprefix([x[1] for x in self.tops.values()])
        if not same:
            return []
        self.tops = {k: (cost, audit[len(same) :], stack) for k, (cost, audit, stack) in self.tops.items()}
        self.audit.append(same)
        out, at = [], 0
        for letter in same:
            if letter == "I":
                turn, role, text, initial = None, None, "", None
            else:
                turn, role, text, initial = self.waiting[at]
                at += 1
            if letter != "D":
                if letter == "K" and initial == "s":
                    self.system = True
                elif letter != "K":
                    role = ROLES["ua"[(self.turns_kept - self.system) % 2]]
                self.turns_kept += 1
            out.append((turn, role, text, letter))
        del self.waiting[:at]
        return out

    def end(self) -> tuple[int, list[tuple]]:
        """The cost, and the rows that were still open."""
        self.insert()
        best = min(x for x in self.tops.values() if shifted(x[2], "$"))
        self.tops = {best[2][-1]: best}
        return best[0], self.decided()

    def gaps(self) -> int:
        return 0 if self.least is None else self.most - self.least + 1 - self.distinct


def damage(turns: DataFrame, conv_id: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """Rows with planted faults, chosen by crc32 of `conv_id:turn` mod 20; nulls are one space.

    0 drops a row, 1 empties its text, 2 takes `[.!?]` out of it, 3 repeats it, 4 makes its role user.
    """

    def filled(c: str) -> Column:
        return F.coalesce(F.col(c).cast("string"), F.lit(" "))

    kind = F.crc32(F.concat(filled(conv_id), F.lit(":"), filled(turn)).cast("binary")) % 20
    body = F.when(kind == 1, "").when(kind == 2, F.regexp_replace(filled(text), "[.!?]", "")).otherwise(filled(text))
    rows = turns.select(F.col(conv_id).alias("conv_id"), F.col(turn).alias("turn"), F.when(kind == 4, "user").otherwise(filled(role)).alias("role"), body.alias("text"), kind.alias("kind")).where("kind != 0")
    return rows.withColumn("copy", F.explode(F.when(F.col("kind") == 3, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0))))).select("conv_id", "turn", "role", "text")


def in_order(turns: DataFrame, conv_id: str, turn: str, role: str, text: str) -> DataFrame:
    """conv_id, turn, role, text and `since` (first turn of a repeated (role, text), as a struct), sorted in each task."""
    filled = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    rows = turns.select(F.col(conv_id).alias("conv_id"), F.col(turn).cast("long").alias("turn"), filled(role).alias("role"), filled(text).alias("text"))
    conv = F.coalesce(F.col("conv_id").cast("string"), F.lit("null "))
    marked = rows.withColumn("key", F.unhex(F.md5(F.concat_ws("|", F.length(conv), conv, F.length("role"), "role", "text").cast("binary"))))
    place = F.struct(F.col("turn").isNotNull().alias("given"), F.coalesce("turn", F.lit(0)).alias("turn"))
    repeated = cut(marked.groupBy("key").agg(F.count("*").alias("n"), F.min(place).alias("since")).where("n > 1"))
    met = hot_join(marked, repeated, ["key"], "n")
    return met.repartition(partitions(turns), "conv_id").sortWithinPartitions(F.col("conv_id"), F.col("turn").asc_nulls_first(), "role", "text").select("conv_id", "turn", "role", "text", F.col("since.given").alias("given"), F.col("since.turn").alias("since"))


def conversations(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
    """(conv_id, repair, rows, cost) along sorted rows; rows come as they are decided, cost is None until the last."""
    nothing = object()
    conv, now, before = nothing, Repair(), None
    for batch in batches:
        for c, turn, role, text, given, since in zip(*(col.to_pylist() for col in batch.columns), strict=True):
            if conv is nothing or c != conv:
                if conv is not nothing:
                    cost, rows = now.end()
                    yield conv, now, rows, cost
                conv, now, before = c, Repair(), None
            # equal rows of one turn stand side by side; others are later than the first turn that has them
            repeated = given is not None and ((turn is not None, turn or 0) > (given, since) or before == (turn, role, text))
            before = (turn, role, text)
            if rows := now.add(turn, role, text, repeated):
                yield conv, now, rows, None
    if conv is not nothing:
        cost, rows = now.end()
        yield conv, now, rows, cost


def repaired_turns(turns: DataFrame, conv_id: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """conv_id, position, turn, role, text and edit (K, R, D or I) of all rows, the deleted ones too, in their order."""
    rows = in_order(turns, conv_id, turn, role, text)
    kind = rows.schema["conv_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out: list[tuple] = []
        place, first = 0, None

        def batch() -> pa.RecordBatch:
            types = (id_type, pa.int64(), pa.int64(), pa.string(), pa.string(), pa.string())
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True), types, strict=True)], ["conv_id", "position", "turn", "role", "text", "edit"])

        def seen() -> Iterator[pa.RecordBatch]:
            nonlocal first
            for b in batches:
                first = b if first is None else first
                yield b

        for conv, _, found, cost in conversations(seen()):
            id_type = first.schema.field(0).type
            for t, r, x, e in found:
                out.append((conv, place, t, r, x, e))
                place += 1
            if cost is not None:
                place = 0
            if len(out) >= ROWS:
                yield batch()
                out = []
        if out:
            yield batch()

    return rows.mapInArrow(run, f"conv_id {kind}, position long, turn long, role string, text string, edit string")


def repair_report(turns: DataFrame, conv_id: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """A row for each conversation: faults as found, cost and audit of the repair, and the repaired text's SHA-256."""
    rows = in_order(turns, conv_id, turn, role, text)
    kind = rows.schema["conv_id"].dataType.simpleString()
    names = ["conv_id", "gaps", *FAULTS, "illegal", "cost", "audit", "repaired_sha256"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out: list[tuple] = []
        digest, begun, id_type = hashlib.sha256(), False, None

        def batch() -> pa.RecordBatch:
            types = (id_type, *[pa.int64()] * 6, pa.string(), pa.string())
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True), types, strict=True)], names)

        def seen() -> Iterator[pa.RecordBatch]:
            nonlocal id_type
            for b in batches:
                id_type = b.schema.field(0).type
                yield b

        for conv, repair, found, cost in conversations(seen()):
            for _, r, x, e in found:
                if e != "D":
                    digest.update(f"{chr(10) * begun}{r}:{x}".encode())
                    begun = True
            if cost is not None:
                out.append((conv, repair.gaps(), *repair.faults.values(), repair.illegal, cost, "".join(repair.audit), digest.hexdigest()))
                digest, begun = hashlib.sha256(), False
                if len(out) >= ROWS:
                    yield batch()
                    out = []
        if out:
            yield batch()

    return rows.mapInArrow(run, f"conv_id {kind}, gaps long, blank long, duplicate long, truncated long, illegal long, cost long, audit string, repaired_sha256 string")

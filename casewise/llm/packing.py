"""Operator 1, best-fit packing: whole documents into as few sequences of a fixed token count as it can.

A document's tokens are cut only where they exceed the capacity. What is left to decide depends on piece lengths
alone, so the plan is made from their histogram: at most `capacity` counts, however large the corpus. The best-fit
packing is the first incumbent. While it is above the lower bound, bin completion looks for a better one: it branches
on the undominated fillings around the longest piece left, least waste first, and cuts a branch whose waste is more
than a better packing can have. Spark numbers the pieces of each length and places number r of a length where the plan
says.

The search is exact if it ends within STEPS; finding a least number of sequences is NP-hard, so that beyond them the
incumbent stays. It is tried on the sequences with most waste first, which is where a packing can lose one.

Null or empty texts have the end mark alone. Repeated rows and rows without a doc_id are documents of their own; which
of pieces of one length goes where is decided by doc_id, piece and content, and does not show between equal ones. Very
long texts become many pieces. Other columns are left behind, whatever their names. An empty table gives no rows.
"""

from __future__ import annotations

import hashlib
import json
import math
from array import array
from bisect import bisect_right
from collections import Counter
from collections.abc import Iterator
from itertools import chain

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from casewise.llm.common import cut, partitions

CAPACITY = 2048
END = 0
#: Words and their parts whose ids a worker keeps; beyond that those that were not met of late are forgotten.
WORDS_KEPT, PARTS_KEPT = 400_000, 800_000
#: Batches of a worker whose first texts are encoded both ways.
COMPARED = 2
#: Steps of a search, and distinct lengths up to which failed states are remembered.
STEPS, REMEMBERED = 400_000, 64


class _Mapped(dict):
    """The characters that stand for a character's bytes in a byte-level vocabulary."""

    def __init__(self):
        from tokenizers import pre_tokenizers

        self.split = pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False)

    def __missing__(self, code: int) -> str:
        self[code] = found = self.split.pre_tokenize_str(chr(code))[0][0]
        return found


class WordEncoder:
    """Ids of texts, word by word, with a bounded memory of words.

    Only for byte-level tokenizers that drop white space and keep runs of letters whole, so that a text's ids are
    those of its words one after the other; others encode the whole text.
    """

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        added = self.tokenizer.get_added_tokens_decoder().values()
        # a text that spells such a token is encoded as a whole
        self.special = [t.content for t in added]
        with open(path) as f:
            kind = json.load(f)
        splits = (kind.get("pre_tokenizer") or {}).get("pretokenizers") or []
        first = splits[0] if splits else {}
        pattern = first.get("pattern", {}).get("Regex", "")
        self.by_word = first.get("behavior") == "Removed" and r"[^\s" in pattern and r"[\p{L}]+" in pattern and splits[-1]["type"] == "ByteLevel" and kind["post_processor"] is None and not any(t.normalized for t in added)
        self.compared = 0
        self.mapped = _Mapped()
        self.words: dict[str, bytes] = {}
        self.before: dict[str, bytes] = {}
        self.parts: dict[str, bytes] = {}

    def part(self, mapped: str) -> bytes:
        if len(self.parts) >= PARTS_KEPT:
            self.parts.clear()
        ids = self.parts[mapped] = array("I", [t.id for t in self.tokenizer.model.tokenize(mapped)]).tobytes()
        return ids

    def normal(self, words: list[str]) -> list[str]:
        found = self.tokenizer.normalizer.normalize_str(" ".join(words)).split(" ")
        return found if len(found) == len(words) else [self.tokenizer.normalizer.normalize_str(w) for w in words]

    def learn(self, words: list[str]) -> None:
        kept, known, part = self.words, self.parts.get, self.part
        odd = []
        for w in words:
            if w.isascii():
                if w.isalpha():
                    w_ = w.lower()
                    kept[w] = known(w_) or part(w_)
                    continue
                if w[-1] in ".," and w[:-1].isalpha():
                    w_, end = w[:-1].lower(), w[-1]
                    kept[w] = (known(w_) or part(w_)) + (known(end) or part(end))
                    continue
            odd.append(w)
        split = self.tokenizer.pre_tokenizer.pre_tokenize_str
        for w, normal in zip(odd, self.normal(odd) if odd else (), strict=True):
            if normal.isalpha():
                pieces = [normal.translate(self.mapped)]
            elif normal[-1:] in ".," and normal[:-1].isalpha():
                pieces = [normal[:-1].translate(self.mapped), normal[-1]]
            else:
                pieces = [p for p, _ in split(normal)]
            kept[w] = b"".join([known(p) or part(p) for p in pieces])

    def encode(self, texts: list[str]) -> list[bytes]:
        """Little-endian unsigned 32-bit ids of each text."""
        if self.by_word and self.compared < COMPARED:
            # a worker's first texts are encoded both ways
            self.compared += 1
            sample = [t[:2000] for t in texts[:8]]
            self.by_word = self.encode_by_word(sample) == self.encode_whole(sample)
        return self.encode_by_word(texts) if self.by_word else self.encode_whole(texts)

    def encode_whole(self, texts: list[str]) -> list[bytes]:
        return [array("I", e.ids).tobytes() for e in self.tokenizer.encode_batch(texts, add_special_tokens=False)]

    def encode_by_word(self, texts: list[str]) -> list[bytes]:
        found = [k for k, t in enumerate(texts) if any(x in t for x in self.special)]
        if found:
            whole = dict(zip(found, self.encode_whole([texts[k] for k in found]), strict=True))
            plain = iter(self.encode_by_word([t for k, t in enumerate(texts) if k not in whole]))
            return [whole[k] if k in whole else next(plain) for k in range(len(texts))]
        split = [t.replace("\n", " ").replace("\t", " ").replace("\r", " ").split(" ") for t in texts]
        new = set(chain.from_iterable(split)).difference(self.words)
        if len(self.words) + len(new) > WORDS_KEPT:
            self.before, self.words = self.words, {}
            new = set(chain.from_iterable(split))
        before = self.before
        again = [w for w in new if w in before]
        self.words.update([(w, before[w]) for w in again])
        new.difference_update(again)
        new.discard("")
        self.words[""] = b""
        self.learn(list(new))
        get = self.words.__getitem__
        return [b"".join(map(get, words)) for words in split]


_ENCODERS: dict[str, WordEncoder] = {}


def tokenized_pieces(docs: DataFrame, tokenizer: str, capacity: int = CAPACITY, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, piece, start, length and the piece's ids (binary, little-endian unsigned 32-bit); an end mark ends a document."""
    end = array("I", [END]).tobytes()
    width = 4 * capacity

    def pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = _ENCODERS.setdefault(tokenizer, None) or WordEncoder(tokenizer)
        _ENCODERS[tokenizer] = coder
        for batch in batches:
            for at in range(0, batch.num_rows, 500):
                part = batch.slice(at, 500)
                out: list[tuple] = []
                for key, coded in zip(part.column(0).to_pylist(), coder.encode([x or "" for x in part.column(1).to_pylist()]), strict=True):
                    ids = coded + end
                    out += [(key, k, k * capacity, len(x) // 4, x) for k, x in enumerate(ids[i : i + width] for i in range(0, len(ids), width))]
                cols = list(zip(*out, strict=True))
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, (batch.schema.field(0).type, pa.int32(), pa.int64(), pa.int64(), pa.binary()), strict=True)], ["doc_id", "piece", "start", "length", "ids"])

    kind = docs.schema[doc_id].dataType.simpleString()
    return docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text")).mapInArrow(pieces, f"doc_id {kind}, piece int, start long, length long, ids binary")


def lower_bound(counts: dict[int, int], capacity: int) -> int:
    """Sequences that no packing can go below: the tokens' own room, and pieces over half with what cannot join them."""
    best = math.ceil(sum(k * n for k, n in counts.items()) / capacity)
    for small in sorted({0, *(k for k in counts if 2 * k <= capacity)}):
        alone = sum(n for k, n in counts.items() if k > capacity - small)
        half = {k: n for k, n in counts.items() if capacity - small >= k > capacity / 2}
        rest = sum(k * n for k, n in counts.items() if small <= k <= capacity / 2)
        room = sum(n * (capacity - k) for k, n in half.items())
        best = max(best, alone + sum(half.values()) + max(0, math.ceil((rest - room) / capacity)))
    # of pieces over capacity / (k + 1) a sequence holds k at most; others count by their length (Fekete and Schepers' dual feasible functions)
    for k in range(1, 21):
        total = sum(n * (s * k if (k + 1) * s % capacity == 0 else (k + 1) * s // capacity * capacity) for s, n in counts.items())
        best = max(best, -(-total // (k * capacity)))
    return best


class Spent(Exception):
    """A search has used up its steps."""


class Search:
    """Bin completion: a packing of counts[length] pieces with fewer than `most` sequences, if there is one."""

    def __init__(self, counts: dict[int, int], capacity: int, most: int, steps: int = STEPS):
        self.capacity, self.steps = capacity, steps
        self.left = Counter({k: n for k, n in counts.items() if n})
        self.sizes = sorted(self.left)
        self.rest = sum(k * n for k, n in self.left.items())
        self.spare = (most - 1) * capacity - self.rest
        self.waste = 0
        self.plan: list[tuple[tuple[int, ...], int]] = []
        self.failed: dict[bytes, int] = {}
        self.reach = self.reachable(self.sizes, self.left)

    def step(self) -> None:
        self.steps -= 1
        if self.steps < 0:
            raise Spent

    def reachable(self, sizes: list[int], left: dict[int, int]) -> list[int]:
        """For each length, bits of the sums that pieces up to this length can have."""
        out, sums, mask = [], 1, (1 << self.capacity + 1) - 1
        for s in sizes:
            n, part = min(left[s], self.capacity // s), 1
            while n > 0:
                part = min(part, n)
                sums |= sums << part * s & mask
                n -= part
                part *= 2
            out.append(sums)
        return out

    def exact(self, need: int, top: int, sizes: list[int], left: dict[int, int], reach: list[int]) -> Iterator[tuple[int, ...]]:
        """Multisets of lengths up to number `top` that sum to `need`, largest first."""
        if not need:
            yield ()
            return
        for at in range(min(top, bisect_right(sizes, need) - 1), -1, -1):
            if not reach[at] >> need & 1:
                return
            s = sizes[at]
            for m in range(min(left[s], need // s), 0, -1):
                self.step()
                over = need - m * s
                if not over or at and reach[at - 1] >> over & 1:
                    for rest in self.exact(over, at - 1, sizes, left, reach):
                        yield (s,) * m + rest

    def dominated(self, filling: tuple[int, ...], waste: int, left: dict[int, int]) -> bool:
        """True if a piece that is left over fits in place of some of the filling's, which it outweighs or equals.

        With that piece in, the pieces that it replaces fit wherever it stood, so another filling is at least as good.
        """

        def sums(pieces) -> int:
            bits = 1
            for p in pieces:
                bits |= bits << p
            return bits

        every, own = sums(filling), Counter(filling)
        window = (1 << waste + 1) - 1
        for x in self.sizes:
            if left[x] <= own[x]:
                continue
            bits = sums(p for p in filling if p != x) if x in own else every
            low = max(0, x - waste)
            if bits >> low & (window if x >= waste else (1 << x + 1) - 1):
                return True
        return False

    def branches(self) -> Iterator[tuple[int, tuple[int, ...], int]]:
        """(waste, pattern, uses) for the longest piece left: all undominated fillings, least waste first."""
        if self.rest <= self.capacity:
            if self.capacity - self.rest <= self.spare - self.waste:
                yield self.capacity - self.rest, tuple(k for k in reversed(self.sizes) for _ in range(self.left[k])), 1
            return
        sizes, left = list(self.sizes), dict(self.left)
        longest, room = sizes[-1], self.capacity - sizes[-1]
        left[longest] -= 1
        reach = self.reachable(sizes, left) if len(sizes) <= REMEMBERED else None
        if reach is None:
            # those of all pieces hold for fewer as well
            reach = [self.reach[bisect_right(self.all_sizes, s) - 1] for s in sizes]
        for waste in range(min(room, self.spare - self.waste) + 1):
            for filling in self.exact(room - waste, len(sizes) - 1, sizes, left, reach):
                self.step()
                if self.dominated(filling, waste, left):
                    continue
                pattern = (longest, *filling)
                most = min(self.left[k] // m for k, m in Counter(pattern).items())
                if waste:
                    most = min(most, (self.spare - self.waste) // waste)
                first = [most >> k for k in range(most.bit_length())]
                for times in chain(first, (t for t in range(most, 0, -1) if t not in first)):
                    yield waste, pattern, times

    def use(self, pattern: tuple[int, ...], times: int) -> None:
        for k, m in Counter(pattern).items():
            was = self.left[k]
            self.left[k] = now = was - m * times
            if not now:
                del self.sizes[bisect_right(self.sizes, k) - 1]
            elif not was:
                self.sizes.insert(bisect_right(self.sizes, k), k)
        self.rest -= sum(pattern) * times

    def state(self) -> bytes | None:
        """A digest of what is left, so that failed states take little memory."""
        if len(self.sizes) > REMEMBERED:
            return None
        return hashlib.blake2b(array("Q", (x for k in self.sizes for x in (k, self.left[k]))).tobytes(), digest_size=16).digest()

    def run(self) -> list[tuple[tuple[int, ...], int]] | None:
        """The plan; None if there is none, or if the steps end before the search does."""
        if self.spare < 0:
            return None
        self.all_sizes = list(self.sizes)
        stack = [self.branches()]
        try:
            while self.sizes:
                taken = next(stack[-1], None)
                if taken is None:
                    state = self.state()
                    if state is not None:
                        self.failed[state] = min(self.waste, self.failed.get(state, self.waste))
                    stack.pop()
                    if not stack:
                        return None
                    pattern, times = self.plan.pop()
                    self.use(pattern, -times)
                    self.waste -= (self.capacity - sum(pattern)) * times
                    continue
                self.step()
                waste, pattern, times = taken
                self.use(pattern, times)
                self.waste += waste * times
                state = self.state()
                if state is not None and self.failed.get(state, self.waste + 1) <= self.waste:
                    self.use(pattern, -times)
                    self.waste -= waste * times
                    continue
                self.plan.append((pattern, times))
                stack.append(self.branches())
        except Spent:
            return None
        return self.plan


def repaired(plan: list[tuple[tuple[int, ...], int]], capacity: int, steps: int, budget: list[int]) -> list[tuple[tuple[int, ...], int]] | None:
    """A plan with fewer sequences, found by packing the sequences with most waste anew; None if that finds none.

    What the searches take is taken off budget[0].
    """
    order = sorted(plan, key=lambda p: sum(p[0]))
    for most in (8, 16, 32, 64):
        # one of each pattern, then another of each
        taken = [0] * len(order)
        free = 0
        while free < most:
            more = [k for k, (_, times) in enumerate(order) if taken[k] < times][: most - free]
            if not more:
                break
            for k in more:
                taken[k] += 1
            free += len(more)
        pieces = Counter()
        for n, (pattern, _) in zip(taken, order, strict=True):
            for k in pattern if n else ():
                pieces[k] += n
        search = Search(pieces, capacity, free, min(steps, budget[0]) // 4)
        before = search.steps
        better = search.run()
        budget[0] -= before - max(0, search.steps)
        if better is not None:
            # wherever the same patterns are left again
            again = min(times // n for n, (_, times) in zip(taken, order, strict=True) if n)
            kept = [(pattern, times - n * again) for n, (pattern, times) in zip(taken, order, strict=True) if times > n * again]
            return kept + [(pattern, times * again) for pattern, times in better]
        if free < most:
            return None
    return None


def best_fit(counts: dict[int, int], capacity: int) -> list[tuple[tuple[int, ...], int]]:
    """Best fit, longest pieces first, on whole classes of equal sequences at a time."""
    open_at: dict[int, list[tuple[tuple[int, ...], int]]] = {}
    rooms: list[int] = []

    def put(room: int, pattern: tuple[int, ...], times: int) -> None:
        if room not in open_at:
            rooms.insert(bisect_right(rooms, room), room)
        open_at.setdefault(room, []).append((pattern, times))

    for size in sorted(counts, reverse=True):
        left = counts[size]
        while left:
            at = bisect_right(rooms, size - 1)
            room = rooms[at] if at < len(rooms) else capacity
            if at < len(rooms):
                pattern, times = open_at[room].pop()
            else:
                pattern, times = (), left
            each = min(room // size, left)
            used = min(times, left // each)
            if times > used and pattern:
                open_at[room].append((pattern, times - used))
            if at < len(rooms) and not open_at[room]:
                del open_at[room], rooms[at]
            put(room - each * size, pattern + (size,) * each, used)
            left -= used * each
    return [x for group in open_at.values() for x in group]


def pack_histogram(counts: dict[int, int], capacity: int = CAPACITY, steps: int = STEPS) -> list[tuple[tuple[int, ...], int]]:
    """How to pack counts[length] pieces of each length: patterns of lengths, each with how many sequences take it."""
    best = best_fit(counts, capacity)
    floor = lower_bound(counts, capacity)
    budget = [2 * steps]  # for all that is found by repair
    while (used := sum(t for _, t in best)) > floor:
        better = repaired(best, capacity, steps, budget) or Search(counts, capacity, used, steps).run()
        if better is None:
            break
        best = better
    return best


def slots(plan: list[tuple[tuple[int, ...], int]]) -> list[tuple[int, int, int, int, list[int]]]:
    """length, first and last number of its pieces + 1, first sequence, offsets in each sequence."""
    out, used, sequence = [], Counter(), 0
    for pattern, times in plan:
        offsets: dict[int, list[int]] = {}
        at = 0
        for k in pattern:
            offsets.setdefault(k, []).append(at)
            at += k
        for k, places in offsets.items():
            out.append((k, used[k], used[k] + times * len(places), sequence, places))
            used[k] += times * len(places)
        sequence += times
    return out


def numbered(pieces: DataFrame, order: list[str]) -> DataFrame:
    """pieces with `nth`, from 0 without gaps in each length.

    Numbers are given within (length, salt) and shifted by the counts of the salts before, so that a length that
    holds a third of all pieces is no task of its own.
    """
    n = max(16, partitions(pieces))
    salted = pieces.withColumn("_salt", F.pmod(F.xxhash64(*order), F.lit(n)))
    before = Window.partitionBy("length").orderBy("_salt").rowsBetween(Window.unboundedPreceding, -1)
    shift = salted.groupBy("length", "_salt").agg(F.count("*").alias("_n")).select("length", "_salt", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_before"))
    own = Window.partitionBy("length", "_salt").orderBy(*order)
    return salted.withColumn("_row", F.row_number().over(own)).join(shift, ["length", "_salt"]).withColumn("nth", F.col("_before") + F.col("_row") - 1).drop("_salt", "_row", "_before")


def pack_documents(docs: DataFrame, tokenizer: str, capacity: int = CAPACITY, keep: dict[str, Column] | None = None, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """Pieces with sequence_id and offset.

    keep: what stays of each piece's `ids` besides doc_id, piece, start and length; the ids themselves unless given.
    """
    keep = {"ids": F.col("ids")} if keep is None else keep
    pieces = cut(tokenized_pieces(docs, tokenizer, capacity, doc_id, text).select("doc_id", "piece", "start", "length", *(c.alias(k) for k, c in keep.items())))
    counts = {r[0]: r[1] for r in pieces.groupBy("length").count().collect()}  # at most `capacity` rows
    where = slots(pack_histogram(counts, capacity))
    table = pieces.sparkSession.createDataFrame(where, "_length long, _from long, _to long, _sequence long, _places array<long>")
    row = F.col("nth") - F.col("_from")
    placed = numbered(pieces, ["doc_id", "piece", "start", *keep]).join(F.broadcast(table), (F.col("length") == F.col("_length")) & (F.col("nth") >= F.col("_from")) & (F.col("nth") < F.col("_to")))
    width = F.size("_places")
    return placed.select("doc_id", "piece", "start", "length", *keep, (F.col("_sequence") + F.floor(row / width)).alias("sequence_id"), F.col("_places")[(row % width).cast("int")].alias("offset"))


def sequences(packed: DataFrame) -> DataFrame:
    """sequence_id and its ids; a sequence holds at most `capacity` tokens."""
    parts = F.array_sort(F.collect_list(F.struct("offset", "doc_id", "piece", "ids")))
    return packed.groupBy("sequence_id").agg(F.transform(parts, lambda x: x["ids"]).alias("ids"))

"""Boosted trees of many models at once: all groups of cases and all parameters grow level by level in the same passes.

The rules are those of the original's learner: squared error, sums by bin, an L2 penalty of 1, at least a given weight in
a leaf, nine tenths of the rows and columns for each tree, and weights that are equal for all cases and 1 on average.
Rows stay in blocks, in their tasks. In a level each task sums gradients and weights by model, node, place and bin, the
sums of a model meet, and only its best split in each node reaches the driver. A tree of depth d is d passes over the
blocks, whatever the number of models.

Sums are of whole numbers (gradients and weights times a power of two that keeps totals exact), so that splits depend on
neither the order in which tasks end nor the session's number of partitions.
"""

from __future__ import annotations

import math
import pickle
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark import RDD, StorageLevel, TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

#: Bins of a place of x (MLlib's default), values that a block tells of each place to cut them, rows of a block.
BINS, POINTS, EACH = 32, 256, 125_000
#: The L2 penalty, and the share of rows and of columns that a tree meets.
PENALTY, SHARE = 1.0, 0.9
#: Trees between two checkpoints of the blocks.
KEEP = 50


class Boosted(NamedTuple):
    """A model. Trees are full and in heap order; a node that does not split sends all rows to the left."""

    borders: tuple[np.ndarray, ...]  # of each place of x, rising; a value's bin is the number of borders under it
    base: float
    feature: np.ndarray  # trees x nodes
    cut: np.ndarray  # trees x nodes: the last bin that goes left
    value: np.ndarray  # trees x leaves


def binned(borders: tuple[np.ndarray, ...], x: np.ndarray) -> np.ndarray:
    """Bins by place, rows in the second dimension."""
    return np.stack([np.searchsorted(b, v) for b, v in zip(borders, x.T, strict=True)]).astype(np.uint8)


def nodes(feature: np.ndarray, cut: np.ndarray, bins: np.ndarray, levels: int) -> np.ndarray:
    """The node of each row, counted within its level, after some levels of a tree."""
    at = np.zeros(bins.shape[1], np.uint8)
    for level in range(levels):
        first = 2**level - 1
        right = bins[feature[first]] > cut[first]
        for k in range(1, 2**level):
            right = np.where(at == k, bins[feature[first + k]] > cut[first + k], right)
        at = 2 * at + right
    return at


def apply(model: Boosted, bins: np.ndarray) -> np.ndarray:
    out = np.full(bins.shape[1], model.base)
    levels = model.value.shape[1].bit_length() - 1
    for feature, cut, value in zip(model.feature, model.cut, model.value, strict=True):
        out += value[nodes(feature, cut, bins, levels)]
    return out


class Block(NamedTuple):
    """Some rows of a task: bins (raw values at first) by place, target, one over the rows of the case, and packed flags of groups."""

    name: tuple[int, int]
    x: np.ndarray
    y: np.ndarray
    share: np.ndarray
    groups: np.ndarray
    made: list[np.ndarray]  # predictions of each model for the rows of its group

    def of(self, group: int) -> np.ndarray:
        return np.flatnonzero(np.unpackbits(self.groups[group], count=len(self.y)))


def in_blocks(rows: DataFrame, groups: list[tuple[object, Column]], x: str, target: str, case: str) -> RDD:
    """rows as blocks. Rows are dealt by case and sorted, so that blocks do not follow the session's number of partitions."""
    count = rows.count()
    flags = F.array(*(F.coalesce(where, F.lit(False)) for _, where in groups))
    width = len(groups)
    dealt = rows.repartition(max(count // EACH + 1, min(8, count // 20_000 + 1)), case).withColumn("_n", F.count("*").over(Window.partitionBy(case)))
    ready = dealt.sortWithinPartitions(case, target, x).select(F.col(x).cast("array<double>").alias("x"), F.col(target).cast("double").alias("y"), (1 / F.col("_n")).alias("share"), flags.alias("groups"))

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        number = 0

        def block() -> pa.RecordBatch:
            nonlocal number
            t = pa.Table.from_batches(held).combine_chunks()
            flat = lambda c: t[c].combine_chunks().flatten().to_numpy(zero_copy_only=False).reshape(t.num_rows, -1)
            found = Block((TaskContext.get().partitionId(), number), np.ascontiguousarray(flat("x").T), t["y"].to_numpy(), t["share"].to_numpy(), np.packbits(flat("groups").astype(bool).T.reshape(width, -1), axis=1), [])
            number += 1
            held.clear()
            return pa.RecordBatch.from_pydict({"block": pa.array([pickle.dumps(found, 5)], pa.binary())})

        for batch in batches:
            if batch.num_rows:
                held.append(batch)
            if sum(b.num_rows for b in held) >= EACH:
                yield block()
        if held:
            yield block()

    return ready.mapInArrow(pack, "block binary").rdd.map(lambda r: pickle.loads(r[0]))


def told(width: int):
    """What a block tells before the first tree: evenly spaced values of each place, and sums over the rows of each group."""

    def tell(b: Block):
        at = np.linspace(0, len(b.y) - 1, min(POINTS, len(b.y))).round().astype(int)
        sums = [(len(i), math.fsum(b.share[i]), math.fsum(b.share[i] * b.y[i])) for i in map(b.of, range(width))]
        return b.name, len(b.y), np.sort(b.x, axis=1)[:, at], sums, float(b.y.min()), float(b.y.max())

    return tell


def borders_of(found: list, places: int) -> tuple[np.ndarray, ...]:
    """Borders between bins with about as many rows each, from what the blocks tell."""
    out = []
    for j in range(places):
        values = np.concatenate([v[j] for _, _, v, *_ in found])
        weights = np.concatenate([np.full(v.shape[1], n / v.shape[1]) for _, n, v, *_ in found])
        order = np.argsort(values, kind="stable")
        upto = np.cumsum(weights[order])
        at = np.searchsorted(upto, upto[-1] * np.arange(1, BINS) / BINS)
        cuts = np.unique(values[order][at])
        out.append(cuts[cuts < values[order[-1]]])
    return tuple(out)


class Plan(NamedTuple):
    """What all tasks know of the models: by model its group, depth, least weight of a leaf, weight of a case and the powers of two."""

    group: list[int]
    depth: list[int]
    least: list[float]
    scale: list[float]
    of_gradient: list[float]
    of_weight: list[float]
    places: int
    seed: int
    share: float


def drawn(plan: Plan, model: int, tree: int, b: Block, n: int) -> np.ndarray:
    """Which rows (of n that the model has in the block) the tree meets."""
    return np.random.default_rng([plan.seed, model, tree, *b.name]).integers(0, 1 << 16, n, np.uint16) < plan.share * (1 << 16)


def sums_of_level(plan: Plan, tree: int, level: int, grown: dict[int, tuple[np.ndarray, np.ndarray]]):
    """For a task: (model, whole sums of gradients and weights by node, place and bin), of models that are deep enough."""
    pairs = (plan.places + 1) // 2
    cells = 2**level * BINS * BINS

    def sum_up(blocks: Iterator[Block]) -> Iterator[tuple[int, np.ndarray]]:
        total: dict[int, np.ndarray] = {}
        for b in blocks:
            # two places at a time: a count by both bins gives those by either
            last = lambda p: b.x[2 * p + 1] if 2 * p + 1 < plan.places else np.uint8(0)
            keys = [b.x[2 * p].astype(np.int64) * BINS + last(p) for p in range(pairs)]
            members = {g: b.of(g) for g in set(plan.group)}
            for m, made in enumerate(b.made):
                if plan.depth[m] <= level or not len(made):
                    continue
                at = members[plan.group[m]]
                weight = b.share[at] * plan.scale[m]
                # rows that the tree does not meet weigh nothing
                weight *= drawn(plan, m, tree, b, len(at))
                gradient = np.rint(weight * (made - b.y[at]) * plan.of_gradient[m])
                weight = np.rint(weight * plan.of_weight[m])
                node = nodes(*grown[m], b.x, level)[at].astype(np.int64) * (BINS * BINS) if level else 0
                out = np.empty((2, 2**level, 2 * pairs, BINS))
                for p, key in enumerate(keys):
                    k = key[at]
                    k += node
                    for s, v in enumerate((gradient, weight)):
                        both = np.bincount(k, v, cells).reshape(-1, BINS, BINS)
                        out[s, :, 2 * p], out[s, :, 2 * p + 1] = both.sum(2), both.sum(1)
                total[m] = total[m] + out if m in total else out
        yield from total.items()

    return sum_up


def best_splits(plan: Plan, columns: np.ndarray):
    """Of a model's sums: by node the place and bin of the best split, gradient and weight to its left and in all."""

    def find(item: tuple[int, np.ndarray]):
        m, sums = item
        g, h = sums[0, :, : plan.places] / plan.of_gradient[m], sums[1, :, : plan.places] / plan.of_weight[m]
        all_g, all_h = g.sum(2, keepdims=True), h.sum(2, keepdims=True)
        left_g, left_h = g.cumsum(2), h.cumsum(2)
        right_g, right_h = all_g - left_g, all_h - left_h
        gain = left_g**2 / (left_h + PENALTY) + right_g**2 / (right_h + PENALTY) - all_g**2 / (all_h + PENALTY)
        least = max(plan.least[m], 1e-9)
        gain = np.where((left_h >= least) & (right_h >= least) & columns[m][None, :, None], gain, -np.inf)
        at = gain.reshape(len(gain), -1).argmax(1)
        place, cut = at // BINS, at % BINS
        n = np.arange(len(gain))
        split = gain[n, place, cut] > 1e-6
        place, cut = np.where(split, place, 0), np.where(split, cut, 255)
        some = lambda left, full: np.where(split, left[n, place, np.minimum(cut, BINS - 1)], full[:, 0, 0])
        return m, place, cut, some(left_g, all_g), some(left_h, all_h), all_g[:, 0, 0], all_h[:, 0, 0]

    return find


def fit_together(rows: DataFrame, groups: list[tuple[object, Column]], parameters: list[tuple[int, float, float]], trees: int, seed: int, x: str = "x", target: str = "y", case: str = "case_id") -> list[list[Boosted]]:
    """A model for each group (a name and which rows train it; a case is in it with all rows or none) and each of its
    parameters: depth, least weight of a leaf and learning rate. x has no null. Places are cut into bins over all rows."""
    if not groups or not parameters or rows.isEmpty():
        raise ValueError("there are no rows, groups or parameters to fit")
    raw = in_blocks(rows, groups, x, target, case).persist(StorageLevel.MEMORY_AND_DISK)
    found = sorted(raw.map(told(len(groups))).collect(), key=lambda t: t[0])
    places = len(found[0][2])
    borders = borders_of(found, places)
    counts = [[math.fsum(t[3][g][k] for t in found) for k in range(3)] for g in range(len(groups))]
    spread = max(t[5] for t in found) - min(t[4] for t in found) + 1.0
    models = [(g, p) for g in range(len(groups)) for p in parameters]
    if any(n == 0 for n, *_ in counts):
        raise ValueError("a group has no rows")
    power = lambda most: 2.0 ** math.floor(52 - math.log2(most))
    of = [counts[g] for g, _ in models]
    plan = Plan([g for g, _ in models], [p[0] for _, p in models], [p[1] for _, p in models], [n / cases for n, cases, _ in of], [power(2 * n * spread) for n, *_ in of], [power(2 * n) for n, *_ in of], places, seed, SHARE)
    base = [total / cases for _, cases, total in of]
    shape = [(trees, 2**d) for d in plan.depth]
    feature, cut, value = ([np.zeros((t, n - less), kind) for t, n in shape] for less, kind in ((1, np.int16), (1, np.uint8), (0, float)))

    def begin(b: Block) -> Block:
        return b._replace(x=binned(borders, b.x.T), made=[np.full(len(b.of(g)), base[m], np.float32) for m, g in enumerate(plan.group)])

    def step(last: list[tuple[np.ndarray, np.ndarray, np.ndarray]]):
        def move(b: Block) -> Block:
            members = {g: b.of(g) for g in set(plan.group)}
            made = [old + v.astype(np.float32)[nodes(f, c, b.x, d)[members[g]]] for old, (f, c, v), d, g in zip(b.made, last, plan.depth, plan.group, strict=True)]
            return b._replace(made=made)

        return move

    context = rows.sparkSession.sparkContext
    # a small job ends sooner with few tasks
    tasks = min(len(models) // 12 + 1, max(context.defaultParallelism, 1))
    state, olds = raw.map(begin).persist(StorageLevel.MEMORY_AND_DISK), [raw]
    try:
        for t in range(trees):
            if t:
                olds.append(state)
                state = state.map(step([(feature[m][t - 1], cut[m][t - 1], value[m][t - 1]) for m in range(len(models))])).persist(StorageLevel.MEMORY_AND_DISK)
                if t % KEEP == 0:
                    state.checkpoint() if context.getCheckpointDir() else state.localCheckpoint()
            chance = np.random.default_rng([seed, t]).random((len(models), places))
            columns = chance.argsort(1).argsort(1) < max(1, int(SHARE * places))
            for level in range(max(plan.depth)):
                grown = {m: (feature[m][t], cut[m][t]) for m, d in enumerate(plan.depth) if d > level}
                sums = state.mapPartitions(sums_of_level(plan, t, level, grown))
                if len(found) > 1:
                    sums = sums.reduceByKey(np.add, tasks)
                for m, place, at, left_g, left_h, all_g, all_h in sums.map(best_splits(plan, columns)).collect():
                    first = 2**level - 1
                    feature[m][t, first : 2 * first + 1], cut[m][t, first : 2 * first + 1] = place, at
                    if level == plan.depth[m] - 1:
                        g, h = np.stack([left_g, all_g - left_g], 1).ravel(), np.stack([left_h, all_h - left_h], 1).ravel()
                        value[m][t] = -models[m][1][2] * g / (h + PENALTY)
                while olds:
                    olds.pop().unpersist()
    finally:
        for r in (*olds, state):
            r.unpersist()
    fitted = [Boosted(borders, base[m], feature[m], cut[m], value[m]) for m in range(len(models))]
    return [fitted[k * len(parameters) : (k + 1) * len(parameters)] for k in range(len(groups))]

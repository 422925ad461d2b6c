"""Drug concentrations per case from recorded pump rates, and the index they predict.

Model constants are published population values and marked as fixed.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

#: Concentrations of half effect, base and steepness of the index.
HALF_P, HALF_R, BASE, STEEP = 4.47, 19.3, 98.0, 1.43


def lean_mass(weight: Column, height: Column, male: Column) -> Column:
    """James' formula."""
    r = (weight / height) ** 2
    return F.when(male == 1, 1.1 * weight - 128 * r).otherwise(1.07 * weight - 148 * r)


def propofol_parameters(df: DataFrame) -> DataFrame:
    """Schnider's model: volumes (L) and clearances (L/min) from age, sex_male, height and weight."""
    age, w, h = F.col("age"), F.col("weight"), F.col("height")
    m = lean_mass(w, h, F.col("sex_male"))
    return df.withColumns({
        "lean_mass": m,
        "v1": F.lit(4.27),
        "v2": 18.9 - 0.391 * (age - 53),
        "v3": F.lit(238.0),
        "cl1": 1.89 + 0.0456 * (w - 77) - 0.0681 * (m - 59) + 0.0264 * (h - 177),
        "cl2": 1.29 - 0.024 * (age - 53),
        "cl3": F.lit(0.836),
        "ke0": F.lit(0.456),
    })


def remifentanil_parameters(df: DataFrame) -> DataFrame:
    """Minto's model."""
    age = F.col("age") - 40
    m = lean_mass(F.col("weight"), F.col("height"), F.col("sex_male"))
    l_ = m - 55
    return df.withColumns({
        "lean_mass": m,
        "v1": 5.1 - 0.0201 * age + 0.072 * l_,
        "v2": 9.82 - 0.0811 * age + 0.108 * l_,
        "v3": F.lit(5.42),
        "cl1": 2.6 - 0.0162 * age + 0.0191 * l_,
        "cl2": 2.05 - 0.030 * age,
        "cl3": 0.076 - 0.00113 * age,
        "ke0": 0.595 - 0.007 * age,
    })


def predicted_index(ce_p: Column, ce_r: Column) -> Column:
    effect = F.pow(1 + ce_p / HALF_P + ce_r / HALF_R, F.lit(-STEEP))
    return F.greatest(F.lit(0.0), F.least(F.lit(100.0), BASE * effect))


def system(v1: float, v2: float, v3: float, cl1: float, cl2: float, cl3: float, ke0: float) -> np.ndarray:
    """Rates per second of three compartments (amounts), the effect site, and a constant input as fifth state."""
    out = np.zeros((5, 5))
    out[0, 0], out[0, 1], out[0, 2], out[0, 4] = -(cl1 + cl2 + cl3) / v1, cl2 / v2, cl3 / v3, 1
    out[1, 0], out[1, 1] = cl2 / v1, -cl2 / v2
    out[2, 0], out[2, 2] = cl3 / v1, -cl3 / v3
    out[3, 0], out[3, 3] = ke0 / v1, -ke0
    return out / 60


def exponential(a: np.ndarray) -> np.ndarray:
    """Matrix exponential by halving, a Taylor series and squaring."""
    n = max(0, int(np.ceil(np.log2(max(np.abs(a).sum(1).max(), 1e-16)))) + 4)
    a, out, term = a / 2**n, np.eye(len(a)), np.eye(len(a))
    for k in range(1, 13):
        term = term @ a / k
        out = out + term
    for _ in range(n):
        out = out @ out
    return out


def exponentials(a: np.ndarray) -> np.ndarray:
    """exponential() of many matrices, each with its own number of squarings."""
    squarings = np.maximum(0, np.ceil(np.log2(np.maximum(np.abs(a).sum(2).max(1), 1e-16))).astype(int) + 4)
    a = a / (2.0**squarings)[:, None, None]
    out = np.tile(np.eye(a.shape[1]), (len(a), 1, 1))
    term = out
    for k in range(1, 13):
        term = term @ a / k
        out = out + term
    for n in range(squarings.max(initial=0)):
        more = np.flatnonzero(squarings > n)
        out[more] = out[more] @ out[more]
    return out


def side_by_side(begins: np.ndarray, n: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """The numbers of the chunks that have a first, second, ... row, and these rows."""
    sizes = np.diff(np.append(begins, n))
    longest = np.argsort(-sizes, kind="stable")
    for j in range(sizes.max(initial=0)):
        longest = longest[: np.searchsorted(-sizes[longest], -j)]
        yield longest, begins[longest] + j


def rate_status(df: DataFrame, rate: str, evidence: list[str], case: str = "caseid", time: str = "time_sec", tolerance: float = 1e-8) -> DataFrame:
    """df with `start` (first time with a rate) and `known`: nothing was given before it, as far as `evidence` tells."""
    w = Window.partitionBy(case)
    start = F.min(F.when(F.col(rate).isNotNull(), F.col(time))).over(w)
    seen = [F.coalesce(F.col(c), F.lit(0.0)) for c in evidence]
    most = F.max(F.when(F.col(time) <= F.col("start"), F.greatest(*seen) if len(seen) > 1 else seen[0])).over(w)
    return df.withColumn("start", start).withColumn("known", F.col("start").isNotNull() & (F.coalesce(most, F.lit(0.0)) <= tolerance))


def scan(maps: np.ndarray, inputs: np.ndarray, block: int = 64) -> tuple[np.ndarray, np.ndarray]:
    """For s -> maps[k] s + inputs[k] one after the other: the map and the input from before the first to after each.

    Blocks go side by side, first each from its own beginning, then each after all that stand before it.
    """
    n, size = inputs.shape
    blocks = -(-n // block)
    whole, part = np.tile(np.eye(size), (blocks * block, 1, 1)), np.zeros((blocks * block, size))
    whole[:n], part[:n] = maps, inputs
    whole, part = whole.reshape(blocks, block, size, size), part.reshape(blocks, block, size)
    for j in range(1, block):
        step = whole[:, j].copy()
        part[:, j] += np.einsum("bij,bj->bi", step, part[:, j - 1])
        whole[:, j] = step @ whole[:, j - 1]
    for b in range(1, blocks):
        part[b] += whole[b] @ part[b - 1, -1]
        whole[b] = whole[b] @ whole[b - 1, -1]
    return whole.reshape(-1, size, size)[:n], part.reshape(-1, size)[:n]


def concentrations(df: DataFrame, rate: str, parameters: DataFrame, evidence: list[str], hold: int = 10, case: str = "caseid", time: str = "time_sec", span: int = 3600) -> DataFrame:
    """case, time, plasma, effect and status per row of df.

    The state is zero at the first rate; the rate seen at t acts on (t, next]; a rate older than `hold` seconds ends
    the series. Times of a case are distinct.

    A case is cut into chunks of `span` seconds, which different tasks can take. What a chunk needs of those before it
    (last rate, last time) is one row for each chunk. The recurrence is affine, so that a chunk is first reduced to one
    map; the maps of a case are put together in order, and with the state that each chunk starts from its rows follow.
    """
    chunk = F.floor(F.col(time) / span).cast("long").alias("_chunk")
    rows = df.select(case, time, F.when(~F.isnan(F.col(rate).cast("double")), F.col(rate).cast("double")).alias("_seen"), F.greatest(*(F.coalesce(F.col(c).cast("double"), F.lit(0.0)) for c in evidence), F.lit(0.0)).alias("_evidence"), chunk)
    starts = rows.groupBy(case).agg(F.min(F.when(F.col("_seen").isNotNull(), F.col(time))).alias("_start"))
    given = rows.join(starts, case).groupBy(case, "_start").agg(F.max(F.when(F.col(time) <= F.col("_start"), F.col("_evidence"))).alias("_most"))
    people = given.select(case, "_start", (F.col("_start").isNotNull() & (F.coalesce("_most", F.lit(0.0)) <= 1e-8)).alias("_known")).join(parameters, case)
    before = Window.partitionBy(case).orderBy("_chunk")
    ends = rows.groupBy(case, "_chunk").agg(F.max_by(F.when(F.col("_seen").isNotNull(), F.struct(F.col("_seen").alias("r"), F.col(time).alias("t"))), F.when(F.col("_seen").isNotNull(), F.col(time))).alias("_last"), F.max(time).alias("_end"))
    held = F.last("_last", ignorenulls=True).over(before.rowsBetween(Window.unboundedPreceding, -1))
    carried = ends.select(case, "_chunk", F.lag("_end").over(before).alias("_end"), held["r"].alias("_rate"), held["t"].alias("_since"))
    names = ["v1", "v2", "v3", "cl1", "cl2", "cl3", "ke0"]
    joined = rows.join(people.select(case, "_start", "_known", *names), case).join(carried, [case, "_chunk"])

    kind = df.schema[case].dataType.simpleString()

    def chunks(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        """Batches of a sorted task that end with a chunk; one chunk at most, of `span` distinct seconds, waits for its rest."""
        open_ = None
        for frame in batches:
            frame = frame if open_ is None else pd.concat([open_, frame], ignore_index=True)
            last = (frame[case] == frame[case].iloc[-1]) & (frame["_chunk"] == frame["_chunk"].iloc[-1])
            open_ = frame[last].reset_index(drop=True)
            if not last.all():
                yield frame[~last].reset_index(drop=True)
        if open_ is not None and len(open_):
            yield open_

    def walk(frame: pd.DataFrame) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Of chunks in order: where each begins, the map and input of each row, and when each chunk's rate is stale (else infinity)."""
        t, seen = frame[time].to_numpy(float), frame["_seen"].to_numpy(float)
        new = np.append(True, (frame[case].to_numpy()[1:] != frame[case].to_numpy()[:-1]) | (frame["_chunk"].to_numpy()[1:] != frame["_chunk"].to_numpy()[:-1]))
        begins = np.flatnonzero(new)
        own = np.maximum.accumulate(np.where(new, np.arange(len(t)), 0))
        # the row of the last rate before a row, if it is in the chunk
        last = np.append(-1, np.maximum.accumulate(np.where(~np.isnan(seen), np.arange(len(t)), -1))[:-1])
        here = last >= own
        known = np.where(here, seen[last], frame["_rate"].to_numpy(float))
        when = np.where(here, t[last], frame["_since"].to_numpy(float))
        start = frame["_start"].to_numpy(float)
        start = np.where(np.isnan(start), np.inf, start)
        end = frame["_end"].to_numpy(float)
        before_ = np.where(new, np.where(np.isnan(end), t, end), np.append(0.0, t[:-1]))
        gaps = np.where(t > start, t - before_, 0.0)
        # equal gaps of a chunk share their step
        pairs, at = np.unique(np.column_stack([own, gaps]), axis=0, return_inverse=True)
        models = np.stack([system(*values) for values in frame.loc[begins, names].to_numpy(float)])
        steps = exponentials(models[np.searchsorted(begins, pairs[:, 0])] * pairs[:, 1][:, None, None])[at.ravel()]
        inputs = steps[:, :4, 4] * (np.nan_to_num(known) * (gaps > 0))[:, None]
        late = (t > start) & (t - when > hold)
        return begins, steps[:, :4, :4], inputs, np.minimum.reduceat(np.where(late, t, np.inf), begins)

    def reduce_(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in chunks(batches):
            begins, steps, inputs, stale = walk(frame)
            # the map in the first four columns, the input in the fifth
            first = np.tile(np.eye(4, 5), (len(begins), 1, 1))
            for chunk_, rows_ in side_by_side(begins, len(frame)):
                first[chunk_] = steps[rows_] @ first[chunk_]
                first[chunk_, :, 4] += inputs[rows_]
            ends_ = frame.loc[begins, [case, "_chunk"]].reset_index(drop=True)
            yield ends_.assign(_map=list(first[:, :, :4].reshape(-1, 16)), _part=list(first[:, :, 4]), _stale=stale)

    def compose(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        """The state that each chunk starts from; chunks come in order of case and place."""
        of, state, stale = None, np.zeros(4), np.inf
        for frame in batches:
            states, ended = [], []
            for key, m, part, own in zip(frame[case], frame["_map"], frame["_part"], frame["_stale"], strict=True):
                if key != of:
                    of, state, stale = key, np.zeros(4), np.inf
                states.append(state)
                stale = min(stale, own)
                ended.append(stale)
                state = np.asarray(m).reshape(4, 4) @ state + np.asarray(part)
            yield frame[[case, "_chunk"]].assign(_state=states, _stale=ended)

    # rows of many chunks meet in a batch, in order
    ordered = joined.repartition(case, "_chunk").sortWithinPartitions(case, "_chunk", time)
    maps = ordered.mapInPandas(reduce_, f"{case} {kind}, _chunk long, _map array<double>, _part array<double>, _stale double")
    begun = maps.repartition(case).sortWithinPartitions(case, "_chunk").mapInPandas(compose, f"{case} {kind}, _chunk long, _state array<double>, _stale double")

    def replay(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in chunks(batches):
            begins, steps, inputs, _ = walk(frame)
            state, states = np.stack(frame.loc[begins, "_state"].to_numpy()).astype(float), np.empty((len(frame), 4))
            for chunk_, rows_ in side_by_side(begins, len(frame)):
                state[chunk_] = np.einsum("bij,bj->bi", steps[rows_], state[chunk_]) + inputs[rows_]
                states[rows_] = state[chunk_]
            t, start = frame[time].to_numpy(float), frame["_start"].to_numpy(float)
            start = np.where(np.isnan(start), np.inf, start)
            status = np.where(~frame["_known"].to_numpy(bool), "unknown_start", np.where(t < start, "before_start", np.where(t >= frame["_stale"].to_numpy(float), "stale", "ok")))
            ok = status == "ok"
            yield frame[[case, time]].assign(plasma=np.where(ok, states[:, 0] / frame["v1"].to_numpy(float), np.nan), effect=np.where(ok, states[:, 3], np.nan), status=status)

    again = joined.join(begun, [case, "_chunk"]).repartition(case, "_chunk").sortWithinPartitions(case, "_chunk", time)
    found = again.mapInPandas(replay, f"{case} {kind}, {time} long, plasma double, effect double, status string")
    number = lambda c: F.when(~F.isnan(c), F.col(c)).alias(c)
    return found.select(case, time, number("plasma"), number("effect"), "status")


__all__ = ["concentrations", "exponential", "exponentials", "lean_mass", "predicted_index", "propofol_parameters", "rate_status", "remifentanil_parameters", "scan", "system"]

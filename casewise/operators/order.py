"""Places, quantiles and modes over whole tables, worked out by ranges so that no task sorts or holds all rows."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

#: Values of one bracket that may come to the driver, and the share of ranks that a round leaves about a target.
FEW, NEAR = 10_000, 0.002


def position(df: DataFrame, name: str) -> Column:
    """A number that grows with the column: itself, or what the first six bytes of a text spell."""
    kind = df.schema[name].dataType
    if isinstance(kind, T.StringType):
        return F.conv(F.rpad(F.hex(F.substring(F.col(name).cast("binary"), 1, 6)), 12, "0"), 16, 10).cast("double")
    return F.col(name).cast("double")


def numbered(df: DataFrame, order: list[str], name: str, by: list[str] | None = None, levels: list[str] | None = None) -> DataFrame:
    """df with `name`, gapless numbers from 0 in the order of columns (rising), within `by`.

    Rows are dealt by ranges of the first column of the order, between its approximate quantiles; numbers inside a range
    are shifted by a table of how many rows the ranges below hold, with one row for each range. `levels`: columns before
    the order that have few values (with many ties, so that ranges of them alone would be uneven); they come first.
    Rows that agree in the whole order take their numbers in no stated order; nulls come first.
    """
    by, levels = by or [], levels or []
    ranges = max(2, int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    placed = df.withColumn("_at", position(df, order[0]))
    shares = F.array(*(F.lit(k / ranges) for k in range(1, ranges)))
    borders = placed.groupBy(*by).agg(F.array_distinct(F.percentile_approx("_at", shares, 10_000)).alias("_borders"))
    # one row for each group of `by`
    dealt = placed.join(F.broadcast(borders), by) if by else placed.join(F.broadcast(borders))
    dealt = dealt.withColumn("_part", F.coalesce(F.size(F.filter("_borders", lambda x: x < F.col("_at"))), F.lit(-1))).drop("_borders", "_at")
    parts = [*by, *levels, "_part"]
    counts = dealt.groupBy(*parts).agg(F.count("*").alias("_n"))
    below = Window.partitionBy(*by).orderBy(*levels, "_part").rowsBetween(Window.unboundedPreceding, -1)
    before = counts.select(*(F.col(c).alias(f"_{c}_") for c in parts), F.coalesce(F.sum("_n").over(below), F.lit(0)).alias("_before"))
    inside = F.row_number().over(Window.partitionBy(*parts).orderBy(*order)) - 1
    same = [F.col(c).eqNullSafe(F.col(f"_{c}_")) for c in parts]
    met = dealt.withColumn("_inside", inside).join(before, same)
    return met.select(*df.columns, (F.col("_before") + F.col("_inside")).cast("long").alias(name))


def least_before(levels: DataFrame, order: str, value: str, name: str, by: list[str]) -> DataFrame:
    """levels with `name`, the least value of the rows of its group that come strictly earlier in the order; null for none.

    levels holds each order value of a group once. Ranges of the order are met as in numbered(): a task has one range,
    and a table with a row for each range tells the least of those before it.
    """
    ranges = max(2, int(levels.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    placed = levels.withColumn("_at", position(levels, order))
    shares = F.array(*(F.lit(k / ranges) for k in range(1, ranges)))
    borders = placed.groupBy(*by).agg(F.array_distinct(F.percentile_approx("_at", shares, 10_000)).alias("_borders"))
    dealt = placed.join(F.broadcast(borders), by) if by else placed.join(F.broadcast(borders))
    dealt = dealt.withColumn("_part", F.size(F.filter("_borders", lambda x: x < F.col("_at"))))
    earlier = Window.partitionBy(*by).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    parts = dealt.groupBy(*by, "_part").agg(F.min(value).alias("_least"))
    before = parts.select(*by, "_part", F.min("_least").over(earlier).alias("_below"))
    inside = Window.partitionBy(*by, "_part").orderBy(order).rowsBetween(Window.unboundedPreceding, -1)
    met = dealt.withColumn("_inside", F.min(value).over(inside)).join(before, [*by, "_part"])
    return met.select(*levels.columns, F.least("_inside", "_below").alias(name))


def quantiles(df: DataFrame, columns: list[str], shares: list[float]) -> dict[str, list[float | None]]:
    """Exact quantiles of each column, between ranks in proportion; None where nothing is seen. Null and NaN are missing.

    Selection by brackets, for all columns at once: an approximate quantile gives a bracket around each rank, a count
    tells what lies below it and inside, and the next round looks into the bracket alone. Each round leaves about NEAR
    of the ranks, so that three of them do for any table. A bracket with one value is the answer; one with at most FEW
    rows is counted value by value.
    """
    seen = {c: F.when(~F.isnan(F.col(c).cast("double")), F.col(c).cast("double")) for c in columns}
    totals = df.agg(*(F.struct(F.count(v).alias("n"), F.min(v).alias("low"), F.max(v).alias("high")).alias(f"_{k}") for k, v in enumerate(seen.values()))).first()
    # (column, rank from 1) -> bracket: (low, high, rows below it, rows in it)
    open_: dict[tuple[str, int], tuple[float, float, int, int]] = {}
    done: dict[tuple[str, int], float] = {}
    wanted: dict[str, list[tuple[int, int, float]]] = {}
    for k, c in enumerate(columns):
        n, low, high = totals[k]
        wanted[c] = []
        for share in shares:
            if n:
                at = (n - 1) * share
                a, b = math.floor(at) + 1, math.ceil(at) + 1
                wanted[c].append((a, b, at - math.floor(at)))
                open_[c, a] = open_[c, b] = (low, high, 0, n)

    def settle() -> None:
        for key in [key for key, (low, high, _, _) in open_.items() if low == high]:
            done[key] = open_.pop(key)[0]

    settle()
    while open_:
        small = {key: x for key, x in open_.items() if x[3] <= FEW}
        if small:
            brackets = {(c, low, high) for (c, _), (low, high, _, _) in small.items()}
            rows = F.filter(F.array(*(F.when(seen[c].between(low, high), F.struct(F.lit(c).alias("c"), F.lit(low).alias("low"), F.lit(high).alias("high"), seen[c].alias("v"))) for c, low, high in sorted(brackets))), lambda x: x.isNotNull())
            found: dict[tuple, list[tuple[float, int]]] = {}
            for r in df.select(F.explode(rows).alias("x")).groupBy("x.c", "x.low", "x.high", "x.v").count().collect():
                found.setdefault((r["c"], r["low"], r["high"]), []).append((r["v"], r["count"]))
            for key, (low, high, below, _) in small.items():
                for v, n in sorted(found[key[0], low, high]):
                    below += n
                    if below >= key[1]:
                        done[key] = v
                        break
                del open_[key]
        if not open_:
            break
        keys = list(open_)
        near = []
        for c, rank in keys:
            low, high, below, inside = open_[c, rank]
            share = (rank - below) / inside
            near.append(F.percentile_approx(F.when(seen[c].between(low, high), seen[c]), [max(0.0, share - NEAR / 2), min(1.0, share + NEAR / 2)], 10_000))
        guesses = df.agg(*(x.alias(f"_{k}") for k, x in enumerate(near))).first()
        counts = []
        for (c, _), (a, b) in zip(keys, guesses, strict=True):
            v = seen[c]
            counts.append(F.struct(*(F.count(F.when(x, 1)) for x in (v < a, v <= a, v < b, v <= b)), F.max(F.when(v < a, v)), F.min(F.when(v > a, v)), F.max(F.when(v < b, v)), F.min(F.when(v > b, v))))
        row = df.agg(*(x.alias(f"_{k}") for k, x in enumerate(counts))).first()
        for key, (a, b), (under, first, last, upto, under_a, over_a, under_b, over_b) in zip(keys, guesses, row, strict=True):
            low, high, below, inside = open_.pop(key)
            rank = key[1]
            if under < rank <= first:
                done[key] = a
            elif last < rank <= upto:
                done[key] = b
            elif rank <= under:
                open_[key] = (low, under_a, below, under - below)
            elif rank <= last:
                open_[key] = (over_a, under_b, first, last - first)
            else:
                open_[key] = (over_b, high, upto, below + inside - upto)
        settle()
    return {c: [None] * len(shares) if not wanted[c] else [done[c, a] + (done[c, b] - done[c, a]) * f for a, b, f in wanted[c]] for c in columns}


def modes(df: DataFrame, columns: list[str]) -> dict[str, float | None]:
    """The most frequent value of each column, the lowest of equally frequent ones; None where nothing is seen.

    Values are counted by key; only the best of each task's share meet.
    """
    values = df.select(F.explode(F.array(*(F.struct(F.lit(c).alias("c"), F.col(c).cast("double").alias("v")) for c in columns))).alias("x")).where("x.v is not null and not isnan(x.v)")
    counts = values.groupBy("x.c", "x.v").agg(F.count("*").alias("n"))
    best = {r["c"]: -r["best"]["v"] for r in counts.groupBy("c").agg(F.max(F.struct("n", (-F.col("v")).alias("v"))).alias("best")).collect()}
    return {c: best.get(c) for c in columns}

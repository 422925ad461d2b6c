"""Column expressions that several operators share."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def draw(seed: int | Column, *parts: Column | int | str) -> Column:
    """A 32-bit number from the seed and the parts alone, so that it does not depend on how rows are partitioned."""
    cols = [p if isinstance(p, Column) else F.lit(p) for p in (seed, *parts)]
    text = F.concat_ws(":", *(c.cast("string") for c in cols))
    return F.conv(F.substring(F.md5(text), 1, 8), 16, 10).cast("long")


#: Numbers that draws() makes at once, and the shifts and constants of MD5.
AT_ONCE = 8192
SHIFTS = [s for four in ((7, 12, 17, 22), (5, 9, 14, 20), (4, 11, 16, 23), (6, 10, 15, 21)) for s in four * 4]
SINES = [int(abs(math.sin(k + 1)) * 2**32) for k in range(64)]


def draws(prefix: str, n: int) -> Iterator[np.ndarray]:
    """draw() of the places 0 to n - 1 after a prefix of seed and parts, for use inside tasks: arrays of uint32 in order.

    draw() is the first 32 bits of the MD5 of a short text, so one block, here of many texts that differ in their last digits.
    """
    head = prefix.encode()
    low = 0
    while low < n:
        high = min(n, low + AT_ONCE, 10 ** len(str(low)))
        size = len(head) + len(str(low))
        if size > 55:
            raise ValueError("the text of a draw is longer than a block")
        fixed = np.frombuffer(head + b"0" * len(str(low)) + b"\x80" + bytes(55 - size) + (8 * size).to_bytes(8, "little"), "<u4")
        words: list = [int(w) for w in fixed]
        rest = np.arange(low, high, dtype=np.uint32)
        for at in range(size - 1, len(head) - 1, -1):
            rest, digit = np.divmod(rest, np.uint32(10))
            words[at // 4] = words[at // 4] + (digit << np.uint32(8 * (at % 4)))
        words = [w if isinstance(w, np.ndarray) else np.uint32(w) for w in words]
        yield first_word(words, high - low)
        low = high


def first_word(words: list, size: int) -> np.ndarray:
    """The first 32 bits of MD5 for blocks of 16 words, each an array of that size or one number for all."""
    a, b, c, d = (np.full(size, v, np.uint32) for v in (0x67452301, 0xEFCDAB89, 0x98BADCFE, 0x10325476))
    f, u = np.empty(size, np.uint32), np.empty(size, np.uint32)
    for k in range(61):  # the last three steps leave the first word as it is
        if k < 16:
            g = k
            np.bitwise_xor(c, d, out=f)
            np.bitwise_and(f, b, out=f)
            np.bitwise_xor(f, d, out=f)
        elif k < 32:
            g = (5 * k + 1) % 16
            np.bitwise_xor(b, c, out=f)
            np.bitwise_and(f, d, out=f)
            np.bitwise_xor(f, c, out=f)
        elif k < 48:
            g = (3 * k + 5) % 16
            np.bitwise_xor(b, c, out=f)
            np.bitwise_xor(f, d, out=f)
        else:
            g = 7 * k % 16
            np.bitwise_not(d, out=f)
            np.bitwise_or(f, b, out=f)
            np.bitwise_xor(f, c, out=f)
        np.add(f, a, out=f)
        w = words[g]
        if isinstance(w, np.ndarray):
            np.add(f, w, out=f)
            w = 0
        np.add(f, np.uint32((int(w) + SINES[k]) & 0xFFFFFFFF), out=f)
        np.left_shift(f, np.uint32(SHIFTS[k]), out=u)
        np.right_shift(f, np.uint32(32 - SHIFTS[k]), out=f)
        np.bitwise_or(f, u, out=f)
        np.add(f, b, out=f)
        a, b, c, d, f = d, f, b, c, a
    # what the last of these steps made stands second
    return (b + np.uint32(0x67452301)).byteswap()


def region(y: Column, low: float = 40, high: float = 60) -> Column:
    """Target region: both borders belong to the middle."""
    return F.when(y < low, "low").when(y > high, "high").when(y.isNotNull(), "mid")


def zone(y: Column, low: float = 40, high: float = 60) -> Column:
    """Right-closed bins: a value at a border belongs to the bin below."""
    return F.when(y <= low, "deep").when(y <= high, "adequate").when(y.isNotNull(), "light")


def once(df: DataFrame) -> DataFrame:
    """df, computed here and not again: sums of doubles may differ in the last bit from one evaluation to the next."""
    return df.checkpoint() if df.sparkSession.sparkContext.getCheckpointDir() else df.localCheckpoint()


def nan_to_null(df: DataFrame) -> DataFrame:
    """NaN stands for missing on ingest; aggregates skip null only."""
    return df.select(*(F.when(~F.isnan(f.name), F.col(f.name)).alias(f.name) if f.dataType.typeName() in ("double", "float") else F.col(f.name) for f in df.schema.fields))


def pearson(x: Column, y: Column) -> Column:
    """Null for fewer than two pairs or no spread."""
    both = x.isNotNull() & y.isNotNull()
    spread = (F.stddev_pop(F.when(both, x)) > 0) & (F.stddev_pop(F.when(both, y)) > 0)
    return F.when((F.count(F.when(both, 1)) > 1) & spread, F.corr(x, y))


def mid_rank(by: list[str], value: str, descending: bool = False) -> Column:
    """Average rank of ties within `by`."""
    from pyspark.sql.window import Window

    order = F.col(value).desc() if descending else F.col(value).asc()
    return F.rank().over(Window.partitionBy(*by).orderBy(order)) + (F.count("*").over(Window.partitionBy(*by, value)) - 1) / 2

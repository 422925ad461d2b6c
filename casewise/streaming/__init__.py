"""The decision history as a stream: per case the last rows, padded with the first one before the start."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout


def streaming_history(stream: DataFrame, value: str, length: int = 6, interval: int = 10, case: str = "caseid", time: str = "timestamp") -> DataFrame:
    """case, time, history (oldest first) and present for each row of a stream that comes in time order per case.

    State is the last `length` values and times of a case. A gap other than the interval is an error of that row:
    its history is null and the buffer starts afresh.
    """

    def step(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        last, values = state.get if state.exists else (None, [])
        values = list(values)
        for frame in frames:
            out = []
            for t, v in frame.sort_values(time)[[time, value]].itertuples(index=False):
                broken = last is not None and t - last != interval
                values = ([] if broken else values)[-(length - 1) :] + [float(v)]
                last, pad = int(t), length - len(values)
                out.append((key[0], last, None if broken else [values[0]] * pad + values, [0] * pad + [1] * len(values)))
            yield pd.DataFrame(out, columns=[case, time, "history", "present"])
        state.update((last, values))

    return stream.groupBy(case).applyInPandasWithState(step, f"{case} long, {time} long, history array<double>, present array<int>", "last long, recent array<double>", "append", GroupStateTimeout.NoTimeout)

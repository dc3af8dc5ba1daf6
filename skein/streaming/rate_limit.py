"""Fixed-window rate limit as streaming state: one window per key, whatever the number of calls."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

OUTPUT = "key string, at double, taken boolean"


def rate_limited(calls: DataFrame, key: str, at: str, limit: int, seconds: float = 60.0) -> DataFrame:
    """(key, at, taken) for a stream with a string key and a time in seconds. A window starts at its first call; calls
    beyond ``limit`` are refused and count nowhere. Calls of one micro-batch are taken in time order."""

    def step(group: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        start, count = state.get if state.exists else (None, 0)
        rows = pd.concat(list(batches)).sort_values(at)
        taken = []
        for t in rows[at]:
            if start is None or t - start >= seconds:
                start, count = float(t), 0
            taken.append(count < limit)
            count += count < limit
        state.update((start, count))
        yield pd.DataFrame({"key": group[0], "at": rows[at].to_numpy(), "taken": taken})

    return calls.groupBy(key).applyInPandasWithState(step, OUTPUT, "start double, count long", "append", GroupStateTimeout.NoTimeout)

"""Order-dependent operators as streaming state that ends: the lean learner and the fixed-window limit.

State lives in the store of the stream (RocksDB), one small value a key, with a time to live: a run or a caller that is
silent for longer loses its state. Rows of one micro-batch are taken in their order; later batches follow earlier ones.
"""

from __future__ import annotations

import json
from collections.abc import Iterator, Sequence

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from skein.operators.lean import _plain, new_state, take

STORE = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def use_store(spark: SparkSession) -> None:
    """The state store that these operators need, for streams started from now on."""
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", STORE)


class LeanLearner(StatefulProcessor):
    """Items of a run in, their outcomes out; the run's state as JSON."""

    def __init__(self, order: Sequence[str], ttl_ms: int | None):
        self.order, self.ttl_ms = list(order), ttl_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.held = handle.getValueState("learner", "told string", self.ttl_ms)

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        state = json.loads(self.held.get()[0]) if self.held.exists() else new_state()
        items = pd.concat(list(rows)).sort_values(self.order).reset_index(drop=True)
        told = [take(state, _plain(one)) for one in items["readings"]]
        self.held.update((json.dumps(state),))
        found = pd.DataFrame(told, columns=["mode", "reason", "fields", "disagreed", "rescued"])
        yield pd.concat([pd.Series([key[0]] * len(items), name="run"), items[self.order], found], axis=1)

    def close(self) -> None:
        pass


def lean_outcomes(items: DataFrame, run: str, order: Sequence[str], ttl_hours: float | None = 24.0) -> DataFrame:
    """Streaming twin of ``lean.lean_outcomes`` over a stream of ``lean.item_rows``: (run, order, mode, reason, fields, disagreed,
    rescued). A run without items for ``ttl_hours`` starts anew."""
    from skein.operators.lean import OUTCOME

    kept = ", ".join(f"{c} {items.schema[c].dataType.simpleString()}" for c in order)
    schema = f"run {items.schema[run].dataType.simpleString()}, {kept}, {OUTCOME}"
    processor = LeanLearner(order, None if ttl_hours is None else int(ttl_hours * 3_600_000))
    return items.groupBy(run).transformWithStateInPandas(processor, schema, "Append", "None" if ttl_hours is None else "ProcessingTime")


class Window(StatefulProcessor):
    """Calls of a caller in, whether each is taken out; one window a caller."""

    def __init__(self, at: str, limit: int, seconds: float, ttl_ms: int | None):
        self.at, self.limit, self.seconds, self.ttl_ms = at, limit, seconds, ttl_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.held = handle.getValueState("window", "start double, taken long", self.ttl_ms)

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        start, count = self.held.get() if self.held.exists() else (None, 0)
        times = sorted(float(t) for batch in rows for t in batch[self.at])
        taken = []
        for t in times:
            if start is None or t - start >= self.seconds:
                start, count = t, 0
            taken.append(count < self.limit)
            count += taken[-1]
        self.held.update((start, count))
        yield pd.DataFrame({"key": key[0], "at": times, "taken": taken})

    def close(self) -> None:
        pass


def limited(calls: DataFrame, key: str, at: str, limit: int, seconds: float = 60.0, ttl_hours: float | None = None) -> DataFrame:
    """(key, at, taken) for a stream of calls with a time in seconds, as ``queue.rate_limited`` decides it. With ``ttl_hours`` (longer
    than a window) a silent caller's window is forgotten; it would have ended anyway."""
    schema = f"key {calls.schema[key].dataType.simpleString()}, at double, taken boolean"
    ttl = None if ttl_hours is None else max(int(ttl_hours * 3_600_000), int(seconds * 1000) + 1)
    return calls.groupBy(key).transformWithStateInPandas(Window(at, limit, seconds, ttl), schema, "Append", "None" if ttl is None else "ProcessingTime")

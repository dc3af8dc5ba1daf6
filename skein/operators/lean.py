"""When a quick (lean) reading of a page is enough: an ordered learner per run, in batch and as streaming state.

The first ``CHECK`` items of a run are read both ways. After that a field that the quick reading misses, or shows
otherwise, sends its item to the full reading. A disagreement, or ``RESCUES`` items in a row that needed the full reading,
switch the rest of the run to it. A field whose miss (or not-shown mark) the full reading confirmed ``CONFIRMS`` times since its
last rescue is believed.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# Items checked both ways, rescues in a row that switch a run, confirmations that are believed.
CHECK, RESCUES, CONFIRMS = 2, 3, 3
OUTCOME = "mode string, reason string, fields array<string>, disagreed array<string>, rescued array<string>"
#: What a field's reading is: its value either way (null: none), whether it is shown, whether it has paths.
READING = ("field", "lean", "full", "lean_shown", "full_shown", "has_paths")


def new_state() -> dict:
    return {"full": False, "checks": CHECK, "streak": 0, "missed": {}, "unshown": {}}


def take(state: dict, readings: list[dict]) -> tuple:
    """The outcome of one item; ``state`` learns from it. Readings in the order of their fields."""
    if state["full"]:
        return "full", "switched", [], [], []
    missed, unshown = state["missed"], state["unshown"]
    misses = [r["field"] for r in readings if r["has_paths"] and r["lean"] is None and missed.get(r["field"], 0) < CONFIRMS]
    hidden = [r["field"] for r in readings if r["lean"] is not None and r["lean_shown"] is False and unshown.get(r["field"], 0) < CONFIRMS]
    reason, fields = ("check", []) if state["checks"] else ("miss", misses) if misses else ("unshown", hidden) if hidden else (None, [])
    if reason is None:
        state["streak"] = 0
        return "lean", None, [], [], []
    disagreed, rescued = [], []
    for r in readings:
        field, both_hidden = r["field"], r["lean_shown"] is False and r["full_shown"] is False
        if r["lean"] is None and r["full"] is None:
            missed[field] = missed.get(field, 0) + bool(r["has_paths"])
        elif r["lean"] is None or (r["lean"] == r["full"] and r["lean_shown"] is False and r["full_shown"] is True):
            rescued.append(field)
            missed.pop(field, None), unshown.pop(field, None)
        elif r["lean"] != r["full"] or (not both_hidden and r["lean_shown"] is not r["full_shown"]):
            disagreed.append(field)
        elif both_hidden:
            unshown[field] = unshown.get(field, 0) + 1
    state["checks"] -= reason == "check"
    state["streak"] = state["streak"] + 1 if rescued else 0
    state["full"] = bool(disagreed) or state["streak"] >= RESCUES
    return "lean+full", reason, fields, disagreed, rescued


def item_rows(readings: DataFrame, run: str, order: Sequence[str]) -> DataFrame:
    """One row an item: run, the order columns and its readings, by field."""
    return readings.groupBy(run, *order).agg(F.array_sort(F.collect_list(F.struct(*READING))).alias("readings"))


def _plain(readings) -> list[dict]:
    """Readings as dictionaries with plain values, however Arrow hands them over."""
    rows = [r if isinstance(r, dict) else r.asDict() for r in readings]
    return [{k: None if v is None or v is pd.NA else bool(v) if k.endswith("shown") or k == "has_paths" else v for k, v in r.items()} for r in rows]


def lean_outcomes(readings: DataFrame, run: str, order: Sequence[str]) -> DataFrame:
    """(run, order, mode, reason, fields, disagreed, rescued) of every item. A run's items depend on the ones before: they arrive
    sorted, in batches, and the fold keeps the state of one run."""
    items = item_rows(readings, run, order).repartition(F.col(run)).sortWithinPartitions(run, *order)
    kept = [f"{c} {items.schema[c].dataType.simpleString()}" for c in (run, *order)]

    def folds(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        current, state = None, None
        for rows in batches:
            told = []
            for key, one in zip(rows[run], rows["readings"]):
                if state is None or key != current:
                    current, state = key, new_state()
                told.append(take(state, _plain(one)))
            names = ["mode", "reason", "fields", "disagreed", "rescued"]
            yield pd.concat([rows[[run, *order]].reset_index(drop=True), pd.DataFrame(told, columns=names)], axis=1)

    return items.mapInPandas(folds, ", ".join([*kept, OUTCOME]))

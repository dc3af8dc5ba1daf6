"""Connected classes of links: label spreading with pointer jumping over stored edges."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .storage import materialise


def spread_labels(links: DataFrame, rounds: int = 60) -> DataFrame:
    """node and label (the smallest node of its class) for the nodes of ``links`` (leaf, root; both longs or both strings).

    Each round hangs every root below the smallest root its links reach and then halves paths by pointer
    jumping, so the rounds grow with the logarithm of the longest chain. Links within one class drop out.
    """
    edges = materialise(links.where("leaf <> root").select(F.greatest("leaf", "root").alias("high"), F.least("leaf", "root").alias("low")).distinct(), "links")
    nodes = edges.select(F.explode(F.array("high", "low")).alias("node")).distinct()
    parents = None
    for _ in range(rounds):
        if edges.isEmpty():
            break
        step = edges.groupBy(F.col("high").alias("node")).agg(F.min("low").alias("label"))
        jumped = _jump(step)
        parents = jumped if parents is None else materialise(_follow(parents, jumped), "labels")
        to_high = _relabel(edges, jumped, "high")
        both = _relabel(to_high, jumped, "low").where("high <> low")
        edges = materialise(both.select(F.greatest("high", "low").alias("high"), F.least("high", "low").alias("low")).distinct(), "links")
    else:
        raise RuntimeError(f"labels still change after {rounds} rounds")
    if parents is None:
        return nodes.select("node", F.col("node").alias("label"))
    return nodes.join(parents, "node", "left").select("node", F.coalesce("label", "node").alias("label"))


def _jump(step: DataFrame) -> DataFrame:
    """node to root of the forest ``step`` (label < node), by repeated squaring until no label moves."""
    current = materialise(step, "jump")
    while True:
        ahead = current.select(F.col("node").alias("label"), F.col("label").alias("further"))
        moved = materialise(current.join(ahead, "label", "left").select("node", F.coalesce("further", "label").alias("label"), F.col("further").isNotNull().alias("moves")), "jump")
        current = moved.select("node", "label")
        if moved.where("moves").isEmpty():
            return current


def _follow(parents: DataFrame, step: DataFrame) -> DataFrame:
    ahead = step.select(F.col("node").alias("label"), F.col("label").alias("further"))
    moved = parents.join(ahead, "label", "left").select("node", F.coalesce("further", "label").alias("label"))
    return moved.unionByName(step.join(parents, "node", "left_anti"))


def _relabel(edges: DataFrame, step: DataFrame, end: str) -> DataFrame:
    ahead = step.select(F.col("node").alias(end), "label")
    other = "low" if end == "high" else "high"
    return edges.join(ahead, end, "left").select(F.coalesce("label", end).alias(end), other)

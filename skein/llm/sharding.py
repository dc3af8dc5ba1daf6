"""Sharding into byte-balanced shards by Karmarkar-Karp differencing of indivisible groups.

A group is all rows with equal text (null counts as empty), so copies never part. Groups are dealt by hash into
blocks of bounded size; each block is differenced into ``shards`` partial sums, and blocks are in turn partial
partitions that the same differencing combines, level by level, until one remains. Every task holds at most
``BLOCK`` partial partitions, whatever the corpus, and a block's shard numbers follow from permutations.

Slots number a shard's rows from 0 without gaps: rows fall into about sqrt(rows) hash ranges per shard, each
range is numbered by a window and starts where the counts of the ranges before it end. A group larger than a
shard's share stays whole; its shard then exceeds the mean by what cannot be divided. Groups too large for a task are
broadcast to their rows.

Defined results: null ids are rows like any other, and ids of any type come back as they are; repeated rows are in one
group and have slots of their own; texts of any length are read whole and never moved; other columns are not read, so
names cannot clash; empty tables give no rows.
"""

from __future__ import annotations

import heapq
import itertools

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .rows import large_groups, meet_groups
from .storage import materialise

#: Partial partitions that one task combines at most (on average; blocks are dealt by hash).
BLOCK = 4096


def karmarkar_karp(sums: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Combine partial partitions (rows of ``sums``, one column a shard) until one is left.

    Returns the total per shard and, for each input row, the shard to which each of its columns goes. The two
    partitions with the largest spread are joined largest to smallest, again and again.
    """
    n, shards = sums.shape
    order = np.argsort(-sums, axis=1, kind="stable")
    ranked = list(np.take_along_axis(sums, order, axis=1))
    heap = [(-int(r[0] - r[-1]), i) for i, r in enumerate(ranked)]
    heapq.heapify(heap)
    joined: list[tuple[int, int, np.ndarray]] = []
    while len(heap) > 1:
        (_, a), (_, b) = heapq.heappop(heap), heapq.heappop(heap)
        both = ranked[a] + ranked[b][::-1]
        by_size = np.argsort(-both, kind="stable")
        ranked[a], ranked[b] = both[by_size], None
        joined.append((a, b, by_size))
        heapq.heappush(heap, (-int(ranked[a][0] - ranked[a][-1]), a))
    places = np.empty((n, shards), dtype=np.int64)
    top = heap[0][1]
    at: dict[int, np.ndarray] = {top: np.arange(shards)}
    for a, b, by_size in reversed(joined):
        before = np.empty(shards, dtype=np.int64)
        before[by_size] = at[a]
        at[a], at[b] = before, before[::-1]
    for i in range(n):
        places[i, order[i]] = at[i]
    return ranked[top], places


def _difference(level: int, shards: int):
    def one_block(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        sums = np.zeros((len(rows), shards), dtype=np.int64)
        if level == 0:
            sums[:, 0] = rows["bytes"].to_numpy()
        else:
            sums[:] = np.stack(rows["sums"].to_numpy())
        total, places = karmarkar_karp(sums)
        return pd.DataFrame(
            {
                "member": rows["member"],
                "parent": key[0],
                "places": [p[:1] for p in places] if level == 0 else list(places),
                "sums": [total if i == 0 else None for i in range(len(rows))],
            }
        )

    return one_block


def assign_groups(groups: DataFrame, shards: int) -> DataFrame:
    """``groups``: member (binary), bytes (long). Returns member and shard."""
    spark = groups.sparkSession
    count = groups.count()
    hashed = groups.select(F.col("member"), "bytes", F.xxhash64("member").alias("spread"))
    levels = []
    current = hashed
    for level in itertools.count():
        blocks = max(1, -(-count // BLOCK))
        kind = "member binary" if level == 0 else "member long"
        dealt = current.withColumn("parent", F.pmod("spread", F.lit(blocks)) if level == 0 else F.pmod(F.xxhash64("member"), F.lit(blocks)))
        done = materialise(dealt.groupBy("parent").applyInPandas(_difference(level, shards), f"{kind}, parent long, places array<long>, sums array<long>"), f"shard-{level}")
        levels.append(done)
        if blocks == 1:
            break
        current = done.where("sums is not null").select(F.col("parent").alias("member"), "sums")
        count = blocks
    where = spark.range(1).select(F.col("id").alias("parent"), F.array(*[F.lit(i).cast("long") for i in range(shards)]).alias("map"))
    for level, done in reversed(list(enumerate(levels))):
        led = done.select("member", "parent", "places").join(where, "parent")
        moved = F.transform("places", lambda p: F.element_at("map", (p + 1).cast("int")))
        where = led.select(F.col("member").alias("parent"), moved.alias("map"))
    return where.select(F.col("parent").alias("member"), F.element_at("map", 1).cast("int").alias("shard"))


def number_rows(rows: DataFrame, key: str, tie: list) -> DataFrame:
    """Add ``slot``: positions 0, 1, ... within ``key``, in an order that hashes give; no task sees a whole key."""
    per_key = rows.groupBy(key).agg(F.ceil(F.sqrt(F.count("*").cast("double"))).cast("long").alias("ranges"))
    ranged = rows.join(F.broadcast(per_key), key).withColumn("range", F.pmod(F.xxhash64(*tie), F.col("ranges")))
    counts = ranged.groupBy(key, "range").agg(F.count("*").alias("in_range"))
    upto = W.partitionBy(key).orderBy("range").rowsBetween(W.unboundedPreceding, 0)
    starts = counts.withColumn("start", F.sum("in_range").over(upto) - F.col("in_range")).select(key, "range", "start")
    inside = W.partitionBy(key, "range").orderBy(*tie)
    return ranged.join(starts, [key, "range"]).withColumn("slot", F.col("start") + F.row_number().over(inside) - 1).drop("ranges", "range", "start")


def shard_documents(docs: DataFrame, shards: int = 40, overhead: int = 16, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: doc_id, size (UTF-8 bytes plus ``overhead``), text_crc32, law, shard, slot, grown_shard."""
    text = F.coalesce(F.col(text_col), F.lit(""))
    narrow = materialise(
        docs.select(
            F.col(id_col).alias("doc_id"),
            (F.octet_length(text) + overhead).cast("long").alias("size"),
            F.crc32(text.cast("binary")).alias("text_crc32"),
            F.unhex(F.sha2(text, 256)).alias("member"),
        ),
        "shard",
    )
    groups = materialise(narrow.groupBy("member").agg(F.sum("size").alias("bytes"), F.count("*").alias("copies")), "shard-groups")
    assigned = materialise(assign_groups(groups, shards), "shard-assigned")
    placed = meet_groups(narrow, assigned, large_groups(groups, "member", "copies"), "member")
    # materialised: the numbering reads these rows three times and must see one assignment
    slots = number_rows(materialise(placed.drop("member"), "shard-rows"), "shard", [F.col("doc_id"), F.col("text_crc32"), F.col("size")])
    return slots.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))

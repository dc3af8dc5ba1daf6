import zlib
from collections import Counter, defaultdict

import numpy as np

import pytest
from pyspark.sql import functions as F

from skein.llm import rows as R
from skein.llm import sharding
from skein.llm.sharding import karmarkar_karp, shard_documents


def check(rows, source_rows, shards):
    sizes = sorted((len((t or "").encode()) + 16, zlib.crc32((t or "").encode())) for _, t, *_ in source_rows)
    assert sorted((r["size"], r.text_crc32) for r in rows) == sizes
    shard_of = defaultdict(set)
    for r in rows:
        shard_of[r["size"], r.text_crc32].add(r.shard)
    assert all(len(s) == 1 for s in shard_of.values())  # equal texts stay together
    slots = defaultdict(list)
    for r in rows:
        slots[r.shard].append(r.slot)
    assert all(sorted(s) == list(range(len(s))) for s in slots.values()) and max(slots) < shards


def test_shards(awkward, awkward_rows):
    check(shard_documents(awkward, shards=5).collect(), awkward_rows, 5)


def test_many_blocks_stay_balanced(spark, monkeypatch):
    monkeypatch.setattr(sharding, "BLOCK", 32)
    rng = np.random.default_rng(1)
    rows = [(n, "x" * int(s)) for n, s in enumerate(rng.integers(1, 4000, 3000))]
    got = shard_documents(spark.createDataFrame(rows, "doc_id long, text string"), shards=8).collect()
    check(got, rows, 8)
    total = Counter()
    for r in got:
        total[r.shard] += r["size"]
    mean = sum(total.values()) / 8
    assert max(total.values()) - min(total.values()) < 0.01 * mean


def test_differencing_beats_greedy_and_adds_up():
    rng = np.random.default_rng(2)
    for _ in range(20):
        values = rng.integers(1, 10_000, 40)
        sums = np.zeros((40, 4), dtype=np.int64)
        sums[:, 0] = values
        total, places = karmarkar_karp(sums)
        again = np.bincount(places[:, 0], values, 4)
        assert (again == total).all() and total.sum() == values.sum()
        greedy = [0] * 4
        for v in sorted(values, reverse=True):
            greedy[greedy.index(min(greedy))] += v
        assert total.max() - total.min() <= max(greedy) - min(greedy)


def test_one_block_against_plain_differencing(spark):
    """All groups fit one block: the shards' totals are those of differencing the groups by hand."""
    rng = np.random.default_rng(6)
    rows = [(n, "y" * int(s) + str(n % 50)) for n, s in enumerate(rng.integers(1, 500, 300))]
    size = Counter()
    for _, t in rows:
        size[t] += len(t) + 16
    parts = [sorted([float(v)] + [0.0] * 5, reverse=True) for v in size.values()]
    while len(parts) > 1:
        parts.sort(key=lambda p: p[-1] - p[0])
        a, b = parts.pop(0), parts.pop(0)
        parts.append(sorted((x + y for x, y in zip(a, reversed(b))), reverse=True))
    got = Counter()
    for r in shard_documents(spark.createDataFrame(rows, "doc_id long, text string"), shards=6).collect():
        got[r.shard] += r["size"]
    spread = max(got.values()) - min(got.values())
    assert sum(got.values()) == sum(size.values()) and spread <= max(parts[0][0] - parts[0][-1], 40)


@pytest.mark.parametrize("large", [1000, 5])
def test_a_third_of_all_rows_with_one_text(spark, monkeypatch, large):
    monkeypatch.setattr(R, "LARGE_GROUP", large)
    rows = [(n, "same" if n % 3 == 0 else f"text {n}") for n in range(900)]
    check(shard_documents(spark.createDataFrame(rows, "doc_id long, text string"), shards=4).collect(), rows, 4)


@pytest.mark.parametrize("column, kind", [([None, (1 << 53) + 1, (1 << 63) - 1, 1], "long"), ([None, "a", "b", ""], "string")])
def test_ids_come_back_as_they_are(spark, column, kind):
    docs = spark.createDataFrame([(i, f"x{n}", 5) for n, i in enumerate(column)], f"doc_id {kind}, text string, slot long").coalesce(1)
    assert sorted(map(str, (r.doc_id for r in shard_documents(docs, shards=3).collect()))) == sorted(map(str, column))


def test_empty_table(nothing):
    assert shard_documents(nothing).count() == 0

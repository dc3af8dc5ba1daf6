import hashlib
from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from skein.llm import dedup
from skein.llm import rows as R
from skein.llm.dedup import exact_dedup
from skein.llm.rows import PLACE, keep_rows, numbered


def digest():
    return F.sha2(F.coalesce("text", F.lit("")), 256)


@pytest.mark.parametrize("keys, large", [(500_000, 1000), (0, 1)])
def test_against_brute_force(awkward, awkward_rows, monkeypatch, keys, large):
    monkeypatch.setattr(dedup, "BROADCAST_KEYS", keys)  # both with sent and with shuffled keys
    monkeypatch.setattr(R, "LARGE_GROUP", large)
    groups = defaultdict(list)
    for i, text, *_ in awkward_rows:
        groups[hashlib.sha256((text or "").encode()).hexdigest()].append(i)
    got = exact_dedup(awkward.withColumn("d", digest()), carry=("d",)).collect()
    assert len(got) == len(awkward_rows)
    kept = defaultdict(int)
    for r in got:
        ids = groups[r.d]
        known = [i for i in ids if i is not None]
        assert r.group_size == len(ids) and r.keep_id == (max(known) if known else None)
        kept[r.d] += r.kept
    assert set(kept.values()) == {1}


def test_equal_prefixes_and_lengths_are_told_apart(spark):
    long = "p" * 300
    docs = spark.createDataFrame([(1, long + "a"), (2, long + "b"), (3, long + "a"), (4, "q" * 301)], "doc_id long, text string")
    got = {r.doc_id: (r.keep_id, r.group_size, r.kept) for r in exact_dedup(docs).collect()}
    assert got == {1: (3, 2, False), 2: (2, 1, True), 3: (3, 2, True), 4: (4, 1, True)}


@pytest.mark.parametrize("bitmaps", [8000, 0])
def test_rows_kept_whole(awkward, awkward_rows, monkeypatch, bitmaps):
    monkeypatch.setattr(R, "MOST_BITMAPS", bitmaps)  # by bitmaps, and by a shuffle
    rows = numbered(awkward)
    kept = keep_rows(rows, exact_dedup(rows, carry=PLACE).where("kept"))
    assert kept.columns == awkward.columns
    assert sorted(r.text or "" for r in kept.collect()) == sorted({t or "" for _, t, *_ in awkward_rows})


def test_places_of_many_rows(spark, tmp_path):
    spark.range(0, 150_000, 1, 3).write.parquet(str(tmp_path / "t"))
    rows = numbered(spark.read.parquet(str(tmp_path / "t")))
    assert rows.select(*PLACE).distinct().count() == 150_000
    wanted = rows.where("id % 7 = 3 or id between 32760 and 32775")
    assert sorted(r.id for r in keep_rows(rows, wanted).collect()) == sorted(r.id for r in wanted.collect())
    assert keep_rows(rows, wanted.where("id < 0")).count() == 0


def test_clashing_names(spark):
    docs = spark.createDataFrame([(1, "a", 5, 6, 7), (2, "a", 5, 6, 7)], "doc_id long, text string, length long, prefix_hash long, row long")
    got = exact_dedup(docs, carry=("length", "prefix_hash", "row"))
    assert sorted(got.columns) == sorted(["doc_id", "length", "prefix_hash", "row", "keep_id", "group_size", "kept"])
    assert {(r.doc_id, r.length, r.prefix_hash, r.row, r.kept) for r in got.collect()} == {(1, 5, 6, 7, False), (2, 5, 6, 7, True)}
    with pytest.raises(ValueError):
        exact_dedup(docs.withColumn("kept", F.lit(1)), carry=("kept",))


@pytest.mark.parametrize("column, kind", [([None, (1 << 53) + 1, (1 << 63) - 1, 1], "long"), ([None, "a", "b", ""], "string")])
def test_ids_come_back_as_they_are(spark, column, kind):
    docs = spark.createDataFrame([(i, "x") for i in column], f"doc_id {kind}, text string").coalesce(1)
    assert sorted(map(str, (r.doc_id for r in exact_dedup(docs).collect()))) == sorted(map(str, column))


def test_empty_table(nothing):
    assert exact_dedup(nothing).count() == 0

import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from skein.llm.quality import COUNTS, FEATURES, fit_trees, judge_documents, keep_good, statistics_of, train

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def slow_counts(text):
    text = text or ""
    words = WORD.findall(text)
    lines, seen, dup = text.split("\n"), set(), 0
    for line in lines:
        if WORD.search(line):
            dup += line in seen
            seen.add(line)
    grams = [tuple(words[i : i + 5]) for i in range(len(words) - 4)]
    count = {}
    for g in grams:
        count[g] = count.get(g, 0) + 1
    covered = {i + k for i, g in enumerate(grams) if count[g] > 1 for k in range(5)}
    return (len(words), sum(map(len, words)), sum(c in "#*$%&|<>" for c in text), dup, len(covered))


@pytest.fixture(scope="module")
def model(spark, sf_dir):
    return train(spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/labels.parquet"))


def test_counts_against_brute_force(awkward, awkward_rows, model):
    assert all(statistics_of(t.encode() if t is not None else None)[:5] == slow_counts(t) for _, t, *_ in awkward_rows)
    got = judge_documents(awkward, model).collect()
    assert sorted(tuple(r[c] for c in COUNTS) for r in got) == sorted(slow_counts(t) for _, t, *_ in awkward_rows)
    for r in got:
        assert r.base_failed == (r.n_words < 10 or 100 * r.n_repeat_words > 20 * r.n_words)
        assert not (r.base_failed and r.kept)


def test_repeats_in_many_words():
    rng = np.random.default_rng(0)
    for words in (5, 6, 50, 400):
        text = " ".join(str(w) for w in rng.integers(0, 4, words))
        assert statistics_of(text.encode())[:5] == slow_counts(text)


def test_trees_learn_and_keep_directions():
    rng = np.random.default_rng(1)
    x = rng.random((3000, 3))
    y = (x[:, 0] + 0.3 * x[:, 1] + 0.1 * rng.normal(size=3000) > 0.6).astype(float)
    trees = fit_trees(x[:2000], y[:2000], [1, 0, -1])
    p = trees.log_odds(x[2000:]) > 0
    assert (p == (y[2000:] > 0.5)).mean() > 0.9
    probe = np.repeat(rng.random((50, 1, 3)), 40, axis=1)
    for feature, sign in ((0, 1), (2, -1)):
        moved = probe.copy()
        moved[:, :, feature] = np.linspace(0, 1, 40)
        score = trees.log_odds(moved.reshape(-1, 3)).reshape(50, 40)
        assert (sign * np.diff(score, axis=1) >= -1e-9).all()


def test_node_arrays_against_a_walk():
    rng = np.random.default_rng(2)
    x, y = rng.random((500, 4)), rng.integers(0, 2, 500).astype(float)
    trees = fit_trees(x, y, [0, 0, 0, 0], rounds=5)

    def walk(row):
        total = trees.base
        for at in trees.roots:
            while trees.feature[at] >= 0:
                at = trees.left[at] + (row[trees.feature[at]] > trees.threshold[at])
            total += trees.value[at]
        return total

    assert np.allclose(trees.log_odds(x[:50]), [walk(r) for r in x[:50]])


def test_held_out_labels(spark):
    folder = "/root/testdata/sf0.01"
    docs, labels = spark.read.parquet(f"{folder}/documents.parquet"), spark.read.parquet(f"{folder}/labels.parquet")
    learn = F.crc32(F.col("doc_id").cast("string")) % 4 != 0
    judged = judge_documents(docs, train(docs, labels.where(learn))).join(labels.where(~learn), "doc_id").toPandas()
    good, bad = judged[judged.quality == 1], judged[judged.quality == 0]
    assert good.kept.mean() >= 0.95 and bad.kept.mean() <= 0.1


def test_no_labels_keeps_what_passes(awkward, nothing, spark):
    model = train(awkward, spark.createDataFrame([], "doc_id long, quality int"))
    judged = judge_documents(awkward, model)
    assert judged.where("kept = base_failed").count() == 0
    kept = keep_good(awkward, model)
    assert kept.columns == awkward.columns and kept.count() == judged.where("kept").count()
    assert judge_documents(nothing, model).count() == 0


def test_one_direction_for_every_feature():
    assert len(FEATURES) == len(statistics_of(b"")) - 5


def test_verdicts_of_the_query_against_a_plain_walk(spark, sf_dir):
    """``kept`` by walking each tree node by node over the statistics."""
    from skein.llm.quality import FEATURES, statistics_of, train
    from skein.llm.queries import op8_quality

    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    model = train(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    texts = {r.doc_id: (r.text or "").encode() for r in docs.collect()}
    for r in op8_quality(spark, sf_dir).collect():
        stats = dict(zip(["n", "c", "s", "d", "r", *FEATURES], statistics_of(texts[r.doc_id])))
        x, odds = [stats[f] for f in FEATURES], model.base
        for at in model.roots:
            while model.feature[at] >= 0:
                at = model.left[at] + (x[model.feature[at]] > model.threshold[at])
            odds += model.value[at]
        assert r.base_failed == (r.n_words < 10 or 100 * r.n_repeat_words > 20 * r.n_words)
        assert r.kept == (not r.base_failed and odds >= 0)

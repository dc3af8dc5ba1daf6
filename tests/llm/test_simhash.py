import itertools
import re
from collections import defaultdict

import numpy as np
import pytest
import xxhash

from pyspark.sql import functions as F

from skein.llm import rows as R
from skein.llm import simhash
from skein.llm.rows import keep_rows, numbered
from skein.llm.simhash import fingerprint_of, simhash_classes, similar_representatives, spread_labels, trie_pairs


def slow_fingerprint(text):
    low = re.sub("[A-Z]", lambda m: m[0].lower(), text or "")
    words = re.findall(r"[^\x20\x09-\x0D]+", low)
    if not words:
        return 0
    shingles = [" ".join(words[i : i + 3]) for i in range(len(words) - 2)] or [" ".join(words)]
    hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def classes_of(prints):
    """Union-find over all pairs."""
    parent = {p: p for p in prints}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in itertools.combinations(sorted(parent), 2):
        if (a ^ b).bit_count() <= 3:
            parent[find(b)] = find(a)
    return {p: find(p) for p in prints}


def test_fingerprints_against_brute_force(awkward_rows):
    for _, text, *_ in awkward_rows:
        assert fingerprint_of(text.encode() if text is not None else None) == slow_fingerprint(text)


def test_classes_against_brute_force(awkward, awkward_rows):
    prints = [slow_fingerprint(t) for _, t, *_ in awkward_rows]
    label = classes_of(set(prints))
    smallest = {}
    for (i, *_), p in zip(awkward_rows, prints):
        if i is not None:
            smallest[label[p]] = min(i, smallest.get(label[p], i))
    want = sorted((str(i), f"{p:016x}", str(smallest.get(label[p]))) for (i, *_), p in zip(awkward_rows, prints))
    got = sorted((str(r.doc_id), r.fingerprint, str(r.component_id)) for r in simhash_classes(awkward).collect())
    assert got == want


@pytest.mark.parametrize("limit", [2048, 8])
def test_links_of_dense_fingerprints(spark, monkeypatch, limit):
    """A cloud of close fingerprints: with a small limit keys are split and cut into chunk pairs."""
    monkeypatch.setattr(simhash, "LIMIT", limit)
    rng = np.random.default_rng(5)
    base = int(rng.integers(1 << 63))
    prints = {base}
    for _ in range(150):
        p = base
        for b in rng.choice(64, rng.integers(1, 6), replace=False):
            p ^= 1 << int(b)
        prints.add(p)
    prints |= {int(x) for x in rng.integers(1 << 63, size=100)}
    signed = [p - (1 << 64) if p >= 1 << 63 else p for p in sorted(prints)]
    links = simhash.linked_prints(spark.createDataFrame([(p,) for p in signed], "fingerprint long"))
    got = {r.node: r.label for r in spread_labels(links).collect()}
    want = classes_of(prints)
    groups = defaultdict(set)
    for p in prints:
        groups[want[p]].add(p - (1 << 64) if p >= 1 << 63 else p)
    for members in groups.values():
        if len(members) > 1:
            assert len({got[m] for m in members}) == 1
        else:
            assert not (members & set(got))
    assert len({got[m] for m in got}) == sum(len(m) > 1 for m in groups.values())


def test_trie_pairs_against_all_pairs():
    rng = np.random.default_rng(7)
    low = rng.integers(0, 1 << 9, 200, dtype=np.uint64)
    prints = np.unique(low | (rng.integers(0, 2, 200, dtype=np.uint64) << np.uint64(63)))
    i, j = trie_pairs(prints, np.array([0]), np.array([len(prints)]), 3)
    got = {tuple(sorted(p)) for p in zip(i.tolist(), j.tolist())}
    want = {(a, b) for a, b in itertools.combinations(range(len(prints)), 2) if int(prints[a] ^ prints[b]).bit_count() <= 3}
    assert got == want


def test_long_chains_get_one_label(spark):
    links = spark.createDataFrame([(n, n + 1) for n in range(300)] + [(1000, 1001)], "leaf long, root long")
    got = {r.node: r.label for r in spread_labels(links).collect()}
    assert set(got[n] for n in range(301)) == {0} and got[1001] == 1000


def test_large_groups_and_bounded_walks(awkward, monkeypatch):
    want = sorted((str(r.doc_id), r.fingerprint, str(r.component_id)) for r in simhash_classes(awkward).collect())
    monkeypatch.setattr(R, "LARGE_GROUP", 1)
    monkeypatch.setattr(simhash, "WALK_PAIRS", 3)
    assert sorted((str(r.doc_id), r.fingerprint, str(r.component_id)) for r in simhash_classes(awkward).collect()) == want


@pytest.mark.parametrize("column, kind", [([None, (1 << 53) + 1, (1 << 63) - 1, 1], "long"), ([None, "a", "b", ""], "string")])
def test_ids_come_back_as_they_are(spark, column, kind):
    docs = spark.createDataFrame([(i, "x y z") for i in column], f"doc_id {kind}, text string").coalesce(1)
    assert sorted(map(str, (r.doc_id for r in simhash_classes(docs).collect()))) == sorted(map(str, column))


def slow_set(text, n=5):
    low = re.sub("[A-Z]", lambda m: m[0].lower(), text or "")
    words = re.findall(r"[^\x20\x09-\x0D]+", low)
    return frozenset(" ".join(words[i : i + n]) for i in range(len(words) - n + 1)) or frozenset([" ".join(words)] if words else [])


def slow_similar(rows):
    """First rows of the classes of rows (id, text) linked at similarity 0.8, over all pairs."""
    sets = sorted({slow_set(t) for _, t in rows}, key=sorted)
    parent = {x: x for x in sets}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in itertools.combinations(sets, 2):
        if len(a & b) >= 0.8 * len(a | b):
            parent[find(b)] = find(a)
    first = {}
    for i, t in rows:
        c, key = find(slow_set(t)), (i is None, i or 0)
        first[c] = min(first.get(c, key), key)
    return sorted(first.values())


def edited(rng, words, pool, changes):
    out = list(words)
    for at in rng.integers(0, len(out), changes):
        out[at] = str(rng.choice(pool))
    return out


@pytest.mark.parametrize("limit", [2048, 6])
def test_similar_classes_against_all_pairs(spark, monkeypatch, limit):
    """Chains and clouds of edited texts of many lengths, also with keys so small that they are cut into chunk pairs."""
    monkeypatch.setattr(simhash, "LIMIT", limit)
    rng = np.random.default_rng(9)
    pool = [f"w{n}" for n in range(5000)]
    rows, n = [], 0
    for size in (30, 80, 200, 200, 600, 1500):
        words = [str(w) for w in rng.choice(pool, size)]
        for step in range(12):
            rows.append((n, " ".join(words)))
            n += 1
            rows.append((n, " ".join(edited(rng, words, pool, max(1, size // 120)))))
            n += 1
            if step % 4 == 3:
                words = edited(rng, words, pool, max(1, size // 90))
    rows += [(n + k, " ".join(rng.choice(pool, 60))) for k in range(40)]
    rows += [(None, rows[0][1]), (900, ""), (901, None), (902, " \n"), (903, "one two"), (904, "One  two"), (905, rows[3][1].upper())]
    docs = numbered(spark.createDataFrame(rows, "doc_id long, text string"))
    got = sorted((r.doc_id is None, r.doc_id or 0) for r in keep_rows(docs, similar_representatives(docs)).collect())
    assert got == slow_similar(rows)


def test_similar_rows_of_an_empty_table(nothing):
    assert similar_representatives(numbered(nothing)).count() == 0


def test_empty_table(nothing):
    assert simhash_classes(nothing).count() == 0


def brute_classes(texts, share=80):
    """Number of classes of distinct five-word shingle sets linked by ``share`` hundredths or more."""
    sets = sorted({slow_set(t) for t in texts}, key=sorted)
    parent = list(range(len(sets)))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in itertools.combinations(range(len(sets)), 2):
        common = len(sets[a] & sets[b])
        if 100 * common >= share * (len(sets[a]) + len(sets[b]) - common):
            parent[find(b)] = find(a)
    return len({find(n) for n in range(len(sets))})


@pytest.mark.parametrize("limit", [2048, 16])
def test_dense_families_around_the_similarity(spark, monkeypatch, limit):
    """Families of variants that are partly just above and partly just below the similarity: no link is lost to a cap."""
    monkeypatch.setattr(simhash, "LIMIT", limit)
    rng = np.random.default_rng(9)
    pool = [f"w{n}" for n in range(4000)]
    texts = []
    for _ in range(8):
        base = rng.choice(pool, 300)
        for _ in range(40):
            words = base.copy()
            for at in rng.integers(0, 300, rng.integers(2, 9)):
                words[at] = rng.choice(pool)
            texts.append(" ".join(words))
    rows = numbered(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(3))
    kept = keep_rows(rows, similar_representatives(rows)).collect()
    assert len(kept) == brute_classes(texts)

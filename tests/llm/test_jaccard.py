import itertools
import re
from collections import defaultdict

import numpy as np
import pytest

from skein.llm import jaccard
from skein.llm.jaccard import jaccard_classes, linked_pairs, matches_wanted, overlaps
from skein.llm.queries import op13_jaccard


def slow_set(text, n=3):
    words = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    return frozenset(" ".join(words[i : i + n]) for i in range(len(words) - n + 1)) or frozenset([" ".join(words)] if words else [])


def brute(rows, share=90):
    """(doc_id, n_shingles, component_id, n_links) of (doc_id, text) rows, by all pairs that have a shingle in common."""
    sets = [slow_set(t) for _, t in rows]
    parent, links = list(range(len(rows))), [0] * len(rows)

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    by_token = defaultdict(list)
    for n, s in enumerate(sets):
        for t in s:
            by_token[t].append(n)
    seen = {p for group in by_token.values() for p in itertools.combinations(group, 2)}
    for a, b in seen:
        common = len(sets[a] & sets[b])
        if 100 * common >= share * (len(sets[a]) + len(sets[b]) - common):
            links[a] += 1
            links[b] += 1
            parent[find(a)] = find(b)
    first = {}
    for n, (i, _) in enumerate(rows):
        if i is not None:
            first[find(n)] = min(i, first.get(find(n), i))
    return sorted((str(i), len(s), str(first.get(find(n)) if s else i), links[n]) for n, ((i, _), s) in enumerate(zip(rows, sets)))


def told(frame):
    return sorted((str(r.doc_id), r.n_shingles, str(r.component_id), r.n_links) for r in frame.collect())


def family(rng, base, size, changes, pool):
    out = []
    for _ in range(size):
        words = list(base)
        for at in rng.integers(0, len(words), changes):
            words[at] = pool[rng.integers(len(pool))]
        out.append(" ".join(words))
    return out


@pytest.fixture(scope="module")
def families():
    """Groups of near copies, dense and just around the share, of several lengths, among texts of their own; with cases."""
    rng = np.random.default_rng(11)
    pool = [f"w{n}" for n in range(3000)]
    texts = []
    for length, size, changes in ((180, 70, 1), (180, 60, 2), (400, 40, 3), (60, 50, 1), (25, 30, 1), (1200, 12, 8)):
        texts += family(rng, rng.choice(pool, length), size, changes, pool)
    texts += [" ".join(rng.choice(pool, 100)) for _ in range(60)]
    texts += [t.upper() for t in texts[:5]] + texts[:8] + [t + " tail" for t in texts[100:110]]
    texts += [" ".join(t.split()[k:]) for k in range(12) for t in texts[130:133]]
    return list(enumerate(texts))


@pytest.mark.parametrize("settings", [{}, {"HOT": 3, "LIMIT": 16}, {"HOT": 10_000}, {"HOT": 3, "MOST_MATCHES": 1}, {"HOT": 4, "LIMIT_BYTES": 9000, "CHUNK": 900, "BUCKET": 700, "FEW": 3, "COLUMNS": 128}])
def test_families_against_brute_force(spark, families, monkeypatch, settings):
    for name, value in settings.items():
        monkeypatch.setattr(jaccard, name, value)
    docs = spark.createDataFrame(families, "doc_id long, text string").repartition(4)
    assert told(jaccard_classes(docs)) == brute(families)


def test_awkward_rows(spark, awkward, awkward_rows, nothing):
    assert told(jaccard_classes(awkward)) == brute([(i, t) for i, t, *_ in awkward_rows])
    assert jaccard_classes(nothing).count() == 0


@pytest.mark.parametrize("share", [50, 80, 100])
def test_other_shares(spark, families, share):
    some = families[::3]
    docs = spark.createDataFrame(some, "doc_id long, text string")
    assert told(jaccard_classes(docs, share=share)) == brute(some, share)


def test_the_query_against_brute_force(spark, sf_dir):
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text").collect()]
    got = op13_jaccard(spark, sf_dir)
    assert got.columns == ["doc_id", "n_shingles", "component_id", "n_links"] and told(got) == brute(rows)


def test_overlaps_against_sets(monkeypatch):
    rng = np.random.default_rng(1)
    sets = [rng.choice(300, rng.integers(1, 80), replace=False) for _ in range(40)]
    rows, columns = np.repeat(np.arange(40), [len(s) for s in sets]), np.concatenate(sets)
    want = np.array([[len(set(a) & set(b)) for b in sets[25:]] for a in sets[:25]])
    for few, width in ((12, 2048), (2, 64), (100, 128)):
        monkeypatch.setattr(jaccard, "FEW", few)
        monkeypatch.setattr(jaccard, "COLUMNS", width)
        assert (overlaps(rows, columns, np.arange(25), np.arange(25, 40), 40) == want).all()


def test_matches_lengthen_with_their_cost():
    """Cheap further tokens are worth asking for more of; a hot one next is not."""
    rare = np.full(60, 1)
    assert matches_wanted(200, rare, 28) == jaccard.MOST_MATCHES
    assert matches_wanted(200, np.r_[rare[:33], np.full(27, 10_000)], 28) == 1
    assert matches_wanted(1, np.array([4]), 1) == 1


def test_pairs_of_two_sides():
    tokens = [np.arange(10, dtype=np.uint64), np.arange(1, 11, dtype=np.uint64), np.arange(10, dtype=np.uint64), np.arange(50, 60, dtype=np.uint64)]
    n, matches, widths = np.full(4, 10), np.ones(4, dtype=np.int64), np.full(4, 3)
    i, j = linked_pairs(n, matches, widths, tokens, np.array([0, 0, 1, 1]), 80)
    assert sorted(zip(i.tolist(), j.tolist())) == [(0, 2), (1, 2)]
    i, j = linked_pairs(n, matches, widths, tokens, np.full(4, jaccard.OWN), 90)
    assert sorted(zip(i.tolist(), j.tolist())) == [(0, 2)]
    assert not len(linked_pairs(n, matches, widths, tokens, np.zeros(4, dtype=int), 90)[0])

import math
import re
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest

from skein.llm import lm_scoring as L

WORD = re.compile(r"[^\x20\x09-\x0D]+")
PLAIN = L.Layout((12, 14, 14, 14, 14, 14))


def words_of(text):
    return WORD.findall(re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))


def held(i):
    return zlib.crc32(b"" if i is None else str(i).encode()) % 5 == 1


def test_base_score_against_brute_force(awkward, awkward_rows):
    count, docs = Counter(), 0
    for i, text, *_ in awkward_rows:
        if not held(i):
            count.update(words_of(text))
            docs += 1
    n, v = sum(count.values()) + docs, len(count) + 1
    norm = math.log10(n + 0.5 * (v + 1))
    want = []
    for i, text, *_ in awkward_rows:
        c = [count[w] for w in words_of(text)] + [docs]
        want.append((str(i), held(i), len(c), sum(x > 0 for x in c), n, round(sum(math.log10(x + 0.5) - norm for x in c), 5)))
    got = L.score_documents(awkward).collect()
    assert sorted((str(r.doc_id), r.held_out, r.n_tokens, r.n_known, r.train_tokens, round(r.base_score, 5)) for r in got) == sorted(want)
    assert all(r.score < 0 for r in got)


def small_mixer(words, counts):
    tables = np.zeros((PLAIN.slots, 2))
    L.add_counts(tables, L.chunked_words(words, counts, PLAIN))
    learner = L.Mixer(L.Evidence.of(tables.astype(np.float32), True), PLAIN.start_weights(), PLAIN)
    learner.learn(L.chunked_words(words, counts, PLAIN))
    refined = L.no_outcomes()
    learner.outcomes(refined, L.chunked_words(words, counts, PLAIN))
    return L.Mixer(L.Evidence.of(tables.astype(np.float32), False), learner.weights, PLAIN, refined), tables


WORDS = [b"the", b"then", b"there", b"a", b"cat", b"cattle", b"\xc3\xa9t\xc3\xa9", b"tt"]
COUNTS = np.array([500.0, 40, 30, 300, 20, 5, 9, 60])


def test_bits_of_later_bytes_form_a_distribution():
    """Over all next bytes after a prefix the chances of the eight bits multiply out to 1."""
    mixer, _ = small_mixer(WORDS, COUNTS)
    for prefix in (b"t", b"th", b"zz"):
        total = 0.0
        for byte in range(256):
            spelling = L.Spelling.of([prefix + bytes([byte])] if byte != 32 else [prefix], PLAIN)
            at, p = len(prefix) - 1, 1.0
            for k, bit, node, slots in spelling.bits():
                x, gate = mixer.inputs(k, bit, slots)
                p *= mixer.chances(mixer.mixed(x, gate), node, bit)[at]
            total += p
        assert total == pytest.approx(1, abs=1e-3)


def test_first_bytes_form_a_distribution():
    rng = np.random.default_rng(0)
    leaves = np.zeros(((3 << L.BORDER_BITS), 256))
    leaves[rng.integers(0, len(leaves), 5000), rng.integers(97, 123, 5000)] += rng.integers(1, 50, 5000)
    pack = lambda x: L._pack_unit(*[np.array([v]) for v in x])
    sample = np.concatenate([pack((*rng.integers(0, 1 << L.BORDER_BITS, 3), rng.integers(97, 123))) for _ in range(400)])
    mixer = L.train_borders(leaves, sample)
    every = np.concatenate([pack((5, 9, 4000, b)) for b in range(256)])
    assert (10 ** mixer.log10(L.chunked_units(every))).sum() == pytest.approx(1, abs=1e-3)


def test_first_bytes_take_no_sample(spark, monkeypatch):
    """Nothing of a first byte is fitted on a bounded part of the tokens."""

    def none(*_):
        raise AssertionError("a sample is fitted on")

    monkeypatch.setattr(L, "train_borders", none)
    docs = spark.createDataFrame([(i, f"alpha beta{i % 7} gamma") for i in range(60)], "doc_id long, text string")
    assert all(r.score < 0 for r in L.score_documents(docs).collect())


def test_first_bytes_of_all_counts_against_the_learnt_weights(monkeypatch):
    """Chances form a distribution, and tokens that are not counted are foreseen about as well as by weights learnt on a sample."""
    import pyarrow.parquet as pq

    docs = pq.read_table("/root/testdata/sf0.01/documents.parquet", columns=["doc_id", "text"])
    apart, units = np.array([held(i) for i in docs["doc_id"].to_pylist()]), []
    count = L.Block._count_borders

    def noted(self, tokens, starts, learning):
        count(self, tokens, starts, learning)
        previous = L.before(tokens, starts)
        units.append(L._pack_unit(self.whole[previous], self.whole[L.before(previous, starts)], self.tail[previous], self.first[tokens])[~learning])

    monkeypatch.setattr(L.Block, "_count_borders", noted)
    block, texts = L.Block(), docs["text"].combine_chunks().cast(pa.binary()).fill_null(b"")
    for low, part in L.slices(texts):
        block.add(part, apart[low : low + len(part)])
    leaves, unseen = block.leaves.astype(float), np.concatenate(units)[:20_000]
    said, learnt = L.first_bytes(leaves), L.train_borders(leaves, L.split_sample(block.sample())[0])
    every = np.concatenate([L._pack_unit(*[np.array([v]) for v in (5, 9, 400, b)]) for b in range(256)])
    assert (10 ** said.log10(L.chunked_units(every))).sum() == pytest.approx(1, abs=1e-5)
    own, other = (m.log10(L.chunked_units(unseen)).mean() for m in (said, learnt))
    print(own, other)
    assert own > other - 0.05


def test_node_counts_against_a_dictionary():
    leaves = np.zeros((3 << L.BORDER_BITS, 256))
    # the last of the three contexts, the previous word, also gives the counts without a context
    leaves[(2 << L.BORDER_BITS) + 7, [97, 98, 32]] = [5, 2, 1]
    tables = L.border_tables(leaves).reshape(-1, 256, 2)
    want = Counter()
    for byte, count in ((97, 5), (98, 2), (32, 1)):
        for k in range(8):
            want[(1 << k) | (byte >> (8 - k)), (byte >> (7 - k)) & 1] += count
    for place in (0, 1 + (2 << L.BORDER_BITS) + 7):
        assert {(n, b): c for (n, b), c in np.ndenumerate(tables[place]) if c} == want


def test_counts_against_a_dictionary():
    _, tables = small_mixer(WORDS, COUNTS)
    spelling = L.Spelling.of(WORDS, PLAIN)
    want = Counter()
    for _, bit, _, slots in spelling.bits():
        for order in slots:
            for at, b, own in zip(order.tolist(), bit.tolist(), COUNTS[spelling.owner]):
                want[at, b] += own
    assert all(tables[at, b] == own for (at, b), own in want.items())


def test_words_that_occur_score_above_others():
    mixer, _ = small_mixer(WORDS, COUNTS)
    fresh = [b"the", b"cat", b"cqx", b"tqq"]
    score = dict(zip(fresh, mixer.log10(L.chunked_words(fresh, np.ones(4), PLAIN))))
    assert score[b"the"] > score[b"cqx"] and score[b"the"] > score[b"tqq"] and score[b"cat"] > score[b"cqx"]


def plain_decisions(words):
    """The yes-or-no bits of a text about its own earlier words, by dictionaries: (order, foreseen word) at each token."""
    after, out = {}, []
    tokens = [*words, None]
    for i, token in enumerate(tokens):
        seen = []
        for order in (2, 1):
            key = tuple(tokens[i - order : i])
            if i >= order and key in after:
                seen.append((order, after[key] == token))
            if i >= order:
                after[key] = token
        out.append(seen)
    return out


def test_word_decisions_against_dictionaries():
    texts = ["a b a b a b", "", "x", "the cat the cat sat the cat the dog the cat the", "a a a a b a a b"]
    split = [t.split() for t in texts]
    known = L.Numbers()
    numbers = np.array([known[w] for s in split for w in s])
    tokens, starts = L.lay_out(numbers, np.array([len(s) for s in split]))
    (two, one), _ = L.word_decisions(tokens, starts)
    want = [d for s in split for d in plain_decisions(s)]
    got = [[(o, bool(h[i])) for o, (e, h, _) in ((2, two), (1, one)) if e[i]] for i in range(len(tokens))]
    assert got == want


def block_of(texts):
    block = L.Block()
    return block, block.add(pa.array([t.encode() for t in texts], type=pa.binary()), np.zeros(len(texts), dtype=bool))


def test_passages_are_found_wherever_they_stand():
    rng = np.random.default_rng(4)
    pool = [f"w{n}" for n in range(3000)]
    shared = " ".join(rng.choice(pool, 200))
    fresh = lambda n: " ".join(rng.choice(pool, n))
    one, (*_, first, _) = block_of([shared])
    two, (*_, second, found) = block_of([fresh(50), fresh(77) + " " + shared + " " + fresh(9), shared.upper()])
    whole = set(one.passages)
    assert len(whole) >= 4 and whole <= set(two.passages)
    # the part before the end is found inside another text, but for the passage that the end closes
    inside = {two.passages.listed[n] for n in second[found[0] : found[0] + found[1]]}
    assert len(whole & inside) >= len(whole) - 1


def test_order_of_words_matters(spark):
    text = "quick brown foxes jump over seven lazy dogs near old stone bridges"
    rows = [(n, " ".join(np.random.default_rng(n).permutation(text.split())) + " more") for n in range(60)]
    rows += [(1000, text), (1001, " ".join(sorted(text.split())))]
    got = {r.doc_id: r.score for r in L.score_documents(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert abs(got[1000] - got[1001]) > 1e-6


def test_copies_cost_little_and_held_out_bits_beat_the_unigram(spark):
    rng = np.random.default_rng(8)
    pool = ["".join(rng.choice(list("abcdefg"), rng.integers(2, 7))) for _ in range(2000)]
    texts = [" ".join(rng.choice(pool, 150)) for _ in range(120)]
    rows = [(n, t) for n, t in enumerate(texts)] + [(1000 + n, t) for n, t in enumerate(texts[:40])]
    got = {r.doc_id: r for r in L.score_documents(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    # a held-out copy of a training text; its words up to the first anchor are spelt
    twice = [got[1000 + n].bits_per_byte for n in range(40) if held(1000 + n) and not held(n)]
    alone = [got[n].bits_per_byte for n in range(40, 120)]
    assert twice and max(twice) < min(alone)
    both = [got[1000 + n] for n in range(40) if held(1000 + n) and not held(n)]
    assert sum(r.score for r in both) > sum(r.base_score for r in both)


def test_no_training_rows_cost_a_bit_each(spark):
    only_held = [n for n in range(40) if held(n)]
    docs = spark.createDataFrame([(n, "ab cd") for n in only_held], "doc_id long, text string")
    got = L.score_documents(docs).collect()
    assert all(r.train_tokens == 0 and r.n_known == 0 and r.score == pytest.approx(-7 * 8 * math.log10(2), rel=1e-4) for r in got)


@pytest.mark.parametrize("column, kind", [([None, (1 << 53) + 1, (1 << 63) - 1, 1], "long"), ([None, "a", "b", ""], "string")])
def test_ids_come_back_as_they_are(spark, column, kind):
    docs = spark.createDataFrame([(i, "one two three") for i in column], f"doc_id {kind}, text string").coalesce(1)
    assert Counter(r.doc_id for r in L.score_documents(docs).collect()) == Counter(column)


def test_blocks_do_not_matter(awkward, monkeypatch):
    """Counts of all blocks meet; only the weights learnt per partition, and so the spelling, may differ a little."""
    pick = lambda rows: sorted((str(r.doc_id), r.n_tokens, r.n_known, round(r.base_score, 6)) for r in rows)
    one = L.score_documents(awkward).collect()
    monkeypatch.setattr(L, "BLOCK_WORDS", 500)
    monkeypatch.setattr(L, "FAN", 2)
    monkeypatch.setattr(L, "PART_ROWS", 2000)
    other = L.score_documents(awkward).collect()
    assert pick(one) == pick(other)
    a, b = (sorted((str(r.doc_id), r.n_tokens, r.score) for r in rows) for rows in (one, other))
    assert all(x[2] == pytest.approx(y[2], rel=0.1, abs=0.5) for x, y in zip(a, b))


def test_empty_table(nothing):
    assert L.score_documents(nothing).count() == 0


def test_packed_columns_come_back():
    for numbers in ([], [0], [1, 255, 256, 65_536, 1 << 24, (1 << 32) - 1]):
        a, b = np.array(numbers, dtype=np.uint32), np.arange(len(numbers), dtype=np.float32)
        x, y = L._unpack(L._pack(a, b), len(a), np.uint32, np.float32)
        assert x.tolist() == a.tolist() and y.tolist() == b.tolist()


def test_documents_are_sums_of_their_tokens(spark):
    """A plain scorer walks each text token by token with the block's answers and gives the same spelt sum."""
    rng = np.random.default_rng(2)
    pool = [f"{a}{b}" for a in "abcdef" for b in ("", "x", "yy")]
    texts = [" ".join(rng.choice(pool, rng.integers(0, 12))) for _ in range(30)]
    block, (numbers, sizes, _, places, number, found) = block_of(texts)
    borders = L.train_borders(block.leaves.astype(float), L.split_sample(block.sample())[0])
    scorer = L.BlockScorer.__new__(L.BlockScorer)
    listed = block.words.listed
    rest = rng.uniform(-5, -1, len(listed)).astype(np.float32)
    hashes, first, whole, tail = L.word_marks(listed)
    scorer.borders, scorer.norm = borders, 3.0
    scorer.count, scorer.rest = np.r_[0, 30, block.train[: len(listed)]], np.r_[0, 0, rest].astype(np.float32)
    scorer.first, scorer.whole, scorer.tail = block.first, block.whole, block.tail
    scorer.passage_count = scorer.passage_total = np.zeros(max(len(block.passages), 1), dtype=np.int64)
    known, base, spelt, bits = scorer.score(numbers, sizes, places, number, found, np.zeros(len(texts), dtype=bool))
    at = {w.decode(): n for n, w in enumerate(listed)}
    for n, text in enumerate(texts):
        words, total, asked = text.split(), 0.0, 0
        decisions = plain_decisions(words)
        for i, token in enumerate([*words, None]):
            guesses = dict(decisions[i])
            asked += 1 if guesses.get(2) else 0
            if guesses.get(2):
                continue
            if guesses.get(1):
                asked += 1
                continue
            p, q = (words[i - 1] if i else None), (words[i - 2] if i > 1 else None)
            place = lambda w, marks: marks[at[w]] if w is not None else 0
            unit = L._pack_unit(*[np.array([x]) for x in (place(p, whole), place(q, whole), place(p, tail), 32 if token is None else first[at[token]])])
            total += float(borders.log10(L.chunked_units(unit))[0]) + (float(rest[at[token]]) if token is not None else 0)
        assert spelt[n] == pytest.approx(total, abs=1e-4)
        assert bits[n, :, 1].sum() == asked

import zlib
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from skein.llm.packing import WordEncoder, best_fit_decreasing, pack_documents

PATH = public_tokenizers.path("word_bpe_49k.json")


def tokens(tokenizer, text):
    return tokenizer.encode(text or "", add_special_tokens=False).ids + [1]


def test_pieces_against_the_tokenizer(awkward, awkward_rows):
    tokenizer = Tokenizer.from_file(PATH)
    got = pack_documents(awkward, PATH, with_ids=True).collect()
    want = defaultdict(int)
    for i, text, *_ in awkward_rows:
        ids = tokens(tokenizer, text)
        for start in range(0, len(ids), 2048):
            piece = np.array(ids[start : start + 2048], dtype="<u4")
            want[i, start, len(piece), zlib.crc32(piece.tobytes()), len(ids)] += 1
    have = defaultdict(int)
    for r in got:
        have[r.doc_id, r.start, r.length, r.ids_crc32, r.doc_tokens] += 1
        assert len(r.ids) == r.length
    assert have == want
    windows = defaultdict(list)
    for r in got:
        windows[r.sequence_id].append((r.offset, r.length))
    for pieces in windows.values():
        at = 0
        for offset, length in sorted(pieces):
            assert offset == at
            at += length
        assert at <= 2048
    full = sum(r.length for r in got) / 2048
    assert len(windows) <= full + 2


@pytest.mark.parametrize("text", ["a<|endoftext|>b <|STARTOFTEXT|> <|startoftext|>x", "don't we'll 12345 É é ΣΑΣ İ ﬁ", "", "  \n", "\x1c a\x85b c"])
def test_encoder_equals_tokenizer(text):
    encoder, tokenizer = WordEncoder(PATH), Tokenizer.from_file(PATH)
    ids, borders = encoder.encode(pa.array([text.encode(), b"x", text.encode()], type=pa.binary()))
    want = tokenizer.encode(text, add_special_tokens=False).ids
    assert ids[borders[0] : borders[1]].tolist() == want and ids[borders[2] : borders[3]].tolist() == want


def test_encoder_forgets_and_goes_on(monkeypatch):
    from skein.llm import packing

    monkeypatch.setattr(packing, "CACHED_WORDS", 3)
    encoder = WordEncoder(PATH)
    for text in ("one two three four", "four five", "one six"):
        ids, _ = encoder.encode(pa.array([text.encode()], type=pa.binary()))
        assert ids.tolist() == Tokenizer.from_file(PATH).encode(text, add_special_tokens=False).ids


def test_best_fit_decreasing_by_search():
    rng = np.random.default_rng(0)
    lengths = rng.integers(1, 101, 300)
    names, offsets = best_fit_decreasing(lengths, 100)
    used = defaultdict(int)
    for i in np.argsort(-lengths, kind="stable"):
        fits = [100 - u for u in used.values() if 100 - u >= lengths[i]]
        if fits:  # the tightest open window takes it
            assert 100 - used[names[i]] == min(fits)
        else:
            assert names[i] not in used
        assert offsets[i] == used[names[i]]
        used[names[i]] += lengths[i]


@pytest.mark.parametrize("column, kind", [([None, (1 << 53) + 1, (1 << 63) - 1, 1, 1], "long"), ([None, "a", "b", "", ""], "string")])
def test_ids_come_back_as_they_are(spark, column, kind):
    docs = spark.createDataFrame([(i, "one two") for i in column], f"doc_id {kind}, text string").coalesce(1)
    assert Counter(r.doc_id for r in pack_documents(docs, PATH).collect()) == Counter(column)


def test_many_pieces_of_one_id_spread_over_blocks(spark, monkeypatch):
    from skein.llm import packing

    monkeypatch.setattr(packing, "BLOCK", 50)
    docs = spark.range(1000).select(F.lit(None).cast("long").alias("doc_id"), F.lit("some words here").alias("text"))
    blocks = pack_documents(docs, PATH).groupBy(F.shiftright("sequence_id", 32)).count().collect()
    assert len(blocks) == 20 and max(r["count"] for r in blocks) < 100


def test_clashing_names_and_a_long_text(spark):
    docs = spark.createDataFrame([(1, "a b " * 40_000, 5, "x")], "doc_id long, text string, length long, offset string")
    got = pack_documents(docs, PATH).collect()
    assert sum(r.length for r in got) == got[0].doc_tokens and all(r.length == 2048 for r in got[:-1])


def test_empty_table(nothing):
    assert pack_documents(nothing, PATH).count() == 0

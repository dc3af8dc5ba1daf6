import hashlib
import itertools
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from skein.llm import fim
from skein.llm.fim import CLASS, EMIT, FOLLOW, IDLE, POINT, SENTINEL, UNIT, counted, emissions, fill_in_middle, restore, transform_text


def slow(doc_id, text):
    text = text or ""
    units = re.findall(r"[A-Za-z]+|[^A-Za-z]", text)
    n = len(units)
    digest = hashlib.sha256(f"1:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    h1, h2, h3, h4 = (int(digest[k : k + 8], 16) for k in (0, 8, 16, 24))
    a, b = sorted((h1 % (n + 1), h2 % (n + 1)))
    if not text or any(s in text for s in ("<P>", "<S>", "<M>")) or h3 % 100 >= 90:
        return n, "plain", None, None, text
    p, m, s = "".join(units[:a]), "".join(units[a:b]), "".join(units[b:])
    if h4 % 100 < 20:
        return n, "spm", len(p), len(m), f"<S>{s}<P>{p}<M>{m}"
    return n, "psm", len(p), len(m), f"<P>{p}<S>{s}<M>{m}"


def walked(data):
    """The table taken one byte at a time."""
    state, told = IDLE, []
    for b in data:
        told.append(int(EMIT[state, CLASS[b]]))
        state = FOLLOW[state, CLASS[b]]
    return told


PIECES = ["a", "Zz", "<", ">", "P", "<P", "<S>", "<M", "<p>", "é", "漢字", "😀", " ", "\n", "\x00", "<<S>>", "Ḱ", "ǅ"]


def test_three_bytes_settle_the_state():
    for word in itertools.product(range(10), repeat=3):
        ends = set()
        for state in range(7):
            for c in word:
                state = FOLLOW[state, c]
            ends.add(int(state))
        assert len(ends) == 1


@pytest.mark.parametrize("block", [5, 64, 1 << 16])
def test_scan_equals_the_walk(monkeypatch, block):
    monkeypatch.setattr(fim, "BLOCK", block)
    rng = np.random.default_rng(2)
    texts = ["".join(rng.choice(PIECES, 60)).encode() for _ in range(40)] + [rng.integers(0, 256, 300, dtype=np.uint8).tobytes() for _ in range(40)]
    for text in texts:
        data = np.frombuffer(text, dtype=np.uint8)
        want = walked(text)
        got = np.concatenate([emissions(data, k, min(k + block, len(data))) for k in range(0, len(data), block)])
        assert got.tolist() == want
        assert counted(data).sum(axis=0).tolist() == [sum(1 for t in want if t & kind) for kind in (UNIT, POINT, SENTINEL)]


@pytest.mark.parametrize("block", [7, 1 << 16])
def test_texts_against_brute_force(monkeypatch, block):
    monkeypatch.setattr(fim, "BLOCK", block)
    rng = np.random.default_rng(8)
    forms = set()
    for n in range(300):
        text = "".join(rng.choice(PIECES[:6] + PIECES[7:15] + PIECES[16:], rng.integers(0, 50)))
        got = transform_text(str(n), text.encode())
        want = slow(n, text)
        assert (*got[:4], got[4].decode()) == want
        forms.add(got[1])
    assert forms == {"plain", "spm", "psm"}


def test_documents_and_their_way_back(spark, awkward, awkward_rows, monkeypatch):
    monkeypatch.setattr(fim, "BATCH_BYTES", 300)
    got = fill_in_middle(awkward)
    told = sorted((str(r.doc_id), r.n, r.form, str(r.prefix_chars), str(r.middle_chars), r.output) for r in got.collect())
    want = [(i, *slow(i, t)) for i, t, *_ in awkward_rows]
    assert told == sorted((str(i), n, f, str(p), str(m), o) for i, n, f, p, m, o in want)
    back = got.select("output", restore(F.col("output"), F.col("form")).alias("text"))
    assert sorted(r.text for r in back.collect()) == sorted(t or "" for _, t, *_ in awkward_rows)


def test_no_rows(nothing):
    assert fill_in_middle(nothing).count() == 0


def test_sentinels_stay_plain(spark):
    docs = spark.createDataFrame([(n, t) for n in range(30) for t in ("x<P>", "<S>", "a<M>b", "<p><s>")], "doc_id int, text string")
    made = fill_in_middle(docs)
    assert made.where(F.col("output").rlike("^x<P>$|^<S>$|^a<M>b$") & (F.col("form") == "plain")).count() == 90
    assert made.where((F.col("n") == 6) & (F.col("form") != "plain")).count() > 0

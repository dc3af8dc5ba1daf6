import hashlib
import math
import re
from collections import defaultdict

from pyspark.sql import functions as F

from skein.llm.mixing import MixSpec, mix_documents, mix_plan

WORDS = re.compile(r"[^\x20\x09-\x0D]+")


def size(text):
    return len(WORDS.findall(text or ""))


def targets_of(sizes, spec):
    """Targets by filling up step by step: whoever exceeds the cap is set to it, the rest share anew."""
    order = sorted(sizes, key=lambda s: (s is None, s))
    weight = {s: spec.weights[i % len(spec.weights)] for i, s in enumerate(order)}
    left, open_, target = spec.volume * sum(sizes.values()), set(order), {}
    while open_:
        share = left / sum(weight[s] for s in open_)
        over = {s for s in open_ if share * weight[s] >= spec.most * sizes[s]}
        if not over:
            target |= {s: share * weight[s] for s in open_}
            break
        target |= {s: float(spec.most * sizes[s]) for s in over}
        left -= sum(target[s] for s in over)
        open_ -= over
    return target


def test_targets_and_taken_words(awkward, awkward_rows):
    spec = MixSpec()
    sizes = defaultdict(int)
    for _, text, _, source, *_ in awkward_rows:
        sizes[source] += size(text)
    want = targets_of(sizes, spec)
    got = mix_plan(awkward).collect()
    assert len(got) == len(awkward_rows)
    source_of = defaultdict(set)
    for i, text, _, source, *_ in awkward_rows:
        source_of[i, size(text)].add(source)
    taken = defaultdict(int)
    for r in got:
        assert 0 <= r.taken <= 2 * r["size"]
        match = [s for s in want if sizes[s] == r.source_size and math.isclose(want[s], r.target)]
        assert match
        taken[match[0]] += r.taken
    for source, words in taken.items():
        assert abs(words - want[source]) <= 3, source  # repeated ids split what is left at the cut


def test_reruns_agree_and_key_order_decides(awkward):
    a, b = (sorted(mix_plan(awkward.repartition(n)).collect(), key=str) for n in (2, 7))
    assert a == b
    cut = {}
    for r in a:
        epochs, part = divmod(r.taken, max(r["size"], 1))
        key = hashlib.md5(f"42|{'' if r.doc_id is None else r.doc_id}".encode()).hexdigest()
        cut.setdefault(r.source_size, []).append((key, r.taken, r["size"]))
    for rows in cut.values():  # full documents come before cut ones, in key order
        shares = [t / s for _, t, s in sorted(rows) if s]
        assert shares == sorted(shares, reverse=True)


def test_documents_of_the_mix(awkward, awkward_rows):
    mixed = mix_documents(awkward)
    assert mixed.columns == awkward.columns
    words = sum(size(r.text) for r in mixed.collect())
    assert abs(words - sum(r.taken for r in mix_plan(awkward).collect())) == 0


def test_native_plan_has_no_python(awkward):
    for df in (mix_plan(awkward), mix_documents(awkward)):
        plan = df._jdf.queryExecution().optimizedPlan().toString()
        assert not any(w in plan for w in ("Python", "Pandas", "Arrow"))


def test_empty_table(nothing):
    assert mix_plan(nothing).count() == 0 and mix_documents(nothing).count() == 0


def test_one_empty_source(spark):
    docs = spark.createDataFrame([(1, None, "a"), (2, "", "a"), (3, "x y", "b")], "doc_id long, text string, source string")
    got = {r.doc_id: (r.source_size, r.taken) for r in mix_plan(docs).collect()}
    assert got[1] == (0, 0) and got[2] == (0, 0) and got[3][1] <= 4
    assert mix_documents(docs).where(F.col("source") == "a").count() == 2

import numpy as np
import pytest
from pyspark.sql import functions as F

from skein.llm.queries import op10_toxicity
from skein.llm.toxicity import INPUTS, WINDOW, Network, Scorer, fit, score_documents, train, windows_of


def test_windows_cover_every_word():
    for n in (0, 1, 63, 64, 65, 112, 113, 1000):
        w = windows_of(n)
        assert w[0][0] == 0 and w[-1][1] == n and all(b - a <= WINDOW for a, b in w)
        assert all(x[1] > y[0] or n <= WINDOW for x, y in zip(w, w[1:]))


def test_gradients_against_differences():
    rng = np.random.default_rng(0)
    net = Network()
    net.w = {k: v.astype(np.float64) for k, v in net.w.items()}
    inputs, index, size, y = rng.normal(size=(9, INPUTS)), rng.integers(0, 9, (4, WINDOW)), np.array([64, 5, 1, 0]), np.array([1.0, 0, 1, 0])

    def loss():
        z = net.forward(net.project(inputs), index, size)[0].astype(np.float64)
        return float(np.mean(np.log1p(np.exp(z)) - y * z))

    grads = net.gradients(inputs, index, size, y)
    for name, w in net.w.items():
        flat = w.reshape(-1)
        for at in rng.choice(flat.size, min(4, flat.size), replace=False):
            was = flat[at]
            flat[at] = was + 1e-3
            up = loss()
            flat[at] = was - 1e-3
            down = loss()
            flat[at] = was
            assert grads[name].reshape(-1)[at] == pytest.approx((up - down) / 2e-3, abs=2e-3)


def test_scores_do_not_depend_on_the_batch():
    rng = np.random.default_rng(1)
    pool = [f"w{n}".encode() for n in range(50)] + [b"vile", b"nasty"]
    texts = [b" ".join(rng.choice(pool[:50], rng.integers(0, 300))) for _ in range(60)]
    texts = [t + (b" vile nasty" if n % 3 == 0 else b"") for n, t in enumerate(texts)]
    model = fit(texts, np.array([n % 3 == 0 for n in range(60)], dtype=float), epochs=3)
    together = Scorer(model).scores(texts)
    alone = np.concatenate([Scorer(model).scores([t]) for t in texts])
    assert np.allclose(together, alone, atol=1e-4)


def test_held_out_accuracy(spark):
    folder = "/root/testdata/sf0.01"
    scored = op10_toxicity(spark, folder).join(spark.read.parquet(f"{folder}/labels.parquet"), "doc_id").where("held_out").toPandas()
    positive, negative = scored[scored.toxic == 1].score.to_numpy(), scored[scored.toxic == 0].score.to_numpy()
    above = (positive[:, None] > negative[None, :]).mean() + 0.5 * (positive[:, None] == negative[None, :]).mean()
    assert above >= 0.9 and (scored.predicted == scored.toxic).mean() >= 0.9


def test_awkward_rows(awkward, awkward_rows, nothing, spark):
    labels = spark.createDataFrame([(n, n % 2) for n in range(60)] + [(None, 1), (3, None)], "doc_id long, toxic int")
    model = train(awkward, labels)
    got = score_documents(awkward, model).collect()
    assert len(got) == len(awkward_rows) and all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.5) for r in got)
    assert score_documents(nothing, model).count() == 0


def test_without_labels_all_score_alike(awkward, spark):
    model = train(awkward, spark.createDataFrame([], "doc_id long, toxic int"))
    assert score_documents(awkward, model).select(F.count_distinct("score")).first()[0] == 1


def test_held_out_labels_are_not_read(awkward, spark):
    learn = spark.createDataFrame([(n, n % 2) for n in range(60)], "doc_id long, toxic int")
    held = F.crc32(F.col("doc_id").cast("string")) % 5 == 0
    turned = learn.withColumn("toxic", F.when(held, 1 - F.col("toxic")).otherwise(F.col("toxic")))
    a, b = (sorted((str(r.doc_id), r.score) for r in score_documents(awkward, train(awkward, x)).collect()) for x in (learn, turned))
    assert a == b


def plain_score(model, text):
    """Score of one text by loops over windows, words and gates."""
    import math

    w = {k: v.astype(float) for k, v in model.network.w.items()}
    words = text.lower().split()
    sigmoid = lambda x: 1 / (1 + math.exp(-x))
    size = w["u"].shape[1]
    best = -math.inf
    starts = [s for s in range(0, max(1, len(words)), 48) if s == 0 or s + 16 < len(words)]
    for s in starts:
        window = words[s : s + WINDOW]
        inputs = [model.evidence.inputs([x])[0].astype(float) for x in window]
        states = [[], []]
        for d in (0, 1):
            h = np.zeros(size)
            for x in inputs if d == 0 else reversed(inputs):
                g = (x @ w["wx"] + w["bx"])[3 * size * d : 3 * size * (d + 1)]
                a = h @ w["u"][d]
                r = np.array([sigmoid(v) for v in g[:size] + a[:size]])
                z = np.array([sigmoid(v) for v in g[size : 2 * size] + a[size : 2 * size]])
                c = np.tanh(g[2 * size :] + r * a[2 * size :])
                h = c + z * (h - c)
                states[d].append(h)
        both = [np.r_[f, b] for f, b in zip(states[0], reversed(states[1]))]
        pull = np.array([math.exp(x @ w["att"]) for x in both])
        pooled = sum((p * x for p, x in zip(pull / pull.sum(), both)), np.zeros(2 * size)) if both else np.zeros(2 * size)
        best = max(best, float(pooled @ w["out"] + w["b"][0]))
    a, b = model.scale
    return sigmoid(a * best + b)


def test_scores_against_loops():
    rng = np.random.default_rng(4)
    pool = [f"w{n}".encode() for n in range(60)] + [b"vile", b"nasty"]
    texts = [b" ".join(rng.choice(pool[:60], rng.integers(1, 200))) for _ in range(50)]
    texts = [t + (b" vile nasty" if n % 3 == 0 else b"") for n, t in enumerate(texts)]
    model = fit(texts, np.array([n % 3 == 0 for n in range(50)], dtype=float), epochs=2)
    some = texts[:12] + [b"", b"unseen", b" ".join(pool) * 7]
    assert np.allclose(Scorer(model).scores(some), [plain_score(model, t) for t in some], atol=1e-3)


@pytest.mark.parametrize("column, kind", [([None, (1 << 53) + 1, (1 << 63) - 1, *range(30)], "long"), ([None, *"abcdefghijklmnopqrstuvwxyz"], "string")])
def test_ids_of_any_type(spark, column, kind):
    docs = spark.createDataFrame([(i, f"word{n % 2} and more", 0.5) for n, i in enumerate(column)], f"doc_id {kind}, text string, score double").coalesce(1)
    labels = spark.createDataFrame([(i, n % 2) for n, i in enumerate(column)] * 2, f"doc_id {kind}, toxic int")
    got = [r.doc_id for r in score_documents(docs, train(docs, labels)).collect()]
    assert sorted(map(str, got)) == sorted(map(str, column))


def test_long_rows_enter_the_sample(spark, monkeypatch):
    """Only long texts are toxic; they are learnt from all the same, in stretches, and repeated rows count once."""
    from skein.llm import toxicity as T

    monkeypatch.setattr(T, "SAMPLE_CHARS", 2000)
    monkeypatch.setattr(T, "STRETCHES", 10)
    seen = []
    monkeypatch.setattr(T, "fit", lambda texts, labels: seen.append((texts, labels)))
    rows = [(n, ("calm words here " * 5) if n % 2 else "vile things " * 2000) for n in range(60)]
    T.train(spark.createDataFrame(rows + rows[:10], "doc_id long, text string"), spark.createDataFrame([(n, 1 - n % 2) for n in range(60)], "doc_id long, toxic int"))
    texts, labels = seen[0]
    long = [t for t, y in zip(texts, labels) if y == 1]
    assert len(texts) <= 60 and len(long) >= 15 and all(1900 <= len(t) <= 2100 for t in long)

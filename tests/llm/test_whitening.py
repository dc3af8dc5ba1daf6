import math

import numpy as np
import pytest

from skein.llm import whitening
from skein.llm.queries import op11_whitening
from skein.llm.whitening import deviations, whiten


def brute(rows):
    """n, exact deviations, eigenvalues and whitened rows (up to sign), and the trace."""
    x = [[math.floor(64 * float(c)) + 1_000_000 for c in v] for v in rows]
    n, sums = len(x), [sum(c) for c in zip(*x)]
    exact = [sum((n * a - s) ** 2 for a, s in zip(row, sums)) for row in x]
    y = np.array([[(n * a - s) / n for a, s in zip(row, sums)] for row in x])
    values, vectors = np.linalg.eigh(y.T @ y / n)
    return n, exact, values[::-1], y @ vectors[:, ::-1] / np.sqrt(np.maximum(values[::-1], 1e-300)), sum(exact) / n**3


def test_the_query_against_brute_force(spark, sf_dir):
    rows = spark.read.parquet(f"{sf_dir}/embeddings.parquet").orderBy("vec_id").toPandas()
    n, exact, values, white, trace = brute(rows["embedding"])
    got = op11_whitening(spark, sf_dir).toPandas().sort_values(["vec_id", "component"])
    assert got.columns.tolist() == ["vec_id", "component", "n", "deviation", "whitened", "explained", "identity_error"]
    assert len(got) == 32 * n and (got["n"] == n).all()
    assert got["deviation"].to_numpy().reshape(-1, 32).tolist() == [[d] * 32 for d in exact]
    assert np.allclose(np.abs(got["whitened"].to_numpy().reshape(-1, 32)), np.abs(white[:, :32]), atol=1e-6)
    assert np.allclose(got["explained"].to_numpy()[:32], values[:32] / trace, rtol=1e-9)
    found = got["whitened"].to_numpy().reshape(-1, 32)
    assert np.abs(np.cov(found.T, bias=True) - np.eye(32)).max() < 1e-4 and got["identity_error"].max() < 1e-4


AWKWARD = [(1, [0.5, -1.0, 2.0]), (2, None), (3, [0.25, None, 1.0]), (4, [float("nan"), 1.0, 1.0]), (5, [float("inf"), 1.0, 1.0]), (None, [1.5, 0.0, -2.0]),
           (1, [0.5, -1.0, 2.0]), (6, [3.0, 4.0, -1.0]), (7, []), (8, [1.0, 2.0]), (9, [-7.25, 1e9, 0.125]), (10, [0.0, -1e300, 4.0])]


def test_awkward_rows(spark):
    """Null and non-finite entries and other lengths go; repeated rows, null ids and huge entries stay."""
    rows = [(i, v, n, "x") for n, (i, v) in enumerate(AWKWARD)]
    got = whiten(spark.createDataFrame(rows, "vec_id long, embedding array<double>, component int, x string"), components=5).toPandas()
    kept = [v for i, v in AWKWARD if i in (1, None, 6, 9, 10)]
    n, exact, values, white, trace = brute([[max(min(c, 2.0**24), -(2.0**24)) for c in v] for v in kept])
    assert sorted(map(int, got["deviation"][got["component"] == 1])) == sorted(exact)
    # the first direction has nearly all of the variance: the others fall below a millionth of its deviation, or not
    live = int((np.sqrt(values / values[0]) >= whitening.LEAST_SHARE).sum())
    assert got["component"].max() == live and (got["n"] == n).all()
    assert np.allclose(sorted(np.abs(got["whitened"][got["component"] == 1])), sorted(np.abs(white[:, 0])), rtol=1e-9)
    assert got["identity_error"].max() < 1e-4


@pytest.mark.parametrize("rows", [[], [(1, [1.0, 2.0])], [(1, [1.0, 2.0]), (2, [1.0, 2.0])], [(1, None)]])
def test_no_variance_gives_no_rows(spark, rows):
    assert whiten(spark.createDataFrame(rows, "vec_id long, embedding array<float>")).count() == 0


def test_wide_vectors_take_repeated_passes(spark, monkeypatch):
    rng = np.random.default_rng(4)
    rows = [(n, v.tolist()) for n, v in enumerate(rng.normal(size=(400, 120)) * np.linspace(1, 9, 120))]
    table = spark.createDataFrame(rows, "vec_id long, embedding array<double>").repartition(3)
    one = whiten(table, components=4).toPandas().sort_values(["vec_id", "component"])
    monkeypatch.setattr(whitening, "ONE_PASS", 8)
    many = whiten(table, components=4).toPandas().sort_values(["vec_id", "component"])
    assert np.allclose(np.abs(one["whitened"]), np.abs(many["whitened"]), atol=1e-6)
    assert np.allclose(one["explained"], many["explained"], rtol=1e-9)


def test_deviations_are_exact_beyond_longs():
    x = np.array([[1 << 30, 3], [5, 1 << 29]], dtype=np.int64)
    n = 1 << 33
    sums = [n << 29, n << 28]
    _, got = deviations(x, n, sums)
    assert got == [sum((n * a - s) ** 2 for a, s in zip(row, sums)) for row in x.tolist()]
    near, got = deviations(x, 2, x.sum(axis=0).tolist())
    assert got == [sum((2 * a - s) ** 2 for a, s in zip(row, x.sum(axis=0).tolist())) for row in x.tolist()]
    assert np.allclose(near, x - x.mean(axis=0))

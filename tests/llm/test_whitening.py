"""Whitening against numpy's eigenvectors, and the solver on matrices with known spectra."""

import numpy as np
import pytest

from strainwise.llm import catalog, whitening

SF = "/root/testdata/sf0.001"


def brute(vectors, k=8):
    x = np.array([[int(np.floor(1024 * float(c))) + 100_000 for c in v] for v in vectors], dtype=object)
    n, s = len(x), x.sum(0)
    deviation = [sum(int(v) ** 2 for v in n * row - s) for row in x]
    c = (n * x - s).astype(float) / n
    v = c.T @ c / n
    values, vecs = np.linalg.eigh(v)
    return deviation, c @ vecs[:, ::-1][:, :k] / np.sqrt(values[::-1][:k]), values[::-1][:k] / np.trace(v)




def test_query_equals_numpy(spark):
    data = [(r["vec_id"], r["embedding"]) for r in spark.read.parquet(f"{SF}/embeddings.parquet").collect()]
    data = [(i, v) for i, v in data if v is not None and all(c is not None and np.isfinite(c) for c in v)]
    deviation, white, share = brute([v for _, v in data])
    rows = catalog.op11_whitening(spark, SF).collect()
    assert len(rows) == 8 * len(data)
    place = {i: j for j, (i, _) in enumerate(data)}
    got = np.zeros((len(data), 8))
    for r in rows:
        j = place[r["vec_id"]]
        got[j, r["component"] - 1] = r["whitened"]
        assert r["n"] == len(data) and r["deviation"] == deviation[j]
        assert r["explained"] == pytest.approx(share[r["component"] - 1], rel=1e-10) and r["identity_error"] < 1e-9
    signs = np.sign((got * white).sum(0))
    assert np.abs(got * signs - white).max() < 1e-8


class Matrix:
    def __init__(self, m):
        self.m, self.passes = m, 0

    def __matmul__(self, v):
        self.passes += 1
        return self.m @ v


@pytest.mark.parametrize("width,spread", [(1, 0), (6, 0), (40, 0), (200, 0), (64, 1e-9)])
def test_solver_reaches_double_precision(width, spread):
    q, _ = np.linalg.qr(np.random.default_rng(width).standard_normal((width, width)))
    values = np.linspace(3, 1, width)
    values[1:3] = values[:1] * (1 - spread) if spread else values[1:3]  # a cluster
    m = Matrix((q * values) @ q.T)
    found, vectors = whitening.jacobi_davidson(m, width, 8)
    wanted = np.sort(values)[::-1][:8]
    assert np.abs(found - wanted).max() < 1e-12
    assert np.abs(m.m @ vectors - vectors * found).max() < 1e-12
    assert np.abs(vectors.T @ vectors - np.eye(len(wanted))).max() < 1e-12
    assert m.passes < 150


def test_repeated_and_zero_eigenvalues():
    found, vectors = whitening.jacobi_davidson(Matrix(np.diag([3.0] * 3 + [1.0] * 3 + [0.0] * 6)), 12, 8)
    assert np.allclose(found, [3, 3, 3, 1, 1, 1, 0, 0]) and np.allclose(vectors.T @ vectors, np.eye(8))


ROWS = "vec_id long, embedding array<float>, x string, ids string, n long, component string"


def test_edge_rows(spark):
    rng = np.random.default_rng(5)
    good = [(i, rng.normal(size=4).tolist()) for i in range(30)]
    good += [good[3], (None, good[4][1])]  # a repeated row; a null id
    bad = [(100, None), (101, [1.0, None, 2.0, 3.0]), (102, [1.0, float("nan"), 2.0, 3.0]),
           (103, [1.0, float("-inf"), 2.0, 3.0]), (104, [1.0, 2.0]), (105, [])]
    df = spark.createDataFrame([(i, v, "a", "b", 1, "c") for i, v in good + bad], ROWS)
    rows = whitening.whiten(df, components=3).collect()
    assert len(rows) == 3 * 32 and {r["vec_id"] for r in rows} == {*range(30), None}
    deviation, white, _ = brute([np.float32(v) for _, v in good], 3)
    by = {(r["vec_id"], r["component"]): r["whitened"] for r in rows}
    for c in (1, 2, 3):
        own = np.array([by[i, c] for i in range(30)])
        assert np.allclose(own * np.sign(own @ white[:30, c - 1]), white[:30, c - 1])
        assert by[None, c] == by[4, c]
    assert sum(1 for r in rows if r["vec_id"] == 3) == 6
    assert {r["deviation"] for r in rows} == set(deviation)


def test_tables_without_spread(spark):
    for rows in ([], [(1, None)], [(1, [1.0, 2.0])], [(1, [1.0, 2.0]), (2, [1.0, 2.0])]):
        out = whitening.whiten(spark.createDataFrame(rows, "vec_id long, embedding array<double>"))
        assert out.columns == ["vec_id", "component", "n", "deviation", "whitened", "explained", "identity_error"]
        assert out.count() == 0
    line = spark.createDataFrame([(i, [float(i), 2.0 * i]) for i in range(5)], "vec_id long, embedding array<double>")
    assert {r["component"] for r in whitening.whiten(line).collect()} == {1}  # one direction has all the variance


def test_many_partial_sums(spark, monkeypatch):
    monkeypatch.setattr(whitening, "FAN_IN", 2)
    df = spark.createDataFrame([(i, [float(i % 7), float(i % 5), float(i % 3)]) for i in range(100)],
                               "vec_id long, embedding array<double>").repartition(9)
    rows = whitening.whiten(df, components=3).collect()
    assert len(rows) == 300 and all(r["identity_error"] < 1e-10 and r["n"] == 100 for r in rows)

import numpy as np

from strainwise.llm import rp_forest as rp
from strainwise.llm.common import arrow_limits, components

SCHEMA = "vec_id long, embedding array<float>, label int, v string, unit string"


def frame(spark, rows):
    arrow_limits(spark)
    return spark.createDataFrame([(*r, "a", "b") for r in rows], SCHEMA)


def brute(rows, least=0.93):
    good = {}
    for i, x, label in rows:
        x = None if x is None or None in x else np.array(x, np.float32).astype(np.float64)
        if x is not None and label is not None and len(x) and np.isfinite(x).all() and x @ x > 0:
            good[i] = (x / np.sqrt(x @ x), label)
    near = {i: [j for j, (y, m) in good.items() if j != i and i in good and good[i][1] == m and len(y) == len(good[i][0])
                and good[i][0] @ y >= least] for i, _, _ in rows}
    label = {i: i for i, _, _ in rows}
    for _ in rows:
        label = {i: min([label[i], *(label[j] for j in near[i])]) for i in label}
    return {i: (len(near[i]), label[i], label[i] == i) for i in label}


def clustered(n, seed=0, size=16):
    rng = np.random.default_rng(seed)
    centres = rng.normal(size=(n // 6, size))
    rows = []
    for i in range(n):
        x = centres[rng.integers(len(centres))] + rng.normal(size=size) * rng.choice([0.0, 0.1, 0.2, 1.0])
        rows.append((i, [float(v) for v in np.float32(x)], int(rng.integers(2))))
    return rows


def grouped(n, size=64, noise=0.2, seed=4):
    """Vectors of one label, a third of them round one centre; noise 0.2 makes cosines of about 0.96."""
    rng = np.random.default_rng(seed)
    x = rng.normal(size=(n, size))
    x[:n // 3] = x[0] + noise * rng.normal(size=(n // 3, size))
    return np.float32(x)


def told(df):
    return {r["vec_id"]: (r["n_links"], r["component_id"], r["kept"]) for r in df.collect()}


def test_small_leaves_hold_all_pairs(spark):
    odd = [(900, None, 1), (901, [], 1), (902, [0.0] * 16, 1), (903, [float("nan")] * 16, 1), (904, [1.0] * 16, None),
           (905, [None] + [1.0] * 15, 1), (906, [1.0, 2.0], 1), (907, [2.0, 4.0], 1), (908, [float("inf")] * 16, 0)]
    rows = clustered(300) + odd
    assert told(rp.near_vectors(frame(spark, rows))) == brute(rows)


def test_forest_finds_links_and_counts_each_once(spark):
    rows = clustered(1500, seed=2)
    want = brute(rows)
    got = told(rp.near_vectors(frame(spark, rows), leaf_rows=60, block_rows=100))
    assert all(got[i][0] <= want[i][0] for i in want)
    assert sum(g[0] for g in got.values()) >= 0.9 * sum(w[0] for w in want.values())


def test_a_dense_group_keeps_its_links(spark):
    for noise in (0.2, 0.27):  # nearly all of the group's pairs link, and about half of them
        x = grouped(4500, noise=noise)
        got = told(rp.near_vectors(frame(spark, [(i, [float(v) for v in y], 1) for i, y in enumerate(x)]), leaf_rows=30))
        x = x.astype(np.float64)
        x /= np.sqrt((x * x).sum(axis=1, keepdims=True))
        want = (x @ x.T >= 0.93).sum(axis=1) - 1
        assert all(got[i][0] <= want[i] for i in got)
        assert sum(g[0] for g in got.values()) >= 0.97 * want.sum()


def test_copies_are_one_vertex(spark):
    rows = [(i, [1.0, 0.5, 0.25], 1) for i in range(200)] + [(500, [1.0, 0.5, 0.26], 1), (501, [-1.0, 0.0, 0.0], 1)]
    assert told(rp.near_vectors(frame(spark, rows))) == brute(rows)


def test_empty_table(spark):
    assert rp.near_vectors(frame(spark, [])).collect() == []


def test_components_of_a_long_chain(spark):
    edges = spark.createDataFrame([(i, i + 1) for i in range(0, 300)] + [(1000, 1001), (1001, 1000), (5, 5)], "a long, b long")
    for tasks in (1000, 60):
        got = {r["id"]: r["component"] for r in components(edges.repartition(7), tasks).collect()}
        assert got == {i: 0 for i in range(301)} | {1000: 1000, 1001: 1000}
    assert components(edges.limit(0)).collect() == []

"""Near-duplicate vectors by a forest of random-projection trees with spill overlap.

Each tree splits a node by a random direction where the halves make fewest pairs; rows
near the split go to both sides, as near as linked rows usually lie. A node that this
margin keeps together is left whole. Pairs are compared within leaves only, found links
are verified by their cosine in double precision, and united into components.
"""

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from .common import components, records, stored

VECTOR = pa.schema([("id", pa.int64()), ("v", pa.int64()), ("space", pa.int64()), ("unit", pa.binary())])
SPLITS = pa.schema([("node", pa.int64()), ("trees", pa.binary()), ("n_trees", pa.int64())])
ROUTED = pa.schema([("v", pa.int64()), ("leaf", pa.int64()), ("dense", pa.bool_())])
FOUND = pa.schema([("v", pa.int64()), ("links", pa.int64()), ("root", pa.int64())])


def _digest(*parts: bytes) -> int:
    h = hashlib.blake2b(digest_size=8)
    for p in parts:
        h.update(p)
    return int.from_bytes(h.digest(), "little", signed=True)


def _units(batches):
    """Vectors of length 1; the vertex is a digest of label and components, the space of label and size.

    Vectors that are null, zero, or hold a null or non-finite component, and rows without
    a label, get no space.
    """
    for batch in batches:
        rows = []
        for id_, values, label in zip(*[c.to_pylist() for c in batch.columns]):
            space = unit = v = None
            if label is not None and values and None not in values:
                x = np.array(values, np.float64)
                with np.errstate(all="ignore"):
                    top = np.abs(x).max()
                    scaled = x / top if np.isfinite(x).all() and top > 0 else np.zeros(1)
                    norm = np.sqrt(scaled @ scaled)
                if norm > 0:
                    unit = (scaled / norm).tobytes()
                    space = _digest(repr((label, len(x))).encode())
                    v = _digest(repr(label).encode(), unit)
            rows.append((id_, v, space, unit))
        yield records(rows, VECTOR)


def _direction(node: int, tree: int, path: int, pick: int, size: int) -> np.ndarray:
    """The random unit direction of a node, one of several; made anew where it is needed."""
    seed = [node & 0xFFFFFFFF, (node >> 32) & 0xFFFFFFFF, tree, path & 0xFFFFFFFF, path >> 32, pick]
    x = np.random.default_rng(seed).normal(size=size)
    return x / np.sqrt(x @ x)


# a split has to leave at most this share of a node's pairs; as many directions are tried; sampled rows that it needs
WORTH, PICKS, LEAST_SAMPLE = 0.9, 4, 32


def _split(at: np.ndarray, margin: float) -> tuple[float, float, float]:
    """Share of the pairs left by the best split of projections, and its bounds: rows up to high go left, from low right."""
    at = np.sort(at)
    middle = np.quantile(at, np.linspace(0.1, 0.9, 17))
    left = np.searchsorted(at, middle + margin, "right") / len(at)
    right = 1 - np.searchsorted(at, middle - margin, "left") / len(at)
    best = int((left * left + right * right).argmin())
    return float(left[best] ** 2 + right[best] ** 2), middle[best] - margin, middle[best] + margin


def _fit(n_trees: int, leaf_rows: int, reach: float):
    """Splits (tree, path, low, high, pick) of the trees of one node, from its sampled rows.

    Bounds are NaN where a node is too dense to split. The projections of two rows at most
    ``d`` apart differ by ``d / sqrt(size)`` (standard deviation); the margin to each side is
    ``reach``, in units of ``1 / sqrt(size)``. A node whose root is a leaf has one tree only.
    """

    def run(key: tuple[pa.Scalar, ...], batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        node, units, rows = key[0].as_py(), [], 0
        for batch in batches:
            units += batch.column("unit").to_pylist()
            rows = batch.column("rows")[0].as_py()
        x = np.frombuffer(b"".join(units), np.float64).reshape(len(units), -1)
        margin, splits = reach / np.sqrt(x.shape[1]), []
        for tree in range(n_trees):
            held, own_splits = [(1, np.arange(len(x)))], []
            while held:
                path, own = held.pop()
                if rows * len(own) <= leaf_rows * len(x) or len(own) < min(LEAST_SAMPLE, len(x)) or path >> 40:
                    continue
                share, low, high, pick = 1.0, np.nan, np.nan, 0
                for pick in range(PICKS):
                    at = x[own] @ _direction(node, tree, path, pick, x.shape[1])
                    share, low, high = _split(at, margin)
                    if share <= WORTH:
                        break
                if share > WORTH:
                    own_splits.append((tree, path, np.nan, np.nan, 0))
                    continue
                own_splits.append((tree, path, low, high, pick))
                held += [(2 * path, own[at <= high]), (2 * path + 1, own[at >= low])]
            whole = not own_splits or np.isnan(own_splits[0][2])
            if whole:  # every pair meets in this one leaf
                splits = [(0, *one[1:]) for one in own_splits]
                break
            splits += own_splits
        yield records([(node, np.array(splits, np.float64).tobytes(), 1 if whole else n_trees)], SPLITS)

    return run


def _route(known: dict | None):
    """All leaves that a row falls into; splits by node, or in the columns ``trees`` and ``n_trees``."""

    def run(batches):
        directions, tables = {}, {}
        for batch in batches:
            rows = []
            node = batch.column("node").to_numpy()
            for key in np.unique(node):
                own = np.flatnonzero(node == key)
                at, key = int(own[0]), int(key)
                if key not in tables:
                    if len(tables) > 1000:
                        tables.clear()
                    trees, n_trees = known[key] if known is not None else (
                        batch.column("trees")[at].as_py(), batch.column("n_trees")[at].as_py())
                    splits = np.frombuffer(trees, np.float64).reshape(-1, 5).tolist()
                    tables[key] = n_trees, {(int(t), int(p)): (low, high, int(k)) for t, p, low, high, k in splits}
                n_trees, table = tables[key]
                v = batch.column("v").to_numpy()[own]
                units = batch.column("unit").take(pa.array(own)).to_pylist()
                x = np.frombuffer(b"".join(units), np.float64).reshape(len(own), -1)
                for tree in range(n_trees):
                    held = [(1, np.arange(len(own)))]
                    while held:
                        path, some = held.pop()
                        if not len(some):
                            continue
                        low, high, pick = table.get((tree, path), (None, None, 0))
                        if low is None or np.isnan(low):
                            leaf = _digest(f"{key}/{tree}/{path}".encode())
                            rows += [(i, leaf, low is not None) for i in v[some].tolist()]
                            continue
                        name = (key, tree, path)
                        if name not in directions:
                            if len(directions) > 20_000:
                                directions.clear()
                            directions[name] = _direction(key, tree, path, pick, x.shape[1])
                        to = x[some] @ directions[name]
                        held += [(2 * path, some[to <= high]), (2 * path + 1, some[to >= low])]
            for i in range(0, len(rows), 100_000):
                yield records(rows[i:i + 100_000], ROUTED)

    return run


def _compare(least: float):
    """Links inside one leaf, or between two blocks of a large one.

    A pair that also meets in a leaf with a smaller number is counted there. Returns per
    row the copies it links to, and a row it is linked with (the smallest reached here).
    """

    def run(key: tuple[pa.Scalar, ...], table: pa.Table) -> pa.Table:
        leaf, i, j = (k.as_py() for k in key)
        v, m = table.column("v").to_numpy(), table.column("copies").to_numpy()
        block = table.column("block").to_numpy()
        x = np.frombuffer(b"".join(table.column("unit").to_pylist()), np.float64).reshape(len(v), -1)
        leaves = table.column("leaves").to_pylist()
        earlier = sorted({q for own in leaves for q in own if q < leaf})
        at = {q: k for k, q in enumerate(earlier)}
        member = np.zeros((len(v), len(earlier)), np.float32)
        for r, own in enumerate(leaves):
            member[r, [at[q] for q in own if q < leaf]] = 1
        links, root = np.zeros(len(v), np.int64), v.copy()
        chunk = max(1, 4_000_000 // max(1, len(v)))
        order = np.arange(len(v))
        for a in range(0, len(v), chunk):
            part = slice(a, a + chunk)
            near = x[part] @ x.T >= least
            near &= order[part, None] != order[None, :]
            if i != j:
                near &= block[part, None] != block[None, :]
            if not near.any():
                continue
            root[part] = np.minimum(root[part], np.where(near, v[None, :], np.iinfo(np.int64).max).min(axis=1))
            counted = near & ~(member[part] @ member.T > 0) if len(earlier) else near
            links[part] = counted @ m
        return pa.table([pa.array(v), pa.array(links), pa.array(root)], schema=FOUND)

    return run


def _assign(rows: DataFrame, trees: int, leaf_rows: int, sample_rows: int, reach: float, max_rounds: int) -> DataFrame:
    """``v, leaf``: rows of ``v, node, unit`` routed to leaves; leaves that stay too large are split again unless dense."""
    done = None
    for round_ in range(max_rounds):
        sizes = rows.groupBy("node").agg(F.count(F.lit(1)).alias("rows"))
        sampled = rows.join(sizes, "node").where((F.col("rows") <= sample_rows) | (
            F.pmod(F.xxhash64("v", F.lit(round_)), F.lit(1_000_000)) < 1_000_000.0 * sample_rows / F.col("rows")))
        splits = stored(sampled.groupBy("node").applyInArrow(
            _fit(trees if round_ == 0 else 1, leaf_rows, reach), "node long, trees binary, n_trees long"))
        # a few numbers per split; sent to all while they are small
        size = splits.agg(F.sum(F.length("trees") + 100)).first()[0] or 0
        known = {r["node"]: (bytes(r["trees"]), r["n_trees"]) for r in splits.collect()} if size <= 16 << 20 else None
        side = rows.join(splits, "node").select("v", "node", "unit", "trees", "n_trees") if known is None else rows
        routed = stored(side.mapInArrow(_route(known), "v long, leaf long, dense boolean"))
        routed_units = rows.select("v", "unit").dropDuplicates(["v"])
        count = routed.groupBy("leaf").agg(F.count(F.lit(1)).alias("n"), F.max("dense").alias("dense"))
        large = count.where((F.col("n") > 4 * leaf_rows) & ~F.col("dense")).select("leaf") if round_ + 1 < max_rounds else None
        leaves = routed.select("v", "leaf")
        if large is None or large.isEmpty():
            return leaves if done is None else done.union(leaves)
        small = leaves.join(large, "leaf", "left_anti").select("v", "leaf")
        done = small if done is None else done.union(small)
        rows = stored(leaves.join(large, "leaf").join(routed_units, "v").select("v", F.col("leaf").alias("node"), "unit"))
    return done


def near_vectors(vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label",
                 least: float = 0.93, trees: int = 6, leaf_rows: int = 400, margin: float = 0.7,
                 sample_rows: int = 4000, block_rows: int = 2000, max_rounds: int = 4) -> DataFrame:
    """One row per vector: id, ``n_links``, ``component_id``, ``kept``.

    Rows with equal, non-null labels (and equal numbers of components) link from a cosine
    of ``least``; vectors that are null, empty, zero, or hold a null or non-finite component
    link with nothing. Vectors of equal direction are one vertex, so large groups of copies
    cost one row. The trees are fitted on at most about ``sample_rows`` rows of each node;
    every row is routed. Rows within ``margin`` standard deviations of the projected difference
    of two rows that just link go to both sides of a split; a node that no such split makes
    smaller is compared whole. Leaves over ``block_rows`` are compared block against block.
    ``component_id`` is the smallest id reachable. Rows with a null id link as usual but
    have a null component if they are alone. Repeated rows count each; an empty table gives
    no rows.
    """
    rows = vectors.select(F.col(id_col).cast("long").alias("id"), F.col(vector_col).cast("array<double>").alias("x"),
                          F.col(label_col).alias("label"))
    units = stored(rows.mapInArrow(_units, "id long, v long, space long, unit binary"))
    usable = units.where("space is not null")
    vertices = stored(usable.groupBy("v", "space").agg(
        F.count(F.lit(1)).alias("copies"), F.min("id").alias("id"), F.first("unit").alias("unit")))
    leaves = stored(_assign(vertices.select("v", F.col("space").alias("node"), "unit"), trees, leaf_rows, sample_rows,
                            margin * float(np.sqrt(max(0.0, 2 - 2 * least))), max_rounds))
    # a row lies in a few leaves of each tree
    own = leaves.groupBy("v").agg(F.collect_list("leaf").alias("leaves"))
    sizes = leaves.groupBy("leaf").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select(
        "leaf", F.ceil(F.col("n") / block_rows).alias("blocks"))
    placed = leaves.join(sizes, "leaf").withColumn("block", F.pmod(F.xxhash64("v"), F.col("blocks")))
    other = F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1)).alias("other")
    dealt = placed.select("v", "leaf", "block", other).select(
        "v", "leaf", "block", F.least("block", "other").alias("i"), F.greatest("block", "other").alias("j"))
    full = dealt.join(own, "v").join(vertices.select("v", "copies", "unit"), "v")
    found = stored(full.groupBy("leaf", "i", "j").applyInArrow(_compare(least), "v long, links long, root long"))
    linked = found.groupBy("v").agg(F.sum("links").alias("links"))
    joined = components(found.where("v <> root").select(F.col("v").alias("a"), F.col("root").alias("b")).distinct())
    named = vertices.select("v", "id", "copies").join(joined.toDF("v", "component"), "v", "left").withColumn(
        "component", F.coalesce("component", "v"))
    smallest = named.groupBy("component").agg(F.min("id").alias("component_id"))
    told = named.join(smallest, "component").join(linked, "v", "left").select(
        "v", (F.col("copies") - 1 + F.coalesce("links", F.lit(0))).alias("n_links"), "component_id")
    out = units.select("id", "v").join(told, "v", "left")
    component = F.coalesce("component_id", "id")
    return out.select(F.col("id").alias(id_col), F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"),
                      component.alias("component_id"), component.eqNullSafe(F.col("id")).alias("kept"))

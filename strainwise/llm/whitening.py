"""Whitening of embeddings by a Jacobi-Davidson eigensolver.

The covariance is never formed: its product with a few vectors is one pass over stored
blocks of centred rows. The solver keeps a small search space on the driver (a few
columns of the embedding's width), and a pass serves all wanted pairs at once.
"""

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from .common import only, stored

BLOCK_BYTES = 4 << 20
# Partial products that are summed in one task or on the driver.
FAN_IN = 64
BLOCK = "ids binary, unknown binary, x binary"
PARTIAL = "part binary"


# ---------------------------------------------------------------- stored blocks of rows
def _blocks(width: int, scale: int, shift: int):
    """Rows of a task as blocks of 64-bit whole numbers, ids beside them."""
    most = max(1, BLOCK_BYTES // (8 * width))

    def pack(ids, unknown, x):
        return pa.record_batch([pa.array([a.tobytes()], pa.binary()) for a in (ids, unknown, x)], names=["ids", "unknown", "x"])

    def run(batches):
        held, size = [], 0
        for batch in batches:
            vectors = batch.column("vector")
            if not len(vectors):
                continue
            x = np.floor(scale * vectors.flatten().to_numpy(zero_copy_only=False).reshape(-1, width)).astype(np.int64) + shift
            ids = batch.column("id")
            held.append((ids.fill_null(0).to_numpy(zero_copy_only=False), ids.is_null().to_numpy(zero_copy_only=False), x))
            size += len(x)
            if size >= most:
                whole = [np.concatenate(c) for c in zip(*held)]
                for i in range(0, size, most):
                    yield pack(*[c[i:i + most] for c in whole])
                held, size = [], 0
        if size:
            yield pack(*[np.concatenate(c) for c in zip(*held)])

    return run


def _rows(batch, width: int):
    for ids, unknown, x in zip(*[batch.column(c).to_pylist() for c in ("ids", "unknown", "x")]):
        yield np.frombuffer(ids, np.int64), np.frombuffer(unknown, bool), np.frombuffer(x, np.int64).reshape(-1, width)


# ----------------------------------------------------------------------- sums of passes
def _total(partials: DataFrame, tasks: int, kind) -> np.ndarray:
    """Sum of the small arrays of all tasks: in two levels where there are many."""

    def add(batches):
        total = None
        for batch in batches:
            for raw in batch.column("part").to_pylist():
                one = np.frombuffer(raw, kind)
                total = one if total is None else total + one
        if total is not None:
            yield pa.record_batch([pa.array([total.tobytes()], pa.binary())], names=["part"])

    if tasks > FAN_IN:
        partials = partials.repartition(math.isqrt(tasks) + 1).mapInArrow(add, PARTIAL)
    return sum(np.frombuffer(r["part"], kind) for r in partials.collect())


class _Covariance:
    """Products with the covariance of the stored blocks, one pass for any number of vectors."""

    def __init__(self, blocks: DataFrame, n: int, sums: np.ndarray):
        self.blocks, self.n, self.sums, self.width = blocks, n, sums, len(sums)
        self.tasks, self.passes = blocks.rdd.getNumPartitions(), 0
        # the mean as a whole part and a rest: whole numbers are centred without loss
        self.base = sums // n
        self.rest = (sums - self.base * n) / n

    def total(self, work, kind=np.float64) -> np.ndarray:
        """Sum over all rows of ``work(ids, unknown, x)``; one small array leaves each task."""
        width = self.width

        def run(batches):
            total = None
            for batch in batches:
                for own in _rows(batch, width):
                    one = work(*own).ravel()
                    total = one if total is None else total + one
            if total is not None:
                yield pa.record_batch([pa.array([total.tobytes()], pa.binary())], names=["part"])

        self.passes += 1
        return _total(self.blocks.mapInArrow(run, PARTIAL), self.tasks, kind)

    def centred(self):
        base, rest = self.base, self.rest
        return lambda x: (x - base) - rest

    def __matmul__(self, vectors: np.ndarray) -> np.ndarray:
        centre = self.centred()

        def work(ids, unknown, x):
            c = centre(x)
            return c.T @ (c @ vectors)

        return self.total(work).reshape(vectors.shape) / self.n

    def trace(self) -> float:
        centre = self.centred()
        return float(self.total(lambda ids, unknown, x: np.array([np.square(centre(x)).sum()]))[0]) / self.n


# -------------------------------------------------------------------------- eigensolver
def _orthonormal(new: np.ndarray, *against: np.ndarray) -> np.ndarray:
    """Columns of ``new`` made orthogonal to the given bases and each other; dependent ones are left out."""
    out = []
    for column in new.T:
        size = np.linalg.norm(column)
        for _ in range(3):
            for basis in against:
                column = column - basis @ (basis.T @ column)
            for done in out:
                column = column - done * (done @ column)
        if size and np.linalg.norm(column) > 1e-10 * size:
            out.append(column / np.linalg.norm(column))
    return np.array(out).T if out else np.zeros((len(new), 0))


def _minres(a, values: np.ndarray, right: np.ndarray, project, steps: int, goal: float) -> np.ndarray:
    """Approximate ``t`` with ``(A - value I) t = right`` for every column, in the space left by ``project``.

    Each column runs its own Lanczos recurrence and plane rotations; the products of all
    columns share one pass over the rows.
    """
    right = project(right)
    beta1 = np.linalg.norm(right, axis=0)
    safe = np.where(beta1 > 0, beta1, 1.0)
    before, now, beta = np.zeros_like(right), right / safe, np.zeros(len(values))
    t, w_old, w = np.zeros_like(right), np.zeros_like(right), np.zeros_like(right)
    c_old, c = np.ones(len(values)), np.ones(len(values))
    s_old, s = np.zeros(len(values)), np.zeros(len(values))
    left = beta1.copy()
    open_ = beta1 > 0
    for _ in range(steps):
        if not open_.any():
            break
        image = project((a @ now) - now * values)
        alpha = (now * image).sum(0)
        ahead = image - now * alpha - before * beta
        beta_new = np.linalg.norm(ahead, axis=0)
        # the two rotations before act on the new column of the tridiagonal matrix
        epsilon, delta_bar = s_old * beta, c_old * beta
        delta = c * delta_bar + s * alpha
        gamma_bar = -s * delta_bar + c * alpha
        gamma = np.hypot(gamma_bar, beta_new)
        gamma = np.where(gamma > 0, gamma, 1.0)
        c_new, s_new = gamma_bar / gamma, beta_new / gamma
        w_new = (now - w_old * epsilon - w * delta) / gamma
        t = np.where(open_, t + w_new * (c_new * left), t)
        left = np.where(open_, -s_new * left, left)
        before, now = now, ahead / np.where(beta_new > 0, beta_new, 1.0)
        w_old, w, c_old, s_old, c, s, beta = w, w_new, c, s, c_new, s_new, beta_new
        open_ &= (np.abs(left) > goal * beta1) & (beta_new > 1e-14 * safe)
    return project(t)


def jacobi_davidson(a, width: int, wanted: int, seed: int = 11, inner: int = 5, rounds: int = 60) -> tuple[np.ndarray, np.ndarray]:
    """The ``wanted`` largest eigenvalues, falling, and unit eigenvectors of a symmetric operator.

    ``a @ vectors`` is the only use of the operator. In each round the leading Ritz pairs
    of the search space are tested; pairs at the floor of double precision are locked, and the
    others get a correction from the equation projected off all kept vectors, solved
    by a few steps of MINRES. The space is restarted from its best vectors when it is full.
    """
    wanted = min(wanted, width)
    spare = min(width, wanted + 4)
    most = min(width, 5 * wanted + 8)
    space = _orthonormal(np.random.default_rng(seed).standard_normal((width, spare)))
    image = a @ space
    locked, values = np.zeros((width, 0)), []
    best = np.inf
    for round_ in range(rounds):
        small = space.T @ image
        ritz, turn = np.linalg.eigh((small + small.T) / 2)
        ritz, turn = ritz[::-1], turn[:, ::-1]
        space, image = space @ turn, image @ turn
        active = min(wanted - len(values), space.shape[1])
        left = image[:, :active] - space[:, :active] * ritz[:active]
        sizes = np.linalg.norm(left, axis=0)
        top = max([*values[:1], ritz[0], 0.0])
        floor = 32 * np.finfo(float).eps * top
        # rounding in the passes can end progress a little above the floor
        stuck = sizes.max() > best / 2 and sizes.max() <= 2000 * floor
        best = min(best, sizes.max())
        done = 0
        while done < active and (sizes[done] <= floor or stuck):
            done += 1
        if done:
            locked = np.column_stack([locked, space[:, :done]])
            values += ritz[:done].tolist()
            space, image, ritz, left, sizes = space[:, done:], image[:, done:], ritz[done:], left[:, done:], sizes[done:]
            best = np.inf
        active = min(wanted - len(values), space.shape[1])
        if len(values) == wanted or len(values) + space.shape[1] == width and not active:
            break
        if not active:
            space = _orthonormal(np.random.default_rng(seed + round_ + 1).standard_normal((width, spare)), locked)
            image = a @ space
            continue
        if space.shape[1] + active > most:
            keep = min(space.shape[1], active + spare)
            space, image, ritz = space[:, :keep], image[:, :keep], ritz[:keep]
        kept = np.column_stack([locked, space[:, :active]])

        def project(v):
            return v - kept @ (kept.T @ v)

        rough = sizes[:active] > floor
        if rough.any():
            goal = max(1e-3, floor / sizes[:active].max())
            step = _minres(a, ritz[:active][rough], -left[:, :active][:, rough], project, inner, goal)
            new = _orthonormal(step, locked, space)
        else:
            new = np.zeros((width, 0))
        if not new.shape[1]:  # the space holds all there is to gain: a random vector looks for missed pairs
            new = _orthonormal(np.random.default_rng(seed + round_ + 1).standard_normal((width, active)), locked, space)
            if not new.shape[1]:
                done = active
                locked = np.column_stack([locked, space[:, :done]])
                values += ritz[:done].tolist()
                break
        space, image = np.column_stack([space, new]), np.column_stack([image, a @ new])
    else:
        raise ArithmeticError(f"{wanted - len(values)} eigenpairs did not reach double precision")
    order = np.argsort(values)[::-1]
    return np.array(values)[order], locked[:, order]


# ---------------------------------------------------------------------------- operator
def whiten(df: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", components: int = 8,
           scale: int = 1024, shift: int = 100_000, seed: int = 11) -> DataFrame:
    """Project every vector on the leading principal components, each scaled to variance 1.

    Entries become whole numbers ``floor(scale * c) + shift``. Returns per row and component
    (from 1, falling variance) ``id, component, n, deviation, whitened, explained,
    identity_error``: the number of rows, the exact sum of squares of ``n * x - S``, the
    coordinate, the component's share of the variance, and the largest entry by which the
    covariance of all coordinates differs from the identity.

    Rows whose vector is null, empty, of another length than the longest, or holds null or
    non-finite entries are dropped. Null and repeated ids are rows of their own; equal
    vectors get equal coordinates. Components without variance cannot be scaled and are left
    out: fewer than ``components`` where the rows span less, none for one row or equal rows.
    A deviation beyond 64 bits is null. No row left, no rows out; other columns are ignored.
    """
    rows = only(df, id=id_col, vector=vector_col).select(
        F.col("id").cast("long").alias("id"), F.col("vector").cast("array<double>").alias("vector"))
    usable = F.forall("vector", lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < float("inf")))
    rows = rows.where(F.col("vector").isNotNull() & (F.size("vector") > 0) & usable)
    width = rows.agg(F.max(F.size("vector"))).first()[0]
    out = f"{id_col} long, component int, n long, deviation long, whitened double, explained double, identity_error double"
    if width is None:
        return df.sparkSession.createDataFrame([], out)
    blocks = stored(rows.where(F.size("vector") == width).mapInArrow(_blocks(width, scale, shift), BLOCK))

    whole = _Covariance(blocks, 1, np.zeros(width, np.int64))
    counted = whole.total(lambda ids, unknown, x: np.concatenate([[len(x)], x.sum(0)]), np.int64)
    n, sums = int(counted[0]), counted[1:]
    a = _Covariance(blocks, n, sums)
    trace = a.trace()
    values, vectors = (np.zeros(0), np.zeros((width, 0))) if trace <= 0 else jacobi_davidson(a, width, components, seed)
    real = values > 1e-13 * trace
    values, vectors = values[real], vectors[:, real]
    if not len(values):
        return df.sparkSession.createDataFrame([], out)
    centre = a.centred()

    def project(x):
        return (centre(x) @ vectors) / np.sqrt(values)

    k = len(values)

    def moments(ids, unknown, x):
        w = project(x)
        return np.concatenate([w.sum(0), (w.T @ w).ravel()])

    found = a.total(moments)
    mean = found[:k] / n
    error = float(np.abs(found[k:].reshape(k, k) / n - np.outer(mean, mean) - np.eye(k)).max())
    share = values / trace

    def deviations(x):
        off = n * (x - a_base) - a_left
        if width * float(np.abs(off).max()) ** 2 < 2 ** 62:
            return pa.array(np.square(off).sum(1))
        exact = [sum(int(v) ** 2 for v in row) for row in off]
        return pa.array([v if v < 2 ** 63 else None for v in exact], pa.int64())

    a_base, a_left = a.base, sums - a.base * n

    def told(batches):
        for batch in batches:
            for ids, unknown, x in _rows(batch, width):
                for i in range(0, len(x), 10_000):
                    own = x[i:i + 10_000]
                    m = len(own)
                    yield pa.record_batch([
                        pa.array(ids[i:i + m], mask=unknown[i:i + m]).take(pa.array(np.repeat(np.arange(m), k))),
                        pa.array(np.tile(np.arange(1, k + 1, dtype=np.int32), m)),
                        pa.array(np.full(m * k, n, np.int64)),
                        deviations(own).take(pa.array(np.repeat(np.arange(m), k))),
                        pa.array(project(own).ravel()),
                        pa.array(np.tile(share, m)),
                        pa.array(np.full(m * k, error))],
                        names=[id_col, "component", "n", "deviation", "whitened", "explained", "identity_error"])

    return blocks.mapInArrow(told, out)

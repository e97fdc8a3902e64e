"""K-means with all restarts side by side: one scan of the rows moves the centres of every restart."""

import sys

import numpy as np
from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame, functions as F

from ..plans.bounds import materialize
from ..plans.partials import PART, one_array, shipped, totals
from ..schema import SEED

# executors need not have the library installed
cloudpickle.register_pickle_by_value(sys.modules[__name__])


def _distances(x: np.ndarray, centres: np.ndarray) -> np.ndarray:
    """Squared distance of every row to every centre."""
    return np.square(x[:, None, :] - centres[None]).sum(2)


def _points(batch) -> np.ndarray:
    return np.stack([batch.column(i).to_numpy(zero_copy_only=False) for i in range(batch.num_columns - 1)], 1)


def _uniform(key: np.ndarray, stream: int) -> np.ndarray:
    """A number between 0 and 1 per row and stream, from the row's hash."""
    with np.errstate(over="ignore"):
        z = key.astype(np.uint64) + np.uint64((stream * 0x9E3779B97F4A7C15) % (1 << 64))
        z = (z ^ (z >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        z = (z ^ (z >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
        z = z ^ (z >> np.uint64(31))
    return ((z >> np.uint64(11)).astype(float) + 0.5) / 2.0 ** 53


def _draw(chosen: list, streams: list):
    """Per restart the row drawn by squared distance to the centres so far: the smallest of exponential clocks."""

    def run(batches):
        best = None
        for batch in batches:
            if not batch.num_rows:
                continue
            x, key = _points(batch), batch.column(batch.num_columns - 1).to_numpy(zero_copy_only=False)
            rows = []
            for centres, stream in zip(chosen, streams):
                weight = _distances(x, centres).min(1) if len(centres) else np.ones(len(x))
                with np.errstate(divide="ignore"):
                    clock = -np.log(_uniform(key, stream)) / weight
                # equal rows share a clock; any order of the table gives the same draw
                i = np.lexsort((*x.T[::-1], clock))[0]
                rows.append([clock[i], *x[i]])
            rows = np.array(rows)
            best = rows if best is None else np.where(_before(rows, best)[:, None], rows, best)
        if best is not None:
            yield one_array(best)

    return run


def _before(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return np.array([tuple(x) < tuple(y) for x, y in zip(a, b)])


def _first(batches):
    best = None
    for batch in batches:
        for raw in batch.column(0).to_pylist():
            one = np.frombuffer(raw)
            best = one if best is None else best
            width = int(batch.column(1)[0].as_py())
            a, b = one.reshape(-1, width), best.reshape(-1, width)
            best = np.where(_before(a, b)[:, None], a, b).ravel()
    if best is not None:
        yield one_array(best)


def _moves(centres: list):
    """Per restart and centre the sum and number of its rows, and per restart the cost."""

    def run(batches):
        total = None
        for batch in batches:
            if not batch.num_rows:
                continue
            x = _points(batch)
            out = []
            for c in centres:
                d = _distances(x, c)
                near = d.argmin(1)
                sums = [np.bincount(near, x[:, j], len(c)) for j in range(x.shape[1])]
                cost = np.zeros(len(c))
                cost[0] = d[np.arange(len(x)), near].sum()
                out.append(np.stack([*sums, np.bincount(near, minlength=len(c)), cost], 1))
            out = np.stack(out)
            total = out if total is None else total + out
        if total is not None:
            yield one_array(total)

    return run


def start_centres(points: DataFrame, width: int, tasks: int, k: int, seeds) -> list:
    """Per seed ``k`` starting centres, each drawn by squared distance to those before (fewer if rows are fewer)."""
    chosen = [np.zeros((0, width)) for _ in seeds]
    for j in range(k):
        parts = points.mapInArrow(shipped(_draw, chosen, [s * 1009 + j for s in seeds]), PART)
        if tasks > 1:
            parts = parts.withColumn("width", F.lit(width + 1)).coalesce(max(1, int(tasks ** 0.5))).mapInArrow(_first, PART)
        found = None
        for r in parts.collect():
            one = np.frombuffer(r["part"]).reshape(len(chosen), width + 1)
            found = one if found is None else np.where(_before(one, found)[:, None], one, found)
        if found is None:
            break
        # an infinite clock means that all rows lie on the centres
        chosen = [np.vstack([c, row[1:]]) if np.isfinite(row[0]) else c for c, row in zip(chosen, found)]
    return chosen


def kmeans(df: DataFrame, columns, k: int = 4, restarts: int = 10, seed: int = SEED, steps: int = 300,
           tolerance: float = 1e-4, seeds=None) -> tuple[np.ndarray, list]:
    """Centres of the best of several restarts, in rising order, and the cost of each restart.

    ``columns`` are numeric and hold no NULL. Starting centres are drawn by squared distance,
    deterministically from the rows' hashes. In every step one scan assigns each row
    for all restarts that still move; a restart whose centres move by less than
    ``tolerance`` (sum of squares) drops out. A centre without rows stays where it is. Tables with
    fewer distinct rows than ``k`` have fewer centres; an empty one has none.
    """
    columns = list(columns)
    seeds = list(seeds) if seeds is not None else [seed + i for i in range(restarts)]
    points = materialize(df.select(*[F.col(c).cast("double").alias(c) for c in columns],
                                   F.xxhash64(*[F.col(c).cast("double") for c in columns]).alias("_key")))
    tasks = points.rdd.getNumPartitions()
    centres = start_centres(points, len(columns), tasks, k, seeds)
    if not len(centres[0]):
        return np.zeros((0, len(columns))), []
    moving, costs = list(range(len(seeds))), [0.0] * len(seeds)
    for step in range(steps + 1):
        last = step == steps
        sums = totals(points, shipped(_moves, [centres[i] for i in moving]), tasks)
        sums, still, at = sums.ravel(), [], 0
        for i in moving:
            c = centres[i]
            own = sums[at:at + len(c) * (len(columns) + 2)].reshape(len(c), -1)
            at += own.size
            costs[i] = float(own[:, -1].sum())
            count = own[:, -2:-1]
            new = np.where(count > 0, own[:, :-2] / np.maximum(count, 1), c)
            # the cost belongs to the centres that the rows were assigned to
            if not last and np.square(new - c).sum() > tolerance:
                centres[i] = new
                still.append(i)
        moving = still
        if not moving:
            break
    best = centres[min(range(len(seeds)), key=lambda i: (costs[i], i))]
    return best[np.lexsort(best.T[::-1])], costs


def nearest(columns, centres) -> Column:
    """Number of the nearest centre, the first on ties; NULL without centres."""
    if not len(centres):
        return F.lit(None).cast("int")
    d = [sum(((F.col(c) - F.lit(float(v))) * (F.col(c) - F.lit(float(v))) for c, v in zip(columns, centre)), F.lit(0.0)) for centre in centres]
    low = F.least(*d) if len(d) > 1 else d[0]
    return (F.array_position(F.array(*d), low) - 1).cast("int")


def kmeans_step(df: DataFrame, columns, starts) -> DataFrame:
    """One step of every start (a list of centres each): ``restart, cluster, rows`` and the mean of each column."""
    columns = list(columns)
    moves = F.explode(F.array(*[F.struct(F.lit(i).alias("restart"), nearest(columns, c).alias("cluster")) for i, c in enumerate(starts)]))
    rows = df.select(*columns, moves.alias("m"))
    return rows.groupBy("m.restart", "m.cluster").agg(F.count(F.lit(1)).alias("rows"), *[F.avg(c).alias(c) for c in columns])

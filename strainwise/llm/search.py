"""Ranked lexical search: an index of compressed blocks per shard of documents, read by Block-Max MaxScore.

A shard is a run of documents in one task. Its index holds, for every term, the documents
with the term in blocks of narrow numbers, and for every block the pairs of frequency and
document length that no other pair of the block beats. As a term's part of the score grows
with its frequency and falls with the length, these pairs give the exact maximum of a
block for any statistics of the whole collection, without opening the block.
"""

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window, functions as F

from ..plans.bounds import small_side
from .common import only, slices, stored
from .shingles import word_hashes

SHARD_BYTES = 8 << 20
SHARD_DOCS = 60_000
BLOCK = 64
# Query terms that are looked up in one pass over the index.
PASS_TERMS = 200_000
# Best lists of tasks that are merged at once.
FAN_IN = 64

_BYTES = np.arange(256)
#: bytes outside of terms: ASCII other than digits and letters
_OUTSIDE = ~((_BYTES >= 128) | ((_BYTES >= 48) & (_BYTES <= 57)) | ((_BYTES >= 65) & (_BYTES <= 90)) | ((_BYTES >= 97) & (_BYTES <= 122)))

ARRAYS = {"ids": np.int64, "unknown": np.bool_, "lengths": np.int64, "terms": np.uint64, "dfs": np.uint32, "widths": np.uint8,
          "firsts": np.uint32, "edges": np.uint8, "edge_tf": np.uint32, "edge_n": np.uint32, "payload": np.uint8}
INDEX = "filled long, words long, " + ", ".join(f"{name} binary" for name in ARRAYS)
HIT = pa.schema([("query", pa.int64()), ("score", pa.int64()), ("id", pa.int64())])


def _terms_of(batch: pa.RecordBatch, column: str) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all terms of a text column, and the number of terms per row; null has none."""
    return word_hashes([t or b"" for t in batch.column(column).cast(pa.binary()).to_pylist()], _OUTSIDE)


def _ranges(starts: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """``starts[i], starts[i] + 1, ...``, ``counts[i]`` of them, one after the other."""
    ends = np.cumsum(counts)
    return np.arange(ends[-1] if len(ends) else 0) + np.repeat(starts - (ends - counts), counts)


def _width(most: np.ndarray) -> np.ndarray:
    """Bytes per number: 1, 2 or 4."""
    return np.where(most < 256, 1, np.where(most < 65536, 2, 4))


# ------------------------------------------------------------------------------ index
def _build(ids, unknown, lengths, hashes) -> dict:
    """Arrays of one shard's index from the hashes of its terms in order of the documents."""
    docs = np.repeat(np.arange(len(lengths), dtype=np.uint64), lengths)
    order = np.argsort(hashes, kind="stable")  # documents stay in order within a term
    hashes, docs = hashes[order], docs[order]
    fresh = np.ones(len(hashes), bool)
    fresh[1:] = (hashes[1:] != hashes[:-1]) | (docs[1:] != docs[:-1])
    at = np.flatnonzero(fresh)
    tf = np.diff(at, append=len(hashes))
    term, doc = hashes[at], docs[at].astype(np.int64)
    new_list = np.ones(len(term), bool)
    new_list[1:] = term[1:] != term[:-1]
    heads = np.flatnonzero(new_list)
    dfs = np.diff(heads, append=len(term))
    place = np.arange(len(term)) - np.repeat(heads, dfs)

    gaps = np.diff(doc, prepend=0)
    gaps[heads] = 0
    widths = np.stack([_width(np.maximum.reduceat(gaps, heads)), _width(np.maximum.reduceat(tf, heads))], 1) if len(heads) else np.zeros((0, 2), int)
    # a list is its gaps, then its frequencies
    size = dfs * widths.sum(1)
    begin = np.cumsum(size) - size
    payload = np.zeros(int(size.sum()), np.uint8)
    for values, wide, start in ((gaps, widths[:, 0], begin), (tf, widths[:, 1], begin + dfs * widths[:, 0])):
        step = np.repeat(wide, dfs)
        to = np.repeat(start, dfs) + place * step
        for byte in range(4):
            mine = step > byte
            payload[to[mine] + byte] = (values[mine] >> (8 * byte)) & 255

    # per block the pairs that no other pair beats: by falling frequency, ever shorter documents
    new_block = place % BLOCK == 0
    block = np.cumsum(new_block) - 1
    n = lengths[doc]
    order = np.lexsort((n, -tf, block))
    own, shortest = block[order], n[order]
    reach = int(n.max(initial=0)) + 1
    low = np.minimum.accumulate(shortest - own * reach) + own * reach
    best = np.ones(len(order), bool)
    best[1:] = (own[1:] != own[:-1]) | (shortest[1:] < low[:-1])
    edge = order[best]
    return {"ids": ids, "unknown": unknown, "lengths": lengths, "terms": term[heads], "dfs": dfs, "widths": widths,
            "firsts": doc[new_block], "edges": np.bincount(block[edge], minlength=int(new_block.sum())), "edge_tf": tf[edge],
            "edge_n": n[edge], "payload": payload}


def _index(batches):
    def flush(ids, unknown, lengths, hashes):
        lengths = np.concatenate(lengths).astype(np.int64)
        arrays = _build(np.concatenate(ids), np.concatenate(unknown), lengths, np.concatenate(hashes))
        binary = [np.ascontiguousarray(arrays[name], kind).tobytes() for name, kind in ARRAYS.items()]
        return pa.record_batch([pa.array([int((lengths > 0).sum())]), pa.array([int(lengths.sum())]),
                                *[pa.array([b], pa.binary()) for b in binary]], names=["filled", "words", *ARRAYS])

    held, size, count = ([], [], [], []), 0, 0
    for batch in batches:
        for part in slices(batch, "text"):
            hashes, lengths = _terms_of(part, "text")
            ids = part.column("id")
            for kept, one in zip(held, (ids.fill_null(0).to_numpy(zero_copy_only=False), ids.is_null().to_numpy(zero_copy_only=False),
                                        lengths, hashes)):
                kept.append(one)
            size, count = size + part.column("text").nbytes, count + len(part)
            if size >= SHARD_BYTES or count >= SHARD_DOCS:
                yield flush(*held)
                held, size, count = ([], [], [], []), 0, 0
    if count:
        yield flush(*held)


def build_index(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Index every row of ``docs``: one stored row per shard of about 8 MB of text, no shuffle.

    Terms are runs of digits, ASCII letters (A-Z lowered) and other characters beyond ASCII,
    held as 64-bit hashes. A null text has no terms; null and repeated ids are documents
    of their own; other columns are ignored.
    """
    rows = only(docs, id=id_col, text=text_col).select(F.col("id").cast("long").alias("id"), "text")
    return stored(rows.mapInArrow(_index, INDEX))


class _Shard:
    """One shard's index, opened for given collection statistics."""

    def __init__(self, row: dict, filled: int, words: int):
        self.__dict__.update({name: np.frombuffer(row[name], kind) for name, kind in ARRAYS.items()})
        self.widths = self.widths.reshape(-1, 2).astype(np.int64)
        self.dfs = self.dfs.astype(np.int64)
        if 50 * int(self.lengths.max(initial=0)) * filled < 2 ** 63:
            self.norm = 50 + (50 * self.lengths * filled) // words
        else:
            self.norm = np.array([50 + 50 * int(n) * filled // words for n in self.lengths], np.int64)
        size = self.dfs * self.widths.sum(1)
        self.begin = np.cumsum(size) - size
        self.blocks = np.append(0, np.cumsum(-(-self.dfs // BLOCK)))
        # frequencies and lengths in the index are of documents of this shard, so their norms are known
        sizes, at = np.unique(self.lengths, return_inverse=True)
        norms = np.zeros(len(sizes), np.int64)
        norms[at] = self.norm
        parts = self._part(self.edge_tf.astype(np.int64), norms[np.searchsorted(sizes, self.edge_n)])
        edges = self.edges.astype(np.int64)
        self.block_max = np.maximum.reduceat(parts, np.cumsum(edges) - edges) if len(edges) else parts
        self.list_max = np.maximum.reduceat(self.block_max, self.blocks[:-1]) if len(self.dfs) else parts
        self.open: dict[int, tuple] = {}

    @staticmethod
    def _part(tf: np.ndarray, norm: np.ndarray) -> np.ndarray:
        return (1_000_000_000 * tf) // (1000 * tf + 20 * norm)

    def _numbers(self, i: int) -> tuple[np.ndarray, np.ndarray]:
        wide, df, start = self.widths[i], int(self.dfs[i]), int(self.begin[i])
        kinds = {1: np.uint8, 2: np.dtype("<u2"), 4: np.dtype("<u4")}
        gaps = np.frombuffer(self.payload, kinds[int(wide[0])], df, start)
        return gaps, np.frombuffer(self.payload, kinds[int(wide[1])], df, start + df * int(wide[0]))

    def whole(self, i: int) -> tuple[np.ndarray, np.ndarray]:
        """Documents of a list and their unweighted parts, kept for the other queries."""
        if i not in self.open:
            gaps, tf = self._numbers(i)
            docs = int(self.firsts[self.blocks[i]]) + np.cumsum(gaps, dtype=np.int64)
            self.open[i] = docs, self._part(tf.astype(np.int64), self.norm[docs])
        return self.open[i]

    def some(self, i: int, blocks: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The same of the given blocks (rising, counted within the list) only."""
        if i in self.open:
            return self.open[i]
        gaps, tf = self._numbers(i)
        counts = np.minimum(BLOCK, len(gaps) - blocks * BLOCK)
        at = _ranges(blocks * BLOCK, counts)
        steps = gaps[at].astype(np.int64)
        heads = np.cumsum(counts) - counts
        steps[heads] = 0
        walked = np.cumsum(steps)
        docs = walked + np.repeat(self.firsts[self.blocks[i] + blocks] - walked[heads], counts)
        return docs, self._part(tf[at].astype(np.int64), self.norm[docs])

    def search(self, lists: np.ndarray, weights: np.ndarray, floor: int) -> tuple[np.ndarray, np.ndarray]:
        """Documents with a score above 0 that reach ``floor``, and their scores."""
        bounds = weights * self.list_max[lists]
        order = np.argsort(bounds, kind="stable")
        lists, weights, upto = lists[order], weights[order], np.cumsum(bounds[order])
        # the lists with the lowest bounds cannot lift a document to the floor by themselves
        spare = int(np.searchsorted(upto, floor))
        if spare == len(lists):
            return np.zeros(0, np.int64), np.zeros(0, np.int64)
        sums = np.zeros(len(self.ids), np.int64)
        for i, w in zip(lists[spare:].tolist(), weights[spare:].tolist()):
            docs, parts = self.whole(i)
            sums[docs] += w * parts
        found = np.flatnonzero(sums)
        bound = sums[found]
        if not spare:
            reach = bound >= floor
            return found[reach], bound[reach]
        reach = bound + upto[spare - 1] >= floor
        found, bound = found[reach], bound[reach]
        # block maxima take the place of the lists' maxima, still without opening a block
        where, tops = [], []
        for i, w in zip(lists[:spare].tolist(), weights[:spare].tolist()):
            a, b = self.blocks[i], self.blocks[i + 1]
            block = np.searchsorted(self.firsts[a:b], found, "right") - 1
            where.append(block)
            tops.append(np.where(block >= 0, w * self.block_max[a + np.maximum(block, 0)], 0))
        where, tops = np.array(where), np.array(tops)
        bound = bound + tops.sum(0)
        for j in range(spare - 1, -1, -1):
            reach = bound >= floor
            if not reach.all():
                found, bound, where, tops = found[reach], bound[reach], where[:, reach], tops[:, reach]
            if not len(found):
                break
            bound = bound - tops[j]
            hit = where[j] >= 0
            if hit.any():
                docs, parts = self.some(int(lists[j]), np.unique(where[j][hit]))
                at = np.minimum(np.searchsorted(docs, found), len(docs) - 1)
                bound = bound + np.where(docs[at] == found, weights[j] * parts[at], 0)
        reach = bound >= floor
        return found[reach], bound[reach]


# ----------------------------------------------------------------------------- queries
def _query_terms(batches):
    for batch in batches:
        for part in slices(batch, "text"):
            hashes, lengths = _terms_of(part, "text")
            own = [np.unique(x) for x in np.split(hashes, np.cumsum(lengths)[:-1])]
            yield pa.record_batch([part.column("query"), pa.array([len(x) for x in own], pa.int64()),
                                   pa.array([x.tobytes() for x in own], pa.binary())], names=["query", "n", "terms"])


def _frequencies(wanted):
    """Documents of this task per wanted term: its place and the number."""

    def run(batches):
        known = wanted.value
        total = np.zeros(len(known), np.int64)
        for batch in batches:
            for terms, dfs in zip(batch.column("terms").to_pylist(), batch.column("dfs").to_pylist()):
                terms, dfs = np.frombuffer(terms, np.uint64), np.frombuffer(dfs, np.uint32)
                if len(terms):
                    at = np.minimum(np.searchsorted(terms, known), len(terms) - 1)
                    total += np.where(terms[at] == known, dfs[at], 0)
        some = np.flatnonzero(total)
        yield pa.record_batch([pa.array(some, pa.int64()), pa.array(total[some], pa.int64())], names=["place", "df"])

    return run


def _search(shared, filled: int, words: int, keep: int):
    """Best documents of a task per query; what earlier shards found raises the floor for later ones."""

    def run(batches):
        numbers, known, places, weights = shared.value
        best = {}
        for batch in batches:
            for row in batch.to_pylist():
                shard = _Shard(row, filled, words)
                if not len(shard.terms):
                    continue
                at = np.minimum(np.searchsorted(shard.terms, known), len(shard.terms) - 1)
                at = np.where(shard.terms[at] == known, at, -1)
                for q, own, w in zip(numbers, places, weights):
                    lists = at[own]
                    here = lists >= 0
                    if not here.any():
                        continue
                    old = best.get(q)
                    floor = int(old[0][-1]) if old is not None and len(old[0]) == keep else 0
                    found, scores = shard.search(lists[here], w[here], floor)
                    if not len(found):
                        continue
                    new = scores, shard.unknown[found], shard.ids[found]
                    if old is not None:
                        new = [np.concatenate(c) for c in zip(old, new)]
                    order = np.lexsort((new[2], new[1], -new[0]))[:keep]
                    best[q] = tuple(c[order] for c in new)
        for q, (scores, unknown, ids) in best.items():
            yield pa.record_batch([pa.array(np.full(len(ids), q, np.int64)), pa.array(scores), pa.array(ids, mask=unknown)], schema=HIT)

    return run


def _best(hits: DataFrame, groups: list, keep: int) -> DataFrame:
    order = Window.partitionBy(*groups).orderBy(F.desc("score"), F.asc_nulls_last("id"))
    return hits.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= keep)


def ranked_search(index: DataFrame, queries: DataFrame, keep: int = 50, query_id: str = "item_id", text_col: str = "text",
                  id_col: str = "doc_id", pass_terms: int = PASS_TERMS) -> DataFrame:
    """``(query_id, rank, id, score)``: the ``keep`` best documents of an index for every row of ``queries``.

    Scores are whole numbers: a term with document frequency ``df`` weighs
    ``floor(1000 ln((2N + 2) / (2 df + 1)))`` and gives ``10^9 tf div (1000 tf + 20 m)`` times that,
    where ``m = 50 + 50 n N div L`` for a document of ``n`` terms; each term of a query counts
    once. Only scores above 0 are returned; equal ones by rising id, null last. Every query
    row is a query of its own, also with a null or repeated id; one without known terms
    has no rows. Queries are taken in passes of about ``pass_terms`` terms, so that what is
    sent to the tasks stays bounded.

    In every shard, term lists are sorted by their bounds; those that together cannot reach
    the floor (the ``keep``-th best score so far) only correct candidates from the others,
    and block maxima reject candidates before any of their blocks is opened. The best
    lists of all tasks are merged, in two steps where there are many.
    """
    spark = index.sparkSession
    out = f"{query_id} {dict(queries.dtypes)[query_id]}, rank int, {id_col} long, score long"
    named = stored(only(queries, name=query_id, text=text_col).withColumn("query", F.monotonically_increasing_id()))
    asked = stored(named.select("query", "text").mapInArrow(_query_terms, "query long, n long, terms binary").where("n > 0"))
    whole = index.agg(F.sum("filled").alias("filled"), F.sum("words").alias("words")).first()
    terms = asked.agg(F.sum("n")).first()[0]
    if not terms or not whole["words"]:
        return spark.createDataFrame([], out)
    tasks, hits = index.rdd.getNumPartitions(), None
    passes = int(terms // pass_terms + 1)
    for i in range(passes):
        own = asked.where(F.pmod(F.xxhash64("query"), F.lit(passes)) == i).select("query", "terms").toArrow()
        lists = [np.frombuffer(t, np.uint64) for t in own.column("terms").to_pylist()]
        if not lists:
            continue
        known = np.unique(np.concatenate(lists))
        counted = index.select("terms", "dfs").mapInArrow(_frequencies(spark.sparkContext.broadcast(known)), "place long, df long")
        weight = np.zeros(len(known), np.int64)
        # one row per query term of this pass
        for row in counted.groupBy("place").agg(F.sum("df").alias("df")).collect():
            weight[row["place"]] = math.floor(1000 * math.log((2 * whole["filled"] + 2) / (2 * row["df"] + 1)))
        places = [np.searchsorted(known, t) for t in lists]
        places = [p[weight[p] > 0] for p in places]
        shared = spark.sparkContext.broadcast((own.column("query").to_pylist(), known, places, [weight[p] for p in places]))
        found = stored(index.mapInArrow(_search(shared, whole["filled"], whole["words"], keep), "query long, score long, id long")
                       .withColumn("task", F.spark_partition_id()))
        hits = found if hits is None else hits.union(found)
    if tasks > FAN_IN:
        hits = _best(hits.withColumn("task", F.col("task") % (math.isqrt(tasks) + 1)), ["query", "task"], keep)
    ranked = _best(hits.select("query", "score", "id"), ["query"], keep)
    names = named.select("query", "name")
    return ranked.join(small_side(names, names.count()), "query").select(
        F.col("name").alias(query_id), "rank", F.col("id").alias(id_col), "score")

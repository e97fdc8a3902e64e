"""N-gram Jaccard self-join by a grouped prefix join.

Shingles are ordered: frequent ones last, otherwise by hash. Two sets similar enough must
share a shingle in their prefixes under that order. Documents with one prefix and size
form a group; groups that share a prefix shingle are paired, filtered by size and
position, and expanded to members whose whole sets are compared.
"""

import hashlib
import math
from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from ..plans.bounds import small_side
from .common import components, only, records, slices, stored
from .shingles import batch_sets

MOST_BROADCAST = 500_000
WINDOW = 1_000_000  # shingles that a task gathers before it hands them on
COUNTS = pa.schema([("bucket", pa.int64()), ("keys", pa.binary()), ("counts", pa.binary())])
MEMBER = pa.schema([("id", pa.int64()), ("doc", pa.int64()), ("n", pa.int64()), ("v", pa.int64()), ("grp", pa.int64()),
                    ("bits", pa.binary())])
POST = pa.schema([("bucket", pa.int64()), ("keys", pa.binary()), ("groups", pa.binary()), ("sizes", pa.binary()),
                  ("places", pa.binary())])
RUN = pa.schema([("key", pa.int64()), ("grp", pa.int64()), ("n", pa.int64()), ("pos", pa.int64()), ("pivot", pa.int64())])
TEXT = pa.schema([("v", pa.int64()), ("text", pa.string())])
LINK = pa.schema([("a", pa.int64()), ("b", pa.int64())])
MET = "g long, h long, gn long, hn long, c long, gp long, hp long"
BITS = 1024  # a set's bitmap: one bit per shingle, by hash
CROWD = 1024  # groups of one shingle that a task compares with each other
UNIT_ROWS = 100_000  # rows of one comparing task, several shingles


def prefix_size(n: int, percent: int) -> int:
    """Shingles that a set of n must show so that a partner cannot be missed."""
    return n - (percent * n + 99) // 100 + 1 if n else 0


def _split(keys: np.ndarray, bits: int) -> tuple[np.ndarray, np.ndarray]:
    """Bucket (the top bits) and the next 32 bits of sorted hashes."""
    return keys >> np.uint64(64 - bits), (keys >> np.uint64(32 - bits)).astype(np.uint32)


def _digest64(data: bytes) -> int:
    return int.from_bytes(hashlib.blake2b(data, digest_size=8).digest(), "little", signed=True)


# ------------------------------------------------------------------ shingle counts
def _count(bits: int, words: int):
    """Documents per shingle, summed over windows of a task and dealt to buckets."""

    def flush(held):
        keys, counts = np.unique(np.concatenate(held), return_counts=True)
        bucket, low = _split(keys, bits)
        edges = np.flatnonzero(np.diff(bucket, prepend=bucket[0] + np.uint64(1), append=bucket[-1] + np.uint64(1)))
        counts = counts.astype(np.uint32)
        rows = []
        for a, b in zip(edges[:-1].tolist(), edges[1:].tolist()):
            # lone shingles need no count: they come first, then those with counts
            lone = counts[a:b] == 1
            own = np.concatenate([low[a:b][lone], low[a:b][~lone]])
            rows.append((int(bucket[a]), own.tobytes(), counts[a:b][~lone].tobytes()))
        return records(rows, COUNTS)

    def run(batches):
        held, size = [], 0
        for batch in batches:
            for part in slices(batch, "text"):
                sets = batch_sets(part, "text", words)
                held += sets
                size += sum(map(len, sets))
                if size >= WINDOW:
                    yield flush(held)
                    held, size = [], 0
        if size:
            yield flush(held)

    return run


def _frequent(least: int, bits: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keys, counts, bucket = [], [], 0
        for batch in batches:
            for b, k, c in zip(*[batch.column(x).to_pylist() for x in ("bucket", "keys", "counts")]):
                k, c, bucket = np.frombuffer(k, np.uint32), np.frombuffer(c, np.uint32), b
                keys.append(k)
                counts.append(np.concatenate([np.ones(len(k) - len(c), np.uint32), c]))
        keys, counts = np.concatenate(keys), np.concatenate(counts)
        order = np.argsort(keys, kind="stable")
        keys, counts = keys[order], counts[order].astype(np.int64)
        first = np.flatnonzero(np.diff(keys, prepend=~keys[:1]))
        sums = np.add.reduceat(counts, first)
        often = sums >= least
        found = (np.int64(bucket) << np.int64(32)) | keys[first][often].astype(np.int64)
        yield pa.record_batch([pa.array(found, pa.int64()), pa.array(sums[often], pa.int64())], names=["key", "n"])

    return run


def frequent_shingles(rows: DataFrame, bits: int, words: int, least: int = 16, most: int = 500_000) -> np.ndarray:
    """Sorted keys (top ``bits + 32`` bits) of the most frequent shingles, counted over all documents.

    Only the order of shingles depends on this list, never a result: it is bounded by ``most``.
    """
    dealt = rows.mapInArrow(_count(bits, words), "bucket long, keys binary, counts binary")
    often = dealt.groupBy("bucket").applyInArrow(_frequent(least, bits), "key long, n long")
    top = often.orderBy(F.desc("n"), "key").limit(most).select("key").toArrow()
    return np.sort(top.column(0).to_numpy())


# ------------------------------------------------------------------------ prefixes
def _ordered_prefix(own: np.ndarray, often: np.ndarray, bits: int, percent: int) -> np.ndarray:
    size = prefix_size(len(own), percent)
    if len(often):
        keys = (own >> np.uint64(32 - bits)).astype(np.int64)
        late = often[np.minimum(np.searchsorted(often, keys), len(often) - 1)] == keys
        if late.any():
            own = np.concatenate([own[~late], own[late]])
    return own[:size]


def _bitmap(own: np.ndarray) -> bytes:
    marks = np.zeros(BITS, bool)
    marks[(own & np.uint64(BITS - 1)).astype(np.int64)] = True
    return np.packbits(marks).tobytes()


def _members(often, bits: int, words: int, percent: int):
    """Per document: size, digest of the set (vertex) and of size and prefix (group), bitmap of the set."""

    def run(batches):
        keys = often.value
        for batch in batches:
            for part in slices(batch, "text"):
                rows = []
                for id_, doc, own in zip(part.column("id").to_pylist(), part.column("doc").to_pylist(),
                                         batch_sets(part, "text", words)):
                    prefix = _ordered_prefix(own, keys, bits, percent)
                    rows.append((id_, doc, len(own), _digest64(own.tobytes()), _digest64(len(own).to_bytes(8, "little") + prefix.tobytes()), _bitmap(own)))
                yield records(rows, MEMBER)

    return run


def _postings(often, bits: int, words: int, percent: int):
    """Prefix shingles of each group, once per window of a task, dealt to buckets."""

    def flush(groups):
        sizes = np.array([len(p) for _, p in groups.values()])
        keys = np.concatenate([p for _, p in groups.values()])
        ids = np.repeat(np.array(list(groups), np.int64), sizes)
        n = np.repeat(np.array([n for n, _ in groups.values()], np.uint32), sizes)
        places = (np.arange(len(keys)) - np.repeat(np.cumsum(sizes) - sizes, sizes)).astype(np.uint32)
        order = np.argsort(keys)
        bucket, low = _split(keys[order], bits)
        ids, n, places = ids[order], n[order], places[order]
        edges = np.flatnonzero(np.diff(bucket, prepend=bucket[0] + np.uint64(1), append=bucket[-1] + np.uint64(1)))
        return records([(int(bucket[a]), low[a:b].tobytes(), ids[a:b].tobytes(), n[a:b].tobytes(), places[a:b].tobytes())
                        for a, b in zip(edges[:-1].tolist(), edges[1:].tolist())], POST)

    def run(batches):
        keys, groups, size = often.value, {}, 0
        for batch in batches:
            for part in slices(batch, "text"):
                for own in batch_sets(part, "text", words):
                    if len(own):
                        prefix = _ordered_prefix(own, keys, bits, percent)
                        group = _digest64(len(own).to_bytes(8, "little") + prefix.tobytes())
                        if group not in groups:
                            groups[group] = (len(own), prefix)
                            size += len(prefix)
                if size >= WINDOW:
                    yield flush(groups)
                    groups, size = {}, 0
        if groups:
            yield flush(groups)

    return run


def _runs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """One bucket: shingles in the prefixes of two groups or more, with a pivot per size class.

    The pivot is the smallest group among those of like size: sizes within a factor of
    1.25 lie in one class or in two neighbouring ones.
    """
    parts, bucket = [[], [], [], []], 0
    for batch in batches:
        bucket = batch.column("bucket")[0].as_py()
        for held, (name, kind) in zip(parts, (("keys", np.uint32), ("groups", np.int64), ("sizes", np.uint32), ("places", np.uint32))):
            held += [np.frombuffer(x, kind) for x in batch.column(name).to_pylist()]
    key, group, n, pos = map(np.concatenate, parts)
    order = np.lexsort((group, key))
    key, group, n, pos = key[order], group[order], n[order], pos[order]
    fresh = np.ones(len(key), bool)
    fresh[1:] = (key[1:] != key[:-1]) | (group[1:] != group[:-1])
    key, group, n, pos = key[fresh], group[fresh], n[fresh], pos[fresh]
    same = key[1:] == key[:-1]
    shared = np.zeros(len(key), bool)
    shared[1:] |= same
    shared[:-1] |= same
    key, group, n, pos = key[shared], group[shared], n[shared].astype(np.int64), pos[shared].astype(np.int64)
    if not len(key):
        return
    level = np.floor(np.log(n) / math.log(1.25)).astype(np.int64)
    order = np.lexsort((group, level, key))
    key, group, n, pos, level = key[order], group[order], n[order], pos[order], level[order]
    first = np.ones(len(key), bool)
    first[1:] = (key[1:] != key[:-1]) | (level[1:] != level[:-1])
    pivot = group[np.flatnonzero(first)[np.cumsum(first) - 1]]
    whole = (np.int64(bucket) << np.int64(32)) | key.astype(np.int64)
    for i in range(0, len(key), 100_000):
        yield pa.record_batch([pa.array(c[i:i + 100_000], pa.int64()) for c in (whole, group, n, pos, pivot)], schema=RUN)


# -------------------------------------------------------------------- verification
def _texts(words: int):
    """Texts whose set is the wanted vertex (an id may occur with several texts)."""

    def run(batches):
        for batch in batches:
            for part in slices(batch, "text"):
                texts = part.column("text").to_pylist()
                rows = [(v, t) for v, t, own in zip(part.column("v").to_pylist(), texts, batch_sets(part, "text", words))
                        if _digest64(own.tobytes()) == v]
                yield records(rows, TEXT)

    return run


def _verify(words: int, percent: int):
    def run(batches):
        for batch in batches:
            for part in slices(batch, "ta"):
                for half in slices(part, "tb"):
                    rows = []
                    for a, b, x, y in zip(half.column("a").to_pylist(), half.column("b").to_pylist(),
                                          batch_sets(half, "ta", words), batch_sets(half, "tb", words)):
                        both = len(np.intersect1d(x, y, assume_unique=True))
                        if both and 100 * both >= percent * (len(x) + len(y) - both):
                            rows.append((a, b))
                    yield records(rows, LINK)

    return run


def verified(docs: DataFrame, pairs: DataFrame, vertices: DataFrame, words: int, percent: int) -> DataFrame:
    """The pairs ``(a, b)`` of vertices whose whole sets are similar enough; stored."""
    pairs = stored(pairs)
    wanted = pairs.select(F.col("a").alias("v")).union(pairs.select("b")).distinct().join(
        vertices.select("v", "id"), "v")
    wanted = stored(wanted)
    # at most MOST_BROADCAST pairs of numbers are sent out, more are joined by shuffle
    side = F.broadcast(wanted) if wanted.count() <= MOST_BROADCAST else wanted
    texts = stored(docs.join(side, "id").select("v", "text").mapInArrow(_texts(words), "v long, text string")
                   .dropDuplicates(["v"]))
    a, b = texts.toDF("a", "ta"), texts.toDF("b", "tb")
    return stored(pairs.join(a, "a").join(b, "b").select("a", "b", "ta", "tb").mapInArrow(
        _verify(words, percent), "a long, b long"))


def _bounded(pairs: DataFrame, percent: int, extra=(), shared=None) -> DataFrame:
    """Group pairs ``(g, h)`` that size and position allow, from one row per shared shingle, or rows that count them.

    Behind the last shared prefix shingle at most the rest of the smaller set can be
    shared; before it, only what was counted.
    """
    need = F.ceil(F.expr(f"{percent} * (gn + hn) / {100 + percent}"))
    reach = F.col("c") + F.least(F.col("gn") - F.col("gp") - 1, F.col("hn") - F.col("hp") - 1)
    return pairs.groupBy("g", "h", "gn", "hn", *extra).agg(
        (F.count(F.lit(1)) if shared is None else shared).alias("c"), F.max("gp").alias("gp"), F.max("hp").alias("hp")).where(reach >= need)


def _once(found: list) -> np.ndarray:
    """One line per pair of groups: ids, sizes, shared shingles, last shared positions."""
    g, h, gn, hn, c, gp, hp = np.concatenate(found, axis=1)
    order = np.lexsort((h, g))
    g, h, gn, hn, c, gp, hp = [x[order] for x in (g, h, gn, hn, c, gp, hp)]
    first = np.flatnonzero(np.append(True, (g[1:] != g[:-1]) | (h[1:] != h[:-1]))[:len(g)])
    if not len(first):
        return np.zeros((7, 0), np.int64)
    return np.stack([g[first], h[first], gn[first], hn[first], np.add.reduceat(c, first), np.maximum.reduceat(gp, first),
                     np.maximum.reduceat(hp, first)])


def _meet(percent: int):
    """Pairs of groups that share a shingle, lie in different components and can be similar enough.

    Every pair leaves the task once, with the number of shingles it shares there. The bits in which the bitmaps of two sets differ are elements in which the sets differ,
    so the bitmaps bound the intersection from above; a group of several sets has none.
    """

    def run(table: pa.Table) -> pa.Table:
        grp, n, pos, lo, hi, key, one, two, own = [table.column(c).to_numpy() for c in (
            "grp", "n", "pos", "lo", "hi", "key", "one", "two", "own")]
        order = np.lexsort((grp, two, one, key))
        grp, n, pos, lo, hi, key, one, two, own = [c[order] for c in (grp, n, pos, lo, hi, key, one, two, own)]
        raw = [table.column("bits")[i].as_py() for i in order.tolist()]
        single = np.array([b is not None for b in raw])
        bits = np.frombuffer(b"".join(b or bytes(BITS // 8) for b in raw), np.uint64).reshape(len(raw), -1)
        same = (key[1:] == key[:-1]) & (one[1:] == one[:-1]) & (two[1:] == two[:-1])
        ends = np.append(np.flatnonzero(~same) + 1, len(key))
        end = np.repeat(ends, np.diff(ends, prepend=0))
        at, found, size = np.arange(len(key)), [], 0
        for step in range(1, len(key)):
            at = at[at + step < end[at]]
            if not len(at):
                break
            to = at + step
            small, large = np.minimum(n[at], n[to]), np.maximum(n[at], n[to])
            fits = (100 * small >= percent * large) & ((one[at] == two[at]) | (own[at] != own[to]))
            fits &= (lo[at] != hi[at]) | (lo[to] != hi[to]) | (lo[at] != lo[to])
            a, b = at[fits], to[fits]
            for i in range(0, len(a), 50_000):
                x, y = a[i:i + 50_000], b[i:i + 50_000]
                apart = np.bitwise_count(bits[x] ^ bits[y]).sum(1, dtype=np.int64)
                most = (n[x] + n[y] - np.where(single[x] & single[y], apart, 0)) // 2
                near = 100 * most >= percent * (n[x] + n[y] - most)
                x, y = x[near], y[near]
                turned = grp[x] > grp[y]
                x, y = np.where(turned, y, x), np.where(turned, x, y)
                found.append(np.stack([grp[x], grp[y], n[x], n[y], np.ones(len(x), np.int64), pos[x], pos[y]]))
                size += len(x)
            if size > 1_000_000:
                found = [_once(found)]
                size = 0
        out = _once(found) if found else np.zeros((7, 0), np.int64)
        return pa.table(list(out), names=["g", "h", "gn", "hn", "c", "gp", "hp"])

    return run


def _met(held: DataFrame, percent: int) -> DataFrame:
    """Rows ``(g, h, gn, hn, c, gp, hp)`` of the pairs that pass :func:`_meet`, from rows per shingle and group.

    The shingles of a crowd share their smallest component (``home``) and go to one task as far
    as its bound allows, so that a pair is mostly met once. The groups of a very common
    shingle are cut into blocks, and every two blocks meet in one task.
    """
    sizes = held.groupBy("key").agg(F.count(F.lit(1)).alias("groups"))
    common = sizes.where(F.col("groups") > CROWD).select("key", F.ceil(F.col("groups") / CROWD).cast("int").alias("cut"))
    homes = held.groupBy("home").agg(F.count(F.lit(1)).alias("rows"))
    wide = homes.where(F.col("rows") > UNIT_ROWS).select("home", F.ceil(F.col("rows") / UNIT_ROWS).alias("parts"))
    rows = held.join(small_side(common, common.count()), "key", "left").join(small_side(wide, wide.count()), "home", "left")
    rows = rows.withColumns({"cut": F.coalesce("cut", F.lit(1)), "part": F.pmod(F.xxhash64("key"), F.coalesce("parts", F.lit(1)))})
    rows = rows.withColumn("own", F.pmod(F.xxhash64("grp"), F.col("cut")).cast("int"))
    rows = rows.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("cut") - 1)))
    rows = rows.withColumns({"one": F.least("own", "other"), "two": F.greatest("own", "other")})
    units = int(held.count() // UNIT_ROWS + 1) * 4
    rows = rows.withColumn("unit", F.pmod(F.xxhash64("home", "part", "one", "two"), F.lit(units)))
    return rows.drop("cut", "other", "parts", "part", "home").groupBy("unit").applyInArrow(_meet(percent), MET)


def _crowds(docs, runs, groups, vertices, links, known, words: int, percent: int, crowd: int = 24,
            rounds: int = 5, draws: int = 3):
    """Grow the components where many groups share a shingle, by pivots from the largest ones.

    In each round a shingle names ``draws`` pivots: groups of the largest component that
    has it, drawn by a hash that all shingles share. Groups of other components are compared
    with their likeliest pivots. Whatever this leaves is compared in full later, so
    it saves comparisons and decides nothing.
    """
    crowded = runs.groupBy("key").agg(F.count(F.lit(1)).alias("groups")).where(F.col("groups") >= crowd).select("key")
    big = stored(runs.join(crowded, "key").select("key", "grp", "n", "pos"))
    if big.isEmpty():
        return links, known
    reps = stored(big.select("grp").distinct().join(groups.select("grp", "rep"), "grp"))
    ids = stored(reps.join(vertices.select(F.col("v").alias("rep"), "id"), "rep").select("id").distinct())
    near = stored(docs.join(F.broadcast(ids) if ids.count() <= MOST_BROADCAST else ids, "id"))
    for round_ in range(rounds):
        own = reps.join(known.toDF("rep", "component"), "rep", "left").withColumn(
            "component", F.coalesce("component", "rep"))
        sizes = own.groupBy("component").agg(F.count(F.lit(1)).alias("size"))
        held = stored(big.join(own.join(sizes, "component"), "grp"))
        told = F.struct(F.col("grp").alias("h"), F.col("n").alias("hn"), F.col("pos").alias("hp"),
                        F.col("component").alias("hc"), F.col("rep").alias("b"))
        drawn = held.groupBy("key").agg(F.array(*[
            F.max_by(told, F.struct("size", F.xxhash64("grp", F.lit(round_ * draws + k)))) for k in range(draws)]).alias("p"))
        pivots = drawn.select("key", F.explode(F.array_distinct("p")).alias("p")).select("key", "p.*")
        pairs = held.join(pivots, "key").where("component <> hc").select(
            F.col("grp").alias("g"), F.col("n").alias("gn"), F.col("pos").alias("gp"), F.col("rep").alias("a"),
            "h", "hn", "hp", "b")
        likely = _bounded(pairs, percent, ("a", "b")).groupBy("g").agg(F.array(*[
            F.max_by(F.struct("a", "b"), F.struct("c", F.xxhash64("h", F.lit(k)))) for k in range(2)]).alias("best"))
        tried = likely.select(F.explode(F.array_distinct("best")).alias("x")).select("x.a", "x.b").distinct()
        found = verified(near, tried, vertices, words, percent)
        if found.isEmpty():
            break
        links = stored(links.union(found))
        known = stored(components(links))
    return links, known


def ngram_classes(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = 5,
                  percent: int = 80, unique_ids: bool = False) -> DataFrame:
    """One row per document: id, ``n_shingles`` and ``component_id``.

    Sets are the distinct shingles of ``words`` words (A-Z lowered, words cut at ASCII
    white space); a shorter text is one shingle, an empty or null one has none and links
    with nothing. Documents link from ``percent`` of a hundred in Jaccard similarity;
    ``component_id`` is the smallest id reachable. Equal sets are one vertex. Null ids
    take part and get the component of their text (null if it has no other id). Repeated
    rows give repeated results; other columns are ignored; an empty table gives no rows.
    Texts are fetched by a row number on a stored copy of the two columns; ``unique_ids``
    states that the ids are unique and not null, and uses them instead.

    Links are found in two steps. First vertices are compared with a few pivots each,
    which settles most of a large group of near copies with a few comparisons a member.
    Then all pairs that are not in one component yet and pass the filters are compared,
    so no component is missed.
    """
    docs = only(docs, doc=id_col, text=text_col).withColumn("doc", F.col("doc").cast("long"))
    docs = docs.withColumn("id", F.col("doc")) if unique_ids else stored(
        docs.withColumn("id", F.monotonically_increasing_id()))
    size = docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    bits = min(31, max(4, math.ceil(math.log2(size / 5e6 + 1))))
    often = docs.sparkSession.sparkContext.broadcast(frequent_shingles(docs, bits, words))
    members = stored(docs.mapInArrow(_members(often, bits, words, percent), "id long, doc long, n long, v long, grp long, bits binary"))
    vertices = stored(members.where("n > 0").groupBy("v", "grp", "n").agg(
        F.min("id").alias("id"), F.min("doc").alias("doc"), F.min("bits").alias("bits")))
    posted = docs.mapInArrow(_postings(often, bits, words, percent), (
        "bucket long, keys binary, groups binary, sizes binary, places binary"))
    runs = stored(posted.groupBy("bucket").applyInArrow(_runs, "key long, grp long, n long, pos long, pivot long"))
    groups = vertices.groupBy("grp").agg(F.min("v").alias("rep"), F.count(F.lit(1)).alias("size"))

    # round 1: members of a group with its representative, each group with its best pivot
    inside = vertices.join(groups, "grp").where("v <> rep").select(F.col("rep").alias("a"), F.col("v").alias("b"))
    g = runs.select("key", F.col("grp").alias("g"), F.col("n").alias("gn"), F.col("pos").alias("gp"), F.col("pivot").alias("h"))
    p = runs.where("grp = pivot").select("key", F.col("grp").alias("h"), F.col("n").alias("hn"), F.col("pos").alias("hp"))
    met = _bounded(g.where("g <> h").join(p, ["key", "h"]), percent)
    best = met.groupBy("g").agg(F.max_by("h", F.struct("c", "h")).alias("h"))
    rep = groups.select("grp", "rep")
    across = best.join(rep.toDF("g", "a"), "g").join(rep.toDF("h", "b"), "h").select("a", "b")
    links = verified(docs, inside.union(across), vertices, words, percent)
    known = stored(components(links))
    links, known = _crowds(docs, runs, groups, vertices, links, known, words, percent)

    # round 2: what is not in one component yet
    placed = stored(vertices.join(known.toDF("v", "component"), "v", "left").select(
        "v", "grp", "id", F.coalesce("component", "v").alias("component")))
    spread = placed.groupBy("grp").agg(F.min("component").alias("lo"), F.max("component").alias("hi"))
    held = runs.join(spread, "grp")
    # shingles whose groups all lie in one component are settled: no pair is formed there
    mixed = held.groupBy("key").agg(F.min("lo").alias("home"), F.max("hi").alias("far")).where("home <> far").select("key", "home")
    open_ = stored(held.join(mixed, "key").select("key", "grp", "n", "pos", "lo", "hi", "home"))
    # the rest is met with bitmaps, so that few pairs leave the tasks
    drawn = vertices.groupBy("grp").agg(F.when(F.count(F.lit(1)) == 1, F.first("bits")).alias("bits"))
    near = stored(_bounded(_met(open_.join(drawn, "grp"), percent), percent, shared=F.sum("c")).select("g", "h"))
    one, two = placed.select("v", "grp", "component").toDF("a", "g", "ca"), placed.select("v", "grp", "component").toDF("b", "h", "cb")
    expanded = near.join(one, "g").join(two, "h").where("ca <> cb").select("a", "b")
    loose = spread.where("lo <> hi").select(F.col("grp").alias("g"))
    within = loose.join(one, "g").join(two.withColumnRenamed("h", "g"), "g").where("a < b and ca <> cb").select("a", "b")
    later = verified(docs, expanded.union(within), vertices, words, percent)
    final = components(links.union(later)) if not later.isEmpty() else known

    named = vertices.select("v", "doc").join(final.toDF("v", "component"), "v", "left").select(
        "v", "doc", F.coalesce("component", "v").alias("component"))
    smallest = named.groupBy("component").agg(F.min("doc").alias("component_id"))
    labels = named.join(smallest, "component").select("v", "component_id")
    # a set held by very many documents is one row of the label side
    out = members.join(labels, "v", "left").select(
        F.col("doc").alias(id_col), F.col("n").alias("n_shingles"),
        F.when(F.col("n") > 0, F.col("component_id")).otherwise(F.col("doc")).alias("component_id"))
    return out

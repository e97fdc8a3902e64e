"""Exact deduplication by Grace hash partitions and open-addressing tables.

Rows are collapsed task by task, spilled once to the shared folder, and dealt to hash
buckets; buckets whose distinct content is over the bound are split again with the next
hash until all fit. Each bucket is then loaded into an open-addressing table that
compares complete contents.
"""

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, functions as F

from .common import records, stored

BLANKS = frozenset(b" \t\n\v\f\r")
SPILL = pa.schema([("row", pa.int64()), ("key", pa.int64()), ("id", pa.int64()), ("rep", pa.int64()), ("hash", pa.int64()),
                   ("sha", pa.string()), ("bytes", pa.int64()), ("content", pa.binary()), ("copies", pa.int64()),
                   ("best_id", pa.int64()), ("best_row", pa.int64())])
GROUP = pa.schema([("rep", pa.int64()), ("keep_id", pa.int64()), ("keep_row", pa.int64()),
                   ("group_size", pa.int64()), ("text_sha256", pa.string())])


def squeeze(text: bytes) -> bytes:
    """Each run of ASCII white space becomes one space; ends are not trimmed."""
    if not text:
        return text
    core = b" ".join(text.split())  # bytes.split() knows exactly the six ASCII blanks
    if not core:
        return b" "
    return (b" " if text[0] in BLANKS else b"") + core + (b" " if text[-1] in BLANKS else b"")


class ContentTable:
    """Open addressing with linear probing over (hash, content); at most half full."""

    def __init__(self):
        self.slots, self.hashes, self.contents = [-1] * 64, [], []

    def place(self, hash_: int, content: bytes) -> int:
        """Number of the entry with this very content; a new one if there is none."""
        mask = len(self.slots) - 1
        slot = hash_ & mask
        while (entry := self.slots[slot]) >= 0:
            if self.hashes[entry] == hash_ and self.contents[entry] == content:
                return entry
            slot = (slot + 1) & mask
        self.slots[slot] = entry = len(self.contents)
        self.hashes.append(hash_)
        self.contents.append(content)
        if 2 * len(self.contents) > len(self.slots):
            self._grow()
        return entry

    def _grow(self):
        mask = 2 * len(self.slots) - 1
        self.slots = [-1] * (mask + 1)
        for entry, hash_ in enumerate(self.hashes):
            slot = hash_ & mask
            while self.slots[slot] >= 0:
                slot = (slot + 1) & mask
            self.slots[slot] = entry


def _order(id_, row):
    """Smallest id first, null ids last, then row number."""
    return (id_ is None, id_ or 0, row)


def _collapse(window_bytes: int, window_rows: int):
    """Rows of a task, with the content only on the first copy in each window."""

    def flush(rows, firsts, shas, table):
        best, copies = list(firsts), [0] * len(firsts)
        for entry, id_, row, _ in rows:
            copies[entry] += 1
            best[entry] = min(best[entry], (id_, row), key=lambda x: _order(*x))
        out = []
        for entry, id_, row, key in rows:
            first = firsts[entry]
            if row == first[1]:
                out.append((row, key, id_, row, table.hashes[entry], shas[entry], len(table.contents[entry]),
                            table.contents[entry], copies[entry], *best[entry]))
            else:
                out.append((row, key, id_, first[1], None, None, None, None, None, None, None))
        for i in range(0, len(out), 2000):
            yield records(out[i:i + 2000], SPILL)

    def run(batches):
        number = TaskContext.get().partitionId() << 33
        table, rows, firsts, shas, size = ContentTable(), [], [], [], 0
        for batch in batches:
            texts = batch.column(1).cast(pa.binary())
            for i, (id_, key) in enumerate(zip(batch.column(0).to_pylist(), batch.column(2).to_pylist())):
                content = squeeze(texts[i].as_py() or b"")
                digest = hashlib.sha256(content)
                entry = table.place(int.from_bytes(digest.digest()[:8], "big", signed=True), content)
                if entry == len(firsts):
                    firsts.append((id_, number))
                    shas.append(digest.hexdigest())
                    size += len(content)
                rows.append((entry, id_, number, key))
                number += 1
                if size >= window_bytes or len(rows) >= window_rows:
                    yield from flush(rows, firsts, shas, table)
                    table, rows, firsts, shas, size = ContentTable(), [], [], [], 0
        yield from flush(rows, firsts, shas, table)

    return run


def _resolve(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """One bucket: equal contents found in the table get the group's best row and size."""
    table, best, sizes, shas, reps = ContentTable(), [], [], [], []
    for batch in batches:
        contents = batch.column("content")
        for i, (rep, hash_, sha, copies, id_, row) in enumerate(zip(*[batch.column(c).to_pylist() for c in (
                "rep", "hash", "sha", "copies", "best_id", "best_row")])):
            entry = table.place(hash_, contents[i].as_py())
            if entry == len(best):
                best.append((id_, row))
                sizes.append(0)
                shas.append(sha)
            best[entry] = min(best[entry], (id_, row), key=lambda x: _order(*x))
            sizes[entry] += copies
            reps.append((rep, entry))
    for i in range(0, len(reps), 20_000):
        yield records([(rep, *best[e], sizes[e], shas[e]) for rep, e in reps[i:i + 20_000]], GROUP)


def bucketed(rows: DataFrame, bucket_bytes: int, max_depth: int = 8) -> DataFrame:
    """Append ``bucket``: hash partitions, each split again by another hash while over the bound.

    Only hashes and sizes are read. A bucket counts its distinct contents, so copies of
    one text never cause a split that cannot help.
    """
    total = rows.agg(F.sum("bytes")).first()[0] or 0
    fan_out = int(total // bucket_bytes) + 1
    rows = rows.withColumn("bucket", F.pmod("hash", F.lit(fan_out)).cast("string"))
    for depth in range(1, max_depth + 1):
        distinct = rows.groupBy("bucket", "hash").agg(F.max("bytes").alias("bytes"))
        over = (distinct.groupBy("bucket").agg(F.sum("bytes").alias("all"), F.count(F.lit(1)).alias("n"))
                .where((F.col("all") > 2 * bucket_bytes) & (F.col("n") > 1))
                .select("bucket", (F.floor(F.col("all") / bucket_bytes) + 1).alias("parts")))
        if over.isEmpty():
            break
        part = F.pmod(F.xxhash64("hash", F.lit(depth)), F.col("parts"))
        rows = rows.join(over, "bucket", "left").withColumn("bucket", F.when(
            F.col("parts").isNull(), F.col("bucket")).otherwise(F.concat_ws(".", "bucket", part))).drop("parts")
    return rows


def exact_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", bucket_bytes: int = 32 << 20,
                window_bytes: int = 16 << 20, window_rows: int = 50_000, key_col: str | None = None) -> DataFrame:
    """One row per document: ``id, keep_id, group_size, kept, text_sha256``.

    ``key_col`` may name a column of numbers that is carried along as ``key``.

    Texts are equal when identical after squeezing ASCII white space; null counts as
    empty. The row with the smallest id stays (null ids last; of rows with the same id
    the first read stays, so exactly one row of each group has ``kept``). Other columns
    are ignored; an empty table gives an empty result.
    """
    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"),
                       (F.col(key_col) if key_col else F.lit(None)).cast("long").alias("key"))
    spill = stored(rows.mapInArrow(_collapse(window_bytes, window_rows), (
        "row long, key long, id long, rep long, hash long, sha string, bytes long, content binary, copies long,"
        "best_id long, best_row long")))
    contents = bucketed(spill.where("content is not null"), bucket_bytes).select(
        "bucket", "rep", "hash", "sha", "content", "copies", "best_id", "best_row")
    groups = contents.groupBy("bucket").applyInArrow(
        _resolve, "rep long, keep_id long, keep_row long, group_size long, text_sha256 string")
    # a representative stands for the copies of one window only, so no key of this join is hot
    return (spill.select("row", "key", "id", "rep").join(groups, "rep")
            .select(*(["key"] if key_col else []), F.col("id").alias(id_col), "keep_id", "group_size",
                    (F.col("row") == F.col("keep_row")).alias("kept"), "text_sha256"))

"""Conflict-constrained best-fit packing of documents into training sequences."""

import hashlib
from bisect import bisect_left, insort
from collections import Counter

import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from .common import only, records, stored

PLACE = pa.schema([("row", pa.int64()), ("piece", pa.int64()), ("start", pa.int64()), ("length", pa.int64()),
                   ("bin", pa.int64()), ("slot", pa.int64())])


class Bins:
    """Open bins ordered by residual; each carries bitmaps of its sources and clusters.

    Bins of one residual are kept by source bitmap, so that the successor search skips
    all bins that hold a source at once.
    """

    def __init__(self, capacity: int):
        self.capacity, self.count = capacity, 0
        self.residuals: list[int] = []
        self.by_residual: dict[int, dict[int, list[list[int]]]] = {}  # residual -> sources -> [bin, clusters, slots]

    def place(self, length: int, source: int, cluster: int) -> tuple[int, int]:
        """Bin and slot of a piece: the tightest open bin without its source and cluster, the oldest on ties."""
        for i in range(bisect_left(self.residuals, length), len(self.residuals)):
            residual, best = self.residuals[i], None
            for sources, bins in self.by_residual[residual].items():
                if sources & source:
                    continue
                for at, one in enumerate(bins):  # oldest first
                    if best is not None and one[0] > best[2][0]:
                        break
                    if not one[1] & cluster:
                        best = (sources, at, one)
                        break
            if best:
                sources, at, one = best
                same = self.by_residual[residual]
                same[sources].pop(at)
                if not same[sources]:
                    del same[sources]
                if not same:
                    del self.by_residual[residual]
                    self.residuals.pop(i)
                self._open(residual - length, sources | source, [one[0], one[1] | cluster, one[2] + 1])
                return one[0], one[2]
        number, self.count = self.count, self.count + 1
        self._open(self.capacity - length, source, [number, cluster, 1])
        return number, 0

    def _open(self, residual, sources, one):
        if residual <= 0:
            return  # full
        if residual not in self.by_residual:
            insort(self.residuals, residual)
            self.by_residual[residual] = {}
        insort(self.by_residual[residual].setdefault(sources, []), one)


def pack(items, capacity: int):
    """Best-fit decreasing over ``(row, length, source, cluster)``.

    Items over the capacity are cut: whole pieces fill a bin each, the rest is packed.
    Longest first, ties by row. Returns ``(row, piece, start, length, bin, slot)``.
    """
    common = {c for c, n in Counter(c for _, _, _, c in items if c is not None).items() if n > 1}
    source_bit, cluster_bit, bins, out, rest = {}, {}, Bins(capacity), [], []
    for row, length, source, cluster in items:
        whole = length // capacity if length > capacity else 0
        if whole and whole * capacity == length:
            whole -= 1
        for piece in range(whole):
            rest.append((-capacity, row, piece, source, cluster))
        rest.append((whole * capacity - length, row, whole, source, cluster))
    for negative, row, piece, source, cluster in sorted(rest, key=lambda x: x[:3]):
        # only what occurs twice can conflict; null sources and clusters conflict with nothing
        s = 0 if source is None else 1 << source_bit.setdefault(source, len(source_bit))
        c = 1 << cluster_bit.setdefault(cluster, len(cluster_bit)) if cluster in common else 0
        out.append((row, piece, piece * capacity, -negative, *bins.place(-negative, s, c)))
    return out


def _pack_group(capacity: int):
    def run(key, rows):
        group = key[0].as_py()
        items = list(zip(*[rows.column(c).to_pylist() for c in ("row", "length", "source", "cluster")]))
        placed = [(row, piece, start, length, (group << 32) | bin_, slot)
                  for row, piece, start, length, bin_, slot in pack(items, capacity)]
        return pa.Table.from_batches([records(placed, PLACE)])

    return run


def _items(batches):
    """Length in words, and the duplicate cluster (digest of the text with blanks squeezed)."""
    for batch in batches:
        texts = batch.column("text").cast(pa.binary())
        lengths, clusters = [], []
        for i in range(batch.num_rows):
            words = (texts[i].as_py() or b"").split()
            lengths.append(len(words))
            clusters.append(int.from_bytes(hashlib.blake2b(b" ".join(words), digest_size=8).digest(), "little", signed=True))
        yield pa.record_batch([batch.column("id"), batch.column("source"), pa.array(lengths, pa.int64()),
                               pa.array(clusters, pa.int64())], names=["id", "source", "length", "cluster"])


def items_of(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source") -> DataFrame:
    """``id, source, length, cluster`` of documents; null texts have length 0."""
    rows = only(docs, id=id_col, text=text_col, source=source_col)
    kinds = dict(rows.dtypes)
    return rows.mapInArrow(_items, f"id {kinds['id']}, source {kinds['source']}, length long, cluster long")


def best_fit_pack(items: DataFrame, capacity: int = 2048, group_rows: int = 5000) -> DataFrame:
    """Pack rows ``id, source, length, cluster``: ``id, source, piece, start, length, bin, slot``.

    Two pieces share a bin only if their sources and their duplicate clusters differ;
    null sources and clusters conflict with nothing. Rows longer than ``capacity`` are
    cut into pieces (``start`` counts words); rows of length 0 are packed too and need no
    room. Repeated rows are packed each on its own. Rows are dealt by hash into groups
    of about ``group_rows``, each packed on its own, so the number of tasks follows the
    data and no source or cluster meets in one place. An empty table gives no rows.
    """
    items = stored(items.select("id", "source", "length", "cluster").withColumn("row", F.monotonically_increasing_id()))
    n = max(1, -(-items.count() // group_rows))
    dealt = items.select("row", "length", "source", "cluster").withColumn("group", F.pmod(F.xxhash64("row"), F.lit(n)))
    placed = dealt.groupBy("group").applyInArrow(
        _pack_group(capacity), "row long, piece long, start long, length long, bin long, slot long")
    return placed.join(items.select("row", "id", "source"), "row").select(
        "id", "source", "piece", "start", "length", "bin", "slot")

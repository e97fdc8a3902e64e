"""Mixing sources to target weights by weighted fair queueing.

Every source hands out its documents in a shuffled order, as often as it may be repeated.
A packet of a document gets a virtual finish time: the words its source has handed out up
to and including it, divided by the source's target. All packets are range-sorted by that
time and cut at the total budget, where all sources are equally far on their way.
"""

from typing import NamedTuple

from pyspark.sql import DataFrame, Window, functions as F

from ..plans.bounds import small_side
from ..plans.quantiles import PART, ranged
from ..plans.running import running_totals
from .common import only, stored

WORD = r"[^\x20\x09-\x0D]+"
# Rows that one task orders.
PART_ROWS = 200_000


class Mix(NamedTuple):
    """``queue``: the packets taken, in range partitions of the mix's order. ``documents``: one row per document."""

    queue: DataFrame
    documents: DataFrame


def _ranked(sources: DataFrame, part_rows: int) -> DataFrame:
    """Sources numbered from 0 by code point, null last, by range partitions and their offsets."""
    lines = ranged(sources.withColumn("unknown", F.col("source").isNull()), ["unknown", "source"], part_rows)
    line = Window.orderBy(PART)  # one row per partition
    slots = lines.groupBy(PART).agg(F.count(F.lit(1)).alias("n"))
    slots = slots.select(PART, (F.sum("n").over(line) - F.col("n")).alias("offset"))
    own = F.row_number().over(Window.partitionBy(PART).orderBy("unknown", "source"))
    # one row per range partition
    return lines.join(F.broadcast(slots), PART).select("source", "source_size", (F.col("offset") + own - 1).alias("rank"))


def source_targets(sources: DataFrame, weights=(3, 1, 2), share: float = 1.5, repeats: int = 2,
                   part_rows: int = PART_ROWS) -> tuple[DataFrame, float]:
    """``source, rank, source_size, target`` per row of ``(source, source_size)``, stored, and the budget.

    Sources in code point order, null last, have the ``weights`` in turn and share
    ``share`` times all sizes. No target is over ``repeats`` times its source; the excess goes
    to the others by weight. The level at which this ends is found from running sums:
    sources sorted by the level that fills them are full up to some point and no further.
    """
    ranked = _ranked(sources, part_rows)
    turn = F.element_at(F.array(*[F.lit(w) for w in weights]), (F.col("rank") % len(weights) + 1).cast("int"))
    lines = stored(ranked.withColumns({"weight": turn, "most": F.col("source_size") * repeats})
                   .withColumn("fills", F.col("most") / F.col("weight")))
    total = lines.agg(F.sum("source_size")).first()[0] or 0
    budget = total * share
    sums = running_totals(lines, "fills", ["most", "weight"], part_rows)
    level = (F.lit(budget) - (F.col("all_most") - F.col("cum_most"))) / F.col("cum_weight")
    found = sums.withColumn("level", level).where("level <= fills").agg(F.min(F.struct("fills", "level"))["level"]).first()[0]
    target = F.col("most").cast("double")
    if found is not None:
        target = F.least(target, F.lit(found) * F.col("weight"))
    return stored(lines.select("source", "rank", "source_size", target.alias("target"))), budget


def _in_order(docs: DataFrame, part_rows: int) -> DataFrame:
    """Stored rows with ``before``: the words of their source ahead of them in the shuffled order.

    A source lies in as many range partitions as it needs; each is summed on its own and
    moved by the totals of those before it.
    """
    parts = int(docs.count() // part_rows + 1)
    dealt = stored(docs.repartitionByRange(parts, "rank", "shuffled", "row").withColumn(PART, F.spark_partition_id()))
    line = Window.partitionBy("rank").orderBy(PART)  # a row per range partition that the source reaches into
    slots = dealt.groupBy("rank", PART).agg(F.sum("size").alias("words"))
    slots = stored(slots.select("rank", PART, (F.sum("words").over(line) - F.col("words")).alias("offset")))
    upto = Window.partitionBy("rank", PART).orderBy("shuffled", "row").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    here = dealt.withColumn("upto", F.sum("size").over(upto))
    return here.join(small_side(slots, slots.count()), ["rank", PART]).withColumn(
        "before", F.col("offset") + F.col("upto") - F.col("size")).drop(PART, "upto", "offset")


def fair_mix(docs: DataFrame, weights=(3, 1, 2), share: float = 1.5, repeats: int = 2, packet: int = 256,
             id_col: str = "doc_id", text_col: str = "text", source_col: str = "source",
             part_rows: int = PART_ROWS) -> Mix:
    """Mix the documents of all sources to their targets (see :func:`source_targets`).

    ``queue`` has ``id, source, turn, words, finish`` of each packet taken: the next ``words`` words
    of the document in the ``turn``-th round through its source. Only at the cut can a source
    stop inside a document, and then after whole packets of ``packet`` words, so that one very
    long document does not push its source off the target. ``documents`` has ``id, size, source_size,
    target, taken``, in words, repeats counted; no document is taken more than ``repeats`` times.

    A null text has size 0 and, like a blank one, is taken 0 times. Null ids and sources
    take part; repeated rows are documents of their own. The shuffled order is the hash of id
    and text, so reruns agree under any partitioning; rows equal in both are interchangeable.
    Other columns are ignored; an empty table gives no rows.
    """
    text = F.col("text")
    rows = only(docs, id=id_col, text=text_col, source=source_col)
    narrow = stored(rows.select(
        F.monotonically_increasing_id().alias("row"), "id", "source",
        F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long").alias("size"),
        F.md5(F.concat_ws(":", F.col("id").cast("string"), text)).alias("shuffled")))
    targets, budget = source_targets(
        narrow.groupBy("source").agg(F.sum("size").alias("source_size")), weights, share, repeats, part_rows)
    sources = small_side(targets, targets.count()).withColumnRenamed("source", "name")
    known = stored(narrow.join(sources, F.col("source").eqNullSafe(F.col("name")), "left").drop("name"))

    served = _in_order(known.where("size > 0").select("row", "id", "source", "rank", "shuffled", "size", "source_size", "target"), part_rows)
    turns = served.withColumn("turn", F.explode(F.sequence(F.lit(0), F.lit(repeats - 1))))
    packets = turns.withColumn("_p", F.explode(F.sequence(F.lit(0).cast("long"), F.expr(f"(size - 1) div {packet}"))))
    words = F.least(F.lit(packet), F.col("size") - F.col("_p") * packet)
    upto = F.col("turn") * F.col("source_size") + F.col("before") + F.col("_p") * packet + words
    queued = packets.select("row", "id", "source", "rank", "turn", words.alias("words"), upto.alias("upto"),
                            (upto / F.col("target")).alias("finish"))
    waiting = known.agg(F.sum(F.expr(f"(size + {packet - 1}) div {packet}"))).first()[0] or 0
    parts = int(waiting * repeats // part_rows + 1)
    queue = stored(queued.repartitionByRange(parts, "finish", "rank", "upto").withColumn(PART, F.spark_partition_id()))

    # the budget ends in one partition, which alone is summed row by row
    line = Window.orderBy(PART)  # one row per partition
    ends = queue.groupBy(PART).agg(F.sum("words").alias("words")).withColumn("end", F.sum("words").over(line))
    last = ends.where(F.col("end") > budget).orderBy(PART).first()
    if last is not None:
        room = budget - (last["end"] - last["words"])
        whole = queue.where(F.col(PART) < last[PART])
        order = Window.orderBy("finish", "rank", "upto").rowsBetween(Window.unboundedPreceding, Window.currentRow)
        cut = queue.where(F.col(PART) == last[PART]).withColumn("_sum", F.sum("words").over(order))
        queue = stored(whole.unionByName(cut.where(F.col("_sum") <= room).drop("_sum")))
    taken = queue.groupBy("row").agg(F.sum("words").alias("taken"))
    documents = known.join(taken, "row", "left").select(
        "id", "size", "source_size", "target", F.coalesce("taken", F.lit(0)).cast("long").alias("taken"))
    return Mix(queue.select("id", "source", "turn", "words", "finish"), documents)

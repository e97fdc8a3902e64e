"""Resharding by minimum-cost flow: move the fewest bytes from old shards to new capacities."""

import heapq
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F, types as T

from ..plans.bounds import small_side
from .common import scratch_folder, stored


def min_cost_flow(supply: list[int], capacity: list[int], stay: list[int | None]) -> list[list[int]]:
    """Bytes to send from each old shard to each new one.

    Staying (``stay[i]`` is the new shard that old shard i becomes) costs nothing, moving
    costs 1 a byte. Successive shortest paths with potentials over source, old, new and
    sink; the graph has one node per shard, whatever the data size.
    """
    n, m = len(supply), len(capacity)
    if sum(capacity) < sum(supply):
        raise ValueError("capacities are smaller than the data")
    size, source, sink = n + m + 2, n + m, n + m + 1
    graph: list[list[list[int]]] = [[] for _ in range(size)]  # [to, room, cost, index of reverse]

    def edge(a, b, room, cost):
        graph[a].append([b, room, cost, len(graph[b])])
        graph[b].append([a, 0, -cost, len(graph[a]) - 1])

    for i, s in enumerate(supply):
        edge(source, i, s, 0)
        for j in range(m):
            edge(i, n + j, s, 0 if stay[i] == j else 1)
    for j, c in enumerate(capacity):
        edge(n + j, sink, c, 0)
    potential = [0] * size
    while True:
        cost, back, heap = [None] * size, [None] * size, [(0, source)]
        cost[source] = 0
        while heap:
            d, a = heapq.heappop(heap)
            if d > cost[a]:
                continue
            for k, (b, room, c, _) in enumerate(graph[a]):
                reach = d + c + potential[a] - potential[b]
                if room and (cost[b] is None or reach < cost[b]):
                    cost[b], back[b] = reach, (a, k)
                    heapq.heappush(heap, (reach, b))
        if cost[sink] is None:
            break
        potential = [p + (c if c is not None else 0) for p, c in zip(potential, cost)]
        path, at = [], sink
        while at != source:
            a, k = back[at]
            path.append((a, k))
            at = a
        sent = min(graph[a][k][1] for a, k in path)
        for a, k in path:
            graph[a][k][1] -= sent
            b, _, _, r = graph[a][k]
            graph[b][r][1] += sent
    flow = [[0] * m for _ in range(n)]
    for i in range(n):
        for b, room, _, _ in graph[i]:
            if n <= b < n + m:
                flow[i][b - n] = supply[i] - room
    return flow


def _target(position: Column, old: Column, cuts: list[list[tuple[int, int]]]) -> Column:
    """New shard of a byte position in an old shard: its flows, laid end to end."""
    chosen = F.lit(None).cast("int")
    for i, own in enumerate(cuts):
        inner = F.lit(own[-1][1] if own else 0)
        for end, j in reversed(own[:-1]):
            inner = F.when(position < end, F.lit(j)).otherwise(inner)
        chosen = F.when(old == i, inner).otherwise(chosen)
    return chosen


def transfer_cuts(supply: list[int], weights: list[float]) -> list[list[tuple[int, int]]]:
    """Per old shard its transfers as (end byte, new shard), what stays first."""
    total = sum(supply)
    # capacities in whole bytes that add up to the data
    ends = [round(total * sum(weights[:k + 1]) / sum(weights)) for k in range(len(weights))]
    capacity = [b - a for a, b in zip([0, *ends], ends)]
    flow = min_cost_flow(supply, capacity, [i if i < len(weights) else None for i in range(len(supply))])
    cuts = []
    for i, own in enumerate(flow):
        line, place = [], 0
        for j in sorted(range(len(weights)), key=lambda j: (j != i, j)):
            if own[j]:
                place += own[j]
                line.append((place, j))
        cuts.append(line)
    return cuts


def _rows(spark: SparkSession, folder: str, kinds: T.StructType, where: Column | None = None) -> DataFrame:
    """Rows of the block files with their file (``block``) and place in it (``at``).

    ``where`` is about ``_metadata.file_path`` alone, so that other files are not opened.
    """
    rows = spark.read.schema(kinds).parquet(folder)
    return (rows if where is None else rows.where(where)).select(
        "*", F.col("_metadata.file_path").alias("block"), F.col("_metadata.row_index").alias("at"))


def lay_out(docs: DataFrame, old_shard: Column, folder: str, id_col: str = "doc_id", text_col: str = "text",
            block_rows: int = 0) -> T.StructType:
    """Write a table as files of its present shards, ``folder/old=<shard>/``; returns the stored columns.

    Each task writes its rows where they are, one file (block) per shard; nothing is shuffled.
    ``block_rows`` ends a file after so many rows. Columns: ``id, text, size, old``.
    """
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"),
                       (F.coalesce(F.octet_length(text_col), F.lit(0)).cast("long") + 1).alias("size"), old_shard.cast("int").alias("old"))
    rows.write.partitionBy("old").option("maxRecordsPerFile", str(block_rows)).parquet(folder)
    return rows.schema


def reshard_files(spark: SparkSession, folder: str, kinds: T.StructType, n_old: int, weights: list[float],
                  new_folder: str) -> DataFrame:
    """Move blocks of laid out shards to new capacities; returns all rows from where they lie afterwards.

    The blocks of an old shard, in the order of their names, form a line of bytes, which the
    flows of that shard cut into transfers; what stays comes first. A block inside one transfer
    goes whole; only a block with a cut in it is divided, at the row whose middle passes the cut. Blocks that
    stay whole are not touched: their rows take slots by their place in the file. All others are
    rewritten below ``new_folder`` with their slots. Plans are made on sizes alone; texts are never shuffled as
    long as the moved blocks are few enough to be broadcast (counted), else those blocks' rows are joined.
    """
    file = F.col("_metadata.file_path")
    blocks = stored(_rows(spark, folder, kinds).groupBy("old", "block").agg(F.sum("size").alias("bytes"), F.count(F.lit(1)).alias("n")))
    supply = [0] * n_old
    for r in blocks.groupBy("old").agg(F.sum("bytes").alias("bytes")).collect():  # n_old rows
        supply[r["old"]] = r["bytes"]
    cuts = transfer_cuts(supply, weights)
    line = Window.partitionBy("old").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    placed = blocks.withColumn("offset", F.coalesce(F.sum("bytes").over(line), F.lit(0)))
    ends = stored(placed.withColumns({"shard": _target(F.col("offset"), F.col("old"), cuts),
                                      "last": _target(F.col("offset") + F.col("bytes") - 1, F.col("old"), cuts)}))
    whole = ends.where("shard = last").select("old", "block", F.lit(0).cast("long").alias("begin"), F.col("n").alias("end"), "n", "shard")
    # at most one block per cut
    cut = [(r["block"], r["offset"]) for r in ends.where("shard <> last").select("block", "offset").collect()]
    facts = F.broadcast(spark.createDataFrame(cut, "block string, offset long"))
    inside = _rows(spark, folder, kinds, file.isin([b for b, _ in cut])).select("old", "block", "at", "size").join(facts, "block")
    upto = F.coalesce(F.sum("size").over(Window.partitionBy("block").orderBy("at").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    middle = F.col("offset") + F.col("upto") + F.floor(F.col("size") / 2)
    parts = inside.withColumn("upto", upto).withColumn("shard", _target(middle, F.col("old"), cuts)).groupBy("old", "block", "shard").agg(
        F.min("at").alias("begin"), (F.max("at") + 1).alias("end"), F.count(F.lit(1)).alias("n"))
    stays = F.col("whole") & (F.col("shard") == F.col("old"))
    pieces = whole.withColumn("whole", F.lit(True)).unionByName(parts.withColumn("whole", F.lit(False))).withColumn("stays", stays)
    before = Window.partitionBy("shard").orderBy(F.desc("stays"), "old", "block", "begin").rowsBetween(Window.unboundedPreceding, -1)
    pieces = stored(pieces.withColumn("base", F.coalesce(F.sum("n").over(before), F.lit(0))))
    # the blocks that stay are the first of their shard, so one name per shard tells them apart
    first = [r["block"] for r in pieces.where("not stays").groupBy("old").agg(F.min("block").alias("block")).collect()]
    leaves = reduce(lambda x, y: x | y, [file.startswith(b.rsplit("/", 1)[0] + "/") & (file >= b) for b in first], F.lit(False))

    def numbered(where: Column, of: DataFrame) -> DataFrame:
        side = small_side(of.select("block", "begin", "end", "base", "shard"), of.count())
        own = _rows(spark, folder, kinds, where).join(side, "block").where("at >= begin and at < end")
        return own.select("id", "text", "size", "old", (F.col("base") + F.col("at") - F.col("begin")).alias("slot"), "shard")

    moved = numbered(leaves, pieces.where("not stays"))
    moved.write.partitionBy("shard").parquet(new_folder)
    return spark.read.schema(moved.schema).parquet(new_folder).unionByName(numbered(~leaves, pieces.where("stays")))


def reshard(docs: DataFrame, old_shard: Column, n_old: int, weights: list[float], id_col: str = "doc_id",
            text_col: str = "text", block_rows: int = 0, folder: str | None = None) -> DataFrame:
    """Lay a table out in its present shards, reshard the files and return the rows.

    ``old_shard`` numbers the present shards 0 to ``n_old - 1`` (never null); ``weights`` gives the
    relative capacity of each new shard. Shard i becomes shard i, so its bytes stay where
    capacity allows. A row weighs the UTF-8 bytes of its text plus 1 (null: 1). Shards differ from their
    capacity by less than the longest rows at the cuts. Result: the id and text columns, ``size,
    old_shard, shard, slot`` with slots gapless from 0 in each shard. An empty table gives an empty
    result; null ids and repeated rows keep a slot each; other columns are ignored.
    """
    folder = folder or scratch_folder(docs.sparkSession)
    kinds = lay_out(docs, old_shard, f"{folder}/before", id_col, text_col, block_rows)
    rows = reshard_files(docs.sparkSession, f"{folder}/before", kinds, n_old, weights, f"{folder}/moved")
    return rows.select(F.col("id").alias(id_col), F.col("text").alias(text_col), "size", F.col("old").alias("old_shard"),
                       F.col("shard").cast("int").alias("shard"), F.col("slot").cast("long").alias("slot"))


def transfers(resharded: DataFrame) -> DataFrame:
    """Bytes and rows per (old shard, new shard); rows with different numbers were moved."""
    return resharded.groupBy("old_shard", "shard").agg(F.sum("size").alias("bytes"), F.count(F.lit(1)).alias("rows"))

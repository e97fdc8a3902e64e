"""Chat formatting: keep maximal conversations, then render them in bounded segments."""

from pyspark.sql import DataFrame, Window, functions as F

from .common import only, stored


def numbered_turns(chats: DataFrame, block: int = 1000) -> DataFrame:
    """Append the gapless ``place`` (from 1) of each turn and the ``prefix`` hash up to it.

    A turn's hash covers place, role and text under two seeds; the prefix hash is the
    running XOR. Both are associative, so a conversation is worked on in blocks of turn
    numbers: places and hashes inside blocks, then offsets over blocks. Turns are ordered
    by (turn, role, text), null turns last; fully equal rows are repeated turns.
    """
    turns = chats.withColumn("block", F.coalesce(F.floor(F.col("turn") / block), F.lit(1 << 62)))
    order = [F.coalesce("turn", F.lit(1 << 62)), F.coalesce("role", F.lit("")), F.coalesce("text", F.lit("")),
             F.col("role").isNull(), F.col("text").isNull()]
    inside = turns.withColumn("local", F.row_number().over(Window.partitionBy("conv", "block").orderBy(*order)).cast("long"))
    sizes = turns.groupBy("conv", "block").agg(F.count(F.lit(1)).alias("n"))
    before = Window.partitionBy("conv").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    starts = sizes.select("conv", "block", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("start"))
    # null conversation numbers are one conversation of their own
    placed = stored(inside.join(starts, inside["conv"].eqNullSafe(starts["conv"]) & (inside["block"] == starts["block"]))
                    .select(inside["conv"], inside["block"], "turn", "role", "text",
                            (F.col("local") + F.col("start")).alias("place")))
    hashes = [F.xxhash64(F.lit(seed), "place", F.col("role").isNull(), "role", F.col("text").isNull(), "text")
              for seed in (11, 12)]
    hashed = placed.withColumn("h1", hashes[0]).withColumn("h2", hashes[1])
    blocks = hashed.groupBy("conv", "block").agg(F.bit_xor("h1").alias("b1"), F.bit_xor("h2").alias("b2"))
    offsets = blocks.select(F.col("conv").alias("oc"), F.col("block").alias("ob"), *[
        F.coalesce(F.bit_xor(b).over(before), F.lit(0)).alias(o) for b, o in (("b1", "o1"), ("b2", "o2"))])
    running = Window.partitionBy("conv", "block").orderBy("place")
    rolled = hashed.withColumn("x1", F.bit_xor("h1").over(running)).withColumn("x2", F.bit_xor("h2").over(running))
    return (rolled.join(offsets, rolled["conv"].eqNullSafe(offsets["oc"]) & (rolled["block"] == offsets["ob"]))
            .select("conv", "place", "turn", "role", "text", F.col("x1").bitwiseXOR(F.col("o1")).alias("p1"),
                    F.col("x2").bitwiseXOR(F.col("o2")).alias("p2")))


def maximal_conversations(turns: DataFrame) -> DataFrame:
    """``conv, n_turns, copies`` of conversations that are no proper prefix of another.

    Of equal conversations the smallest number stays, ``copies`` of them in all.
    """
    last = turns.groupBy("conv").agg(F.max_by(F.struct("place", "p1", "p2"), "place").alias("e"))
    ends = last.select("conv", F.col("e.place").alias("place"), F.col("e.p1").alias("p1"), F.col("e.p2").alias("p2"))
    whole = ends.groupBy("place", "p1", "p2").agg(F.min("conv").alias("conv"), F.count(F.lit(1)).alias("copies"))
    # a prefix that goes on: the same state reached by a turn that is not the last one
    at_end = ends.select(F.col("conv").alias("ec"), F.col("place").alias("ep"))
    goes_on = turns.select("conv", "place", "p1", "p2").join(
        at_end, F.col("conv").eqNullSafe(F.col("ec")) & (F.col("place") == F.col("ep")), "left_anti")
    longer = goes_on.select("place", "p1", "p2").distinct()
    return whole.join(longer, ["place", "p1", "p2"], "left_anti").select("conv", F.col("place").alias("n_turns"), "copies")


def render(turns: DataFrame, kept: DataFrame, segment_turns: int = 200) -> DataFrame:
    """``conv, n_turns, copies, segment, text``: at most ``segment_turns`` turns per row, in order."""
    said = F.concat(F.lit("<|im_start|>"), F.coalesce("role", F.lit("user")), F.lit("\n"),
                    F.coalesce("text", F.lit("")), F.lit("<|im_end|>\n"))
    kept = kept.select(F.col("conv").alias("kc"), "n_turns", "copies")
    lines = turns.join(kept, F.col("conv").eqNullSafe(F.col("kc"))).select(
        "conv", "n_turns", "copies", F.floor((F.col("place") - 1) / segment_turns).alias("segment"),
        F.struct("place", said.alias("line")).alias("x"))
    parts = lines.groupBy("conv", "n_turns", "copies", "segment").agg(F.sort_array(F.collect_list("x")).alias("x"))
    return parts.select("conv", "n_turns", "copies", "segment", F.concat_ws("", "x.line").alias("text"))


def chat_format(chats: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role",
                text_col: str = "text", segment_turns: int = 200) -> DataFrame:
    """Render maximal conversations: ``conv_id, n_turns, copies, segment, text``.

    Cumulative snapshots (conversations that another one continues) and repeated
    conversations are left out. A missing role is rendered as user, a missing text as
    empty, but both differ from present ones when comparing. Other columns are ignored;
    an empty table gives an empty result.
    """
    rows = only(chats, conv=conv_col, turn=turn_col, role=role_col, text=text_col)
    turns = stored(numbered_turns(rows))
    told = render(turns, maximal_conversations(turns), segment_turns)
    return told.withColumnRenamed("conv", conv_col)

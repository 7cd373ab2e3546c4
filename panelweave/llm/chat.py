"""Chat formatting: collapse cumulative snapshots, then render the turns."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

# Turn numbers per block of the running prefix hash.
BLOCK = 4096
OPEN, CLOSE, END = "<|start|>", "<|end|>\n", "<|conversation_end|>\n"


def prefix_hashes(turns: DataFrame) -> DataFrame:
    """(conv_id, turn, k, n, h, g): two 64-bit hashes of the first k of n turns,
    with the number of the last of them.

    A turn's hash covers its number, role and text; a prefix is the exclusive-or
    of its turns' hashes, so it rolls forward in one step per turn. Blocks of
    turn numbers are folded before the shuffle and rolled first, then turns
    inside a block, so a very long conversation spreads over its blocks.
    """
    what = [F.col("turn"), F.coalesce(F.col("role"), F.lit("")), F.coalesce(F.col("text"), F.lit(""))]
    rows = turns.select(
        "conv_id", "turn", F.floor(F.col("turn") / BLOCK).alias("block"),
        F.xxhash64(*what).alias("h"), F.xxhash64(F.lit("second"), *reversed(what)).alias("g")).distinct()
    blocks = rows.groupBy("conv_id", "block").agg(
        F.bit_xor("h").alias("bh"), F.bit_xor("g").alias("bg"), F.count(F.lit(1)).alias("bn"))
    conv = Window.partitionBy("conv_id")
    past = conv.orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    blocks = blocks.select(
        F.col("conv_id").alias("c"), F.col("block").alias("b"), F.sum("bn").over(conv).alias("n"),
        *[F.coalesce(f(c).over(past), F.lit(0)).alias(c) for f, c in
          ((F.bit_xor, "bh"), (F.bit_xor, "bg"), (F.sum, "bn"))])
    inside = Window.partitionBy("conv_id", "block").orderBy("turn", "h", "g")
    met = rows.join(blocks, F.col("conv_id").eqNullSafe(F.col("c")) & F.col("block").eqNullSafe(F.col("b")))
    return met.select(
        "conv_id", "turn", "n", (F.col("bn") + F.row_number().over(inside)).alias("k"),
        F.col("bh").bitwiseXOR(F.bit_xor("h").over(inside)).alias("h"),
        F.col("bg").bitwiseXOR(F.bit_xor("g").over(inside)).alias("g"))


def maximal(turns: DataFrame) -> DataFrame:
    """(conv_id, n_turns, top) of conversations that no longer one begins with,
    with their last turn; of equal conversations the smallest id stays. Equal prefixes are merged before
    the anti-join, so neither side has a hot key."""
    prefixes = prefix_hashes(turns)
    whole = (prefixes.where("k = n").groupBy("n", "h", "g")
             .agg(F.min(F.struct(F.col("conv_id").isNull(), "conv_id"))["conv_id"].alias("conv_id"), F.max("turn").alias("top")))
    longer = prefixes.where("k < n").select(F.col("k").alias("n"), "h", "g").distinct()
    return whole.join(longer, ["n", "h", "g"], "left_anti").select("conv_id", F.col("n").alias("n_turns"), "top")


def render(conversations: DataFrame, opening=OPEN, closing=CLOSE, ending=END) -> DataFrame:
    """The turns of maximal conversations in chat form, one row per turn.

    Concatenating ``rendered`` by ``turn`` gives a conversation's text; it stays
    in rows, so that no conversation has to fit one value or one task. Columns:
    conv_id, turn, n_turns, rendered.

    Rows repeated with the same id, turn, role and text count once; differing
    rows with the same turn all stay, ordered by role and text. A null turn is
    turn -1. A null role renders as ``none``, a null text as empty, and both
    compare as empty. Rows with a null id form one conversation. Conversations
    match only if their turns carry the same numbers. Other columns are ignored;
    an empty table gives an empty one.
    """
    turns = conversations.select(
        "conv_id", F.coalesce(F.col("turn").cast("long"), F.lit(-1).cast("long")).alias("turn"), "role", "text").distinct()
    keep = maximal(turns).withColumnRenamed("conv_id", "c")
    met = turns.join(keep, F.col("conv_id").eqNullSafe(F.col("c")))
    text = F.concat(
        F.lit(opening), F.coalesce(F.col("role"), F.lit("none")), F.lit("\n"), F.coalesce(F.col("text"), F.lit("")),
        F.lit(closing), F.when(F.col("turn") == F.col("top"), F.lit(ending)).otherwise(F.lit("")))
    return met.select("conv_id", "turn", "n_turns", text.alias("rendered"))

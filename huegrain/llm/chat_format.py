"""Chat formatting by collapse of cumulative snapshots, in DataFrame functions only.

A conversation is often logged again after each turn. Two running 64-bit hashes (the exclusive or of place-tagged turn
hashes, 128 bits together) name every prefix of every conversation; a conversation whose whole is a proper prefix of another one
is dropped by an anti-join, of identical ones the smallest id stays, and what is left is rendered.

Texts move once, to their conversation, which is written down with its turns in order; only hashes are windowed.

Defined cases: turns are ordered by turn, then role, then text (nulls first), when compared as when rendered; repeated turns are
turns of their own; null roles and texts differ from empty ones when compared and render as empty; a turn without an id belongs
to no conversation that is known and is one by itself; extra columns are ignored; an empty table gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import materialize


def conversations(turns: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text") -> DataFrame:
    """(row, conv_id, said): each conversation's (turn, role, text) in order."""
    told = turns.select(F.col(conv_col).alias("conv_id"), F.struct(F.col(turn_col).alias("turn"), F.col(role_col).alias("role"), F.col(text_col).alias("text")).alias("x"))
    whole = told.filter("conv_id is not null").groupBy("conv_id").agg(F.array_sort(F.collect_list("x")).alias("said"))  # one conversation's turns
    alone = told.filter("conv_id is null").select("conv_id", F.array("x").alias("said"))
    return whole.unionByName(alone).withColumn("row", F.monotonically_increasing_id())


def prefix_hashes(convs: DataFrame) -> DataFrame:
    """(row, conv_id, pos, proper, h1, h2): the hashes of each conversation's first pos turns; proper unless it is the whole."""
    told = lambda x: [x["role"].isNull(), F.coalesce(x["role"], F.lit("")), x["text"].isNull(), F.coalesce(x["text"], F.lit(""))]
    hashed = F.transform("said", lambda x: F.struct(F.xxhash64(*told(x)).alias("t1"), F.xxhash64(F.lit(0x51ED), *told(x)[::-1]).alias("t2")))
    turns = convs.select("row", "conv_id", F.size("said").alias("n"), F.posexplode(hashed).alias("at", "t")).select("row", "conv_id", (F.col("at") + 1).alias("pos"), (F.col("at") + 1 < F.col("n")).alias("proper"), "t.t1", "t.t2")
    upto = Window.partitionBy("row").orderBy("pos").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    return turns.select("row", "conv_id", "pos", "proper", F.bit_xor(F.xxhash64("pos", "t1", "t2")).over(upto).alias("h1"), F.bit_xor(F.xxhash64("t2", "t1", "pos")).over(upto).alias("h2"))


def maximal_conversations(convs: DataFrame) -> DataFrame:
    """(row, n_turns, n_copies) of the conversations that stay."""
    marked = prefix_hashes(convs)
    whole = marked.filter(~F.col("proper")).groupBy("pos", "h1", "h2").agg(F.min(F.struct(F.col("conv_id").isNull(), "conv_id", "row")).alias("first"), F.count("*").alias("n_copies"))
    prefixes = marked.filter("proper").select("pos", "h1", "h2").distinct()
    return whole.join(prefixes, ["pos", "h1", "h2"], "left_anti").select(F.col("first.row").alias("row"), F.col("pos").cast("long").alias("n_turns"), "n_copies")


def render_chats(turns: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text", before: str = "<|im_start|>", between: str = "\n", after: str = "<|im_end|>\n") -> DataFrame:
    """(conv_id, n_turns, n_copies, rendered): one row for each maximal conversation."""
    convs = materialize(conversations(turns, conv_col, turn_col, role_col, text_col), "conversations")
    line = lambda x: F.concat(F.lit(before), F.coalesce(x["role"], F.lit("")), F.lit(between), F.coalesce(x["text"], F.lit("")), F.lit(after))
    return convs.join(maximal_conversations(convs), "row").select("conv_id", "n_turns", "n_copies", F.array_join(F.transform("said", line), "").alias("rendered"))

"""Collapsing logged chat snapshots: conversations that are the beginning of a longer one go.

Logs of a chat often hold every state of it. Each turn is hashed with its number to 128 bits and
the hashes are rolled up turn by turn, so every beginning of a conversation has one hash. A
conversation whose whole hash is that of a proper beginning of another is left out by an anti-join;
of equal conversations the smallest identifier stays. The rest is rendered.

The rolling hash is an exclusive or of turn hashes, taken over blocks of turns first: a conversation
of any length is spread over tasks by block. Only rendering brings a conversation's turns together,
as it makes one text of them.

A turn is its number, role and text; repeated rows count once and several turns of one number stand
in the order of role and text. Null role or text is empty; a null number stands before all others.
Rows without conversation identifier belong to none and are left out. Empty tables give empty
results; other columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

BLOCK_TURNS = 1024
FIRST = -(1 << 31)


def turns(conversations: DataFrame, conv_id: str, turn: str, role: str, text: str) -> DataFrame:
    return conversations.where(F.col(conv_id).isNotNull()).select(
        F.col(conv_id).alias("conv_id"),
        F.coalesce(F.col(turn), F.lit(FIRST)).cast("bigint").alias("turn"),
        F.coalesce(F.col(role), F.lit("")).alias("role"),
        F.coalesce(F.col(text), F.lit("")).alias("text"),
    )


def prefix_hashes(rows: DataFrame) -> DataFrame:
    """conv_id, a, b, n_turns, ends: the hash of every beginning; ``ends`` marks the whole conversation."""
    hashed = rows.select(
        "conv_id", "turn",
        F.xxhash64(F.lit(1), "turn", F.length("role"), "role", "text").alias("a"),
        F.xxhash64(F.lit("second"), "text", "role", F.length("text"), "turn").alias("b"),
    ).distinct()
    per_turn = hashed.groupBy("conv_id", "turn", F.floor(F.col("turn") / BLOCK_TURNS).alias("block")).agg(
        F.bit_xor("a").alias("a"), F.bit_xor("b").alias("b"), F.count(F.lit(1)).alias("n")
    )
    blocks = per_turn.groupBy("conv_id", "block").agg(
        F.bit_xor("a").alias("a"), F.bit_xor("b").alias("b"), F.sum("n").alias("n")
    )
    by_block = Window.partitionBy("conv_id").orderBy("block")
    before = by_block.rowsBetween(Window.unboundedPreceding, -1)
    blocks = blocks.select(
        "conv_id", "block",
        F.coalesce(F.expr("bit_xor(a)").over(before), F.lit(0)).alias("a0"),
        F.coalesce(F.expr("bit_xor(b)").over(before), F.lit(0)).alias("b0"),
        F.coalesce(F.sum("n").over(before), F.lit(0)).alias("n0"),
        F.lead("block").over(by_block).isNull().alias("last_block"),
    )
    inside = Window.partitionBy("conv_id", "block").orderBy("turn")
    so_far = inside.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    return per_turn.join(blocks, ["conv_id", "block"]).select(
        "conv_id",
        F.expr("bit_xor(a)").over(so_far).bitwiseXOR(F.col("a0")).alias("a"),
        F.expr("bit_xor(b)").over(so_far).bitwiseXOR(F.col("b0")).alias("b"),
        (F.sum("n").over(so_far) + F.col("n0")).alias("n_turns"),
        (F.col("last_block") & F.lead("turn").over(inside).isNull()).alias("ends"),
    )


def maximal_conversations(
    conversations: DataFrame, conv_id: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text"
) -> DataFrame:
    """conv_id, n_turns, copies of the conversations that no longer one begins with."""
    prefixes = prefix_hashes(turns(conversations, conv_id, turn, role, text))
    whole = prefixes.where("ends").groupBy("a", "b").agg(
        F.min("conv_id").alias("conv_id"), F.max("n_turns").alias("n_turns"), F.count(F.lit(1)).alias("copies")
    )
    proper = prefixes.where("NOT ends").select("a", "b").distinct()
    return whole.join(proper, ["a", "b"], "left_anti").select("conv_id", "n_turns", "copies")


def rendered(
    conversations: DataFrame, conv_id: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text"
) -> DataFrame:
    """conv_id, n_turns, copies, chat: maximal conversations as one text each."""
    kept = maximal_conversations(conversations, conv_id, turn, role, text)
    told = (
        turns(conversations, conv_id, turn, role, text)
        .join(kept, "conv_id")
        .groupBy("conv_id", "n_turns", "copies")
        .agg(F.sort_array(F.collect_set(F.struct("turn", "role", "text"))).alias("turns"))
    )
    line = F.transform("turns", lambda t: F.concat(F.lit("<|"), t["role"], F.lit("|>\n"), t["text"], F.lit("\n")))
    return told.select("conv_id", "n_turns", "copies", F.array_join(line, "").alias("chat"))

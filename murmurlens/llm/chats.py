"""Chat formatting: keep maximal conversations, then render them.

Logged chats are often saved after every turn, so that one conversation is there many times, each
a prefix of the next. Rolling hashes over the turns name every prefix; an anti-join on (turns,
hash) drops each conversation that is a proper prefix of another, and of equal ones all but the
smallest id. What is left is rendered, a block per turn.

Only hashes and counts are compared and moved; texts are gathered for conversations that stay.
The hash of a prefix is the exclusive-or of two 64-bit hashes of its (position, role, text) rows, which
can't overflow, doesn't depend on task order and combines.

Defined results: a null role counts as ``user``, a null text as empty; turns are taken in order of
(turn, role, text), null turns first, and exactly repeated rows once; each row without a conversation
id is a conversation of its own, so that no number of them is gathered; an empty table gives no rows;
extra columns are not read.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

CONV = ["nameless", "conv"]


def clean_turns(chats: DataFrame) -> DataFrame:
    """``(nameless, conv, turn, role, text)``: ``conv`` is the id, or a hash of the row where that is null."""
    known = chats.select(
        F.col("conv_id").cast("long"), F.col("turn").cast("long"),
        F.coalesce("role", F.lit("user")).alias("role"), F.coalesce("text", F.lit("")).alias("text"),
    )
    conv = F.coalesce("conv_id", F.xxhash64("turn", "role", "text"))
    return known.select(F.col("conv_id").isNull().alias("nameless"), conv.alias("conv"), "turn", "role", "text").distinct()


def prefix_hashes(turns: DataFrame) -> DataFrame:
    """``(nameless, conv, n, h1, h2)``: each conversation's first ``n`` turns."""
    order = W.partitionBy(*CONV).orderBy(F.col("turn").asc_nulls_first(), "role", "text")
    so_far = order.rowsBetween(W.unboundedPreceding, 0)
    numbered = turns.withColumn("n", F.row_number().over(order))
    bits = lambda seed: F.xxhash64(F.lit(seed), "n", "role", "text")
    return numbered.select(*CONV, "n", *[F.bit_xor(bits(seed)).over(so_far).alias(name) for seed, name in ((11, "h1"), (23, "h2"))])


def maximal_conversations(prefixes: DataFrame) -> DataFrame:
    """``(nameless, conv, turns)`` of those that are no proper prefix of another; of equal ones the first."""
    marked = prefixes.join(prefixes.groupBy(*CONV).agg(F.max("n").alias("turns")), CONV)
    ends = marked.filter("n = turns").groupBy("n", "h1", "h2").agg(F.min(F.struct(*CONV)).alias("first"))
    longer = marked.filter("n < turns").select("n", "h1", "h2").distinct()
    return ends.join(longer, ["n", "h1", "h2"], "left_anti").select("first.*", F.col("n").cast("long").alias("turns"))


def render(turns: DataFrame, kept: DataFrame, start: str = "<|im_start|>", end: str = "<|im_end|>") -> DataFrame:
    """``(conv_id, turns, rendered)``. Markers inside a text are broken by a zero-width joiner."""
    safe = F.replace(F.replace("text", F.lit(start), F.lit(start[:1] + "‍" + start[1:])), F.lit(end), F.lit(end[:1] + "‍" + end[1:]))
    block = F.concat(F.lit(start), F.col("role"), F.lit("\n"), safe, F.lit(end), F.lit("\n"))
    order = W.partitionBy(*CONV).orderBy(F.col("turn").asc_nulls_first(), "role", "text")
    numbered = turns.join(kept, CONV).select(*CONV, "turns", F.row_number().over(order).alias("n"), block.alias("block"))
    whole = numbered.groupBy(*CONV, "turns").agg(
        F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("n", "block"))), lambda x: x.block), "").alias("rendered")
    )
    return whole.select(F.when(~F.col("nameless"), F.col("conv")).alias("conv_id"), "turns", "rendered")


def format_chats(chats: DataFrame) -> DataFrame:
    turns = clean_turns(chats)
    return render(turns, maximal_conversations(prefix_hashes(turns)))

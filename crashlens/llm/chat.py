"""Chat formatting: collapse cumulative snapshots, then render what is left.

A chat that is logged after every turn leaves many conversations that are the beginning of a longer one. Each turn gets the
rolling hash of all turns up to it; a conversation whose last hash is the hash of a shorter prefix elsewhere is a snapshot
and goes by an anti-join, and of equal conversations the one of smallest id stays.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def prefixes(turns: DataFrame) -> DataFrame:
    """For each turn its place k in the conversation, the number n of turns there, and the hash of turns 1 to k.

    The hash is the running sum of the turns' hashes, each taken with its place: two sums of 64-bit hashes, as decimals, that
    a window adds up row by row without holding a conversation.
    """
    whole = Window.partitionBy("conv_id")
    order = whole.orderBy(F.col("turn").asc_nulls_last(), F.col("role").asc_nulls_first(), F.col("text").asc_nulls_first())
    rolling = order.rowsBetween(Window.unboundedPreceding, Window.currentRow)

    def summed(salt: str) -> Column:
        told = [F.lit(salt), F.col("k"), F.coalesce("role", F.lit("")), F.coalesce("text", F.lit(""))]
        return F.sum(F.xxhash64(*told).cast("decimal(20,0)")).over(rolling)

    placed = turns.withColumn("k", F.row_number().over(order).cast("long"))
    return placed.select("conv_id", "k", "role", "text", F.count(F.lit(1)).over(whole).alias("n"), summed("a").alias("a"), summed("b").alias("b"))


def collapse(turns: DataFrame) -> DataFrame:
    """Ids of the maximal conversations, with their turns and the number of equal ones: conv_id, n_turns, copies."""
    rolled = prefixes(turns)
    whole = rolled.where("k = n").groupBy("a", "b", "n").agg(F.min("conv_id").alias("conv_id"), F.count(F.lit(1)).alias("copies"))
    # Both sides hold a hash once, so a first turn or conversation that many share is one row here.
    shorter = rolled.where("k < n").select("a", "b", F.col("k").alias("n")).distinct()
    return whole.join(shorter, ["a", "b", "n"], "left_anti").select("conv_id", F.col("n").alias("n_turns"), "copies")


def render(turns: DataFrame, start: str = "<|", after_role: str = "|>\n", end: str = "<|end|>\n", keep: Sequence[str] = ()) -> DataFrame:
    """One text for each conversation, its turns in order: conv_id, the columns ``keep`` (the same for all its turns), text."""
    places = Window.partitionBy("conv_id").orderBy(
        F.col("turn").asc_nulls_last(), F.col("role").asc_nulls_first(), F.col("text").asc_nulls_first()
    )
    turn = F.concat(
        F.lit(start), F.coalesce("role", F.lit("")), F.lit(after_role), F.coalesce("text", F.lit("")), F.lit(end)
    )
    return (
        turns.select("conv_id", *keep, F.row_number().over(places).alias("k"), turn.alias("turn"))
        .groupBy("conv_id", *keep)
        .agg(F.array_sort(F.collect_list(F.struct("k", "turn"))).alias("turns"))
        .select("conv_id", *keep, F.array_join(F.transform("turns", lambda t: t["turn"]), "").alias("text"))
    )


def format_chats(conversations: DataFrame) -> DataFrame:
    """Maximal conversations as texts: conv_id, n_turns, copies, text.

    Turns go by number, those without one last; turns of equal number by role and text. A null role or text counts as
    empty. A null conv_id is an id like any other. A repeated row is a turn of its own. Of equal conversations the smallest
    id stays, a null id only if no other is equal. An empty table gives no rows; other columns are not read.
    """
    turns = conversations.select("conv_id", "turn", "role", "text")
    kept = collapse(turns).withColumnRenamed("conv_id", "kept")
    # Snapshots go before their texts are sorted and put together.
    own = turns.join(kept, F.col("kept").eqNullSafe(F.col("conv_id"))).drop("kept")
    return render(own, keep=("n_turns", "copies"))

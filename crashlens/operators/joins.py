"""Equi-joins on shared column names; key columns appear once in the result.

The physical join is Spark's choice from the sizes it knows; only top-k lists, which their k bounds, are
broadcast by hint. Against hot keys:

* the side that is only looked up is made distinct, or counted, per key first, with map-side aggregation, so its
  copies of a hot key fold before the exchange and no pairs of copies arise;
* the other side keeps its rows, and adaptive execution may split the partition its hot key lands in. Spark does that
  only where both inputs of the join come straight from an exchange, see ``_look_up``.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from crashlens.operators.ranking import top_values

# Largest top-k list that is broadcast by hint.
BROADCAST_ROWS = 10_000


def join_on(left: DataFrame, right: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Inner join; repeated keys on both sides give every combination, NULL keys give none."""
    return left.join(right, list(keys), "inner")


def _look_up(rows: DataFrame, per_key: DataFrame, keys: Sequence[str], how: str) -> DataFrame:
    """Join rows to a table that is unique per key.

    Such a table is the output of an aggregation already partitioned by the key, and Spark would join it in place,
    which rules out splitting a hot key of ``rows``. Joining on one more column derived from the key gives the
    small aggregated side an exchange of its own and so allows the split.
    """
    part = F.hash(*keys).bitwiseAND(1)
    joined = rows.withColumn("_part", part).join(per_key.withColumn("_part", part), [*keys, "_part"], how)
    return joined.drop("_part")


def join_per_key(rows: DataFrame, per_key: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Rows with the columns of their key's only row in ``per_key``; rows without one drop out."""
    return _look_up(rows, per_key, keys, "inner")


def semi(left: DataFrame, right: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Rows of ``left`` that have a partner, each once."""
    return _look_up(left, right.select(*keys).distinct(), keys, "left_semi")


def anti(left: DataFrame, right: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Rows of ``left`` that have no partner; a row with a NULL key has none and stays."""
    return _look_up(left, right.select(*keys).distinct(), keys, "left_anti")


def common_keys(left: DataFrame, right: DataFrame, keys: Sequence[str]) -> DataFrame:
    """The keys that occur in both tables, each once. Both key sets meet in the exchange that made them distinct."""
    return left.select(*keys).distinct().join(right.select(*keys).distinct(), list(keys), "left_semi")


def restrict_to_top(
    df: DataFrame,
    source: DataFrame,
    column: str,
    k: int,
    eligible: Column | None = None,
    rows: str | None = None,
) -> DataFrame:
    """Rows of ``df`` whose ``column`` is among the ``k`` most frequent values in ``source`` (see ``top_values``).

    A NULL can take a place in the list but matches no row. The list holds at most k values, each once. The
    optimizer would move a semi-join, or the NULL test that goes with a plain equality, below a distinct that
    ``df`` ends in; a null-safe inner join stays where it is, so that ``df`` and ``source`` can share those rows.
    """
    members = top_values(source, column, k, eligible, rows).select(F.col(column).alias("_member")).na.drop()
    if k <= BROADCAST_ROWS:
        members = F.broadcast(members)
    return df.join(members, F.col(column).eqNullSafe(F.col("_member")), "inner").drop("_member")


def count_pairs(
    left: DataFrame,
    right: DataFrame,
    keys: Sequence[str],
    by: Sequence[str] = (),
    count: str = "count",
    within: DataFrame | None = None,
) -> DataFrame:
    """Rows of the inner join of both sides counted per ``by``, without building the joined rows.

    A side that brings no ``by`` column is counted per key; each row of the other side then stands for that many
    pairs. If both sides bring some, both are counted per key and their own columns. Either way a key that
    holds a large part of both tables never costs the product of its rows. ``within`` restricts the keys to those
    of a third table. Without ``by`` the result is one row, 0 if nothing joins.
    """

    def own(side: DataFrame) -> list[str]:
        return [column for column in by if column in side.columns and column not in keys]

    def counted(side: DataFrame, rows: str) -> DataFrame:
        return side.groupBy(*keys, *own(side)).agg(F.count(F.lit(1)).alias(rows))

    many, one = (right, left) if own(right) and not own(left) else (left, right)
    per_key = counted(one, "_one")
    if within is not None:
        per_key = per_key.join(within.select(*keys).distinct(), list(keys), "left_semi")
    if own(one):
        pairs = join_on(counted(many, "_many"), per_key, keys)
        total = F.sum(F.col("_many") * F.col("_one"))
    else:
        pairs = join_per_key(many.select(*keys, *own(many)), per_key, keys)
        total = F.sum("_one")
    if not by:
        return pairs.agg(F.coalesce(total, F.lit(0).cast("bigint")).alias(count))
    return pairs.groupBy(*by).agg(total.alias(count))

"""Joins on keys of which some may hold any share of the rows."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from helixspark.session import cut

#: A key is hot with over one in so many of all rows, and so many rows at least; hence there are fewer hot keys than HOT.
HOT, LEAST_ROWS = 2000, 200


def hot_keys(counts: DataFrame, keys: Sequence[str], n: str = "k") -> DataFrame:
    """The hot keys, fewer than HOT, from one row a key with its number of rows ``n``."""
    total = counts.agg(F.sum(n)).first()[0] or 0
    return cut(counts.where((F.col(n) * HOT > total) & (F.col(n) >= LEAST_ROWS)).select(*keys))


def join_hot(rows: DataFrame, other: DataFrame, keys: Sequence[str], how: str = "inner", heavy: DataFrame | None = None) -> DataFrame:
    """``rows`` joined (inner or left) with ``other``, which has one row a key. Keys aren't null.

    The rows of hot keys stay where they are and meet a broadcast of fewer than HOT rows of ``other``;
    all others are shuffled. ``heavy``: the hot keys, if known.
    """
    keys = list(keys)
    if heavy is None:
        heavy = hot_keys(rows.groupBy(*keys).agg(F.count(F.lit(1)).alias("k")), keys)
    if heavy.isEmpty():
        return rows.join(other, keys, how)
    few = heavy.join(other.withColumn("_there", F.lit(True)), keys, "left").withColumn("_hot", F.lit(True))
    met = rows.join(F.broadcast(cut(few)), keys, "left")
    hot = met.where("_hot" if how == "left" else "_there").drop("_hot", "_there")
    rest = met.where("_hot is null").select(*rows.columns).join(other, keys, how)
    return hot.unionByName(rest)

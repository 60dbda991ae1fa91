"""Connected components of an edge table: in one task for a bounded table, else by alternating large-star and small-star steps.

The rounds of steps make dozens of jobs, whose plans, tasks and threads fill the driver, and a bounded table
needs none of them. In them, every step is an aggregation, cut in the shared folder, and a join of two cut tables, so that Spark can split
the rows of a hub over tasks. The edges are cut each round, whose shuffle files then go, and nothing but a
count and a checksum reaches the driver.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from helixspark.session import cut, release, ship

#: Up to so many edges (16 MB) are decided in one task.
ONE_TASK = 1_000_000


def _least(edges: DataFrame) -> DataFrame:
    """a, m: of each node with smaller neighbours the smallest one."""
    return cut(edges.groupBy("a").agg(F.min("b").alias("m")))


def _large_star(edges: DataFrame) -> DataFrame:
    """Links the greater end of each edge to the smallest neighbour of the smaller end, or to that end."""
    low = _least(edges).select(F.col("a").alias("b"), "m")
    return edges.join(low, "b", "left").select("a", F.coalesce("m", "b").alias("b")).distinct()


def _small_star(edges: DataFrame) -> DataFrame:
    """Links each node and its smaller neighbours to the smallest of them."""
    low = _least(edges)
    linked = edges.join(low, "a").select(F.col("b").alias("a"), F.col("m").alias("b"))
    return linked.unionByName(low.select("a", F.col("m").alias("b"))).where("a <> b").distinct()


def least_reachable(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The nodes of the edges a, b, and the smallest node that each reaches."""
    ids, at = np.unique(np.concatenate([a, b]), return_inverse=True)
    x, y, root = at[: len(a)], at[len(a) :], np.arange(len(ids))
    while True:
        low, high = np.minimum(root[x], root[y]), np.maximum(root[x], root[y])
        open_ = low < high
        if not open_.any():
            return ids, ids[root]
        x, y = x[open_], y[open_]
        np.minimum.at(root, high[open_], low[open_])
        while (root[root] != root).any():
            root = root[root]


def _in_one_task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    ends = [(b.column(0).to_numpy(), b.column(1).to_numpy()) for b in batches if len(b)]
    if ends:
        ids, least = least_reachable(*(np.concatenate(x) for x in zip(*ends, strict=True)))
        yield pa.RecordBatch.from_arrays([pa.array(ids), pa.array(least)], ["id", "component"])


def connected_components(edges: DataFrame) -> DataFrame:
    """id and component (its smallest id) of every node of ``edges`` (long columns a, b)."""
    edges = cut(edges.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct())
    if edges.count() <= ONE_TASK:
        ship(edges.sparkSession)
        return edges.coalesce(1).mapInArrow(_in_one_task, "id long, component long")
    sums, before = (F.count(F.lit(1)), F.bit_xor(F.xxhash64("a", "b"))), None
    while True:
        now = tuple(edges.agg(*sums).first())
        if now == before or not now[0]:
            break
        before = now
        edges = cut(_small_star(cut(_large_star(edges))))
        release(edges.sparkSession)
    return edges.select(F.col("a").alias("id"), F.col("b").alias("component")).unionByName(edges.select(F.col("b").alias("id"), F.col("b").alias("component")).distinct())

"""Running sums, ranks and last-known values over a global order, without a single-partition window.

Rows fall into blocks of the order, and blocks into groups. Blocks and groups are summed up, the few group
totals (one for 2 ** 32 places) are accumulated, and windows run inside groups and blocks only.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from helixspark.session import cut

BLOCK_BITS = 16


def running_sum(df: DataFrame, order: str, value: Column, name: str, bits: int = BLOCK_BITS) -> DataFrame:
    """``df`` with the sum of ``value`` over all rows before (not at) each, by the long column ``order``."""
    rows = df.withColumn("_block", F.shiftright(order, bits)).withColumn("_value", value)
    totals = rows.groupBy("_block").agg(F.sum("_value").alias("_total")).withColumn("_far", F.shiftright("_block", bits))
    groups = totals.groupBy("_far").agg(F.sum("_total").alias("_all"))
    groups = groups.select("_far", (F.sum("_all").over(W.orderBy("_far")) - F.col("_all")).alias("_earlier"))
    near = F.sum("_total").over(W.partitionBy("_far").orderBy("_block")) - F.col("_total")
    before = totals.withColumn("_near", near).join(groups, "_far").select("_block", (F.col("_earlier") + F.col("_near")).alias("_before"))
    inside = F.sum("_value").over(W.partitionBy("_block").orderBy(order).rowsBetween(W.unboundedPreceding, 0)) - F.col("_value")
    return rows.join(before, "_block").withColumn(name, (F.col("_before") + inside).cast("long")).drop("_block", "_value", "_before")


def global_rank(df: DataFrame, keys: list[str], name: str) -> DataFrame:
    """``df`` with the 0-based rank of each row by ``keys``; ties share the least rank.

    Rows are range-partitioned by the keys, so equal keys meet, and each partition counts on from those before it.
    """
    placed = cut(df.repartitionByRange(*keys).withColumn("_part", F.spark_partition_id()))
    counts = placed.groupBy("_part").agg(F.count(F.lit(1)).alias("_n"))
    before = counts.select("_part", (F.sum("_n").over(W.orderBy("_part")) - F.col("_n")).alias("_before"))
    own = F.rank().over(W.partitionBy("_part").orderBy(*keys)) - 1
    return placed.withColumn("_own", own).join(before, "_part").withColumn(name, (F.col("_own") + F.col("_before")).cast("long")).drop("_part", "_own", "_before")


def as_of(points: DataFrame, point: str, marks: DataFrame, mark: str, bits: int = BLOCK_BITS) -> DataFrame:
    """``points`` with the columns of the last row of ``marks`` at or before each point; null where there is none."""
    payload = F.struct(*[F.col(c) for c in marks.columns])
    some = marks.select(F.col(mark).alias("_at"), payload.alias("_mark"), F.lit(None).cast(points.schema).alias("_point"))
    both = points.select(F.col(point).alias("_at"), F.lit(None).cast(some.schema["_mark"].dataType).alias("_mark"), F.struct(*[F.col(c) for c in points.columns]).alias("_point")).unionByName(some)
    both = both.withColumn("_block", F.shiftright("_at", bits)).withColumn("_is_point", F.col("_point").isNotNull())
    ends = marks.groupBy(F.shiftright(mark, bits).alias("_block")).agg(F.max_by(payload, F.col(mark)).alias("_end"))
    blocks = both.select("_block").distinct().join(ends, "_block", "left").withColumn("_far", F.shiftright("_block", bits))
    groups = blocks.groupBy("_far").agg(F.max_by("_end", F.when(F.col("_end").isNotNull(), F.col("_block"))).alias("_last"))
    earlier = lambda order: order.rowsBetween(W.unboundedPreceding, -1)
    groups = groups.select("_far", F.last("_last", True).over(earlier(W.orderBy("_far"))).alias("_earlier"))
    blocks = blocks.withColumn("_near", F.last("_end", True).over(earlier(W.partitionBy("_far").orderBy("_block")))).join(groups, "_far")
    carried = blocks.select("_block", F.coalesce("_near", "_earlier").alias("_carried"))
    known = F.last("_mark", True).over(W.partitionBy("_block").orderBy("_at", "_is_point").rowsBetween(W.unboundedPreceding, 0))
    found = both.withColumn("_known", known).where("_is_point").join(carried, "_block").withColumn("_mark", F.coalesce("_known", "_carried"))
    return found.select("_point.*", "_mark.*")

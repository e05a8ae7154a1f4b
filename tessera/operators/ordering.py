"""Global order without a global task: row numbers and running maxima over range partitions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.runtime import materialize

_LOCAL = (1 << 33) - 1  # the low bits of Spark's increasing ids count within a partition


def ranged(rows: DataFrame, *order: Column | str) -> DataFrame:
    """Rows in ranges of the order, written once, with ``_part`` and ``_at`` (from 0 in each part).

    Parts follow the order, and rows follow it within a part. The order must be total for
    repeatable numbers.
    """
    dealt = rows.repartitionByRange(*order).sortWithinPartitions(*order)
    placed = dealt.withColumn("_part", F.spark_partition_id()).withColumn("_at", F.monotonically_increasing_id().bitwiseAND(_LOCAL))
    return materialize(placed, "ranged")


def numbered(rows: DataFrame, name: str, *order: Column | str) -> DataFrame:
    """Adds ``name``: positions from 0 in the order. Only one row per part goes through one task."""
    parts = ranged(rows, *order)
    before = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = parts.groupBy("_part").count().select("_part", F.coalesce(F.sum("count").over(before), F.lit(0)).alias("_from"))
    return parts.join(offsets, "_part").withColumn(name, F.col("_from") + F.col("_at")).drop("_part", "_at", "_from")


def max_before(rows: DataFrame, name: str, value: Column, *order: Column | str) -> DataFrame:
    """Adds ``name``: the greatest value of all earlier rows, null for the first."""
    parts = ranged(rows.withColumn("_value", value), *order)
    inside = Window.partitionBy("_part").orderBy("_at").rowsBetween(Window.unboundedPreceding, -1)
    before = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    carried = parts.groupBy("_part").agg(F.max("_value").alias("m")).select("_part", F.max("m").over(before).alias("_carried"))
    joined = parts.withColumn("_inside", F.max("_value").over(inside)).join(carried, "_part")
    return joined.withColumn(name, F.greatest("_inside", "_carried")).drop("_part", "_at", "_value", "_inside", "_carried")

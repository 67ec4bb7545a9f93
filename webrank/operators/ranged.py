"""Running counts and positions inside groups of any size, computed over range partitions instead of whole groups."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from webrank.plans.session import materialize


def running_counts(df: DataFrame, group: list[str], order: list[str], weight: str, out: str) -> DataFrame:
    """Adds ``out``: the sum of ``weight`` over earlier rows of the same ``group`` by ``order``, the row itself left out.

    The rows are range-partitioned by group and order, so a large group lies in many tasks; the totals of the partitions,
    one row per group and partition, give each partition its offset. ``order`` must be unique within a group.
    """
    part = materialize(df.repartitionByRange(*group, *order).withColumn("__part", F.spark_partition_id()))
    totals = part.groupBy(*group, "__part").agg(F.sum(weight).alias("__total"))
    before = Window.partitionBy(*group).orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = totals.withColumn("__offset", F.coalesce(F.sum("__total").over(before), F.lit(0))).drop("__total")
    own = Window.partitionBy(*group, "__part").orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    here = part.withColumn("__own", F.coalesce(F.sum(weight).over(own), F.lit(0)))
    return here.join(offsets, [*group, "__part"]).withColumn(out, F.col("__own") + F.col("__offset")).drop("__part", "__own", "__offset")

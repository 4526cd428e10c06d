"""Positions in a global order without bringing all rows to one task."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from skein.plans.scratch import materialize


def with_position(df: DataFrame, keys: list[str], name: str = "position") -> DataFrame:
    """Add each row's place (from 0) in the order of ``keys``, which must be unique.

    Rows are dealt into key ranges and ranked inside each; one row for each
    range, with the rows before it, goes to a single task and back.
    """
    ranged = df.repartitionByRange(*keys).withColumn("_range", F.spark_partition_id())
    held = materialize(ranged, "ranges")
    so_far = F.sum("count").over(W.orderBy("_range").rowsBetween(W.unboundedPreceding, -1))
    before = held.groupBy("_range").count().select("_range", F.coalesce(so_far, F.lit(0)).alias("_before"))
    own = F.row_number().over(W.partitionBy("_range").orderBy(*keys))
    return held.withColumn("_own", own).join(F.broadcast(before), "_range").withColumn(name, (F.col("_own") - 1 + F.col("_before")).cast("long")).drop("_range", "_own", "_before")

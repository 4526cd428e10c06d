"""Dealing rows into as many partitions as the input is large, so that a task's memory doesn't grow with it."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame

#: Bytes of input files, and rows where they are known, for each partition.
PART_BYTES, PART_ROWS = 8 << 20, 500_000


def input_bytes(df: DataFrame) -> int:
    """Bytes of the files that ``df`` is read from; 0 if it comes from none."""
    jvm, conf = df.sparkSession.sparkContext._jvm, df.sparkSession.sparkContext._jsc.hadoopConfiguration()
    paths = [jvm.org.apache.hadoop.fs.Path(jvm.java.net.URI(f)) for f in df.inputFiles()]
    return sum(p.getFileSystem(conf).getFileStatus(p).getLen() for p in paths)


def deal(df: DataFrame, *keys: str, rows: int | None = None) -> DataFrame:
    """``df`` by its keys in a partition for each PART_BYTES of its files, or PART_ROWS of its ``rows``.

    The adaptive planner merges partitions up to a size as they were shuffled, compressed, of which hash maps
    and sorts hold a multiple; a count of partitions that is given stays.  Input that is small for
    the cores is left to the planner.  Keys must be spread: no partition is split.
    """
    parts = math.ceil(input_bytes(df) / PART_BYTES if rows is None else rows / PART_ROWS)
    return df if parts <= df.sparkSession.sparkContext.defaultParallelism else df.repartition(parts, *keys)

"""Cutting lineage through tables in the folder that all executors share.

A written table survives the loss of any executor and is computed once, unlike
``checkpoint()`` (which runs the plan twice) or a block that only one executor
holds.  Tables live in ``spark.checkpoint.dir``; where that is unset (local
tests) one temporary folder per process is made and removed at exit.
"""

from __future__ import annotations

import atexit
import gc
import shutil
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_LOCAL_ROOT: str | None = None
_SESSION_DIRS: list[tuple[SparkSession, str]] = []


def shared_root(spark: SparkSession) -> str:
    """Folder that the driver and every executor can read and write."""
    global _LOCAL_ROOT
    root = spark.conf.get("spark.checkpoint.dir", None)
    if root:
        return root.rstrip("/")
    if spark.sparkContext.master.startswith("local"):
        if _LOCAL_ROOT is None:
            _LOCAL_ROOT = tempfile.mkdtemp(prefix="skein-scratch-")
            atexit.register(shutil.rmtree, _LOCAL_ROOT, ignore_errors=True)
        return "file://" + _LOCAL_ROOT
    raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")


def new_path(spark: SparkSession, label: str) -> str:
    """A path nobody has used, under the shared folder."""
    path = f"{shared_root(spark)}/skein-{uuid.uuid4().hex}/{label}"
    _SESSION_DIRS.append((spark, path.rsplit("/", 1)[0]))
    return path


def write_table(df: DataFrame, label: str) -> tuple[DataFrame, str]:
    """Write ``df`` once; return the reread table and its path."""
    spark = df.sparkSession
    path = new_path(spark, label)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path), path


def materialize(df: DataFrame, label: str) -> DataFrame:
    """Write ``df`` once and read it back: a lineage cut that outlives executors."""
    return write_table(df, label)[0]


def delete_path(spark: SparkSession, path: str) -> None:
    """Remove a scratch table through Hadoop's file system, whatever the scheme."""
    jvm = spark.sparkContext._jvm
    target = jvm.org.apache.hadoop.fs.Path(path.rsplit("/", 1)[0])
    target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(target, True)


def drop_spent_shuffles(spark: SparkSession) -> None:
    """Let Spark remove shuffle files that no plan refers to; it does so only when the driver collects its garbage."""
    gc.collect()
    spark.sparkContext._jvm.System.gc()


def clear(spark: SparkSession) -> None:
    """Remove every scratch table of this session; results that still read them are lost."""
    for owner, folder in [x for x in _SESSION_DIRS if x[0] is spark]:
        delete_path(owner, folder + "/x")
        _SESSION_DIRS.remove((owner, folder))

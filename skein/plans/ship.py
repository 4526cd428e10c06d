"""Giving Python workers this package, wherever they run."""

from __future__ import annotations

import atexit
import os
import shutil
import tempfile
import zipfile
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

#: Arrow bytes that a function gets at once, unless one row alone has more; the Python objects made of them take several times that.
BATCH_BYTES = 4_000_000
_SHIPPED: set[str] = set()


def ship(spark: SparkSession) -> None:
    """Send the package's sources to the application's workers, once.

    A path that only the driver's process knows doesn't reach them.
    """
    sc = spark.sparkContext
    home = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    if sc.applicationId in _SHIPPED or not os.path.isdir(home):  # from an archive it has come by the same way
        return
    folder = tempfile.mkdtemp(prefix="skein-ship-")
    atexit.register(shutil.rmtree, folder, ignore_errors=True)
    archive = os.path.join(folder, "skein.zip")
    with zipfile.ZipFile(archive, "w", zipfile.ZIP_DEFLATED) as z:
        for at, _, names in os.walk(home):
            for name in sorted(names):
                if name.endswith(".py"):
                    path = os.path.join(at, name)
                    z.write(path, os.path.relpath(path, os.path.dirname(home)))
    sc.addPyFile(archive)
    _SHIPPED.add(sc.applicationId)


def pieces(batch: pa.RecordBatch, most: int = BATCH_BYTES) -> Iterator[pa.RecordBatch]:
    """Slices of a batch, in order and without copying, of at most ``most`` bytes or one row each."""
    if batch.num_rows < 2 or batch.nbytes <= most:
        yield batch
        return
    half = batch.num_rows // 2
    yield from pieces(batch.slice(0, half), most)
    yield from pieces(batch.slice(half), most)


def map_batches(df: DataFrame, run: Callable, schema: str) -> DataFrame:
    """``mapInArrow`` with a function of this package, whose batches are bounded by bytes.

    Spark bounds a batch by rows and, more widely, by bytes; what a function
    holds at once follows from BATCH_BYTES and its longest row alone.
    """
    ship(df.sparkSession)

    def bounded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        return run(piece for batch in batches for piece in pieces(batch))

    return df.mapInArrow(bounded, schema)

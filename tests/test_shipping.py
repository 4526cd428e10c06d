"""The package reaches Python workers of a driver that was started elsewhere."""

import os
import subprocess
import sys

import pyarrow as pa

from skein.plans import ship


def test_pieces_are_bounded_by_bytes_and_keep_every_row_in_order():
    texts = ["x" * n for n in (0, 5, 40_000, 3, 0, 7_000, 9_000, 1)] + [None]
    batch = pa.RecordBatch.from_arrays([pa.array(range(9), pa.int64()), pa.array(texts), pa.array([[i] * i for i in range(9)])], names=["id", "text", "list"])
    cut = list(ship.pieces(batch, 10_000))
    assert [r for c in cut for r in c.to_pylist()] == batch.to_pylist()
    assert all(c.num_rows == 1 or c.nbytes <= 10_000 for c in cut) and len(cut) > 2
    # One row beyond the bound goes alone, an empty batch stays one.
    assert [c.num_rows for c in ship.pieces(batch.slice(2, 1), 10)] == [1]
    assert [c.num_rows for c in ship.pieces(batch.slice(0, 0), 10)] == [0]


def test_functions_get_pieces(spark):
    def run(batches):
        for b in batches:
            yield pa.RecordBatch.from_arrays([pa.array([b.num_rows], pa.int64()), pa.array([b.nbytes], pa.int64())], names=["n", "size"])

    found = spark.range(0, 9_000, 1, 1).selectExpr("repeat('y', 2000) AS t").transform(ship.map_batches, run, "n long, size long").collect()
    assert sum(r["n"] for r in found) == 9_000 and max(r["size"] for r in found) <= ship.BATCH_BYTES


def test_workers_find_the_package(tmp_path):
    root = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    code = f"""
import sys
sys.path.insert(0, {root!r})
from pyspark.sql import SparkSession
from skein.plans import ship
spark = SparkSession.builder.master('local[1]').config('spark.ui.enabled', 'false').getOrCreate()
def run(batches):
    import skein.model
    for b in batches:
        yield b
print('ROWS', ship.map_batches(spark.range(3), run, 'id long').count())
"""
    env = {k: v for k, v in os.environ.items() if k != "PYTHONPATH"}
    done = subprocess.run([sys.executable, "-c", code], cwd=tmp_path, env=env, capture_output=True, text=True, timeout=300)
    assert "ROWS 3" in done.stdout, done.stderr[-2000:]

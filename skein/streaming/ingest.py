"""Structured Streaming: edge streams into a store, and running degrees."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from skein.functions.etl import upsert
from skein.sources.store import GraphStore


def into_store(edges: DataFrame, store: GraphStore, checkpoint: str, on_duplicate: str = "keep", available_now: bool = True) -> StreamingQuery:
    """Commit every micro-batch as a version.

    A batch that is run again after a failure adds the same edges, which changes
    nothing.
    """
    write = edges.writeStream.option("checkpointLocation", checkpoint).foreachBatch(lambda batch, _: None if batch.isEmpty() else upsert(store, batch, on_duplicate))
    return (write.trigger(availableNow=True) if available_now else write).start()


def degree_counts(edges: DataFrame, window: str, delay: str, time: str = "ts") -> DataFrame:
    """``(start, src, degree)`` of every window of event time; edges later than ``delay`` are dropped."""
    return edges.withWatermark(time, delay).groupBy(F.window(time, window).alias("w"), "src").agg(F.count("*").alias("degree")).select(F.col("w.start").alias("start"), "src", "degree")

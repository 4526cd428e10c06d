"""Whole-graph scans, component statistics and the compressed row form."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from skein.model import Graph
from skein.operators.reads import degrees
from skein.plans.ranking import with_position


def neighbourhood_scan(g: Graph, direction: str = "out") -> DataFrame:
    """One row: ``lists`` scanned, ``members`` in them and ``distinct_nodes`` among keys and members."""
    key, other = ("src", "dst") if direction == "out" else ("dst", "src")
    seen = g.edges.select(F.explode(F.array(F.struct(F.col(key).alias("id"), F.lit(True).alias("first")), F.struct(F.col(other).alias("id"), F.lit(False).alias("first")))).alias("e"))
    # A row for each node before anything is counted.
    nodes = seen.groupBy("e.id").agg(F.count(F.when(F.col("e.first"), 1)).alias("n"))
    return nodes.agg(F.count(F.when(F.col("n") > 0, 1)).alias("lists"), F.coalesce(F.sum("n"), F.lit(0)).alias("members"), F.count("*").alias("distinct_nodes"))


def edge_scan(g: Graph) -> DataFrame:
    """One row: the number of edges and the sum of their weights."""
    return g.edges.agg(F.count("*").alias("edges"), F.coalesce(F.sum("weight"), F.lit(0)).alias("weight"))


def component_sizes(components: DataFrame) -> DataFrame:
    """``(component, n)``."""
    return components.groupBy("component").agg(F.count("*").alias("n"))


def component_stats(components: DataFrame) -> DataFrame:
    """One row: ``components``, ``largest``, ``nodes``."""
    return component_sizes(components).agg(F.count("*").alias("components"), F.max("n").alias("largest"), F.sum("n").alias("nodes"))


def csr(g: Graph) -> DataFrame:
    """``(id, position, first, degree)``: where each node's out-edges begin in (src, dst) order.

    Offsets come from the edges' global positions, so no task sums over all nodes.
    """
    placed = with_position(g.edges.select("src", "dst"), ["src", "dst"], "at")
    first = placed.groupBy(F.col("src").alias("id")).agg(F.min("at").alias("first"), F.count("*").alias("degree"))
    ranked = with_position(g.nodes, ["id"])
    return ranked.join(first, "id", "left").select("id", "position", "first", F.coalesce("degree", F.lit(0)).alias("degree"))


def degree_histogram(g: Graph) -> DataFrame:
    """``(out_degree, n)``."""
    return degrees(g).groupBy("out_degree").agg(F.count("*").alias("n"))

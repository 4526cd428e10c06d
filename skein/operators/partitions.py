"""Cutting nodes and edges into ranges for parallel work; ranges never overlap."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from skein.model import Graph, GraphError
from skein.plans.ranking import with_position


def _tile(position: str, total: int, parts: int) -> Column:
    """Equal tiles of which the first take the remainder, numbered from 1."""
    small, rest = divmod(total, parts)
    p = F.col(position)
    return (F.when(p < rest * (small + 1), F.floor(p / (small + 1))).otherwise(rest + F.floor((p - rest * (small + 1)) / max(small, 1))) + 1).cast("int")


def node_ranges_by_count(g: Graph, parts: int) -> DataFrame:
    """``(part, first, last, n)``: ranges of ids with equal numbers of nodes."""
    _check(parts)
    placed = with_position(g.nodes, ["id"])
    return placed.withColumn("part", _tile("position", placed.count(), parts)).groupBy("part").agg(F.min("id").alias("first"), F.max("id").alias("last"), F.count("*").alias("n"))


def node_ranges_by_width(g: Graph, parts: int) -> DataFrame:
    """``(part, first, last, n)``: equal widths of ids between the smallest and the largest.

    The width is at least 1; ``first`` and ``last`` bound the range, whether nodes
    have those ids or not, and ranges without nodes are left out.
    """
    _check(parts)
    bounds = g.nodes.agg(F.min("id").alias("a"), F.max("id").alias("b")).first()
    if bounds["a"] is None:
        return g.nodes.select(F.lit(1).alias("part"), F.col("id").alias("first"), F.col("id").alias("last"), F.lit(1).cast("long").alias("n")).limit(0)
    width = max(1, -(-(bounds["b"] - bounds["a"] + 1) // parts))
    part = F.floor((F.col("id") - bounds["a"]) / width).cast("int") + 1
    counted = g.nodes.groupBy(part.alias("part")).agg(F.count("*").alias("n"))
    first = F.lit(bounds["a"]) + (F.col("part") - 1) * width
    return counted.select("part", first.cast("long").alias("first"), F.least(first + width - 1, F.lit(bounds["b"])).cast("long").alias("last"), "n")


def edge_ranges_by_count(g: Graph, parts: int) -> DataFrame:
    """``(part, first_src, first_dst, last_src, last_dst, n)``: ranges of (src, dst) with equal numbers of edges."""
    _check(parts)
    placed = with_position(g.edges.select("src", "dst"), ["src", "dst"])
    tiled = placed.withColumn("part", _tile("position", placed.count(), parts)).groupBy("part").agg(F.min(F.struct("src", "dst")).alias("a"), F.max(F.struct("src", "dst")).alias("b"), F.count("*").alias("n"))
    return tiled.select("part", F.col("a.src").alias("first_src"), F.col("a.dst").alias("first_dst"), F.col("b.src").alias("last_src"), F.col("b.dst").alias("last_dst"), "n")


def _check(parts: int) -> None:
    if parts < 1:
        raise GraphError("at least one part is needed")

"""Point and set reads.

A lookup of what is absent gives no rows; neighbours of an absent node raise
GraphError.  Every read is a filter that reaches the scan, with an aggregate or
join above it at most.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from skein.model import Graph, GraphError


def has_node(g: Graph, node: int) -> bool:
    return not get_node(g, node).isEmpty()


def get_node(g: Graph, node: int) -> DataFrame:
    return g.nodes.where(F.col("id") == node)


def get_nodes(g: Graph) -> DataFrame:
    """All nodes in order of their ids."""
    return g.nodes.orderBy("id")


def mix(c: str | Column, seed: int = 0) -> Column:
    """An arithmetic hash of an id below 2^20 or so, the same in any SQL dialect."""
    col = F.col(c) if isinstance(c, str) else c
    return F.pmod(F.pmod(col, F.lit(1_000_003)) * 7919 + (seed % 1_000_003) * 104_729 + 12_345, F.lit(1_000_003))


def get_random_node(g: Graph, seed: int = 0) -> DataFrame:
    """One node, fixed by the seed."""
    return g.nodes.orderBy(mix("id", seed), "id").limit(1)


def get_random_node_ids(g: Graph, n: int, seed: int = 0) -> DataFrame:
    """``n`` nodes with out-edges, fixed by the seed."""
    return g.edges.select(F.col("src").alias("id")).distinct().orderBy(mix("id", seed), "id").limit(n)


def has_edge(g: Graph, src: int, dst: int) -> bool:
    return not get_edge(g, src, dst).isEmpty()


def get_edge(g: Graph, src: int, dst: int) -> DataFrame:
    return g.edges.where((F.col("src") == src) & (F.col("dst") == dst))


def get_edges(g: Graph) -> DataFrame:
    """All edges in order of (src, dst)."""
    return g.edges.orderBy("src", "dst")


def degrees(g: Graph) -> DataFrame:
    """``(id, in_degree, out_degree)`` of every node; isolated nodes have zeros."""
    ends = g.edges.select(F.explode(F.array(F.struct(F.col("src").alias("id"), F.lit(0).alias("i"), F.lit(1).alias("o")), F.struct(F.col("dst").alias("id"), F.lit(1).alias("i"), F.lit(0).alias("o")))).alias("e"))
    counted = ends.groupBy(F.col("e.id").alias("id")).agg(F.sum("e.i").alias("i"), F.sum("e.o").alias("o"))
    return g.nodes.join(counted, "id", "left").select("id", F.coalesce("i", F.lit(0)).alias("in_degree"), F.coalesce("o", F.lit(0)).alias("out_degree"))


def _present(g: Graph, node: int) -> None:
    if not has_node(g, node):
        raise GraphError(f"no node {node}")


def get_out_degree(g: Graph, node: int) -> int:
    _present(g, node)
    return g.edges.where(F.col("src") == node).count()


def get_in_degree(g: Graph, node: int) -> int:
    _present(g, node)
    return g.edges.where(F.col("dst") == node).count()


def get_out_edges(g: Graph, node: int) -> DataFrame:
    _present(g, node)
    return g.edges.where(F.col("src") == node).orderBy("dst")


def get_in_edges(g: Graph, node: int) -> DataFrame:
    _present(g, node)
    return g.edges.where(F.col("dst") == node).orderBy("src")


def get_out_nodes_id(g: Graph, node: int) -> DataFrame:
    return get_out_edges(g, node).select(F.col("dst").alias("id"))


def get_in_nodes_id(g: Graph, node: int) -> DataFrame:
    return get_in_edges(g, node).select(F.col("src").alias("id"))


def get_out_nodes(g: Graph, node: int) -> DataFrame:
    """Node records, with degrees, of the out-neighbours."""
    return _records(g, get_out_nodes_id(g, node))


def get_in_nodes(g: Graph, node: int) -> DataFrame:
    """Node records, with degrees, of the in-neighbours."""
    return _records(g, get_in_nodes_id(g, node))


def _records(g: Graph, wanted: DataFrame) -> DataFrame:
    """Node records of the wanted ids in order; edges are cut down to theirs before they are counted."""
    own = wanted.select("id").distinct()
    touching = lambda end: g.edges.join(own.select(F.col("id").alias(end)), end, "left_semi").select(F.col(end).alias("id"))
    ends = touching("dst").select("id", F.lit(1).alias("i"), F.lit(0).alias("o")).union(touching("src").select("id", F.lit(0), F.lit(1)))
    counted = ends.groupBy("id").agg(F.sum("i").alias("i"), F.sum("o").alias("o"))
    return own.join(counted, "id", "left").select("id", F.coalesce("i", F.lit(0)).alias("in_degree"), F.coalesce("o", F.lit(0)).alias("out_degree")).orderBy("id")


def adjacency(g: Graph, direction: str = "out", all_nodes: bool = False) -> DataFrame:
    """``(node_id, degree int, edgelist array<long>)`` with sorted lists; with ``all_nodes`` also the empty ones."""
    key, other = ("src", "dst") if direction == "out" else ("dst", "src")
    lists = g.edges.groupBy(F.col(key).alias("node_id")).agg(F.count("*").cast("int").alias("degree"), F.sort_array(F.collect_list(other)).alias("edgelist"))
    if all_nodes:
        lists = g.nodes.select(F.col("id").alias("node_id")).join(lists, "node_id", "left").select("node_id", F.coalesce("degree", F.lit(0)).alias("degree"), F.coalesce("edgelist", F.array().cast("array<long>")).alias("edgelist"))
    return lists


def get_adjlist(g: Graph, node: int, direction: str = "out") -> DataFrame:
    """One node's list."""
    key = "src" if direction == "out" else "dst"
    return adjacency(g.with_(edges=g.edges.where(F.col(key) == node)), direction)


def get_min_node_id(g: Graph) -> DataFrame:
    return g.nodes.agg(F.min("id").alias("id"))


def get_max_node_id(g: Graph) -> DataFrame:
    return g.nodes.agg(F.max("id").alias("id"))


def lookup(g: Graph, wanted: DataFrame) -> DataFrame:
    """``(id, degree)`` of many wanted ids at once: a join instead of a seek for each."""
    out = g.edges.join(wanted.select(F.col("id").alias("src")).distinct(), "src", "left_semi").groupBy(F.col("src").alias("id")).agg(F.count("*").alias("degree"))
    return wanted.select("id").distinct().join(out, "id", "left").select("id", F.coalesce("degree", F.lit(0)).alias("degree"))

"""Batch updates: functions from a graph and a table of changes to a graph.

Degrees and lists follow from the edges, so no update maintains them.  A batch
becomes visible at once when the result is committed to a store.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from skein.model import Graph, GraphError, endpoints, symmetrise


def _ids(df: DataFrame) -> DataFrame:
    return df.select(F.col(df.columns[0]).cast("long").alias("id")).where("id is not null").distinct()


def _pairs(g: Graph, edges: DataFrame) -> DataFrame:
    """A change table's edges as the graph stores them: both directions if undirected, one row for each pair."""
    weight = F.coalesce(F.col("weight").cast("int"), F.lit(0)) if "weight" in edges.columns else F.lit(0)
    own = edges.select(F.col("src").cast("long").alias("src"), F.col("dst").cast("long").alias("dst"), weight.alias("weight")).where("src is not null and dst is not null")
    own = own if g.directed else symmetrise(own)
    return own.groupBy("src", "dst").agg(F.max("weight").alias("weight"))


def add_nodes(g: Graph, nodes: DataFrame, on_duplicate: str = "keep") -> Graph:
    """Add nodes; one that exists already stays, or raises with ``on_duplicate='error'``."""
    new = _ids(nodes)
    if on_duplicate == "error" and not new.join(g.nodes, "id", "left_semi").isEmpty():
        raise GraphError("a node exists already")
    return g.with_(nodes=g.nodes.union(new).distinct())


def add_nodes_with_lists(g: Graph, lists: DataFrame) -> Graph:
    """Add nodes with their neighbours: ``(node_id, out array<long>, in array<long>)``."""
    out = lists.select(F.col("node_id").alias("src"), F.explode("out").alias("dst"))
    back = lists.select(F.explode("in").alias("src"), F.col("node_id").alias("dst"))
    return add_edges(add_nodes(g, lists.select("node_id")), out.union(back))


def add_edges(g: Graph, edges: DataFrame, on_duplicate: str = "keep") -> Graph:
    """Add edges and the nodes at their ends.

    Of an edge that exists already the old row stays (``keep``), the new weight
    counts (``replace``), or GraphError is raised (``error``).  Of repeats within
    the batch the largest weight counts.
    """
    new = _pairs(g, edges)
    if on_duplicate == "error":
        if not new.join(g.edges, ["src", "dst"], "left_semi").isEmpty():
            raise GraphError("an edge exists already")
    elif on_duplicate not in ("keep", "replace"):
        raise GraphError(f"not a policy: {on_duplicate}")
    first = F.min if on_duplicate != "replace" else F.max
    both = g.edges.select("src", "dst", "weight", F.lit(0).alias("age")).union(new.select("src", "dst", "weight", F.lit(1).alias("age")))
    merged = both.groupBy("src", "dst").agg(first(F.struct("age", "weight")).alias("w")).select("src", "dst", F.col("w.weight").alias("weight"))
    return g.with_(g.nodes.union(endpoints(new)).distinct(), merged)


def delete_nodes(g: Graph, nodes: DataFrame) -> Graph:
    """Delete nodes and all edges at them; absent ones change nothing."""
    gone = _ids(nodes)
    kept = g.edges.join(gone.withColumnRenamed("id", "src"), "src", "left_anti").join(gone.withColumnRenamed("id", "dst"), "dst", "left_anti")
    return g.with_(g.nodes.join(gone, "id", "left_anti"), kept.select("src", "dst", "weight"))


def delete_edges(g: Graph, edges: DataFrame) -> Graph:
    """Delete edges, of undirected graphs in both directions; nodes stay."""
    return g.with_(edges=g.edges.join(_pairs(g, edges).select("src", "dst"), ["src", "dst"], "left_anti"))


def update_weights(g: Graph, edges: DataFrame) -> Graph:
    """Overwrite weights of edges that exist; others change nothing."""
    if not g.options.weighted:
        raise GraphError("the graph has no weights")
    new = _pairs(g, edges).withColumnRenamed("weight", "new")
    return g.with_(edges=g.edges.join(new, ["src", "dst"], "left").select("src", "dst", F.coalesce("new", "weight").alias("weight")))


def append_to_lists(lists: DataFrame, changes: DataFrame) -> DataFrame:
    """Adjacency lists with ``changes(node_id, edgelist)`` united in; lists stay sorted and free of repeats."""
    both = lists.select("node_id", "edgelist").union(changes.select("node_id", "edgelist"))
    merged = both.groupBy("node_id").agg(F.array_sort(F.array_distinct(F.flatten(F.collect_list("edgelist")))).alias("edgelist"))
    return merged.select("node_id", F.size("edgelist").alias("degree"), "edgelist")


def remove_from_lists(lists: DataFrame, changes: DataFrame) -> DataFrame:
    """Adjacency lists without the members named by ``changes(node_id, edgelist)``; nodes stay."""
    gone = changes.groupBy("node_id").agg(F.flatten(F.collect_list("edgelist")).alias("gone"))
    left = lists.join(gone, "node_id", "left").select("node_id", F.when(F.col("gone").isNull(), F.col("edgelist")).otherwise(F.array_except("edgelist", "gone")).alias("edgelist"))
    return left.select("node_id", F.size("edgelist").alias("degree"), "edgelist")

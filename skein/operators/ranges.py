"""Ordered iterators as range scans; both ends are inclusive and ``None`` is open."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from skein.model import Graph
from skein.operators.reads import adjacency


def node_range(g: Graph, start: int | None = None, end: int | None = None) -> DataFrame:
    """Nodes of the range by id."""
    out = g.nodes
    if start is not None:
        out = out.where(F.col("id") >= start)
    if end is not None:
        out = out.where(F.col("id") <= end)
    return out.orderBy("id")


def node_seek(g: Graph, key: int, start: int | None = None, end: int | None = None) -> DataFrame:
    """The node with this id if the range holds it."""
    return node_range(g, start, end).where(F.col("id") == key)


def edge_range(g: Graph, start: tuple[int, int] | None = None, end: tuple[int, int] | None = None, with_weight: bool = True) -> DataFrame:
    """Edges of the range by (src, dst); pairs compare by src first.

    The bounds on ``src`` alone are stated too, as only those can skip row groups.
    """
    out = g.edges
    if start is not None:
        s, d = start
        out = out.where((F.col("src") >= s) & ((F.col("src") > s) | (F.col("dst") >= d)))
    if end is not None:
        s, d = end
        out = out.where((F.col("src") <= s) & ((F.col("src") < s) | (F.col("dst") <= d)))
    return out.select("src", "dst", *["weight"] * with_weight).orderBy("src", "dst")


def _list_range(g: Graph, direction: str, start: int | None, end: int | None, all_nodes: bool) -> DataFrame:
    key = "src" if direction == "out" else "dst"
    nodes, edges = g.nodes, g.edges
    for bound, compare in ((start, lambda c, x: c >= x), (end, lambda c, x: c <= x)):
        if bound is not None:
            nodes, edges = nodes.where(compare(F.col("id"), bound)), edges.where(compare(F.col(key), bound))
    return adjacency(g.with_(nodes, edges), direction, all_nodes).orderBy("node_id")


def out_lists(g: Graph, start: int | None = None, end: int | None = None, all_nodes: bool = False) -> DataFrame:
    """Out-lists of the range's nodes; empty ones only with ``all_nodes``."""
    return _list_range(g, "out", start, end, all_nodes)


def in_lists(g: Graph, start: int | None = None, end: int | None = None, all_nodes: bool = False) -> DataFrame:
    """In-lists of the range's nodes; empty ones only with ``all_nodes``."""
    return _list_range(g, "in", start, end, all_nodes)

"""The logical graph: nodes and weighted edges, with options and metadata."""

from __future__ import annotations

from dataclasses import dataclass, replace
from enum import Enum

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from skein.plans.deal import deal

NODES = T.StructType([T.StructField("id", T.LongType(), False)])
EDGES = T.StructType([T.StructField("src", T.LongType(), False), T.StructField("dst", T.LongType(), False), T.StructField("weight", T.IntegerType(), False)])
ADJACENCY = T.StructType([T.StructField("node_id", T.LongType(), False), T.StructField("degree", T.IntegerType()), T.StructField("edgelist", T.ArrayType(T.LongType()))])


class GraphError(Exception):
    """A request that the graph can't meet."""


class Layout(Enum):
    """Physical layouts; all give the same rows to every reader."""

    EDGE_LIST = "edge_list"
    ADJACENCY = "adjacency"
    EDGE_KEY = "edge_key"
    SPLIT_EDGE_KEY = "split_edge_key"


@dataclass(frozen=True)
class GraphOptions:
    """What a graph is and how it is stored."""

    name: str = "graph"
    directed: bool = True
    weighted: bool = True
    read_optimize: bool = False
    layout: Layout = Layout.EDGE_LIST
    partitions: int = 0

    def __post_init__(self) -> None:
        if not self.name or "/" in self.name:
            raise GraphError(f"not a graph name: {self.name!r}")
        if self.partitions < 0:
            raise GraphError("partitions must not be negative")

    def directory(self) -> str:
        """Layout, option letters and name, as in ``adjacency_rd_kron``."""
        letters = "r" * self.read_optimize + "d" * self.directed
        return "_".join(x for x in (self.layout.value, letters, self.name) if x)


@dataclass(frozen=True)
class Graph:
    """``nodes(id)`` and ``edges(src, dst, weight)``.

    (src, dst) is unique.  An undirected graph holds both directions of an edge
    with one weight, and a self loop once.
    """

    nodes: DataFrame
    edges: DataFrame
    options: GraphOptions = GraphOptions()

    @property
    def spark(self) -> SparkSession:
        return self.edges.sparkSession

    @property
    def directed(self) -> bool:
        return self.options.directed

    def with_(self, nodes: DataFrame | None = None, edges: DataFrame | None = None) -> Graph:
        return replace(self, nodes=self.nodes if nodes is None else nodes, edges=self.edges if edges is None else edges)

    @classmethod
    def from_edges(cls, edges: DataFrame, nodes: DataFrame | None = None, options: GraphOptions = GraphOptions(), on_duplicate: str = "min") -> Graph:
        """Clean edges and make their endpoints nodes.

        Edges with a null end go; a missing or null weight is 0.  Of repeated
        (src, dst) the smallest weight stays (``min``) or the largest (``max``).
        Undirected graphs are symmetrised.
        """
        weight = F.coalesce(F.col("weight").cast("int"), F.lit(0)) if "weight" in edges.columns and options.weighted else F.lit(0)
        own = edges.select(F.col("src").cast("long").alias("src"), F.col("dst").cast("long").alias("dst"), weight.alias("weight")).where("src is not null and dst is not null")
        own = grouped(own, on_duplicate) if options.directed else both_ways(own, on_duplicate)
        ends = endpoints(own) if options.directed else own.select(F.col("src").alias("id")).distinct()
        if nodes is not None:
            ends = ends.union(nodes.select(F.col(nodes.columns[0]).cast("long").alias("id")).where("id is not null")).distinct()
        return cls(ends, own, options)

    def metadata(self) -> DataFrame:
        """One row of name, options, counts and id bounds; the counts come from the data.

        ``num_edges`` counts stored directed rows, ``num_undirected_edges`` pairs.
        """
        o = self.options
        # One pass over both tables; a row and its reverse are one undirected edge.
        kinds = self.nodes.select("id", F.lit(0).alias("edge"), F.lit(0).alias("half")).union(self.edges.select(F.lit(None).cast("long"), F.lit(1), (F.col("src") <= F.col("dst")).cast("int")))
        total = lambda c: F.coalesce(F.sum(c), F.lit(0)).cast("long")
        counts = kinds.agg(F.count("id").alias("num_nodes"), total("edge").alias("num_edges"), total("half").alias("num_undirected_edges"), F.max("id").alias("max_node_id"), F.min("id").alias("min_node_id"))
        named = [F.lit(o.name).alias("db_name"), F.lit(o.weighted).alias("is_weighted"), F.lit(o.read_optimize).alias("read_optimize"), F.lit(o.directed).alias("is_directed")]
        return counts.select(*named, *counts.columns)


def grouped(edges: DataFrame, on_duplicate: str = "min") -> DataFrame:
    """One row for each (src, dst), with its smallest weight (``min``) or its largest (``max``)."""
    return deal(edges, "src", "dst").groupBy("src", "dst").agg((F.min if on_duplicate == "min" else F.max)("weight").alias("weight"))


def both_ways(edges: DataFrame, on_duplicate: str = "min") -> DataFrame:
    """Edges without null ends in both directions, grouped: an edge and its reverse are one group and have one weight."""
    own = grouped(edges.select(F.least("src", "dst").alias("src"), F.greatest("src", "dst").alias("dst"), "weight"), on_duplicate)
    there, back = F.struct("src", "dst", "weight"), F.struct(F.col("dst").alias("src"), F.col("src").alias("dst"), "weight")
    return own.select(F.inline(F.when(F.col("src") == F.col("dst"), F.array(there)).otherwise(F.array(there, back))))


def endpoints(edges: DataFrame) -> DataFrame:
    """Distinct ids of both ends."""
    return edges.select(F.explode(F.array("src", "dst")).alias("id")).distinct()


def symmetrise(edges: DataFrame) -> DataFrame:
    """Edges and their reverses; a self loop once."""
    return edges.union(edges.where("src <> dst").select(F.col("dst").alias("src"), F.col("src").alias("dst"), "weight"))

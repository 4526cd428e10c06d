"""From raw edges to graphs: distinct nodes, reversal, weights, dense ids, checks, and the whole ingest."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from skein.model import Graph, GraphOptions, endpoints
from skein.plans.ranking import with_position
from skein.plans.scratch import materialize
from skein.sources.store import GraphStore
from skein.sources.text import read_edges


def reverse(edges: DataFrame) -> DataFrame:
    """The transposed graph's edges."""
    return edges.select(F.col("dst").alias("src"), F.col("src").alias("dst"), "weight")


def random_weight(src: str = "src", dst: str = "dst") -> Column:
    """A weight from 0 to 255 that an edge and its reverse share."""
    low, high = F.least(src, dst), F.greatest(src, dst)
    return F.pmod(low * 31 + high * 17 + F.pmod(low * high, F.lit(251)), F.lit(256)).cast("int")


def with_random_weights(edges: DataFrame) -> DataFrame:
    return edges.select("src", "dst", random_weight().alias("weight"))


def id_map(nodes: DataFrame) -> DataFrame:
    """``(old_id, new_id)``: ranks of the sorted ids from 0, computed range by range."""
    return with_position(nodes.select(F.col("id").alias("old_id")).distinct(), ["old_id"], "new_id")


def dense_renumber(g: Graph) -> tuple[Graph, DataFrame]:
    """The graph over ids 0..n-1, and the map from old ids."""
    ids = materialize(id_map(g.nodes), "id-map")
    new = lambda c: ids.select(F.col("old_id").alias(c), F.col("new_id").alias(f"new_{c}"))
    edges = g.edges.join(new("src"), "src").join(new("dst"), "dst").select(F.col("new_src").alias("src"), F.col("new_dst").alias("dst"), "weight")
    return g.with_(ids.select(F.col("new_id").alias("id")), edges), ids


def unsorted_rows(df: DataFrame, position: str, keys: list[str]) -> DataFrame:
    """Rows that are smaller than the row before them in order of ``position``.

    Each range of positions is checked by itself, and its first row against the
    last key of the range before; one row for each range goes to a single task.
    """
    held = materialize(df.repartitionByRange(position).withColumn("_range", F.spark_partition_id()), "ranges")
    key = F.struct(*keys)
    inside = held.withColumn("_before", F.lag(key).over(W.partitionBy("_range").orderBy(position))).where(key < F.col("_before"))
    ends = held.groupBy("_range").agg(F.min_by(F.struct(*df.columns), position).alias("first"), F.max_by(key, position).alias("last"))
    joints = ends.withColumn("_before", F.lag("last").over(W.orderBy("_range"))).select("first.*", "_before").where(key < F.col("_before"))
    return inside.select(*df.columns).union(joints.select(*df.columns))


def density(nodes: DataFrame) -> DataFrame:
    """One row: ``n``, ``lowest``, ``highest`` and whether the ids are just 0..n-1."""
    out = nodes.agg(F.count("*").alias("n"), F.count_distinct("id").alias("different"), F.min("id").alias("lowest"), F.max("id").alias("highest"))
    dense = (F.col("n") == F.col("different")) & (F.col("lowest") == 0) & (F.col("highest") == F.col("n") - 1)
    return out.select("n", "lowest", "highest", F.coalesce(dense, F.lit(True)).alias("dense"))


def split(df: DataFrame, parts: int, keys: list[str]) -> DataFrame:
    """Rows dealt into ``parts`` sorted key ranges, for writing as that many files."""
    return df.repartitionByRange(parts, *keys).sortWithinPartitions(*keys)


def ingest(spark: SparkSession, path: str, root: str, options: GraphOptions, random_weights: bool = False, dense: bool = False, index: bool = False) -> GraphStore:
    """Read an edge list, clean, weigh and renumber it as asked, and store it."""
    edges = read_edges(spark, path)
    if random_weights:
        edges = with_random_weights(edges)
    g = Graph.from_edges(edges, options=options)
    if dense:
        # Parsed and grouped once, for the ids and for the edges; renumbered once, for the store's bounds and its rows.
        edges = materialize(g.edges, "parsed")
        g, _ = dense_renumber(g.with_(endpoints(edges), edges))
        g = g.with_(edges=materialize(g.edges, "renumbered"))
    store = GraphStore(spark, root, options)
    store.create(g)
    if index:
        store.create_indices()
    return store


def append(store: GraphStore, edges: DataFrame) -> int:
    """Add edges that the caller knows to be new to the last version, without looking for repeats or concurrent commits.

    What ``upsert`` does besides is two joins of the batch with the graph.
    """
    g = store.graph()
    ends = edges.select(F.explode(F.array("src", "dst")).alias("id"))
    both = edges if g.directed else edges.union(edges.where("src <> dst").select(F.col("dst"), F.col("src"), "weight"))
    return store.commit(g.with_(nodes=g.nodes.union(ends).distinct(), edges=g.edges.unionByName(both)))


def upsert(store: GraphStore, edges: DataFrame, on_duplicate: str = "keep", retries: int = 3) -> int:
    """Add a batch of edges to the last version; on a concurrent commit try again."""
    from skein.model import GraphError
    from skein.operators.updates import add_edges

    for attempt in range(retries + 1):
        version = store.versions()[-1]
        try:
            return store.commit(add_edges(store.graph(version), edges, on_duplicate), expected=version)
        except GraphError:
            if attempt == retries or store.versions()[-1] == version:
                raise
    raise AssertionError

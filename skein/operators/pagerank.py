"""PageRank by synchronous rounds."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from skein.model import Graph
from skein.plans.loops import dealt_by
from skein.plans.scratch import delete_path, materialize, write_table

#: Rounds whose plan grows as one before it is cut by a written table.
CUT_EVERY = 5


def pagerank(g: Graph, damping: float = 0.85, max_iter: int = 10, tolerance: float | None = None) -> DataFrame:
    """``(id, rank double)`` of every node.

    Every round gives ``(1-d)/N + d * sum(rank(u) / outdegree(u))`` over in-edges,
    from 1/N on.  Mass of nodes without out-edges is not handed on.  With a
    tolerance rounds end when the absolute changes sum to less.  An empty graph
    has no ranks.

    Edges are dealt by source, sorted and kept so; a round moves ranks and partial
    sums only.  Sums are combined before they travel, so a hub costs one row a task.
    """
    n = g.nodes.count()
    if not n:
        return g.nodes.select("id", F.lit(0.0).alias("rank"))
    out = g.edges.groupBy("src").agg(F.count("*").alias("degree"))
    nodes = materialize(g.nodes, "nodes")
    ranks, spent = nodes.select("id", F.lit(1.0 / n).alias("rank")), None
    with dealt_by(g.edges.select("src", "dst").join(out, "src"), "src") as links:
        for i in range(1, max_iter + 1):
            shares = links.join(ranks, F.col("src") == F.col("id")).select(F.col("dst").alias("id"), (F.col("rank") / F.col("degree")).alias("in"), F.lit(False).alias("node"))
            # Nodes go along with a share of nothing, so that none without in-edges is lost and sums need no join.
            got = shares.union(nodes.select("id", F.lit(0.0), F.lit(True))).groupBy("id").agg(F.sum("in").alias("in"), F.max("node").alias("node")).where("node")
            new = got.select("id", (F.lit((1 - damping) / n) + damping * F.col("in")).alias("rank"))
            if tolerance is not None or i % CUT_EVERY == 0 or i == max_iter:
                new, path = write_table(new, "ranks")
            if tolerance is not None:
                moved = new.join(ranks.withColumnRenamed("rank", "was"), "id").agg(F.sum(F.abs(F.col("rank") - F.col("was")))).first()[0]
            ranks = new
            # The table of the last cut is read by no plan any more.
            if tolerance is not None or i % CUT_EVERY == 0 or i == max_iter:
                if spent:
                    delete_path(g.spark, spent)
                spent = path
            if tolerance is not None and moved < tolerance:
                break
    return ranks


def top_k(scores: DataFrame, k: int, score: str = "rank", key: str = "id") -> DataFrame:
    """The ``k`` largest scores; ties go to the smaller key."""
    return scores.orderBy(F.desc(score), F.asc(key)).limit(k)

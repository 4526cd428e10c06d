"""Single-source shortest paths over non-negative integer weights."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from skein.model import Graph, GraphError
from skein.plans.loops import dealt_by
from skein.plans.scratch import delete_path, write_table

#: Rounds whose changes are tables of their own before they are merged into one.
MERGE_ROUNDS = 16


def sssp(g: Graph, source: int, delta: int | None = None, max_rounds: int = 1_000_000) -> DataFrame:
    """``(id, dist long)`` of every reached node.

    Rounds relax the edges of nodes whose distance fell in the round before and
    write the distances that fall; a node's distance is the smallest of its rows.
    With ``delta`` only pending nodes of the lowest bucket of that width are
    relaxed, which saves work where weights differ much; distances are the same.
    """
    start, path = write_table(g.nodes.where(F.col("id") == source).select("id", F.lit(0).cast("long").alias("dist")), "fell")
    if start.isEmpty():
        delete_path(g.spark, path)
        raise GraphError(f"no node {source}")
    fell, paths = [start], [path]
    pending, waiting = start, None
    with dealt_by(g.edges.select("src", "dst", "weight"), "src") as edges:
        if not edges.where("weight < 0").isEmpty():
            delete_path(g.spark, path)
            raise GraphError("a weight is negative")
        for _ in range(max_rounds):
            if delta is None:
                if pending.isEmpty():
                    break
                active = pending
            else:
                low = pending.agg(F.min("dist")).first()[0]
                if low is None:
                    break
                lowest = F.floor(F.col("dist") / delta) <= low // delta
                active, later = pending.where(lowest), pending.where(~lowest)
            relaxed = edges.join(active.select(F.col("id").alias("src"), "dist"), "src").groupBy(F.col("dst").alias("id")).agg(F.min(F.col("dist") + F.col("weight")).alias("dist"))
            known = reduce(DataFrame.union, fell).select(F.col("id").alias("known"), F.col("dist").alias("was"))
            less, path = write_table(relaxed.join(known, (F.col("id") == F.col("known")) & (F.col("was") <= F.col("dist")), "left_anti"), "fell")
            fell.append(less)
            paths.append(path)
            if delta is None:
                pending = less
            else:
                old = waiting
                pending, waiting = write_table(later.union(less).groupBy("id").agg(F.min("dist").alias("dist")), "pending")
                if old:
                    delete_path(g.spark, old)
            if len(fell) > MERGE_ROUNDS:
                # The last changes stay a table of their own, as the next round reads them.
                merged, path = write_table(_least(fell[:-1]), "fell")
                for spent in paths[:-1]:
                    delete_path(g.spark, spent)
                fell, paths = [merged, less], [path, paths[-1]]
    if waiting:
        delete_path(g.spark, waiting)
    return _least(fell)


def _least(tables: list[DataFrame]) -> DataFrame:
    return reduce(DataFrame.union, tables).groupBy("id").agg(F.min("dist").alias("dist"))

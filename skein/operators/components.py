"""Connected components by alternating large-star and small-star contraction."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from skein.plans.deal import PART_ROWS, deal
from skein.plans.scratch import delete_path, materialize, write_table


def _with_lowest(pairs: DataFrame, rows: int) -> tuple[DataFrame, DataFrame, str]:
    """``pairs(u, v)`` with ``m``, the smallest ``v`` of each ``u``; these by themselves, and the path of their table.

    Many rows are dealt by ``u`` into parts of bounded size, but for those of a
    ``u`` that would fill a part alone: there are few of these and they are broadcast.
    """
    lowest, path = write_table(pairs.groupBy("u").agg(F.min("v").alias("m"), F.count("*").alias("n")), "lowest")
    if rows <= PART_ROWS * pairs.sparkSession.sparkContext.defaultParallelism:
        return pairs.join(lowest.select("u", "m"), "u"), lowest, path
    heavy = F.broadcast(lowest.where(F.col("n") > PART_ROWS).select("u", "m"))
    light = deal(pairs.join(heavy, "u", "left_anti"), "u", rows=rows).join(lowest.where(F.col("n") <= PART_ROWS).select("u", "m"), "u")
    return light.unionByName(pairs.join(heavy, "u")), lowest, path


def _large_star(edges: DataFrame, rows: int) -> tuple[DataFrame, str]:
    """Every larger neighbour goes to the smallest one; a written table of pairs ``u > v``, and its path."""
    both = edges.select("u", "v").union(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    joined, _, path = _with_lowest(both, 2 * rows)
    down = write_table(joined.where("v > u").select(F.col("v").alias("u"), F.least("u", "m").alias("v")).distinct(), "large")
    delete_path(edges.sparkSession, path)
    return down


def _small_star(down: DataFrame, rows: int) -> tuple[DataFrame, str]:
    """Every smaller neighbour goes to the smallest one; a written table of pairs ``u > v``, and its path."""
    joined, lowest, path = _with_lowest(down, rows)
    moved = joined.where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
    stars = write_table(moved.union(lowest.select("u", F.col("m").alias("v"))).distinct(), "stars")
    delete_path(down.sparkSession, path)
    return stars


def connected_components(edges: DataFrame, nodes: DataFrame | None = None, src: str = "src", dst: str = "dst", max_rounds: int = 60) -> DataFrame:
    """Smallest reachable id of every node, edges read in both directions.

    Returns ``(id, component)``.  Nodes in ``nodes(id)`` without an edge are
    their own component; edges with a null end are ignored; repeated edges and
    self loops change nothing; an empty edge table gives the nodes alone.

    A round costs a fixed number of shuffles and rounds grow with the logarithm
    of the component size, not with its diameter.  The working set is always at
    most one row per node and edge, and is written to the shared folder.
    """
    ends = edges.select(F.col(src).cast("long").alias("u"), F.col(dst).cast("long").alias("v")).where("u is not null and v is not null")
    first = deal(ends.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")), "u", "v").distinct()
    first, path = write_table(first, "edges")
    loops = materialize(first.where("u = v").select(F.col("u").alias("id")), "loops") if nodes is None else None
    state = first.where("u <> v")
    mark = _mark(state)
    for _ in range(max_rounds):
        if mark[0] == 0:
            break
        down, down_path = _large_star(state, mark[0])
        after, after_path = _small_star(down, down.count())
        delete_path(edges.sparkSession, path)
        delete_path(edges.sparkSession, down_path)
        state, path = after, after_path
        was, mark = mark, _mark(state)
        if mark == was:
            break
    else:
        raise RuntimeError(f"components did not settle in {max_rounds} rounds")
    labels = state.groupBy(F.col("u").alias("id")).agg(F.min("v").alias("component"))
    if nodes is None:
        # Every smaller end is the root of a star by now.
        return labels.union(state.select(F.col("v").alias("id"), F.col("v").alias("component"))).groupBy("id").agg(F.min("component").alias("component")).union(_lone_loops(loops, state))
    ids = nodes.select(F.col(nodes.columns[0]).cast("long").alias("id")).where("id is not null").distinct()
    return ids.join(labels, "id", "left").select("id", F.coalesce("component", "id").alias("component"))


def _lone_loops(loops: DataFrame, state: DataFrame) -> DataFrame:
    """Nodes that only have an edge to themselves."""
    known = state.select(F.col("u").alias("id")).union(state.select(F.col("v").alias("id"))).distinct()
    return loops.join(known, "id", "left_anti").select("id", F.col("id").alias("component"))


def _mark(edges: DataFrame) -> tuple[int, int]:
    """Count and an order-free checksum; equal marks mean that a round changed nothing."""
    row = edges.agg(F.count("*").alias("n"), F.coalesce(F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")), F.lit(0)).alias("h")).first()
    return int(row["n"]), int(row["h"])

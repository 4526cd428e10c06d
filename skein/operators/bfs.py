"""Breadth-first search by levels."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from skein.model import Graph, GraphError
from skein.operators.reads import get_random_node_ids, has_node
from skein.plans.loops import State, dealt_by
from skein.plans.scratch import delete_path, write_table

#: Levels that are kept as tables of their own before they are merged into one.
MERGE_LEVELS = 16


def bfs(g: Graph, source: int, max_levels: int = 1_000_000) -> DataFrame:
    """``(id, parent, depth int)`` of every reached node; the source is its own parent.

    Of several parents on the level before, the smallest counts.  Edges are dealt
    by source once; a level moves its frontier to them, broadcast by the planner
    if it is small and shuffled if large, which is the direction switch of other
    engines.
    """
    start = g.nodes.where(F.col("id") == source).select("id", F.col("id").alias("parent"), F.lit(0).alias("depth"))
    frontier, path = write_table(start, "level")
    if frontier.isEmpty():
        delete_path(g.spark, path)
        raise GraphError(f"no node {source}")
    levels, paths = [frontier], [path]
    with dealt_by(g.edges.select("src", "dst"), "src") as edges:
        for depth in range(1, max_levels + 1):
            reached = edges.join(frontier.select(F.col("id").alias("src")), "src").groupBy(F.col("dst").alias("id")).agg(F.min("src").alias("parent"))
            visited = reduce(DataFrame.union, levels).select("id")
            frontier, path = write_table(reached.join(visited, "id", "left_anti").select("id", "parent", F.lit(depth).alias("depth")), "level")
            if frontier.isEmpty():
                delete_path(g.spark, path)
                break
            levels.append(frontier)
            paths.append(path)
            if len(levels) > MERGE_LEVELS:
                # The frontier stays a table of its own, as the next round reads it.
                merged, path = write_table(reduce(DataFrame.union, levels[:-1]), "levels")
                for spent in paths[:-1]:
                    delete_path(g.spark, spent)
                levels, paths = [merged, frontier], [path, paths[-1]]
    return reduce(DataFrame.union, levels)


def bfs_by_edges(g: Graph, source: int, max_rounds: int = 1_000_000) -> DataFrame:
    """``(id, depth)`` by whole edge scans: every round relaxes all edges from reached nodes.

    The rounds and the depths are those of ``bfs``; it never narrows to a frontier.
    """
    if not has_node(g, source):
        raise GraphError(f"no node {source}")
    state = State(g.nodes.where(F.col("id") == source).select("id", F.lit(0).alias("depth")))
    n = 1
    for _ in range(max_rounds):
        spread = g.edges.join(state.df, F.col("src") == F.col("id")).select(F.col("dst").alias("id"), (F.col("depth") + 1).alias("depth"))
        state.set(state.df.union(spread).groupBy("id").agg(F.min("depth").alias("depth")))
        was, n = n, state.df.count()
        if n == was:
            break
    return state.df


def bfs_stats(g: Graph, tree: DataFrame) -> DataFrame:
    """``(num_visited, sum_out_degree, max_depth)`` of a search tree."""
    followed = g.edges.join(tree.select(F.col("id").alias("src")), "src", "left_semi")
    both = tree.select("depth", F.lit(0).alias("edge")).union(followed.select(F.lit(None).cast("int"), F.lit(1)))
    return both.agg(F.count("depth").alias("num_visited"), F.coalesce(F.sum("edge"), F.lit(0)).cast("long").alias("sum_out_degree"), F.max("depth").alias("max_depth"))


def bfs_violations(g: Graph, source: int, tree: DataFrame) -> DataFrame:
    """``(rule, n)``: how often a tree breaks each rule of breadth-first search; all zero if it is one."""
    t = tree.select("id", "parent", "depth")
    parents = t.select(F.col("id").alias("parent"), F.col("depth").alias("parent_depth"))
    child = t.where(F.col("id") != source)
    edges = g.edges.select("src", "dst")
    after = t.select(F.col("id").alias("dst"), F.col("depth").alias("after"))
    crossing = edges.join(t.select(F.col("id").alias("src"), F.col("depth").alias("before")), "src").join(after, "dst", "left")
    rules = {
        "source": t.where((F.col("id") == source) & (F.col("parent") == source) & (F.col("depth") == 0)).agg((1 - F.count("*")).alias("n")),
        "depth": child.join(parents, "parent", "left").where(F.col("parent_depth").isNull() | (F.col("depth") != F.col("parent_depth") + 1)).agg(F.count("*").alias("n")),
        "edge": child.join(edges, (F.col("parent") == F.col("src")) & (F.col("id") == F.col("dst")), "left_anti").agg(F.count("*").alias("n")),
        "reach": crossing.where(F.col("after").isNull() | (F.col("after") > F.col("before") + 1)).agg(F.count("*").alias("n")),
    }
    return reduce(DataFrame.union, [df.select(F.lit(rule).alias("rule"), F.col("n").cast("long").alias("n")) for rule, df in rules.items()])


def random_start(g: Graph, seed: int = 27491095) -> int:
    """A node with out-edges, fixed by the seed."""
    row = get_random_node_ids(g, 1, seed).first()
    if row is None:
        raise GraphError("no node has out-edges")
    return row["id"]

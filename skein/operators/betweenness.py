"""Betweenness centrality by Brandes' two passes: source by source in tasks that hold the edges, or by joins, level by level for a batch of sources."""

from __future__ import annotations

from collections.abc import Iterator
from functools import partial, reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from skein.model import Graph, endpoints
from skein.plans.joins import fits
from skein.plans.loops import State, dealt_by
from skein.plans.ranking import with_position
from skein.plans.scratch import delete_path, drop_spent_shuffles, write_table
from skein.plans.ship import map_batches

#: Edges that a task may hold, eight bytes each as they are broadcast, and its nodes' share of STATE_ROWS; a larger graph is joined.
TASK_EDGES, TASK_SHARE = 8_000_000, 20
#: Edges in a row of the packed table, and tasks for each core.
PACK_EDGES, TASKS = 250_000, 4
#: Rows of state, one for each source and node, that a batch of sources may have.
STATE_ROWS = 40_000_000
#: Edges that may be broadcast, so that paths stay where their source is; beyond it they are shuffled.
BROADCAST_EDGES = 1_000_000
#: Levels whose reached nodes are tables of their own before they are merged into one.
MERGE_LEVELS = 16


def betweenness(g: Graph, sources: DataFrame | None = None, normalise: bool = True, max_levels: int = 1_000_000, batch: int | None = None) -> DataFrame:
    """``(id, score double)`` of every node over the given sources (default: all nodes).

    Scores sum each source's dependencies; with ``normalise`` the largest is 1
    (all stay 0 where no path has an inner node).  A graph of at most ``TASK_EDGES``
    edges goes to every task, and sources are dealt over tasks.  A larger one, or any
    with a ``batch``, is joined: state is one row for each source and node it reaches;
    sources go in batches of about ``batch`` (default: as many as make ``STATE_ROWS``
    rows), so disk in use does not grow with their number.
    """
    scores = _in_tasks(g, sources, max_levels) if batch is None else None
    if scores is None:
        scores = _by_joins(g, sources, max_levels, batch)
    if not normalise:
        return scores
    most = scores.agg(F.max("score")).first()[0] or 0.0
    return scores.select("id", (F.col("score") / (most if most > 0 else 1.0)).alias("score"))


def _in_tasks(g: Graph, sources: DataFrame | None, max_levels: int) -> DataFrame | None:
    """Scores, or None where the edges are too many for a task."""
    edges = g.edges.where("src <> dst").select("src", "dst")
    # Nodes without edges are neither between others nor a source of paths.
    numbers, path = write_table(with_position(endpoints(edges), ["id"], "number"), "numbers")
    n, m = numbers.count(), edges.count()
    if m > TASK_EDGES or n > STATE_ROWS // TASK_SHARE:
        delete_path(g.spark, path)
        return None
    number = lambda end: numbers.select(F.col("id").alias(end), F.col("number").alias(f"{end}_number"))
    pairs = edges.join(number("src"), "src").join(number("dst"), "dst").select((F.shiftleft("src_number", 32) + F.col("dst_number")).alias("pair"))
    edge_rows = pairs.groupBy(F.pmod(F.xxhash64("pair"), F.lit(m // PACK_EDGES + 1)).alias("row")).agg(F.collect_list("pair").alias("longs")).select(F.lit(False).alias("start"), "longs")
    start = numbers if sources is None else numbers.join(sources.select(F.col(sources.columns[0]).alias("id")).distinct(), "id", "left_semi")
    start_rows = start.groupBy(F.floor(F.col("number") / PACK_EDGES)).agg(F.collect_list("number").alias("longs")).select(F.lit(True).alias("start"), "longs")
    packed, packed_path = write_table(edge_rows.union(start_rows), "packed")
    tasks = g.spark.sparkContext.defaultParallelism * TASKS
    dealt = g.spark.range(0, tasks, 1, tasks).withColumnRenamed("id", "part").crossJoin(F.broadcast(packed))
    sums = map_batches(dealt, partial(_part, tasks, n, max_levels), "number long, score double").groupBy("number").agg(F.sum("score").alias("own")).join(numbers, "number").select("id", "own")
    scores, _ = write_table(g.nodes.join(sums, "id", "left").select("id", F.coalesce("own", F.lit(0.0)).alias("score")), "scores")
    delete_path(g.spark, path)
    delete_path(g.spark, packed_path)
    return scores


def _part(tasks: int, n: int, max_levels: int, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Summed dependencies, by number, of the sources of a task's parts."""
    first, parts, pairs, starts = None, set(), [np.empty(0, np.int64)], [np.empty(0, np.int64)]
    for batch in batches:
        for i, (part, start) in enumerate(zip(batch["part"].to_pylist(), batch["start"].to_pylist())):
            first = part if first is None else first
            parts.add(part)
            if part == first:  # every part has the same rows
                (starts if start else pairs).append(batch["longs"][i].values.to_numpy().copy())
    own = np.sort(np.concatenate(starts))
    total = _dependencies(own[np.isin(np.arange(len(own)) % tasks, list(parts))], np.concatenate(pairs), n, max_levels)
    found = np.flatnonzero(total)
    yield pa.RecordBatch.from_arrays([pa.array(found, pa.int64()), pa.array(total[found])], names=["number", "score"])


def _lists(pairs: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Neighbours by node: where each node's list begins, and all lists."""
    pairs = np.sort(pairs)
    return np.searchsorted(pairs, np.arange(n + 1) << 32), pairs & 0xFFFFFFFF


def _spread(nodes: np.ndarray, at: np.ndarray, lists: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Every edge of ``nodes``: the node, and its neighbour."""
    count = at[nodes + 1] - at[nodes]
    place = np.repeat(at[nodes] - np.cumsum(count) + count, count) + np.arange(count.sum())
    return np.repeat(nodes, count), lists.take(place)


def _dependencies(sources: np.ndarray, pairs: np.ndarray, n: int, max_levels: int) -> np.ndarray:
    """Sum of the sources' dependencies on each node.

    A level is reached from the edges that leave the last one or from those that
    enter nodes not yet reached, whichever are fewer.
    """
    out_at, out = _lists(pairs, n)
    in_at, into = _lists((pairs & 0xFFFFFFFF) << 32 | pairs >> 32, n)
    out_count, in_count = np.diff(out_at), np.diff(in_at)
    depth, paths, passed, share, place, total = np.empty(n, np.int32), np.empty(n), np.empty(n), np.empty(n), np.empty(n, np.int64), np.zeros(n)
    for source in sources:
        depth.fill(-1)
        paths.fill(0)
        depth[source], paths[source] = 0, 1
        level, levels, steps = np.array([source]), [], []
        ahead = len(pairs) - in_count[source]
        while len(level) and len(steps) < max_levels:
            levels.append(level)
            if out_count[level].sum() <= ahead:
                parent, child = _spread(level, out_at, out)
                new = np.flatnonzero(depth.take(child) < 0)
            else:
                child, parent = _spread(np.flatnonzero(depth < 0), in_at, into)
                new = np.flatnonzero(depth.take(parent) == len(steps))
            parent, child = parent.take(new), child.take(new)
            np.add.at(paths, child, paths.take(parent))
            if 8 * len(child) > n:
                level = np.flatnonzero((depth < 0) & (paths > 0))
            else:  # each node where it stands last
                order = np.arange(len(child))
                place[child] = order
                level = child[place.take(child) == order]
            steps.append((parent, child))
            depth[level] = len(steps)
            ahead -= in_count[level].sum()
        levels.append(level)
        passed.fill(0)
        for i in range(len(steps) - 1, 0, -1):  # not to the source, which is no inner node of its own paths
            parent, child = steps[i]
            share[levels[i + 1]] = (1 + passed[levels[i + 1]]) / paths[levels[i + 1]]
            np.add.at(passed, parent, share.take(child))
            passed[levels[i]] *= paths[levels[i]]
        total += passed
    return total


def _by_joins(g: Graph, sources: DataFrame | None, max_levels: int, batch: int | None) -> DataFrame:
    start = g.nodes if sources is None else g.nodes.join(sources.select(F.col(sources.columns[0]).alias("id")).distinct(), "id", "left_semi")
    batch = batch or max(1, STATE_ROWS // max(1, g.nodes.count()))
    parts = max(1, -(-start.count() // batch))
    total = State(g.nodes.select("id", F.lit(0.0).alias("score")), "scores") if parts > 1 else None
    with dealt_by(g.edges.where("src <> dst").select("src", "dst"), "src") as edges:
        small = fits(edges, BROADCAST_EDGES)
        for i in range(parts):
            own = start if total is None else start.where(F.pmod(F.xxhash64("id"), F.lit(parts)) == i)
            scores, path = _accumulate(g, own, edges, small, max_levels)
            if total is not None:
                scores = total.set(total.df.union(scores).groupBy("id").agg(F.sum("score").alias("score")))
                delete_path(g.spark, path)
                drop_spent_shuffles(g.spark)
    return scores


def _along(level: DataFrame, edges: DataFrame, small: bool, here: str, there: str, value: str) -> DataFrame:
    """``(s, id, value)``: sums of a level's values over its edges.  Summed before anything is joined to them."""
    if small:  # dealt by source, sums need no shuffle
        level, edges = level.repartition(int(level.sparkSession.conf.get("spark.sql.shuffle.partitions")), "s"), F.broadcast(edges)
    return level.join(edges, F.col("id") == F.col(here)).groupBy("s", F.col(there).alias("id")).agg(F.sum(value).alias(value))


def _accumulate(g: Graph, start: DataFrame, edges: DataFrame, small: bool, max_levels: int) -> tuple[DataFrame, str]:
    """Scores of the sources in ``start``, and the path of their table."""
    first, path = write_table(start.select(F.col("id").alias("s"), "id", F.lit(1.0).alias("paths")), "level")
    levels, paths, seen = [first], [path], [first.select("s", "id")]
    # A source that has reached every node with an in-edge, and itself, is done.
    ends = edges.select(F.col("dst").alias("s")).distinct()
    n = ends.count()
    most, path = write_table(first.select("s").join(ends.withColumn("own", F.lit(0)), "s", "left").select("s", (n + F.coalesce("own", F.lit(1))).alias("most")), "most")
    paths.append(path)
    merged = None
    for _ in range(max_levels):
        reached = reduce(DataFrame.union, seen)
        open_ = reached.groupBy("s").agg(F.count("*").alias("n")).join(most, "s").where("n < most").select("s")
        ahead = _along(levels[-1].join(open_, "s", "left_semi"), edges, small, "src", "dst", "paths")
        level, path = write_table(ahead.join(reached, ["s", "id"], "left_anti"), "level")
        paths.append(path)
        if level.isEmpty():
            break
        levels.append(level)
        seen.append(level.select("s", "id"))
        if len(seen) >= MERGE_LEVELS:  # so that long paths don't make long plans
            whole, path = write_table(reduce(DataFrame.union, seen), "seen")
            if merged:
                delete_path(g.spark, merged)
            seen, merged = [whole], path
    paths += [merged] if merged else []
    # Backwards: what a node passes on to its parents is its share of paths.
    none = levels[0].limit(0).select("s", "id", F.lit(0.0).alias("dependency"))
    total = State(none.select("id", "dependency"), "dependencies")
    below = none
    for depth in range(len(levels) - 1, 1, -1):  # down to 1 only: a source is no inner node of its own paths
        child = levels[depth].join(below, ["s", "id"], "left").select("s", "id", ((1 + F.coalesce("dependency", F.lit(0.0))) / F.col("paths")).alias("share"))
        passed = levels[depth - 1].join(_along(child, edges, small, "dst", "src", "share"), ["s", "id"]).select("s", "id", (F.col("paths") * F.col("share")).alias("dependency"))
        below, path = write_table(passed, "below")
        paths.append(path)
        total.set(total.df.union(below.select("id", "dependency")).groupBy("id").agg(F.sum("dependency").alias("dependency")))
    scores, kept = write_table(g.nodes.join(total.df, "id", "left").select("id", F.coalesce("dependency", F.lit(0.0)).alias("score")), "scores")
    for spent in paths:
        delete_path(g.spark, spent)
    return scores, kept

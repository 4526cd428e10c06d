"""Triangle counts from one enumeration of undirected triangles.

Edges are turned from the end of lower degree to that of higher degree, so no
node has more than sqrt(2m) out-edges and wedges stay below m^1.5 whatever the
hubs.  Lists remember which directions of an edge exist; a triangle's six
readings tell how many directed patterns it holds.  Self loops are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from skein.model import Graph
from skein.plans.scratch import materialize


def oriented(g: Graph) -> DataFrame:
    """``(a, b, ab, ba)``: each undirected edge once, from lower to higher (degree, id), with its directions."""
    pairs = g.edges.where("src <> dst").groupBy(F.least("src", "dst").alias("lo"), F.greatest("src", "dst").alias("hi")).agg(F.max((F.col("src") < F.col("dst")).cast("int")).alias("up"), F.max((F.col("src") > F.col("dst")).cast("int")).alias("down"))
    pairs = materialize(pairs, "pairs")
    degree = pairs.select(F.explode(F.array("lo", "hi")).alias("id")).groupBy("id").agg(F.count("*").alias("d"))
    both = pairs.join(degree.select(F.col("id").alias("lo"), F.col("d").alias("dlo")), "lo").join(degree.select(F.col("id").alias("hi"), F.col("d").alias("dhi")), "hi")
    keep = F.struct("dlo", "lo") < F.struct("dhi", "hi")
    pick = lambda x, y: F.when(keep, F.col(x)).otherwise(F.col(y))
    return both.select(pick("lo", "hi").alias("a"), pick("hi", "lo").alias("b"), pick("up", "down").alias("ab"), pick("down", "up").alias("ba"))


def _lists(e: DataFrame) -> DataFrame:
    """``(id, out, back, both)``: a node's neighbours of higher degree, by which directions of the edge exist."""
    kind = lambda up, down: F.collect_list(F.when((F.col("ab") == up) & (F.col("ba") == down), F.col("b")))
    return e.groupBy(F.col("a").alias("id")).agg(kind(1, 0).alias("out"), kind(0, 1).alias("back"), kind(1, 1).alias("both"))


def triangle_counts(g: Graph) -> DataFrame:
    """One row: ``trust`` (u->v, u->w, v->w), ``cycle`` (directed three-cycles) and ``triangles`` (undirected, once each).

    An edge x-y carries y's list to x, where both lists are intersected, so a wedge
    travels as eight bytes of a list and not as a row of its own.
    """
    e = materialize(oriented(g), "oriented")
    lists = materialize(_lists(e), "lists")
    of = lambda x: lists.select(F.col("id").alias(x), *(F.col(c).alias(f"{x}_{c}") for c in ("out", "back", "both")))
    sides = e.select(F.col("a").alias("x"), F.col("b").alias("y"), "ab", "ba").join(of("y"), "y").drop("y").join(of("x"), "x")
    # Neighbours of x or y: all, those that it has an edge to, and those that have one to it.
    every = lambda x: F.concat(f"{x}_out", f"{x}_back", f"{x}_both")
    to = lambda x: F.concat(f"{x}_out", f"{x}_both")
    by = lambda x: F.concat(f"{x}_back", f"{x}_both")
    found = sides.withColumn("z", F.array_intersect(every("x"), every("y"))).where(F.size("z") > 0)
    n = lambda left, right: F.size(F.array_intersect(F.array_intersect("z", left), right))
    found = found.select("ab", "ba", F.size("z").alias("z"), n(to("x"), to("y")).alias("oo"), n(to("x"), by("y")).alias("oi"), n(by("x"), to("y")).alias("io"), n(by("x"), by("y")).alias("ii"))
    zero = lambda c: F.coalesce(F.sum(c.cast("long")), F.lit(0)).cast("long")
    up, down = F.col("ab"), F.col("ba")
    trust = up * (F.col("oo") + F.col("oi") + F.col("ii")) + down * (F.col("oo") + F.col("io") + F.col("ii"))
    return found.agg(zero(trust).alias("trust"), zero(up * F.col("io") + down * F.col("oi")).alias("cycle"), zero(F.col("z")).alias("triangles"))


def common_neighbours(g: Graph, left: int, right: int) -> DataFrame:
    """``(id)``: nodes that both have an edge to."""
    out = g.edges.where(F.col("src").isin(left, right)).groupBy(F.col("dst").alias("id")).agg(F.count_distinct("src").alias("n"))
    return out.where(F.col("n") == (1 if left == right else 2)).select("id").orderBy("id")


def intersect_lists(left: Column, right: Column) -> Column:
    """Common members of two list columns, sorted and without repeats."""
    return F.sort_array(F.array_intersect(left, right))

"""Synthetic graphs, fixed by their seed and made in parallel from row numbers."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Draws are whole numbers below this prime.
_PRIME = 2147483647


def draw_sql(step: int, seed: int) -> str:
    """A number from 0 to _PRIME - 1 for a row (column ``id``) and a step, as SQL of 64-bit whole numbers that any engine computes alike."""
    x = f"((id * 48271 + {(step * 40692 + seed * 69621 + 12345) % _PRIME}) % {_PRIME})"
    for factor in (16807, 39373):
        x = f"(({x} * {factor}) % {_PRIME})"
        x = f"(({x} * ({x} % 65521 + 1) + {step + 1}) % {_PRIME})"
    return x


def rmat_sql(scale: int, seed: int = 1, a: float = 0.57, b: float = 0.19, c: float = 0.19) -> tuple[str, str]:
    """SQL of an edge's ends: each bit of them falls into a quadrant."""
    src, dst = [], []
    first, second, third = (int(x * _PRIME) for x in (a, a + b, a + b + c))
    for bit in range(scale):
        u = draw_sql(bit, seed)
        src.append(f"case when {u} >= {second} then {1 << (scale - 1 - bit)} else 0 end")
        dst.append(f"case when ({u} >= {first} and {u} < {second}) or {u} >= {third} then {1 << (scale - 1 - bit)} else 0 end")
    return " + ".join(src), " + ".join(dst)


def rmat(spark: SparkSession, scale: int, edge_factor: int = 16, seed: int = 1, a: float = 0.57, b: float = 0.19, c: float = 0.19) -> DataFrame:
    """Kronecker-like edges over 2^scale ids.

    Self loops and repeats are left out, so there are at most
    ``edge_factor * 2^scale`` edges.
    """
    src, dst = rmat_sql(scale, seed, a, b, c)
    return _ends(spark.range(edge_factor << scale), src, dst)


def uniform_sql(scale: int, seed: int = 1) -> tuple[str, str]:
    """SQL of uniform ends."""
    return f"{draw_sql(0, seed)} % {1 << scale}", f"{draw_sql(1, seed)} % {1 << scale}"


def uniform(spark: SparkSession, scale: int, edge_factor: int = 16, seed: int = 1) -> DataFrame:
    """Edges with uniform ends over 2^scale ids; self loops and repeats are left out."""
    return _ends(spark.range(edge_factor << scale), *uniform_sql(scale, seed))


def _ends(rows: DataFrame, src: str, dst: str) -> DataFrame:
    return _clean(rows.select(F.expr(src).cast("long").alias("src"), F.expr(dst).cast("long").alias("dst")))


def _clean(edges: DataFrame) -> DataFrame:
    return edges.where("src <> dst").distinct().withColumn("weight", F.lit(0))


def star(spark: SparkSession, n: int) -> DataFrame:
    """Edges from node 1 to nodes 2..n+1."""
    return spark.range(n).select(F.lit(1).cast("long").alias("src"), (F.col("id") + 2).alias("dst"), F.lit(0).alias("weight"))


def chain(spark: SparkSession, n: int) -> DataFrame:
    """Edges from each of n nodes to the next."""
    return spark.range(n).select("id", (F.col("id") + 1).alias("dst"), F.lit(0).alias("weight")).withColumnRenamed("id", "src")

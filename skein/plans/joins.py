"""Joins that broadcast only what has been counted and measured."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Rows, and bytes of their values, of what may be broadcast.
BROADCAST_ROWS, BROADCAST_BYTES = 400_000, 64 << 20


def _width(df: DataFrame) -> Column:
    """Bytes of a row's values, roughly: texts by their length, arrays and maps by what they hold as text, all else as 16."""
    plain = [F.lit(16)]
    for f in df.schema.fields:
        c = F.col(f"`{f.name}`")
        if f.dataType.typeName() in ("string", "binary"):
            plain.append(F.coalesce(F.octet_length(c), F.lit(0)) + 16)
        elif f.dataType.typeName() in ("array", "map", "struct", "variant"):
            plain.append(F.coalesce(F.octet_length(F.to_json(F.struct(c))), F.lit(0)) + 16)
        else:
            plain.append(F.lit(16))
    return sum(plain[1:], plain[0])


def fits(df: DataFrame, rows: int = BROADCAST_ROWS, size: int = BROADCAST_BYTES) -> bool:
    """Whether ``df`` has at most ``rows`` rows and ``size`` bytes; looks at ``rows + 1`` rows of them at most."""
    found = df.limit(rows + 1).agg(F.count("*").alias("n"), F.coalesce(F.sum(_width(df)), F.lit(0)).alias("size")).first()
    return found["n"] <= rows and found["size"] <= size


def attach(left: DataFrame, right: DataFrame, on: Sequence[str], how: str = "left", rows: int = BROADCAST_ROWS) -> DataFrame:
    """Join a materialised ``right`` to ``left``.

    ``right`` is broadcast if counting its rows and bytes proves it small.  Otherwise both sides are
    shuffled and the adaptive planner splits the partitions that a hot key fills.
    """
    return left.join(F.broadcast(right) if fits(right, rows) else right, list(on), how)

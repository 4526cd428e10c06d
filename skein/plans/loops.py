"""Bounded driver loops over tables that are written once a round."""

from __future__ import annotations

from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame

from skein.plans.deal import deal
from skein.plans.scratch import delete_path, write_table


class State:
    """The table a loop carries; each new version replaces the one before."""

    def __init__(self, df: DataFrame, label: str = "state") -> None:
        self.label = label
        self.df, self._path = write_table(df, label)

    def set(self, df: DataFrame) -> DataFrame:
        """Write the next version, then drop the last."""
        old = self._path
        self.df, self._path = write_table(df, self.label)
        delete_path(self.df.sparkSession, old)
        return self.df


@contextmanager
def dealt_by(df: DataFrame, *keys: str) -> Iterator[DataFrame]:
    """``df`` dealt by its keys, sorted and kept for as long as a loop joins to it on them.

    Joins on the keys then move and sort the other side only.  What a lost executor
    kept is computed again.
    """
    dealt = deal(df, *keys)
    kept = (df.repartition(*keys) if dealt is df else dealt).sortWithinPartitions(*keys).persist()
    try:
        yield kept
    finally:
        kept.unpersist()

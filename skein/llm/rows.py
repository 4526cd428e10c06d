"""Taking rows out of a documents table by identity, without moving texts if it can be helped."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from skein.plans.joins import fits
from skein.plans.scratch import materialize


def text_key(text: str = "text") -> Column:
    """With the id, what tells a row from others that carry the same id."""
    return F.xxhash64(F.coalesce(F.col(text), F.lit("")))


def without(docs: DataFrame, gone: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """Rows of ``docs`` that are not in ``gone(gone_id, gone_key)``; all columns stay.

    Null ids are compared like values.  ``gone`` is broadcast if counting proves
    it small, else both sides are shuffled by id and text key.
    """
    gone = materialize(gone.distinct(), "gone")
    side = F.broadcast(gone) if fits(gone) else gone
    return docs.join(side, docs[doc_id].eqNullSafe(side["gone_id"]) & (text_key(text) == side["gone_key"]), "left_anti")

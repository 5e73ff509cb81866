"""Keys of texts: two 64-bit hashes with different seeds, taken together."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from kinfrag.plans.scratch import materialize

#: Rows of keys that are broadcast, at most.
BROADCAST = 200_000


def text_key(text: Column) -> list[Column]:
    return [F.xxhash64(text).alias("k1"), F.xxhash64(F.lit("second"), text).alias("k2")]


def small(df: DataFrame, rows: int) -> DataFrame:
    """``df``, which has ``rows`` rows, broadcast only while that is within the bound."""
    return F.broadcast(df) if rows <= BROADCAST else df


def without(docs: DataFrame, gone: DataFrame) -> DataFrame:
    """The rows of ``docs`` whose text has none of the keys ``k1``, ``k2`` of ``gone``; columns may have any name."""
    gone = materialize(gone.select("k1", "k2").distinct(), "keys-gone")
    # Rows are packed, so that no column of theirs can clash with a key.
    wide = docs.select(F.struct("*").alias("row"), *text_key(F.col("text")))
    return wide.join(small(gone, gone.count()), ["k1", "k2"], "left_anti").select("row.*")

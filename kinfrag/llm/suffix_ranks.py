"""Distributed prefix doubling: ranks of positions by the strings that begin there.

Every position has the rank of its first symbol. Two ranks at a growing offset make the rank of a
string of twice the length: Spark sorts the distinct pairs and numbers them in their order. A position
whose pair is unique is given up, and with it every position whose string would reach into it. So after
the last round, at the wanted length, positions are left whose strings stand elsewhere too, ranked in
the order of a suffix array.

All steps are joins, counts and range-partitioned sorts of rows of a position and two numbers; each
round is written, and the one before deleted.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kinfrag.plans.scratch import mark, materialize, sweep


def reranked(pairs: DataFrame, keys: list[str]) -> DataFrame:
    """Rows of ``keys``, ``pos``, ``a`` and ``b`` by the ``rank`` of their pair; those with a unique pair are left out."""
    repeated = pairs.groupBy("a", "b").agg(F.count("*").alias("times")).where("times > 1").select("a", "b")
    # Numbers grow along the sorted partitions; they are written, so every reader sees the same.
    ranked = materialize(repeated.orderBy("a", "b").withColumn("rank", F.monotonically_increasing_id()), "suffix-names")
    return materialize(pairs.join(ranked, ["a", "b"]).select(*keys, "pos", "rank"), "suffix-ranks")


def suffix_ranks(symbols: DataFrame, keys: list[str], length: int) -> DataFrame:
    """Positions whose ``length`` symbols stand at another position too: ``keys``, ``pos`` and ``rank``.

    ``symbols`` has the ``keys`` of a stream, ``pos`` in it and ``symbol``, a number that orders the
    symbols. Strings never cross streams; a stream of fewer symbols has none. Null keys match nothing.
    """
    spark = symbols.sparkSession
    since = mark(spark)
    alive = reranked(symbols.select(*keys, "pos", F.col("symbol").alias("a"), F.lit(0).cast("long").alias("b")), keys)
    sweep(spark, since, keep=1)
    size = 1
    while size < length and not alive.isEmpty():
        step = min(size, length - size)
        after = alive.select(*keys, (F.col("pos") - step).alias("pos"), F.col("rank").alias("b"))
        pairs = alive.withColumnRenamed("rank", "a").join(after, [*keys, "pos"])
        alive = reranked(pairs, keys)
        sweep(spark, since, keep=1)
        size += step
    return alive

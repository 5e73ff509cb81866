"""Connected components of a graph of any size, by alternating large and small stars.

Every step is a grouped minimum (summed up before it is shuffled) and a join with the edges; the
edges are written to the shared folder after each round, and those of the round before deleted. No component comes to the driver or into
one task.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kinfrag.plans.scratch import mark, materialize, sweep

#: Edges of one file of a round, about, so that the last rounds don't read many small ones.
FILE_EDGES = 50_000


def _stars(edges: DataFrame, large: bool) -> DataFrame:
    both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
    if not large:
        both = both.where("b < a")
    least = both.groupBy("a").agg(F.min("b").alias("m")).withColumn("m", F.least("a", "m"))
    met = both.join(least, "a")
    out = met.where("b > a") if large else met
    out = out.select(F.col("b").alias("a"), F.col("m").alias("b"))
    if not large:
        out = out.unionByName(least.select("a", F.col("m").alias("b")))
    return out.where("a != b").distinct()


def components(edges: DataFrame) -> DataFrame:
    """``node`` and ``root`` (the smallest node that it reaches) of every node of ``edges`` (long ``a`` and ``b``)."""
    spark, since = edges.sparkSession, mark(edges.sparkSession)
    edges = edges.where("a != b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct()
    edges = materialize(edges, "component-edges")
    last, count = None, edges.count()
    while True:
        edges = materialize(_stars(_stars(edges, True), False).coalesce(1 + count // FILE_EDGES), "component-edges")
        seen = edges.agg(F.count("*"), F.bit_xor(F.xxhash64("a", "b")), F.bit_xor(F.xxhash64("b", "a", F.lit(1)))).first()
        sweep(spark, since, keep=1)
        if seen == last:
            break
        last, count = seen, seen[0]
    roots = edges.select(F.col("b").alias("node")).distinct()
    return edges.select(F.col("a").alias("node"), F.col("b").alias("root")).unionByName(roots.withColumn("root", F.col("node")))

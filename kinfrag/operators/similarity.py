"""Pairwise similarities of terms, as tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from kinfrag.schema import SIM

#: Fixed values of the five-term example.
EXAMPLE = [
    ("Asthma", "Cough", 0.2),
    ("Asthma", "Influenza", 0.2),
    ("Asthma", "Tibial Fracture", 0.1429),
    ("Asthma", "Ulna Fracture", 0.1429),
    ("Cough", "Influenza", 0.2),
    ("Cough", "Tibial Fracture", 0.1429),
    ("Cough", "Ulna Fracture", 0.1429),
    ("Influenza", "Tibial Fracture", 0.1429),
    ("Influenza", "Ulna Fracture", 0.1429),
    ("Tibial Fracture", "Ulna Fracture", 0.3333),
]


def example(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(EXAMPLE, SIM)


def from_lengths(lengths: DataFrame) -> DataFrame:
    """Similarities ``1.0 / length`` of ``term1``, ``term2``, ``length`` rows, in canonical form."""
    return canonical(lengths.where(F.col("length") >= 1).select("term1", "term2", (F.lit(1.0) / F.col("length")).alias("simvalue")))


def canonical(pairs: DataFrame) -> DataFrame:
    """Each pair once with ``term1 < term2`` (the greatest of its values); equal terms are 1 and left out."""
    ordered = pairs.where(F.col("term1") != F.col("term2")).select(F.least("term1", "term2").alias("term1"), F.greatest("term1", "term2").alias("term2"), "simvalue")
    return ordered.groupBy("term1", "term2").agg(F.max("simvalue").alias("simvalue"))


def symmetric(sim: DataFrame) -> DataFrame:
    """Both orientations of a canonical table."""
    return sim.select("term1", "term2", "simvalue").union(sim.select("term2", "term1", "simvalue"))


def terms_of(sim: DataFrame) -> DataFrame:
    return sim.select(F.col("term1").alias("term")).union(sim.select("term2")).distinct()


def lookup(pairs: DataFrame, sim: DataFrame) -> DataFrame:
    """``simvalue`` for rows of ``term1`` and ``term2`` in either order: 1 if equal, 0 if unknown."""
    keyed = pairs.select("term1", "term2", F.least("term1", "term2").alias("low"), F.greatest("term1", "term2").alias("high"))
    known = sim.select(F.col("term1").alias("low"), F.col("term2").alias("high"), "simvalue")
    value = F.when(F.col("low") == F.col("high"), 1.0).otherwise(F.coalesce("simvalue", F.lit(0.0)))
    return keyed.join(known, ["low", "high"], "left").select("term1", "term2", value.alias("simvalue"))

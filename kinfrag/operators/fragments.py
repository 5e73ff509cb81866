"""Horizontal fragments of the primary relation, and those derived from it."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kinfrag.schema import UNASSIGNED, FragmentationSpec

#: Terms of an assignment table that are broadcast, at most.
BROADCAST_TERMS = 200_000


def fragment_primary(rows: DataFrame, assign: DataFrame, spec: FragmentationSpec) -> DataFrame:
    """``rows`` with the ``frag_id`` of their term; ``UNASSIGNED`` where the model doesn't know it."""
    table = assign.select(F.col("term").alias(spec.attribute), "frag_id")
    if assign.count() <= BROADCAST_TERMS:
        table = F.broadcast(table)
    return rows.join(table, spec.attribute, "left").select(*rows.columns, F.coalesce("frag_id", F.lit(UNASSIGNED)).alias("frag_id"))


def fragment_derived(rows: DataFrame, primary: DataFrame, spec: FragmentationSpec) -> DataFrame:
    """``rows`` once for every fragment in which their key has a primary row."""
    homes = primary.select(spec.key, "frag_id").distinct()
    return rows.join(homes, spec.key).select(*rows.columns, "frag_id")


def localized(fragmented: DataFrame, spec: FragmentationSpec, union_distinct: bool = False) -> DataFrame:
    """The primary relation from all fragments; with ``union_distinct`` as a union that drops equal rows."""
    rows = fragmented.drop("frag_id")
    return rows.distinct() if union_distinct else rows


def with_cuis(rows: DataFrame, cuis: DataFrame, spec: FragmentationSpec) -> DataFrame:
    """``rows`` of the primary relation with the identifier of their term (``term``, ``cui``) where they have none."""
    known = cuis.groupBy(F.col("term").alias(spec.attribute)).agg(F.max("cui").alias("_known"))
    if known.count() <= BROADCAST_TERMS:
        known = F.broadcast(known)
    return rows.join(known, spec.attribute, "left").withColumn("cui", F.coalesce("cui", "_known")).select(*rows.columns)

"""Running sums over groups of any size, without a group in one task."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Rows that one window of a running sum holds, about; buckets that one window of their sums holds.
BUCKET_ROWS, FAN = 4_096, 4_096


def running_sum(df: DataFrame, group: str, order: list[str], weight: Column, rows: int, out: str) -> DataFrame:
    """Adds ``out``: the sum of ``weight`` over the rows of the same ``group`` that come before.

    Rows are ordered by hash bucket of ``order`` and by ``order`` in it. The buckets (about
    ``BUCKET_ROWS`` of ``rows`` each) are summed first, and buckets of ``FAN`` buckets before that, as
    many levels as it takes; so a group with a third of all rows is spread over as many tasks as it
    has buckets, and no window holds more than one level's share of it. Equal rows are counted before
    anything moves and dealt out again at the end. ``group`` must not be null.
    """
    own = df.columns
    buckets = max(1, -(-rows // BUCKET_ROWS))
    counted = df.groupBy(*own).agg(F.count("*").alias("_times"))
    placed = counted.withColumns({"_bucket": F.pmod(F.xxhash64(*order), F.lit(buckets)), "_weight": weight})
    level = placed.groupBy(group, "_bucket").agg(F.sum(F.col("_weight") * F.col("_times")).alias("_sum"))
    within = Window.partitionBy(group, "_bucket").orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    before = F.coalesce(F.sum(F.col("_weight") * F.col("_times")).over(within), F.lit(0))
    return (
        placed.join(_offsets(level, group, buckets), [group, "_bucket"])
        .withColumn("_first", F.col("_offset") + before)
        .withColumn("_part", F.explode(F.expr(f"sequence(0L, (_times - 1) div {FAN})")))
        .withColumn("_nth", F.explode(F.expr(f"sequence(_part * {FAN}, least(_times, (_part + 1) * {FAN}) - 1)")))
        .withColumn(out, F.col("_first") + F.col("_nth") * F.col("_weight"))
        .select(*own, out)
    )


def _offsets(level: DataFrame, group: str, buckets: int) -> DataFrame:
    """The sum of all buckets of a group before each: ``group``, ``_bucket`` and ``_offset``."""
    before = Window.partitionBy(group, "_above").orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
    inside = level.withColumn("_above", F.expr(f"_bucket div {FAN}")).withColumn("_inside", F.coalesce(F.sum("_sum").over(before), F.lit(0)))
    if buckets <= FAN:
        return inside.select(group, "_bucket", F.col("_inside").alias("_offset"))
    above = level.groupBy(group, F.expr(f"_bucket div {FAN}").alias("_bucket")).agg(F.sum("_sum").alias("_sum"))
    above = _offsets(above, group, -(-buckets // FAN)).select(group, F.col("_bucket").alias("_above"), F.col("_offset").alias("_base"))
    return inside.join(above, [group, "_above"]).select(group, "_bucket", (F.col("_inside") + F.col("_base")).alias("_offset"))

"""A training corpus from ``documents`` in five stages, each on all that the one before it kept."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from kinfrag.llm import decontaminate, kd_shards, mixing, near_dups, quality
from kinfrag.llm.keys import small, text_key, without
from kinfrag.plans.scratch import mark, materialize, sweep


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality rules keep."""
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    verdicts = quality.judged_documents(docs, labels)
    return without(docs, verdicts.where(~F.col("kept")))


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates: that of the smallest id, once."""
    keys = ["k1", "k2", "k3"]
    kept = near_dups.grouped_documents(docs).where("kept").groupBy("k1", "k2", F.xxhash64("doc_id").alias("k3")).agg(F.count("*").alias("rows"))
    kept = materialize(kept, "pipeline-kept")
    # Rows are packed, so that no column of theirs can clash with a key.
    wide = docs.select(F.struct("*").alias("row"), *text_key(F.col("text")), F.xxhash64("doc_id").alias("k3"))
    out = wide.join(small(kept.where("rows = 1").select(*keys), kept.count()), keys, "left_semi")
    again = kept.where("rows > 1").select(*keys)
    if not again.isEmpty():
        out = out.unionByName(wide.join(small(again, again.count()), keys, "left_semi").dropDuplicates(keys))
    return out.select("row.*")


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the benchmark doesn't contaminate."""
    verdicts = decontaminate.judged_documents(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))
    return without(docs, verdicts.where("contaminated"))


def source_mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix of sources takes them."""
    return mixing.mixed_copies(docs)


def sharding(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document's shard and slot."""
    return kd_shards.kd_shards(docs)


STAGES = [
    ("quality rules", quality_rules),
    ("near-duplicates", near_dedup),
    ("decontamination", decontamination),
    ("source mix", source_mix),
    ("sharding", sharding),
]

#: SQL can't express the isolation forest; the tests hold every stage against a plain version.
ORACLE_SQL: str | None = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; each stage's rows are written, and read again by the next.

    What a stage has written besides is deleted once its rows are. ``documents`` may have columns of any
    name; nulls, empty texts, repeated rows and empty tables are handled as each operator says.
    """
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    since = mark(spark)
    for name, stage in STAGES[:-1]:
        docs = materialize(stage(spark, docs, sf_dir), "pipeline-" + name.replace(" ", "-"))
        sweep(spark, since, keep=1)
    return STAGES[-1][1](spark, docs, sf_dir)

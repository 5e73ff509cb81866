"""Tables written between the steps of an iterative plan.

They go to the shared folder that the session names in ``spark.checkpoint.dir`` (or has set as its
checkpoint directory); only where there is none (local tests) a folder beside the warehouse is used, with
a warning unless the session is local. Results may read them until ``sweep`` deletes them.
"""

from __future__ import annotations

import uuid
import warnings

from pyspark.sql import DataFrame, SparkSession

_written: dict[str, list[str]] = {}


def scratch_root(spark: SparkSession) -> str:
    root = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not root:
        root = spark.conf.get("spark.sql.warehouse.dir").rstrip("/") + "/_scratch"
        if not spark.sparkContext.master.startswith("local"):
            warnings.warn(f"spark.checkpoint.dir is not set; tables between steps go to {root}, which all executors must share", stacklevel=3)
    return root.rstrip("/")


def materialize(df: DataFrame, label: str) -> DataFrame:
    """Write ``df`` as Parquet into the shared folder and read it back, which cuts its lineage."""
    spark = df.sparkSession
    path = f"{scratch_root(spark)}/{label}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    _written.setdefault(spark.sparkContext.applicationId, []).append(path)
    return spark.read.schema(df.schema).parquet(path)


def mark(spark: SparkSession) -> int:
    """How many tables this session has written so far that are still there."""
    return len(_written.get(spark.sparkContext.applicationId, []))


def sweep(spark: SparkSession, since: int = 0, keep: int = 0) -> int:
    """Delete the tables that this session has written after its first ``since``, but for the last ``keep``, and say how many."""
    own = _written.get(spark.sparkContext.applicationId, [])
    stop = max(since, len(own) - keep)
    paths, own[since:stop] = own[since:stop], []
    for path in paths:
        where = spark._jvm.org.apache.hadoop.fs.Path(path)
        where.getFileSystem(spark._jsc.hadoopConfiguration()).delete(where, True)
    return len(paths)

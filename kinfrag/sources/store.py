"""Where the relations lie: logical tables and their fragments, as Parquet partitioned by fragment.

One physical layout serves both ways to look at fragments: a relation's table with a ``frag_id``, and
one view ``NAME_<i>`` for each fragment. The logical tables are the un-fragmented relations, with
every row once. What replaces a table is written beside it as a new version, which counts once it is whole.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from kinfrag.operators.fragments import fragment_derived, fragment_primary
from kinfrag.plans.scratch import materialize
from kinfrag.schema import ASSIGN, FragmentationSpec
from kinfrag.sources.files import latest


@dataclass
class Store:
    """The relations of ``spec`` under the folder ``path``."""

    spark: SparkSession
    path: str
    spec: FragmentationSpec

    def logical_path(self, table: str) -> str:
        return self._current(table.lower())

    def fragment_path(self, table: str) -> str:
        return self._current(f"{table.lower()}_f")

    def _versions(self, folder: str) -> list[int]:
        """The finished versions of a table, in order."""
        root = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.path}/{folder}")
        fs = root.getFileSystem(self.spark._jsc.hadoopConfiguration())
        if not fs.exists(root):
            return []
        names = [str(x.getPath().getName()) for x in fs.listStatus(root)]
        path = self.spark._jvm.org.apache.hadoop.fs.Path
        return sorted(int(n[1:]) for n in names if n[:1] == "v" and n[1:].isdigit() and fs.exists(path(f"{self.path}/{folder}/{n}/_SUCCESS")))

    def _current(self, folder: str) -> str:
        return f"{self.path}/{folder}/v{(self._versions(folder) or [0])[-1]}"

    def _replace(self, folder: str, rows: DataFrame, *by: str) -> None:
        """Write a new version of a table; it counts from when it is whole, and older ones go then."""
        old = self._versions(folder)
        writer = rows.write.mode("overwrite").option("mapreduce.fileoutputcommitter.marksuccessfuljobs", "true")
        writer.partitionBy(*by).parquet(f"{self.path}/{folder}/v{old[-1] + 1 if old else 0}")
        for n in old:
            self._delete(f"{self.path}/{folder}/v{n}")

    def _delete(self, path: str) -> None:
        where = self.spark._jvm.org.apache.hadoop.fs.Path(path)
        where.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(where, True)

    def logical(self, table: str) -> DataFrame:
        return self.spark.read.schema(T.StructType(self.spec.schemas[table].fields)).parquet(self.logical_path(table))

    def fragmented(self, table: str) -> DataFrame:
        schema = T.StructType([*self.spec.schemas[table].fields, T.StructField("frag_id", T.IntegerType())])
        return self.spark.read.schema(schema).parquet(self.fragment_path(table))

    def fragment(self, table: str, number: int) -> DataFrame:
        return self.fragmented(table).where(F.col("frag_id") == number).drop("frag_id")

    @property
    def assign(self) -> DataFrame:
        return self.spark.read.schema(ASSIGN).parquet(self._current("assign"))

    @property
    def is_fragmented(self) -> bool:
        return bool(self._versions("assign"))

    def create(self, tables: dict[str, DataFrame], assign: DataFrame | None = None) -> None:
        """Write the relations, each row of equal keys once, and with ``assign`` their fragments."""
        for name in self.spec.schemas:
            rows = tables[name].select(*self.spec.columns(name)).dropDuplicates(list(self.spec.keys[name]))
            self._replace(name.lower(), rows)
        if assign is not None:
            self._replace("assign", assign.select("term", "frag_id").coalesce(1))
            self.rebuild()

    def rebuild(self) -> None:
        """Write all fragments anew from the logical tables. Each fragment's files come from all tasks that hold rows of it."""
        primary = fragment_primary(self.logical(self.spec.primary), self.assign, self.spec)
        self._write(self.spec.primary, primary)
        for name in self.spec.derived:
            self._write(name, fragment_derived(self.logical(name), self.fragmented(self.spec.primary), self.spec))

    def _write(self, table: str, rows: DataFrame) -> None:
        # The rebalance gathers small pieces of a fragment and splits a large one over tasks.
        self._replace(f"{table.lower()}_f", rows.hint("rebalance", F.col("frag_id")), "frag_id")

    def _add(self, table: str, rows: DataFrame) -> None:
        rows.hint("rebalance", F.col("frag_id")).write.mode("append").partitionBy("frag_id").parquet(self.fragment_path(table))

    def append(self, table: str, rows: DataFrame) -> None:
        """Add rows to a relation and to its fragments; those whose keys it has already are left out.

        New rows of the primary relation bring the rows of their persons into their fragments.
        """
        spec, keys = self.spec, list(self.spec.keys[table])
        new = rows.select(*spec.columns(table)).dropDuplicates(keys).join(self.logical(table).select(*keys), keys, "left_anti").select(*spec.columns(table))
        new = materialize(new, "store-new")
        if self.is_fragmented:
            if table == spec.primary:
                placed = materialize(fragment_primary(new, self.assign, spec), "store-placed")
                homes = placed.select(spec.key, "frag_id").distinct().join(self.fragmented(table).select(spec.key, "frag_id"), [spec.key, "frag_id"], "left_anti")
                homes = materialize(homes, "store-homes")
                for name in spec.derived:
                    self._add(name, fragment_derived(self.logical(name), homes, spec))
                self._add(table, placed)
            else:
                self._add(table, fragment_derived(new, self.fragmented(spec.primary), spec))
        new.write.mode("append").parquet(self.logical_path(table))

    def upsert(self, table: str, rows: DataFrame) -> None:
        """Add rows, which replace those of the same keys, and bring the fragments up to date."""
        columns, keys = self.spec.columns(table), list(self.spec.keys[table])
        both = self.logical(table).withColumn("_new", F.lit(0)).unionByName(rows.select(*columns).withColumn("_new", F.lit(1)))
        self._replace(table.lower(), latest(both, keys, "_new").select(*columns))
        if self.is_fragmented:
            self.rebuild()

    def clear(self) -> None:
        """Empty all relations and their fragments."""
        for name, schema in self.spec.schemas.items():
            empty = self.spark.createDataFrame([], schema)
            self._replace(name.lower(), empty)
            self._replace(f"{name.lower()}_f", empty.withColumn("frag_id", F.lit(0)), "frag_id")

    def drop(self) -> None:
        """Delete the folder with all its tables, where there is one."""
        self._delete(self.path)

    def save_as_tables(self, prefix: str = "") -> None:
        """Register the relations in the catalog by ``prefix`` and name."""
        for name in self.spec.schemas:
            self.spark.sql(f"DROP TABLE IF EXISTS {prefix}{name}")
            self.logical(name).write.mode("overwrite").saveAsTable(f"{prefix}{name}")

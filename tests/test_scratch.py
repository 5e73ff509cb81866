import os

import pytest

from kinfrag.plans import scratch


def test_tables_go_to_the_shared_folder_and_are_swept(spark):
    df = scratch.materialize(spark.range(5), "some")
    path = df.inputFiles()[0].removeprefix("file://")
    assert path.startswith(scratch.scratch_root(spark)) and df.count() == 5
    assert scratch.sweep(spark) >= 1 and not os.path.exists(path)
    assert scratch.sweep(spark) == 0


def test_folder_beside_the_warehouse_where_none_is_named(spark):
    class Conf:
        def get(self, key, default=None):
            return "/w/" if key == "spark.sql.warehouse.dir" else None

    class Context:
        master = "spark://host:7077"

        def getCheckpointDir(self):
            return None

    class Session:
        conf, sparkContext = Conf(), Context()

    with pytest.warns(UserWarning, match="spark.checkpoint.dir"):
        assert scratch.scratch_root(Session()) == "/w/_scratch"


def test_sweep_of_a_part(spark):
    before = scratch.mark(spark)
    kept = [scratch.materialize(spark.range(i + 1), "part") for i in range(4)]
    assert scratch.sweep(spark, before + 1, keep=1) == 2 and scratch.mark(spark) == before + 2
    assert (kept[0].count(), kept[3].count()) == (1, 4)
    assert scratch.sweep(spark, before) == 2 and scratch.sweep(spark, before) == 0

import zlib
from collections import defaultdict

from kinfrag.llm import kd_shards as kd
from kinfrag.llm.catalog import op4_kd_shards
from kinfrag.llm.kd_shards import kd_shards
from kinfrag.llm.running import running_sum
from pyspark.sql import functions as F


def verify(docs, out, shards, near=None):
    assert sorted((i is None, i or 0, len((t or "").encode()) + 8, zlib.crc32((t or "").encode())) for i, t in docs) == sorted(
        (r.doc_id is None, r.doc_id or 0, r.size, r.text_crc32) for r in out
    )
    slots, size, homes = defaultdict(list), defaultdict(int), defaultdict(set)
    for r in out:
        assert (r.law, r.grown_shard) == ("bytes", None) and 0 <= r.shard < shards
        slots[r.shard].append(r.slot)
        size[r.shard] += r.size
        homes[r.size, r.text_crc32].add(r.shard)
    assert all(sorted(s) == list(range(len(s))) for s in slots.values())
    assert all(len(h) == 1 for h in homes.values())
    if near:
        mean = sum(size.values()) / shards
        assert all(abs(size[s] - mean) <= near * mean for s in range(shards))


def test_even_with_groups_ties_and_nulls(spark):
    docs = [(i, "ab" * (i % 37 + 1) + str(i % 900)) for i in range(2500)] + [(None, None), (None, None), (7, ""), (7, "")]
    df = spark.createDataFrame([(i, t, 1, "q") for i, t in docs], "doc_id long, text string, size int, shard string")
    verify(docs, kd_shards(df, 6).collect(), 6, near=0.05)


def test_group_larger_than_a_shard_stays_whole(spark):
    docs = [(i, "copy " * 40) for i in range(400)] + [(1000 + i, f"own text {i} " * 10) for i in range(900)]
    out = kd_shards(spark.createDataFrame(docs, "doc_id long, text string"), 8).collect()
    verify(docs, out, 8)
    rest = defaultdict(int)
    for r in out:
        if r.doc_id >= 1000:
            rest[r.shard] += r.size
    assert len(rest) == 7 and max(rest.values()) < 1.1 * min(rest.values())


def test_small_and_empty_tables(spark):
    assert kd_shards(spark.createDataFrame([], "doc_id long, text string"), 4).count() == 0
    verify([(1, "x")], kd_shards(spark.createDataFrame([(1, "x")], "doc_id long, text string"), 4).collect(), 4)


def cut_dimensions(node):
    return [] if node.left is None else [node.dim, *cut_dimensions(node.left), *cut_dimensions(node.right)]


def test_the_tree_cuts_along_the_widest_dimension(spark):
    # Half of the texts have many lines and the others none; all have about the same size.
    docs = [(i, ("a b\n" if i % 2 else "a bc") * (100 + i % 3)) for i in range(400)]
    docs = [(i, t + f"{i:04d}") for i, t in docs]
    rows = kd.materialize(kd.metadata(spark.createDataFrame(docs, "doc_id long, text string")), "test")
    root = kd.Node(0, 4)
    kd.build_tree(rows, root)
    assert cut_dimensions(root)[0] in kd.DIMENSIONS
    placed = rows.select("doc_id", kd.shard_of(root).alias("shard")).collect()
    # A naive version: the widest dimension of all rows at the weighted median.
    keys = {r.doc_id: r for r in rows.collect()}
    first = root.dim
    left = {r.doc_id for r in placed if r.shard < 2}
    order = sorted(keys.values(), key=lambda r: r[f"key_{first}"])
    half, at, want = sum(r.size for r in order) / 2, 0, set()
    for r in order:
        if at + r.size / 2 < half:
            want.add(r.doc_id)
        at += r.size
    assert len(left ^ want) <= 1


def test_cuts_are_along_metadata(spark, sf_dir):
    rows = kd.materialize(kd.metadata(spark.read.parquet(f"{sf_dir}/documents.parquet")), "test")
    root = kd.Node(0, 24)
    kd.build_tree(rows, root)
    assert len(cut_dimensions(root)) == 23 and len(set(cut_dimensions(root))) >= 3


def test_a_very_long_text(spark):
    docs = [(i, f"text {i} " * 20) for i in range(300)] + [(1000, "long words " * 400_000)]
    out = kd_shards(spark.createDataFrame(docs, "doc_id long, text string"), 6).collect()
    verify(docs, out, 6)
    assert sum(r.shard == next(x.shard for x in out if x.doc_id == 1000) for r in out) == 1


def test_target_bytes(spark):
    docs = [(i, "x" * 92 + f"{i:04d}") for i in range(100)]
    out = kd_shards(spark.createDataFrame(docs, "doc_id long, text string"), None, target_bytes=1100).collect()
    verify(docs, out, 10, near=0.1)


def test_running_sum(spark, monkeypatch):
    monkeypatch.setattr("kinfrag.llm.running.BUCKET_ROWS", 7)
    monkeypatch.setattr("kinfrag.llm.running.FAN", 3)
    df = spark.range(200).select((F.col("id") % 3).alias("g"), "id", (F.col("id") % 5 + 1).alias("w"))
    by = defaultdict(list)
    for r in running_sum(df, "g", ["id"], F.col("w"), 200, "start").collect():
        by[r.g].append((r.start, r.start + r.w))
    for spans in by.values():
        spans.sort()
        assert spans[0][0] == 0 and all(a[1] == b[0] for a, b in zip(spans, spans[1:], strict=False))


def test_running_sum_of_equal_rows(spark):
    df = spark.createDataFrame([("a", 1, 3)] * 5000 + [("a", 2, 4), ("b", 1, 3)], "g string, id int, w int")
    out = running_sum(df, "g", ["id"], F.col("w"), 5002, "start").collect()
    spans = sorted((r.start, r.start + r.w) for r in out if r.g == "a")
    assert len(out) == 5002 and spans[0][0] == 0 and all(a[1] == b[0] for a, b in zip(spans, spans[1:], strict=False))


def test_query_on_the_table(spark, sf_dir):
    docs = [(r.doc_id, r.text) for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()]
    verify(docs, op4_kd_shards(spark, sf_dir).collect(), 24)

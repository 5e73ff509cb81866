import re
from collections import defaultdict

import pytest

from kinfrag.llm import mixing
from kinfrag.llm.catalog import op6_mixing
from pyspark.sql import functions as F


def words(text):
    return len(re.findall(r"[^\x20\x09-\x0D]+", text or ""))


def water(sizes):
    """Targets by resharing the excess until no source is above its bound."""
    weight = {s: float(i % 3 + 1) for i, s in enumerate(sorted(sizes, key=lambda s: (s is None, (s or "").encode())))}
    full, total = {}, sum(sizes.values())
    while True:
        open_ = [s for s in sizes if s not in full]
        left = total - sum(full.values())
        share = sum(weight[s] for s in open_)
        above = [s for s in open_ if left * weight[s] / share >= 3 * sizes[s]] if share else []
        if not above:
            return full | {s: left * weight[s] / share for s in open_}
        full |= {s: 3.0 * sizes[s] for s in above}


def verify(docs, out):
    sizes, taken, target = defaultdict(int), defaultdict(int), {}
    for _, s, t in docs:
        sizes[s] += words(t)
    want = water(sizes)
    assert len(out) == len(docs)
    source = {i: s for i, s, _ in docs}
    assert sorted((r.doc_id, r.size) for r in out) == sorted((i, words(t)) for i, _, t in docs)
    for r in out:
        assert r.source_size == sizes[source[r.doc_id]] and 0 <= r.taken <= 3 * r.size
        taken[source[r.doc_id]] += r.taken
        target[source[r.doc_id]] = r.target
    for s in sizes:
        assert target[s] == pytest.approx(want[s], rel=1e-9) and abs(taken[s] - want[s]) <= 1


def test_targets_ties_nulls_and_hot_source(spark):
    docs = [(i, None if i % 50 == 0 else f"s{i % 7}", "w " * (i % 90)) for i in range(600)]
    docs += [(1000 + i, "big", "word\n" * 300) for i in range(60)] + [(2000, "tiny", "a b c"), (2001, "none", None), (2002, "é", " "), (2003, "", "x\xa0y z")]
    df = spark.createDataFrame([(*d, 5, "n") for d in docs], "doc_id long, source string, text string, taken int, skey string")
    first = mixing.mix(df).collect()
    verify(docs, first)
    assert sorted(first) == sorted(mixing.mix(df.repartition(7)).collect())


def test_all_sources_can_meet_their_bound(spark):
    docs = [(1, "a", "w " * 10), (2, "b", "w " * 1000)]
    verify(docs, mixing.mix(spark.createDataFrame(docs, "doc_id long, source string, text string")).collect())
    docs = [(1, "a", ""), (2, "b", None)]
    assert [(r.taken, r.target) for r in mixing.mix(spark.createDataFrame(docs, "doc_id long, source string, text string")).collect()] == [(0, 0.0)] * 2
    assert mixing.mix(spark.createDataFrame([], "doc_id long, source string, text string")).count() == 0


def test_repeated_rows_and_null_ids(spark):
    docs = [(3, "a", "w " * 100), (3, "a", "w " * 100), (None, "a", "v " * 100), (None, "b", "v " * 500)]
    out = mixing.mix(spark.createDataFrame(docs, "doc_id long, source string, text string")).collect()
    assert sorted((r.doc_id or 0, r.size) for r in out) == [(0, 100), (0, 500), (3, 100), (3, 100)]


@pytest.mark.parametrize("n", [1, 2, 7, 64, 1001])
def test_permutation_is_one(spark, n):
    there = spark.range(n).select("id", mixing.permuted(F.col("id"), F.lit(n), F.lit("k")).alias("to"))
    back = there.select("id", "to", mixing.permuted(F.col("to"), F.lit(n), F.lit("k"), backwards=True).alias("back")).collect()
    assert sorted(r.to for r in back) == list(range(n)) and all(r.id == r.back for r in back)


def test_draws_keep_shard_sizes_and_source_totals(spark):
    want = {"a": 5000, "b": 1, "c": 777, "d": 12_000, "e": 40}
    out = mixing.shard_draws(spark.createDataFrame(list(want.items()), "skey string, slots long"), 16, 3).collect()
    got, shard, spans = defaultdict(int), defaultdict(int), defaultdict(list)
    for r in out:
        got[r.skey] += r.n
        shard[r.shard] += r.n
        spans[r.skey].append((r.shard, r.first, r.n))
    assert got == want and len(shard) == 16 and max(shard.values()) - min(shard.values()) <= 1
    for s in spans.values():
        at = 0
        for _, first, n in sorted(s):
            assert first == at
            at += n
    # Counts are those of a multinomial: about as far from their means as chance has it.
    mean = sum(want.values()) / 16
    for k in ("a", "d"):
        p = want[k] / sum(want.values())
        off = [(r.n - mean * p) / (mean * p * (1 - p)) ** 0.5 for r in out if r.skey == k]
        assert 0.3 < sum(x * x for x in off) / 16 < 3 and max(map(abs, off)) < 5


def test_draws_of_nothing(spark):
    assert mixing.shard_draws(spark.createDataFrame([], "skey string, slots long"), 4).count() == 0


@pytest.mark.parametrize("target", [25_010.0, 30_000.0, 9_999.0, 10_000.0, 10_063.0, 1.0])
def test_slots_over_shards(spark, target):
    targets = spark.createDataFrame([("sa", "a", 10_000, target), ("sb", "b", 333, 900.0), ("sc", "c", 64, 0.2)], "skey string, source string, source_size long, target double")
    out = mixing.slots(targets, 64, 4).collect()
    for key, size, want in (("sa", 10_000, target), ("sb", 333, 900.0), ("sc", 64, 0)):
        own = [r for r in out if r.skey == key]
        assert sum(r.words for r in own) == want
        blocks = -(-size // 64)
        for p in {r["pass"] for r in own}:
            here = [r for r in own if r["pass"] == p]
            assert len({r.block for r in here}) == len(here) == len({r.slot for r in here})
            if p < want // size:
                assert sorted(r.block for r in here) == list(range(blocks))
        assert all(0 < r.words <= min(64, size - 64 * r.block) for r in own)


def test_takes_equal_a_plain_version(spark, monkeypatch):
    monkeypatch.setattr(mixing, "CHUNK", 5)
    docs = [(i, f"s{i % 3}", "w " * (i * 7 % 150)) for i in range(120)]
    df = spark.createDataFrame(docs, "doc_id long, source string, text string")
    kept = {}

    def keep(frame, label):
        kept[label] = out = real(frame, label)
        return out

    real = mixing.materialize
    monkeypatch.setattr(mixing, "materialize", keep)
    out = {r.doc_id: r for r in mixing.mix(df, block=10, shards=5).collect()}
    place = {r.doc_id: (r.skey, r.start, r.size) for r in kept["mix-lines"].collect()}
    covered = defaultdict(list)
    for r in mixing.slots(kept["mix-targets"], 10, 5).collect():
        covered[r.skey] += [(r.block * 10 + k, r.shard) for k in range(r.words)]
    for i, _, _ in docs:
        skey, start, size = place.get(i, (None, 0, 0))
        own = [shard for at, shard in covered.get(skey, []) if start <= at < start + size]
        assert (out[i].taken, out[i].n_shards) == (len(own), len(set(own)))


def test_shards_are_in_the_plan(spark):
    df = spark.createDataFrame([(1, "a", "x y z")], "doc_id long, source string, text string")
    assert "shard" in mixing.mix(df)._jdf.queryExecution().optimizedPlan().toString()


def test_a_very_long_text(spark):
    docs = [(1, "a", "word " * 300_000), (2, "b", "w " * 50), (3, "b", "v " * 70_000)]
    verify(docs, mixing.mix(spark.createDataFrame(docs, "doc_id long, source string, text string")).collect())


def test_query_on_the_table(spark, sf_dir):
    docs = [(r.doc_id, r.source, r.text) for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()]
    verify(docs, op6_mixing(spark, sf_dir).collect())

import random
from collections import Counter, defaultdict

import corpus_pipeline as cp
from tests.llm.test_decontaminate import brute as contaminated
from tests.llm.test_mixing import water, words
from tests.llm.test_near_dups import brute as components
from tests.llm.test_quality import brute as counts

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def write(spark, path, docs, labels, bench):
    spark.createDataFrame([(i, t, "en", s, len(t or "")) for i, t, s in docs], "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{path}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{path}/labels.parquet")
    spark.createDataFrame(bench, "item_id long, text string").write.parquet(f"{path}/benchmark.parquet")


def corpus():
    rng = random.Random(6)
    word = lambda: "".join(rng.choice("abcdefghij") for _ in range(rng.randint(2, 8)))
    text = lambda n: [word() for _ in range(n)]
    bench = [(i, " ".join(text(30))) for i in range(5)]
    docs = []
    for i in range(400):
        own = text(rng.randint(60, 200))
        if i % 17 == 0:
            own = [w + "###" for w in own]
        elif i % 19 == 0:
            own[20:20] = rng.choice(bench)[1].split()
        docs.append([i, " ".join(own), None if i % 50 == 3 else f"s{i % 4}"])
    for i in range(60):
        own = docs[100 + i][1].split()
        if i % 2:
            own[5] = word()
        docs.append([1000 + i, " ".join(own), "s9"])
    docs += [[5000, None, "s1"], [5001, "", "s1"], [5002, "short text", "s1"], [101, docs[101][1], docs[101][2]], [None, " ".join(text(80)), "s2"]]
    labels = [(i, 0 if i % 17 == 0 else 1, 0) for i in range(0, 400, 2)]
    return docs, labels, bench


def test_every_stage_against_a_plain_version(spark, tmp_path):
    docs, labels, bench = corpus()
    sf = str(tmp_path)
    write(spark, sf, docs, labels, bench)
    here = spark.read.parquet(f"{sf}/documents.parquet")

    def step(k, df):
        df = cp.STAGES[k][1](spark, df, sf)
        assert df.columns == COLUMNS
        out = cp.materialize(df, "test")
        return out, [(r.doc_id, r.text, r.source) for r in out.collect()]

    df, rows = step(0, here)
    want = [tuple(d) for d in docs if counts(d[1])[0] >= 50 and "###" not in d[1]]
    assert sorted(map(repr, rows)) == sorted(map(repr, want))

    df, rows = step(1, df)
    group = dict.fromkeys(d for d, _, g in components([r[:2] for r in want]) if d == g)
    assert sorted(map(repr, rows)) == sorted(repr(r) for r in dict.fromkeys(want) if r[0] in group)

    before = rows
    df, rows = step(2, df)
    assert sorted(map(repr, rows)) == sorted(repr(r) for r in before if not contaminated(r[1], bench)[-1])

    before = rows
    df, rows = step(3, df)
    times = Counter(rows)
    assert set(times) <= set(before) and max(times.values()) <= 3
    size, got = defaultdict(int), defaultdict(int)
    for r in before:
        size[r[2]] += words(r[1])
        got[r[2]] += words(r[1]) * times[r]
    for s, target in water(size).items():
        assert abs(got[s] - target) <= 0.25 * target

    out = cp.STAGES[4][1](spark, df, sf).collect()
    assert Counter(r.doc_id for r in out) == Counter(r[0] for r in rows)
    assert sorted(map(repr, cp.run(spark, sf).collect())) == sorted(map(repr, out))


HOSTILE = ["__k1", "__k2", "__s", "__copies", "k1", "k2", "k3", "s", "row", "copy", "copies", "rows", "node", "skey", "size", "shard", "kept", "path", "start", "block", "TAKEN"]


def test_columns_of_any_name_pass_through_every_stage(spark, tmp_path):
    docs, labels, bench = corpus()
    sf = str(tmp_path / "sf")
    write(spark, sf, docs[:80] + docs[400:430] + docs[-1:], labels, bench)
    df = spark.read.parquet(f"{sf}/documents.parquet").selectExpr("*", *(f"doc_id AS `{c}`" for c in HOSTILE))
    for _, stage in cp.STAGES[:-1]:
        df = cp.materialize(stage(spark, df, sf), "test")
        assert df.columns == COLUMNS + HOSTILE
        assert all(r.doc_id == r["__k1"] == r["copies"] == r["TAKEN"] for r in df.collect())
    assert cp.STAGES[-1][1](spark, df, sf).count() == df.count() > 0


def test_empty_tables(spark, tmp_path):
    write(spark, str(tmp_path), [], [], [])
    assert cp.run(spark, str(tmp_path)).count() == 0

import hashlib
import random
import re

import duckdb

from kinfrag.llm import catalog, decontaminate, keys


def words(text):
    lower = "".join(c.lower() if c.isascii() else c for c in text or "")
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", lower)


def brute(text, bench, window=13):
    w, hit, items = words(text), set(), set()
    for item, t in bench:
        b = words(t)
        n = min(window, len(b))
        grams = {tuple(b[i : i + n]) for i in range(len(b) - n + 1)} if n else set()
        for i in range(len(w) - n + 1) if n else ():
            if tuple(w[i : i + n]) in grams:
                hit |= set(range(i, i + n))
                items.add("" if item is None else str(item))
    return len(w), len(hit), len(items), hashlib.sha256(",".join(sorted(items)).encode()).hexdigest(), bool(hit) and 20 * len(hit) >= len(w)


def check(spark, docs, bench, window=13):
    df = spark.createDataFrame([(*d, "x", 0) for d in docs], "doc_id long, text string, words string, k1 int")
    bn = spark.createDataFrame([(*b, "y") for b in bench], "item_id long, text string, phrase string")
    out = decontaminate.contamination(df, bn, window).collect()
    assert sorted(map(repr, ((r.doc_id, *r[1:]) for r in out))) == sorted(repr((i, *brute(t, bench, window))) for i, t in docs)


def corpus():
    rng = random.Random(4)
    vocabulary = [f"w{i}" for i in range(30)] + ["É", "ünd", "42", "the", "The"]
    text = lambda n: " ".join(rng.choice(vocabulary) for _ in range(n))
    bench = [(i, text(rng.choice([1, 5, 12, 13, 14, 30, 60])) if i else "the") for i in range(1, 25)]
    docs = [(i, text(rng.randint(0, 200))) for i in range(120)]
    for i in range(60):
        passage = rng.choice(bench)[1].split()
        a = rng.randint(0, max(0, len(passage) - 13))
        docs.append((1000 + i, text(rng.randint(0, 60)) + "\n" + "-".join(passage[a : a + 20]).upper() + " " + text(rng.randint(0, 300))))
    return docs, bench


def test_equals_brute_force(spark, monkeypatch):
    docs, bench = corpus()
    docs += [(None, None), (7, ""), (7, docs[5][1]), (1000, docs[130][1]), (3000, "?!")] + [(4000 + i, docs[125][1]) for i in range(40)]
    bench += [(None, "w1 w2 w3"), (99, None), (98, ""), (97, "!!"), (5, "w4 w5 the w6"), (96, "zzz unseen term")]
    check(spark, docs, bench)
    check(spark, docs, bench, window=3)
    monkeypatch.setattr(keys, "BROADCAST", 0)
    check(spark, docs, bench)


def test_empty_tables(spark):
    check(spark, [(1, "a b c")], [])
    check(spark, [], [(1, "a b c")])


def test_near_matches(spark):
    docs = spark.createDataFrame([(1, "x q alpha y beta z"), (2, "alpha x x beta"), (3, "beta alpha")], "doc_id long, text string")
    bench = spark.createDataFrame([(1, "alpha beta")], "item_id long, text string")
    phrases = decontaminate.phrases_of(bench)
    leads = decontaminate.leading_terms(phrases, decontaminate.term_counts(docs, phrases.selectExpr("explode(words) term").distinct(), 2))
    index = decontaminate.build_index(docs, leads, 2)
    off = lambda slop: sorted(r.off for r in decontaminate.near_matches(index, leads, 2, slop).collect())
    assert (off(0), off(1), off(2)) == ([], [1], [-2, 1, 2])


def written(spark, run):
    """Bytes that the stages of a run have put into exchanges."""
    store, none, jvm = spark._jsc.sc().statusStore(), spark._jvm.java.util.ArrayList(), spark._jvm

    def total():
        stages = store.stageList(none, False, False, spark.sparkContext._gateway.new_array(jvm.double, 0), none)
        return sum(stages.apply(i).shuffleWriteBytes() for i in range(stages.size()))

    spark._jsc.sc().listenerBus().waitUntilEmpty()
    before = total()
    run()
    spark._jsc.sc().listenerBus().waitUntilEmpty()
    return total() - before


def test_exchanges_grow_in_proportion_to_a_text(spark, monkeypatch):
    monkeypatch.setattr(keys, "BROADCAST", 0)
    rng = random.Random(7)
    bench = spark.createDataFrame([(1, " ".join(f"w{i}" for i in range(20)))], "item_id long, text string")

    def of(n):
        text = " ".join(f"w{rng.randrange(40)}" for _ in range(n))
        docs = spark.createDataFrame([(1, text)], "doc_id long, text string")
        return written(spark, lambda: decontaminate.contamination(docs, bench).collect()) / len(text)

    small, large = of(2_000), of(20_000)
    assert large < 2 * small


def test_a_very_long_text(spark):
    rng = random.Random(8)
    bench = [(1, " ".join(f"w{rng.randrange(50)}" for _ in range(40))), (2, "w1 w2")]
    text = " ".join(f"w{rng.randrange(50)}" for _ in range(60_000))
    check(spark, [(1, text + " " + bench[0][1] + " " + text)], bench)


def test_lists_of_a_frequent_term_are_dealt_out(spark, monkeypatch):
    monkeypatch.setattr(decontaminate, "TERM_ROWS", 20)
    monkeypatch.setattr(keys, "BROADCAST", 0)
    docs, bench = corpus()
    check(spark, docs, bench, window=3)


def test_query_equals_its_sql(spark, sf_dir):
    con = duckdb.connect()
    for t in ("documents", "benchmark"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf_dir}/{t}.parquet'")
    want = con.execute(catalog.oracle_sql()["op10_decontaminate"]).fetchall()
    got = [tuple(r) for r in catalog.op10_decontaminate(spark, sf_dir).collect()]
    assert sorted(map(repr, got)) == sorted(map(repr, want)) and any(r[-1] for r in got)

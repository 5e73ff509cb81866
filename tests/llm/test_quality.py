import random
import re
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from kinfrag.llm import quality, textbytes
from kinfrag.llm.catalog import op9_quality


def brute(text):
    text = text or ""
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    windows = Counter(tuple(words[i : i + 3]) for i in range(len(words) - 2))
    hit = {j for i in range(len(words) - 2) if windows[tuple(words[i : i + 3])] > 1 for j in range(i, i + 3)}
    lines = [x for x in text.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    return len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text)), len(lines) - len(set(lines)), len(hit)


def counted(texts):
    out = []
    for _, _, data, offsets in textbytes.chunks(pa.array(texts, pa.string())):
        found = quality.count_texts(data, offsets)
        out += zip(*(found[c].tolist() for c in quality.COUNTS[:5]), strict=True)
    return out


EDGES = [None, "", " ", "\n", "a", "a b c a b c", "a a a a", "x\n x\nx\n\nx", "é　# *\x0b|\r\n", "\x1c\x85b\x00", "a b\na b\n", "a b c\nb c a b"]


@pytest.mark.parametrize("size", [1, 8, 2_000_000])
def test_counts_equal_brute_force(monkeypatch, size):
    monkeypatch.setattr(textbytes, "CHUNK", size)
    rng = random.Random(3)
    texts = EDGES + ["".join(rng.choice("ab é\n#") for _ in range(rng.randint(0, 200))) for _ in range(200)]
    assert counted(texts) == [brute(t) for t in texts]


@settings(max_examples=150, deadline=None)
@given(st.lists(st.text(alphabet="ab \n\t|ñ😀", max_size=60), max_size=6))
def test_counts_of_random_texts(texts):
    assert counted(texts) == [brute(t) for t in texts]


def test_odd_rows_have_short_paths():
    rng = np.random.default_rng(1)
    good, odd = rng.uniform(0, 0.6, (970, 6)), rng.uniform(0, 0.6, (30, 6))
    odd[np.arange(30), rng.integers(0, 6, 30)] = 0.95
    forest = quality.grow(good, np.ones(6))
    assert np.quantile(quality.mean_path(forest, odd), 0.9) < np.quantile(quality.mean_path(forest, good), 0.1)


def naive_path(tree, row):
    what, where, left, path = tree
    node = 0
    while what[node] >= 0:
        node = left[node] + (1 if row[what[node]] > where[node] else 0)
    return path[node]


def test_paths_equal_a_naive_walk():
    rng = np.random.default_rng(2)
    good, rows = rng.uniform(0, 1, (400, 6)), rng.uniform(0, 1, (50, 6))
    rows[3] = rows[4]
    forest = quality.grow(good, np.ones(6), trees=9, tree_rows=64)
    got = quality.mean_path(forest, rows, 64)
    want = [sum(naive_path(t, r) for t in forest) / 9 / float(quality.path_of(64)) for r in rows]
    assert got == pytest.approx(want, rel=1e-12) and got[3] == got[4]
    # A leaf's path is its depth and that of a search among the rows that the tree was grown from there.
    what, _, left, path = forest[0]
    depth = {0: 0}
    for i in range(len(what)):
        if what[i] >= 0:
            depth[left[i]] = depth[left[i] + 1] = depth[i] + 1
        else:
            assert min(abs(path[i] - depth[i] - float(quality.path_of(n))) for n in range(65)) < 1e-9


def test_ranks_are_shares_below():
    known = quality.Ranks([(0, 0, 6), (0, 5, 3), (0, 9, 1)] + [(i, 2, 10) for i in range(1, 6)])
    got = known(np.array([[0, 2, 2, 2, 2, 2], [5, 2, 2, 2, 2, 2], [9, 1, 3, 2, 2, 2], [7, 2, 2, 2, 2, 2]]))
    assert got[:, 0].tolist() == [0.0, 0.6, 0.9, 0.9] and got[2, 1:3].tolist() == [0.0, 1.0]
    assert known.highest().tolist() == [0.9, 0, 0, 0, 0, 0]


def judged(spark, docs, labels):
    df = spark.createDataFrame([(*d, "x", 1.0) for d in docs], "doc_id long, text string, path string, f0 double")
    lb = spark.createDataFrame(labels, "doc_id long, quality int, n_words string")
    return quality.quality(df, lb).collect()


def corpus(n):
    rng = random.Random(9)
    word = lambda: "".join(rng.choice("abcdefghij") for _ in range(rng.randint(2, 8)))
    docs, labels = [], []
    for i in range(n):
        bad = i % 17 == 0
        docs.append((i, " ".join(word() + ("###" if bad and rng.random() < 0.7 else "") for _ in range(rng.randint(60, 400)))))
        if i % 3 == 0:
            labels.append((i, 1 - bad, "q"))
    return docs, labels


def test_verdicts_nulls_repeats_and_held_out_rows(spark):
    docs, labels = corpus(900)
    more = [(None, None), (5000, ""), (5001, "w " * 400), (1, docs[1][1]), (5002, "two words")]
    out = judged(spark, docs + more, labels + [(None, 0, "q"), (1, None, "q"), (7777, 0, "q")])
    assert len(out) == len(docs) + len(more)
    for r in out:
        n, _, _, _, rep = counts = brute(dict(docs + more)[r.doc_id])
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) == counts
        assert r.base_failed == (n < 50 or 100 * rep > 50 * n) and not (r.base_failed and r.kept)
        if not r.base_failed:
            assert r.kept == (r.doc_id % 17 != 0)


def test_without_labels_and_empty(spark):
    docs, _ = corpus(300)
    out = judged(spark, docs, [])
    assert all(r.base_failed == (brute(dict(docs)[r.doc_id])[0] < 50) for r in out)
    assert sum(r.kept for r in out) > 0.9 * len(out)
    assert judged(spark, [], []) == []


def test_held_out_accuracy_on_the_table(spark):
    sf = "/root/testdata/sf0.1"
    labels = {r.doc_id: r.quality for r in spark.read.parquet(f"{sf}/labels.parquet").collect()}
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    half = spark.read.parquet(f"{sf}/labels.parquet").where("doc_id % 2 = 0")
    out = [r for r in quality.quality(docs, half).collect() if r.doc_id in labels and r.doc_id % 2 and not r.base_failed]
    good = [r.kept for r in out if labels[r.doc_id] == 1]
    bad = [r.kept for r in out if labels[r.doc_id] == 0]
    assert np.mean(good) > 0.99 and np.mean(bad) < 0.05


def test_lines_that_collide_modulo_powers_of_two(spark):
    lines = ["".join("ab"[(bin(i).count("1") + flip) % 2] for i in range(2048)) for flip in (0, 1)]
    assert counted(["\n".join(lines), "\n".join(lines + lines[:1])]) == [(2, 4096, 0, 0, 0), (3, 6144, 0, 1, 0)]


def test_equal_documents_have_one_verdict(spark):
    docs, labels = corpus(300)
    out = judged(spark, docs + [(10_000 + i, docs[i][1]) for i in range(100)], labels)
    kept = {r.doc_id: (r.kept, r.path) for r in out}
    assert all(kept[10_000 + i] == kept[i] for i in range(100))


def test_query_on_the_table(spark, sf_dir):
    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()}
    for r in op9_quality(spark, sf_dir).collect():
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) == brute(texts[r.doc_id])

import random
import re
from itertools import combinations

import numpy as np
import pytest

from kinfrag.llm import near_dups
from kinfrag.llm.catalog import op8_near_dups
from kinfrag.llm.components import components


def shingles(text):
    lower = "".join(c.lower() if c.isascii() else c for c in text or "")
    w = re.findall(r"[^\x20\x09-\x0D]+", lower)
    if len(w) < 5:
        return {tuple(w)} if w else set()
    return {tuple(w[i : i + 5]) for i in range(len(w) - 4)}


def brute(docs):
    """Component of each row, over all pairs that share a shingle."""
    sets = [shingles(t) for _, t in docs]
    root = list(range(len(docs)))

    def find(i):
        while root[i] != i:
            root[i] = root[root[i]]
            i = root[i]
        return i

    where = {}
    for i, s in enumerate(sets):
        for x in s:
            where.setdefault(x, []).append(i)
    seen = {p for w in where.values() for p in combinations(w, 2)}
    for i, j in seen:
        common = len(sets[i] & sets[j])
        if 100 * common >= 75 * (len(sets[i]) + len(sets[j]) - common):
            root[find(i)] = find(j)
    least = {}
    for i, (d, _) in enumerate(docs):
        if d is not None:
            least[find(i)] = min(d, least.get(find(i), d))
    return [(d, len(sets[i]), least.get(find(i)) if sets[i] else d) for i, (d, _) in enumerate(docs)]


def check(spark, docs):
    df = spark.createDataFrame([(*d, 0, "x") for d in docs], "doc_id long, text string, n int, node string")
    out = near_dups.near_dups(df).collect()
    assert sorted(map(repr, ((r.doc_id, r.n_shingles, r.component_id) for r in out))) == sorted(map(repr, brute(docs)))
    assert all(r.kept == (r.doc_id == r.component_id) for r in out)


def corpus(rng, groups=12, copies=8, hot=60):
    word = lambda: "".join(rng.choice("abcdefgé") for _ in range(rng.randint(1, 6)))
    line = " ".join(word() for _ in range(20))
    texts = []
    for g in range(groups):
        base = [word() for _ in range(rng.randint(20, 200))]
        texts.append(" ".join(base))
        for _ in range(hot if g == 0 else copies):
            own = list(base)
            for _ in range(rng.randint(0, max(1, len(base) // 25))):
                own[rng.randrange(len(own))] = word()
            texts.append((" " if rng.random() < 0.5 else "\n").join(own).upper() if rng.random() < 0.2 else " ".join(own))
    texts += [line + " " + " ".join(word() for _ in range(rng.randint(10, 60))) for _ in range(60)]
    texts += [" ".join(word() for _ in range(rng.randint(0, 8))) for _ in range(60)]
    rng.shuffle(texts)
    return list(enumerate(texts))


def test_equals_brute_force(spark):
    docs = corpus(random.Random(1))
    docs += [(None, docs[3][1]), (None, "some words of nobody else at all"), (900, None), (901, ""), (902, " \t\n"), (5, docs[5][1]), (903, "one"), (904, "ONE"), (905, "one two")]
    check(spark, docs)


def test_large_buckets_by_blocks(spark, monkeypatch):
    monkeypatch.setattr(near_dups, "BLOCK", 16)
    monkeypatch.setattr(near_dups, "BROADCAST", 0)
    check(spark, corpus(random.Random(2), groups=5, hot=120))


def test_large_buckets_are_split_by_rare_shingles(spark, monkeypatch):
    # A passage that many share fills buckets whose members are not alike.
    monkeypatch.setattr(near_dups, "BLOCK", 8)
    rng = random.Random(9)
    word = lambda: "".join(rng.choice("abcdefgh") for _ in range(6))
    passage = [word() for _ in range(60)]
    docs = []
    for _ in range(40):
        own = [word() for _ in range(22)]
        docs += [" ".join(passage + own), " ".join(passage + own[:-1] + [word()])]
    check(spark, list(enumerate(docs)))


def test_words_that_collide_modulo_powers_of_two(spark):
    texts = ["".join("ab"[(bin(i).count("1") + flip) % 2] for i in range(2048)) for flip in (0, 1)]
    check(spark, list(enumerate(texts)))


def test_empty_and_single(spark):
    check(spark, [])
    check(spark, [(1, "a b c d e f g")])


def test_spanning_links_connect_what_all_links_do():
    rng = np.random.default_rng(5)
    for _ in range(20):
        base = [rng.choice(2**40, 60, replace=False).astype(np.int64) for _ in range(4)]
        sets = []
        for b in base:
            for _ in range(rng.integers(1, 12)):
                cut = int(rng.integers(0, 14))
                sets.append(np.unique(np.concatenate([b[cut:], rng.integers(2**41, 2**42, cut)])))
        def parts(links):
            root = list(range(len(sets)))
            for a, b in links:
                root = [root[b] if r == root[a] else r for r in root]
            return {frozenset(i for i in range(len(sets)) if root[i] == r) for r in root}
        every = [(i, j) for i, j in combinations(range(len(sets)), 2) if near_dups.similar(len(np.intersect1d(sets[i], sets[j])), len(sets[i]), len(sets[j]))]
        assert parts(near_dups.spanning_links(np.arange(len(sets)), sets)) == parts(every)


def test_pairs_at_the_threshold_meet():
    rng = np.random.default_rng(8)
    met = 0
    for _ in range(400):
        x = rng.integers(0, 2**63, 175, dtype=np.uint64)
        a, b = x[:150], x[25:]  # 125 of 175 in common would be under; 150/200 is the bound
        a, b = np.concatenate([x[:150], x[:0]]), np.concatenate([x[:150], rng.integers(0, 2**63, 50, dtype=np.uint64)])
        s, t = (near_dups.bands(v, np.array([0]))[0] for v in (a, b))
        met += (s[: near_dups.SIDE] == t[: near_dups.SIDE]).any() and (s[near_dups.SIDE :] == t[near_dups.SIDE :]).any()
    assert met >= 397


@pytest.mark.parametrize("n", [1, 30])
def test_components_of_a_path_and_a_star(spark, n):
    edges = [(i, i + 1) for i in range(n)] + [(100, 100 + i) for i in range(1, n + 1)] + [(7000, 7000)]
    got = {r.node: r.root for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {i: 0 for i in range(n + 1)} | {100 + i: 100 for i in range(n + 1)}


def test_query_on_the_table(spark, sf_dir):
    docs = [(r.doc_id, r.text) for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()]
    out = op8_near_dups(spark, sf_dir).collect()
    assert sorted((r.doc_id, r.n_shingles, r.component_id) for r in out) == sorted(brute(docs))

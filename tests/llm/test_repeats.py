import hashlib
import random
from collections import Counter

import numpy as np
import pytest

from kinfrag.llm import anchors, repeats
from kinfrag.llm.catalog import op7_repeats
from kinfrag.llm.suffix_ranks import suffix_ranks

N = anchors.WINDOW


def brute(docs):
    raw = [(t or "").encode() for _, t in docs]
    count = Counter(r[p : p + N] for r in raw for p in range(len(r) - N + 1))
    out = []
    for (i, _), r in zip(docs, raw, strict=True):
        gone = np.zeros(len(r) + 1, bool)
        for p in range(len(r) - N + 1):
            if count[r[p : p + N]] > 1:
                gone[p : p + N] = True
        kept = bytes(b for b, g in zip(r, gone, strict=False) if not g)
        spans = int((gone[1:] & ~gone[:-1]).sum() + gone[0])
        out.append((i, len(r), int(gone.sum()), spans, hashlib.sha256(kept).hexdigest(), kept))
    return out


def check(spark, docs):
    df = spark.createDataFrame([(*d, 1, b"x") for d in docs], "doc_id long, text string, h int, kept binary")
    got = [(r.doc_id, r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256, bytes(r.kept)) for r in repeats.repeats(df).collect()]
    assert sorted(map(repr, got)) == sorted(map(repr, brute(docs)))


def corpus(seed, hot=40):
    rng = random.Random(seed)
    text = lambda n: "".join(rng.choice("abcde é") for _ in range(n))
    passage, long = text(260), text(900)
    docs = []
    for i in range(hot):
        docs.append(text(rng.randint(0, 300)) + passage + text(rng.randint(0, 300)))
    for i in range(20):
        own = list(long)
        for _ in range(rng.randint(0, 3)):
            own[rng.randrange(len(own))] = "z"
        a = rng.randint(0, 600)
        docs.append(text(rng.randint(0, 150)) + "".join(own[a : a + rng.randint(150, 320)]) + text(rng.randint(0, 150)))
    docs += [text(50) * 12, "a" * 700, "ab" * 300, "a" * 199, "b" * 200, "c" * 201, text(400), "", text(150)]
    docs += [long, long, text(199)]
    rng.shuffle(docs)
    return list(enumerate(docs))


@pytest.mark.parametrize("large", [16_384, 3])
def test_equals_brute_force(spark, monkeypatch, large):
    monkeypatch.setattr(repeats, "LARGE", large)
    if large == 3:
        monkeypatch.setattr(repeats, "BROADCAST", 0)
    docs = corpus(large)
    check(spark, docs + [(None, None), (None, docs[1][1]), (5, docs[5][1]), (7, docs[7][1])])


def test_prefix_doubling_over_all_positions_gives_the_same_spans(spark):
    docs = [d for d in corpus(7, hot=6) if len(d[1]) < 1200] + [(5, corpus(7, hot=6)[5][1])]
    df = spark.createDataFrame(docs, "doc_id long, text string")
    plain = {(r.k1, r.k2): r.spans for r in repeats.ranked_spans(df).collect()}
    assert plain == {(r.k1, r.k2): r.spans for r in repeats.repeated_spans(df).collect()} and plain


def test_ranks_are_in_the_order_of_a_suffix_array(spark):
    text = "banana bandana banana"
    rows = spark.createDataFrame([(1, i, ord(c)) for i, c in enumerate(text)], "d long, pos int, symbol long")
    for n in (1, 2, 3, 5, 6):
        got = {r.pos: r["rank"] for r in suffix_ranks(rows, ["d"], n).collect()}
        strings = {p: text[p : p + n] for p in range(len(text) - n + 1)}
        assert set(got) == {p for p, s in strings.items() if list(strings.values()).count(s) > 1}
        assert all((strings[p] < strings[q]) == (got[p] < got[q]) for p in got for q in got)


def test_a_document_of_many_spans(spark):
    rng = random.Random(6)
    text = lambda n: "".join(rng.choice("abcdefgh ") for _ in range(n))
    passage = text(220)
    check(spark, [(1, "".join(passage + text(30) for _ in range(1500))), (2, text(500))])


def test_windows_of_a_large_group_are_not_joined(spark, monkeypatch):
    monkeypatch.setattr(repeats, "LARGE", 3)
    rng = random.Random(9)
    base = "".join(rng.choice("abcdefgh ") for _ in range(500))
    docs = [(i, base[: 20 * i] + chr(65 + i) + base[20 * i + 1 :] + str(i)) for i in range(25)]
    docs += [(30, base), (31, base), (32, base[:230] + "!" + base[231:])]
    made = []
    monkeypatch.setattr(repeats, "settle_large", lambda *a, whole=repeats.settle_large: made.append(whole(*a)) or made[0])
    check(spark, docs)
    plan = made[0]._jdf.queryExecution().optimizedPlan().toString()
    assert made[0].count() and "place" in plan and not any("Join" in x and ("one#" in x or "place#" in x) for x in plan.splitlines())
    # Runs, not windows, leave it: at most one more for each anchor than it has unique stretches.
    assert made[0].where("first > last").isEmpty() and made[0].where("last > first").count() > 0


def test_empty(spark):
    check(spark, [])
    check(spark, [(1, "x" * 199), (2, None)])


@pytest.mark.parametrize("segment", [300, 400_000])
def test_anchors_are_the_least_grams(monkeypatch, segment):
    monkeypatch.setattr(anchors, "SEGMENT", segment)
    rng = random.Random(3)
    docs = [bytes(rng.choice(b"ab") if i % 3 else 97 for _ in range(rng.randint(0, 1200))) for i in range(30)] + [b"abc" * 300, b"", b"x" * 199, b"y" * 200]
    data, offsets = np.frombuffer(b"".join(docs), np.uint8), np.concatenate([[0], np.cumsum([len(d) for d in docs])])
    got = {i: set() for i in range(len(docs))}
    for text, at, _, _, first, last in anchors.found(data, offsets):
        for t, *x in zip(text.tolist(), at.tolist(), first.tolist(), last.tolist(), strict=True):
            got[t].add(tuple(x))
    for i, d in enumerate(docs):
        want = {}
        names = anchors.gram_names(np.frombuffer(d, np.uint8)) if len(d) >= N else ()
        for p in range(len(d) - N + 1):
            want.setdefault(p + int(np.argmin(names[p : p + anchors.SPAN])), []).append(p)
        assert got[i] == {(a, p[0], p[-1]) for a, p in want.items()}


def test_query_on_the_table(spark, sf_dir):
    docs = [(r.doc_id, r.text) for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()]
    assert sorted(map(tuple, op7_repeats(spark, sf_dir).collect())) == sorted(x[:5] for x in brute(docs))

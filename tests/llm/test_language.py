import math
import zlib

import numpy as np
import public_tokenizers
import pytest
import sentencepiece

from kinfrag.llm import language as lg
from kinfrag.llm.catalog import op2_language

KNOWN = lg.vocabulary(lg.VOCABULARY)


PIECES = {p.lower() for p in map(sentencepiece.SentencePieceProcessor(model_file=public_tokenizers.path(lg.VOCABULARY)).id_to_piece, range(32_000))}
ORDER = sorted(p for p in PIECES if p.removeprefix(lg.MARK).isalpha() or p == lg.MARK)
PLACE = {p: i for i, p in enumerate(ORDER)}


def cuts(word):
    """All segmentations of a marked word into pieces and single letters."""
    if not word:
        yield []
    for k in range(1, len(word) + 1):
        if k == 1 or word[:k] in PLACE:
            for rest in cuts(word[k:]):
                yield [word[:k], *rest]


def piece_id(piece):
    return PLACE.get(piece, len(ORDER))


def log_sum(word, p):
    """The sum over all segmentations by exact logarithms, from the front."""
    logs = [0.0]
    for j in range(1, len(word) + 1):
        terms = [logs[i] + math.log(p[piece_id(word[i:j])]) for i in range(j) if j - i == 1 or word[i:j] in PLACE]
        top = max(terms)
        logs.append(top + math.log(sum(math.exp(t - top) for t in terms)))
    return logs[-1]


def model(seed, langs=2):
    rng = np.random.default_rng(seed)
    return np.column_stack([lg.probabilities(rng.random(len(KNOWN) + 1) * 5) for _ in range(langs)])


def test_every_piece_of_letters_is_known():
    assert len(KNOWN) == len(ORDER) > 20_000 and KNOWN.longest == max(map(len, ORDER)) > 12


@pytest.mark.parametrize("word", ["a", "the", "straße", "ño", "語x", "nation", "international", "представляет"])
def test_forward_sums_all_segmentations(word):
    p = model(1)
    got = np.exp(lg.log_sums([word], p, KNOWN)[0, 0])
    want = sum(np.prod([p[piece_id(x), 0] for x in c]) for c in cuts(lg.MARK + word))
    assert got == pytest.approx(want, rel=1e-9)


@pytest.mark.parametrize("word", ["x" * 200, "the" * 70, "語" * 150, "internationalrepresentation" * 12, max(ORDER, key=len).removeprefix(lg.MARK) * 3])
def test_runs_of_any_length(word, monkeypatch):
    p = model(4)
    for window in (50, 4096):
        monkeypatch.setattr(lg, "WINDOW", window)
        assert lg.log_sum(word, p, KNOWN) == pytest.approx([log_sum(lg.MARK + word, p[:, g]) for g in range(2)], rel=1e-9)
    got = lg.log_sums([word, word], p, KNOWN)
    assert np.isfinite(got).all()
    for g in range(2):
        assert got[0, g] == got[1, g] == pytest.approx(log_sum(lg.MARK + word, p[:, g]), rel=1e-9)


def test_expected_counts_are_those_of_all_segmentations():
    p, words, n = model(2)[:, [0]], ["the", "nation", "été", "international"], np.array([3.0, 2.0, 1.0, 4.0])
    want = np.zeros(len(KNOWN) + 1)
    for w, k in zip(words, n, strict=True):
        every = [(c, float(np.prod([p[piece_id(x), 0] for x in c]))) for c in cuts(lg.MARK + w)]
        whole = sum(x for _, x in every)
        for c, weight in every:
            for x in c:
                want[piece_id(x)] += k * weight / whole
    assert lg.expected(words, n, p, KNOWN) == pytest.approx(want, rel=1e-9, abs=1e-12)


def test_expected_counts_of_a_long_run():
    p, word = model(5)[:, [0]], "nationthe" * 25
    got = lg.expected([word], np.array([1.0]), p, KNOWN)
    size = np.array([len(x) for x in ORDER] + [1])
    assert (got * size).sum() == pytest.approx(len(word) + 1, rel=1e-9)  # every letter once


def test_words():
    assert lg.words_of("Été_2x a½b²c 語, don't") == ["été", "x", "a", "b", "c", "語", "don", "t"]
    assert lg.words_of("A" * 100) == ["a" * 100]


TEXTS = {"en": "the house and the water with those other things that were there", "de": "der hund und die katze sind nicht auf dem dach gewesen", "fr": "le chat est dans la maison avec les autres enfants"}


def test_rows(spark, monkeypatch):
    docs = [(i, " ".join(TEXTS[g].split()[i % 5 :]), g) for i in range(120) for g in (sorted(TEXTS)[i % 3],)]
    edge = [(None, "das ist die katze und der hund", "de"), (900, None, "de"), (901, "", "fr"), (902, "12 !? ½", "en"), (903, "THE WATER AND THE HOUSE", None), (904, "и語", None), (5, docs[5][1], docs[5][2])]
    df = spark.createDataFrame([(*d, "s", 0.5) for d in docs + edge], "doc_id long, text string, lang string, source string, score double")
    out = lg.language(df).collect()
    assert len(out) == len(docs) + len(edge)
    truth = {i: g for i, _, g in docs}
    for r in out:
        assert r.held_out == (r.doc_id is not None and zlib.crc32(str(r.doc_id).encode()) % 3 == 1) and 0 <= r.score <= 1
        if r.doc_id in truth:
            assert r.lang_pred == truth[r.doc_id]
        elif r.doc_id in (900, 901, 902):
            assert (r.lang_pred, r.score) == ("und", 0.0)
        elif r.doc_id != 904:
            assert r.lang_pred == ("de" if r.doc_id is None else "en")
    # The label of a row is no input of its prediction.
    swapped = df.selectExpr("doc_id", "text", "CASE WHEN crc32(cast(cast(doc_id AS string) AS binary)) % 3 = 1 THEN 'xx' ELSE lang END AS lang", "source")
    assert sorted(map(repr, lg.language(swapped).collect())) == sorted(map(repr, out))
    monkeypatch.setattr(lg, "BATCH", 10)
    monkeypatch.setattr(lg, "CACHE", 5)
    p = model(3)
    monkeypatch.setattr(lg, "KEPT", 3)
    small, large = lg.Scorer(p, lg.VOCABULARY).score(list(TEXTS.values())), [lg.Scorer(p, lg.VOCABULARY).score([t])[0] for t in TEXTS.values()]
    assert np.allclose(small, large)


def test_equal_scores_take_the_smallest_language(spark):
    docs = [(i, "same words here", g) for i, g in enumerate(["b", "a"] * 30)]
    rows = spark.createDataFrame([d for d in docs if zlib.crc32(str(d[0]).encode()) % 3 != 1][:20] + [(900, "same words here", None)], "doc_id long, text string, lang string")
    n = {r["lang"]: r["count"] for r in rows.groupBy("lang").count().collect()}
    want = "a" if n["a"] >= n["b"] else "b"
    assert {r.lang_pred for r in lg.language(rows).collect()} == {want}


def test_languages_are_bounded(spark, monkeypatch):
    monkeypatch.setattr(lg, "LANGUAGES", 2)
    docs = [(i, TEXTS[g], g) for i in range(90) for g in (sorted(TEXTS)[i % 3],)] + [(1000 + i, TEXTS["en"], "xx") for i in range(2)]
    out = lg.language(spark.createDataFrame([d for d in docs if d[2] != "fr" or d[0] < 9], "doc_id long, text string, lang string")).collect()
    assert {r.lang_pred for r in out} <= {"de", "en"}


def test_nothing_to_learn_from(spark):
    schema = "doc_id long, text string, lang string"
    assert [(r.lang_pred, r.score) for r in lg.language(spark.createDataFrame([(0, "the", None)], schema)).collect()] == [("und", 0.0)]
    assert lg.language(spark.createDataFrame([], schema)).count() == 0


def test_held_out_accuracy(spark):
    sf = "/root/testdata/sf0.01"
    truth = {r.doc_id: r.lang for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    out = [r for r in op2_language(spark, sf).collect() if r.held_out and r.lang_pred != "und"]
    assert np.mean([r.lang_pred == truth[r.doc_id] for r in out]) > 0.97

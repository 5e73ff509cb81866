import public_tokenizers
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from kinfrag.llm import token_counts
from kinfrag.llm.catalog import op1_token_counts

LIBRARY = Tokenizer.from_file(public_tokenizers.path(token_counts.VOCABULARY))


def by_library(text):
    return len(LIBRARY.encode(text or "", add_special_tokens=False).ids)


def by_hand(word):
    """Merges one pair after the other, as a plain list."""
    m = token_counts.merger(token_counts.VOCABULARY)
    symbols = [int(m.inner[b]) for b in word[:-1]] + [int(m.last[word[-1]])]
    ranks = dict(zip(m.keys.tolist(), m.ranks.tolist(), strict=True))
    while True:
        pairs = [(ranks.get(a * m.size + b), i) for i, (a, b) in enumerate(zip(symbols, symbols[1:], strict=False))]
        pairs = [p for p in pairs if p[0] is not None]
        if not pairs:
            return len(symbols)
        rank, i = min(pairs)
        symbols[i : i + 2] = [int(m.merged[rank])]


EDGES = ["", " ", "a", "aaaa aaaaaaa", "<|startoftext|>Hi<|endoftext|> x <|endoftext", "İstanbul ΑΣ ß ǅ", "é ẛ̣", "\x1c\x1da\x85b​d", "we're''s I'LL 12345 ½²ª", "😀 中文字 \U00032808b", "x" * 5000]


@pytest.mark.parametrize("text", EDGES)
def test_edges_equal_the_library(text):
    assert token_counts.merger(token_counts.VOCABULARY).count(text) == by_library(text)


@settings(max_examples=150, deadline=None)
@given(st.lists(st.text(min_size=0, max_size=40), max_size=5))
def test_random_texts_equal_the_library(texts):
    assert token_counts.merger(token_counts.VOCABULARY).count_all(texts) == [by_library(t) for t in texts]


@settings(max_examples=100, deadline=None)
@given(st.lists(st.text(alphabet="abtheín ", min_size=1, max_size=30).map(str.encode), min_size=1, max_size=6))
def test_merging_equals_one_pair_at_a_time(words):
    assert token_counts.merger(token_counts.VOCABULARY).symbol_counts(words).tolist() == [by_hand(w) for w in words]


def test_long_text_is_counted_whole(monkeypatch):
    monkeypatch.setattr(token_counts, "PIECE", 50)
    text = "the thing, İs é and <|endoftext|> more. " * 60 + "z" * 300
    assert token_counts.merger(token_counts.VOCABULARY).count(text) == by_library(text)


def test_rows(spark):
    rows = [(1, None, "x"), (2, "", "y"), (2, "", "y"), (None, "été the", "z"), (3, "word " * 3000, "w")]
    out = token_counts.token_counts(spark.createDataFrame(rows, "doc_id long, text string, n_tokens string")).collect()
    assert sorted((r.doc_id or -1, r.n_bytes, r.n_tokens, r.over_limit) for r in out) == sorted(
        (i or -1, len((t or "").encode()), by_library(t), by_library(t) > 2048) for i, t, _ in rows
    )
    assert token_counts.token_counts(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def test_query_on_the_table(spark, sf_dir):
    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()}
    got = {r.doc_id: r.n_tokens for r in op1_token_counts(spark, sf_dir).collect()}
    assert got == {i: by_library(t) for i, t in texts.items()}

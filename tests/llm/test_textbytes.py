import random

import numpy as np
import pytest

from kinfrag.llm import textbytes as tb


@pytest.fixture
def small_chunks(monkeypatch):
    monkeypatch.setattr(tb, "CHUNK", 64)
    tb.powers.cache_clear()
    yield
    monkeypatch.undo()
    tb.powers.cache_clear()


def test_hashes_of_spans_in_long_data_depend_on_their_bytes_alone(small_chunks):
    rng = random.Random(2)
    raw = bytes(rng.choice(b"ab") for _ in range(1000)) * 2
    data = np.frombuffer(raw, np.uint8)
    spans = [(s, s + n) for s in range(0, 990, 7) for n in (0, 1, 5, 63, 64, 65, 200, 900)]
    spans += [(s + 1000, e + 1000) for s, e in spans if e + 1000 <= 2000]
    starts, ends = (np.array(x) for x in zip(*spans, strict=True))
    for family in (0, 1):
        got = tb.span_hashes(data, starts, ends, family)
        by_bytes = {}
        for h, (s, e) in zip(got.tolist(), spans, strict=True):
            assert by_bytes.setdefault(raw[s:e], h) == h
        assert len(set(by_bytes.values())) == len(by_bytes)


def test_words_end_at_cuts():
    data = np.frombuffer(b"ab cd\x0bef gh", np.uint8)
    starts, ends = tb.word_spans(data, np.array([0, 4, 6, 10, len(data)]))
    assert [bytes(data[s:e]) for s, e in zip(starts, ends, strict=True)] == [b"ab", b"c", b"d", b"ef", b"g", b"h"]


def morse(n, flip):
    return bytes(97 + (bin(i).count("1") + flip) % 2 for i in range(n))


@pytest.mark.parametrize("n", [1024, 2048, 4096])
def test_strings_that_collide_modulo_powers_of_two_do_not(n):
    data = np.frombuffer(morse(n, 0) + morse(n, 1), np.uint8)
    got = [tb.span_hashes(data, np.array([0, n]), np.array([n, 2 * n]), family) for family in (0, 1)]
    assert got[0][0] != got[0][1] and got[1][0] != got[1][1] and got[0][0] != got[1][0]


def test_products_modulo_the_prime():
    rng = np.random.default_rng(4)
    a, b = (np.append(rng.integers(0, tb.PRIME, 500, dtype=np.uint64), np.uint64(tb.PRIME - 1)) for _ in range(2))
    assert [int(x) * int(y) % tb.PRIME for x, y in zip(a, b, strict=True)] == tb.times(a, b).tolist()

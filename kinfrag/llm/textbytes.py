"""Whole texts as arrays of UTF-8 bytes: words, lines and 64-bit hashes of any spans of them.

Words are runs of bytes that are not ``0x20`` or ``0x09``-``0x0D``; these are ASCII, so words of
bytes are words of characters. A span's hash is a polynomial of its bytes modulo a prime of 61 bits, from prefix
sums, so that all spans of a chunk are hashed at once.
"""

from __future__ import annotations

import functools
from collections.abc import Iterator

import numpy as np
import pyarrow as pa

#: Bytes and rows of text that are worked on together; a longer text makes a chunk of its own.
CHUNK, ROWS = 2_000_000, 512

SPACE = np.zeros(256, bool)
SPACE[[0x20, *range(0x09, 0x0E)]] = True
#: A-Z to a-z, all other bytes as they are.
LOWER = np.arange(256, dtype=np.uint8)
LOWER[0x41:0x5B] += 0x20

#: A Mersenne prime, and a base for each of two independent families of hashes.
PRIME = 2**61 - 1
BASES = (1_181_783_497_276_652_981 % PRIME, 767_130_331_852_047_469)
_P = np.uint64(PRIME)
_HALF, _HALF_MASK, _LOW, _LOW_MASK = np.uint64(31), np.uint64(2**31 - 1), np.uint64(30), np.uint64(2**30 - 1)


def reduced(x: np.ndarray) -> np.ndarray:
    """64-bit words modulo ``PRIME``."""
    x = (x & _P) + (x >> np.uint64(61))
    return np.where(x >= _P, x - _P, x)


def times(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Products modulo ``PRIME`` of words under it, from halves of 31 bits."""
    a1, a0, b1, b0 = a >> _HALF, a & _HALF_MASK, b >> _HALF, b & _HALF_MASK
    middle = a1 * b0 + a0 * b1
    # 2**62 is 2, and 2**61 is 1, modulo the prime.
    return reduced(np.uint64(2) * a1 * b1 + (middle >> _LOW) + ((middle & _LOW_MASK) << _HALF) + a0 * b0)


@functools.cache
def powers(family: int) -> tuple[np.ndarray, np.ndarray]:
    """The first powers of the base and of its inverse, as many as a chunk has places."""
    tables = []
    for base in (BASES[family], pow(BASES[family], -1, PRIME)):
        table = np.ones(1, np.uint64)
        while len(table) <= CHUNK:
            table = np.concatenate([table, times(table, np.uint64(pow(base, len(table), PRIME)))])
        tables.append(table[: CHUNK + 1])
    return tables[0], tables[1]


def mixed(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit words that spreads every bit."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _sums(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, family: int) -> np.ndarray:
    """The polynomials of spans of at most ``CHUNK`` bytes of data."""
    up, down = powers(family)
    digit = data.astype(np.uint64) + np.uint64(1)
    total = np.zeros(len(starts), np.uint64)
    # Sums of halves of the products are exact: no prefix of a chunk exceeds 64 bits.
    for shift in (np.uint64(0), np.uint64(32)):
        sums = np.zeros(len(data) + 1, np.uint64)
        np.cumsum(digit * ((up[: len(data)] >> shift) & np.uint64(2**32 - 1)), out=sums[1:])
        part = reduced(sums[ends] - sums[starts])
        total = reduced(total + (times(part, np.uint64(2**32)) if shift else part))
    return times(total, down[starts])


def span_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, family: int = 0) -> np.ndarray:
    """A hash of each span ``data[start:end]``, which depends on its bytes alone."""
    size = len(powers(family)[0]) - 1
    if len(data) <= size:
        out = _sums(data, starts, ends, family)
    else:
        out, order = np.zeros(len(starts), np.uint64), np.argsort(starts, kind="stable")
        at, begins = 0, starts[order]
        while at < len(order):
            low = int(begins[at])
            stop = int(np.searchsorted(begins, low + size // 2 + 1))
            own = order[at:stop]
            inside = ends[own] <= low + size
            own, long = own[inside], own[~inside]
            out[own] = _sums(data[low : low + size], starts[own] - low, ends[own] - low, family)
            for i in long:  # a span of more bytes is the sum of its parts, each raised to its place
                s, total = int(starts[i]), 0
                for p in range(s, int(ends[i]), size):
                    part = data[p : min(p + size, int(ends[i]))]
                    total += int(_sums(part, np.array([0]), np.array([len(part)]), family)[0]) * pow(BASES[family], p - s, PRIME)
                out[i] = total % PRIME
            at = stop
    return mixed(out + (ends - starts).astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93))


def word_spans(data: np.ndarray, cuts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Where the words begin and end; no word runs across one of the ``cuts``."""
    inside = ~SPACE[data]
    before = np.empty(len(data), bool)
    before[:1] = False
    before[1:] = inside[:-1]
    before[cuts[cuts < len(data)]] = False
    starts = np.flatnonzero(inside & ~before)
    after = np.empty(len(data), bool)
    after[-1:] = False
    after[:-1] = inside[1:]
    ends_at = cuts[(cuts > 0) & (cuts <= len(data))] - 1
    after[ends_at] = False
    return starts, np.flatnonzero(inside & ~after) + 1


def chunks(column: pa.Array) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """Parts of a string column: first row, end row, the bytes of their texts, and where each begins.

    Nulls are empty texts. The last offset is the end of the bytes.
    """
    for above in range(0, len(column), ROWS):
        part = column.slice(above, ROWS)
        if part.null_count:
            part = part.fill_null("")
        _, offsets, data = part.buffers()
        size = np.int64 if pa.types.is_large_string(part.type) else np.int32
        at = np.frombuffer(offsets, size)[part.offset : part.offset + len(part) + 1].astype(np.int64)
        raw = np.frombuffer(data or b"", np.uint8)
        row = 0
        while row < len(part):
            end = max(row + 1, int(np.searchsorted(at, at[row] + CHUNK, "right")) - 1)
            yield above + row, above + end, raw[at[row] : at[end]], at[row : end + 1] - at[row]
            row = end


def per_text(mask: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """How many of the bytes of each text are marked."""
    return np.array([np.count_nonzero(mask[a:b]) for a, b in zip(offsets[:-1].tolist(), offsets[1:].tolist(), strict=True)], np.int64)

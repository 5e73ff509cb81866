"""Anchors of byte windows: where two equal windows are sure to meet.

A window of ``WINDOW`` bytes has ``SPAN`` grams of ``GRAM`` bytes. Its anchor is the gram with the
least hash, the leftmost of equal ones: a function of the window's bytes alone, so equal windows have
equal anchors at the same offset. Consecutive windows mostly share their anchor, which leaves about
two anchors for ``SPAN`` bytes. Gram hashes are named at doubling lengths (2, 4, ... bytes) from the
names of their halves.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np

from kinfrag.llm.textbytes import mixed, span_hashes

WINDOW, GRAM = 200, 64
SPAN = WINDOW - GRAM + 1
#: Bytes of text whose grams are hashed together.
SEGMENT = 400_000

_RNG = np.random.default_rng(77)
_BYTES = _RNG.integers(0, 2**64, 256, dtype=np.uint64)
_DOUBLING = _RNG.integers(1, 2**63, 8, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_NONE = np.uint64(2**64 - 1)


def gram_names(data: np.ndarray) -> np.ndarray:
    """A hash of the ``GRAM`` bytes from each place on; shorter than ``data`` by ``GRAM - 1``."""
    name, size = _BYTES[data], 1
    while size < GRAM:
        name = name[:-size] * _DOUBLING[size.bit_length() - 1] + name[size:]
        size *= 2
    return mixed(name)


def sliding(values: np.ndarray, pick: np.ufunc) -> np.ndarray:
    """The least or greatest of ``SPAN`` values from each place on; shorter by ``SPAN - 1``."""
    size = 1
    while 2 * size <= SPAN:
        values = pick(values[:-size], values[size:])
        size *= 2
    rest = SPAN - size
    return pick(values[:-rest], values[rest:]) if rest else values


def runs(data: np.ndarray, cuts: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """All anchors of the texts between ``cuts``: place, hash, first and last window that it is the anchor of."""
    none = np.zeros(0, np.int64)
    if len(data) < WINDOW:
        return none, none.astype(np.uint64), none, none
    names = gram_names(data)
    for c in cuts[1:-1]:
        names[max(0, c - GRAM + 1) : c] = _NONE
    least = sliding(names, np.minimum)
    whole = np.ones(len(least), bool)
    for c in cuts[1:-1]:
        whole[max(0, c - WINDOW + 1) : c] = False
    # A gram is the least of some window if it equals the greatest of its windows' leasts.
    padded = np.zeros(len(names) + SPAN - 1, np.uint64)
    padded[SPAN - 1 : SPAN - 1 + len(least)] = np.where(whole, least, 0)
    at = np.flatnonzero(sliding(padded, np.maximum) == names)
    h = names[at]
    low, high = at - SPAN + 1, at.copy()
    text = np.searchsorted(cuts, at, "right")
    low = np.maximum(low, cuts[text - 1])
    high = np.minimum(high, cuts[text] - WINDOW)
    for step in range(1, SPAN):
        near = np.flatnonzero(at[step:] - at[:-step] < SPAN)
        if not len(near):
            break
        a, b = near, near + step
        lower = h[a] <= h[b]  # the one on the left is no greater: it bounds the windows of the right one
        np.maximum.at(low, b[lower], at[a[lower]] + 1)
        smaller = h[b] < h[a]
        np.minimum.at(high, a[smaller], at[b[smaller]] - SPAN)
    some = (low <= high) & (h != _NONE)
    return at[some], h[some], low[some], high[some]


def found(data: np.ndarray, offsets: np.ndarray) -> Iterator[tuple[np.ndarray, ...]]:
    """Anchors of a chunk's texts in parts: text, place, hash, context, first and last window.

    Places count from the text's first byte. The context hashes all bytes that any window of the anchor's
    run could have: from ``SPAN - 1`` before to ``WINDOW`` after it, as far as the text goes.
    """
    row, n = 0, len(offsets) - 1
    while row < n:
        end = max(row + 1, int(np.searchsorted(offsets, offsets[row] + SEGMENT, "right")) - 1)
        start, stop = int(offsets[row]), int(offsets[end])
        margin = 3 * WINDOW
        for a in range(start, max(stop, start + 1), SEGMENT) if end == row + 1 else (start,):
            b = min(stop, a + SEGMENT) if end == row + 1 else stop
            low, high = max(start, a - margin), min(stop, b + margin)
            cuts = np.unique(np.concatenate([[low, high], offsets[row : end + 1][(offsets[row : end + 1] > low) & (offsets[row : end + 1] < high)]])) - low
            at, h, first, last = runs(data[low:high], cuts)
            own = (at + low >= a) & (at + low < b)
            at, h, first, last = at[own] + low, h[own], first[own] + low, last[own] + low
            text = np.searchsorted(offsets, at, "right") - 1
            left, right = np.maximum(at - SPAN + 1, offsets[text]), np.minimum(at + WINDOW, offsets[text + 1])
            context = span_hashes(data[low:high], left - low, right - low)
            context = mixed(context + (at - left).astype(np.uint64))
            yield text, at - offsets[text], h, context, first - offsets[text], last - offsets[text]
        row = end

"""Language identification by unigram piece models, summed over all segmentations.

The pieces are all those of a fixed public vocabulary that are made of letters (a word's first piece
with its mark). Each language has a probability for every piece. A word's
probability is the sum over all ways to cut it into pieces, by a forward pass over its letters; a
text's is the product over its words. Nothing is decided by a single best segmentation.

Probabilities come from expectation steps (forward and backward) over the word counts of a bounded
sample of labelled rows, about ``SAMPLE`` of each language, picked by a hash; priors count all labelled
rows. The languages are the ``LANGUAGES`` values of ``lang`` with most labelled rows. Words are worked
on in batches of one length as arrays: the pieces at all places of all words are looked up at once by
rolling hashes, which go on only while they begin a piece. Words may have any length: sums are scaled
every ``SLAB`` letters, so that none becomes too small.
"""

from __future__ import annotations

import functools
import math
import os
import pickle
import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from kinfrag.plans.scratch import materialize

VOCABULARY = "piece_bpe_32k.model"
MARK = "▁"
#: Letters after which sums are scaled.
SLAB = 16
#: Labelled rows to learn from, of each language, about; expectation steps; added to each count.
SAMPLE, STEPS, SMOOTHING = 10_000, 2, 0.01
#: Languages that are learned, at most: a bound on the model's size.
LANGUAGES = 256
#: Probability of a letter that the vocabulary doesn't have.
UNKNOWN = 1e-7
#: Scored words that a task keeps; code points of texts, and letters of words, that are worked on together.
CACHE, BATCH, PART = 500_000, 1_000_000, 400_000
#: Letters up to which words are scored together and kept; of a longer one that are scored at once; of a
#: run that is learned from as one word.
KEPT, WINDOW, LEARNED = 64, 4_096, 1_024

_RUN = re.compile(r"[^\W\d_]+")
_BASE = np.uint64(0x9E3779B97F4A7C15)
UNDETERMINED = "und"


def words_of(text: str) -> list[str]:
    """The runs of letters of a text in lower case."""
    found = []
    for w in _RUN.findall(text.lower()):
        if not w.isascii() and not w.isalpha():
            found += "".join(c if c.isalpha() else " " for c in w).split()
        else:
            found.append(w)
    return found


def hashes(pieces: list[str]) -> np.ndarray:
    out = np.zeros(len(pieces), np.uint64)
    for i, p in enumerate(pieces):
        h = 0
        for c in p:
            h = (h * int(_BASE) + ord(c) + 1) % 2**64
        out[i] = h
    return out


@dataclass
class Vocabulary:
    """Sorted hashes of all beginnings of pieces, with the piece that each is (-1 if none), and the number of pieces."""

    begins: np.ndarray
    piece: np.ndarray
    size: int
    longest: int

    def __len__(self) -> int:
        return self.size


@functools.cache
def vocabulary(name: str) -> Vocabulary:
    """The pieces that are scored; a piece's id is its place among the sorted ones."""
    import public_tokenizers
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=name if os.path.sep in name else public_tokenizers.path(name))
    pieces = {model.id_to_piece(i).lower() for i in range(model.get_piece_size())}
    kept = sorted(p for p in pieces if p.removeprefix(MARK).isalpha() or p == MARK)
    place = {p: i for i, p in enumerate(kept)}
    begins = sorted({p[:k] for p in kept for k in range(1, len(p) + 1)})
    names = hashes(begins)
    order = np.argsort(names)
    return Vocabulary(names[order], np.array([place.get(b, -1) for b in begins], np.int32)[order], len(kept), max(map(len, kept)))


#: Where a piece begins, how many letters it has, the words that have it there, and its ids in them.
Edge = tuple[int, int, np.ndarray, np.ndarray]


def lookup(words: list[str], known: Vocabulary) -> list[Edge]:
    """All pieces in words of one length with their marks, by their end; ``len(known)`` is a letter or mark that no piece is."""
    return sorted(edges(letters(MARK + MARK.join(words), len(words)), known), key=lambda e: e[0] + e[1])


def letters(text: str, words: int) -> np.ndarray:
    """Code points of words of one length, one after another: [place, word]."""
    return np.frombuffer(text.encode("utf-32-le"), np.uint32).astype(np.uint64).reshape(words, -1).T


def edges(raw: np.ndarray, known: Vocabulary, starts: int | None = None) -> list[Edge]:
    """All pieces in ``letters``, by their start, which is under ``starts``."""
    found: list[Edge] = []
    n, words = raw.shape
    for i in range(n if starts is None else starts):
        going, h = np.arange(words), np.zeros(words, np.uint64)
        for k in range(min(known.longest, n - i)):
            h = h * _BASE + raw[i + k, going] + np.uint64(1)
            at = np.minimum(np.searchsorted(known.begins, h), len(known.begins) - 1)
            hit = known.begins[at] == h
            ids = np.where(hit, known.piece[at], -1)
            if k == 0:
                found.append((i, 1, going, np.where(ids < 0, len(known), ids)))
            elif (is_piece := ids >= 0).any():
                found.append((i, k + 1, going[is_piece], ids[is_piece]))
            going, h = going[hit], h[hit]
            if not len(going):
                break
    return found


def forward(found: list[Edge], n: int, words: int, p: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Sums over the segmentations of each word's beginnings, scaled, and the logarithms of their scales: [letters, language, word].

    ``p`` has a row for each piece, with one for unknown letters.
    """
    alpha = np.zeros((n + 1, p.shape[1], words))
    scale = np.zeros((n + 1, p.shape[1], words))
    alpha[0] = 1
    at = 0
    for j in range(1, n + 1):
        scale[j] = scale[j - 1]
        while at < len(found) and found[at][0] + found[at][1] == j:
            i, _, who, ids = found[at]
            # Sums of another slab have another scale.
            own = alpha[i][:, who] if i // SLAB == (j - 1) // SLAB or j <= SLAB else alpha[i][:, who] * np.exp(scale[i][:, who] - scale[j][:, who])
            alpha[j][:, who] += own * p[ids].T
            at += 1
        if j % SLAB == 0:
            scale[j] += np.log(alpha[j])
            alpha[j] = 1
    return alpha, scale


def log_sums(words: list[str], p: np.ndarray, known: Vocabulary) -> np.ndarray:
    """The logarithm of the sum over all segmentations of words of one length: [word, language]."""
    n = len(words[0]) + 1
    alpha, scale = forward(lookup(words, known), n, len(words), p)
    return (np.log(alpha[n]) + scale[n]).T


def log_sum(word: str, p: np.ndarray, known: Vocabulary) -> np.ndarray:
    """The same for one word of any length, whose sums are held for ``WINDOW`` letters at a time: [language]."""
    marked, most = MARK + word, known.longest
    log, ahead = np.zeros(p.shape[1]), np.zeros((most + 1, p.shape[1]))
    ahead[0] = 1
    for low in range(0, len(marked), WINDOW):
        size = min(WINDOW, len(marked) - low)
        alpha = np.zeros((size + most + 1, p.shape[1]))
        alpha[: most + 1] = ahead
        at = 0
        for i, k, _, ids in edges(letters(marked[low : low + size + most], 1), known, size):
            while at <= i:
                if at % SLAB == 0:
                    log += np.log(alpha[at])
                    alpha[at : at + most + 1] /= alpha[at].copy()
                at += 1
            alpha[i + k] += alpha[i] * p[ids[0]]
        ahead = alpha[size : size + most + 1]
    return log + np.log(ahead[0])


def by_length(words: list[str]) -> Iterator[tuple[list[int], list[str]]]:
    groups: dict[int, list[int]] = {}
    for i, w in enumerate(words):
        groups.setdefault(len(w), []).append(i)
    for n, at in groups.items():
        step = max(1, PART // (n + 1))
        for i in range(0, len(at), step):
            part = at[i : i + step]
            yield part, [words[j] for j in part]


def expected(words: list[str], counts: np.ndarray, p: np.ndarray | None, known: Vocabulary) -> np.ndarray:
    """How often each piece is used by the words, over all segmentations by their weight under ``p`` (of one language).

    Without ``p``, how often each piece stands anywhere in them.
    """
    total = np.zeros(len(known) + 1)
    for at, part in by_length(words):
        found, n, size = lookup(part, known), counts[at], len(part[0]) + 1
        if p is None:
            for _, _, who, ids in found:
                total += np.bincount(ids, n[who], len(total))
            continue
        alpha, scale = (x[:, 0] for x in forward(found, size, len(part), p))
        # Backward sums by the scales of the forward ones: their product is the share of each place.
        beta = np.zeros((size + 1, len(part)))
        beta[size] = 1 / alpha[size]
        for i, k, who, ids in sorted(found, key=lambda e: -e[0]):
            weight = p[ids, 0] * beta[i + k, who] * np.exp(scale[i, who] - scale[i + k, who])
            beta[i, who] += weight
            total += np.bincount(ids, alpha[i, who] * weight * n[who], len(total))
    return total


def probabilities(counts: np.ndarray) -> np.ndarray:
    """Piece probabilities of one language from counts, smoothed; that of unknown letters is fixed."""
    p = counts + SMOOTHING
    p[-1] = 0
    p /= p.sum()
    p[-1] = UNKNOWN
    return p


def held_out() -> Column:
    """Whether a row is kept from learning: the checksum of its id as text leaves 1 by 3."""
    return F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 3 == 1, F.lit(False))


def word_counts(rows: DataFrame) -> DataFrame:
    """Words of ``lang`` and ``text`` rows with their number: ``lang``, ``word``, ``n``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found: Counter[tuple[str, str]] = Counter()
            for lang, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                found.update((lang, w[i : i + LEARNED]) for w in words_of(text) for i in range(0, len(w), LEARNED))
            keys = list(found)
            yield pa.RecordBatch.from_arrays([pa.array([k[0] for k in keys], pa.string()), pa.array([k[1] for k in keys], pa.string()), pa.array(list(found.values()), pa.int64())], names=["lang", "word", "n"])

    return rows.mapInArrow(run, "lang string, word string, n long").groupBy("lang", "word").agg(F.sum("n").alias("n"))


def learn(docs: DataFrame, name: str = VOCABULARY) -> tuple[list[str], np.ndarray, np.ndarray]:
    """Languages, piece probabilities [piece, language] and log priors from rows of ``doc_id``, ``text``, ``lang``."""
    rows = docs.where(~held_out() & F.col("lang").isNotNull() & F.col("text").isNotNull())
    seen = {r["lang"]: r["count"] for r in rows.groupBy("lang").count().orderBy(F.desc("count"), "lang").limit(LANGUAGES).collect()}
    langs, known = sorted(seen), vocabulary(name)
    if not langs:
        return [], np.zeros((len(known) + 1, 0)), np.zeros(0)
    # Null, and so left out, for a language that isn't learned.
    share = F.coalesce(*(F.when(F.col("lang") == g, F.lit(int(1_000_003 * min(1.0, SAMPLE / seen[g])))) for g in langs))
    sample = rows.where(F.pmod(F.xxhash64("doc_id", "text"), F.lit(1_000_003)) <= share).select("lang", "text")
    counts = materialize(word_counts(sample), "language-words")
    place = {g: i for i, g in enumerate(langs)}
    context = docs.sparkSession.sparkContext
    p: np.ndarray | None = None
    for _ in range(STEPS + 1):
        held = context.broadcast(pickle.dumps(p))

        def run(batches: Iterator[pa.RecordBatch], held=held) -> Iterator[pa.RecordBatch]:
            model, own = pickle.loads(held.value), vocabulary(name)
            total = np.zeros((len(place), len(own) + 1))
            for batch in batches:
                lang = np.array([place[g] for g in batch.column(0).to_pylist()])
                words, n = np.array(batch.column(1).to_pylist(), object), batch.column(2).to_numpy().astype(float)
                for g in np.unique(lang):
                    mine = lang == g
                    total[g] += expected(words[mine].tolist(), n[mine], None if model is None else model[:, [g]], own)
            g, piece = np.nonzero(total)
            yield pa.RecordBatch.from_arrays([pa.array(g, pa.int32()), pa.array(piece, pa.int32()), pa.array(total[g, piece])], names=["g", "piece", "n"])

        found = counts.mapInArrow(run, "g int, piece int, n double").groupBy("g", "piece").agg(F.sum("n").alias("n")).collect()
        total = np.zeros((len(langs), len(known) + 1))
        for r in found:  # at most one for each piece and language
            total[r["g"], r["piece"]] = r["n"]
        p = np.column_stack([probabilities(t) for t in total])
    every = sum(seen.values())
    return langs, p, np.array([math.log(seen[g] / every) for g in langs])


class Scorer:
    """Log probabilities of texts in each language; words that it has met are kept."""

    def __init__(self, p: np.ndarray, name: str):
        self.p, self.known = p, vocabulary(name)
        self.clear()

    def clear(self) -> None:
        self.place: dict[str, int] = {}
        self.logs = np.zeros((0, self.p.shape[1]))

    def score(self, texts: list[str | None]) -> list[np.ndarray | None]:
        """A row of log probabilities for each text; None for those without a letter."""
        out: list[np.ndarray | None] = []
        held, size = [], 0
        for t in texts:
            held.append(words_of(t or ""))
            size += len(t or "")
            if size >= BATCH:
                out += self.settle(held)
                held, size = [], 0
        return out + self.settle(held)

    def settle(self, held: list[list[str]]) -> list[np.ndarray | None]:
        words = set().union(*held)
        long = {w for w in words if len(w) > KEPT}
        fresh = words.difference(self.place, long)
        if len(self.place) + len(fresh) > CACHE:
            self.clear()
            fresh = words - long
        if fresh:
            new = list(fresh)
            self.place.update(zip(new, range(len(self.logs), len(self.logs) + len(new)), strict=True))
            self.logs = np.concatenate([self.logs, self.logs_of(new)])
        extra = {w: log_sum(w, self.p, self.known) for w in long}
        out: list[np.ndarray | None] = []
        for ws in held:
            known = [self.place[w] for w in ws if w not in extra] if extra else [self.place[w] for w in ws]
            total = self.logs[known].sum(0) if known else np.zeros(self.p.shape[1])
            for w in ws if extra else ():
                if w in extra:
                    total = total + extra[w]
            out.append(total if ws else None)
        return out

    def logs_of(self, words: list[str]) -> np.ndarray:
        out = np.empty((len(words), self.p.shape[1]))
        for at, part in by_length(words):
            out[at] = log_sums(part, self.p, self.known)
        return out


def language(docs: DataFrame, name: str = VOCABULARY) -> DataFrame:
    """Per document: ``doc_id``, ``held_out``, ``lang_pred`` and ``score`` (its posterior probability).

    Rows whose id's checksum leaves 1 by 3 are held out of learning, as are rows without text or
    ``lang``; ids, ``lang`` and ``source`` are never inputs of a prediction. A text without a letter, a
    null one, and every text where nothing could be learned is ``und`` with score 0. Among equal
    scores the smallest language wins. Letters that no language tells apart leave the prior. A null id is not held out; repeated rows are judged each;
    other columns are not read.
    """
    narrow = docs.select("doc_id", F.col("text").alias("text"), F.col("lang").alias("lang"))
    langs, p, priors = learn(narrow, name)
    held = docs.sparkSession.sparkContext.broadcast(pickle.dumps((langs, p, priors)))
    rows = narrow.select("doc_id", held_out().alias("held_out"), "text")
    schema = T.StructType([rows.schema["doc_id"], T.StructField("held_out", T.BooleanType()), T.StructField("lang_pred", T.StringType()), T.StructField("score", T.DoubleType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names, model, before = pickle.loads(held.value)
        scorer = Scorer(model, name)
        for batch in batches:
            pred, sure = [], []
            for logs in scorer.score(batch.column(2).to_pylist()) if names else [None] * batch.num_rows:
                if logs is None:
                    pred.append(UNDETERMINED), sure.append(0.0)
                    continue
                logs = logs + before
                best = int(np.argmax(logs))
                pred.append(names[best]), sure.append(float(1 / np.exp(logs - logs[best]).sum()))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(pred, pa.string()), pa.array(sure, pa.float64())], names=schema.names)

    return rows.mapInArrow(run, schema)

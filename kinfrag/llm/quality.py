"""Quality rules: an isolation forest over rule statistics of documents.

One pass over the texts counts what rules look at (words, symbols, repeated lines and word windows,
capitals, ends of sentences), and all later steps read these counts alone. A statistic of a document
is seen as its rank: the share of all documents that have less of it, from an exact histogram of the whole
corpus. So no statistic needs a limit of its own, and a value that few have lies far from the others.

Trees split a random statistic at a random place of all its ranks, until rows stand alone; a document
that few splits set apart is odd. They are grown from a bounded sample of rows that are labelled good (``SAMPLE``
rows; of all documents where there are none), so bad documents are odd even if there are many alike. The
bound on a document's mean path is set from histograms over every labelled row.
"""

from __future__ import annotations

import pickle
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from kinfrag.llm.keys import text_key
from kinfrag.llm.textbytes import chunks, mixed, per_text, span_hashes, word_spans
from kinfrag.plans.scratch import materialize

#: Words that a document must have, and the share of repeated ones it may have, in percent.
LEAST_WORDS, MOST_REPEATED = 50, 50
#: Rows that the trees are grown from, at most.
SAMPLE = 20_000
#: Bins of a statistic's histogram, for each unit of its logarithm.
FINE = 4_096
TREES, TREE_ROWS, SEED = 128, 256, 11
#: Bins of the path lengths, and the share of good labelled rows that the bound may reject.
BINS, FALSE_REJECTS = 2_000, 0.002
#: Path length over that of a random tree under which a document is odd, where nothing is labelled.
UNLABELLED_BOUND = 0.5

COUNTS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines", "n_capitals", "n_marks", "n_digits")

_SYMBOL, _CAPITAL, _MARK, _DIGIT = (np.zeros(256, bool) for _ in range(4))
_SYMBOL[list(b"#*$%&|<>")] = True
_CAPITAL[0x41:0x5B] = True
_MARK[list(b"!?:;=~^_/\\")] = True
_DIGIT[0x30:0x3A] = True


def repeats(keys: np.ndarray) -> np.ndarray:
    """Marks the keys that occur more than once."""
    order = np.argsort(keys, kind="stable")
    same = keys[order[1:]] == keys[order[:-1]]
    marked = np.zeros(len(keys), bool)
    marked[order[1:]] = same
    marked[order[:-1]] |= same
    return marked


def count_texts(data: np.ndarray, offsets: np.ndarray) -> dict[str, np.ndarray]:
    """The ``COUNTS`` of each text of a chunk."""
    n = len(offsets) - 1
    starts, ends = word_spans(data, offsets)
    first = np.searchsorted(starts, offsets)
    words = np.diff(first)
    text = np.repeat(np.arange(n), words).astype(np.uint64)

    breaks = np.flatnonzero(data == 0x0A)
    begins = np.sort(np.concatenate([offsets[:-1], breaks + 1]))
    stops = np.sort(np.concatenate([breaks, offsets[1:]]))
    filled = np.searchsorted(starts, stops) > np.searchsorted(starts, begins)
    begins, stops = begins[filled], stops[filled]

    hashes = span_hashes(data, np.concatenate([starts, begins]), np.concatenate([ends, stops]))
    word, line = hashes[: len(starts)], hashes[len(starts) :]
    covered = np.zeros(len(word), bool)
    if len(word) > 2:
        whole = text[2:] == text[:-2]
        window = mixed(word[:-2] * np.uint64(3) + mixed(word[1:-1]) * np.uint64(5) + mixed(mixed(word[2:])) + text[2:] * np.uint64(0x9E3779B97F4A7C15))[whole]
        at = np.flatnonzero(whole)[repeats(window)]
        for i in range(3):
            covered[at + i] = True
    line_text = np.searchsorted(offsets, begins, "right") - 1
    key = mixed(line + line_text.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15))
    _, unique = np.unique(key, return_index=True)
    lines = np.bincount(line_text, minlength=n)
    letter = (data & 0xC0) != 0x80
    spaces = np.zeros(len(data), bool)
    spaces[(data == 0x20) | (data >= 0x09) & (data <= 0x0D)] = True
    return {
        "n_words": words,
        "word_chars": per_text(letter & ~spaces, offsets),
        "n_symbols": per_text(_SYMBOL[data], offsets),
        "n_dup_lines": lines - np.bincount(line_text[unique], minlength=n),
        "n_repeat_words": np.diff(np.concatenate([[0], np.cumsum(covered)])[first]),
        "n_lines": lines,
        "n_capitals": per_text(_CAPITAL[data], offsets),
        "n_marks": per_text(_MARK[data], offsets),
        "n_digits": per_text(_DIGIT[data], offsets),
    }


def statistics(docs: DataFrame) -> DataFrame:
    """Per document: ``doc_id``, ``k1``, ``k2`` (of its text) and the ``COUNTS`` of its whole text."""
    narrow = docs.select("doc_id", *text_key(F.col("text")), F.col("text").alias("text"))
    schema = T.StructType([*narrow.schema.fields[:3], *(T.StructField(c, T.LongType()) for c in COUNTS)])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row, end, data, offsets in chunks(batch.column(3)):
                found = count_texts(data, offsets)
                yield pa.RecordBatch.from_arrays([*(batch.column(i)[row:end] for i in range(3)), *(pa.array(found[c].astype(np.int64)) for c in COUNTS)], names=schema.names)

    return narrow.mapInArrow(run, schema)


def features() -> list[Column]:
    """What the rules look at: shares, so that a document's length alone makes nothing odd."""
    words, chars = (F.greatest(F.lit(1), F.col(c)) for c in ("n_words", "word_chars"))
    return [
        F.col("n_symbols") / words,
        F.col("n_repeat_words") / words,
        F.col("n_dup_lines") / F.greatest(F.lit(1), F.col("n_lines")),
        F.col("word_chars") / words,
        F.col("n_capitals") / chars,
        F.col("n_marks") / words,
    ]


def bins() -> list[Column]:
    """The ``features`` as whole bins, fine where they are small."""
    return [F.floor(F.log1p(f) * FINE).cast("int").alias(f"f{i}") for i, f in enumerate(features())]


WIDTH = 6


class Ranks:
    """The share of documents that lie in a lower bin of a statistic, for each bin that a document is in."""

    def __init__(self, found: list[tuple[int, int, int]]):
        self.bins, self.below = [], []
        for i in range(WIDTH):
            own = sorted((at, n) for f, at, n in found if f == i)
            counts = np.array([n for _, n in own], np.int64)
            self.bins.append(np.array([at for at, _ in own], np.int64))
            self.below.append((np.cumsum(counts) - counts) / max(1, counts.sum()))

    def __call__(self, rows: np.ndarray) -> np.ndarray:
        """Ranks of rows of bins; one that no document is in has the rank of the next."""
        out = np.ones(rows.shape)
        for i, (at, below) in enumerate(zip(self.bins, self.below, strict=True)):
            out[:, i] = np.append(below, 1.0)[np.searchsorted(at, rows[:, i])]
        return out

    def highest(self) -> np.ndarray:
        return np.array([b[-1] if len(b) else 0.0 for b in self.below])


def ranks(judged: DataFrame) -> Ranks:
    """From the histograms of all ``judged`` documents: at most some ten thousand bins of each statistic."""
    wide = judged.select(*bins())
    pairs = F.explode(F.array(*(F.struct(F.lit(i).alias("f"), F.col(f"f{i}").alias("at")) for i in range(WIDTH))))
    return Ranks([tuple(r) for r in wide.select(pairs.alias("x")).groupBy("x.f", "x.at").count().collect()])


def path_of(n: np.ndarray | float) -> np.ndarray:
    """The mean path of an unsuccessful search among n rows."""
    n = np.asarray(n, float)
    safe = np.maximum(n, 2)
    return np.where(n > 2, 2 * (np.log(safe - 1) + 0.5772156649) - 2 * (safe - 1) / safe, np.where(n == 2, 1.0, 0.0))


def grow(rows: np.ndarray, high: np.ndarray, trees: int = TREES, tree_rows: int = TREE_ROWS, seed: int = SEED) -> list[tuple[np.ndarray, ...]]:
    """Isolation trees as arrays: statistic (-1 at leaves), place of the split, left child, path at leaves.

    A node is split anywhere between the ends of its part of the space from 0 to ``high``, whether ``rows`` lie there or not.
    """
    rng = np.random.default_rng(seed)
    limit = int(np.ceil(np.log2(max(2, tree_rows)))) + 4
    forest = []
    for _ in range(trees):
        own = rows[rng.choice(len(rows), min(tree_rows, len(rows)), replace=False)]
        what, where, left, path = [], [], [], []
        todo = [(own, 0, np.zeros(len(high)), np.array(high, float))]
        while todo:
            part, depth, a, b = todo.pop(0)
            open_ = np.flatnonzero(b > a)
            if depth >= limit or len(part) < 2 or not len(open_):
                what.append(-1), where.append(0.0), left.append(0), path.append(depth + float(path_of(len(part))))
                continue
            f = int(rng.choice(open_))
            cut = rng.uniform(a[f], b[f])
            what.append(f), where.append(cut), path.append(0.0)
            left.append(len(what) + len(todo))
            under = np.where(np.arange(len(b)) == f, cut, b)
            over = np.where(np.arange(len(a)) == f, cut, a)
            todo += [(part[part[:, f] <= cut], depth + 1, a, under), (part[part[:, f] > cut], depth + 1, over, b)]
        forest.append((np.array(what), np.array(where), np.array(left), np.array(path)))
    return forest


def mean_path(forest: list[tuple[np.ndarray, ...]], rows: np.ndarray, tree_rows: int = TREE_ROWS) -> np.ndarray:
    """The mean path of each row, as a multiple of that of a random tree."""
    total = np.zeros(len(rows))
    for what, where, left, path in forest:
        node = np.zeros(len(rows), np.int64)
        going = np.arange(len(rows))
        while len(going):
            at = node[going]
            going = going[what[at] >= 0]
            at = node[going]
            node[going] = left[at] + (rows[going, what[at]] > where[at])
        total += path[node]
    return total / len(forest) / float(path_of(tree_rows))


def scored(stats: DataFrame, forest: list[tuple[np.ndarray, ...]] | None, known: Ranks) -> DataFrame:
    """Adds ``path``; 1 for all rows without a forest."""
    if forest is None:
        return stats.withColumn("path", F.lit(1.0))
    held = stats.sparkSession.sparkContext.broadcast(pickle.dumps((forest, known)))
    wide = stats.select("*", *bins())
    schema = T.StructType([*stats.schema.fields, T.StructField("path", T.DoubleType())])
    own = len(stats.columns)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        trees, rank = pickle.loads(held.value)
        for batch in batches:
            rows = rank(np.column_stack([batch.column(own + i).to_numpy() for i in range(WIDTH)]))
            yield pa.RecordBatch.from_arrays([*batch.columns[:own], pa.array(mean_path(trees, rows))], names=schema.names)

    return wide.mapInArrow(run, schema)


def base_failed() -> Column:
    return (F.col("n_words") < LEAST_WORDS) | (100 * F.col("n_repeat_words") > MOST_REPEATED * F.col("n_words"))


def bounded_sample(rows: DataFrame, most: int, known: Ranks) -> np.ndarray:
    """What the trees see of ``most`` rows at most: those of the least hashes of counts and id."""
    n = rows.count()
    if not n:
        return np.zeros((0, WIDTH))
    draw = F.pmod(F.xxhash64("doc_id", *COUNTS), F.lit(1_000_003))
    share = min(1.0, 1.1 * most / n + 0.001)
    picked = rows.withColumn("draw", draw).where(F.col("draw") <= F.lit(int(1_000_003 * share))).select("draw", *bins())
    found = picked.orderBy("draw", *(f"f{i}" for i in range(WIDTH))).limit(most).drop("draw").collect()
    return known(np.array([tuple(r) for r in found], np.int64).reshape(-1, WIDTH))


def bound(paths: DataFrame) -> float:
    """The path under which a document is rejected, from rows of ``path`` and ``quality``.

    Of the bounds that reject at most ``FALSE_REJECTS`` of the good rows, the one that rejects most
    of the bad ones; among equal ones the middle.
    """
    hist = (
        paths.where(F.col("quality").isNotNull())
        .select(F.least(F.lit(2 * BINS - 1), F.floor(F.col("path") * BINS).cast("int")).alias("bin"), (F.col("quality") > 0).alias("good"))
        .groupBy("bin", "good")
        .count()
        .collect()
    )
    good, bad = np.zeros(2 * BINS), np.zeros(2 * BINS)
    for r in hist:
        (good if r["good"] else bad)[r["bin"]] += r["count"]
    if not good.sum() or not bad.sum():
        return UNLABELLED_BOUND
    lost, caught = (np.concatenate([[0], np.cumsum(x)]) for x in (good, bad))
    allowed = np.flatnonzero(lost <= FALSE_REJECTS * good.sum())
    best = allowed[caught[allowed] == caught[allowed].max()]
    return float(best[len(best) // 2]) / BINS


def judged_documents(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """Per document: ``doc_id``, ``k1``, ``k2`` (of its text), ``n_words``, ``word_chars``, ``n_symbols``, ``n_dup_lines``,
    ``n_repeat_words``, ``base_failed``, ``kept`` and ``path`` (the forest's mean path).

    ``base_failed`` documents go; of the others those whose path is under the bound go too. ``labels``
    has ``doc_id`` and ``quality`` (1 good, 0 bad; null is no label); a document with labels of
    both kinds counts as bad. Without labels of both kinds the bound is ``UNLABELLED_BOUND``, without
    good ones the trees are grown from all documents. Equal paths have one verdict; one on the bound is kept.

    Null and empty texts have no words and fail the base. Null ids match no label; repeated rows are
    judged each; empty tables give no rows; other columns are not read.
    """
    stats = materialize(statistics(docs), "quality-counts")
    judged = stats.where(~base_failed())
    marks = labels.where(F.col("doc_id").isNotNull() & F.col("quality").isNotNull()).groupBy("doc_id").agg(F.min("quality").alias("quality"))
    marked = judged.join(marks, "doc_id")
    known = ranks(judged)
    sample = bounded_sample(marked.where("quality > 0"), SAMPLE, known)
    if not len(sample):
        sample = bounded_sample(judged, SAMPLE, known)
    forest = grow(sample, known.highest()) if len(sample) else None
    limit = bound(scored(marked.drop("quality"), forest, known).join(marks, "doc_id")) if forest else UNLABELLED_BOUND
    return scored(stats, forest, known).select(
        "doc_id", "k1", "k2", *COUNTS[:5], base_failed().alias("base_failed"), (~base_failed() & (F.col("path") >= F.lit(limit))).alias("kept"), "path"
    )


def quality(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """``judged_documents`` without the keys of the texts."""
    return judged_documents(docs, labels).drop("k1", "k2")

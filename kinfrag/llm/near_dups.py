"""Near-duplicates by tensored MinHash banding, verified on full shingle sets.

A document's bands come from two collections of ``SIDE`` hashes, each of ``ROWS`` minima; a table key
combines one hash of either, so ``SIDE * SIDE`` tables need only ``2 * SIDE * ROWS`` minima. At a
similarity of 0.75 a pair meets in a table unless one whole collection fails: all but 0.05 % meet.

Documents with the same set (by a hash of 128 bits) are one class, which has a number of its own, and only
classes go on. In each bucket every class is
compared with the bucket's hub (the class that meets most others) on full sets. Buckets whose members
are then not all connected are settled exactly: all their members' sets meet in one task, which
counts common shingles through an index of them. Buckets too large for a task are pooled, each class once,
and split by rarest shingles: two sets can only be similar if they share one of the first quarter of theirs, ordered
by how many classes have them, so a passage that all have parts nobody from a partner. What is
still too large after that meets block by block. Only links of a spanning forest are returned, never
all pairs.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from kinfrag.llm.components import components
from kinfrag.llm.textbytes import LOWER, chunks, mixed, span_hashes, word_spans
from kinfrag.plans.scratch import materialize

SHINGLE, PERCENT = 5, 75
#: Hashes of each of the two collections, and minima of each hash.
SIDE, ROWS = 10, 2
#: Classes of a block, and shingles of it, about, where a bucket is too large for one task.
BLOCK, BLOCK_SHINGLES = 1_024, 1_000_000
#: Parts that a shingle of a large bucket is dealt over while its members are counted.
SALTS = 16
#: Keys of texts to read again that are broadcast, at most.
BROADCAST = 200_000

_RNG = np.random.default_rng(20_11)
_FACTORS = _RNG.integers(1, 2**63, 2 * SIDE * ROWS, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_SHIFTS = _RNG.integers(0, 2**63, 2 * SIDE * ROWS, dtype=np.uint64)


def shingles(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all shingles of the texts of a chunk, and where each text's begin.

    A text of fewer words than ``SHINGLE`` has its whole sequence as one; one without words none.
    """
    data = LOWER[data]
    starts, ends = word_spans(data, offsets)
    words = span_hashes(data, starts, ends)
    first = np.searchsorted(starts, offsets)
    counts = np.diff(first)
    short = np.flatnonzero((counts > 0) & (counts < SHINGLE))
    size = np.maximum(counts - SHINGLE + 1, 0)
    size[short] = 1
    out_first = np.concatenate([[0], np.cumsum(size)])
    out = np.empty(out_first[-1], np.uint64)
    at = np.arange(len(out)) - np.repeat(out_first[:-1], size) + np.repeat(first[:-1], size)
    is_short = np.zeros(len(counts), bool)
    is_short[short] = True
    full = ~np.repeat(is_short, size)
    h = np.zeros(int(full.sum()), np.uint64)
    for k in range(SHINGLE):
        h = mixed(h + words[at[full] + k])
    out[full] = h
    for t in short:
        h = np.full(1, counts[t], np.uint64)
        for k in range(counts[t]):
            h = mixed(h + words[first[t] + k : first[t] + k + 1])
        out[out_first[t]] = h[0]
    return out, out_first


def bands(hashes: np.ndarray, first: np.ndarray) -> np.ndarray:
    """The hashes of both collections for each run of shingles (none may be empty): [text, 2 * SIDE]."""
    minima = np.empty((2 * SIDE * ROWS, len(first)), np.uint64)
    for i in range(len(minima)):
        minima[i] = np.minimum.reduceat(hashes * _FACTORS[i] + _SHIFTS[i], first)
    out = np.zeros((2 * SIDE, len(first)), np.uint64)
    for r in range(ROWS):
        out = mixed(out + minima[r::ROWS])
    return out.T


def sketches(docs: DataFrame) -> DataFrame:
    """Per document: ``doc_id``, ``k1``, ``k2`` (of its text), ``n``, ``d1``, ``d2`` (of its set), ``left`` and ``right``."""
    text = F.col("text")
    narrow = docs.select("doc_id", text.alias("text")).select("doc_id", F.xxhash64("text").alias("k1"), F.xxhash64(F.lit("second"), "text").alias("k2"), "text")
    longs = T.ArrayType(T.LongType())
    fields = [T.StructField(c, T.LongType()) for c in ("k1", "k2", "n", "d1", "d2")]
    schema = T.StructType([narrow.schema["doc_id"], *fields, T.StructField("left", longs), T.StructField("right", longs)])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row, end, data, offsets in chunks(batch.column(3)):
                hashes, first = shingles(data, offsets)
                some = np.flatnonzero(np.diff(first))
                n, d = np.zeros(end - row, np.int64), np.zeros((end - row, 2), np.int64)
                for i in some:
                    own = np.unique(hashes[first[i] : first[i + 1]])
                    n[i], d[i] = len(own), np.frombuffer(hashlib.blake2b(own.tobytes(), digest_size=16).digest(), np.int64)
                found = np.zeros((end - row, 2 * SIDE), np.uint64)
                if len(some):
                    found[some] = bands(hashes, first[some])
                found = found.view(np.int64)
                sides = [pa.FixedSizeListArray.from_arrays(pa.array(np.ascontiguousarray(x).ravel()), SIDE).cast(pa.list_(pa.int64())) for x in (found[:, :SIDE], found[:, SIDE:])]
                yield pa.RecordBatch.from_arrays([*(batch.column(i)[row:end] for i in range(3)), pa.array(n), pa.array(d[:, 0]), pa.array(d[:, 1]), *sides], names=schema.names)

    return narrow.mapInArrow(run, schema)


def shingle_sets(texts: DataFrame) -> DataFrame:
    """The full sets of rows of ``node`` and ``text``: ``node`` and ``shingles`` (sorted)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row, end, data, offsets in chunks(batch.column(1)):
                hashes, first = shingles(data, offsets)
                own = [np.unique(hashes[a:b]) for a, b in zip(first, first[1:], strict=False)]
                sizes = np.concatenate([[0], np.cumsum([len(x) for x in own])]).astype(np.int32)
                flat = np.concatenate([*own, np.zeros(0, np.uint64)]).view(np.int64)
                yield pa.RecordBatch.from_arrays([batch.column(0)[row:end], pa.ListArray.from_arrays(pa.array(sizes), pa.array(flat))], names=["node", "shingles"])

    return texts.select("node", "text").mapInArrow(run, "node long, shingles array<long>")


def similar(common: np.ndarray, a: np.ndarray | int, b: np.ndarray | int) -> np.ndarray:
    return 100 * common >= PERCENT * (a + b - common)


def spanning_links(nodes: np.ndarray, sets: list[np.ndarray]) -> list[tuple[int, int]]:
    """Links that connect the same nodes as all links between the sets do.

    A set is counted against all others through an index of their shingles; every set outside the
    largest component is, so no link between two components can be missed.
    """
    sizes = np.array([len(s) for s in sets])
    _, term = np.unique(np.concatenate(sets), return_inverse=True)
    owner = np.repeat(np.arange(len(sets)), sizes)
    order = np.argsort(term, kind="stable")
    begin = np.searchsorted(term[order], np.arange(term.max() + 2))
    posting, often = owner[order], np.diff(begin)
    place = np.concatenate([[0], np.cumsum(sizes)])
    root = np.arange(len(sets))
    hub = int(np.argmax(np.add.reduceat(often[term], place[:-1]) / sizes))
    counted = np.zeros(len(sets), bool)
    links = []
    todo = hub
    while True:
        counted[todo] = True
        own = term[place[todo] : place[todo + 1]]
        own = own[often[own] > 1]
        if len(own):
            runs = often[own]
            at = np.repeat(begin[own] - np.concatenate([[0], np.cumsum(runs)[:-1]]), runs) + np.arange(runs.sum())
            common = np.bincount(posting[at], minlength=len(sets))
            for y in np.flatnonzero(similar(common, sizes[todo], sizes)):
                if root[y] != root[todo]:
                    links.append((int(nodes[todo]), int(nodes[y])))
                    root[root == root[y]] = root[todo]
        largest = np.bincount(root, minlength=len(sets)).argmax()
        left = np.flatnonzero((root != largest) & ~counted)
        if not len(left):
            return links
        todo = int(left[0])


def settle(groups: DataFrame) -> DataFrame:
    """Links ``a``, ``b`` within each ``task`` of rows of ``task``, ``node`` and ``shingles``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, np.ndarray] = {}
        now = None

        def close() -> Iterator[pa.RecordBatch]:
            if len(held) > 1:
                links = spanning_links(np.array(list(held)), list(held.values()))
                yield pa.RecordBatch.from_arrays([pa.array([x[0] for x in links], pa.int64()), pa.array([x[1] for x in links], pa.int64())], names=["a", "b"])

        for batch in batches:
            tasks, nodes = batch.column(0).to_numpy(), batch.column(1).to_numpy()
            values, at = batch.column(2).flatten().to_numpy(), np.concatenate([[0], np.cumsum(batch.column(2).value_lengths().to_numpy())])
            for i, task in enumerate(tasks):
                if task != now:
                    yield from close()
                    held, now = {}, task
                held[int(nodes[i])] = values[at[i] : at[i + 1]].copy()
        yield from close()

    return groups.repartition("task").sortWithinPartitions("task").select("task", "node", "shingles").mapInArrow(run, "a long, b long")


def tables(classes: DataFrame) -> DataFrame:
    """Members of all buckets with two classes or more: ``key``, ``node``, ``n`` and ``size``."""
    pick = F.expr(f"xxhash64(t, left[t div {SIDE}], right[t % {SIDE}])")
    keys = classes.withColumn("t", F.explode(F.sequence(F.lit(0), F.lit(SIDE * SIDE - 1)))).select(pick.alias("key"), "node", "n")
    full = keys.groupBy("key").agg(F.count("*").alias("size")).where("size > 1")
    return keys.join(full, "key")


def open_buckets(members: DataFrame, roots: DataFrame) -> DataFrame:
    """Buckets whose members (``key``, ``node``, ``n``) are not all connected yet: ``key`` and ``blocks``; of those with the same members one."""
    marked = members.join(roots, members["node"] == roots["node"], "left").select("key", members["node"], "n", F.coalesce("root", members["node"]).alias("root"))
    same = F.struct(F.count("*").alias("c"), F.sum(F.xxhash64("node").cast("decimal(38,0)")).alias("s"), F.bit_xor(F.xxhash64(F.lit(1), "node")).alias("x"))
    return (
        marked.groupBy("key")
        .agg(same.alias("same"), F.min("root").alias("low"), F.max("root").alias("high"), F.sum("n").alias("all"))
        .where("low != high")
        .groupBy("same")
        .agg(F.min("key").alias("key"), F.min("all").alias("all"))
        .select("key", F.greatest(F.ceil(F.col("same.c") / BLOCK), F.ceil(F.col("all") / BLOCK_SHINGLES)).cast("int").alias("blocks"))
    )


def split_by_shingles(classes: DataFrame, sets: DataFrame) -> DataFrame:
    """Buckets of those ``classes`` (``node`` and ``n``) that share one of their rarest shingles: ``key``, ``node`` and ``n``.

    Classes that are similar share one: of a set of n, all but ``PERCENT`` percent and one more are looked at.
    """
    terms = classes.join(sets, "node").select("node", "n", F.explode("shingles").alias("term"))
    terms = terms.withColumn("salt", F.pmod(F.xxhash64("node"), F.lit(SALTS)).cast("int"))
    often = terms.groupBy("term").agg(F.count("*").alias("often")).where("often > 1")
    often = often.withColumn("salt", F.explode(F.array(*map(F.lit, range(SALTS)))))
    order = Window.partitionBy("node").orderBy(F.coalesce("often", F.lit(1)), "term")
    placed = terms.join(often, ["term", "salt"], "left").withColumn("place", F.row_number().over(order))
    prefix = F.col("n") - F.expr(f"(n * {PERCENT} + 99) div 100") + 1
    return placed.where((F.col("place") <= prefix) & F.col("often").isNotNull()).select(F.xxhash64(F.lit("term"), "term").alias("key"), "node", "n")


def bucket_tasks(members: DataFrame, buckets: DataFrame) -> DataFrame:
    """The ``task`` of each member, one for every two blocks of a bucket: ``task`` and ``node``."""
    block = F.pmod(F.xxhash64(F.lit("block"), "node"), F.col("blocks")).cast("int")
    other = F.explode(F.when(F.col("blocks") == 1, F.array(F.lit(0))).otherwise(F.array_remove(F.sequence(F.lit(0), F.col("blocks") - 1), F.col("block"))))
    return (
        members.select("key", "node")
        .join(buckets, "key")
        .withColumn("block", block)
        .withColumn("other", other)
        .select(F.xxhash64("key", F.least("block", "other"), F.greatest("block", "other")).alias("task"), "node")
    )


def grouped_documents(docs: DataFrame) -> DataFrame:
    """Per document: ``doc_id``, ``k1``, ``k2`` (of its text), ``n_shingles``, ``component_id`` and ``kept``.

    Documents whose sets of distinct shingles of ``SHINGLE`` words (A-Z in lower case) have a
    similarity of ``PERCENT`` percent or more are linked; ``component_id`` is the smallest id that a
    document reaches, ``kept`` says that it is its own. Null ids are reached but never smallest,
    unless all are null (then ``component_id`` is null and the row kept); of repeated rows each has
    the same answer. Null and empty texts and those without words have no shingle, no link and are
    their own component. An empty table gives no rows; other columns are not read.
    """
    rows = materialize(sketches(docs), "near-sketches")
    rep = F.min(F.struct("doc_id", "k1", "k2"))
    classes = (
        rows.where("n > 0")
        .groupBy("d1", "d2")
        .agg(F.min("doc_id").alias("least"), rep.alias("rep"), F.first("n").alias("n"), F.first("left").alias("left"), F.first("right").alias("right"))
        # Numbered as they are written: no two classes have one number.
        .withColumn("node", F.monotonically_increasing_id())
    )
    classes = materialize(classes, "near-classes")
    members = materialize(tables(classes), "near-members")

    score = members.groupBy("node").agg(F.sum("size").alias("score"))
    hub = members.join(score, "node").groupBy("key").agg(F.max(F.struct("score", "node", "n")).alias("hub")).select("key", F.col("hub.node").alias("b"), F.col("hub.n").alias("n_b"))
    fits = (100 * F.least("n", "n_b") >= PERCENT * F.greatest("n", "n_b")) & (F.col("node") != F.col("b"))
    pairs = materialize(members.join(hub, "key").where(fits).select(F.col("node").alias("a"), "b").distinct(), "near-pairs")

    read = classes.join(members.select("node").distinct(), "node", "left_semi").select("node", F.col("rep.doc_id").alias("rep_id"), "rep.k1", "rep.k2")
    read = read.select("node", "k1", "k2", F.xxhash64("rep_id").alias("k3"))
    texts = docs.select(F.xxhash64("text").alias("k1"), F.xxhash64(F.lit("second"), "text").alias("k2"), F.xxhash64("doc_id").alias("k3"), "text")
    texts = texts.join(F.broadcast(read) if read.count() <= BROADCAST else read, ["k1", "k2", "k3"])
    sets = materialize(shingle_sets(texts), "near-sets").dropDuplicates(["node"])

    first, second = sets.select(F.col("node").alias("a"), F.col("shingles").alias("x")), sets.select(F.col("node").alias("b"), F.col("shingles").alias("y"))
    common = F.size(F.array_intersect("x", "y"))
    links = pairs.join(first, "a").join(second, "b").where(100 * common >= PERCENT * (F.size("x") + F.size("y") - common)).select("a", "b")
    links = materialize(links, "near-links")

    roots = materialize(components(links), "near-roots")
    buckets = materialize(open_buckets(members, roots), "near-open")
    tasks = bucket_tasks(members, buckets.where("blocks = 1"))
    large = buckets.where("blocks > 1").select("key")
    if not large.isEmpty():
        # The same classes meet in a large bucket of many tables: all large buckets are split together, once.
        pooled = members.join(large, "key").select("node", "n").distinct()
        parts = materialize(split_by_shingles(pooled, sets), "near-parts")
        tasks = tasks.unionByName(bucket_tasks(parts, open_buckets(parts, roots)))
    more = settle(tasks.join(sets, "node"))
    found = components(links.unionByName(more))

    whole = classes.join(found, "node", "left").withColumn("root", F.coalesce("root", "node"))
    named = whole.join(whole.groupBy("root").agg(F.min("least").alias("component")), "root").select("d1", "d2", "component")
    linked = rows.where("n > 0").join(named, ["d1", "d2"]).select("doc_id", "k1", "k2", F.col("n").alias("n_shingles"), F.col("component").alias("component_id"))
    alone = rows.where("n = 0").select("doc_id", "k1", "k2", F.col("n").alias("n_shingles"), F.col("doc_id").alias("component_id"))
    return linked.unionByName(alone).withColumn("kept", F.col("doc_id").eqNullSafe(F.col("component_id")))


def near_dups(docs: DataFrame) -> DataFrame:
    """``grouped_documents`` without the keys of the texts."""
    return grouped_documents(docs).drop("k1", "k2")

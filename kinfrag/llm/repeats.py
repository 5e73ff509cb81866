"""Suffix-array dedup: bytes covered by a long string that starts anywhere else too.

This is prefix doubling with sampled positions. Positions are named at doubling lengths (1 to 64
bytes, by hashes of the pairs of the halves' names); of these only anchors go on (``anchors``), which
any two equal windows of 200 bytes share at the same offset. Spark counts the pairs of an anchor's
name and the name of its surroundings, and every position is given up as soon as its name is unique:

* a unique anchor begins no repeated window;
* an anchor whose surroundings are repeated too has all its windows repeated;
* what is left, where repeated strings end, is named once more at the full 200 bytes, window by
  window, among the positions with the same anchor.

Names are 64-bit hashes of two independent families, compared together; ranks in sorted order
would say no more about equality. ``ranked_spans`` is the plain method, all positions sorted by rank pairs; it gives the same spans
and moves too much for large inputs (see the README). Names of one anchor with many occurrences are counted before they are
shuffled. Surroundings with one anchor meet in a task if there are at most ``LARGE`` of them, else
their windows are counted as rows of their own, and the unique ones are told to their anchor.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from kinfrag.llm.anchors import SPAN, WINDOW, found
from kinfrag.llm.suffix_ranks import suffix_ranks
from kinfrag.llm.textbytes import ROWS, chunks, mixed, span_hashes
from kinfrag.plans.scratch import materialize

#: Different surroundings of one anchor that meet in a task; of several anchors that are worked on together.
LARGE, TOGETHER = 4_096, 2_048
#: Surroundings whose windows are hashed at once.
SLAB = 2_048
#: Removed spans of all documents that are broadcast, at most.
BROADCAST = 500_000

NAMES = "h long, c long, n long"
ANCHOR = "h long, c long, k1 long, k2 long, at int, first int, last int"


def keyed(docs: DataFrame) -> DataFrame:
    """``doc_id``, ``k1``, ``k2`` (of text and id) and ``text`` of each document."""
    return docs.select("doc_id", F.xxhash64("text").alias("k1"), F.xxhash64(F.lit("second"), "doc_id", "text").alias("k2"), F.col("text").alias("text"))


def anchor_names(texts: DataFrame) -> DataFrame:
    """``h``, ``c`` and ``n`` (their number) of the anchors of each chunk of texts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for _, _, data, offsets in chunks(batch.column(0)):
                parts = [(h, c) for _, _, h, c, _, _ in found(data, offsets)]
                h, c = (np.concatenate([p[i] for p in parts]) for i in (0, 1))
                order = np.lexsort((c, h))
                h, c = h[order], c[order]
                new = np.flatnonzero(np.append(True, (h[1:] != h[:-1]) | (c[1:] != c[:-1]))[: len(h)])
                yield pa.RecordBatch.from_arrays([pa.array(h[new].view(np.int64)), pa.array(c[new].view(np.int64)), pa.array(np.diff(np.append(new, len(h))).astype(np.int64))], names=["h", "c", "n"])

    return texts.select("text").mapInArrow(run, NAMES)


def anchor_rows(texts: DataFrame) -> DataFrame:
    """The anchors of all texts: ``h``, ``c``, ``k1``, ``k2``, ``at``, ``first`` and ``last``."""
    schema = T._parse_datatype_string(ANCHOR)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row, _, data, offsets in chunks(batch.column(2)):
                for text, at, h, c, first, last in found(data, offsets):
                    out = [pa.array(h.view(np.int64)), pa.array(c.view(np.int64))]
                    out += [batch.column(i).take(pa.array(text + row)) for i in (0, 1)]
                    out += [pa.array(x.astype(np.int32)) for x in (at, first, last)]
                    yield pa.RecordBatch.from_arrays(out, names=schema.names)

    return texts.select("k1", "k2", "text").mapInArrow(run, schema)


AROUND = pa.schema([("h", pa.int64()), ("g", pa.int64()), ("n", pa.int64()), ("k1", pa.int64()), ("k2", pa.int64()), ("at", pa.int32()), ("first", pa.int32()), ("last", pa.int32()), ("left", pa.int32()), ("around", pa.binary())])


def bytes_around(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
    """Per text of rows of ``k1``, ``k2``, ``text`` and ``anchors``: the bytes around its anchors; ``left`` of them are before it."""
    for i in range(batch.num_rows):
        k1, k2, text, own = (batch.column(j)[i].as_py() for j in range(4))
        raw = text.encode()
        yield pa.RecordBatch.from_pylist(
            [
                {"h": a["h"], "g": a["g"], "n": a["n"], "k1": k1, "k2": k2, "at": a["at"], "first": a["first"], "last": a["last"], "left": min(a["at"], SPAN - 1), "around": raw[max(0, a["at"] - SPAN + 1) : a["at"] + WINDOW]}
                for a in own
            ],
            schema=AROUND,
        )


def surroundings(texts: DataFrame) -> DataFrame:
    """``bytes_around`` of all rows."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield from bytes_around(batch)

    return texts.select("k1", "k2", "text", "anchors").mapInArrow(run, "h long, g long, n long, k1 long, k2 long, at int, first int, last int, left int, around binary")


def window_names(table: pa.Table) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Both names of each window of rows of ``surroundings``, its row, and the window's place."""
    parts = [_window_names(table.slice(i, SLAB), i) for i in range(0, table.num_rows, SLAB)]
    return tuple(np.concatenate([p[i] for p in parts]) for i in range(4))


def _window_names(table: pa.Table, above: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    get = lambda c: table.column(c).to_numpy().astype(np.int64)
    around = table.column("around").to_pylist()
    sizes = np.array([len(x) for x in around], np.int64)
    data = np.frombuffer(b"".join(around), np.uint8)
    begin = np.concatenate([[0], np.cumsum(sizes)[:-1]]).astype(np.int64)
    first, count = get("first"), get("last") - get("first") + 1
    row = np.repeat(np.arange(len(first)), count)
    place = np.arange(len(row)) - np.repeat(np.cumsum(count) - count, count) + first[row]
    offset = get("at")[row] - place
    start = begin[row] + get("left")[row] - offset
    anchor = mixed(get("h").astype(np.uint64)[row] + offset.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15))
    one = mixed(span_hashes(data, start, start + WINDOW) + anchor)
    two = mixed(span_hashes(data, start, start + WINDOW, 1) ^ anchor)
    return one, two, (row + above).astype(np.int32), place.astype(np.int32)


def pieces(row: np.ndarray, place: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Runs of consecutive places of one row: row, first and last."""
    if not len(row):
        return row, place, place
    new = np.flatnonzero((np.diff(row) != 0) | (np.diff(place) != 1)) + 1
    a, b = np.concatenate([[0], new]), np.concatenate([new, [len(row)]]) - 1
    return row[a], place[a], place[b]


def settle(around: DataFrame) -> DataFrame:
    """Repeated windows of surroundings that occur once: ``k1``, ``k2``, ``first`` and ``last``."""
    schema = T._parse_datatype_string("k1 long, k2 long, first int, last int")

    def close(parts: list[pa.Table]) -> pa.RecordBatch:
        table = pa.concat_tables(parts).combine_chunks()
        one, two, row, place = window_names(table)
        order = np.lexsort((two, one))
        same = (one[order[1:]] == one[order[:-1]]) & (two[order[1:]] == two[order[:-1]])
        again = np.zeros(len(one), bool)
        again[order[1:]] = same
        again[order[:-1]] |= same
        again &= table.column("n").to_numpy()[row] == 1
        r, first, last = pieces(row[again], place[again])
        return pa.RecordBatch.from_arrays([*(table.column(k).combine_chunks().take(pa.array(r)) for k in ("k1", "k2")), pa.array(first.astype(np.int32)), pa.array(last.astype(np.int32))], names=schema.names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.Table] = []
        rows = 0
        for batch in batches:
            table = pa.Table.from_batches([batch])
            h = table.column("h").to_numpy()
            cut = np.flatnonzero(h[1:] != h[:-1]) + 1
            if held and len(h) and held[-1].column("h")[-1].as_py() != h[0]:
                cut = np.concatenate([[0], cut])
            if rows + len(h) >= TOGETHER and len(cut):
                # Up to the last anchor that is complete.
                yield close([*held, table.slice(0, int(cut[-1]))])
                table = table.slice(int(cut[-1]))
                held, rows = [], 0
            held.append(table)
            rows += table.num_rows
        if rows:
            yield close(held)

    return around.repartition("h").sortWithinPartitions("h").mapInArrow(run, schema)


def settle_large(texts: DataFrame, own: DataFrame) -> DataFrame:
    """The same for anchors with any number of surroundings: windows are rows, counted by name.

    ``texts`` has ``k1``, ``k2``, ``text`` and ``anchors``; ``own`` those that occur once: ``k1``, ``k2``, ``at``, ``first``
    and ``last``. Only windows that are unique are told to their anchor, by the count itself; its other windows are
    repeated. So the windows of a group of any size are summed before they move, and none is joined with others of its name.
    """
    schema = T._parse_datatype_string("one long, two long, k1 long, k2 long, at int, place int, n long")

    def named(parts: list[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        whole = pa.Table.from_batches(parts).combine_chunks()
        for i in range(0, whole.num_rows, TOGETHER):
            table = whole.slice(i, TOGETHER)
            one, two, row, place = window_names(table)
            take = lambda c, row=row, table=table: table.column(c).combine_chunks().take(pa.array(row))
            yield pa.RecordBatch.from_arrays([pa.array(one.view(np.int64)), pa.array(two.view(np.int64)), take("k1"), take("k2"), take("at"), pa.array(place.astype(np.int32)), take("n")], names=schema.names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        rows = 0
        for batch in batches:
            for part in bytes_around(batch):
                held.append(part)
                rows += part.num_rows
                if rows >= TOGETHER:
                    yield from named(held)
                    held, rows = [], 0
        if rows:
            yield from named(held)

    counted = texts.select("k1", "k2", "text", "anchors").mapInArrow(run, schema).groupBy("one", "two").agg(F.count("*").alias("times"), *(F.min(c).alias(c) for c in ("k1", "k2", "at", "place", "n")))
    alone = counted.where("times = 1 and n = 1").select("k1", "k2", "at", F.lit(None).cast("int").alias("first"), F.lit(None).cast("int").alias("last"), "place")
    each = own.withColumn("place", F.lit(None).cast("int")).unionByName(alone).groupBy("k1", "k2", "at").agg(F.max("first").alias("first"), F.max("last").alias("last"), F.collect_list("place").alias("alone"))
    # What lies between the unique windows, and before and after them.
    ends = F.array_sort(F.concat("alone", F.array(F.col("first") - 1, F.col("last") + 1)))
    gaps = F.expr("filter(zip_with(slice(ends, 1, size(ends) - 1), slice(ends, 2, size(ends) - 1), (a, b) -> struct(a + 1 as first, b - 1 as last)), x -> x.first <= x.last)")
    return each.withColumn("ends", ends).select("k1", "k2", F.inline(gaps))


def merged(runs: DataFrame) -> DataFrame:
    """Runs of windows of each document as the spans of bytes that they cover, sorted and apart."""
    order = Window.partitionBy("k1", "k2").orderBy("a", "b")
    reached = F.max("b").over(order.rowsBetween(Window.unboundedPreceding, -1))
    begins = F.coalesce(F.col("a") > reached, F.lit(True)).cast("int")
    cover = runs.select("k1", "k2", F.col("first").alias("a"), (F.col("last") + WINDOW).alias("b")).withColumn("begins", begins)
    cover = cover.withColumn("span", F.sum("begins").over(order.rowsBetween(Window.unboundedPreceding, 0)))
    spans = cover.groupBy("k1", "k2", "span").agg(F.min("a").alias("a"), F.max("b").alias("b"))
    return spans.groupBy("k1", "k2").agg(F.array_sort(F.collect_list(F.struct("a", "b"))).alias("spans"))


def repeated_spans(docs: DataFrame) -> DataFrame:
    """The spans of bytes to remove: ``k1``, ``k2`` (see ``keyed``) and ``spans`` (begin and end), where there are some."""
    texts = keyed(docs.where(F.octet_length("text") >= WINDOW)).drop("doc_id")
    # Names are counted before they move; both sides of the join are plain shuffles, which Spark can split.
    contexts = materialize(anchor_names(texts).groupBy("h", "c").agg(F.sum("n").alias("n")), "repeat-contexts")
    by_name = materialize(contexts.groupBy("h").agg(F.count("*").alias("g"), F.sum("n").alias("all")).where("all > 1").select("h", "g"), "repeat-anchor-counts")
    known = materialize(contexts.join(by_name.hint("merge"), "h"), "repeat-names")
    rows = materialize(anchor_rows(texts).join(known.hint("merge"), ["h", "c"]), "repeat-anchors")

    rep = F.min(F.struct("k1", "k2", "at", "first", "last")).alias("rep")
    asked = rows.where("g > 1").groupBy("h", "c").agg(F.first("g").alias("g"), F.first("n").alias("n"), rep).select("h", "g", "n", "rep.*")

    def with_anchors(some: DataFrame) -> DataFrame:
        anchors = some.groupBy("k1", "k2").agg(F.collect_list(F.struct("h", "g", "n", "at", "first", "last")).alias("anchors"))
        return texts.join(anchors.hint("merge"), ["k1", "k2"])

    some = settle(surroundings(with_anchors(asked.where(F.col("g") <= LARGE))))
    if (known.agg(F.max("g")).first()[0] or 0) > LARGE:
        own = rows.where((F.col("g") > LARGE) & (F.col("n") == 1)).select("k1", "k2", "at", "first", "last")
        some = some.unionByName(settle_large(with_anchors(asked.where(F.col("g") > LARGE)), own))
    return merged(rows.where("n > 1").select("k1", "k2", "first", "last").unionByName(some))


def ranked_spans(docs: DataFrame) -> DataFrame:
    """The same as ``repeated_spans`` by prefix doubling over all positions: rank pairs at offsets 1, 2, ... 64 and 72, sorted by Spark."""
    texts = keyed(docs.where(F.octet_length("text") >= WINDOW)).select("k1", "k2", F.encode("text", "UTF-8").alias("raw"))
    # Rows of one id and text are streams of their own.
    texts = materialize(texts.withColumn("copy", F.monotonically_increasing_id()), "repeat-texts")
    places = F.posexplode(F.expr("transform(sequence(1, octet_length(raw)), i -> conv(hex(substring(raw, i, 1)), 16, 10))"))
    symbols = texts.select("k1", "k2", "copy", places.alias("pos", "symbol")).withColumn("symbol", F.col("symbol").cast("long"))
    found = suffix_ranks(symbols, ["k1", "k2", "copy"], WINDOW)
    return merged(found.select("k1", "k2", F.col("pos").alias("first"), F.col("pos").alias("last")))


def repeats(docs: DataFrame, with_kept: bool = True) -> DataFrame:
    """Per document: ``doc_id``, ``n_bytes``, ``n_removed``, ``n_spans``, ``kept_sha256`` and ``with_kept`` ``kept`` (its bytes).

    A byte is removed if a string of ``WINDOW`` bytes that covers it starts anywhere else too, in the
    same document or another, overlaps counted; strings never cross documents and are judged on the
    input. Texts of fewer bytes, null ones among them (empty), keep all. Null ids and repeated rows
    are documents like others, so a repeated row of ``WINDOW`` bytes loses all. ``kept`` may end within
    a character. An empty table gives no rows; other columns are not read.
    """
    spans = materialize(repeated_spans(docs), "repeat-spans")
    small = spans.agg(F.sum(F.size("spans"))).first()[0] or 0
    joined = keyed(docs).join(F.broadcast(spans) if small <= BROADCAST else spans, ["k1", "k2"], "left").select("doc_id", "text", "spans")
    fields = [T.StructField(c, T.LongType()) for c in ("n_bytes", "n_removed", "n_spans")]
    kept_field = [T.StructField("kept", T.BinaryType())] if with_kept else []
    schema = T.StructType([joined.schema["doc_id"], *fields, T.StructField("kept_sha256", T.StringType()), *kept_field])
    types = (pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.binary())[: len(schema) - 1]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for at in range(0, whole.num_rows, ROWS):
                batch = whole.slice(at, ROWS)
                out = [cut(text, spans) for text, spans in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist(), strict=True)]
                yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array([r[i] for r in out], t) for i, t in enumerate(types))], names=schema.names)

    return joined.mapInArrow(run, schema)


def cut(text: str | None, spans: list[dict[str, int]] | None) -> tuple[int, int, int, str, bytes]:
    """Bytes of a text, those in ``spans``, number of spans, and the hash of what is left with it itself."""
    raw = (text or "").encode()
    kept, at = [], 0
    for s in spans or ():
        kept.append(raw[at : s["a"]])
        at = s["b"]
    rest = b"".join([*kept, raw[at:]])
    return len(raw), len(raw) - len(rest), len(spans or ()), hashlib.sha256(rest).hexdigest(), rest

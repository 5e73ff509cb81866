"""Main text of web pages: the host's suffix array over whole pages, then an exact check by landmarks.

A page is cut into blocks at block-level tags. Blocks inside a landmark are told by it: those of
``article`` or ``main`` are content, those of menus, headers, footers, sidebars, notices, adverts,
forms and comments are not. Elements and roles are landmarks; the names of a class or id are only for
containers, and never speak against an element. The blocks of a page in content, in other landmarks and in
none are three parts; each is a token stream, with marks before its begin and after its end.

All streams of all pages are in the array. Symbols are words of a host, so strings of different hosts differ. Positions are named
at doubling lengths up to half of ``LENGTH`` (by hashes of the pairs of the halves' names). A string's anchor is the least name
in it, so equal strings have equal anchors: a position whose anchor is on one page only, or in content only, is given up, and nothing
is lost by it. What is left has the last round of ``suffix_ranks``: Spark sorts the pairs of names and ranks them. Strings of
``LENGTH`` tokens that stand on two distinct pages (by their html), but nowhere in content, are boilerplate; the
words that they cover go, unique runs stay. The marks let shorter strings count where they begin or end a part, from
``LEAST`` words on.

The check: where a page has content landmarks nothing outside them stays, and what other landmarks hold never does.
The suffix array alone can't give right results where menus and adverts are new on each page (nothing
repeats) and passages of articles repeat across pages (they would go); see the README for figures.
"""

from __future__ import annotations

import html as entities
import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from kinfrag.llm.suffix_ranks import reranked
from kinfrag.llm.textbytes import mixed, span_hashes
from kinfrag.llm.url_filter import host_and_path
from kinfrag.plans.scratch import mark, materialize, sweep

#: Tokens of a string that is boilerplate if it stands on two pages, and words that it must have.
LENGTH, LEAST = 16, 4
#: Tokens that a position's name stands for before Spark ranks pairs of names.
GRAM = LENGTH // 2
#: Covered places of all pages, and anchors that repeat, that are broadcast, at most.
BROADCAST, KNOWN = 500_000, 4_000_000
#: Pages whose strings are worked on together.
ROWS = 512
#: Parts of a page, each a stream of its own: blocks in content, in other landmarks, in none.
IN_CONTENT, IN_ASIDE, IN_NONE = 0, 1, 2

# Fixed values of HTML.
RAW = "script style textarea title noscript iframe template noembed noframes xmp svg math select button object canvas audio video".split()
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
BLOCK = frozenset(
    "address article aside blockquote body caption center dd details dialog div dl dt fieldset figcaption figure footer form frameset h1 h2 h3 h4 h5 h6 head header hr html legend li main menu nav ol optgroup option p pre search section summary table tbody td tfoot th thead tr ul".split()
)
#: Inline elements, which the end of an outer element may close.
LIGHT = frozenset("a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd label mark q rp rt ruby s samp small span strike strong sub sup time tt u var p li dd dt option tr td th thead tbody tfoot".split())

CONTENT = frozenset(("article", "main"))
CONTENT_ROLES = frozenset(("article", "main"))
ASIDE = frozenset("nav aside footer form dialog menu search fieldset".split())
ASIDE_ROLES = frozenset("navigation banner contentinfo complementary search form dialog alert alertdialog menu menubar toolbar".split())
#: Elements whose class or id is looked at; whole names of it that make them content, and words of it that make them none.
CONTAINERS = frozenset("div section ul ol dl table center span".split())
CONTENT_NAMES = frozenset("content main main-content maincontent page-content post-content entry-content article-content article-body post-body story-body".split())
ASIDE_NAMES = frozenset(
    "ad ads advert adverts advertisement advertising sponsor sponsored promo promotion banner popup modal overlay cookie cookies consent notice notices gdpr newsletter subscribe signup login nav navbar navigation menu menus breadcrumb breadcrumbs sidebar sidebars aside widget widgets footer masthead share sharing social related recommended comment comments disqus pagination pager toolbar skip".split()
)

TOKEN = re.compile(
    r"<!--.*?(?:-->|\Z)"
    r"|<(?P<raw>" + "|".join(RAW) + r")(?=[\s/>])[^>]*>.*?(?:</(?P=raw)\s*>|\Z)"
    r"|<(?P<end>/?)(?P<tag>[a-zA-Z][^\s/>]*)(?P<attributes>(?:[^>\"']++|\"[^\"]*+\"|'[^']*+')*+)>"
    r"|<[!?/][^>]*>"
    r"|<(?P<tag2>[a-zA-Z][^\s/>]*)[^>]*>",
    re.DOTALL | re.IGNORECASE,
)
ATTRIBUTE = re.compile(r"(?:^|\s)(class|id|role|hidden)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+)))?", re.IGNORECASE)
NAME = re.compile(r"[a-z]+|[0-9]+")


@dataclass
class Block:
    """A block's text, and whether a landmark makes it content (True), none (False) or says nothing."""

    text: str
    content: bool | None


def landmark(tag: str, attributes: str, inside: bool) -> bool | None:
    """What an element says of what it holds; ``inside`` is whether content holds it."""
    if tag in ASIDE or tag == "header" and not inside:
        return False
    said = True if tag in CONTENT else None
    if attributes:
        for kind, *values in ATTRIBUTE.findall(attributes):
            kind, value = kind.lower(), next((v for v in values if v), "").lower()
            if kind == "hidden" or kind == "role" and value in ASIDE_ROLES:
                return False
            if kind == "role" and value in CONTENT_ROLES:
                said = True
            if kind in ("class", "id") and tag in CONTAINERS and said is None:
                if not CONTENT_NAMES.isdisjoint(value.split()):
                    said = True
                elif not ASIDE_NAMES.isdisjoint(NAME.findall(value)):
                    said = False
    return said


def blocks(page: str) -> list[Block]:
    """The blocks of a page that have text, in its order."""
    found: list[Block] = []
    text: list[str] = []
    stack: list[tuple[str, bool | None]] = []
    state: bool | None = None
    at = 0

    def close() -> None:
        joined = " ".join(entities.unescape("".join(text)).split())
        if joined:
            found.append(Block(joined, state))
        text.clear()

    for m in TOKEN.finditer(page):
        if m.start() > at:
            text.append(page[at : m.start()])
        at = m.end()
        tag = m["tag"] or m["tag2"]
        if tag is None:
            if m["raw"] and m["raw"].lower() == "title":
                close()
            continue
        tag = tag.lower()
        if tag == "br":
            text.append(" ")
        elif tag in BLOCK:
            close()
        if tag in VOID:
            continue
        if not m["end"]:
            if (m["attributes"] or "").endswith("/") and tag not in BLOCK and tag not in LIGHT:
                continue
            said = landmark(tag, m["attributes"] or "", state is True)
            if said is not None or tag not in LIGHT:
                if said is not None and state != said:
                    close()
                stack.append((tag, state))
                # Content in a menu is none; a menu in content is none.
                state = state if said is None or state is False else said
            continue
        for i in range(len(stack) - 1, -1, -1):
            if stack[i][0] == tag:
                if state != stack[i][1]:
                    close()
                state = stack[i][1]
                del stack[i:]
                break
            if tag in LIGHT and stack[i][0] not in LIGHT:
                break
    if at < len(page):
        text.append(page[at:])
    close()
    return found


def parts(found: list[Block]) -> Iterator[tuple[int, list[int]]]:
    """Of each part of a page that has words: the part and its blocks."""
    for part, said in ((IN_CONTENT, True), (IN_ASIDE, False), (IN_NONE, None)):
        own = [i for i, block in enumerate(found) if block.content is said]
        if own:
            yield part, own


def named(tokens: np.ndarray) -> np.ndarray:
    """Names of the ``GRAM`` tokens from each position on, by doubling: a name of two halves' names at a time."""
    size = 1
    while size < GRAM:
        tokens = mixed(mixed(tokens[:-size] + np.uint64(size)) + tokens[size:])
        size *= 2
    return tokens


def least(values: np.ndarray, span: int) -> np.ndarray:
    """The least of ``span`` values from each place on."""
    size = 1
    while size < span:
        step = min(size, span - size)
        values = np.minimum(values[:-step], values[step:])
        size += step
    return values


@dataclass
class Strings:
    """The strings of ``LENGTH`` tokens of some pages: of each its anchor, its place among all tokens, in its stream and the stream."""

    keys: list[np.ndarray]  # host, k1 and k2 of each stream
    part: np.ndarray  # of each stream
    names: np.ndarray  # of each token
    anchor: np.ndarray
    at: np.ndarray
    pos: np.ndarray
    stream: np.ndarray


def strings(pages: pa.RecordBatch) -> Iterator[Strings]:
    """The strings of the streams of rows of ``host``, ``k1``, ``k2``, ``html``, ``ROWS`` pages at a time.

    On either side of a stream stand as many marks as leave ``LEAST`` words, or all there are, to every string.
    """
    for above in range(0, pages.num_rows, ROWS):
        rows = pages.slice(above, ROWS)
        texts, row, part = [], [], []
        for i, page in enumerate(rows.column(3).to_pylist()):
            found = blocks(page)
            for kind, own in parts(found):
                texts.append(" ".join([found[j].text for j in own]))
                row.append(i)
                part.append(kind)
        if not texts:
            continue
        data = np.frombuffer(" ".join(texts).encode(), np.uint8)
        gaps = np.flatnonzero(data == 0x20)
        words = mixed(span_hashes(data, np.append(0, gaps + 1), np.append(gaps, len(data))))
        keys = [rows.column(j).to_numpy()[row] for j in range(3)]
        n = np.array([t.count(" ") + 1 for t in texts], np.int64)
        pad = LENGTH - np.minimum(LEAST, n)
        size = n + 2 * pad
        stream = np.repeat(np.arange(len(n)), size)
        place = np.arange(len(stream)) - (np.cumsum(size) - size)[stream]
        before, after = place < pad[stream], place >= (pad + n)[stream]
        tokens = np.where(before, np.uint64(1), np.uint64(2))
        tokens[~before & ~after] = words
        names = named(mixed(tokens + mixed(keys[0].view(np.uint64))[stream]))
        # Names of marks alone are no anchors.
        rest = slice(0, len(names))
        anchor = least(np.where((place[rest] + GRAM <= pad[stream[rest]]) | after[rest], np.uint64(2**64 - 1), names), LENGTH - GRAM + 1)
        at = np.flatnonzero(place[: len(anchor)] <= (size - LENGTH)[stream[: len(anchor)]])
        yield Strings(keys, np.array(part, np.int32), names.view(np.int64), anchor[at].view(np.int64), at, (place - pad[stream])[at], stream[at])


def anchors(pages: DataFrame) -> DataFrame:
    """The anchors of all streams of rows of ``host``, ``k1``, ``k2``, ``html``: ``anchor``, ``page`` (a number of it) and ``outside`` (1 if not in content)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for s in strings(batch):
                # Neighbours mostly share their anchor.
                new = np.append(True, (s.anchor[1:] != s.anchor[:-1]) | (s.stream[1:] != s.stream[:-1]))
                stream = s.stream[new]
                page = s.keys[1].view(np.uint64) ^ mixed(s.keys[2].view(np.uint64))
                yield pa.RecordBatch.from_arrays([pa.array(s.anchor[new]), pa.array(page.view(np.int64)[stream]), pa.array((s.part != IN_CONTENT).astype(np.int32)[stream])], names=["anchor", "page", "outside"])

    return pages.select("host", "k1", "k2", "html").mapInArrow(run, "anchor long, page long, outside int")


def pairs(pages: DataFrame, known: Broadcast | None) -> DataFrame:
    """Strings of all streams whose anchor is among ``known`` (sorted; all if none): ``host``, ``k1``, ``k2``, ``part``, ``pos`` (0 at the first word), ``anchor``, and the names ``a`` and ``b`` of the two halves."""
    schema = T._parse_datatype_string("host long, k1 long, k2 long, part int, pos int, anchor long, a long, b long")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for s in strings(batch):
                if known is None:
                    alive = np.ones(len(s.at), bool)
                elif len(known.value):
                    alive = known.value[np.minimum(np.searchsorted(known.value, s.anchor), len(known.value) - 1)] == s.anchor
                else:
                    continue
                at, stream = s.at[alive], s.stream[alive]
                out = [*(k[stream] for k in s.keys), s.part[stream], s.pos[alive].astype(np.int32), s.anchor[alive], s.names[at], s.names[at + GRAM]]
                yield pa.RecordBatch.from_arrays([pa.array(x) for x in out], names=schema.names)

    return pages.select("host", "k1", "k2", "html").mapInArrow(run, schema)


def repeated(pages: DataFrame) -> DataFrame:
    """Strings on two distinct pages of a host and nowhere in content: ``host``, ``k1``, ``k2``, ``part`` and ``pos``."""
    counted = anchors(pages).groupBy("anchor").agg(F.min("page").alias("low"), F.max("page").alias("high"), F.max("outside").alias("outside"))
    again = materialize(counted.where("low != high and outside = 1").select("anchor"), "html-anchors")
    if again.count() <= KNOWN:
        names = np.sort(again.toArrow().column("anchor").to_numpy())
        alive = pairs(pages, pages.sparkSession.sparkContext.broadcast(names))
    else:
        alive = pairs(pages, None).join(again, "anchor", "left_semi")
    ranked = reranked(materialize(alive.drop("anchor"), "html-pairs"), ["host", "k1", "k2", "part"])
    page = F.struct("k1", "k2")
    boilerplate = ranked.groupBy("rank").agg(F.min(page).alias("low"), F.max(page).alias("high"), F.min("part").alias("least")).where(f"low != high and least > {IN_CONTENT}").select("rank")
    return ranked.join(boilerplate, "rank").select("host", "k1", "k2", "part", "pos")


def keyed(pages: DataFrame) -> DataFrame:
    html = F.coalesce(F.col("html"), F.lit(""))
    return pages.select("page_id", "url", F.xxhash64(host_and_path(F.col("url"))[0]).alias("host"), F.xxhash64(html).alias("k1"), F.xxhash64(F.lit("second"), html).alias("k2"), html.alias("html"))


def main_text(pages: DataFrame) -> DataFrame:
    """Per page: ``page_id``, ``url``, ``text`` (the main text, its blocks joined by a line feed) and ``n_chars``.

    Character references are decoded; white space in a block is one space; blocks without text are
    none. A null or empty html has an empty text; pages of the same html count as one page for
    repetition; a null url has its own host, the empty one; ids may be null or repeated; an empty table
    gives no rows; other columns are not read.
    """
    rows = keyed(pages.select("page_id", "url", "html"))
    spark = pages.sparkSession
    since = mark(spark)
    # Parts in landmarks are covered as well, but the check after it needs no places of theirs.
    covered = repeated(rows).where(F.col("part") == IN_NONE).groupBy("host", "k1", "k2").agg(F.array_sort(F.collect_set("pos")).alias("covered"))
    covered = materialize(covered, "html-covered")
    sweep(spark, since, keep=1)
    small = covered.agg(F.sum(F.size("covered"))).first()[0] or 0
    joined = rows.join(F.broadcast(covered) if small <= BROADCAST else covered, ["host", "k1", "k2"], "left").select("page_id", "url", "html", "covered")
    schema = T.StructType([*(joined.schema[c] for c in ("page_id", "url")), T.StructField("text", T.StringType()), T.StructField("n_chars", T.LongType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [
                extracted(page, places)
                for page, places in zip(batch.column(2).to_pylist(), batch.column(3).to_pylist(), strict=True)
            ]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], names=schema.names)

    return joined.mapInArrow(run, schema)


def extracted(page: str, places: list[int] | None) -> str:
    """The main text of a page, given where boilerplate begins in its blocks that are in no landmark."""
    found = blocks(page)
    own = dict(parts(found))
    # The check by landmarks: content, of which nothing is boilerplate, else what is in none.
    if IN_CONTENT in own:
        return "\n".join(found[i].text for i in own[IN_CONTENT])
    words = [w for i in own.get(IN_NONE, ()) for w in found[i].text.split(" ")]
    owner = [i for i in own.get(IN_NONE, ()) for _ in range(found[i].text.count(" ") + 1)]
    change = np.zeros(len(words) + 1, np.int64)
    for sign, at in ((1, np.array(places or [], np.int64)), (-1, np.array(places or [], np.int64) + LENGTH)):
        np.add.at(change, np.clip(at, 0, len(words)), sign)
    kept = np.cumsum(change)[:-1] == 0
    lines: dict[int, list[str]] = {}
    for i in np.flatnonzero(kept).tolist():
        lines.setdefault(owner[i], []).append(words[i])
    return "\n".join(" ".join(line) for line in lines.values())

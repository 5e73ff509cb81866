"""Benchmark decontamination by a positional inverted index of the documents.

A benchmark item's windows are phrases. Each phrase is led by its rarest terms, by their counts over
all documents; the index stores a posting (document and position) for every occurrence of a leading
term. A phrase's lists are intersected with their positions shifted by the terms' offsets, the rarest
first. What is left is a few places of a document where a phrase would have to stand; the words there
are cut out of the text, which is read once more for these documents alone, and compared with the
phrase, so a match is exact.

Documents are known by a hash of their text, so a group of copies is indexed once. The terms of
the benchmark and its phrases are broadcast only while their counted number is under ``keys.BROADCAST``;
beyond, the same joins are shuffled, and the postings of a term with many are dealt over several tasks.
No text and no array of words is ever shuffled.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from kinfrag.llm.keys import small, text_key
from kinfrag.llm.url_filter import LOWER, UPPER
from kinfrag.plans.scratch import materialize

BREAK = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
#: Words of a window, terms of it that lead to it, and percent of a document that makes it contaminated.
WINDOW, LEADERS, PERCENT = 13, 2, 5
#: Postings of a term that one task takes, about, where they are shuffled.
TERM_ROWS = 100_000


def words_of(text: Column) -> Column:
    """The words of a text, A-Z in lower case; none if it is null."""
    lowered = F.when(F.octet_length(text) == F.length(text), F.lower(text)).otherwise(F.translate(text, UPPER, LOWER))
    return F.coalesce(F.array_remove(F.split(lowered, BREAK), ""), F.array().cast("array<string>"))


def phrases_of(benchmark: DataFrame, window: int = WINDOW) -> DataFrame:
    """One row for each item and window of it: ``item_id``, ``phrase`` and its ``words``."""
    items = benchmark.select("item_id", words_of(F.col("text")).alias("all")).where(F.size("all") > 0)
    starts = F.sequence(F.lit(1), F.greatest(F.lit(1), F.size("all") - F.lit(window - 1)))
    words = F.expr(f"slice(all, at, {window})")
    return items.withColumn("at", F.explode(starts)).select("item_id", words.alias("words")).withColumn("phrase", F.array_join("words", " ")).distinct()


def term_counts(docs: DataFrame, terms: DataFrame, rows: int) -> DataFrame:
    """How often each of ``terms`` stands in the documents: ``term`` and ``n``."""
    return docs.select(F.explode(words_of(F.col("text"))).alias("term")).join(small(terms, rows), "term").groupBy("term").agg(F.count("*").alias("n"))


def leading_terms(phrases: DataFrame, counts: DataFrame, leaders: int = LEADERS) -> DataFrame:
    """The rarest terms of each phrase: ``id``, ``phrase``, ``wanted``, ``length``, ``term``, ``offset``, ``rank`` from 0 and ``salts``.

    A phrase with a term that no document has is left out: nothing can match it.
    """
    placed = phrases.select("phrase", "words").distinct().select("phrase", "words", F.posexplode("words").alias("offset", "term"))
    known = placed.join(counts, "term", "left")
    by_phrase = Window.partitionBy("phrase")
    ranked = known.withColumn("gaps", F.count(F.when(F.col("n").isNull(), 1)).over(by_phrase)).withColumn(
        "rank", F.row_number().over(by_phrase.orderBy("n", "term", "offset")) - 1
    )
    return ranked.where((F.col("gaps") == 0) & (F.col("rank") < leaders)).select(
        F.xxhash64("phrase").alias("id"),
        "phrase",
        F.least(F.lit(leaders), F.size("words")).alias("wanted"),
        F.size("words").alias("length"),
        "term",
        "offset",
        "rank",
        F.expr(f"n div {TERM_ROWS} + 1").alias("salts"),
    )


def build_index(docs: DataFrame, leads: DataFrame, rows: int) -> DataFrame:
    """Postings of the leading terms: ``k1``, ``k2``, ``term``, ``pos`` and ``salt`` (which part of a long list)."""
    terms = leads.groupBy("term").agg(F.max("salts").alias("salts"))
    tokens = docs.select(*text_key(F.col("text")), F.posexplode(words_of(F.col("text"))).alias("pos", "term"))
    return tokens.join(small(terms, rows), "term").select("k1", "k2", "term", "pos", F.pmod(F.xxhash64("k1", "pos"), F.col("salts")).alias("salt")).distinct()


def candidates(index: DataFrame, leads: DataFrame, rows: int) -> DataFrame:
    """Where all leading terms of a phrase stand in place: ``k1``, ``k2``, ``id``, ``start`` and ``length``."""
    # Lists meet by hashes of the phrases, without their words.
    narrow = leads.select("id", "term", "offset", "wanted", "length", F.explode(F.expr("sequence(0L, salts - 1)")).alias("salt"))
    return (
        index.join(small(narrow, rows), ["term", "salt"])
        .withColumn("start", F.col("pos") - F.col("offset"))
        .where("start >= 0")
        .groupBy("k1", "k2", "id", "start", "length")
        .agg(F.count("*").alias("lists"), F.max("wanted").alias("wanted"))
        .where(F.col("lists") == F.col("wanted"))
        .select("k1", "k2", "id", "start", "length")
    )


def phrase_matches(docs: DataFrame, index: DataFrame, leads: DataFrame, rows: int) -> DataFrame:
    """Every exact occurrence of a phrase: ``k1``, ``k2``, ``id``, ``start`` and ``length``."""
    by_text = candidates(index, leads, rows).groupBy("k1", "k2").agg(F.collect_list(F.struct("id", "start", "length")).alias("places"))
    by_text = materialize(by_text, "bench-places")
    asked = docs.select(*text_key(F.col("text")), "text").join(small(by_text, by_text.agg(F.coalesce(F.sum(F.size("places")), F.lit(0))).first()[0]), ["k1", "k2"])
    # The words of a text are split once, and only what stands at its places leaves the expression.
    cut = F.transform(
        F.array(words_of(F.col("text"))),
        lambda w: F.transform(
            F.col("places"),
            lambda p: F.struct(p["id"].alias("id"), p["start"].alias("start"), p["length"].alias("length"), F.array_join(F.slice(w, p["start"] + 1, p["length"]), " ").alias("phrase")),
        ),
    )[0]
    here = asked.select("k1", "k2", F.inline(cut)).distinct()
    return here.join(small(leads.where("rank = 0").select("id", "phrase"), rows), ["id", "phrase"]).select("k1", "k2", "id", "start", "length")


def near_matches(index: DataFrame, leads: DataFrame, rows: int, slop: int) -> DataFrame:
    """Phrases whose two rarest terms stand within ``slop`` places of where the phrase has them.

    Gives ``k1``, ``k2``, ``phrase``, ``start`` (by the rarest term) and ``off`` (places amiss, signed).
    Lists are joined by cells of ``slop + 1`` places, so only neighbours meet.
    """
    narrow = leads.select("phrase", "term", "offset", "rank", F.explode(F.expr("sequence(0L, salts - 1)")).alias("salt"))
    lists = index.join(small(narrow, rows), ["term", "salt"]).withColumn("start", F.col("pos") - F.col("offset"))
    cell = F.floor(F.col("start") / (slop + 1))
    first = lists.where("rank = 0").select("k1", "k2", "phrase", "start", F.explode(F.array(cell - 1, cell, cell + 1)).alias("cell"))
    second = lists.where("rank = 1").select("k1", "k2", "phrase", F.col("start").alias("other"), cell.alias("cell"))
    off = F.col("other") - F.col("start")
    return first.join(second, ["k1", "k2", "phrase", "cell"]).where(F.abs(off) <= slop).select("k1", "k2", "phrase", "start", off.alias("off"))


def judged_documents(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, percent: int = PERCENT) -> DataFrame:
    """Per document: ``doc_id``, ``k1``, ``k2`` (of its text), ``n_words``, ``n_hit``, ``n_items``, ``items_sha256``, ``contaminated``.

    ``n_hit`` counts the words inside any occurrence of a window; ``contaminated`` if there are some
    and they are ``percent`` of all words or more. Null and empty texts have no words; an item
    without words has no window, and one with a null id or a repeated one counts by its id (null as
    an empty string); repeated rows and null ``doc_id`` pass through, one row each; an empty
    benchmark contaminates nothing. Other columns are not read.
    """
    texts = docs.select("doc_id", F.col("text").alias("text"))
    phrases = materialize(phrases_of(benchmark.select("item_id", "text"), window), "bench-phrases")
    terms = phrases.select(F.explode("words").alias("term")).distinct()
    n_terms, n_leads = terms.count(), phrases.select("phrase").distinct().count() * LEADERS
    leads = materialize(leading_terms(phrases, term_counts(texts, terms, n_terms)), "bench-leads")
    index = materialize(build_index(texts, leads, min(n_terms, n_leads)), "bench-index")
    matches = materialize(phrase_matches(texts, index, leads, n_leads), "bench-matches")

    ends = F.transform(F.array_sort("spans"), lambda s: F.struct(s["start"].alias("a"), (s["start"] + s["length"]).alias("b")))
    covered = F.aggregate(
        ends,
        F.struct(F.lit(0).alias("end"), F.lit(0).cast("long").alias("n")),
        lambda s, x: F.struct(F.greatest(s["end"], x["b"]).alias("end"), (s["n"] + F.greatest(F.lit(0), x["b"] - F.greatest(s["end"], x["a"]))).alias("n")),
    )["n"]
    hits = matches.groupBy("k1", "k2").agg(F.collect_set(F.struct("start", "length")).alias("spans")).select("k1", "k2", covered.alias("hit"))
    # Phrases and items are known by hashes until the few that occur are named.
    item = F.coalesce(F.col("item_id").cast("string"), F.lit(""))
    owners = materialize(phrases.select(F.xxhash64("phrase").alias("id"), item.alias("item")).distinct(), "bench-owners")
    named = (
        matches.select("k1", "k2", "id")
        .distinct()
        .join(small(owners, owners.count()), "id")
        .groupBy("k1", "k2")
        .agg(F.array_sort(F.collect_set("item")).alias("ids"))
    )
    by_text = hits.join(named, ["k1", "k2"])
    rows = texts.select("doc_id", *text_key(F.col("text")), F.size(words_of(F.col("text"))).cast("long").alias("n_words"))
    n_hit = F.coalesce(F.col("hit"), F.lit(0)).cast("long")
    ids = F.coalesce(F.col("ids"), F.array().cast("array<string>"))
    return (
        rows.join(by_text, ["k1", "k2"], "left")
        .select("doc_id", "k1", "k2", "n_words", n_hit.alias("n_hit"), F.size(ids).cast("long").alias("n_items"), F.sha2(F.array_join(ids, ","), 256).alias("items_sha256"))
        .withColumn("contaminated", (F.col("n_hit") > 0) & (100 * F.col("n_hit") >= percent * F.col("n_words")))
    )


def contamination(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, percent: int = PERCENT) -> DataFrame:
    """``judged_documents`` without the keys of the texts."""
    return judged_documents(docs, benchmark, window, percent).drop("k1", "k2")

"""URL filters: a blocked Bloom filter before an exact hash join.

The keys of a list (host and path, canonical: no scheme, query or fragment, host in lower
case) are set in a Bloom filter of 64-bit blocks; each key sets ``BITS`` bits of one block. Listed urls
are probed with the distinct canonical urls of the pages. Rules on hosts and path prefixes are probed with
every key that a place could meet; a place is the last host labels and the path, cut to what the
rules can tell apart. Possible hits go to a hash join with the list, which removes false positives.

Filter and lists are broadcast only while their counted size is under ``BROADCAST``
rows; beyond, the same joins are shuffled. Places and urls are made distinct before anything is probed, so a
host with a third of all urls is probed once for each of its path prefixes. What is found is joined to the
pages by broadcast while it is small, else over ``SALTS`` parts of each place.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from kinfrag.plans.scratch import materialize

#: Filter bits for each listed key, and bits that a key sets.
BITS_PER_KEY, BITS = 16, 5
BROADCAST = 200_000
#: Parts that the pages of one place are dealt over where they are shuffled.
SALTS = 8

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def host_and_path(url: Column) -> tuple[Column, Column]:
    """Host and path of a url; both empty if it is null or has no ``://``."""
    at = F.instr(url, "://")
    rest = F.when(at > 0, F.substring(url, at + 3, F.length(url))).otherwise(F.lit(""))
    host = F.translate(F.regexp_extract(rest, r"^([^/?#]*)", 1), UPPER, LOWER)
    return host, F.regexp_extract(rest, r"^[^/?#]*([^?#]*)", 1)


def entries(spark: SparkSession, rules: list[tuple[str, str]], kind: str) -> DataFrame:
    """Rules written as (verdict, ``host/path``) as rows of ``key``, ``verdict`` and ``kind``."""
    rows = [F.struct(F.lit(k).alias("key"), F.lit(v).alias("verdict"), F.lit(kind).alias("kind")) for v, k in rules]
    empty = F.array().cast("array<struct<key:string,verdict:string,kind:string>>")
    return spark.range(1).select(F.inline(F.array(*rows) if rows else empty))


def bloom_parts(key: Column, blocks: int) -> tuple[Column, Column]:
    """The block of a key, and the bits it sets there."""
    spread = F.xxhash64(F.lit("bits"), key)
    mask = F.lit(0).cast("long")
    for i in range(BITS):
        bit = F.shiftrightunsigned(spread, 6 * i).bitwiseAND(F.lit(63)).cast("int")
        mask = mask.bitwiseOR(F.call_function("shiftleft", F.lit(1).cast("long"), bit))
    return F.pmod(F.xxhash64(F.lit("block"), key), F.lit(blocks)), mask


def bloom_filter(listed: DataFrame, blocks: int) -> DataFrame:
    """The filter's blocks that have bits: ``block`` and ``bits``."""
    block, mask = bloom_parts(F.col("key"), blocks)
    return listed.select(block.alias("block"), mask.alias("mask")).groupBy("block").agg(F.bit_or("mask").alias("bits"))


def small(df: DataFrame, rows: int) -> DataFrame:
    return F.broadcast(df) if rows <= BROADCAST else df


def possible(probes: DataFrame, listed: DataFrame, rows: int) -> DataFrame:
    """The ``probes`` (with a ``key``) that the filter of ``listed`` lets pass; ``rows`` are listed."""
    blocks = max(1, rows * BITS_PER_KEY // 64)
    block, mask = bloom_parts(F.col("key"), blocks)
    met = probes.withColumns({"block": block, "mask": mask}).join(small(bloom_filter(listed, blocks), blocks), "block")
    return met.where(F.col("bits").bitwiseAND(F.col("mask")) == F.col("mask")).drop("block", "mask", "bits")


def attach(rows: DataFrame, found: DataFrame, on: list[str]) -> DataFrame:
    """``rows`` with what is ``found`` for them, a row each for ``on``, or nulls."""
    if found.count() <= BROADCAST:
        return rows.join(F.broadcast(found), on, "left")
    dealt = found.withColumn("salt", F.explode(F.array(*map(F.lit, range(SALTS)))))
    return rows.withColumn("salt", F.pmod(F.xxhash64("page_id"), F.lit(SALTS)).cast("int")).join(dealt, [*on, "salt"], "left").drop("salt")


def best_rules(rows: DataFrame, rules: DataFrame) -> tuple[DataFrame, DataFrame]:
    """``rows`` with the place of each (``tail``, ``head``), and for places that a rule fits the best one: ``kind``, ``rule`` and ``ruled``."""
    rules = (
        rules.withColumn("slash", F.instr("key", "/"))
        .withColumn("own_host", F.when(F.col("slash") > 0, F.substring_index("key", "/", 1)).otherwise(F.col("key")))
        .withColumn("own_path", F.when(F.col("slash") > 0, F.expr("substring(key, slash)")).otherwise(F.lit("")))
        .drop("slash")
    )
    shape = rules.agg(
        F.count("*").alias("n"),
        F.max(F.size(F.split("own_host", r"\.", -1))).alias("labels"),
        F.collect_set(F.length("own_path")).alias("lengths"),
    ).first()
    labels, lengths = shape["labels"] or 1, sorted(shape["lengths"]) or [0]
    rows = rows.withColumns({"tail": F.substring_index("host", ".", -labels), "head": F.substring("path", 1, lengths[-1])})
    hosts = F.transform(F.sequence(F.lit(1), F.lit(labels)), lambda i: F.call_function("substring_index", F.col("tail"), F.lit("."), -i))
    cuts = F.filter(F.array(*map(F.lit, lengths)), lambda n: n <= F.length("head"))
    keys = F.flatten(F.transform(F.array_distinct(hosts), lambda h: F.transform(cuts, lambda n: F.concat(h, F.substring(F.col("head"), F.lit(1), n)))))
    probes = rows.select("tail", "head").distinct().withColumn("key", F.explode(keys))
    fits = possible(probes, rules, shape["n"]).join(small(rules.select("key", "kind", "verdict"), shape["n"]), "key")
    best = fits.groupBy("tail", "head").agg(F.max(F.struct((F.col("kind") == "rule").alias("first"), F.length("key").alias("long"))).alias("top"))
    won = fits.join(best, ["tail", "head"]).where(((F.col("kind") == "rule") == F.col("top.first")) & (F.length("key") == F.col("top.long")))
    won = won.groupBy("tail", "head").agg(F.min(F.struct("key", "kind", "verdict")).alias("won"))
    return rows, won.select("tail", "head", "won.kind", F.col("won.key").alias("rule"), F.col("won.verdict").alias("ruled"))


def listed_urls(rows: DataFrame, urls: DataFrame) -> DataFrame:
    """The canonical urls of ``rows`` that are among ``urls``: ``url`` and its verdict, ``said``."""
    n = urls.count()
    hits = possible(rows.select(F.col("url").alias("key")).distinct(), urls, n)
    return hits.join(small(urls, n), "key").select(F.col("key").alias("url"), F.col("verdict").alias("said"))


def url_verdicts(pages: DataFrame, listed: DataFrame, default: str = "allow") -> DataFrame:
    """Per page: ``page_id``, ``host``, ``path``, ``rule``, ``verdict`` and ``listed`` (whether its canonical url is).

    ``listed`` has ``key`` (host, then path from its slash on), ``verdict`` and ``kind``. An entry of
    kind ``rule`` or ``site`` fits its host and all subdomains where the path begins with its own;
    the longest wins, among equally long ones the smallest key, and of one key's verdicts ``block``.
    One of any other kind is a canonical url and fits that host and path alone. Rules decide before all others and are named in
    ``rule``, then urls, then sites. Where none fits, ``default`` holds.

    Null urls and urls without ``://`` have an empty host and path, which no entry fits. Rows pass
    through one for one, repeated ones and null ids too; null keys of the list are left out; other
    columns are not read.
    """
    host, path = host_and_path(F.col("url"))
    rows = pages.select("page_id", "url").select("page_id", host.alias("host"), path.alias("path"))
    rows = rows.withColumn("url", F.concat("host", "path"))
    listed = listed.where(F.col("key").isNotNull()).groupBy("key", "kind").agg(F.max("verdict").alias("verdict"))
    prefix = F.col("kind").isin("rule", "site")
    urls = materialize(listed.where(~prefix & (F.col("key") != "")).groupBy("key").agg(F.max("verdict").alias("verdict")), "url-list")
    rows, ruled = best_rules(rows, listed.where(prefix))
    out = attach(rows, materialize(ruled, "url-rules"), ["tail", "head"])
    out = attach(out, materialize(listed_urls(rows, urls), "url-hits"), ["url"])
    is_rule = F.col("kind") == "rule"
    return out.select(
        "page_id",
        "host",
        "path",
        F.when(is_rule, F.col("rule")).alias("rule"),
        F.coalesce(F.when(is_rule, F.col("ruled")), F.col("said"), F.col("ruled"), F.lit(default)).alias("verdict"),
        F.col("said").isNotNull().alias("listed"),
    )

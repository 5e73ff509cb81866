"""The queries of this subpackage over the driver's tables, each with production parameters."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from kinfrag.llm import decontaminate, html_text, kd_shards, language, mixing, near_dups, quality, repeats, token_counts, url_filter


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts.token_counts(table(spark, sf_dir, "documents"))


def op2_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    return language.language(table(spark, sf_dir, "documents"))


def op3_html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_text.main_text(table(spark, sf_dir, "pages"))


def op4_kd_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    return kd_shards.kd_shards(table(spark, sf_dir, "documents"))


#: Rules of op5, and the sites that decide where neither a rule nor a listed url does.
URL_RULES = [("block", "net/"), ("allow", "example.net/en/"), ("block", "example.com/de/"), ("allow", "org/fr/")]
LISTED_SITES = [
    ("block", f"{host}/")
    for host in ("ads-track.example.com", "adult-x.example.com", "casino-win.example.net", "cheap-pills.example.net", "free-bets.example.net", "spam-farm.example.org")
]
#: First digit of the checksum of canonical urls that are listed: one url in 16.
LISTED_DIGIT = "0"


def listed_urls(pages: DataFrame) -> DataFrame:
    """A list of canonical urls to block: those of ``pages`` that a checksum picks."""
    host, path = url_filter.host_and_path(F.col("url"))
    urls = pages.select(F.concat(host, path).alias("key")).where(F.col("key") != "").distinct()
    return urls.where(F.md5(F.col("key").cast("binary")).startswith(LISTED_DIGIT)).select("key", F.lit("block").alias("verdict"), F.lit("url").alias("kind"))


def op5_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages")
    listed = url_filter.entries(spark, URL_RULES, "rule").unionByName(url_filter.entries(spark, LISTED_SITES, "site")).unionByName(listed_urls(pages))
    return url_filter.url_verdicts(pages, listed)


def op6_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(table(spark, sf_dir, "documents"))


def op7_repeats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repeats.repeats(table(spark, sf_dir, "documents"), with_kept=False)


def op8_near_dups(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_dups.near_dups(table(spark, sf_dir, "documents"))


def op9_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.quality(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op10_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        "op1_token_counts": op1_token_counts,
        "op2_language": op2_language,
        "op3_html_text": op3_html_text,
        "op4_kd_shards": op4_kd_shards,
        "op5_url_filter": op5_url_filter,
        "op6_mixing": op6_mixing,
        "op7_repeats": op7_repeats,
        "op8_near_dups": op8_near_dups,
        "op9_quality": op9_quality,
        "op10_decontaminate": op10_decontaminate,
    }


def _op5_sql() -> str:
    listed = ", ".join(
        f"({i}, '{v}', '{k}', '{k.partition('/')[0]}', '/{k.partition('/')[2]}')"
        for i, rules in ((1, URL_RULES), (0, LISTED_SITES))
        for v, k in rules
    )
    return f"""
WITH l(is_rule, verdict, key, own_host, own_path) AS (VALUES {listed}),
r AS (
  SELECT row_number() OVER () AS row_id, page_id,
    CASE WHEN strpos(url, '://') > 0 THEN substr(url, strpos(url, '://') + 3) ELSE '' END AS rest
  FROM pages),
u AS (
  SELECT row_id, page_id,
    translate(regexp_extract(rest, '^[^/?#]*'), '{url_filter.UPPER}', '{url_filter.LOWER}') AS host,
    regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) AS path
  FROM r),
m AS (
  SELECT u.*, l.*, host || path <> '' AND starts_with(md5(host || path), '{LISTED_DIGIT}') AS listed,
    row_number() OVER (PARTITION BY row_id ORDER BY is_rule DESC NULLS LAST, length(key) DESC, key) AS place
  FROM u LEFT JOIN l ON (host = own_host OR ends_with(host, '.' || own_host)) AND starts_with(path, own_path))
SELECT page_id, host, path, CASE WHEN is_rule = 1 THEN key END AS rule,
  CASE WHEN is_rule = 1 THEN verdict WHEN listed THEN 'block' ELSE coalesce(verdict, 'allow') END AS verdict, listed
FROM m WHERE place = 1
"""


def _op10_sql() -> str:
    words = f"regexp_extract_all(translate(coalesce(text, ''), '{url_filter.UPPER}', '{url_filter.LOWER}'), '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+')"
    return f"""
WITH d AS (SELECT row_number() OVER () AS rid, doc_id, {words} AS w FROM documents),
b AS (SELECT item_id, w, least(13, len(w)) AS n FROM (SELECT item_id, {words} AS w FROM benchmark) WHERE len(w) > 0),
bw AS (SELECT DISTINCT item_id, n, array_to_string(w[s:s + n - 1], ' ') AS g
       FROM (SELECT *, unnest(range(1, len(w) - n + 2)) AS s FROM b)),
dg AS (SELECT rid, n, s, array_to_string(w[s:s + n - 1], ' ') AS g
       FROM (SELECT rid, w, n, unnest(range(1, len(w) - n + 2)) AS s FROM d, (SELECT DISTINCT n FROM bw))),
m AS (SELECT rid, item_id, s, n FROM dg JOIN bw USING (n, g)),
h AS (SELECT rid, count(DISTINCT p) AS n_hit FROM (SELECT rid, unnest(range(s, s + n)) AS p FROM m) GROUP BY rid),
i AS (SELECT rid, count(*) AS n_items, string_agg(x, ',' ORDER BY x) AS ids
      FROM (SELECT DISTINCT rid, coalesce(CAST(item_id AS VARCHAR), '') AS x FROM m) GROUP BY rid)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(n_hit, 0) AS BIGINT) AS n_hit,
  CAST(coalesce(n_items, 0) AS BIGINT) AS n_items, sha256(coalesce(ids, '')) AS items_sha256,
  coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(w) AS contaminated
FROM d LEFT JOIN h USING (rid) LEFT JOIN i USING (rid)
"""


def oracle_sql() -> dict[str, str]:
    return {
        "op5_url_filter": _op5_sql(),
        "op10_decontaminate": _op10_sql(),
    }

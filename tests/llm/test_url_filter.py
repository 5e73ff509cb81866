import random

import duckdb

from kinfrag.llm import catalog, url_filter
from pyspark.sql import functions as F

URLS = [None, "", "no scheme.net/en/", "https://", "https://A.Example.NET/en/x?q#f", "http://example.net/EN/", "x://net", "x://net/", "x://xnet/", "x://a.b.example.com/de/1", "x://a.org/fr/", "x://a.org/fr", "x://a.org?/fr/", "x://a.org#/fr/", "x://spam-farm.example.org/fr/", "x://www.spam-farm.example.org/", "x://a.net?x", "x://net:80/", "a://b://net/", "x://.net/", "x://net./", "x://é.net/ü", "x://" + "a." * 3000 + "net/" + "p" * 5000]


def brute(url, listed):
    rest = url.split("://", 1)[1] if url and "://" in url else ""
    ends = [i for i in (rest.find(c) for c in "/?#") if i >= 0]
    host = "".join(c.lower() if c.isascii() else c for c in (rest[: min(ends)] if ends else rest))
    path = rest[len(host) :]
    path = path[: min([i for i in (path.find(c) for c in "?#") if i >= 0] or [len(path)])]
    best = {}
    for verdict, key, kind in listed:
        h, slash, p = key.partition("/")
        fits = (host == h or host.endswith("." + h)) and path.startswith(slash + p) if kind != "url" else key == host + path != ""
        if fits:
            # The longest key, of these the smallest; of one key's verdicts the greatest.
            mine = (-len(key), key)
            if kind not in best or mine < best[kind][0]:
                best[kind] = (mine, key, verdict)
            elif mine == best[kind][0]:
                best[kind] = (mine, key, max(verdict, best[kind][2]))
    won = best.get("rule") or best.get("url") or best.get("site")
    return host, path, best["rule"][1] if "rule" in best else None, won[2] if won else "allow", "url" in best


LISTED = [(v, k, "rule") for v, k in catalog.URL_RULES] + [(v, k, "site") for v, k in catalog.LISTED_SITES] + [("block", "a.org/fr", "url"), ("allow", "spam-farm.example.org/fr/", "url"), ("block", "net", "url"), ("block", "", "url")]


def entries(spark, listed):
    return spark.createDataFrame(listed or [], "verdict string, key string, kind string").select("key", "verdict", "kind")


def check(spark, urls, listed):
    pages = [(i, u, "z", 1) for i, u in enumerate(urls)] + [(None, u, "z", 1) for u in urls[:3]] + [(0, urls[0], "z", 1)]
    got = url_filter.url_verdicts(spark.createDataFrame(pages, "page_id long, url string, host string, key int"), entries(spark, listed)).collect()
    assert sorted(map(repr, map(tuple, got))) == sorted(repr((i, *brute(u, listed))) for i, u, _, _ in pages)


def test_edges(spark):
    check(spark, URLS + URLS, LISTED)
    check(spark, URLS, [])
    assert url_filter.url_verdicts(spark.createDataFrame([], "page_id long, url string"), entries(spark, LISTED)).count() == 0


def test_random_lists_broadcast_or_not(spark, monkeypatch):
    rng = random.Random(5)
    part = lambda n: "".join(rng.choice("ab") for _ in range(rng.randint(1, n)))
    hosts = [".".join(part(2) for _ in range(rng.randint(1, 4))) for _ in range(60)]
    keys = {h + "/" + part(3) + rng.choice(["", "/"]) for h in hosts}
    listed = [(rng.choice(["block", "allow"]), k, rng.choice(["rule", "site", "url"])) for k in sorted(keys)]
    urls = [f"h://{part(2)}.{rng.choice(hosts)}/{part(4)}/{part(2)}" for _ in range(400)]
    listed += [(rng.choice(["block", "allow"]), k, "url") for k in sorted({u.split("://")[1] for u in urls}) if rng.random() < 0.3]
    check(spark, urls, listed)
    monkeypatch.setattr(url_filter, "BROADCAST", 0)
    check(spark, urls, listed)


def test_filter_has_no_false_negative(spark):
    listed = spark.range(5000).select(F.concat(F.lit("h"), F.col("id"), F.lit(".net/")).alias("key"))
    block, mask = url_filter.bloom_parts(F.col("key"), 1250)
    bloom = url_filter.bloom_filter(listed, 1250)
    probe = lambda df: df.select(block.alias("block"), mask.alias("mask")).join(bloom, "block").where(F.col("bits").bitwiseAND(F.col("mask")) == F.col("mask")).count()
    assert probe(listed) == 5000
    others = spark.range(5000).select(F.concat(F.lit("x"), F.col("id"), F.lit(".net/")).alias("key"))
    assert probe(others) < 500


def test_query_equals_its_sql(spark, sf_dir):
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet").toPandas()
    con = duckdb.connect()
    con.register("pages", pages)
    want = con.execute(catalog.oracle_sql()["op5_url_filter"]).fetchall()
    got = [tuple(r) for r in catalog.op5_url_filter(spark, sf_dir).collect()]
    assert sorted(map(repr, got)) == sorted(map(repr, want))

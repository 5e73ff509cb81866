"""The engine's queries over the driver's tables, and the same in SQL.

The driver's star schema stands for the engine's relations: nations are terms, regions their
taxonomy, customers the persons; a customer "has" the nations of the suppliers of their orders and the
part types they bought. Relations are built once for each folder of tables and kept for the session.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from kinfrag.engine import Engine
from kinfrag.operators import clustering, similarity, taxonomy
from kinfrag.operators.fragments import fragment_derived, fragment_primary, localized
from kinfrag.plans.scratch import scratch_root
from kinfrag.schema import ILL, INFO, TREAT, FragmentationSpec
from kinfrag.sources import files

ALPHA = 0.3
#: Terms that the queries select: D1 and D2 in one fragment, D3 in another.
D1, D2, D3 = "NATION_7", "NATION_12", "NATION_8"

Query = Callable[[SparkSession, str], DataFrame]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


# --- the driver's tables as the engine's relations


def taxonomy_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    nation, region = (table(spark, sf_dir, t) for t in ("nation", "region"))
    up = nation.join(region, F.col("n_regionkey") == F.col("r_regionkey")).select(F.col("n_name").alias("child"), F.concat(F.lit("region/"), "r_name").alias("parent"))
    return up.union(region.select(F.concat(F.lit("region/"), "r_name"), F.lit("root")))


def terms(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "nation").select(F.col("n_name").alias("term")).distinct()


def lengths(spark: SparkSession, sf_dir: str) -> DataFrame:
    return taxonomy.path_lengths(taxonomy_edges(spark, sf_dir), terms(spark, sf_dir))


def relations(spark: SparkSession, sf_dir: str) -> dict[str, DataFrame]:
    t = {n: table(spark, sf_dir, n) for n in ("customer", "orders", "lineitem", "supplier", "nation", "part")}
    info = t["customer"].select(F.col("c_custkey").cast("int").alias("id"), F.col("c_name").alias("name"), F.col("c_mktsegment").alias("address"), (F.col("c_custkey") % 120).cast("int").alias("age"))
    bought = t["orders"].join(t["lineitem"], F.col("o_orderkey") == F.col("l_orderkey"))
    named = t["supplier"].join(t["nation"], F.col("s_nationkey") == F.col("n_nationkey"))
    ill = bought.join(named, F.col("l_suppkey") == F.col("s_suppkey")).select(F.col("o_custkey").cast("int").alias("id"), F.col("n_name").alias("disease"), F.concat(F.lit("C"), F.col("n_nationkey").cast("string")).alias("cui")).distinct()
    treat = bought.join(t["part"], F.col("l_partkey") == F.col("p_partkey")).groupBy(F.col("o_custkey").cast("int").alias("id"), F.col("p_type").alias("prescription")).agg(F.bool_or(F.col("l_returnflag") != "R").alias("success"))
    return {"INFO": info.select(*INFO.fieldNames()), "ILL": ill.select(*ILL.fieldNames()), "TREAT": treat.select(*TREAT.fieldNames())}


_engines: dict[tuple[str, str], Engine] = {}


def engine(spark: SparkSession, sf_dir: str) -> Engine:
    """The engine over a folder's relations, which are written when first asked for."""
    key = (spark.sparkContext.applicationId, sf_dir)
    if key not in _engines:
        tag = hashlib.sha1("/".join(key).encode()).hexdigest()[:16]
        sim = similarity.from_lengths(lengths(spark, sf_dir))
        _engines[key] = Engine.build(spark, f"{scratch_root(spark)}/relations-{tag}", relations(spark, sf_dir), sim, terms(spark, sf_dir), ALPHA)
    return _engines[key]


def _clustered(spark: SparkSession, sf_dir: str) -> tuple[clustering.Clustering, DataFrame]:
    sim = similarity.from_lengths(lengths(spark, sf_dir))
    return clustering.cluster(terms(spark, sf_dir), sim, ALPHA), sim


# --- operators


def pairwise_path_length(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lengths(spark, sf_dir)


def pairwise_similarity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return similarity.from_lengths(lengths(spark, sf_dir))


def similarity_lookup(spark: SparkSession, sf_dir: str) -> DataFrame:
    own = terms(spark, sf_dir)
    pairs = own.select(F.col("term").alias("term1")).join(own.select(F.col("term").alias("term2")), F.col("term1") >= F.col("term2"))
    return similarity.lookup(pairs, pairwise_similarity(spark, sf_dir))


def term_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return files.term_pairs(terms(spark, sf_dir))


def cluster_membership(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _clustered(spark, sf_dir)[0].membership


def cluster_statistics(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _clustered(spark, sf_dir)[0].statistics()


def identify_cluster(spark: SparkSession, sf_dir: str) -> DataFrame:
    made, sim = _clustered(spark, sf_dir)
    return clustering.identify(terms(spark, sf_dir), made.heads, sim)


def identify_top1(spark: SparkSession, sf_dir: str) -> DataFrame:
    made, sim = _clustered(spark, sf_dir)
    return clustering.identify_top(terms(spark, sf_dir), made.heads, sim)


def fragment_assignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = engine(spark, sf_dir)
    return fragment_primary(e.store.logical("ILL"), e.store.assign, e.spec)


def _derived(name: str) -> Query:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        e = engine(spark, sf_dir)
        return fragment_derived(e.store.logical(name), e.store.fragmented("ILL"), e.spec)

    return run


def fragment_sizes(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = engine(spark, sf_dir)
    parts = [e.store.fragmented(t).groupBy("frag_id").agg(F.count("*").alias("n_rows")).select(F.lit(t).alias("relation"), "frag_id", "n_rows") for t in FragmentationSpec().schemas]
    return parts[0].unionByName(parts[1]).unionByName(parts[2])


def fragment_union_distinct(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = engine(spark, sf_dir)
    return localized(e.store.fragmented("ILL").select("disease", "cui", "frag_id"), e.spec, union_distinct=True)


def flex_builder(spark: SparkSession, sf_dir: str) -> DataFrame:
    q = engine(spark, sf_dir).query(i="ILL", p="INFO").term("i", D1).where(F.col("p.age") < 50)
    return q.frame(relaxed=True).select("p.id", "p.name", "p.address", "p.age", "i.disease")


# --- the query corpus: text, whether it is relaxed, and its own SQL over the relations

_SAME = "(SELECT b.term FROM assign a JOIN assign b ON a.frag_id = b.frag_id WHERE a.term = '{}')"


def _in(column: str, term: str) -> str:
    return f"{column} IN {_SAME.format(term)}"


EXACT = {
    "exact_q1": f"SELECT who.id, who.name, who.age FROM INFO who JOIN ILL has ON has.id = who.id WHERE has.disease = '{D1}'",
    "exact_q2": f"SELECT who.id, who.address FROM ILL one, INFO who, ILL two WHERE one.id = who.id AND two.id = who.id AND one.disease = '{D1}' AND two.disease = '{D3}' AND who.age >= 5",
    "exact_q3": f"SELECT got.id, got.prescription, got.success FROM TREAT got JOIN ILL has ON has.id = got.id WHERE has.disease = '{D1}'",
    "exact_q4": f"SELECT who.name, has.cui, got.prescription FROM INFO who JOIN ILL has ON has.id = who.id JOIN TREAT got ON got.id = has.id WHERE has.disease = '{D1}'",
    "exact_q5": f"SELECT got.prescription, one.cui AS cui1, two.cui AS cui2 FROM TREAT got, ILL one, ILL two WHERE one.id = got.id AND two.id = one.id AND one.disease = '{D1}' AND two.disease = '{D2}'",
    "avg_age_q6": "SELECT CAST(avg(who.age) AS DOUBLE) AS mean_age, min(who.age) AS youngest FROM INFO who",
    "distinct_q7": f"SELECT DISTINCT who.address, who.age FROM INFO who JOIN ILL has ON has.id = who.id WHERE has.disease = '{D1}'",
    "distinct_q8": f"SELECT DISTINCT who.address, who.age FROM ILL one, INFO who, ILL two WHERE one.id = who.id AND two.id = who.id AND one.disease = '{D1}' AND two.disease = '{D3}'",
    "localized_q9": "SELECT who.*, has.disease FROM INFO who JOIN ILL has ON has.id = who.id",
    "count_by_name_q10": "SELECT who.address, count(has.cui) AS n_ills FROM INFO who JOIN ILL has ON has.id = who.id GROUP BY who.address ORDER BY count(has.cui) DESC",
    "theta_q11": "SELECT who.id, one.cui AS cui1, two.cui AS cui2 FROM INFO who, ILL one, ILL two WHERE one.id = who.id AND two.id = who.id AND one.disease <> two.disease",
    "unaliased_q12": f"SELECT ILL.disease, ILL.id, who.address FROM ILL JOIN INFO who ON who.id = ILL.id WHERE ILL.disease = '{D1}'",
    "reversed_q13": f"SELECT who.id, who.age FROM INFO who, ILL one, ILL two WHERE one.id = who.id AND two.id = who.id AND '{D2}' = one.disease AND '{D3}' = two.disease",
    "group_q14": f"SELECT disease, count(DISTINCT id) AS n_persons FROM ILL WHERE '{D1}' = disease GROUP BY disease",
    "group_q15": "SELECT ILL.cui, who.address, got.prescription FROM ILL, TREAT got, INFO who WHERE got.id = ILL.id AND who.id = ILL.id GROUP BY ILL.cui, who.address, got.prescription",
    "having_topk": f"SELECT got.prescription, count(*) AS times FROM TREAT got JOIN ILL has ON has.id = got.id WHERE has.disease = '{D1}' GROUP BY got.prescription HAVING count(*) > 1 ORDER BY times DESC, got.prescription LIMIT 15",
    "join_on": f"SELECT who.age, got.prescription FROM ILL has JOIN INFO who ON has.id = who.id JOIN TREAT got ON got.id = who.id AND got.success WHERE has.disease = '{D1}' AND who.age > 25",
    "or_not_routed": f"SELECT has.id, has.cui FROM ILL has JOIN INFO who ON has.id = who.id WHERE has.disease = '{D1}' OR who.age > 7",
    "anti_join_no_condition": f"SELECT who.id, who.age * 100 AS load FROM INFO who WHERE who.id NOT IN (SELECT has.id FROM ILL has WHERE has.disease <> '{D3}' AND has.id % 2 = 0)",
    "quoted_term": f"SELECT has.id, 'it''s' AS mark FROM ILL has WHERE has.disease <> 'Sjogren''s Syndrome' AND has.disease = '{D1}'",
}

#: Relaxed queries with the SQL of their answers.
RELAXED = {
    "relaxed_x1": (f"SELECT who.* FROM ILL has JOIN INFO who ON who.id = has.id WHERE has.disease = '{D1}'", f"SELECT p.* FROM info p JOIN ill i USING (id) WHERE {_in('i.disease', D1)}"),
    "relaxed_x2": (f"SELECT who.id, who.name FROM ILL has, INFO who WHERE who.id = has.id AND who.age < 45 AND has.disease = '{D1}'", f"SELECT p.id, p.name FROM info p JOIN ill i USING (id) WHERE {_in('i.disease', D1)} AND p.age < 45"),
    "relaxed_x3": (
        f"SELECT who.id, who.age FROM ILL one, ILL two, INFO who WHERE one.id = who.id AND two.id = who.id AND one.disease = '{D1}' AND two.disease = '{D2}'",
        f"SELECT p.id, p.age FROM info p JOIN ill a USING (id) JOIN ill b USING (id) WHERE {_in('a.disease', D1)} AND {_in('b.disease', D2)}",
    ),
    "relaxed_x4": (
        f"SELECT me.id, me.address FROM ILL one, INFO me, ILL two, INFO again WHERE one.id = me.id AND two.id = again.id AND two.id = one.id AND two.disease = '{D3}' AND one.disease = '{D1}'",
        f"SELECT p.id, p.address FROM info p JOIN ill a USING (id) JOIN ill b USING (id) WHERE {_in('a.disease', D1)} AND {_in('b.disease', D3)}",
    ),
    "relaxed_x5": (f"SELECT * FROM ILL WHERE '{D1}' = disease", f"SELECT * FROM ill WHERE {_in('disease', D1)}"),
    "relaxed_x6": (f"SELECT has.cui, who.address FROM ILL has JOIN INFO who ON who.id = has.id AND who.age > 30 WHERE has.disease = '{D1}'", f"SELECT i.cui, p.address FROM info p JOIN ill i USING (id) WHERE {_in('i.disease', D1)} AND p.age > 30"),
    "relaxed_x7": (f"SELECT has.id, has.disease FROM ILL has WHERE has.disease = '{D1}'", f"SELECT i.id, i.disease FROM ill i WHERE {_in('i.disease', D1)}"),
    "relaxed_group": (f"SELECT has.cui, count(*) AS times FROM TREAT got JOIN ILL has ON has.id = got.id WHERE has.disease = '{D1}' GROUP BY has.cui", f"SELECT i.cui, count(*) AS times FROM ill i JOIN treat t USING (id) WHERE {_in('i.disease', D1)} GROUP BY i.cui"),
}


def _corpus(sql: str, relaxed: bool) -> Query:
    return lambda spark, sf_dir: engine(spark, sf_dir).sql(sql, relaxed=relaxed)


def relaxed_with_term(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first relaxed query with the term that each row was found by."""
    return engine(spark, sf_dir).sql(RELAXED["relaxed_x1"][0], relaxed=True, with_relaxed_term=True)


def relaxed_in_list(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A relaxed query over plain relations: the selection becomes a list of terms."""
    e = engine(spark, sf_dir)
    return Engine(spark, e.store, "baseline").sql(RELAXED["relaxed_x7"][0], relaxed=True)


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _corpus(RELAXED["relaxed_x1"][0], True)(spark, sf_dir)


def queries() -> dict[str, Query]:
    found: dict[str, Query] = {
        f.__name__: f
        for f in (pairwise_path_length, pairwise_similarity, similarity_lookup, term_pairs, cluster_membership, cluster_statistics, identify_cluster, identify_top1, fragment_assignment)
    }
    found |= {"derived_info_fragment": _derived("INFO"), "derived_treat_fragment": _derived("TREAT")}
    found |= {f.__name__: f for f in (fragment_sizes, fragment_union_distinct, flex_builder)}
    found |= {name: _corpus(sql, False) for name, sql in EXACT.items()}
    found |= {name: _corpus(sql, True) for name, (sql, _) in RELAXED.items()}
    return found | {f.__name__: f for f in (relaxed_with_term, relaxed_in_list)}


# --- the same in SQL

_WITH = """WITH RECURSIVE terms AS (SELECT DISTINCT n_name t, n_regionkey r FROM nation),
sim AS (SELECT a.t t1, b.t t2, CASE WHEN a.r = b.r THEN 2 ELSE 4 END len FROM terms a JOIN terms b ON a.t <> b.t),
g(step, heads) AS (
  SELECT 0, [min(t)] FROM terms
  UNION ALL
  SELECT step + 1, list_append(heads, nxt) FROM (
    SELECT g.step, g.heads,
      (SELECT x.t FROM (SELECT s.t2 AS t, max({'s': 1.0 / s.len, 'k': list_position(g.heads, s.t1)}) m FROM sim s
                        WHERE list_contains(g.heads, s.t1) AND NOT list_contains(g.heads, s.t2) GROUP BY s.t2) x
       WHERE x.m.s < 0.3 ORDER BY x.m.s, x.m.k, x.t LIMIT 1) nxt
    FROM g) WHERE nxt IS NOT NULL),
fin AS (SELECT heads FROM g ORDER BY step DESC LIMIT 1),
heads AS (SELECT CAST(unnest(range(len(heads))) AS INTEGER) cluster_id, unnest(heads) head FROM fin),
ranked AS (SELECT t.t term, h.cluster_id, h.head,
    row_number() OVER (PARTITION BY t.t ORDER BY CASE WHEN t.t = h.head THEN 2.0 ELSE 1.0 / s.len END DESC, h.cluster_id) low,
    row_number() OVER (PARTITION BY t.t ORDER BY CASE WHEN t.t = h.head THEN 2.0 ELSE 1.0 / s.len END DESC, h.cluster_id DESC) high
  FROM terms t CROSS JOIN heads h LEFT JOIN sim s ON s.t1 = t.t AND s.t2 = h.head),
assign AS (SELECT term, cluster_id AS frag_id, head FROM ranked WHERE low = 1),
info AS (SELECT CAST(c_custkey AS INTEGER) id, c_name AS name, c_mktsegment AS address, CAST(c_custkey % 120 AS INTEGER) age FROM customer),
ill AS (SELECT DISTINCT CAST(o_custkey AS INTEGER) id, n_name AS disease, 'C' || CAST(n_nationkey AS VARCHAR) AS cui
  FROM orders JOIN lineitem ON o_orderkey = l_orderkey JOIN supplier ON l_suppkey = s_suppkey JOIN nation ON s_nationkey = n_nationkey),
treat AS (SELECT CAST(o_custkey AS INTEGER) id, p_type AS prescription, bool_or(l_returnflag <> 'R') AS success
  FROM orders JOIN lineitem ON o_orderkey = l_orderkey JOIN part ON l_partkey = p_partkey GROUP BY 1, 2),
ill_f AS (SELECT ill.*, frag_id FROM ill JOIN assign ON disease = term),
homes AS (SELECT DISTINCT id, frag_id FROM ill_f),
info_f AS (SELECT info.*, frag_id FROM info JOIN homes USING (id)),
treat_f AS (SELECT treat.*, frag_id FROM treat JOIN homes USING (id))
"""

_OWN = {
    "pairwise_path_length": "SELECT t1 AS term1, t2 AS term2, CAST(len AS INTEGER) AS length FROM sim WHERE t1 < t2",
    "pairwise_similarity": "SELECT t1 AS term1, t2 AS term2, CAST(1.0 AS DOUBLE) / len AS simvalue FROM sim WHERE t1 < t2",
    "similarity_lookup": "SELECT a.t AS term1, b.t AS term2, CASE WHEN a.t = b.t THEN CAST(1.0 AS DOUBLE) ELSE CAST(1.0 AS DOUBLE) / len END AS simvalue FROM terms a JOIN terms b ON a.t >= b.t LEFT JOIN sim ON a.t = t1 AND b.t = t2",
    "term_pairs": "SELECT a.t AS term1, b.t AS term2 FROM terms a JOIN terms b ON a.t < b.t",
    "cluster_membership": "SELECT cluster_id, head, term, term = head AS is_head FROM ranked WHERE high = 1",
    "cluster_statistics": "SELECT CAST(sum(n) AS BIGINT) AS n_terms, count(*) AS n_clusters, CAST(sum(n) // count(*) AS BIGINT) AS avg_size, min(n) AS min_size, max(n) AS max_size FROM (SELECT count(*) n FROM ranked WHERE high = 1 GROUP BY cluster_id)",
    "identify_cluster": "SELECT term, frag_id FROM assign",
    "identify_top1": "SELECT term, head, frag_id FROM assign",
    "fragment_assignment": "SELECT id, disease, cui, frag_id FROM ill_f",
    "derived_info_fragment": "SELECT * FROM info_f",
    "derived_treat_fragment": "SELECT * FROM treat_f",
    "fragment_sizes": "SELECT 'ILL' AS relation, frag_id, count(*) AS n_rows FROM ill_f GROUP BY 2 UNION ALL SELECT 'INFO', frag_id, count(*) FROM info_f GROUP BY 2 UNION ALL SELECT 'TREAT', frag_id, count(*) FROM treat_f GROUP BY 2",
    "fragment_union_distinct": "SELECT DISTINCT disease, cui FROM ill",
    "flex_builder": f"SELECT p.*, i.disease FROM ill i JOIN info p USING (id) WHERE {_in('i.disease', D1)} AND p.age < 50".replace("p.*", "p.id, p.name, p.address, p.age"),
    "relaxed_with_term": f"SELECT p.*, i.disease FROM info p JOIN ill i ON p.id = i.id WHERE {_in('i.disease', D1)}",
    "relaxed_in_list": f"SELECT i.id, i.disease FROM ill i WHERE {_in('i.disease', D1)}",
}


def oracle_sql() -> dict[str, str]:
    own = _OWN | EXACT | {name: sql for name, (_, sql) in RELAXED.items()}
    return {name: _WITH + sql for name, sql in own.items()}

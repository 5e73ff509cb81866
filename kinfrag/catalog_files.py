"""Queries over formats, storage and models: what is written is read back, over the driver's tables.

Nations and regions stand for a tree of descriptors: region ``r`` is ``C01.<100 + r>``, nation ``n`` one level below.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from kinfrag import catalog as base
from kinfrag.engine import Engine
from kinfrag.functions import rows as shown
from kinfrag.operators import clustering, similarity, taxonomy
from kinfrag.operators.fragments import with_cuis
from kinfrag.plans.scratch import scratch_root
from kinfrag.schema import INFO, FragmentationSpec
from kinfrag.sources import files
from kinfrag.sources.generator import generate
from kinfrag.sources.store import Store

D1, D2, D3 = base.D1, base.D2, base.D3


def place(spark: SparkSession, name: str) -> str:
    return f"{scratch_root(spark)}/files-{name}-{uuid.uuid4().hex}"


def written(df: DataFrame, name: str, *values) -> str:
    """The path of a text file of one line for each row."""
    path = place(df.sparkSession, name)
    df.select(F.concat(*values)).write.text(path)
    return path


# --- sources


def term_list(spark: SparkSession, sf_dir: str) -> DataFrame:
    twice = base.terms(spark, sf_dir).union(base.terms(spark, sf_dir))
    return files.read_terms(spark, written(twice, "terms", "term"))


def similarity_file(spark: SparkSession, sf_dir: str) -> DataFrame:
    cui = lambda c: F.concat(F.lit("(C"), F.substring(c, 8, 2), F.lit(")"))
    pairs = base.pairwise_similarity(spark, sf_dir)
    path = written(pairs, "similarities", F.col("simvalue").cast("string"), F.lit("<>"), "term1", cui(F.col("term1")), F.lit("<>"), "term2", cui(F.col("term2")))
    return files.read_similarities(spark, path)


def similarity_file_cuis(spark: SparkSession, sf_dir: str) -> DataFrame:
    return files.terms_with_cuis(similarity_file(spark, sf_dir))


def _lengths_file(spark: SparkSession, sf_dir: str) -> str:
    path = place(spark, "lengths")
    files.write_path_lengths(base.lengths(spark, sf_dir), path)
    return path


def length_file(spark: SparkSession, sf_dir: str) -> DataFrame:
    return files.read_path_lengths(spark, _lengths_file(spark, sf_dir))


def length_file_similarity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return similarity.from_lengths(length_file(spark, sf_dir))


def length_file_terms(spark: SparkSession, sf_dir: str) -> DataFrame:
    return files.term_set(length_file(spark, sf_dir))


def longest_paths(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Path lengths of the first ten terms, written and read."""
    few = base.terms(spark, sf_dir).orderBy("term").limit(10)
    path = place(spark, "first-lengths")
    files.write_path_lengths(taxonomy.path_lengths(base.taxonomy_edges(spark, sf_dir), few), path)
    return files.read_path_lengths(spark, path)


def stored_similarity(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = place(spark, "similarity-table")
    files.write_similarities(base.pairwise_similarity(spark, sf_dir), path)
    return files.read_written_similarities(spark, path)


def pair_file(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = place(spark, "pairs")
    files.write_term_pairs(files.term_pairs(base.terms(spark, sf_dir), 12), path)
    return spark.read.text(path).select(F.col("value").alias("line"))


def sampled_terms(spark: SparkSession, sf_dir: str) -> DataFrame:
    picked = files.sample_terms(base.terms(spark, sf_dir), 10)
    return picked.agg(F.count("*").alias("n"), F.count_distinct("term").alias("n_distinct"))


def first_terms(spark: SparkSession, sf_dir: str) -> DataFrame:
    return base.terms(spark, sf_dir).orderBy("term").limit(7)


def example_similarity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return similarity.example(spark)


def tree(spark: SparkSession, sf_dir: str) -> DataFrame:
    nation, region = (base.table(spark, sf_dir, t) for t in ("nation", "region"))
    number = lambda c: (F.col(c) + 100).cast("string")
    top = spark.createDataFrame([("C01", "World"), ("D01", "Elsewhere")], "tree_number string, descriptor string")
    regions = region.select(F.concat(F.lit("C01."), number("r_regionkey")), "r_name")
    nations = nation.select(F.concat(F.lit("C01."), number("n_regionkey"), F.lit("."), number("n_nationkey")), "n_name")
    return top.union(regions).union(nations)


def tree_file(spark: SparkSession, sf_dir: str) -> DataFrame:
    return files.read_tree(spark, written(tree(spark, sf_dir), "tree", "tree_number", F.lit(","), "descriptor"))


def tree_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    return taxonomy.tree_edges(tree(spark, sf_dir))


def tree_path_lengths(spark: SparkSession, sf_dir: str) -> DataFrame:
    return taxonomy.tree_path_lengths(tree(spark, sf_dir))


def tree_similarity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Similarities of all descriptors of the tree, written and read."""
    path = place(spark, "tree-similarity")
    files.write_similarities(similarity.from_lengths(tree_path_lengths(spark, sf_dir)), path)
    return files.read_written_similarities(spark, path)


def branch_terms(spark: SparkSession, sf_dir: str) -> DataFrame:
    return files.disease_terms(tree(spark, sf_dir))


def descriptor_file(spark: SparkSession, sf_dir: str) -> DataFrame:
    nation = base.table(spark, sf_dir, "nation")
    return files.read_descriptors(spark, written(nation, "descriptors", F.lit("D"), F.col("n_nationkey").cast("string"), F.lit("|"), "n_name"))


def branch_identifiers(spark: SparkSession, sf_dir: str) -> DataFrame:
    own = base.terms(spark, sf_dir).union(spark.createDataFrame([("Elsewhere",)], "term string"))
    return files.term_identifiers(tree(spark, sf_dir), own, descriptor_file(spark, sf_dir).where("id != 'D7'"))


def descriptor_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    nation = base.table(spark, sf_dir, "nation")
    lang = F.when(F.col("n_regionkey") == 0, F.lit("@de")).otherwise(F.lit(files.LANGUAGE))
    raw = nation.select(F.concat(F.lit(files.PREFIX), F.lit("D"), F.col("n_nationkey").cast("string"), F.lit('|"'), "n_name", F.lit('"'), lang).alias("value"))
    return files.descriptor_lines(raw)


# --- storage


def fragment_views(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows of the views of single fragments."""
    e = base.engine(spark, sf_dir)
    e.register(fragments=True)
    number = e.lookup.get(D1)
    parts = [spark.table(f"{t}_{number}").agg(F.count("*").alias("n_rows")).select(F.lit(t).alias("relation"), "n_rows") for t in e.spec.schemas]
    return parts[0].union(parts[1]).union(parts[2])


def _small_store(spark: SparkSession, sf_dir: str) -> Store:
    """A store of the persons with small keys."""
    e = base.engine(spark, sf_dir)
    store = Store(spark, place(spark, "store"), FragmentationSpec())
    store.create({t: e.store.logical(t).where("id % 10 = 1") for t in e.spec.schemas}, e.store.assign)
    return store


def _sizes(store: Store) -> DataFrame:
    out = None
    for t in store.spec.schemas:
        for kind, df in (("logical", store.logical(t)), ("fragments", store.fragmented(t))):
            one = df.agg(F.count("*").alias("n_rows")).select(F.lit(t).alias("relation"), F.lit(kind).alias("kind"), "n_rows")
            out = one if out is None else out.union(one)
    return out


def store_append(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sizes after more rows were added, some of which were there before."""
    store, whole = _small_store(spark, sf_dir), base.engine(spark, sf_dir).store
    for t in ("INFO", "ILL", "TREAT"):
        more = whole.logical(t).where("id % 10 IN (1, 2)")
        store.append(t, more.union(more))
    return _sizes(store)


def store_upsert(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Persons after some were replaced and one was added."""
    store = _small_store(spark, sf_dir)
    rows = store.logical("INFO").where("id % 20 = 1").select("id", "name", "address", F.lit(-1).alias("age"))
    store.upsert("INFO", rows.union(spark.createDataFrame([(-5, "new", "here", 30)], INFO)))
    return store.logical("INFO")


def store_clear_drop(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sizes after all was cleared, and whether the folder is gone after it was dropped."""
    store = _small_store(spark, sf_dir)
    store.clear()
    sizes = [tuple(r) for r in _sizes(store).collect()]
    store.drop()
    where = spark._jvm.org.apache.hadoop.fs.Path(store.path)
    gone = not where.getFileSystem(spark._jsc.hadoopConfiguration()).exists(where)
    return spark.createDataFrame([(*r, gone) for r in sizes], "relation string, kind string, n_rows long, dropped boolean")


def catalog_tables(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sizes of the relations as tables of the catalog."""
    store = _small_store(spark, sf_dir)
    prefix = f"kf_{uuid.uuid4().hex[:8]}_"
    store.save_as_tables(prefix)
    sizes = [(t, spark.table(f"{prefix}{t}").count()) for t in store.spec.schemas]
    for t in store.spec.schemas:
        spark.sql(f"DROP TABLE IF EXISTS {prefix}{t}")
    return spark.createDataFrame(sizes, "relation string, n_rows long")


def stored_clustering(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = place(spark, "clustering")
    files.write_clustering(base._clustered(spark, sf_dir)[0], path)
    again = files.read_clustering(spark, path)
    return again.membership.withColumn("alpha", F.lit(again.alpha))


def clustering_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = place(spark, "clustering")
    files.write_clustering(base._clustered(spark, sf_dir)[0], path)
    return files.read_clustering(spark, path).heads


def precomputed_clusterings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Statistics of stored clusterings of the first ten terms and of all."""
    sim = base.pairwise_similarity(spark, sf_dir)
    found = files.precompute(base.terms(spark, sf_dir), sim, base.ALPHA, (10, 0), place(spark, "precomputed"))
    parts = [files.read_clustering(spark, p).statistics().withColumn("count", F.lit(n)) for n, p in found.items()]
    return parts[0].unionByName(parts[1])


def cluster_members(spark: SparkSession, sf_dir: str) -> DataFrame:
    made = base._clustered(spark, sf_dir)[0]
    return made.cluster(1).select("term").unionByName(made.heads.where("id = 2").select(F.col("head").alias("term")))


def alpha_sweep(spark: SparkSession, sf_dir: str) -> DataFrame:
    return clustering.sweep(base.terms(spark, sf_dir), base.pairwise_similarity(spark, sf_dir), (0.25, 0.3, 0.5, 1.0))


def unknown_similarity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Similarities of a term that the model doesn't know to all others: 0, and 1 to itself."""
    one = F.lit("Nowhere").alias("term2")
    pairs = base.terms(spark, sf_dir).select(F.col("term").alias("term1"), one).union(spark.range(1).select(F.lit("Nowhere"), one))
    return similarity.lookup(pairs, base.pairwise_similarity(spark, sf_dir))


def cui_fill(spark: SparkSession, sf_dir: str) -> DataFrame:
    bare = base.engine(spark, sf_dir).store.logical("ILL").withColumn("cui", F.when(F.col("id") % 2 == 0, F.col("cui")))
    cuis = base.table(spark, sf_dir, "nation").select(F.col("n_name").alias("term"), F.concat(F.lit("C"), F.col("n_nationkey").cast("string")).alias("cui"))
    return with_cuis(bare, cuis, FragmentationSpec())


def generated(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sizes of generated relations, and what holds of all their rows."""
    own = generate(spark, base.terms(spark, sf_dir), 3)
    again = generate(spark, base.terms(spark, sf_dir), 3)
    known = own["ILL"].join(base.terms(spark, sf_dir), own["ILL"]["disease"] == F.col("term"), "left_anti").count()
    return own["INFO"].agg(
        F.count("*").alias("n_persons"),
        F.count_distinct("id").alias("n_ids"),
        (F.sum(F.when(F.col("age").between(0, 119), 0).otherwise(1))).alias("n_bad_ages"),
        F.lit(known).cast("long").alias("n_unknown_terms"),
        F.lit(sorted(own["ILL"].collect()) == sorted(again["ILL"].collect())).alias("same_again"),
    )


def text_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """An answer's rows as text."""
    few = base.engine(spark, sf_dir).store.logical("INFO").where("id <= 40")
    return spark.createDataFrame(shown.string_rows(few), "id string, name string, address string, age string")


def html_answer(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The HTML table of a one-row answer, and the line in the place of one that can't be given."""
    e = base.engine(spark, sf_dir)
    good = e.answer("SELECT min(p.id) AS low, max(p.id) AS high FROM INFO p")
    bad = e.answer(f"SELECT id FROM ILL WHERE disease = '{D1}' OR id > 5", relaxed=True)
    return spark.createDataFrame([(good, "class='note'" in bad and "UnsupportedQuery" in bad)], "answer string, refused boolean")


# --- engines and queries that the corpus has not


def lengths_engine(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fragments of an engine made from a file of path lengths."""
    e = base.engine(spark, sf_dir)
    tables = {t: e.store.logical(t).where("id % 10 = 1") for t in e.spec.schemas}
    made = Engine.from_files(spark, place(spark, "engine"), tables, base.ALPHA, lengths=_lengths_file(spark, sf_dir))
    return made.store.fragmented("ILL")


def stored_clustering_engine(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A relaxed answer of an engine made from a stored clustering."""
    e = base.engine(spark, sf_dir)
    path = place(spark, "clustering")
    files.write_clustering(base._clustered(spark, sf_dir)[0], path)
    tables = {t: e.store.logical(t).where("id % 10 = 1") for t in e.spec.schemas}
    made = Engine.from_files(spark, place(spark, "engine"), tables, base.ALPHA, lengths=_lengths_file(spark, sf_dir), clustering=path)
    return made.sql(f"SELECT i.id, i.disease FROM ILL i WHERE i.disease = '{D1}'", relaxed=True)


def function_engine(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fragments of an engine whose similarity is a function of two terms: 1 over the distance of their numbers."""
    e = base.engine(spark, sf_dir)
    number = lambda c: F.substring(c, 8, 2).cast("int")
    tables = {t: e.store.logical(t).where("id % 10 = 1") for t in e.spec.schemas}
    made = Engine.from_function(spark, place(spark, "engine"), tables, lambda a, b: 1.0 / F.abs(number(a) - number(b)), base.terms(spark, sf_dir), 0.0)
    return made.store.fragmented("ILL").groupBy("frag_id").agg(F.count("*").alias("n_rows"))


_SAME = base._SAME

#: Texts, whether they are relaxed, and the SQL of their answers where it isn't the text itself.
TEXTS: dict[str, tuple[str, bool, str | None]] = {
    "relaxed_in_subquery": (
        f"SELECT who.id, who.age FROM INFO who WHERE who.id IN (SELECT has.id FROM ILL has WHERE has.disease = '{D1}') AND who.age < 70",
        True,
        f"SELECT id, age FROM info WHERE id IN (SELECT id FROM ill WHERE disease IN {_SAME.format(D1)}) AND age < 70",
    ),
    "relaxed_exists": (
        f"SELECT who.name FROM INFO who WHERE EXISTS (SELECT 1 FROM ILL has WHERE has.id = who.id AND has.disease = '{D3}')",
        True,
        f"SELECT name FROM info p WHERE EXISTS (SELECT 1 FROM ill i WHERE i.id = p.id AND i.disease IN {_SAME.format(D3)})",
    ),
    "relaxed_derived": (
        f"SELECT got.prescription, ills.disease FROM (SELECT has.id, has.disease FROM ILL has WHERE has.disease = '{D1}') ills JOIN TREAT got ON got.id = ills.id",
        True,
        f"SELECT t.prescription, i.disease FROM ill i JOIN treat t USING (id) WHERE i.disease IN {_SAME.format(D1)}",
    ),
    "relaxed_in_literals": (
        f"SELECT has.id, has.cui FROM ILL has WHERE has.disease IN ('{D1}', '{D3}', '{D2}')",
        True,
        f"SELECT id, cui FROM ill WHERE disease IN {_SAME.format(D1)} OR disease IN {_SAME.format(D3)}",
    ),
    "exact_in_literals": (f"SELECT has.id, who.age FROM ILL has JOIN INFO who ON who.id = has.id WHERE has.disease IN ('{D1}', '{D3}')", False, None),
    "exact_exists": (f"SELECT who.id FROM INFO who WHERE EXISTS (SELECT 1 FROM ILL has WHERE has.id = who.id AND has.disease = '{D1}')", False, None),
    "exact_not_exists": (f"SELECT who.id FROM INFO who WHERE NOT EXISTS (SELECT 1 FROM ILL has WHERE has.id = who.id AND has.disease = '{D1}')", False, None),
    "relaxed_two_terms": (
        f"SELECT has.id, has.disease FROM ILL has WHERE has.disease = '{D1}' AND has.disease = '{D2}'",
        True,
        f"SELECT id, disease FROM ill WHERE disease IN {_SAME.format(D1)} AND disease IN {_SAME.format(D2)}",
    ),
    "user_union": (f"SELECT id FROM ILL WHERE disease = '{D1}' UNION SELECT id FROM TREAT WHERE success EXCEPT SELECT id FROM INFO WHERE age > 60", False, None),
    "named_table": (f"WITH third AS (SELECT id, disease FROM ILL WHERE id % 3 = 0) SELECT third.id FROM third WHERE third.disease = '{D1}'", False, None),
    "parenthesised_from": (f"SELECT who.name, has.cui FROM (ILL has JOIN INFO who ON who.id = has.id) WHERE has.disease = '{D2}'", False, None),
    "outer_join": (f"SELECT who.id, has.cui FROM INFO who LEFT JOIN ILL has ON has.id = who.id AND has.disease = '{D1}'", False, None),
    "like_between": ("SELECT has.id FROM ILL has, INFO who WHERE has.id = who.id AND has.disease LIKE 'NATION_1%' AND who.age BETWEEN 20 AND 40 AND has.cui IS NOT NULL", False, None),
    "distinct_aggregates": ("SELECT has.disease, count(DISTINCT has.id) AS n_persons, CAST(sum(DISTINCT who.age) AS BIGINT) AS ages FROM ILL has, INFO who WHERE has.id = who.id GROUP BY has.disease", False, None),
    "expressions": (f"SELECT who.id, who.age * 100 AS load, CASE WHEN who.age > 60 THEN 'old' ELSE upper(who.address) END AS kind, 'x' AS mark FROM INFO who, ILL has WHERE who.id = has.id AND has.disease = '{D1}'", False, None),
}


def _text(sql: str, relaxed: bool) -> Callable[[SparkSession, str], DataFrame]:
    return lambda spark, sf_dir: base.engine(spark, sf_dir).sql(sql, relaxed=relaxed)


def bound_parameter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return base.engine(spark, sf_dir).sql("SELECT has.id FROM ILL has WHERE has.disease = :term AND has.id > :low", args={"term": D1, "low": 20})


def own_views(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A text of one engine that is read after another engine has shown its relations."""
    out = base.engine(spark, sf_dir).sql("SELECT count(*) AS n FROM INFO")
    Engine(spark, _small_store(spark, sf_dir), "baseline").sql("SELECT count(*) AS n FROM INFO")
    return out


SINGLE = [
    term_list, similarity_file, similarity_file_cuis, length_file, length_file_similarity, length_file_terms, longest_paths, stored_similarity, pair_file, sampled_terms, first_terms,
    example_similarity, tree_file, tree_edges, tree_path_lengths, tree_similarity, branch_terms, descriptor_file, branch_identifiers, descriptor_labels, fragment_views, store_append,
    store_upsert, store_clear_drop, catalog_tables, stored_clustering, clustering_table, precomputed_clusterings, cluster_members, alpha_sweep, unknown_similarity, cui_fill, generated,
    text_rows, html_answer, lengths_engine, stored_clustering_engine, function_engine, bound_parameter, own_views,
]


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {f.__name__: f for f in SINGLE} | {name: _text(sql, relaxed) for name, (sql, relaxed, _) in TEXTS.items()}


_TREE = """tree AS (SELECT 'C01' num, 'World' term, NULL r, 0 depth UNION ALL SELECT 'D01', 'Elsewhere', NULL, 0
  UNION ALL SELECT 'C01.' || CAST(r_regionkey + 100 AS VARCHAR), r_name, r_regionkey, 1 FROM region
  UNION ALL SELECT 'C01.' || CAST(n_regionkey + 100 AS VARCHAR) || '.' || CAST(n_nationkey + 100 AS VARCHAR), n_name, n_regionkey, 2 FROM nation),
paths AS (SELECT least(a.term, b.term) AS term1, greatest(a.term, b.term) AS term2,
    CAST(CASE WHEN a.r = b.r THEN (CASE WHEN a.depth = 2 AND b.depth = 2 THEN 2 ELSE b.depth - a.depth END) ELSE a.depth + b.depth END AS INTEGER) AS length
  FROM tree a JOIN tree b ON a.depth < b.depth OR a.depth = b.depth AND a.term < b.term WHERE a.num LIKE 'C%' AND b.num LIKE 'C%')
"""
_FEW = """few AS (SELECT * FROM info WHERE id % 10 = 1), few_ill AS (SELECT * FROM ill_f WHERE id % 10 = 1), few_treat AS (SELECT * FROM treat WHERE id % 10 = 1),
few_homes AS (SELECT DISTINCT id, frag_id FROM few_ill),
more AS (SELECT * FROM info WHERE id % 10 IN (1, 2)), more_ill AS (SELECT * FROM ill_f WHERE id % 10 IN (1, 2)), more_treat AS (SELECT * FROM treat WHERE id % 10 IN (1, 2)),
more_homes AS (SELECT DISTINCT id, frag_id FROM more_ill)
"""
_CUI = "'C' || substr({0}, 8, 2)"

_OWN = {
    "term_list": "SELECT t AS term FROM terms",
    "similarity_file": f"SELECT t1 AS term1, {_CUI.format('t1')} AS cui1, t2 AS term2, {_CUI.format('t2')} AS cui2, CAST(1.0 AS DOUBLE) / len AS simvalue FROM sim WHERE t1 < t2",
    "similarity_file_cuis": f"SELECT t AS term, {_CUI.format('t')} AS cui FROM terms",
    "length_file": "SELECT t1 AS term1, t2 AS term2, CAST(len AS INTEGER) AS length FROM sim WHERE t1 < t2",
    "length_file_similarity": "SELECT t1 AS term1, t2 AS term2, CAST(1.0 AS DOUBLE) / len AS simvalue FROM sim WHERE t1 < t2",
    "length_file_terms": "SELECT t AS term FROM terms",
    "longest_paths": "SELECT t1 AS term1, t2 AS term2, CAST(len AS INTEGER) AS length FROM sim WHERE t1 < t2 AND t1 IN (SELECT t FROM terms ORDER BY t LIMIT 10) AND t2 IN (SELECT t FROM terms ORDER BY t LIMIT 10)",
    "stored_similarity": "SELECT t1 AS term1, t2 AS term2, CAST(1.0 AS DOUBLE) / len AS simvalue FROM sim WHERE t1 < t2",
    "pair_file": "SELECT a.t || '<>' || b.t AS line FROM (SELECT t FROM terms ORDER BY t LIMIT 12) a JOIN (SELECT t FROM terms ORDER BY t LIMIT 12) b ON a.t < b.t",
    "sampled_terms": "SELECT CAST(10 AS BIGINT) AS n, CAST(10 AS BIGINT) AS n_distinct",
    "first_terms": "SELECT t AS term FROM terms ORDER BY t LIMIT 7",
    "example_similarity": "SELECT term1, term2, CAST(simvalue AS DOUBLE) AS simvalue FROM (VALUES " + ", ".join(f"('{a}', '{b}', {s})" for a, b, s in similarity.EXAMPLE) + ") AS v(term1, term2, simvalue)",
    "tree_file": "SELECT num AS tree_number, term AS descriptor FROM tree",
    "tree_edges": "SELECT num AS child, substr(num, 1, length(num) - 4) AS parent FROM tree WHERE length(num) > 4",
    "tree_path_lengths": "SELECT term1, term2, length FROM paths",
    "tree_similarity": "SELECT term1, term2, CAST(1.0 AS DOUBLE) / length AS simvalue FROM paths",
    "branch_terms": "SELECT term FROM tree WHERE num LIKE 'C%'",
    "descriptor_file": "SELECT 'D' || CAST(n_nationkey AS VARCHAR) AS id, n_name AS name FROM nation",
    "branch_identifiers": "SELECT n_name AS term, CASE WHEN n_nationkey <> 7 THEN 'D' || CAST(n_nationkey AS VARCHAR) END AS cui FROM nation",
    "descriptor_labels": "SELECT 'D' || CAST(n_nationkey AS VARCHAR) || '|' || n_name AS value FROM nation WHERE n_regionkey <> 0",
    "fragment_views": f"SELECT 'ILL' AS relation, count(*) AS n_rows FROM ill_f WHERE frag_id = (SELECT frag_id FROM assign WHERE term = '{D1}') UNION ALL SELECT 'INFO', count(*) FROM info_f WHERE frag_id = (SELECT frag_id FROM assign WHERE term = '{D1}') UNION ALL SELECT 'TREAT', count(*) FROM treat_f WHERE frag_id = (SELECT frag_id FROM assign WHERE term = '{D1}')",
    "store_append": "SELECT 'INFO' AS relation, 'logical' AS kind, count(*) AS n_rows FROM more UNION ALL SELECT 'INFO', 'fragments', count(*) FROM more JOIN more_homes USING (id) UNION ALL SELECT 'ILL', 'logical', count(*) FROM more_ill UNION ALL SELECT 'ILL', 'fragments', count(*) FROM more_ill UNION ALL SELECT 'TREAT', 'logical', count(*) FROM more_treat UNION ALL SELECT 'TREAT', 'fragments', count(*) FROM more_treat JOIN more_homes USING (id)",
    "store_upsert": "SELECT id, name, address, CAST(CASE WHEN id % 20 = 1 THEN -1 ELSE age END AS INTEGER) AS age FROM few UNION ALL SELECT -5, 'new', 'here', 30",
    "store_clear_drop": "SELECT relation, kind, CAST(0 AS BIGINT) AS n_rows, true AS dropped FROM (VALUES ('INFO'), ('ILL'), ('TREAT')) a(relation), (VALUES ('logical'), ('fragments')) b(kind)",
    "catalog_tables": "SELECT 'INFO' AS relation, count(*) AS n_rows FROM few UNION ALL SELECT 'ILL', count(*) FROM few_ill UNION ALL SELECT 'TREAT', count(*) FROM few_treat",
    "stored_clustering": "SELECT cluster_id, head, term, term = head AS is_head, CAST(0.3 AS DOUBLE) AS alpha FROM ranked WHERE high = 1",
    "clustering_table": "SELECT cluster_id AS id, head FROM heads",
    "precomputed_clusterings": "SELECT CAST(sum(n) AS BIGINT) AS n_terms, count(*) AS n_clusters, CAST(sum(n) // count(*) AS BIGINT) AS avg_size, min(n) AS min_size, max(n) AS max_size, which AS count FROM (SELECT 0 AS which, count(*) n FROM terms GROUP BY r UNION ALL SELECT 10, count(*) FROM (SELECT * FROM terms ORDER BY t LIMIT 10) GROUP BY r) GROUP BY which",
    "cluster_members": "SELECT term FROM ranked WHERE high = 1 AND cluster_id = 1 UNION ALL SELECT head FROM heads WHERE cluster_id = 2",
    "alpha_sweep": "SELECT CAST(sum(n) AS BIGINT) AS n_terms, count(*) AS n_clusters, CAST(sum(n) // count(*) AS BIGINT) AS avg_size, min(n) AS min_size, max(n) AS max_size, alpha FROM (SELECT CAST(0.25 AS DOUBLE) AS alpha, count(*) n FROM terms UNION ALL SELECT 0.3, count(*) FROM terms GROUP BY r UNION ALL SELECT 0.5, count(*) FROM terms GROUP BY r UNION ALL SELECT 1.0, 1 FROM terms) GROUP BY alpha",
    "unknown_similarity": "SELECT t AS term1, 'Nowhere' AS term2, CAST(0 AS DOUBLE) AS simvalue FROM terms UNION ALL SELECT 'Nowhere', 'Nowhere', CAST(1 AS DOUBLE)",
    "cui_fill": "SELECT id, disease, cui FROM ill",
    "generated": "SELECT CAST(150 AS BIGINT) AS n_persons, CAST(150 AS BIGINT) AS n_ids, CAST(0 AS BIGINT) AS n_bad_ages, CAST(0 AS BIGINT) AS n_unknown_terms, true AS same_again",
    "text_rows": "SELECT CAST(id AS VARCHAR) AS id, name, address, CAST(age AS VARCHAR) AS age FROM info WHERE id <= 40",
    "html_answer": "SELECT '<table class=''answer''>' || chr(10) || '<thead><tr><th scope=''col''>low</th><th scope=''col''>high</th></tr></thead>' || chr(10) || '<tbody>' || chr(10) || '<tr><td>' || CAST(min(id) AS VARCHAR) || '</td><td>' || CAST(max(id) AS VARCHAR) || '</td></tr>' || chr(10) || '</tbody>' || chr(10) || '</table>' AS answer, true AS refused FROM info",
    "lengths_engine": "SELECT id, disease, cui, frag_id FROM few_ill",
    "stored_clustering_engine": f"SELECT id, disease FROM few_ill WHERE disease IN {_SAME.format(D1)}",
    "function_engine": "SELECT CAST(0 AS INTEGER) AS frag_id, count(*) AS n_rows FROM few_ill",
    "bound_parameter": f"SELECT id FROM ill WHERE disease = '{D1}' AND id > 20",
    "own_views": "SELECT count(*) AS n FROM info",
}


def oracle_sql() -> dict[str, str]:
    own = _OWN | {name: same or sql for name, (sql, _, same) in TEXTS.items()}
    return {name: base._WITH.rstrip() + ",\n" + _TREE.rstrip() + ",\n" + _FEW + sql_or_with(sql) for name, sql in own.items()}


def sql_or_with(sql: str) -> str:
    """A text to stand after the names; one that has names of its own goes on with them."""
    return ", " + sql.removeprefix("WITH ") if sql.startswith("WITH ") else sql

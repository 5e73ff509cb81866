import duckdb
import pytest
from pyspark.sql import functions as F

import __spark_entry__ as contract
from kinfrag import catalog, catalog_files
from kinfrag.__main__ import main
from kinfrag.engine import Engine
from kinfrag.functions import rows as shown
from kinfrag.operators import similarity
from kinfrag.operators.clustering import cluster, identify
from kinfrag.schema import ILL, INFO, TREAT, UnknownTerm, UnsupportedQuery
from kinfrag.sources.generator import generate
from kinfrag.sources.store import Store

RESPIRATORY, FRACTURES = {"Asthma", "Cough", "Influenza"}, {"Tibial Fracture", "Ulna Fracture"}
QUOTED = "Sjogren's Syndrome"


def bag(df):
    return sorted(map(repr, map(tuple, df.collect())))


@pytest.fixture(scope="module")
def tables(spark):
    info = [(i, f"n{i % 9}", "a", i % 90) for i in range(40)]
    names = [*sorted(RESPIRATORY | FRACTURES), QUOTED, "Unheard Of"]
    ill = [(i, names[(i * 3 + k) % len(names)], f"C{k}") for i in range(36) for k in range(i % 4)]
    treat = [(i, f"P{k}", [True, False, None][k]) for i in range(38) for k in range(i % 3)]
    return {"INFO": spark.createDataFrame(info, INFO), "ILL": spark.createDataFrame(ill, ILL), "TREAT": spark.createDataFrame(treat, TREAT)}


@pytest.fixture(scope="module")
def engines(spark, tables, tmp_path_factory):
    sim = similarity.example(spark).union(spark.createDataFrame([("Asthma", QUOTED, 0.05)], "a string, b string, s double"))
    path = str(tmp_path_factory.mktemp("store") / "rel")
    made = Engine.build(spark, path, tables, sim, similarity.terms_of(sim), 0.15)
    return made, Engine(spark, made.store, "baseline")


@pytest.fixture(scope="module")
def con(engines):
    con = duckdb.connect()
    for t in ("INFO", "ILL", "TREAT"):
        con.register(t, engines[0].store.logical(t).toPandas())
    return con


Q = {k: v.replace(catalog.D1, "Cough").replace(catalog.D2, "Asthma").replace(catalog.D3, "Ulna Fracture") for k, v in catalog.EXACT.items()}


@pytest.mark.parametrize("name", Q)
def test_fragments_are_transparent(spark, engines, name):
    made, plain = engines
    fragmented, baseline = made.sql(Q[name]), plain.sql(Q[name])
    assert fragmented.columns == baseline.columns and bag(fragmented) == bag(baseline)
    assert "frag_id" not in fragmented.columns


R = {k: v[0].replace(catalog.D1, "Cough").replace(catalog.D2, "Asthma").replace(catalog.D3, "Ulna Fracture") for k, v in catalog.RELAXED.items()}


@pytest.mark.parametrize("name", R)
def test_relaxed_answers_are_the_same_in_both_layouts_and_hold_the_exact_ones(engines, name):
    made, plain = engines
    relaxed = bag(made.sql(R[name], relaxed=True))
    assert relaxed == bag(plain.sql(R[name], relaxed=True))
    if "group" not in name:
        rest = list(relaxed)
        for r in bag(made.sql(R[name])):
            rest.remove(r)


def test_scans_are_pruned(engines):
    made, _ = engines
    plan = made.sql(Q["exact_q4"])._jdf.queryExecution().executedPlan().toString()
    assert plan.count("PartitionFilters: [isnotnull(frag_id") == 3
    assert made.explain_routing(Q["exact_q2"]).fragments == {"one": [0], "two": [2], "who": [0]}


@pytest.mark.parametrize(
    "sql",
    [
        "SELECT i.id FROM ILL i WHERE i.disease = 'Cough' OR i.id > 5",
        "SELECT i.id FROM ILL i WHERE NOT (i.disease = 'Cough')",
        "SELECT p.id FROM INFO p LEFT JOIN ILL i ON p.id = i.id AND i.disease = 'Cough'",
        "SELECT id FROM ILL WHERE disease = 'Cough' UNION ALL SELECT id FROM INFO",
        "WITH x AS (SELECT * FROM ILL) SELECT id FROM x WHERE disease = 'Cough'",
        "SELECT i.id FROM ILL i WHERE i.disease IN ('Cough', 'Unheard Of')",
        "SELECT p.id FROM INFO p WHERE NOT EXISTS (SELECT 1 FROM ILL i WHERE i.id = p.id AND i.disease = 'Cough')",
        "SELECT i.id FROM ILL i WHERE i.disease = 'Unheard Of'",
        "SELECT p.name FROM INFO p WHERE p.name = 'Cough'",
    ],
)
def test_unsound_shapes_run_as_they_are(spark, engines, sql):
    made, plain = engines
    assert made.explain_routing(sql).sql == sql and bag(made.sql(sql)) == bag(plain.sql(sql))


def test_relaxing_what_cannot_be(engines):
    made, _ = engines
    for sql in ("SELECT p.id FROM INFO p LEFT JOIN ILL i ON p.id = i.id WHERE i.disease = 'Cough'", "SELECT id FROM ILL WHERE disease = 'Cough' UNION SELECT id FROM INFO", "SELECT i.id FROM ILL i WHERE i.disease = 'Cough' OR i.id > 5", "SELECT i.id FROM ILL i, ILL j WHERE i.id = j.id AND disease = 'Cough'", "SELECT p.id FROM INFO p WHERE p.id NOT IN (SELECT i.id FROM ILL i WHERE i.disease = 'Cough')", "SELECT p.id, (SELECT count(*) FROM ILL i WHERE i.disease = 'Cough') AS n FROM INFO p", "WITH x AS (SELECT * FROM ILL WHERE disease = 'Cough') SELECT id FROM x", "SELECT x.id FROM (SELECT id, disease FROM ILL) x WHERE x.disease = 'Cough'", "SELECT i.id FROM ILL i WHERE i.disease IN ('Cough', i.cui)", "SELECT i.disease FROM ILL i GROUP BY i.disease HAVING i.disease = 'Cough'", "SELECT i.id FROM ILL i WHERE i.disease <=> 'Cough'", "SELECT p.id FROM INFO p WHERE p.id IN (SELECT id FROM ILL WHERE disease = 'Cough' UNION SELECT id FROM TREAT)"):
        with pytest.raises(UnsupportedQuery):
            made.sql(sql, relaxed=True)
    for term in ("Unheard Of", "Nothing"):
        with pytest.raises(UnknownTerm):
            made.sql(f"SELECT id FROM ILL WHERE disease = '{term}'", relaxed=True)
    assert made.explain_routing("SELECT p.id FROM INFO p", relaxed=True).sql == "SELECT p.id FROM INFO p"


def test_quotes_parameters_and_wide_characters(engines):
    made, plain = engines
    sql = "SELECT '😀 x' AS s, i.id FROM ILL i WHERE i.disease = :d ORDER BY i.id LIMIT 3"
    got = made.sql(sql, args={"d": QUOTED})
    assert made.explain_routing(sql, args={"d": QUOTED}).fragments and bag(got) == bag(plain.sql(sql, args={"d": QUOTED}))
    assert got.columns == ["s", "id"] and got.count() == 3
    both = "SELECT i.id FROM ILL i WHERE i.disease = 'Sjogren''s Syndrome'"
    assert bag(made.sql(both, relaxed=True)) == bag(plain.sql(both, relaxed=True))


NESTED = {
    "SELECT p.id FROM INFO p WHERE p.id IN (SELECT i.id FROM ILL i WHERE i.disease = 'Cough')": "SELECT p.id FROM INFO p WHERE p.id IN (SELECT i.id FROM ILL i WHERE i.disease IN ('Asthma', 'Cough', 'Influenza'))",
    "SELECT p.id FROM INFO p WHERE EXISTS (SELECT 1 FROM ILL i WHERE i.id = p.id AND i.disease = 'Cough') AND p.age > 3": "SELECT p.id FROM INFO p WHERE EXISTS (SELECT 1 FROM ILL i WHERE i.id = p.id AND i.disease IN ('Asthma', 'Cough', 'Influenza')) AND p.age > 3",
    "SELECT x.id, t.prescription FROM (SELECT id FROM ILL WHERE disease = 'Cough') x JOIN TREAT t ON t.id = x.id": "SELECT i.id, t.prescription FROM ILL i JOIN TREAT t ON t.id = i.id WHERE i.disease IN ('Asthma', 'Cough', 'Influenza')",
    "SELECT i.id FROM ILL i, INFO p WHERE p.id = i.id AND i.disease IN ('Cough', 'Ulna Fracture')": "SELECT i.id FROM ILL i WHERE i.disease <> 'Unheard Of' AND i.disease <> 'Sjogren''s Syndrome'",
    "SELECT disease FROM ILL WHERE disease IN (SELECT disease FROM ILL WHERE disease = 'Cough')": "SELECT disease FROM ILL WHERE disease IN ('Asthma', 'Cough', 'Influenza')",
}


@pytest.mark.parametrize("sql", NESTED)
def test_inner_blocks_and_lists_are_routed_and_relaxed(engines, con, sql):
    made, plain = engines
    want = sorted(map(repr, con.execute(NESTED[sql]).fetchall()))
    assert bag(made.sql(sql, relaxed=True)) == bag(plain.sql(sql, relaxed=True)) == want != []
    assert bag(made.sql(sql)) == bag(plain.sql(sql)) and made.explain_routing(sql).fragments


def test_engines_read_their_own_relations(spark, engines, tables, tmp_path):
    made, _ = engines
    held = made.sql("SELECT count(*) AS n FROM INFO")
    sim = similarity.example(spark)
    other = Engine.build(spark, str(tmp_path / "o"), {t: df.where("id < 5") for t, df in tables.items()}, sim, similarity.terms_of(sim), 0.15)
    assert other.sql("SELECT count(*) AS n FROM INFO p").first().n == 5 and held.first().n == 40
    assert made.sql("WITH INFO AS (SELECT 1 AS id) SELECT id FROM INFO").count() == 1
    assert "UnsupportedQuery" in made.answer("SELECT id FROM ILL WHERE disease = 'Cough' OR id > 5", relaxed=True) and "<td>40</td>" in made.answer("SELECT count(*) AS n FROM INFO")


def test_two_terms_of_one_instance(engines):
    made, plain = engines
    sql = "SELECT i.id FROM ILL i WHERE i.disease = 'Cough' AND i.disease = 'Ulna Fracture'"
    assert made.sql(sql).count() == 0 and made.sql(sql, relaxed=True).count() == 0
    sql = "SELECT i.id FROM ILL i WHERE i.disease = 'Cough' AND i.disease = 'Asthma'"
    assert made.sql(sql).count() == 0 and bag(made.sql(sql, relaxed=True)) == bag(plain.sql(sql, relaxed=True)) != []


@pytest.mark.parametrize(("sql", "columns"), [("SELECT i.id FROM ILL i WHERE i.disease = 'Cough'", ["id", "disease"]), ("SELECT * FROM ILL i WHERE i.disease = 'Cough'", ["id", "disease", "cui"]), ("SELECT i.disease FROM ILL i WHERE i.disease = 'Cough'", ["disease"]), ("SELECT p.* FROM ILL i, INFO p WHERE i.id = p.id AND i.disease = 'Cough'", ["id", "name", "address", "age", "disease"]), ("SELECT count(*) AS n FROM ILL i WHERE i.disease = 'Cough' GROUP BY i.cui", ["n"])])
def test_relaxed_term_is_put_out_once(engines, sql, columns):
    for e in engines:
        out = e.sql(sql, relaxed=True, with_relaxed_term=True)
        assert out.columns == columns
        if "disease" in columns:
            assert {r.disease for r in out.collect()} <= RESPIRATORY


def test_builder(engines):
    for e in engines:
        exact = e.query(i="ILL", p="INFO", t="TREAT").term("i", "Cough").where(F.col("p.age") > 3)
        assert bag(exact.frame().select("p.name", "t.prescription")) == bag(e.sql("SELECT p.name, t.prescription FROM ILL i, INFO p, TREAT t WHERE i.id = p.id AND t.id = i.id AND i.disease = 'Cough' AND p.age > 3"))
        assert bag(exact.frame(relaxed=True).select("i.id")) == bag(e.sql("SELECT i.id FROM ILL i, INFO p, TREAT t WHERE i.id = p.id AND t.id = i.id AND i.disease = 'Cough' AND p.age > 3", relaxed=True))
        with pytest.raises(ValueError):
            e.query(p="INFO").term("p", "Cough")
        with pytest.raises(UnknownTerm):
            e.query(i="ILL").term("i", "Nothing").frame(relaxed=True)


def test_derived_fragments_hold_each_person_once(engines, tables):
    store = engines[0].store
    homes = {(r.id, r.frag_id) for r in store.fragmented("ILL").collect()}
    assert sorted((r.id, r.frag_id) for r in store.fragmented("INFO").collect()) == sorted(homes)
    assert {r.frag_id for r in store.fragmented("ILL").where("disease = 'Unheard Of'").collect()} == {-1}
    assert store.logical("INFO").count() == 40


def test_refresh_sees_changes(spark, tables, tmp_path):
    sim = similarity.example(spark)
    made = Engine.build(spark, str(tmp_path / "r"), tables, sim, similarity.terms_of(sim), 0.15)
    sql = "SELECT i.id FROM ILL i WHERE i.disease = 'Cough'"
    before = made.sql(sql).count()
    new = spark.createDataFrame([(999, "Cough", "C"), (999, "Cough", "C")], ILL)
    made.store.append("ILL", new)
    made.store.append("ILL", new)
    made.store.append("INFO", spark.createDataFrame([(999, "late", "a", 5)], INFO))
    made.refresh()
    assert made.sql("SELECT p.name FROM ILL i, INFO p WHERE i.id = p.id AND i.disease = 'Cough' AND p.id = 999").count() == 1
    assert made.sql(sql).count() == before + 1 == made.sql("SELECT id FROM ILL WHERE disease = 'Cough' OR false").count()


def test_views_by_fragment_number(spark, engines):
    engines[0].register(fragments=True)
    assert {r.disease for r in spark.sql("SELECT disease FROM ILL_0").collect()} <= RESPIRATORY
    assert {r.disease for r in spark.sql("SELECT disease FROM ILL_2").collect()} <= FRACTURES


def test_store_changes(spark, tables, tmp_path):
    sim = similarity.example(spark)
    terms = similarity.terms_of(sim)
    store = Store(spark, str(tmp_path / "s"), catalog.FragmentationSpec())
    twice = {t: df.union(df) for t, df in tables.items()}
    store.create(twice, identify(terms, cluster(terms, sim, 0.15).heads, sim))
    assert store.logical("INFO").count() == 40
    store.upsert("INFO", spark.createDataFrame([(1, "new", "b", 5), (99, "more", "b", 6)], INFO))
    assert store.logical("INFO").count() == 41 and store.logical("INFO").where("id = 1").first().name == "new"
    before = store.fragmented("ILL").count()
    store.append("ILL", spark.createDataFrame([(99, "Cough", "C")], ILL))
    assert store.fragmented("ILL").count() == before + 1 and store.fragmented("INFO").where("id = 99").count() == 1
    store.clear()
    assert store.logical("TREAT").count() == 0 and store.fragmented("ILL").count() == 0
    store.save_as_tables("kf_")
    assert spark.table("kf_ILL").columns == ["id", "disease", "cui"]
    for t in ("INFO", "ILL", "TREAT"):
        spark.sql(f"DROP TABLE kf_{t}")
    store.drop()
    assert not (tmp_path / "s").exists()


def test_rows_on_the_driver(spark):
    df = spark.createDataFrame([(1, "a<b", None)], "x int, y string, x2 double")
    assert shown.string_rows(df) == [["1", "a<b", None]]
    want = "<table class='answer'><thead><tr><th scope='col'>x</th><th scope='col'>y</th><th scope='col'>x2</th></tr></thead><tbody><tr><td>1</td><td>a&lt;b</td><td class='null'></td></tr></tbody></table>"
    assert shown.html_table(df).replace("\n", "") == want
    assert shown.quoted("a'b") == "a''b" and shown.mean([1, 2, 4]) == 2


def test_generator(spark):
    terms = similarity.terms_of(similarity.example(spark))
    one, two = generate(spark, terms, 4), generate(spark, terms, 4)
    assert one["INFO"].count() == 200 and 0 < one["ILL"].count() <= 400
    for t in one:
        assert bag(one[t]) == bag(two[t])
    assert one["INFO"].where("age < 0 OR age >= 120").count() == 0 and one["TREAT"].where("success IS NOT NULL").count() == 0
    assert generate(spark, terms, 0)["ILL"].count() == 0


def test_command_line(spark, tmp_path, capsys):
    run = ["-m", "-a", "0.15", "--path", str(tmp_path / "c"), "-sf", "2", "-rt", "--query", "SELECT DISTINCT disease FROM ILL WHERE disease = 'Cough'", "--relaxed", "--html"]
    assert main(run) == 0
    assert "<td>Influenza</td>" in capsys.readouterr().out
    assert main(["-r", "-a", "0.15", "--path", str(tmp_path / "c"), "--query", "SELECT count(*) AS n FROM INFO"]) == 0
    assert "100" in capsys.readouterr().out
    for wrong in (["-m", "-a", "1.5", "--path", "x"], ["-m", "-a", "0.5", "-sf", "-1", "--path", "x"]):
        with pytest.raises(SystemExit):
            main(wrong)


def test_driver_queries_equal_their_sql(spark, sf_dir):
    con = duckdb.connect()
    for t in ("nation", "region", "customer", "orders", "lineitem", "supplier", "part"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf_dir}/{t}.parquet'")
    oracle = catalog.oracle_sql()
    oracle |= catalog_files.oracle_sql()
    every = catalog.queries() | catalog_files.queries()
    assert set(oracle) == set(every)
    for name, query in every.items():
        want = con.execute(oracle[name])
        columns = [c[0] for c in want.description]
        df = query(spark, sf_dir)
        assert sorted(df.columns) == sorted(columns), name
        assert bag(df.select(*sorted(columns))) == sorted(repr(tuple(r[columns.index(c)] for c in sorted(columns))) for r in want.fetchall()), name


def test_entry(spark):
    assert contract.entry(spark).count() == 147
    assert set(contract.oracle_sql()) <= set(contract.queries())

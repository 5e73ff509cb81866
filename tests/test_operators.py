import random

import pytest
from pyspark.sql import Row
from pyspark.sql import functions as F

from kinfrag.operators import clustering, similarity, taxonomy
from kinfrag.operators.clustering import cluster, identify, identify_top, sweep
from kinfrag.sources import files

R = {"Asthma", "Cough", "Influenza"}
EXPECTED = {
    0.10: [("Asthma", R | {"Tibial Fracture", "Ulna Fracture"})],
    0.1429: [("Asthma", R | {"Tibial Fracture", "Ulna Fracture"})],
    0.15: [("Asthma", R), ("Tibial Fracture", {"Tibial Fracture", "Ulna Fracture"})],
    0.20: [("Asthma", R), ("Tibial Fracture", {"Tibial Fracture", "Ulna Fracture"})],
    0.25: [("Asthma", {"Asthma"}), ("Tibial Fracture", {"Tibial Fracture", "Ulna Fracture"}), ("Cough", {"Cough"}), ("Influenza", {"Influenza"})],
    0.35: [(t, {t}) for t in ("Asthma", "Tibial Fracture", "Cough", "Influenza", "Ulna Fracture")],
}


def read(made):
    out = {}
    for r in made.membership.collect():
        out.setdefault((r.cluster_id, r.head), set()).add(r.term)
        assert r.is_head == (r.term == r.head)
    return [(h, t) for (_, h), t in sorted(out.items())]


@pytest.mark.parametrize("alpha", EXPECTED)
def test_example_clusters(spark, alpha):
    sim = similarity.example(spark)
    assert read(cluster(similarity.terms_of(sim), sim, alpha)) == EXPECTED[alpha]


def model(terms, sim, alpha):
    """Clusters as sets, moved one by one."""
    s = lambda a, b: sim.get((min(a, b), max(a, b)), 0.0)
    terms = sorted(terms)
    clusters = [(terms[0], set(terms[1:]))]
    while True:
        members = [(s(t, h), i, t) for i, (h, c) in enumerate(clusters) for t in c]
        if not members or min(members)[0] >= alpha:
            return [(h, c | {h}) for h, c in clusters]
        _, i, new = min(members)
        clusters[i][1].remove(new)
        moved = {t for h, c in clusters for t in c if s(t, new) >= s(t, h)}
        for _, c in clusters:
            c -= moved
        clusters.append((new, moved))


def random_taxonomy(seed):
    rng = random.Random(seed)
    parent = {i: rng.randint(max(0, i - 6), i - 1) for i in range(1, 60)}
    return [(f"t{c:02d}", f"t{p:02d}") for c, p in parent.items()], [f"t{i:02d}" for i in rng.sample(range(60), 30)]


@pytest.mark.parametrize("seed", range(3))
def test_random_taxonomies(spark, monkeypatch, seed):
    edges, names = random_taxonomy(seed)
    terms = spark.createDataFrame([(t,) for t in names], "term string")
    frame = spark.createDataFrame(edges, "child string, parent string")
    lengths = taxonomy.path_lengths(frame, terms)
    sim = similarity.from_lengths(lengths)
    known = {(r.term1, r.term2): r.simvalue for r in sim.collect()}
    assert len(known) == 30 * 29 // 2
    for alpha in (0.10, 0.12, 0.15, 0.20, 0.30):
        made = cluster(terms, sim, alpha)
        assert read(made) == model(names, known, alpha)
        heads = {r.id: r.head for r in made.heads.collect()}
        s = lambda a, b: 1.0 if a == b else known[min(a, b), max(a, b)]
        assert len(set(heads.values())) == len(heads)
        for r in made.membership.collect():
            assert s(r.term, r.head) == max(s(r.term, h) for h in heads.values()) and s(r.term, r.head) >= alpha
        want = {t: min(heads, key=lambda i: (heads[i] != t, -s(t, heads[i]), i)) for t in names}
        assert {r.term: r.frag_id for r in identify(terms, made.heads, sim).collect()} == want
        assert {r.term: r.frag_id for r in identify_top(terms, made.heads, sim).collect()} == want
    if seed == 0:
        monkeypatch.setattr(clustering, "DRIVER_PAIRS", 0)
        assert read(cluster(terms, sim, 0.12)) == model(names, known, 0.12)
        monkeypatch.setattr(taxonomy, "DRIVER_EDGES", 0)
        assert sorted(taxonomy.path_lengths(frame, terms).collect()) == sorted(lengths.collect())
        assert taxonomy.path_lengths(frame, terms, longest=2).agg(F.max("length")).first()[0] == 2


@pytest.mark.parametrize("most", (1, 2, 3, 7, 100))
def test_heads_of_a_round(monkeypatch, most):
    monkeypatch.setattr(clustering, "ROUND", most)
    for seed in range(60):
        rng = random.Random(seed)
        names = [f"t{i:02d}" for i in range(rng.randint(2, 25))]
        known = {(a, b): rng.choice((0.0, 0.0, 0.0, 0.1, 0.2, 0.25, 0.5)[rng.randint(0, 3) :]) for a in names for b in names if a < b}
        both = {(a, b): known[min(a, b), max(a, b)] for a in names for b in names if a != b}
        state, heads, rounds = {t: (0.0, 0) for t in names}, [(0, names[0])], 0
        new = heads
        while new:
            for n, h in new:
                del state[h]
                state = {t: (both[h, t], n) if both[h, t] >= s else (s, c) for t, (s, c) in state.items()}
            low = [Row(best=s, cluster_id=c, term=t) for (s, c), t in sorted((v, t) for t, v in state.items())]
            new = clustering._next_heads(low[: most + 1], both, 0.2, len(heads))
            heads, rounds = heads + new, rounds + 1
        assert [(h, {h} | {t for t, (_, c) in state.items() if c == n}) for n, h in heads] == model(names, known, 0.2)
        assert most < 100 or rounds <= 2


def test_distributed_rounds_of_sparse_similarities(spark, monkeypatch):
    edges, names = random_taxonomy(5)
    terms = spark.createDataFrame([(t,) for t in names], "term string")
    lengths = taxonomy.path_lengths(spark.createDataFrame(edges, "child string, parent string"), terms, longest=3)
    sim = similarity.from_lengths(lengths)
    want = read(cluster(terms, sim, 0.3))
    monkeypatch.setattr(clustering, "DRIVER_PAIRS", 0)
    for most, least in ((4, 0), (256, 200_000)):
        monkeypatch.setattr(clustering, "ROUND", most)
        monkeypatch.setattr(clustering, "BROADCAST", least)
        assert read(cluster(terms, sim, 0.3)) == want


def test_cluster_bounds_and_statistics(spark):
    sim = similarity.example(spark)
    terms = similarity.terms_of(sim)
    for alpha in (-0.1, 1.1):
        with pytest.raises(ValueError):
            cluster(terms, sim, alpha)
    with pytest.raises(ValueError):
        cluster(terms.limit(0), sim, 0.5)
    assert tuple(cluster(terms, sim, 0.15).statistics().first()) == (5, 2, 2, 2, 3)
    assert {r.alpha: r.n_clusters for r in sweep(terms, sim, [0.1, 0.15, 1.0]).collect()} == {0.1: 1, 0.15: 2, 1.0: 5}
    assert cluster(terms, sim, 0.15).cluster(1).count() == 2
    with pytest.raises(ValueError):
        sweep(terms, sim, [])
    lone = identify(terms.union(spark.createDataFrame([("Zzz",)], "term string")), cluster(terms, sim, 0.15).heads, sim)
    assert {r.frag_id for r in lone.collect() if r.term == "Zzz"} == {-1}


def test_lookup(spark):
    pairs = spark.createDataFrame([("Cough", "Asthma"), ("Cough", "Cough"), ("Cough", "Zzz")], "term1 string, term2 string")
    got = {(r.term1, r.term2): r.simvalue for r in similarity.lookup(pairs, similarity.example(spark)).collect()}
    assert got == {("Cough", "Asthma"): 0.2, ("Cough", "Cough"): 1.0, ("Cough", "Zzz"): 0.0}
    assert similarity.symmetric(similarity.example(spark)).count() == 20


def test_canonical(spark):
    rows = spark.createDataFrame([("b", "a", 0.5), ("a", "b", 0.5), ("c", "c", 1.0)], "term1 string, term2 string, simvalue double")
    assert [tuple(r) for r in similarity.canonical(rows).collect()] == [("a", "b", 0.5)]


TREE = [("C01", "Root"), ("C01.100", "A"), ("C01.100.200", "B"), ("C01.300", "C"), ("C02", "Other"), ("C02.100", "B"), ("D01", "Drug"), ("C09.100", "Orphan")]


def test_tree_numbers(spark):
    tree = spark.createDataFrame(TREE, "tree_number string, descriptor string")
    assert {tuple(r) for r in taxonomy.tree_edges(tree).collect()} == {("C01.100", "C01"), ("C01.100.200", "C01.100"), ("C01.300", "C01"), ("C02.100", "C02")}
    got = {(r.term1, r.term2): r.length for r in taxonomy.tree_path_lengths(tree).collect()}
    assert got[("A", "B")] == 1 and got[("B", "C")] == 3 and got[("B", "Other")] == 1 and ("A", "Other") not in got
    assert {r.term for r in files.disease_terms(tree).collect()} == {"Root", "A", "B", "C", "Other", "Orphan"}
    names = spark.createDataFrame([("D1", "A"), ("D2", "Drug")], "id string, name string")
    want = spark.createDataFrame([("A",), ("Drug",), ("C",)], "term string")
    assert {tuple(r) for r in files.term_identifiers(tree, want, names).collect()} == {("A", "D1"), ("C", None)}


def test_files(spark, tmp_path):
    write = lambda name, text: (tmp_path / name).write_text(text, encoding="utf-8") and str(tmp_path / name)
    assert {r.term for r in files.read_terms(spark, write("t.txt", "b\na\n\na\n")).collect()} == {"a", "b"}
    sims = files.read_similarities(spark, write("s.txt", "0.25<>Cough (dry)(C1)<>Pain(C2)\n\n0.5<>Pain(C2)<>Ache(C3(x))\n"))
    assert {tuple(r) for r in sims.collect()} == {("Cough ", "dry)(C1", "Pain", "C2", 0.25), ("Pain", "C2", "Ache", "C3(x)", 0.5)}
    assert {tuple(r) for r in files.terms_with_cuis(sims).collect()} == {("Cough ", "dry)(C1"), ("Pain", "C2"), ("Ache", "C3(x)")}
    lengths = files.read_path_lengths(spark, write("l.csv", "b|a|2\n\na|c|4\nc|d|0\n"))
    assert {tuple(r) for r in lengths.collect()} == {("b", "a", 2), ("a", "c", 4)}
    assert {r.term for r in files.term_set(lengths).collect()} == {"a", "b", "c"}
    assert {tuple(r) for r in similarity.from_lengths(lengths).collect()} == {("a", "b", 0.5), ("a", "c", 0.25)}
    files.write_path_lengths(lengths, str(tmp_path / "out"))
    assert files.read_path_lengths(spark, str(tmp_path / "out")).count() == 2
    pairs = files.term_pairs(files.term_set(lengths), 2)
    files.write_term_pairs(pairs, str(tmp_path / "pairs"))
    assert [r.value for r in spark.read.text(str(tmp_path / "pairs")).collect()] == ["a<>b"]
    assert files.read_descriptors(spark, write("m.csv", "D1|Pain\n")).first().name == "Pain"
    assert files.read_tree(spark, write("tree.csv", "C01,Root\n")).first().descriptor == "Root"
    raw = spark.createDataFrame([("http://id.nlm.nih.gov/mesh/D1|\"Pain's\"@en",), ("x@de",)], "value string")
    assert [r.value for r in files.descriptor_lines(raw).collect()] == ["D1|Pains"]
    assert files.sample_terms(files.term_set(lengths), 2).count() == 2


def test_clustering_is_kept(spark, tmp_path):
    sim = similarity.example(spark)
    made = cluster(similarity.terms_of(sim), sim, 0.15)
    files.write_clustering(made, str(tmp_path / "c"))
    again = files.read_clustering(spark, str(tmp_path / "c"))
    assert again.alpha == 0.15 and read(again) == read(made)

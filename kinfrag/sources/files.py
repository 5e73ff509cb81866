"""Readers and writers of the text formats of terms, similarities, taxonomies and clusterings."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from kinfrag.operators import similarity
from kinfrag.operators.clustering import Clustering, cluster
from kinfrag.schema import SIM

#: Fixed values of the similarity file and of the descriptor labels.
SEPARATOR, LANGUAGE, PREFIX = "<>", "@en", "http://id.nlm.nih.gov/mesh/"


def read_terms(spark: SparkSession, path: str) -> DataFrame:
    """Distinct terms of a file with one on each line: ``term``. Blank lines are none."""
    return spark.read.text(path).select(F.col("value").alias("term")).where(F.trim("term") != "").distinct()


def read_similarities(spark: SparkSession, path: str) -> DataFrame:
    """``simvalue<>term1(CUI1)<>term2(CUI2)`` lines: ``term1``, ``cui1``, ``term2``, ``cui2``, ``simvalue``.

    A CUI is what stands between the first parenthesis and the last character; the term is the rest
    without anything in parentheses.
    """
    parts = F.split("value", SEPARATOR)

    def term(i: int) -> Column:
        return F.regexp_replace(parts[i], r"\(.*\)", "")

    def cui(i: int) -> Column:
        return F.regexp_extract(parts[i], r"^[^(]*\((.*).$", 1)

    lines = spark.read.text(path).where(F.trim("value") != "")
    return lines.select(term(1).alias("term1"), cui(1).alias("cui1"), term(2).alias("term2"), cui(2).alias("cui2"), parts[0].cast("double").alias("simvalue"))


def terms_with_cuis(similarities: DataFrame) -> DataFrame:
    """``term`` and ``cui`` of rows of ``read_similarities``."""
    first, second = (similarities.select(F.col(f"term{i}").alias("term"), F.col(f"cui{i}").alias("cui")) for i in (1, 2))
    return first.union(second).groupBy("term").agg(F.max("cui").alias("cui"))


def read_path_lengths(spark: SparkSession, path: str) -> DataFrame:
    """``term1|term2|length`` lines: ``term1``, ``term2``, ``length``. Blank lines and lengths under 1 are left out."""
    return spark.read.schema("term1 string, term2 string, length int").option("sep", "|").csv(path).where(F.col("length") >= 1)


def write_path_lengths(lengths: DataFrame, path: str) -> None:
    lengths.select("term1", "term2", "length").write.mode("overwrite").option("sep", "|").csv(path)


def term_set(lengths: DataFrame) -> DataFrame:
    """All terms of either column: ``term``."""
    return lengths.select(F.col("term1").alias("term")).union(lengths.select("term2")).where(F.trim("term") != "").distinct()


def read_descriptors(spark: SparkSession, path: str) -> DataFrame:
    """``id|name`` lines: ``id`` and ``name``."""
    return spark.read.schema("id string, name string").option("sep", "|").csv(path)


def descriptor_lines(raw: DataFrame) -> DataFrame:
    """Labels in the wanted language of raw ``value`` rows, without address prefix, quotes and language tag."""
    cleaned = F.replace(F.col("value"), F.lit(PREFIX), F.lit(""))
    for sign in ('"', "'", LANGUAGE):
        cleaned = F.replace(cleaned, F.lit(sign), F.lit(""))
    return raw.where(F.col("value").contains(LANGUAGE)).select(cleaned.alias("value"))


def read_tree(spark: SparkSession, path: str) -> DataFrame:
    """``tree_number,descriptor`` lines."""
    return spark.read.schema("tree_number string, descriptor string").csv(path)


def disease_terms(tree: DataFrame, branch: str = "C") -> DataFrame:
    """Descriptors of a branch of the tree: ``term``."""
    return tree.where(F.col("tree_number").startswith(branch)).select(F.col("descriptor").alias("term")).distinct()


def term_identifiers(tree: DataFrame, terms: DataFrame, identifiers: DataFrame) -> DataFrame:
    """``term`` and ``cui`` of those ``terms`` that are in the tree's disease branch, from ``id``, ``name`` rows."""
    known = disease_terms(tree).join(terms, "term", "left_semi")
    return known.join(identifiers.select(F.col("name").alias("term"), F.col("id").alias("cui")), "term", "left")


def term_pairs(terms: DataFrame, count: int | None = None) -> DataFrame:
    """All pairs ``term1 < term2`` of the first ``count`` terms (all, if None).

    The terms of one attribute are few; every two of them are the result asked for.
    """
    picked = terms.select("term").distinct()
    if count is not None:
        picked = picked.orderBy("term").limit(count)
    first, second = picked.select(F.col("term").alias("term1")), picked.select(F.col("term").alias("term2"))
    return first.join(second, F.col("term1") < F.col("term2"))


def write_term_pairs(pairs: DataFrame, path: str) -> None:
    pairs.select(F.concat_ws(SEPARATOR, "term1", "term2")).write.mode("overwrite").text(path)


def sample_terms(terms: DataFrame, count: int, seed: int = 1) -> DataFrame:
    """``count`` terms picked by chance, the same ones for a seed."""
    return terms.select("term").distinct().orderBy(F.xxhash64(F.lit(seed), "term"), "term").limit(count)


def write_similarities(sim: DataFrame, path: str) -> None:
    """``term1|term2|simvalue`` lines."""
    sim.select("term1", "term2", "simvalue").write.mode("overwrite").option("sep", "|").csv(path)


def read_written_similarities(spark: SparkSession, path: str) -> DataFrame:
    """What ``write_similarities`` has written."""
    return spark.read.schema(SIM).option("sep", "|").csv(path)


def read_model(spark: SparkSession, similarities: str | None = None, lengths: str | None = None, terms: str | None = None, count: int = 0) -> tuple[DataFrame, DataFrame, DataFrame | None]:
    """Similarities, terms and their identifiers (None if unknown) of files; of the example where there are none."""
    cuis = None
    if similarities:
        pairs = read_similarities(spark, similarities)
        sim, cuis = similarity.canonical(pairs), terms_with_cuis(pairs)
    elif lengths:
        sim = similarity.from_lengths(read_path_lengths(spark, lengths))
    else:
        sim = similarity.example(spark)
    own = read_terms(spark, terms) if terms else similarity.terms_of(sim)
    return sim, own.orderBy("term").limit(count) if count else own, cuis


def precompute(terms: DataFrame, sim: DataFrame, alpha: float, counts: Iterable[int], path: str) -> dict[int, str]:
    """Cluster the first so many terms for each of ``counts`` (0 for all), write the clusterings, and say where they are."""
    found = {}
    for count in counts:
        own = terms.orderBy("term").limit(count) if count else terms
        found[count] = f"{path}/clustering-{count or 'all'}-{alpha}"
        write_clustering(cluster(own, sim, alpha), found[count])
    return found


def write_clustering(clustering: Clustering, path: str) -> None:
    clustering.membership.withColumn("alpha", F.lit(clustering.alpha)).coalesce(1).write.mode("overwrite").parquet(path)


def read_clustering(spark: SparkSession, path: str) -> Clustering:
    rows = spark.read.parquet(path)
    return Clustering(rows.drop("alpha"), rows.agg(F.max("alpha")).first()[0])


def latest(rows: DataFrame, keys: list[str], order: str) -> DataFrame:
    """Of rows with the same keys, the last by ``order``."""
    last = Window.partitionBy(*keys).orderBy(F.desc(order))
    return rows.withColumn("_place", F.row_number().over(last)).where("_place = 1").drop("_place")

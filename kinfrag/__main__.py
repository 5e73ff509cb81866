"""Command line: build the relations and their fragments, and answer a query.

    python -m kinfrag -m -a 0.2 --path DIR --terms FILE --similarities FILE -sf 2 --query "SELECT ..." --relaxed
"""

from __future__ import annotations

import argparse

from pyspark.sql import SparkSession

from kinfrag.engine import Engine
from kinfrag.functions.rows import html_table
from kinfrag.operators.clustering import cluster
from kinfrag.schema import FragmentationSpec
from kinfrag.sources import files
from kinfrag.sources.generator import generate
from kinfrag.sources.store import Store


def arguments() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser("kinfrag", description=__doc__)
    mode = p.add_mutually_exclusive_group(required=True)
    mode.add_argument("-r", "--reference", dest="layout", action="store_const", const="baseline", help="plain relations")
    mode.add_argument("-m", "--materialized", dest="layout", action="store_const", const="fragmented", help="fragments, each with views by number")
    mode.add_argument("-p", "--partition", dest="layout", action="store_const", const="fragmented", help="fragments by number")
    p.add_argument("-a", "--alpha", type=float, required=True, help="similarity threshold, 0 to 1")
    p.add_argument("-sf", "--scalingFactor", type=int, default=0, help="size of generated relations; 0 keeps what is there")
    p.add_argument("-t", "--terms", help="file of terms; all terms of the similarities if left out")
    p.add_argument("--count", type=int, default=0, help="use only the first so many terms; 0 for all")
    source = p.add_mutually_exclusive_group()
    source.add_argument("--similarities", help="file of similarities by <>")
    source.add_argument("--lengths", help="file of path lengths by |")
    p.add_argument("--path", required=True, help="folder of the relations")
    p.add_argument("-rt", "--recreateTables", action="store_true", help="delete the folder first")
    p.add_argument("-ct", "--clearTables", action="store_true", help="empty the relations first")
    p.add_argument("-is", "--initSimilarity", action="store_true", help="write the similarities into the folder")
    p.add_argument("-ic", "--initClustering", action="store_true", help="cluster the terms and write the clustering into the folder")
    p.add_argument("--query", help="SQL over ILL, INFO and TREAT")
    p.add_argument("--relaxed", action="store_true", help="relax the query")
    p.add_argument("--html", action="store_true", help="print the answer as an HTML table")
    return p


def answer(engine: Engine, query: str, relaxed: bool, as_html: bool) -> str | None:
    out = engine.sql(query, relaxed=relaxed)
    if as_html:
        return html_table(out)
    out.show(100, truncate=False)
    return None


def main(argv: list[str] | None = None) -> int:
    p = arguments()
    a = p.parse_args(argv)
    if not 0 <= a.alpha <= 1:
        p.error("alpha must be from 0 to 1")
    if a.scalingFactor < 0 or a.count < 0:
        p.error("sizes must not be negative")
    spark = SparkSession.builder.appName("kinfrag").getOrCreate()
    store = Store(spark, a.path, FragmentationSpec())
    if a.recreateTables:
        store.drop()
    sim, terms, cuis = files.read_model(spark, a.similarities, a.lengths, a.terms, a.count)
    if a.initSimilarity:
        files.write_similarities(sim, f"{a.path}/similarities")
    stored = f"{a.path}/clustering"
    if a.initClustering:
        files.write_clustering(cluster(terms, sim, a.alpha), stored)
    if a.clearTables:
        store.clear()
    if a.scalingFactor:
        made = files.read_clustering(spark, stored) if a.initClustering else cluster(terms, sim, a.alpha)
        engine = Engine.from_clustering(spark, a.path, generate(spark, terms, a.scalingFactor), made, sim, layout=a.layout, cuis=cuis)
    else:
        engine = Engine(spark, store, a.layout)
    engine.register(fragments=True)
    if a.query and (text := answer(engine, a.query, a.relaxed, a.html)):
        print(text)
    return 0


if __name__ == "__main__":
    raise SystemExit(main())

"""Path lengths in taxonomies."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kinfrag.plans.scratch import materialize

#: Characters of one level of a tree number, its point included.
LEVEL = 4
#: Edges, and terms, up to which paths are searched on the driver, from the collected table.
DRIVER_EDGES, DRIVER_TERMS = 50_000, 1_000


def tree_edges(tree: DataFrame) -> DataFrame:
    """``child`` and ``parent`` tree numbers: the parent is the number without its last level."""
    numbers = tree.select("tree_number").distinct()
    up = numbers.where(F.length("tree_number") > LEVEL).select(F.col("tree_number").alias("child"), F.expr(f"substring(tree_number, 1, length(tree_number) - {LEVEL})").alias("parent"))
    return up.join(numbers.withColumnRenamed("tree_number", "parent"), "parent", "left_semi").select("child", "parent")


def path_lengths(edges: DataFrame, terms: DataFrame, longest: int | None = None) -> DataFrame:
    """Shortest path lengths of every two ``terms`` over undirected ``child``, ``parent`` edges.

    Gives ``term1 < term2`` and ``length``; pairs without a path are left out. The search widens
    from all terms at once, one join for each length; a node is left alone by a term that has
    reached it.
    """
    ends = edges.select(F.col("child").alias("a"), F.col("parent").alias("b")).where("a != b")
    few = ends.limit(DRIVER_EDGES + 1).collect()
    own = terms.select("term").where(F.col("term").isNotNull()).distinct().limit(DRIVER_TERMS + 1).collect()
    if len(few) <= DRIVER_EDGES and len(own) <= DRIVER_TERMS:
        return terms.sparkSession.createDataFrame(_on_driver(few, {r["term"] for r in own}, longest), "term1 string, term2 string, length int")
    both = materialize(ends.union(ends.select("b", "a")).distinct(), "taxonomy-edges")
    seen = terms.select(F.col("term").alias("source"), F.col("term").alias("node")).distinct().withColumn("length", F.lit(0))
    seen = materialize(seen, "taxonomy-seen")
    front, step = seen, 0
    while longest is None or step < longest:
        step += 1
        reached = front.join(both, front["node"] == both["a"]).select("source", F.col("b").alias("node")).distinct()
        front = materialize(reached.join(seen, ["source", "node"], "left_anti").withColumn("length", F.lit(step)), "taxonomy-front")
        if front.isEmpty():
            break
        seen = seen.unionByName(front)
    targets = terms.select(F.col("term").alias("node")).distinct()
    return seen.join(targets, "node", "left_semi").where("source < node").select(F.col("source").alias("term1"), F.col("node").alias("term2"), "length")


def _on_driver(edges: list, terms: set[str], longest: int | None) -> list[tuple[str, str, int]]:
    near: dict[str, set[str]] = {}
    for a, b in edges:
        near.setdefault(a, set()).add(b)
        near.setdefault(b, set()).add(a)
    found = []
    for source in sorted(terms):
        seen, front, step = {source}, {source}, 0
        while front and (longest is None or step < longest):
            step += 1
            front = set().union(*(near.get(n, set()) for n in front)) - seen
            seen |= front
            found += [(source, n, step) for n in front if n in terms and source < n]
    return found


def tree_path_lengths(tree: DataFrame, terms: DataFrame | None = None) -> DataFrame:
    """The same over tree numbers: the least length over all pairs of numbers of two descriptors.

    Two numbers meet at their deepest common ancestor, so every number brings its ancestors and
    equal ones are joined; no search is needed.
    """
    rows = tree.select("tree_number", F.col("descriptor").alias("term")).distinct()
    if terms is not None:
        rows = rows.join(terms.select("term").distinct(), "term", "left_semi")
    levels = F.floor((F.length("tree_number") - 1) / LEVEL)
    up = rows.withColumn("depth", levels).withColumn("above", F.explode(F.sequence(F.lit(0).cast("long"), F.col("depth"))))
    up = up.select("term", F.expr(f"substring(tree_number, 1, length(tree_number) - {LEVEL} * int(depth - above))").alias("ancestor"), (F.col("depth") - F.col("above")).cast("int").alias("climb"))
    up = up.groupBy("term", "ancestor").agg(F.min("climb").alias("climb"))
    a, b = up.alias("a"), up.alias("b")
    met = a.join(b, (F.col("a.ancestor") == F.col("b.ancestor")) & (F.col("a.term") < F.col("b.term")))
    return met.groupBy(F.col("a.term").alias("term1"), F.col("b.term").alias("term2")).agg(F.min(F.col("a.climb") + F.col("b.climb")).alias("length"))

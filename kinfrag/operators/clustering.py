"""Clustering of the terms of one attribute by farthest-first heads and a similarity threshold."""

from __future__ import annotations

from collections.abc import Iterable
from dataclasses import dataclass

from pyspark.sql import DataFrame, Row, Window
from pyspark.sql import functions as F

from kinfrag.operators.similarity import symmetric
from kinfrag.plans.scratch import materialize
from kinfrag.schema import MEMBERSHIP, UNASSIGNED

#: Pairs of terms up to which heads are found on the driver, from the collected table.
DRIVER_PAIRS = 1_000_000
#: Least similar terms that a distributed round takes heads from, at most; heads that are broadcast, at most.
ROUND, BROADCAST = 256, 200_000


@dataclass(frozen=True)
class Clustering:
    """``membership`` (``cluster_id``, ``head``, ``term``, ``is_head``) under a threshold."""

    membership: DataFrame
    alpha: float

    @property
    def heads(self) -> DataFrame:
        """``id`` and ``head`` of each cluster."""
        return self.membership.where("is_head").select(F.col("cluster_id").alias("id"), "head")

    @property
    def terms(self) -> DataFrame:
        return self.membership.select("term")

    def cluster(self, number: int) -> DataFrame:
        return self.membership.where(F.col("cluster_id") == number)

    def statistics(self) -> DataFrame:
        """Numbers of terms and clusters, and mean (whole), least and greatest cluster size."""
        sizes = self.membership.groupBy("cluster_id").agg(F.count("*").alias("size"))
        return sizes.agg(
            F.sum("size").alias("n_terms"),
            F.count("*").alias("n_clusters"),
            F.expr("sum(size) div count(*)").alias("avg_size"),
            F.min("size").alias("min_size"),
            F.max("size").alias("max_size"),
        )


def cluster(terms: DataFrame, sim: DataFrame, alpha: float) -> Clustering:
    """Clusters ``terms`` so that each is at least ``alpha`` similar to its head.

    The first head is the smallest term. While a term is less than ``alpha`` similar to its head, the
    least similar one (of equals that in the lowest cluster, then the smallest) becomes the next head
    and takes all terms to which it is as similar as their own head. Unknown pairs have similarity 0.
    """
    if not 0 <= alpha <= 1:
        raise ValueError("alpha must be from 0 to 1")
    terms = terms.select("term").where(F.col("term").isNotNull()).distinct()
    if terms.isEmpty():
        raise ValueError("there are no terms to cluster")
    count = terms.count()
    if count * count <= DRIVER_PAIRS:
        return Clustering(_on_driver(terms, sim, alpha), alpha)
    return Clustering(_distributed(terms, sim, alpha), alpha)


def _on_driver(terms: DataFrame, sim: DataFrame, alpha: float) -> DataFrame:
    known = sorted(r["term"] for r in terms.collect())
    value: dict[str, dict[str, float]] = {t: {} for t in known}
    for a, b, s in symmetric(sim).join(terms.withColumnRenamed("term", "term1"), "term1", "left_semi").collect():
        value[a][b] = s
    heads = [known[0]]
    best = {t: (value[heads[0]].get(t, 0.0), 0) for t in known[1:]}
    while best:
        (least, _), term = min((b, t) for t, b in best.items())
        if least >= alpha:
            break
        del best[term]
        for t, (s, _) in best.items():
            if value[term].get(t, 0.0) >= s:
                best[t] = (value[term].get(t, 0.0), len(heads))
        heads.append(term)
    rows = [(i, h, h, True) for i, h in enumerate(heads)] + [(i, heads[i], t, False) for t, (_, i) in best.items()]
    return terms.sparkSession.createDataFrame(rows, MEMBERSHIP)


def _next_heads(low: list[Row], value: dict[tuple[str, str], float], alpha: float, number: int) -> list[tuple[int, str]]:
    """The heads from ``number`` on that the least similar terms ``low`` settle, in order; the last of more than ``ROUND`` only bounds the rest.

    A term's place (``best``, ``cluster_id``, ``term``) never falls, so a head is the next one while it lies under that of the
    first term left out. All terms of similarity 0 are in the last cluster, so they follow it in the order of their names.
    """
    best = {r["term"]: (r["best"], r["cluster_id"]) for r in low[:ROUND]}
    rest = low[ROUND] if len(low) > ROUND else None
    heads: list[tuple[int, str]] = []
    while best:
        (least, own), term = min((b, t) for t, b in best.items())
        if least >= alpha:
            break
        if rest is not None:
            last = number + len(heads) - 1 if rest["best"] == 0 else rest["cluster_id"]
            if (least, own, term) > (rest["best"], last, rest["term"]):
                break
        del best[term]
        for t, (s, _) in best.items():
            if value.get((term, t), 0.0) >= s:
                best[t] = (value.get((term, t), 0.0), number + len(heads))
        heads.append((number + len(heads), term))
    return heads


def _distributed(terms: DataFrame, sim: DataFrame, alpha: float) -> DataFrame:
    spark = terms.sparkSession
    both = materialize(symmetric(sim), "cluster-sim")

    def moved(state: DataFrame, new: list[tuple[int, str]]) -> DataFrame:
        """The terms but for the ``new`` heads (``ROUND`` at most), each with the last head that it is as similar to as any."""
        named = F.broadcast(spark.createDataFrame(new, "number int, head string"))
        near = both.join(named, both["term2"] == named["head"]).groupBy(F.col("term1").alias("term")).agg(F.max(F.struct(F.col("simvalue").alias("s"), "number")).alias("near"))
        unknown = F.struct(F.lit(0.0).alias("s"), F.lit(new[-1][0]).alias("number"))
        at = F.greatest(F.struct(F.col("best").alias("s"), F.col("cluster_id").alias("number")), unknown, F.col("near"))
        left = state.join(named, state["term"] == named["head"], "left_anti").join(near, "term", "left")
        return materialize(left.select("term", at.alias("at")).select("term", F.col("at.s").alias("best"), F.col("at.number").alias("cluster_id")), "cluster-state")

    heads = [(0, terms.agg(F.min("term")).first()[0])]
    state = moved(terms.select("term", F.lit(0.0).alias("best"), F.lit(0).alias("cluster_id")), heads)
    while True:
        low = state.orderBy("best", "cluster_id", "term").limit(ROUND + 1).collect()
        if not low or low[0]["best"] >= alpha:
            break
        own = F.broadcast(spark.createDataFrame([(r["term"],) for r in low[:ROUND]], "term string"))
        among = both.join(own, both["term1"] == own["term"], "left_semi").join(own, both["term2"] == own["term"], "left_semi")
        new = _next_heads(low, {(r["term1"], r["term2"]): r["simvalue"] for r in among.collect()}, alpha, len(heads))
        heads += new
        state = moved(state, new)
    named = spark.createDataFrame(heads, "cluster_id int, head string")
    made = named.select("cluster_id", "head", F.col("head").alias("term"), F.lit(True).alias("is_head"))
    rest = state.join(F.broadcast(named) if len(heads) <= BROADCAST else named, "cluster_id").select("cluster_id", "head", "term", F.lit(False).alias("is_head"))
    return materialize(made.unionByName(rest), "cluster-membership")


def identify(terms: DataFrame, heads: DataFrame, sim: DataFrame) -> DataFrame:
    """The fragment of every term: ``term`` and ``frag_id``.

    A head has its own; another term that of the head it is most similar to, of equal ones the lowest.
    Terms that no head is similar to have ``UNASSIGNED``.
    """
    terms = terms.select("term").distinct()
    pairs = symmetric(sim).select(F.col("term1").alias("term"), F.col("term2").alias("head"), "simvalue")
    near = pairs.join(heads.select("id", "head"), "head").select("term", "id", "simvalue")
    own = heads.select(F.col("head").alias("term"), "id", F.lit(float("inf")).alias("simvalue"))
    best = near.unionByName(own).groupBy("term").agg(F.max(F.struct("simvalue", (-F.col("id")).alias("low"))).alias("best"))
    return terms.join(best, "term", "left").select("term", F.coalesce(-F.col("best.low"), F.lit(UNASSIGNED)).cast("int").alias("frag_id"))


def identify_top(terms: DataFrame, heads: DataFrame, sim: DataFrame) -> DataFrame:
    """``identify`` by ranking: the first of each term's heads by similarity, then cluster number."""
    pairs = symmetric(sim).select(F.col("term1").alias("term"), F.col("term2").alias("head"), "simvalue")
    pairs = pairs.union(heads.select("head", F.col("head"), F.lit(1.0)))
    order = Window.partitionBy("term").orderBy((F.col("term") == F.col("head")).desc(), F.desc("simvalue"), "id")
    ranked = terms.select("term").distinct().join(pairs, "term").join(heads, "head").withColumn("place", F.row_number().over(order))
    return ranked.where("place = 1").select("term", "head", F.col("id").cast("int").alias("frag_id"))


def sweep(terms: DataFrame, sim: DataFrame, alphas: Iterable[float]) -> DataFrame:
    """``statistics`` for each threshold, with its ``alpha``."""
    out = None
    for alpha in alphas:
        one = cluster(terms, sim, alpha).statistics().withColumn("alpha", F.lit(alpha))
        out = one if out is None else out.unionByName(one)
    if out is None:
        raise ValueError("no threshold is given")
    return out

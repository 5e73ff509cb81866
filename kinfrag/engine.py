"""The engine: exact and relaxed answers over fragmented or plain relations."""

from __future__ import annotations

import uuid
from collections.abc import Callable
from dataclasses import dataclass, field
from typing import Any

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from kinfrag.functions.rows import html_table, note
from kinfrag.operators.clustering import Clustering, cluster, identify
from kinfrag.operators.fragments import with_cuis
from kinfrag.plans.routing import Routed, route, with_views
from kinfrag.schema import UNASSIGNED, FragmentationSpec, UnknownTerm, UnsupportedQuery
from kinfrag.sources import files
from kinfrag.sources.store import Store

#: Terms of a model that are held on the driver for routing, at most; beyond, terms are looked up one by one.
HELD_TERMS = 200_000
#: Terms of a fragment up to which an IN list names them.
LISTED_TERMS = 1_000

#: Texts whose routing is kept, at most.
KEPT_TEXTS = 1_000

LAYOUTS = ("fragmented", "baseline")

#: The store whose relations a session's views show, by application.
_shown: dict[str, str] = {}


class FragmentLookup(dict):
    """Fragments of terms, read from the assignment when they are first asked for."""

    def __init__(self, assign: DataFrame):
        super().__init__()
        self.assign = assign
        if assign.count() <= HELD_TERMS:
            self.update((r["term"], r["frag_id"]) for r in assign.collect())
            self.assign = None

    def get(self, term: str, default: Any = None) -> Any:
        if term not in self and self.assign is not None:
            row = self.assign.where(F.col("term") == term).first()
            self[term] = row["frag_id"] if row else UNASSIGNED
        return super().get(term, default)


@dataclass
class Engine:
    """Answers SQL over ``store``; ``layout`` says whether fragments are used."""

    spark: SparkSession
    store: Store
    layout: str = "fragmented"
    views: dict[str, str] = field(default_factory=dict)
    routed: dict[tuple, Routed] = field(default_factory=dict)

    def __post_init__(self) -> None:
        if self.layout not in LAYOUTS:
            raise ValueError(f"layout must be one of {', '.join(LAYOUTS)}")
        self.spec = self.store.spec
        self.refresh()

    def refresh(self) -> None:
        """Read the store anew, after its relations or fragments have changed."""
        self.routed.clear()
        _shown.pop(self.spark.sparkContext.applicationId, None)
        self.lookup = FragmentLookup(self.store.assign)
        tag = uuid.uuid4().hex[:12]
        for name in self.spec.schemas:
            self.views[name] = f"kinfrag_{tag}_{name.lower()}_f"
            self.store.fragmented(name).createOrReplaceTempView(self.views[name])
            self.store.logical(name).createOrReplaceTempView(self.plain_view(name))
        self.assign_view = f"kinfrag_{tag}_assign"
        self.store.assign.createOrReplaceTempView(self.assign_view)

    @classmethod
    def build(cls, spark: SparkSession, path: str, tables: dict[str, DataFrame], sim: DataFrame, terms: DataFrame, alpha: float, spec: FragmentationSpec | None = None, layout: str = "fragmented", cuis: DataFrame | None = None) -> Engine:
        """Cluster ``terms``, write the relations and their fragments under ``path``, and open them.

        ``cuis`` (``term`` and ``cui``) fills the identifiers that rows of the primary relation lack.
        """
        return cls.from_clustering(spark, path, tables, cluster(terms, sim, alpha), sim, spec, layout, cuis)

    @classmethod
    def from_clustering(cls, spark: SparkSession, path: str, tables: dict[str, DataFrame], clustering: Clustering, sim: DataFrame, spec: FragmentationSpec | None = None, layout: str = "fragmented", cuis: DataFrame | None = None) -> Engine:
        """The same with a clustering that was made before."""
        store = Store(spark, path, spec or FragmentationSpec())
        if cuis is not None:
            tables = tables | {store.spec.primary: with_cuis(tables[store.spec.primary], cuis, store.spec)}
        store.create(tables, identify(clustering.terms, clustering.heads, sim))
        return cls(spark, store, layout)

    @classmethod
    def from_files(cls, spark: SparkSession, path: str, tables: dict[str, DataFrame], alpha: float, *, similarities: str | None = None, lengths: str | None = None, terms: str | None = None, clustering: str | None = None, count: int = 0, layout: str = "fragmented") -> Engine:
        """The same from files of similarities or path lengths (the example where there is neither), of terms, and of a stored clustering.

        ``count`` picks the first so many terms; 0 takes all.
        """
        sim, own, cuis = files.read_model(spark, similarities, lengths, terms, count)
        made = files.read_clustering(spark, clustering) if clustering else cluster(own, sim, alpha)
        return cls.from_clustering(spark, path, tables, made, sim, None, layout, cuis)

    @classmethod
    def from_function(cls, spark: SparkSession, path: str, tables: dict[str, DataFrame], similarity_of: Callable[[Column, Column], Column], terms: DataFrame, alpha: float, layout: str = "fragmented") -> Engine:
        """The same with similarities that are a function of two columns of terms."""
        pairs = files.term_pairs(terms)
        return cls.build(spark, path, tables, pairs.withColumn("simvalue", similarity_of(F.col("term1"), F.col("term2"))), terms, alpha, layout=layout)

    def plain_view(self, name: str) -> str:
        """The view of a relation that only this engine's texts read, whatever other engines show by its name."""
        return self.views[name].removesuffix("_f") + "_l"

    def register(self, fragments: bool = False) -> None:
        """Views by the relations' names, and with ``fragments`` one ``NAME_<i>`` for each fragment."""
        session = self.spark.sparkContext.applicationId
        if _shown.get(session) != self.store.path:
            for name in self.spec.schemas:
                self.store.logical(name).createOrReplaceTempView(name)
            _shown[session] = self.store.path
        if fragments:
            for row in self.store.assign.select("frag_id").distinct().collect():
                for name in self.spec.schemas:
                    self.store.fragment(name, row["frag_id"]).createOrReplaceTempView(f"{name}_{row['frag_id']}")

    def terms_of(self, number: int) -> str:
        """The terms of a fragment as SQL: literals of few, else a subquery."""
        own = self.store.assign.where(F.col("frag_id") == number).select("term").limit(LISTED_TERMS + 1).collect()
        if len(own) > LISTED_TERMS:
            return f"SELECT term FROM {self.assign_view} WHERE frag_id = {number}"
        return ", ".join("'" + r["term"].replace("\\", "\\\\").replace("'", "\\'") + "'" for r in sorted(own))

    def explain_routing(self, sql: str, relaxed: bool = False, with_relaxed_term: bool = False, args: dict[str, Any] | None = None) -> Routed:
        """The text that would run, and the fragments of each instance; texts are routed once."""
        key = (sql, relaxed, with_relaxed_term, repr(sorted((args or {}).items())))
        if key not in self.routed:
            if len(self.routed) >= KEPT_TEXTS:
                self.routed.pop(next(iter(self.routed)))
            found = self._route(sql, relaxed, with_relaxed_term, args)
            found.text = with_views(self.spark, found.sql, self.spec, self.plain_view)
            self.routed[key] = found
        return self.routed[key]

    def _route(self, sql: str, relaxed: bool, with_relaxed_term: bool, args: dict[str, Any] | None) -> Routed:
        if self.layout == "baseline":
            if not relaxed:
                return Routed(sql, {}, "baseline layout")
            return route(self.spark, sql, self.spec, self.lookup, None, True, with_relaxed_term, args, self.terms_of)
        return route(self.spark, sql, self.spec, self.lookup, self.views.__getitem__, relaxed, with_relaxed_term, args)

    def sql(self, sql: str, relaxed: bool = False, with_relaxed_term: bool = False, args: dict[str, Any] | None = None) -> DataFrame:
        """The answer to ``sql``; relaxed, each selected term stands for all terms of its fragment."""
        self.register()
        text = self.explain_routing(sql, relaxed, with_relaxed_term, args).text
        return self.spark.sql(text, args=args) if args else self.spark.sql(text)

    def answer(self, sql: str, relaxed: bool = False) -> str:
        """The answer as an HTML table; what can't be answered as a line that says why."""
        try:
            return html_table(self.sql(sql, relaxed=relaxed))
        except (UnsupportedQuery, UnknownTerm, AnalysisException) as why:
            return note(f"{type(why).__name__}: {why}")

    def query(self, **instances: str) -> FlexQuery:
        """A query by instances, such as ``query(i="ILL", p="INFO")``, built with DataFrames alone."""
        return FlexQuery(self, instances)


@dataclass
class FlexQuery:
    """An inner join of instances by key, with selections of terms."""

    engine: Engine
    instances: dict[str, str]
    selected: dict[str, str] = field(default_factory=dict)
    filters: list[Column] = field(default_factory=list)

    def term(self, instance: str, term: str) -> FlexQuery:
        """Select ``term`` in an instance of the primary relation."""
        if self.instances[instance] != self.engine.spec.primary:
            raise ValueError(f"{instance} is no instance of {self.engine.spec.primary}")
        self.selected[instance] = term
        return self

    def where(self, condition: Column) -> FlexQuery:
        self.filters.append(condition)
        return self

    def frame(self, relaxed: bool = False) -> DataFrame:
        """The joined rows, columns by ``instance.column``."""
        engine, spec = self.engine, self.engine.spec
        numbers = {i: engine.lookup.get(t, UNASSIGNED) for i, t in self.selected.items()}
        if relaxed:
            for i, n in numbers.items():
                if n == UNASSIGNED:
                    raise UnknownTerm(self.selected[i])
        known = [n for n in numbers.values() if n != UNASSIGNED]
        out, first = None, None
        for name, table in self.instances.items():
            number = numbers.get(name, UNASSIGNED) if table == spec.primary else next(iter(known), UNASSIGNED)
            if engine.layout == "baseline" or number == UNASSIGNED:
                rows = engine.store.logical(table)
                if relaxed and name in numbers:
                    own = engine.store.assign.where(F.col("frag_id") == numbers[name])
                    rows = rows.join(F.broadcast(own) if own.count() <= HELD_TERMS else own, rows[spec.attribute] == own["term"], "left_semi")
            else:
                rows = engine.store.fragment(table, number)
            if name in self.selected and not relaxed:
                rows = rows.where(F.col(spec.attribute) == self.selected[name])
            rows = rows.alias(name)
            if out is None:
                out, first = rows, name
            else:
                out = out.join(rows, F.col(f"{first}.{spec.key}") == F.col(f"{name}.{spec.key}"))
        if out is None:
            raise ValueError("the query has no instance")
        for f in self.filters:
            out = out.where(f)
        return out


@dataclass
class Service:
    """Answers to queries in any mode, over engines that are built when first asked for and kept.

    ``build`` makes the engine of a layout, a number of terms (0 for all) and a threshold.
    """

    build: Callable[[str, int, float], Engine]
    engines: dict[tuple[str, int, float], Engine] = field(default_factory=dict)

    def answer(self, query: str, mode: str, terms: int, alpha: float, fqa: bool) -> str:
        """An HTML table of the answer, relaxed with ``fqa``; ``mode`` is a layout."""
        key = (mode, terms, alpha)
        if key not in self.engines:
            self.engines[key] = self.build(*key)
        return self.engines[key].answer(query, relaxed=fqa)

"""Relations of the engine, and what is fragmented by what."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import types as T


def _struct(*fields: tuple[str, T.DataType, bool]) -> T.StructType:
    return T.StructType([T.StructField(*f) for f in fields])


#: Persons.
INFO = _struct(("id", T.IntegerType(), False), ("name", T.StringType(), True), ("address", T.StringType(), True), ("age", T.IntegerType(), True))
#: Which person has which disease: the primary relation.
ILL = _struct(("id", T.IntegerType(), False), ("disease", T.StringType(), False), ("cui", T.StringType(), True))
#: Prescriptions of persons.
TREAT = _struct(("id", T.IntegerType(), False), ("prescription", T.StringType(), False), ("success", T.BooleanType(), True))
#: Similarities of pairs of terms, ``term1 < term2``.
SIM = _struct(("term1", T.StringType(), False), ("term2", T.StringType(), False), ("simvalue", T.DoubleType(), False))
CLUSTERING = _struct(("id", T.IntegerType(), False), ("head", T.StringType(), False))
MEMBERSHIP = _struct(("cluster_id", T.IntegerType(), False), ("head", T.StringType(), False), ("term", T.StringType(), False), ("is_head", T.BooleanType(), False))
ASSIGN = _struct(("term", T.StringType(), False), ("frag_id", T.IntegerType(), False))

#: Fragment of rows whose term is not in the similarity model.
UNASSIGNED = -1


class UnsupportedQuery(ValueError):
    """A relaxed answer was asked of a query in which the selection can't be relaxed soundly."""


class UnknownTerm(LookupError):
    """A relaxed answer was asked for a term that has no fragment."""


@dataclass(frozen=True)
class FragmentationSpec:
    """The primary relation, fragmented by ``attribute``, and those that follow it along ``key``."""

    primary: str = "ILL"
    key: str = "id"
    attribute: str = "disease"
    schemas: dict[str, T.StructType] = field(default_factory=lambda: {"ILL": ILL, "INFO": INFO, "TREAT": TREAT})
    #: Columns that identify a row; a later row with the same ones replaces it.
    keys: dict[str, tuple[str, ...]] = field(default_factory=lambda: {"ILL": ("id", "disease"), "INFO": ("id",), "TREAT": ("id", "prescription")})

    @property
    def derived(self) -> tuple[str, ...]:
        return tuple(t for t in self.schemas if t != self.primary)

    def columns(self, table: str) -> list[str]:
        return self.schemas[table].fieldNames()

    def relation(self, name: str) -> str | None:
        """The relation of that name in any case, or None."""
        return next((t for t in self.schemas if t.lower() == name.lower()), None)

"""The data model: resource types, their fields, and where their rows come from."""

from __future__ import annotations

import json
import re
from collections.abc import Callable, Iterable, Mapping
from dataclasses import dataclass, field, replace
from typing import Any

from pyspark.sql import DataFrame, SparkSession

from sparkgraph.errors import UnknownType
from sparkgraph.terms import RDF_TYPE

SCALARS = ("string", "integer", "boolean", "float", "double", "decimal", "date", "datetime")


@dataclass(frozen=True)
class Field:
    """A predicate of a type and the column that holds it.

    ``kind`` is one of SCALARS or "ref"; ``many`` marks array columns; ``targets``
    are the types (IRIs) that a reference may point to, by their id column.
    """

    predicate: str
    column: str
    kind: str = "string"
    many: bool = False
    targets: tuple[str, ...] = ()
    indexed: bool = False

    def __post_init__(self) -> None:
        if self.kind not in (*SCALARS, "ref"):
            raise ValueError(f"unknown field kind {self.kind!r}")
        if (self.kind == "ref") != bool(self.targets):
            raise ValueError(f"targets go with references: {self.predicate}")

    @property
    def is_ref(self) -> bool:
        return self.kind == "ref"


def local_name(iri: str) -> str:
    """What follows the last ``#``, or else the last ``/``."""
    return iri.rpartition("#" if "#" in iri else "/")[2]


@dataclass(frozen=True)
class ResourceType:
    """A class of resources: one row of its table each.

    ``subject_column`` holds the full IRI; ``id_column`` (by default the same)
    what references to it hold.
    """

    iri: str
    fields: tuple[Field, ...] = ()
    table: str = ""
    subject_column: str = "_subject"
    id_column: str = ""

    def __post_init__(self) -> None:
        object.__setattr__(self, "table", self.table or local_name(self.iri))
        object.__setattr__(self, "id_column", self.id_column or self.subject_column)

    def field(self, predicate: str) -> Field | None:
        return next((f for f in self.fields if f.predicate == predicate), None)


#: Gives the rows of a type. The last argument names the columns that the query reads (None: all), so that a
#: source need not derive the others; more columns than these do no harm.
Source = Callable[[SparkSession, ResourceType, frozenset[str] | None], DataFrame]


@dataclass
class GraphCatalog:
    """The registered types, in order, with their lookups and absence rewrites."""

    types: dict[str, ResourceType] = field(default_factory=dict)
    _sources: dict[str, Source] = field(default_factory=dict)
    _absent: dict[tuple[str, str], tuple[str, ...]] = field(default_factory=dict)

    def register(self, type_: ResourceType, source: Source | None = None) -> GraphCatalog:
        self.types[type_.iri] = type_
        if source:
            self._sources[type_.iri] = source
        return self

    def identified_by(self, subject_column: str, id_column: str = "") -> GraphCatalog:
        """Let all types use these columns for IRIs and for what references hold (by default the same)."""
        self.types = {iri: replace(t, subject_column=subject_column, id_column=id_column or subject_column) for iri, t in self.types.items()}
        return self

    def bind(self, source: Source, types: Iterable[str] | None = None) -> GraphCatalog:
        """Let ``source`` give the rows of these types (all by default)."""
        for iri in types if types is not None else self.types:
            self._sources[self.type(iri).iri] = source
        return self

    def rows(self, spark: SparkSession, iri: str, columns: Iterable[str] | None = None) -> DataFrame:
        """The rows of a type with its subject and id, and at least these columns."""
        t = self.types[iri]
        needed = None if columns is None else frozenset((*columns, t.subject_column, t.id_column))
        return self._sources[iri](spark, t, needed)

    def type(self, iri: str) -> ResourceType:
        if iri not in self.types:
            raise UnknownType(iri)
        return self.types[iri]

    def known_types(self) -> list[str]:
        return list(self.types)

    def is_known_predicate(self, predicate: str) -> bool:
        return predicate == RDF_TYPE or bool(self.types_for_predicate(predicate))

    def known_predicates(self) -> list[str]:
        return list(dict.fromkeys(f.predicate for t in self.types.values() for f in t.fields))

    def types_for_predicate(self, predicate: str) -> list[str]:
        """The types that have the predicate, in the order of registration."""
        return [iri for iri, t in self.types.items() if t.field(predicate)]

    def field_name(self, type_iri: str, predicate: str) -> str | None:
        f = self.type(type_iri).field(predicate)
        return f.column if f else None

    def predicate_for_field(self, type_iri: str, column: str) -> str | None:
        return next((f.predicate for f in self.type(type_iri).fields if f.column == column), None)

    def fields_for_type(self, type_iri: str) -> tuple[Field, ...]:
        return self.type(type_iri).fields

    def table_name(self, type_iri: str) -> str:
        return self.type(type_iri).table

    def range_types(self, type_iri: str, predicate: str) -> tuple[str, ...]:
        f = self.type(type_iri).field(predicate)
        return f.targets if f else ()

    def register_absence_rewrite(self, predicate: str, type_iri: str, columns: Iterable[str]) -> GraphCatalog:
        """Say that no resource points by ``predicate`` to a resource of the type whose ``columns`` are all null."""
        self._absent[predicate, self.type(type_iri).iri] = tuple(columns)
        return self

    def absence_rewrite(self, predicate: str, type_iri: str) -> tuple[str, ...] | None:
        return self._absent.get((predicate, type_iri))

    @classmethod
    def from_spec(cls, spec: Mapping[str, Any] | str) -> GraphCatalog:
        """A catalogue from a mapping or its JSON text.

        ``{"prefixes": {p: iri}, "types": {type: {"table", "subject", "id", "fields": {column: [predicate, kind]}}},
        "absence": [[predicate, type, [column, ...]]]}``, where a kind is a scalar, ``Type`` or ``A|B`` for a
        reference, and ``...[]`` for an array; names may be prefixed.
        """
        spec = json.loads(spec) if isinstance(spec, str) else spec
        prefixes = spec.get("prefixes", {})

        def full(name: str) -> str:
            prefix, colon, rest = name.partition(":")
            return prefixes[prefix] + rest if colon and prefix in prefixes else name

        out = cls()
        for name, entry in spec["types"].items():
            fields = []
            for column, (predicate, kind) in entry.get("fields", {}).items():
                many = kind.endswith("[]")
                base = kind.removesuffix("[]")
                if base in SCALARS:
                    fields.append(Field(full(predicate), column, base, many))
                else:
                    fields.append(Field(full(predicate), column, "ref", many, tuple(full(t) for t in re.split(r"\s*\|\s*", base))))
            out.register(ResourceType(full(name), tuple(fields), entry.get("table", ""), entry.get("subject", "_subject"), entry.get("id", "")))
        for predicate, type_, columns in spec.get("absence", []):
            out.register_absence_rewrite(full(predicate), full(type_), columns)
        return out

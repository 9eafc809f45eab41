"""Partial solutions: a DataFrame and what its columns mean."""

from __future__ import annotations

import itertools
from dataclasses import dataclass, field, replace
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from sparkgraph.catalog import GraphCatalog
from sparkgraph.functions.terms import NUMERIC, SPARK_TYPES, iri_term, term
from sparkgraph.terms import Var

_numbers = itertools.count()


def fresh(label: str) -> str:
    """A column name that nothing else has; variables may differ in case only, columns may not."""
    return f"__{label}{next(_numbers)}"


@dataclass(frozen=True)
class Binding:
    """The columns of a variable.

    "res": a resource, by ``key`` (what references hold), the types it may be of
    and, once known, ``iri``; "iri": IRIs in ``column``; "val": literals of
    ``value_kind`` in ``column``; "term": mixed terms in ``column``. ``inline``
    marks constants of the query, ``optional`` columns whose nulls are unbound
    and agree with anything.

    A key tells resources of one type apart only, so it goes with a type: ``sets``
    are the sets of types that a row's resource may be of, by number. Where there
    are several, the row's number is in the column ``tag``.
    """

    kind: str
    column: str = ""
    value_kind: str = ""
    key: str = ""
    iri: str = ""
    tag: str = ""
    sets: tuple[tuple[int, tuple[str, ...]], ...] = ()
    inline: bool = False
    optional: bool = False

    def columns(self) -> list[str]:
        return [c for c in (self.column, self.key, self.tag, self.iri) if c]

    def number(self) -> Column:
        """The number of each row's set of types."""
        return F.col(self.tag) if self.tag else F.lit(self.sets[0][0] if self.sets else -1)

    def exact(self) -> bool:
        """Whether each row's type is known."""
        return all(len(types) == 1 for _, types in self.sets)


@dataclass
class Solution:
    df: DataFrame
    bindings: dict[Var, Binding]

    def keep(self) -> Solution:
        """Only the columns of bindings."""
        names = list(dict.fromkeys(c for b in self.bindings.values() for c in b.columns()))
        return Solution(self.df.select(*names), self.bindings)


@dataclass(frozen=True)
class Context:
    spark: SparkSession
    catalog: GraphCatalog
    _sets: dict[tuple[str, ...], int] = field(default_factory=dict)

    def typed(self, types: tuple[str, ...]) -> tuple[int, tuple[str, ...]]:
        """A set of types with its number in this query."""
        return self._sets.setdefault(types, len(self._sets)), types


def with_iri(context: Context, solution: Solution, var: Var) -> Solution:
    """Look up the IRI of a resource that is known by its key only; a key that no target has gives null.

    Of several targets that have the key, the first counts, in the order in
    which the reference declares them; the row's type is then that one.
    """
    b = solution.bindings[var]
    if b.kind != "res" or b.iri:
        return solution
    df, found = solution.df, {}
    for type_iri in dict.fromkeys(t for _, types in b.sets for t in types):
        t = context.catalog.type(type_iri)
        name, key = fresh("iri"), fresh("key")
        rows = context.catalog.rows(context.spark, type_iri, ()).select(F.col(t.id_column).cast("string").alias(key), F.col(t.subject_column).alias(name))
        having = [n for n, types in b.sets if type_iri in types]
        here = df[b.key] == rows[key]
        df = df.join(rows, here if len(having) == len(b.sets) else here & b.number().isin(having), "left").drop(key)
        found[type_iri] = name
    iri, made = fresh("iri"), b
    value = _by_set(b, [F.coalesce(*(F.col(found[t]) for t in types)) for _, types in b.sets])
    if not b.exact():
        tag = fresh("t")
        known = lambda n, types: F.coalesce(*(F.when(F.col(found[t]).isNotNull(), F.lit(context.typed((t,))[0])) for t in types), F.lit(n))
        df = df.withColumn(tag, _by_set(b, [known(n, types) for n, types in b.sets]))
        made = replace(b, tag=tag, sets=tuple(dict.fromkeys([*(context.typed((t,)) for t in found), *b.sets])))
    df = df.withColumn(iri, value).drop(*found.values())
    return Solution(df, {**solution.bindings, var: replace(made, iri=iri)})


def _by_set(b: Binding, values: list[Column]) -> Column:
    """The value that belongs to each row's set of types."""
    if len(values) == 1:
        return values[0]
    out = F.when(F.lit(False), F.lit(None).cast("string")) if not values else F.when(b.number() == b.sets[0][0], values[0])
    for (n, _), value in zip(b.sets[1:], values[1:], strict=True):
        out = out.when(b.number() == n, value)
    return out


def same_resource(a: Binding, b: Binding) -> Column:
    """Equality of two resources: of key, and of type, which a reference to several types leaves open."""
    equal = F.col(a.key) == F.col(b.key)
    near = {n: [m for m, other in b.sets if set(types) & set(other)] for n, types in a.sets}
    if all(len(ms) == len(b.sets) for ms in near.values()):
        return equal
    if a.exact() and b.exact():
        return equal & (a.number() == b.number())
    return equal & reduce(Column.__or__, [(a.number() == n) & b.number().isin(ms) for n, ms in near.items() if ms], F.lit(False))


def as_term(b: Binding) -> Column:
    """The binding as mixed terms; a resource needs its IRI."""
    if b.kind == "term":
        return F.col(b.column)
    if b.kind == "val":
        return term(F.col(b.column), b.value_kind)
    return iri_term(F.col(b.iri if b.kind == "res" else b.column))


def needs_iri(a: Binding, b: Binding) -> bool:
    """Whether comparing the two needs the IRI of ``a``."""
    return a.kind == "res" and b.kind in ("iri", "term")


def agree(a: Binding, b: Binding) -> Column:
    """Equality of two bindings; terms of different natures differ."""
    if a.kind == b.kind == "res":
        return same_resource(a, b)
    if "term" in (a.kind, b.kind):
        x, y = as_term(a), as_term(b)
        return (x["kind"] == y["kind"]) & (x["lex"] == y["lex"]) & x["dt"].eqNullSafe(y["dt"])
    if a.kind == b.kind == "val":
        x, y = F.col(a.column), F.col(b.column)
        if a.value_kind == b.value_kind or (a.value_kind in NUMERIC and b.value_kind in NUMERIC):
            return x == y
        if a.inline != b.inline:  # a constant is read in the type of the column
            return x.try_cast(SPARK_TYPES[b.value_kind]) == y if a.inline else x == y.try_cast(SPARK_TYPES[a.value_kind])
        return F.lit(False)
    if "val" in (a.kind, b.kind):
        value, other = (a, b) if a.kind == "val" else (b, a)
        if other.kind == "iri" and other.inline and value.value_kind == "string":
            return F.col(value.column) == F.col(other.column)
        return F.lit(False)
    return F.col(a.iri or a.column) == F.col(b.iri or b.column)

"""Scans: one pattern over the tables of its candidate types."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import replace
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sparkgraph.catalog import Field, ResourceType
from sparkgraph.functions.terms import DATATYPES, NUMERIC, SPARK_TYPES, iri_term, lexical, matches, native, term, widest
from sparkgraph.operators.bindings import Binding, Context, Solution, fresh, with_iri
from sparkgraph.plans.resolve import Pattern
from sparkgraph.terms import RDF_TYPE, Iri, Literal, Term, Var

_SUBJECT, _ID = "__subject", "__id"


def _elements(column: Column) -> Column:
    """The distinct, not null elements of an array; a graph has a triple once."""
    return F.array_distinct(F.filter(column, lambda x: x.isNotNull()))


def _entry(field: Field, value: Term, number: int) -> Callable[[Column], Column]:
    """An element of a field as a triple's predicate and object; null if it is not there or not the literal asked for."""

    def made(x: Column) -> Column:
        wanted = matches(x, field, value) if isinstance(value, Literal) else x.isNotNull()
        entry = F.struct(
            F.lit(field.predicate).alias("p"),
            F.lit("iri" if field.is_ref else "literal").alias("kind"),
            lexical(native(x, field.kind), "string" if field.is_ref else field.kind).alias("lex"),
            F.lit(None if field.is_ref else DATATYPES[field.kind]).cast("string").alias("dt"),
            F.lit(number).alias("range"),
        )
        return F.when(wanted, entry)

    return made


class _TypeScan:
    """One pattern over one type: a frame with subject, id and a column for each occurrence of a variable."""

    def __init__(self, context: Context, pattern: Pattern, type_: ResourceType):
        self.context, self.type = context, type_
        used = {f.column for f in (type_.field(p) for p, _ in pattern.constraints) if f}
        if pattern.scans:
            used |= {f.column for f in type_.fields}
        used |= pattern.null_columns.get(type_.iri, set())
        rows = context.catalog.rows(context.spark, type_.iri, used)
        self.names = {c: f"__f{i}" for i, c in enumerate(sorted(used))}
        self.df = rows.select(
            F.col(type_.subject_column).alias(_SUBJECT),
            F.col(type_.id_column).cast("string").alias(_ID),
            *[F.col(c).alias(n) for c, n in self.names.items()],
        )
        self.found: dict[Var, list[tuple[str, Field | str]]] = {}
        if isinstance(pattern.subject, Iri):
            self.df = self.df.where(F.col(_SUBJECT) == pattern.subject.value)
        for column in pattern.null_columns.get(type_.iri, ()):
            self.df = self.df.where(F.col(self.names[column]).isNull())
        for predicate, value in pattern.constraints:
            field = type_.field(predicate)
            if field is None:
                raise AssertionError(predicate)
            self.constrain(field, value)
        for var in pattern.type_variables:
            self.add(var, F.lit(type_.iri), "iri")
        for predicate, value in pattern.scans:
            self.scan_fields(predicate, value)
        if isinstance(pattern.subject, Var):
            for name, field in self.found.pop(pattern.subject, []):
                if isinstance(field, Field) and field.is_ref:
                    self.df = self.df.where(F.col(name) == F.col(_ID) if type_.iri in field.targets else F.lit(False))
                else:
                    self.df = self.df.where(F.col(name) == F.col(_SUBJECT) if field == "iri" else F.lit(False))

    def add(self, var: Var, column: Column, field: Field | str) -> None:
        name = fresh("o")
        self.df = self.df.withColumn(name, column)
        self.found.setdefault(var, []).append((name, field))

    def constrain(self, field: Field, value: Term) -> None:
        column = F.col(self.names[field.column])
        if field.many and (isinstance(value, Var) or field.is_ref):
            name = fresh("e")
            self.df = self.df.withColumn(name, F.explode(_elements(column)))
            column = F.col(name)
        if isinstance(value, Var):
            self.df = self.df.where(column.isNotNull())
            self.add(value, native(column, field.kind), field)
        elif field.is_ref and isinstance(value, Iri):
            self.df = self.df.join(self.ids(field, value.value), column.cast("string") == F.col("__target"), "left_semi")
        elif field.is_ref:
            self.df = self.df.where(F.lit(False))
        elif field.many:
            self.df = self.df.where(F.exists(_elements(column), lambda x: matches(x, field, value)))
        else:
            self.df = self.df.where(matches(column, field, value))

    def ids(self, field: Field, iri: str) -> DataFrame:
        """The keys of the resource with this IRI among the field's targets."""
        parts = []
        for target in field.targets:
            t = self.context.catalog.type(target)
            rows = self.context.catalog.rows(self.context.spark, target, ())
            parts.append(rows.where(F.col(t.subject_column) == iri).select(F.col(t.id_column).cast("string").alias("__target")))
        return reduce(DataFrame.union, parts)

    def scan_fields(self, predicate: Var, value: Term) -> None:
        """One row for each triple of the subject, its type included; references become IRIs.

        Literals and references are exploded apart, each from its own columns,
        and only references are joined with their targets. A bound IRI is first
        looked for among the targets.
        """
        ranges: dict[tuple[str, ...], int] = {}
        plain, refs = [], []
        for field in self.type.fields:
            if isinstance(value, Literal) and field.is_ref or isinstance(value, Iri) and not field.is_ref:
                continue
            column = F.col(self.names[field.column])
            each = F.coalesce(_elements(column), F.array().cast(f"array<{SPARK_TYPES[field.kind]}>")) if field.many else F.array(column)
            number = ranges.setdefault(field.targets, len(ranges)) if field.is_ref else -1
            (refs if field.is_ref else plain).append(F.transform(each, _entry(field, value, number)))
        if isinstance(value, Var) or isinstance(value, Iri) and value.value == self.type.iri:
            own = (RDF_TYPE, "iri", self.type.iri, None, -1)
            kinds = ("string", "string", "string", "string", "int")
            plain.append(F.array(F.struct(*[F.lit(v).cast(k).alias(n) for v, k, n in zip(own, kinds, ("p", "kind", "lex", "dt", "range"), strict=True)])))
        name, lex, before = fresh("t"), fresh("lex"), self.df.columns
        parts = []
        for options in (plain, refs):
            if options:
                triples = self.df.withColumn(name, F.explode(F.filter(F.concat(*options), lambda t: t.isNotNull())))
                parts.append(self._resolved(triples, name, lex, ranges, value) if options is refs else triples.withColumn(lex, F.col(name)["lex"]))
        if parts:
            self.df = reduce(DataFrame.unionByName, [p.select(*before, name, lex) for p in parts])
        else:
            none = F.lit(None).cast("struct<p:string,kind:string,lex:string,dt:string,range:int>")
            self.df = self.df.where(F.lit(False)).withColumn(name, none).withColumn(lex, F.lit(None).cast("string"))
        self.add(predicate, F.col(name)["p"], "iri")
        if isinstance(value, Var):
            self.add(value, F.struct(F.col(name)["kind"].alias("kind"), F.col(lex).alias("lex"), F.col(name)["dt"].alias("dt")), "term")

    def _resolved(self, triples: DataFrame, name: str, lex: str, ranges: dict[tuple[str, ...], int], value: Term) -> DataFrame:
        """References with the IRIs of what they point to; one to nothing is no triple, and of several targets the first counts."""
        single, several = [], []
        for targets, number in ranges.items():
            for place, target in enumerate(targets):
                t = self.context.catalog.type(target)
                rows = self.context.catalog.rows(self.context.spark, target, ())
                keyed = [F.lit(number).alias("__range"), F.col(t.id_column).cast("string").alias("__key"), F.col(t.subject_column).alias("__iri")]
                if len(targets) == 1:
                    single.append(rows.select(*keyed))
                else:
                    several.append(rows.select(*keyed, F.lit(place).alias("__place")))
        if several:
            first = F.min(F.struct("__place", "__iri")).alias("first")
            by_key = reduce(DataFrame.union, several).groupBy("__range", "__key").agg(first)
            single.append(by_key.select("__range", "__key", F.col("first.__iri").alias("__iri")))
        found = reduce(DataFrame.union, single)
        if isinstance(value, Iri):
            found = found.where(F.col("__iri") == value.value)
        here = (F.col(name)["range"] == F.col("__range")) & (F.col(name)["lex"] == F.col("__key"))
        return triples.join(found, here).withColumnRenamed("__iri", lex)


def _same(a: tuple[str, Field | str], b: tuple[str, Field | str]) -> Column:
    """Equality of two occurrences of a variable in one row."""
    kinds = [f if isinstance(f, str) else "ref" if f.is_ref else f.kind for _, f in (a, b)]
    x, y = F.col(a[0]), F.col(b[0])
    if kinds == ["ref", "ref"] and not set(a[1].targets) & set(b[1].targets):  # type: ignore[union-attr]
        return F.lit(False)
    if kinds[0] == kinds[1]:
        return x["lex"].eqNullSafe(y["lex"]) & (x["kind"] == y["kind"]) & x["dt"].eqNullSafe(y["dt"]) if kinds[0] == "term" else x == y
    if all(k in NUMERIC for k in kinds):
        return x == y
    if "term" in kinds:
        terms = [c if k == "term" else iri_term(c) if k == "iri" else term(c, k) if k != "ref" else None for c, k in zip((x, y), kinds, strict=True)]
        if all(t is not None for t in terms):
            return (terms[0]["kind"] == terms[1]["kind"]) & (terms[0]["lex"] == terms[1]["lex"]) & terms[0]["dt"].eqNullSafe(terms[1]["dt"])
    return F.lit(False)


def scan(context: Context, pattern: Pattern) -> Solution:
    """The solutions of one pattern, as a union over its candidate types."""
    parts = [_TypeScan(context, pattern, context.catalog.type(t)) for t in pattern.types]
    bindings: dict[Var, Binding] = {}
    columns: list[list[Column]] = [[] for _ in parts]
    if isinstance(pattern.subject, Var):
        key, iri, tag = fresh("k"), fresh("s"), fresh("t")
        sets = tuple(context.typed((t,)) for t in pattern.types)
        bindings[pattern.subject] = Binding("res", key=key, iri=iri, tag=tag if len(sets) > 1 else "", sets=sets)
        for out, (number, _) in zip(columns, sets, strict=True):
            out += [F.col(_ID).alias(key), F.col(_SUBJECT).alias(iri), *([F.lit(number).alias(tag)] if len(sets) > 1 else [])]
    for i, part in enumerate(parts):
        for var, found in part.found.items():
            # Where an occurrence is a mixed term, references among the others are looked up.
            if any(f == "term" for _, f in found) and any(isinstance(f, Field) and f.is_ref for _, f in found):
                part.found[var] = found = [_looked_up(context, part, n, f) if isinstance(f, Field) and f.is_ref else (n, f) for n, f in found]
            for other in found[1:]:
                part.df = part.df.where(_same(found[0], other))
            targets = [f.targets for _, f in found if isinstance(f, Field) and f.is_ref]
            if len(targets) == len(found) > 1 and (both := tuple(t for t in targets[0] if all(t in more for more in targets))):
                part.found[var] = [(found[0][0], replace(found[0][1], targets=both))]  # type: ignore[type-var]
    for var in dict.fromkeys(v for p in parts for v in p.found):
        firsts = [p.found[var][0] for p in parts]
        forms = [f if isinstance(f, str) else "ref" if f.is_ref else f.kind for _, f in firsts]
        name = fresh("v")
        if set(forms) == {"ref"}:
            each = [context.typed(f.targets) for _, f in firsts if isinstance(f, Field)]
            sets, tag = tuple(dict.fromkeys(each)), fresh("t")
            bindings[var] = Binding("res", key=name, tag=tag if len(sets) > 1 else "", sets=sets)
            made = [F.col(n) for n, _ in firsts]
            if len(sets) > 1:
                for out, (number, _) in zip(columns, each, strict=True):
                    out.append(F.lit(number).alias(tag))
        elif set(forms) == {"iri"}:
            bindings[var] = Binding("iri", name)
            made = [F.col(n) for n, _ in firsts]
        elif not {"ref", "iri", "term"} & set(forms):
            kind = widest(forms)
            bindings[var] = Binding("val", name, kind)
            made = [F.col(n) if k == kind else lexical(F.col(n), k) if kind == "string" else F.col(n).cast(SPARK_TYPES[kind]) for (n, _), k in zip(firsts, forms, strict=True)]
        else:
            bindings[var] = Binding("term", name)
            made = []
            for part, (n, f), form in zip(parts, firsts, forms, strict=True):
                if form == "ref":
                    n, form = _looked_up(context, part, n, f)  # type: ignore[arg-type]
                made.append(F.col(n) if form == "term" else iri_term(F.col(n)) if form == "iri" else term(F.col(n), form))
        for out, column in zip(columns, made, strict=True):
            out.append(column.alias(name))
    frames = [p.df.select(*(out or [F.lit(1).alias("__one")])) for p, out in zip(parts, columns, strict=True)]
    if not frames:  # no type is registered, so no variable has a value
        bindings |= {v: Binding("iri", fresh("v")) for v in pattern.variables() if v not in bindings}
        names = [c for b in bindings.values() for c in b.columns()]
        frames = [context.spark.createDataFrame([], ", ".join(f"{n} string" for n in names) or "__one int")]
    return Solution(reduce(DataFrame.unionByName, frames), bindings)


def _looked_up(context: Context, part: _TypeScan, name: str, field: Field) -> tuple[str, str]:
    """A reference's column as IRIs."""
    var = Var("__lookup")
    found = with_iri(context, Solution(part.df, {var: Binding("res", key=name, sets=(context.typed(field.targets),))}), var)
    part.df = found.df
    return found.bindings[var].iri, "iri"

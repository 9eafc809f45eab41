"""Terms as Spark columns.

A variable whose type is known is a native column. A mixed one is a struct of
``kind`` ("iri" or "literal"), ``lex`` and ``dt`` (the datatype's IRI).
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from sparkgraph.catalog import Field
from sparkgraph.terms import XSD, Iri, Literal

SPARK_TYPES = {
    "string": "string", "integer": "bigint", "boolean": "boolean", "float": "float", "double": "double", "decimal": "decimal(38,18)",
    "date": "date", "datetime": "timestamp", "ref": "string",
}
DATATYPES = {kind: XSD + ("dateTime" if kind == "datetime" else kind) for kind in SPARK_TYPES if kind != "ref"}
NUMERIC = ("integer", "decimal", "float", "double")

#: Datatypes in a query that are read as a kind of field; all others are strings.
_KINDS = {iri: kind for kind, iri in DATATYPES.items()}
_KINDS |= {XSD + n: "integer" for n in ("int", "long", "short", "byte", "nonNegativeInteger", "positiveInteger", "unsignedInt", "unsignedLong")}

TERM = "struct<kind:string,lex:string,dt:string>"


def literal_kind(literal: Literal) -> str:
    """The kind of field that a literal is like; an ill-formed one is a string."""
    kind = _KINDS.get(literal.datatype, "string")
    try:
        if kind == "integer":
            int(literal.lex)
        elif kind in ("float", "double", "decimal"):
            float(literal.lex)
        elif kind == "boolean" and literal.lex not in ("true", "false", "1", "0"):
            return "string"
    except ValueError:
        return "string"
    return kind


def native(column: Column, kind: str) -> Column:
    """A field's column in the type that its kind has in results."""
    return column.cast(SPARK_TYPES[kind])


def lexical(column: Column, kind: str) -> Column:
    if kind == "datetime":
        return F.date_format(column, "yyyy-MM-dd'T'HH:mm:ss.SSSSSS'Z'")
    return column.cast("string")


def term(column: Column, kind: str) -> Column:
    """A native column as a mixed term; null stays null."""
    made = F.struct(F.lit("literal").alias("kind"), lexical(column, kind).alias("lex"), F.lit(DATATYPES[kind]).alias("dt"))
    return F.when(column.isNotNull(), made)


def iri_term(column: Column) -> Column:
    made = F.struct(F.lit("iri").alias("kind"), column.alias("lex"), F.lit(None).cast("string").alias("dt"))
    return F.when(column.isNotNull(), made)


def constant(value: Literal, kind: str) -> Column:
    """A literal of the query in the type of a column; null if it has no such form, which then matches nothing."""
    text = F.lit(value.lex)
    if kind in ("integer", "boolean") and literal_kind(value) != kind:
        # "30" may stand for 30, but 2.5 is no integer and "t" no boolean.
        whole = text.rlike(r"^\s*[+-]?\d+\s*$") if kind == "integer" else text.isin("true", "false")
        return F.when(whole, text.try_cast(SPARK_TYPES[kind]))
    return text.try_cast(SPARK_TYPES[kind])


def matches(column: Column, field: Field, value: Iri | Literal) -> Column:
    """Whether an element of a field that is no reference is the constant."""
    if isinstance(value, Iri):
        return column == F.lit(value.value) if field.kind == "string" else F.lit(False)
    return native(column, field.kind) == constant(value, field.kind)


def widest(kinds: list[str]) -> str:
    """The kind in which values of all the kinds can stand."""
    if len(set(kinds)) == 1:
        return kinds[0]
    if all(k in NUMERIC for k in kinds):
        return "decimal" if set(kinds) <= {"integer", "decimal"} else "double"
    return "string"


def order_keys(column: Column) -> list[Column]:
    """Sort keys of a mixed term: IRIs first, then literals by datatype and value."""
    number = column["lex"].try_cast("double")
    numeric = column["dt"].isin(*(DATATYPES[k] for k in NUMERIC))
    return [column["kind"] != "iri", column["dt"], F.when(numeric, number), column["lex"]]

"""RDF terms as they stand in a query."""

from __future__ import annotations

from dataclasses import dataclass

XSD = "http://www.w3.org/2001/XMLSchema#"
RDF_TYPE = "http://www.w3.org/1999/02/22-rdf-syntax-ns#type"


@dataclass(frozen=True)
class Iri:
    value: str

    def __str__(self) -> str:
        return f"<{self.value}>"


@dataclass(frozen=True)
class Literal:
    """A lexical form with its datatype (a full IRI); a language tag is kept but not compared."""

    lex: str
    datatype: str = XSD + "string"
    lang: str | None = None

    def __str__(self) -> str:
        return f'"{self.lex}"' if self.datatype == XSD + "string" else self.lex


@dataclass(frozen=True)
class Var:
    """A variable. Blank nodes are variables that are never shown."""

    name: str
    anonymous: bool = False

    def __str__(self) -> str:
        return f"?{self.name}"


Term = Iri | Literal | Var

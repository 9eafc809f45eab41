"""What can be wrong with a query. All are raised before any Spark job starts."""

from __future__ import annotations

from collections.abc import Sequence


class GraphError(Exception):
    """Base of all errors of this package."""


class ParseError(GraphError):
    """The text is no query, or uses a part of SPARQL that is not supported."""


class UnknownPredicate(GraphError):
    def __init__(self, predicate: str, type_iri: str | None = None):
        self.predicate, self.type_iri = predicate, type_iri
        super().__init__(f"unknown predicate <{predicate}>" + (f" for type <{type_iri}>" if type_iri else ""))


class UnknownType(GraphError):
    def __init__(self, type_iri: str):
        self.type_iri = type_iri
        super().__init__(f"unknown type <{type_iri}>")


class AmbiguousType(GraphError):
    """No type fits all that is said of a subject (``candidates`` is empty)."""

    def __init__(self, subject: str, candidates: Sequence[str] = ()):
        self.subject, self.candidates = subject, list(candidates)
        super().__init__(f"no type fits {subject}" if not candidates else f"the type of {subject} is one of {', '.join(candidates)}")


class UnboundVariables(GraphError):
    def __init__(self, variables: Sequence[str]):
        self.variables = list(variables)
        super().__init__("variables that no pattern binds: " + ", ".join(f"?{v}" for v in variables))


class DisconnectedPatterns(GraphError):
    def __init__(self, groups: Sequence[Sequence[str]]):
        self.groups = [list(g) for g in groups]
        super().__init__("patterns that share no variable: " + " / ".join(", ".join(g) for g in groups))

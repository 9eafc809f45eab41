"""What the parser makes of a query."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

from sparkgraph.terms import Iri, Literal, Term, Var


@dataclass(frozen=True)
class Triple:
    subject: Term
    predicate: Term
    object: Term

    def variables(self) -> Iterator[Var]:
        yield from (t for t in (self.subject, self.predicate, self.object) if isinstance(t, Var))


@dataclass
class Values:
    """Inline rows; None is UNDEF."""

    variables: list[Var]
    rows: list[list[Iri | Literal | None]]


@dataclass
class Group:
    """A basic graph pattern, at most one VALUES block, and groups that must not match."""

    triples: list[Triple] = field(default_factory=list)
    values: Values | None = None
    absent: list[Group] = field(default_factory=list)

    def variables(self) -> list[Var]:
        """Those that patterns and VALUES bind, in order of first appearance by subject."""
        seen: dict[Var, None] = {}
        for subject in dict.fromkeys(t.subject for t in self.triples):
            if isinstance(subject, Var):
                seen[subject] = None
            for t in self.triples:
                if t.subject == subject:
                    seen.update(dict.fromkeys(v for v in (t.predicate, t.object) if isinstance(v, Var)))
        if self.values:
            seen.update(dict.fromkeys(self.values.variables))
        return list(seen)


@dataclass
class Query:
    """``select`` is None for ``*``; ``count`` is the alias of COUNT(*), if that is asked for."""

    where: Group
    select: list[Var] | None = None
    count: str | None = None
    distinct: bool = False
    order: list[tuple[Var, bool]] = field(default_factory=list)  # (variable, descending)
    limit: int | None = None
    offset: int = 0

    def columns(self) -> list[Var]:
        """The variables of the result, in order."""
        if self.select is not None:
            return self.select
        return [v for v in self.where.variables() if not v.anonymous]

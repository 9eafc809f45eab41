"""Random basic graph patterns against an evaluator that knows triples only."""

from __future__ import annotations

import itertools

from fixtures import EX, catalog
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st

from sparkgraph.errors import GraphError
from sparkgraph.session import GraphSession
from sparkgraph.sources import from_records
from sparkgraph.sparql.parser import parse
from sparkgraph.terms import RDF_TYPE, Iri, Var

TYPES = {
    "ex:Team": {"fields": {"name": ["ex:name", "string"], "size": ["ex:size", "integer"], "lead": ["ex:lead", "ex:Person"]}, "id": "id"},
    "ex:Person": {"fields": {"name": ["ex:name", "string"], "nick": ["ex:nick", "string[]"], "team": ["ex:team", "ex:Team[]"], "likes": ["ex:likes", "ex:Person|ex:Team"]}, "id": "id"},
    "ex:Game": {"fields": {"nick": ["ex:nick", "string"], "size": ["ex:size", "integer"], "winner": ["ex:winner", "ex:Team"]}, "id": "id"},
}
ROWS = {
    "Team": [
        {"_subject": EX + "t1", "id": "t/1", "name": "red", "size": 2, "lead": "p/1"},
        {"_subject": EX + "t2", "id": "t/2", "name": "blue", "size": None, "lead": "p/2"},
        {"_subject": EX + "t3", "id": "t/3", "name": "ann", "size": 2, "lead": None},
    ],
    "Person": [
        {"_subject": EX + "p1", "id": "p/1", "name": "ann", "nick": ["a", "ann", "a"], "team": ["t/1", "t/2"], "likes": "t/1"},
        {"_subject": EX + "p2", "id": "p/2", "name": "bob", "nick": [], "team": ["t/1"], "likes": "p/1"},
        {"_subject": EX + "p3", "id": "p/3", "name": None, "nick": None, "team": None, "likes": "p/3"},
    ],
    "Game": [
        {"_subject": EX + "g1", "id": "g/1", "nick": "a", "size": 1, "winner": "t/1"},
        {"_subject": EX + "g2", "id": "g/2", "nick": "red", "size": 2, "winner": None},
    ],
}
CATALOG = catalog(TYPES).bind(from_records(ROWS))
IRIS = {r["id"]: r["_subject"] for rows in ROWS.values() for r in rows}


def triples():
    for iri, type_ in CATALOG.types.items():
        for row in ROWS[type_.table]:
            s = ("iri", row["_subject"])
            yield s, RDF_TYPE, ("iri", iri)
            for f in type_.fields:
                values = row[f.column] if f.many else [row[f.column]]
                for v in dict.fromkeys(v for v in values or () if v is not None):
                    yield s, f.predicate, ("iri", IRIS[v]) if f.is_ref else ("lit", str(v), f.kind)


TRIPLES = list(triples())


def evaluate(group, start, triples):
    """All solutions, as a bag, by trying every triple for every pattern."""
    solutions = [start]
    for t in group.triples:
        grown = []
        for solution, (s, p, o) in itertools.product(solutions, triples):
            new = dict(solution)
            for term, value in ((t.subject, s), (t.predicate, ("iri", p)), (t.object, o)):
                if isinstance(term, Var):
                    if new.setdefault(term, value) != value:
                        break
                elif isinstance(term, Iri):
                    if value != ("iri", term.value):
                        break
                elif value[0] != "lit" or value[1] != term.lex:
                    break
            else:
                grown.append(new)
        solutions = grown
    return [s for s in solutions if not any(evaluate(inner, s, triples) for inner in group.absent)]


subjects = st.sampled_from(["?a", "?b", "?c", f"<{EX}p1>"])
objects = st.sampled_from(["?a", "?b", "?x", "?y", "[]", '"ann"', '"a"', "2", f"<{EX}t1>", f"<{EX}p1>"])
predicates = st.sampled_from(["ex:name", "ex:size", "ex:lead", "ex:nick", "ex:team", "ex:likes", "ex:winner", "a", "?p"])
pattern = st.tuples(subjects, predicates, objects).map(lambda t: " ".join(t) if t[1] != "a" else f"{t[0]} a {t[2] if t[2].startswith('?') else 'ex:Person'}")
groups = st.lists(pattern, min_size=1, max_size=3).map(" . ".join)


@settings(max_examples=60, deadline=None, suppress_health_check=list(HealthCheck), derandomize=True)
@given(body=groups, absent=st.none() | st.lists(pattern, min_size=1, max_size=2).map(" . ".join))
def test_same_solutions(spark, body, absent):
    text = f"PREFIX ex: <{EX}>\nSELECT * {{ {body} {f'FILTER NOT EXISTS {{ {absent} }}' if absent else ''} }}"
    same_solutions(spark, CATALOG, TRIPLES, text)


#: The same graph with ids that all types have; a reference to several types names one of only one of them.
SHARED_IDS = {"t/1": "1", "t/2": "2", "t/3": "4", "p/1": "1", "p/2": "2", "p/3": "3", "g/1": "1", "g/2": "2"}
SHARED_ROWS = {
    name: [
        {c: SHARED_IDS[v] if isinstance(v, str) and v in SHARED_IDS else [SHARED_IDS[x] for x in v] if c == "team" and v else v for c, v in row.items()}
        for row in [{**row, "likes": {"p/1": "t/3", "p/2": "p/3", "p/3": "p/3"}[row["id"]]} if "likes" in row else row for row in rows]
    ]
    for name, rows in ROWS.items()
}
SHARED_CATALOG = catalog(TYPES).bind(from_records(SHARED_ROWS))


def shared_triples():
    by_type = {(name, row["id"]): row["_subject"] for name, rows in SHARED_ROWS.items() for row in rows}
    for iri, type_ in SHARED_CATALOG.types.items():
        for row in SHARED_ROWS[type_.table]:
            s = ("iri", row["_subject"])
            yield s, RDF_TYPE, ("iri", iri)
            for f in type_.fields:
                values = row[f.column] if f.many else [row[f.column]]
                for v in dict.fromkeys(v for v in values or () if v is not None):
                    found = [by_type[t.removeprefix(EX), v] for t in f.targets if (t.removeprefix(EX), v) in by_type]
                    yield s, f.predicate, ("iri", found[0]) if f.is_ref else ("lit", str(v), f.kind)


SHARED_TRIPLES = list(shared_triples())


@settings(max_examples=60, deadline=None, suppress_health_check=list(HealthCheck), derandomize=True)
@given(body=groups, absent=st.none() | st.lists(pattern, min_size=1, max_size=2).map(" . ".join))
def test_same_solutions_with_shared_ids(spark, body, absent):
    text = f"PREFIX ex: <{EX}>\nSELECT * {{ {body} {f'FILTER NOT EXISTS {{ {absent} }}' if absent else ''} }}"
    same_solutions(spark, SHARED_CATALOG, SHARED_TRIPLES, text)


def same_solutions(spark, cat, triples, text):
    query = parse(text)
    try:
        df = GraphSession(spark, cat).sparql(text)
    except GraphError:
        return  # types or connection forbid it
    if not df.columns:
        assert df.count() == len(evaluate(query.where, {}, triples)), text
        return
    want = sorted(tuple(s[v][1] for v in query.columns()) for s in evaluate(query.where, {}, triples))
    got = sorted(tuple(v["lex"] if hasattr(v, "asDict") else str(v) for v in row) for row in df.collect())
    assert got == want, text

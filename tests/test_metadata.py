"""Queries of a measurement-data portal: stations, specifications, objects with versions, submissions, collections.

Ids are short and differ from IRIs; some predicates are shared, some with different kinds of values.
"""

from __future__ import annotations

import datetime as dt

import pytest

from sparkgraph.catalog import GraphCatalog
from sparkgraph.errors import DisconnectedPatterns
from sparkgraph.plans.resolve import resolve
from sparkgraph.session import GraphSession
from sparkgraph.sources import from_records, inverse_references
from sparkgraph.sparql.parser import parse

M = "http://meta.example.org/"
P = f"PREFIX m: <{M}>\n"
SPEC = {
    "prefixes": {"m": M},
    "types": {
        "m:Station": {"table": "stations", "fields": {"name": ["m:hasName", "string"], "country": ["m:country", "string"], "lat": ["m:latitude", "double"], "note": ["m:comment", "string[]"]}},
        "m:Project": {"table": "projects", "fields": {"hidden": ["m:hidden", "boolean"], "note": ["m:comment", "string"]}},
        "m:Spec": {"table": "specs", "fields": {"level": ["m:level", "integer"], "project": ["m:project", "m:Project"]}},
        "m:Object": {
            "table": "objects",
            "fields": {
                "name": ["m:hasName", "string"], "size": ["m:size", "integer"], "spec": ["m:spec", "m:Spec"], "submission": ["m:submittedBy", "m:Submission"],
                "acquisition": ["m:acquiredBy", "m:Acquisition"], "next": ["m:isNextVersionOf", "m:Object[]"], "deprecated": ["m:deprecatedBy", "m:Object"],
            },
        },
        "m:Submission": {"table": "submissions", "fields": {"start": ["m:startedAt", "datetime"], "end": ["m:endedAt", "datetime"]}},
        "m:Acquisition": {"table": "acquisitions", "fields": {"start": ["m:startedAt", "datetime"], "end": ["m:endedAt", "datetime"]}},
        "m:Collection": {"table": "collections", "fields": {"parts": ["m:hasPart", "string[]"], "next": ["m:isNextVersionOf", "m:Collection[]"]}},
        "m:PlainCollection": {"table": "plain", "fields": {"parts": ["m:hasPart", "string[]"], "next": ["m:isNextVersionOf", "m:PlainCollection"]}},
    },
    "absence": [["m:isNextVersionOf", "m:Object", ["deprecated"]]],
}


def rows(*records):
    return [{"rdf_subject": M + r["id"], **r} for r in records]


def at(day):
    return dt.datetime(2024, 1, day)


ROWS = {
    "stations": rows({"id": "s1", "name": "Zeppelin", "country": "NO", "lat": 78.9, "note": ["a", "b"]}, {"id": "s2", "name": "Htm", "country": "SE", "lat": 56.1}, {"id": "s3", "name": "Nor", "country": "SE"}),
    "projects": rows({"id": "p1", "hidden": True, "note": "a"}, {"id": "p2", "hidden": False}),
    "specs": rows({"id": "e1", "level": 1, "project": "p1"}, {"id": "e2", "level": 2, "project": "p2"}, {"id": "e3", "project": "p2"}, {"id": "e4", "level": 0}),
    "objects": rows(
        {"id": "o1", "name": "x1", "size": 10, "spec": "e2", "submission": "b1", "acquisition": "q1"},
        {"id": "o2", "name": "x2", "size": 20, "spec": "e2", "submission": "b2", "acquisition": "q2", "next": ["o1"]},
        {"id": "o3", "name": "x3", "size": 30, "spec": "e1", "submission": "b1", "acquisition": "q1"},
        {"id": "o4", "name": "x4", "spec": "e2", "submission": "b1", "acquisition": "q1"},
        {"id": "o5", "name": "x5", "size": 50, "spec": "e4", "submission": "b3", "acquisition": "q3"},
        {"id": "o6", "name": "x6", "size": 60, "spec": "e3", "submission": "b1", "acquisition": "q1"},
    ),
    "submissions": rows({"id": "b1", "start": at(1), "end": at(2)}, {"id": "b2", "start": at(3), "end": at(4)}, {"id": "b3", "end": at(9)}),
    "acquisitions": rows({"id": "q1", "start": at(1), "end": at(1)}, {"id": "q2", "start": at(2), "end": at(2)}, {"id": "q3", "start": at(5), "end": at(6)}),
    "collections": rows({"id": "c1", "parts": [M + "o1", M + "o2"]}, {"id": "c2", "parts": [], "next": ["c1"]}),
    "plain": rows({"id": "k1", "parts": [M + "c1"]}, {"id": "k2", "next": "k1"}),
}
OBJECTS = """
  ?spec m:level [] .
  FILTER NOT EXISTS { ?spec m:project ?pro . ?pro m:hidden true }
  ?obj m:spec ?spec ; m:size [] ; m:hasName ?name ; m:submittedBy ?sub ; m:acquiredBy ?acq .
"""


@pytest.fixture(scope="module")
def session(spark):
    given = from_records(ROWS)

    def source(spark, type_, columns=None):
        made = given(spark, type_, columns)
        return inverse_references(made, "id", "next", "deprecated") if type_.table == "objects" else made

    return GraphSession(spark, GraphCatalog.from_spec(SPEC).identified_by("rdf_subject", "id").bind(source))


def ask(session, text):
    return [tuple(v.removeprefix(M) if isinstance(v, str) else v for v in row) for row in session.sparql(P + text).collect()]


def test_sorted_scan(session):
    got = ask(session, "SELECT ?n ?c ?x { ?s a m:Station ; m:hasName ?n ; m:country ?c ; m:latitude ?x } ORDER BY ?c ?n LIMIT 20")
    assert got == [("Zeppelin", "NO", 78.9), ("Htm", "SE", 56.1)]


def test_objects(session):
    text = f"SELECT * {{ {OBJECTS} ?acq m:startedAt ?from ; m:endedAt ?to . ?sub m:endedAt ?when FILTER NOT EXISTS {{ [] m:isNextVersionOf ?obj }} }} ORDER BY DESC(?when) OFFSET 0 LIMIT 20"
    plan = session.plan(P + text)
    assert {str(p.subject): [t.removeprefix(M) for t in p.types] for p in plan.patterns} == {"?spec": ["Spec"], "?obj": ["Object"], "?acq": ["Acquisition"], "?sub": ["Submission"]}
    assert len(plan.absent) == 1 and plan.subjects()[next(v for v in plan.variables() if v.name == "obj")].null_columns == {M + "Object": {"deprecated"}}
    df = session.sparql(P + text)
    assert df.columns == ["spec", "obj", "name", "sub", "acq", "from", "to", "when"]
    assert [(r.obj.removeprefix(M), r.sub.removeprefix(M), r.when) for r in df.collect()] == [("o5", "b3", at(9)), ("o2", "b2", at(4))]


def test_count(session):
    assert ask(session, f"SELECT (COUNT(*) AS ?n) {{ {OBJECTS} }}") == [(3,)]


def test_ambiguous_predicate(session):
    assert sorted(ask(session, "SELECT ?c ?p { ?c m:hasPart ?p }")) == [("c1", "o1"), ("c1", "o2"), ("k1", "c1")]
    assert len(ask(session, "SELECT ?c { ?c m:hasPart ?p } LIMIT 2")) == 2


def test_kinds_that_differ(session):
    assert sorted(ask(session, "SELECT ?s ?x { ?s m:comment ?x }")) == [("p1", "a"), ("s1", "a"), ("s1", "b")]
    assert sorted(ask(session, "SELECT ?a ?b { ?a m:isNextVersionOf ?b }")) == [("c2", "c1"), ("k2", "k1"), ("o2", "o1")]


def test_disconnected(session):
    with pytest.raises(DisconnectedPatterns):
        session.plan(P + "SELECT ?o { ?o a m:Object . ?spec m:level ?l FILTER NOT EXISTS { [] m:isNextVersionOf ?o } }")


def test_bound_resources(session):
    assert ask(session, f"SELECT ?n {{ ?o m:spec <{M}e1> ; m:hasName ?n }}") == [("x3",)]
    assert ask(session, f"SELECT ?n {{ ?o m:isNextVersionOf <{M}o1> ; m:hasName ?n }}") == [("x2",)]
    assert ask(session, f"SELECT ?l {{ <{M}o1> m:spec/m:level ?l }}") == [(2,)]
    assert resolve(parse(P + f"SELECT ?x {{ <{M}s1> m:comment ?x }}"), session.catalog).patterns[0].types == [M + "Station", M + "Project"]
    assert sorted(ask(session, f"SELECT ?x {{ <{M}s1> m:comment ?x }}")) == [("a",), ("b",)]

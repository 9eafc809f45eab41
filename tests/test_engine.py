"""Queries over small tables with nulls, arrays, dangling keys and odd values."""

from __future__ import annotations

import datetime as dt
from decimal import Decimal

import pytest
from fixtures import EX, INSTRUMENT, ITEM_ABSENCE, ITEMS, PERSON, PETS, P, catalog

from sparkgraph.session import GraphSession
from sparkgraph.sources import from_records, inverse_references, tsv_lines, write_people

ROWS = {
    "Person": [
        {"_subject": EX + "person/alice", "name": "Alice", "age": 30},
        {"_subject": EX + "person/bob", "name": "Bob", "age": 25},
        {"_subject": EX + "person/o'neil", "name": "O'Neil", "age": None},
    ],
    "Instrument": [
        {"_subject": EX + "i1", "model": "m1", "tags": ["red", "blue", "red", None]},
        {"_subject": EX + "i2", "model": "m2", "tags": []},
        {"_subject": EX + "i3", "model": "m3", "tags": None},
        {"_subject": EX + "i4", "model": "red", "tags": ["red"]},
    ],
    "Owner": [
        {"_subject": EX + "o1", "id": "1", "name": "Ann", "pet": "c1"},
        {"_subject": EX + "o2", "id": "2", "name": "Ben", "pet": "d1"},
        {"_subject": EX + "o3", "id": "3", "name": "Cid", "pet": "gone"},
        {"_subject": EX + "o4", "id": "4", "name": "Dan", "pet": None},
    ],
    "Cat": [{"_subject": EX + "cat1", "id": "c1", "call": "Tom"}],
    "Dog": [{"_subject": EX + "dog1", "id": "d1", "call": "Rex", "age": 3}, {"_subject": EX + "dog2", "id": "d2", "call": "Tom", "age": None}],
    "Item": [
        {"_subject": EX + "a", "link": "x", "deprecated_by": EX + "b"},
        {"_subject": EX + "b", "link": "y", "deprecated_by": None},
    ],
    "Versioner": [{"_subject": EX + "v", "is_next": EX + "a"}],
}
CATALOG = catalog({**PERSON, **INSTRUMENT, **PETS, **ITEMS}, ITEM_ABSENCE).bind(from_records(ROWS))


@pytest.fixture(scope="module")
def ask(spark):
    session = GraphSession(spark, CATALOG)

    def run(text):
        return [tuple(v.removeprefix(EX) if isinstance(v, str) else v for v in row) for row in session.sparql(P + text).collect()]

    return run


def test_bound_variables_are_not_null(ask):
    assert sorted(ask("SELECT ?n ?a { ?s a ex:Person ; ex:name ?n ; ex:age ?a }")) == [("Alice", 30), ("Bob", 25)]
    assert sorted(ask("SELECT ?n { ?s a ex:Person ; ex:name ?n }")) == [("Alice",), ("Bob",), ("O'Neil",)]
    assert ask("SELECT ?n { ?s ex:age [] ; ex:name ?n ; ex:age 25 }") == [("Bob",)]


def test_subject_with_quote(ask):
    assert ask("SELECT ?n { <http://example.org/person/o'neil> a ex:Person ; ex:name ?n }") == [("O'Neil",)]


def test_literals_fit_the_column(ask):
    assert ask('SELECT ?n { ?s ex:age "30" ; ex:name ?n }') == [("Alice",)]
    assert ask('SELECT ?n { ?s ex:age "abc" ; ex:name ?n }') == []
    assert ask("SELECT ?n { ?s ex:age 30.5 ; ex:name ?n }") == []


def test_order_unbound_first_and_slices(ask):
    assert ask("SELECT ?o ?p { ?o a ex:Owner ; ex:pet ?p } ORDER BY ?p ?o") == [("o3", None), ("o1", "cat1"), ("o2", "dog1")]
    assert ask("SELECT ?n { ?s a ex:Person ; ex:name ?n } ORDER BY DESC(?n) OFFSET 1 LIMIT 1") == [("Bob",)]


def test_arrays(ask):
    assert sorted(ask("SELECT ?m ?t { ?i ex:model ?m ; ex:tags ?t }")) == [("m1", "blue"), ("m1", "red"), ("red", "red")]
    assert sorted(ask('SELECT ?m { ?i ex:model ?m ; ex:tags "red" }')) == [("m1",), ("red",)]
    assert ask("SELECT ?i { ?i ex:model ?x ; ex:tags ?x }") == [("i4",)]
    assert len(ask("SELECT ?a ?b { ?i ex:model \"m1\" ; ex:tags ?a , ?b }")) == 4
    assert sorted(ask("SELECT ?m { ?i ex:model ?m FILTER NOT EXISTS { ?i ex:tags ?t } }")) == [("m2",), ("m3",)]


def test_references(ask):
    assert sorted(ask("SELECT ?n ?c { ?o a ex:Owner ; ex:name ?n ; ex:pet ?p . ?p ex:call ?c }")) == [("Ann", "Tom"), ("Ben", "Rex")]
    assert ask("SELECT ?n { ?o ex:pet <http://example.org/dog1> ; ex:name ?n }") == [("Ben",)]
    assert ask('SELECT ?n { ?o ex:name ?n ; ex:pet "c1" }') == []
    assert sorted(ask("SELECT ?p { ?p ex:call ?c . ?o ex:pet ?p }")) == [("cat1",), ("dog1",)]


def test_value_join(ask):
    assert ask("SELECT ?a ?b { ?a a ex:Cat ; ex:call ?x . ?b a ex:Dog ; ex:call ?x }") == [("cat1", "dog2")]


def test_union_over_types(ask):
    found = ask("SELECT ?s ?t ?a { ?s a ?t ; ex:age ?a }")
    assert sorted(found) == [("dog1", "Dog", 3), ("person/alice", "Person", 30), ("person/bob", "Person", 25)]
    assert ask("SELECT (COUNT(*) AS ?n) { ?s ex:name ?x }") == [(7,)]
    assert ask("SELECT (COUNT(*) AS ?n) { ?s ex:name ?x } OFFSET 1") == []


def test_distinct(ask):
    assert sorted(ask("SELECT DISTINCT ?c { ?p ex:call ?c }")) == [("Rex",), ("Tom",)]
    assert ask("SELECT DISTINCT ?c { ?p ex:call ?c } ORDER BY DESC(?p)") == [("Tom",), ("Rex",)]
    assert ask("SELECT DISTINCT ?c { ?p ex:call ?c } ORDER BY ?c LIMIT 1") == [("Rex",)]


def test_not_exists(ask):
    assert sorted(ask("SELECT ?p { ?p ex:call ?c FILTER NOT EXISTS { ?o ex:pet ?p } }")) == [("dog2",)]
    assert sorted(ask("SELECT ?s { ?s a ex:Person FILTER NOT EXISTS { ?s ex:age ?a } }")) == [("person/o'neil",)]
    assert sorted(ask("SELECT ?i { ?i ex:link ?l FILTER NOT EXISTS { [] ex:isNextVersionOf ?i } }")) == [("b",)]
    assert ask("SELECT ?i { ?i ex:link ?l FILTER NOT EXISTS { ?x a ex:Cat } }") == []
    assert sorted(ask('SELECT ?n { ?s a ex:Owner ; ex:name ?n ; ex:pet ?p FILTER NOT EXISTS { ?p ex:call "Tom" } FILTER NOT EXISTS { ?p ex:age 3 } }')) == [("Cid",)]
    assert sorted(ask("SELECT ?d { ?d a ex:Dog FILTER NOT EXISTS { ?d ex:call ?c FILTER NOT EXISTS { ?d ex:age ?a } } }")) == [("dog1",)]
    assert ask('SELECT ?x { VALUES ?x { "Tom" "Zed" UNDEF } FILTER NOT EXISTS { ?p ex:call ?x } }') == [("Zed",)]


def test_values(ask):
    assert sorted(ask('SELECT ?n ?k { ?s a ex:Person ; ex:name ?n VALUES (?n ?k) { ("Bob" 1) ("Bob" 2) (UNDEF 3) } }')) == [
        ("Alice", 3), ("Bob", 1), ("Bob", 2), ("Bob", 3), ("O'Neil", 3),
    ]
    assert ask("SELECT ?n { ?o ex:name ?n ; ex:pet ?p VALUES ?p { <http://example.org/cat1> } }") == [("Ann",)]
    assert ask("SELECT ?n { ?s ex:name ?n VALUES ?n { } }") == []
    assert sorted(ask('SELECT ?n { ?s ex:age ?a ; ex:name ?n VALUES ?a { "25" 30 } }')) == [("Alice",)]
    assert sorted(ask("SELECT ?x { VALUES ?x { 1 2 } }")) == [(1,), (2,)]
    mixed = ask('SELECT ?x { VALUES ?x { 1 <http://example.org/a> "s" } } ORDER BY ?x')
    assert [row[0]["lex"] for row in mixed] == ["http://example.org/a", "1", "s"]


def test_field_scan(ask):
    got = sorted((p, o["lex"].removeprefix(EX)) for p, o in ask("SELECT ?p ?o { <http://example.org/i1> ?p ?o }"))
    assert got == [("http://www.w3.org/1999/02/22-rdf-syntax-ns#type", "Instrument"), ("model", "m1"), ("tags", "blue"), ("tags", "red")]
    assert sorted(ask('SELECT ?s ?p { ?s ?p "Tom" }')) == [("cat1", "call"), ("dog2", "call")]
    assert ask("SELECT ?s ?p { ?s ?p <http://example.org/dog1> }") == [("o2", "pet")]
    assert ask("SELECT (COUNT(*) AS ?n) { ?s ?p 30 }") == [(1,)]
    assert ask("SELECT (COUNT(*) AS ?n) { ?s a ex:Dog ; ?p ?o FILTER NOT EXISTS { ?s ex:age ?a } }") == [(2,)]
    assert ask("SELECT ?n { ?o a ex:Owner ; ex:name ?n ; ?p ?x . ?x a ex:Cat }") == [("Ann",)]


def test_fully_bound(ask):
    assert len(ask("SELECT ?s { ?s a ex:Cat . <http://example.org/i1> ex:model \"m1\" }")) == 1
    assert len(ask("SELECT ?s { ?s a ex:Cat . <http://example.org/i1> ex:model \"zz\" }")) == 0


def test_names_that_differ_in_case(spark):
    df = GraphSession(spark, CATALOG).sparql(P + "SELECT ?x ?X { ?x a ex:Person ; ex:name ?X } ORDER BY ?X LIMIT 1")
    assert df.columns == ["x", "X"] and df.collect()[0][1] == "Alice"


def test_every_kind_of_value(spark):
    kinds = {
        "ex:Thing": {
            "fields": {
                "b": ["ex:b", "boolean"], "f": ["ex:f", "float"], "d": ["ex:d", "double"],
                "m": ["ex:m", "decimal"], "day": ["ex:day", "date"], "at": ["ex:at", "datetime"],
            }
        }
    }
    rows = [{"_subject": EX + "t", "b": True, "f": 1.5, "d": float("nan"), "m": Decimal("2.50"), "day": dt.date(2024, 1, 2), "at": dt.datetime(2024, 1, 2, 3, 4, 5)}]
    session = GraphSession(spark, catalog(kinds).bind(from_records({"Thing": rows})))
    got = session.sparql(P + 'SELECT * { ?t ex:b true ; ex:f 1.5 ; ex:d ?d ; ex:m 2.5 ; ex:day "2024-01-02" ; ex:at ?at }').collect()
    assert len(got) == 1 and got[0].at == dt.datetime(2024, 1, 2, 3, 4, 5)
    assert session.sparql(P + "SELECT ?t { ?t ex:b false }").collect() == []
    text = {r.p.removeprefix(EX): r.o.lex for r in session.sparql(P + "SELECT ?p ?o { ?t ?p ?o }").collect()}
    assert text["b"] == "true" and text["day"] == "2024-01-02" and text["at"].startswith("2024-01-02T03:04:05")


def test_empty_catalogue_and_tables(spark):
    assert GraphSession(spark, catalog({})).sparql("SELECT ?s ?t { ?s a ?t }").collect() == []
    empty = GraphSession(spark, catalog(PERSON).bind(from_records({})))
    assert empty.sparql(P + "SELECT ?s { ?s ex:name ?n }").collect() == []
    assert empty.sparql(P + "SELECT (COUNT(*) AS ?n) { ?s ex:name ?n }").collect()[0].n == 0


def test_plans(spark):
    session = GraphSession(spark, CATALOG)
    text = session.explain(P + "SELECT ?n { ?o a ex:Owner ; ex:name ?n ; ex:pet ?p . ?p ex:call ?c FILTER NOT EXISTS { ?p ex:age ?a } }")
    assert "scan ?o" in text and "LeftAnti" in text
    assert "CartesianProduct" not in text and "NestedLoop" not in text


def test_sinks_and_sources(spark, tmp_path):
    session = GraphSession(spark, CATALOG)
    df = session.sparql(P + "SELECT ?s ?a ?p { ?s ex:name ?n ; ex:pet ?p VALUES ?a { 2.5 } } ORDER BY ?s LIMIT 3")
    lines = list(tsv_lines(df, frozenset({"s", "p"})))
    assert lines[0] == "?s\t?a\t?p" and lines[1].startswith(f"<{EX}o1>\t2.5") and lines[3].endswith("UNBOUND")
    write_people(spark, str(tmp_path / "people"), 10)
    assert spark.read.parquet(str(tmp_path / "people")).count() == 10
    rows = spark.createDataFrame([("a", None), ("b", ["a"]), ("c", ["a", "b"])], "id string, before array<string>")
    assert {r.id: r.after for r in inverse_references(rows, "id", "before", "after").collect()} == {"a": "b", "b": "c", "c": None}


def test_streaming(spark, tmp_path):
    from sparkgraph.sources.providers import from_records as records
    from sparkgraph.streaming import from_parquet_stream, start

    cat = catalog(PERSON)
    person = cat.type(EX + "Person")
    records(ROWS)(spark, person).write.parquet(str(tmp_path / "in/Person"))
    session = GraphSession(spark, cat.bind(from_parquet_stream(str(tmp_path / "in"), {"Person"})))
    df = session.sparql(P + "SELECT ?n ?a { ?s ex:name ?n ; ex:age ?a }")
    assert df.isStreaming
    start(df, str(tmp_path / "out"), str(tmp_path / "check")).awaitTermination()
    assert spark.read.parquet(str(tmp_path / "out")).count() == 2


def test_command_line(spark, tmp_path, capsys):
    from sparkgraph.__main__ import main

    query = tmp_path / "q.rq"
    query.write_text("PREFIX t: <http://example.org/tpch/#> SELECT ?r ?n { ?r a t:Region ; t:name ?n } ORDER BY ?n LIMIT 1")
    assert main([str(query), "--data", "/root/testdata/sf0.001", "--plan"]) == 0
    assert "scan ?r" in capsys.readouterr().out
    query.write_text("SELECT ?r { ?r <nothing> ?n }")
    assert main([str(query), "--data", "/root/testdata/sf0.001"]) == 2


def test_two_variables_over_one_array_of_every_part(spark):
    """All combinations of every part, compared with SQL."""
    import duckdb

    from __spark_entry__ import oracle_sql, queries

    folder, name = "/root/testdata/sf0.01", "array_two_variables_all"
    with duckdb.connect() as db:
        db.execute(f"CREATE VIEW part AS SELECT * FROM '{folder}/part.parquet'")
        want = db.execute(oracle_sql()[name]).fetchall()
        n_parts = db.execute("SELECT count(*) FROM part").fetchone()[0]
    got = [tuple(r) for r in queries()[name](spark, folder).collect()]
    assert sorted(got) == sorted(want) and len({r[0] for r in got}) == n_parts


SHARED = {
    "ex:Owner": {"fields": {"name": ["ex:name", "string"], "pet": ["ex:pet", "ex:Cat"]}, "id": "id"},
    "ex:Kennel": {"fields": {"name": ["ex:name", "string"], "pet": ["ex:pet", "ex:Dog"]}, "id": "id"},
    "ex:Zoo": {"fields": {"name": ["ex:name", "string"], "any": ["ex:any", "ex:Dog|ex:Cat"]}, "id": "id"},
    "ex:Cat": {"fields": {"call": ["ex:call", "string"]}, "id": "id"},
    "ex:Dog": {"fields": {"call": ["ex:call", "string"]}, "id": "id"},
}
SHARED_ROWS = {
    "Owner": [{"_subject": EX + "o1", "id": "1", "name": "Ann", "pet": "1"}],
    "Kennel": [{"_subject": EX + "k1", "id": "1", "name": "Kay", "pet": "1"}],
    "Zoo": [{"_subject": EX + "z1", "id": "1", "name": "Zed", "any": "1"}, {"_subject": EX + "z2", "id": "2", "name": "Zoe", "any": "2"}, {"_subject": EX + "z3", "id": "3", "name": "Zac", "any": "3"}],
    "Cat": [{"_subject": EX + "cat1", "id": "1", "call": "Tom"}, {"_subject": EX + "cat2", "id": "2", "call": "Kit"}],
    "Dog": [{"_subject": EX + "dog1", "id": "1", "call": "Rex"}],
}


@pytest.fixture(scope="module")
def ask_shared(spark):
    session = GraphSession(spark, catalog(SHARED).bind(from_records(SHARED_ROWS)))
    return lambda text: sorted(
        tuple(v.removeprefix(EX) if isinstance(v, str) else v for v in row) for row in session.sparql(P + text).collect()
    )


def test_ids_that_types_share(ask_shared):
    """The key 1 stands for another resource in each type."""
    assert ask_shared("SELECT ?n ?c { ?o ex:name ?n ; ex:pet ?p . ?p ex:call ?c }") == [("Ann", "Tom"), ("Kay", "Rex")]
    assert ask_shared("SELECT ?p ?o { ?p ex:call ?c . ?o ex:pet ?p }") == [("cat1", "o1"), ("dog1", "k1")]
    assert ask_shared("SELECT ?n ?p { ?o ex:name ?n ; ex:pet ?p }") == [("Ann", "cat1"), ("Kay", "dog1")]
    assert ask_shared('SELECT ?a ?b { ?a ex:call ?x . ?b ex:pet ?a FILTER NOT EXISTS { ?b ex:name "Ann" } }') == [("dog1", "k1")]
    assert ask_shared('SELECT ?a { ?a ex:call ?x FILTER NOT EXISTS { ?b ex:pet ?a ; ex:name "Ann" } }') == [("cat2",), ("dog1",)]
    assert ask_shared("SELECT ?x ?y { ?x a ex:Owner ; ex:pet ?p . ?y a ex:Kennel ; ex:pet ?p }") == []
    assert ask_shared("SELECT ?p { ?x ex:pet ?p VALUES ?p { <http://example.org/dog1> } }") == [("dog1",)]
    assert ask_shared("SELECT ?x { ?x ?q ?p . ?p a ex:Cat ; ex:call \"Tom\" }") == [("o1",)]


def test_reference_to_several_types_that_share_ids(ask_shared):
    """Shown, such a reference is the first declared target that has the id; joined, any."""
    assert ask_shared("SELECT ?n ?p { ?z ex:name ?n ; ex:any ?p }") == [("Zac", None), ("Zed", "dog1"), ("Zoe", "cat2")]
    assert ask_shared("SELECT ?n ?c { ?z ex:name ?n ; ex:any ?p . ?p ex:call ?c }") == [("Zed", "Rex"), ("Zed", "Tom"), ("Zoe", "Kit")]
    assert ask_shared("SELECT ?n ?x { ?z ex:name ?n ; ex:any ?p . ?x ex:pet ?p }") == [("Zed", "k1"), ("Zed", "o1")]
    assert ask_shared("SELECT ?c { ?p ex:call ?c FILTER NOT EXISTS { ?z ex:any ?p } }") == []
    assert ask_shared("SELECT (COUNT(*) AS ?n) { ?z a ex:Zoo ; ?p ?x }") == [(8,)]
    assert ask_shared("SELECT ?z ?p { ?z ex:any ?p . ?k a ex:Kennel ; ex:pet ?p }") == [("z1", "dog1")]


def test_plans_of_field_scans_and_unbound_values(spark):
    session = GraphSession(spark, CATALOG)
    plan = session.sparql(P + "SELECT ?s ?p ?o { ?s ?p ?o }")._jdf.queryExecution().optimizedPlan().toString()
    assert "Join LeftOuter" not in plan  # literals are in no join
    bound = session.sparql(P + "SELECT ?s ?p { ?s ?p <http://example.org/dog1> }")._jdf.queryExecution().optimizedPlan().toString()
    assert "Join LeftOuter" not in bound and "Filter" in bound
    text = 'SELECT ?x ?y { VALUES (?x ?y) { ("Tom" UNDEF) (UNDEF 3) ("Zed" 1) } FILTER NOT EXISTS { ?p ex:call ?x ; ex:age ?y } }'
    plan = session.sparql(P + text)._jdf.queryExecution().executedPlan().toString()
    # Only rows with nothing bound are not equi-joined: they ask whether there is one row.
    assert plan.count("NestedLoop") == 1 and "Limit 1" in plan and "Cartesian" not in plan
    assert {tuple(r) for r in session.sparql(P + text).collect()} == {("Tom", None), ("Zed", 1)}
    plan = session.sparql(P + "SELECT DISTINCT ?c { ?p ex:call ?c } ORDER BY DESC(?p)")._jdf.queryExecution().optimizedPlan().toString()
    assert "Window" not in plan


def test_distinct_by_hidden_keys_of_mixed_directions(ask):
    assert ask("SELECT DISTINCT ?c { ?p ex:call ?c } ORDER BY DESC(?c) ?p") == [("Tom",), ("Rex",)]
    assert ask("SELECT DISTINCT ?n { ?s a ?t ; ex:name ?n } ORDER BY DESC(?t) ?s LIMIT 3") == [("Alice",), ("Bob",), ("O'Neil",)]


def test_jdbc_source(spark, tmp_path):
    """A database in Derby, which Spark carries: types decoded, nulls kept, read in parts."""
    from sparkgraph.sources import from_jdbc

    url = f"jdbc:derby:{tmp_path}/db;create=true"
    kinds = {
        "ex:Thing": {
            "fields": {
                "name": ["ex:name", "string"], "size": ["ex:size", "integer"], "share": ["ex:share", "double"], "ratio": ["ex:ratio", "float"],
                "price": ["ex:price", "decimal"], "ok": ["ex:ok", "boolean"], "day": ["ex:day", "date"], "at": ["ex:at", "datetime"], "next": ["ex:next", "ex:Thing"],
            },
            "table": "THING", "subject": "_subject", "id": "id",
        }
    }
    rows = [
        (EX + "t1", 1, "one", 10, 0.5, 1.5, Decimal("2.50"), True, dt.date(2024, 1, 2), dt.datetime(2024, 1, 2, 3, 4, 5), 2),
        (EX + "t2", 2, None, None, None, None, None, None, None, None, 1),
        (EX + "t3", 3, "it's", -7, -0.25, 0.0, Decimal("-1.00"), False, dt.date(1969, 12, 31), dt.datetime(1969, 12, 31, 23, 59, 59), None),
    ]
    schema = "`_subject` string, id long, name string, size long, share double, ratio float, price decimal(10,2), ok boolean, day date, at timestamp, next long"
    options = {"driver": "org.apache.derby.iapi.jdbc.AutoloadedDriver"}
    spark.createDataFrame(rows, schema).write.format("jdbc").options(url=url, dbtable="THING", **options).save()
    for parts in (None, {"THING": ("id", 1, 4, 2)}):
        session = GraphSession(spark, catalog(kinds).bind(from_jdbc(url, options, parts)))
        assert parts is None or session.sparql(P + "SELECT ?t { ?t ex:next ?u }").rdd.getNumPartitions() == 2
        got = session.sparql(P + "SELECT ?n ?s ?h ?r ?p ?k ?d ?a { ?t ex:name ?n ; ex:size ?s ; ex:share ?h ; ex:ratio ?r ; ex:price ?p ; ex:ok ?k ; ex:day ?d ; ex:at ?a }").collect()
        assert sorted(tuple(r) for r in got) == sorted(r[2:10] for r in rows if r[2])
        found = session.sparql(P + "SELECT ?t ?u { ?t ex:next ?u }").collect()
        assert sorted(tuple(r) for r in found) == [(EX + "t1", EX + "t2"), (EX + "t2", EX + "t1")]
        assert session.sparql(P + "SELECT ?t { ?t ex:size 10 ; ex:ok true }").collect() == [(EX + "t1",)]

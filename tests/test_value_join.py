"""Joins on literals that stand in many rows of both sides."""

from __future__ import annotations

import duckdb
import pytest

from sparkgraph.operators import joins
from sparkgraph.queries import ORACLES, QUERIES
from sparkgraph.session import GraphSession
from sparkgraph.tpch_graph import PREFIX, tpch_catalog

DAYS, ORDERS, LINES = 60, 80, 400


@pytest.fixture(scope="module")
def tables(tmp_path_factory):
    folder = tmp_path_factory.mktemp("many")
    day = "TIMESTAMP '2000-01-01' + to_days(CAST(i % {} AS INTEGER))"
    orders = f"""SELECT i AS o_orderkey, i AS o_custkey, CASE WHEN i % 7 = 0 THEN 'F' ELSE 'P' END AS o_orderstatus, 1.0::DOUBLE AS o_totalprice,
        CASE WHEN i % 11 <> 0 THEN {day.format(DAYS)} END AS o_orderdate, '1-URGENT' AS o_orderpriority FROM range({DAYS * ORDERS}) r(i)"""
    lines = f"""SELECT i AS l_orderkey, i * 7 AS l_partkey, i * 3 AS l_suppkey, 1 AS l_linenumber, 1.0::DOUBLE AS l_quantity, 'R' AS l_returnflag,
        {day.format(DAYS + 1)} AS l_shipdate FROM range({DAYS * LINES}) r(i)"""
    for name, text in (("orders", orders), ("lineitem", lines)):
        duckdb.sql(f"COPY ({text}) TO '{folder}/{name}.parquet' (FORMAT parquet)")
    return str(folder)


@pytest.fixture
def large(spark, monkeypatch):
    """Tables of some KB count as large ones."""
    key = "spark.sql.autoBroadcastJoinThreshold"
    before = spark.conf.get(key)
    spark.conf.set(key, "-1")
    monkeypatch.setattr(joins, "PART_BYTES", 2 << 10, raising=False)
    yield
    spark.conf.set(key, before)


def test_all_pairs_in_little_space(spark, tables, large, tmp_path):
    out = tmp_path / "out"
    QUERIES["value_join_dates"](spark, tables).write.parquet(str(out))
    db = duckdb.connect()
    for name in ("orders", "lineitem"):
        db.sql(f"CREATE VIEW {name} AS SELECT * FROM '{tables}/{name}.parquet'")
    db.sql(f"CREATE VIEW got AS SELECT a, b FROM '{out}/*.parquet'")
    digest = "SELECT count(*), sum(hash(a, b)), count(DISTINCT a), count(DISTINCT b) FROM"
    n, *rest = db.execute(f"{digest} got").fetchone()
    assert (n, *rest) == db.execute(f"{digest} ({ORACLES['value_join_dates']})").fetchone()
    assert n > 1_000_000
    assert sum(p.stat().st_size for p in out.glob("*.parquet")) / n < 1  # bytes a pair of some 80 characters


def test_sides_of_a_large_value_join(spark, tables, large):
    frame = QUERIES["value_join_dates"](spark, tables)
    plan = frame._jdf.queryExecution().executedPlan().toString()
    assert plan.count("REPARTITION_BY_NUM") == 2 and "ENSURE_REQUIREMENTS" not in plan
    assert plan.index("l_shipdate") < plan.index("o_orderdate")  # the larger table runs, the smaller is held


def test_other_joins_are_left_to_spark(spark, tables, large, monkeypatch):
    session, prefix = GraphSession(spark, tpch_catalog(tables)), f"PREFIX t: <{PREFIX}>\n"
    plan = lambda text: session.sparql(prefix + text)._jdf.queryExecution().executedPlan().toString()
    assert "REPARTITION" not in plan("SELECT ?o ?l { ?o a t:Order ; t:status ?s . ?l t:order ?o }")
    assert "REPARTITION" not in plan("SELECT ?a ?b { ?a a t:Order ; t:total ?x . ?b a t:LineItem ; t:quantity ?x }")
    text = "SELECT ?a ?b { ?a a t:Order ; t:status ?x . ?b a t:LineItem ; t:flag ?x }"
    assert "REPARTITION" in plan(text)
    monkeypatch.setattr(joins, "PART_BYTES", 1 << 30)
    assert "REPARTITION" not in plan(text)

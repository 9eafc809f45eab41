"""Named queries over the TPC-H-like catalogue, each with DuckDB SQL for the same rows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sparkgraph.session import GraphSession
from sparkgraph.tpch_graph import BASE, PREFIX, shared_ids_catalog, tpch_catalog

_P = f"PREFIX t: <{PREFIX}>\n"
_A = "http://www.w3.org/1999/02/22-rdf-syntax-ns#type"


def _iri(kind: str, key: str) -> str:
    return f"'{BASE}{kind}/' || {key}"


def _type(name: str) -> str:
    return f"'{PREFIX}{name}'"


_LINE = _iri("lineitem", "l_orderkey || '-' || l_linenumber || '-' || l_partkey || '-' || l_suppkey")
_NEW_VERSION = "EXISTS (SELECT 1 FROM orders v WHERE v.o_orderkey = o.o_orderkey + 1 AND v.o_orderkey % 10 = 0)"

FLAGSHIP = """
SELECT ?order ?cname ?nname ?total WHERE {
  ?order t:customer ?c ; t:total ?total ; t:priority [] .
  ?c t:name ?cname ; t:nation ?n .
  ?n t:name ?nname .
  FILTER NOT EXISTS { ?c t:segment "BUILDING" }
  FILTER NOT EXISTS { [] t:nextVersionOf ?order }
} ORDER BY DESC(?total) ?order LIMIT 20
"""

#: name: (SPARQL, SQL). A mixed variable is shown by its lexical form.
TEXTS: dict[str, tuple[str, str]] = {
    "flagship": (
        FLAGSHIP,
        f"""SELECT {_iri("order", "o.o_orderkey")} AS "order", c.c_name AS cname, n.n_name AS nname, CAST(o.o_totalprice AS DOUBLE) AS total
        FROM orders o JOIN customer c ON c.c_custkey = o.o_custkey JOIN nation n ON n.n_nationkey = c.c_nationkey
        WHERE o.o_orderpriority <> '5-LOW' AND c.c_mktsegment <> 'BUILDING' AND NOT {_NEW_VERSION}
        ORDER BY total DESC, 1 LIMIT 20""",
    ),
    "typed_scan": (
        "SELECT ?s ?name ?balance WHERE { ?s a t:Supplier ; t:name ?name ; t:balance ?balance }",
        f"SELECT {_iri('supplier', 's_suppkey')} AS s, s_name AS name, CAST(s_acctbal AS DOUBLE) AS balance FROM supplier",
    ),
    "bound_object": (
        'SELECT ?c ?name WHERE { ?c t:segment "BUILDING" ; t:name ?name }',
        f"SELECT {_iri('customer', 'c_custkey')} AS c, c_name AS name FROM customer WHERE c_mktsegment = 'BUILDING'",
    ),
    "bound_iri_object": (
        f"SELECT ?c ?name WHERE {{ ?c a t:Customer ; t:nation <{BASE}nation/3> ; t:name ?name }}",
        f"SELECT {_iri('customer', 'c_custkey')} AS c, c_name AS name FROM customer WHERE c_nationkey = 3",
    ),
    "bound_subject": (
        f"SELECT ?name ?region WHERE {{ <{BASE}nation/7> a t:Nation ; t:name ?name ; t:region ?region }}",
        f"SELECT n_name AS name, {_iri('region', 'n_regionkey')} AS region FROM nation WHERE n_nationkey = 7",
    ),
    "fully_bound": (
        f"SELECT ?r WHERE {{ ?r a t:Region . <{BASE}nation/7> t:region <{BASE}region/2> }}",
        f"SELECT {_iri('region', 'r_regionkey')} AS r FROM region WHERE EXISTS (SELECT 1 FROM nation WHERE n_nationkey = 7 AND n_regionkey = 2)",
    ),
    "blank_existence": (
        "SELECT ?c WHERE { ?c t:segment [] ; t:balance _:b }",
        f"SELECT {_iri('customer', 'c_custkey')} AS c FROM customer WHERE c_mktsegment <> 'HOUSEHOLD'",
    ),
    "type_var_known": (
        "SELECT ?n ?t WHERE { ?n a ?t ; t:region ?r }",
        f"SELECT {_iri('nation', 'n_nationkey')} AS n, {_type('Nation')} AS t FROM nation",
    ),
    "type_var_all": (
        "SELECT ?s ?t WHERE { ?s a ?t }",
        " UNION ALL ".join(
            f"SELECT {_iri(kind, key)} AS s, {_type(name)} AS t FROM {table}"
            for name, kind, key, table in (
                ("Region", "region", "r_regionkey", "region"),
                ("Nation", "nation", "n_nationkey", "nation"),
                ("Customer", "customer", "c_custkey", "customer"),
                ("Supplier", "supplier", "s_suppkey", "supplier"),
                ("Part", "part", "p_partkey", "part"),
                ("Order", "order", "o_orderkey", "orders"),
                ("Event", "event", "event_id", "events"),
            )
        )
        + f" UNION ALL SELECT {_LINE} AS s, {_type('LineItem')} AS t FROM lineitem",
    ),
    "same_var_two_fields": (
        "SELECT ?o ?status WHERE { ?o t:placed ?x ; t:updated ?x ; t:status ?status }",
        f"SELECT {_iri('order', 'o_orderkey')} AS o, o_orderstatus AS status FROM orders WHERE o_orderstatus = 'F'",
    ),
    "duplicate_predicate": (
        'SELECT ?c ?s WHERE { ?c t:segment ?s ; t:segment "MACHINERY" }',
        f"SELECT {_iri('customer', 'c_custkey')} AS c, c_mktsegment AS s FROM customer WHERE c_mktsegment = 'MACHINERY'",
    ),
    "fk_join": (
        "SELECT ?c ?nname WHERE { ?c a t:Customer ; t:nation ?n . ?n t:name ?nname }",
        f"SELECT {_iri('customer', 'c_custkey')} AS c, n_name AS nname FROM customer JOIN nation ON n_nationkey = c_nationkey",
    ),
    "fk_join_reversed": (
        'SELECT ?rname ?n WHERE { ?r t:name ?rname . ?n t:region ?r ; t:name "NATION_3" }',
        f"SELECT r_name AS rname, {_iri('nation', 'n_nationkey')} AS n FROM region JOIN nation ON n_regionkey = r_regionkey WHERE n_name = 'NATION_3'",
    ),
    "fk_join_3way": (
        "SELECT ?l ?status ?cname ?pname WHERE { ?l t:order ?o ; t:part ?p ; t:flag \"R\" . ?o t:customer ?c ; t:status ?status . ?c t:name ?cname . ?p t:name ?pname }",
        f"""SELECT {_LINE} AS l, o_orderstatus AS status, c_name AS cname, p_name AS pname
        FROM lineitem JOIN orders ON o_orderkey = l_orderkey JOIN customer ON c_custkey = o_custkey JOIN part ON p_partkey = l_partkey
        WHERE l_returnflag = 'R'""",
    ),
    "path_sequence": (
        "SELECT ?c ?rname WHERE { ?c a t:Customer ; t:nation/t:region/t:name ?rname }",
        f"""SELECT {_iri('customer', 'c_custkey')} AS c, r_name AS rname
        FROM customer JOIN nation ON n_nationkey = c_nationkey JOIN region ON r_regionkey = n_regionkey""",
    ),
    "value_join": (
        "SELECT ?a ?b WHERE { ?a a t:Customer ; t:balance ?x . ?b a t:Supplier ; t:balance ?x }",
        f"SELECT {_iri('customer', 'c_custkey')} AS a, {_iri('supplier', 's_suppkey')} AS b FROM customer JOIN supplier ON CAST(c_acctbal AS DOUBLE) = CAST(s_acctbal AS DOUBLE)",
    ),
    "value_join_dates": (
        'SELECT ?a ?b WHERE { ?a a t:Order ; t:placed ?x ; t:status "P" . ?b a t:LineItem ; t:shipped ?x ; t:flag "R" }',
        f"""SELECT {_iri('order', 'o_orderkey')} AS a, {_LINE} AS b FROM orders JOIN lineitem ON o_orderdate = l_shipdate WHERE o_orderstatus = 'P' AND l_returnflag = 'R'""",
    ),
    "ref_resolve_single": (
        "SELECT ?o ?c WHERE { ?o t:customer ?c }",
        f"SELECT {_iri('order', 'o_orderkey')} AS o, CASE WHEN c_custkey IS NOT NULL THEN {_iri('customer', 'c_custkey')} END AS c FROM orders LEFT JOIN customer ON c_custkey = o_custkey",
    ),
    "ref_resolve_multi": (
        "SELECT ?e ?a WHERE { ?e t:actor ?a }",
        f"""SELECT {_iri('event', 'event_id')} AS e, CASE WHEN user_id % 2 = 0 AND c_custkey IS NOT NULL THEN {_iri('customer', 'c_custkey')}
        WHEN user_id % 2 = 1 AND s_suppkey IS NOT NULL THEN {_iri('supplier', 's_suppkey')} END AS a
        FROM events LEFT JOIN customer ON c_custkey = user_id LEFT JOIN supplier ON s_suppkey = user_id""",
    ),
    "ambiguous_union": (
        "SELECT ?x ?b ?t WHERE { ?x t:balance ?b ; a ?t }",
        f"""SELECT {_iri('customer', 'c_custkey')} AS x, CAST(c_acctbal AS DOUBLE) AS b, {_type('Customer')} AS t FROM customer
        UNION ALL SELECT {_iri('supplier', 's_suppkey')}, CAST(s_acctbal AS DOUBLE), {_type('Supplier')} FROM supplier""",
    ),
    "count_star": (
        'SELECT (COUNT(*) AS ?count) WHERE { ?o t:customer ?c ; t:status "F" . ?c t:segment [] }',
        "SELECT count(*) AS count FROM orders JOIN customer ON c_custkey = o_custkey WHERE o_orderstatus = 'F' AND c_mktsegment <> 'HOUSEHOLD'",
    ),
    "count_union": (
        "SELECT (COUNT(*) AS ?n) WHERE { ?x t:name ?name }",
        "SELECT CAST((SELECT count(*) FROM region) + (SELECT count(*) FROM nation) + (SELECT count(*) FROM customer) + (SELECT count(*) FROM supplier) + (SELECT count(*) FROM part) AS BIGINT) AS n",
    ),
    "count_field_scan": (
        f"SELECT (COUNT(*) AS ?n) WHERE {{ <{BASE}customer/5> ?p ?o }}",
        "SELECT CAST(4 + count(*) FILTER (c_mktsegment <> 'HOUSEHOLD') AS BIGINT) AS n FROM customer WHERE c_custkey = 5",
    ),
    "distinct_project": (
        "SELECT DISTINCT ?status ?priority WHERE { ?o t:status ?status ; t:priority ?priority }",
        "SELECT DISTINCT o_orderstatus AS status, o_orderpriority AS priority FROM orders WHERE o_orderpriority <> '5-LOW'",
    ),
    "order_limit_offset": (
        "SELECT ?o ?total WHERE { ?o t:total ?total } ORDER BY DESC(?total) ?o OFFSET 10 LIMIT 25",
        f"SELECT {_iri('order', 'o_orderkey')} AS o, CAST(o_totalprice AS DOUBLE) AS total FROM orders ORDER BY total DESC, o LIMIT 25 OFFSET 10",
    ),
    "distinct_order_hidden": (
        "SELECT DISTINCT ?status ?priority WHERE { ?o t:status ?status ; t:priority ?priority ; t:total ?total } ORDER BY DESC(?total) LIMIT 5",
        """SELECT o_orderstatus AS status, o_orderpriority AS priority FROM orders WHERE o_orderpriority <> '5-LOW'
        GROUP BY ALL ORDER BY max(o_totalprice) DESC LIMIT 5""",
    ),
    "not_exists_correlated": (
        'SELECT ?o WHERE { ?o t:customer ?c . FILTER NOT EXISTS { ?c t:segment ?s ; t:segment "BUILDING" } }',
        f"SELECT {_iri('order', 'o_orderkey')} AS o FROM orders WHERE NOT EXISTS (SELECT 1 FROM customer WHERE c_custkey = o_custkey AND c_mktsegment = 'BUILDING')",
    ),
    "not_exists_two_hop": (
        'SELECT ?o WHERE { ?o t:customer ?c . FILTER NOT EXISTS { ?c t:nation ?n . ?n t:region ?r . ?r t:name "EUROPE" } }',
        f"""SELECT {_iri('order', 'o_orderkey')} AS o FROM orders WHERE NOT EXISTS (SELECT 1 FROM customer JOIN nation ON n_nationkey = c_nationkey
        JOIN region ON r_regionkey = n_regionkey WHERE c_custkey = o_custkey AND r_name = 'EUROPE')""",
    ),
    "not_exists_decorrelated": (
        "SELECT ?p WHERE { ?p t:brand ?b . FILTER NOT EXISTS { [] t:hasPart ?p } }",
        f"SELECT {_iri('part', 'p_partkey')} AS p FROM part WHERE NOT EXISTS (SELECT 1 FROM lineitem JOIN orders ON o_orderkey = l_orderkey WHERE l_partkey = p_partkey)",
    ),
    "not_exists_decorrelated_flag": (
        'SELECT ?o WHERE { ?o t:status ?s . FILTER NOT EXISTS { ?l t:order ?o ; t:flag "R" } }',
        f"""SELECT {_iri('order', 'o_orderkey')} AS o FROM orders WHERE NOT EXISTS (SELECT 1 FROM lineitem WHERE l_orderkey = o_orderkey AND l_returnflag = 'R')""",
    ),
    "not_exists_undef": (
        'SELECT ?st ?pr WHERE { VALUES (?st ?pr) { ("F" "1-URGENT") ("Z" UNDEF) (UNDEF "9-NONE") ("O" "9-NONE") } FILTER NOT EXISTS { ?o t:status ?st ; t:priority ?pr } }',
        """SELECT st, pr FROM (VALUES ('F', '1-URGENT'), ('Z', NULL), (NULL, '9-NONE'), ('O', '9-NONE')) v(st, pr) WHERE NOT EXISTS (SELECT 1 FROM orders
        WHERE o_orderpriority <> '5-LOW' AND (st IS NULL OR st = o_orderstatus) AND (pr IS NULL OR pr = o_orderpriority))""",
    ),
    "distinct_order_mixed": (
        "SELECT DISTINCT ?status ?priority WHERE { ?o t:status ?status ; t:priority ?priority ; t:total ?total ; t:placed ?placed } ORDER BY DESC(?placed) ?total LIMIT 7",
        """SELECT status, priority FROM (SELECT o_orderstatus AS status, o_orderpriority AS priority, row_number() OVER (PARTITION BY o_orderstatus, o_orderpriority
        ORDER BY o_orderdate DESC, o_totalprice) AS n, o_orderdate AS d, o_totalprice AS t FROM orders WHERE o_orderpriority <> '5-LOW') WHERE n = 1 ORDER BY d DESC, t LIMIT 7""",
    ),
    "not_exists_combined": (
        'SELECT ?c WHERE { ?c t:segment [] . FILTER (NOT EXISTS { ?o t:customer ?c ; t:status "P" } && NOT EXISTS { ?e t:actor ?c ; t:kind "click" }) }',
        f"""SELECT {_iri('customer', 'c_custkey')} AS c FROM customer WHERE c_mktsegment <> 'HOUSEHOLD'
        AND NOT EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_orderstatus = 'P')
        AND NOT EXISTS (SELECT 1 FROM events WHERE user_id % 2 = 0 AND user_id = c_custkey AND event_type = 'click')""",
    ),
    "not_exists_unbound_field": (
        "SELECT ?c WHERE { ?c a t:Customer . FILTER NOT EXISTS { ?c t:segment ?s } }",
        f"SELECT {_iri('customer', 'c_custkey')} AS c FROM customer WHERE c_mktsegment = 'HOUSEHOLD'",
    ),
    "not_exists_null_rewrite": (
        "SELECT ?order WHERE { ?order t:total ?x . FILTER NOT EXISTS { [] t:nextVersionOf ?order } }",
        f'SELECT {_iri("order", "o.o_orderkey")} AS "order" FROM orders o WHERE NOT {_NEW_VERSION}',
    ),
    "array_unnest": (
        "SELECT ?p ?w WHERE { ?p t:word ?w }",
        f"SELECT {_iri('part', 'p_partkey')} AS p, unnest(list_distinct(string_split(p_name, ' '))) AS w FROM part",
    ),
    "array_two_variables": (
        "SELECT ?p ?a ?b WHERE { ?p t:word ?a ; t:word ?b ; t:size 7 }",
        f"""SELECT {_iri('part', 'p_partkey')} AS p, a, b FROM (SELECT p_partkey, a, unnest(list_distinct(string_split(p_name, ' '))) AS b
        FROM (SELECT p_partkey, p_name, unnest(list_distinct(string_split(p_name, ' '))) AS a FROM part WHERE p_size = 7))""",
    ),
    "array_two_variables_all": (
        "SELECT ?p ?a ?b WHERE { ?p t:word ?a ; t:word ?b }",
        f"""SELECT {_iri('part', 'p_partkey')} AS p, a, b FROM (SELECT p_partkey, a, unnest(list_distinct(string_split(p_name, ' '))) AS b
        FROM (SELECT p_partkey, p_name, unnest(list_distinct(string_split(p_name, ' '))) AS a FROM part))""",
    ),
    "array_contains": (
        'SELECT ?p ?name WHERE { ?p t:word "red" ; t:name ?name }',
        f"SELECT {_iri('part', 'p_partkey')} AS p, p_name AS name FROM part WHERE list_contains(string_split(p_name, ' '), 'red')",
    ),
    "array_ref_join": (
        "SELECT ?o ?p ?brand WHERE { ?o t:hasPart ?p ; t:status \"P\" . ?p t:brand ?brand }",
        f"""SELECT DISTINCT {_iri('order', 'o_orderkey')} AS o, {_iri('part', 'p_partkey')} AS p, p_brand AS brand
        FROM orders JOIN lineitem ON l_orderkey = o_orderkey JOIN part ON p_partkey = l_partkey WHERE o_orderstatus = 'P'""",
    ),
    "array_ref_resolve": (
        "SELECT ?o ?before WHERE { ?o t:nextVersionOf ?before }",
        f"""SELECT {_iri('order', 'o.o_orderkey')} AS o, CASE WHEN b.o_orderkey IS NOT NULL THEN {_iri('order', 'b.o_orderkey')} END AS before
        FROM orders o LEFT JOIN orders b ON b.o_orderkey = o.o_orderkey - 1 WHERE o.o_orderkey > 0 AND o.o_orderkey % 10 = 0""",
    ),
    "values_in": (
        'SELECT ?c ?s WHERE { ?c t:segment ?s VALUES ?s { "BUILDING" "MACHINERY" "MACHINERY" } }',
        f"SELECT {_iri('customer', 'c_custkey')} AS c, c_mktsegment AS s FROM customer JOIN (VALUES ('BUILDING'), ('MACHINERY'), ('MACHINERY')) v(s) ON s = c_mktsegment",
    ),
    "values_iri": (
        f"SELECT ?c ?n WHERE {{ ?c a t:Supplier ; t:nation ?n VALUES ?n {{ <{BASE}nation/1> <{BASE}nation/99> }} }}",
        f"SELECT {_iri('supplier', 's_suppkey')} AS c, {_iri('nation', 's_nationkey')} AS n FROM supplier WHERE s_nationkey = 1",
    ),
    "values_multi": (
        'SELECT ?o ?st ?pr WHERE { ?o t:status ?st ; t:priority ?pr } VALUES (?st ?pr) { ("F" "1-URGENT") ("O" "2-HIGH") }',
        f"""SELECT {_iri('order', 'o_orderkey')} AS o, o_orderstatus AS st, o_orderpriority AS pr FROM orders
        WHERE (o_orderstatus, o_orderpriority) IN (('F', '1-URGENT'), ('O', '2-HIGH'))""",
    ),
    "values_undef": (
        'SELECT ?o ?st ?pr ?mark WHERE { ?o t:status ?st ; t:priority ?pr } VALUES (?st ?pr ?mark) { ("F" UNDEF 1) (UNDEF "2-HIGH" 2) (UNDEF "2-HIGH" UNDEF) }',
        f"""SELECT {_iri('order', 'o_orderkey')} AS o, o_orderstatus AS st, o_orderpriority AS pr, CAST(m AS BIGINT) AS mark FROM orders
        JOIN (VALUES ('F', NULL, 1), (NULL, '2-HIGH', 2), (NULL, '2-HIGH', NULL)) v(s, p, m)
        ON (s IS NULL OR s = o_orderstatus) AND (p IS NULL OR p = o_orderpriority) WHERE o_orderpriority <> '5-LOW'""",
    ),
    "values_only": (
        'SELECT ?x ?y WHERE { VALUES (?x ?y) { (1 "a") (2 UNDEF) } }',
        "SELECT CAST(x AS BIGINT) AS x, y FROM (VALUES (1, 'a'), (2, NULL)) v(x, y)",
    ),
    "field_scan_typed": (
        "SELECT ?n ?p ?o WHERE { ?n a t:Nation ; ?p ?o }",
        f"""SELECT {_iri('nation', 'n_nationkey')} AS n, '{PREFIX}name' AS p, n_name AS o FROM nation
        UNION ALL SELECT {_iri('nation', 'n_nationkey')}, '{PREFIX}region', {_iri('region', 'n_regionkey')} FROM nation
        UNION ALL SELECT {_iri('nation', 'n_nationkey')}, '{_A}', {_type('Nation')} FROM nation""",
    ),
    "field_scan_all_types": (
        "SELECT ?p ?t WHERE { ?s ?p ?o ; a ?t }",
        " UNION ALL ".join(
            f"SELECT '{PREFIX}{field}' AS p, {_type(name)} AS t FROM {table} WHERE {where}"
            for name, table, where, fields in (
                ("Region", "region", "true", "name"),
                ("Nation", "nation", "true", "name region"),
                ("Customer", "customer", "true", "name nation balance"),
                ("Customer", "customer", "c_mktsegment <> 'HOUSEHOLD'", "segment"),
                ("Supplier", "supplier", "true", "name nation balance"),
                ("Part", "part", "true", "name brand size price"),
                ("Order", "orders", "true", "customer status total placed"),
                ("Order", "orders", "o_orderpriority <> '5-LOW'", "priority"),
                ("Order", "orders", "o_orderstatus IN ('F', 'P')", "updated"),
                ("Order", "orders", "o_orderkey > 0 AND o_orderkey % 10 = 0 AND o_orderkey - 1 IN (SELECT o_orderkey FROM orders)", "nextVersionOf"),
                ("Order", "orders", "(o_orderkey + 1) % 10 = 0 AND o_orderkey + 1 IN (SELECT o_orderkey FROM orders)", "deprecatedBy"),
                ("LineItem", "lineitem", "true", "order part supplier quantity flag shipped"),
                ("Event", "events", "true", "kind value at"),
                ("Event", "events", "CASE WHEN user_id % 2 = 0 THEN user_id IN (SELECT c_custkey FROM customer) ELSE user_id IN (SELECT s_suppkey FROM supplier) END", "actor"),
            )
            for field in fields.split()
        )
        + f""" UNION ALL SELECT '{PREFIX}word', {_type('Part')} FROM (SELECT unnest(list_distinct(string_split(p_name, ' '))) FROM part)
        UNION ALL SELECT '{PREFIX}hasPart', {_type('Order')} FROM (SELECT DISTINCT l_orderkey, l_partkey FROM lineitem JOIN orders ON o_orderkey = l_orderkey JOIN part ON p_partkey = l_partkey)
        """
        + "".join(
            f" UNION ALL SELECT '{_A}', {_type(name)} FROM {table}"
            for name, table in (("Region", "region"), ("Nation", "nation"), ("Customer", "customer"), ("Supplier", "supplier"), ("Part", "part"), ("Order", "orders"), ("LineItem", "lineitem"), ("Event", "events"))
        ),
    ),
    "field_scan_bound_object": (
        'SELECT ?s ?p WHERE { ?s ?p "NATION_3" }',
        f"SELECT {_iri('nation', 'n_nationkey')} AS s, '{PREFIX}name' AS p FROM nation WHERE n_name = 'NATION_3'",
    ),
    "field_scan_bound_iri": (
        f"SELECT ?s ?p WHERE {{ ?s ?p <{BASE}nation/2> }}",
        f"""SELECT {_iri('customer', 'c_custkey')} AS s, '{PREFIX}nation' AS p FROM customer WHERE c_nationkey = 2
        UNION ALL SELECT {_iri('supplier', 's_suppkey')}, '{PREFIX}nation' FROM supplier WHERE s_nationkey = 2""",
    ),
    "field_scan_filtered": (
        "SELECT ?c ?p ?o WHERE { ?c a t:Customer ; t:name ?o ; ?p ?o . FILTER NOT EXISTS { ?c t:segment ?s } }",
        f"SELECT {_iri('customer', 'c_custkey')} AS c, '{PREFIX}name' AS p, c_name AS o FROM customer WHERE c_mktsegment = 'HOUSEHOLD'",
    ),
    "field_scan_narrowed": (
        "SELECT ?n ?p WHERE { ?c a t:Supplier ; t:nation ?n . ?n ?p ?o }",
        f"""SELECT {_iri('nation', 's_nationkey')} AS n, p FROM supplier JOIN nation ON n_nationkey = s_nationkey,
        (VALUES ('{PREFIX}name'), ('{PREFIX}region'), ('{_A}')) v(p)""",
    ),
    "select_star": (
        "SELECT * WHERE { ?n t:region ?r ; t:name ?name . ?r t:name [] }",
        f"SELECT {_iri('nation', 'n_nationkey')} AS n, {_iri('region', 'n_regionkey')} AS r, n_name AS name FROM nation",
    ),
}

#: Over the catalogue whose types share their ids.
_LINE_ITEM = _iri("LineItem", "l_orderkey || '-' || l_linenumber || '-' || l_partkey || '-' || l_suppkey")
SHARED: dict[str, tuple[str, str]] = {
    "shared_ids_join": (
        "SELECT ?x ?pname WHERE { ?x t:partner ?p ; t:status \"F\" . ?p t:name ?pname }",
        f"""SELECT {_iri('Order', 'o_orderkey')} AS x, c_name AS pname FROM orders JOIN customer ON c_custkey = o_custkey WHERE o_orderstatus = 'F'
        UNION ALL SELECT {_LINE_ITEM}, s_name FROM lineitem JOIN supplier ON s_suppkey = l_suppkey WHERE l_linestatus = 'F'""",
    ),
    "shared_ids_not_exists": (
        'SELECT ?p WHERE { ?p t:balance ?b FILTER NOT EXISTS { ?x t:partner ?p ; t:status "F" } FILTER NOT EXISTS { ?e t:actor ?p ; t:kind "click" } }',
        f"""SELECT {_iri('Customer', 'c_custkey')} AS p FROM customer WHERE NOT EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_orderstatus = 'F')
        AND NOT EXISTS (SELECT 1 FROM events WHERE user_id = c_custkey AND event_type = 'click')
        UNION ALL SELECT {_iri('Supplier', 's_suppkey')} FROM supplier WHERE NOT EXISTS (SELECT 1 FROM lineitem WHERE l_suppkey = s_suppkey AND l_linestatus = 'F')
        AND NOT EXISTS (SELECT 1 FROM events WHERE user_id = s_suppkey AND event_type = 'click')""",
    ),
    "shared_ids_resolve": (
        'SELECT ?x ?p WHERE { ?x t:partner ?p ; t:status "O" }',
        f"""SELECT {_iri('Order', 'o_orderkey')} AS x, CASE WHEN c_custkey IS NOT NULL THEN {_iri('Customer', 'c_custkey')} END AS p
        FROM orders LEFT JOIN customer ON c_custkey = o_custkey WHERE o_orderstatus = 'O'
        UNION ALL SELECT {_LINE_ITEM}, CASE WHEN s_suppkey IS NOT NULL THEN {_iri('Supplier', 's_suppkey')} END
        FROM lineitem LEFT JOIN supplier ON s_suppkey = l_suppkey WHERE l_linestatus = 'O'""",
    ),
    "shared_ids_resolve_first": (
        "SELECT ?e ?a WHERE { ?e t:actor ?a }",
        f"""SELECT {_iri('Event', 'event_id')} AS e, CASE WHEN s_suppkey IS NOT NULL THEN {_iri('Supplier', 's_suppkey')}
        WHEN c_custkey IS NOT NULL THEN {_iri('Customer', 'c_custkey')} END AS a
        FROM events LEFT JOIN customer ON c_custkey = user_id LEFT JOIN supplier ON s_suppkey = user_id""",
    ),
}


def _run(name: str) -> Callable[[SparkSession, str], DataFrame]:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        catalog, text = (tpch_catalog(sf_dir), TEXTS[name][0]) if name in TEXTS else (shared_ids_catalog(sf_dir), SHARED[name][0])
        df = GraphSession(spark, catalog).sparql(_P + text)
        mixed = [f.name for f in df.schema.fields if f.dataType.typeName() == "struct"]
        return df.withColumns({c: F.col(f"`{c}`.lex") for c in mixed}) if mixed else df

    run.__name__ = name
    return run


QUERIES = {name: _run(name) for name in (*TEXTS, *SHARED)}
ORACLES = {name: sql for name, (_, sql) in (TEXTS | SHARED).items()}

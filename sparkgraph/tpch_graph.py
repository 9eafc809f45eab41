"""A catalogue over TPC-H-like Parquet tables, with nullable, array, reverse and multi-target fields derived from them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from sparkgraph.catalog import GraphCatalog, ResourceType

BASE = "http://example.org/tpch/"
PREFIX = f"{BASE}#"

SPEC = {
    "prefixes": {"t": PREFIX},
    "types": {
        "t:Region": {"fields": {"name": ["t:name", "string"]}},
        "t:Nation": {"fields": {"name": ["t:name", "string"], "region": ["t:region", "t:Region"]}},
        "t:Customer": {
            "fields": {
                "name": ["t:name", "string"],
                "nation": ["t:nation", "t:Nation"],
                "balance": ["t:balance", "double"],
                "segment": ["t:segment", "string"],
            }
        },
        "t:Supplier": {"fields": {"name": ["t:name", "string"], "nation": ["t:nation", "t:Nation"], "balance": ["t:balance", "double"]}},
        "t:Part": {
            "fields": {
                "name": ["t:name", "string"],
                "brand": ["t:brand", "string"],
                "size": ["t:size", "integer"],
                "price": ["t:price", "double"],
                "words": ["t:word", "string[]"],
            }
        },
        "t:Order": {
            "fields": {
                "customer": ["t:customer", "t:Customer"],
                "status": ["t:status", "string"],
                "total": ["t:total", "double"],
                "placed": ["t:placed", "datetime"],
                "updated": ["t:updated", "datetime"],
                "priority": ["t:priority", "string"],
                "hasPart": ["t:hasPart", "t:Part[]"],
                "nextVersionOf": ["t:nextVersionOf", "t:Order[]"],
                "deprecatedBy": ["t:deprecatedBy", "t:Order"],
            }
        },
        "t:LineItem": {
            "fields": {
                "order": ["t:order", "t:Order"],
                "part": ["t:part", "t:Part"],
                "supplier": ["t:supplier", "t:Supplier"],
                "quantity": ["t:quantity", "double"],
                "flag": ["t:flag", "string"],
                "shipped": ["t:shipped", "datetime"],
            }
        },
        "t:Event": {
            "fields": {
                "actor": ["t:actor", "t:Customer|t:Supplier"],
                "kind": ["t:kind", "string"],
                "value": ["t:value", "double"],
                "at": ["t:at", "datetime"],
            }
        },
    },
    "absence": [["t:nextVersionOf", "t:Order", ["deprecatedBy"]]],
}
for _entry in SPEC["types"].values():
    _entry["id"] = "_id"


def _id(kind: str, *keys: Column | str) -> Column:
    parts = [F.lit(f"{kind}/")]
    for i, key in enumerate(keys):
        parts += [F.lit("-")] * bool(i) + [(F.col(key) if isinstance(key, str) else key).cast("string")]
    return F.concat(*parts)


def tpch_catalog(sf_dir: str) -> GraphCatalog:
    """The catalogue over the tables in ``sf_dir``."""

    def table(spark: SparkSession, name: str) -> DataFrame:
        return spark.read.parquet(f"{sf_dir}/{name}.parquet")

    def orders(spark: SparkSession, columns: frozenset[str] | None) -> DataFrame:
        """Orders; what other tables or rows give is joined only where a query reads it."""
        rows = table(spark, "orders")
        key = F.col("o_orderkey")
        out = [
            _id("order", "o_orderkey").alias("_id"),
            _id("customer", "o_custkey").alias("customer"),
            F.col("o_orderstatus").alias("status"),
            F.col("o_totalprice").cast("double").alias("total"),
            F.col("o_orderdate").alias("placed"),
            F.when(F.col("o_orderstatus") == "P", F.col("o_orderdate") + F.expr("INTERVAL 1 DAY"))
            .when(F.col("o_orderstatus") == "F", F.col("o_orderdate"))
            .alias("updated"),
            F.when(F.col("o_orderpriority") != "5-LOW", F.col("o_orderpriority")).alias("priority"),
            F.when((key > 0) & (key % 10 == 0), F.array(_id("order", key - 1))).alias("nextVersionOf"),
        ]
        if columns is None or "hasPart" in columns:
            parts = (
                table(spark, "lineitem")
                .groupBy(F.col("l_orderkey").alias("__order"))
                .agg(F.array_sort(F.collect_set(_id("part", "l_partkey"))).alias("hasPart"))
            )
            rows = rows.join(parts, key == F.col("__order"), "left")
            out.append(F.col("hasPart"))
        if columns is None or "deprecatedBy" in columns:
            # The order after this one, where that is a new version of it.
            later = table(spark, "orders").where((key % 10 == 0) & (key > 0)).select((key - 1).alias("__key"), _id("order", "o_orderkey").alias("deprecatedBy"))
            rows = rows.join(later, key == F.col("__key"), "left")
            out.append(F.col("deprecatedBy"))
        return rows.select(*out)

    rows: dict[str, Callable[[SparkSession], DataFrame]] = {
        "Region": lambda s: table(s, "region").select(_id("region", "r_regionkey").alias("_id"), F.col("r_name").alias("name")),
        "Nation": lambda s: table(s, "nation").select(
            _id("nation", "n_nationkey").alias("_id"), F.col("n_name").alias("name"), _id("region", "n_regionkey").alias("region")
        ),
        "Customer": lambda s: table(s, "customer").select(
            _id("customer", "c_custkey").alias("_id"),
            F.col("c_name").alias("name"),
            _id("nation", "c_nationkey").alias("nation"),
            F.col("c_acctbal").cast("double").alias("balance"),
            F.when(F.col("c_mktsegment") != "HOUSEHOLD", F.col("c_mktsegment")).alias("segment"),
        ),
        "Supplier": lambda s: table(s, "supplier").select(
            _id("supplier", "s_suppkey").alias("_id"),
            F.col("s_name").alias("name"),
            _id("nation", "s_nationkey").alias("nation"),
            F.col("s_acctbal").cast("double").alias("balance"),
        ),
        "Part": lambda s: table(s, "part").select(
            _id("part", "p_partkey").alias("_id"),
            F.col("p_name").alias("name"),
            F.col("p_brand").alias("brand"),
            F.col("p_size").cast("long").alias("size"),
            F.col("p_retailprice").cast("double").alias("price"),
            F.split("p_name", " ").alias("words"),
        ),
        "LineItem": lambda s: table(s, "lineitem").select(
            _id("lineitem", "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey").alias("_id"),
            _id("order", "l_orderkey").alias("order"),
            _id("part", "l_partkey").alias("part"),
            _id("supplier", "l_suppkey").alias("supplier"),
            F.col("l_quantity").cast("double").alias("quantity"),
            F.col("l_returnflag").alias("flag"),
            F.col("l_shipdate").alias("shipped"),
        ),
        "Event": lambda s: table(s, "events").select(
            _id("event", "event_id").alias("_id"),
            F.when(F.col("user_id") % 2 == 0, _id("customer", "user_id")).otherwise(_id("supplier", "user_id")).alias("actor"),
            F.col("event_type").alias("kind"),
            F.col("value").cast("double").alias("value"),
            F.col("ts").alias("at"),
        ),
    }

    def source(spark: SparkSession, type_: ResourceType, columns: frozenset[str] | None = None) -> DataFrame:
        made = orders(spark, columns) if type_.table == "Order" else rows[type_.table](spark)
        return made.withColumn("_subject", F.concat(F.lit(BASE), "_id"))

    return GraphCatalog.from_spec(SPEC).bind(source)


#: Types whose ids are the plain integer keys of their tables, so that all types share them.
SHARED_SPEC = {
    "prefixes": {"t": PREFIX},
    "types": {
        "t:Nation": {"id": "id", "fields": {"name": ["t:name", "string"]}},
        "t:Customer": {"id": "id", "fields": {"name": ["t:name", "string"], "nation": ["t:nation", "t:Nation"], "balance": ["t:balance", "double"]}},
        "t:Supplier": {"id": "id", "fields": {"name": ["t:name", "string"], "nation": ["t:nation", "t:Nation"], "balance": ["t:balance", "double"]}},
        "t:Order": {"id": "id", "fields": {"partner": ["t:partner", "t:Customer"], "status": ["t:status", "string"]}},
        "t:LineItem": {"id": "id", "fields": {"partner": ["t:partner", "t:Supplier"], "status": ["t:status", "string"]}},
        "t:Event": {"id": "id", "fields": {"actor": ["t:actor", "t:Supplier|t:Customer"], "kind": ["t:kind", "string"]}},
    },
}


def shared_ids_catalog(sf_dir: str) -> GraphCatalog:
    """A catalogue over the same tables in which ids are integers that several types have."""
    tables = {
        "Nation": ("nation", ("n_nationkey",), {"name": "n_name"}),
        "Customer": ("customer", ("c_custkey",), {"name": "c_name", "nation": "c_nationkey", "balance": "CAST(c_acctbal AS DOUBLE)"}),
        "Supplier": ("supplier", ("s_suppkey",), {"name": "s_name", "nation": "s_nationkey", "balance": "CAST(s_acctbal AS DOUBLE)"}),
        "Order": ("orders", ("o_orderkey",), {"partner": "o_custkey", "status": "o_orderstatus"}),
        "LineItem": ("lineitem", ("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey"), {"partner": "l_suppkey", "status": "l_linestatus"}),
        "Event": ("events", ("event_id",), {"actor": "user_id", "kind": "event_type"}),
    }

    def source(spark: SparkSession, type_: ResourceType, columns: frozenset[str] | None = None) -> DataFrame:
        name, keys, fields = tables[type_.table]
        subject = F.concat(F.lit(f"{BASE}{type_.table}/"), F.concat_ws("-", *[F.col(k).cast("string") for k in keys]))
        made = [F.expr(e).alias(c) for c, e in fields.items()]
        return spark.read.parquet(f"{sf_dir}/{name}.parquet").select(subject.alias("_subject"), F.col(keys[0]).alias("id"), *made)

    return GraphCatalog.from_spec(SHARED_SPEC).bind(source)

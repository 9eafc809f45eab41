"""Sources: functions from (session, type, columns) to the rows of the type's table.

Rows need the type's subject and id columns and its fields' columns. Scans
select only the columns a query uses, and Catalyst pushes that and the filters
into Parquet and JDBC.
"""

from __future__ import annotations

from collections.abc import Iterable, Mapping
from typing import Any

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from sparkgraph.catalog import ResourceType, Source
from sparkgraph.functions.terms import SPARK_TYPES


def from_parquet(folder: str, suffix: str = ".parquet", format: str = "parquet") -> Source:
    """One file or folder a type, named by its table; any format of Spark's readers."""
    return lambda spark, type_, columns=None: spark.read.format(format).load(f"{folder}/{type_.table}{suffix}")


def from_tables(database: str = "") -> Source:
    """Tables or views of the session's catalogue."""
    return lambda spark, type_, columns=None: spark.table(f"{database}.{type_.table}" if database else type_.table)


def from_jdbc(url: str, properties: Mapping[str, str] | None = None, partitions: Mapping[str, tuple[str, int, int, int]] | None = None) -> Source:
    """Tables of a database.

    ``partitions`` may name, by table, a numeric column, its lower and upper
    bound and the number of parallel reads; without it a table is read by one.
    """

    def rows(spark: SparkSession, type_: ResourceType, columns: frozenset[str] | None = None) -> DataFrame:
        reader = spark.read.format("jdbc").options(**dict(properties or {})).option("url", url).option("dbtable", type_.table)
        if partitions and type_.table in partitions:
            column, low, high, count = partitions[type_.table]
            reader = reader.options(partitionColumn=column, lowerBound=low, upperBound=high, numPartitions=count)
        return reader.load()

    return rows


def from_dataframes(frames: Mapping[str, DataFrame]) -> Source:
    """Frames by table name."""
    return lambda spark, type_, columns=None: frames[type_.table]


def schema_of(type_: ResourceType) -> T.StructType:
    """The columns of a type's table: subject, id (where it is another) and fields."""
    ids = list(dict.fromkeys((type_.subject_column, type_.id_column)))
    kinds = {f.column: f"array<{SPARK_TYPES[f.kind]}>" if f.many else SPARK_TYPES[f.kind] for f in type_.fields}
    return T.StructType.fromDDL(", ".join([*(f"`{c}` string" for c in ids), *(f"`{c}` {k}" for c, k in kinds.items())]))


def from_records(records: Mapping[str, Iterable[Mapping[str, Any]]]) -> Source:
    """Rows held in memory, by table name; a column that a record lacks is null."""

    def rows(spark: SparkSession, type_: ResourceType, columns: frozenset[str] | None = None) -> DataFrame:
        schema = schema_of(type_)
        return spark.createDataFrame([tuple(r.get(c) for c in schema.names) for r in records.get(type_.table, ())], schema)

    return rows


def inverse_references(rows: DataFrame, id_column: str, array_column: str, out_column: str) -> DataFrame:
    """``rows`` with the inverse of an array of references: the least id of the rows that point to this one, or null.

    This materialises what an absence rewrite needs.
    """
    pointing = (
        rows.select(F.col(id_column).alias("__from"), F.explode(array_column).alias("__to"))
        .groupBy("__to")
        .agg(F.min("__from").alias(out_column))
    )
    return rows.drop(out_column).join(pointing, F.col(id_column) == F.col("__to"), "left").drop("__to")


def write_people(spark: SparkSession, path: str, n: int) -> None:
    """A table of ``n`` people (_subject, name, age) as Parquet, made in parallel."""
    i = F.col("id")
    spark.range(n).select(
        F.concat(F.lit("http://example.org/person/"), i.cast("string")).alias("_subject"),
        F.concat(F.lit("Person "), i.cast("string")).alias("name"),
        (18 + i % 70).cast("int").alias("age"),
    ).write.mode("overwrite").parquet(path)

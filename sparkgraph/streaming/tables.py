"""Streaming sources and the start of a continuous query."""

from __future__ import annotations

from collections.abc import Collection

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StreamingQuery

from sparkgraph.catalog import ResourceType, Source
from sparkgraph.sources.providers import schema_of


def from_parquet_stream(folder: str, growing: Collection[str], suffix: str = "") -> Source:
    """Like the Parquet source, but the tables named in ``growing`` are read as streams of the files that arrive."""

    def rows(spark: SparkSession, type_: ResourceType, columns: frozenset[str] | None = None) -> DataFrame:
        path = f"{folder}/{type_.table}{suffix}"
        if type_.table in growing:
            return spark.readStream.schema(schema_of(type_)).parquet(path)
        return spark.read.parquet(path)

    return rows


def start(df: DataFrame, path: str, checkpoint: str, format: str = "parquet") -> StreamingQuery:
    """Append the results of a continuous query to files, exactly once, until it is stopped or all input is read."""
    return df.writeStream.format(format).option("path", path).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()

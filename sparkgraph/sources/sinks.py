"""Sinks: results as tab-separated text or written tables."""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import DataFrame

from sparkgraph.functions.display import show_term


def tsv_lines(df: DataFrame, iris: frozenset[str] = frozenset()) -> Iterator[str]:
    """A header of variables, then a line a row, fetched one partition at a time; ``iris`` names the columns of IRIs."""
    yield "\t".join(f"?{c}" for c in df.columns)
    for row in df.toLocalIterator():
        yield "\t".join(show_term(v, c in iris) for c, v in zip(df.columns, row, strict=True))


def write(df: DataFrame, path: str, format: str = "parquet", mode: str = "errorifexists") -> None:
    """The result as files of any format that Spark writes."""
    df.write.format(format).mode(mode).save(path)

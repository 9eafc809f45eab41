"""Continuous queries over tables that grow.

Patterns are compiled to ordinary DataFrame operations, so a source may hand
out a streaming frame: scans, filters, array and field scans, inline rows and
joins with still tables run in Structured Streaming as they are. Sorting,
LIMIT and NOT EXISTS need the whole input and are refused by Spark there.
"""

from sparkgraph.streaming.tables import from_parquet_stream, start

__all__ = ["from_parquet_stream", "start"]

"""Where rows come from, and where results go."""

from sparkgraph.sources.providers import from_dataframes, from_jdbc, from_parquet, from_records, from_tables, inverse_references, write_people
from sparkgraph.sources.sinks import tsv_lines, write

__all__ = ["from_dataframes", "from_jdbc", "from_parquet", "from_records", "from_tables", "inverse_references", "tsv_lines", "write", "write_people"]

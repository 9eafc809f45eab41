"""``python -m sparkgraph FILE.rq --data DIR [--catalog SPEC.json] [--plan] [--explain] [--out PATH]``"""

from __future__ import annotations

import argparse
import sys
from pathlib import Path

from pyspark.sql import SparkSession

from sparkgraph.catalog import GraphCatalog
from sparkgraph.errors import GraphError
from sparkgraph.operators.bindings import Context
from sparkgraph.operators.joins import solve
from sparkgraph.plans.resolve import resolve
from sparkgraph.session import GraphSession
from sparkgraph.sources import from_jdbc, from_parquet, tsv_lines, write
from sparkgraph.sparql.parser import parse
from sparkgraph.tpch_graph import tpch_catalog


def main(argv: list[str] | None = None) -> int:
    parser = argparse.ArgumentParser(prog="sparkgraph", description="Run a SPARQL SELECT query over tables.")
    parser.add_argument("query", type=Path)
    parser.add_argument("--data", required=True, help="folder of Parquet tables, or a jdbc: URL")
    parser.add_argument("--catalog", type=Path, help="JSON description of the types; without it, the TPC-H-like catalogue")
    parser.add_argument("--plan", action="store_true", help="show the typed patterns only")
    parser.add_argument("--explain", action="store_true", help="show the physical plan only")
    parser.add_argument("--out", help="write the result as Parquet instead of printing it")
    args = parser.parse_args(argv)
    if args.catalog:
        source = from_jdbc(args.data) if args.data.startswith("jdbc:") else from_parquet(args.data)
        catalog = GraphCatalog.from_spec(args.catalog.read_text()).bind(source)
    else:
        catalog = tpch_catalog(args.data)
    text = args.query.read_text()
    try:
        query = parse(text)
        plan = resolve(query, catalog)
        if args.plan:
            print("\n".join(plan.lines()))
            return 0
        spark = SparkSession.builder.config("spark.sql.session.timeZone", "UTC").getOrCreate()
        session = GraphSession(spark, catalog)
        if args.explain:
            print(session.explain(text))
            return 0
        df = session.sparql(text)
    except GraphError as error:
        print(f"{type(error).__name__}: {error}", file=sys.stderr)
        return 2
    if args.out:
        write(df, args.out)
        return 0
    bindings = solve(Context(spark, catalog), plan).bindings if query.count is None else {}
    for line in tsv_lines(df, frozenset(v.name for v, b in bindings.items() if b.kind in ("res", "iri"))):
        print(line)
    return 0


if __name__ == "__main__":
    sys.exit(main())

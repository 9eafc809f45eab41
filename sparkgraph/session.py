"""The entry point: SPARQL text to lazy DataFrames."""

from __future__ import annotations

import contextlib
import io

from pyspark.sql import DataFrame, SparkSession

from sparkgraph.catalog import GraphCatalog
from sparkgraph.operators.bindings import Context
from sparkgraph.operators.joins import solve
from sparkgraph.operators.modifiers import finish
from sparkgraph.plans.resolve import Plan, resolve
from sparkgraph.sparql.parser import parse


class GraphSession:
    """Queries over the tables of a catalogue."""

    def __init__(self, spark: SparkSession, catalog: GraphCatalog):
        self.spark, self.catalog = spark, catalog

    def plan(self, text: str) -> Plan:
        """Parse, check and type a query; no Spark plan is made."""
        return resolve(parse(text), self.catalog)

    def sparql(self, text: str) -> DataFrame:
        """The result of a SELECT query, one column a variable (or the count).

        IRIs and literals of one type are plain columns; variables that may be
        either are structs of ``kind``, ``lex`` and ``dt``. Errors in the query
        are raised here, before any job.
        """
        query = parse(text)
        context = Context(self.spark, self.catalog)
        return finish(context, solve(context, resolve(query, self.catalog)), query)

    def explain(self, text: str) -> str:
        """The typed patterns and the physical plan."""
        out = io.StringIO()
        with contextlib.redirect_stdout(out):
            self.sparql(text).explain("formatted")
        return "\n".join([*self.plan(text).lines(), "", out.getvalue()])

"""Counting, projection, DISTINCT, ORDER BY, OFFSET and LIMIT."""

from __future__ import annotations

from itertools import groupby

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sparkgraph.functions.terms import order_keys
from sparkgraph.operators.bindings import Context, Solution, with_iri
from sparkgraph.sparql.ast import Query
from sparkgraph.terms import Var


def _slice(df: DataFrame, query: Query) -> DataFrame:
    if query.offset:
        df = df.offset(query.offset)
    return df if query.limit is None else df.limit(query.limit)


def _column(solution: Solution, var: Var) -> Column:
    b = solution.bindings[var]
    return F.col(b.iri if b.kind == "res" else b.column)


def finish(context: Context, solution: Solution, query: Query) -> DataFrame:
    """The result of a query: its variables in order, or the count. Unbound is null, and sorts first."""
    if query.count is not None:
        return _slice(solution.df.agg(F.count(F.lit(1)).alias(query.count)), query)
    columns = query.columns()
    ordered = [v for v, _ in query.order]
    for var in dict.fromkeys([*columns, *ordered]):
        solution = with_iri(context, solution, var)
    keys: list[tuple[Column, bool]] = []
    for var, descending in query.order:
        column = _column(solution, var)
        parts = order_keys(column) if solution.bindings[var].kind == "term" else [column]
        keys += [(part, descending) for part in parts]
    named = [_column(solution, v).alias(v.name) for v in columns]
    sort = [c.desc_nulls_last() if d else c.asc_nulls_first() for c, d in keys]
    if not query.distinct:
        df = solution.df.orderBy(*sort) if sort else solution.df
        return _slice(df, query).select(*named)
    if not keys or set(ordered) <= set(columns):
        # Distinct rows are sorted by columns that they have.
        places = {v: f"__c{i}" for i, v in enumerate(columns)}
        df = solution.df.select(*[_column(solution, v).alias(places[v]) for v in columns]).distinct()
        sort = []
        for var, descending in query.order:
            column = F.col(places[var])
            for part in order_keys(column) if solution.bindings[var].kind == "term" else [column]:
                sort.append(part.desc_nulls_last() if descending else part.asc_nulls_first())
        df = _slice(df.orderBy(*sort) if sort else df, query)
        return df.select(*[F.col(places[v]).alias(v.name) for v in columns])
    # Sort keys that are not shown: each distinct row stands where its first one stood.
    names = [f"__c{i}" for i in range(len(columns))]
    hidden = [f"__k{i}" for i in range(len(keys))]
    df = solution.df.select(*[_column(solution, v).alias(n) for v, n in zip(columns, names, strict=True)], *[k.alias(h) for (k, _), h in zip(keys, hidden, strict=True)])
    by = [F.col(h).desc_nulls_last() if d else F.col(h).asc_nulls_first() for h, (_, d) in zip(hidden, keys, strict=True)]
    df = _firsts(df, names, [(h, d) for h, (_, d) in zip(hidden, keys, strict=True)])
    return _slice(df.orderBy(*by), query).select(*[F.col(n).alias(v.name) for n, v in zip(names, columns, strict=True)])


def _firsts(df: DataFrame, names: list[str], keys: list[tuple[str, bool]]) -> DataFrame:
    """Of each group of rows equal in ``names`` the first one by ``keys`` (column, whether descending).

    Structs compare field by field with nulls lowest, so the first by keys of one
    direction is a minimum or maximum, which is added up before the shuffle. Where
    the direction changes, the rows that are first so far go on to the next keys.
    """
    runs = [(d, [h for h, _ in run]) for d, run in groupby(keys, key=lambda k: k[1])]
    for i, (descending, run) in enumerate(runs):
        done = [h for _, past in runs[:i] for h in past]
        best = (F.max if descending else F.min)(F.struct(*run)).alias("__best")
        firsts = df.groupBy(*names, *done).agg(best).select(*names, *done, *[F.col("__best")[h].alias(h) for h in run])
        if i == len(runs) - 1:
            return firsts
        fixed = [*names, *done, *run]
        first = firsts.select(*[F.col(c).alias(f"__f{j}") for j, c in enumerate(fixed)])
        same = [F.col(c).eqNullSafe(F.col(f"__f{j}")) for j, c in enumerate(fixed)]
        df = df.join(first, same, "left_semi")
    return df

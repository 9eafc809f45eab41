"""Joins of solutions, inline rows, and anti-joins for NOT EXISTS."""

from __future__ import annotations

from dataclasses import replace
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sparkgraph.functions.terms import DATATYPES, SPARK_TYPES, TERM, literal_kind
from sparkgraph.operators.bindings import Binding, Context, Solution, agree, as_term, fresh, needs_iri, with_iri
from sparkgraph.operators.scan import scan
from sparkgraph.plans.resolve import Plan
from sparkgraph.sparql.ast import Values
from sparkgraph.terms import XSD, Iri, Var


def inline(context: Context, values: Values) -> Solution:
    """The rows of VALUES; their number is that of the query's text, so they may be broadcast."""
    bindings: dict[Var, Binding] = {}
    columns = []
    fields, picked = [], []
    for i, var in enumerate(values.variables):
        terms = [row[i] for row in values.rows]
        given = [t for t in terms if t is not None]
        name, optional = fresh("i"), len(given) < len(terms)
        kinds = {None if isinstance(t, Iri) else literal_kind(t) for t in given}
        raw = f"c{i}"
        if kinds == {None}:
            fields.append(f"{raw} string")
            picked.append([t.value if isinstance(t, Iri) else None for t in terms])
            columns.append(F.col(raw).alias(name))
            bindings[var] = Binding("iri", name, inline=True, optional=optional)
        elif None not in kinds and len(kinds) <= 1:
            kind = next(iter(kinds), "string")
            fields.append(f"{raw} string")
            picked.append([t.lex if t is not None else None for t in terms])
            columns.append(F.col(raw).try_cast(SPARK_TYPES[kind]).alias(name))
            bindings[var] = Binding("val", name, kind, inline=True, optional=optional)
        else:
            fields.append(f"{raw} {TERM}")
            picked.append(
                [
                    None if t is None else ("iri", t.value, None) if isinstance(t, Iri) else ("literal", t.lex, DATATYPES.get(literal_kind(t), XSD + "string"))
                    for t in terms
                ]
            )
            columns.append(F.col(raw).alias(name))
            bindings[var] = Binding("term", name, inline=True, optional=optional)
    rows = [tuple(column[j] for column in picked) for j in range(len(values.rows))]
    if not values.variables:
        return Solution(context.spark.range(len(rows)).select(), {})
    return Solution(context.spark.createDataFrame(rows, ", ".join(fields)).select(*columns), bindings)


def _condition(context: Context, a: Solution, b: Solution, var: Var) -> tuple[Solution, Solution, Column]:
    x, y = a.bindings[var], b.bindings[var]
    if needs_iri(x, y):
        a = with_iri(context, a, var)
    if needs_iri(y, x):
        b = with_iri(context, b, var)
    x, y = a.bindings[var], b.bindings[var]
    equal = agree(x, y)
    for side in (x, y):
        if side.optional:
            equal = F.col(side.column).isNull() | equal
    return a, b, equal


#: A join on values is dealt to a part for so many bytes of the tables that it reads, and to so many parts at most.
PART_BYTES, MOST_PARTS = 128 << 10, 4096


def _bytes(df: DataFrame) -> int | None:
    """The size of the files that a frame reads; None where Spark does not know it before running. No job is started."""
    if df.isStreaming:
        return None
    leaves = df._jdf.queryExecution().analyzed().collectLeaves()
    sizes = [int(str(leaves.apply(i).stats().sizeInBytes())) for i in range(leaves.size())]
    return sum(sizes) if max(sizes, default=0) < 1 << 60 else None


def _dealt(context: Context, a: Solution, b: Solution, shared: list[Var]) -> tuple[DataFrame, DataFrame]:
    """The sides of a join; of a large one that compares literals only, the larger side first and both in more parts.

    A literal may stand in many rows of both sides, so that there are far more
    pairs than rows, and Spark, which packs parts by the bytes they read, would
    give one task the pairs of hundreds of values. A merge join holds the second
    side's rows of a value and goes through them for each row of the first: with
    the larger side first it holds less, and a file of the result, which then has
    few values, takes little space, since the first side's terms come in long
    runs and the others in short rounds. Floating numbers are left to Spark,
    which deals them by another form of the value.
    """
    pairs = [(a.bindings[v], b.bindings[v]) for v in shared]
    if not pairs or any(not x.kind == y.kind == "val" or x.value_kind != y.value_kind or x.value_kind in ("float", "double") or x.optional or y.optional for x, y in pairs):
        return a.df, b.df
    left, right = _bytes(a.df), _bytes(b.df)
    state = context.spark._jsparkSession.sessionState().conf()
    if left is None or right is None or min(left, right) <= state.autoBroadcastJoinThreshold():
        return a.df, b.df
    parts = min((left + right) // PART_BYTES, MOST_PARTS)
    if parts <= state.numShufflePartitions():
        return a.df, b.df
    one = a.df.repartition(parts, *(x.column for x, _ in pairs))
    other = b.df.repartition(parts, *(y.column for _, y in pairs))
    return (one, other) if left >= right else (other, one)


def join(context: Context, a: Solution, b: Solution, broadcast: bool = False) -> Solution:
    """All compatible pairs; a variable that an optional side leaves unbound takes the other's value."""
    shared = [v for v in a.bindings if v in b.bindings]
    conditions = []
    for var in shared:
        a, b, equal = _condition(context, a, b, var)
        conditions.append(equal)
    left, right = (a.df, F.broadcast(b.df)) if broadcast else _dealt(context, a, b, shared)
    df = left.join(right, reduce(Column.__and__, conditions), "inner") if conditions else left.crossJoin(right)
    bindings = {**b.bindings, **a.bindings}
    for var in shared:
        x, y = a.bindings[var], b.bindings[var]
        first, second = (x, y) if not x.optional else (y, x)
        if first.kind == second.kind == "res":
            df, first = _narrowed(context, df, first, second)
        if first.optional:  # both may be unbound
            name = fresh("v")
            same = x.kind == y.kind and x.value_kind == y.value_kind
            df = df.withColumn(name, F.coalesce(F.col(x.column), F.col(y.column)) if same else F.coalesce(as_term(x), as_term(y)))
            first = replace(x, column=name) if same else Binding("term", name, optional=True)
        bindings[var] = first
    return Solution(df, bindings).keep() if bindings else Solution(df, bindings)


def _narrowed(context: Context, df: DataFrame, a: Binding, b: Binding) -> tuple[DataFrame, Binding]:
    """Of two bindings of a resource that agree, one with the IRI if either has it, and with the types that both allow."""
    if b.iri and not a.iri:
        a, b = b, a
    if a.exact() or not b.sets:
        return df, a
    if b.exact():
        return df, replace(a, tag=b.tag, sets=b.sets)
    both = [(n, m, context.typed(tuple(t for t in types if t in other))) for n, types in a.sets for m, other in b.sets if set(types) & set(other)]
    if len(both) == 1:
        return df, replace(a, tag="", sets=(both[0][2],))
    tag = fresh("t")
    number = reduce(lambda made, one: made.when((a.number() == one[0]) & (b.number() == one[1]), one[2][0]), both, F.when(F.lit(False), F.lit(-1)))
    return df.withColumn(tag, number), replace(a, tag=tag, sets=tuple(dict.fromkeys(s for _, _, s in both)))


def _without(context: Context, outer: Solution, inner: Solution) -> Solution:
    """The rows of ``outer`` that agree with no row of ``inner``.

    What is unbound agrees with anything. Rows are parted by what they leave
    unbound, so that each part is an equi-join.
    """
    shared = [v for v in inner.bindings if v in outer.bindings]
    for var in shared:
        loose = inner.bindings[var]
        if loose.optional:
            rest = {v: b for v, b in inner.bindings.items() if v != var}
            bound = Solution(inner.df.where(F.col(loose.column).isNotNull()), {**rest, var: replace(loose, optional=False)})
            return _without(context, _without(context, outer, bound), Solution(inner.df.where(F.col(loose.column).isNull()), rest))
    for var in shared:
        loose = outer.bindings[var]
        if loose.optional:
            rest = {v: b for v, b in inner.bindings.items() if v != var}
            tight = {**outer.bindings, var: replace(loose, optional=False)}
            bound = _without(context, Solution(outer.df.where(F.col(loose.column).isNotNull()), tight), inner)
            free = _without(context, Solution(outer.df.where(F.col(loose.column).isNull()), outer.bindings), Solution(inner.df, rest))
            names = outer.df.columns
            return Solution(bound.df.select(*names).union(free.df.select(*names)), outer.bindings)
    if not shared:
        return Solution(outer.df.join(inner.df.limit(1), F.lit(True), "left_anti"), outer.bindings)
    conditions = []
    for var in shared:
        outer, inner, equal = _condition(context, outer, inner, var)
        conditions.append(equal)
    names = [c for v in shared for c in inner.bindings[v].columns()]
    found = inner.df.select(*names)
    return Solution(outer.df.join(found, reduce(Column.__and__, conditions), "left_anti"), outer.bindings)


def _merged(solutions: list[Solution], shared: list[list[Var]], outer: Solution) -> list[Solution]:
    """Solutions that only share the same one resource with the outside, united to one list of its keys (and types) each."""
    out: list[Solution] = []
    keys: dict[Var, list[Solution]] = {}
    for inner, names in zip(solutions, shared, strict=True):
        if len(names) == 1 and inner.bindings[names[0]].kind == outer.bindings[names[0]].kind == "res":
            keys.setdefault(names[0], []).append(inner)
        else:
            out.append(inner)
    for var, inners in keys.items():
        name, tag = fresh("k"), fresh("t")
        bindings = [s.bindings[var] for s in inners]
        sets = tuple(dict.fromkeys(s for b in bindings for s in b.sets))
        frames = [s.df.select(F.col(b.key).alias(name), *([b.number().alias(tag)] if len(sets) > 1 else [])) for s, b in zip(inners, bindings, strict=True)]
        out.append(Solution(reduce(DataFrame.union, frames), {var: Binding("res", key=name, tag=tag if len(sets) > 1 else "", sets=sets)}))
    return out


def solve(context: Context, plan: Plan) -> Solution:
    """All solutions of a plan, as a bag."""
    waiting = [scan(context, p) for p in plan.patterns]
    tests = [s for s in waiting if not s.bindings]
    waiting = [s for s in waiting if s.bindings]
    rows = inline(context, plan.values) if plan.values else None
    if waiting:
        done = waiting.pop(0)
    else:
        done, rows = rows or Solution(context.spark.range(1).select(), {}), None
    while waiting or rows:
        bound = set(done.bindings)
        near = next((s for s in waiting if bound & set(s.bindings)), None)
        if near is not None:
            waiting.remove(near)
            done = join(context, done, near)
        elif rows is not None and (bound & set(rows.bindings) or not waiting):
            done, rows = join(context, done, rows, broadcast=True), None
        else:
            done = join(context, done, waiting.pop(0))
    for test in tests:  # a pattern without variables is there or not
        done = Solution(done.df.join(test.df.limit(1), F.lit(True), "left_semi"), done.bindings)
    inner = [solve(context, p) for p in plan.absent]
    shared = [[v for v in s.bindings if v in done.bindings] for s in inner]
    for s in _merged(inner, shared, done):
        done = _without(context, done, s)
    return done

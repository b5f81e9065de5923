"""Operators as DataFrames: one nullable column for each variable, null for unbound.

Columns hold terms, or, as long as all sides agree, the keys and values of the tables that they come from.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field
from functools import reduce
from itertools import product

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import filters
from ..functions import values as V
from ..functions.values import Form, Value
from ..plans import planner as P
from ..plans import syntax as S
from ..sources.base import Source
from . import algebra as A


def one(spark: SparkSession) -> DataFrame:
    return spark.range(1).select()


def none(spark: SparkSession, names) -> DataFrame:
    names = list(names)
    return spark.createDataFrame([], ", ".join(f"`{n}` string" for n in names)) if names else spark.range(0).select()


def column(name: str) -> Column:
    return F.col(f"`{name}`")


@dataclass(frozen=True)
class Solutions:
    """Rows of bindings. ``forms``: the columns that hold keys or values instead of terms (see functions.values)."""

    df: DataFrame
    forms: dict[str, Form] = field(default_factory=dict)

    def values(self) -> dict[str, Value]:
        return {c: Value(column(c), self.forms.get(c)) for c in self.df.columns}

    def as_terms(self, names=None) -> Solutions:
        """The same with terms in these columns (by default in all)."""
        turned = {n for n in self.forms if names is None or n in names}
        if not turned:
            return self
        df = self.df.select(*((v.term.alias(c) if c in turned else column(c)) for c, v in self.values().items()))
        return Solutions(df, {n: f for n, f in self.forms.items() if n not in turned})


def agreed(left: Solutions, right: Solutions, joined: bool) -> tuple[Solutions, Solutions]:
    """Both with every shared column in one form; a column to join on must tell terms apart as they are."""
    unlike = []
    for n in left.df.columns:
        if n in right.df.columns:
            f, g = left.forms.get(n), right.forms.get(n)
            if f != g or (joined and f is not None and not f.one_to_one):
                unlike.append(n)
    return left.as_terms(unlike), right.as_terms(unlike)


# --- basic graph patterns


def natural(left: DataFrame, right: DataFrame, how: str = "inner") -> DataFrame:
    """Join on all shared columns, which are bound on both sides; without any, the product."""
    shared = [c for c in left.columns if c in right.columns]
    if shared:
        return left.join(right, shared, how)
    return left.crossJoin(right)


def of_plan(plan: P.Plan, read: Callable[[P.Unit], DataFrame], sent: dict[P.Plan, DataFrame] | None = None) -> DataFrame:
    """``sent``: the sides that are broadcast already; a set that filters several scans is one DataFrame, and one exchange."""
    sent = {} if sent is None else sent

    def small(p: P.Plan) -> DataFrame:
        if p not in sent:
            sent[p] = F.broadcast(of_plan(p, read, sent))
        return sent[p]

    match plan:
        case P.Scan(unit):
            return read(unit)
        case P.Star(parts):
            # one key, so Spark partitions every input once
            return reduce(natural, (of_plan(p, read, sent) for p in parts))
        case P.Joined(left, right, how):
            a = of_plan(left, read, sent)
            if how == "filter":
                # the set adds no variable and has no repeats (a graph is a set), so no row is multiplied
                return natural(a, small(right), "left_semi")
            return natural(a, small(right) if how == "broadcast" else of_plan(right, read, sent))
    raise TypeError(plan)


# --- joins of solutions that may leave variables unbound


def compatible(left: Solutions, right: Solutions, certain: frozenset[str], how: str, tests: Callable[[dict[str, Value]], list[Column]] | None = None) -> Solutions:
    """Join solutions that agree on every variable that both bind.

    ``certain`` are the variables that both sides always bind: they are the keys of the join. Others match if equal or if
    either is null, and the result takes the one that is bound. ``tests`` adds conditions over the merged columns.
    """
    a, b = agreed(left, right, True)
    forms = {**b.forms, **a.forms}
    shared = [c for c in a.df.columns if c in b.df.columns]
    rest = [c for c in b.df.columns if c not in shared]
    if tests is None and all(c in certain for c in shared):
        if shared:
            return Solutions(a.df.join(b.df, shared, how), forms)
        return Solutions(a.df.crossJoin(b.df) if how == "inner" else a.df.join(b.df, F.lit(True), how), forms)
    loose = [c for c in shared if c not in certain]
    if how == "inner" and tests is None and len(loose) == len(shared) <= 2:
        return Solutions(_by_bound(a.df, b.df, shared), forms)
    far = b.df.select(*(column(c).alias(f"{c} ") for c in b.df.columns))  # names that no variable can have
    conditions = []
    for c in shared:
        x, y = column(c), column(f"{c} ")
        conditions.append(x == y if c in certain else (x == y) | x.isNull() | y.isNull())
    merged = {c: F.coalesce(column(c), column(f"{c} ")) if c in shared else column(c) for c in a.df.columns} | {c: column(f"{c} ") for c in rest}
    conditions += tests({c: Value(v, forms.get(c)) for c, v in merged.items()}) if tests else []
    condition = reduce(lambda x, y: x & y, conditions) if conditions else F.lit(True)
    return Solutions(a.df.join(far, condition, how).select(*(v.alias(c) for c, v in merged.items())), forms)


def _by_bound(left: DataFrame, right: DataFrame, shared: list[str]) -> DataFrame:
    """Inner join on variables that either side may leave unbound: rows by which of them are bound, each kind on its own keys."""
    out = None
    rest = [c for c in right.columns if c not in shared]
    for mine in product((True, False), repeat=len(shared)):
        for theirs in product((True, False), repeat=len(shared)):
            a, b = left, right
            for c, x, y in zip(shared, mine, theirs):
                a = a.where(column(c).isNotNull() if x else column(c).isNull())
                b = b.where(column(c).isNotNull() if y else column(c).isNull())
            keys = [c for c, x, y in zip(shared, mine, theirs) if x and y]
            taken = [c for c, x, y in zip(shared, mine, theirs) if y and not x]  # bound on the right alone
            a, b = a.drop(*taken), b.drop(*(c for c in shared if c not in keys and c not in taken))
            part = (a.join(b, keys) if keys else a.crossJoin(b)).select(*map(column, [*left.columns, *rest]))
            out = part if out is None else out.unionByName(part)
    return out


# --- tests


def operand(atom: S.Atom, values: dict[str, Value]) -> Value:
    if isinstance(atom, S.Term):
        return V.constant(atom.text)
    return values.get(atom.name, Value(F.lit(None).cast("string")))


def test(t: S.Test, values: dict[str, Value]) -> Column:
    if isinstance(t, S.Regex):
        return V.matches(operand(t.operand, values), t.pattern, t.flags)
    return V.compare(t.op, operand(t.left, values), operand(t.right, values))


# --- the whole tree


class Lowering:
    def __init__(self, source: Source, order: Callable[[list[P.Unit]], P.Plan]):
        self.source, self.order = source, order
        self.plans: dict[A.Pattern, P.Plan] = {}

    def plan(self, pattern: A.Pattern) -> P.Plan:
        if pattern not in self.plans:
            self.plans[pattern] = self.order(self.source.units(pattern.triples))
        return self.plans[pattern]

    def lower(self, node: A.Node) -> Solutions:
        match node:
            case A.One():
                return Solutions(one(self.source.spark))
            case A.Pattern():
                plan = self.plan(node)
                if isinstance(plan, P.Nothing):
                    return Solutions(none(self.source.spark, node.possible))
                read, forms = self.source.reader(self.source.units(node.triples))
                return Solutions(of_plan(P.read_together(plan, self.source.together), read).select(*map(column, node.possible)), {n: f for n, f in forms.items() if n in node.possible})
            case A.Join(left, right):
                return compatible(self.lower(left), self.lower(right), left.certain & right.certain, "inner")
            case A.LeftJoin(left, right, tests):
                more = (lambda values: [F.coalesce(test(t, values), F.lit(False)) for t in tests]) if tests else None
                return compatible(self.lower(left), self.lower(right), left.certain & right.certain, "left", more)
            case A.Union(branches):

                def union(x: Solutions, y: Solutions) -> Solutions:
                    x, y = agreed(x, y, False)
                    return Solutions(x.df.unionByName(y.df, allowMissingColumns=True), {**x.forms, **y.forms})

                return reduce(union, map(self.lower, branches))
            case A.Select(child, tests):
                found = self.lower(child)
                df = found.df
                for t in tests:
                    df = df.where(test(t, found.values()))
                return Solutions(df, found.forms)
        raise TypeError(node)


def modifiers(found: Solutions, query: S.Query, visible: tuple[str, ...], lexical_order: bool = False) -> Solutions:
    """Projection, then DISTINCT, then ORDER BY. Keys that aren't selected may be sorted by, unless DISTINCT."""
    names = list(visible) if query.select is None else query.select
    if query.distinct:
        if hidden := [n for n, _ in query.order if n not in names]:
            raise S.SparqlError(f"ORDER BY ?{hidden[0]}, which DISTINCT drops")
        found = found.as_terms([n for n, f in found.forms.items() if not f.one_to_one])
    if lexical_order:
        found = found.as_terms([n for n, _ in query.order])
    absent = F.lit(None).cast("string")
    values = found.values()

    def key(name: str, ascending: bool) -> list[Column]:
        v = values.get(name, Value(absent))
        if v.form is None and not lexical_order:
            return filters.sort_keys(v.column, ascending)
        c = v.column if v.form is None else v.form.sort_key(v.column)
        return [c.asc_nulls_first() if ascending else c.desc_nulls_last()]

    keys = [k for name, ascending in query.order for k in key(name, ascending)]
    picked = [(column(n) if n in values else absent).alias(n) for n in names]
    df, forms = found.df, {n: f for n, f in found.forms.items() if n in names}
    if query.distinct:
        df = df.select(*picked).distinct()
        return Solutions(df.orderBy(*keys) if keys else df, forms)
    return Solutions((df.orderBy(*keys) if keys else df).select(*picked), forms)

"""Engine: SPARQL text in, DataFrame out."""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, SparkSession

from .functions import values as V
from .operators import algebra as A
from .operators.lower import Lowering, modifiers
from .plans import planner as P
from .plans import syntax as S
from .plans.statistics import Statistics
from .sources import DataFrameSource, MappedSource, Mapping, Source, Store, read_ntriples


def read_query(spark: SparkSession, path: str) -> str:
    """The text of a query file, from any file system that Spark reads."""
    rows = spark.read.text(path, wholetext=True).collect()  # one row for each file
    return "\n".join(r.value for r in rows)


class Engine:
    """Queries over one source.

    ``optimizer``: none, connected, stats or cost (see plans.planner). ``stat_limit``: for cost, how many of the listed terms of
    each column are used. ``decode``: variable to SQL type; the variable's column is its term's text, cast (null if it can't be).
    ``order``: 'value' sorts by SPARQL's rules, 'lexical' by the terms' strings. ``broadcast_bytes``: what the planner may
    broadcast, by a proven bound.
    """

    def __init__(self, source: Source, broadcast_bytes: int = P.BROADCAST_BYTES):
        self.source, self.spark, self.broadcast_bytes = source, source.spark, broadcast_bytes

    @classmethod
    def from_ntriples(cls, spark: SparkSession, path: str, dedup: bool = True, mode: str = "fail") -> Engine:
        """Query N-Triples files directly, without loading them."""
        return cls(DataFrameSource(read_ntriples(spark, path, mode), dedup, keep=True))

    @classmethod
    def from_dataframe(cls, triples: DataFrame, dedup: bool = True) -> Engine:
        return cls(DataFrameSource(triples, dedup))

    @classmethod
    def from_store(cls, spark: SparkSession, root: str) -> Engine:
        return cls(Store(spark, root))

    @classmethod
    def from_mapping(cls, tables: dict[str, Mapping]) -> Engine:
        return cls(MappedSource(tables))

    # --- queries

    def _lowering(self, optimizer: str, stat_limit: int | None) -> Lowering:
        if optimizer not in P.LEVELS:
            raise ValueError(f"optimizer is one of {', '.join(P.LEVELS)}")
        return Lowering(self.source, lambda units: P.plan(units, optimizer, lambda u: self._statistics(u, optimizer == "cost"), stat_limit, self.broadcast_bytes))

    def _statistics(self, units: list[P.Unit], full: bool) -> Statistics:
        """What is known of the predicates that the units read."""
        read = [u.predicates for u in units]
        return self.source.statistics(full, None if None in read else frozenset().union(*read))

    def sparql(self, text: str, optimizer: str = "connected", stat_limit: int | None = None, decode: dict[str, str] | None = None, order: str = "value") -> DataFrame:
        query = S.parse(text)
        tree = A.translate(query.where)
        found = modifiers(self._lowering(optimizer, stat_limit).lower(tree), query, tree.possible, order == "lexical")
        if not decode:
            return found.as_terms().df
        return found.df.select(*((V.decoded(v, decode[c]) if c in decode else v.term).alias(c) for c, v in found.values().items()))

    def sparql_file(self, path: str, **options) -> DataFrame:
        return self.sparql(read_query(self.spark, path), **options)

    # --- explanations

    def explain(self, text: str, mode: str = "text", optimizer: str = "connected", stat_limit: int | None = None) -> str:
        """The pattern as written, the order chosen for it (with bounds, where statistics give them), and Spark's plan.

        ``mode='json'`` gives the commands of the plan instead: {"commands": [...], "result": id}.
        """
        query = S.parse(text)
        tree = A.translate(query.where)
        lowering = self._lowering(optimizer, stat_limit)
        if mode == "json":
            return json.dumps(_Commands(lowering).query(query, tree), ensure_ascii=False)
        if mode != "text":
            raise ValueError("mode is text or json")
        df = modifiers(lowering.lower(tree), query, tree.possible).as_terms().df
        lines = ["-- as written", *_written(tree, 0), f"-- order ({optimizer})"]
        for pattern, plan in lowering.plans.items():
            stats = self._statistics(self.source.units(pattern.triples), True) if optimizer == "cost" else None
            lines += _ordered(plan, 0, stats)
        return "\n".join([*lines, "-- physical plan", df._sc._jvm.PythonSQLUtils.explainString(df._jdf.queryExecution(), "formatted")])


def _written(node: A.Node, depth: int) -> list[str]:
    pad = "  " * depth
    match node:
        case A.Pattern(triples):
            return [f"{pad}{t} ." for t in triples]
        case A.Join(left, right):
            return [f"{pad}JOIN", *_written(left, depth + 1), *_written(right, depth + 1)]
        case A.LeftJoin(left, right, tests):
            return [f"{pad}OPTIONAL", *_written(left, depth + 1), *_written(right, depth + 1), *(f"{pad}  ON {_test(t)}" for t in tests)]
        case A.Union(branches):
            return [f"{pad}UNION", *(x for b in branches for x in _written(b, depth + 1))]
        case A.Select(child, tests):
            return [f"{pad}FILTER {' AND '.join(map(_test, tests))}", *_written(child, depth + 1)]
    return [f"{pad}{{}}"]


def _test(t: S.Test) -> str:
    if isinstance(t, S.Regex):
        return f"REGEX({t.operand}, {json.dumps(t.pattern)}, {json.dumps(t.flags)})"
    return f"{t.left} {t.op} {t.right}"


def _ordered(plan: P.Plan, depth: int, stats) -> list[str]:
    pad = "  " * depth
    match plan:
        case P.Scan(unit):
            note = f"  # at most {min(stats.estimate(t).size for t in unit.triples)}" if stats else ""
            return [f"{pad}SCAN {unit}{note}"]
        case P.Star(parts, on):
            return [f"{pad}STAR {' '.join('?' + n for n in on)}", *(x for p in parts for x in _ordered(p, depth + 1, stats))]
        case P.Joined(left, right, how):
            return [f"{pad}{how.upper()} JOIN", *_ordered(left, depth + 1, stats), *_ordered(right, depth + 1, stats)]
    return [f"{pad}EMPTY"]


class _Commands:
    """The plan as a list of commands, each with an id that later ones refer to; equal commands are given once."""

    def __init__(self, lowering: Lowering):
        self.lowering, self.commands, self.known = lowering, [], {}

    def add(self, op: str, **args) -> int:
        seal = json.dumps([op, args], sort_keys=True)
        if seal not in self.known:
            self.known[seal] = len(self.commands)
            self.commands.append({"id": len(self.commands), "op": op, **args})
        return self.known[seal]

    def triple(self, t: S.Triple) -> int:
        constant = isinstance(t.p, S.Term)
        at = self.add("PRED", predicate=t.p.text, columns=["s", "o"]) if constant else self.add("ALL", columns=["s", "p", "o"])
        names: dict[str, str] = {}
        for place, atom in zip("spo", t.atoms):
            if constant and place == "p":
                continue
            if isinstance(atom, S.Term):
                at = self.add("FILTER", input=at, test={"op": "=", "column": place, "term": atom.text})
            elif atom.name in names.values():
                other = next(k for k, v in names.items() if v == atom.name)
                at = self.add("FILTER", input=at, test={"op": "=", "column": place, "other": other})
            else:
                names[place] = atom.name
        return self.add("SELECT", input=at, columns=names)

    def plan(self, plan: P.Plan) -> int:
        match plan:
            case P.Scan(unit):
                ids = [self.triple(t) for t in unit.triples]
                out = ids[0]
                for i in ids[1:]:
                    out = self.add("JOIN", inputs=[out, i], kind="same scan")
                return out
            case P.Nothing(names):
                return self.add("EMPTY", columns=sorted(names))
            case P.Star(parts, on):
                return self.add("JOIN", inputs=[self.plan(p) for p in parts], kind="star", on=list(on))
            case P.Joined(left, right, how):
                a, b = self.plan(left), self.plan(right)
                if how in ("broadcast", "filter"):
                    b = self.add("BROADCAST", input=b)
                    return self.add("FILTER" if how == "filter" else "MAP_BC", input=a, broadcast=b, on=sorted(plan.key))
                return self.add("JOIN", inputs=[a, b], kind=how, on=sorted(plan.key))
        raise TypeError(plan)

    def node(self, node: A.Node) -> int:
        match node:
            case A.Pattern():
                return self.add("SELECT", input=self.plan(self.lowering.plan(node)), columns={n: n for n in node.possible})
            case A.Join(left, right):
                return self.add("JOIN", inputs=[self.node(left), self.node(right)], kind="compatible", on=sorted(set(left.possible) & set(right.possible)))
            case A.LeftJoin(left, right, tests):
                return self.add("LEFTJOIN", inputs=[self.node(left), self.node(right)], on=sorted(set(left.possible) & set(right.possible)), tests=list(map(_test, tests)))
            case A.Union(branches):
                return self.add("UNION", inputs=[self.node(b) for b in branches])
            case A.Select(child, tests):
                return self.add("FILTER", input=self.node(child), tests=list(map(_test, tests)))
        return self.add("EMPTY", columns=[], rows=1)

    def query(self, query: S.Query, tree: A.Node) -> dict:
        at = self.add("SELECT", input=self.node(tree), columns={n: n for n in (tree.possible if query.select is None else query.select)})
        if query.distinct:
            at = self.add("DISTINCT", input=at)
        if query.order:
            at = self.add("ORDER", input=at, keys=[[n, "asc" if up else "desc"] for n, up in query.order])
        return {"commands": self.commands, "result": at}

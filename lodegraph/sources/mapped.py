"""Relational tables seen as a graph, without copying them.

A row is a subject ``<urn:r:table/key>`` of type ``<urn:c:table>``; a column ``c`` is the predicate ``<urn:p:c>``. A column that
refers to another table has that row as its object, and its value under ``<urn:p:c.value>``. Nulls make no triple.

Patterns about one subject are read in one scan of its table where keys are unique (every column then has one value), so a star
costs no join; constants are turned back into column values, which Spark pushes down to the files. Variables stay keys and
values of their columns (``functions.values``) where all their occurrences in a pattern agree.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence
from dataclasses import dataclass, field, replace
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import terms as T
from ..functions.values import WHOLE, Form, whole
from ..plans.planner import Unit
from ..plans.statistics import Statistics, coarse, full
from ..plans.syntax import Atom, Term, Triple, Var
from . import rowcounts
from .base import TRIPLES, Source, positions

ROW, CLASS, PREDICATE = "urn:r:", "urn:c:", "urn:p:"
_KINDS = {"string": "", "tinyint": "integer", "smallint": "integer", "int": "integer", "bigint": "integer", "float": "float", "double": "double", "boolean": "boolean", "date": "date"}


@dataclass
class Mapping:
    """A table, the columns that identify a row, and the columns that refer to other tables (column: table).

    ``unique``: no two rows have one key. If it isn't given, it is found out once, by a job over the keys, when a query first
    depends on it. Rows that share a key are one subject with the triples of all. ``hidden``: columns that are no predicates.
    """

    table: DataFrame
    key: Sequence[str]
    references: dict[str, str] = field(default_factory=dict)
    unique: bool | None = None
    hidden: Sequence[str] = ()

    def key_column(self) -> Column:
        if len(self.key) == 1:
            return F.col(self.key[0]).cast("string")

        def part(c: str) -> Column:
            """Parts can't run into each other: each begins with its length, and a null part is told from every text."""
            text = F.col(c).cast("string")
            return F.coalesce(F.concat(F.length(text).cast("string"), F.lit(":"), text), F.lit("-"))

        return F.md5(F.concat(*map(part, self.key)))

    def is_unique(self) -> bool:
        if self.unique is None:
            keys = self.table.groupBy(*(F.col(c).alias(f"k{i}") for i, c in enumerate(self.key))).agg(F.count(F.lit(1)).alias("n"))
            if len(self.key) == 1:
                keys = keys.where("k0 IS NOT NULL")
            self.unique = keys.where("n > 1").isEmpty()
        return self.unique


@dataclass(frozen=True)
class _Access:
    """How one predicate is read from one table."""

    table: str
    kind: str  # type, reference, value
    column: str = ""
    datatype: str = ""


class MappedSource(Source):
    def __init__(self, tables: dict[str, Mapping]):
        self.tables = tables
        self.spark = next(iter(tables.values())).table.sparkSession
        self.access: dict[str, list[_Access]] = {}
        for name, m in tables.items():
            self._add(T.RDF_TYPE, _Access(name, "type"))
            for column, kind in m.table.dtypes:
                datatype = T.TIMESTAMP if kind.startswith("timestamp") else T.XSD + "decimal" if kind.startswith("decimal") else _KINDS.get(kind)
                if datatype is None or column in m.hidden:
                    continue  # arrays and the like aren't terms
                if datatype and ":" not in datatype:
                    datatype = T.XSD + datatype
                value = _Access(name, "value", column, datatype)
                if column in m.references:
                    self._add(T.iri(PREDICATE + column), _Access(name, "reference", column))
                    self._add(T.iri(f"{PREDICATE}{column}.value"), value)
                else:
                    self._add(T.iri(PREDICATE + column), value)

    def _add(self, predicate: str, access: _Access) -> None:
        self.access.setdefault(predicate, []).append(access)

    # --- terms of a table's rows

    def _subject(self, table: str) -> Column:
        return T.to_iri(f"{ROW}{table}/", self.tables[table].key_column())

    def _object(self, a: _Access) -> Column:
        if a.kind == "type":
            return F.lit(T.iri(CLASS + a.table))
        if a.kind == "reference":
            return T.to_iri(f"{ROW}{self.tables[a.table].references[a.column]}/", F.col(a.column))
        return T.to_literal(F.col(a.column), a.datatype)

    def _with_subject(self, table: str, df: DataFrame) -> DataFrame:
        """Rows without a key are no subjects; several key columns always give one."""
        key = self.tables[table].key
        return df.where(F.col(key[0]).isNotNull()) if len(key) == 1 else df

    def _type(self, table: str, column: str) -> str:
        return dict(self.tables[table].table.dtypes)[column]

    def _value(self, table: str, column: str, text: str) -> Column:
        """The column equals the value with this text; false if no value has it."""
        if self._type(table, column) in WHOLE:
            number = whole(text)
            return F.lit(False) if number is None else F.col(column) == F.lit(number).cast("bigint")
        return F.col(column).cast("string") == text

    def _subject_is(self, table: str, term: str) -> Column:
        start = f"<{ROW}{table}/"
        if not term.startswith(start):
            return F.lit(False)
        key = self.tables[table].key
        return self._value(table, key[0], term[len(start) : -1]) if len(key) == 1 else self._subject(table) == term

    def _object_is(self, a: _Access, term: str) -> Column:
        if a.kind == "type":
            return F.lit(term == T.iri(CLASS + a.table))
        if a.kind == "reference":
            start = f"<{ROW}{self.tables[a.table].references[a.column]}/"
            return self._value(a.table, a.column, term[len(start) : -1]) if term.startswith(start) else F.lit(False)
        end = f'"^^<{a.datatype}>' if a.datatype else '"'
        if not (term.startswith('"') and term.endswith(end)):
            return F.lit(False)
        text = T.unescaped(term[1 : -len(end)])
        if not a.datatype:
            return F.col(a.column) == text if T.literal(text) == term else F.lit(False)
        return self._value(a.table, a.column, text)

    # --- scans

    def _union(self, frames: list[DataFrame], schema: str) -> DataFrame:
        return reduce(DataFrame.unionByName, frames) if frames else self.spark.createDataFrame([], schema)

    def scan(self, predicate: str) -> DataFrame:
        frames = []
        for a in self.access.get(predicate, ()):
            t = self._with_subject(a.table, self.tables[a.table].table)
            rows = (t.where(F.col(a.column).isNotNull()) if a.column else t).select(self._subject(a.table).alias("s"), self._object(a).alias("o"))
            frames.append(self._once(a.table, rows))
        return self._union(frames, "s string, o string")

    def _once(self, table: str, triples: DataFrame) -> DataFrame:
        """A graph is a set: rows that share a key may repeat a triple."""
        return triples if self.tables[table].is_unique() else triples.distinct()

    def _rows_of(self, table: str) -> DataFrame:
        """(s, p, o) of one table in one scan."""
        pairs = [F.struct(F.lit(p).alias("p"), self._object(a).alias("o")) for p, found in self.access.items() for a in found if a.table == table]
        rows = self._with_subject(table, self.tables[table].table).select(self._subject(table).alias("s"), F.explode(F.array(*pairs)).alias("x"))
        return self._once(table, rows.select("s", "x.p", "x.o").where("o IS NOT NULL"))

    def statistics(self, with_full: bool, predicates: frozenset[str] | None = None) -> Statistics:
        """Of the triples of these predicates alone, so only their columns are read."""
        if predicates is None:
            return super().statistics(with_full)
        known = self.__dict__.setdefault("_known", {})
        if (with_full, predicates) not in known:
            table = self.counted("full" if with_full else "coarse", self.stat_size, predicates)
            known[with_full, predicates] = Statistics.read(None if with_full else table, table if with_full else None)
        return known[with_full, predicates]

    def counted(self, kind: str, k: int, predicates: frozenset[str] | None = None) -> DataFrame:
        if self.is_set():
            return rowcounts.coarse(self, k, predicates) if kind == "coarse" else rowcounts.full(self, k, predicates)
        triples = self.scan_all() if predicates is None else self._union([self.scan(p).select("s", F.lit(p).alias("p"), "o") for p in sorted(predicates)], TRIPLES)
        return (coarse if kind == "coarse" else full)(triples, k)

    def is_apart(self) -> bool:
        """Whether rows of two tables, or two columns of a row, never make the same triple."""
        names = [*self.tables, *(r for m in self.tables.values() for r in m.references.values())]
        return not any("/" in n for n in names) and all(len({a.table for a in found}) == len(found) for found in self.access.values())

    def is_set(self) -> bool:
        """Whether every row is a subject of its own, with one object at most for each predicate: then no triple is repeated."""
        return self.is_apart() and all(m.is_unique() for m in self.tables.values())

    def dealt(self, size: int = 1 << 20) -> MappedSource:
        """The same rows in as many parts as tables have ``size`` bytes, for work that takes long for each row: files are read in few."""
        tables = {}
        for name, m in self.tables.items():
            n = -(-int(m.table._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()) // size)
            tables[name] = replace(m, table=m.table.repartition(n)) if 1 < n < 1 << 20 else m
        return MappedSource(tables)

    def plus(self, other: MappedSource) -> MappedSource:
        """The rows of both; tables of one name are alike, and may have the same rows."""
        tables = self.tables | other.tables
        for name in self.tables.keys() & other.tables.keys():
            a, b = self.tables[name], other.tables[name]
            if (list(a.key), a.references, set(a.hidden), a.table.dtypes) != (list(b.key), b.references, set(b.hidden), b.table.dtypes):
                raise ValueError(f"the two tables {name} differ in columns, key or references")
            tables[name] = Mapping(a.table.unionByName(b.table), a.key, a.references, False, a.hidden)
        return MappedSource(tables)

    def scan_all(self) -> DataFrame:
        return self._union([self._rows_of(t) for t in self.tables], TRIPLES)

    # --- stars

    def units(self, triples: Sequence[Triple]) -> list[Unit]:
        stars: dict[Atom, list[Triple]] = {}
        out: list[list[Triple]] = []
        for t in triples:
            if isinstance(t.p, Term):
                if t.s in stars:
                    stars[t.s].append(t)
                    continue
                stars[t.s] = [t]
                out.append(stars[t.s])
            else:
                out.append([t])
        found = []
        for x in out:
            whole_star = len(x) == 1 or all(self.tables[t].is_unique() for t, _ in self._tables_of(Unit(tuple(x))))
            found += [Unit(tuple(x))] if whole_star else [Unit((t,)) for t in x]
        return found

    def _tables_of(self, unit: Unit) -> list[tuple[str, list[tuple[Triple, _Access]]]]:
        """The tables whose rows can match a star, and how each of its patterns is read from them."""
        triples = unit.triples
        by_table: dict[str, list[tuple[Triple, _Access]]] = {}
        for t in triples:
            for a in self.access.get(t.p.text, ()):
                by_table.setdefault(a.table, []).append((t, a))
        out = []
        for table, pairs in by_table.items():
            elsewhere = isinstance(triples[0].s, Term) and not triples[0].s.text.startswith(f"<{ROW}{table}/")
            other_type = any(a.kind == "type" and isinstance(t.o, Term) and t.o.text != T.iri(CLASS + table) for t, a in pairs)
            if len(pairs) == len(triples) and not elsewhere and not other_type:
                out.append((table, pairs))
        return out

    def _key_form(self, table: str) -> Form | None:
        """What can stand for a table's rows: a key of one column, as a whole number or string."""
        m = self.tables.get(table)
        if m is None or len(m.key) != 1:
            return None
        kind = "bigint" if self._type(table, m.key[0]) in WHOLE else self._type(table, m.key[0])
        return Form(kind, f"{ROW}{table}/") if kind in ("bigint", "string") else None

    def _object_form(self, a: _Access) -> Form | None:
        if a.kind == "type":
            return None
        kind = self._type(a.table, a.column)
        if a.kind == "reference":
            form = self._key_form(self.tables[a.table].references[a.column])
            return form if form and form.sql == ("bigint" if kind in WHOLE else kind) else None
        form = Form(kind, datatype=a.datatype)
        return form if form.family else None  # the text of a float isn't the number that it is as a double

    def _forms(self, units: Sequence[Unit]) -> dict[str, Form]:
        """The variables that hold one form wherever they occur in the pattern."""
        seen: dict[str, set[Form | None]] = {}
        places: dict[str, int] = {}
        for unit in units:
            for t in unit.triples:
                for n in t.variables():
                    places[n] = places.get(n, 0) + (not isinstance(t.s, Var) or t.s.name != n)
            found = self._tables_of(unit) if unit.predicates is not None else []
            if not found:
                for n in unit.variables:
                    seen.setdefault(n, set()).add(None)
            for table, pairs in found:
                if isinstance(pairs[0][0].s, Var):
                    seen.setdefault(pairs[0][0].s.name, set()).add(self._key_form(table))
                for t, a in pairs:
                    if isinstance(t.o, Var):
                        seen.setdefault(t.o.name, set()).add(self._object_form(a))
        one = {n: next(iter(forms)) for n, forms in seen.items() if len(forms) == 1}
        return {n: f for n, f in one.items() if f is not None and (f.one_to_one or places[n] < 2)}

    def reader(self, units: Sequence[Unit]) -> tuple[Callable[[Unit], DataFrame], dict[str, Form]]:
        forms = self._forms(units)
        return (lambda unit: self.matches(unit, forms)), forms

    def matches(self, unit: Unit, forms: dict[str, Form] | None = None) -> DataFrame:
        """``forms``: variables to be given as keys or values (see _forms)."""
        triples = unit.triples
        if unit.predicates is None:
            return self._any_predicate(triples[0])
        names = list(dict.fromkeys(n for t in triples for n in t.variables()))
        frames = [self._star(table, pairs, names, forms or {}) for table, pairs in self._tables_of(unit)]
        return self._union(frames, ", ".join(f"`{n}` string" for n in names)) if names or frames else self.spark.range(0).select()

    def _star(self, table: str, pairs: list[tuple[Triple, _Access]], names: list[str], forms: dict[str, Form]) -> DataFrame:
        df = self.tables[table].table
        subject = pairs[0][0].s
        bound: dict[str, Column] = {}

        def raw(name: str, column: str) -> Column:
            return F.col(column) if forms[name].start is None else F.col(column).cast(forms[name].sql)

        if isinstance(subject, Term):
            df = df.where(self._subject_is(table, subject.text))
        else:
            bound[subject.name] = raw(subject.name, self.tables[table].key[0]) if subject.name in forms else self._subject(table)
        df = self._with_subject(table, df)
        for t, a in pairs:
            if isinstance(t.o, Term):
                df = df.where(self._object_is(a, t.o.text))
                continue
            if a.column:
                df = df.where(F.col(a.column).isNotNull())
            value = raw(t.o.name, a.column) if t.o.name in forms else self._object(a)
            if t.o.name in bound:
                df = df.where(bound[t.o.name] == value)
            else:
                bound[t.o.name] = value
        return self._once(table, df.select(*(bound[n].alias(n) for n in names)))

    def _any_predicate(self, t: Triple) -> DataFrame:
        tables = list(self.tables)
        if isinstance(t.s, Term):  # a subject names its table
            tables = [x for x in tables if t.s.text.startswith(f"<{ROW}{x}/")]
        frames = []
        for table in tables:
            rows = self._with_subject(table, self.tables[table].table)
            if isinstance(t.s, Term):
                rows = rows.where(self._subject_is(table, t.s.text))
            pairs = [F.struct(F.lit(p).alias("p"), self._object(a).alias("o")) for p, found in self.access.items() for a in found if a.table == table]
            triples = self._once(table, rows.select(self._subject(table).alias("s"), F.explode(F.array(*pairs)).alias("x")).select("s", "x.p", "x.o").where("o IS NOT NULL"))
            tests, names = positions(t.atoms, [F.col(c) for c in "spo"])
            for test in tests:
                triples = triples.where(test)
            frames.append(triples.select(*(c.alias(n) for n, c in names.items())))
        return self._union(frames, ", ".join(f"`{n}` string" for n in t.variables()))

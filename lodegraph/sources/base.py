"""The interface of sources, and the source over a DataFrame of triples."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.values import Form
from ..plans.planner import Unit
from ..plans.statistics import Statistics, coarse, full
from ..plans.syntax import Atom, Term, Triple

TRIPLES = "s string, p string, o string"


def positions(atoms: Sequence[Atom], columns: Sequence[Column]) -> tuple[list[Column], dict[str, Column]]:
    """Conditions for constants and repeated variables, and the column of each variable."""
    tests, names = [], {}
    for atom, column in zip(atoms, columns):
        if isinstance(atom, Term):
            tests.append(column == F.lit(atom.text))
        elif atom.name in names:
            tests.append(column == names[atom.name])
        else:
            names[atom.name] = column
    return tests, names


def select_matches(df: DataFrame, atoms: Sequence[Atom], columns: Sequence[Column]) -> DataFrame:
    tests, names = positions(atoms, columns)
    for t in tests:
        df = df.where(t)
    return df.select(*(c.alias(n) for n, c in names.items()))


class Source:
    """Triples by predicate. ``stat_size`` is the number of terms listed by statistics that are made on demand."""

    spark: SparkSession
    stat_size = 50
    _known: dict[bool, Statistics]

    def scan(self, predicate: str) -> DataFrame:
        """(s, o) of one predicate; empty if it is unknown."""
        raise NotImplementedError

    def scan_all(self) -> DataFrame:
        """(s, p, o)."""
        raise NotImplementedError

    def counted(self, kind: str, k: int, predicates: frozenset[str] | None = None) -> DataFrame:
        """The table of statistics ('coarse' or 'full') of at least these predicates (None: of all)."""
        return (coarse if kind == "coarse" else full)(self.scan_all(), k)

    def statistics(self, with_full: bool, predicates: frozenset[str] | None = None) -> Statistics:
        """Coarse or full statistics of at least these predicates (None: of all), made by a job the first time."""
        known = self.__dict__.setdefault("_known", {})
        if with_full not in known:
            table = self.counted("full" if with_full else "coarse", self.stat_size)
            known[with_full] = Statistics.read(None if with_full else table, table if with_full else None, self.scan_all().count() if with_full else 0)
        return known[with_full]

    def units(self, triples: Sequence[Triple]) -> list[Unit]:
        """The pattern cut into what is read at once."""
        return [Unit((t,)) for t in triples]

    def together(self, unit: Unit, other: Unit) -> bool:
        """Whether two units that are joined can be read as one."""
        return False

    def reader(self, units: Sequence[Unit]) -> tuple[Callable[[Unit], DataFrame], dict[str, Form]]:
        """How to read the units of one pattern, and the variables whose columns don't hold terms, with what they hold."""
        return self.matches, {}

    def matches(self, unit: Unit) -> DataFrame:
        """One column for each variable of the unit."""
        (t,) = unit.triples
        if isinstance(t.p, Term):
            return select_matches(self.scan(t.p.text), (t.s, t.o), (F.col("s"), F.col("o")))
        return select_matches(self.scan_all(), t.atoms, (F.col("s"), F.col("p"), F.col("o")))


class DataFrameSource(Source):
    """Triples of a DataFrame (s, p, o). A graph is a set: ``dedup`` drops repeats.

    ``keep``: the triples take long to read, so those of a pattern's predicates are read once, for all its parts, and kept by Spark.
    """

    def __init__(self, triples: DataFrame, dedup: bool = True, keep: bool = False):
        self.spark, self._keep = triples.sparkSession, keep
        self._kept: dict[frozenset[str], DataFrameSource] = {}
        triples = triples.select("s", "p", "o").where("s IS NOT NULL AND p IS NOT NULL AND o IS NOT NULL")
        self.triples = triples.dropDuplicates() if dedup else triples
        self._raw, self._dedup = triples, dedup

    def scan(self, predicate: str) -> DataFrame:
        # repeats are dropped within the predicate, so that only its triples are shuffled
        rows = self._raw.where(F.col("p") == predicate).select("s", "o")
        return rows.dropDuplicates() if self._dedup else rows

    def scan_all(self) -> DataFrame:
        return self.triples

    def reader(self, units: Sequence[Unit]) -> tuple[Callable[[Unit], DataFrame], dict[str, Form]]:
        read = [t.p for u in units for t in u.triples]
        if not self._keep or len(read) < 2 or not all(isinstance(p, Term) for p in read):
            return super().reader(units)
        names = frozenset(p.text for p in read)
        found = next((kept for known, kept in self._kept.items() if names <= known), None)
        if found is None:
            rows = self._raw.where(F.col("p").isin(*names))
            found = self._kept[names] = DataFrameSource((rows.dropDuplicates() if self._dedup else rows).persist(), dedup=False)
        return found.reader(units)

    def cache(self) -> DataFrameSource:
        """Keep the triples for several queries."""
        kept = DataFrameSource(self.triples.cache(), dedup=False)
        kept.stat_size = self.stat_size
        return kept

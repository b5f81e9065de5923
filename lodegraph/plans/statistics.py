"""Statistics of a graph: Spark jobs that make them, and the small tables that the planner reads.

Coarse: the k commonest terms of each position (s, p, o) of all triples. Full: the k commonest subjects and objects of each
predicate, with the number of other values, the rows they hold, and the bytes of the longest term. Ties go to the lesser term.
The last listed count bounds every term that isn't listed.
"""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .cardinality import Column, Estimate
from .syntax import Term, Triple, Var

COARSE = "pos string, term string, cnt long, is_tail boolean"
FULL = "p string, pos int, term string, cnt long, rank int, n_values long, n_rows long, width int"
ANY = 1 << 62  # triples of a graph that weren't counted


def coarse(triples: DataFrame, k: int) -> DataFrame:
    """pos ('s', 'p', 'o'), term, cnt, is_tail (the k-th, which bounds the rest)."""
    counted = triples.select(F.explode(F.array(*(F.struct(F.lit(c).alias("pos"), F.col(c).alias("term")) for c in "spo"))).alias("x")).select("x.*").groupBy("pos", "term").agg(F.count(F.lit(1)).alias("cnt"))
    rank = F.row_number().over(Window.partitionBy("pos").orderBy(F.desc("cnt"), "term"))
    return counted.withColumn("rank", rank).where(F.col("rank") <= k).select("pos", "term", "cnt", (F.col("rank") == k).alias("is_tail"))


def full(triples: DataFrame, k: int) -> DataFrame:
    """For each predicate and pos (0 subject, 1 object) the k commonest terms with their rank, the numbers of values and rows, and the width."""
    terms = F.array(F.struct(F.lit(0).alias("pos"), F.col("s").alias("term")), F.struct(F.lit(1).alias("pos"), F.col("o").alias("term")))
    return listed(triples.select("p", F.explode(terms).alias("x")).select("p", "x.*").groupBy("p", "pos", "term").agg(F.count(F.lit(1)).alias("cnt")), k)


def listed(counted: DataFrame, k: int) -> DataFrame:
    """Full statistics of (p, pos, term, cnt), one row for each term of a predicate's column."""
    totals = counted.groupBy("p", "pos").agg(F.count(F.lit(1)).alias("n_values"), F.sum("cnt").alias("n_rows"), F.max(F.octet_length("term")).alias("width"))
    rank = F.row_number().over(Window.partitionBy("p", "pos").orderBy(F.desc("cnt"), "term"))
    top = counted.withColumn("rank", rank).where(F.col("rank") <= k)  # the filter on the rank is pushed into the window
    return top.join(totals, ["p", "pos"]).select("p", "pos", "term", "cnt", "rank", "n_values", "n_rows", "width")


@dataclass
class Statistics:
    """What the planner knows. ``terms`` has the coarse counts by position, ``predicates`` the summaries of both columns."""

    terms: dict[str, dict[str, int]] = field(default_factory=dict)
    tails: dict[str, int] = field(default_factory=dict)
    predicates: dict[str, tuple[Column, Column]] = field(default_factory=dict)
    total: int = 0
    full: bool = False

    @classmethod
    def read(cls, coarse_table: DataFrame | None, full_table: DataFrame | None, total: int = ANY) -> Statistics:
        """The tables hold at most k rows for a position, or for a predicate's column. ``total``: of all triples, if known."""
        out = cls(total=total)
        if coarse_table is not None:
            for r in coarse_table.collect():
                out.terms.setdefault(r.pos, {})[r.term] = r.cnt
                if r.is_tail:
                    out.tails[r.pos] = r.cnt
        if full_table is not None:
            out.full = True
            parts: dict[tuple[str, int], list] = {}
            for r in full_table.collect():
                parts.setdefault((r.p, r.pos), []).append(r)
            both: dict[str, dict[int, Column]] = {}
            for (p, pos), rows in parts.items():
                listed = {r.term: r.cnt for r in rows}
                others = rows[0].n_values - len(rows)
                both.setdefault(p, {})[pos] = Column(listed, others, min(listed.values()) if others else 0, rows[0].n_rows - sum(listed.values()), rows[0].width)
            out.predicates = {p: (c[0], c[1]) for p, c in both.items()}
        return out

    def limited(self, k: int | None) -> Statistics:
        if k is None:
            return self
        kept = {p: (s.limited(k), o.limited(k)) for p, (s, o) in self.predicates.items()}
        return Statistics(self.terms, self.tails, kept, self.total, self.full)

    def constant(self, pos: str, term: str) -> int:
        """Bound on the triples with this term there; a list that isn't full holds every term."""
        return self.terms.get(pos, {}).get(term, self.tails.get(pos, 0))

    def estimate(self, t: Triple) -> Estimate:
        """Bound on the matches of one pattern (needs full statistics)."""
        if isinstance(t.p, Var):
            names = t.variables()
            size = self.total
            if not names:
                return Estimate(1, {})
            return Estimate(size, {n: Column({}, size, size, size) for n in names})  # of any width
        if t.p.text not in self.predicates:
            return Estimate(0, {n: Column() for n in t.variables()})
        s, o = self.predicates[t.p.text]
        rows = sum(s.listed.values()) + s.tot_other
        fixed = [c.count(a.text) for c, a in ((s, t.s), (o, t.o)) if isinstance(a, Term)]
        if len(fixed) == 2:
            return Estimate(min(1, *fixed), {})
        if fixed:
            free, column = t.variables()[0], s if isinstance(t.s, Var) else o
            return Estimate(fixed[0], {free: Column({}, fixed[0], min(1, fixed[0]), fixed[0], column.width)})  # a graph is a set
        if t.s == t.o:
            n = min(rows, s.n_other + len(s.listed), o.n_other + len(o.listed))
            return Estimate(n, {t.s.name: Column({}, n, min(1, n), n, s.width)})
        return Estimate(rows, {t.s.name: s, t.o.name: o})

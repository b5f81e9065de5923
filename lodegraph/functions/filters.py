"""FILTER tests: numbers, simple strings and times compare by value; other terms are only equal to themselves.

A test that has no meaning for its operands is null, and a row stays only where the test is true.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from . import terms as T


def _comparable(a: Column, b: Column, test) -> list[tuple[Column, Column]]:
    """(condition, result) by kind of value; exact numbers before doubles."""
    kinds = [(T.exact(a), T.exact(b)), (T.numeric(a), T.numeric(b)), (T.simple(a), T.simple(b)), (T.instant(a), T.instant(b))]
    return [(x.isNotNull() & y.isNotNull(), test(x, y)) for x, y in kinds]


def _cases(pairs: list[tuple[Column, Column]], otherwise: Column) -> Column:
    out = None
    for condition, result in pairs:
        out = F.when(condition, result) if out is None else out.when(condition, result)
    return out.otherwise(otherwise)


def equal(a: Column, b: Column) -> Column:
    same = a == b
    both_literals = T.is_literal(a) & T.is_literal(b)
    known = T.NUMERIC + T.TIMES + T.SIMPLE
    # unlike literals of a datatype without known values can't be told apart; an IRI or a plain language literal can
    unknown = both_literals & ~(T.datatype(a).isin(*known) & T.datatype(b).isin(*known))
    return F.when(same, F.lit(True)).otherwise(_cases(_comparable(a, b, lambda x, y: x == y), F.when(unknown, F.lit(None).cast("boolean")).otherwise(F.lit(False))))


def less(a: Column, b: Column) -> Column:
    return _cases(_comparable(a, b, lambda x, y: x < y), F.lit(None).cast("boolean"))


def less_or_equal(a: Column, b: Column) -> Column:
    return _cases(_comparable(a, b, lambda x, y: x <= y), F.lit(None).cast("boolean"))


def compare(op: str, a: Column, b: Column) -> Column:
    """Null where an operand is unbound."""
    return F.when(a.isNotNull() & b.isNotNull(), _compare(op, a, b))


def _compare(op: str, a: Column, b: Column) -> Column:
    match op:
        case "=":
            return equal(a, b)
        case "!=":
            return ~equal(a, b)
        case "<":
            return less(a, b)
        case ">":
            return less(b, a)
        case "<=":
            return less_or_equal(a, b)
        case ">=":
            return less_or_equal(b, a)
    raise ValueError(op)


def inline(pattern: str, flags: str) -> str:
    """The pattern with its flags inside."""
    known = "".join(f for f in "ismx" if f in flags)
    return (f"(?{known})" if known else "") + pattern


def matches(a: Column, pattern: str, flags: str = "") -> Column:
    """REGEX: whether the pattern is found in a literal's text; null for other terms."""
    return F.when(T.is_literal(a), T.lexical(a).rlike(inline(pattern, flags)))


def sort_keys(c: Column, ascending: bool = True) -> list[Column]:
    """ORDER BY: unbound, blank nodes, IRIs, literals; among literals numbers by value, then times, then others by text."""
    rank = F.when(c.isNull(), 0).when(T.is_blank(c), 1).when(T.is_iri(c), 2).otherwise(3)
    kind = F.when(T.numeric(c).isNotNull(), 0).when(T.instant(c).isNotNull(), 1).otherwise(2)
    keys = [rank, F.when(rank == 3, kind), T.numeric(c), T.exact(c), T.instant(c), T.lexical(c), c]
    return [k.asc_nulls_first() if ascending else k.desc_nulls_last() for k in keys]

"""Variables whose columns hold keys or values of tables instead of terms.

A source that reads tables leaves a variable in the table's own type as long as all its occurrences agree on it: then joins
compare keys, FILTER compares values (and Spark pushes the test down to the files), ORDER BY sorts values, and terms are made at
the end. What has no direct form here is done on terms, by ``functions.filters``.
"""

from __future__ import annotations

import re
from dataclasses import dataclass
from decimal import Decimal

from pyspark.sql import Column
from pyspark.sql import functions as F

from . import filters
from . import terms as T

WHOLE = ("tinyint", "smallint", "int", "bigint")
_INTEGER, _DECIMAL, _DOUBLE = (re.compile(x) for x in (r"[+-]?[0-9]{1,18}", r"[+-]?[0-9]{1,18}(\.[0-9]{1,9})?", r"[+-]?[0-9]{1,300}(\.[0-9]+)?([eE][+-]?[0-9]{1,2})?"))
_TIME = re.compile(r"[0-9]{4}-[0-9]{2}-[0-9]{2}([ T][0-9]{2}:[0-9]{2}:[0-9]{2}(\.[0-9]{1,6})?)?")


@dataclass(frozen=True)
class Form:
    """What a column holds: keys of a table's rows (``start`` is the beginning of their IRIs), or values of a datatype."""

    sql: str
    start: str | None = None
    datatype: str = ""

    @property
    def family(self) -> str | None:
        if self.start is not None:
            return None
        if self.sql in WHOLE or self.sql.startswith("decimal"):
            return "exact"
        return {"double": "double", "string": "string", "date": "time", "timestamp": "time", "timestamp_ntz": "time"}.get(self.sql)

    @property
    def one_to_one(self) -> bool:
        """Whether columns are equal just where the terms are the same; 0.0 and -0.0 are two terms."""
        return self.sql != "double"

    def term(self, c: Column) -> Column:
        return T.to_literal(c, self.datatype) if self.start is None else T.to_iri(self.start, c)

    def text(self, c: Column) -> Column:
        return c.cast("string") if self.start is None else F.concat(F.lit(self.start), c.cast("string"))

    def sort_key(self, c: Column) -> Column:
        """Sorts like the terms do by value."""
        return c if self.start is None else c.cast("string")


@dataclass(frozen=True)
class Value:
    """An operand: a column of terms (``form`` None) or of a form, or a constant term."""

    column: Column
    form: Form | None = None
    constant: str | None = None

    @property
    def term(self) -> Column:
        return self.column if self.form is None else self.form.term(self.column)


def constant(term: str) -> Value:
    return Value(F.lit(term), None, term)


def whole(text: str) -> int | None:
    """The number that a bigint column writes like this."""
    digits = text.removeprefix("-")
    if digits.isascii() and digits.isdigit() and str(int(text)) == text and -(1 << 63) <= int(text) < 1 << 63:
        return int(text)
    return None


def _parts(term: str) -> tuple[str, str] | None:
    """Text and datatype of a literal without a language."""
    m = re.fullmatch(r'"(.*)"(?:\^\^<([^<>"]*)>)?', term, re.S)
    return None if m is None else (T.unescaped(m[1]), m[2] or "")


def _literal(term: str, form: Form) -> tuple[str, Column] | None:
    """The family of a constant and its column, where they can be compared with ``form`` directly."""
    if (parts := _parts(term)) is None:
        return None
    text, datatype = parts
    if form.family == "string" and datatype in T.SIMPLE:
        return "string", F.lit(text)
    if form.family == "time" and datatype in T.TIMES and _TIME.fullmatch(text):
        return "time", F.lit(text).cast("date" if form.sql == "date" and len(text) == 10 else "timestamp_ntz")
    if form.family not in ("exact", "double") or datatype not in T.NUMERIC:
        return None
    if datatype.endswith(("double", "float")):
        return ("double", F.lit(float(text))) if _DOUBLE.fullmatch(text) else None
    if form.family == "double":
        return ("double", F.lit(float(text))) if _DECIMAL.fullmatch(text) else None
    if _INTEGER.fullmatch(text):
        return "exact", F.lit(int(text)).cast("bigint")
    return ("exact", F.lit(Decimal(text))) if _DECIMAL.fullmatch(text) else None


def _row(op: str, a: Value, b: Value) -> Column | None:
    """Rows of a table against an IRI."""
    if op not in ("=", "!=") or not b.constant.startswith("<"):
        return None
    start, key = "<" + a.form.start, None
    if b.constant.startswith(start):
        key = b.constant[len(start) : -1]
        key = whole(key) if a.form.sql in WHOLE else key
    if key is None:
        return F.when(a.column.isNotNull(), F.lit(op == "!="))
    return a.column == F.lit(key) if op == "=" else a.column != F.lit(key)


_TESTS = {"=": Column.__eq__, "!=": Column.__ne__, "<": Column.__lt__, ">": Column.__gt__, "<=": Column.__le__, ">=": Column.__ge__}
_TURNED = {"=": "=", "!=": "!=", "<": ">", ">": "<", "<=": ">=", ">=": "<="}


def _direct(op: str, a: Value, b: Value) -> Column | None:
    if a.form is None:
        return None if b.form is None else _direct(_TURNED[op], b, a)
    if b.constant is not None:
        if a.form.start is not None:
            return _row(op, a, b)
        if (found := _literal(b.constant, a.form)) is None:
            return None
        family, right = found
    elif b.form is None:
        return None
    elif a.form == b.form and a.form.start is not None:
        return _TESTS[op](a.column, b.column) if op in ("=", "!=") else None
    else:
        family, right = b.form.family, b.column
    numbers = {"exact", "double"}
    if a.form.family is None or family is None or (a.form.family != family and not {a.form.family, family} <= numbers):
        return None
    left = a.column
    if family != a.form.family:  # an exact number and a double
        left, right = left.cast("double"), right.cast("double")
    elif family == "time" and (b.form is None or b.form.sql != a.form.sql) and not (a.form.sql == "date" and b.constant is not None and _parts(b.constant)[0].count(":") == 0):
        left, right = left.cast("timestamp_ntz"), right.cast("timestamp_ntz")
    return _TESTS[op](left, right)


def compare(op: str, a: Value, b: Value) -> Column:
    found = _direct(op, a, b)
    return filters.compare(op, a.term, b.term) if found is None else found


def matches(a: Value, pattern: str, flags: str = "") -> Column:
    if a.form is not None and a.form.family == "string":
        return a.column.rlike(filters.inline(pattern, flags))
    return filters.matches(a.term, pattern, flags)


def decoded(a: Value, kind: str) -> Column:
    """The term's text, cast; null if it can't be."""
    if a.form is None:
        return T.lexical(a.column).try_cast(kind)
    same = a.form.sql == kind or (a.form.sql in WHOLE and kind in (*WHOLE, "double"))
    return a.column.try_cast(kind) if same and a.form.start is None else a.form.text(a.column).try_cast(kind)

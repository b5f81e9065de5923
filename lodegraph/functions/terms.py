"""RDF terms are strings in N-Triples syntax: ``<iri>``, ``_:label``, ``"text"``, ``"text"@lang``, ``"text"^^<datatype>``.

Two terms are the same if their strings are; so strings are kept in one canonical form, in which only the backslash, the double
quote, line feed and carriage return are escaped.
"""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

XSD = "http://www.w3.org/2001/XMLSchema#"
RDF_TYPE = "<http://www.w3.org/1999/02/22-rdf-syntax-ns#type>"
TIMESTAMP = "urn:dt:timestamp"
NUMERIC = tuple(XSD + x for x in ("integer", "decimal", "double", "float", "int", "long", "short", "byte", "nonNegativeInteger", "positiveInteger", "nonPositiveInteger", "negativeInteger", "unsignedInt", "unsignedLong", "unsignedShort", "unsignedByte"))
SIMPLE = ("", XSD + "string")
TIMES = (XSD + "dateTime", XSD + "date", TIMESTAMP)

_ESCAPES = {"t": "\t", "b": "\b", "n": "\n", "r": "\r", "f": "\f", '"': '"', "'": "'", "\\": "\\"}
_ESCAPE = re.compile(r"\\(?:u([0-9A-Fa-f]{4})|U([0-9A-Fa-f]{8})|(.))", re.S)


# --- on the driver -------------------------------------------------------------------------------------------------------------


def escaped(text: str) -> str:
    return text.replace("\\", "\\\\").replace('"', '\\"').replace("\n", "\\n").replace("\r", "\\r")


def unescaped(text: str) -> str:
    return _ESCAPE.sub(lambda m: chr(int(m[1] or m[2], 16)) if m[3] is None else _ESCAPES.get(m[3], m[0]), text)


def iri(text: str) -> str:
    return f"<{text}>"


def literal(text: str, datatype: str | None = None, lang: str | None = None) -> str:
    tail = f"@{lang.lower()}" if lang else f"^^<{datatype}>" if datatype and datatype != XSD + "string" else ""
    return f'"{escaped(text)}"{tail}'


# --- on columns ----------------------------------------------------------------------------------------------------------------


def is_iri(c: Column) -> Column:
    return c.startswith("<")


def is_blank(c: Column) -> Column:
    return c.startswith("_:")


def is_literal(c: Column) -> Column:
    return c.startswith('"')


def _close(c: Column) -> Column:
    """Place of the closing quote; language tags and datatypes hold no quote."""
    return F.length(c) - F.instr(F.reverse(c), '"') + 1


def tail(c: Column) -> Column:
    return F.when(is_literal(c), F.substring(c, _close(c) + 1, F.length(c)))


def datatype(c: Column) -> Column:
    """Datatype IRI without brackets; '' for a literal without one or with a language; null for other terms."""
    t = tail(c)
    return F.when(t.startswith("^^<"), F.substring(t, F.lit(4), F.length(t) - 4)).when(t.isNotNull(), F.lit(""))


def language(c: Column) -> Column:
    t = tail(c)
    return F.when(t.startswith("@"), F.lower(F.substring(t, F.lit(2), F.length(t)))).when(t.isNotNull(), F.lit(""))


def _hex(c: Column, mark: str, digits: int, charset: str) -> Column:
    parts = F.split(c, r"\\" + mark + "(?=[0-9A-Fa-f]{%d})" % digits)
    decoded = F.transform(parts, lambda x, i: F.when(i == 0, x).otherwise(F.concat(F.decode(F.unhex(F.substring(x, 1, digits)), charset), F.substring(x, F.lit(digits + 1), F.length(x)))))
    return F.array_join(decoded, "")


def unescape(c: Column) -> Column:
    """Decode string escapes in one pass: pairs of backslashes split the text, so what is left holds single escapes only."""

    def single(x: Column) -> Column:
        x = _hex(_hex(x, "U", 8, "UTF-32"), "u", 4, "UTF-16BE")
        for mark, char in _ESCAPES.items():
            if mark != "\\":
                x = F.replace(x, F.lit("\\" + mark), F.lit(char))
        return x

    return F.when(F.contains(c, F.lit("\\")), F.array_join(F.transform(F.split(c, r"\\\\"), single), "\\")).otherwise(c)


def escape(c: Column) -> Column:
    for raw, mark in (("\\", "\\\\"), ('"', '\\"'), ("\n", "\\n"), ("\r", "\\r")):
        c = F.replace(c, F.lit(raw), F.lit(mark))
    return c


def lexical(c: Column) -> Column:
    """Text of a literal, IRI without brackets, or blank node label."""
    return F.when(is_literal(c), unescape(F.substring(c, F.lit(2), _close(c) - 2))).when(is_iri(c), F.substring(c, F.lit(2), F.length(c) - 2)).otherwise(c)


def canonical(c: Column) -> Column:
    """One form of each literal: the least escapes, tags in lower case, no datatype xsd:string; IRIs without numeric escapes."""
    end = tail(c)
    tidy = F.when(end.startswith("@"), F.lower(end)).when(end == f"^^<{XSD}string>", F.lit("")).otherwise(end)
    text = F.substring(c, F.lit(2), _close(c) - 2)
    text = F.when(F.contains(text, F.lit("\\")), escape(unescape(text))).otherwise(escape(text))
    return F.when(is_literal(c), F.concat(F.lit('"'), text, F.lit('"'), tidy)).when(F.contains(c, F.lit("\\")), unescape(c)).otherwise(c)


def numeric(c: Column) -> Column:
    """Value of a numeric literal as a double, else null."""
    return F.when(datatype(c).isin(*NUMERIC), lexical(c).try_cast("double"))


def exact(c: Column) -> Column:
    """Value of an integer or decimal literal as a decimal, else null (doubles and numbers too wide included)."""
    kinds = [n for n in NUMERIC if not n.endswith(("double", "float"))]
    return F.when(datatype(c).isin(*kinds), lexical(c).try_cast("decimal(38,10)"))


def instant(c: Column) -> Column:
    return F.when(datatype(c).isin(*TIMES), lexical(c).try_cast("timestamp_ntz"))


def simple(c: Column) -> Column:
    """Text of a literal without language whose datatype is none or xsd:string, else null."""
    return F.when(datatype(c).isin(*SIMPLE) & (language(c) == ""), lexical(c))


def to_iri(prefix: str, c: Column) -> Column:
    return F.concat(F.lit("<" + prefix), c.cast("string"), F.lit(">"))


def to_literal(c: Column, datatype: str = "") -> Column:
    """A literal of a column's string form; numbers and times hold nothing to escape."""
    text = c.cast("string")
    if not datatype:
        text = escape(text)
    return F.concat(F.lit('"'), text, F.lit(f'"^^<{datatype}>' if datatype else '"'))

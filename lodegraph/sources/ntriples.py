"""N-Triples text."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import terms as T

_IRI = r"<[^>]*+>"
_BLANK = r"_:[^\s<>\"]+?"
# possessive loops: a literal of any length takes no stack
_LITERAL = r'"(?>[^"\\]++|\\.)*+"(?:@[A-Za-z0-9-]+|\^\^<[^>]*+>)?'
LINE = rf"^\s*+({_IRI}|{_BLANK})\s++({_IRI})\s++({_IRI}|{_BLANK}|{_LITERAL})\s*+\.\s*+(?:#.*)?$"
#: A line as write_ntriples makes it, whose terms are canonical as they stand: single spaces between, and no escapes, tags or labels.
#: Reading finds these without a pattern (_is_plain).
PLAIN = r'^<[^> \\\s]*+> <[^> \\\s]*+> (?:<[^> \\\s]*+>|"[^"\\\n\r]*+"(?:\^\^<(?!http://www\.w3\.org/2001/XMLSchema#string>)[^> \\\s]*+>)?+) \.\z'
#: A line that holds nothing: white space, or a comment.
BLANK_LINE = r"^\s*+(?:#.*)?$"
MODES = ("fail", "drop")


def parse_lines(lines: DataFrame, column: str = "value", mode: str = "fail") -> DataFrame:
    """(s, p, o) of lines of N-Triples, in canonical form. Empty lines and comments are skipped.

    A malformed line raises an error (``fail``) or is skipped (``drop``). White space before the final dot may be missing.
    """
    if mode not in MODES:
        raise ValueError(f"mode is one of {', '.join(MODES)}")
    line = F.col("line")
    known = lines.select(F.col(column).alias("line")).where("line IS NOT NULL")
    held = known.where(line.startswith("<") | ~line.rlike(BLANK_LINE))
    first = F.instr(line, " ")
    held = held.select("line", first.alias("first")).select("line", "first", F.position(F.lit(" "), line, F.col("first") + 1).alias("second"))
    first, second = F.col("first"), F.col("second")
    cut = held.select("line", "second", F.substring(line, F.lit(1), first - 1).alias("s"), F.substring(line, first + 1, second - first - 1).alias("p"), F.substring(line, second + 1, F.length(line) - second - 2).alias("o"))
    cut = cut.select("*", _is_plain().alias("plain"))

    def grammar(x: Column) -> Column:
        parts = [F.regexp_extract(x, LINE, i) for i in (1, 2, 3)]
        terms = [T.canonical(c) for c in parts]
        if mode == "fail":
            broken = F.raise_error(F.concat(F.lit("not a triple: "), F.substring(x, 1, 200)))
            terms[0] = F.when(parts[0] == "", broken.cast("string")).otherwise(terms[0])
        return F.struct(*(t.alias(c) for t, c in zip(terms, "spo")))

    # what few lines need stands in a lambda, which is interpreted: in line, it makes the method that all lines run too long for the JVM to compile
    terms = F.when(F.col("plain"), F.struct("s", "p", "o")).otherwise(F.element_at(F.transform(F.array(line), grammar), 1))
    # one row a line: a test on the terms isn't moved below a generator, where it would cut each line once more
    found = cut.select(F.explode(F.array(terms)).alias("x")).select("x.*")
    return found.where("p <> ''") if mode == "drop" else found


def _is_iri(c: str) -> Column:
    return F.col(c).startswith("<") & (F.instr(F.col(c), ">") == F.length(c))


def _is_plain() -> Column:
    """Whether a line, cut at its first two spaces and before its last one, is a triple whose terms are canonical as they stand.

    No pattern is matched: what isn't known at once to be such a line goes by the grammar.
    """
    line, o = F.col("line"), F.col("o")
    close = F.position(F.lit('"'), o, F.lit(2))
    kind = F.substring(o, close + 1, F.length(o))
    typed = kind.startswith("^^<") & (F.instr(kind, ">") == F.length(kind)) & (kind != f"^^<{T.XSD}string>")
    text = o.startswith('"') & (close > 1) & ((close == F.length(o)) | typed) & ~F.contains(o, F.lit("\n")) & ~F.contains(o, F.lit("\r"))
    return (F.col("second") > 0) & line.endswith(" .") & ~F.contains(line, F.lit("\\")) & _is_iri("s") & _is_iri("p") & (_is_iri("o") | text)


def read_ntriples(spark: SparkSession, path: str, mode: str = "fail") -> DataFrame:
    """Triples of text files (plain or compressed), as they stand: repeats included."""
    return parse_lines(spark.read.text(path), mode=mode)


def write_ntriples(triples: DataFrame, path: str, compression: str = "none") -> None:
    triples.select(F.concat_ws(" ", "s", "p", "o", F.lit("."))).write.option("compression", compression).text(path)

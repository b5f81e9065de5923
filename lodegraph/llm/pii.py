"""Operator 4: information-theoretic sanitisation of personal data.

Base spans are found by form (e-mail, IP, card and phone numbers); their values are the protected entities. Terms (words)
within ``reach`` words of an entity are its context. Over the whole corpus, how strongly a term t reveals an entity e is
PMI(t; e) / IC(e) = log(N c(t,e) / (c(t) c(e))) / log(N / c(e)), with N rows, c(e) and c(t) the numbers of rows with e and
with t, and c(t,e) of rows with t in e's context; 1 means that t tells e for certain. A term is disclosing if this is at least
``threshold`` and the pair isn't chance. Pairs seen in at least ``support`` different contexts (copies of a passage count once)
aren't; of the others those are, unless t is found elsewhere too and k contexts are unlikely where t and e are independent: at
most (c(t) c(e) / N)^k / k!, a bound of the Poisson tail, which must not exceed ``chance``. (A word that stands nowhere but in
one passage has no frequency to judge by.) Disclosing terms are generalised: every occurrence in any text becomes a span of kind
``term``, unless it overlaps a base span. Terms are words of three characters or more without signs at their ends, of any length.

Matches are leftmost and don't overlap within a kind; one that fails its check is dropped, and the search goes on behind it.
Null texts are empty. Texts in which nothing is found have no spans; texts of any length are searched whole. Repeated rows are
judged alike, and count each. Rows whose key is null keep their base spans and take part in no statistics; ``with_key`` makes a
key that is never null. Ties need no order: pairs are judged each. An empty table gives an empty table; columns to keep that are
named like a result give way to it. Offsets count code points.
"""

from __future__ import annotations

import re
from bisect import bisect_left
from collections import Counter
from itertools import accumulate

import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from . import common as C

KINDS = ("email", "ip", "card", "phone")
KEY = "pii_key"
LOCAL_SET = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
DOMAIN = re.compile(r"[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)+")
# a match can start inside a run of digits only if it could start before it
IP = re.compile(r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++")
CARD = re.compile(r"[0-9](?:[ -]?[0-9])++")
PHONE = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")
DIGIT = re.compile(r"[0-9]")
NOT_DIGIT = re.compile(r"[^0-9]")
WORD = re.compile(r"[^\x20\x09-\x0D]+")
EDGES = ".,;:!?()[]{}\"'|*#$%&<>"
EDGE_BYTES = EDGES.encode()
SHARED_BYTES = 16 << 20
MEMO = 50_000  # words whose terms a task remembers; Python workers live on, and keep the memory
PLACEHOLDER = {"email": "[EMAIL]", "ip": "[IP]", "card": "[CARD]", "phone": "[PHONE]", "term": "[TERM]"}


def luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = ord(c) - 48
        if i & 1:
            d = d * 2 - 9 * (d > 4)
        total += d
    return total % 10 == 0


def base_spans(text: str) -> list[tuple[str, int, int]]:
    """(kind, start, end) in order of kind, then start."""
    out = []
    end, at = 0, text.find("@")
    while at >= 0:
        start = at  # the longest run that can stand before this sign and behind the last match
        while start > end and text[start - 1] in LOCAL_SET:
            start -= 1
        if start < at and (m := DOMAIN.match(text, at + 1)):
            end = m.end()
            out.append(("email", start, end))
            at = text.find("@", end)
        else:
            end = max(end, at + 1)  # no match can hold this sign
            at = text.find("@", at + 1)
    if DIGIT.search(text):
        if text.count(".") > 2:
            for m in IP.finditer(text):
                if all(len(p.lstrip("0")) <= 3 and int(p.lstrip("0") or 0) <= 255 for p in m[0].split(".")):
                    out.append(("ip", *m.span()))
        for m in CARD.finditer(text):
            digits = NOT_DIGIT.sub("", m[0])
            if 16 <= len(digits) <= 19 and luhn(digits):
                out.append(("card", *m.span()))
        if "+" in text:
            for m in PHONE.finditer(text):
                if 8 <= len(NOT_DIGIT.sub("", m[0])) <= 15:
                    out.append(("phone", *m.span()))
    return out


def value(kind: str, text: str) -> str:
    return kind + ":" + (text.lower() if kind == "email" else NOT_DIGIT.sub("", text) if kind != "ip" else text)


def contexts(text: str, spans: list[tuple[str, int, int]], reach: int) -> list[tuple[str, int, list[tuple[str, int, int]]]]:
    """For each span its entity, a hash of its context, and the context's terms with their places."""
    if not spans:
        return []
    words = [m.span() for m in WORD.finditer(text)]
    begins = [a for a, _ in words]
    ordered = sorted((a, b) for _, a, b in spans)
    starts, ends = [a for a, _ in ordered], list(accumulate((b for _, b in ordered), max))

    def bare(start: int, stop: int) -> tuple[int, int]:
        while start < stop and text[start] in EDGES:
            start += 1
        while start < stop and text[stop - 1] in EDGES:
            stop -= 1
        return start, stop

    out = []
    for kind, a, b in spans:
        at, last = bisect_left(begins, a), bisect_left(begins, b)  # a word that the span cuts is a word on either side
        left = [(s, min(e, a)) for s, e in words[max(0, at - reach) : at]]
        cut = [(b, words[last - 1][1])] if words[last - 1][1] > b else []
        right = [*cut, *words[last : last + reach - len(cut)]]
        terms = []
        for start, stop in (bare(*w) for w in (*left, *right)):
            before = bisect_left(starts, stop)  # spans that start before the word's end
            if stop - start > 2 and not (before and ends[before - 1] > start):
                terms.append((text[start:stop].lower(), start, stop))
        seal = xxhash.xxh3_64_intdigest("\0".join(t for t, _, _ in terms)) >> 1
        out.append((value(kind, text[a:b]), seal, terms))
    return out


FOUND = "spans array<struct<kind:string,a:int,b:int>>, contexts array<struct<entity:string,seal:long,terms:array<struct<term:string,a:int,b:int>>>>"


def find(df: DataFrame, keep=("doc_id",), text: str = "text", reach: int = 6) -> DataFrame:
    """``keep`` columns, the base spans (kind, a, b) and the contexts of the entities."""

    def make():
        kind = pa.list_(pa.struct([("kind", pa.string()), ("a", pa.int32()), ("b", pa.int32())]))
        around = pa.list_(pa.struct([("entity", pa.string()), ("seal", pa.int64()), ("terms", pa.list_(pa.struct([("term", pa.string()), ("a", pa.int32()), ("b", pa.int32())])))]))

        def run(batch: pa.RecordBatch) -> dict[str, pa.Array]:
            spans, about = [], []
            for t in C.column(batch, text).to_pylist():
                found = base_spans(t or "")
                spans.append([{"kind": k, "a": a, "b": b} for k, a, b in found])
                about.append([{"entity": e, "seal": s, "terms": [{"term": w, "a": a, "b": b} for w, a, b in terms]} for e, s, terms in contexts(t, found, reach)] if found else [])
            return {"spans": pa.array(spans, kind), "contexts": pa.array(about, around)}

        return run

    return C.map_texts(df, make, FOUND, keep, text)


def words_of(docs: DataFrame, key: str, text: str) -> DataFrame:
    """``key``, term: the different words of every text, as ``contexts`` writes terms."""
    return docs.where(F.col(key).isNotNull()).select(key, F.explode(F.array_distinct(F.transform(F.split(F.lower(F.col(text)), "[\\x20\\x09-\\x0D]+"), lambda w: F.btrim(w, F.lit(EDGES))))).alias("term"))


def bare_term(word: bytes) -> bytes | None:
    """A word as a term, if it is one."""
    s = word.strip(EDGE_BYTES).decode()
    return s.lower().encode() if len(s) > 2 else None


def row_counts(docs: DataFrame, key: str, text: str) -> DataFrame:
    """term, c_t: the number of rows with a key that hold the term; added up in each piece of input before anything is shuffled."""
    C.bounded_batches(docs.sparkSession)

    def count(batches):
        terms, bag = C.Memo(bare_term, MEMO), Counter()

        def rows():
            return pa.RecordBatch.from_arrays([pa.array(bag.keys(), pa.binary()), pa.array(bag.values(), pa.int64())], names=["word", "n"])

        for batch in C.chunks(batches, text):
            for t in C.as_bytes(batch, text):
                bag.update(set(map(terms.__getitem__, set(t.split()))))
            if len(bag) > 2 * MEMO:
                bag.pop(None, None)
                yield rows()
                bag.clear()
        bag.pop(None, None)
        if bag:
            yield rows()

    counted = docs.where(F.col(key).isNotNull()).select(text).mapInArrow(count, StructType.fromDDL("word binary, n long"))
    return counted.groupBy(F.col("word").cast("string").alias("term")).agg(F.sum("n").alias("c_t"))


def disclosing(found: DataFrame, docs: DataFrame, key: str = "doc_id", text: str = "text", threshold: float = 0.8, support: int = 3, chance: float = 0.01) -> DataFrame:
    """(entity, term, strength, n_contexts, c_te, c_e, c_t) of the pairs that disclose too much, as a stored table.

    ``found`` is ``find``'s result, stored. The threshold bounds c(t) from above, and the rows that have t in some context bound
    it from below: pairs that these two rule out are dropped before terms are counted in all texts.
    """
    # rows are numbered before their contexts are taken apart
    held = found.where(F.col(key).isNotNull() & (F.size("contexts") > 0)).select("contexts", F.monotonically_increasing_id().alias("row"))
    pairs = held.select("row", F.explode("contexts").alias("x")).select("row", "x.entity", "x.seal", F.explode_outer("x.terms.term").alias("term"))
    seen = pairs.where("term is not null").groupBy("entity", "term").agg(F.countDistinct("seal").alias("n_contexts"), F.countDistinct("row").alias("c_te"))
    n = docs.where(F.col(key).isNotNull()).count()
    c_e = pairs.groupBy("entity").agg(F.countDistinct("row").alias("c_e")).where(F.col("c_e") < n)
    at_least = pairs.where("term is not null").groupBy("term").agg(F.countDistinct("row").alias("c_least"))

    def strength(c_t: str):
        return F.log(n * F.col("c_te") / (F.col(c_t) * F.col("c_e"))) / F.log(n / F.col("c_e"))

    open_pairs = C.materialise(seen.join(c_e, "entity").join(at_least, "term").where(strength("c_least") >= threshold).drop("c_least"), "pii-pairs")
    k = F.least("n_contexts", F.lit(20)).cast("int")
    luck = F.pow(F.col("c_t") * F.col("c_e") / n, k) / F.factorial(k)
    meant = (F.col("n_contexts") >= support) | ((F.col("c_t") > F.col("c_te")) & (luck <= chance))
    judged = open_pairs.join(row_counts(docs, key, text), "term").withColumn("strength", strength("c_t")).where((F.col("strength") >= threshold) & meant)
    return C.materialise(judged.select("entity", "term", "strength", "n_contexts", "c_te", "c_e", "c_t"), "pii-terms")


def places(text: str, wanted, spans: list[tuple[str, int, int]], least: int = 3) -> list[tuple[int, int]]:
    """Where the terms ``wanted`` stand in the text, outside the spans."""
    out = []
    for m in WORD.finditer(text):
        word = m[0].strip(EDGES)
        if len(word) >= least and word.lower() in wanted:
            start = m.start() + m[0].find(word)
            if not any(a < start + len(word) and start < b for _, a, b in spans):
                out.append((start, start + len(word)))
    return out


def replaced(text: str | None, spans: list[dict]) -> str | None:
    """The text with each span's kind's placeholder instead; of spans that overlap, what the first hasn't covered goes too."""
    if not text or not spans:
        return text
    pieces, at = [], 0
    for s in sorted(spans, key=lambda s: (s["a"], -s["b"])):
        if s["b"] <= at:
            continue
        pieces += [text[at : s["a"]] if s["a"] >= at else "", PLACEHOLDER[s["kind"]] if s["a"] >= at else ""]
        at = s["b"]
    return "".join(pieces) + text[at:]


def all_spans(docs: DataFrame, pairs: DataFrame, keep=("doc_id",), key: str = "doc_id", text: str = "text", shared_bytes: int = SHARED_BYTES, with_text: bool = False) -> DataFrame:
    """``keep`` columns, spans (the base spans) and all_spans (these, then the disclosing terms of ``pairs`` wherever they stand).

    ``with_text`` adds sanitised, the text with all of them replaced, in the same pass (what ``sanitise`` gives).

    If all terms have at most ``shared_bytes`` bytes, every task is given them and texts are read once; otherwise each text is
    first joined with the terms that it holds. Both give the same spans.
    """
    spark = docs.sparkSession
    terms = pairs.select("term").distinct()
    size, many = terms.agg(F.coalesce(F.sum(F.octet_length("term")), F.lit(0)), F.count(F.lit(1))).first()
    joined = size + 64 * many > shared_bytes
    keep = tuple(c for c in dict.fromkeys(keep) if c not in ("wanted", "wanted_key"))
    docs = docs.drop("wanted", "wanted_key")
    if joined:
        hits = words_of(docs, key, text).join(terms, "term").groupBy(F.col(key).alias("wanted_key")).agg(F.collect_set("term").alias("wanted"))
        docs = docs.join(hits, F.col(key) == F.col("wanted_key"), "left")
        shared = None
    else:
        shared = spark.sparkContext.broadcast([r.term.encode() for r in terms.collect()])  # at most shared_bytes

    def make():
        listed = pa.list_(pa.struct([("kind", pa.string()), ("a", pa.int32()), ("b", pa.int32())]))
        known = None if shared is None else frozenset(shared.value)
        words = None if known is None else frozenset(w.decode() for w in known)
        is_known = C.Memo(lambda w: bare_term(w) in known, MEMO)

        def run(batch: pa.RecordBatch) -> dict[str, pa.Array]:
            base, every = [], []
            wanted = C.column(batch, "wanted").to_pylist() if known is None else None
            for i, t in enumerate(C.column(batch, text).to_pylist()):
                found = base_spans(t or "")
                if known is None:
                    mine = frozenset(wanted[i] or ())
                else:
                    mine = words if t and known and any(map(is_known.__getitem__, set(t.encode().split()))) else ()
                more = [("term", a, b) for a, b in places(t, mine, found)] if mine else []
                base.append([{"kind": k, "a": a, "b": b} for k, a, b in found])
                every.append(base[-1] + [{"kind": k, "a": a, "b": b} for k, a, b in more])
            clean = {"sanitised": pa.array(map(replaced, C.column(batch, text).to_pylist(), every), pa.string())} if with_text else {}
            return {"spans": pa.array(base, listed), "all_spans": pa.array(every, listed)} | clean

        return run

    kind = "array<struct<kind:string,a:int,b:int>>"
    fields = f"spans {kind}, all_spans {kind}" + ", sanitised string" * with_text
    return C.map_texts(docs, make, fields, keep, text, ("wanted",) if joined else ())


def sanitise(df: DataFrame, spans: str = "all_spans", text: str = "text") -> DataFrame:
    """Replace each span of ``text`` (see ``replaced``)."""

    def run(batches):
        for batch in C.chunks(batches, text):
            out = list(map(replaced, C.column(batch, text).to_pylist(), C.column(batch, spans).to_pylist()))
            at = batch.schema.get_field_index(text)
            yield batch.set_column(at, text, pa.array(out, pa.string())).drop_columns([spans])

    C.bounded_batches(df.sparkSession)
    return df.mapInArrow(run, StructType([f for f in df.schema.fields if f.name != spans]))


def with_key(docs: DataFrame) -> DataFrame:
    """A key of a row's doc_id and text, never null, so that rows with one doc_id and several texts are told apart."""
    return docs.withColumn(KEY, F.xxhash64("doc_id", "text"))


def count_kind(spans: str, kind: str):
    return F.size(F.filter(spans, lambda s: s["kind"] == kind)).cast("long")


def digest(spans: str):
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["a"].cast("string"), s["b"].cast("string"))), ",")


def op4_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = with_key(C.table(spark, sf_dir, "documents").select("doc_id", "text"))
    found = C.materialise(find(docs, (KEY,)), "pii")
    out = all_spans(docs, disclosing(found, docs, KEY), ("doc_id",), KEY)
    counts = [count_kind("spans", k).alias(f"n_{k}") for k in KINDS]
    return out.select("doc_id", *counts, F.sha2(digest("spans"), 256).alias("base_sha256"), digest("all_spans").alias("spans"))

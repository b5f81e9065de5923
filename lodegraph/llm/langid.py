"""Operator 1: language identification by words first, then ever shorter character n-grams.

A known word scores its log frequency in each language. A word that isn't known is scored by the longest n for which at least
half of its character n-grams are known; where no n-gram is known, it says nothing. A text's scores are summed over its words
and turned into probabilities.

The model is learned from a bounded sample (``max_docs`` labelled texts, those with the least hash of doc_id, whole whatever
their length), of which it keeps the ``max_words`` and ``max_grams`` commonest entries, ties in order of the entry; so its size
doesn't depend on the table's. Texts of any length are predicted whole. Null texts and texts without a letter (a character that
Unicode counts among the letters) get ``und`` and score 0; so does every text where nothing could be learned. Ties go to the
first language in order of name. Rows without a doc_id are predicted, never learned from; repeated rows are predicted alike, and
learned from each. An empty table gives an empty table. Columns to keep that are named like a result give way to it.
"""

from __future__ import annotations

import re
from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from . import common as C

#: Characters that count as parts of words for ``re`` but are numbers, such as the half sign or a raised two.
NUMBER = re.compile("[" + "".join(c for c in map(chr, range(0x110000)) if c.isalnum() and not c.isalpha() and not c.isdecimal()) + "]")
WORD = re.compile(r"[^\W\d_]+")
SIZES = (5, 4, 3, 2, 1)


def words_of(text: str) -> list[str]:
    """Runs of letters, in lower case."""
    words = WORD.findall(text.lower())
    if "".join(words).isalpha():
        return words
    return [part for w in words for part in ([w] if w.isalpha() else NUMBER.sub(" ", w).split())]


def grams(word: str, n: int) -> list[str]:
    padded = f" {word} "
    return [padded[i : i + n] for i in range(len(padded) - n + 1)]


class Model:
    def __init__(self, langs: list[str], words: dict[str, np.ndarray], parts: dict[str, np.ndarray], prior: np.ndarray):
        self.langs, self.words, self.parts, self.prior = langs, words, parts, prior
        self.table = np.zeros((1024, len(langs)))
        self.rows: dict[str, int] = {}

    def score(self, word: str) -> np.ndarray:
        if (known := self.words.get(word)) is not None:
            return known
        for n in SIZES:
            all_of = grams(word, n)
            found = [p for g in all_of if (p := self.parts.get(g)) is not None]
            if found and 2 * len(found) >= len(all_of):
                return np.mean(found, axis=0)
        return np.zeros(len(self.langs))

    def row(self, word: str) -> int:
        if (i := self.rows.get(word)) is None:
            if len(self.rows) >= C.CACHE_ENTRIES:
                self.rows.clear()
            i = self.rows[word] = len(self.rows)
            if i >= len(self.table):
                self.table = np.vstack([self.table, np.zeros_like(self.table)])
            self.table[i] = self.score(word)
        return i

    def predict(self, text: str | None) -> tuple[str, float]:
        words = words_of(text or "")
        if not words or not self.langs:
            return "und", 0.0
        if len(self.rows) + len(words) > C.CACHE_ENTRIES:
            self.rows.clear()
        get = self.rows.get
        at = [i if (i := get(w)) is not None else self.row(w) for w in words] if len(words) <= C.CACHE_ENTRIES else None
        total = self.table[at].sum(0) if at is not None else sum(map(self.score, words))
        total = total + self.prior
        p = np.exp(total - total.max())
        p /= p.sum()
        i = int(p.argmax())
        return self.langs[i], float(p[i])


def learn(labelled: DataFrame, key: str = "doc_id", text: str = "text", lang: str = "lang", max_docs: int = 3000, max_words: int = 60_000, max_grams: int = 60_000) -> Model:
    """Learn from rows with a non-null key, text and lang."""
    labelled = labelled.where(F.col(key).isNotNull() & F.col(text).isNotNull() & F.col(lang).isNotNull())
    chosen = labelled.select(key).orderBy(F.xxhash64(key), key).limit(max_docs)
    sample = labelled.join(F.broadcast(chosen), key, "left_semi")  # at most max_docs keys

    def count(batches):
        for batch in batches:
            words: dict[str, Counter] = {}
            docs: Counter = Counter()
            for t, label in zip(C.column(batch, text).to_pylist(), C.column(batch, lang).to_pylist()):
                words.setdefault(label, Counter()).update(words_of(t))
                docs[label] += 1
            rows = [("doc", "", label, n) for label, n in docs.items()]
            for label, bag in words.items():
                parts: Counter = Counter()
                for w, n in bag.items():
                    rows.append(("word", w, label, n))
                    for size in SIZES:
                        for g in grams(w, size):
                            parts[g] += n
                rows += [("part", g, label, n) for g, n in parts.items()]
            if rows:
                kind, item, label, n = zip(*rows)
                yield pa.RecordBatch.from_arrays([pa.array(kind), pa.array(item), pa.array(label), pa.array(n, pa.int64())], names=["kind", "item", "lang", "n"])

    counted = sample.select(text, lang).mapInArrow(count, StructType.fromDDL(f"kind string, item string, {lang} string, n long"))
    summed = C.materialise(counted.groupBy("kind", "item", F.col(lang).alias("lang")).agg(F.sum("n").alias("n")), "langid")
    totals = {(r.kind, r.lang): r.n for r in summed.where("kind = 'doc'").groupBy("kind", "lang").agg(F.sum("n").alias("n")).collect()}
    langs = sorted(lang for _, lang in totals)
    if not langs:
        return Model([], {}, {}, np.zeros(0))
    at = {x: i for i, x in enumerate(langs)}
    docs = np.array([totals["doc", x] for x in langs], float)

    def load(kind: str, most: int) -> dict[str, np.ndarray]:
        best = summed.where(F.col("kind") == kind).groupBy("item").agg(F.collect_list(F.struct("lang", "n")).alias("by"), F.sum("n").alias("total")).orderBy(F.desc("total"), "item").limit(most)
        counts: dict[str, np.ndarray] = {}
        for r in best.collect():  # at most `most` rows
            counts[r.item] = np.zeros(len(langs))
            for x in r.by:
                counts[r.item][at[x.lang]] = x.n
        if not counts:
            return {}
        whole = np.sum(list(counts.values()), axis=0) + 0.5 * len(counts)
        return {k: np.log((v + 0.5) / whole) for k, v in counts.items()}

    return Model(langs, load("word", max_words), load("part", max_grams), np.log(docs / docs.sum()))


def identify(df: DataFrame, model: Model, keep=("doc_id",), text: str = "text") -> DataFrame:
    """``keep`` columns, lang_pred string, score double (0 to 1)."""
    shared = df.sparkSession.sparkContext.broadcast((model.langs, model.words, model.parts, model.prior))  # bounded by max_words, max_grams

    def make():
        m = Model(*shared.value)

        def run(batch: pa.RecordBatch) -> dict[str, pa.Array]:
            found = [m.predict(t) for t in C.column(batch, text).to_pylist()]
            return {"lang_pred": pa.array([x for x, _ in found], pa.string()), "score": pa.array([x for _, x in found], pa.float64())}

        return run

    return C.map_texts(df, make, "lang_pred string, score double", keep, text)


def op1_langid(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = C.table(spark, sf_dir, "documents")
    fold = C.crc_fold("doc_id", 4)
    model = learn(docs.where(fold != 2))
    return identify(docs, model).select("doc_id", (F.coalesce(C.crc_fold("doc_id", 4), F.lit(-1)) == 2).alias("held_out"), "lang_pred", "score")

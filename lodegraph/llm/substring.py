"""Operator 5: incremental removal of repeated passages, by a log-structured index of window fingerprints.

A window is ``WINDOW`` words in a row. Each window has an anchor: of its runs of ANCHOR words the one with the least hash, the
leftmost of equals. Equal windows have equal anchors, and windows that follow each other mostly share theirs, so the index holds
one entry for each anchor: the anchor's hash ``h``, a fingerprint ``g`` of all the words that its windows span (its context), and
where it stands. The entries of a batch are written once as a run: a table bucketed and sorted by ``h`` that never changes. The
batch's anchors are merge-joined with every older run as it lies, bucket by bucket, without a shuffle or sort of the run; only old
entries that share an anchor with the batch come out, so what follows is in proportion to the batch:

* An entry that isn't the first with its (h, g) is a whole context seen before: all its windows are repeats. h and g are hashed
  independently, so a match is verified by 128 bits.
* The first entry of a context whose h has other contexts too may share single windows with those. Only such entries, new
  and old, are expanded from the texts into windows, which are compared by two independent 64-bit hashes.

Windows are judged on the input; a word covered by a repeated window is removed. Order is (batch, key, place). Before a batch
that finds ``FAN_IN`` runs, these are compacted into one, which keeps only the first entry of every context. Old texts are read
again where they hold a context that must be expanded; batches without one aren't.

Copies within one piece of input are known to be repeats before anything is shuffled; they spread over the buckets and only
their first entry travels to the bucket of its anchor, so a group of copies doesn't gather in one task.

Null texts have no words. Rows without a key come back whole and are never earlier than anything. Rows with the same key and
text are judged alike (an equal start isn't an earlier one); with the same key and different texts, each by its own words. Texts
of any length are judged whole. An empty batch gives an empty result. Columns to keep that are named like a result give way to it.
"""

from __future__ import annotations

import uuid
from itertools import compress

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from . import common as C

WINDOW = 20
ANCHOR = 6
SPAN = WINDOW - ANCHOR + 1  # runs of ANCHOR words in a window
FAN_IN = 4
#: Spark trusts the order of a bucketed table only if this is set; every bucket of a run is one sorted file.
ORDERED = "spark.sql.legacy.bucketedTableScan.outputOrdering"


def _leftmost_least(x: np.ndarray, span: int) -> np.ndarray:
    """Place of the least of each ``span`` consecutive values, the leftmost of equals."""
    value, place, have = x, np.arange(len(x)), 1

    def both(shift: int) -> tuple[np.ndarray, np.ndarray]:
        n = len(value) - shift
        right = value[shift:] < value[:n]
        return np.where(right, value[shift:], value[:n]), np.where(right, place[shift:], place[:n])

    while 2 * have <= span:
        value, place = both(have)
        have *= 2
    if have < span:
        value, place = both(span - have)
    return place


class Piece:
    """The words of several texts in a row, and the anchors of their windows.

    ``at``, ``first`` and ``last`` are the places of each anchor and of the first and last window that it stands for, among the
    words of all texts; ``begin`` and ``count`` are the first word and the number of words of each text.
    """

    def __init__(self, texts: list[bytes], hasher: C.WordHasher):
        self.count, self.one, self.two = hasher.of(texts)
        self.begin = np.cumsum(self.count) - self.count
        self.doc = np.repeat(np.arange(len(texts)), self.count)
        n, powers = len(self.one), hasher.powers
        self.at = self.first = self.last = np.zeros(0, np.int64)
        self.h = self.g = np.zeros(0, np.uint64)
        if n < WINDOW:
            return
        runs = C.rolling(self.one, ANCHOR)
        place = _leftmost_least(runs, SPAN)[: n - WINDOW + 1]
        start = np.flatnonzero(self.doc[: n - WINDOW + 1] == self.doc[WINDOW - 1 :])  # windows that lie in one text
        if not len(start):
            return
        place = place[start]
        change = np.flatnonzero(np.diff(place))
        self.first = start[np.concatenate([[0], change + 1])]
        self.last = start[np.concatenate([change, [len(place) - 1]])]
        self.at = place[np.concatenate([[0], change + 1])]
        self.h = runs[self.at]
        powers.upto(n + 1)
        with np.errstate(over="ignore"):
            total = np.concatenate([np.zeros(1, np.uint64), np.cumsum(C.mix(self.two) * powers.up[:n], dtype=np.uint64)])
            whole = (total[self.last + WINDOW] - total[self.first]) * powers.down[self.first]
            shape = (self.at - self.first) * 64 + (self.last - self.first)
            self.g = C.mix(whole + C.mix(shape.astype(np.uint64) + C.ODD))

    def windows(self, k: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Places of the windows of these anchors, and for each its position in ``k``."""
        many = self.last[k] - self.first[k] + 1
        which = np.repeat(np.arange(len(k)), many)
        return np.arange(len(which)) - np.repeat(np.cumsum(many) - many, many) + self.first[k][which], which

    def find(self, doc: np.ndarray, at: np.ndarray, g: np.ndarray) -> np.ndarray:
        """Numbers of the anchors at these places of these texts that have the fingerprint g; -1 where there is none."""
        if not len(self.at):
            return np.full(len(doc), -1)
        place = self.begin[doc] + at
        k = np.minimum(np.searchsorted(self.at, place), len(self.at) - 1)
        return np.where((self.at[k] == place) & (self.doc[self.at[k]] == doc) & (self.g[k].view(np.int64) == g), k, -1)


def _listed(batch: pa.RecordBatch, name: str, *fields: str) -> tuple[np.ndarray, ...]:
    """A column of arrays of structs as flat arrays: the row of each entry, then its fields. Null is empty."""
    lists = C.column(batch, name)
    rows = pc.list_parent_indices(lists).to_numpy(zero_copy_only=False).astype(np.int64)
    entries = pc.list_flatten(lists)
    return rows, *(entries.field(f).to_numpy(zero_copy_only=False) for f in fields)


ENTRY = "h long, g long, doc long, at int, known boolean"


def entries(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """The index entries of all texts with a key.

    ``known`` marks an entry that is not the first of its (h, g) within its piece of input; its h is spread at random.
    """

    def run(batches):
        hasher = C.WordHasher()
        for batch in C.chunks(batches, text):
            x = Piece(C.as_bytes(batch, text), hasher)
            if not len(x.at):
                continue
            keys = C.column(batch, key).cast(pa.int64()).to_numpy(zero_copy_only=False)
            row = x.doc[x.at]
            h, g, doc, at = x.h, x.g, keys[row], (x.at - x.begin[row]).astype(np.int32)
            order = np.lexsort((at, doc, g, h))
            h, g, doc, at = h[order], g[order], doc[order], at[order]
            head = np.ones(len(h), bool)
            head[1:] = (h[1:] != h[:-1]) | (g[1:] != g[:-1])
            top = np.maximum.accumulate(np.where(head, np.arange(len(h)), 0))
            known = (doc != doc[top]) | (at != at[top])  # the same place again isn't a repeat
            with np.errstate(over="ignore"):
                h = np.where(known, C.mix(g ^ (doc.view(np.uint64) * C.ODD) ^ at.astype(np.uint64)), h)
            for s in range(0, len(h), 200_000):
                e = s + 200_000
                yield pa.RecordBatch.from_arrays([C.signed(h[s:e]), C.signed(g[s:e]), pa.array(doc[s:e]), pa.array(at[s:e]), pa.array(known[s:e])], names=["h", "g", "doc", "at", "known"])

    return docs.where(F.col(key).isNotNull()).select(key, text).mapInArrow(run, StructType.fromDDL(ENTRY))


def expand(texts: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Windows of the anchors in ``wanted`` (array of struct<at, g>): (w, v, doc, at, seq)."""

    def run(batches):
        hasher = C.WordHasher()
        for batch in C.chunks(batches, text):
            x = Piece(C.as_bytes(batch, text), hasher)
            k = x.find(*_listed(batch, "wanted", "at", "g"))
            k = np.unique(k[k >= 0])
            if not len(k):
                continue
            place, _ = x.windows(k)
            row = x.doc[place]
            keys = C.column(batch, key).cast(pa.int64()).to_numpy(zero_copy_only=False)
            seq = C.column(batch, "seq").to_numpy(zero_copy_only=False)
            w, v = (C.rolling(h, WINDOW)[place] for h in (x.one, x.two))
            yield pa.RecordBatch.from_arrays([C.signed(w), C.signed(v), pa.array(keys[row]), pa.array((place - x.begin[row]).astype(np.int32)), pa.array(seq[row])], names=["w", "v", "doc", "at", "seq"])

    return texts.mapInArrow(run, StructType.fromDDL("w long, v long, doc long, at int, seq int"))


def removal(texts: DataFrame, keep: tuple[str, ...], text: str = "text") -> DataFrame:
    """``keep``, n_words, n_removed, kept (the words that stay, joined by one space).

    ``marks`` is an array of struct<at int, f long, whole boolean>: repeated contexts by place of the anchor and g, or repeated
    windows by place and first hash.
    """

    def make():
        hasher = C.WordHasher()

        def run(batch: pa.RecordBatch) -> dict[str, pa.Array]:
            texts = C.as_bytes(batch, text)
            doc, at, f, whole = _listed(batch, "marks", "at", "f", "whole")
            marked = np.unique(doc)  # only texts with marks are hashed
            x = Piece([texts[i] for i in marked.tolist()], hasher)
            doc = np.searchsorted(marked, doc)
            whole = whole.astype(bool)
            edge = np.zeros(len(x.one) + 1, np.int64)
            k = x.find(doc[whole], at[whole], f[whole])
            k = k[k >= 0]
            np.add.at(edge, x.first[k], 1)
            np.add.at(edge, x.last[k] + WINDOW, -1)
            place, hashes = x.begin[doc[~whole]] + at[~whole], C.rolling(x.one, WINDOW).view(np.int64)
            inside = at[~whole] + WINDOW <= x.count[doc[~whole]]
            place, wanted = place[inside], f[~whole][inside]
            place = place[hashes[place] == wanted]
            np.add.at(edge, place, 1)
            np.add.at(edge, place + WINDOW, -1)
            stays = (np.cumsum(edge)[:-1] == 0).tolist()
            words, gone, left = [], [], []
            of = dict(zip(marked.tolist(), range(len(marked))))
            for i, t in enumerate(texts):
                parts = t.split()
                words.append(len(parts))
                if (j := of.get(i)) is not None:
                    a = int(x.begin[j])
                    parts = list(compress(parts, stays[a : a + len(parts)]))
                gone.append(words[-1] - len(parts))
                left.append(b" ".join(parts))
            return {"n_words": pa.array(words, pa.int64()), "n_removed": pa.array(gone, pa.int64()), "kept": pa.array(left, pa.binary()).cast(pa.string())}

        return run

    return C.map_texts(texts, make, "n_words long, n_removed long, kept string", keep, text, also=("marks",))


class PassageIndex:
    """An index that grows by batches. ``buckets`` should grow with the corpus: a bucket is sorted by one task."""

    def __init__(self, spark: SparkSession, buckets: int | None = None):
        C.bounded_batches(spark)
        self.spark = spark
        self.buckets = buckets or int(spark.conf.get("spark.sql.shuffle.partitions"))
        self.runs: list[str] = []
        self.texts: list[DataFrame] = []  # (doc, text, seq) of every batch: old contexts are expanded from them
        self.name = f"lodegraph_runs_{uuid.uuid4().hex}"
        self._made = 0

    def _write(self, df: DataFrame) -> str:
        name = f"{self.name}_{self._made}"
        self._made += 1
        sorted_run = df.repartition(self.buckets, "h").sortWithinPartitions("h", "g", "seq", "doc", "at")
        sorted_run.write.bucketBy(self.buckets, "h").sortBy("h").option("compression", "zstd").saveAsTable(name)
        C.made_table(name)
        return name

    def _all(self) -> DataFrame:
        out = None
        for name in self.runs:
            run = self.spark.table(name)
            out = run if out is None else out.unionByName(run)
        return out

    def add(self, batch: DataFrame, key: str = "doc_id", text: str = "text", keep: tuple[str, ...] = ()) -> DataFrame:
        """Index the batch; its rows with n_words, n_removed and kept, judged against all batches so far."""
        seq = len(self.texts)
        keep = tuple(dict.fromkeys((key, *keep)))
        if len(self.runs) >= FAN_IN:
            self.compact()
        old = self.runs
        new = self._write(entries(batch, key, text).withColumn("seq", F.lit(seq)))
        self.runs = [*old, new]
        self.texts.append(batch.where(F.col(key).isNotNull()).select(F.col(key).alias("doc"), F.col(text).alias("text"), F.lit(seq).alias("seq")))

        place = F.struct("seq", "doc", "at")
        of_h, of_g = Window.partitionBy("h"), Window.partitionBy("h", "g")
        merged = self._merged(old, new).withColumn("top", F.min(place).over(of_g)).withColumn("lo", F.min("g").over(of_h)).withColumn("hi", F.max("g").over(of_h)).withColumn("newest", F.max("seq").over(of_h))
        first = F.col("top") == place
        judged = merged.select("seq", "doc", "at", "g", (F.col("known") | ~first).alias("whole"), (~F.col("known") & first & (F.col("lo") < F.col("hi")) & (F.col("newest") == seq)).alias("open"))
        judged = self._ordered(lambda: C.materialise(judged.where(f"open OR (whole AND seq = {seq})"), "passages"))

        touched = {r.seq for r in judged.where("open").select("seq").distinct().collect()}  # at most one row for each batch
        wanted = judged.where("open").groupBy("seq", "doc").agg(F.collect_list(F.struct("at", "g")).alias("wanted"))
        parts = [expand(t.join(wanted.where(F.col("seq") == i).drop("seq"), "doc").select("doc", "text", "seq", "wanted"), "doc") for i, t in enumerate(self.texts) if i in touched or i == seq]
        windows = parts[0]
        for p in parts[1:]:
            windows = windows.unionByName(p)
        windows = C.materialise(windows, "passage-windows")
        tops = windows.groupBy("w", "v").agg(F.min(place).alias("top"), F.count(F.lit(1)).alias("n")).where("n > 1").select("w", "v", "top")
        single = windows.where(F.col("seq") == seq).join(tops, ["w", "v"]).where(F.col("top") != place).select("doc", "at", F.col("w").alias("f"), F.lit(False).alias("whole"))
        marks = judged.where("whole").select("doc", "at", F.col("g").alias("f"), "whole").unionByName(single).groupBy(F.col("doc").alias(key)).agg(F.collect_list(F.struct("at", "f", "whole")).alias("marks"))
        return removal(batch.select(*keep, text).join(marks, key, "left"), keep, text)

    def _ordered(self, work):
        """Run the work while Spark trusts the order of runs."""
        before = self.spark.conf.get(ORDERED)
        self.spark.conf.set(ORDERED, "true")
        try:
            return work()
        finally:
            self.spark.conf.set(ORDERED, before)

    def partners(self, old: str, new: str) -> DataFrame:
        """The entries of an old run whose anchor the new one has too, by a merge join of the runs."""
        anchors = self.spark.table(new).where("NOT known").groupBy("h").agg(F.count(F.lit(1)).alias("n")).select("h")
        return self.spark.table(old).where("NOT known").join(anchors.hint("merge"), "h", "left_semi")

    def _merged(self, old: list[str], new: str) -> DataFrame:
        out = self.spark.table(new)
        for name in old:
            out = out.unionByName(self.partners(name, new))
        return out

    def compact(self) -> None:
        """Merge all runs into one with the first entry of every context."""
        firsts = self._all().where("NOT known").groupBy("h", "g").agg(F.min(F.struct("seq", "doc", "at")).alias("top")).select("h", "g", "top.doc", "top.at", F.lit(False).alias("known"), "top.seq")
        merged, gone = self._write(firsts), self.runs
        self.runs = [merged]
        for name in gone:
            self.spark.sql(f"DROP TABLE {name}")

    def drop(self) -> None:
        for name in self.runs:
            self.spark.sql(f"DROP TABLE {name}")
        self.runs, self.texts = [], []


def op5_substring(spark: SparkSession, sf_dir: str, batches: int = 2) -> DataFrame:
    """The documents in batches by doc_id, so that earlier batches hold smaller doc_ids."""
    table = C.table(spark, sf_dir, "documents").select("doc_id", "text")
    docs = table.where("doc_id IS NOT NULL")
    lo, hi = docs.agg(F.min("doc_id"), F.max("doc_id")).first()
    cuts = [] if lo is None else [lo + (hi - lo + 1) * i // batches for i in range(1, batches)]
    index = PassageIndex(spark)
    parts = []
    for i in range(len(cuts) + 1):
        part = docs
        if i:
            part = part.where(F.col("doc_id") >= cuts[i - 1])
        if i < len(cuts):
            part = part.where(F.col("doc_id") < cuts[i])
        parts.append(index.add(part))
    parts.append(removal(table.where("doc_id IS NULL").withColumn("marks", F.lit(None).cast("array<struct<at:int,f:bigint,whole:boolean>>")), ("doc_id",)))
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out.select("doc_id", "n_words", "n_removed", F.sha2(F.col("kept").cast("binary"), 256).alias("kept_sha256"))

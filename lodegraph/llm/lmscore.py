"""Operator 6: cross-entropy difference of two matched n-gram models.

A target model (chosen texts) and a background model (all texts) are counted over the whole corpus in the same way and share one
vocabulary: every word. Both are bigram models with every word as a head and the start of a text as one more: P(w | h) mixes the
bigram estimate, (c(h, w) + 5 P(w)) / (c(h) + 5), with the unigram estimate P(w), by ``mixture``; unigram counts have 0.5 added,
for the vocabulary and one unseen word. A token's loss is -log2 P; a document's score is the mean over its tokens of target loss
minus background loss, so lower is more like the target.

What is counted grows with the corpus and stays distributed. Texts are put into pieces of about PIECE_BYTES, a stored table
bucketed by piece. A piece has its different words and bigrams, by 64-bit hashes in ascending order, with their counts; the range of
hashes is cut into slices of about SLICE_BYTES of text each, and a piece sends every slice one packed block of its part. A slice adds
up all pieces' counts and answers each with a block of the sums, in the order that was asked. The answers meet the pieces, whose
texts never move. So a common word has as many counts to add as there are pieces, not as it has occurrences.

Null and empty texts have no tokens and null losses. Texts of any length are scored whole; one that is longer than a piece is a piece
of its own. Repeated rows count, and are scored, each. Rows without a key are never targets. An empty table gives an empty table;
without a target text the target model is uniform. Columns to keep that are named like a result give way to it.
"""

from __future__ import annotations

import struct
import uuid

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, LongType, StructField, StructType

from . import common as C

PIECE_BYTES = 8 << 20
SLICE_BYTES = 32 << 20
RESULT = "n_tokens long, background_loss double, target_loss double, score double"


# --- blocks of numbers


def pack(columns: list[np.ndarray]) -> bytes:
    """Columns of 64-bit numbers as bytes: for each its length, its width, and its bytes by place, the empty ones left out."""
    parts = []
    for x in columns:
        planes = np.ascontiguousarray(np.ascontiguousarray(x, "<u8").view(np.uint8).reshape(-1, 8).T)
        width = 8 - int(planes.any(axis=1)[::-1].argmax()) if planes.any() else 0
        parts += [struct.pack("<QB", len(x), width), planes[:width].tobytes()]
    return zstandard.ZstdCompressor(level=1).compress(b"".join(parts))


def unpack(block: bytes) -> list[np.ndarray]:
    raw, at, out = zstandard.ZstdDecompressor().decompress(block), 0, []
    while at < len(raw):
        n, width = struct.unpack_from("<QB", raw, at)
        planes = np.zeros((8, n), np.uint8)
        planes[:width] = np.frombuffer(raw, np.uint8, n * width, at + 9).reshape(width, n)
        out.append(np.ascontiguousarray(planes.T).view("<u8").ravel())
        at += 9 + n * width
    return out


def rises(keys: np.ndarray) -> np.ndarray:
    """Ascending keys as their differences, which are shorter."""
    return np.diff(keys, prepend=np.uint64(0))


# --- pieces


def pieces(docs: DataFrame, key: str, keep: tuple[str, ...], text: str) -> DataFrame:
    """piece long, size long (bytes), and lists, row for row: texts, keys, and the columns ``keep`` as k0, k1, ... A stored table."""
    spark = docs.sparkSession
    C.bounded_batches(spark)

    def cut(batches):
        from pyspark import TaskContext

        at = TaskContext.get().partitionId() << 32

        def piece(parts, size):
            whole = pa.Table.from_batches(parts).combine_chunks()
            lists = [pa.ListArray.from_arrays(pa.array([0, whole.num_rows], pa.int32()), whole.column(c).combine_chunks()) for c in whole.column_names]
            return pa.RecordBatch.from_arrays([pa.array([at], pa.int64()), pa.array([size], pa.int64()), *lists], names=schema.names)

        parts, size = [], 0
        for batch in C.chunks(batches, "texts"):
            more = C.column(batch, "texts").nbytes
            if parts and size + more > PIECE_BYTES:
                yield piece(parts, size)
                at, parts, size = at + 1, [], 0
            parts.append(batch)
            size += more
        if parts:
            yield piece(parts, size)

    rows = docs.select(F.col(text).alias("texts"), F.col(key).alias("keys"), *(F.col(f"`{c}`").alias(f"k{i}") for i, c in enumerate(keep)))
    schema = StructType([StructField("piece", LongType()), StructField("size", LongType()), *(StructField(f.name, ArrayType(f.dataType)) for f in rows.schema.fields)])
    name = f"lodegraph_pieces_{uuid.uuid4().hex}"
    buckets = int(spark.conf.get("spark.sql.shuffle.partitions"))
    rows.mapInArrow(cut, schema).write.bucketBy(buckets, "piece").option("compression", "zstd").saveAsTable(name)
    C.made_table(name)
    return spark.table(name)


class Piece:
    """The different words and bigrams of texts, ascending, and where each token finds its own."""

    def __init__(self, texts: list[str | None]):
        self.many, one, _ = C.WordHasher().of([(t or "").encode() for t in texts])
        ends = np.cumsum(self.many)
        self.first = np.zeros(len(one), bool)
        self.first[(ends - self.many)[self.many > 0]] = True
        self.last = np.zeros(len(one), bool)
        self.last[ends[self.many > 0] - 1] = True
        self.words, self.word = np.unique(one, return_inverse=True)
        before = np.roll(one, 1)
        before[self.first] = 0  # the start of a text
        with np.errstate(over="ignore"):
            self.bigrams, self.bigram = np.unique(C.mix(C.mix(before + self.first) * C.ODD + one), return_inverse=True)

    def counts(self, marks: np.ndarray) -> tuple[list[np.ndarray], list[np.ndarray]]:
        """Of words: occurrences in all and in marked texts, then occurrences that another word follows; of bigrams: the first two."""
        marked = np.repeat(marks, self.many)
        every = np.ones(len(marked), bool)

        def of(at: np.ndarray, size: int, mask: np.ndarray) -> np.ndarray:
            return np.bincount(at[mask], minlength=size)

        words = [of(self.word, len(self.words), m) for m in (every, marked, ~self.last, marked & ~self.last)]
        return words, [of(self.bigram, len(self.bigrams), m) for m in (every, marked)]


BLOCKS = "slice long, piece long, words binary, bigrams binary"
ANSWERS = "piece long, slice long, words binary, bigrams binary, vocabulary long, tokens long, marked long, followed long, marked_followed long"


def blocks(stored: DataFrame, marks: DataFrame, slices: int) -> DataFrame:
    """For each piece and slice: the keys in the slice's range and their counts. ``marks``: of_piece, place (of marked texts)."""

    def ask(left: pa.Table, right: pa.Table) -> pa.Table:
        rows = []
        for i in range(left.num_rows):  # one row, or none
            texts = left.column("texts")[i].as_py()
            marked = np.zeros(len(texts), bool)
            marked[right.column("place").to_numpy()] = True
            p = Piece(texts)
            bounds = np.array([(s << 64) // slices for s in range(1, slices)], np.uint64)
            found = []
            for keys, counts in zip((p.words, p.bigrams), p.counts(marked)):
                cuts = [0, *np.searchsorted(keys, bounds).tolist(), len(keys)]
                found.append((keys, counts, cuts))
            for s in range(slices):
                parts = [pack([rises(keys[cuts[s] : cuts[s + 1]]), *(c[cuts[s] : cuts[s + 1]] for c in counts)]) for keys, counts, cuts in found if cuts[s] < cuts[s + 1]]
                if parts:
                    which = [cuts[s] < cuts[s + 1] for _, _, cuts in found]
                    whole = iter(parts)
                    rows.append((s, left.column("piece")[i].as_py(), *(next(whole) if w else None for w in which)))
        return pa.Table.from_pylist([dict(zip(("slice", "piece", "words", "bigrams"), r)) for r in rows], schema)

    schema = pa.schema([("slice", pa.int64()), ("piece", pa.int64()), ("words", pa.binary()), ("bigrams", pa.binary())])
    return stored.select("piece", "texts").groupBy("piece").cogroup(marks.groupBy("of_piece")).applyInArrow(ask, StructType.fromDDL(BLOCKS))


def answers(asked: DataFrame) -> DataFrame:
    """The sums over all pieces, to each piece in the order of its keys; and one row of totals for each slice, of piece -1."""

    names = StructType.fromDDL(ANSWERS).names

    def add(table: pa.Table) -> pa.Table:
        at = table.column("slice")[0].as_py()
        piece_ids = table.column("piece").to_pylist()
        replies = {}
        totals = [0] * 5
        for name in ("words", "bigrams"):
            held = [(i, unpack(b)) for i, b in enumerate(table.column(name).to_pylist()) if b is not None]
            replies[name] = [None] * len(piece_ids)
            if not held:
                continue
            with np.errstate(over="ignore"):
                keys, place = np.unique(np.concatenate([np.cumsum(c[0], dtype=np.uint64) for _, c in held]), return_inverse=True)
            sums = []
            for k in range(1, len(held[0][1])):
                total = np.zeros(len(keys), np.int64)
                np.add.at(total, place, np.concatenate([c[k] for _, c in held]).view(np.int64))
                sums.append(total)
            if name == "words":
                totals = [len(keys), *(int(x.sum()) for x in sums)]
            start = 0
            for i, c in held:
                mine = place[start : start + len(c[0])]
                replies[name][i] = pack([x[mine] for x in sums])
                start += len(c[0])
        n = len(piece_ids)
        fields = [pa.array([*piece_ids, -1]), pa.array([at] * (n + 1)), *(pa.array([*replies[x], None], pa.binary()) for x in ("words", "bigrams")), *(pa.array([0] * n + [t]) for t in totals)]
        return pa.table(fields, names=names)

    return asked.groupBy("slice").applyInArrow(add, StructType.fromDDL(ANSWERS))


def score(docs: DataFrame, targets: DataFrame, key: str = "doc_id", keep: tuple[str, ...] = ("doc_id",), text: str = "text", mixture: float = 0.6) -> DataFrame:
    """``keep`` columns, n_tokens long, background_loss, target_loss and score (bits a token; null without tokens).

    The target texts are the rows whose key is in ``targets``, a table with that column.
    """
    fields = StructType.fromDDL(RESULT)
    keep = tuple(c for c in dict.fromkeys(keep) if c not in fields.names)
    stored = pieces(docs, key, keep, text)
    slices = max(1, -(-(stored.agg(F.sum("size")).first()[0] or 0) // SLICE_BYTES))
    chosen = targets.select(F.col(key).alias("key")).where("key IS NOT NULL").distinct()
    marks = stored.select("piece", F.posexplode("keys").alias("place", "key")).join(chosen, "key").select(F.col("piece").alias("of_piece"), "place")
    told = C.materialise(answers(blocks(stored, marks, slices)), "lm-answers", "zstd")
    names = ("vocabulary", "tokens", "marked", "followed", "marked_followed")
    v, *totals = told.where("piece < 0").agg(*(F.coalesce(F.sum(n), F.lit(0)) for n in names)).first()
    tokens, starts = totals[:2], [totals[0] - totals[2], totals[1] - totals[3]]
    schema = StructType([*(docs.schema[c] for c in keep), *fields.fields])

    def losses(left: pa.Table, right: pa.Table) -> pa.Table:
        if not left.num_rows:
            return schema_of.empty_table()
        texts = left.column("texts")[0].as_py()
        p = Piece(texts)
        right = right.sort_by("slice")
        words, bigrams = ([np.concatenate(x).astype(float) for x in zip(*(unpack(b) for b in right.column(n).to_pylist() if b is not None))] for n in ("words", "bigrams"))
        some = p.many > 0
        begin = (np.cumsum(p.many) - p.many)[some]
        means = np.full((2, len(texts)), np.nan)
        for row in (0, 1):
            if not len(begin):
                break
            uni = (words[row][p.word] + 0.5) / (tokens[row] + 0.5 * (v + 1))
            head = np.where(p.first, starts[row], np.roll(words[2 + row][p.word], 1))
            loss = -np.log2(mixture * (bigrams[row][p.bigram] + 5.0 * uni) / (head + 5.0) + (1 - mixture) * uni)
            means[row, some] = np.add.reduceat(loss, begin) / p.many[some]
        out = [pa.array(p.many.astype(np.int64)), *(pa.array(x, mask=~some) for x in (means[0], means[1], means[1] - means[0]))]
        return pa.table([*(left.column(f"k{i}").combine_chunks().flatten() for i in range(len(keep))), *out], names=schema.names)

    from pyspark.sql.pandas.types import to_arrow_schema

    schema_of = to_arrow_schema(schema)
    return stored.drop("size", "keys").groupBy("piece").cogroup(told.where("piece >= 0").select("piece", "slice", "words", "bigrams").groupBy("piece")).applyInArrow(losses, schema)


def op6_lm_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Target: the documents that labels.quality marks 1."""
    return score(C.table(spark, sf_dir, "documents"), C.table(spark, sf_dir, "labels").where("quality = 1"))

"""Operator 10: quality rules by tokeniser fertility.

A public vocabulary with byte fallback cuts every word; a text's characters per token, share of byte-fallback tokens and
entropy of its tokens (over the entropy that as many different tokens would have) are compared with bands of its language.
A band reaches ``reach`` interquartile ranges beyond the quartiles of all texts of the language, and at least ``floor`` beyond,
so that a language whose texts are alike doesn't reject them. Base rules on words, symbols and repeats come first.

Null texts are empty: they have no words, and fail the base rules. Rows with a null language form a group. Counts and
quartiles cover all rows (quartiles are approximate, see ``accuracy``); an empty table gives an empty table.
"""

from __future__ import annotations

import math
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common as C

SYMBOLS = b"#*$%&|<>"
WINDOW = 8
MEASURES = ("chars_per_token", "byte_share", "entropy")
FLOOR = {"chars_per_token": 0.4, "byte_share": 0.05, "entropy": 0.1}


@lru_cache(maxsize=2)
def pieces(path: str):
    import sentencepiece

    return sentencepiece.SentencePieceProcessor(model_file=path)


def repeat_words(h: np.ndarray, window: int = WINDOW) -> int:
    """Words in windows that occur twice or more."""
    r = C.rolling(h, window)
    if len(r) < 2:
        return 0
    order = np.argsort(r, kind="stable")
    s = r[order]
    same = s[1:] == s[:-1]
    if not same.any():
        return 0
    twice = np.zeros(len(r), bool)
    twice[order[1:][same]] = twice[order[:-1][same]] = True
    edge = np.zeros(len(h) + 1, np.int64)
    np.add.at(edge, np.flatnonzero(twice), 1)
    np.add.at(edge, np.flatnonzero(twice) + window, -1)
    return int((np.cumsum(edge) > 0).sum())


def measure(df: DataFrame, path: str, keep=("doc_id",), text: str = "text") -> DataFrame:
    """``keep`` columns, the base counts, n_tokens and the three measures (null for texts without words)."""

    def make():
        model = pieces(path)
        is_byte = np.array([model.is_byte(i) for i in range(model.get_piece_size())])
        wide = "<u4"
        hashes = C.hash_memo()
        memo: dict[bytes, bytes] = {}

        def run(batch: pa.RecordBatch) -> dict[str, pa.Array]:
            texts = C.as_bytes(batch, text)
            parts = [t.split() for t in texts]
            new = list(set().union(*parts) - memo.keys())
            if len(memo) + len(new) > C.CACHE_ENTRIES:
                memo.clear()
                new = list(set().union(*parts))
            for w, ids in zip(new, model.encode([w.decode() for w in new], num_threads=1)):
                memo[w] = np.array(ids, wide).tobytes()
            rows = []
            for t, words in zip(texts, parts):
                # every byte that doesn't continue a character starts one; the white space outside words is ASCII
                joined = b"".join(words)
                chars = len(joined) if joined.isascii() else len(joined.decode())
                lines = [x for x in t.split(b"\n") if x.strip()]
                ids = np.frombuffer(b"".join(map(memo.__getitem__, words)), wide)
                n = len(ids)
                if n:
                    c = np.bincount(ids)
                    c = c[c > 0]
                    bits = math.log2(n) - float((c * np.log2(c)).sum()) / n
                    measures = (chars / n, float(is_byte[ids].mean()), bits / math.log2(n) if n > 1 else 1.0)
                else:
                    measures = (None, None, None)
                rows.append((len(words), chars, sum(map(t.count, (SYMBOLS[i : i + 1] for i in range(len(SYMBOLS))))), len(lines) - len(set(lines)), repeat_words(C.word_hashes(words, hashes)), n, *measures))
            kinds = [pa.int64()] * 6 + [pa.float64()] * 3
            return {name: pa.array(x, kind) for name, x, kind in zip(NAMES, zip(*rows), kinds)}

        return run

    return C.map_texts(df, make, ", ".join(f"{n} {'long' if n.startswith('n_') or n == 'word_chars' else 'double'}" for n in NAMES), keep, text)


NAMES = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_tokens", *MEASURES)


def judge(measured: DataFrame, group: str = "lang", reach: float = 4.0, accuracy: int = 2000) -> DataFrame:
    """Add base_failed and kept. ``measured`` is read twice, so it should be a stored table.

    Quartiles are those of the group's texts that pass the base rules.
    """
    base = measured.withColumn("base_failed", (F.col("n_words") < 20) | (100 * F.col("n_repeat_words") > 30 * F.col("n_words")))
    quartiles = [F.percentile_approx(m, F.array(F.lit(0.25), F.lit(0.75)), accuracy).alias(f"q_{m}") for m in MEASURES]
    bands = base.where(~F.col("base_failed")).groupBy(F.col(group).alias("band_of")).agg(*quartiles)
    joined = base.join(bands, F.col(group).eqNullSafe(F.col("band_of")), "left")
    inside = F.lit(True)
    for m in MEASURES:
        low, high = F.col(f"q_{m}")[0], F.col(f"q_{m}")[1]
        room = F.greatest(reach * (high - low), F.lit(FLOOR[m]))
        inside = inside & (F.col(m) <= high + room) & ((F.col(m) >= low - room) if m != "byte_share" else F.lit(True))
    return joined.withColumn("kept", ~F.col("base_failed") & F.coalesce(inside, F.lit(False))).drop("band_of", *(f"q_{m}" for m in MEASURES))


def op10_fertility(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers as P

    measured = C.materialise(measure(C.table(spark, sf_dir, "documents"), P.path("piece_bpe_32k.model"), ("doc_id", "lang")), "fertility")
    return judge(measured).select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", *MEASURES)

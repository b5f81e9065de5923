"""Operator 9: token counts by a linear longest-match automaton.

The vocabulary is a byte trie. Every node carries a failure link and the number of tokens popped on following it, worked out
once in order of depth, so that greedy longest-match lengths come from one walk over the bytes of a word, without building
pieces. A word is matched with a leading space; entries that begin with a space can therefore match only at its start, all
others continue a word. A word that can't be matched whole counts as one unknown token.

Null and empty texts count no words and no tokens; an empty table gives an empty table.
"""

from __future__ import annotations

from collections.abc import Iterable
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from . import common as C
from .bpe import VOCABULARY, read_ranks


class Matcher:
    def __init__(self, vocabulary: Iterable[bytes]):
        child: dict[int, int] = {}
        up, ends = [(0, 0)], [False]
        for token in vocabulary:
            v = 0
            for c in token:
                k = v << 8 | c
                if (u := child.get(k)) is None:
                    child[k] = u = len(up)
                    up.append((v, c))
                    ends.append(False)
                v = u
            if token:
                ends[v] = True
        depth = [0] * len(up)
        for v in range(1, len(up)):
            depth[v] = depth[up[v][0]] + 1  # a parent is made before its children
        fail, popped = [-1] * len(up), [0] * len(up)
        for v in sorted(range(1, len(up)), key=depth.__getitem__):
            if ends[v]:
                fail[v], popped[v] = 0, 1
                continue
            parent, c = up[v]
            z, n = fail[parent], popped[parent]
            while z >= 0 and z << 8 | c not in child:
                z, n = fail[z], n + popped[z]
            if z >= 0:
                fail[v], popped[v] = child[z << 8 | c], n
        self.child, self.fail, self.popped = child, fail, popped

    def count(self, word: bytes) -> int:
        """Number of greedy longest-match tokens of the word; -1 if it can't be matched whole."""
        child, fail, popped = self.child, self.fail, self.popped
        v = n = 0
        for c in word:
            while (u := child.get(v << 8 | c)) is None:
                n += popped[v]
                v = fail[v]
                if v < 0:
                    return -1
            v = u
        while v:
            n += popped[v]
            v = fail[v]
            if v < 0:
                return -1
        return n


@lru_cache(maxsize=2)
def matcher(path: str) -> Matcher:
    return Matcher(read_ranks(path))


def token_counts(df: DataFrame, path: str, keep=("doc_id",), text: str = "text") -> DataFrame:
    """``keep`` columns, n_words, n_tokens, n_unknown (words that can't be matched) — all long. ``path`` as in ``bpe.encode``."""

    def make():
        m = matcher(path)
        memo = C.Memo(lambda w: m.count(b" " + w))

        def run(batch: pa.RecordBatch) -> dict[str, pa.Array]:
            words, tokens, unknown = [], [], []
            for t in C.as_bytes(batch, text):
                counts = list(map(memo.__getitem__, t.split()))
                bad = counts.count(-1)
                words.append(len(counts))
                tokens.append(sum(counts) + 2 * bad)
                unknown.append(bad)
            return {n: pa.array(x, pa.int64()) for n, x in (("n_words", words), ("n_tokens", tokens), ("n_unknown", unknown))}

        return run

    return C.map_texts(df, make, "n_words long, n_tokens long, n_unknown long", keep, text)


def op9_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers as P

    return token_counts(C.table(spark, sf_dir, "documents"), P.path(VOCABULARY))

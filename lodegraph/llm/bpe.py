"""Operator 7: byte-level BPE encoding and decoding.

Every match of the splitting pattern is merged on its own. A segment tree over the byte positions of the piece holds at its
root the leftmost pair of least rank; a merge changes the leaves of at most three positions (the merged pair, its right part,
which dies, and the live left neighbour), each in a logarithmic number of steps. Pieces of up to SHORT bytes are merged many at
a time, one tree a row of a NumPy array; longer ones have a tree of their own.

Null and empty texts have no tokens; texts of any length are encoded whole; equal texts give equal ids; an empty table gives
an empty table; columns named like a result are replaced by it.
"""

from __future__ import annotations

import base64
import re
from functools import lru_cache

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common as C

SHORT = 64
NONE = np.int64(1) << 62
#: Characters for which the classes of ``re`` and the Unicode properties in the pattern agree.
PLAIN = re.compile("[^\x00-\x1b\x20-\xb1\xb4-\xb8\xba\xbb\xbf-ɏ]")
#: What QUICK does on such characters, as a pattern of the ``regex`` library; other patterns are always run as they are.
SLOW = "'s|'t|'re|'ve|'m|'ll|'d| ?\\p{L}+| ?\\p{N}+| ?[^\\s\\p{L}\\p{N}]+|\\s+(?!\\S)|\\s+"
QUICK = re.compile(r"'s|'t|'re|'ve|'m|'ll|'d| ?[^\W\d_]+| ?\d+| ?(?:[^\s\w]|_)+|\s+(?!\S)|\s+")
VOCABULARY = "byte_bpe_multi_50k.tiktoken"


def read_ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as f:
        return {base64.b64decode(a): int(b) for a, b in (line.split() for line in f if line.strip())}


class Coder:
    """Encodes and decodes by a table of ranks; ids are ranks."""

    def __init__(self, ranks: dict[bytes, int], pattern: str):
        self.ranks = ranks
        self.bytes_of = {i: t for t, i in ranks.items()}
        self.slow, self.has_quick = regex.compile(pattern), pattern == SLOW
        self.byte_ids = np.array([ranks[bytes([b])] for b in range(256)], np.int64)
        pairs = {}
        for t, i in ranks.items():
            for cut in range(1, len(t)):
                a, b = ranks.get(t[:cut]), ranks.get(t[cut:])
                if a is not None and b is not None:
                    pairs[a << 32 | b] = i
        self.pairs = pairs
        self.keys = np.array(sorted(pairs), np.int64)
        self.merged = np.array([pairs[k] for k in self.keys.tolist()], np.int64)
        self.memo: dict[str, bytes] = {}

    def split(self, text: str) -> list[str]:
        return QUICK.findall(text) if self.has_quick and not PLAIN.search(text) else [m[0] for m in self.slow.finditer(text)]

    def pair_ranks(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Ranks of the pairs; NONE where either is missing (below 0) or they don't merge."""
        key = (a << np.int64(32)) | np.maximum(b, 0)
        at = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
        return np.where((self.keys[at] == key) & (a >= 0) & (b >= 0), self.merged[at], NONE)

    def merge_many(self, pieces: list[bytes]) -> list[np.ndarray]:
        """Ids of pieces of 2 to SHORT bytes."""
        out: list[np.ndarray] = [None] * len(pieces)  # type: ignore[list-item]
        lengths = np.array([len(p) for p in pieces])
        width = 2
        while width <= SHORT:
            here = np.flatnonzero((lengths <= width) & (lengths > width // 2) if width > 2 else lengths <= 2)
            for start in range(0, len(here), 8192):
                part = here[start : start + 8192]
                for i, ids in zip(part.tolist(), self._rows([pieces[i] for i in part.tolist()], lengths[part], width)):
                    out[i] = ids
            width *= 2
        return out

    def _rows(self, pieces: list[bytes], lengths: np.ndarray, w: int) -> list[np.ndarray]:
        n = len(pieces)
        raw = np.frombuffer(b"".join(p.ljust(w, b"\0") for p in pieces), np.uint8).reshape(n, w)
        place = np.arange(w + 1)
        ids = np.full((n, w + 1), -1, np.int64)  # the last column stands for "no position"
        ids[:, :w] = np.where(place[:w] < lengths[:, None], self.byte_ids[raw], -1)
        after = np.tile(np.minimum(place + 1, w), (n, 1))
        after[place[None, :] + 1 >= lengths[:, None]] = w
        before = np.tile(place - 1, (n, 1))
        before[:, 0] = w
        tree = np.full((n, 2 * w), NONE, np.int64)
        rank = self.pair_ranks(ids[:, : w - 1].ravel(), ids[:, 1:w].ravel()).reshape(n, w - 1)
        tree[:, w : 2 * w - 1] = np.where(rank < NONE, rank * w + place[: w - 1], NONE)
        for node in range(w - 1, 0, -1):
            np.minimum(tree[:, 2 * node], tree[:, 2 * node + 1], out=tree[:, node])
        row = np.flatnonzero(tree[:, 1] < NONE)
        while len(row):
            best = tree[row, 1]
            at, new = best % w, best // w
            dead = after[row, at]
            right, left = after[row, dead], before[row, at]
            ids[row, at] = new
            ids[row, dead] = -1
            after[row, at] = right
            before[row, right] = at  # right may be the column that stands for none
            for leaf, value in (
                (dead, None),
                (at, self.pair_ranks(new, np.where(right < w, ids[row, right], -1))),
                (left, self.pair_ranks(np.where(left < w, ids[row, left], -1), new)),
            ):
                real = leaf < w
                r, p = row[real], leaf[real]
                node = p + w
                tree[r, node] = NONE if value is None else np.where(value[real] < NONE, value[real] * w + p, NONE)
                while len(node) and node[0] > 1:  # all leaves are on one level
                    node = node >> 1
                    tree[r, node] = np.minimum(tree[r, 2 * node], tree[r, 2 * node + 1])
            row = row[tree[row, 1] < NONE]
        body = ids[:, :w]
        return [body[i][body[i] >= 0] for i in range(n)]

    def merge_long(self, piece: bytes) -> list[int]:
        """Ids of one piece, with a segment tree of its own."""
        n = len(piece)
        w = 1 << (n - 1).bit_length()
        none = int(NONE)
        ids = [int(self.byte_ids[b]) for b in piece]
        after, before = [*range(1, n + 1)], [*range(-1, n - 1)]
        get = self.pairs.get

        def leaf(i: int, j: int) -> int:
            r = get(ids[i] << 32 | ids[j]) if j < n else None
            return none if r is None else r * w + i

        tree = [none] * (2 * w)
        tree[w : w + n] = [leaf(i, i + 1) for i in range(n)]
        for node in range(w - 1, 0, -1):
            a, b = tree[2 * node], tree[2 * node + 1]
            tree[node] = a if a < b else b

        def put(i: int, value: int) -> None:
            node = i + w
            tree[node] = value
            while node > 1:
                node >>= 1
                a, b = tree[2 * node], tree[2 * node + 1]
                tree[node] = a if a < b else b

        while tree[1] < none:
            new, i = divmod(tree[1], w)
            j = after[i]
            ids[i], ids[j] = new, -1
            after[i] = k = after[j]
            if k < n:
                before[k] = i
            put(j, none)
            put(i, leaf(i, k))
            if before[i] >= 0:
                put(before[i], leaf(before[i], i))
        return [x for x in ids if x >= 0]

    def learn(self, pieces: set[str]) -> None:
        """Put the ids of pieces into the memo, as little-endian 32-bit numbers."""
        new = [p for p in pieces if p not in self.memo]
        if len(self.memo) + len(new) > C.CACHE_ENTRIES:
            self.memo.clear()
            new = list(pieces)
        short: list[str] = []
        for p in new:
            raw = p.encode()
            if (whole := self.ranks.get(raw)) is not None:
                self.memo[p] = whole.to_bytes(4, "little")
            elif len(raw) <= SHORT:
                short.append(p)
            else:
                self.memo[p] = np.array(self.merge_long(raw), "<u4").tobytes()
        for p, ids in zip(short, self.merge_many([p.encode() for p in short])):
            self.memo[p] = ids.astype("<u4").tobytes()

    def encode_many(self, texts: list[str]) -> list[bytes]:
        """Ids of each text as little-endian unsigned 32-bit numbers."""
        parts = [self.split(t) for t in texts]
        self.learn(set().union(*parts))
        return [b"".join(map(self.memo.__getitem__, p)) for p in parts]

    def decode(self, ids: bytes) -> bytes:
        return b"".join(map(self.bytes_of.__getitem__, np.frombuffer(ids, "<u4").tolist()))


@lru_cache(maxsize=2)
def coder(path: str, pattern: str) -> Coder:
    return Coder(read_ranks(path), pattern)


def encode(df: DataFrame, path: str, pattern: str, keep=("doc_id",), text: str = "text") -> DataFrame:
    """``keep`` columns, n_tokens long, token_ids binary (little-endian unsigned 32-bit), decoded binary (the bytes that the ids stand for).

    ``path`` names a rank file that every executor can open.
    """

    def make():
        c = coder(path, pattern)
        C.keep_until_other("bpe", coder.cache_clear)

        def run(batch: pa.RecordBatch) -> dict[str, pa.Array]:
            texts = [t or "" for t in C.column(batch, text).to_pylist()]
            ids = c.encode_many(texts)
            return {"n_tokens": pa.array([len(i) // 4 for i in ids], pa.int64()), "token_ids": pa.array(ids, pa.binary()), "decoded": pa.array(map(c.decode, ids), pa.binary())}

        return run

    return C.map_texts(df, make, "n_tokens long, token_ids binary, decoded binary", keep, text)


def op7_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers as P

    out = encode(C.table(spark, sf_dir, "documents"), P.path(VOCABULARY), P.PATTERN)
    return out.select("doc_id", "n_tokens", F.sha2("token_ids", 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))

"""Operator 2: document quality from a linear-chain conditional random field over lines.

Every line with a word is good or bad. A line's evidence is its own features and those of the lines before and after it; a
transition matrix ties neighbours. Training maximises the likelihood of line labels, each line taking its document's label;
inference runs forward-backward, and a document's score is the mean of its lines' probabilities of being good, weighted by
their lengths in bytes.

The field is learned from a bounded sample: at most ``max_docs`` labelled documents, those with the least hash of doc_id, whole
whatever their length, as long as the documents before them have fewer than ``max_lines`` lines together. Scores come from whole
texts of any length. Documents without a word, null and empty texts, and all documents when nothing could be learned, score
``empty_score``. Where a doc_id has several labels, each is learned from (ties in hash go by doc_id, then label); repeated rows
are learned from, and scored, each; rows without a doc_id are scored, never learned from. An empty table gives an empty table.
Columns to keep that are named score give way to the result.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from . import common as C

#: Classes of bytes that are counted in each line.
CLASSES = (b"#*$%&<>{}\\^~=", b"|", b"!", b"0123456789", b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b".,;:?", b"@/_+-")
OWN = len(CLASSES) + 9
WIDTH = 3 * OWN
MOST_WEIGHT = 8


def line_features(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Features of all lines with a word [lines, WIDTH], their lengths, and the number of such lines of each text."""
    lines: list[bytes] = []
    counts, words, distinct, again, longest, common, heads = [], [], [], [], [], [], []
    for t in texts:
        seen: set[bytes] = set()
        n = 0
        for line in t.split(b"\n"):
            w = line.split()
            if not w:
                continue
            n += 1
            lines.append(line)
            bag = set(w)
            words.append(len(w))
            distinct.append(len(bag))
            longest.append(max(map(len, bag)))
            common.append(sum(a == b for a, b in zip(w, w[1:])) if len(bag) < len(w) else 0)
            again.append(line in seen)
            heads.append(line[:1].islower())
            seen.add(line)
        counts.append(n)
    total = len(lines)
    own = np.zeros((total, OWN))
    lengths = np.array([len(x) for x in lines], np.int64)
    if total:
        raw = np.frombuffer(b"".join(lines), np.uint8)
        starts = np.concatenate([[0], np.cumsum(lengths)[:-1]])
        size = lengths.astype(float)
        for i, members in enumerate(CLASSES):
            flags = np.zeros(256, np.uint8)
            flags[np.frombuffer(members, np.uint8)] = 1
            own[:, i] = np.minimum(np.add.reduceat(flags[raw], starts, dtype=np.int64) / size * 4, 2.0)
        k, w, d = len(CLASSES), np.array(words, float), np.array(distinct, float)
        own[:, k] = 1 - d / w
        own[:, k + 1] = again
        own[:, k + 2] = np.array(common) / w
        own[:, k + 3] = np.log1p(w) / 4
        own[:, k + 4] = np.minimum(size / w / 10, 3)
        own[:, k + 5] = np.minimum(np.array(longest) / 40, 3)
        own[:, k + 6] = w < 4
        own[:, k + 7] = (1 - d / w) * (w > 30)
        own[:, k + 8] = heads
    nearby = np.zeros((total, WIDTH))
    nearby[:, :OWN] = own
    doc = np.repeat(np.arange(len(texts)), counts)
    if total > 1:
        same = (doc[1:] == doc[:-1])[:, None]
        nearby[1:, OWN : 2 * OWN] = own[:-1] * same
        nearby[:-1, 2 * OWN :] = own[1:] * same
    return nearby, lengths, np.array(counts, np.int64)


class Field:
    """Weights of a chain with states 0 (bad) and 1 (good)."""

    def __init__(self, theta: np.ndarray):
        self.theta = theta
        self.w, self.bias, self.edge = theta[:WIDTH], theta[WIDTH], theta[WIDTH + 1 :].reshape(2, 2)

    def marginals(self, x: np.ndarray, counts: np.ndarray, weights: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray, float]:
        """P(good) of each line, the expected transitions (2, 2), each document by its weight, and the sum of the log partition functions.

        Documents go side by side, in order of length, so that each step handles one line of every document that has one.
        """
        unary = x @ self.w + self.bias
        good = np.zeros(len(x))
        pairs = np.zeros((2, 2))
        docs = np.flatnonzero(counts)
        docs = docs[np.argsort(-counts[docs], kind="stable")]
        if not len(docs):
            return good, pairs, 0.0
        first = np.concatenate([[0], np.cumsum(counts)[:-1]])[docs]
        many = counts[docs]
        weight = np.ones(len(docs)) if weights is None else weights[docs]
        steps = int(many[0])
        alive = np.searchsorted(-many, -np.arange(steps), side="left")  # documents with more than t lines
        a = np.zeros((len(docs), 2))
        a[:, 1] = unary[first]
        forward = [a]
        for t in range(1, steps):
            n = alive[t]
            before = forward[-1][:n]
            a = np.logaddexp(before[:, :1] + self.edge[0], before[:, 1:] + self.edge[1])
            a[:, 1] += unary[first[:n] + t]
            forward.append(a)
        log_z = np.zeros(len(docs))
        b = np.zeros((0, 2))
        for t in range(steps - 1, -1, -1):
            n = alive[t]
            here = np.zeros((n, 2))
            if len(b):
                m = len(b)
                onward = b.copy()
                onward[:, 1] += unary[first[:m] + t + 1]
                here[:m] = np.logaddexp(self.edge[:, 0] + onward[:, :1], self.edge[:, 1] + onward[:, 1:])
                joint = forward[t][:m, :, None] + self.edge + onward[:, None, :]
                share = np.exp(joint - np.logaddexp(here[:m, 0] + forward[t][:m, 0], here[:m, 1] + forward[t][:m, 1])[:, None, None])
                pairs += np.tensordot(weight[:m], share, 1)
            b = here
            both = forward[t] + b
            z = np.logaddexp(both[:, 0], both[:, 1])
            good[first[:n] + t] = np.exp(both[:, 1] - z)
            if t == 0:
                log_z = z
        return good, pairs, float(log_z.sum())


def fit(x: np.ndarray, counts: np.ndarray, labels: np.ndarray, rounds: int = 300, penalty: float = 1e-3) -> Field:
    """Maximise the penalised likelihood by gradient steps with per-weight scales (Adam).

    Documents of the rarer class weigh more, up to MOST_WEIGHT times, so that both classes weigh about alike.
    """
    many = np.bincount(labels, minlength=2)
    rare = int(many.argmin())
    weights = np.where(labels == rare, np.clip(many.max() // max(1, many.min()), 1, MOST_WEIGHT), 1).astype(float)
    of_line = np.repeat(weights, counts)
    labelled = of_line * np.repeat(labels, counts)
    theta = np.zeros(WIDTH + 5)
    m, v = np.zeros_like(theta), np.zeros_like(theta)
    seen = np.zeros((2, 2))
    inner = np.maximum(counts - 1, 0) * weights
    for y in (0, 1):
        seen[y, y] = inner[labels == y].sum()
    target = np.concatenate([x.T @ labelled, [labelled.sum()], seen.ravel()])
    n = max(1.0, weights.sum())
    for i in range(1, rounds + 1):
        field = Field(theta)
        good, pairs, _ = field.marginals(x, counts, weights)
        good *= of_line
        slope = (target - np.concatenate([x.T @ good, [good.sum()], pairs.ravel()])) / n - penalty * theta
        m, v = 0.9 * m + 0.1 * slope, 0.99 * v + 0.01 * slope * slope
        theta = theta + 0.1 * (m / (1 - 0.9**i)) / (np.sqrt(v / (1 - 0.99**i)) + 1e-8)
    return Field(theta)


def learn(docs: DataFrame, labels: DataFrame, key: str = "doc_id", text: str = "text", label: str = "quality", max_docs: int = 3000, max_lines: int = 300_000) -> Field | None:
    """Learn from the texts of ``docs`` that ``labels`` marks 0 or 1; None if there aren't both.

    The sample is drawn from the labels alone and sent to the texts, so no text is shuffled.
    """
    known = labels.where(F.col(key).isNotNull() & F.col(label).isin(0, 1)).select(key, F.col(label).cast("int").alias("label"))
    chosen = known.orderBy(F.xxhash64(key), key, "label").limit(max_docs).withColumn("rank", F.xxhash64(key))
    sample = docs.select(key, text).join(F.broadcast(chosen), key)  # at most max_docs rows

    def features(batches):
        for batch in C.chunks(batches, text):
            x, _, counts = line_features(C.as_bytes(batch, text))
            cuts = np.concatenate([[0], np.cumsum(counts)])
            rows = [x[a:b].astype("<f4").tobytes() for a, b in zip(cuts, cuts[1:])]
            yield pa.RecordBatch.from_arrays([C.column(batch, "rank"), C.column(batch, "label"), pa.array(counts), pa.array(rows, pa.binary())], names=["rank", "label", "n", "x"])

    made = sample.select(text, "rank", "label").mapInArrow(features, StructType.fromDDL("rank long, label int, n long, x binary")).where("n > 0")
    # at most max_docs documents (and their repeats) are put in order
    before = F.sum("n").over(Window.orderBy("rank", "label", "x").rowsBetween(Window.unboundedPreceding, -1))
    rows = C.materialise(made, "quality-lines").withColumn("before", F.coalesce(before, F.lit(0))).where(F.col("before") < max_lines).select("label", "x").collect()
    if len({r.label for r in rows}) < 2:
        return None
    rows.sort(key=lambda r: (r.label, bytes(r.x)))  # the order of rows doesn't change the sums
    x = [np.frombuffer(r.x, "<f4").reshape(-1, WIDTH) for r in rows]
    return fit(np.concatenate(x).astype(float), np.array([len(a) for a in x]), np.array([r.label for r in rows]))


def score(df: DataFrame, field: Field | None, keep=("doc_id",), text: str = "text", empty_score: float = 0.0) -> DataFrame:
    """``keep`` columns and score double (0 to 1)."""
    theta = None if field is None else field.theta

    def make():
        chain = None if theta is None else Field(theta)

        def run(batch: pa.RecordBatch) -> dict[str, pa.Array]:
            texts = C.as_bytes(batch, text)
            out = np.full(len(texts), empty_score)
            if chain is not None:
                x, lengths, counts = line_features(texts)
                good, _, _ = chain.marginals(x, counts)
                at = np.flatnonzero(counts)
                if len(at):
                    starts = np.concatenate([[0], np.cumsum(counts)[:-1]])[at]
                    out[at] = np.add.reduceat(good * lengths, starts) / np.add.reduceat(lengths, starts)
            return {"score": pa.array(np.clip(out, 0.0, 1.0))}

        return run

    return C.map_texts(df, make, "score double", keep, text)


def training_labels(labels: DataFrame, folds: int = 5) -> DataFrame:
    """The labels outside the held-out fold."""
    return labels.where(C.crc_fold("doc_id", folds) != 0)


def op2_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = C.table(spark, sf_dir, "documents"), C.table(spark, sf_dir, "labels")
    scored = score(docs, learn(docs, training_labels(labels)))
    held_out = F.coalesce(C.crc_fold("doc_id", 5), F.lit(-1)) == 0
    return scored.select("doc_id", held_out.alias("held_out"), "score", (F.col("score") >= 0.3).cast("int").alias("predicted"))

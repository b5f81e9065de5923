"""Shared pieces of the training-data operators: words, hashes, batches and shared folders.

A *word* is a maximal run of bytes other than space and \\t \\n \\v \\f \\r, which is what ``bytes.split()`` yields.
"""

from __future__ import annotations

import ctypes
import gc
import time
import uuid
from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

CHUNK_BYTES = 2 << 20
CHUNK_ROWS = 1000
CACHE_ENTRIES = 300_000
RELEASE_AFTER = 0.5  # seconds that a write took whose shuffles are worth removing at once
COLLECT_AFTER = 3  # seconds that a write took after which executors' heaps are worth shrinking
ODD = np.uint64(0x9E3779B97F4A7C15)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that the driver and all executors share: spark.checkpoint.dir. Where that is unset, it is set beside the warehouse,
    unless that is a folder of this machine and the executors are on others."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        warehouse = spark.conf.get("spark.sql.warehouse.dir")
        if not spark.sparkContext.master.startswith("local[") and warehouse.startswith(("file:", "/")):
            raise ValueError("spark.checkpoint.dir is unset, and the warehouse isn't in a file system that executors share")
        base = warehouse.rstrip("/") + "/_lodegraph_shared"
    return base.rstrip("/")


_made: dict[str, list[str]] = {"paths": [], "tables": []}


def materialise(df: DataFrame, tag: str, compression: str = "snappy") -> DataFrame:
    """Write ``df`` as Parquet to the shared folder and read it back: cuts the lineage, survives lost executors."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/lodegraph-{tag}-{uuid.uuid4().hex}"
    _made["paths"].append(path)
    begun = time.monotonic()
    df.write.option("compression", compression).parquet(path)
    took = time.monotonic() - begun
    if took >= COLLECT_AFTER:
        shrink_heaps(spark)
    if took >= RELEASE_AFTER:
        # shuffles that nothing refers to any more lie on the executors' disks until the driver collects garbage, which may be never;
        # Spark itself refers to its last job, and events that still wait for listeners do
        spark.range(1).collect()
        spark._jsc.sc().listenerBus().waitUntilEmpty()
        spark._jvm.System.gc()
    return spark.read.schema(df.schema).parquet(path)


def shrink_heaps(spark: SparkSession) -> int:
    """Have each executor collect all its garbage, and return how many were asked.

    A JVM's heap grows while a job runs and gives memory back only then; otherwise the needs of all jobs so far add up, beside the Python workers.
    """
    executors = spark._jsc.sc().getExecutorMemoryStatus().size() - 1  # one is the driver
    if executors > 0:
        spark.range(0, executors, 1, executors).select(F.expr("java_method('java.lang.System', 'gc')")).collect()  # a row for each executor
    return executors


_worker: dict = {"operator": None, "drops": {}}


def keep_until_other(name: str, drop: Callable[[], None]) -> None:
    """``drop`` frees what an operator keeps in this Python worker from task to task; it is called once a task of another one begins."""
    _worker["drops"][name] = drop


def take_over(operator: str) -> None:
    """Free what tasks of other operators have left in this Python worker, which lives on from stage to stage."""
    if _worker["operator"] == operator:
        return
    _worker["operator"] = operator
    while _worker["drops"]:
        _worker["drops"].popitem()[1]()
    gc.collect()
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # glibc's
    if trim is not None:
        trim(0)


def made_table(name: str) -> None:
    _made["tables"].append(name)


def clean(spark: SparkSession) -> None:
    """Remove what operators have stored on the way. Results that weren't written or read before are lost with it."""
    while _made["paths"]:
        p = spark._jvm.org.apache.hadoop.fs.Path(_made["paths"].pop())
        p.getFileSystem(spark._jsc.hadoopConfiguration()).delete(p, True)
    while _made["tables"]:
        spark.sql(f"DROP TABLE IF EXISTS {_made['tables'].pop()}")


def bounded_batches(spark: SparkSession) -> None:
    """Hand at most CHUNK_ROWS rows at once to Python: both sides hold a batch whole, and rows can be long."""
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if not 0 < int(spark.conf.get(name)) <= CHUNK_ROWS:
        spark.conf.set(name, str(CHUNK_ROWS))


def crc_fold(key: str, folds: int) -> Column:
    """crc32 of the key as text, modulo ``folds``."""
    return F.crc32(F.col(key).cast("string").cast("binary")) % folds


def chunks(batches: Iterable[pa.RecordBatch], text: str = "text") -> Iterator[pa.RecordBatch]:
    """Split record batches so that each piece has at most CHUNK_ROWS rows and about CHUNK_BYTES of text (one row at least)."""
    for batch in batches:
        if not batch.num_rows:
            continue
        sizes = pc.binary_length(batch.column(batch.schema.get_field_index(text))).fill_null(0).to_numpy(zero_copy_only=False)
        piece = np.maximum(np.cumsum(sizes) // CHUNK_BYTES, np.arange(len(sizes)) // CHUNK_ROWS)
        cuts = [0, *(np.flatnonzero(np.diff(piece)) + 1).tolist(), batch.num_rows]
        for a, b in zip(cuts, cuts[1:]):
            if b > a:
                yield batch.slice(a, b - a)


def column(batch: pa.RecordBatch, name: str) -> pa.Array:
    return batch.column(batch.schema.get_field_index(name))


def as_bytes(batch: pa.RecordBatch, name: str = "text") -> list[bytes]:
    """A string column as UTF-8 bytes; null becomes b''."""
    return [x or b"" for x in column(batch, name).cast(pa.large_binary()).to_pylist()]


class Memo(dict):
    """A bounded memo of a function of one argument; it is emptied when full, which changes speed only."""

    def __init__(self, function: Callable, limit: int = CACHE_ENTRIES):
        super().__init__()
        self.function, self.limit = function, limit

    def __missing__(self, key):
        if len(self) >= self.limit:
            self.clear()
        self[key] = value = self.function(key)
        return value


def word_hashes(words: list[bytes], memo: Memo) -> np.ndarray:
    return np.fromiter(map(memo.__getitem__, words), np.uint64, len(words))


def hash_memo(seed: int = 0) -> Memo:
    digest = xxhash.xxh3_64_intdigest
    return Memo(lambda w: digest(w, seed))


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit values (the finaliser of splitmix64)."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def rolling(h: np.ndarray, k: int) -> np.ndarray:
    """Hashes of all runs of k consecutive values: element i stands for h[i:i+k]; empty when there are fewer."""
    if len(h) < k:
        return h[:0]
    out, done, base = mix(h), 1, ODD
    with np.errstate(over="ignore"):
        acc, have, power = None, 0, ODD  # acc covers `have` values; out covers `done`; power is ODD ** done
        rest = k
        while True:
            if rest & 1:
                acc, have = (out, done) if acc is None else (acc[: len(h) - have - done + 1] * power + out[have : have + len(h) - have - done + 1], have + done)
            rest >>= 1
            if not rest:
                break
            m = len(out) - done
            out, done, power = out[:m] * power + out[done : done + m], done * 2, power * power
        return mix(acc[: len(h) - k + 1])


class Powers:
    """Powers of an odd number and of its inverse modulo 2**64, as many as were asked for."""

    def __init__(self, base: int = 0xC2B2AE3D27D4EB4F):
        self.base, self.inverse = base, pow(base, -1, 1 << 64)
        self.up = self.down = np.ones(1, np.uint64)

    def upto(self, n: int) -> None:
        if len(self.up) < n:
            n = max(n, 2 * len(self.up), 4096)
            with np.errstate(over="ignore"):
                self.up, self.down = (np.cumprod(np.array([1] + [x] * (n - 1), np.uint64), dtype=np.uint64) for x in (self.base, self.inverse))


class WordHasher:
    """Two 64-bit hashes of every word of texts, from running sums over their bytes.

    A byte has a random value in each of two tables; a word's hash is the sum of its bytes' values times rising powers, mixed
    with its length. Texts go through in blocks that fit the processor's cache; a longer text is a block of its own.
    """

    BLOCK = 1 << 17

    def __init__(self):
        self.powers = Powers()
        with np.errstate(over="ignore"):
            self.tables = mix(np.arange(1, 513, dtype=np.uint64) * ODD).reshape(2, 256)
        self.space = np.zeros(256, bool)
        self.space[[9, 10, 11, 12, 13, 32]] = True

    def _block(self, texts: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        raw = np.frombuffer(b"\n".join(texts), np.uint8)
        n = len(raw)
        outside = np.ones(n + 2, bool)
        outside[1:-1] = self.space[raw]
        edges = np.flatnonzero(outside[1:] != outside[:-1])
        start, end = edges[0::2], edges[1::2]
        begin = np.cumsum([0, *(len(t) + 1 for t in texts)])
        self.powers.upto(n + 1)
        out = []
        with np.errstate(over="ignore"):
            length = mix((end - start).astype(np.uint64) + ODD)
            for table in self.tables:
                total = np.zeros(n + 1, np.uint64)
                np.cumsum(table[raw] * self.powers.up[:n], out=total[1:])
                out.append(mix((total[end] - total[start]) * self.powers.down[start] + length))
        return np.diff(np.searchsorted(start, begin)), *out

    def of(self, texts: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """The number of words of each text, and both hashes of all words in a row."""
        parts, block, size = [], [], 0
        for t in texts:
            if block and size + len(t) > self.BLOCK:
                parts.append(self._block(block))
                block, size = [], 0
            block.append(t)
            size += len(t) + 1
        parts.append(self._block(block))
        return tuple(np.concatenate(x) for x in zip(*parts))


def signed(x: np.ndarray) -> pa.Array:
    return pa.array(np.ascontiguousarray(x).view(np.int64))


def map_texts(df: DataFrame, make: Callable[[], Callable[[pa.RecordBatch], dict[str, pa.Array]]], fields: str, keep: Iterable[str] = ("doc_id",), text: str = "text", also: Iterable[str] = ()) -> DataFrame:
    """Add columns computed from whole texts, piece by piece (see ``chunks``), through Arrow.

    ``make`` runs once in each task and returns a function from a record batch to new columns (row for row). ``fields`` is
    their DDL. The result has the columns ``keep`` that don't clash with the new names, then the new ones; ``also`` names
    columns that the function needs besides. Columns of ``df`` beyond these are not read.
    """
    from pyspark.sql.types import StructType

    bounded_batches(df.sparkSession)
    new = StructType.fromDDL(fields)
    kept = [c for c in dict.fromkeys(keep) if c not in new.names]
    need = list(dict.fromkeys([*kept, text, *also]))
    schema = StructType([*(df.schema[c] for c in kept), *new.fields])

    operator = make.__module__

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        take_over(operator)
        function = make()
        for batch in chunks(batches, text):
            out = function(batch)
            yield pa.RecordBatch.from_arrays([*(column(batch, c) for c in kept), *(out[n] for n in new.names)], names=[*kept, *new.names])

    return df.select(*(F.col(f"`{c}`") for c in need)).mapInArrow(run, schema)

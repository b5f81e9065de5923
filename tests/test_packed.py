"""Counts of numbers by packed blocks are those of grouping, and blocks are short."""

import collections
import datetime
import random

import numpy as np
from pyspark.sql import functions as F

from lodegraph.sources import packed


def test_counts_of_numbers_are_those_of_their_texts(spark, monkeypatch):
    monkeypatch.setattr(packed, "HELD", 50)
    some = random.Random(5)
    whole = [-(1 << 63), (1 << 63) - 1, -1, 0, 1, None, *range(3000, 3040)]
    reals = [0.0, -0.0, float("nan"), float("inf"), -1.5, 2.25, 1e-300, None]
    times = [None, datetime.datetime(1, 1, 1), datetime.datetime(1969, 12, 31, 23, 59, 59, 999999), datetime.datetime(2024, 3, 31, 2, 30)]
    rows = [(some.choice(whole), some.choice([1, 2, None]), some.choice(reals), some.choice(times)) for _ in range(700)]
    df = spark.createDataFrame(rows, "a long, b int, x double, at timestamp_ntz").repartition(3)
    found = packed.counted([(df, [(F.col("a"), "bigint", [1, 2]), (F.col("b"), "bigint", [2]), (F.col("x"), "double", [3])]), (df.limit(0), [(F.col("a"), "bigint", [1])]), (df, [(F.col("at"), "timestamp_ntz", [4])])])
    text = F.coalesce(*(F.col(c).cast("string") for c in ("number", "real", "moment")))
    got = collections.Counter({(r.g, r.text): r.cnt for r in found.select("g", text.alias("text"), "cnt").collect()})
    want = collections.Counter()
    for r in df.select(*(F.col(c).cast("string") for c in df.columns)).collect():
        for g, x in ((1, r.a), (2, r.a), (2, r.b), (3, r.x), (4, r["at"])):
            want[g, x] += x is not None
    assert got == +want and found.count() == len(got)


def test_blocks_are_short():
    values = np.random.default_rng(3).integers(0, 9_000_000, 800_000)
    blocks = packed._blocks(values, 0)
    back = [packed._values(dict(zip(("bucket", "member", "n", "first", "wide", "often", "block"), b))) for b in blocks]
    found, often = np.unique(values, return_counts=True)
    order = np.argsort(np.concatenate([v for v, _ in back]))
    assert (np.concatenate([v for v, _ in back])[order] == found).all() and (np.concatenate([c for _, c in back])[order] == often).all()
    assert sum(len(b[-1]) + 28 for b in blocks) < 2 * len(found)  # a row of its own takes 24 bytes


def test_statistics_shuffle_no_number_by_itself(spark):
    from lodegraph.sources import MappedSource, Mapping

    t = spark.range(100).select(F.col("id").alias("k"), (F.col("id") % 7).cast("double").alias("x"))
    source = MappedSource({"t": Mapping(t, ["k"], unique=True)})
    for kind in ("coarse", "full"):
        plan = source.counted(kind, 3)._jdf.queryExecution().optimizedPlan().toString()
        assert "MapInArrow" in plan and "Aggregate [g" not in plan


def test_hundredths_are_exact_and_short():
    some = np.random.default_rng(4)
    money = np.round(some.uniform(-1000, 100_000, 300_000), 2)
    odd = np.array([0.0, -0.0, np.nan, np.inf, -np.inf, 0.1 + 0.2, 1 / 3, 1e300, -1e-300, 2.0**53, 2.0**60, 0.07, -0.07])
    bits = np.concatenate([money, odd]).view(np.int64)
    held, numbers = packed._hundredths(bits)
    assert ((numbers / 100).view(np.int64) == bits[held]).all() and held[: len(money)].all()
    assert held[len(money) :].tolist() == [True, *[False] * 8, False, False, True, True]
    run = packed._packer([3], ["double"])

    def size(x):
        import pyarrow as pa

        return sum(len(b) for batch in run(iter([pa.RecordBatch.from_arrays([pa.array(x)], names=["x"])])) for b in batch.column("block").to_pylist())

    assert size(money) < len(money) * 1.5 < size(money + 1 / 3) / 2


def test_short_blocks_are_not_put_into_few_tasks(spark):
    """Else a task sorts so many values that it spills."""
    t = spark.range(2000).select(F.col("id").alias("k"))
    found = packed.counted([(t, [(F.col("k"), "bigint", [1])])])
    assert found.rdd.getNumPartitions() == int(spark.conf.get("spark.sql.shuffle.partitions")) and found.count() == 2000

"""What a materialised table was made through doesn't stay on disk."""

import time

from pyspark.sql import functions as F

from lodegraph.llm import common


def test_shuffles_of_materialised_tables_are_removed(spark, monkeypatch):
    monkeypatch.setattr(common, "RELEASE_AFTER", 0, raising=False)
    kept = spark._jsc.sc().env().mapOutputTracker().shuffleStatuses()
    spark._jvm.System.gc()
    time.sleep(2)
    before = kept.size()
    rows = spark.range(1000)
    for i in range(6):
        rows = common.materialise(rows.repartition(3, F.col("id") + i), "release")
    until = time.monotonic() + 10
    while kept.size() > before and time.monotonic() < until:
        time.sleep(0.2)
    assert kept.size() <= before and rows.count() == 1000

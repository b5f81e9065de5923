"""Executors and Python workers give back what a stage needed before the next one."""

import os
import subprocess
import sys

import public_tokenizers as P
import pyarrow as pa

from lodegraph.llm import bpe, quality

from .helpers import frame

CLUSTER = """
import re, sys, time
from pathlib import Path
import psutil
from pyspark.sql import SparkSession
from lodegraph.llm import common

spark = (
    SparkSession.builder.master("local-cluster[2,1,900]").config("spark.executor.memory", "600m").config("spark.ui.enabled", "false")
    .config("spark.executor.extraJavaOptions", "-XX:+UseG1GC").config("spark.checkpoint.dir", "file://" + sys.argv[1] + "/shared").getOrCreate()
)

def heaps():
    found = [p for p in psutil.Process().children(recursive=True) if "CoarseGrainedExecutorBackend" in " ".join(p.cmdline())]
    return sum(int(re.search(r"Pss_Anon:\\s+(\\d+)", Path(f"/proc/{p.pid}/smaps_rollup").read_text())[1]) / 1024 for p in found)

while spark._jsc.sc().getExecutorMemoryStatus().size() < 3:
    time.sleep(0.1)
common.COLLECT_AFTER = float("inf")
make = lambda: common.materialise(spark.range(0, 2, 1, 2).selectExpr("size(transform(sequence(1, 4000000), x -> cast(x as string))) AS n"), "heap")
make()
grown = heaps()
common.COLLECT_AFTER = 0
common.materialise(spark.range(4), "heap")
until = time.monotonic() + 20
while heaps() > grown - 200 and time.monotonic() < until:
    time.sleep(0.5)
print("heaps", grown, heaps())
sys.exit(heaps() > grown - 200)
"""


def test_heaps_of_executors_shrink_after_a_write(tmp_path):
    env = os.environ | {"PYTHONPATH": os.pathsep.join(x for x in sys.path if x), "SPARK_LOCAL_IP": "127.0.0.1", "PYSPARK_PYTHON": sys.executable, "SPARK_SCALA_VERSION": "2.13"}
    env.pop("PYSPARK_GATEWAY_PORT", None)
    done = subprocess.run([sys.executable, "-c", CLUSTER, str(tmp_path)], cwd=tmp_path, env=env, capture_output=True, text=True, timeout=200)
    assert done.returncode == 0, done.stdout + done.stderr[-2000:]


def test_worker_drops_the_coder_of_an_earlier_stage(spark, monkeypatch):
    docs = frame(spark, [(1, "some words", "en", "s", 0)])
    batch = pa.RecordBatch.from_arrays([pa.array([1]), pa.array(["some words"])], names=["doc_id", "text"])
    with monkeypatch.context() as m:
        m.setattr(type(docs), "mapInArrow", lambda self, run, schema: run)  # what a worker would run
        encode, score = bpe.encode(docs, P.path(bpe.VOCABULARY), P.PATTERN), quality.score(docs, None)
    bpe.coder.cache_clear()
    for _ in range(2):
        assert next(encode(iter([batch]))).num_rows == 1
        assert bpe.coder.cache_info().misses == 1  # the next task of the same stage finds it
    assert next(score(iter([batch]))).num_rows == 1
    assert bpe.coder.cache_info().currsize == 0

"""Connected components of a graph given by its links, without bringing links or components to the driver.

Alternates two local steps until nothing changes: every node's larger neighbours are linked to its least neighbour, then its
smaller neighbours and itself are. The links become stars whose centres are the least nodes. Each round is written to the
shared folder, so a lost executor costs one round at most.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common as C


def _large(links: DataFrame) -> DataFrame:
    both = links.unionByName(links.select(F.col("b").alias("a"), F.col("a").alias("b")))
    least = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
    return both.join(least, "a").where("b > a").select(F.col("m").alias("a"), "b").distinct()


def _small(links: DataFrame) -> DataFrame:
    """Links (a, b) with a < b: b's smaller neighbours are its a's."""
    least = links.groupBy("b").agg(F.min("a").alias("m"))
    down = links.join(least, "b").where("a > m").select(F.col("m").alias("a"), F.col("a").alias("b"))
    return down.unionByName(least.select(F.col("m").alias("a"), "b")).distinct()


def _state(links: DataFrame) -> tuple:
    return tuple(links.agg(F.count(F.lit(1)), F.expr("bit_xor(xxhash64(a, b))"), F.expr("bit_xor(xxhash64(b, a, 7))")).first())


def components(links: DataFrame) -> DataFrame:
    """(node, component) for every node of the links (a, b); component is the least node. Loops and repeats don't matter."""
    tidy = links.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).where("a < b").distinct()
    links = C.materialise(tidy, "links")
    state = _state(links)
    while state[0]:
        links = C.materialise(_small(_large(links)), "links")
        new = _state(links)
        if new == state:
            break
        state = new
    return links.select(F.col("b").alias("node"), F.col("a").alias("component")).unionByName(links.select(F.col("a").alias("node"), F.col("a").alias("component")).distinct())

"""A training-data pipeline over ``documents``; its stages call operators of lodegraph.llm.

Every stage takes all rows that its predecessor kept. Stages that compare documents know a row by a hash of its doc_id and text
(``pii.with_key``), so rows without a doc_id, and different texts under one, are judged each; rows equal in both are copies.
"""

from __future__ import annotations

import public_tokenizers as P
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lodegraph.llm import bpe, common, decontaminate, jaccard, pii, quality

LEAST_QUALITY = 0.3


def packed(docs: DataFrame) -> DataFrame:
    """The rows with all columns but the text in one, so that no name of theirs meets one of an operator's; doc_id and a key besides."""
    rest = F.struct(*(F.col(f"`{c}`") for c in docs.columns if c != "text"))
    return docs.select(rest.alias("row_of_input"), "text", "doc_id", F.xxhash64("doc_id", "text").alias(pii.KEY))


def unpacked(rows: DataFrame, like: DataFrame, **new: Column) -> DataFrame:
    new["text"] = F.col("text")
    return rows.select(*((new[c] if c in new else F.col(f"row_of_input.`{c}`")).alias(c) for c in like.columns))


def good_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Quality classifier: documents that score below LEAST_QUALITY go.

    Without labels of both kinds all stay. Null and empty texts score 0 and go; repeated rows are judged alike; long texts are scored
    whole; an empty table stays empty.
    """
    field = quality.learn(docs, quality.training_labels(common.table(spark, sf_dir, "labels")))
    if field is None:
        return docs
    scored = quality.score(packed(docs), field, ("row_of_input", "text"))
    return unpacked(scored.where(F.col("score") >= LEAST_QUALITY), docs)


def no_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """N-gram Jaccard join on five-word shingles from 0.8: one row of each group stays, of the least doc_id (null last).

    Of rows that are the same in doc_id and text one stays; null and empty texts all stay; an empty table stays empty.
    """
    key = pii.KEY
    keyed = packed(docs)
    named = jaccard.groups(keyed, 5, 4, 5, key=key).where("component_id is not null").select(key, "component_id")
    # rows that are repeated have one key, and are counted here
    rows = keyed.groupBy(key).agg(F.min("doc_id").alias("id"), F.count(F.lit(1)).alias("n"))
    named = common.materialise(named.distinct().join(rows, key).select("component_id", key, "n", F.struct(F.col("id").isNull().alias("last"), "id", key).alias("rank")), "stage-groups")
    first = named.groupBy("component_id").agg(F.min("rank").alias("first"))
    judged = named.join(first, "component_id").select(key, "n", (F.col("rank")[key] == F.col("first")[key]).alias("stays"))
    apart = common.materialise(judged.where("not stays or n > 1").select(key, "stays"), "stage-copies")
    alone = keyed.join(apart, key, "left_anti")
    one = keyed.join(apart.where("stays").select(key), key, "left_semi").dropDuplicates([key])
    return unpacked(alone.unionByName(one), docs)


def no_leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Benchmark decontamination: documents that hold a benchmark item go.

    Null and empty texts stay, rows of one text go or stay together, and without items all stay.
    """
    keyed = packed(docs)
    found = decontaminate.matches(keyed, common.table(spark, sf_dir, "benchmark"), pii.KEY)
    leaks = common.materialise(found.select(pii.KEY).distinct(), "stage-leaks")
    return unpacked(keyed.join(leaks, pii.KEY, "left_anti"), docs)


def no_personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """PII: personal data and terms that disclose it are replaced by placeholders; n_chars follows the text.

    Every row stays. Null texts stay null, repeated rows are changed alike, an empty table stays empty.
    """
    keyed = packed(docs)
    found = common.materialise(pii.find(keyed, (pii.KEY,)), "stage-pii")
    # one pass, so one Python worker for each task: workers live on, and what a later stage loads is loaded by each of them
    clean = pii.all_spans(keyed, pii.disclosing(found, keyed, pii.KEY), ("row_of_input",), pii.KEY, with_text=True)
    return unpacked(clean.select("row_of_input", F.col("sanitised").alias("text")), docs, n_chars=F.length("text").cast("long"))


def encoded(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Byte-level BPE: the ids of every text, and whether they decode to it. Null texts are empty; repeated rows are encoded alike."""
    out = bpe.encode(docs, P.path(bpe.VOCABULARY), P.PATTERN, ("doc_id", "lang", "source", "text"))
    return out.select("doc_id", "lang", "source", "n_tokens", "token_ids", (F.coalesce("text", F.lit("")).cast("binary") == F.col("decoded")).alias("round_trip"))


STAGES = [("quality", good_quality), ("near copies", no_near_copies), ("decontamination", no_leaks), ("personal data", no_personal_data), ("encoding", encoded)]
ORACLE_SQL = None  # the classifier, the personal data and the encoding aren't SQL


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages applied to documents, each stage's rows written as Parquet and read again."""
    docs = common.table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = common.materialise(stage(spark, docs, sf_dir), f"stage-{name.replace(' ', '-')}")
    return STAGES[-1][1](spark, docs, sf_dir)

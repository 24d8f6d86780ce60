"""From raw documents to token ids: quality rules, near duplicates, secrets, mixing, BPE.

``STAGES`` lists (name, function) pairs; each function takes (spark, docs, sf_dir) and
returns a DataFrame that is written and read again as the next one's docs.  All but
the last return the columns of ``docs``.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.llm import bpe, jaccard, mixing, quality, secrets
from tessera.llm.common import delete, ensure_checkpoints, table


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the base rule or the learned list rejects go; the list is learned from ``labels.quality``."""
    rules = quality.learn_from(docs, table(spark, sf_dir, "labels", "doc_id", "quality"))
    return quality.keep_good(docs, rules)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each class stays: the one with the least id; of equal rows, one.

    Rows are told apart by id and text, so repeated and missing ids don't matter; a null id comes last.
    """
    id_, text = F.col("doc_id"), F.col("text")
    key = F.struct(id_.isNull().alias("a"), id_.alias("b"), text.isNull().alias("c"), F.md5(F.coalesce(text, F.lit("")).cast("binary")).alias("d"))
    classes = jaccard.jaccard_classes(docs.select(key.alias("__key"), "text"), key="__key")
    stays = classes.where("__key = class_id").groupBy("__key").agg(F.count(F.lit(1)).alias("__times"))
    # the row in a struct of its own, so that no column name of it can clash
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("__row"), key.alias("__key")).join(stays, "__key")
    kept = rows.where("__times = 1").select("__row").unionByName(rows.where("__times > 1").dropDuplicates(["__key"]).select("__row"))
    return kept.select(*[F.col("__row")[c].alias(c) for c in docs.columns])


def secret_scan(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Secrets are masked in their texts; all documents stay."""
    return secrets.redact(docs)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents repeated or left out so that sources meet their targets."""
    return mixing.mix(docs)


def encode_texts(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of each emitted text."""
    return bpe.encode(docs, "text", "doc_id")


STAGES = [
    ("quality rules", quality_rules),
    ("n-gram Jaccard join", near_duplicates),
    ("secret scans", secret_scan),
    ("mixing sources", mix_sources),
    ("BPE encoding", encode_texts),
]
#: The learned list, the forest and the encoder are beyond SQL; tests/llm/test_pipeline.py checks the stages instead.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; what lies between them is written to the shared checkpoint folder."""
    ensure_checkpoints(spark)
    base = f"{spark.sparkContext.getCheckpointDir()}/pipeline-{uuid.uuid4().hex}"
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for k, (_, stage) in enumerate(STAGES[:-1]):
        stage(spark, docs, sf_dir).write.parquet(f"{base}/{k}")
        if k:
            delete(spark, f"{base}/{k - 1}")
        docs = spark.read.parquet(f"{base}/{k}")
    return STAGES[-1][1](spark, docs, sf_dir)

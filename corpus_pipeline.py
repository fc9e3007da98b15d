"""A training-data pipeline over ``documents``: five stages, each written as Parquet and read again by the next.

Every stage works on all rows its predecessor kept. All but the last return the columns of ``documents``; ``n_chars``
follows the text.
"""

from __future__ import annotations

import uuid

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from proofline.llm import decontam, jaccard, langid, linededup, packing
from proofline.llm.common import staged
from proofline.session import shared_dir

#: Below this share of one language a document is rejected as mixed.
LEAST_SHARE = 0.5
TOKENIZER = public_tokenizers.path("byte_bpe_50k.json")


def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents without letters, and those of which no language makes up ``LEAST_SHARE``.

    The model learns from the non-null ``lang`` values of its own input. A null ``lang`` stays null.
    """
    names, logs = langid.train(docs)
    rated = langid.predict(docs, names, logs, keep=("text", "lang", "source", "n_chars"))
    kept = rated.filter((F.col("lang_pred") != "und") & (F.col("score") >= LEAST_SHARE))
    return kept.select("doc_id", "text", "lang", "source", "n_chars")


def drop_template_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Takes recurring lines out of the texts; documents that consisted of nothing else go."""
    out = linededup.dedup_lines(docs)
    out = out.filter((F.col("n_dropped") == 0) | (F.btrim("text", F.lit(" \t\r\n")) != ""))
    return out.select("doc_id", "text", "lang", "source", F.length("text").cast("bigint").alias("n_chars"))


def drop_similar(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps the document with the smallest id of every group of similar ones (five words, 0.8); of repeated rows one."""
    named = staged(jaccard.similar_documents(docs, k=5, num=80, den=100), "named")
    ids = named.groupBy(F.col("doc_id").alias("id")).agg(
        F.bool_or(F.col("doc_id").eqNullSafe(F.col("component_id"))).alias("kept"), F.count("*").alias("rows"))
    # the ids that go are far fewer than those that stay
    gone = staged(ids.filter("NOT kept").select("id"), "gone")
    out = docs.join(gone, F.col("doc_id").eqNullSafe(F.col("id")), "left_anti")
    if ids.filter("kept AND rows > 1").isEmpty():
        return out
    return out.dropDuplicates(["doc_id", "text"])  # ids that stand for several rows


def drop_leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents that hold a benchmark item (five words, 0.8)."""
    items = spark.read.parquet(f"{sf_dir}/benchmark.parquet")
    return decontam.with_leaks(docs, items).filter(F.size("leaks") == 0).drop("leaks")


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Sequences of at most 1024 tokens, with their ids."""
    return packing.pack(docs, TOKENIZER, size=1024)


STAGES = [("language", identify_language), ("lines", drop_template_lines), ("similar", drop_similar),
          ("leaks", drop_leaks), ("pack", pack)]

# Learned proportions, SimHash candidates and a tokenizer are not SQL; the stages are tested against plain versions.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; each result is written to the shared folder before the next stage reads it."""
    root = f"{shared_dir(spark)}/corpus-{uuid.uuid4().hex}"
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for k, (name, stage) in enumerate(STAGES):
        path = f"{root}/{k}-{name}"
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return docs

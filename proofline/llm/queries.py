"""Registered queries of this subpackage with their SQL twins."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

import corpus_pipeline

from . import decontam, divergence, ftrl, htmlcrf, jaccard, langid, licences, linededup, packing, repair, rules, topk, warc
from .common import held_out, work_dir


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_license_digests(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licences.scan(table(spark, sf_dir, "documents"), licences.known_digests(spark))


def op2_language_mixture(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").withColumn("held_out", held_out())
    names, logs = langid.train(docs.filter(~F.col("held_out")))
    return langid.predict(docs, names, logs, keep=("held_out",)).select("doc_id", "held_out", "lang_pred", "score", "shares")


def op3_warc_segments(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = work_dir(spark, "warc")
    warc.write_archives(warc.plan_records(table(spark, sf_dir, "pages")), path)
    return warc.read_archives(spark, path).select(F.col("id").alias("page_id"), "payload_bytes", "payload_digest", "record_type", "refers_to")


def op4_ftrl_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").withColumn("held_out", held_out())
    labels = table(spark, sf_dir, "labels").filter(~held_out())
    weights = ftrl.train(docs, labels, label="quality")
    return ftrl.score(docs, weights, keep=("held_out",)).select("doc_id", "held_out", "score", (F.col("score") >= 0.7).cast("int").alias("predicted"))


def op5_crf_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    return htmlcrf.extract(table(spark, sf_dir, "pages"), htmlcrf.trained())


def op6_decision_list(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    learned = rules.train(docs, table(spark, sf_dir, "labels").filter(~held_out()))
    return rules.judge(docs, learned).select("doc_id", *rules.BASE, "base_failed", "kept", "rule")


def op7_divide_skip(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard.similar_documents(table(spark, sf_dir, "documents"), k=4, num=85, den=100)


def op8_simhash_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontam.leaks(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op9_template_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return linededup.dedup_lines(docs).select("doc_id", "n_lines", "n_dropped", "text")


def op10_binary_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return packing.pack(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"), with_ids=False)


def op11_prefix_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return divergence.audit(table(spark, sf_dir, "documents"))


def op12_lightest_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows, copies = repair.damaged(table(spark, sf_dir, "conversations"))
    return repair.digested(repair.repair(rows, copies))


def op13_voronoi_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return topk.top_k(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 50 == 0, k=5)


def pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    return corpus_pipeline.run(spark, sf_dir)


_B32 = "'ABCDEFGHIJKLMNOPQRSTUVWXYZ234567'"
_GROUP = " || ".join(f"substr({_B32}, CAST((g >> {s}) & 31 AS INTEGER) + 1, 1)" for s in range(35, -5, -5))
_DIGEST = " || ".join(f"(SELECT {_GROUP} FROM (SELECT CAST('0x' || substr(h, {i}, 10) AS BIGINT) AS g))" for i in (1, 11, 21, 31))
WARC_SQL = f"""WITH p AS (SELECT page_id, encode(coalesce(html, '')) AS b, sha1(encode(coalesce(html, ''))) AS h FROM pages),
 f AS (SELECT *, min(page_id) OVER (PARTITION BY h, octet_length(b)) AS first FROM p)
 SELECT page_id, CAST(octet_length(b) AS BIGINT) AS payload_bytes, {_DIGEST} AS payload_digest,
 CASE WHEN page_id = first THEN 'response' ELSE 'revisit' END AS record_type,
 CASE WHEN page_id <> first THEN first END AS refers_to FROM f"""

ENTRIES = {
    "op1_license_digests": (op1_license_digests, licences.oracle()),
    "op2_language_mixture": (op2_language_mixture, None),
    "op3_warc_segments": (op3_warc_segments, WARC_SQL),
    "op4_ftrl_quality": (op4_ftrl_quality, None),
    "op5_crf_extraction": (op5_crf_extraction, None),
    "op6_decision_list": (op6_decision_list, None),
    "op7_divide_skip": (op7_divide_skip, jaccard.oracle(4, 85, 100)),
    "op8_simhash_windows": (op8_simhash_windows, None),
    "op9_template_lines": (op9_template_lines, linededup.oracle()),
    "op10_binary_packing": (op10_binary_packing, None),
    "op11_prefix_divergence": (op11_prefix_divergence, divergence.oracle()),
    "op12_lightest_repair": (op12_lightest_repair, repair.oracle()),
    "op13_voronoi_topk": (op13_voronoi_topk, topk.oracle()),
    "pipeline": (pipeline, corpus_pipeline.ORACLE_SQL),
}


def queries() -> dict:
    return {name: fn for name, (fn, _) in ENTRIES.items()}


def oracle_sql() -> dict:
    return {name: sql for name, (_, sql) in ENTRIES.items() if sql}

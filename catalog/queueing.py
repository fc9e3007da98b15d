"""Queue upkeep, admission caps, quotas, plan gates, result cache."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from proofline.operators import admission, queue, result_cache
from proofline.session import shared_dir
from proofline.sources import derive, dims

from . import sql as S

# Small quotas fit the given event table, where users have few uses per month.
QUOTAS = {"free": 0, "pro": 5, "vip": 15}


def _base(spark, d):
    """Queue before any change: one idle row per image that the events may name."""
    img = derive.read(spark, d, "part")
    return img.select(F.col("p_partkey").alias("image_id"), F.lit("idle").alias("status"),
                      F.lit("1970-01-01 00:00:00").cast("timestamp").alias("ts"), F.lit(-1).cast("bigint").alias("event_id"),
                      F.lit(0.0).alias("value"))


def queue_append(spark, d):
    out = queue.append(_base(spark, d), derive.queue_events(spark, d))
    return out.groupBy("status").agg(F.count("*").alias("rows_held"), F.max("image_id").alias("last_image"))


def queue_latest(spark, d):
    return queue.latest(derive.queue_events(spark, d)).select("image_id", "status", "event_id")


def queue_upsert(spark, d):
    return queue.upsert(_base(spark, d), derive.queue_events(spark, d)).select("image_id", "status", "event_id", "value")


def queue_patch(spark, d):
    done = queue.latest(derive.queue_events(spark, d)).filter("status = 'done'").select("image_id", "status", "value")
    return queue.patch(_base(spark, d), done).select("image_id", "status", "value")


def queue_remove(spark, d):
    bad = derive.queue_events(spark, d).filter("status = 'error'")
    return queue.remove(_base(spark, d), bad).select("image_id", "status")


def side_pairing(spark, d):
    front = derive.read(spark, d, "documents").select(F.col("doc_id").alias("job_id"), F.col("source").alias("artwork"))
    back = derive.read(spark, d, "labels").select(F.col("doc_id").alias("job_id"),
                                                  F.concat(F.lit("back-"), F.col("quality").cast("string")).alias("artwork"))
    return queue.pair_sides(front, back)


def cache_lookup(spark, d):
    """Documents whose content was already processed; labelled documents count as processed."""
    docs = derive.read(spark, d, "documents").select("doc_id", "text", F.lit("model-a").alias("model"))
    req = queue.content_key(docs, "text", "model")
    labels = derive.read(spark, d, "labels").select("doc_id")
    hit, miss = queue.split_cached(req.select("doc_id", "cache_key"), req.join(labels, "doc_id", "left_semi"))
    return hit.withColumn("cached", F.lit(True)).unionByName(miss.withColumn("cached", F.lit(False)))


def bucketed_cache(spark, d):
    """Every document against a cache that took the labelled ones in two batches, even ids first."""
    docs = derive.read(spark, d, "documents").select("doc_id", "text", F.lit("model-a").alias("model"))
    requests = queue.content_key(docs, "text", "model").select("doc_id", "cache_key")
    done = requests.join(derive.read(spark, d, "labels").select("doc_id", "quality"), "doc_id").withColumnRenamed("doc_id", "first_doc")
    name = f"result_cache_{uuid.uuid4().hex}"
    result_cache.open_cache(spark, name, f"{shared_dir(spark)}/{name}", "first_doc BIGINT, quality BIGINT", 16)
    for odd in (0, 1):
        batch = done.filter(F.col("first_doc") % 2 == odd).withColumn("quality", F.col("quality").cast("bigint"))
        result_cache.add_results(batch, name, "first_doc")
    return result_cache.lookup(requests, name).select("doc_id", "cache_key", "cached", "first_doc", "quality")


def batch_admission(spark, d):
    ok = admission.reject_reason(derive.images(spark, d)).filter("reject_reason IS NULL")
    return admission.first_per_batch(ok, 12).select("image_id", "batch_id", "seq", "batch_pos")


def plan_batch_admission(spark, d):
    plans = F.array(*[F.lit(p[0]) for p in dims.PLANS])
    img = derive.images(spark, d).withColumn("plan_id", F.get(plans, (F.col("batch_id") % 3).cast("int")))
    return admission.first_per_plan_batch(img).select("image_id", "batch_id", "plan_id", "batch_pos")


def _quota():
    col = F.lit(0)
    for plan, n in QUOTAS.items():
        col = F.when(F.col("plan_id") == plan, n).otherwise(col)
    return col


def quota_unit_cost(spark, d):
    e = derive.quota_events(spark, d).withColumn("quota", _quota())
    return admission.quota_units(e, F.col("quota"), max(QUOTAS.values())).select("event_id", "user_id", "month", "use_no")


def _variable(spark, d):
    e = derive.quota_events(spark, d).withColumn("quota", _quota())
    return admission.quota_variable(e, "quota", max(QUOTAS.values()))


def quota_variable_cost(spark, d):
    return _variable(spark, d).select("event_id", "user_id", "month", "cost", "accepted")


def quota_state(spark, d):
    out = admission.quota_state(_variable(spark, d), F.col("quota"))
    return out.select("user_id", "month", "used", "uses", "remaining")


def feature_gates(spark, d):
    plans = F.array(*[F.lit(p[0]) for p in dims.PLANS])
    c = derive.read(spark, d, "customer").select(F.col("c_custkey").alias("user_id"),
                                                 F.get(plans, (F.col("c_custkey") % 3).cast("int")).alias("plan_id"))
    names = F.array(*[F.lit(f) for f in [*dims.PLAN_FEATURES, "preview"]])
    c = c.select("user_id", "plan_id", F.explode(names).alias("feature"))
    return c.select("user_id", "plan_id", "feature",
                    admission.feature_allowed(F.col("plan_id"), F.col("feature")).alias("allowed"))


_LATEST = f"""SELECT * EXCLUDE (rn) FROM (SELECT *, row_number() OVER (PARTITION BY image_id ORDER BY ts DESC, event_id DESC) AS rn
 FROM ({S.QUEUE})) WHERE rn=1"""
_BASE = """SELECT p_partkey AS image_id, 'idle' AS status, TIMESTAMP '1970-01-01 00:00:00' AS ts, CAST(-1 AS BIGINT) AS event_id,
 CAST(0 AS DOUBLE) AS value FROM part"""
_PLAN = S.lst([p[0] for p in dims.PLANS])
_Q = f"SELECT *, {S.case_list('plan_id', QUOTAS.items(), '0')} AS quota FROM ({S.QUOTA})"
_FOLD = f"""WITH RECURSIVE q AS MATERIALIZED (SELECT *, row_number() OVER (PARTITION BY user_id, month ORDER BY ts, event_id) AS rn FROM ({_Q})),
 f AS (SELECT event_id, user_id, month, cost, quota, rn, cost<=quota AS accepted, CASE WHEN cost<=quota THEN cost ELSE 0 END AS used
 FROM q WHERE rn=1 UNION ALL SELECT q.event_id, q.user_id, q.month, q.cost, q.quota, q.rn, f.used+q.cost<=q.quota,
 CASE WHEN f.used+q.cost<=q.quota THEN f.used+q.cost ELSE f.used END FROM f JOIN q ON q.user_id=f.user_id AND q.month=f.month AND q.rn=f.rn+1) """
_KEY = "model||'_'||length(text)||'_'||sha256(text)"
_GATES = " ".join(f"WHEN '{f}' THEN plan_id IN ({','.join(S.q(p[0]) for p in dims.PLANS if p[4][f]) or 'NULL'})"
                  for f in dims.PLAN_FEATURES)

ENTRIES = {
    "queue_append": (queue_append, f"""SELECT status, count(*) AS rows_held, max(image_id) AS last_image FROM (
 SELECT image_id, status FROM ({_BASE}) UNION ALL SELECT image_id, status FROM ({S.QUEUE})) GROUP BY 1"""),
    "queue_latest": (queue_latest, f"SELECT image_id, status, event_id FROM ({_LATEST})"),
    "queue_upsert": (queue_upsert, f"""SELECT image_id, status, event_id, value FROM ({_LATEST}) UNION ALL SELECT image_id, status,
 event_id, value FROM ({_BASE}) WHERE image_id NOT IN (SELECT image_id FROM ({S.QUEUE}))"""),
    "queue_patch": (queue_patch, f"""SELECT b.image_id, coalesce(u.status,b.status) AS status, coalesce(u.value,b.value) AS value
 FROM ({_BASE}) b LEFT JOIN (SELECT * FROM ({_LATEST}) WHERE status='done') u USING (image_id)"""),
    "queue_remove": (queue_remove, f"""SELECT image_id, status FROM ({_BASE}) WHERE image_id NOT IN
 (SELECT image_id FROM ({S.QUEUE}) WHERE status='error')"""),
    "side_pairing": (side_pairing, """SELECT coalesce(f.doc_id,b.doc_id) AS job_id, source AS front_artwork,
 CASE WHEN b.doc_id IS NOT NULL THEN 'back-'||quality END AS back_artwork, source IS NOT NULL AS has_front, b.doc_id IS NOT NULL AS has_back
 FROM documents f FULL OUTER JOIN labels b ON f.doc_id=b.doc_id"""),
    "cache_lookup": (cache_lookup, f"""WITH r AS (SELECT doc_id, {_KEY} AS cache_key FROM (SELECT doc_id, text, 'model-a' AS model
 FROM documents)) SELECT doc_id, cache_key, cache_key IN (SELECT cache_key FROM r JOIN labels USING (doc_id)) AS cached FROM r"""),
    "bucketed_cache": (bucketed_cache, f"""WITH r AS (SELECT doc_id, {_KEY} AS cache_key FROM (SELECT doc_id, text, 'model-a' AS model
 FROM documents)), c AS (SELECT cache_key, doc_id AS first_doc, CAST(quality AS BIGINT) AS quality FROM r JOIN labels USING (doc_id)
 QUALIFY row_number() OVER (PARTITION BY cache_key ORDER BY doc_id%2, doc_id)=1)
 SELECT doc_id, cache_key, first_doc IS NOT NULL AS cached, first_doc, quality FROM r LEFT JOIN c USING (cache_key)"""),
    "batch_admission": (batch_admission, f"""SELECT image_id, batch_id, seq, batch_pos FROM (SELECT *, CAST(row_number() OVER
 (PARTITION BY batch_id ORDER BY seq) AS INTEGER) AS batch_pos FROM ({S.IMAGES}) WHERE starts_with(mime,'image/') AND size_bytes<=104857600
 AND width_px>0 AND height_px>0) WHERE batch_pos<=12"""),
    "plan_batch_admission": (plan_batch_admission, f"""SELECT image_id, batch_id, plan_id, batch_pos FROM (SELECT *,
 {_PLAN}[batch_id%3+1] AS plan_id, CAST(row_number() OVER (PARTITION BY batch_id ORDER BY seq) AS INTEGER) AS batch_pos FROM ({S.IMAGES}))
 WHERE batch_pos<=CASE plan_id WHEN 'pro' THEN 20 WHEN 'vip' THEN 100 ELSE 1 END"""),
    "quota_unit_cost": (quota_unit_cost, f"""SELECT event_id, user_id, month, use_no FROM (SELECT *, CAST(row_number() OVER
 (PARTITION BY user_id, month ORDER BY ts, event_id) AS INTEGER) AS use_no FROM ({_Q})) WHERE use_no<=quota"""),
    "quota_variable_cost": (quota_variable_cost, _FOLD + "SELECT event_id, user_id, month, cost, accepted FROM f"),
    "quota_state": (quota_state, _FOLD + """SELECT user_id, month, CAST(sum(cost) AS BIGINT) AS used, count(*) AS uses,
 CAST(greatest(0,max(quota)-sum(cost)) AS BIGINT) AS remaining FROM f WHERE accepted GROUP BY 1,2"""),
    "feature_gates": (feature_gates, f"""SELECT user_id, plan_id, feature, CASE feature {_GATES} ELSE TRUE END AS allowed FROM (
 SELECT c_custkey AS user_id, {_PLAN}[c_custkey%3+1] AS plan_id, unnest({S.lst([*dims.PLAN_FEATURES, 'preview'])}) AS feature FROM customer)"""),
}

"""Admission checks, batch caps, quotas and plan gates."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..sources import dims
from .fence import fenced

MAX_FILE_BYTES = 100 * 1024 * 1024
UPLOAD_CAP = 20
LARGEST_QUOTA = max(p[3] for p in dims.PLANS)
LARGEST_BATCH = max(p[2] for p in dims.PLANS)


def reject_reason(df: DataFrame) -> DataFrame:
    """``not_image``, ``too_large``, ``undecodable`` or null for an admitted file."""
    ok_dims = (F.col("width_px") > 0) & (F.col("height_px") > 0)
    reason = (F.when(~F.coalesce(F.col("mime").startswith("image/"), F.lit(False)), "not_image")
               .when(F.col("size_bytes") > MAX_FILE_BYTES, "too_large")
               .when(~F.coalesce(ok_dims, F.lit(False)), "undecodable"))
    return df.withColumn("reject_reason", reason)


def first_per_batch(df: DataFrame, cap: int = UPLOAD_CAP, batch: str = "batch_id", order: str = "seq") -> DataFrame:
    """The first ``cap`` rows of each batch.

    A row-number filter with a literal bound is trimmed before the exchange, so a
    task forwards at most ``cap`` rows of a batch, however large the batch is.
    """
    w = Window.partitionBy(batch).orderBy(order)
    return df.withColumn("batch_pos", F.row_number().over(w)).filter(F.col("batch_pos") <= cap)


def plan_value(plan: Column, position: int) -> Column:
    """Number from the plan list; unknown plans count as the first one."""
    col = F.lit(dims.PLANS[0][position])
    for p in dims.PLANS:
        col = F.when(plan == p[0], F.lit(p[position])).otherwise(col)
    return col


def first_per_plan_batch(df: DataFrame, plan: str = "plan_id", batch: str = "batch_id", order: str = "seq") -> DataFrame:
    """Batch cap of the owner's plan (1, 20 or 100)."""
    capped = first_per_batch(df, LARGEST_BATCH, batch, order)
    return capped.filter(F.col("batch_pos") <= plan_value(F.col(plan), 2))


def quota_units(df: DataFrame, quota: Column, largest: int, keys=("user_id", "month"), order=("ts", "event_id")) -> DataFrame:
    """Accepted uses when every use costs one: the first ``quota`` per key."""
    w = Window.partitionBy(*keys).orderBy(*order)
    first = df.withColumn("use_no", F.row_number().over(w)).filter(F.col("use_no") <= largest)
    return first.filter(F.col("use_no") <= quota)


def quota_variable(df: DataFrame, quota: str, largest: int, keys=("user_id", "month"), order=("ts", "event_id"),
                   cost: str = "cost", event: str = "event_id") -> DataFrame:
    """Marks each use accepted or rejected when costs differ and rejects consume nothing.

    The remaining quota never grows, so the accepted uses of one cost are the
    first ones of that cost: at most ``quota / cost`` per key. Keeping that many
    candidates per (key, cost) bounds the ordered fold of a key by
    ``quota * (1 + 1/2 + ...)`` entries, with nothing left out. The fold writes
    one mark per candidate, and the verdicts return to the full rows by key and
    event. Costs are whole numbers; a use that costs nothing is always accepted.
    Rows that repeat an event of a key are one use and share its verdict.
    """
    ids = [*keys, event]
    once = df.groupBy(*ids).agg(F.min(F.struct(*[c for c in (*order, cost, quota) if c != event])).alias("_u")).select(*ids, "_u.*")
    w = Window.partitionBy(*keys, cost).orderBy(*order)
    paid = once.filter(F.col(cost) > 0).withColumn("_rn", F.row_number().over(w))
    cand = paid.filter((F.col("_rn") <= largest) & (F.col("_rn") * F.col(cost) <= F.col(quota)))
    entry = F.struct(*order, F.col(cost).cast("bigint").alias("_c"), F.col(event).alias("_e"))
    per_key = cand.groupBy(*keys).agg(F.sort_array(F.collect_list(entry)).alias("_uses"),
                                      F.max(F.col(quota).cast("bigint")).alias("_q"))
    start = F.struct(F.lit(0).cast("bigint").alias("used"), F.lit("").alias("marks"))

    def step(acc, use):
        fits = acc["used"] + use["_c"] <= F.col("_q")
        return F.struct(F.when(fits, acc["used"] + use["_c"]).otherwise(acc["used"]).alias("used"),
                        F.concat(acc["marks"], F.when(fits, "1").otherwise("0")).alias("marks"))

    marked = fenced(per_key.withColumn("_marks", F.aggregate("_uses", start, step)["marks"]), ["_uses", "_marks"])
    fits = F.filter("_uses", lambda use, i: F.substring(F.col("_marks"), i + 1, F.lit(1)) == "1")
    folded = marked.select(*[F.col(k).alias(f"_k{i}") for i, k in enumerate(keys)], F.explode(fits).alias("_u"))
    folded = folded.select(*[f"_k{i}" for i in range(len(keys))], F.col("_u._e").alias("_event"), F.lit(True).alias("_paid"))
    on = F.col(event) == F.col("_event")
    for i, k in enumerate(keys):
        on = on & (F.col(k) == F.col(f"_k{i}"))
    out = df.join(folded, on, "left").select(*df.columns, "_paid")
    return out.withColumn("accepted", F.coalesce("_paid", F.col(cost) == 0, F.lit(False))).drop("_paid")


def quota_state(df: DataFrame, quota: Column, keys=("user_id", "month"), cost: str = "cost") -> DataFrame:
    """Used and remaining quota per key from the accepted uses."""
    used = df.filter("accepted").groupBy(*keys).agg(F.sum(cost).alias("used"), F.count("*").alias("uses"),
                                                    F.max(quota).alias("quota"))
    return used.withColumn("remaining", F.greatest(F.lit(0), F.col("quota") - F.col("used")))


def feature_allowed(plan: Column, feature: Column, unlocked: bool = False) -> Column:
    """Plan gate of a feature; unknown features are open to everyone."""
    if unlocked:
        return F.lit(True)
    col = F.lit(True)
    for f in dims.PLAN_FEATURES:
        allowed = [p[0] for p in dims.PLANS if p[4][f]]
        col = F.when(feature == f, plan.isin(allowed)).otherwise(col)
    return col

"""Streams: keyed quota state with late and repeated rows, the bucketed queue table, restarts."""

from __future__ import annotations

import os
import random
from datetime import datetime, timedelta, timezone

from pyspark.sql import functions as F

from proofline import schemas
from proofline.operators import admission, queue
from proofline.sources import derive
from proofline.streaming import jobs, queue_table, quota

USES = "event_id bigint, ts timestamp, user_id bigint, plan_id string, month string, cost int"
QUOTAS = {"free": 0, "pro": 7, "vip": 30}
FIRST = datetime(2024, 1, 1, tzinfo=timezone.utc)


def use(event, hours, user, cost=1, plan="pro"):
    ts = FIRST + timedelta(hours=hours)
    return event, ts, user, plan, ts.strftime("%Y-%m"), cost


def feed(spark, tmp, rows):
    spark.createDataFrame(rows, USES).coalesce(1).write.mode("append").parquet(f"{tmp}/in")
    query = quota.quota_meter(jobs.source(spark, f"{tmp}/in", USES), f"{tmp}/meter", QUOTAS, delay="2 days")
    query.awaitTermination()
    return query.lastProgress


def seen(spark, tmp):
    rows = quota.verdicts(spark, f"{tmp}/meter").collect()
    assert len(rows) == len({r.event_id for r in rows if not r.late}) + sum(r.late for r in rows)
    return {r.event_id: "late" if r.late else r.accepted for r in rows}


def test_quota_over_batches_equals_one_batch(spark, tmp_path):
    """A hot user, costs that differ, a quota that ends midway; batches split at random times."""
    rnd = random.Random(1)
    rows = []
    for i in range(900):
        user = 1 if i % 3 else rnd.randrange(2, 30)
        plan = ["free", "pro", "vip"][user % 3]
        rows.append(use(i, i * 1.5, user, rnd.randrange(0, 6), plan))
    for lo, hi in ((0, 200), (200, 650), (650, 900)):
        part = rows[lo:hi]
        rnd.shuffle(part)
        feed(spark, tmp_path, part)
    limit = F.expr("CASE plan_id WHEN 'pro' THEN 7 WHEN 'vip' THEN 30 ELSE 0 END")
    batch = spark.createDataFrame(rows, USES).withColumn("quota", limit)
    want = {r.event_id: r.accepted for r in admission.quota_variable(batch, "quota", 30).collect()}
    assert seen(spark, tmp_path) == want and set(want.values()) == {True, False}


def test_late_and_repeated_uses(spark, tmp_path):
    feed(spark, tmp_path, [use(1, 0, 5, 3), use(1, 0, 5, 3), use(2, 1, 5, 3), use(3, 2, 6, 1)])
    feed(spark, tmp_path, [use(2, 1, 5, 3), use(4, 200, 5, 2), use(5, 201, 5, 1)])  # 2 again; 5 fits beside 1 and 2
    feed(spark, tmp_path, [use(6, 3, 5, 1), use(7, 190, 5, 1), use(8, 900, 6, 1), (9, None, 5, "pro", None, 1)])
    got = seen(spark, tmp_path)
    assert got == {1: True, 2: True, 3: True, 4: False, 5: True, 6: "late", 7: False, 8: True, 9: "late"}
    late = spark.read.parquet(f"{tmp_path}/meter/uses/late=true")
    assert {r.event_id for r in late.collect()} == {6, 9} and late.filter("accepted IS NOT NULL").count() == 0


def test_state_follows_the_batch_and_ends_with_the_month(spark, tmp_path):
    feed(spark, tmp_path, [use(u, u / 10, u, 1) for u in range(200)])
    progress = feed(spark, tmp_path, [use(1000, 30, 3, 1)])
    state = progress.stateOperators[0]
    assert state.numRowsUpdated <= 4  # one user: the counter and one verdict, not the other 199
    assert state.numRowsTotal >= 401
    feed(spark, tmp_path, [use(1001, 24 * 40, 7, 1)])
    progress = feed(spark, tmp_path, [use(1002, 24 * 40 + 1, 7, 1)])
    assert progress.stateOperators[0].numRowsTotal < 20  # January is closed
    feed(spark, tmp_path, [use(1003, 31, 3, 1), use(1004, 24 * 41, 3, 7)])  # late; a new month starts from zero
    got = seen(spark, tmp_path)
    assert got[1003] == "late" and got[1004] is True and got[1000] is True


def test_meter_goes_on_after_a_restart_without_new_rows(spark, tmp_path):
    feed(spark, tmp_path, [use(1, 0, 5, 6)])
    query = quota.quota_meter(jobs.source(spark, f"{tmp_path}/in", USES), f"{tmp_path}/meter", QUOTAS, delay="2 days")
    query.awaitTermination()
    feed(spark, tmp_path, [use(2, 1, 5, 2), use(3, 2, 5, 1)])
    assert seen(spark, tmp_path) == {1: True, 2: False, 3: True}


def versions(tmp, kind):
    return sorted(os.listdir(f"{tmp}/table/{kind}")) if os.path.exists(f"{tmp}/table/{kind}") else []


def queue_feed(spark, tmp, events, **options):
    events.coalesce(1).write.mode("append").parquet(f"{tmp}/in")
    queue_table.queue_upserts(jobs.source(spark, f"{tmp}/in", schemas.EVENTS), f"{tmp}/table", **options).awaitTermination()


def same(spark, tmp, events):
    got = queue_table.current(spark, f"{tmp}/table")
    want = queue.latest(derive.queue_event_columns(events)).select(*got.columns)
    assert got.count() == want.count() and got.exceptAll(want).count() == 0


def test_queue_table_over_batches(spark, sf, tmp_path):
    """Parts out of order and repeated events; the newest status wins."""
    events = spark.read.schema(schemas.EVENTS).parquet(f"{sf}/events.parquet")
    assert queue_table.current(spark, f"{tmp_path}/table").count() == 0
    for n in (1, 0, 2, 1):
        queue_feed(spark, tmp_path, events.filter(F.col("event_id") % 3 == n), buckets=8)
    same(spark, tmp_path, events)
    queue_table.queue_upserts(jobs.source(spark, f"{tmp_path}/in", schemas.EVENTS), f"{tmp_path}/table", buckets=8).awaitTermination()
    same(spark, tmp_path, events)
    assert len(versions(tmp_path, "manifest")) == 2 and not versions(tmp_path, "changes")


def test_queue_batch_rewrites_its_buckets_only(spark, sf, tmp_path):
    events = spark.read.schema(schemas.EVENTS).parquet(f"{sf}/events.parquet")
    queue_feed(spark, tmp_path, events, buckets=16)
    assert len([p for p in os.listdir(f"{tmp_path}/table/data/v=0") if p.startswith("bucket=")]) == 16
    one = events.limit(1).withColumn("ts", F.col("ts") + F.expr("INTERVAL 10 YEARS")).persist()
    queue_feed(spark, tmp_path, one, buckets=16)
    assert len([p for p in os.listdir(f"{tmp_path}/table/data/v=1") if p.startswith("bucket=")]) == 1
    same(spark, tmp_path, events.unionByName(one))
    for _ in range(2):  # what no manifest names any more is removed
        queue_feed(spark, tmp_path, one, buckets=16)
    assert len([p for p in os.listdir(f"{tmp_path}/table/data/v=0") if p.startswith("bucket=")]) == 15
    assert "v=1" not in versions(tmp_path, "data")
    same(spark, tmp_path, events.unionByName(one))


def test_repeated_queue_batch_changes_nothing(spark, sf, tmp_path):
    rows = derive.queue_events(spark, sf)
    a, b = rows.filter("event_id % 2 = 0"), rows.filter("event_id % 2 = 1")
    root = f"{tmp_path}/table"
    queue_table.merge(a, root, 0, buckets=4)
    queue_table.merge(b, root, 1, buckets=4)
    first = queue_table.current(spark, root).collect()
    queue_table.merge(b, root, 1, buckets=4)  # as after a lost driver
    assert sorted(queue_table.current(spark, root).collect()) == sorted(first)


def test_repeats_within_the_watermark(spark, sf, tmp_path):
    events = spark.read.schema(schemas.EVENTS).parquet(f"{sf}/events.parquet")
    for _ in range(2):
        queue_feed(spark, tmp_path, events, buckets=4, repeats_within="1000 days")
    same(spark, tmp_path, events)

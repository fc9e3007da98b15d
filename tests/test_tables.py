"""Queues, quotas, sources, streaming and the registered queries."""

from __future__ import annotations

import json
import random
import struct
import zlib

import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry
import compare
from proofline.operators import admission, queue, score, stencil
from proofline.plans import readiness
from proofline.sources import derive, images


def test_variable_quota_matches_loop(spark):
    """Includes one user with most of the rows and quotas that end mid-way."""
    rnd = random.Random(5)
    rows, want = [], {}
    for i in range(3000):
        user = 1 if i % 3 else rnd.randrange(2, 40)
        rows.append((i, user, "2024-01", i, rnd.randrange(1, 9), {0: 0, 1: 7, 2: 40}[user % 3]))
    used: dict = {}
    for e, user, month, _, cost, quota in rows:
        ok = used.get(user, 0) + cost <= quota
        used[user] = used.get(user, 0) + cost * ok
        want[e] = ok
    df = spark.createDataFrame(rows, "event_id bigint, user_id bigint, month string, ts bigint, cost int, quota int")
    got = {r.event_id: r.accepted for r in admission.quota_variable(df, "quota", 40).collect()}
    assert got == want


def test_batch_cap_is_trimmed_before_the_exchange(spark):
    df = spark.range(1000).select((F.col("id") % 2).alias("batch_id"), F.col("id").alias("seq"))
    out = admission.first_per_batch(df, 20)
    assert sorted(r.seq for r in out.collect()) == list(range(40))
    assert "WindowGroupLimit" in out._jdf.queryExecution().executedPlan().toString()


def test_queue_rules(spark):
    q = spark.createDataFrame([(1, "idle", 0, 0), (2, "idle", 0, 0)], "image_id int, status string, ts int, event_id int")
    ch = spark.createDataFrame([(2, "done", 5, 9), (3, "error", 4, 8)], q.schema)
    assert sorted((r.image_id, r.status) for r in queue.upsert(q, ch).collect()) == [(1, "idle"), (2, "done"), (3, "error")]
    up = spark.createDataFrame([(1, "processing"), (7, "done")], "image_id int, status string")
    assert sorted((r.image_id, r.status) for r in queue.patch(q, up).collect()) == [(1, "processing"), (2, "idle")]
    assert [r.image_id for r in queue.remove(q, up).collect()] == [2]


def test_scores_stay_in_range_and_never_regress_on_dpi(spark, sf):
    out = score.before_after(readiness.measured(derive.images(spark, sf), derive.scanlines(spark, sf))).collect()
    assert out and all(0 <= r.pre_score <= 100 and 0 <= r.post_score <= 100 for r in out)
    assert all(r.post_score >= r.pre_score for r in out if r.preset_id != "social" and r.applied_scale > 1)


def _png(path, img):
    h, w = len(img), len(img[0])
    raw = b"".join(b"\0" + bytes(v for px in row for v in px) for row in img)

    def chunk(kind, data):
        body = kind + data
        return struct.pack(">I", len(data)) + body + struct.pack(">I", zlib.crc32(body))

    head = struct.pack(">IIBBBBB", w, h, 8, 6, 0, 0, 0)
    path.write_bytes(b"\x89PNG\r\n\x1a\n" + chunk(b"IHDR", head) + chunk(b"IDAT", zlib.compress(raw)) + chunk(b"IEND", b""))


def test_image_files(spark, tmp_path):
    img = [[(x * 9, y * 20, 7, 255 - x) for x in range(12)] for y in range(5)]
    _png(tmp_path / "a.png", img)
    (tmp_path / "bad.png").write_bytes(b"no image")
    scan = images.raster_to_scanlines(images.read_images(spark, str(tmp_path)))
    got = [list(zip(r.r, r.g, r.b, r.a)) for r in scan.orderBy("y").collect()]
    assert got == img
    files = {r.name.rsplit("/", 1)[1]: r for r in images.read_files(spark, str(tmp_path)).collect()}
    assert set(files) == {"a.png", "bad.png"} and files["a.png"].mime == "image/png"


def test_manifest_and_sinks(spark, tmp_path):
    rows = [{"id": f"s{i}", "name": "n", "filename": "f.png", "width": 10 + i, "height": 5, "description": "d",
             "targetPreset": "postcard", "dataUrl": "data:", "sizeBytes": 99} for i in range(10)]
    (tmp_path / "m.json").write_text(json.dumps(rows, indent=1))
    df = images.read_manifest(spark, str(tmp_path / "m.json"))
    assert df.count() == 10 and df.schema["sizeBytes"].dataType.simpleString() == "bigint"
    images.write_result(df, str(tmp_path / "out"), "json", ["targetPreset"])
    assert spark.read.json(str(tmp_path / "out")).count() == 10


def test_packed_lines_round_trip(spark, sf):
    scan = derive.scanlines(spark, sf).filter("image_id < 9")
    back = stencil.to_pixels(images.unpack_lines(images.pack_lines(scan)))
    assert back.exceptAll(stencil.to_pixels(scan)).count() == 0


NO_CROSS = ["preset_matrix", "nearest_shop", "quote_matrix", "preflight", "fuzzy_matches", "measured_scores"]


@pytest.mark.parametrize("name", NO_CROSS)
def test_no_cross_joins(spark, sf, name):
    plan = entry.queries()[name](spark, sf)._jdf.queryExecution().executedPlan().toString()
    assert "Scan parquet" in plan
    assert "CartesianProduct" not in plan and "BroadcastNestedLoopJoin" not in plan


def test_every_sql_twin_has_a_query():
    assert set(entry.oracle_sql()) <= set(entry.queries())


@pytest.mark.parametrize("name", ["dpi_analysis", "readiness_score", "fused_measurement", "text_summary", "vendor_quotes",
                                  "quota_variable_cost", "queue_upsert", "text_bands"])
def test_sql_twins_small(spark, sf, name):
    ok, note = compare.check(spark, compare.duck(sf), name, sf)
    assert ok, note


def test_entry(spark):
    df = entry.entry(spark)
    assert df.count() == 6 and "avg_delta" in df.columns

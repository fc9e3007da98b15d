"""Steps whose cost must follow the input: no broadcast of what grows, compact rows on the network, the same results."""

from __future__ import annotations

from pyspark.sql import functions as F

import catalog
from proofline import schemas
from proofline.functions import color
from proofline.functions.rounding import fixed_avg
from proofline.operators import bands, bleed, masks, stencil, transforms
from proofline.sources import derive, images

from conftest import as_grid, scan_frame


def _plan(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


def test_background_meets_lines_without_a_broadcast(spark, sf):
    assert "Broadcast" not in _plan(catalog.queries()["background_removal"](spark, sf))


def test_cut_line_meets_spans_without_a_broadcast(spark, sf):
    assert "Broadcast" not in _plan(catalog.queries()["cut_line"](spark, sf))


def test_only_bands_are_dealt(spark, sf):
    plan = _plan(derive.scanlines(spark, sf))
    assert "slope_r" not in plan.split("Exchange")[1] and "lambda" not in plan


def test_scanlines_hold_the_pixels(spark, sf):
    got = stencil.to_pixels(derive.scanlines(spark, sf))
    want = derive.pixels(spark, sf)
    assert got.exceptAll(want.select(*got.columns)).isEmpty() and want.select(*got.columns).exceptAll(got).isEmpty()


def test_pixels_travel_as_pieces_of_lines(spark):
    rows = [(1, 3, 1, x, 0, v, 0, None, 255) for x, v in ((2, 5), (0, 7), (0, 6), (1, 9))] + [(None, 1, 1, 0, 0, 1, 2, 3, 4)]
    px = spark.createDataFrame(rows, schemas.PIXELS)
    out = stencil.to_scanlines(px.repartition(3))
    got = {r.image_id: (r.r, r.b) for r in out.collect()}
    assert got == {1: ([6, 7, 9, 5], [None] * 4), None: ([1], [3])}
    assert "collect_list" not in _plan(out)


def test_lines_over_many_batches(spark):
    grid = {i: [[(x % 256, y, i, 255) for x in range(701)] for y in range(3)] for i in range(8)}
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "100")
    try:
        got = as_grid(stencil.to_scanlines(stencil.to_pixels(scan_frame(spark, grid))))
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    assert got == grid


def test_runs_and_masks_of_odd_lines(spark):
    rows = [(1, 4, 2, 0, [True, None, True, True]), (1, 4, 2, 1, [False] * 4), (2, None, 1, 0, [True]), (3, 3, 1, 0, None)]
    m = spark.createDataFrame(rows, "image_id bigint, w int, h int, y int, mask array<boolean>")
    runs = masks.mask_runs(m)
    assert {(r.image_id, r.y, r.x0, r.x1) for r in runs.collect()} == {(1, 0, 0, 0), (1, 0, 2, 3)}
    assert "lambda" not in _plan(runs)
    back = {(r.image_id, r.y): r.mask for r in masks.runs_to_mask(runs, m).collect()}
    assert back == {(1, 0): [True, False, True, True], (1, 1): [False] * 4, (2, 0): None, (3, 0): [False] * 3}


def test_grid_and_edges_have_no_lambda(spark, sf):
    lines = derive.scanlines(spark, sf)
    assert "lambda" not in _plan(bands.contrast_grid(lines)) + _plan(stencil.edge_score(lines))


def test_mean_of_billionths_is_exact(spark):
    df = spark.createDataFrame([(v,) for v in (0.1, -0.7, 123456.789, None)], "v double")
    row = df.agg(fixed_avg(F.col("v")).alias("m"), F.sum(F.floor(F.col("v") * 1e9 + 0.5)).alias("s")).first()
    assert row.m == row.s / 1e9 / 4
    assert "decimal(28,0)),false)" not in _plan(df.agg(fixed_avg(F.col("v"))))


def test_inks_of_codes_without_a_linear_value(spark):
    px = spark.createDataFrame([(None, 3, 4), (300, 0, 0), (255, 255, 255)], "r int, g int, b int")
    out = color.with_cmyk(px)
    assert [(r.c, r.m, r.y_ink) for r in out.collect()][:2] == [(0.0, 0.0, 0.0)] * 2
    assert [r.k for r in out.collect()][:2] == [1.0, 1.0]
    assert "MapInArrow" in _plan(out)


def test_clamp_packing_and_bleed_have_no_lambda(spark, sf):
    lines = derive.scanlines(spark, sf)
    px = derive.pixels(spark, sf)
    packed = images.pack_lines(lines)
    assert "lambda" not in _plan(packed) + _plan(bleed.bleed_pad(px))
    assert "_tac" not in _plan(transforms.clamp_ink(px))


def test_clamped_and_unknown_pixels(spark):
    px = spark.createDataFrame([(0, 0, 0), (0, 0, 255), (None, 0, 0), (255, 255, 255)], "r int, g int, b int")
    out = transforms.clamp_ink(px, 150).collect()
    assert [r.modified for r in out] == [True, True, None, False]
    assert (out[2].r, out[2].g, out[2].b) == (None, 0, 0) and (out[3].r, out[3].g, out[3].b) == (255, 255, 255)
    assert out[0].r == out[0].g == out[0].b == 159  # ink 150 / 400 of each plate


def test_packed_lines_without_width_or_channel(spark):
    rows = [(1, 2, 1, 0, [1, 2], [3, 4], [5, None], [7, 8]), (2, None, 1, 0, None, None, None, None), (3, 1, 1, 0, None, None, None, None)]
    out = images.pack_lines(spark.createDataFrame(rows, schemas.SCANLINES)).collect()
    assert {r.image_id: None if r.data is None else bytes(r.data) for r in out} == {1: bytes([5, 3, 1, 7]), 2: None, 3: b""}

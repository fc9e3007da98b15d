"""Neighbourhood and separable operators against plain loops, and invariants."""

from __future__ import annotations

import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from conftest import as_grid, scan_frame
from proofline.functions.color import srgb_table
from proofline.operators import bands, masks, measure, separable, stencil, transforms
from proofline.sources import derive


def noise(w, h, seed, alpha=None):
    rnd = random.Random(seed)
    return [[(rnd.randrange(256), rnd.randrange(256), rnd.randrange(256),
              255 if alpha is None else alpha(x, y, rnd)) for x in range(w)] for y in range(h)]


@pytest.mark.parametrize("step", [1, 2])
def test_edges_across_bands(spark, step):
    """A tall image crosses band borders; every row must still see both neighbours."""
    img = noise(9, 150, 1)
    got = stencil.edge_score(scan_frame(spark, {1: img}), step).first()
    lum = [[sum(p[:3]) / 765 for p in row] for row in img]
    total, n = 0.0, 0
    for y in range(1, 149, step):
        for x in range(1, 8, step):
            p = [[lum[y + j][x + i] for i in (-1, 0, 1)] for j in (-1, 0, 1)]
            gx = sum(k * (p[j][2] - p[j][0]) for j, k in enumerate((1, 2, 1)))
            gy = sum(k * (p[2][i] - p[0][i]) for i, k in enumerate((1, 2, 1)))
            gd = -p[0][1] - 2 * p[0][2] + p[1][0] + p[1][2] - 2 * p[2][0] + p[2][1]
            total += 0.5 * math.sqrt(gx * gx + gy * gy + 0.5 * gd * gd)
            n += 1
    assert got.edge_points == n and got.edge_score == pytest.approx(total / n, abs=1e-6)


def _disc(r):
    return [(dx, dy) for dx in range(-r, r + 1) for dy in range(-r, r + 1) if dx * dx + dy * dy <= r * r]


@pytest.mark.parametrize("radius", [1, 3, 5])
def test_masks_match_loops(spark, radius):
    w, h = 31, 80
    img = noise(w, h, 7, lambda x, y, rnd: 255 if rnd.random() < (0.97 if y < 40 else 0.03) else 0)
    on = {(x, y) for y in range(h) for x in range(w) if img[y][x][3] > 20}
    rows = masks.mask_rows(scan_frame(spark, {1: img}))

    def cells(runs):
        return {(x, r.y) for r in runs.collect() for x in range(r.x0, r.x1 + 1)}

    grown = {(x + dx, y + dy) for x, y in on for dx, dy in _disc(radius) if 0 <= x + dx < w and 0 <= y + dy < h}
    assert cells(masks.mask_runs(rows)) == on
    assert cells(masks.dilate(rows, radius)) == grown
    kept = {(x, y) for x, y in on if radius <= x < w - radius and radius <= y < h - radius
            and all((x + dx, y + dy) in on for dx, dy in _disc(radius))}
    assert cells(masks.erode(rows, radius)) == kept
    line = {(x, y) for x, y in on if 1 <= x < w - 1 and 1 <= y < h - 1
            and not {(x - 1, y), (x + 1, y), (x, y - 1), (x, y + 1)} <= on}
    assert {(r.x, r.y) for r in masks.contour_pixels(rows).collect()} == line
    back = masks.runs_to_mask(masks.mask_runs(rows), rows)
    assert {(x, r.y) for r in back.collect() for x, v in enumerate(r["mask"]) if v} == on


@pytest.mark.parametrize("radius", [1, 3, 17, 40, 300])
def test_discs_of_any_radius(spark, radius):
    """Distances over several bands and strips against the definition, for sparse, dense, empty and full masks."""
    import numpy as np

    from proofline.operators import distance

    rng = np.random.default_rng(radius)
    w, h = 60, 210
    sparse, dense = np.zeros((h, w), bool), np.ones((h, w), bool)
    sparse[rng.integers(0, h, 4), rng.integers(0, w, 4)] = True
    dense[rng.integers(0, h, 3), rng.integers(0, w, 3)] = False
    wide = np.zeros((3, 2 * distance.STRIP + 5), bool)
    wide[1, [0, distance.STRIP - 1, distance.STRIP, 2 * distance.STRIP + 4]] = True
    grids = {1: sparse, 2: dense, 3: np.zeros((h, w), bool), 4: np.ones((h, w), bool), 5: wide}
    lines = [(i, g.shape[1], g.shape[0], y, g[y].tolist()) for i, g in grids.items() for y in range(len(g))]
    rows = spark.createDataFrame(lines, "image_id long, w int, h int, y int, mask array<boolean>").repartition(5)

    def near(points, shape):
        ys, xs = np.indices(shape)
        return np.array([(ys - y) ** 2 + (xs - x) ** 2 <= radius * radius for y, x in points]).any(axis=0) if len(points) else np.zeros(shape, bool)

    def cells(runs):
        return {(r.image_id, r.y, x) for r in runs.collect() for x in range(r.x0, r.x1 + 1)}

    grown, kept = set(), set()
    for i, g in grids.items():
        few = np.argwhere(g) if i != 2 else None
        out = near(few, g.shape) if few is not None and len(few) < 50 else np.ones(g.shape, bool)
        grown |= {(i, int(y), int(x)) for y, x in np.argwhere(out)}
        ys, xs = np.indices(g.shape)
        inner = (xs >= radius) & (xs < g.shape[1] - radius) & (ys >= radius) & (ys < g.shape[0] - radius)
        left = inner & ~near(np.argwhere(~g), g.shape) if (~g).sum() < 50 else np.zeros(g.shape, bool)
        kept |= {(i, int(y), int(x)) for y, x in np.argwhere(left)}
    assert cells(distance.dilate(rows, radius)) == grown
    assert cells(distance.erode(rows, radius)) == kept
    # runs are maximal, one row a run
    runs = distance.dilate(rows, radius).filter("image_id = 4").collect()
    assert len(runs) == h and all((r.x0, r.x1) == (0, w - 1) for r in runs)


def test_wide_discs_equal_the_spread_runs(spark, sf, monkeypatch):
    from proofline.sources import derive

    rows = masks.mask_rows(derive.scanlines(spark, sf)).filter("image_id % 20 = 1")
    for run in (masks.dilate, masks.erode):
        got = {tuple(r) for r in run(rows, 18).select("image_id", "y", "x0", "x1").collect()}
        monkeypatch.setattr(masks, "WIDE", 50)
        assert got == {tuple(r) for r in run(rows, 18).select("image_id", "y", "x0", "x1").collect()}
        monkeypatch.undo()
    none = rows.filter("false")
    assert masks.dilate(none, 20).count() == 0 and masks.erode(none, 20).count() == 0


def test_sticker_solid_pixels(spark):
    img = [[(200, 40, 40, 255 if 15 <= x < 35 and 15 <= y < 35 else 0) for x in range(50)] for y in range(50)]
    row = measure.alpha_counts(stencil.to_pixels(scan_frame(spark, {1: img}))).first()
    assert row.solid == 400 and row.sticker_transparency


def test_text_band_image(spark):
    img = [[(20, 20, 20, 255) if 50 <= y < 80 and 60 <= x < 340 and (x // 3 + y // 3) % 2 == 0 else (245, 245, 245, 255)
            for x in range(400)] for y in range(300)]
    got = bands.text_bands(scan_frame(spark, {1: img})).collect()
    assert len(got) == 1
    box = got[0]
    assert box.box_y <= 52 and 75 <= box.box_y + box.box_h <= 90 and box.box_x <= 60 and box.box_w >= 270


def _kernel(d):
    d = abs(d)
    if d >= 3:
        return 0.0
    t = math.floor(d / 3 * 1024 + 0.5) / 1024 * 3
    if t == 0:
        return 1.0
    if t >= 3:
        return 0.0
    return float(np.float32(math.sin(math.pi * t) / (math.pi * t) * math.sin(math.pi * t / 3) / (math.pi * t / 3)))


def _line(values, scale, clamp):
    n, out = len(values), []
    for o in range(math.floor(n * scale + 0.5)):
        c = (o + 0.5) / scale - 0.5
        taps = [(s, _kernel(c - s)) for s in range(max(0, math.floor(c - 3)), min(n - 1, math.ceil(c + 3)) + 1)]
        taps = [(s, k) for s, k in taps if k != 0]
        v = sum(values[s] * k for s, k in taps) / sum(k for _, k in taps)
        if clamp:
            v = min(max(values[s] for s, _ in taps), max(min(values[s] for s, _ in taps), v))
        out.append(v)
    return out


def _resample(img, scale):
    lut = srgb_table()
    planes = []
    for c in range(4):
        p = [[lut[px[c]] if c < 3 else px[c] / 255 for px in row] for row in img]
        p = [[float(np.float32(v)) for v in _line(row, scale, c < 3)] for row in p]
        cols = [_line(list(col), scale, c < 3) for col in zip(*p)]
        planes.append([list(r) for r in zip(*cols)])

    def code(v, c):
        if c < 3:
            v = 12.92 * v if v <= 0.0031308 else 1.055 * v ** (1 / 2.4) - 0.055
        return min(255, max(0, math.floor(v * 255 + 0.5)))

    return [[tuple(code(planes[c][y][x], c) for c in range(4)) for x in range(len(planes[0][0]))]
            for y in range(len(planes[0]))]


def test_resample_matches_loops(spark):
    img = noise(70, 11, 3)
    got = as_grid(separable.resample(scan_frame(spark, {1: img}), 2.0))[1]
    assert got == _resample(img, 2.0)


def test_resample_each_factor(spark):
    imgs = {1: noise(8, 6, 4), 2: noise(7, 9, 5)}
    scan = scan_frame(spark, imgs).withColumn("factor", F.when(F.col("image_id") == 1, 3).otherwise(8))
    got = as_grid(separable.resample_each(scan, "factor"))
    assert got[1] == _resample(_resample(imgs[1], 2.0), 1.5)
    assert (len(got[2]), len(got[2][0])) == (72, 56)
    assert separable.scale_steps(8) == [2.0, 2.0, 2.0] and separable.scale_steps(2.2) == [2.2]


def _blur(rows, sigma):
    s = max(0.5, sigma)
    q = 0.98711 * s - 0.9633 if s >= 2.5 else 3.97156 - 4.14554 * math.sqrt(1 - 0.26891 * s)
    b0 = 1.57825 + 2.44413 * q + 1.4281 * q * q + 0.422205 * q ** 3
    b = [(2.44413 * q + 2.85619 * q * q + 1.26661 * q ** 3) / b0, -(1.4281 * q * q + 1.26661 * q ** 3) / b0,
         0.422205 * q ** 3 / b0]
    gain = 1 - sum(b)

    def run(v):
        out = []
        for i, x in enumerate(v):
            out.append(gain * x + sum(b[k] * out[i - k - 1] for k in range(3) if i > k))
        return out

    rows = [run(run(r)[::-1])[::-1] for r in rows]
    cols = [run(run(list(c))[::-1])[::-1] for c in zip(*rows)]
    return [list(r) for r in zip(*cols)]


def test_bands_hand_on_the_recurrence():
    """Any cut into bands, also of one row, gives the blur of the whole column."""
    rng = np.random.default_rng(1)
    v = rng.normal(size=(41, 3))
    for sigma in (0.8, 2.5, 9.0):
        want = separable.recursive_blur(v, sigma)
        for cuts in ([41], [20, 21], [1, 1, 2, 30, 5, 2], [8] * 5 + [1]):
            parts = np.split(v, np.cumsum(cuts)[:-1])
            states = separable._band_states(cuts, [separable._band_carries(p, sigma) for p in parts], sigma)
            got = np.concatenate([separable._band_blur(p, s, sigma) for p, s in zip(parts, states)])
            assert np.abs(got - want).max() < 1e-12


# the second image has several bands, the third several strips
@pytest.mark.parametrize("w,h", [(67, 23), (9, 197), (530, 66)])
def test_sharpening_matches_loops(spark, w, h):
    img = noise(w, h, 9, lambda x, y, rnd: (x * 3) % 256)

    def lightness(p):
        lin = [v / 255 / 12.92 if v / 255 <= 0.04045 else ((v / 255 + 0.055) / 1.055) ** 2.4 for v in p[:3]]
        y = 0.2126 * lin[0] + 0.7152 * lin[1] + 0.0722 * lin[2]
        return 116 * (y ** (1 / 3) if y > 0.008856 else 7.787 * y + 16 / 116) - 16

    light = [[lightness(p) for p in row] for row in img]
    fine, coarse = _blur(light, 0.8), _blur(light, 2.5)
    want = []
    for y in range(h):
        line = []
        for x in range(w):
            box = [light[j][i] / 100 for j in range(max(0, y - 4), min(h, y + 5)) for i in range(max(0, x - 4), min(w, x + 5))]
            var = max(0.0, sum(v * v for v in box) / len(box) - (sum(box) / len(box)) ** 2)
            a, b = light[y][x] - fine[y][x], light[y][x] - coarse[y][x]
            diff = 0.65 * a + 0.35 * b if a * b > 0 else 0.4 * a + 0.6 * b
            gain = 0.0
            if abs(diff) >= 3:
                f = 0.05 if var < 0.0003 else 1.0 if var >= 0.004 else 0.05 + 0.95 * ((var - 0.0003) / 0.0037) ** 2
                gain = diff * 1.5 * (0.8 + 0.4 * min(1.2, abs(diff) / 15)) * f
                if abs(gain) > 15:
                    over = (abs(gain) - 15) / 15
                    gain = math.copysign(min(15 + 7.5 * (1 - 1 / (1 + over)), 22.5), gain)
            line.append((*[min(255, max(0, math.floor(v + gain + 0.5))) for v in img[y][x][:3]], img[y][x][3]))
        want.append(line)
    got = as_grid(separable.unsharp(scan_frame(spark, {1: img})))[1]
    worst = max(abs(p - q) for gr, wr in zip(got, want) for gp, wp in zip(gr, wr) for p, q in zip(gp, wp))
    assert worst <= 1  # single-precision buffers may move a value across one rounding step
    assert [[p[3] for p in row] for row in got] == [[p[3] for p in row] for row in img]


def test_clamp_keeps_the_limit(spark, sf):
    for limit in (220, 300):
        out = transforms.clamp_ink(derive.pixels(spark, sf), limit)
        worst = measure.analyze_ink(out, limit).agg(F.max("max_tac")).first()[0]
        assert worst <= limit


def test_scanlines_equal_pixels(spark, sf):
    direct = stencil.to_pixels(derive.scanlines(spark, sf))
    pixels = derive.pixels(spark, sf).select(*direct.columns)
    assert direct.exceptAll(pixels).count() == 0 and pixels.exceptAll(direct).count() == 0


def test_background_removal(spark):
    img = [[(20, 20, 20, 255) if 15 <= x < 35 and 15 <= y < 35 else (255, 255, 255, 255) for x in range(50)] for y in range(50)]
    out = transforms.remove_background(scan_frame(spark, {1: img}))
    assert out.filter("cleared").count() == 2100 and out.filter("a = 255").count() == 400


def test_optimise_chain_matches_its_sql(spark, sf):
    """Too slow for the registered comparison, so on the small table here."""
    from catalog import neighbourhood
    from compare import duck, normal

    got = normal(neighbourhood.optimise_chain(spark, sf).toPandas())
    want = normal(duck(sf).sql(neighbourhood.OPTIMISED_SQL).df())
    assert len(got) == 200 and got.equals(want[got.columns])


def test_column_pass_takes_strips_of_equal_height_side_by_side():
    import pyarrow as pa

    from proofline.operators import separable

    rng = np.random.default_rng(5)
    sizes = {1: (6, 4), 2: (6, 9), 3: (6, 4), None: (8, 3)}
    rows = [(i, 20, h, y, 2.0, 0, rng.random(4 * w).tolist()) for i, (h, w) in sizes.items() for y in range(h)]
    names = ("image_id", "w", "h", "y", "step", "strip", "cells")
    kinds = (pa.int64(), pa.int32(), pa.int32(), pa.int32(), pa.float64(), pa.int32(), pa.list_(pa.float64()))
    table = pa.table({n: pa.array(c, t) for n, c, t in zip(names, zip(*rows), kinds)})
    batches = [table.slice(at, 5).combine_chunks().to_batches()[0] for at in range(0, len(rows), 5)]
    whole = [t.column("image_id").to_pylist() for t in separable._whole_groups(iter(batches), ("image_id", "strip"))]
    assert [i for t in whole for i in t] == [r[0] for r in rows] and all(set(a).isdisjoint(b) for a, b in zip(whole, whole[1:]))
    found = list(separable._resampled(table))
    assert len(found) == 2  # two heights
    got = {(r["image_id"], r["y"]): r for b in found for r in b.to_pylist()}
    for i, (h, w) in sizes.items():
        cube = np.array([r[6] for r in rows if r[0] == i]).reshape(1, h, w, 4)
        want = separable._to_codes(separable._blend(cube, h, 2.0, 3)[0][..., :3])
        for y in range(2 * h):
            assert got[i, y]["h"] == 2 * h and [got[i, y][c] for c in "rgb"] == want[y].T.tolist()


def test_sharpening_is_the_same_in_bands_of_any_height(spark):
    """Also for an image without an id."""
    images = {i: noise(w, h, i, lambda x, y, rnd: rnd.randrange(256)) for i, (w, h) in {1: (9, 70), 2: (530, 40), 3: (7, 33), 4: (9, 70)}.items()}
    scan = scan_frame(spark, images)
    nameless = scan.filter("image_id = 4").withColumn("image_id", F.lit(None).cast("bigint"))
    scan = scan.unionByName(nameless)
    whole, cut = (sorted(map(str, separable.unsharp(scan, band_rows=n).collect())) for n in (256, 16))
    assert len(whole) == 70 + 40 + 33 + 70 + 70 and whole == cut


def test_optimise_takes_many_small_images_at_once_and_broadcasts_nothing(spark, sf):
    from proofline.plans import optimise

    scan = derive.scanlines(spark, sf)
    scales = derive.thumbnails(spark, sf).selectExpr("image_id", "IF(w < 30, 3, 1) AS scale_factor")
    plan = optimise.optimise(scan, scales)._jdf.queryExecution().executedPlan().toString()
    assert "InPandas" not in plan and "GroupsInArrow" not in plan and "Broadcast" not in plan


def test_clamped_lines_have_the_pixels_of_the_pixel_form(spark):
    """Lists that are longer or shorter than the line, pixels without a channel, lines without a width or a list, lines that come twice."""
    from proofline import schemas
    from proofline.plans import optimise

    dark = [5, 2, 200]
    rows = [(1, 3, 2, 0, dark, [0, 0, 0], [0, 9, 0], [255] * 3), (1, 3, 2, 1, dark + [7], [0, 0], [0, None, 0], None),
            (2, 3, 1, 0, dark, dark, dark, dark), (2, 3, 1, 0, [1, 1, 1], dark, dark, dark), (3, None, 1, 0, dark, dark, dark, dark),
            (None, 2, 1, 0, [0, 3], [0, 3], [0, 3], [9, 9]), (4, 0, 1, 0, [], [], [], [])]
    scan = spark.createDataFrame(rows, schemas.SCANLINES)
    want = stencil.to_scanlines(transforms.clamp_ink(stencil.to_pixels(scan), 300).drop("modified"))
    got = optimise.limit_ink(scan)
    assert sorted(map(str, got.collect())) == sorted(map(str, want.collect())) and got.count() == 5

"""Nothing is dropped by size, and odd rows do no harm."""

from __future__ import annotations

import re

import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry
from conftest import scan_frame
from proofline.functions import text as tx
from proofline.operators import admission, bands, commerce, measure, score, separable, sizing, stencil, textcheck
from proofline.operators.lookup import with_preset
from proofline.plans import optimise, readiness
from proofline.sources import derive, dims


def striped(spark, w, h):
    """Black and green columns in turn, as pixels."""
    return spark.range(w * h).selectExpr("1L AS image_id", f"{w} AS w", f"{h} AS h", f"int(id % {w}) AS x", f"int(id div {w}) AS y",
                                         "0 AS r", "int(id % 2 * 255) AS g", "0 AS b", "255 AS a")


def test_statistics_read_every_pixel(spark):
    p = striped(spark, 1200, 1000)
    a, b = measure.pixel_stats(p).first(), measure.measure(p).first()
    assert a.n == b.n == 1_200_000 and abs(a.avg_lum - b.avg_lum) < 1e-12 and abs(a.avg_sat - 0.5) < 1e-9
    assert measure.analyze_gamut(p).first().oog_ratio == b.oog_ratio
    assert measure.pixel_stats(p, stride_above=1_000_000).first().n == 600_000
    assert measure.colour_clusters(p).agg(F.sum("pixels")).first()[0] == 1_200_000


def lines_image(w, h, top, gap, thick, count):
    img = [[(255, 255, 255, 255)] * w for _ in range(h)]
    for k in range(count):
        for y in range(top + k * gap, top + k * gap + thick):
            img[y] = [(0, 0, 0, 255) if 20 <= x < w - 20 and x % 6 < 3 else (255, 255, 255, 255) for x in range(w)]
    return img


def test_thin_strokes_and_all_bands(spark):
    scan = scan_frame(spark, {1: lines_image(400, 400, 21, 28, 2, 13)})
    assert bands.text_bands(scan).count() == 13
    assert bands.text_bands(scan, max_bands=8).count() == 8


def test_edge_score_is_the_mean_of_all_points(spark, sf):
    scan = derive.scanlines(spark, sf).filter("image_id < 12")
    got = {r.image_id: (r.edge_score, r.edge_points) for r in stencil.edge_score(scan).collect()}
    for r in stencil.sobel(scan).groupBy("image_id", ).agg(F.avg("magnitude").alias("m"), F.count("*").alias("n")).collect():
        assert got[r.image_id][1] == r.n and abs(got[r.image_id][0] - r.m) < 1e-8
    every = stencil.edge_score(scan, step=3).collect()
    thin = {r.image_id: r.n for r in stencil.sobel(scan, step=3).groupBy("image_id").agg(F.count("*").alias("n")).collect()}
    assert {r.image_id: r.edge_points for r in every} == thin


def exchanges_with_pixels(df):
    """Inputs of the exchanges that carry an ``x`` column."""
    plan = df.sparkSession._jvm.org.apache.spark.sql.api.python.PythonSQLUtils.explainString(df._jdf.queryExecution(), "formatted")
    inputs = re.findall(r"^\(\d+\) Exchange[^\n]*\nInput \[\d+\]: \[([^\n]*)\]", plan, re.M)
    assert inputs
    return [x for x in inputs if re.search(r"(^|[ ,])x#", x)]


def test_no_exchange_over_pixel_rows(spark, sf):
    for name in ("named_steps", "background_removal"):
        assert exchanges_with_pixels(entry.queries()[name](spark, sf)) == []


def test_limit_ink_equals_the_pixel_form(spark, sf):
    scan = derive.scanlines(spark, sf).filter("image_id < 6")
    from proofline.operators import transforms

    want = transforms.clamp_ink(stencil.to_pixels(scan), 300).drop("modified")
    got = stencil.to_pixels(optimise.limit_ink(scan))
    assert got.exceptAll(want.select(*got.columns)).count() == 0 and got.count() == want.count()


IMAGES = "image_id bigint, width_px int, height_px int, preset_id string"


def test_images_without_size(spark):
    rows = [(1, 0, 0, "poster-a4"), (2, 0, 10, "social"), (3, None, 5, "poster-a4"), (4, 100, 300, "social"), (5, 7000, 5000, "poster-a3")]
    got = {r.image_id: r for r in sizing.analyze_dpi(with_preset(spark.createDataFrame(rows, IMAGES))).collect()}
    assert [got[i].scale_factor for i in (1, 2, 3)] == [None] * 3 and not any(got[i].needs_upscale for i in (1, 2, 3))
    assert got[4].scale_factor == 11 and got[5].scale_factor == 1
    wide = sizing.analyze_dpi(with_preset(spark.createDataFrame(rows, IMAGES)), max_px=20_000).filter("image_id = 5").first()
    assert wide.scale_factor >= 1
    stats = spark.createDataFrame(rows, IMAGES).selectExpr("*", "0.5D AS avg_lum", "0.2D AS avg_sat", "0.2D AS std_lum", "0.1D AS edge_score",
                                                           "200 AS max_tac", "CAST(null AS double) AS oog_ratio", "false AS has_overflow")
    scored = {r.image_id: r.score for r in score.score_readiness(sizing.analyze_dpi(with_preset(stats)), issues=True).collect()}
    assert scored[1] is None and scored[2] is None and scored[3] is None and scored[4] > 0


def test_quantity_zero(spark):
    rows = spark.createDataFrame([("gainhow", "poster-a4", "250g-matte", 0)], "vendor_id string, preset_id string, paper_id string, qty int")
    assert commerce.quote(rows).first().unit_price is None


def test_tiny_images_stay_in_the_report(spark):
    scan = scan_frame(spark, {1: [[(10, 20, 30, 255)] * 2] * 5, 2: [[(10, 20, 30, 255)] * 9] * 9})
    images = spark.createDataFrame([(1, 2, 5, "a"), (2, 9, 9, "a")], "image_id bigint, width_px int, height_px int, category string")
    got = {r.image_id: r.edge_score for r in readiness.measured(images, scan).collect()}
    assert set(got) == {1, 2} and got[1] == 0.04


def test_every_order_has_a_ticket(spark, sf):
    assert entry.queries()["order_tickets"](spark, sf).count() == spark.read.parquet(f"{sf}/orders.parquet").count()


@pytest.mark.parametrize("factor", [2, 3, 9, 11])
def test_any_enlargement(spark, factor):
    scan = scan_frame(spark, {1: [[(10 * x, 20 * y, 30, 255) for x in range(5)] for y in range(4)], 2: [[(1, 2, 3, 255)] * 3] * 3})
    scales = spark.createDataFrame([(1, factor), (2, None)], "image_id bigint, scale_factor int")
    got = {r.image_id: (r.w, r.h, r.n) for r in optimise.upscale_where_needed(scan, scales).groupBy("image_id", "w", "h").agg(F.sum(F.size("r")).alias("n")).collect()}
    w = h = None
    for axis, size in (("w", 5), ("h", 4)):
        for step in separable.scale_steps(factor):
            size = int(size * step + 0.5)
        w, h = (size, h) if axis == "w" else (w, size)
    assert got == {1: (w, h, w * h), 2: (3, 3, 9)}


def test_unicode_blanks_and_layout(spark):
    rows = spark.createDataFrame([(1, "　hello　coffee cofee\n\n  next\tline﻿")], "doc_id int, text string")
    words = [r.clean for r in textcheck.tokenize(rows, ["doc_id"]).orderBy("pos").collect()]
    assert words == ["hello", "coffee", "cofee", "next", "line"]
    assert rows.select(tx.with_word(F.col("text"), F.lit(2), F.lit("COFFEE"))).first()[0] == "hello　coffee COFFEE\n\n  next\tline"
    counts = textcheck.word_counts(textcheck.tokenize(rows, ["doc_id"]))
    vocab, typos = dims.table(spark, "vocab"), dims.table(spark, "typos")
    issues = textcheck.first_issue(textcheck.judge_words(textcheck.tokenize(rows, ["doc_id"]), vocab, typos), ["doc_id"])
    out = textcheck.suggest_text(rows, issues, ["doc_id"]).first()
    assert out.word == "cofee" and out.suggestion == "hello　coffee coffee\n\n  next\tline"


USES = "user_id int, month string, ts int, event_id int, cost int, q int"


def plain_quota(rows):
    first, used, verdict = {}, {}, {}
    for r in sorted(rows, key=lambda r: (r[2], r[3])):
        key = (r[0], r[1])
        if (*key, r[3]) in first:
            continue
        first[(*key, r[3])] = True
        fits = r[4] == 0 or used.get(key, 0) + r[4] <= r[5]
        used[key] = used.get(key, 0) + (r[4] if fits else 0)
        verdict[(*key, r[3])] = fits
    return sorted((r[0], r[3], verdict[(r[0], r[1], r[3])]) for r in rows)


def test_quota_with_free_and_repeated_uses(spark):
    import random

    rng = random.Random(5)
    rows = [(u, "m", t, t, rng.randint(0, 4), 9) for u in range(4) for t in range(30)]
    rows += [(9, "m", t, t, 0, 2) for t in range(5)] + [rows[3], rows[3], rows[40]]
    got = admission.quota_variable(spark.createDataFrame(rows, USES), "q", 9)
    assert sorted((r.user_id, r.event_id, r.accepted) for r in got.collect()) == plain_quota(rows)


def test_shared_folder_is_required_on_a_cluster():
    from types import SimpleNamespace

    from proofline.session import shared_dir

    cluster = SimpleNamespace(conf=SimpleNamespace(get=lambda key, default: None), sparkContext=SimpleNamespace(master="spark://host:7077"))
    with pytest.raises(ValueError):
        shared_dir(cluster)


def test_optimised_images_are_measured_again(spark, sf, tmp_path):
    """The chain agrees with its steps: ink stays under the limit, sizes grow by the factor, scores follow."""
    ids = "image_id < 8"
    images, scan = derive.images(spark, sf).filter(ids), derive.scanlines(spark, sf).filter(ids)
    got = {r.image_id: r for r in readiness.optimised_scores(images, scan, str(tmp_path / "work")).collect()}
    before = {r.image_id: r for r in score.score_readiness(readiness.measured(images, scan)).collect()}
    sizes = {r.image_id: (r.w, r.h) for r in spark.read.parquet(str(tmp_path / "work")).select("image_id", "w", "h").distinct().collect()}
    first = {r.image_id: (r.w, r.h) for r in scan.select("image_id", "w", "h").distinct().collect()}
    assert set(got) == set(before) == set(sizes)
    for i, r in got.items():
        assert r.pre_score == before[i].score and r.max_tac <= 300 and r.score_delta == r.post_score - r.pre_score
        want = before[i].scale_factor if before[i].needs_upscale else 1
        assert r.applied_scale == want
        for k in (0, 1):
            size = first[i][k]
            for step in separable.scale_steps(want):
                size = int(size * step + 0.5)
            assert sizes[i][k] == size
    assert any(r.applied_scale > 1 and r.post_dpi > r.pre_dpi for r in got.values())


def test_word_lists_grow_with_the_corpus(spark):
    """A word's share decides, not its rank: a thousand frequent words are all vocabulary."""
    rows = [(f"word{chr(97 + i // 26 % 26)}{chr(97 + i % 26)}{i // 676}", 50) for i in range(1000)] + [("wordx", 12), ("wordy", 9), ("abc", 10**6)]
    counts = spark.createDataFrame(rows, "clean string, n bigint")
    vocab, typos = textcheck.corpus_lists(counts, 4000, 5000)
    words = {r.word for r in vocab.collect()}
    assert {w for w, n in rows if n == 50} <= words and "wordx" not in words and "abc" not in words
    assert {r.bad for r in typos.collect()} - set(dims.TYPOS) == {"wordx"}  # 12 of 50,021 is one in 4168; 9 is one in 5558
    assert typos.filter("bad = 'wordx'").first().good == "wordaa0"


@pytest.mark.parametrize("keys", [0, 10**6])
def test_closest_words_with_and_without_broadcast(spark, monkeypatch, keys):
    monkeypatch.setattr(textcheck, "BROADCAST_KEYS", keys)
    vocab = spark.createDataFrame([("coffee", 0), ("office", 1), ("edition", 2)], "word string, ordinal int")
    words = spark.createDataFrame([("cofee",), ("offce",), ("edition",), ("coffeeee",), ("tea",)], "clean string")
    got = {r.clean: (r.closest, r.distance) for r in textcheck.closest_words(words, vocab).collect()}
    assert got == {"cofee": ("coffee", 1), "offce": ("office", 1), "edition": ("edition", 0), "coffeeee": ("coffee", 2)}
    assert {r.clean for r in textcheck.fuzzy_matches(words, vocab).collect()} == {"cofee", "offce", "coffeeee"}


def test_measures_of_images_are_not_broadcast(spark, sf, tmp_path):
    """One row per image grows with the collection; only the fixed dimension may be sent to every task."""
    scan = derive.scanlines(spark, sf).filter("image_id < 20")
    out = readiness.optimised_scores(derive.images(spark, sf).filter("image_id < 20"), scan, str(tmp_path / "changed"))
    plan = out._jdf.queryExecution().executedPlan().toString()
    joins = re.findall(r"BroadcastHashJoin \[([^\]]*)\]", plan)
    assert "SortMergeJoin" in plan and joins and all(j.startswith("_key#") for j in joins)

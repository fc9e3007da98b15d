"""Hand-computed values of the scalar rules."""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from proofline.functions import color, geo, text, units
from proofline.functions.register import register
from proofline.functions.rounding import jr_int, tenths
from proofline.operators import admission, bands, commerce, lookup, report, sizing, textcheck
from proofline.sources import dims


def one(spark, *cols):
    return spark.range(1).select(*cols).first()


def test_units_and_rounding(spark):
    row = one(spark, units.mm_to_px(F.lit(210.0), F.lit(300)), units.mm_to_px(F.lit(-1.0), F.lit(300)),
              jr_int(F.lit(-2.5)), jr_int(F.lit(2.5)), tenths(F.lit(1.25)))
    assert tuple(row) == (2480, 0, -2, 3, 1.3)


@pytest.mark.parametrize("w,h,dpi,tier,scale,up", [
    (1000, 1414, 121, "critical", 3, True), (3000, 4242, 363, "excellent", 1, False)])
def test_dpi_on_a4(spark, w, h, dpi, tier, scale, up):
    df = spark.createDataFrame([(w, h, "poster-a4")], "width_px int, height_px int, preset_id string")
    row = sizing.analyze_dpi(lookup.with_preset(df)).first()
    assert (row.current_dpi, row.quality_tier, row.scale_factor, row.needs_upscale) == (dpi, tier, scale, up)


def test_preset_detection(spark):
    cases = [(800, 800, "sticker"), (2048, 2048, "social"), (1060, 636, "business-card"), (1480, 1000, "postcard"),
             (2480, 1754, "poster-a4"), (4960, 3508, "poster-a3"), (0, 10, "poster-a4")]
    df = spark.createDataFrame(cases, "w int, h int, want string")
    got = df.select("want", sizing.detect_best_preset(F.col("w"), F.col("h")).alias("got")).collect()
    assert all(r.want == r.got for r in got)


def test_tac(spark):
    df = spark.createDataFrame([(0, 0, 0), (255, 0, 0), (255, 255, 255)], "r int, g int, b int")
    got = [r[0] for r in df.select(color.tac(F.col("r"), F.col("g"), F.col("b"))).collect()]
    assert got == [400.0, 200.0, 0.0]


def test_quotes(spark):
    rows = [("gainhow", "poster-a4", "250g-matte", q) for q in (10, 50, 100, 1000)]
    df = spark.createDataFrame(rows, "vendor_id string, preset_id string, paper_id string, qty int")
    got = {r.qty: r for r in commerce.quote(df).collect()}
    assert [got[q].total_price for q in (10, 50, 100, 1000)] == [158, 422, 642, 2269]
    prices = [got[q].unit_price for q in (10, 50, 100, 1000)]
    assert prices == sorted(prices, reverse=True)
    assert got[100].best_value and "volume_rate" in got[100].notes


def test_imposition(spark):
    df = spark.createDataFrame([(90.0, 54.0, "A4"), (50.0, 50.0, "A4"), (148.0, 100.0, "A3"), (400.0, 400.0, "A4")],
                               "item_w double, item_h double, sheet string")
    got = {(r.item_w, r.item_h): r for r in commerce.imposition_layout(df).collect()}
    assert (got[90, 54].cells, got[90, 54].rotated, got[90, 54].savings_pct) == (9, True, 85)
    assert (got[50, 50].cells, got[50, 50].savings_pct) == (15, 85)
    assert (got[148, 100].cells, got[148, 100].rotated, got[148, 100].savings_pct) == (4, True, 75)
    assert got[400, 400].cells == 1 and not got[400, 400].fits


def test_distance(spark):
    row = one(spark, geo.haversine_m(F.lit(25.0478), F.lit(121.5170), F.lit(25.0339), F.lit(121.5645)),
              geo.format_distance(F.lit(450)), geo.format_distance(F.lit(2250)))
    assert tuple(row) == (5029, "450 m", "2.3 km")


def test_text_rules(spark):
    row = one(spark, F.levenshtein(F.lit("kitten"), F.lit("sitting")),
              text.match_case(F.lit("COFEE"), F.lit("coffee")), text.match_case(F.lit("Cofee"), F.lit("coffee")),
              text.collapse_repeats(F.lit("coooolll")), text.gibberish_reason(F.lit("bcdfgh"), F.lit("bcdfgh")),
              text.gibberish_reason(F.lit("world"), F.lit("wOrld")), text.html_escape(F.lit("<a href='x'>&</a>")))
    assert tuple(row) == (3, "COFFEE", "Coffee", "cooll", "consonants", "mixed_case",
                          "&lt;a href=&#39;x&#39;&gt;&amp;&lt;/a&gt;")


def _check_texts(spark, texts):
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string")
    vocab, typos = dims.table(spark, "vocab"), dims.table(spark, "typos")
    judged = textcheck.judge_words(textcheck.tokenize(docs, ["doc_id"]), vocab, typos)
    issues = textcheck.first_issue(judged, ["doc_id"])
    return {r.doc_id: r for r in textcheck.suggest_text(docs, issues, ["doc_id"]).collect()}


def test_text_suggestions(spark):
    got = _check_texts(spark, ["SPECIAL COFEE EDITION", "NEON TOKYO", "aaab fine", "happy birthday", "  Exhibitiom  now",
                               "moderm cLean", "xzcvbn"])
    assert got[0].suggestion == "SPECIAL COFFEE EDITION" and got[0].pos == 1
    assert 1 not in got
    assert (got[2].reason, got[2].suggestion) == ("repeat", "aab")
    assert got[3].reason == "consonants" and got[3].suggestion == "birthday"
    assert (got[4].reason, got[4].suggestion) == ("near_vocabulary", "Exhibition  now")
    assert got[5].suggestion == "modern cLean"
    assert (got[6].reason, got[6].suggestion) == ("consonants", "")


def test_hysteresis(spark):
    v = [0, .05, .09, .06, .05, .04, .05, .1, .02]
    df = spark.createDataFrame([(1, i, float(x)) for i, x in enumerate(v)], "g int, i int, v double")
    got = [r.in_band for r in bands.hysteresis(df, "v", "g", "i").orderBy("i").collect()]
    assert got == [0, 0, 1, 1, 1, 0, 0, 1, 0]


def test_profile_limits(spark):
    df = spark.createDataFrame([(280,), (360,)], "max_tac int")
    got = {(r.max_tac, r.profile_id): r for r in report.tac_compliance(df).collect()}
    assert got[280, "japan-color-2001"].compliant and got[280, "japan-color-2001"].tac_delta == 0
    assert not got[360, "japan-color-2001"].compliant and got[360, "japan-color-2001"].tac_delta == 10


def test_admission(spark):
    rows = [("image/png", 10, 5, 5), ("text/plain", 10, 5, 5), ("image/png", 200_000_000, 5, 5), ("image/gif", 1, 0, 5),
            (None, 1, 5, 5)]
    df = spark.createDataFrame(rows, "mime string, size_bytes bigint, width_px int, height_px int")
    got = [r.reject_reason for r in admission.reject_reason(df).collect()]
    assert got == [None, "not_image", "too_large", "undecodable", "not_image"]


def test_sql_surface(spark):
    names = register(spark)
    assert "tac" in names
    row = spark.sql("SELECT mm_to_px(210D, 300), js_round(-2.5D), tac(0,0,0), clean_token('Caf-É9!'), "
                    "haversine_m(25.0478D, 121.5170D, 25.0339D, 121.5645D), match_case('Ab', 'xyz')").first()
    assert tuple(row) == (2480, -2, 400.0, "caf9", 5029, "Xyz")


def test_dimension_sizes(spark):
    want = {"presets": 6, "vendors": 4, "papers": 5, "shops": 13, "products": 6, "profiles": 8, "plans": 3,
            "qty_tiers": 7, "vocab": 118, "typos": 32}
    assert {n: dims.table(spark, n).count() for n in dims.names()} == want


def test_judged_words_read_the_texts_twice_and_keep_each_spelling(spark):
    from proofline.operators import textcheck

    texts = spark.createDataFrame([(1, " colour Colour COLOUR　xyzzkrt coolour"), (2, "colour﻿kept kept"), (3, None)], "doc_id bigint, text string")
    vocab = spark.createDataFrame([("kept", 0), ("color", 1)], "word string, ordinal int")
    typos = spark.createDataFrame([("colour", "color")], "bad string, good string")
    words = textcheck.split_words(texts, ["doc_id"])
    spelled = textcheck.spellings(words)
    assert {(r.word, r.n) for r in spelled.collect()} == {("colour", 2), ("Colour", 1), ("COLOUR", 1), ("xyzzkrt", 1), ("coolour", 1), ("kept", 2)}
    got = {(r.doc_id, r.pos, r.word, r.reason, r.fix) for r in textcheck.judge_words(words, vocab, typos, spelled=spelled).collect()}
    assert got == {(1, 0, "colour", "misspelling", "color"), (1, 1, "Colour", "misspelling", "Color"), (1, 2, "COLOUR", "misspelling", "COLOR"),
                   (1, 3, "xyzzkrt", "consonants", ""), (1, 4, "coolour", "near_vocabulary", "color"), (2, 0, "colour", "misspelling", "color")}


def test_a_word_that_asks_for_one_edit_has_few_keys(spark):
    from proofline.operators import textcheck

    asked = spark.createDataFrame([("spelling", 1), ("spell", 2)], "clean string, limit int")
    vocab = spark.createDataFrame([("spellings", 0), ("spells", 1), ("spall", 2), ("shell", 3)], "word string, ordinal int")
    assert textcheck.deletion_keys(asked, "clean").groupBy("clean").count().collect() == [("spelling", 9), ("spell", 16)]
    got = {tuple(r) for r in textcheck.closest_words(asked, vocab).collect()}
    assert got == {("spelling", "spellings", 1), ("spell", "spells", 1)}


def test_long_words_find_the_closest_by_their_thirds(spark):
    from itertools import combinations

    from proofline.operators import textcheck

    base = "abcdefghi"
    made = {base[:i] + x + base[i + 1:] for i in range(9) for x in ("", "z", "zq")} | {"zq" + base, base + "zq", base[2:], base[:-2], "q" + base + "z"}
    made |= {"".join(c for k, c in enumerate(base) if k not in two) for two in combinations(range(9), 2)}
    made |= {"".join("z" if k in two else c for k, c in enumerate(base)) for two in combinations(range(9), 2)}
    asked = spark.createDataFrame([(w,) for w in sorted(made)], "clean string")
    vocab = spark.createDataFrame([(base, 0), ("unrelated", 1)], "word string, ordinal int")
    assert textcheck.piece_keys(asked, "clean").groupBy("clean").count().select("count").distinct().collect() == [(3,)]
    assert {r.clean for r in textcheck.closest_words(asked, vocab).collect()} == made

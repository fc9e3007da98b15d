"""Image metadata: admission, presets, DPI, score, reports."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from proofline.functions import text as tx
from proofline.functions import units
from proofline.functions.rounding import js_round, jr_int, r6
from proofline.operators import admission, bleed, lookup, report, score, sizing
from proofline.sources import derive, dims

from . import sql as S


def _detected(spark, d) -> DataFrame:
    img = derive.image_stats(spark, d)
    img = img.withColumns({"preset_id": sizing.detect_best_preset(F.col("width_px"), F.col("height_px")),
                           "oog_ratio": F.lit(None).cast("double"), "has_overflow": F.col("max_tac") > 300})
    return lookup.with_preset(img)


def _dpi(spark, d) -> DataFrame:
    return sizing.analyze_dpi(_detected(spark, d))


def _compared(spark, d) -> DataFrame:
    return score.before_after(_dpi(spark, d))


def admission_check(spark: SparkSession, d: str) -> DataFrame:
    out = admission.reject_reason(derive.images(spark, d))
    return out.select("image_id", "mime", "size_bytes", "reject_reason")


def preset_detection(spark, d):
    return derive.images(spark, d).select(
        "image_id", sizing.detect_best_preset(F.col("width_px"), F.col("height_px")).alias("preset_id"))


DPI_COLS = ["image_id", "preset_id", "current_dpi", "target_dpi", "quality_tier", "scale_factor", "needs_upscale",
            "target_width_px", "target_height_px"]


def dpi_analysis(spark, d):
    return _dpi(spark, d).select(*DPI_COLS)


def dpi_digital(spark, d):
    img = derive.images(spark, d).withColumn("preset_id", F.lit("social"))
    return sizing.analyze_dpi(lookup.with_preset(img)).select(*DPI_COLS)


def preset_matrix(spark, d):
    return sizing.analyze_dpi(lookup.cross_presets(derive.images(spark, d))).select(*DPI_COLS)


def best_preset(spark, d):
    out = sizing.best_preset(derive.images(spark, d))
    return out.select("image_id", "best_preset", "best_dpi", "best_gap")


def preset_ranking(spark, d):
    return sizing.rank_presets(derive.images(spark, d)).select("image_id", "preset_id", "dpi", "preset_rank")


def preset_lookup_default(spark, d):
    """Orders whose preset id is partly unknown, resolved to the default row."""
    o = derive.print_orders(spark, d).withColumn(
        "preset_id", F.when(F.col("order_id") % 7 == 0, F.lit("photo-4x6")).otherwise(F.col("preset_id")))
    return lookup.with_preset(o).select("order_id", "preset_id", "width_mm", "height_mm", "target_dpi", "bleed_mm")


SCORE_COLS = ["image_id", "preset_id", *[f"s_{n}" for n in score.FACTORS], "score", "level"]


def readiness_score(spark, d):
    return score.score_readiness(_dpi(spark, d)).select(*SCORE_COLS)


def issue_codes(spark, d):
    out = score.score_readiness(_dpi(spark, d), issues=True)
    return out.select("image_id", F.concat_ws(",", "issues").alias("issues"),
                      F.concat_ws(",", "recommendations").alias("recommendations"))


def level_and_badges(spark, d):
    out = score.score_readiness(_dpi(spark, d))
    return out.select("image_id", "score", "level", score.badge(F.col("score")).alias("badge"),
                      score.colour_band(F.col("score")).alias("colour_band"),
                      *[c.alias(n) for n, c in score.tile_passes().items()])


BA_COLS = ["image_id", "preset_id", "applied_scale", "pre_score", "post_score", "pre_dpi", "post_dpi", "score_delta",
           "regressed"]


def before_after_scores(spark, d):
    return _compared(spark, d).select(*BA_COLS)


def run_report(spark, d):
    return report.run_report(_compared(spark, d)).select(
        "images", "avg_pre", "avg_post", "avg_delta", "min_post", "max_post", "regressions")


def category_report(spark, d):
    return report.run_report(_compared(spark, d), ["category"]).select(
        "category", "images", "avg_pre", "avg_post", "avg_delta", "min_post", "max_post", "regressions")


def score_distribution(spark, d):
    return report.score_distribution(_compared(spark, d))


def anomaly_rows(spark, d):
    return report.anomalies(_compared(spark, d)).select("image_id", "anomaly", "applied_scale", "score_delta")


def anomaly_counts(spark, d):
    return report.anomalies(_compared(spark, d)).groupBy("category", "anomaly").agg(F.count("*").alias("rows_found"))


def worst_images(spark, d):
    return report.worst(_compared(spark, d), 25, below=88).select("image_id", "post_score")


def delta_labels(spark, d):
    return _compared(spark, d).groupBy(tx.delta_label(F.col("score_delta")).alias("label")).agg(
        F.count("*").alias("images"))


def optimisation_actions(spark, d):
    return _dpi(spark, d).select("image_id", F.concat_ws(",", score.action_list()).alias("actions"))


def unit_conversion(spark, d):
    img = derive.images(spark, d)
    dpi = (F.lit(72) + F.col("image_id") % 300).cast("int")
    return img.select(
        "image_id", units.mm_to_px(F.col("width_px") / 10.0, dpi).alias("mm_px"),
        r6(units.px_to_mm(F.col("width_px"), dpi)).alias("px_mm"),
        units.mm_to_px(F.lit(-1.0), dpi).alias("zero_px"),
        r6(units.screen_ppi(F.col("height_px"))).alias("screen_ppi"))


def half_up_rounding(spark, d):
    v = (F.col("image_id") % 2001 - 1000) / 4.0
    return derive.images(spark, d).select("image_id", jr_int(v).alias("half_up"), js_round(-v).alias("half_up_neg"))


def page_boxes(spark, d):
    out = sizing.page_boxes(_detected(spark, d))
    return out.select("image_id", "preset_id", "trim_w", "trim_h", "content_x", "content_w", "content_h", "trim_x",
                      "page_w", "page_h", "orientation")


def press_page_boxes(spark, d):
    out = sizing.total_size(sizing.page_boxes(_detected(spark, d), always_marked=True))
    return out.select("image_id", "page_w", "page_h", "trim_x", "total_w_mm", "total_h_mm")


def crop_mark_segments(spark, d):
    out = sizing.crop_marks(sizing.page_boxes(_detected(spark, d)))
    return out.select("image_id", "kind", *[r6(F.col(c)).alias(c) for c in ("x1", "y1", "x2", "y2")])


def crop_offsets(spark, d):
    anchors = F.array(*[F.lit(v) for v in ("center", "top", "bottom", "left", "right")])
    df = derive.images(spark, d).select("image_id", F.get(anchors, (F.col("image_id") % 5).cast("int")).alias("anchor"))
    x, y = sizing.crop_offset(F.col("anchor"))
    return df.select("image_id", "anchor", x.alias("offset_x"), y.alias("offset_y"))


def product_fit(spark, d):
    out = sizing.fit_to_product(sizing.cross_products(derive.images(spark, d)))
    return out.select("image_id", "product_id", "price", "margin_px", "fit_by_width",
                      *[r6(F.col(c)).alias(c) for c in ("draw_x", "draw_y", "draw_w", "draw_h")])


def bleed_geometry(spark, d):
    out = bleed.bleed_geometry(_detected(spark, d))
    return out.select("image_id", "bleed_x", "bleed_y", "out_w", "out_h")


def preflight(spark, d):
    out = report.tac_compliance(derive.image_stats(spark, d))
    return out.select("image_id", "source", "profile_id", "tac_limit", "compliant", "tac_delta")


def preflight_request(spark, d):
    """Each measurement with the profile its request names; unknown names take the first server profile."""
    img = derive.image_stats(spark, d)
    names = [p[1] for p in dims.PROFILES if p[0] == "server"] + ["unlisted-profile"]
    img = img.withColumn("profile_id", F.get(F.array(*[F.lit(n) for n in names]), (F.col("image_id") % 5).cast("int")))
    out = lookup.lookup_with_default(img.withColumnRenamed("max_tac", "measured_tac"), "profile_id", "profiles",
                                     "japan-color-2001", ["profile_name", "max_tac"])
    return out.select("image_id", "profile_id", "profile_name", F.col("max_tac").alias("tac_limit"),
                      (F.col("measured_tac") <= F.col("max_tac")).alias("compliant"),
                      F.greatest(F.lit(0), F.col("measured_tac") - F.col("max_tac")).alias("tac_delta"))


def file_names(spark, d):
    img = derive.images(spark, d)
    return img.select("image_id", tx.strip_extension(F.col("name")).alias("stem"),
                      tx.safe_file_part(F.concat(F.col("category"), F.lit(" #"), F.col("name"))).alias("safe"))


_BASE = f"SELECT *, CAST(NULL AS DOUBLE) AS oog_ratio, max_tac>300 AS has_overflow FROM ({S.STATS})"
_DET = S.with_preset(S.detected(_BASE))
_DPI_SQL = S.dpi(_DET)
_BA = S.stats_before_after()
_DPI_LIST = ", ".join(DPI_COLS)


def _cross_sql() -> str:
    src = (f"SELECT i.*, p.preset_id, p.width_mm, p.height_mm, p.target_dpi FROM ({S.IMAGES}) i, {S.PRESETS} p")
    return f"SELECT {_DPI_LIST} FROM ({S.dpi(src)})"


def _rank_sql() -> str:
    dpi = S.jr("least(greatest(width_px,height_px)/greatest(width_mm,height_mm),"
               "least(width_px,height_px)/least(width_mm,height_mm))*25.4")
    return f"""SELECT image_id, preset_id, dpi, CAST(row_number() OVER (PARTITION BY image_id ORDER BY dpi DESC, ordinal) AS INTEGER)
 AS preset_rank FROM (SELECT image_id, preset_id, ordinal, {dpi} AS dpi FROM ({S.IMAGES}), {S.PRESETS} WHERE width_mm>0)"""


def _best_sql() -> str:
    dpi = S.jr("least(greatest(width_px,height_px)/greatest(width_mm,height_mm),"
               "least(width_px,height_px)/least(width_mm,height_mm))*25.4")
    ratio = ("((greatest(width_px,height_px)/CAST(least(width_px,height_px) AS DOUBLE))"
             "/(greatest(width_mm,height_mm)/least(width_mm,height_mm)))")
    return f"""SELECT image_id, preset_id AS best_preset, dpi AS best_dpi, gap/1e6 AS best_gap FROM (
 SELECT *, row_number() OVER (PARTITION BY image_id ORDER BY gap, dpi DESC, ordinal) AS rn FROM (
 SELECT image_id, preset_id, ordinal, {dpi} AS dpi, floor(greatest({ratio},1/{ratio})*1e6+0.5) AS gap
 FROM ({S.IMAGES}), {S.PRESETS} WHERE width_mm>0)) WHERE rn=1"""


def _codes_sql() -> str:
    src = S.score(_DPI_SQL)
    dig = "(preset_id='social' OR width_mm<=0 OR height_mm<=0)"
    oog, over = "coalesce(oog_ratio,0.0)", f"(has_overflow AND NOT {dig})"
    issue = [("screen_small", f"{dig} AND least(width_px,height_px)<720"),
             ("dpi_basic", f"NOT {dig} AND current_dpi BETWEEN 200 AND 279"),
             ("dpi_low", f"NOT {dig} AND current_dpi BETWEEN 140 AND 199"),
             ("dpi_critical", f"NOT {dig} AND current_dpi<140"),
             ("aspect_wide", f"NOT {dig} AND gap>1.8 AND ia>2"),
             ("aspect_tall", f"NOT {dig} AND gap>1.8 AND ia<0.5"),
             ("aspect_extreme", f"NOT {dig} AND gap>1.8 AND ia<=2 AND ia>=0.5"),
             ("aspect_crop", f"NOT {dig} AND gap<=1.8 AND opt>0.15"),
             ("very_dark", "avg_lum<0.04"), ("dark", "avg_lum>=0.04 AND avg_lum<0.16"),
             ("very_bright", "avg_lum>0.92"), ("out_of_gamut", f"{oog}>0.12"),
             ("over_saturated", f"{oog}<=0.12 AND {oog}>0.02 AND avg_sat>0.82"),
             ("flat_contrast", "std_lum<0.05"), ("soft_edges", "edge_score<0.03"),
             ("ink_heavy", f"{over} AND max_tac>340"), ("ink_trace", f"{over} AND max_tac<=340")]
    advice = [("upscale", f"NOT {dig} AND current_dpi<200"), ("auto_rotate", f"NOT {dig} AND df<dn AND dn>0.15"),
              ("use_landscape", f"NOT {dig} AND gap>1.8 AND ia>2"),
              ("use_postcard", f"NOT {dig} AND gap>1.8 AND ia<0.5"),
              ("align_subject", f"NOT {dig} AND gap<=1.8 AND opt>0.15"), ("coated_paper", "avg_lum<0.04"),
              ("shadow_lift", "avg_lum>=0.04 AND avg_lum<0.16"),
              ("soft_proof", f"{oog}>0.12 OR ({oog}>0.02 AND avg_sat>0.82)"),
              ("quality_ink", f"{oog}<=0.02 AND avg_sat>0.82"), ("sharpen", "edge_score<0.03"),
              ("limit_ink", f"{over} AND max_tac>340")]

    def codes(pairs):
        return "concat_ws(','," + ",".join(f"CASE WHEN {c} THEN '{n}' END" for n, c in pairs) + ")"

    return f"SELECT image_id, {codes(issue)} AS issues, {codes(advice)} AS recommendations FROM ({src})"


_PAGE = """SELECT *, CASE WHEN width_mm>0 THEN width_mm ELSE 210.0 END AS trim_w,
 CASE WHEN height_mm>0 THEN height_mm ELSE 297.0 END AS trim_h, {margin} AS om FROM ({src})"""


def _page_sql(margin: str) -> str:
    src = _PAGE.format(margin=margin, src=_DET)
    return f"""SELECT *, om AS content_x, trim_w+2*bleed_mm AS content_w, trim_h+2*bleed_mm AS content_h,
 bleed_mm+om AS trim_x, trim_w+2*(bleed_mm+om) AS page_w, trim_h+2*(bleed_mm+om) AS page_h,
 CASE WHEN trim_w>trim_h THEN 'landscape' ELSE 'portrait' END AS orientation FROM ({src})"""


_MARKED = "CASE WHEN crop_marks THEN 12.0 ELSE 0.0 END"


def _marks_sql() -> str:
    src = _page_sql(_MARKED)
    parts = []
    for v, y in (("top", "trim_x"), ("bottom", "(trim_x+trim_h)")):
        for side, x in (("left", "trim_x"), ("right", "(trim_x+trim_w)")):
            h = (f"{x}-7.5", f"{x}-1.5") if side == "left" else (f"{x}+1.5", f"{x}+7.5")
            t = (f"{y}-7.5", f"{y}-1.5") if v == "top" else (f"{y}+1.5", f"{y}+7.5")
            parts.append(f"SELECT image_id,'{v}-{side}-h' AS kind,{h[0]} AS x1,{y} AS y1,{h[1]} AS x2,{y} AS y2 FROM pg WHERE crop_marks")
            parts.append(f"SELECT image_id,'{v}-{side}-v',{x},{t[0]},{x},{t[1]} FROM pg WHERE crop_marks")
    cx, cy = "trim_x+trim_w/2", "trim_x+trim_h/2"
    for kind, x, y in (("top", cx, "om/2"), ("bottom", cx, "page_h-om/2"), ("left", "om/2", cy), ("right", "page_w-om/2", cy)):
        parts.append(f"SELECT image_id,'target-{kind}',{x}-3.5,{y},{x}+3.5,{y} FROM pg WHERE registration_marks")
    body = " UNION ALL ".join(parts)
    cols = ", ".join(f"{S.r6(c)} AS {c}" for c in ("x1", "y1", "x2", "y2"))
    return f"WITH pg AS ({src}) SELECT image_id, kind, {cols} FROM ({body})"


def _product_sql() -> str:
    prod = S.values([(p[0], p[4], p[5], p[6], p[7]) for p in dims.PRODUCTS], "product_id,pw,ph,price,margin_mm")
    a = f"SELECT *, {S.jr('margin_mm/25.4*300')} AS m FROM ({S.IMAGES}), {prod}"
    b = f"SELECT *, pw-2*m AS fw, ph-2*m AS fh, width_px/CAST(height_px AS DOUBLE) AS sa FROM ({a})"
    c = f"SELECT *, sa>fw/CAST(fh AS DOUBLE) AS wide FROM ({b})"
    e = f"SELECT *, CASE WHEN wide THEN fw ELSE fh*sa END AS dw, CASE WHEN wide THEN fw/sa ELSE fh END AS dh FROM ({c})"
    return f"""SELECT image_id, product_id, price, m AS margin_px, wide AS fit_by_width,
 {S.r6('m+(fw-dw)/2')} AS draw_x, {S.r6('m+(fh-dh)/2')} AS draw_y, {S.r6('dw')} AS draw_w, {S.r6('dh')} AS draw_h FROM ({e})"""


def _profile_sql() -> str:
    return S.values([(p[0], p[1], p[2], p[3]) for p in dims.PROFILES], "source,profile_id,profile_name,tac_limit")


_REPORT = """count(*) AS images, floor(sum(pre_score)/count(*)*10+0.5)/10 AS avg_pre,
 floor(sum(post_score)/count(*)*10+0.5)/10 AS avg_post, floor((sum(post_score)-sum(pre_score))/count(*)*10+0.5)/10 AS avg_delta,
 min(post_score) AS min_post, max(post_score) AS max_post, count(*) FILTER (WHERE regressed) AS regressions"""
_BUCKET = "CASE WHEN post_score<75 THEN 'below_75' WHEN post_score<88 THEN '75_to_87' ELSE '88_and_up' END"
_ANOM = f"""SELECT *, unnest([z for z in [CASE WHEN score_delta<0 THEN 'regression' END,
 CASE WHEN pre_score IS NULL OR post_score IS NULL THEN 'no_score' END,
 CASE WHEN applied_scale>4 THEN 'high_scale' END] if z IS NOT NULL]) AS anomaly FROM ({_BA})"""
_SCORED = S.stats_scored()
_TILES = ", ".join(f"s_{n}>={t} AS pass_{n}" for n, t in score.TILE_PASS.items())
_SERVER = [p[1] for p in dims.PROFILES if p[0] == "server"]

ENTRIES = {
    "admission_check": (admission_check, S.dbl(f"""SELECT image_id, mime, size_bytes, CASE WHEN NOT starts_with(mime,'image/')
 THEN 'not_image' WHEN size_bytes>104857600 THEN 'too_large' WHEN width_px<=0 OR height_px<=0 THEN 'undecodable' END AS reject_reason
 FROM ({S.IMAGES})""")),
    "preset_detection": (preset_detection, S.dbl(f"SELECT image_id, preset_id FROM ({S.detected(S.IMAGES)})")),
    "dpi_analysis": (dpi_analysis, S.dbl(f"SELECT {_DPI_LIST} FROM ({_DPI_SQL})")),
    "dpi_digital": (dpi_digital, S.dbl("SELECT " + _DPI_LIST + " FROM (" + S.dpi(S.with_preset(
        f"SELECT *, 'social' AS preset_id FROM ({S.IMAGES})")) + ")")),
    "preset_matrix": (preset_matrix, S.dbl(_cross_sql())),
    "best_preset": (best_preset, S.dbl(_best_sql())),
    "preset_ranking": (preset_ranking, S.dbl(_rank_sql())),
    "preset_lookup_default": (preset_lookup_default, S.dbl(
        "SELECT order_id, preset_id, width_mm, height_mm, target_dpi, bleed_mm FROM (" + S.with_preset(
            f"SELECT * REPLACE (CASE WHEN order_id%7=0 THEN 'photo-4x6' ELSE preset_id END AS preset_id) FROM ({S.PRINT_ORDERS})")
        + ")")),
    "readiness_score": (readiness_score, S.dbl(f"SELECT {', '.join(SCORE_COLS)} FROM ({_SCORED})")),
    "issue_codes": (issue_codes, S.dbl(_codes_sql())),
    "level_and_badges": (level_and_badges, S.dbl(f"""SELECT image_id, score, level,
 CASE WHEN score>=88 THEN 'success' WHEN score>=70 THEN 'warning' ELSE 'danger' END AS badge,
 CASE WHEN score>=85 THEN 'green' WHEN score>=65 THEN 'amber' ELSE 'red' END AS colour_band, {_TILES} FROM ({_SCORED})""")),
    "before_after_scores": (before_after_scores, S.dbl(f"SELECT {', '.join(BA_COLS)} FROM ({_BA})")),
    "run_report": (run_report, S.dbl(f"SELECT {_REPORT} FROM ({_BA})")),
    "category_report": (category_report, S.dbl(f"SELECT category, {_REPORT} FROM ({_BA}) GROUP BY category")),
    "score_distribution": (score_distribution, S.dbl(f"""SELECT bucket, images,
 floor(images*100.0/sum(images) OVER ()*10+0.5)/10 AS share_pct FROM (SELECT {_BUCKET} AS bucket, count(*) AS images
 FROM ({_BA}) GROUP BY 1)""")),
    "anomaly_rows": (anomaly_rows, S.dbl(f"SELECT image_id, anomaly, applied_scale, score_delta FROM ({_ANOM})")),
    "anomaly_counts": (anomaly_counts, S.dbl(
        f"SELECT category, anomaly, count(*) AS rows_found FROM ({_ANOM}) GROUP BY 1,2")),
    "worst_images": (worst_images, S.dbl(
        f"SELECT image_id, post_score FROM ({_BA}) WHERE post_score<88 ORDER BY post_score, image_id LIMIT 25")),
    "delta_labels": (delta_labels, S.dbl(f"""SELECT CASE WHEN score_delta>0 THEN '+'||score_delta WHEN score_delta=0 THEN '±0'
 ELSE CAST(score_delta AS VARCHAR) END AS label, count(*) AS images FROM ({_BA}) GROUP BY 1""")),
    "optimisation_actions": (optimisation_actions, S.dbl(f"""SELECT image_id, concat_ws(',', CASE WHEN scale_factor>1 THEN
 'upscale_x'||scale_factor END, 'sharpen', 'limit_ink', 'bleed_box') AS actions FROM ({_DPI_SQL})""")),
    "unit_conversion": (unit_conversion, S.dbl(f"""SELECT image_id, {S.jr('width_px/10.0/25.4*CAST(dpi AS DOUBLE)')} AS mm_px,
 {S.r6('width_px/CAST(dpi AS DOUBLE)*25.4')} AS px_mm, 0 AS zero_px, {S.r6('height_px/85.6*25.4')} AS screen_ppi
 FROM (SELECT *, CAST(72+image_id%300 AS INTEGER) AS dpi FROM ({S.IMAGES}))""")),
    "half_up_rounding": (half_up_rounding, S.dbl(f"""SELECT image_id, CAST(floor(v+0.5) AS INTEGER) AS half_up,
 CAST(floor(-v+0.5) AS BIGINT) AS half_up_neg FROM (SELECT image_id, (image_id%2001-1000)/4.0 AS v FROM ({S.IMAGES}))""")),
    "page_boxes": (page_boxes, S.dbl(f"""SELECT image_id, preset_id, trim_w, trim_h, content_x, content_w, content_h, trim_x,
 page_w, page_h, orientation FROM ({_page_sql(_MARKED)})""")),
    "press_page_boxes": (press_page_boxes, S.dbl(f"""SELECT image_id, page_w, page_h, trim_x, width_mm+2*bleed_mm AS total_w_mm,
 height_mm+2*bleed_mm AS total_h_mm FROM ({_page_sql('12.0')})""")),
    "crop_mark_segments": (crop_mark_segments, S.dbl(_marks_sql())),
    "crop_offsets": (crop_offsets, f"""SELECT image_id, anchor, CASE anchor WHEN 'left' THEN -25 WHEN 'right' THEN 25 ELSE 0 END
 AS offset_x, CASE anchor WHEN 'top' THEN -25 WHEN 'bottom' THEN 25 ELSE 0 END AS offset_y FROM (SELECT p_partkey AS image_id,
 ['center','top','bottom','left','right'][p_partkey%5+1] AS anchor FROM part)"""),
    "product_fit": (product_fit, S.dbl(_product_sql())),
    "bleed_geometry": (bleed_geometry, S.dbl(f"""SELECT image_id, bl AS bleed_x, bt AS bleed_y, width_px+2*bl AS out_w,
 height_px+2*bt AS out_h FROM (SELECT *, greatest(16,{S.jr('width_px/(CASE WHEN width_mm>0 THEN width_mm ELSE 210.0 END)*3.0')}) AS bl,
 greatest(16,{S.jr('height_px/(CASE WHEN height_mm>0 THEN height_mm ELSE 297.0 END)*3.0')}) AS bt FROM ({_DET}))""")),
    "preflight": (preflight, S.dbl(f"""SELECT image_id, source, profile_id, tac_limit, max_tac<=tac_limit AS compliant,
 greatest(0,max_tac-tac_limit) AS tac_delta FROM ({S.STATS}), {_profile_sql()}""")),
    "preflight_request": (preflight_request, S.dbl(f"""SELECT image_id, s.profile_id, profile_name, tac_limit,
 max_tac<=tac_limit AS compliant, greatest(0,max_tac-tac_limit) AS tac_delta FROM (SELECT *,
 {S.lst(_SERVER + ['unlisted-profile'])}[image_id%5+1] AS profile_id FROM ({S.STATS})) s JOIN {_profile_sql()} p
 ON p.profile_id=CASE WHEN s.profile_id='unlisted-profile' THEN 'japan-color-2001' ELSE s.profile_id END""")),
    "file_names": (file_names, f"""SELECT image_id, regexp_replace(name,'\\.[^/.]+$','') AS stem,
 regexp_replace(category||' #'||name,'[^A-Za-z0-9_一-龥-]','_','g') AS safe FROM ({S.IMAGES})"""),
}

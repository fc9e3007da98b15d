"""Preset detection, effective resolution, page boxes and fitting."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.rounding import jr_int, js_round
from ..functions.units import mm_to_px
from ..sources import dims
from ..functions.color import stage
from .fence import fenced

DPI_COLUMNS = ["current_dpi", "quality_tier", "scale_factor", "target_width_px", "target_height_px", "needs_upscale"]
MAX_SAFE_PX = 6000
DIGITAL_PX = 1080


def detect_best_preset(width: Column, height: Column) -> Column:
    """Preset id from the aspect ratio and size; first matching rule wins."""
    long_px, short_px = F.greatest(width, height), F.least(width, height)
    aspect = long_px.cast("double") / short_px
    return (F.when((width == 0) | (height == 0) | width.isNull() | height.isNull(), dims.DEFAULT_PRESET)
             .when(aspect.between(0.92, 1.08) & (long_px <= 1200), "sticker")
             .when(aspect.between(0.92, 1.08), "social")
             .when(aspect.between(1.58, 1.78) & (short_px <= 1400), "business-card")
             .when(aspect.between(1.44, 1.55), "postcard")
             .when(aspect.between(1.35, 1.44) & (long_px >= 3400), "poster-a3")
             .otherwise("poster-a4"))


DIGITAL_SQL = "(preset_id = 'social' OR width_mm <= 0 OR height_mm <= 0)"


def is_digital() -> Column:
    return F.expr(DIGITAL_SQL)


def analyze_dpi(df: DataFrame, max_px: int = MAX_SAFE_PX) -> DataFrame:
    """Adds current DPI, tier, scale factor, upscale flag and target pixels.

    Needs ``width_px, height_px`` and the preset columns ``preset_id, width_mm,
    height_mm, target_dpi``. Images of ``max_px`` and more on the long side are
    not enlarged, and no enlargement goes beyond it. An image without a size has
    no scale factor and needs no upscale. Map-side only.
    """
    fit = "least(_long / greatest(width_mm, height_mm), _short / least(width_mm, height_mm)) * 25.4D"
    tier = (f"CASE WHEN _dig THEN CASE WHEN _short >= {DIGITAL_PX} THEN 'excellent' ELSE 'warning' END "
            "WHEN current_dpi >= 280 THEN 'excellent' WHEN current_dpi >= 200 THEN 'good' "
            "WHEN current_dpi >= 140 THEN 'warning' ELSE 'critical' END")
    # at most eightfold, at least twofold, and the result must fit the pixel ceiling
    wanted = "least(8, greatest(2, int(ceil(target_dpi / greatest(1, current_dpi)))))"
    scale = (f"CASE WHEN NOT (coalesce(width_px, 0) > 0 AND coalesce(height_px, 0) > 0) THEN NULL WHEN _dig AND _short < {DIGITAL_PX} THEN int(ceil(try_divide({DIGITAL_PX}, _short))) "
             f"WHEN NOT _dig AND current_dpi < target_dpi AND _long < {max_px} THEN "
             f"greatest(1, least({wanted}, int(floor(try_divide({max_px}, _long))))) ELSE 1 END")

    def target(side: str) -> str:
        return f"CASE WHEN _dig THEN {DIGITAL_PX} ELSE int(floor({side} / 25.4D * target_dpi + 0.5D)) END"

    out = stage(df, _dig=DIGITAL_SQL, _long="greatest(width_px, height_px)", _short="least(width_px, height_px)",
                current_dpi=f"CASE WHEN _dig THEN 72 ELSE int(floor({fit} + 0.5D)) END", quality_tier=tier,
                scale_factor=scale, target_width_px=target("width_mm"), target_height_px=target("height_mm"),
                needs_upscale="coalesce(scale_factor, 1) > 1 AND (_dig OR current_dpi < target_dpi)")
    return fenced(out.drop("_dig", "_long", "_short"), DPI_COLUMNS)


def best_preset(df: DataFrame) -> DataFrame:
    """Closest physical preset per image: smallest aspect gap, then highest DPI.

    The five physical presets become five struct literals compared with
    ``least``, so ranking needs neither a row expansion nor a shuffle.
    """
    w, h = F.col("width_px"), F.col("height_px")
    long_px, short_px = F.greatest(w, h), F.least(w, h)

    def cell(p) -> Column:
        long_mm, short_mm = max(p[2], p[3]), min(p[2], p[3])
        ratio = (long_px / short_px) / F.lit(long_mm / short_mm)
        dpi = jr_int(F.least(long_px / long_mm, short_px / short_mm) * 25.4)
        return F.struct(js_round(F.greatest(ratio, 1 / ratio) * 1e6).alias("gap"), (-dpi).alias("neg_dpi"),
                        F.lit(p[-1]).alias("ordinal"), F.lit(p[0]).alias("preset_id"))

    best = F.least(*[cell(p) for p in dims.PRESETS if p[2] > 0])
    df = df.withColumn("_best", best)
    return df.withColumns({"best_preset": F.col("_best.preset_id"), "best_dpi": -F.col("_best.neg_dpi"),
                           "best_gap": F.col("_best.gap") / 1e6}).drop("_best")


def rank_presets(df: DataFrame) -> DataFrame:
    """All physical presets of each image with their rank, without a shuffle."""
    w, h = F.col("width_px"), F.col("height_px")
    long_px, short_px = F.greatest(w, h), F.least(w, h)
    cells = []
    for p in dims.PRESETS:
        if p[2] > 0:
            fit = F.least(long_px / max(p[2], p[3]), short_px / min(p[2], p[3])) * 25.4
            cells.append(F.struct((-jr_int(fit)).alias("neg_dpi"), F.lit(p[-1]).alias("ordinal"),
                                  F.lit(p[0]).alias("preset_id")))
    ranked = F.posexplode(F.array_sort(F.array(*cells))).alias("pos", "cell")
    return df.select("*", ranked).withColumns({
        "preset_id": F.col("cell.preset_id"), "dpi": -F.col("cell.neg_dpi"),
        "preset_rank": F.col("pos") + 1}).drop("pos", "cell")


def page_boxes(df: DataFrame, always_marked: bool = False) -> DataFrame:
    """Trim, bleed, content and page boxes in mm for rows carrying preset columns.

    ``always_marked`` keeps the 12-mm slug margin whatever the preset says
    (the press-exchange variant).
    """
    trim_w = F.when(F.col("width_mm") > 0, F.col("width_mm")).otherwise(F.lit(210.0))
    trim_h = F.when(F.col("height_mm") > 0, F.col("height_mm")).otherwise(F.lit(297.0))
    margin = F.lit(12.0) if always_marked else F.when(F.col("crop_marks"), F.lit(12.0)).otherwise(F.lit(0.0))
    df = df.withColumns({"trim_w": trim_w, "trim_h": trim_h, "outer_margin": margin})
    edge = F.col("bleed_mm") + F.col("outer_margin")
    return df.withColumns({
        "content_x": F.col("outer_margin"), "content_w": F.col("trim_w") + F.col("bleed_mm") * 2,
        "content_h": F.col("trim_h") + F.col("bleed_mm") * 2,
        "trim_x": edge, "page_w": F.col("trim_w") + edge * 2, "page_h": F.col("trim_h") + edge * 2,
        "orientation": F.when(F.col("trim_w") > F.col("trim_h"), "landscape").otherwise("portrait"),
    })


def total_size(df: DataFrame) -> DataFrame:
    return df.withColumns({"total_w_mm": F.col("width_mm") + F.col("bleed_mm") * 2,
                           "total_h_mm": F.col("height_mm") + F.col("bleed_mm") * 2})


def fit_to_product(df: DataFrame) -> DataFrame:
    """Contain-fit rectangle in 300-DPI pixels for rows with image and product columns."""
    margin = js_round(F.col("margin_mm") / 25.4 * 300).cast("int")
    df = df.withColumn("margin_px", margin)
    df = df.withColumns({"_pw": F.col("width_px300") - F.col("margin_px") * 2,
                         "_ph": F.col("height_px300") - F.col("margin_px") * 2,
                         "_src": F.col("width_px").cast("double") / F.col("height_px")})
    df = df.withColumn("fit_by_width", F.col("_src") > F.col("_pw") / F.col("_ph"))
    df = df.withColumns({
        "draw_w": F.when(F.col("fit_by_width"), F.col("_pw").cast("double")).otherwise(F.col("_ph") * F.col("_src")),
        "draw_h": F.when(F.col("fit_by_width"), F.col("_pw") / F.col("_src")).otherwise(F.col("_ph").cast("double")),
    })
    return df.withColumns({
        "draw_x": F.col("margin_px") + (F.col("_pw") - F.col("draw_w")) / 2,
        "draw_y": F.col("margin_px") + (F.col("_ph") - F.col("draw_h")) / 2,
    }).drop("_pw", "_ph", "_src")


def cross_products(df: DataFrame) -> DataFrame:
    cells = F.array(*[
        F.struct(F.lit(p[0]).alias("product_id"), F.lit(p[4]).alias("width_px300"), F.lit(p[5]).alias("height_px300"),
                 F.lit(p[6]).alias("price"), F.lit(p[7]).alias("margin_mm")) for p in dims.PRODUCTS])
    return df.select("*", F.inline(cells))


def crop_offset(anchor: Column) -> tuple[Column, Column]:
    """Horizontal and vertical offset in percent for a crop anchor."""
    x = F.when(anchor == "left", -25).when(anchor == "right", 25).otherwise(0)
    y = F.when(anchor == "top", -25).when(anchor == "bottom", 25).otherwise(0)
    return x, y


def crop_marks(df: DataFrame, mark_len: float = 6.0, gap: float = 1.5) -> DataFrame:
    """Eight corner segments per marked page and four registration targets.

    Needs :func:`page_boxes` columns; one row per segment.
    """
    left, top = F.col("trim_x"), F.col("trim_x")
    right, bottom = left + F.col("trim_w"), top + F.col("trim_h")

    def seg(kind: str, cond: Column, x1, y1, x2, y2) -> Column:
        return F.when(cond, F.struct(F.lit(kind).alias("kind"), x1.alias("x1"), y1.alias("y1"),
                                     x2.alias("x2"), y2.alias("y2")))

    segments = []
    for v, y in (("top", top), ("bottom", bottom)):
        for side, x in (("left", left), ("right", right)):
            near, far = (gap, gap + mark_len)
            hx1, hx2 = (x - far, x - near) if side == "left" else (x + near, x + far)
            vy1, vy2 = (y - far, y - near) if v == "top" else (y + near, y + far)
            segments.append(seg(f"{v}-{side}-h", F.col("crop_marks"), hx1, y, hx2, y))
            segments.append(seg(f"{v}-{side}-v", F.col("crop_marks"), x, vy1, x, vy2))
    cx, cy = left + F.col("trim_w") / 2, top + F.col("trim_h") / 2
    half = F.col("outer_margin") / 2
    for kind, x, y in (("target-top", cx, half), ("target-bottom", cx, F.col("page_h") - half),
                       ("target-left", half, cy), ("target-right", F.col("page_w") - half, cy)):
        segments.append(seg(kind, F.col("registration_marks"), x - 3.5, y, x + 3.5, y))
    return df.select("*", F.inline(F.array_compact(F.array(*segments))))

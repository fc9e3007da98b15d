"""Bleed margins: geometry and mirrored padding."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.rounding import jr_int


def bleed_px(side_px: Column, side_mm: Column, fallback_mm: float, margin_mm: float = 3.0) -> Column:
    mm = F.when(side_mm > 0, side_mm).otherwise(F.lit(fallback_mm))
    return F.greatest(F.lit(16), jr_int(side_px / mm * margin_mm))


def bleed_geometry(df: DataFrame, margin_mm: float = 3.0) -> DataFrame:
    """Bleed per side and the padded size for rows with image and preset columns."""
    df = df.withColumns({"bleed_x": bleed_px(F.col("width_px"), F.col("width_mm"), 210.0, margin_mm),
                         "bleed_y": bleed_px(F.col("height_px"), F.col("height_mm"), 297.0, margin_mm)})
    return df.withColumns({"out_w": F.col("width_px") + F.col("bleed_x") * 2,
                           "out_h": F.col("height_px") + F.col("bleed_y") * 2})


def bleed_pad(pixels: DataFrame, width_mm: float = 210.0, height_mm: float = 297.0, margin_mm: float = 3.0) -> DataFrame:
    """Pixels on the padded canvas: mirrored strips on four sides, copied corners.

    Each source pixel names its up to nine destinations, so the operator is one
    row expansion without a shuffle.
    """
    x, y, w, h = [F.col(c) for c in ("x", "y", "w", "h")]
    df = pixels.withColumns({"bleed_x": bleed_px(w, F.lit(width_mm), 210.0, margin_mm),
                             "bleed_y": bleed_px(h, F.lit(height_mm), 297.0, margin_mm)})
    bx, by = F.col("bleed_x"), F.col("bleed_y")
    left, right, top, bottom = x < bx, x >= w - bx, y < by, y >= h - by

    def spot(part: str, cond: Column | None, ox: Column, oy: Column) -> Column:
        s = F.struct(F.lit(part).alias("part"), ox.cast("int").alias("out_x"), oy.cast("int").alias("out_y"))
        return s if cond is None else F.when(cond, s)

    far_x, far_y = bx + w * 2 - 1 - x, by + h * 2 - 1 - y
    spots = F.array(
        spot("centre", None, x + bx, y + by),
        spot("top", top, x + bx, by - 1 - y), spot("bottom", bottom, x + bx, far_y),
        spot("left", left, bx - 1 - x, y + by), spot("right", right, far_x, y + by),
        spot("corner", left & top, x, y),
        spot("corner", right & top, x + bx * 2, y),
        spot("corner", left & bottom, x, y + by * 2),
        spot("corner", right & bottom, x + bx * 2, y + by * 2))
    # the places that do not apply leave as null rows: dropping them here stays in compiled code
    return df.select("image_id", (w + bx * 2).alias("out_w"), (h + by * 2).alias("out_h"), "r", "g", "b", "a",
                     F.inline(spots)).filter(F.col("part").isNotNull())

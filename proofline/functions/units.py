"""Physical units."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .rounding import js_round

MM_PER_INCH = 25.4
CARD_WIDTH_MM = 85.60


def mm_to_px(mm: Column, dpi: Column) -> Column:
    px = js_round(mm.cast("double") / F.lit(MM_PER_INCH) * dpi.cast("double")).cast("int")
    return F.when(mm > 0, px).otherwise(F.lit(0))


def px_to_mm(px: Column, dpi: Column) -> Column:
    mm = px.cast("double") / dpi.cast("double") * F.lit(MM_PER_INCH)
    return F.when(dpi > 0, mm).otherwise(F.lit(0.0))


def screen_ppi(card_width_px: Column) -> Column:
    """Screen density from the on-screen width of an ID-1 card."""
    return card_width_px.cast("double") / F.lit(CARD_WIDTH_MM) * F.lit(MM_PER_INCH)

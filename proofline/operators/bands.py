"""Text-line bands: contrast grid, row density, hysteresis and band boxes."""

from __future__ import annotations

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .stencil import combined, with_neighbour_rows

CONTRAST = 38.0
ENTER, LEAVE = 0.08, 0.04


def _luma(r: pa.Array, g: pa.Array, b: pa.Array) -> pa.Array:
    r, g, b = (pc.multiply(pc.cast(v, pa.float64()), w) for v, w in ((r, 0.299), (g, 0.587), (b, 0.114)))
    return pc.add(pc.add(r, g), b)


def contrast_grid(scanlines: DataFrame, step: int = 1) -> DataFrame:
    """Grid points ``(gx, gy)`` with their contrast flag; border rows carry a null ``gx``.

    Every pixel is a grid point unless the caller asks for a coarser ``step``,
    which may miss thin strokes.
    """
    lum = combined(scanlines, "l", "double", _luma)
    near = with_neighbour_rows(lum, ["l"]).withColumn("step", F.lit(step))
    near = near.withColumns({"grid_w": F.floor(F.col("w") / F.col("step")).cast("int"),
                             "grid_h": F.floor(F.col("h") / F.col("step")).cast("int"),
                             "gy": F.floor(F.col("y") / F.col("step")).cast("int")})
    rows = near.filter((F.col("y") % F.col("step") == 0) & (F.col("gy") < F.col("grid_h")))
    inner = (F.col("gy") >= 1) & (F.col("gy") < F.col("grid_h") - 1) & (F.col("grid_w") >= 3)
    pts = rows.withColumn("gx", F.explode_outer(F.when(inner, F.sequence(F.lit(1), F.col("grid_w") - 2))))
    px = F.col("gx") * F.col("step")
    here = F.get("l", px)
    grad = F.abs(here - F.get("l", px + 1)) + F.abs(here - F.get("l_dn1", px))
    return pts.select("image_id", "w", "h", "step", "grid_w", "grid_h", "gx", "gy",
                      F.coalesce(grad > CONTRAST, F.lit(False)).alias("contrast"))


def row_density(grid: DataFrame) -> DataFrame:
    """Contrast share, extent and count per grid row (every grid row is kept)."""
    px = F.when(F.col("contrast"), F.col("gx") * F.col("step"))
    out = grid.groupBy("image_id", "w", "h", "step", "grid_w", "grid_h", "gy").agg(
        F.count_if("contrast").alias("hits"), F.min(px).alias("min_x"), F.max(px).alias("max_x"))
    return out.withColumn("density", F.col("hits") / F.col("grid_w"))


def hysteresis(df: DataFrame, value: str, group: str, order: str, enter: float = ENTER, leave: float = LEAVE) -> DataFrame:
    """Adds ``in_band``: on above ``enter``, off at or below ``leave``, else unchanged."""
    w = Window.partitionBy(group).orderBy(order)
    mark = F.when(F.col(value) > enter, 1).when(F.col(value) <= leave, 0)
    state = F.coalesce(F.last(mark, ignorenulls=True).over(w.rowsBetween(Window.unboundedPreceding, 0)), F.lit(0))
    return df.withColumn("in_band", state)


def density_bands(density: DataFrame) -> DataFrame:
    """Candidate bands per image with the box of their contrast points.

    A group is the grid rows of one image, bounded by its height over the step.
    """
    w = Window.partitionBy("image_id").orderBy("gy")
    df = hysteresis(density, "density", "image_id", "gy")
    df = df.withColumn("_prev", F.coalesce(F.lag("in_band").over(w), F.lit(0)))
    starts = ((F.col("in_band") == 1) & (F.col("_prev") == 0)).cast("int")
    df = df.withColumn("band_id", F.sum(starts).over(w))
    rows = df.filter((F.col("in_band") == 1) | (F.col("_prev") == 1))
    on = F.when(F.col("in_band") == 1, F.col("gy"))
    agg = rows.groupBy("image_id", "w", "h", "step", "grid_h", "band_id").agg(
        F.min(on).alias("start"), F.max(on).alias("_last"), F.min("min_x").alias("min_x"),
        F.max("max_x").alias("max_x"), F.sum("hits").alias("contrast_points"))
    tail = F.col("_last") == F.col("grid_h") - 1
    agg = agg.withColumn("end", F.when(tail, F.col("_last")).otherwise(F.col("_last") + 1))
    length = F.col("end") - F.col("start")
    keep = F.when(tail, F.col("grid_h") - F.col("start") >= 2).otherwise(
        (length >= 2) & (length <= F.col("grid_h") * 0.4))
    return agg.filter(keep).drop("_last")


def text_bands(scanlines: DataFrame, max_bands: int | None = None, step: int = 1) -> DataFrame:
    """Boxes of the text-like bands of every image; only the first ``max_bands`` where the caller asks for that."""
    bands = density_bands(row_density(contrast_grid(scanlines, step)))
    w = Window.partitionBy("image_id").orderBy("start")
    first = bands.withColumn("band_no", F.row_number().over(w))
    if max_bands is not None:
        first = first.filter(F.col("band_no") <= max_bands)
    span = F.col("max_x") - F.col("min_x")
    boxed = first.filter((span > 0) & (span > F.col("w") * 0.08))
    step = F.col("step")
    y1 = F.col("start") * step
    boxed = boxed.withColumns({
        "box_x": F.greatest(F.lit(0), F.col("min_x") - step * 2), "box_y": y1,
        "box_w": F.least(F.col("w") - F.col("min_x"), span + step * 4),
        "box_h": F.least(F.col("h"), F.col("end") * step + step * 2) - y1})
    cells = (F.col("box_w") / step) * (F.col("box_h") / step)
    return boxed.select("image_id", "band_no", "box_x", "box_y", "box_w", "box_h", "contrast_points",
                        (F.col("contrast_points") / cells).alias("edge_score"))

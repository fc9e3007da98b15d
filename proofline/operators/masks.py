"""Binary masks as run-length rows: runs, dilation, erosion, contour."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import distance
from .stencil import explode_x, with_neighbour_rows

#: Discs beyond this radius go by distances, whose work does not grow with the radius.
WIDE = 16


def mask_rows(scanlines: DataFrame, above: int = 20) -> DataFrame:
    return scanlines.select("image_id", "w", "h", "y", F.transform("a", lambda v: v > above).alias("mask"))


def _row_runs(rows: DataFrame, value: bool) -> DataFrame:
    """Maximal horizontal runs of ``value``; each row is handled where it lies."""

    def runs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            batch = batch.filter(pc.and_(batch.column("w").is_valid(), batch.column("mask").is_valid()))
            lists, width = batch.column("mask"), batch.column("w").to_numpy().astype(np.int64)
            sizes = lists.value_lengths().to_numpy().astype(np.int64)
            line = np.repeat(np.arange(len(sizes)), sizes)
            x = np.arange(len(line)) - np.repeat(np.cumsum(sizes) - sizes, sizes)
            on = lists.flatten().fill_null(not value).to_numpy(zero_copy_only=False) == value
            on &= x < width[line]
            before = np.concatenate(([False], on[:-1])) & (x > 0)
            after = np.concatenate((on[1:], [False])) & (x < sizes[line] - 1)
            first, last = np.flatnonzero(on & ~before), np.flatnonzero(on & ~after)
            keys = batch.select(["image_id", "w", "h", "y"]).take(pa.array(line[first]))
            yield pa.RecordBatch.from_arrays([*keys.columns, pa.array(x[first].astype(np.int32)), pa.array(x[last].astype(np.int32))],
                                             names=["image_id", "w", "h", "y", "x0", "x1"])

    kinds = ", ".join(f"{c} {rows.schema[c].dataType.simpleString()}" for c in ("image_id", "w", "h", "y"))
    return rows.select("image_id", "w", "h", "y", "mask").mapInArrow(runs, f"{kinds}, x0 int, x1 int")


def mask_runs(rows: DataFrame) -> DataFrame:
    return _row_runs(rows, True)


def merge_intervals(runs: DataFrame) -> DataFrame:
    """Overlapping or touching intervals of one image row joined together."""
    w = Window.partitionBy("image_id", "y").orderBy("x0", "x1")
    before = F.max("x1").over(w.rowsBetween(Window.unboundedPreceding, -1))
    df = runs.withColumn("_new", F.when(F.col("x0") <= before + 1, 0).otherwise(1))
    df = df.withColumn("_isle", F.sum("_new").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    return df.groupBy("image_id", "y", "_isle").agg(
        F.first("w").alias("w"), F.first("h").alias("h"), F.min("x0").alias("x0"),
        F.max("x1").alias("x1")).drop("_isle")


def _spread(runs: DataFrame, radius: int) -> DataFrame:
    """Every run widened to the disc on each row within the radius, clipped to the image."""
    dy = F.explode(F.sequence(F.greatest(F.lit(-radius), -F.col("y")),
                              F.least(F.lit(radius), F.col("h") - 1 - F.col("y"))))
    wide = runs.withColumn("_dy", dy)
    half = F.floor(F.sqrt(F.lit(radius * radius) - F.col("_dy") * F.col("_dy"))).cast("int")
    return wide.select("image_id", "w", "h", (F.col("y") + F.col("_dy")).alias("y"),
                       F.greatest(F.lit(0), F.col("x0") - half).alias("x0"),
                       F.least(F.col("w") - 1, F.col("x1") + half).alias("x1"))


def dilate(rows: DataFrame, radius: int = 24) -> DataFrame:
    """Disc dilation, as merged runs. Work is proportional to runs times radius, up to ``WIDE``."""
    if radius > WIDE:
        return distance.dilate(rows, radius)
    runs = mask_runs(rows)
    return merge_intervals(runs if radius <= 0 else _spread(runs, radius))


def erode(rows: DataFrame, radius: int = 3) -> DataFrame:
    """Disc erosion, as runs; nothing within ``radius`` of the border survives.

    The blocked part of a row is the dilated background plus both border strips;
    the surviving runs are the gaps between the merged blocked intervals.
    """
    if radius <= 0:
        return mask_runs(rows)
    if radius > WIDE:
        return distance.erode(rows, radius)
    inner = rows.filter((F.col("y") >= radius) & (F.col("y") < F.col("h") - radius))
    border = inner.select("image_id", "w", "h", "y", F.inline(F.array(
        F.struct(F.lit(0).alias("x0"), F.lit(radius - 1).alias("x1")),
        F.struct((F.col("w") - radius).alias("x0"), (F.col("w") - 1).alias("x1")))))
    blocked = _spread(_row_runs(rows, False), radius)
    blocked = blocked.filter((F.col("y") >= radius) & (F.col("y") < F.col("h") - radius))
    merged = merge_intervals(border.unionByName(blocked))
    w = Window.partitionBy("image_id", "y").orderBy("x0")
    gaps = merged.withColumn("_next", F.lead("x0").over(w))
    return gaps.filter(F.col("_next").isNotNull()).select(
        "image_id", "y", "w", "h", (F.col("x1") + 1).alias("x0"), (F.col("_next") - 1).alias("x1"))


def run_area(runs: DataFrame) -> DataFrame:
    return runs.groupBy("image_id").agg(
        F.sum((F.col("x1") - F.col("x0") + 1).cast("bigint")).alias("area"), F.count("*").alias("runs"))


def contour_pixels(rows: DataFrame) -> DataFrame:
    """Interior mask pixels with a cleared 4-neighbour."""
    near = with_neighbour_rows(rows, ["mask"])
    near = near.filter((F.col("y") >= 1) & (F.col("y") < F.col("h") - 1))
    pts = explode_x(near, F.lit(1), F.col("w") - 2, F.lit(1))
    x = F.col("x")
    edge = ~(F.get("mask_up1", x) & F.get("mask_dn1", x) & F.get("mask", x - 1) & F.get("mask", x + 1))
    return pts.filter(F.get("mask", x) & edge).select("image_id", "x", "y")


def runs_to_mask(runs: DataFrame, rows: DataFrame) -> DataFrame:
    """Run-length rows back to mask rows; ``rows`` names every row of every image."""
    spans = runs.groupBy("image_id", "y").agg(F.collect_list(F.struct("x0", "x1")).alias("_spans"))
    # the planner cannot foresee how many lines an image has: without the hint it broadcasts the spans of all of them
    joined = rows.select("image_id", "w", "h", "y").join(spans.hint("merge"), ["image_id", "y"], "left").select(
        "image_id", "w", "h", "y", F.col("_spans.x0").alias("_x0"), F.col("_spans.x1").alias("_x1"))

    def filled(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            none = batch.column("w").is_null()
            width = batch.column("w").fill_null(0).to_numpy().astype(np.int64)
            at = np.cumsum(width) - width
            lists = [batch.column(c) for c in ("_x0", "_x1")]
            sizes = lists[0].value_lengths().fill_null(0).to_numpy()
            line = np.repeat(np.arange(len(sizes)), sizes)
            x0, x1 = (v.flatten().to_numpy().astype(np.int64) for v in lists)
            x0, x1 = np.maximum(x0, 0), np.minimum(x1 + 1, width[line])
            use = x0 < x1
            step = np.bincount((at[line] + x0)[use], minlength=width.sum() + 1) - np.bincount((at[line] + x1)[use], minlength=width.sum() + 1)
            mask = pa.array(np.cumsum(step)[:-1] > 0)
            offsets = pa.array(np.append(at, width.sum()).astype(np.int32))
            yield pa.RecordBatch.from_arrays([*batch.columns[:4], pa.ListArray.from_arrays(offsets, mask, mask=none)],
                                             names=["image_id", "w", "h", "y", "mask"])

    kinds = ", ".join(f"{c} {rows.schema[c].dataType.simpleString()}" for c in ("image_id", "w", "h", "y"))
    return joined.mapInArrow(filled, f"{kinds}, mask array<boolean>")

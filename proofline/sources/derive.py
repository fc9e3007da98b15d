"""Inputs derived from the given tables.

The tables hold no image files, so images, pixels, scanlines, print orders and
queue events are computed from their rows with integer formulas. Every row of
the source table takes part.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import schemas

from ..session import task_parallelism
from . import dims

STYLES = ["gradient", "texture", "lettering", "zebra", "shadow", "vivid", "highlight", "blueprint"]
MIMES = ["image/png", "image/jpeg", "image/webp", "text/plain", "image/gif"]
ROWS_PER_BAND = 32


def _pick(values: list, index: Column) -> Column:
    return F.get(F.array(*[F.lit(v) for v in values]), index.cast("int"))


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def images(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Image metadata, one row per part."""
    k, s = F.col("p_partkey"), F.col("p_size").cast("bigint")
    return read(spark, sf_dir, "part").select(
        k.alias("image_id"),
        F.concat(F.regexp_replace("p_name", " ", "_"), F.lit("_"), k.cast("string"), F.lit(".png")).alias("name"),
        F.col("p_type").alias("category"),
        _pick(MIMES, k % 5).alias("mime"),
        ((k * 7919) % 160000000).alias("size_bytes"),
        (200 + (k * 37) % 4800).cast("int").alias("width_px"),
        (200 + (k * 53 + s * 97) % 4800).cast("int").alias("height_px"),
        F.floor(k / 32).alias("batch_id"),
        (k % 32).cast("int").alias("seq"))


def image_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Images with ready-made statistics (the labelled-corpus shape)."""
    k = F.col("image_id")
    return images(spark, sf_dir).withColumns({
        "avg_lum": ((k * 31) % 1000) / 1000.0,
        "avg_sat": ((k * 17) % 1000) / 1000.0,
        "std_lum": ((k * 13) % 400) / 1000.0,
        "edge_score": ((k * 7) % 100) / 1000.0,
        "max_tac": (200 + (k * 11) % 201).cast("int"),
    })


def thumbnails(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Small raster per part: ``image_id, w, h, style`` plus the shape seeds."""
    return read(spark, sf_dir, "part").selectExpr(
        "p_partkey AS image_id", "int(24 + p_size % 24) AS w", "int(24 + p_partkey % 17) AS h",
        f"int(p_partkey % {len(STYLES)}) AS style", "int(p_partkey % 1000) AS k", "int(p_size) AS s")


# Ground colour and overlay colour of the flat styles.
GROUND = {2: (240, 236, 228), 4: (8, 6, 10), 5: (224, 0, 200), 6: (244, 240, 238), 7: (14, 48, 115)}
OVERLAY = {2: (20, 24, 30), 7: (40, 95, 185)}


# Per channel: slope, offset and modulus by style, over the columns of an image line.
SLOPE = {"r": {0: "wstep", 1: "11", 3: "1", 4: "1", 5: "3", 6: "1"}, "g": {1: "5", 3: "1", 6: "1"},
         "b": {1: "y", 3: "1", 4: "1", 5: "1"}}
OFFSET = {"r": {1: "y * 7 + k * 13", 4: "k", 6: "y"},
          "g": {0: "y * (65280 div h)", 1: "y * 17 + s * 29", 4: "y", 5: "y * 5", 6: "k"},
          "b": {0: "(k * 37) % 256 * 256", 1: "k * 3", 4: "y", 5: "y", 6: "y + s"}}
MODULUS = {"r": {0: "256", 1: "256", 3: "2", 4: "17", 5: "32", 6: "8"},
           "g": {0: "256", 1: "256", 3: "2", 4: "13", 5: "40", 6: "9"},
           "b": {0: "256", 1: "256", 3: "2", 4: "19", 5: "56", 6: "11"}}


def _line_parameters() -> list[str]:
    """Per image line: every channel is ``base + amp * (((off + slope * x) >> sh) % mod)``.

    Whatever depends on the style or on the line is settled here, before the
    rows spread out, which leaves a short formula for each pixel.
    """
    def by_style(forms: dict, default: str = "0") -> str:
        cases = " ".join(f"WHEN {i} THEN {f}" for i, f in forms.items())
        return f"int(CASE style {cases} ELSE {default} END)"

    out = []
    for i, ch in enumerate("rgb"):
        out += [f"{by_style(SLOPE[ch])} AS slope_{ch}", f"{by_style(OFFSET[ch])} AS off_{ch}",
                f"{by_style(MODULUS[ch], '1')} AS mod_{ch}",
                f"{by_style({st: c[i] for st, c in GROUND.items()})} AS base_{ch}",
                f"{by_style({st: c[i] for st, c in OVERLAY.items()})} AS over_{ch}"]
    # hit 1: lettering line, 2: ground line of the grid, 3: full grid line
    hit = by_style({2: "IF((y div 5) % 3 = 1, 1, 0)", 7: "IF(y % 9 = 0, 3, 2)"})
    return [*out, f"{by_style({0: 8, 3: 1})} AS sh", f"{by_style({3: 255}, '1')} AS amp", f"{hit} AS hit",
            f"{by_style({1: 1, 5: 1, 6: 2})} AS alpha_kind",
            "int(least(w, h) * least(w, h) - (2 * y - h) * (2 * y - h)) AS radius2", "wstep AS fade"]


def pixel_channels(x: str = "x") -> dict[str, str]:
    """Channel formulas at column ``x`` over the line parameters."""
    letter = f"{x} * 6 >= w AND {x} * 6 <= w * 5 AND shiftright({x} * 7 + k, 1) % 3 = 0"
    marked = f"(hit = 1 AND {letter}) OR (hit = 2 AND {x} % 9 = 0) OR hit = 3"
    out = {ch: f"IF({marked}, over_{ch}, base_{ch} + amp * (shiftright(off_{ch} + slope_{ch} * {x}, sh) % mod_{ch}))"
           for ch in "rgb"}
    out["a"] = (f"CASE alpha_kind WHEN 0 THEN 255 WHEN 1 THEN IF((2 * {x} - w) * (2 * {x} - w) <= radius2, 255, 0) "
                f"ELSE shiftright({x} * fade, 8) END")
    return out


def raster_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row per image line, spread by (image, band) so no image sits in one task.

    Only a short row per band is shuffled; lines and their parameters are made behind it.
    """
    bands = thumbnails(spark, sf_dir).selectExpr("*", f"explode(sequence(0, int((h - 1) div {ROWS_PER_BAND}))) AS band")
    bands = bands.repartition(task_parallelism(spark), F.col("image_id"), F.col("band"))
    rows = bands.selectExpr("*", "int(65280 div w) AS wstep", f"explode(sequence(band * {ROWS_PER_BAND}, "
                            f"least(h, band * {ROWS_PER_BAND} + {ROWS_PER_BAND}) - 1)) AS y")
    return rows.selectExpr("image_id", "w", "h", "y", "k", *_line_parameters())


def pixels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``pixels(image_id, w, h, x, y, r, g, b, a)`` of every thumbnail."""
    p = raster_rows(spark, sf_dir).selectExpr("*", "explode(sequence(0, w - 1)) AS x")
    return p.selectExpr("image_id", "w", "h", "x", "y", *[f"{e} AS {n}" for n, e in pixel_channels().items()])


def _line_pixels(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The formulas of :func:`pixel_channels` for all lines of a batch at once; lines without a width have null lists."""
    for batch in batches:
        # 32 bits, as in the formulas of the pixels
        n = {c: batch.column(c).fill_null(0).to_numpy().astype(np.int32) for c in batch.schema.names[1:]}
        known = batch.column("w").is_valid().to_numpy(zero_copy_only=False)
        width = np.where(known, n["w"], 0)
        ends = np.cumsum(width, dtype=np.int32)
        x = np.arange(width.sum(), dtype=np.int32) - np.repeat(ends - width, width)
        line = {c: np.repeat(v, width) for c, v in n.items() if c not in ("h", "y")}
        w, hit = line["w"], line["hit"]
        letter = (x * 6 >= w) & (x * 6 <= w * 5) & (np.fmod((x * 7 + line["k"]) >> 1, 3) == 0)
        marked = ((hit == 1) & letter) | ((hit == 2) & (x % 9 == 0)) | (hit == 3)
        out = [np.where(marked, line[f"over_{c}"], line[f"base_{c}"] + line["amp"] * np.fmod(
            (line[f"off_{c}"] + line[f"slope_{c}"] * x) >> line["sh"], line[f"mod_{c}"])) for c in "rgb"]
        kind = line["alpha_kind"]
        disc = np.where((2 * x - w) ** 2 <= line["radius2"], 255, 0)
        out.append(np.where(kind == 0, 255, np.where(kind == 1, disc, (x * line["fade"]) >> 8)))
        offsets = pa.array(np.concatenate(([0], ends)).astype(np.int32))
        lists = [pa.ListArray.from_arrays(offsets, pa.array(v.astype(np.int32, copy=False)), mask=pa.array(~known)) for v in out]
        yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in ("image_id", "w", "h", "y")), *lists],
                                         names=["image_id", "w", "h", "y", *"rgba"])


def scanlines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``scanlines(image_id, w, h, y, r[], g[], b[], a[])``, built without a shuffle of pixels."""
    return raster_rows(spark, sf_dir).mapInArrow(_line_pixels, schemas.SCANLINES)


def print_orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders with a preset, a paper and a quantity in dimension-row order."""
    k, c = F.col("o_orderkey"), F.col("o_custkey")
    return read(spark, sf_dir, "orders").select(
        k.alias("order_id"), c.alias("customer_id"),
        _pick([p[0] for p in dims.PRESETS], k % len(dims.PRESETS)).alias("preset_id"),
        _pick([p[0] for p in dims.PAPERS], k % len(dims.PAPERS)).alias("paper_id"),
        _pick(dims.QTY_TIERS, c % len(dims.QTY_TIERS)).alias("qty"))


def users_geo(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("c_custkey")
    return read(spark, sf_dir, "customer").select(
        k.alias("user_id"),
        (22 + ((k * 7919) % 3300) / 1000.0).alias("lat"),
        (120 + ((k * 104729) % 1900) / 1000.0).alias("lng"))


def queue_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Status changes of the processing queue, from the event stream."""
    return queue_event_columns(read(spark, sf_dir, "events"))


def queue_event_columns(events: DataFrame) -> DataFrame:
    et = F.col("event_type")
    status = (F.when(et == "view", "processing").when(et == "purchase", "done")
               .when(et == "error", "error").otherwise("idle"))
    return events.select(
        (F.col("user_id") * 8 + F.col("event_id") % 8).alias("image_id"),
        status.alias("status"), F.col("ts"), F.col("event_id"), F.col("value"))


def quota_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Metered uses per user and month, with a unit cost and a variable cost."""
    return quota_event_columns(read(spark, sf_dir, "events"))


def quota_event_columns(events: DataFrame) -> DataFrame:
    plan = _pick([p[0] for p in dims.PLANS], F.col("user_id") % len(dims.PLANS))
    return (events.filter(F.col("event_type") == "purchase")
            .select("event_id", "ts", "user_id", plan.alias("plan_id"),
                    F.date_format("ts", "yyyy-MM").alias("month"),
                    (1 + F.col("event_id") % 5).cast("int").alias("cost")))

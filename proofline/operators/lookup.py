"""Lookup against a fixed dimension, unknown keys falling back to a default row."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..sources import dims


def lookup_with_default(df: DataFrame, key: str, name: str, default: str, keep: list[str]) -> DataFrame:
    """Broadcast join to a fixed dimension; unknown or null keys take the ``default`` row.

    The key is resolved against the known ids first (an IN list of at most a few
    dozen literals), which turns the outer lookup into an inner hash join and
    keeps nulls inside the dimension as nulls.
    """
    dim = dims.table(df.sparkSession, name)
    dim_key = dim.columns[dims.key_position(name)]
    known = F.col(key).isin(dims.keys(name))
    resolved = df.withColumn("_key", F.when(known, F.col(key)).otherwise(F.lit(default)))
    side = F.broadcast(dim.select(F.col(dim_key).alias("_dim_key"), *keep))
    return resolved.join(side, F.col("_key") == F.col("_dim_key"), "inner").drop("_key", "_dim_key")


def with_preset(df: DataFrame, key: str = "preset_id") -> DataFrame:
    """Adds the preset geometry for a preset id column."""
    keep = ["width_mm", "height_mm", "target_dpi", "bleed_mm", "crop_marks", "color_bars",
            "registration_marks", "preset_name"]
    return lookup_with_default(df, key, "presets", dims.DEFAULT_PRESET, keep)


def cross_presets(df: DataFrame) -> DataFrame:
    """Every row with each of the six presets, as a map-side row expansion."""
    cells = F.array(*[
        F.struct(F.lit(p[0]).alias("preset_id"), F.lit(p[2]).alias("width_mm"), F.lit(p[3]).alias("height_mm"),
                 F.lit(p[4]).alias("target_dpi"), F.lit(p[-1]).alias("preset_ordinal"))
        for p in dims.PRESETS])
    return df.select("*", F.inline(cells))

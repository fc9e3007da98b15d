"""Streaming sources and the continuous pre-flight; quotas are in ``quota``, the queue is in ``queue_table``."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..operators import report, sizing
from ..operators.lookup import with_preset


def source(spark: SparkSession, path: str, schema: str, files_per_trigger: int | None = None) -> DataFrame:
    reader = spark.readStream.schema(schema)
    if files_per_trigger:
        reader = reader.option("maxFilesPerTrigger", files_per_trigger)
    return reader.parquet(path)


def preflight(images: DataFrame) -> DataFrame:
    """Stateless: preset, DPI and profile compliance of arriving image metadata."""
    preset = sizing.detect_best_preset(F.col("width_px"), F.col("height_px"))
    return report.tac_compliance(sizing.analyze_dpi(with_preset(images.withColumn("preset_id", preset))))


def write_parquet(df: DataFrame, out: str, checkpoint: str) -> StreamingQuery:
    return (df.writeStream.format("parquet").option("path", out).option("checkpointLocation", checkpoint)
            .trigger(availableNow=True).start())

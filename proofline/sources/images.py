"""Image files, raw rasters and the sample manifest as DataFrames; result sinks."""

from __future__ import annotations

from collections.abc import Iterator
from contextlib import contextmanager

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import schemas
from ..session import task_parallelism


def read_images(spark: SparkSession, path: str) -> DataFrame:
    """Decoded image files: id from the path, size, channels and BGR(A) bytes.

    Undecodable files are dropped by the source; :func:`image_reports` lists them with the reason.
    """
    img = spark.read.format("image").option("dropInvalid", True).load(path).select("image.*")
    return img.select(F.xxhash64("origin").alias("image_id"), F.col("origin").alias("name"),
                      F.col("width").alias("w"), F.col("height").alias("h"), F.col("nChannels").alias("channels"), "data")


# Mime types by file extension.
MIME_BY_EXTENSION = {"png": "image/png", "jpg": "image/jpeg", "jpeg": "image/jpeg", "webp": "image/webp",
                     "gif": "image/gif", "bmp": "image/bmp"}


def read_files(spark: SparkSession, path: str) -> DataFrame:
    """Path, size and mime of every file; contents are pruned from the scan."""
    ext = F.lower(F.regexp_extract("path", r"\.([^./]+)$", 1))
    mime = F.lit("application/octet-stream")
    for e, m in MIME_BY_EXTENSION.items():
        mime = F.when(ext == e, F.lit(m)).otherwise(mime)
    files = spark.read.format("binaryFile").load(path)
    return files.select(F.xxhash64("path").alias("image_id"), F.col("path").alias("name"), mime.alias("mime"),
                        F.col("length").alias("size_bytes"))


# Leading bytes of the file formats the decoder knows.
MAGIC = {"png": "89504E470D0A1A0A", "jpeg": "FFD8FF", "gif": "47494638", "bmp": "424D"}


LISTING_TASKS = "spark.sql.sources.parallelPartitionDiscovery.parallelism"


@contextmanager
def _folders_listed_together(spark: SparkSession) -> Iterator[None]:
    """Lists folders in a few tasks per core; Spark would take a task for each of the first ten thousand."""
    before = spark.conf.get(LISTING_TASKS, "10000")
    spark.conf.set(LISTING_TASKS, str(min(int(before), 4 * task_parallelism(spark))))
    try:
        yield
    finally:
        spark.conf.set(LISTING_TASKS, before)


def image_reports(spark: SparkSession, path: str) -> DataFrame:
    """One row per file: image_id, name, size_bytes, format by its leading bytes, w, h, channels and ``error_message``.

    A file that gives no image stays, with null size and the reason: of no known format, or damaged. Pixels are decoded
    to prove the file, but not carried along. Spark's sources do not list files of no bytes.
    """
    with _folders_listed_together(spark):
        files = spark.read.format("binaryFile").load(path)
        img = spark.read.format("image").option("dropInvalid", False).load(path)
    head = F.hex(F.expr("substring(content, 1, 8)"))
    kind = F.lit(None).cast("string")
    for name, magic in MAGIC.items():
        kind = F.when(F.startswith(head, F.lit(magic)), name).otherwise(kind)
    # the two sources write the same address with one slash or three
    place = lambda c: F.regexp_replace(c, "^([A-Za-z0-9+.-]+):/+", "$1:/")
    files = files.select(place("path").alias("_at"), F.col("path"), F.col("length").alias("size_bytes"), kind.alias("format"))
    img = img.select("image.origin", "image.width", "image.height", "image.nChannels")
    img = img.select(place("origin").alias("_at"), "origin", *[F.when(F.col("width") > 0, F.col(c)).alias(n) for c, n in (
        ("width", "w"), ("height", "h"), ("nChannels", "channels"))])
    error = (F.when(F.col("w").isNotNull(), F.lit(None)).when(F.col("format").isNull(), "unknown format")
             .otherwise(F.concat(F.lit("damaged "), "format", F.lit(" data"))))
    name = F.coalesce("origin", "path")
    return files.join(img.hint("merge"), "_at", "left").select(F.xxhash64(name).alias("image_id"), name.alias("name"), "size_bytes", "format", "w", "h", "channels",
                                                 error.cast("string").alias("error_message"))


ROWS_PER_CHUNK = 256


def raster_to_scanlines(images: DataFrame) -> DataFrame:
    """Image bytes to scanlines, map-side, a few hundred lines at a time.

    Accepts 1 (grey), 3 (BGR) or 4 (BGRA) channels per pixel.
    """
    def decode(batches):
        for pdf in batches:
            for row in pdf.itertuples(index=False):
                px = np.frombuffer(row.data, dtype=np.uint8).reshape(row.h, row.w, row.channels).astype(np.int32)
                b, g, r = (px[..., min(i, row.channels - 1)] for i in range(3))
                a = px[..., 3] if row.channels == 4 else np.full((row.h, row.w), 255, dtype=np.int32)
                for y0 in range(0, row.h, ROWS_PER_CHUNK):
                    ys = np.arange(y0, min(row.h, y0 + ROWS_PER_CHUNK))
                    yield pd.DataFrame({"image_id": row.image_id, "w": row.w, "h": row.h, "y": ys,
                                        "r": list(r[ys]), "g": list(g[ys]), "b": list(b[ys]), "a": list(a[ys])})

    return images.select("image_id", "w", "h", "channels", "data").mapInPandas(decode, schemas.SCANLINES)


def pack_lines(scanlines: DataFrame) -> DataFrame:
    """Each scanline as a one-line BGRA raster (binary), ready for a compact table; a pixel without a channel is left out."""
    def encode(batches):
        for batch in batches:
            none = batch.column("w").is_null().to_numpy(zero_copy_only=False)
            lists = [batch.column(c) for c in "bgra"]
            sizes = np.where(none, 0, lists[0].value_lengths().fill_null(0).to_numpy())
            width = batch.column("w").fill_null(0).to_numpy()
            line = np.repeat(np.arange(len(sizes)), sizes)
            x = np.arange(len(line)) - np.repeat(np.cumsum(sizes) - sizes, sizes)
            flat = [v.filter(pa.array(~none)).flatten() for v in lists]
            use = (x < width[line]) & np.logical_and.reduce([v.is_valid().to_numpy(zero_copy_only=False) for v in flat])
            cells = np.stack([v.fill_null(0).to_numpy()[use] for v in flat], axis=-1).astype(np.uint8)
            ends = 4 * np.cumsum(np.bincount(line[use], minlength=len(sizes)))
            data, at = cells.tobytes(), 0
            out = []
            for end, gone in zip(ends.tolist(), none.tolist()):
                out.append(None if gone else data[at:end])
                at = end
            yield pa.RecordBatch.from_arrays([*batch.columns[:4], pa.array(out, pa.binary())], names=["image_id", "w", "h", "y", "data"])

    kinds = ", ".join(f"{c} {scanlines.schema[c].dataType.simpleString()}" for c in ("image_id", "w", "h", "y"))
    return scanlines.select("image_id", "w", "h", "y", "r", "g", "b", "a").mapInArrow(encode, f"{kinds}, data binary")


def unpack_lines(lines: DataFrame) -> DataFrame:
    """Inverse of :func:`pack_lines` for whole batches of lines."""
    def decode(batches):
        for pdf in batches:
            px = [np.frombuffer(v, dtype=np.uint8).reshape(-1, 4).astype(np.int32) for v in pdf["data"]]
            yield pd.DataFrame({**{c: pdf[c] for c in ("image_id", "w", "h", "y")},
                                **{c: [p[:, i] for p in px] for c, i in (("r", 2), ("g", 1), ("b", 0), ("a", 3))}})

    return lines.mapInPandas(decode, schemas.SCANLINES)


def read_manifest(spark: SparkSession, path: str, lines: bool = False) -> DataFrame:
    """A manifest as one JSON array per file, or with ``lines`` as one object per line."""
    return spark.read.schema(schemas.MANIFEST).json(path, multiLine=not lines)


def write_result(df: DataFrame, path: str, fmt: str = "parquet", partition_by: list[str] | None = None,
                 mode: str = "error") -> None:
    """Reports as parquet or JSON tables, tickets as text."""
    writer = df.write.mode(mode).format(fmt)
    if partition_by:
        writer = writer.partitionBy(*partition_by)
    writer.save(path)

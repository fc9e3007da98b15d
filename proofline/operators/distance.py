"""Dilation and erosion of masks by discs of any radius, from exact distances: the work does not depend on the radius.

A pixel lies within the disc of a mask pixel if, for some column x' of its row, the squared distance to the column plus
the squared distance within that column to the nearest mask pixel is at most the squared radius. So

1. the mask is written once, a bit a pixel, a row of the table for each image line;
2. every (image, band of lines) is reduced to the first and last line set in each column, per batch and without a shuffle;
3. a scan over these few lines per band, in groups of (image, ``STRIP`` columns), tells each band the nearest set line above
   and below it;
4. bands meet these carries, know the distance within every column, widen each pixel of a line by what the disc has left,
   and return the union as runs.

A group holds ``BAND`` lines of an image, or one number per band and column of a strip, whatever the height.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import stage
from .stencil import BAND

STRIP = 1024
_NONE = np.int64(1) << 40  # farther than any line
_BITS = "image_id bigint, w int, h int, y int, bits binary"
_ENDS = "image_id bigint, strip int, band int, low binary, high binary"
_RUNS = "image_id bigint, y int, w int, h int, x0 int, x1 int"


def _bits(rows: DataFrame, value: bool) -> DataFrame:
    """Where the mask equals ``value``, eight pixels a byte; a null pixel equals neither."""
    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            width = batch.column(1).to_numpy()
            lists = batch.column(4)
            flat = lists.flatten().fill_null(not value).to_numpy(zero_copy_only=False) == value
            ends = np.cumsum(lists.value_lengths().fill_null(0).to_numpy())
            bits = []
            for n, end, had in zip(width, ends, np.diff(ends, prepend=0)):
                line = np.zeros(n, bool)
                line[:had] = flat[end - had:end][:n]
                bits.append(np.packbits(line).tobytes())
            yield pa.RecordBatch.from_arrays([*batch.columns[:4], pa.array(bits, pa.binary())], names=["image_id", "w", "h", "y", "bits"])

    return rows.select(F.col("image_id").cast("bigint"), F.col("w").cast("int"), F.col("h").cast("int"), F.col("y").cast("int"), "mask").mapInArrow(pack, _BITS)


def _grid(bits: list[bytes], width: int) -> np.ndarray:
    return np.unpackbits(np.frombuffer(b"".join(bits), np.uint8).reshape(len(bits), -1), axis=1, count=width).astype(bool)


def _ends(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """First and last line set per column of the lines of a band that a batch has."""
    for batch in batches:
        image, width, y = (batch.column(i).to_numpy() for i in (0, 1, 3))
        bits = batch.column(4).to_pylist()
        order = np.lexsort((y, image))
        key = np.stack((image[order], y[order] // BAND))
        starts = np.flatnonzero(np.concatenate(([True], (key[:, 1:] != key[:, :-1]).any(axis=0)))) if len(order) else []
        out: list[tuple] = []
        for lo, hi in zip(starts, np.append(starts[1:], len(order))):
            at = order[lo:hi]
            w, ys = int(width[at[0]]), y[at].astype(np.int64)[:, None]
            on = _grid([bits[i] for i in at], w)
            low, high = np.where(on, ys, _NONE).min(axis=0), np.where(on, ys, -_NONE).max(axis=0)
            out += [(int(image[at[0]]), s // STRIP, int(ys[0, 0] // BAND), low[s:s + STRIP].tobytes(), high[s:s + STRIP].tobytes())
                    for s in range(0, w, STRIP)]
        types = (pa.int64(), pa.int32(), pa.int32(), pa.binary(), pa.binary())
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out) if out else [()] * 5, types)],
                                         names=["image_id", "strip", "band", "low", "high"])


def _carry(group: pa.Table) -> pa.Table:
    """Per band, the nearest line set in each column below it (``low``) and above it (``high``)."""
    band = group["band"].to_numpy()
    bands, where = np.unique(band, return_inverse=True)
    low, high = (np.frombuffer(b"".join(group[c].to_pylist()), np.int64).reshape(len(band), -1) for c in ("low", "high"))
    first, last = np.full((len(bands) + 1, low.shape[1]), _NONE), np.full((len(bands) + 1, low.shape[1]), -_NONE)
    np.minimum.at(first, where, low)  # the row more at the end of ``first`` and, shifted, at the start of ``last`` is none
    np.maximum.at(last, where + 1, high)
    below = np.minimum.accumulate(first[::-1], axis=0)[::-1][1:]
    above = np.maximum.accumulate(last, axis=0)[:-1]
    n = len(bands)
    return pa.table({"image_id": pa.array([group["image_id"][0].as_py()] * n, pa.int64()), "strip": pa.array([group["strip"][0].as_py()] * n, pa.int32()),
                     "band": pa.array(bands, pa.int32()), "low": pa.array([x.tobytes() for x in below], pa.binary()),
                     "high": pa.array([x.tobytes() for x in above], pa.binary())})


def _within(lines: pa.Table, carry: pa.Table, radius: int, blocked: bool) -> pa.Table:
    """Runs of the pixels of a band within ``radius``; with ``blocked`` of all others away from the border."""
    lines, carry = lines.sort_by("y"), carry.sort_by("strip")
    empty = pa.table({n: pa.array([], t) for n, t in zip(("image_id", "y", "w", "h", "x0", "x1"), (pa.int64(), *[pa.int32()] * 5))})
    if not lines.num_rows:
        return empty
    w, h = lines["w"][0].as_py(), lines["h"][0].as_py()
    if w <= 0:
        return empty
    y = lines["y"].to_numpy().astype(np.int64)[:, None]
    on = _grid(lines["bits"].to_pylist(), w)
    below, above = (np.frombuffer(b"".join(carry[c].to_pylist()), np.int64)[None, :] for c in ("low", "high"))
    up = np.maximum.accumulate(np.concatenate((above, np.where(on, y, -_NONE))), axis=0)[1:]
    down = np.minimum.accumulate(np.concatenate((np.where(on, y, _NONE), below))[::-1], axis=0)[::-1][:-1]
    gap = np.minimum(y - up, down - y)
    row, x = np.nonzero(gap <= radius)
    half = np.sqrt(radius * radius - gap[row, x] ** 2).astype(np.int64)
    step = np.zeros((len(y), w + 1), np.int32)
    np.add.at(step, (row, np.maximum(0, x - half)), 1)
    np.add.at(step, (row, np.minimum(w - 1, x + half) + 1), -1)
    hit = np.cumsum(step[:, :w], axis=1) > 0
    if blocked:
        hit = ~hit & (np.arange(w) >= radius) & (np.arange(w) < w - radius) & (y >= radius) & (y < h - radius)
    rim = np.zeros((len(y), 1), bool)
    change = np.diff(np.concatenate((rim, hit, rim), axis=1).astype(np.int8), axis=1)
    (row, x0), (_, x1) = np.nonzero(change == 1), np.nonzero(change == -1)
    n = len(row)
    return pa.table({"image_id": pa.array([lines["image_id"][0].as_py()] * n, pa.int64()), "y": pa.array(y[row, 0], pa.int32()),
                     "w": pa.array([w] * n, pa.int32()), "h": pa.array([h] * n, pa.int32()),
                     "x0": pa.array(x0, pa.int32()), "x1": pa.array(x1 - 1, pa.int32())})


def _near(rows: DataFrame, value: bool, radius: int, blocked: bool) -> DataFrame:
    bits = stage(_bits(rows, value), "mask-bits")
    carry = bits.filter("w > 0").mapInArrow(_ends, _ENDS).groupBy("image_id", "strip").applyInArrow(_carry, _ENDS)
    lines = bits.withColumn("band", F.floor(F.col("y") / BAND).cast("int")).groupBy("image_id", "band")
    return lines.cogroup(carry.groupBy("image_id", "band")).applyInArrow(lambda a, b: _within(a, b, radius, blocked), _RUNS)


def dilate(rows: DataFrame, radius: int) -> DataFrame:
    """Disc dilation as runs (image_id, y, w, h, x0, x1), the rows of :func:`.masks.dilate`.

    ``rows`` holds every line of an image once. An empty mask has no runs, an image without width none either; a null
    pixel is not set.
    """
    return _near(rows, True, radius, False)


def erode(rows: DataFrame, radius: int) -> DataFrame:
    """Disc erosion as runs, the rows of :func:`.masks.erode`: nothing within ``radius`` of the border survives."""
    return _near(rows, False, radius, True)

"""Scanlines and neighbourhood access.

A scanline holds one image row as channel arrays. Neighbouring rows meet inside
(image, band) groups of ``BAND`` rows; rows at a band's rim are also sent to the
adjacent band. A group is therefore bounded by ``BAND + 2 * radius`` rows
whatever the height of the image, and one hot image spreads over many tasks.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

BAND = 64
CHANNELS = ("r", "g", "b", "a")


LINE = ("image_id", "w", "h", "y")


def _starts(table: pa.Table | pa.RecordBatch) -> np.ndarray:
    """Positions where a row has another line key than the row before."""
    new = np.zeros(table.num_rows, bool)
    new[:1] = True
    for c in LINE:
        v = table.column(c)
        v = v.combine_chunks() if isinstance(v, pa.ChunkedArray) else v
        for part in (v.fill_null(0), v.is_null()):
            values = part.to_numpy(zero_copy_only=False)
            new[1:] |= values[1:] != values[:-1]
    return np.flatnonzero(new)


def _pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Neighbouring pixels of a line as one row."""
    for batch in batches:
        if batch.num_rows:
            starts = _starts(batch)
            offsets = pa.array(np.append(starts, batch.num_rows).astype(np.int32))
            keys = batch.select(list(LINE)).take(pa.array(starts))
            cells = [pa.ListArray.from_arrays(offsets, batch.column(c)) for c in ("x", *CHANNELS)]
            yield pa.RecordBatch.from_arrays([*keys.columns, *cells], names=[*LINE, "xs", *CHANNELS])


def _whole_lines(rows: pa.Table) -> pa.RecordBatch:
    """Sorted pieces put together, pixels in order of place and colour, nulls first."""
    starts = _starts(rows)
    lists = {c: rows.column(c).combine_chunks() for c in ("xs", *CHANNELS)}
    sizes = lists["xs"].value_lengths().to_numpy()
    width = np.add.reduceat(sizes, starts)
    line = np.repeat(np.arange(len(starts)), width)
    flat = {c: v.flatten() for c, v in lists.items()}
    x = flat["xs"].fill_null(0).to_numpy()
    if flat["xs"].null_count or (np.diff(x)[np.diff(line) == 0] <= 0).any():
        least = np.iinfo(np.int64).min
        values = {c: np.where(v.is_null().to_numpy(zero_copy_only=False), least, v.fill_null(0).to_numpy().astype(np.int64)) for c, v in flat.items()}
        order = pa.array(np.lexsort((*(values[c] for c in reversed(CHANNELS)), values["xs"], line)))
        flat = {c: v.take(order) for c, v in flat.items()}
    offsets = pa.array(np.concatenate(([0], np.cumsum(width))).astype(np.int32))
    keys = [rows.column(c).combine_chunks().take(pa.array(starts)) for c in LINE]
    return pa.RecordBatch.from_arrays([*keys, *(pa.ListArray.from_arrays(offsets, flat[c]) for c in CHANNELS)], names=[*LINE, *CHANNELS])


def _merged(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    held: list[pa.RecordBatch] = []
    for batch in batches:
        if not batch.num_rows:
            continue
        held.append(batch)
        last = int(_starts(batch)[-1])
        if last == 0 and len(held) == 1:
            continue
        rows = pa.Table.from_batches(held)
        last = int(_starts(rows)[-1])  # the last line may go on in the next batch
        if last:
            yield _whole_lines(rows.slice(0, last).combine_chunks())
            held = rows.slice(last).combine_chunks().to_batches()
    if held:
        yield _whole_lines(pa.Table.from_batches(held))


def to_scanlines(pixels: DataFrame) -> DataFrame:
    """Pixels gathered to lines, in order of ``x``.

    Pixels that lie side by side travel as one row, so what is shuffled and sorted is a few rows per line.
    """
    kinds = {f.name: f.dataType.simpleString() for f in pixels.schema}
    keys = ", ".join(f"{c} {kinds[c]}" for c in LINE)
    lists = ", ".join(f"{c} array<{kinds[c]}>" for c in CHANNELS)
    return gathered(pixels.select(*LINE, "x", *CHANNELS).mapInArrow(_pieces, f"{keys}, xs array<{kinds['x']}>, {lists}"))


def gathered(pieces: DataFrame) -> DataFrame:
    """Pieces of lines, with the places ``xs`` of their pixels, put together to lines."""
    schema = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in pieces.schema if f.name != "xs")
    return pieces.repartition(*LINE).sortWithinPartitions(*LINE).mapInArrow(_merged, schema)


def to_pixels(scanlines: DataFrame) -> DataFrame:
    """One row per pixel; positions are generated and looked up in compiled code."""
    out = scanlines.selectExpr("*", "explode(sequence(0, w - 1)) AS x")
    return out.selectExpr("image_id", "w", "h", "x", "y", *[f"get({c}, x) AS {c}" for c in CHANNELS])


def with_neighbour_rows(scanlines: DataFrame, columns: list[str], radius: int = 1, band: int = BAND) -> DataFrame:
    """Adds ``<col>_up<i>`` and ``<col>_dn<i>`` for ``i`` in 1..radius (null beyond the image)."""
    y = F.col("y")
    home = F.floor(y / band)
    bands = F.array_distinct(F.array(F.floor((y - radius) / band), home, F.floor((y + radius) / band)))
    keyed = scanlines.withColumn("_band", F.explode(bands))
    w = Window.partitionBy("image_id", "_band").orderBy("y")
    near = {}
    for c in columns:
        for i in range(1, radius + 1):
            near[f"{c}_up{i}"] = F.lag(c, i).over(w)
            near[f"{c}_dn{i}"] = F.lead(c, i).over(w)
    return keyed.withColumns(near).filter(F.col("_band") == F.floor(F.col("y") / band)).drop("_band")


def explode_x(df: DataFrame, start: Column, stop: Column, step: Column) -> DataFrame:
    """One row per sampled column of a scanline; none where the range is empty."""
    xs = F.when(stop >= start, F.sequence(start, stop, step))
    return df.withColumn("x", F.explode(xs))


def combined(scanlines: DataFrame, name: str, kind: str, rule: Callable[[pa.Array, pa.Array, pa.Array], pa.Array]) -> DataFrame:
    """``image_id, w, h, y`` and the list ``name``: ``rule`` of the three colour lists, a batch of lines at a time."""

    def lines(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            r, g, b = (batch.column(c) for c in "rgb")
            none = pc.or_(pc.or_(r.is_null(), g.is_null()), b.is_null())
            sizes = pc.if_else(none, 0, pc.fill_null(r.value_lengths(), 0))
            offsets = pa.array(np.concatenate(([0], np.cumsum(sizes.to_numpy(zero_copy_only=False)))).astype(np.int32))
            values = rule(*(pc.filter(v, pc.invert(none)).flatten() for v in (r, g, b)))
            yield pa.RecordBatch.from_arrays([*batch.columns[:4], pa.ListArray.from_arrays(offsets, values, mask=none)],
                                             names=["image_id", "w", "h", "y", name])

    kinds = ", ".join(f"{c} {scanlines.schema[c].dataType.simpleString()}" for c in LINE)
    return scanlines.select(*LINE, *"rgb").mapInArrow(lines, f"{kinds}, {name} array<{kind}>")


def _brightness(scanlines: DataFrame) -> DataFrame:
    """Adds ``l``, the channel sum 0..765 per pixel."""
    return combined(scanlines, "l", "int", lambda r, g, b: pc.cast(pc.add(pc.add(r, g), b), pa.int32()))


def _interior(scanlines: DataFrame, step: int) -> DataFrame:
    near = with_neighbour_rows(_brightness(scanlines), ["l"])
    return near.filter((F.col("y") >= 1) & (F.col("y") < F.col("h") - 1) & ((F.col("y") - 1) % step == 0))


def sobel(scanlines: DataFrame, step: int = 1) -> DataFrame:
    """Gradient magnitude at the interior points of every image, or at every ``step``-th of them."""
    pts = explode_x(_interior(scanlines, step), F.lit(1), F.col("w") - 2, F.lit(step))

    def at(col: str, dx: int) -> Column:
        return F.get(F.col(col), F.col("x") + dx)

    names = {}
    for row, col in (("0", "l_up1"), ("1", "l"), ("2", "l_dn1")):
        for j, dx in enumerate((-1, 0, 1)):
            if not (row == "1" and dx == 0):
                names[f"p{row}{j}"] = at(col, dx)
    pts = pts.select("image_id", "x", "y", *[c.alias(n) for n, c in names.items()])
    p = {n: F.col(n) for n in names}
    gx = p["p02"] + p["p12"] * 2 + p["p22"] - p["p00"] - p["p10"] * 2 - p["p20"]
    gy = p["p20"] + p["p21"] * 2 + p["p22"] - p["p00"] - p["p01"] * 2 - p["p02"]
    gd = p["p10"] + p["p12"] + p["p21"] - p["p01"] - p["p02"] * 2 - p["p20"] * 2
    pts = pts.select("image_id", "x", "y", gx.alias("gx"), gy.alias("gy"), gd.alias("gd"))
    # the squared sum stays an integer (doubled to absorb the half weight)
    twice = 2 * F.col("gx") * F.col("gx") + 2 * F.col("gy") * F.col("gy") + F.col("gd") * F.col("gd")
    return pts.select("image_id", "x", "y", (F.sqrt(twice / 2.0) * (0.5 * 0.0013071895)).alias("magnitude"))


def gradient(up: np.ndarray, here: np.ndarray, down: np.ndarray) -> np.ndarray:
    """Gradient magnitude at the inner columns (last axis) of lines, from the channel sums of three lines."""
    n, c, s = up, here, down
    gx = n[..., 2:] + c[..., 2:] * 2 + s[..., 2:] - n[..., :-2] - c[..., :-2] * 2 - s[..., :-2]
    gy = s[..., :-2] + s[..., 1:-1] * 2 + s[..., 2:] - n[..., :-2] - n[..., 1:-1] * 2 - n[..., 2:]
    gd = c[..., :-2] + c[..., 2:] + s[..., 1:-1] - n[..., 1:-1] - n[..., 2:] * 2 - s[..., :-2] * 2
    return np.sqrt((2 * gx * gx + 2 * gy * gy + gd * gd) / 2.0) * (0.5 * 0.0013071895)


def edge_score(scanlines: DataFrame, step: int = 1) -> DataFrame:
    """Mean gradient per image, with no row for images below three pixels a side.

    The same numbers as the mean of :func:`sobel`, added up a line at a time on
    Arrow buffers, so no row per pixel is made.
    """

    def lines(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            wide = pc.greater_equal(batch.column("w"), 3)
            part = batch.filter(wide)
            if not part.num_rows:
                continue
            up, here, down = (part.column(c) for c in ("l_up1", "l", "l_dn1"))
            ends = np.cumsum(np.diff(here.offsets.to_numpy()))
            starts = np.concatenate(([0], ends[:-1]))
            n, c, s = (x.flatten().to_numpy().astype(np.int64) for x in (up, here, down))
            magnitude = gradient(n, c, s)
            nano = np.floor(magnitude * 1e9 + 0.5).astype(np.int64)
            # position p of the arrays is column p + 1; the columns of a line that count are 1, 1 + step, ...
            line = np.repeat(np.arange(len(starts)), ends - starts)[1:-1]
            column = np.arange(1, len(c) - 1) - starts[line]
            use = (column >= 1) & (column < (ends - starts)[line] - 1) & ((column - 1) % step == 0)
            sums = np.zeros(len(starts), np.int64)
            np.add.at(sums, line[use], nano[use])
            yield pa.RecordBatch.from_arrays(
                [part.column("image_id"), pa.array(sums), pa.array(np.bincount(line[use], minlength=len(starts)).astype(np.int64))],
                names=["image_id", "total", "points"])

    rows = _interior(scanlines, step).select("image_id", "w", "l_up1", "l", "l_dn1")
    out = rows.mapInArrow(lines, "image_id bigint, total bigint, points bigint").groupBy("image_id").agg(
        F.sum("total").alias("total"), F.sum("points").alias("edge_points"))
    return out.select("image_id", (F.col("total").cast("double") / F.lit(1e9) / F.col("edge_points")).alias("edge_score"), "edge_points")

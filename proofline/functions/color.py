"""Colour expressions.

Three ink models exist on purpose: the sum model behind TAC, the
white-point-adapted model with grey replacement behind the gamut test, and the
plain density model behind plate coverage.

Deep formulas are written as *stages* (``DataFrame -> DataFrame``): every stage
names its intermediate values once, so the optimizer sees a short tree per
projection instead of one exponentially repeated tree.
"""

from __future__ import annotations

import struct
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StructField, StructType

from .rounding import js_round


def _float32(v: float) -> float:
    return struct.unpack("f", struct.pack("f", v))[0]


def srgb_table() -> list[float]:
    """Linear value of each 8-bit sRGB code, kept in single precision."""
    out = []
    for code in range(256):
        v = code / 255
        out.append(_float32(v / 12.92 if v <= 0.04045 else ((v + 0.055) / 1.055) ** 2.4))
    return out


@lru_cache(maxsize=1)
def srgb_table_sql() -> str:
    """The table as one constant array expression."""
    return "array(" + ",".join(f"{v!r}D" for v in srgb_table()) + ")"


def srgb_to_linear(c: Column) -> Column:
    """Constant-table lookup; ``c`` is an integer code in 0..255."""
    return F.get(F.expr(srgb_table_sql()), c.cast("int"))


def linear_to_srgb(v: Column) -> Column:
    """Linear light to an 8-bit code."""
    g = F.when(v <= 0.0031308, v * 12.92).otherwise(F.pow(F.greatest(v, F.lit(0.0)), F.lit(1 / 2.4)) * 1.055 - 0.055)
    return F.least(F.lit(255), F.greatest(F.lit(0), js_round(g * 255))).cast("int")


def tac(r: Column, g: Column, b: Column) -> Column:
    """Total area coverage in percent: C+M+Y plus the smallest of the three."""
    c, m, y = [F.lit(1.0) - ch.cast("double") / 255 for ch in (r, g, b)]
    return (c + m + y + F.least(c, m, y)) * 100


def ink_units(r: Column, g: Column, b: Column) -> Column:
    """TAC in exact integer steps of 100/255 percent (0..1020)."""
    c, m, y = [F.lit(255) - ch for ch in (r, g, b)]
    return c + m + y + F.least(c, m, y)


def luma601(r: Column, g: Column, b: Column) -> Column:
    return r * 0.299 + g * 0.587 + b * 0.114


def luma709(r: Column, g: Column, b: Column) -> Column:
    return r * 0.2126 + g * 0.7152 + b * 0.0722


def lightness_mid(r: Column, g: Column, b: Column) -> Column:
    return (F.greatest(r, g, b) + F.least(r, g, b)) / 2.0


def luma_mean(r: Column, g: Column, b: Column) -> Column:
    return (r + g + b) / 3.0


def saturation(r: Column, g: Column, b: Column) -> Column:
    mx = F.greatest(r, g, b)
    return F.when(mx > 0, (mx - F.least(r, g, b)).cast("double") / mx).otherwise(F.lit(0.0))


def quantise_hex(r: Column, g: Column, b: Column, step: int = 32) -> Column:
    """Colour snapped to a ``step`` grid, as ``#rrggbb``."""
    def q(ch: Column) -> Column:
        return F.least(F.lit(255), js_round(ch.cast("double") / step) * step)

    code = q(r) * 65536 + q(g) * 256 + q(b)
    return F.concat(F.lit("#"), F.lower(F.lpad(F.hex(code), 6, "0")))


def colour_distance(r: Column, g: Column, b: Column, br: Column, bg: Column, bb: Column) -> Column:
    dr, dg, db = r - br, g - bg, b - bb
    return F.sqrt(dr * dr + dg * dg + db * db)


def feathered_alpha(dist: Column, tolerance: float) -> Column:
    """0 inside the tolerance, a linear ramp up to 1.8 tolerances, then 255."""
    ramp = js_round((dist - tolerance) / (tolerance * 0.8) * 255)
    return (F.when(dist < tolerance, F.lit(0).cast("bigint"))
             .when(dist < tolerance * 1.8, ramp)
             .otherwise(F.lit(255).cast("bigint"))).cast("int")


# sRGB primaries to XYZ under D65, its inverse, the D65 to D50
# adaptation, and D50 XYZ back to linear RGB.
RGB_TO_XYZ = ((0.4124564, 0.3575761, 0.1804375),
              (0.2126729, 0.7151522, 0.0721750),
              (0.0193339, 0.1191920, 0.9503041))
XYZ_TO_RGB = ((3.2404542, -1.5371385, -0.4985314),
              (-0.9692660, 1.8760108, 0.0415560),
              (0.0556434, -0.2040259, 1.0572252))
D65_TO_D50 = ((1.0478112, 0.0228866, -0.0501270),
              (0.0295424, 0.9904844, -0.0170491),
              (-0.0092345, 0.0150436, 0.7521316))
D50_TO_RGB = ((3.1338561, -1.6168667, -0.4906146),
              (-0.9787684, 1.9161415, 0.0334540),
              (0.0719453, -0.2289914, 1.4052427))
WHITE_D65 = (0.95047, 1.0, 1.08883)


def dot_sql(row, cols) -> str:
    return "(" + " + ".join(f"{c} * {v!r}D" for c, v in zip(cols, row)) + ")"


def stage(df: DataFrame, **exprs: str) -> DataFrame:
    """Adds the named SQL expressions; later ones may use earlier ones by name.

    The chain is one ``selectExpr`` with lateral column aliases, so a long
    formula is analysed once.
    """
    return df.selectExpr("*", *[f"{e} AS {n}" for n, e in exprs.items()])


def unit_sql(e: str) -> str:
    return f"least(1D, greatest(0D, {e}))"


def code_sql(v: str) -> str:
    """8-bit sRGB code of a linear value, as SQL."""
    g = f"CASE WHEN {v} <= 0.0031308D THEN {v} * 12.92D ELSE power(greatest({v}, 0D), {1 / 2.4!r}D) * 1.055D - 0.055D END"
    return f"int(least(255, greatest(0, floor(({g}) * 255 + 0.5D))))"


def xyz_exprs(r: str, g: str, b: str) -> dict[str, str]:
    """Linear light and XYZ of an 8-bit colour."""
    table = srgb_table_sql()
    out = {n: f"get({table}, {c})" for n, c in (("_lr", r), ("_lg", g), ("_lb", b))}
    out |= {n: dot_sql(row, ("_lr", "_lg", "_lb")) for n, row in zip(("_X", "_Y", "_Z"), RGB_TO_XYZ)}
    return out


INKS = ("c", "m", "y_ink", "k")


def _inks(codes: list[np.ndarray], gcr: float) -> list[np.ndarray]:
    """``c, m, y_ink, k`` of whole columns in the order of the formula; a code without a linear value counts as 0."""
    def dot(row, cols):
        return cols[0] * row[0] + cols[1] * row[1] + cols[2] * row[2]

    def unit(v):
        return np.minimum(1.0, np.maximum(0.0, v))

    lin = [np.array(srgb_table())[v] for v in codes]
    xyz = [dot(row, lin) for row in RGB_TO_XYZ]
    x5 = [dot(row, xyz) for row in D65_TO_D50]
    rgb = [unit(dot(row, x5)) for row in D50_TO_RGB]
    kb = 1.0 - np.maximum(np.maximum(rgb[0], rgb[1]), rgb[2])
    some = kb < 1
    rest = np.where(some, 1.0 - kb, 1.0)
    raw = [np.where(some, unit((1.0 - v - kb) / rest), 0.0) for v in rgb]
    strength = np.where(kb > 0.6, min(0.95, gcr * 1.15), np.where(kb > 0.3, gcr, max(0.3, gcr * 0.75)))
    cut = np.minimum(np.minimum(raw[0], raw[1]), raw[2]) * strength
    return [*(unit(v - cut) for v in raw), unit(kb + cut * 0.6)]


def with_cmyk(df: DataFrame, gcr: float = 0.8, r="r", g="g", b="b") -> DataFrame:
    """Adds ``c, m, y_ink, k`` under the white-point-adapted, grey-replacing model.

    The formula is too long for one compiled method of the JVM; a batch of rows at a time it is plain array arithmetic.
    """
    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            codes = [batch.column(c).fill_null(-1).to_numpy() for c in (r, g, b)]
            known = np.logical_and.reduce([(v >= 0) & (v <= 255) for v in codes])
            inks = _inks([np.where(known, v, 0).astype(np.int64) for v in codes], gcr)
            yield pa.RecordBatch.from_arrays([*batch.columns, *(pa.array(v) for v in inks)], names=[*batch.schema.names, *INKS])

    schema = StructType([*df.schema.fields, *(StructField(n, DoubleType()) for n in INKS)])
    return df.mapInArrow(rows, schema)


def with_round_trip(df: DataFrame, gcr: float, names: tuple[str, str, str]) -> DataFrame:
    """Adds the colour that comes back from the ink model."""
    back = {n: code_sql(f"((1D - {ink}) * (1D - k))") for n, ink in zip(names, ("c", "m", "y_ink"))}
    return stage(with_cmyk(df, gcr), **back).drop(*INKS)


def cmyk_to_rgb(c: Column, m: Column, y: Column, k: Column) -> tuple[Column, Column, Column]:
    light = F.lit(1.0) - k
    return tuple(linear_to_srgb((F.lit(1.0) - ink) * light) for ink in (c, m, y))


def lab_f(t: Column) -> Column:
    return F.when(t > 0.008856, F.cbrt(t)).otherwise(t * 7.787 + 16.0 / 116.0)


def lab_exprs(r="r", g="g", b="b") -> dict[str, str]:
    def bend(t: str) -> str:
        return f"CASE WHEN {t} > 0.008856D THEN cbrt({t}) ELSE {t} * 7.787D + {16 / 116!r}D END"

    out = xyz_exprs(r, g, b)
    out |= {n: bend(f"({c} / {w!r}D)") for n, c, w in zip(("_fx", "_fy", "_fz"), ("_X", "_Y", "_Z"), WHITE_D65)}
    return out | {"lab_l": "_fy * 116 - 16", "lab_a": "(_fx - _fy) * 500", "lab_b": "(_fy - _fz) * 200"}


def with_lab(df: DataFrame, r="r", g="g", b="b") -> DataFrame:
    """Adds ``lab_l, lab_a, lab_b`` (D65) for the 8-bit colour."""
    exprs = lab_exprs(r, g, b)
    return stage(df, **exprs).drop(*[n for n in exprs if n.startswith("_")])


def lab_arrays(codes: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Lab (D65) of whole columns of 8-bit codes."""
    lin = [np.array(srgb_table())[np.clip(v, 0, 255)] for v in codes]
    bent = []
    for row, white in zip(RGB_TO_XYZ, WHITE_D65):
        t = (lin[0] * row[0] + lin[1] * row[1] + lin[2] * row[2]) / white
        bent.append(np.where(t > 0.008856, np.cbrt(t), t * 7.787 + 16 / 116))
    fx, fy, fz = bent
    return fy * 116 - 16, (fx - fy) * 500, (fy - fz) * 200


def rgb_from_lab_arrays(l: np.ndarray, a: np.ndarray, b: np.ndarray) -> list[np.ndarray]:
    """Clamped linear RGB of Lab columns."""
    gy = (l + 16) / 116
    xyz = [np.where(g * g * g > 0.008856, g * g * g, (g - 16 / 116) / 7.787) * w for g, w in zip((a / 500 + gy, gy, gy - b / 200), WHITE_D65)]
    return [np.minimum(1.0, np.maximum(0.0, xyz[0] * row[0] + xyz[1] * row[1] + xyz[2] * row[2])) for row in XYZ_TO_RGB]


def code_formula(v: np.ndarray) -> np.ndarray:
    """8-bit sRGB codes of linear values, as numbers."""
    g = np.where(v <= 0.0031308, v * 12.92, np.maximum(v, 0.0) ** (1 / 2.4) * 1.055 - 0.055)
    return np.clip(np.floor(g * 255 + 0.5), 0, 255)


# Fixed value: bins of linear light that are narrower than any code, so that a bin holds at most two of them.
CODE_BINS = 4096


@lru_cache(maxsize=1)
def code_steps() -> tuple[np.ndarray, np.ndarray]:
    """The code at the start of each bin, and the least linear value of the code behind each code."""
    low, high = np.zeros(255), np.ones(255)
    while True:  # halving ends at neighbouring numbers
        mid = (low + high) / 2
        if ((mid == low) | (mid == high)).all():
            break
        up = code_formula(mid) >= np.arange(1, 256)
        low, high = np.where(up, low, mid), np.where(up, mid, high)
    bins = code_formula(np.arange(CODE_BINS + 1) / CODE_BINS)
    return bins.astype(np.uint8), np.append(high, np.inf)


def code_array(v: np.ndarray) -> np.ndarray:
    """8-bit sRGB codes of linear values, looked up instead of raised to a power."""
    bins, steps = code_steps()
    v = np.clip(v, 0.0, 1.0)
    code = bins[(v * CODE_BINS).astype(np.int32)]
    return code + (v >= steps[code])


@lru_cache(maxsize=4)
def _moved_table(gcr: float, limit: int) -> np.ndarray:
    """Per 24-bit colour whether it is moved, 2 where that is not known yet; filled as colours come."""
    return np.full(1 << 24, 2, np.uint8)


def moved_by_round_trip(codes: list[np.ndarray], gcr: float, limit: int) -> np.ndarray:
    """Whether the ink round trip moves 8-bit colours by more than ``limit`` codes; a task works out each colour about once."""
    table = _moved_table(gcr, limit)
    colour = (codes[0].astype(np.int32) << 16) | (codes[1].astype(np.int32) << 8) | codes[2]
    out = table[colour]
    new = np.nonzero(out == 2)
    if len(new[0]):
        some = [v[new].astype(np.int64) for v in codes]
        *inks, k = _inks(some, gcr)
        found = sum(np.abs(v - code_array((1.0 - ink) * (1.0 - k))) for v, ink in zip(some, inks)) > limit
        table[colour[new]] = out[new] = found
    return out == 1


def lab_lightness(r: Column, g: Column, b: Column) -> Column:
    """L* from relative luminance with the rounded Rec. 709 weights."""
    y = luma709(srgb_to_linear(r), srgb_to_linear(g), srgb_to_linear(b))
    return lab_f(y) * 116 - 16

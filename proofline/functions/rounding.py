"""Rounding rules shared by every operator.

Spark's ``round`` goes half away from zero; the rules here need half toward
plus infinity, so everything goes through ``floor(x + 0.5)``.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def js_round(c: Column) -> Column:
    """Half-up toward +infinity, as BIGINT."""
    return F.floor(c + F.lit(0.5))


def jr_int(c: Column) -> Column:
    return js_round(c).cast("int")


def r6(c: Column) -> Column:
    """Six-decimal value used wherever doubles leave an operator."""
    return F.floor(c * F.lit(1e6) + F.lit(0.5)) / F.lit(1e6)


def tenths(c: Column) -> Column:
    """Half-up value with one decimal place."""
    return F.floor(c * F.lit(10.0) + F.lit(0.5)) / F.lit(10.0)


def clamp(c: Column, lo: float, hi: float) -> Column:
    return F.least(F.lit(hi), F.greatest(F.lit(lo), c))


def nano(c: Column) -> Column:
    """Whole billionths: sums of these are exact and independent of row order."""
    return F.floor(c * F.lit(1e9) + F.lit(0.5))


def fixed_avg(c: Column) -> Column:
    """Mean from an integer sum of billionths, wide enough for any number of pixels.

    Upper and lower bits are added up apart as long integers and only their sums meet as a decimal.
    """
    v = nano(c)
    high = F.sum(F.shiftright(v, 24)).cast("decimal(28,0)")
    low = F.sum(v.bitwiseAND(F.lit((1 << 24) - 1))).cast("decimal(28,0)")
    return (high * F.lit(1 << 24).cast("decimal(9,0)") + low).cast("double") / F.lit(1e9) / F.count("*")

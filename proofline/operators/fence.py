"""Keeps a computed set of columns from being re-expanded by later steps."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def fenced(df: DataFrame, columns: list[str]) -> DataFrame:
    """Computes ``columns`` once per row behind a one-row generator.

    Filters and projections that use a deep expression several times would be
    rewritten to repeat it; the generator ends that rewriting, so generated code
    stays short. It stays inside the same stage and moves no data.
    """
    rest = [c for c in df.columns if c not in columns]
    return df.select(*rest, F.inline(F.array(F.struct(*columns))))

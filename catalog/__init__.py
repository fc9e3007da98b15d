"""Registered queries with their SQL twins, grouped by area."""

from __future__ import annotations

from functools import wraps

from proofline.session import tune

from . import commerce, metadata, neighbourhood, pixels, platform, queueing, text

AREAS = (metadata, pixels, neighbourhood, text, commerce, queueing, platform)


def _tuned(fn):
    @wraps(fn)
    def run(spark, sf_dir):
        tune(spark)
        return fn(spark, sf_dir)

    return run


def queries() -> dict:
    return {name: _tuned(entry[0]) for area in AREAS for name, entry in area.ENTRIES.items()}


def oracle_sql() -> dict:
    return {name: entry[1] for area in AREAS for name, entry in area.ENTRIES.items() if entry[1]}

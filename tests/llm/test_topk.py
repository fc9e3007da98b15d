"""Exact top-k search against brute force."""

from __future__ import annotations

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from proofline.llm import queries, topk

SCHEMA = "vec_id bigint, embedding array<float>, label int"


def plain(rows, every, k):
    usable = []
    for n, (vec_id, v, _) in enumerate(rows):
        if v is not None and all(e is not None and math.isfinite(e) for e in v):
            usable.append((n, vec_id, [math.floor(256 * float(np.float32(e))) for e in v]))
    out = []
    for n, vec_id, q in usable:
        if vec_id is not None and vec_id % every == 0:
            scores = [(-min(max(sum(a * b for a, b in zip(q, x)), -2**63), 2**63 - 1), other is None, other or 0, other) for m, other, x in usable if m != n]
            out += [(vec_id, r + 1, s[3], -s[0]) for r, s in enumerate(sorted(scores, key=lambda s: s[:3])[:k])]
    return sorted(out, key=str)


def got(spark, rows, every=5, k=5, **options):
    table = spark.createDataFrame(rows, SCHEMA)
    return sorted((tuple(r) for r in topk.top_k(table, F.col("vec_id") % every == 0, k, **options).collect()), key=str)


def clusters(n, dims, seed, spread):
    rng = np.random.default_rng(seed)
    centres = rng.normal(size=(6, dims)) * 4
    return [(i, (centres[rng.integers(6)] + rng.normal(size=dims) * spread).tolist(), 0) for i in range(n)]


@pytest.mark.parametrize("options", [{}, {"pivots": 7, "group_queries": 9, "block_rows": 40}, {"pivots": 1, "group_queries": 1}])
def test_matches_brute_force(spark, options):
    rows = clusters(260, 5, 1, 0.2)
    rows += [(500 + i, rows[3][1], 1) for i in range(40)]  # copies: ties, and a hot cell of queries
    assert got(spark, rows, **options) == plain(rows, 5, 5)


def test_bounds_send_only_what_is_needed(spark, monkeypatch):
    """Far clusters are not sent to each other's queries; the result stays whole."""
    rows = [(i, (np.array(v) / np.linalg.norm(v)).tolist(), 0) for i, v, _ in clusters(400, 3, 2, 0.01)]
    sent = []
    real = topk.bounds

    def spy(pivots, near, radius, k):
        out = real(pivots, near, radius, k)
        sent.extend(near[j][0] <= hi and lo <= near[j][0] for (i, j), (lo, hi) in out.items())
        return out

    monkeypatch.setattr(topk, "bounds", spy)
    assert got(spark, rows, pivots=24, group_queries=20) == plain(rows, 5, 5)
    assert 0 < sum(sent) < 0.7 * len(sent)


def test_odd_rows(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(0, [1.0, 2.0], 0), (5, None, 0), (10, [None, 1.0], 0), (15, [nan, 1.0], 0), (20, [inf, 0.0], 0), (25, [], 0), (30, [0.5], 0),
            (0, [1.0, 2.0], 0), (None, [1.0, 2.0], 0), (1, [-0.001, 0.0], 0), (2, [1.0, 2.0], 0)]
    assert got(spark, rows, k=3) == plain(rows, 5, 3)
    assert got(spark, rows, k=50) == plain(rows, 5, 50)
    assert got(spark, []) == [] and got(spark, [(5, [1.0], 0)]) == [] and got(spark, [(1, [1.0], 0), (2, [1.0], 0)]) == []


@pytest.mark.parametrize("size", [1e6, 3e8])
def test_large_components_stay_exact(spark, size):
    rng = np.random.default_rng(4)
    rows = [(i, (rng.normal(size=3) * size).tolist(), 0) for i in range(60)]
    assert got(spark, rows, k=4) == plain(rows, 5, 4)


def test_clashing_columns(spark):
    rows = clusters(50, 4, 3, 1.0)
    table = spark.createDataFrame(rows, SCHEMA)
    for name in ("rid", "cell", "g", "block", "score", "rank", "query_id", "v"):
        table = table.withColumn(name, F.lit("x"))
    out = topk.top_k(table, F.col("vec_id") % 5 == 0, 2)
    assert sorted((tuple(r) for r in out.collect()), key=str) == plain(rows, 5, 2)
    assert out.columns == ["query_id", "rank", "vec_id", "score"]


def test_query_and_its_sql(spark, sf):
    from compare import check, duck

    ok, note = check(spark, duck(sf), "op13_voronoi_topk", sf)
    assert ok, note
    assert queries.queries()["op13_voronoi_topk"](spark, sf).count() > 0

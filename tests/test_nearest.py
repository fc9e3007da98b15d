"""k nearest places against brute force."""

from __future__ import annotations

import math
import random

import pytest

from proofline.operators import nearest


def metres(a, b):
    (la, lo), (lb, ln) = a, b
    h = math.sin(math.radians(lb - la) / 2) ** 2 + math.cos(math.radians(la)) * math.cos(math.radians(lb)) * math.sin(math.radians(ln - lo) / 2) ** 2
    return math.floor(2 * 6371000 * math.atan2(math.sqrt(h), math.sqrt(max(0.0, 1 - h))) + 0.5)


def plain(users, places, k, same=lambda u, p: True):
    out = {}
    for u in users:
        found = sorted((metres(u[1:3], p[1:3]), p[0]) for p in places if same(u, p) and None not in p[1:3]) if None not in u[1:3] else []
        for n, (d, p) in enumerate(found[:k]):
            out[u[0], n + 1] = (p, d)
    return out


def got(spark, users, places, k, extra="", **options):
    u = spark.createDataFrame(users, f"user_id bigint, lat double, lng double{extra}")
    p = spark.createDataFrame(places, f"place_id bigint, lat double, lng double{extra}")
    return {(r.user_id, r.place_rank): (r.place_id, r.distance_m) for r in nearest.nearest_places(u, p, k, **options).collect()}


def globe(n, seed):
    rng = random.Random(seed)
    return [(i, math.degrees(math.asin(rng.uniform(-1, 1))), rng.uniform(-180, 180)) for i in range(n)]


def test_ten_thousand_places(spark):
    places = globe(9000, 1) + [(20_000 + i, 25 + i % 40 * 1e-4, 121 + i // 40 * 1e-4) for i in range(1000)]
    users = globe(60, 2) + [(1000, 90.0, 0.0), (1001, -90.0, 77.0), (1002, 10.0, 180.0), (1003, 10.0, -180.0), (1004, 25.01, 121.01), (1005, 0.0, 0.0)]
    assert got(spark, users, places, 3) == plain(users, places, 3)


@pytest.mark.parametrize("k", [1, 4])
def test_clusters_far_from_the_users(spark, k):
    """Many levels: the nearest place is on the other side of the globe, or just across the pole or the date line."""
    places = [(i, 89.9, i * 36.0) for i in range(10)] + [(100 + i, 0.0, 179.9 + (i % 2) * 0.2 - (i % 2) * 360) for i in range(6)] + [(200, -89.99, 10.0)]
    users = [(1, 89.95, -170.0), (2, 0.0, -179.95), (3, 0.0, 0.0), (4, -45.0, 10.0), (5, None, 3.0), (6, 1.0, None)]
    assert got(spark, users, places, k) == plain(users, places, k)


def test_few_places_and_equal_columns(spark):
    users = [(1, 1.0, 1.0, "a"), (2, 1.0, 1.0, "b"), (3, 1.0, 1.0, None)]
    places = [(7, 1.0, 1.0, "a"), (8, 1.0, 1.0, "a"), (9, 50.0, 1.0, "b"), (10, None, 1.0, "b")]
    assert got(spark, users, places, 5, ", city string", same="city") == plain(users, places, 5, lambda u, p: u[3] == p[3])
    assert got(spark, users, [], 2, ", city string") == {} and got(spark, [], places, 2, ", city string") == {}


def test_join_is_on_cells(spark, sf):
    import __spark_entry__ as entry

    plan = entry.queries()["nearest_places"](spark, sf)._jdf.queryExecution().toString()
    assert "CartesianProduct" not in plan and "BroadcastNestedLoopJoin" not in plan

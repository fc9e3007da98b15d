"""The bucketed result cache: history in place, first results stay, odd requests."""

from __future__ import annotations

import re

import pytest

from proofline.operators import result_cache


@pytest.fixture
def cache(spark, tmp_path):
    name = f"cache_{re.sub('[^0-9a-z]', '', tmp_path.name.lower())}"
    result_cache.open_cache(spark, name, str(tmp_path / "cache"), "result STRING, at BIGINT", 8)
    yield name
    spark.sql(f"DROP TABLE IF EXISTS {name}")


def results(spark, rows):
    return spark.createDataFrame(rows, "cache_key string, result string, at bigint")


def above_history(plan: str) -> list[str]:
    """Operators between the scan of the bucketed table and the join that reads it."""
    lines = [(len(re.match(r"[\s:+\-|]*", x)[0]), x) for x in plan.splitlines() if x.strip()]
    at = next(i for i, (_, x) in enumerate(lines) if "FileScan" in x and "Bucketed: true" in x)
    depth, out = lines[at][0], []
    for level, line in reversed(lines[:at]):
        if level < depth:
            depth = level
            if "Join" in line:
                break
            out.append(line)
    return out


def test_history_is_not_shuffled(spark, cache):
    result_cache.add_results(results(spark, [(f"k{i}", f"r{i}", i) for i in range(500)]), cache, "at")
    requests = spark.range(0, 900).selectExpr("id", "concat('k', id % 600) AS cache_key")
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        found = result_cache.answers(requests, cache)
        steps = above_history(found._jdf.queryExecution().executedPlan().toString())
        assert steps and not any("Exchange" in s for s in steps)
        assert found.count() == 500
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)


def test_first_result_stays_and_batches_repeat(spark, cache, tmp_path):
    one = results(spark, [("a", "late", 2), ("a", "early", 1), ("b", "b", 3), (None, "no", 0)])
    for batch in (one, one, results(spark, [("a", "other", 0), ("c", None, 4)])):
        files = len(list((tmp_path / "cache").glob("part-*")))
        result_cache.add_results(batch, cache, "at")
        assert len(list((tmp_path / "cache").glob("part-*"))) - files <= 8
    assert {tuple(r) for r in spark.table(cache).collect()} == {("a", "early", 1), ("b", "b", 3), ("c", None, 4)}
    # a cache outlives its name
    spark.sql(f"DROP TABLE {cache}")
    result_cache.open_cache(spark, cache, str(tmp_path / "cache"), "result STRING, at BIGINT", 8)
    assert spark.table(cache).count() == 3


def test_odd_requests(spark, cache):
    requests = spark.createDataFrame([(1, "a", "x"), (2, "a", "y"), (3, None, "z"), (4, "q", None)], "id int, cache_key string, result string")
    assert {r.id: r.cached for r in result_cache.lookup(requests, cache).collect()} == dict.fromkeys((1, 2, 3, 4), False)
    result_cache.add_results(results(spark, [("a", "ra", 1)]), cache, "at")
    got = {r.id: (r.result, r.cached) for r in result_cache.lookup(requests, cache).collect()}
    assert got == {1: ("ra", True), 2: ("ra", True), 3: (None, False), 4: (None, False)}
    assert result_cache.lookup(requests.filter("false"), cache).count() == 0

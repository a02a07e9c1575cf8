"""Pairs of keys that many rows have: equal to a plain join, and dealt over the tasks."""

import itertools

import pytest
from pyspark.sql import functions as F

from tracklight.operators import joins, matching
from tracklight.queries import rules


@pytest.fixture
def small_blocks(monkeypatch):
    monkeypatch.setattr(joins, "BLOCK", 8)


def largest_share(pairs):
    n = [r["count"] for r in pairs.groupBy(F.spark_partition_id().alias("task")).count().collect()]
    return max(n) / sum(n)


def test_block_join_equals_a_join(spark, small_blocks):
    left = spark.range(90).selectExpr("id as x", "case when id < 70 then 'hot' when id = 89 then null else concat('k', id % 3) end as k")
    right = spark.range(50).selectExpr("id as y", "case when id < 30 then 'hot' when id = 49 then null else concat('k', id % 4) end as k")
    got = joins.block_join(left, right, ["k"], "x", "y")
    assert sorted(map(tuple, got.select("x", "y", "k").collect())) == sorted(map(tuple, left.join(right, "k").select("x", "y", "k").collect()))
    assert largest_share(got) < 0.6


def test_identity_pairs_are_all_and_once(spark, small_blocks):
    codes = [(k, "hot") for k in range(60)] + [(k, "two") for k in range(5, 9)] + [(k, "own") for k in range(7, 12)] + [(3, "hot"), (70, None), (71, None)]
    held = [(k, "c", k // 2) for k in range(75)] + [(k, "d", k // 2 + 1) for k in range(75)] + [(80, "c", None), (81, "c", None)]
    shared = {(a, b) for (a, x), (b, y) in itertools.product(codes, codes) if x and x == y and a < b}
    shared |= {(a, b) for (a, *x), (b, *y) in itertools.product(held, held) if x[1] is not None and x == y and a < b}
    got = matching.same_identity(spark.createDataFrame(codes, "id long, isrc string"), spark.createDataFrame(held, "id long, connector string, identifier long"))
    assert sorted(map(tuple, got.collect())) == sorted(shared)
    # no pair of equal codes is looked for among the others
    assert got._jdf.queryExecution().optimizedPlan().nodeName() == "Union"


def test_a_code_that_many_have_is_no_one_tasks(spark, small_blocks):
    class Lib:
        canonicals = spark.createDataFrame([(k, "same", k * 1000) for k in range(120)], "track_id long, isrc string, duration_ms long")
        connector_tracks = spark.createDataFrame([(k, "same", 5000) for k in range(100)], "id long, isrc string, duration_ms long")

    pairs = rules.isrc_pairs(Lib)
    assert pairs.count() == 12_000 and largest_share(pairs) < 0.6

"""Competitor pools and pairs of small and large cases against plain Python, and the shuffles they take."""

import random

import pytest
from pyspark.sql import functions as F

from rankwright.operators import learned as L
from rankwright.plans import texts
from tests.test_pairs import plain


@pytest.mark.parametrize("limit", [0, 7, 256])  # all cases large, both kinds, all small
def test_either_way_gives_the_same(spark, monkeypatch, limit):
    monkeypatch.setattr(L, "CASE", limit)
    rng = random.Random(2)
    rows = [(k, f"c{i:03d}", rng.random() < 0.3, rng.choice([None, 1.0, rng.random()]), rng.random()) for k in range(15) for i in range(rng.choice([1, 4, 7, 30]))]
    again = [(k, c, good, None if a is None else a - 1, b - 1) for k, c, good, a, b in rows[::3]] + [(k, c, False, a, b) for k, c, _, a, b in rows[::4]]
    df = spark.createDataFrame(rows + again, "k long, c string, good boolean, a double, b double").repartition(4)
    args = ("k", "c", "good", ["a", "b"], 2, 1)
    want_pool, want = plain(rows, 2, 1, 5, "s")
    got = L.competitor_pool(df, *args, "s", ["b"]).collect()
    best = {(k, c): (good, b) for k, c, good, _, b in rows}
    assert sorted((r.k, r.c) for r in got) == sorted(want_pool) and all((r.good, r.b) == best[r.k, r.c] for r in got)
    got = L.competitor_pairs(df, *args, 5, "s", F.array(F.col("b") * 2)).collect()
    assert sorted((r.k, r.pair, r.pos_id, r.neg_id) for r in got) == want
    assert all(r.d == [best[r.k, r.pos_id][1] * 2 - best[r.k, r.neg_id][1] * 2] for r in got)
    assert L.competitor_pairs(df.where("k < 0"), *args, 5, "s", F.array("b")).count() == L.competitor_pool(df.where("k < 0"), *args, "s").count() == 0


def test_unknown_positives_compete_for_a_place_only(spark):
    df = spark.createDataFrame([(1, "a", None, 3.0), (1, "b", None, 2.0), (1, "c", True, 1.0), (1, "d", False, 0.0)], "k long, c string, good boolean, a double")
    assert len(L.competitor_pool(df, "k", "c", "good", ["a"], 1, 2, "s").collect()) == 4
    assert [(r.pos_id, r.neg_id) for r in L.competitor_pairs(df, "k", "c", "good", ["a"], 4, 0, 9, "s", F.array("a")).collect()] == [("c", "d")]


def test_a_large_case_is_not_one_group(spark):
    df = spark.range(200_000, numPartitions=8).selectExpr("1 AS k", "id AS c", "id % 2 = 0 AS good", "CAST(id * 7 % 1000 AS DOUBLE) AS a", "CAST(id * 11 % 1000 AS DOUBLE) AS b")
    pairs = L.competitor_pairs(df, "k", "c", "good", ["a", "b"], 4, 3, 50, "s", F.array("a"))
    assert pairs.count() == 50 and pairs.where("d IS NULL OR pos_id % 2 = 1 OR neg_id % 2 = 0").isEmpty()


def test_small_cases_are_shuffled_once(spark, sf):
    """Each further shuffle of all rows is written to disk."""
    for query in (texts.pool, texts.competitor_pairs):
        plan = query(spark, sf)._jdf.queryExecution().executedPlan().toString()
        assert plan.count("Exchange hashpartitioning") == 1 and "Join" not in plan

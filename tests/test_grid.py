"""Lane budgets against every split counted by itself."""

import random

import pytest

from rankwright.operators import grid


@pytest.mark.parametrize("most, n", [(3, 40), (30, 400), (90, 5)])
def test_every_split(spark, most, n):
    rng = random.Random(most)
    rows = [tuple(rng.choice([None, 1, rng.randint(1, most)]) for _ in range(3)) for _ in range(n)] + [(None, None, None), (1, 1, 1), (10**9, 2, None)]
    ks = [1, 2, 7, 33]
    got = {(r.k, r.a, r.b, r.c): (r.hits, r.cases) for r in grid.lane_budget_sweep(spark.createDataFrame(rows, "a long, b long, c long"), ["a", "b", "c"], ks).collect()}
    want = {}
    for k in ks:
        for a in range(k + 1):
            for b in range(k - a + 1):
                hit = sum(any(r is not None and r <= m for r, m in zip(row, (a, b, k - a - b))) for row in rows)
                want[k, a, b, k - a - b] = (hit, len(rows))
    assert got == want
    best = {r.k: (r.a, r.b, r.c) for r in grid.select_lane_budgets(spark.createDataFrame(rows, "a long, b long, c long"), ["a", "b", "c"], ks).collect()}
    for k in ks:
        assert best[k] == max((key[1:] for key in want if key[0] == k), key=lambda t: (want[(k, *t)][0], -t[2], t[1], -t[0]))


def test_no_cases(spark):
    assert grid.select_lane_budgets(spark.createDataFrame([], "a long, b long, c long"), ["a", "b", "c"], [5]).count() == 0


def test_cases_meet_in_one_aggregation(spark):
    """However many cases there are, what leaves their tasks is bounded by the grid."""
    df = spark.range(200_000, numPartitions=4).selectExpr("id % 911 + 1 AS a", "id % 77 + 1 AS b", "id % 13 + 1 AS c")
    out = grid.select_lane_budgets(df, ["a", "b", "c"], [12]).first()
    assert out.cases == 200_000 and 0 < out.hits < 200_000

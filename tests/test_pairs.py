"""Competitor pools and sampled pairs against plain Python."""

import hashlib
import random
from collections import defaultdict

from rankwright.operators import learned as L

DIGITS = lambda *parts: hashlib.sha256("\0".join(map(str, parts)).encode()).hexdigest()[:16]


def plain(rows, top, tail, most, seed):
    cases, pools, pairs = defaultdict(list), {}, []
    for row in rows:
        cases[row[0]].append(row[1:])
    for case, cands in cases.items():
        chosen = {c for c, positive, *_ in cands if positive}
        for lane in (2, 3):
            ranked = sorted(cands, key=lambda x: (x[lane] is None, -(x[lane] or 0), x[0]))
            chosen |= {x[0] for x in ranked[:top]}
        rest = sorted((DIGITS(seed, case, c), c) for c, *_ in cands if c not in chosen)
        chosen |= {c for _, c in rest[:tail]}
        pools[case] = chosen
        good = sorted(c for c, positive, *_ in cands if positive)
        bad = sorted(c for c, positive, *_ in cands if not positive and c in chosen)
        every = [(g, b) for g in good for b in bad]
        kept = sorted(range(len(every)), key=lambda i: (DIGITS(seed, case, i), i))[:most]
        pairs += [(case, i, *every[i]) for i in kept]
    return {(case, c) for case, cs in pools.items() for c in cs}, sorted(pairs)


def test_pools_and_pairs(spark):
    rng = random.Random(1)
    rows = [(k, f"c{i:03d}", rng.random() < 0.2, rng.choice([None, 1.0, rng.random()]), rng.random()) for k in range(12) for i in range(rng.choice([1, 5, 40]))]
    rows += [(50, "only", True, 1.0, 1.0), (51, "none", False, 1.0, 1.0)]
    df = spark.createDataFrame(rows, "k long, c string, good boolean, a double, b double").repartition(5)
    pool = L.competitor_pool(df, "k", "c", "good", ["a", "b"], 3, 2, "seed")
    want_pool, want = plain(rows, 3, 2, 7, "seed")
    got = [(r.k, r.c) for r in pool.collect()]
    assert set(got) == want_pool and len(got) == len(want_pool)
    pairs = L.sampled_pairs(pool, "k", "c", "good", 7, "seed")
    assert sorted((r.k, r.pair, r.pos_id, r.neg_id) for r in pairs.collect()) == want
    assert L.sampled_pairs(pool.where("k < 0"), "k", "c", "good", 7, "seed").count() == 0
    d = L.pair_differences(pairs, df.selectExpr("k", "c", "array(b, 1.0D) AS x"), "k", "c", "x").collect()
    b = {(k, c): y for k, c, _, _, y in rows}
    assert len(d) == len(want) and all(r.d == [b[r.k, r.pos_id] - b[r.k, r.neg_id], 0.0] for r in d)


def test_a_large_case_keeps_its_cap(spark):
    """10^5 positives and as many others: only numbers are ranked, and no join makes more rows than are kept."""
    df = spark.range(200_000, numPartitions=8).selectExpr("1 AS k", "id AS c", "id % 2 = 0 AS good", "CAST(id * 7 % 1000 AS DOUBLE) AS a", "CAST(id * 11 % 1000 AS DOUBLE) AS b")
    pool = L.competitor_pool(df, "k", "c", "good", ["a", "b"], 4, 3, "s")
    assert 100_003 <= pool.count() <= 100_011
    pairs = L.sampled_pairs(pool, "k", "c", "good", 50, "s")
    assert pairs.count() == 50 and pairs.select("pair").distinct().count() == 50


def test_training_ends_when_nothing_moves(spark):
    rows = spark.createDataFrame([([1.0],)] * 4, "d array<double>")
    loose, tight = L.train_pairwise(rows, "d", 1, epochs=200, tolerance=0.3), L.train_pairwise(rows, "d", 1, epochs=3)
    assert loose == [0.25] and tight[0] > 0.6

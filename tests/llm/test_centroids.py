"""Centroid clustering against plain integers."""

import hashlib
import math
import random

import numpy as np
import pytest

from rankwright.llm import centroids as ce


def plain(rows, k=8, rounds=10, d=64):
    kept = [(i, [math.floor(1024 * float(np.float32(x))) for x in v]) for i, v in rows if v is not None and len(v) == d and all(x is not None and math.isfinite(x) for x in v)]
    c = [v for _, v in sorted(kept, key=lambda r: (r[0] is None, hashlib.sha256(f"3:{r[0]}".encode()).hexdigest(), r[1]))[:k]]
    near = lambda v: min((sum((a - b) ** 2 for a, b in zip(v, m)), j) for j, m in enumerate(c))
    for _ in range(rounds):
        of = [near(v)[1] for _, v in kept]
        for j in range(len(c)):
            mine = [v for (_, v), o in zip(kept, of) if o == j]
            if mine:
                c[j] = [sum(x) // len(mine) for x in zip(*mine)]
    last = [(i, *near(v)) for i, v in kept]
    per = {j: sum(x for _, x, o in last if o == j) for j in range(len(c))}
    return sorted((str(i), j, x, per[j], sum(per.values()), hashlib.sha256(",".join(map(str, c[j])).encode()).hexdigest()) for i, x, j in last)


def rows_of(df):
    return sorted((str(r.vec_id), r.cluster, r.distance, r.cluster_inertia, r.inertia, r.centroid_sha256) for r in df.collect())


def frame(spark, rows):
    return spark.createDataFrame([(i, v, 7, "x") for i, v in rows], "vec_id long, embedding array<float>, _v int, cluster string").repartition(3)


@pytest.fixture(scope="module")
def vectors():
    rng = random.Random(3)
    rows = [(i, [rng.gauss(0, 1) for _ in range(64)]) for i in range(150)]
    rows += [(200, None), (201, []), (202, [1.0] * 63), (203, [1.0] * 65), (204, [None] + [0.0] * 63), (205, [float("nan")] + [0.0] * 63), (206, [float("inf")] + [0.0] * 63)]
    return [*rows, *rows[:9], (7, rows[50][1]), (None, rows[3][1]), (300, [-0.5 / 1024] * 64), (301, [0.0] * 64)]


def test_clusters_agree_with_plain_integers(spark, vectors):
    assert rows_of(ce.cluster(frame(spark, vectors))) == plain(vectors)


def test_few_equal_and_no_vectors(spark):
    same = [(i, [0.25] * 64) for i in range(20)]
    for rows in (same, same[:1], [(None, [1.0] * 64), (1, [2.0] * 64), (1, [2.0] * 64)]):
        assert rows_of(ce.cluster(frame(spark, rows))) == plain(rows)
    assert rows_of(ce.cluster(frame(spark, [(1, None)]))) == rows_of(ce.cluster(frame(spark, same).where("vec_id < 0"))) == []


@pytest.mark.parametrize("most", [3, 1 << 10, 1 << 16, 1 << 26])
def test_screening_never_loses_the_nearest(most):
    """Ties and near ties at every magnitude: the result is that of exact integers, and far centroids are decided by float32."""
    rng = np.random.default_rng(most)
    c = rng.integers(-most, most, (16, 64))
    c[5], c[9], c[11] = c[2], c[2], c[2] + (np.arange(64) == 7)
    x = np.concatenate([rng.integers(-most, most, (400, 64)), c, (c[:8] + c[8:]) // 2])
    best, distance, opened = ce.nearest(x, c)
    want = [min((sum((int(a) - int(b)) ** 2 for a, b in zip(v, m)), j) for j, m in enumerate(c)) for v in x]
    assert [(int(d), int(b)) for d, b in zip(distance, best)] == want
    assert opened < len(x)


def test_a_distance_beyond_64_bits_is_refused(spark):
    with pytest.raises(Exception, match="would not fit 64 bits"):
        ce.cluster(frame(spark, [(1, [2.0e5] + [0.0] * 63)])).collect()


def test_query_agrees_with_sql(spark, sf):
    import duckdb

    c = duckdb.connect()
    c.execute(f"CREATE VIEW embeddings AS SELECT * FROM '{sf}/embeddings.parquet'")
    want = c.sql(ce.SQL["op13_centroids"]).select("vec_id, cluster, distance, cluster_inertia, inertia, centroid_sha256").fetchall()
    assert rows_of(ce.op13_centroids(spark, sf)) == sorted((str(r[0]), *r[1:]) for r in want)

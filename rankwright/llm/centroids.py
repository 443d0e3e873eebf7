"""Centroid clustering of integer vectors: float32 screening, exact integers where it can't decide.

A round reads the vectors once. Each task multiplies its batches by the
centroids in float32 and gives every score ``|c|^2 - 2 x.c`` an interval that
holds the exact value whatever the order of summation: the error of a dot
product of n terms is at most ``gamma_n |x| |c|`` with
``gamma_n = n u / (1 - n u)``, u = 2^-24, two more terms standing for the
conversion of the inputs. Centroids whose interval begins above the least upper
end cannot win. Where one is left it is the nearest; the others' squared
distances are computed in 64-bit integers, the smaller number winning ties. So
the result is that of exact arithmetic, and only rows between centroids pay
for it.

Tasks return one row of sums for each centroid; Spark adds those as decimals,
and k * d numbers reach the driver, which divides them as Python integers.
Nothing else leaves the tasks but the final rows.

Cases: vectors that are null, of another length, or hold a null or a value that
is not finite are left out; a null id is kept, and can be a seed only where
fewer than k others are there; equal vectors share a cluster; repeated ids stay
as rows; fewer than k vectors give as many centroids; an empty table gives no
row; other columns are not read. A component beyond ``MOST`` (a value beyond
131,072) would let distances overflow 64 bits and ends the query with an error
that says so.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from rankwright.llm.common import cut, scratch, ship, spread, table

DIMENSIONS, SEEDS, ROUNDS, SCALE = 64, 8, 10, 1024
#: Largest component: 64 squared differences of two such fit 63 bits.
MOST = 1 << 27
#: Scores that a task holds at once.
CELLS = 1 << 22
_U = 2.0**-24


def quantised(embedding: Column, scale: int = SCALE) -> Column:
    """floor(scale * x) of every component, as long. A power of two, so that the product is exact."""
    whole = F.transform(embedding, lambda x: F.floor(x.cast("double") * F.lit(float(scale))))
    fits = F.forall(embedding, lambda x: F.abs(x.cast("double")) * F.lit(float(scale)) < F.lit(float(MOST)))
    return F.when(fits, whole).otherwise(F.raise_error(F.lit(f"a component times {scale} is not below {MOST}: its distances would not fit 64 bits")).cast("array<bigint>"))


def valid(embedding: Column, dimensions: int) -> Column:
    """Whether a vector has exactly so many components, all there and finite."""
    finite = F.forall(embedding, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))))
    return F.coalesce((F.size(embedding) == dimensions) & finite, F.lit(False))


def dot_bound(terms: int) -> float:
    """Largest error of a float32 dot product of rounded inputs, as a share of the product of the norms."""
    n = terms + 2
    return n * _U / (1 - n * _U)


def nearest(x: np.ndarray, centroids: np.ndarray) -> tuple[np.ndarray, np.ndarray, int]:
    """For int64 rows: the nearest centroid, its squared distance, and how many rows the intervals left open."""
    n, d = x.shape
    x32, c32 = x.astype(np.float32), centroids.astype(np.float32)
    c2 = (centroids * centroids).sum(axis=1)
    cn = np.sqrt(c2.astype(np.float64)) * (1 + 2.0**-40)
    xn = np.sqrt((x * x).sum(axis=1).astype(np.float64)) * (1 + 2.0**-40)
    size = np.outer(xn, cn)
    score = c2.astype(np.float64) - 2.0 * (x32 @ c32.T).astype(np.float64)
    # what float32 may have lost, and what the float64 steps above may lose
    radius = 2.0 * dot_bound(d) * size + 2.0**-48 * (c2.astype(np.float64) + 2.0 * size) + 2.0**-20
    low = score - radius
    able = low <= (score + radius).min(axis=1, keepdims=True)
    best = able.argmax(axis=1)
    open_rows = np.flatnonzero(able.sum(axis=1) > 1)
    if len(open_rows):
        row, col = np.nonzero(able[open_rows])
        step = max(1, CELLS // d)
        exact = np.concatenate([((x[open_rows[row[i : i + step]]] - centroids[col[i : i + step]]) ** 2).sum(axis=1) for i in range(0, len(row), step)])
        order = np.lexsort((col, exact, row))
        first = order[np.unique(row[order], return_index=True)[1]]
        best[open_rows] = col[first]
    return best, ((x - centroids[best]) ** 2).sum(axis=1), len(open_rows)


def _blocks(batches: Iterator[pa.RecordBatch], centroids: np.ndarray) -> Iterator[tuple[pa.RecordBatch, np.ndarray, np.ndarray, np.ndarray]]:
    """Slices of a bounded number of scores with their vectors, clusters and distances."""
    k, d = centroids.shape
    step = max(1, CELLS // max(k, d))
    for batch in batches:
        for at in range(0, batch.num_rows, step):
            part = batch.slice(at, step)
            x = part.column("_v").flatten().to_numpy().reshape(part.num_rows, d)
            best, distance, _ = nearest(x, centroids)
            yield part, x, best, distance


def _sums(rows: DataFrame, centroids: np.ndarray) -> tuple[list[list[int]], list[int]]:
    """Exact sums of the vectors of each cluster, and their numbers."""
    k, d = centroids.shape

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, count = np.zeros((k, d), np.int64), np.zeros(k, np.int64)
        for _, x, best, _ in _blocks(batches, centroids):
            np.add.at(total, best, x)
            count += np.bincount(best, minlength=k)
            if np.abs(total).max() > 1 << 61:  # far from overflow still: a block adds at most 2^49
                yield _as_rows(total, count)
                total[:], count[:] = 0, 0
        yield _as_rows(total, count)

    def _as_rows(total: np.ndarray, count: np.ndarray) -> pa.RecordBatch:
        flat = np.concatenate([total, count[:, None]], axis=1)
        return pa.RecordBatch.from_arrays([pa.array(np.repeat(np.arange(k), d + 1)), pa.array(np.tile(np.arange(d + 1), k)), pa.array(flat.ravel())], ["cluster", "at", "part"])

    parts = rows.select("_v").mapInArrow(run, "cluster long, at long, part long")
    found = parts.groupBy("cluster", "at").agg(F.sum(F.col("part").cast("decimal(38,0)")).alias("total")).collect()
    total, count = [[0] * d for _ in range(k)], [0] * k
    for r in found:
        if r["at"] == d:
            count[r["cluster"]] = int(r["total"])
        else:
            total[r["cluster"]][r["at"]] = int(r["total"])
    return total, count


def seeds(rows: DataFrame, key: str, k: int, salt: str) -> np.ndarray:
    """The vectors of the k rows whose ``salt + key`` has the smallest SHA-256; equal keys by their components."""
    rank = F.sha2(F.concat(F.lit(salt), F.col(key).cast("string")), 256)
    first = rows.select("_v", rank.alias("_h")).orderBy(F.col("_h").asc_nulls_last(), "_v").limit(k).collect()
    return np.array([r["_v"] for r in first], np.int64)


def fit(rows: DataFrame, centroids: np.ndarray, rounds: int) -> np.ndarray:
    """Centroids after so many rounds: exact means rounded down; an empty cluster's stays."""
    for _ in range(rounds):
        total, count = _sums(rows, centroids)
        centroids = np.array([[t // n for t in total[i]] if (n := count[i]) else centroids[i].tolist() for i in range(len(centroids))], np.int64)
    return centroids


def assign(rows: DataFrame, key: str, centroids: np.ndarray) -> DataFrame:
    """key, cluster, distance of every row."""
    kind = dict(rows.dtypes)[key]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, _, best, distance in _blocks(batches, centroids):
            yield pa.RecordBatch.from_arrays([part.column(key), pa.array(best.astype(np.int32)), pa.array(distance)], [key, "cluster", "distance"])

    return rows.select(key, "_v").mapInArrow(run, f"`{key}` {kind}, cluster int, distance long")


def cluster(df: DataFrame, key: str = "vec_id", embedding: str = "embedding", dimensions: int = DIMENSIONS, k: int = SEEDS, rounds: int = ROUNDS, scale: int = SCALE, salt: str = "3:") -> DataFrame:
    """key, cluster, distance, cluster_inertia, inertia, centroid_sha256 of every valid vector."""
    spark = df.sparkSession
    ship(spark)
    with scratch(spark) as kept:
        vectors = df.select(key, embedding).where(valid(F.col(embedding), dimensions)).select(key, quantised(F.col(embedding), scale).alias("_v"))
        vectors = spread(cut(vectors, "vectors"))
        centroids = seeds(vectors, key, k, salt)
        if not len(centroids):
            centroids = np.zeros((1, dimensions), np.int64)  # no row will ask for it
        centroids = fit(vectors, centroids, rounds)
        rows = kept(cut(assign(vectors, key, centroids), "clusters"))
    # one row for each centroid: k rows, whatever the number of vectors
    per = {r["cluster"]: int(r["s"]) for r in rows.groupBy("cluster").agg(F.sum(F.col("distance").cast("decimal(38,0)")).alias("s")).collect()}
    digest = [hashlib.sha256(",".join(map(str, c.tolist())).encode()).hexdigest() for c in centroids]
    told = spark.createDataFrame([(i, per.get(i, 0), sum(per.values()), h) for i, h in enumerate(digest)], "cluster int, cluster_inertia long, inertia long, centroid_sha256 string")
    return rows.join(F.broadcast(told), "cluster").select(key, "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256")


def op13_centroids(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cluster(table(spark, sf_dir, "embeddings"))


def _oracle(k: int = SEEDS, rounds: int = ROUNDS) -> str:
    """The rounds unrolled: distances by a join on the component, the nearest by the least (distance, number)."""
    steps = [f"""
  v AS MATERIALIZED (SELECT row_number() OVER () AS r, vec_id, embedding AS e FROM embeddings
    WHERE len(embedding) = {DIMENSIONS} AND len(list_filter(embedding, lambda x: x IS NOT NULL AND isfinite(x))) = {DIMENSIONS}),
  x AS MATERIALIZED (SELECT r, vec_id, j, CAST(floor({SCALE} * CAST(e[j] AS DOUBLE)) AS BIGINT) AS x FROM v, range(1, {DIMENSIONS + 1}) t(j)),
  seed AS (SELECT r, row_number() OVER (ORDER BY sha256('3:' || CAST(vec_id AS VARCHAR)) NULLS LAST, e) - 1 AS c FROM v),
  c0 AS MATERIALIZED (SELECT c, j, x AS m FROM seed JOIN x USING (r) WHERE c < {k})"""]
    for i in range(rounds + 1):
        steps.append(f"""
  a{i} AS MATERIALIZED (SELECT r, min({{'d': d, 'c': c}}) AS a FROM (SELECT r, c, sum((x - m) * (x - m)) AS d FROM x JOIN c{i} USING (j) GROUP BY r, c) GROUP BY r)""")
        if i < rounds:
            steps.append(f"""
  n{i} AS MATERIALIZED (SELECT a.c AS c, j, sum(x) AS s, count(*) AS n FROM x JOIN a{i} USING (r) GROUP BY 1, 2),
  c{i + 1} AS MATERIALIZED (SELECT o.c, o.j, CAST(CASE WHEN n IS NULL THEN m ELSE (s - ((s % n) + n) % n) // n END AS BIGINT) AS m FROM c{i} o LEFT JOIN n{i} w ON o.c = w.c AND o.j = w.j)""")
    return "WITH " + ",".join(steps) + f""",
  h AS (SELECT c, sha256(string_agg(CAST(m AS VARCHAR), ',' ORDER BY j)) AS centroid_sha256 FROM c{rounds} GROUP BY c)
SELECT vec_id, CAST(a.c AS INTEGER) AS cluster, CAST(a.d AS BIGINT) AS distance, CAST(sum(a.d) OVER (PARTITION BY a.c) AS BIGINT) AS cluster_inertia,
       CAST(sum(a.d) OVER () AS BIGINT) AS inertia, centroid_sha256
FROM v JOIN a{rounds} USING (r) JOIN h ON h.c = a.c"""


QUERIES = {"op13_centroids": op13_centroids}
SQL = {"op13_centroids": _oracle()}

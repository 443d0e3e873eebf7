"""Samples and splits that are the same on every run and every partitioning."""

from __future__ import annotations

import heapq

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def seeded_hash(seed: str, *parts: str) -> Column:
    return F.sha2(F.concat_ws("\0", F.lit(seed), *[F.col(p).cast("string") for p in parts]), 256)


def stratified(df: DataFrame, stratum: str, key: str, seed: str, total: int) -> DataFrame:
    """Proportional targets that sum to ``total``, or to all rows if there are fewer, filled in seeded hash order.

    Running totals of the strata, by name, are rounded half to even; a
    stratum's target is the step of the rounded ones, so the last takes the
    rest and none is asked for more than it has.
    """
    n = df.groupBy(stratum).agg(F.count(F.lit(1)).alias("_n"))
    everything, so_far = F.sum("_n").over(Window.partitionBy()), F.sum("_n").over(Window.orderBy(stratum).rowsBetween(Window.unboundedPreceding, 0))  # a row for each stratum
    upto = lambda c: F.bround(F.least(F.lit(total), everything) * c / everything, 0).cast("long")
    n = n.select(stratum, "_n", (upto(so_far) - upto(so_far - F.col("_n"))).alias("_t"))
    w = Window.partitionBy(stratum).orderBy(seeded_hash(seed, key), key)
    ranked = df.withColumn("_rn", F.row_number().over(w)).withColumnRenamed(stratum, "_s")
    ranked = ranked.join(F.broadcast(n), F.col("_s").eqNullSafe(n[stratum])).where("_rn <= _t")
    return ranked.select(*[F.col("_s").alias(c) if c == stratum else c for c in df.columns])


def round_robin(df: DataFrame, bucket: str, key: str, n: int) -> DataFrame:
    """Cycle through the buckets, first of each, then second of each, up to n rows."""
    first = df.groupBy(key).agg(F.min(bucket).alias(bucket))
    w = Window.partitionBy(bucket).orderBy(key)
    return first.withColumn("turn", F.row_number().over(w)).orderBy("turn", bucket).limit(n)


def hash_bucket(key: Column, buckets: int) -> Column:
    """The first 16 hex digits of SHA-256 as an unsigned number, modulo the buckets."""
    return (F.conv(F.substring(F.sha2(key.cast("string"), 256), 1, 16), 16, 10).cast("decimal(20,0)") % buckets).cast("int")


def unit_float(key: Column) -> Column:
    return F.conv(F.substring(F.sha2(key.cast("string"), 256), 1, 13), 16, 10).cast("double") / float(1 << 52)


def ab_label(key: Column) -> Column:
    """Parity of the first hash byte."""
    return F.when(F.conv(F.substring(F.sha2(key.cast("string"), 256), 1, 2), 16, 10).cast("int") % 2 == 0, "A").otherwise("B")


def longest_first(loads: list[tuple[str, int]], workers: int) -> dict[str, int]:
    """Largest item to the least-loaded worker: driver-side, over a table of repositories."""
    heap = [(0, w) for w in range(workers)]
    out = {}
    for key, size in sorted(loads, key=lambda x: (-x[1], x[0])):
        load, w = heapq.heappop(heap)
        out[key] = w
        heapq.heappush(heap, (load + size, w))
    return out

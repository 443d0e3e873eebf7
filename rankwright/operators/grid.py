"""Lane budgets: the best split of K reviews over three lanes, for any number of cases in one aggregation.

A case is missed by budgets (a, b, K - a - b) where all of its first-positive
ranks lie beyond them: for a < x, b < y and a + b >= K - z + 1. In the plane of
(a, b) that is a rectangle at the origin without a corner, and its rows begin on
an axis or on a diagonal and end at b = y. So each case adds at most six steps
to a table of differences, along a for each b and for each diagonal a + b; the
cases combine on the map side into at most 2 (K + 2)^2 sums, and two running
sums over the grid turn those into the misses of every split.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def _steps(k: Column, x: Column, y: Column, z: Column) -> Column:
    """kind, at, a, d: differences along a of a row of b (``b``) or of a diagonal (``t``). A null rank lies beyond every budget."""
    x, y, z = (F.coalesce(F.least(r.cast("int"), k + 1), k + 1) for r in (x, y, z))
    s = k - z + 1
    lo, hi = F.greatest(F.lit(0), s - y + 1), x - 1
    step = lambda kind, at, a, d: F.struct(F.lit(kind).alias("kind"), at.alias("at"), a.alias("a"), F.lit(d).cast("long").alias("d"))
    pair = lambda kind, at, a, z, d: F.when(a <= z, F.array(step(kind, at, a, d), step(kind, at, z + 1, -d))).otherwise(F.array())
    return F.concat(pair("b", y, lo, hi, -1), pair("t", s, lo, F.least(hi, s - 1), 1), pair("b", F.lit(0), F.greatest(lo, s), hi, 1))


def lane_budget_sweep(cases: DataFrame, lanes: list[str], ks: list[int]) -> DataFrame:
    """k, budgets of the three lanes, hits and cases for every split of every k.

    ``lanes``: columns with a case's first-positive rank, null where it has
    none. A table without cases has no split.
    """
    spark = cases.sparkSession
    first, second, third = lanes
    rows = cases.select(F.explode(F.array(*map(F.lit, ks))).alias("k"), *lanes)
    steps = rows.select("k", F.explode(F.concat(_steps(F.col("k"), *map(F.col, lanes)), F.array(F.struct(F.lit("n").alias("kind"), F.lit(0).alias("at"), F.lit(0).alias("a"), F.lit(1).cast("long").alias("d"))))).alias("_s"))
    sums = steps.groupBy("k", "_s.kind", "_s.at", "_s.a").agg(F.sum("_s.d").alias("d"))
    whole = sums.where("kind = 'n'").select("k", F.col("d").alias("cases"))  # one row for each k
    # the grid: some k * k / 2 points for each k, whatever the cases
    grid = spark.createDataFrame([(k,) for k in ks], "k int").select("k", F.explode(F.sequence(F.lit(0), "k")).alias("a"))
    grid = grid.select("k", "a", F.explode(F.sequence(F.lit(0), F.col("k") - F.col("a"))).alias("b"))
    points = [grid.select("k", F.lit(kind).alias("kind"), at.alias("at"), "a", F.lit(0).cast("long").alias("d"), F.col("b").alias("_b")) for kind, at in (("b", F.col("b")), ("t", F.col("a") + F.col("b")))]
    line = points[0].unionByName(points[1]).unionByName(sums.where("kind <> 'n'"), allowMissingColumns=True)
    along = Window.partitionBy("k", "kind", "at").orderBy("a").rangeBetween(Window.unboundedPreceding, 0)
    line = line.withColumn("d", F.sum("d").over(along)).where("_b IS NOT NULL")
    begun = line.groupBy("k", "a", F.col("_b").alias("b")).agg(F.sum("d").alias("d"))
    missed = begun.withColumn("missed", F.sum("d").over(Window.partitionBy("k", "a").orderBy("b").rowsBetween(Window.unboundedPreceding, 0)))
    return missed.join(F.broadcast(whole), "k").select("k", F.col("a").alias(first), F.col("b").alias(second), (F.col("k") - F.col("a") - F.col("b")).alias(third), (F.col("cases") - F.col("missed")).alias("hits"), "cases")


def select_lane_budgets(cases: DataFrame, lanes: list[str], ks: list[int]) -> DataFrame:
    """The split of each k with the most hits; then the least of the third lane, the most of the second, the least of the first."""
    sweep = lane_budget_sweep(cases, lanes, ks)
    first, second, third = lanes
    best = F.max_by(F.struct(*lanes, "hits", "cases"), F.struct(F.col("hits"), -F.col(third), F.col(second), -F.col(first)))
    return sweep.groupBy("k").agg(best.alias("_x")).select("k", "_x.*")

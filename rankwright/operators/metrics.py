"""Retrieval and detection metrics."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def hit_columns(rank: str, budgets: list[int], denominator: Column | None = None) -> list[Column]:
    """Hit@K counts and rates; a null rank is a miss and stays in the denominator."""
    n = F.count(F.lit(1)) if denominator is None else denominator
    out = []
    for k in budgets:
        hits = F.count_if(F.col(rank) <= k)
        out += [hits.alias(f"hit_{k}"), F.round(hits / n, 6).alias(f"rate_{k}")]
    return out


def mrr(rank: str) -> Column:
    return F.sum(F.coalesce(1.0 / F.col(rank), F.lit(0.0))) / F.count(F.lit(1))


def percentiles(rank: str, points: list[float]) -> list[Column]:
    """Exact, linear interpolation, over hits only."""
    return [F.round(F.percentile(rank, F.lit(p)), 6).alias(f"p{int(p * 100)}") for p in points]


def nearest_rank(rank: str, p: float) -> Column:
    return F.expr(f"percentile_disc({p}) WITHIN GROUP (ORDER BY {rank})")


def coverage_budgets(df: DataFrame, rank: str, shares: list[float], by: list[str] = ()) -> DataFrame:
    """Smallest rank budget that covers ceil(N * share) of all cases, else null: counts by rank and prefix sums, no list of all ranks."""
    per = df.groupBy(*by, rank).agg(F.count(F.lit(1)).alias("_n"))
    w = Window.partitionBy(*by).orderBy(F.col(rank).asc_nulls_last()).rowsBetween(Window.unboundedPreceding, 0)
    per = per.withColumn("_upto", F.sum("_n").over(w)).withColumn("_all", F.sum("_n").over(Window.partitionBy(*by)))
    cols = [
        F.min(F.when(F.col(rank).isNotNull() & (F.col("_upto") >= F.ceil(F.col("_all") * F.lit(s))), F.col(rank))).alias(f"b{int(s * 100)}")
        for s in shares
    ]
    return per.groupBy(*by).agg(*cols)


def paired(left: str, right: str, k: int) -> list[Column]:
    """Cases that one side alone hits."""
    lo, ro = F.coalesce(F.col(left) <= k, F.lit(False)), F.coalesce(F.col(right) <= k, F.lit(False))
    return [
        F.count_if(lo & ro).alias("both"), F.count_if(lo & ~ro).alias("left_only"),
        F.count_if(~lo & ro).alias("right_only"), F.count_if(~lo & ~ro).alias("neither"),
    ]


def ratio(a: Column, b: Column) -> Column:
    """a / b, 0 where b is 0."""
    return F.coalesce(F.try_divide(a, b), F.lit(0.0))


def f1_harmonic(recall: Column, precision: Column) -> Column:
    """Localization form: recall by case, precision by alarm."""
    return ratio(2 * recall * precision, recall + precision)


def f1_counts(tp: Column, fp: Column, fn: Column) -> Column:
    """Ablation form."""
    return ratio(2.0 * tp, 2.0 * tp + fp + fn)


def best_method(df: DataFrame, by: list[str], method: str, value: str, order: str) -> DataFrame:
    """Argmax; the method listed first wins ties."""
    return df.groupBy(*by).agg(F.max_by(method, F.struct(F.col(value), -F.col(order))).alias("best"))

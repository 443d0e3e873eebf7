"""Rankings over partitions: total orders, fusion, lanes, folds."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from rankwright.session import cut

#: Scores are compared at so many decimals, so that every engine orders near-ties alike.
SCORE_DIGITS = 9


def order_key(score: str | Column) -> Column:
    """A score as it is compared: rounded, NaN below everything."""
    c = F.col(score) if isinstance(score, str) else score
    return F.round(F.nanvl(c, F.lit(-1e308)), SCORE_DIGITS)


def rank(df: DataFrame, by: list[str], score: str, tie: str, out: str = "rn", tie_desc: bool = False) -> DataFrame:
    """Row number by score descending, ties by id ascending (or descending)."""
    t = F.col(tie).desc() if tie_desc else F.col(tie).asc()
    return df.withColumn(out, F.row_number().over(Window.partitionBy(*by).orderBy(order_key(score).desc(), t)))


def top_k(df: DataFrame, by: list[str], score: str, tie: str, k: int, out: str = "rn") -> DataFrame:
    """The first k of every partition; the group limit cuts before the shuffle."""
    return rank(df, by, score, tie, out).where(F.col(out) <= k)


def first_positive(df: DataFrame, by: list[str], rn: str, positive: str, tie: str, score: str) -> DataFrame:
    """Smallest rank of a positive row, with its id and score; null without one."""
    hit = F.when(F.col(positive), F.struct(rn, tie, score))
    return df.groupBy(*by).agg(F.min(hit).alias("_f"), F.count(F.lit(1)).alias("n")).select(
        *by, F.col(f"_f.{rn}").alias("first_rank"), F.col(f"_f.{tie}").alias("first_id"), F.col(f"_f.{score}").alias("first_score"), "n"
    )


def normalized_rank(rn: Column, n: Column) -> Column:
    return (rn - 1) / F.greatest(n - 1, F.lit(1))


def zscore(df: DataFrame, by: list[str], score: str, out: str) -> DataFrame:
    """Population z-score over a partition; zeros where it does not vary."""
    w = Window.partitionBy(*by)
    sd = F.stddev_pop(score).over(w)
    return df.withColumn(out, F.when(sd <= 1e-12, 0.0).otherwise((F.col(score) - F.avg(score).over(w)) / sd))


def rrf(*ranks: Column, k: int = 60) -> Column:
    """Reciprocal-rank fusion of ranks that every row has."""
    out = F.lit(0.0)
    for r in ranks:
        out = out + F.lit(1.0) / (F.lit(k) + r)
    return out


def weighted_rrf(left: DataFrame, right: DataFrame, case: str, key: str, pos: str, weights=(1.5, 1.0), k: int = 60, cap: int | None = None) -> DataFrame:
    """Union of two ranked lists by key: a capped source counts by array position, a later duplicate of a key wins,
    equal scores keep the order of first appearance, left list before right."""
    def side(df: DataFrame, name: str) -> DataFrame:
        df = df.where(F.col(pos) <= cap) if cap else df
        return df.groupBy(case, key).agg(F.max(pos).alias(f"{name}_rank"), F.min(pos).alias(f"_{name}_at"))

    both = side(left, "left").join(side(right, "right"), [case, key], "full_outer")
    part = lambda n, w: F.coalesce(F.lit(w) / (F.lit(k) + F.col(f"{n}_rank")), F.lit(0.0))
    both = both.withColumn("score", part("left", weights[0]) + part("right", weights[1]))
    w = Window.partitionBy(case).orderBy(order_key("score").desc(), F.col("_left_at").asc_nulls_last(), F.col("_right_at").asc_nulls_last())
    return both.withColumn("rank", F.row_number().over(w)).drop("_left_at", "_right_at")


def lane_queue(lanes: DataFrame, case: str, key: str, lane: str, rn: str, budgets: dict[int, int]) -> DataFrame:
    """Budget_i first rows of each lane in order, repeats of a key dropped, numbered anew."""
    ok = F.lit(False)
    for k, n in budgets.items():
        ok = ok | ((F.col(lane) == k) & (F.col(rn) <= n))
    first = lanes.where(ok).groupBy(case, key).agg(F.min(F.struct(lane, rn)).alias("_at"))
    w = Window.partitionBy(case).orderBy("_at")
    return first.select(case, key, F.col(f"_at.{lane}").alias(lane), F.row_number().over(w).alias("queue_rank"))


def keep_last(df: DataFrame, key: list[str], order: str) -> DataFrame:
    """Ledger fold: the row of the largest ``order`` for each key."""
    rest = [c for c in df.columns if c not in key]
    return df.groupBy(*key).agg(F.max_by(F.struct(*rest), order).alias("_r")).select(*key, "_r.*")


def keep_first(df: DataFrame, key: list[str], order: str) -> DataFrame:
    rest = [c for c in df.columns if c not in key]
    return df.groupBy(*key).agg(F.min_by(F.struct(*rest), order).alias("_r")).select(*key, "_r.*")


def chunk_index(df: DataFrame, by: list[str], order: str, size: int) -> DataFrame:
    """Fixed-size groups in order, numbered from 1."""
    n = F.row_number().over(Window.partitionBy(*by).orderBy(order))
    return df.withColumn("chunk", (F.floor((n - 1) / size) + 1).cast("long"))


def hash_order(df: DataFrame, by: list[str], parts: list[str], out: str = "rn") -> DataFrame:
    """A shuffle that is the same everywhere: by SHA-256 of a stable key."""
    return df.withColumn(out, F.row_number().over(Window.partitionBy(*by).orderBy(F.sha2(F.concat_ws("|", *parts), 256))))


def rank_delta(df: DataFrame, by: str, run: str, rn: str) -> DataFrame:
    """Previous run's rank less this one's: positive is better."""
    return df.withColumn("delta", F.lag(rn).over(Window.partitionBy(by).orderBy(run)) - F.col(rn))


def numbered(df: DataFrame, order: list[Column], out: str) -> DataFrame:
    """Row numbers from 1 in a total order over all rows, without sorting them in one task.

    Rows are range-partitioned and written; each range is numbered by itself
    and the ranges' sizes, one row each, are summed up before it.
    """
    ranged = cut(df.repartitionByRange(*order).withColumn("_range", F.spark_partition_id()), "ranged")
    sizes = ranged.groupBy("_range").agg(F.count(F.lit(1)).alias("_n"))
    before = Window.orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)  # one row a range
    sizes = sizes.select("_range", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_before"))
    nth = F.row_number().over(Window.partitionBy("_range").orderBy(*order))
    return ranged.withColumn(out, nth).join(F.broadcast(sizes), "_range").withColumn(out, F.col(out) + F.col("_before")).drop("_range", "_before")

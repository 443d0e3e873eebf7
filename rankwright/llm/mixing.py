"""Mixing sources to target weights by entropy balancing.

Every document gets a rate: how often its words are to be taken. Rates start
from one, stay as close to it as relative entropy (weighted by words) allows,
and meet the token constraints of all sources together: for each source
``sum(size * rate) = target``. The convex dual has one multiplier a source and
the document's rate is ``exp(lambda)``. Newton's method solves it: in every
iteration all documents are tilted by the multipliers so far and their tilted
tokens summed by source, which is gradient and Hessian (a document counts for
one source, so the Hessian is diagonal); it ends with the step
after every constraint is met to TOLERANCE. Rates are then rounded into whole copies: everyone gets
``floor(rate)``, and the documents that come first in the order of a hash of
doc_id get one more until the source's remaining words are spent, to within
half a document. The point where that ends is found by prefix sums over hash
ranges and, inside the one range that holds it, over documents; no task ever
gets a whole source.

Cases: a null text has size 0; a null source is a source of its own, sorted
last; rows that share a doc_id share one decision; sources without words get
target 0; an empty table gives an empty result; more columns pass untouched.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from rankwright.llm.common import attach_groups, cut, table, whole_text

WEIGHTS = (5, 2, 1)
SHARE = 1.5
CAP = 2
#: Relative error at which a constraint counts as met, and steps after which the search gives up.
TOLERANCE = 1e-9
NEWTON_STEPS = 200
#: Hash order: 52 bits of SHA-256 of the doc_id.
HASH_BITS = 52
#: Source tables up to so many rows are broadcast, larger ones join by shuffle.
BROADCAST_SOURCES = 100_000


def words(text: Column) -> Column:
    return F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]+")).cast("long")


def draw(doc_id: str = "doc_id") -> Column:
    key = F.coalesce(F.col(doc_id).cast("string"), F.lit(""))
    return F.conv(F.substring(F.sha2(key, 256), 1, 13), 16, 10).cast("long")


def targets(sources: DataFrame) -> DataFrame:
    """Add ``target``: the share by weight, capped, the excess reshared by weight.

    Sharing until none is above its cap fills sources up in the order of
    ``cap / weight``; prefix sums in that order give the level in one pass.
    ``sources`` has one row a source, with ``source_size``.
    """
    every = Window.orderBy(F.col("source").asc_nulls_last())
    w = F.element_at(F.array(*map(F.lit, WEIGHTS)), (F.pmod(F.row_number().over(every) - 1, F.lit(len(WEIGHTS))) + 1))
    sources = sources.withColumn("_w", w.cast("long")).withColumn("_cap", CAP * F.col("source_size"))
    order = Window.orderBy(F.col("_cap") / F.col("_w"), F.col("source").asc_nulls_last())
    before = order.rowsBetween(Window.unboundedPreceding, -1)
    all_rows = order.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    total = SHARE * F.sum("source_size").over(all_rows)
    left = total - F.coalesce(F.sum("_cap").over(before), F.lit(0))
    rest = F.sum("_w").over(all_rows) - F.coalesce(F.sum("_w").over(before), F.lit(0))  # a total less a prefix: linear in the sources
    sources = sources.withColumn("_full", F.col("_cap") * rest <= F.col("_w") * left)
    spent = F.coalesce(F.sum(F.when(F.col("_full"), F.col("_cap"))).over(all_rows), F.lit(0))
    level = (total - spent) / F.sum(F.when(~F.col("_full"), F.col("_w"))).over(all_rows)
    return sources.withColumn(
        "target", F.when(F.col("_full"), F.col("_cap").cast("double")).otherwise(F.col("_w") * level)
    ).drop("_w", "_cap", "_full")


def tilt(sources: DataFrame) -> DataFrame:
    """Add ``lambda`` and ``rate`` to ``sources`` (source_size, target): Newton on the dual, started from no tilt.

    With the tilted tokens ``m = source_size * exp(lambda)`` the gradient is
    ``m - target`` and the Hessian ``m``. Sources without words or target have
    no constraint and rate 0.
    """
    size, target = F.col("source_size").cast("double"), F.col("target")
    open_ = (F.col("source_size") > 0) & (target > 0)

    def step(a: Column, _: Column) -> Column:
        m = size * F.exp(a["lambda"])
        met = a["off"] <= TOLERANCE
        return F.struct(F.when(met, a["lambda"]).otherwise(a["lambda"] - 1 + target / m).alias("lambda"), F.when(met, a["off"]).otherwise(F.abs(m / target - 1)).alias("off"))

    start = F.struct(F.lit(0.0).alias("lambda"), F.lit(float("inf")).alias("off"))
    solved = F.aggregate(F.sequence(F.lit(1), F.lit(NEWTON_STEPS)), start, step)
    state = sources.withColumn("_x", F.when(open_, solved))
    failed = F.raise_error(F.concat(F.lit("a constraint is off by "), F.col("_x.off").cast("string"), F.lit(f" after {NEWTON_STEPS} steps"))).cast("double")
    state = state.withColumn("lambda", F.when(F.col("_x.off") <= TOLERANCE, F.round("_x.lambda", 12)).when(open_, failed)).drop("_x")
    return state.withColumn("rate", F.coalesce(F.exp("lambda"), F.lit(0.0)))


def _meet(rows: DataFrame, sources: DataFrame, columns: list[str], bounded: bool, total: int) -> DataFrame:
    """Rows with columns of their source: by broadcast, or, if sources are many, the large ones by broadcast and the rest by shuffle."""
    if bounded:
        part = F.broadcast(sources.select(F.col("source").alias("_s"), *columns))
        return rows.join(part, F.col("source").eqNullSafe(F.col("_s"))).drop("_s")
    key = F.struct(F.col("source"))
    part = sources.select(key.alias("_s"), "_rows", *columns)
    return attach_groups(rows.withColumn("_s", key), part, "_s", "_rows", total).drop("_s", "_rows")


def plan(docs: DataFrame) -> tuple[DataFrame, DataFrame, bool, int]:
    """Sizes of all documents; one row a source with target, rate and the rounding rule; whether sources are few; rows in all.

    A document gets ``_base`` copies, and one more if its draw is at most ``_cutoff``.
    """
    slim = cut(
        docs.select("doc_id", "source", words(whole_text()).alias("size"), draw().alias("_u")), "sizes"
    )
    total = slim.count()
    sums = cut(slim.groupBy("source").agg(F.sum("size").alias("source_size"), F.count(F.lit(1)).alias("_rows")), "sums")
    bounded = sums.count() <= BROADCAST_SOURCES
    src = cut(tilt(targets(sums)), "dual")
    src = src.withColumn("_base", F.floor(F.col("rate") + 1e-9).cast("long")).withColumn(
        "_rest", F.greatest(F.lit(0.0), F.col("target") - F.col("_base") * F.col("source_size"))
    )
    src = cut(src, "sources")
    bits = HASH_BITS - min(24, max(8, math.ceil(math.log2(total / 4096 + 1))))
    ranged = slim.withColumn("_r", F.shiftright("_u", bits))
    sums = ranged.groupBy("source", "_r").agg(F.sum("size").alias("_sum"))
    upto = Window.partitionBy("source").orderBy("_r").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    sums = sums.withColumn("_before", F.sum("_sum").over(upto) - F.col("_sum"))
    edge = _meet(sums, src, ["_rest"], bounded, total).where(
        (F.col("_before") <= F.col("_rest")) & (F.col("_rest") < F.col("_before") + F.col("_sum"))
    )
    edge = edge.select(F.col("source").alias("_s"), F.col("_r").alias("_er"), "_before", "_rest")
    inside = ranged.join(
        F.broadcast(edge) if bounded else edge,
        F.col("source").eqNullSafe(F.col("_s")) & (F.col("_r") == F.col("_er")),
    )
    nth = Window.partitionBy("source", "_r").orderBy("_u").rangeBetween(Window.unboundedPreceding, Window.currentRow)
    same = Window.partitionBy("source", "_r", "_u")
    tied = F.sum("size").over(same)
    inside = inside.withColumn("_half", F.col("_before") + F.sum("size").over(nth) - tied + tied / 2)
    ends = inside.groupBy("source").agg(
        F.coalesce(
            F.max(F.when(F.col("_half") <= F.col("_rest"), F.col("_u"))),
            F.shiftleft(F.min("_r"), bits) - 1,
        ).alias("_cutoff")
    )
    ends = ends.withColumnRenamed("source", "_s2")
    src = src.join(ends, F.col("source").eqNullSafe(F.col("_s2")), "left").drop("_s2")
    return slim, cut(src.withColumn("_cutoff", F.coalesce("_cutoff", F.lit(-1).cast("long"))), "rule"), bounded, total


def copies() -> Column:
    return F.col("_base") + (F.col("_u") <= F.col("_cutoff")).cast("long")


def mix_sizes(docs: DataFrame) -> DataFrame:
    """doc_id, size, source_size, target, taken, rate and copies of every document."""
    slim, src, bounded, total = plan(docs)
    rows = _meet(slim, src, ["source_size", "target", "rate", "_base", "_cutoff"], bounded, total)
    return rows.select(
        "doc_id", "source", "size", "source_size", "target", "rate", copies().alias("copies"),
        (F.col("size") * copies()).alias("taken"),
    )


def mix(docs: DataFrame) -> DataFrame:
    """The mix: each row of ``docs`` as often as it is taken, columns as they were."""
    _, src, bounded, total = plan(docs)
    rows = docs.select(F.struct(*[docs[c] for c in docs.columns]).alias("_doc"), "source", draw().alias("_u"))
    rows = _meet(rows, src, ["_base", "_cutoff"], bounded, total).where(copies() > 0)
    return rows.select("_doc", F.explode(F.sequence(F.lit(1).cast("long"), copies()))).select("_doc.*")


def op2_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = mix_sizes(table(spark, sf_dir, "documents"))
    return rows.select("doc_id", "size", "source_size", "target", "taken")


ORACLE = r"""
WITH d AS (
  SELECT doc_id, source, CAST(len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS BIGINT) AS size,
         CAST('0x' || substr(sha256(coalesce(CAST(doc_id AS VARCHAR), '')), 1, 13) AS BIGINT) AS u
  FROM documents),
s AS (SELECT source, CAST(sum(size) AS BIGINT) AS source_size FROM d GROUP BY source),
w AS (SELECT *, [5, 2, 1][1 + (row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3] AS w, 2 * source_size AS cap FROM s),
f AS (
  SELECT *, cap * sum(w) OVER (o ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)
    <= w * (1.5e0 * sum(source_size) OVER () - coalesce(sum(cap) OVER (o ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)) AS is_full
  FROM w WINDOW o AS (ORDER BY CAST(cap AS DOUBLE) / w, source NULLS LAST)),
t AS (
  SELECT *, CASE WHEN is_full THEN CAST(cap AS DOUBLE)
    ELSE w * ((1.5e0 * sum(source_size) OVER () - coalesce(sum(cap) FILTER (is_full) OVER (), 0)) / sum(w) FILTER (NOT is_full) OVER ()) END AS target
  FROM f),
r AS (SELECT source, source_size, target,
  CASE WHEN source_size > 0 THEN CAST(floor(target / source_size + 1e-9) AS BIGINT) ELSE 0 END AS base FROM t),
c AS (
  SELECT d.*, r.source_size, r.target, r.base, greatest(0e0, r.target - r.base * r.source_size) AS rest,
    sum(size) OVER (PARTITION BY d.source ORDER BY u RANGE BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS upto,
    sum(size) OVER (PARTITION BY d.source, u) AS tied
  FROM d JOIN r ON d.source IS NOT DISTINCT FROM r.source)
SELECT doc_id, size, source_size, target,
  CAST(size * (base + CASE WHEN upto - tied + tied / 2e0 <= rest THEN 1 ELSE 0 END) AS BIGINT) AS taken
FROM c
"""

QUERIES = {"op2_mixing": op2_mixing}
SQL = {"op2_mixing": ORACLE}

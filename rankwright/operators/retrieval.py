"""BM25, exact dense similarity, centroids."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rankwright.functions.text import tokens

K1, B = 1.5, 0.75


def term_stats(docs: DataFrame, doc_id: str, text: str, corpus: list[str] = ()) -> tuple[DataFrame, DataFrame, DataFrame]:
    """tf by document, df by term, and size and mean length by corpus."""
    toks = docs.select(doc_id, *corpus, tokens(F.col(text)).alias("_t"))
    tf = toks.select(doc_id, *corpus, F.size("_t").alias("len"), F.explode("_t").alias("term"))
    tf = tf.groupBy(doc_id, *corpus, "term", "len").agg(F.count(F.lit(1)).cast("double").alias("f"))
    df = tf.groupBy(*corpus, "term").agg(F.count(F.lit(1)).cast("double").alias("df"))
    size = toks.groupBy(*corpus).agg(F.count(F.lit(1)).cast("double").alias("n"), F.avg(F.size("_t")).alias("avgdl"))
    return tf, df, size


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def l2_normalize(v: Column) -> Column:
    """Unit length; the zero vector stays zero."""
    norm = F.sqrt(dot(v, v))
    return F.when(norm == 0, F.transform(v, lambda x: x.cast("double"))).otherwise(F.transform(v, lambda x: x.cast("double") / norm))


def interpolate(q: Column, c: Column, alpha: float) -> Column:
    return l2_normalize(F.zip_with(q, c, lambda x, y: (1 - alpha) * x + alpha * y))


def centroid(df: DataFrame, by: list[str], vec: str) -> DataFrame:
    """Mean vector of a group, renormalized; the sums run by (group, position), so any group size does."""
    parts = df.select(*by, F.posexplode(vec).alias("_i", "_x")).groupBy(*by, "_i").agg(F.avg(F.col("_x").cast("double")).alias("_m"))
    mean = parts.groupBy(*by).agg(F.array_sort(F.collect_list(F.struct("_i", "_m"))).alias("_v"))
    return mean.select(*by, l2_normalize(F.transform("_v", lambda p: p["_m"])).alias("centroid"))


def cached_vectors(queries: DataFrame, cache: DataFrame, query_id: str, cache_id: str) -> DataFrame:
    """Each query with its cached vector and a state: ok, ``missing``, or ``stale`` where the fingerprint of the text differs."""
    c = cache.withColumnRenamed("fingerprint", "_f")
    rows = queries.join(c, queries[query_id] == c[cache_id], "left")
    return rows.withColumn("state", F.when(F.col(cache_id).isNull(), "missing").when(~F.col("fingerprint").eqNullSafe(F.col("_f")), "stale").otherwise("ok")).drop("_f")


def vector_state(vector: Column, fingerprint: Column, expected: Column, size: int) -> Column:
    """The first check that a cached vector fails, in this order: miss, stale, bad_shape, bad_value, bad_norm; else hit."""
    sound = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return (
        F.when(vector.isNull(), "miss").when(~fingerprint.eqNullSafe(expected), "stale").when(F.size(vector) != size, "bad_shape")
        .when(~sound, "bad_value").when(F.abs(F.sqrt(dot(vector, vector)) - 1) > 1e-4, "bad_norm").otherwise("hit")
    )


def first_hit(wanted: DataFrame, caches: list[DataFrame], key: str, expected: str, size: int) -> DataFrame:
    """Each wanted key with the vector of the first cache that has a sound one: place (from 1; null without), vector, and states of all caches in order.

    ``wanted`` (key, fingerprint expected), caches (key, fingerprint, embedding).
    The caches meet the keys in one aggregation, a row for each cache and key.
    """
    rows = wanted.select(key, F.col(expected).alias("_e"), F.lit(0).alias("_at"), F.lit(None).cast("string").alias("_f"), F.lit(None).cast("array<double>").alias("_v"))
    for at, cache in enumerate(caches, 1):
        rows = rows.unionByName(cache.select(key, F.lit(None).cast("string").alias("_e"), F.lit(at).alias("_at"), F.col("fingerprint").alias("_f"), F.col("embedding").cast("array<double>").alias("_v")))
    met = rows.groupBy(key).agg(F.max("_e").alias("_e"), F.bool_or(F.col("_at") == 0).alias("_w"), *[F.max_by(F.struct("_f", "_v"), F.when(F.col("_at") == at, F.coalesce("_f", F.lit("")))).alias(f"_c{at}") for at in range(1, len(caches) + 1)])
    states = F.array(*[vector_state(F.col(f"_c{at}._v"), F.col(f"_c{at}._f"), F.col("_e"), size) for at in range(1, len(caches) + 1)])
    met = met.where("_w").withColumn("states", states).withColumn("place", F.nullif(F.array_position("states", F.lit("hit")).cast("int"), F.lit(0)))
    vectors = F.array(*[F.col(f"_c{at}._v") for at in range(1, len(caches) + 1)])
    return met.select(key, "place", F.get(vectors, F.col("place") - 1).alias("vector"), "states")


def query_vectors(queries: DataFrame, cache: DataFrame, text: str, vector: str) -> DataFrame:
    """Queries with the unit vector of their text; a text that the cache does not hold ends the query with an error."""
    known = cache.groupBy(text).agg(F.max(vector).alias("_v"))
    guard = F.raise_error(F.concat(F.lit("no vector for the text: "), F.substring(F.coalesce(text, F.lit("null")), 1, 80))).cast("array<double>")
    return queries.join(known, text, "left").withColumn(vector, F.when(F.col("_v").isNull(), guard).otherwise(l2_normalize(F.col("_v")))).drop("_v")

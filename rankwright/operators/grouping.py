"""Group statistics: purity, entropy, mode, gates, folds of summaries."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def class_counts(df: DataFrame, by: list[str], label: str, missing: str = "missing") -> DataFrame:
    """Counts by label; a null label is a label of its own."""
    return df.groupBy(*by, F.coalesce(F.col(label), F.lit(missing)).alias(label)).agg(F.count(F.lit(1)).alias("n"))


def composition(df: DataFrame, by: list[str], label: str) -> DataFrame:
    """Purity, normalized entropy and majority label (smallest label of the highest count)."""
    c = class_counts(df, by, label)
    p = F.col("n") / F.sum("n").over(Window.partitionBy(*by))
    g = c.withColumn("_p", p).groupBy(*by).agg(
        F.max("_p").alias("purity"), (-F.sum(F.col("_p") * F.ln("_p"))).alias("_h"), F.count(F.lit(1)).alias("classes"),
        F.min_by(label, F.struct(-F.col("n"), F.col(label))).alias("majority"),
    )
    return g.withColumn("entropy", F.when(F.col("classes") <= 1, 0.0).otherwise(F.col("_h") / F.ln(F.col("classes")))).drop("_h")


def means(df: DataFrame, value: str, weight: str) -> DataFrame:
    """Macro and weighted mean over non-empty groups."""
    return df.where(F.col(weight) > 0).agg(F.avg(value).alias("macro"), (F.sum(F.col(value) * F.col(weight)) / F.sum(weight)).alias("weighted"))


def ordered_distinct(df: DataFrame, by: list[str], order: str, value: str, sep: str = "\n\n") -> DataFrame:
    """Values in first-seen order, repeats dropped, joined."""
    first = df.groupBy(*by, value).agg(F.min(order).alias("_o"))
    rows = F.array_sort(F.collect_list(F.struct("_o", value)))
    return first.groupBy(*by).agg(F.array_join(F.transform(rows, lambda x: x[value]), sep).alias(value))


def merge_count_maps(df: DataFrame, column: str) -> DataFrame:
    """Sum of count maps by key."""
    return df.select(F.explode(column).alias("key", "n")).groupBy("key").agg(F.sum("n").alias("n"))


def weighted_recombination(df: DataFrame, mean: str, count: str) -> DataFrame:
    """The mean of partial means, weighted by their counts."""
    return df.agg((F.sum(F.col(mean) * F.col(count)) / F.sum(count)).alias(mean), F.sum(count).alias(count))


def per_bucket_limit(df: DataFrame, by: list[str], order: list, n: int) -> DataFrame:
    return df.withColumn("_rn", F.row_number().over(Window.partitionBy(*by).orderBy(*order))).where(F.col("_rn") <= n).drop("_rn")


def ordered_digest(df: DataFrame, key: str, id_: str, text: str, out: str = "fingerprint") -> DataFrame:
    """SHA-256 over (id, length in bytes, bytes), each closed by NUL, of a key's rows in the order of their ids.

    A digest in order is one stream, so a key's rows pass through one task;
    they are read off a sorted partition and never held together. Null ids and
    texts are empty.
    """
    kind = dict(df.dtypes)[key]
    name = F.coalesce(F.col(id_).cast("string"), F.lit("")).alias("_id")
    rows = df.select(F.col(key).alias("_key"), F.col(id_).alias("_ord"), name, F.coalesce(F.col(text), F.lit("")).alias("_text"))
    rows = rows.repartition("_key").sortWithinPartitions("_key", F.col("_ord").asc_nulls_first(), "_text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def row(value, digest) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array([value], batch.schema.field(0).type), pa.array([digest.hexdigest()])], names=[key, out])

        now, digest = None, None
        for batch in batches:
            for value, id_value, body in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2).to_pylist()):
                if digest is None or value != now:
                    if digest is not None:
                        yield row(now, digest)
                    now, digest = value, hashlib.sha256()
                data = body.encode("utf-8", "replace")
                digest.update(b"%b\0%d\0%b\0" % (id_value.encode("utf-8", "replace"), len(data), data))
        if digest is not None:
            yield row(now, digest)

    return rows.select("_key", "_id", "_text").mapInArrow(run, f"`{key}` {kind}, {out} string")


def numeric_totals(df: DataFrame, by: list[str], value: str) -> DataFrame:
    """Count and sum of the values that are numbers; others are skipped."""
    v = F.col(value).try_cast("double")
    return df.groupBy(*by).agg(F.count(v).alias("n"), F.sum(v).alias("total"))


def call_counts(ledger: DataFrame, key: str, tokens: str, completed: Column, receipts: DataFrame) -> DataFrame:
    """Calls (all) and tokens (completed ones) of each key, and whether it has a receipt."""
    g = ledger.groupBy(key).agg(F.count(F.lit(1)).alias("calls"), F.coalesce(F.sum(F.when(completed, F.col(tokens))), F.lit(0.0)).alias("tokens"))
    return g.join(receipts.select(key).distinct().withColumn("_r", F.lit(True)), key, "left").withColumn("verified", F.col("_r").isNotNull()).drop("_r")


def progress(ledger: DataFrame, key: str, ord_: str, status: str) -> DataFrame:
    """Each key's last status, number of attempts and their history in order."""
    g = ledger.groupBy(key).agg(F.max_by(status, ord_).alias(status), F.count(F.lit(1)).alias("attempts"), F.array_sort(F.collect_list(F.struct(ord_, status))).alias("_h"))
    return g.select(key, status, "attempts", F.array_join(F.transform("_h", lambda x: x[status]), ">").alias("history"))


def method_rows(methods: dict[str, tuple[DataFrame, Column]]) -> DataFrame:
    """One row a method: cases and hits."""
    out = None
    for name, (df, hit) in methods.items():
        one = df.agg(F.lit(name).alias("method"), F.count(F.lit(1)).alias("n"), F.count_if(hit).alias("hits"))
        out = one if out is None else out.unionByName(one)
    return out

"""Sinks: JSON lines, CSV, TSV, manifests, reports."""

from __future__ import annotations

import json

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def write_jsonl(df: DataFrame, path: str, order: str | None = None, mode: str = "errorifexists") -> None:
    """Rows with sorted columns; with ``order`` one file in that order."""
    df = df.select(*sorted(df.columns)) if order is None else df.repartitionByRange(1, order).sortWithinPartitions(order).select(*sorted(df.columns))
    df.write.mode(mode).json(path)


def append_ledger(df: DataFrame, path: str) -> None:
    df.write.mode("append").json(path)


def flat(df: DataFrame, fields: list[str]) -> DataFrame:
    """Fixed field list; nested values as JSON, missing ones empty."""
    kinds = dict(df.dtypes)
    cols = []
    for f in fields:
        c = F.lit("") if f not in kinds else F.to_json(f) if kinds[f].startswith(("array", "struct", "map")) else F.col(f).cast("string")
        cols.append(F.coalesce(c, F.lit("")).alias(f))
    return df.select(*cols)


def write_csv(df: DataFrame, path: str, fields: list[str], mode: str = "errorifexists") -> None:
    flat(df, fields).write.mode(mode).option("header", True).option("emptyValue", "").csv(path)


def display(c: Column, kind: str) -> Column:
    """n/a for null, four decimals for fractions, JSON for lists, no tabs or line ends."""
    if kind in ("double", "float"):
        text = F.format_string("%.4f", c.cast("double"))
    elif kind.startswith(("array", "struct", "map")):
        text = F.to_json(c)
    else:
        text = c.cast("string")
    return F.when(c.isNull(), "n/a").otherwise(F.regexp_replace(text, r"[\t\r\n]+", " "))


def write_tsv(df: DataFrame, path: str, fields: list[str], mode: str = "errorifexists") -> None:
    kinds = dict(df.dtypes)
    df.select(*[display(F.col(f), kinds[f]).alias(f) for f in fields]).write.mode(mode).option("header", True).option("sep", "\t").option("quote", "").csv(path)


def write_vectors(df: DataFrame, path: str, by: str) -> None:
    """A vector table by repository; only the partitions written are replaced, at commit."""
    df.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(by).parquet(path)


def manifest(spark: SparkSession, root: str) -> DataFrame:
    """path, bytes, sha256 of every file below root."""
    df = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(root)
    return df.select("path", F.col("length").alias("bytes"), F.sha2("content", 256).alias("sha256"))


def verify_manifest(expected: DataFrame, found: DataFrame) -> DataFrame:
    """path and problem: missing, unexpected, changed; no row where all agree."""
    e = expected.select("path", F.col("sha256").alias("_e"))
    j = e.join(found.select("path", F.col("sha256").alias("_f")), "path", "full_outer")
    problem = F.when(F.col("_f").isNull(), "missing").when(F.col("_e").isNull(), "unexpected").when(F.col("_e") != F.col("_f"), "changed")
    return j.select("path", problem.alias("problem")).where("problem IS NOT NULL")


def _small(summary: DataFrame, limit: int) -> list:
    """All rows of a summary; more than ``limit`` are an error, never a shorter report."""
    rows = summary.limit(limit + 1).collect()
    if len(rows) > limit:
        raise ValueError(f"the summary has more than {limit} rows: aggregate it further, raise the limit, or write it as a table")
    return rows


def json_document(summary: DataFrame, limit: int = 1000) -> str:
    """A summary of at most ``limit`` rows as one document with sorted keys."""
    rows = [r.asDict(recursive=True) for r in _small(summary, limit)]
    return json.dumps(rows, sort_keys=True, indent=2, default=str) + "\n"


def markdown(summary: DataFrame, title: str, limit: int = 200) -> str:
    """A summary of at most ``limit`` rows as a table."""
    rows = _small(summary, limit)
    head = summary.columns
    body = ["| " + " | ".join("n/a" if v is None else f"{v:.4f}" if isinstance(v, float) else str(v) for v in r) + " |" for r in rows]
    return "\n".join([f"# {title}", "", "| " + " | ".join(head) + " |", "|" + " --- |" * len(head), *body, ""])


def write_groups(df: DataFrame, path: str, key: str) -> None:
    df.write.mode("errorifexists").partitionBy(key).json(path)

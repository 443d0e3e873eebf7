"""Helpers shared by the operators of this subpackage."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from rankwright.session import cut, scratch, shared_folder, ship, spread, table

__all__ = ["cut", "scratch", "shared_folder", "spread", "table", "fold_ascii", "whole_text", "attach_groups", "matches", "small_batches"]

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: Groups with more than one in so many of all rows are hot: there are at most so many of them.
HOT_SHARE = 1000


def whole_text(name: str = "text") -> Column:
    """The text column, null as empty."""
    return F.coalesce(F.col(name), F.lit(""))


def fold_ascii(text: Column) -> Column:
    """Lower-case A-Z only. ASCII texts take the fast built-in."""
    return F.when(F.octet_length(text) == F.char_length(text), F.lower(text)).otherwise(
        F.translate(text, UPPER, LOWER)
    )


def attach_groups(rows: DataFrame, groups: DataFrame, key: str, size: str, total: int) -> DataFrame:
    """Inner join of rows to one row per group, safe for hot groups.

    Groups of over ``total / HOT_SHARE`` rows number at most HOT_SHARE, so
    they are broadcast and their rows stay where they are; the other groups
    are small and join by shuffle.
    """
    limit = max(1, total // HOT_SHARE)
    hot = F.broadcast(groups.where(F.col(size) > limit))
    cold = groups.where(F.col(size) <= limit)
    return rows.join(hot, key).unionByName(
        rows.join(F.broadcast(groups.where(F.col(size) > limit).select(key)), key, "left_anti").join(cold, key)
    )


#: Matches gathered before they are set aside, so that a text with n of them costs about 128 n copies and not n * n / 2.
_CHUNK = 256


def matches(text: Column, pattern: Column, item: Callable[[Column, Column, Column], Column], kind: str) -> Column:
    """All matches of a regex as an array of ``item(start, end, value)``: the gaps between matches and the matches, summed up."""
    pairs = F.arrays_zip(F.split(text, pattern, -1).alias("gap"), F.regexp_extract_all(text, pattern, F.lit(0)).alias("hit"))
    none, lists = F.array().cast(f"array<{kind}>"), F.array().cast(f"array<array<{kind}>>")

    def step(acc: Column, x: Column) -> Column:
        start = acc["at"] + F.length(x["gap"])
        end = start + F.length(x["hit"])
        full = F.size(acc["now"]) >= _CHUNK
        now = F.when(full, none).otherwise(acc["now"])
        found = F.array(item(start, end, x["hit"])).cast(f"array<{kind}>")
        return F.struct(
            F.coalesce(end, acc["at"]).alias("at"),
            F.when(full, F.concat(acc["done"], F.array(acc["now"]))).otherwise(acc["done"]).alias("done"),
            F.when(x["hit"].isNull(), now).otherwise(F.concat(now, found)).alias("now"),
        )

    start = F.struct(F.lit(0).alias("at"), lists.alias("done"), none.alias("now"))
    return F.aggregate(pairs, start, step, lambda a: F.concat(F.flatten(a["done"]), a["now"]))


def small_batches(spark: SparkSession, rows: int = 256) -> None:
    """Prepare for Python workers: ship the package, bound what a worker holds at once (texts can be long)."""
    ship(spark)
    now = int(spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch", "10000"))
    if now <= 0 or now > rows:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(rows))

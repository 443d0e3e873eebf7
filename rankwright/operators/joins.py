"""Joins with guards, statuses and audits."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def guard_unique(df: DataFrame, key: str) -> DataFrame:
    """Fail on a null, empty or repeated key when the rows are read."""
    n = F.count(F.lit(1)).over(Window.partitionBy(key))
    bad = F.col(key).isNull() | (F.col(key).cast("string") == "") | (n > 1)
    message = F.concat(F.lit(f"bad or repeated {key}: "), F.coalesce(F.col(key).cast("string"), F.lit("null")))
    return df.withColumn("_n", F.when(bad, F.raise_error(message).cast("long")).otherwise(n)).where("_n = 1").drop("_n")


def identity_join(left: DataFrame, right: DataFrame, key: str) -> DataFrame:
    """Inner join that fails unless both sides hold the same identities once each."""
    l, r = guard_unique(left, key), guard_unique(right, key)
    both = l.withColumn("_l", F.lit(True)).join(r.withColumn("_r", F.lit(True)), key, "full_outer")
    lone = F.col("_l").isNull() | F.col("_r").isNull()
    message = F.concat(F.lit(f"{key} on one side: "), F.col(key).cast("string"))
    return both.withColumn("_ok", F.when(lone, F.raise_error(message).cast("boolean")).otherwise(True)).where("_ok").drop("_l", "_r", "_ok")


def key_audit(left: DataFrame, right: DataFrame, key: str) -> DataFrame:
    """Every key once, with the side that has it: both, left_only, right_only."""
    l, r = left.select(key).distinct().withColumn("_l", F.lit(1)), right.select(key).distinct().withColumn("_r", F.lit(1))
    side = F.when(F.col("_l").isNull(), "right_only").when(F.col("_r").isNull(), "left_only").otherwise("both")
    return l.join(r, key, "full_outer").select(key, side.alias("side"))


def left_with_status(left: DataFrame, right: DataFrame, key: str, missing: str, status: str = "status") -> DataFrame:
    """Left join; a missing right row becomes a label."""
    r = right.withColumn("_m", F.lit(True))
    return left.join(r, key, "left").withColumn(status, F.when(F.col("_m").isNull(), missing).otherwise("joined")).drop("_m")


def fallback_join(left: DataFrame, right: DataFrame, keys: list[tuple[str, str]], value: str) -> DataFrame:
    """Value by the first key that hits: one equi-join a key, never an OR join."""
    out, found = left, []
    for i, (lk, rk) in enumerate(keys):
        part = right.where(F.col(rk).isNotNull()).groupBy(F.col(rk).alias(f"_k{i}")).agg(F.min(value).alias(f"_v{i}"))
        out = out.join(part, F.col(lk) == F.col(f"_k{i}"), "left").drop(f"_k{i}")
        found.append(f"_v{i}")
    return out.withColumn(value, F.coalesce(*found)).drop(*found)


def precedence(df: DataFrame, rules: list[tuple[Column, str]], default: str, out: str = "state") -> DataFrame:
    """The first rule that holds names the state."""
    c = F.when(rules[0][0], rules[0][1])
    for cond, label in rules[1:]:
        c = c.when(cond, label)
    return df.withColumn(out, c.otherwise(default))


def source_chain(sources: list[DataFrame], key: str) -> DataFrame:
    """Rows of the first source that has any for the key."""
    u = None
    for i, s in enumerate(sources):
        s = s.withColumn("_prio", F.lit(i))
        u = s if u is None else u.unionByName(s)
    return u.withColumn("_min", F.min("_prio").over(Window.partitionBy(key))).where("_prio = _min").drop("_prio", "_min")


def ambiguity(left: DataFrame, right: DataFrame, on: list[str], key: str, value: str) -> DataFrame:
    """0, 1 or more distinct matches for each left key: missing, matched, ambiguous."""
    j = left.join(right, on, "left").groupBy(key).agg(F.countDistinct(value).alias("matches"), F.min(value).alias(value))
    status = F.when(F.col("matches") == 0, "missing").when(F.col("matches") == 1, "matched").otherwise("ambiguous")
    return j.select(key, "matches", F.when(F.col("matches") == 1, F.col(value)).alias(value), status.alias("status"))


def ordered_lookup(df: DataFrame, key: str, items: str, lookup: DataFrame, on: str, value: str) -> DataFrame:
    """For each item in order, its values not seen before; one array a key."""
    j = df.select(key, F.posexplode(items).alias("_p", on)).join(lookup, on)
    first = j.groupBy(key, value).agg(F.min("_p").alias("_p"))
    return first.groupBy(key).agg(F.array_sort(F.collect_list(F.struct("_p", value))).alias("_l")).select(key, F.transform("_l", lambda x: x[value]).alias(value))


def not_exists_active(tasks: DataFrame, active: DataFrame, key: str) -> DataFrame:
    """Tasks without an active task of the same key; a null key is exempt."""
    return tasks.join(active.select(key).where(F.col(key).isNotNull()).distinct(), key, "left_anti")


def zip_rows(left: DataFrame, right: DataFrame, order: str) -> DataFrame:
    """Row i with row i by ordinal; a short right side gives nulls."""
    return left.join(right, order, "left")


def conflict_checked(df: DataFrame, key: str) -> DataFrame:
    """Key, rows, and whether all rows of the key say the same."""
    rest = F.struct(*[c for c in df.columns if c != key])
    return df.groupBy(key).agg(F.count(F.lit(1)).alias("n"), (F.countDistinct(F.sha2(F.to_json(rest), 256)) == 1).alias("consistent"))


def flips(left: DataFrame, right: DataFrame, key: str, outcome: str) -> DataFrame:
    """Transitions of an outcome between two runs, counted."""
    l, r = left.select(key, F.col(outcome).alias("_a")), right.select(key, F.col(outcome).alias("_b"))
    j = l.join(r, key, "full_outer")
    t = F.concat(F.coalesce(F.col("_a"), F.lit("absent")), F.lit("->"), F.coalesce(F.col("_b"), F.lit("absent")))
    return j.groupBy(t.alias("transition")).agg(F.count(F.lit(1)).alias("n"))


def reference_match(cand: DataFrame, ref: DataFrame, key: str, fields: list[str]) -> DataFrame:
    """Whether the candidate of each reference agrees on every field, null-safely."""
    r = ref.select(key, *[F.col(f).alias(f"_{f}") for f in fields])
    same = F.lit(True)
    for f in fields:
        same = same & F.col(f).eqNullSafe(F.col(f"_{f}"))
    return r.join(cand, key, "left").select(key, same.alias("matches"))

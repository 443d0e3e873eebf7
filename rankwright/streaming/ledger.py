"""Ledgers and queues as streams and as tables."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from rankwright.session import ship

#: Transitions a task may take.
MOVES = {
    "queued": ["running", "cancelled"], "running": ["verifying", "failed", "queued"],
    "verifying": ["succeeded", "failed", "queued"], "failed": [], "succeeded": [], "cancelled": [],
}
#: Marker files by precedence.
MARKERS = ["done", "failed", "timeout", "skipped"]


def upsert_stream(stream: DataFrame, path: str, key: str, order: str, checkpoint: str):
    """Append the last row of each key of every batch of a ledger stream; the batch number makes a replayed batch overwrite itself."""
    def save(batch: DataFrame, number: int) -> None:
        _last(batch, key, order).write.mode("overwrite").parquet(f"{path}/batch={number}")

    return stream.writeStream.foreachBatch(save).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def folded(spark: SparkSession, path: str, key: str, order: str) -> DataFrame:
    """The ledger as it stands: last row of each key."""
    return _last(spark.read.parquet(path).drop("batch"), key, order)


def compact(spark: SparkSession, path: str, into: str, key: str, order: str) -> None:
    """The ledger as one batch of a fresh folder, for when its batches have become many; the old one stays until it is dropped."""
    folded(spark, path, key, order).write.mode("errorifexists").parquet(f"{into}/batch=-1")


def _last(df: DataFrame, key: str, order: str) -> DataFrame:
    rest = [c for c in df.columns if c != key]
    return df.groupBy(key).agg(F.max_by(F.struct(*rest), order).alias("_r")).select(key, "_r.*")


def pending(work: DataFrame, done: DataFrame, key: str) -> DataFrame:
    """Work not completed yet: what a resumed run has left."""
    return work.join(done.select(key).distinct(), key, "left_anti")


def windowed_counts(stream: DataFrame, at: str, kind: str, late: str = "10 minutes", width: str = "5 minutes") -> DataFrame:
    """Events by kind in tumbling windows with a watermark."""
    return stream.withWatermark(at, late).groupBy(F.window(at, width), kind).agg(F.count(F.lit(1)).alias("n"))


def token_totals(events: DataFrame, session: str, tokens: str) -> DataFrame:
    """Running sums by session, batch or stream (update mode)."""
    return events.groupBy(session).agg(F.sum(F.coalesce(F.col(tokens), F.lit(0.0))).alias("tokens"), F.count(F.lit(1)).alias("events"))


def attempt_index(events: DataFrame, task: str, order: str) -> DataFrame:
    """1, 2, ... within a task, in event order."""
    return events.withColumn("attempt", F.row_number().over(Window.partitionBy(task).orderBy(order)))


def task_states(events: DataFrame, task: str, order: str, status: str) -> DataFrame:
    """Last status of each task, its number of events and of moves that the state machine does not allow."""
    w = Window.partitionBy(task).orderBy(order)
    allowed = F.lit(False)
    for a, bs in MOVES.items():
        for b in bs:
            allowed = allowed | ((F.col("_p") == a) & (F.col(status) == b))
    rows = events.withColumn("_p", F.lag(status).over(w)).withColumn("_bad", F.col("_p").isNotNull() & ~allowed)
    return rows.groupBy(task).agg(F.max_by(status, order).alias("state"), F.count(F.lit(1)).alias("events"), F.count_if("_bad").alias("violations"))


def expired_leases(events: DataFrame, task: str, at: str, lease_seconds: float) -> DataFrame:
    """Heartbeats that came after the lease had run out: task, at, late by seconds."""
    micros = lambda c: F.unix_micros(c.cast("timestamp"))
    gap = micros(F.col(at)) - micros(F.lag(at).over(Window.partitionBy(task).orderBy(at)))
    return events.withColumn("late", gap / 1e6 - lease_seconds).where("late > 0")


def next_claim(tasks: DataFrame, now: Column) -> DataFrame:
    """The task to take: queued or with an expired lease, no running task of its project, by priority, age, id."""
    ready = tasks.where((F.col("status") == "queued") | ((F.col("status") == "running") & (F.col("lease_expires_at") < now)))
    busy = tasks.where((F.col("status") == "running") & (F.col("lease_expires_at") >= now) & F.col("project_key").isNotNull()).select("project_key").distinct()
    return ready.join(busy, "project_key", "left_anti").orderBy(F.col("priority").desc(), "created_at", "task_id").limit(1)


def release_orphans(tasks: DataFrame, alive: DataFrame, owner: str = "lease_owner") -> tuple[DataFrame, DataFrame]:
    """Tasks with a dead owner back to queued; and the events to append."""
    orphan = tasks.where("status = 'running'").join(alive, owner, "left_anti").select("task_id")
    out = tasks.join(orphan.withColumn("_o", F.lit(True)), "task_id", "left")
    back = F.col("_o").isNotNull()
    out = out.withColumn("status", F.when(back, "queued").otherwise(F.col("status"))).withColumn(owner, F.when(~back, F.col(owner))).drop("_o")
    return out, orphan.select("task_id", F.lit("released_for_retry").alias("event"))


def merge_attempts(table: DataFrame, updates: DataFrame, keys: list[str], order: str) -> DataFrame:
    """Upsert: of rows with one key, the latest; columns missing on one side are null."""
    both = table.unionByName(updates, allowMissingColumns=True)
    rest = [c for c in both.columns if c not in keys]
    return both.groupBy(*keys).agg(F.max_by(F.struct(*rest), order).alias("_r")).select(*keys, "_r.*")


def terminal_state(files: DataFrame, case: str, marker: str) -> DataFrame:
    """First marker in precedence order of each case; ``unfinished`` without one."""
    place = F.array_position(F.array(*map(F.lit, MARKERS)), F.col(marker))
    return files.groupBy(case).agg(F.coalesce(F.min_by(F.when(place > 0, F.col(marker)), F.when(place > 0, place)), F.lit("unfinished")).alias("state"))


def lease_stream(stream: DataFrame, task: str, at: str, lease_seconds: int):
    """Stateful stream: the deadline of each task's lease; a late heartbeat is reported with its lateness.

    State is one timestamp a task; events of a batch are taken in time order.
    """
    ship(stream.sparkSession)

    def run(key, batches: Iterator[pd.DataFrame], state) -> Iterator[pd.DataFrame]:
        deadline = state.get[0] if state.exists else None
        out = []
        for b in batches:
            for ts in sorted(b[at]):
                t = ts.timestamp()
                if deadline is not None and t > deadline:
                    out.append((key[0], ts, t - deadline))
                deadline = t + lease_seconds
        state.update((deadline,))
        yield pd.DataFrame(out, columns=[task, at, "late"]) if out else pd.DataFrame({task: pd.Series(dtype="int64"), at: pd.Series(dtype="datetime64[ns]"), "late": pd.Series(dtype="float64")})

    return stream.groupBy(task).applyInPandasWithState(run, f"{task} long, {at} timestamp, late double", "deadline double", "append", "NoTimeout")

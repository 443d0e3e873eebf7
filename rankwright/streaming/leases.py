"""Leases that run out by themselves, as a table and as a stream with timers.

One task of a project is active at a time. An event is a claim, a heartbeat or
a finish of a task by an owner. A claim is granted where the project has no
active task, else refused; a heartbeat of the active task's owner moves the
deadline; a finish ends it; heartbeats and finishes of others are lost. A
deadline that lies before the clock gives the task back (``queued``), with no
further event needed. The state of a project is its active task alone, however
many tasks it has.

Events of one project are taken by time, then by number. A null project is the
task's own. Null times, tasks or kinds are no events.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from rankwright.session import ship

#: What the fold tells: the task, its owner, its new state and when.
TOLD = "project string, task string, owner string, state string, at long"
_COLUMNS = ["project", "task", "owner", "state", "at"]
Active = tuple[str, str | None, int]


def expire(active: Active | None, clock: int) -> tuple[Active | None, list[tuple]]:
    """What a clock (microseconds) makes of an active task: its deadline must lie strictly before it."""
    if active and active[2] < clock:
        return None, [(active[0], active[1], "queued", active[2])]
    return active, []


def step(active: Active | None, kind: str, task: str, owner: str | None, at: int, lease: int) -> tuple[Active | None, list[tuple]]:
    """One event: the new active task, and (task, owner, state, at) of what is to tell."""
    active, told = expire(active, at)
    mine = active is not None and active[:2] == (task, owner)
    if kind == "claim":
        if active:
            return active, [*told, (task, owner, "refused", at)]
        return (task, owner, at + lease), [*told, (task, owner, "running", at)]
    if not mine:
        return active, [*told, (task, owner, "lost", at)]
    if kind == "heartbeat":
        return (task, owner, at + lease), told
    return None, [*told, (task, owner, "finished", at)]


def _events(df: DataFrame) -> DataFrame:
    """project, task, owner, kind, at (microseconds) and ord of usable events."""
    kinds = F.col("kind").isin("claim", "heartbeat", "finish")
    rows = df.where(kinds & F.col("task").isNotNull() & F.col("ts").isNotNull())
    task = F.col("task").cast("string")
    project = F.coalesce(F.concat(F.lit("p:"), F.col("project").cast("string")), F.concat(F.lit("t:"), task))
    return rows.select(project.alias("project"), task.alias("task"), F.col("owner").cast("string").alias("owner"), "kind", "ts", F.unix_micros(F.col("ts").cast("timestamp")).alias("at"), F.col("ord").cast("long").alias("ord"))


def fold_leases(events: DataFrame, lease_seconds: float, clock: int | None = None) -> DataFrame:
    """The fold of a whole table: project, task, owner, kind, ts, ord -> TOLD, with what has run out at ``clock`` (microseconds; none: nothing more).

    A project's events stream through one task in order, since each depends on
    the one before; memory is one active task.
    """
    ship(events.sparkSession)
    lease = int(lease_seconds * 1_000_000)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        project, active = None, None

        def end() -> list[tuple]:
            return [(project, *t) for t in expire(active, clock)[1]] if clock is not None else []

        for b in batches:
            out: list[tuple] = []
            for p, task, owner, kind, at in zip(b["project"], b["task"], b["owner"], b["kind"], b["at"]):
                if p != project:
                    out += end()
                    project, active = p, None
                active, told = step(active, kind, task, owner, at, lease)
                out += [(p, *t) for t in told]
            yield pd.DataFrame(out, columns=_COLUMNS)
        yield pd.DataFrame(end(), columns=_COLUMNS)

    rows = _events(events).drop("ts").repartition("project").sortWithinPartitions("project", "at", "ord")
    return rows.mapInPandas(run, TOLD)


class LeaseProcessor(StatefulProcessor):
    """The same fold on a stream: one value of state a project, and a timer at its deadline."""

    def __init__(self, lease_seconds: float) -> None:
        self.lease = int(lease_seconds * 1_000_000)

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.active = handle.getValueState("active", "task string, owner string, deadline long")

    def _held(self) -> Active | None:
        return tuple(self.active.get()) if self.active.exists() else None

    def _keep(self, before: Active | None, after: Active | None) -> None:
        """Store the active task and move the timer; a timer is due at the first millisecond after its deadline."""
        if before == after:
            return
        if before:
            self.handle.deleteTimer(before[2] // 1000 + 1)
        if after:
            self.active.update(after)
            self.handle.registerTimer(after[2] // 1000 + 1)
        else:
            self.active.clear()

    def _told(self, key, told: list[tuple]) -> pd.DataFrame:
        return pd.DataFrame([(key[0], *t) for t in told], columns=_COLUMNS).astype({"at": "int64"})

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        before = active = self._held()
        batch = pd.concat(list(rows)).sort_values(["at", "ord"], kind="stable")  # one project's events of one batch
        told = []
        for kind, task, owner, at in zip(batch["kind"], batch["task"], batch["owner"], batch["at"]):
            active, more = step(active, kind, task, None if pd.isna(owner) else owner, int(at), self.lease)
            told += more
        self._keep(before, active)
        yield self._told(key, told)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        before = self._held()
        active, told = expire(before, expiredTimerInfo.getExpiryTimeInMs() * 1000)
        if told:
            self.active.clear()
        yield self._told(key, told)

    def close(self) -> None:
        pass


def lease_stream(stream: DataFrame, lease_seconds: float, late: str = "0 seconds") -> DataFrame:
    """A stream of events -> TOLD. The clock is the watermark of ``ts``: it fires the deadlines that it has passed.

    Needs the RocksDB state store (``spark.sql.streaming.stateStore.providerClass``).
    """
    ship(stream.sparkSession)
    rows = _events(stream.withWatermark("ts", late))
    return rows.groupBy("project").transformWithStateInPandas(LeaseProcessor(lease_seconds), TOLD, "Append", "EventTime")


def lease_expirations(heartbeats: DataFrame, task: str, at: str, lease_seconds: int) -> DataFrame:
    """task, expired_at of every lease that ran out: before the next heartbeat, or before the last time of the table."""
    micros, lease = F.unix_micros(F.col(at).cast("timestamp")), int(lease_seconds * 1_000_000)
    known = heartbeats.where(F.col(at).isNotNull())
    clock = known.agg(F.max(micros).alias("_clock"))  # one row
    rows = known.select(task, micros.alias("_at")).crossJoin(F.broadcast(clock))
    then = F.coalesce(F.lead("_at").over(Window.partitionBy(task).orderBy("_at")), F.col("_clock"))
    return rows.withColumn("_then", then).where(F.col("_at") + lease < F.col("_then")).select(task, F.timestamp_micros(F.col("_at") + lease).alias("expired_at"))

"""Leases: the stream with a virtual clock, the table, and a plain fold."""

import random
from collections import defaultdict
from datetime import datetime, timedelta

import pytest

from rankwright.plans import catalog
from rankwright.session import table
from rankwright.streaming import leases

SCHEMA = "project string, task string, owner string, kind string, ts timestamp, ord long"
T0 = datetime(2024, 1, 1)
at = lambda s: T0 + timedelta(seconds=s)
micros = lambda t: round((t - datetime(1970, 1, 1)).total_seconds() * 1_000_000)


def plain(rows, lease, clock=None):
    """Second by second what each project's events say, from the statement."""
    out, projects = [], defaultdict(list)
    for project, task, owner, kind, ts, ord_ in rows:
        if task is not None and ts is not None and kind in ("claim", "heartbeat", "finish"):
            projects[f"p:{project}" if project is not None else f"t:{task}"].append((micros(ts), ord_, kind, task, owner))
    for p, events in projects.items():
        holder, deadline = None, None
        for now, _, kind, task, owner in sorted(events):
            if holder and deadline < now:
                out.append((p, *holder, "queued", deadline))
                holder = None
            if kind == "claim":
                out.append((p, task, owner, "refused" if holder else "running", now))
                if not holder:
                    holder, deadline = (task, owner), now + lease * 1_000_000
            elif holder != (task, owner):
                out.append((p, task, owner, "lost", now))
            elif kind == "heartbeat":
                deadline = now + lease * 1_000_000
            else:
                out.append((p, task, owner, "finished", now))
                holder = None
        if holder and clock is not None and deadline < clock:
            out.append((p, *holder, "queued", deadline))
    return sorted(out, key=str)


def told(rows):
    return sorted(((r.project, r.task, r.owner, r.state, r["at"]) for r in rows), key=str)


@pytest.fixture(scope="module")
def events():
    rng = random.Random(9)
    rows = [(rng.choice(["x", "y", None]), rng.choice(["a", "b", "c"]), rng.choice(["w1", "w2"]), rng.choice(["claim", "heartbeat", "heartbeat", "finish"]), at(rng.randrange(4000)), i) for i in range(400)]
    return [*rows, ("x", None, "w1", "claim", at(5), 900), ("x", "a", "w1", "claim", None, 901), ("x", "a", "w1", None, at(5), 902), ("x", "a", "w1", "sleep", at(5), 903)]


@pytest.mark.parametrize("clock", [None, 9_000])
def test_table(spark, events, clock):
    df = spark.createDataFrame(events, SCHEMA).repartition(5)
    clock = clock and micros(at(clock))
    assert told(leases.fold_leases(df, 30, clock).collect()) == plain(events, 30, clock)
    assert leases.fold_leases(df.where("ord < 0"), 30, clock).count() == 0


def test_query(spark, sf):
    rows = []
    for r in table(spark, sf, "events").collect():
        kind = {"click": "claim", "purchase": "finish", "error": "other"}.get(r.event_type, "heartbeat")
        rows.append((r.user_id if r.user_id % 11 > 0 else None, f"{r.user_id}/{r.event_id % 3}", "ab"[r.event_id % 2], kind, r.ts, r.event_id))
    assert told(catalog.queries()["lease_fold"](spark, sf).collect()) == plain(rows, 86400)


@pytest.fixture
def rocks(spark):
    name = "spark.sql.streaming.stateStore.providerClass"
    before = spark.conf.get(name)
    spark.conf.set(name, "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    yield
    spark.conf.set(name, before)


def stream(spark, folder, batches, lease):
    """Each batch is a file; what the stream has told after each of them."""
    out, heard = [], []
    source, place = folder / "in", folder / "state"
    source.mkdir()

    def keep(df, _):
        heard.extend(df.collect())

    for n, rows in enumerate(batches):
        spark.createDataFrame(rows, SCHEMA).coalesce(1).write.json(str(source / str(n)))
        events = spark.readStream.schema(SCHEMA).json(str(source / "*"))
        q = leases.lease_stream(events, lease).writeStream.foreachBatch(keep).option("checkpointLocation", str(place)).trigger(availableNow=True).start()
        q.awaitTermination()
        out.append(told(heard))
    return out


def test_deadline_fires_without_a_further_heartbeat(spark, rocks, tmp_path):
    tick = lambda s, i: [("clock", "clock", "c", "heartbeat", at(s), i)]
    batches = [
        [("x", "a", "w", "claim", at(0), 1), ("x", "b", "w", "claim", at(5), 2), ("y", "c", "w", "claim", at(0), 3)],
        [("x", "a", "w", "heartbeat", at(40), 4), *tick(55, 5)],  # y's deadline is at 60
        tick(75, 6),
        tick(99, 7),  # x was moved to 100
        tick(130, 8),
        [("x", "b", "w", "claim", at(131), 9)],
    ]
    heard = stream(spark, tmp_path, batches, 60)
    said = lambda rows: {r for r in rows if r[3] != "lost"}
    m = lambda s: micros(at(s))
    first = {("p:x", "a", "w", "running", m(0)), ("p:x", "b", "w", "refused", m(5)), ("p:y", "c", "w", "running", m(0))}
    assert said(heard[0]) == first and said(heard[1]) == first
    given_back = {("p:y", "c", "w", "queued", m(60))}
    assert said(heard[2]) == said(heard[3]) == first | given_back
    given_back |= {("p:x", "a", "w", "queued", m(100))}
    assert said(heard[4]) == first | given_back
    assert said(heard[5]) == first | given_back | {("p:x", "b", "w", "running", m(131))}


def test_stream_tells_what_the_table_tells(spark, rocks, events, tmp_path):
    rows = sorted((r for r in events if r[4] is not None), key=lambda r: (r[4], r[5]))
    cut = [0, 150, 151, 300, len(rows)]
    batches = [rows[a:b] for a, b in zip(cut, cut[1:])]
    # events of one second lie in one batch, so that none is late
    batches = [b for b in batches if b]
    for i in range(len(batches) - 1):
        while batches[i] and batches[i + 1] and batches[i][-1][4] == batches[i + 1][0][4]:
            batches[i + 1].insert(0, batches[i].pop())
    end = [("clock", "clock", "c", "heartbeat", at(9_000), 5000)]
    heard = stream(spark, tmp_path, [b for b in batches if b] + [end, [("clock", "clock", "c", "heartbeat", at(9_001), 5001)]], 30)
    assert [r for r in heard[-1] if r[0] != "p:clock"] == plain(rows, 30, micros(at(9_000)))

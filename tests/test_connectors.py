"""Connectors over a transport that fails, answers out of order and leaves gaps."""

import pytest

from rankwright.sources import connectors as C


def shuffled(answer):
    return lambda keys: [{"index": i, "value": answer(k)} for i, k in reversed(list(enumerate(keys)))]


def flaky(call, failures, error=C.Unavailable):
    """Fails so many times for each batch before it answers."""
    seen = {}

    def run(keys):
        n = seen[tuple(keys)] = seen.get(tuple(keys), 0) + 1
        if n <= failures:
            raise error(f"try {n}")
        return call(keys)

    return run


def test_sources_in_order_with_cached_misses(spark):
    keys = spark.createDataFrame([(f"CVE-{i}",) for i in range(40)] + [("GHSA-1",), (None,), ("CVE-3",)], "k string")
    cache = spark.createDataFrame([("CVE-0", "old", "osv"), ("CVE-1", None, "unresolved"), ("CVE-2", "x", None)], "k string, v string, origin string")
    number = lambda k: int(k.split("-")[1])
    first = C.Source("osv", flaky(shuffled(lambda k: f"a{k}" if number(k) % 3 == 0 else None), 2))
    second = C.Source("nvd", shuffled(lambda k: f"b{k}" if number(k) % 2 == 0 else None), lambda k: k.startswith("CVE-"))
    rows = C.lookup(keys, cache, "k", "v", [first, second], batch=7, tries=3, wait=0.0).collect()
    got = {r.k: (r.v, r.origin, [a.source for a in r.attempts]) for r in rows}
    assert len(rows) == len(got) == 41
    for k, row in got.items():
        if k == "CVE-0":
            assert row == ("old", "cache:osv", [])
        elif k == "CVE-2":
            assert row == ("x", "cache:unknown", [])
        elif number(k) % 3 == 0:
            assert row == (f"a{k}", "osv", ["osv"])
        elif k.startswith("CVE-") and number(k) % 2 == 0:
            assert row == (f"b{k}", "nvd", ["osv", "nvd"])
        else:
            assert row == (None, "unresolved", ["osv", "nvd"] if k.startswith("CVE-") else ["osv"])
    found = C.lookup(keys, cache, "k", "v", [first, second], batch=7, wait=0.0)
    fresh = {r.k: r.v for r in C.to_cache(found, "k", "v").collect()}
    assert "CVE-0" not in fresh and fresh["CVE-1"] is None and fresh["CVE-3"] == "aCVE-3"
    offline = {r.k: r.origin for r in C.lookup(keys, cache, "k", "v", [first], offline=True).collect()}
    assert offline["CVE-0"] == "cache:osv" and offline["CVE-1"] == offline["CVE-9"] == "unresolved"


def test_failures_by_class(spark):
    keys = spark.createDataFrame([(i,) for i in range(6)], "k long").coalesce(1)
    empty = spark.createDataFrame([], "k long, v string, origin string")
    good = shuffled(lambda k: f"v{k}")
    refused = C.Source("refused", flaky(good, 1, C.Refused))  # one refusal is final: no retry
    down = C.Source("down", flaky(good, 9))
    short = C.Source("short", lambda keys: [{"index": 0, "value": "x"}])
    rows = C.lookup(keys, empty, "k", "v", [refused, down, short, C.Source("good", good)], batch=3, wait=0.0).collect()
    assert all(r.origin == "good" and r.v == f"v{r.k}" and [(a.source, a.ok) for a in r.attempts] == [("refused", False), ("down", False), ("short", False), ("good", True)] for r in rows)


def test_encoder(spark):
    df = spark.createDataFrame([(i, None if i == 4 else "x" * i) for i in range(10)], "i int, t string").coalesce(2)
    call = flaky(lambda texts: [{"index": i, "value": [len(t), 0.0, len(t)]} for i, t in reversed(list(enumerate(texts)))], 1)
    for r in C.encode(df, "t", call, batch=3, wait=0.0).collect():
        assert r.embedding == (None if r.i == 4 else [0.0] * 3 if r.i == 0 else pytest.approx([0.5**0.5, 0.0, 0.5**0.5]))
    with pytest.raises(Exception, match="2 items for 3 keys|Refused|items for"):
        C.encode(df, "t", lambda texts: [{"index": i, "value": [1.0]} for i in range(len(texts) - 1)], batch=3).collect()

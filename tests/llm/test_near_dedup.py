"""Near-dedup against all pairs: links, recall, large buckets, long chains."""

import random
from collections import defaultdict

import numpy as np
import pytest

from rankwright.llm import graph, near_dedup
from rankwright.session import collected, table


def joined(n, links):
    up = list(range(n))

    def top(x):
        while up[x] != x:
            x = up[x]
        return x

    for a, b in links:
        up[max(top(a), top(b))] = min(top(a), top(b))
    return [top(x) for x in range(n)]


def brute(words):
    """Pairs that align at the threshold."""
    out = []
    for j in range(len(words)):
        for i in range(j):
            n = max(len(words[i]), len(words[j]))
            if n and abs(len(words[i]) - len(words[j])) <= near_dedup.allowed(n) and near_dedup.similarity(words[i], words[j]) > 0:
                out.append((i, j))
    return out


def partition(labels):
    groups = defaultdict(set)
    for k, label in labels.items():
        groups[label].add(k)
    return {frozenset(g) for g in groups.values()}


@pytest.mark.parametrize("kind", ["replaced", "deleted", "inserted"])
@pytest.mark.parametrize("n", [9, 20, 50, 100, 127, 128, 300])
@pytest.mark.parametrize("share", [0.05, 0.08, 1 / 9 + 1e-9])
def test_recall_of_scattered_edits(n, share, kind):
    """Texts within the threshold meet in a bucket; the edits are words replaced, deleted or inserted at random places, n the longer length."""
    g, hit, d = np.random.default_rng(n), 0, max(1, int(n * share))
    for _ in range(400):
        a = g.integers(0, 1 << 32, n, dtype=np.uint32)
        at = g.choice(n, d, replace=False)
        if kind == "replaced":
            b = a.copy()
            b[at] = g.integers(0, 1 << 32, d, dtype=np.uint32)
        else:
            b = np.delete(a, at)
            a, b = (a, b) if kind == "deleted" else (b, a)
        assert near_dedup.similarity(a, b) > 0
        hit += bool(np.intersect1d(near_dedup.sketch(a), near_dedup.sketch(b)).size)
    assert hit / 400 >= 0.95


@pytest.mark.parametrize("least, bar", [(0.8, 0.95), (2 / 3, 0.35)])
def test_recall_by_threshold(least, bar):
    """``least`` is a parameter of the alignment: at 2/3 a fifth of the words may differ, and about two of five such pairs become candidates."""
    g, hit = np.random.default_rng(7), 0
    d = near_dedup.allowed(200, least)
    assert d == (22 if least == 0.8 else 40)
    for _ in range(200):
        a = g.integers(0, 1 << 32, 200, dtype=np.uint32)
        b = a.copy()
        b[g.choice(200, d, replace=False)] = g.integers(0, 1 << 32, d, dtype=np.uint32)
        assert near_dedup.similarity(a, b, least) > 0
        hit += bool(np.intersect1d(near_dedup.sketch(a), near_dedup.sketch(b)).size)
    assert hit / 200 >= bar


def test_recall_on_the_documents(spark, sf):
    """Of all pairs of the table that align, at least nine in ten share a class, and every class holds together by such pairs."""
    docs = table(spark, sf, "documents")
    texts = {r.doc_id: r.text or "" for r in docs.collect()}
    ids = sorted(texts)
    words = [near_dedup.words().of(texts[i]) for i in ids]
    pairs = brute(words)
    got = {r.doc_id: r.class_id for r in near_dedup.classes(docs)[0].collect()}
    met = sum(got[ids[i]] == got[ids[j]] for i, j in pairs)
    assert len(pairs) > 20 and met >= 0.9 * len(pairs)
    label = joined(len(ids), pairs)
    for i in range(len(ids)):
        for j in range(i):
            assert got[ids[i]] != got[ids[j]] or label[i] == label[j]


@pytest.mark.parametrize("small", [0, 8])
def test_large_buckets_lose_no_link(spark, monkeypatch, small):
    """Pairs of copies under one frequent passage, and two families that meet in one member each, in blocks of a few texts."""
    monkeypatch.setattr(near_dedup, "SMALL", small)
    monkeypatch.setattr(near_dedup, "BLOCK", 7)
    r = random.Random(11)
    passage = [f"p{i}" for i in range(150)]
    rows = []
    for k in range(40):
        own = [f"o{k}x{i}" for i in range(80)]
        rows.append(" ".join(passage + own))
        for i in r.sample(range(80), 12):
            own[i] = f"e{k}x{i}"
        rows.append(" ".join(passage + own))
    drift = [f"d{i}" for i in range(100)]
    for k in range(12):
        rows.append(" ".join(drift))
        drift[8 * k : 8 * k + 8] = [f"n{k}x{i}" for i in range(8)]
    docs = spark.createDataFrame(list(enumerate(rows)), "doc_id long, text string").repartition(4)
    words = [near_dedup.words().of(t) for t in rows]
    want = joined(len(rows), brute(words))
    got = {x.doc_id: x.class_id for x in near_dedup.classes(docs)[0].collect()}
    assert len(set(want)) == 41 and partition(got) == partition(dict(enumerate(want)))


@pytest.mark.parametrize("local", [0, 5, 1 << 20])
def test_components(spark, local):
    r = random.Random(5)
    links = [(i, i + 1) for i in range(300)] + [(1000, 1000 + k) for k in range(1, 200)]
    links += [(r.randrange(2000, 2300), r.randrange(2000, 2300)) for _ in range(200)] + [(7, 7)]
    nodes = sorted({x for a, b in links if a != b for x in (a, b)})
    at = {x: k for k, x in enumerate(nodes)}
    want = joined(len(nodes), [(at[a], at[b]) for a, b in links if a != b])
    with collected() as paths:
        got = graph.components(spark.createDataFrame(links, "a long, b long"), local)
        rounds = sum("/step-" in p for p in paths)
    got = {x.node: x.label for x in got.collect()}
    assert sorted(got) == nodes and partition(got) == partition({x: want[at[x]] for x in nodes})
    assert rounds <= 24  # a path of 301 nodes in the order of ids would take 300 rounds of its neighbours' least id


def test_contraction_on_empty_links(spark):
    assert graph.components(spark.createDataFrame([], "a long, b long"), 0).count() == 0


def test_what_a_run_leaves_behind(spark, sf):
    with collected() as paths:
        near_dedup.classes(table(spark, sf, "documents"))
    assert sorted(p.rsplit("/", 1)[1].split("-")[0] for p in paths) == ["classes", "links"]


def test_hot_pivots_are_aligned_in_parts(spark, monkeypatch):
    monkeypatch.setattr(near_dedup, "SHARED", 3)
    base = [f"w{i}" for i in range(60)]
    rows = [" ".join(base[:k] + [f"x{k}"] + base[k + 1 :]) for k in range(50)]
    docs = spark.createDataFrame(list(enumerate(rows)), "doc_id long, text string").repartition(4)
    assert {r.class_id for r in near_dedup.classes(docs)[0].collect()} == {0}

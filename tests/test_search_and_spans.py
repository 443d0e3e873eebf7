"""Searches, spans, grouping and adapters against brute force."""

import hashlib
import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from rankwright.operators import grouping as G
from rankwright.operators import learned as L
from rankwright.operators import ranking as R
from rankwright.operators import search as D
from rankwright.operators import spans as P


def meets(dialect, a, b):
    (s1, e1), (s2, e2) = a, b
    if dialect == "zero":
        s1, e1, s2, e2 = (x or 0 for x in (s1, e1, s2, e2))
    elif dialect == "wildcard":
        s1, s2 = s1 or 0, s2 or 0
        e1, e2 = (s if (e or 0) <= 0 else e for s, e in ((s1, e1), (s2, e2)))
        if s1 <= 0 or s2 <= 0:
            return True
    elif None in (s1, e1, s2, e2):
        return False
    elif dialect == "repair":
        if min(s1, e1, s2, e2) <= 0:
            return False
        s1, e1, s2, e2 = min(s1, e1), max(s1, e1), min(s2, e2), max(s2, e2)
    return max(s1, s2) <= min(e1, e2)


@pytest.fixture(scope="module")
def lines():
    r = random.Random(2)
    one = lambda: r.choice([None, 0, *range(-2, 200)])
    span = lambda: (one(), one()) if r.random() < 0.4 else (x := r.randrange(1, 200), x + r.randrange(0, 150))
    cand = [(i, r.choice(["f", "g", "h", None]), *span()) for i in range(150)]
    truth = [(i, r.choice(["f", "g", "k", None]), *span()) for i in range(12)]
    return cand, truth


@pytest.mark.parametrize("dialect", ["zero", "strict", "wildcard", "repair"])
def test_overlap_join(spark, lines, dialect):
    cand, truth = lines
    c = spark.createDataFrame(cand, "id int, file string, s int, e int")
    t = spark.createDataFrame(truth, "tid int, file string, ts int, te int")
    want = {i for i, f, s, e in cand if any(f and f == g and meets(dialect, (s, e), (a, b)) for _, g, a, b in truth)}
    assert {r.id for r in P.overlap_join(c, t, ["file"], dialect).collect()} == want
    assert {r.id for r in P.overlap_join(c, t, ["file"], dialect, "left_anti").collect()} == {i for i, *_ in cand} - want


def test_closest_best_and_pairs(spark, lines):
    cand, truth = ([x for x in rows if None not in x and x[2] <= x[3]] for rows in lines)
    c = spark.createDataFrame(cand, "id int, file string, s int, e int")
    t = spark.createDataFrame(truth, "tid int, file string, ts int, te int")
    got = {r.id: (r.exact, r.closest) for r in P.closest_truth(c, t, ["file"]).collect()}
    gap = lambda s, e, a, b: 0 if max(s, a) <= min(e, b) else a - e if e < a else s - b
    want = {}
    for i, f, s, e in cand:
        if all_ := [gap(s, e, a, b) for _, g, a, b in truth if g == f]:
            want[i] = (min(all_) == 0, min(all_))
    assert got == want
    pairs = {(r.id, r.tid) for r in P.span_pairs(c, t, "file").collect()}
    want = {(i, k) for i, f, s, e in cand for k, g, a, b in truth if f == g and max(s, a) <= min(e, b)}
    assert pairs == want and P.span_pairs(c, t, "file").count() == len(want)
    got = {r.id: r.fid for r in P.best_overlap(c, t.withColumnRenamed("tid", "fid"), "file", "id").collect()}
    for i, f, s, e in cand:
        mine = [(-(min(e, b) - max(s, a) + 1), abs(s + e - a - b), b - a, k) for k, g, a, b in truth if f == g and max(s, a) <= min(e, b)]
        assert got.get(i) == (min(mine)[3] if mine else None)
    got = {r.id: r.tid for r in P.start_or_overlap(c, t, "file", "tid").collect()}
    for i, f, s, e in cand:
        mine = [k for k, g, a, b in truth if f == g and (s == a or max(s, a) <= min(e, b))]
        assert got.get(i) == (min(mine) if mine else None)


def test_bm25_in_blocks(spark, monkeypatch):
    monkeypatch.setattr(D, "BLOCK_POSTINGS", 5)
    r = random.Random(4)
    words = [f"w{i}" for i in range(30)]
    docs = [(i, " ".join(r.choices(words, k=r.randrange(0, 20))), r.choice("ab")) for i in range(60)] + [(60, None, "a"), (61, "", "c")]
    asked = [(i, " ".join(r.choices(words, k=4))) for i in range(9)] + [(9, "nothing"), (10, None)]
    d, q = spark.createDataFrame(docs, "doc int, text string, c string"), spark.createDataFrame(asked, "q int, text string")

    def brute(part):
        toks = {i: (t or "").split() for i, t, _ in part}
        mean = sum(map(len, toks.values())) / len(toks)
        out = {}
        for qi, qt in asked:
            for i, t in toks.items():
                s = 0.0
                for w in (qt or "").split():
                    n, f = sum(w in x for x in toks.values()), t.count(w)
                    if f:
                        s += math.log(1 + (len(toks) - n + 0.5) / (n + 0.5)) * f * 2.5 / (f + 1.5 * (0.25 + 0.75 * len(t) / mean))
                if s:
                    out.setdefault(qi, []).append((-round(s, 9), i))
        return {k: [i for _, i in sorted(v)] for k, v in out.items()}

    want = brute(docs)
    got = {}
    for x in D.bm25_top_k(q, "q", "text", d, "doc", "text", 3).collect():
        got.setdefault(x.q, {})[x.rn] = x.doc
    assert {k: [v[i] for i in sorted(v)] for k, v in got.items()} == {k: v[:3] for k, v in want.items()}
    assert {x.q: x.scored for x in D.bm25_scored(q, "q", "text", d, "doc", "text").collect()} == {k: len(v) for k, v in want.items()}
    got = {(x.q, x.c): x.doc for x in D.bm25_top_k(q, "q", "text", d, "doc", "text", 1, "c").collect()}
    assert got == {(k, c): v[0] for c in "abc" for k, v in brute([x for x in docs if x[2] == c] or [(0, "", c)]).items()}


def test_dense_in_blocks(spark, monkeypatch):
    monkeypatch.setattr(D, "BLOCK_VECTORS", 4)
    g = np.random.default_rng(3)
    v = g.integers(-2, 3, (50, 4)).astype(float)  # many ties and zero vectors
    label = g.integers(0, 9, 50)
    rows = spark.createDataFrame([(i, int(label[i]), v[i].tolist()) for i in range(50)], "id long, label int, vec array<double>")
    queries = rows.where("id % 5 = 0")
    norm = np.linalg.norm(v, axis=1, keepdims=True)
    u = v / np.where(norm == 0, 1, norm)
    order = {q: sorted((-round(float(u[q] @ u[i]), 9), i) for i in range(50) if i != q) for q in range(0, 50, 5)}
    got = {}
    for x in D.dense_top_k(queries, rows, 4).collect():
        got.setdefault(x.query_id, {})[x.rn] = x.cand_id
    assert {k: [x[i] for i in sorted(x)] for k, x in got.items()} == {k: [i for _, i in x[:4]] for k, x in order.items()}
    for x in D.dense_first_positive(queries, rows).collect():
        first = [k for k, (_, i) in enumerate(order[x.query_id], 1) if label[i] == label[x.query_id]]
        assert (x.first_rank, x.n) == (first[0] if first else None, 49)
    best = {i: min((-round(float(u[q] @ u[i]), 9), q) for q in order if q != i)[1] for i in range(50)}
    assert {x.cand_id: x.query_id for x in D.dense_best_query(queries, rows).collect()} == best


def test_numbered_and_digest(spark):
    df = spark.range(1000).select((F.col("id") * 7 % 13).alias("a"), "id").repartition(5)
    got = sorted((r.a, r.id, r.n) for r in R.numbered(df, [F.col("a"), F.col("id").desc()], "n").collect())
    want = sorted((i * 7 % 13, -i) for i in range(1000))
    assert sorted(got, key=lambda r: r[2]) == [(a, -i, k) for k, (a, i) in enumerate(want, 1)]
    rows = [("x", 2, "b\0é"), ("x", 1, None), ("y", None, "q"), (None, 5, ""), ("x", 10, "a")]
    got = {r.k: r.fingerprint for r in G.ordered_digest(spark.createDataFrame(rows, "k string, i long, t string"), "k", "i", "t").collect()}
    frame = lambda *parts: hashlib.sha256(b"".join(f"{i}\0{len(t.encode())}\0{t}\0".encode() for i, t in parts)).hexdigest()
    assert got == {"x": frame((1, ""), (2, "b\0é"), (10, "a")), "y": frame(("", "q")), None: frame((5, ""))}


def test_directory_groups_follow_any_member(spark):
    r = random.Random(9)
    rows = [(r.choice("ab"), "/".join(r.choices(["src", "lib", ".", "x", "y", ""], k=r.randrange(0, 5))) + "\\f.c", r.randrange(6), f"a{i}") for i in range(40)]
    rows += [("c", "p/q/r/s/1.c", 1, "s"), ("c", "p/q/r/2.c", 2, "t"), ("c", "p/q/3.c", 3, "u"), ("c", "p/z/4.c", 4, "v"), ("c", None, 9, "w")]
    df = spark.createDataFrame(rows, "c string, p string, r int, a string")
    got = {x.a: (x.c, x.group_id) for x in L.group_by_directory(df, "c", "p", "r", 3, "a").collect()}

    def parts(p):
        return [x for x in (p or "").replace("\\", "/").split("/")[:-1] if x not in ("", ".")]

    def apart(a, b):
        shared = next((k for k, (x, y) in enumerate(zip(a, b)) if x != y), min(len(a), len(b)))
        return len(a) + len(b) - 2 * shared

    for case in "abc":
        left, number = sorted((x for x in rows if x[0] == case), key=lambda x: (x[2], x[1] or "", x[3])), 0
        while left:
            number += 1
            group = [left[0]]
            left = left[1:]
            while left and len(group) < 3:
                nxt = min(left, key=lambda x: (min(apart(parts(x[1]), parts(m[1])) for m in group), x[2], x[1] or "", x[3]))
                group.append(nxt)
                left.remove(nxt)
            assert all(got[x[3]] == (case, number) for x in group)


def test_residual_adapter(spark):
    g = np.random.default_rng(1)
    w1, b1, w2, b2 = g.normal(size=(5, 8)), g.normal(size=5), g.normal(size=(8, 5)), g.normal(size=8)
    q = g.normal(size=(6, 8))
    df = spark.createDataFrame([(i, q[i].tolist()) for i in range(6)], "i int, v array<double>")
    for r in L.residual_adapter(df, "v", w1, b1, w2, b2, 0.1).collect():
        h = [sum(w1[k][j] * q[r.i][j] for j in range(8)) + b1[k] for k in range(5)]
        h = [0.5 * x * (1 + math.erf(x / math.sqrt(2))) for x in h]
        out = [q[r.i][j] + 0.1 * (sum(w2[j][k] * h[k] for k in range(5)) + b2[j]) for j in range(8)]
        norm = math.sqrt(sum(x * x for x in out))
        assert r.v == pytest.approx([x / norm for x in out])


@pytest.mark.parametrize("dialect", ["zero", "strict", "wildcard", "repair"])
def test_sweep_over_many_ranges(spark, lines, dialect, monkeypatch):
    """Bounds are carried from range to range, whatever the ranges are."""
    monkeypatch.setattr(P, "RANGE", 16)
    test_overlap_join(spark, lines, dialect)
    if dialect == "strict":
        test_closest_best_and_pairs(spark, lines)


def test_sweep_of_one_file_takes_linear_time(spark):
    """One file of distinct spans: four times as many take about four times as long, not sixteen times."""
    import time

    spent = []
    for n in (250_000, 1_000_000):
        c = spark.range(n, numPartitions=8).selectExpr("'f' AS file", "id * 3 % 900001 * 10 AS s", "id * 3 % 900001 * 10 + id % 4 AS e", "id")
        t = spark.range(n, numPartitions=8).selectExpr("'f' AS file", "id * 7 % 900007 * 10 + 5 AS ts", "id * 7 % 900007 * 10 + 6 AS te")
        began = time.perf_counter()
        assert P.closest_truth(c, t, ["file"]).where("NOT exact").count() == n
        assert P.overlap_join(c, t, ["file"]).count() == 0
        spent.append(time.perf_counter() - began)
    assert spent[1] < 8 * spent[0] + 5


def test_symbol_or_overlap(spark, lines):
    cand, truth = ([x for x in rows if None not in x and x[2] <= x[3]] for rows in lines)
    names = ["a", "b", " ", "", None]
    cand, truth = [(*x, names[x[0] % 5]) for x in cand], [(*x, names[x[0] % 4]) for x in truth]
    c = spark.createDataFrame(cand + cand[:3], "id int, file string, s int, e int, symbol string")
    t = spark.createDataFrame(truth, "tid int, file string, ts int, te int, symbol string")
    rows = P.symbol_or_overlap(c, t, "file", "symbol", "tid").collect()
    want = {}
    for i, f, s, e, name in cand:
        mine = [k for k, g, a, b, other in truth if f == g and ((name or "").strip() and name == other or max(s, a) <= min(e, b))]
        if mine:
            want[i] = min(mine)
    assert {r.id: r.tid for r in rows} == want and len(rows) == len(want) + sum(x[0] in want for x in cand[:3])

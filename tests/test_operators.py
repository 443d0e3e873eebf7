"""Operators on hand-written rows."""

import hashlib
import io
import json
import sqlite3
import tarfile
from datetime import datetime

import pytest
from pyspark.sql import functions as F

from rankwright.functions import text as X
from rankwright.operators import grouping as G
from rankwright.operators import joins as J
from rankwright.operators import metrics as M
from rankwright.operators import ranking as R
from rankwright.operators import sampling as S
from rankwright.operators import spans as P
from rankwright.sources import readers, sinks
from rankwright.streaming import ledger as E


def test_percentiles_and_mrr(spark):
    df = spark.createDataFrame([(10,), (1,), (4,), (2,), (None,)], "r int")
    got = df.agg(*M.percentiles("r", [0.5, 0.9]), M.nearest_rank("r", 0.5).alias("d")).first()
    assert (got.p50, got.p90, got.d, M.coverage_budgets(df, "r", [0.5]).first().b50) == (3.0, 8.2, 2, 4)
    two = spark.createDataFrame([(2,), (None,)], "r int").agg(*M.hit_columns("r", [1, 5]), M.mrr("r").alias("mrr")).first()
    assert (two.hit_1, two.hit_5, two.rate_5, two.mrr) == (0, 1, 0.5, 0.25)


def test_window_expectations(spark):
    docs = spark.createDataFrame([(n, "\n".join(f"l{i}" for i in range(n))) for n in (80, 81, 100, 160)] + [(0, "")], "n int, text string")
    got = {}
    for r in P.windows(docs, ["n"], "text").collect():
        got.setdefault(r.n, []).append((r.start_line, r.end_line))
    assert {k: sorted(v) for k, v in got.items()} == {80: [(1, 80)], 81: [(1, 80), (41, 81)], 100: [(1, 80), (41, 100)], 160: [(1, 80), (41, 120), (81, 160)]}


def test_lines_split_as_python(spark):
    texts = ["a\rb\r\nc\x0bd\x0ce\x1cf\x85g h\n", "", "x", "\n\n"]
    df = spark.createDataFrame([(t,) for t in texts], "t string")
    assert [r[0] for r in df.select(X.lines(F.col("t"))).collect()] == [t.splitlines() for t in texts]


@pytest.mark.parametrize("spans,want", [
    ((1, 5, 5, 9), (True, True, True, True)), ((1, 4, 5, 9), (False, False, False, False)), ((1, 4, 9, 2), (False, False, False, True)),
    ((1, 4, None, 9), (True, False, True, False)), ((0, 4, 50, 60), (False, False, True, False)), ((0, 0, None, None), (True, False, True, False)),
])
def test_span_dialects(spark, spans, want):
    df = spark.createDataFrame([spans], "s int, e int, ts int, te int")
    c = [F.col(x) for x in ("s", "e", "ts", "te")]
    assert tuple(df.select(*[P.overlaps(*c, d).alias(d) for d in ("zero", "strict", "wildcard", "repair")]).first()) == want


def test_weighted_rrf(spark):
    left = spark.createDataFrame([("c", "x", 1), ("c", "y", 2)], "case string, key string, pos int")
    right = spark.createDataFrame([("c", "z", 1), ("c", "y", 2)], "case string, key string, pos int")
    got = {r.key: r for r in R.weighted_rrf(left, right, "case", "key", "pos").collect()}
    assert got["y"]["rank"] == 1 and (got["y"].left_rank, got["y"].right_rank) == (2, 2)
    assert {r.key for r in R.weighted_rrf(left, right, "case", "key", "pos", cap=1).collect()} == {"x", "z"}


def test_nan_scores_rank_last(spark):
    df = spark.createDataFrame([("c", "a", float("nan")), ("c", "b", -5.0), ("c", "d", 1.0)], "case string, id string, s double")
    assert [r.id for r in R.rank(df, ["case"], "s", "id").orderBy("rn").collect()] == ["d", "b", "a"]


def test_guards(spark):
    ok = spark.createDataFrame([("a", 1), ("b", 2)], "k string, v int")
    assert J.identity_join(ok, ok.withColumnRenamed("v", "w"), "k").count() == 2
    for bad in ([("a", 1), ("a", 2)], [("a", 1), (None, 2)], [("a", 1), ("c", 2)]):
        with pytest.raises(Exception, match="repeated k|on one side"):
            J.identity_join(ok, spark.createDataFrame(bad, "k string, w int"), "k").collect()


def test_composition_ties(spark):
    df = spark.createDataFrame([("g", "b"), ("g", "a"), ("h", None)], "g string, label string")
    got = {r.g: r for r in G.composition(df, ["g"], "label").collect()}
    assert got["g"].majority == "a" and got["g"].purity == 0.5 and got["h"].majority == "missing" and got["h"].entropy == 0.0


def test_hash_samples(spark):
    df = spark.createDataFrame([(i,) for i in range(50)], "k int")
    for r in df.select("k", S.hash_bucket(F.col("k"), 4).alias("b"), S.ab_label(F.col("k")).alias("l")).collect():
        h = hashlib.sha256(str(r.k).encode()).hexdigest()
        assert r.b == int(h[:16], 16) % 4 and r.l == "AB"[int(h[:2], 16) % 2]
    assert S.longest_first([("a", 5), ("b", 4), ("c", 3), ("d", 1)], 2) == {"a": 0, "b": 1, "c": 1, "d": 0}


def test_suffix_join_has_no_nested_loop(spark):
    a = spark.createDataFrame([("x/src/A.java",), ("B.java",)], "p string")
    b = spark.createDataFrame([("src/A.java",), ("y/B.java",), ("A.javax",)], "q string")
    j = P.suffix_join(a, b, "p", "q")
    assert {tuple(r) for r in j.collect()} == {("x/src/A.java", "src/A.java"), ("B.java", "y/B.java")}
    assert "NestedLoop" not in j._jdf.queryExecution().toString()


def test_readers(spark, tmp_path):
    (tmp_path / "a.jsonl").write_text('{"k": "a", "v": 1}\n\n{"k": "b", "v": 2}\n')
    assert [r.k for r in readers.read_jsonl(spark, f"{tmp_path}/a.jsonl", "k string, v int").orderBy("ord").collect()] == ["a", "b"]
    assert readers.read_jsonl(spark, f"{tmp_path}/none", "k string", missing_ok=True).count() == 0
    assert [r.line_no for r in readers.read_jsonl_numbered(spark, f"{tmp_path}/a.jsonl", "k string").collect()] == [1, 3]
    (tmp_path / "bad.jsonl").write_text('{"a": 1, "a": 2}\n{"a": NaN}\n[1]\n{"a": 1}\n\n{"b": 2}\n')
    assert [r.ok for r in readers.strict_json(spark, f"{tmp_path}/bad.jsonl").orderBy("line_no").collect()] == [False, False, False, True, False, True]
    for name, body in (("l.json", '[{"k": "a"}, {"k": "b"}]'), ("e.json", '{\n "cases": [{"k": "a"}, {"k": "b"}]}'), ("n.jsonl", '{"k": "a"}\n{"k": "b"}\n')):
        (tmp_path / name).write_text(body)
        assert sorted(r.k for r in readers.read_records(spark, f"{tmp_path}/{name}", "k string").collect()) == ["a", "b"]
    (tmp_path / "c.csv").write_text("a,b\n1,\n,x\n")
    assert [tuple(r) for r in readers.read_csv_text(spark, f"{tmp_path}/c.csv", ["a", "b"]).collect()] == [("1", ""), ("", "x")]
    (tmp_path / "h.txt").write_text("A=1\nB=x=y\nA=2\n c=3\n")
    assert {r.key: r.value for r in readers.read_key_values(spark, f"{tmp_path}/h.txt").collect()} == {"A": "2", "B": "x=y"}
    loc = {"physicalLocation": {"artifactLocation": {"uri": "f"}, "region": {"startLine": 3}}}
    (tmp_path / "s.sarif").write_text(json.dumps({"runs": [{"results": [{"ruleId": "r", "locations": [loc, loc], "codeFlows": [{"threadFlows": [{"locations": [{"location": loc}]}]}]}]}]}))
    assert [(r.source, r.start, r.end) for r in readers.read_sarif(spark, f"{tmp_path}/s.sarif").collect()] == [("primary", 3, 3), ("flow", 3, 3)]


def test_archive_sqlite_tree(spark, tmp_path):
    with tarfile.open(tmp_path / "a.tar", "w") as tar:
        for name, body in (("x/keep.txt", b"hello"), ("x/skip.bin", b"no")):
            info = tarfile.TarInfo(name)
            info.size = len(body)
            tar.addfile(info, io.BytesIO(body))
    assert [(r.member, r.text) for r in readers.read_archive(spark, f"{tmp_path}/a.tar", r"\.txt$", 100).collect()] == [("x/keep.txt", "hello")]
    db = sqlite3.connect(tmp_path / "q.db")
    db.execute("CREATE TABLE t (k TEXT, v INT)")
    db.execute("INSERT INTO t VALUES ('a', 1), ('b', 2)")
    db.commit()
    db.close()
    assert [tuple(r) for r in readers.read_sqlite(spark, f"{tmp_path}/q.db", "SELECT k, v FROM t ORDER BY k", "k string, v long").collect()] == [("a", 1), ("b", 2)]
    root = tmp_path / "src"
    for f in ("a/B.JAVA", "a/c.py", "node_modules/d.py", "e.txt"):
        (root / f).parent.mkdir(parents=True, exist_ok=True)
        (root / f).write_text("x")
    assert [r.path.split("/src/")[1] for r in readers.source_tree(spark, str(root), [".java", ".py"], 10, ["node_modules"], 5).collect()] == ["a/B.JAVA", "a/c.py"]


def test_sinks(spark, tmp_path):
    df = spark.createDataFrame([("b", 0.5, [1]), (None, 0.25, None)], "k string, x double, a array<int>")
    sinks.write_csv(df, f"{tmp_path}/csv", ["k", "a", "gone"])
    assert {r[0] for r in spark.read.text(f"{tmp_path}/csv").collect()} == {"k,a,gone", "b,[1],", ",,"}
    with pytest.raises(Exception, match="already exists|PATH_ALREADY_EXISTS"):
        sinks.write_csv(df, f"{tmp_path}/csv", ["k"])
    sinks.write_tsv(df, f"{tmp_path}/tsv", ["k", "x", "a"])
    assert "n/a\t0.2500\tn/a" in [r[0] for r in spark.read.text(f"{tmp_path}/tsv").collect()]
    m = sinks.manifest(spark, f"{tmp_path}/csv")
    assert sinks.verify_manifest(m, m).count() == 0 and sinks.verify_manifest(m, m.limit(0)).count() == m.count()
    assert "| b | 0.5000 |" in sinks.markdown(df.select("k", "x"), "t")


def test_ledger_stream(spark, tmp_path):
    src = f"{tmp_path}/in"
    spark.createDataFrame([("a", 1, "queued"), ("b", 2, "running")], "k string, ord long, state string").write.parquet(src)
    for extra in ([], [("a", 3, "done")]):
        if extra:
            spark.createDataFrame(extra, "k string, ord long, state string").write.mode("append").parquet(src)
        stream = spark.readStream.schema("k string, ord long, state string").parquet(src)
        E.upsert_stream(stream, f"{tmp_path}/out", "k", "ord", f"{tmp_path}/cp").awaitTermination()
    assert {r.k: r.state for r in E.folded(spark, f"{tmp_path}/out", "k", "ord").collect()} == {"a": "done", "b": "running"}


def test_lease_stream(spark, tmp_path):
    at = lambda s: datetime(2024, 1, 1, 0, 0, s)
    spark.createDataFrame([(1, at(0)), (1, at(5)), (1, at(40)), (2, at(0))], "task long, at_ts timestamp").write.parquet(f"{tmp_path}/in")
    out = E.lease_stream(spark.readStream.schema("task long, at_ts timestamp").parquet(f"{tmp_path}/in"), "task", "at_ts", 10)
    q = out.writeStream.format("memory").queryName("leases").option("checkpointLocation", f"{tmp_path}/cp").trigger(availableNow=True).start()
    q.awaitTermination()
    assert [(r.task, r.late) for r in spark.sql("SELECT * FROM leases").collect()] == [(1, 25.0)]


def test_queue(spark):
    t = lambda h: datetime(2024, 1, 1, h)
    rows = [("a", "p", 1, "queued", None, None, t(1)), ("b", "q", 5, "queued", None, None, t(2)), ("c", "q", 9, "running", "w1", t(9), t(0)), ("d", None, 2, "running", "w2", t(3), t(0))]
    tasks = spark.createDataFrame(rows, "task_id string, project_key string, priority int, status string, lease_owner string, lease_expires_at timestamp, created_at timestamp")
    assert E.next_claim(tasks, F.lit(t(5))).first().task_id == "d"
    out, events = E.release_orphans(tasks, spark.createDataFrame([("w1",)], "lease_owner string"))
    assert {r.task_id: r.status for r in out.collect()} == {"a": "queued", "b": "queued", "c": "running", "d": "queued"} and events.count() == 1
    up = E.merge_attempts(tasks.select("task_id", "priority"), spark.createDataFrame([("a", 7, "x")], "task_id string, priority int, note string"), ["task_id"], "priority")
    assert up.where("task_id = 'a'").first().note == "x" and up.count() == 4


def test_function_extraction():
    from rankwright.operators import code

    text = 'int a(int x) {\n  if (x) { /* } */ s("}"); }\n  return 1;\n}\n// int no() {\nvoid b()\n{\n}\n'
    assert code.functions_of("x.c", text) == [("a", "function", 1, 4), ("b", "function", 6, 8)]
    assert len(code.blank_noise(text)) == len(text) and code.functions_in("") == []


def test_small_scalars(spark):
    from rankwright.functions import text as X

    rows = [("a/../b", "CWE-79 cwe_0022 CWE-79", "One. Risk here! 风险 risk。 Next risk? And risk. Last risk.", 800.0), ("../x", None, None, -800.0), ("/etc", "none", "", 0.0), ("a/b/../../..", "x", "no", 1.0), ("c:\\x", "x", "no", -2.0), ("./a\\..\\b", "x", "no", 3.0)]
    df = spark.createDataFrame(rows, "p string, c string, t string, s double")
    got = df.select(X.stays_below(df.p).alias("below"), X.cwe_numbers(df.c, df.c).alias("cwe"), X.evidence_preview(df.t, ["risk"]).alias("e"), X.log_loss(df.s, F.lit(True)).alias("l")).collect()
    assert [r.below for r in got] == [True, False, False, False, False, True]
    assert got[0].cwe == ["CWE-22", "CWE-79"] and got[1].cwe == []
    assert got[0].e == "Risk here! 风险 risk。 Next risk?" and got[2].e == "" and got[1].e is None
    assert got[0].l == 0.0 and got[1].l == 800.0 and abs(got[2].l - 0.6931471805599453) < 1e-15
    ids = df.select(X.vulnerability_ids(F.lit("x CVE-2020-12345, ghsa-aaaa-bbbb-cccc"), F.lit("cve-2020-12345 CVE-20-1"), F.lit(None).cast("string")).alias("i")).first().i
    assert ids == ["CVE-2020-12345", "GHSA-AAAA-BBBB-CCCC"]
    assert df.limit(1).select(X.numbered_snippet(F.lit("a\nbb\nccc"), F.lit(2), F.lit(3), 7).alias("x")).first().x == "2: bb\n3"


def test_summaries_are_never_cut(spark):
    from rankwright.sources import sinks

    df = spark.range(11)
    assert sinks.json_document(df, 11).count("id") == 11
    for report in (lambda: sinks.json_document(df, 10), lambda: sinks.markdown(df, "t", 10)):
        with pytest.raises(ValueError, match="more than 10 rows"):
            report()


@pytest.mark.parametrize("total", [0, 1, 7, 10, 23, 40, 99])
def test_stratified_totals(spark, total):
    from rankwright.operators import sampling as S

    rows = [(i, "a") for i in range(20)] + [(i, "b") for i in range(20, 37)] + [(i, None) for i in range(37, 40)]
    got = S.stratified(spark.createDataFrame(rows, "k int, s string"), "s", "k", "seed", total).collect()
    assert len(got) == min(total, 40) == len({r.k for r in got})
    for s, n in (("a", 20), ("b", 17), (None, 3)):
        assert abs(sum(r.s == s for r in got) - min(total, 40) * n / 40) < 1.0001


def test_forbidden_paths_of_deep_documents(spark):
    from rankwright.operators import projection as P

    deep = '{"a":' * 200 + '{"secret_key":[{"x":1,"Secret":2}]}' + "}" * 200
    rows = [(0, '{"secret":{"b":[1,{"my_secret":3}],"c":1},"z":{"secrets":0}}'), (1, deep), (2, "[" * 100_000 + "]" * 100_000), (3, "{"), (4, None)]
    got = {r.i: r.paths for r in P.forbidden_paths(spark.createDataFrame(rows, "i int, t string"), "t", ["secret"]).collect()}
    assert got[0] == ["secret", "secret.b[1].my_secret", "z.secrets"] and got[3] == got[4] == []
    assert len(got[1]) == 2 and got[1][0].endswith(".a.secret_key") and got[1][1].endswith(".a.secret_key[0].Secret")
    assert got[2] is None


def test_ledger_batches_and_compaction(spark, tmp_path):
    rows = [[("a", 1, "x"), ("a", 3, "y"), ("b", 2, "z")], [("a", 2, "late"), ("b", 9, "new")]]
    for n, batch in enumerate(rows):
        spark.createDataFrame(batch, "k string, ord int, v string").write.json(f"{tmp_path}/in/{n}")
        stream = spark.readStream.schema("k string, ord int, v string").json(f"{tmp_path}/in/*")
        E.upsert_stream(stream, f"{tmp_path}/out", "k", "ord", f"{tmp_path}/cp").awaitTermination()
    assert spark.read.parquet(f"{tmp_path}/out").count() == 4  # one row a key and batch
    E.compact(spark, f"{tmp_path}/out", f"{tmp_path}/new", "k", "ord")
    for path in ("out", "new"):
        assert {(r.k, r.ord, r.v) for r in E.folded(spark, f"{tmp_path}/{path}", "k", "ord").collect()} == {("a", 3, "y"), ("b", 9, "new")}


def test_vector_checks_in_order(spark):
    from rankwright.operators import retrieval as V

    inf, nan = float("inf"), float("nan")
    rows = [(0, "f", [0.6, 0.8]), (1, "f", None), (2, "old", [nan]), (3, "f", [1.0]), (4, "f", [1.0, inf]), (5, "f", [1.0, None]), (6, "f", [1.0, nan]), (7, "f", [1.0, 1.0]), (8, None, [0.6, 0.8]), (9, "f", [0.60005, 0.8])]
    df = spark.createDataFrame(rows, "k int, fingerprint string, embedding array<double>")
    got = [r.s for r in df.orderBy("k").select(V.vector_state(df.embedding, df.fingerprint, F.lit("f"), 2).alias("s")).collect()]
    assert got == ["hit", "miss", "stale", "bad_shape", "bad_value", "bad_value", "bad_value", "bad_norm", "stale", "hit"]
    wanted = spark.createDataFrame([(0, "f"), (3, "f"), (99, "f")], "k int, e string")
    found = {r.k: (r.place, r.vector, r.states) for r in V.first_hit(wanted, [df.where("k > 0"), df.selectExpr("k", "fingerprint", "IF(k = 3, array(0.0D, 1.0D), embedding) AS embedding")], "k", "e", 2).collect()}
    assert found == {0: (2, [0.6, 0.8], ["miss", "hit"]), 3: (2, [0.0, 1.0], ["bad_shape", "hit"]), 99: (None, None, ["miss", "miss"])}
    q = spark.createDataFrame([("a",), ("b",)], "t string")
    cache = spark.createDataFrame([("a", [3.0, 4.0])], "t string, v array<double>")
    assert V.query_vectors(q.where("t = 'a'"), cache, "t", "v").first().v == [0.6, 0.8]
    with pytest.raises(Exception, match="no vector for the text: b"):
        V.query_vectors(q, cache, "t", "v").collect()

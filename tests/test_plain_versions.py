"""Queries that SQL cannot express, against plain Python."""

import pytest

from rankwright.operators import learned as L
from rankwright.sources import readers


def test_pairwise_training_against_gradient_descent(spark):
    rows = [(i, [(i * 7 % 11) / 10 - 0.4, (i * 5 % 13) / 10 - 0.6]) for i in range(60)]
    got = L.train_pairwise(spark.createDataFrame(rows, "i int, d array<double>"), "d", 2, epochs=7)
    w = [0.0, 0.0]
    for _ in range(7):
        e = [1 / (1 + 2.718281828459045 ** sum(a * b for a, b in zip(w, d))) for _, d in rows]
        w = [w[k] + 0.5 * (sum(x * d[k] for x, (_, d) in zip(e, rows)) / len(rows) - 1e-3 * w[k]) for k in (0, 1)]
    assert got == pytest.approx(w)


def test_numbered_lines_over_splits(spark, tmp_path):
    (tmp_path / "b").mkdir()
    for name, n in (("a.txt", 4000), ("b/c.txt", 3), ("b/d.txt", 0), ("z.txt", 500)):
        (tmp_path / name).write_text("".join(f"{name} {k}\n" if k % 3 else "\n" for k in range(n)))
    before = spark.conf.get("spark.sql.files.maxPartitionBytes"), spark.conf.get("spark.sql.files.openCostInBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "4096")
    spark.conf.set("spark.sql.files.openCostInBytes", "1")
    try:
        df = readers.numbered_lines(spark, f"{tmp_path}/{{a.txt,b/*.txt,z.txt}}")
        rows = sorted(df.collect(), key=lambda r: r.ord)
        assert df.rdd.getNumPartitions() > 4
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before[0])
        spark.conf.set("spark.sql.files.openCostInBytes", before[1])
    want = [(f"{name} {k}" if k % 3 else "", k + 1) for name, n in (("a.txt", 4000), ("b/c.txt", 3), ("z.txt", 500)) for k in range(n)]
    assert [(r.value, r.line_no) for r in rows] == want and [r.ord for r in rows] == list(range(len(want)))


def test_budgets():
    assert readers.parse_budgets(" 50, 30\n30 0 ") == [30, 50]

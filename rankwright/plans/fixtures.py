"""Tables of the retrieval domain, read off the driver's tables: one list of expressions serves both engines."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from rankwright.session import table

FIXTURES: dict[str, tuple[str, list[str]]] = {
    "ranks": ("orders", [
        "o_orderkey AS identity_key", "o_orderpriority AS track", "o_orderstatus AS split",
        "CASE WHEN o_custkey % 7 = 0 THEN NULL ELSE o_custkey % 997 + 1 END AS left_rank",
        "CASE WHEN o_orderkey % 5 = 0 THEN NULL ELSE (o_orderkey * 31) % 499 + 1 END AS right_rank",
        "1000 + o_custkey % 500 AS candidate_count",
    ]),
    "anchors": ("lineitem", [
        "l_orderkey AS case_id", "concat('f', CAST(l_partkey % 7 AS VARCHAR(9))) AS file", "l_partkey % 90 + 1 AS s",
        "l_partkey % 90 + 1 + l_linenumber * 3 AS e", "l_linenumber AS pos", "l_extendedprice AS score_a", "l_quantity AS score_b",
        "concat(CAST(l_orderkey AS VARCHAR(20)), '-', CAST(l_partkey AS VARCHAR(20)), '-', CAST(l_suppkey AS VARCHAR(20)), '-', CAST(l_linenumber AS VARCHAR(9))) AS anchor_id",
        "l_returnflag = 'R' AS positive", "l_discount AS disc",
    ]),
    "truth": ("supplier", [
        "s_suppkey AS truth_id", "concat('f', CAST(s_suppkey % 7 AS VARCHAR(9))) AS tfile",
        "CASE WHEN s_nationkey = 3 THEN NULL ELSE s_suppkey % 80 + 1 END AS ts",
        "CASE WHEN s_nationkey = 5 THEN NULL ELSE s_suppkey % 80 + 1 + s_nationkey END AS te",
    ]),
    "findings": ("lineitem", [
        "l_orderkey AS case_id", "l_suppkey AS finding_id", "l_returnflag IN ('R', 'A') AS hit", "l_quantity > 25e0 AS alarm",
    ]),
    "ledger": ("events", [
        "user_id AS task_id", "event_id AS ord", "event_type AS status", "value AS tokens", "ts AS at_ts",
    ]),
    "boundaries": ("supplier", [
        "s_suppkey AS b_id", "s_nationkey AS guideline_id", "concat('b', CAST(s_suppkey AS VARCHAR(20))) AS label",
        "CASE WHEN s_suppkey % 3 = 0 THEN 'promote_boundary' WHEN s_suppkey % 3 = 1 THEN 'needs_more_evidence' ELSE 'reject_boundary' END AS decision",
        "s_acctbal AS bal", "s_suppkey * 3 AS r1", "s_suppkey * 5 + 1 AS r2", "s_suppkey * 7 + 2 AS r3",
    ]),
    "cases": ("customer", ["c_custkey AS identity", "c_nationkey AS guideline_id", "c_mktsegment AS mechanism", "c_acctbal AS bal"]),
    "groups": ("customer", [
        "c_custkey AS identity_key", "c_nationkey AS guideline_id", "c_mktsegment AS label", "c_acctbal AS weight",
    ]),
}


def fixture(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    source, exprs = FIXTURES[name]
    return table(spark, sf_dir, source).selectExpr(*exprs)


def sql(*names: str) -> str:
    """The same as a WITH list."""
    return "WITH " + ", ".join(f"{n} AS (SELECT {', '.join(FIXTURES[n][1])} FROM {FIXTURES[n][0]})" for n in names)


#: A text as a source file: a function of so many lines for each of its lines, which stands there as a comment; @ is the line's number.
BLOCK = [
    "  public static int f@(int a, String b) {", "    if (a > 0) { b = \"}{\"; } /* } */", "    run(new R() { void g@() { x('{'); } });",
    "    while (a-- > 0) { }", "    return os.path(a, b);", "  }",
]


def source_file(text: Column) -> Column:
    def block(line: Column, i: Column) -> Column:
        return F.concat(F.lit("  // "), line, F.lit("\n"), F.replace(F.lit("\n".join(BLOCK)), F.lit("@"), (i + 1).cast("string")))

    return F.concat(F.lit("class T {\n"), F.array_join(F.transform(F.split(F.coalesce(text, F.lit("")), "\n"), block), "\n"), F.lit("\n}\n"))

"""Queries over scalar functions that texts.py does not ask."""

from __future__ import annotations

from pyspark.sql import functions as F

from rankwright.functions import text as X
from rankwright.operators import code
from rankwright.operators import spans as P
from rankwright.plans.relational import _LINES
from rankwright.sources import readers
from rankwright.session import table

QUERIES, SQL = {}, {}


def query(name: str, oracle: str | None = None):
    def keep(f):
        QUERIES[name] = f
        if oracle:
            SQL[name] = oracle
        return f

    return keep


@query("symbol_leaf", "SELECT s_suppkey, CASE s_suppkey % 3 WHEN 2 THEN regexp_extract(s_name, '[^#]*$') ELSE 'run' || CAST(s_suppkey AS VARCHAR) END AS leaf FROM supplier")
def symbol_leaf(spark, d):
    k = F.col("s_suppkey").cast("string")
    names = F.array(F.concat(F.lit("a::b.run"), k, F.lit("(int, x.Y)")), F.concat(F.lit("pkg.Cls#run"), k), F.col("s_name"))
    return table(spark, d, "supplier").select("s_suppkey", X.symbol_leaf(F.get(names, (F.col("s_suppkey") % 3).cast("int"))).alias("leaf"))


@query("first_clause", r"SELECT doc_id, sha256(substr(coalesce(nullif(regexp_extract(trim(text), '(?s)^(.*?[.;:])\s', 1), ''), trim(text)), 1, 80)) AS h FROM documents")
def first_clause(spark, d):
    return table(spark, d, "documents").select("doc_id", F.sha2(X.first_clause(F.col("text"), 80), 256).alias("h"))


@query("file_line_pairs", "SELECT s_suppkey, 'src/a_' || CAST(s_suppkey AS VARCHAR) || '.py:' || CAST(s_suppkey + 4 AS VARCHAR) || '|lib.js:7' AS pairs FROM supplier")
def file_line_pairs(spark, d):
    k = F.col("s_suppkey").cast("string")
    one = F.concat(F.lit("src/a_"), k, F.lit(".py:"), (F.col("s_suppkey") + 4).cast("string"))
    text = F.concat(F.lit("see "), one, F.lit(" then lib.js:7, "), one, F.lit(" and http://x:80 or plain.txt"))
    return table(spark, d, "supplier").select("s_suppkey", F.array_join(X.file_lines(text), "|").alias("pairs"))


@query("json_in_prose", """SELECT s_suppkey, CASE s_suppkey % 3 WHEN 0 THEN '{"a": {"b": ' || CAST(s_suppkey AS VARCHAR) || '}}' WHEN 1 THEN NULL ELSE '{"s": "} {"}' END AS found FROM supplier""")
def json_in_prose(spark, d):
    forms = F.array(
        F.concat(F.lit('well {not json} then {"a": {"b": '), F.col("s_suppkey").cast("string"), F.lit("}} and {\"c\": 1}")), F.lit('none {here: } [1, 2] {"open": 1'), F.lit('x {"s": "} {"} y'))
    rows = table(spark, d, "supplier").select("s_suppkey", F.get(forms, (F.col("s_suppkey") % 3).cast("int")).alias("t"))
    return code.brace_json(rows, "t", "found").select("s_suppkey", "found")


@query("fenced_json", """SELECT s_suppkey, CASE s_suppkey % 3 WHEN 0 THEN '{"a":1}' WHEN 1 THEN '{"k":' || CAST(s_suppkey AS VARCHAR) || '}' END AS found FROM supplier""")
def fenced(spark, d):
    forms = F.array(F.lit('so:\n```json\n{"a":1}\n```\nand ```{"b":2}```'), F.concat(F.lit(' {"k":'), F.col("s_suppkey").cast("string"), F.lit("} ")), F.lit("no object"))
    return table(spark, d, "supplier").select("s_suppkey", X.fenced_json(F.get(forms, (F.col("s_suppkey") % 3).cast("int"))).alias("found"))


@query("numbered_snippet", _LINES + " SELECT doc_id, sha256(array_to_string(list_transform(l[2:4], lambda x, i: CAST(i + 1 AS VARCHAR) || ': ' || x), chr(10))) AS h FROM l")
def snippet(spark, d):
    t = table(spark, d, "documents").where("text <> ''")
    return t.select("doc_id", F.sha2(X.numbered_snippet(F.col("text"), F.lit(2), F.lit(4)), 256).alias("h"))


@query("filled_line_windows", _LINES + """, b AS (SELECT doc_id, CAST(s + 1 AS INTEGER) AS start_line, CAST(least(s + 8, len(l)) AS INTEGER) AS end_line, regexp_replace(array_to_string(l[s + 1:s + 8], chr(10)), '^[ \\t\\n\\r\\f\\x0b]+|[ \\t\\n\\r\\f\\x0b]+$', '', 'g') AS body FROM w WHERE s = 0 OR s + 4 < len(l))
SELECT doc_id, start_line, end_line, sha256(body) AS body FROM b WHERE body <> ''""")
def filled(spark, d):
    return P.filled_windows(table(spark, d, "documents"), ["doc_id"], "text", 8, 4).withColumn("body", F.sha2("body", 256))


@query("canonical_row_hash", """SELECT c_custkey, sha256('{"c_custkey":' || CAST(c_custkey AS VARCHAR) || ',"c_name":"' || c_name || '","c_nationkey":' || CAST(c_nationkey AS VARCHAR) || '}') AS h FROM customer""")
def row_hash(spark, d):
    c = table(spark, d, "customer")
    return c.select("c_custkey", X.canonical_hash(c_nationkey=F.col("c_nationkey"), c_name=F.col("c_name"), c_custkey=F.col("c_custkey")).alias("h"))


@query("guideline_sidecar", "SELECT key, min(text) AS text, count(DISTINCT text) > 1 AS conflict FROM (SELECT coalesce(CASE WHEN c_custkey % 3 > 0 THEN c_name END, c_mktsegment) AS key, CAST(c_nationkey AS VARCHAR) AS text FROM customer) GROUP BY key")
def sidecar(spark, d):
    c = table(spark, d, "customer").select(F.when(F.col("c_custkey") % 3 > 0, F.col("c_name")).otherwise("").alias("identity"), F.col("c_mktsegment").alias("case_id"), F.col("c_nationkey").cast("string").alias("text"))
    return readers.read_sidecar(c, ["identity", "case_id"], "text")

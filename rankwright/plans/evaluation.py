"""Queries over selection, array projections, grid search and lookups."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from rankwright.operators import code
from rankwright.operators import grid as grids
from rankwright.operators import grouping as G
from rankwright.operators import joins as J
from rankwright.operators import ranking as R
from rankwright.operators import spans as P
from rankwright.plans.fixtures import BLOCK, fixture, source_file, sql
from rankwright.session import table

QUERIES, SQL = {}, {}


def query(name: str, oracle: str | None = None):
    def keep(f):
        QUERIES[name] = f
        if oracle:
            SQL[name] = oracle
        return f

    return keep


_A, _R, _G = sql("anchors"), sql("ranks"), sql("groups")


def _nested(spark, d):
    """One row a case with its anchors as an array, in position order."""
    item = F.struct("pos", "anchor_id", "file", "s", "e", "positive")
    a = fixture(spark, d, "anchors").groupBy("case_id").agg(F.array_sort(F.collect_list(item)).alias("top"))
    return a


_RN = "row_number() OVER (PARTITION BY case_id ORDER BY pos, anchor_id)"


@query("topk_projection_by_position", _A + f" SELECT case_id, anchor_id, CAST(rn AS INTEGER) AS rank FROM (SELECT *, {_RN} AS rn FROM anchors) WHERE rn <= 3")
def topk_projection(spark, d):
    top = F.transform(F.slice("top", 1, 3), lambda x, i: F.struct(x["anchor_id"].alias("anchor_id"), (i + 1).alias("rank")))
    return _nested(spark, d).select("case_id", F.explode(top).alias("x")).select("case_id", "x.anchor_id", "x.rank")


@query("pick_element_by_rank", _A + f" SELECT case_id, max(CASE WHEN rn = 2 THEN anchor_id END) AS second FROM (SELECT *, {_RN} AS rn FROM anchors) GROUP BY case_id")
def pick_element(spark, d):
    return _nested(spark, d).select("case_id", F.get("top", F.lit(1))["anchor_id"].alias("second"))


@query("best_rank_of_overlapping", _A + f" SELECT case_id, min(rn) FILTER (positive) AS best FROM (SELECT *, {_RN} AS rn FROM anchors) GROUP BY case_id")
def best_rank(spark, d):
    ranked = F.transform("top", lambda x, i: F.when(x["positive"], (i + 1).cast("long")))
    return _nested(spark, d).select("case_id", F.array_min(ranked).alias("best"))


@query("exported_candidate_summary", _A + f""" SELECT case_id, count(*) AS n, count(*) FILTER (positive) AS overlaps, CASE WHEN count(*) = 0 THEN NULL ELSE coalesce(min(rn) FILTER (positive) <= 2, false) END AS within
FROM (SELECT *, {_RN} AS rn FROM anchors) GROUP BY case_id""")
def exported(spark, d):
    hit = F.transform("top", lambda x, i: F.when(x["positive"], i + 1))
    within = F.when(F.size("top") > 0, F.coalesce(F.array_min(hit) <= 2, F.lit(False)))
    return _nested(spark, d).select("case_id", F.size("top").cast("long").alias("n"), F.size(F.filter("top", lambda x: x["positive"])).cast("long").alias("overlaps"), within.alias("within"))


@query("rank_independent_order", _A + " SELECT case_id, sha256(string_agg(anchor_id, ',' ORDER BY file, s, e, anchor_id)) AS h FROM anchors GROUP BY case_id")
def rank_free(spark, d):
    plain = F.array_sort(F.transform("top", lambda x: F.struct(x["file"].alias("file"), x["s"].alias("s"), x["e"].alias("e"), x["anchor_id"].alias("anchor_id"))))
    return _nested(spark, d).select("case_id", F.sha2(F.array_join(F.transform(plain, lambda x: x["anchor_id"]), ","), 256).alias("h"))


@query("order_by_external_list", "SELECT c_custkey, row_number() OVER (ORDER BY o NULLS LAST, c_custkey) AS pos FROM customer LEFT JOIN (SELECT o_custkey AS c_custkey, min(o_orderkey) AS o FROM orders GROUP BY 1) USING (c_custkey)")
def external_order(spark, d):
    o = table(spark, d, "orders").groupBy(F.col("o_custkey").alias("c_custkey")).agg(F.min("o_orderkey").alias("o"))
    c = table(spark, d, "customer").select("c_custkey").join(o, "c_custkey", "left")
    return R.numbered(c, [F.asc_nulls_last("o"), F.col("c_custkey")], "pos").select("c_custkey", "pos")


@query("exploded_item_counts", "SELECT item, count(*) AS n FROM (SELECT unnest([o_orderstatus, o_orderpriority]) AS item FROM orders) GROUP BY 1")
def item_counts(spark, d):
    return table(spark, d, "orders").select(F.explode(F.array("o_orderstatus", "o_orderpriority")).alias("item")).groupBy("item").agg(F.count(F.lit(1)).alias("n"))


@query("grid_search_weights", _R + """, g AS (SELECT a / 10e0 AS alpha FROM range(0, 11) t(a)),
s AS (SELECT track, alpha, count(*) FILTER (alpha / coalesce(left_rank, 1000000) + (1 - alpha) / coalesce(right_rank, 1000000) >= 0.005) AS hits FROM ranks, g GROUP BY ALL)
SELECT track, max(hits) AS hits, arg_max(alpha, hits * 100 - alpha) AS alpha FROM s GROUP BY track""")
def grid(spark, d):
    g = spark.range(11).select((F.col("id") / 10).alias("alpha"))
    s = fixture(spark, d, "ranks").crossJoin(F.broadcast(g))  # eleven settings
    part = lambda w, r: w / F.coalesce(F.col(r), F.lit(1000000))
    ok = part(F.col("alpha"), "left_rank") + part(1 - F.col("alpha"), "right_rank") >= 0.005
    s = s.groupBy("track", "alpha").agg(F.count_if(ok).alias("hits"))
    return s.groupBy("track").agg(F.max("hits").alias("hits"), F.max_by("alpha", F.struct("hits", -F.col("alpha"))).alias("alpha"))


_LANES = """WITH x AS (SELECT CASE WHEN o_custkey % 7 = 0 THEN NULL ELSE o_custkey % 83 + 1 END AS bm25, CASE WHEN o_orderkey % 5 = 0 THEN NULL ELSE (o_orderkey * 31) % 67 + 1 END AS embedding,
CASE WHEN o_orderstatus = 'F' THEN NULL ELSE (o_orderkey * 17) % 41 + 1 END AS residual FROM orders), r AS (SELECT bm25 AS x, embedding AS y, residual AS z, count(*) AS n FROM x GROUP BY ALL),
t AS (SELECT k, b AS bm25, e AS embedding, k - b - e AS residual FROM (SELECT unnest([1, 10, 40]) AS k), range(0, 41) a(b), range(0, 41) c(e) WHERE b + e <= k),
s AS (SELECT k, bm25, embedding, residual, CAST(coalesce(sum(n) FILTER (x <= bm25 OR y <= embedding OR z <= residual), 0) AS BIGINT) AS hits, CAST(sum(n) AS BIGINT) AS cases FROM t, r GROUP BY ALL) """


def _lanes(spark, d):
    return table(spark, d, "orders").selectExpr(
        "CASE WHEN o_custkey % 7 = 0 THEN NULL ELSE o_custkey % 83 + 1 END AS bm25", "CASE WHEN o_orderkey % 5 = 0 THEN NULL ELSE (o_orderkey * 31) % 67 + 1 END AS embedding",
        "CASE WHEN o_orderstatus = 'F' THEN NULL ELSE (o_orderkey * 17) % 41 + 1 END AS residual")


@query("lane_budget_sweep", _LANES + "SELECT k, bm25, embedding, residual, hits, cases FROM s")
def lane_sweep(spark, d):
    return grids.lane_budget_sweep(_lanes(spark, d), ["bm25", "embedding", "residual"], [1, 10, 40])


@query("lane_budget_grid", _LANES + "SELECT k, bm25, embedding, residual, hits, cases FROM (SELECT *, row_number() OVER (PARTITION BY k ORDER BY hits DESC, residual, embedding DESC, bm25) AS rn FROM s) WHERE rn = 1")
def lane_grid(spark, d):
    return grids.select_lane_budgets(_lanes(spark, d), ["bm25", "embedding", "residual"], [1, 10, 40])


@query("disjunctive_match_join", sql("anchors", "truth") + """ SELECT anchor_id, min(truth_id) AS truth_id FROM anchors JOIN truth ON file = tfile AND (s = ts OR (ts IS NOT NULL AND te IS NOT NULL AND greatest(s, ts) <= least(e, te))) GROUP BY anchor_id""")
def disjunctive(spark, d):
    b = fixture(spark, d, "truth").withColumnRenamed("tfile", "file")
    return P.start_or_overlap(fixture(spark, d, "anchors"), b, "file", "truth_id").select("anchor_id", "truth_id")


@query("symbol_or_overlap_join", sql("anchors", "truth") + """, a AS (SELECT anchor_id, file, s, e, CASE WHEN pos % 3 = 0 THEN ' ' WHEN pos % 3 = 1 THEN NULL ELSE concat('g', CAST(s % 60 AS VARCHAR)) END AS symbol FROM anchors),
b AS (SELECT truth_id, tfile, ts, te, CASE WHEN truth_id % 4 = 0 THEN ' ' ELSE concat('g', CAST(truth_id % 60 AS VARCHAR)) END AS symbol FROM truth)
SELECT anchor_id, min(truth_id) AS truth_id FROM a JOIN b ON file = tfile AND ((trim(a.symbol) <> '' AND a.symbol = b.symbol) OR (ts IS NOT NULL AND te IS NOT NULL AND greatest(s, ts) <= least(e, te))) GROUP BY anchor_id""")
def symbol_join(spark, d):
    a = fixture(spark, d, "anchors").withColumn("symbol", F.when(F.col("pos") % 3 == 0, " ").when(F.col("pos") % 3 == 2, F.concat(F.lit("g"), (F.col("s") % 60).cast("string"))))
    b = fixture(spark, d, "truth").withColumnRenamed("tfile", "file")
    b = b.withColumn("symbol", F.when(F.col("truth_id") % 4 == 0, " ").otherwise(F.concat(F.lit("g"), (F.col("truth_id") % 60).cast("string"))))
    return P.symbol_or_overlap(a, b, "file", "symbol", "truth_id").select("anchor_id", "truth_id")


@query("labelled_table_lookup", _R + """, u AS (SELECT identity_key, 'left' AS label, left_rank AS r FROM ranks WHERE identity_key % 3 > 0 UNION ALL SELECT identity_key, 'right', right_rank FROM ranks WHERE identity_key % 4 > 0)
SELECT identity_key, count(*) FILTER (label = 'left') > 0 AS in_left, count(*) FILTER (label = 'right') > 0 AS in_right, count(*) FILTER (r <= 100) AS hits FROM u GROUP BY 1""")
def labelled(spark, d):
    r = fixture(spark, d, "ranks")
    u = r.where("identity_key % 3 > 0").select("identity_key", F.lit("left").alias("label"), F.col("left_rank").alias("r")).unionByName(
        r.where("identity_key % 4 > 0").select("identity_key", F.lit("right").alias("label"), F.col("right_rank").alias("r")))
    return u.groupBy("identity_key").agg(F.bool_or(F.col("label") == "left").alias("in_left"), F.bool_or(F.col("label") == "right").alias("in_right"), F.count_if(F.col("r") <= 100).alias("hits"))


@query("casefolded_composite_join", "SELECT lower(s_name) AS k, s_nationkey AS n, string_agg(CAST(s_suppkey AS VARCHAR), ',' ORDER BY s_suppkey) AS ids FROM supplier JOIN nation ON s_nationkey = n_nationkey GROUP BY ALL")
def casefolded(spark, d):
    s = table(spark, d, "supplier").select(F.lower("s_name").alias("k"), F.col("s_nationkey").alias("n"), "s_suppkey")
    n = table(spark, d, "nation").select(F.col("n_nationkey").alias("n"))
    ids = F.transform(F.array_sort(F.collect_list("s_suppkey")), lambda x: x.cast("string"))
    return s.join(n, "n").groupBy("k", "n").agg(F.array_join(ids, ",").alias("ids"))


@query("alias_lookup_join", "SELECT c_custkey, count(DISTINCT o_orderkey) AS n FROM (SELECT DISTINCT c_custkey, unnest([c_custkey, c_custkey + 1, c_nationkey]) AS a FROM customer) JOIN orders ON o_custkey = a GROUP BY 1")
def alias_lookup(spark, d):
    c = table(spark, d, "customer").select("c_custkey", F.explode(F.array_distinct(F.array("c_custkey", F.col("c_custkey") + 1, F.col("c_nationkey").cast("long")))).alias("o_custkey"))
    return c.join(table(spark, d, "orders").select("o_custkey", "o_orderkey"), "o_custkey").groupBy("c_custkey").agg(F.countDistinct("o_orderkey").alias("n"))


@query("equality_and_changes", "SELECT CASE WHEN a.k IS NULL THEN 'right_only' WHEN b.k IS NULL THEN 'left_only' WHEN a.v IS NOT DISTINCT FROM b.v THEN 'same' ELSE 'changed' END AS state, count(*) AS n FROM (SELECT c_custkey AS k, c_mktsegment AS v FROM customer WHERE c_custkey % 10 < 9) a FULL JOIN (SELECT c_custkey AS k, CASE WHEN c_custkey % 7 = 0 THEN NULL ELSE c_mktsegment END AS v FROM customer WHERE c_custkey % 10 > 0) b ON a.k = b.k GROUP BY 1")
def equality(spark, d):
    c = table(spark, d, "customer").select(F.col("c_custkey").alias("k"), F.col("c_mktsegment").alias("v"))
    a = c.where("k % 10 < 9").withColumn("_a", F.lit(1))
    b = c.where("k % 10 > 0").select("k", F.when(F.col("k") % 7 != 0, F.col("v")).alias("w"), F.lit(1).alias("_b"))
    rules = [(F.col("_a").isNull(), "right_only"), (F.col("_b").isNull(), "left_only"), (F.col("v").eqNullSafe(F.col("w")), "same")]
    return J.precedence(a.join(b, "k", "full_outer"), rules, "changed").groupBy("state").agg(F.count(F.lit(1)).alias("n"))


@query("subset_test", "SELECT o_orderstatus, count(*) FILTER (c_custkey IS NULL) = 0 AS subset FROM orders LEFT JOIN (SELECT c_custkey FROM customer WHERE c_acctbal > -900) ON o_custkey = c_custkey GROUP BY 1")
def subset(spark, d):
    c = table(spark, d, "customer").where("c_acctbal > -900").select(F.col("c_custkey").alias("o_custkey"), F.lit(1).alias("_c"))
    return table(spark, d, "orders").join(c, "o_custkey", "left").groupBy("o_orderstatus").agg((F.count_if(F.col("_c").isNull()) == 0).alias("subset"))


@query("positional_numbering", _G + " SELECT identity_key, printf('gl_mech_%04d', row_number() OVER (PARTITION BY guideline_id ORDER BY identity_key)) AS id FROM groups")
def numbering(spark, d):
    n = F.row_number().over(Window.partitionBy("guideline_id").orderBy("identity_key"))
    return fixture(spark, d, "groups").select("identity_key", F.format_string("gl_mech_%04d", n).alias("id"))


@query("group_diagnostics", _G + ", j AS (SELECT g.guideline_id, g.identity_key, l.r FROM groups g LEFT JOIN (SELECT o_custkey AS k, min(o_orderkey % 300) AS r FROM orders GROUP BY 1) l ON l.k = g.identity_key) SELECT guideline_id, count(r) AS joined, count(*) - count(r) AS missing, count(*) FILTER (r <= 50) AS hits, round(count(*) FILTER (r <= 50) / greatest(count(r), 1), 6) AS rate FROM j GROUP BY 1")
def diagnostics(spark, d):
    o = table(spark, d, "orders").groupBy(F.col("o_custkey").alias("identity_key")).agg(F.min(F.col("o_orderkey") % 300).alias("r"))
    hits = F.count_if(F.col("r") <= 50)
    return fixture(spark, d, "groups").join(o, "identity_key", "left").groupBy("guideline_id").agg(
        F.count("r").alias("joined"), (F.count(F.lit(1)) - F.count("r")).alias("missing"), hits.alias("hits"), F.round(hits / F.greatest(F.count("r"), F.lit(1)), 6).alias("rate"))


@query("content_fingerprint", "SELECT source, sha256(string_agg(concat(CAST(doc_id AS VARCHAR), chr(0), CAST(strlen(text) AS VARCHAR), chr(0), text, chr(0)), '' ORDER BY doc_id)) AS fingerprint FROM documents GROUP BY source")
def fingerprint(spark, d):
    return G.ordered_digest(table(spark, d, "documents"), "source", "doc_id", "text")


#: The functions of the source files made from documents: a method for each line, what it runs, and what that holds.
_FILES = "SELECT doc_id, unnest(range(1, len(string_split(coalesce(text, ''), chr(10))) + 1)) AS i FROM documents"
_CODE = "'" + chr(10).join(BLOCK).replace("'", "''") + "'"
_HELD = "'" + BLOCK[2].replace("'", "''") + "'"


@query("function_extraction", f"""WITH x AS ({_FILES}), f AS (
SELECT doc_id, concat('f', i) AS symbol, 7 * i - 4 AS a, 7 * i + 1 AS z, replace({_CODE}, '@', CAST(i AS VARCHAR)) AS code FROM x UNION ALL
SELECT doc_id, unnest(['run', concat('g', i)]), 7 * i - 2, 7 * i - 2, replace({_HELD}, '@', CAST(i AS VARCHAR)) FROM x)
SELECT doc_id, symbol, 'method_declaration' AS kind, CAST(a AS INTEGER) AS start_line, CAST(z AS INTEGER) AS end_line, sha256(code) AS code FROM f""")
def functions(spark, d):
    files = table(spark, d, "documents").select("doc_id", source_file(F.col("text")).alias("text"))
    return code.extract_functions(files, "doc_id", "text").withColumn("code", F.sha2("code", 256))


@query("function_extraction_by_language", f"WITH x AS ({_FILES}) SELECT doc_id, concat('f', i) AS symbol, CAST(7 * i - 4 AS INTEGER) AS start_line, CAST(7 * i + 1 AS INTEGER) AS end_line FROM x WHERE doc_id % 3 < 2 UNION ALL SELECT doc_id, concat('f', i), CAST(7 * i - 7 AS INTEGER), CAST(7 * i + 1 AS INTEGER) FROM x WHERE i > 1 AND doc_id % 3 = 0")
def functions_by_language(spark, d):
    """In Java a signature may follow other statements of the lines it is joined from: the return before each method begins one too."""
    path = F.concat(F.lit("src/m"), F.get(F.array(F.lit(".java"), F.lit(".cc"), F.lit(".py")), (F.col("doc_id") % 3).cast("int")))
    files = table(spark, d, "documents").select("doc_id", source_file(F.col("text")).alias("text"), path.alias("path"))
    return code.extract_functions(files, "doc_id", "text", "path").select("doc_id", "symbol", "start_line", "end_line")


@query("function_extraction_wrapped", "SELECT doc_id, 'f' || CAST(doc_id AS VARCHAR) AS symbol, 1 AS start_line, CAST(length(text) - length(replace(text, chr(10), '')) + 3 AS INTEGER) AS end_line FROM documents")
def functions_wrapped(spark, d):
    body = F.regexp_replace("text", "[{}\"'/]", "")
    files = table(spark, d, "documents").select("doc_id", F.concat(F.lit("int f"), F.col("doc_id").cast("string"), F.lit("(int x) {\n"), body, F.lit("\n}\n")).alias("text"))
    return code.extract_functions(files, "doc_id", "text").select("doc_id", "symbol", "start_line", "end_line")

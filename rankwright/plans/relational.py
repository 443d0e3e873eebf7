"""Queries over joins, spans, groups, samples and sets."""

from __future__ import annotations

from pyspark.sql import functions as F

from rankwright.operators import grouping as G
from rankwright.operators import joins as J
from rankwright.operators import ranking as R
from rankwright.operators import sampling as S
from rankwright.operators import spans as P
from rankwright.plans.fixtures import fixture, sql
from rankwright.session import table

QUERIES, SQL = {}, {}


def query(name: str, oracle: str | None = None):
    def keep(f):
        QUERIES[name] = f
        if oracle:
            SQL[name] = oracle
        return f

    return keep


def t(spark, d, name):
    return table(spark, d, name)


@query("identity_guarded_join", "SELECT o_orderkey AS k, o_totalprice AS a, o_custkey AS b FROM orders")
def identity_join(spark, d):
    o = t(spark, d, "orders")
    return J.identity_join(o.select(F.col("o_orderkey").alias("k"), F.col("o_totalprice").alias("a")), o.select(F.col("o_orderkey").alias("k"), F.col("o_custkey").alias("b")), "k")


@query("intersection_join_audit", "SELECT side, count(*) AS n FROM (SELECT CASE WHEN a.k IS NULL THEN 'right_only' WHEN b.k IS NULL THEN 'left_only' ELSE 'both' END AS side FROM (SELECT DISTINCT l_partkey AS k FROM lineitem WHERE l_quantity > 45) a FULL JOIN (SELECT DISTINCT l_partkey AS k FROM lineitem WHERE l_discount > 0.08) b USING (k)) GROUP BY side")
def intersection_audit(spark, d):
    li = t(spark, d, "lineitem").withColumnRenamed("l_partkey", "k")
    return J.key_audit(li.where("l_quantity > 45"), li.where("l_discount > 0.08"), "k").groupBy("side").agg(F.count(F.lit(1)).alias("n"))


@query("left_join_missing_status", "SELECT status, count(*) AS n FROM (SELECT CASE WHEN o.c IS NULL THEN 'missing_orders' ELSE 'joined' END AS status FROM customer LEFT JOIN (SELECT DISTINCT o_custkey AS c FROM orders WHERE o_orderstatus = 'F') o ON c_custkey = o.c) GROUP BY status")
def left_status(spark, d):
    o = t(spark, d, "orders").where("o_orderstatus = 'F'").select(F.col("o_custkey").alias("c_custkey")).distinct()
    return J.left_with_status(t(spark, d, "customer").select("c_custkey"), o, "c_custkey", "missing_orders").groupBy("status").agg(F.count(F.lit(1)).alias("n"))


@query("precedence_multi_left_join", """SELECT state, count(*) AS n FROM (SELECT CASE WHEN p.x IS NOT NULL THEN 'receipt' WHEN e.x IS NOT NULL THEN 'unresolved' WHEN v.x IS NOT NULL THEN 'packet' ELSE 'missing_input' END AS state FROM customer
 LEFT JOIN (SELECT DISTINCT user_id AS x FROM events WHERE event_type = 'purchase' AND value > 60) p ON p.x = c_custkey LEFT JOIN (SELECT DISTINCT user_id AS x FROM events WHERE event_type = 'error' AND value > 40) e ON e.x = c_custkey
 LEFT JOIN (SELECT DISTINCT user_id AS x FROM events) v ON v.x = c_custkey) GROUP BY state""")
def precedence(spark, d):
    e = t(spark, d, "events").withColumnRenamed("user_id", "c_custkey")
    c = t(spark, d, "customer").select("c_custkey")
    for name, cond in (("_p", "event_type = 'purchase' AND value > 60"), ("_e", "event_type = 'error' AND value > 40"), ("_v", "true")):
        c = c.join(e.where(cond).select("c_custkey").distinct().withColumn(name, F.lit(1)), "c_custkey", "left")
    rules = [(F.col("_p").isNotNull(), "receipt"), (F.col("_e").isNotNull(), "unresolved"), (F.col("_v").isNotNull(), "packet")]
    return J.precedence(c, rules, "missing_input").groupBy("state").agg(F.count(F.lit(1)).alias("n"))


@query("full_outer_backlog", "SELECT coalesce(a.k, b.k) AS k, coalesce(a.n, 0) AS judged, coalesce(b.n, 0) AS aligned FROM (SELECT l_orderkey AS k, count(*) AS n FROM lineitem WHERE l_returnflag = 'R' GROUP BY 1) a FULL JOIN (SELECT l_orderkey AS k, count(*) AS n FROM lineitem WHERE l_returnflag <> 'R' GROUP BY 1) b ON a.k = b.k")
def full_outer(spark, d):
    li = t(spark, d, "lineitem").withColumnRenamed("l_orderkey", "k")
    side = lambda f, n: li.where(f).groupBy("k").agg(F.count(F.lit(1)).alias(n))
    return side("l_returnflag = 'R'", "judged").join(side("l_returnflag <> 'R'", "aligned"), "k", "full_outer").fillna(0)


@query("fallback_key_join", """WITH x AS (SELECT s_suppkey, s_nationkey, s_suppkey * 3 AS k1, s_nationkey AS k2 FROM supplier), c AS (SELECT c_custkey, c_nationkey, c_name FROM customer)
SELECT s_suppkey, coalesce(a.v, b.v) AS c_name FROM x LEFT JOIN (SELECT c_custkey AS k, min(c_name) AS v FROM c GROUP BY 1) a ON a.k = k1 LEFT JOIN (SELECT c_nationkey AS k, min(c_name) AS v FROM c GROUP BY 1) b ON b.k = k2""")
def fallback(spark, d):
    x = t(spark, d, "supplier").select("s_suppkey", (F.col("s_suppkey") * 3).alias("k1"), F.col("s_nationkey").alias("k2"))
    return J.fallback_join(x, t(spark, d, "customer"), [("k1", "c_custkey"), ("k2", "c_nationkey")], "c_name").select("s_suppkey", "c_name")


@query("source_chain_keep_first", """WITH u AS (SELECT user_id AS k, 0 AS p, event_id AS v FROM events WHERE event_type = 'purchase' AND value > 50 UNION ALL SELECT user_id, 1, event_id FROM events WHERE event_type = 'click' AND value > 50 UNION ALL SELECT user_id, 2, event_id FROM events)
SELECT k, v FROM (SELECT *, min(p) OVER (PARTITION BY k) AS m FROM u) WHERE p = m""")
def source_chain(spark, d):
    e = t(spark, d, "events").select(F.col("user_id").alias("k"), F.col("event_id").alias("v"), "event_type", "value")
    return J.source_chain([e.where("event_type = 'purchase' AND value > 50").select("k", "v"), e.where("event_type = 'click' AND value > 50").select("k", "v"), e.select("k", "v")], "k")


@query("exploded_key_ambiguity", """SELECT k, CAST(count(DISTINCT l_suppkey) AS BIGINT) AS matches, CASE WHEN count(DISTINCT l_suppkey) = 1 THEN min(l_suppkey) END AS l_suppkey, CASE count(DISTINCT l_suppkey) WHEN 0 THEN 'missing' WHEN 1 THEN 'matched' ELSE 'ambiguous' END AS status
FROM (SELECT p_partkey AS k FROM part) LEFT JOIN (SELECT l_orderkey AS k, l_suppkey FROM lineitem) USING (k) GROUP BY k""")
def ambiguity(spark, d):
    li = t(spark, d, "lineitem").select(F.col("l_orderkey").alias("k"), "l_suppkey")
    return J.ambiguity(t(spark, d, "part").select(F.col("p_partkey").alias("k")), li, ["k"], "k", "l_suppkey")


@query("array_lookup_ordered_dedupe", """WITH i AS (SELECT c_custkey, unnest([c_nationkey % 5, (c_nationkey + 2) % 5, c_nationkey % 5]) AS r, generate_subscripts([1, 2, 3], 1) AS p FROM customer),
j AS (SELECT c_custkey, n_name, min(p) AS p FROM i JOIN nation ON n_regionkey = r WHERE n_nationkey % 4 = 0 GROUP BY ALL) SELECT c_custkey, string_agg(n_name, ',' ORDER BY p, n_name) AS names FROM j GROUP BY c_custkey""")
def array_lookup(spark, d):
    r = F.col("c_nationkey") % 5
    c = t(spark, d, "customer").select("c_custkey", F.array(r, (F.col("c_nationkey") + 2) % 5, r).alias("items"))
    n = t(spark, d, "nation").where("n_nationkey % 4 = 0").select(F.col("n_regionkey").alias("r"), "n_name")
    return J.ordered_lookup(c, "c_custkey", "items", n, "r", "n_name").select("c_custkey", F.array_join("n_name", ",").alias("names"))


@query("not_exists_active_project", "SELECT c_custkey FROM customer WHERE NOT EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_orderstatus = 'P')")
def not_exists(spark, d):
    o = t(spark, d, "orders").where("o_orderstatus = 'P'").withColumnRenamed("o_custkey", "c_custkey")
    return J.not_exists_active(t(spark, d, "customer").select("c_custkey"), o, "c_custkey")


@query("semi_join_pushdown", "SELECT doc_id, source FROM documents WHERE source IN (SELECT DISTINCT source FROM documents WHERE lang = 'fr')")
def semi_join(spark, d):
    docs = t(spark, d, "documents")
    return docs.select("doc_id", "source").join(docs.where("lang = 'fr'").select("source").distinct(), "source", "left_semi")


@query("anti_join_leakage", "SELECT o_orderkey FROM orders WHERE o_custkey NOT IN (SELECT c_custkey FROM customer WHERE c_mktsegment = 'BUILDING')")
def anti_join(spark, d):
    c = t(spark, d, "customer").where("c_mktsegment = 'BUILDING'").select(F.col("c_custkey").alias("o_custkey"))
    return t(spark, d, "orders").join(c, "o_custkey", "left_anti").select("o_orderkey")


@query("missing_coverage_rows", "SELECT c_custkey AS k, 'missing' AS state FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders) UNION ALL SELECT DISTINCT o_custkey, 'present' FROM orders")
def missing_rows(spark, d):
    o = t(spark, d, "orders").select(F.col("o_custkey").alias("k")).distinct().withColumn("state", F.lit("present"))
    c = t(spark, d, "customer").select(F.col("c_custkey").alias("k")).join(o, "k", "left_anti").withColumn("state", F.lit("missing"))
    return c.unionByName(o)


@query("inner_join_accepted", "SELECT o_orderkey, l_linenumber, l_quantity FROM orders JOIN lineitem ON o_orderkey = l_orderkey WHERE o_orderstatus = 'F' AND l_returnflag = 'R'")
def inner_join(spark, d):
    li = t(spark, d, "lineitem").where("l_returnflag = 'R'").withColumnRenamed("l_orderkey", "o_orderkey")
    return t(spark, d, "orders").where("o_orderstatus = 'F'").join(li, "o_orderkey").select("o_orderkey", "l_linenumber", "l_quantity")


@query("positional_zip_join", "SELECT a.i, a.s_name, b.n_name FROM (SELECT row_number() OVER (ORDER BY s_name DESC) AS i, s_name FROM supplier) a LEFT JOIN (SELECT row_number() OVER (ORDER BY n_name) AS i, n_name FROM nation) b USING (i)")
def zip_join(spark, d):
    a = R.numbered(t(spark, d, "supplier").select("s_name"), [F.col("s_name").desc()], "i")
    return J.zip_rows(a, R.numbered(t(spark, d, "nation").select("n_name"), [F.col("n_name")], "i"), "i")


@query("conflict_checked_keys", "SELECT c_nationkey AS k, count(*) AS n, count(DISTINCT c_mktsegment) = 1 AS consistent FROM customer GROUP BY 1")
def conflicts(spark, d):
    return J.conflict_checked(t(spark, d, "customer").select(F.col("c_nationkey").alias("k"), "c_mktsegment"), "k")


@query("flip_transitions", """SELECT concat(coalesce(a.o, 'absent'), '->', coalesce(b.o, 'absent')) AS transition, count(*) AS n FROM (SELECT l_orderkey AS k, min(l_returnflag) AS o FROM lineitem WHERE l_quantity > 30 GROUP BY 1) a
FULL JOIN (SELECT l_orderkey AS k, max(l_returnflag) AS o FROM lineitem WHERE l_discount > 0.04 GROUP BY 1) b USING (k) GROUP BY 1""")
def flips(spark, d):
    li = t(spark, d, "lineitem").withColumnRenamed("l_orderkey", "k")
    return J.flips(li.where("l_quantity > 30").groupBy("k").agg(F.min("l_returnflag").alias("o")), li.where("l_discount > 0.04").groupBy("k").agg(F.max("l_returnflag").alias("o")), "k", "o")


@query("reference_field_match", "SELECT o_orderkey, coalesce(o_orderstatus IS NOT DISTINCT FROM CASE WHEN o_orderkey % 3 = 0 THEN 'F' ELSE o_orderstatus END, false) AS matches FROM orders")
def reference_match(spark, d):
    o = t(spark, d, "orders").select("o_orderkey", "o_orderstatus", "o_custkey")
    ref = o.withColumn("o_orderstatus", F.when(F.col("o_orderkey") % 3 == 0, "F").otherwise(F.col("o_orderstatus")))
    return J.reference_match(o, ref, "o_orderkey", ["o_orderstatus", "o_custkey"])


_S = sql("anchors", "truth")
_ON = {
    "zero": "greatest(coalesce(s, 0), coalesce(ts, 0)) <= least(coalesce(e, 0), coalesce(te, 0))",
    "strict": "ts IS NOT NULL AND te IS NOT NULL AND greatest(s, ts) <= least(e, te)",
    "wildcard": "(s <= 0 OR coalesce(ts, 0) <= 0 OR greatest(s, ts) <= least(e, CASE WHEN coalesce(te, 0) <= 0 THEN ts ELSE te END))",
    "repair": "ts > 0 AND te > 0 AND greatest(s, least(ts, te)) <= least(e, greatest(ts, te))",
}


def _span_query(dialect):
    @query(f"span_overlap_{dialect}", _S + f" SELECT case_id, count(*) AS hits FROM anchors WHERE EXISTS (SELECT 1 FROM truth WHERE tfile = file AND {_ON[dialect]}) GROUP BY case_id")
    def run(spark, d):
        a, b = fixture(spark, d, "anchors"), fixture(spark, d, "truth").withColumnRenamed("tfile", "file")
        return P.overlap_join(a, b, ["file"], dialect).groupBy("case_id").agg(F.count(F.lit(1)).alias("hits"))


for _d in _ON:
    _span_query(_d)


@query("span_distance_tiers", _S + """ SELECT anchor_id, bool_or(greatest(s, ts) <= least(e, te)) AS exact, min(CASE WHEN greatest(s, ts) <= least(e, te) THEN 0 WHEN e < ts THEN ts - e ELSE s - te END) AS closest
FROM anchors JOIN truth ON file = tfile AND ts IS NOT NULL AND te IS NOT NULL WHERE positive GROUP BY anchor_id""")
def span_tiers(spark, d):
    a, b = fixture(spark, d, "anchors").where("positive"), fixture(spark, d, "truth").where("ts IS NOT NULL AND te IS NOT NULL")
    return P.closest_truth(a, b.withColumnRenamed("tfile", "file"), ["file"]).select("anchor_id", "exact", "closest")


@query("best_overlap_function", _S + """ SELECT anchor_id, truth_id FROM (SELECT anchor_id, truth_id, row_number() OVER (PARTITION BY anchor_id ORDER BY least(e, te) - greatest(s, ts) + 1 DESC, abs(s + e - ts - te), te - ts, truth_id) AS rn
FROM anchors JOIN truth ON file = tfile AND greatest(s, ts) <= least(e, te) WHERE ts IS NOT NULL AND te IS NOT NULL) WHERE rn = 1""")
def best_overlap(spark, d):
    f = fixture(spark, d, "truth").where("ts IS NOT NULL AND te IS NOT NULL").select(F.col("truth_id").alias("fid"), F.col("tfile").alias("file"), "ts", "te")
    return P.best_overlap(fixture(spark, d, "anchors"), f, "file", "anchor_id").select("anchor_id", F.col("fid").alias("truth_id"))


_LINES = r"""WITH l0 AS (SELECT doc_id, regexp_split_to_array(text, '\r\n|[\n\x0b\x0c\r\x1c-\x1e\x{85}\x{2028}\x{2029}]') AS l FROM documents WHERE text <> ''),
l AS (SELECT doc_id, CASE WHEN l[len(l)] = '' THEN l[:len(l)-1] ELSE l END AS l FROM l0),
w AS (SELECT doc_id, l, unnest(range(0, len(l), 4)) AS s FROM l WHERE len(l) > 0)"""


@query("sliding_line_windows", _LINES + " SELECT doc_id, CAST(s + 1 AS INTEGER) AS start_line, CAST(least(s + 8, len(l)) AS INTEGER) AS end_line, sha256(array_to_string(l[s + 1:s + 8], chr(10))) AS body FROM w WHERE s = 0 OR s + 4 < len(l)")
def line_windows(spark, d):
    w = P.windows(t(spark, d, "documents"), ["doc_id"], "text", 8, 4)
    return w.withColumn("body", F.sha2("body", 256))


@query("nearest_symbol_lookback", sql("ledger") + " SELECT ord, last_value(CASE WHEN status = 'signup' THEN ord END IGNORE NULLS) OVER (PARTITION BY task_id ORDER BY ord ROWS BETWEEN 5 PRECEDING AND CURRENT ROW) AS nearest FROM ledger")
def nearest_symbol(spark, d):
    g = fixture(spark, d, "ledger").withColumn("sym", F.when(F.col("status") == "signup", F.col("ord")))
    return P.nearest_symbol(g, ["task_id"], "ord", "sym", 5).select("ord", "nearest")


@query("path_suffix_join", "WITH a AS (SELECT page_id, regexp_replace(url, '^http://', '') AS p FROM pages), b AS (SELECT DISTINCT regexp_extract(url, '/([^/]+/[^/]+)$', 1) AS q FROM pages) SELECT page_id, q FROM a JOIN b ON p = q OR ends_with(p, '/' || q) OR ends_with(q, '/' || p) WHERE q <> ''")
def suffix_join(spark, d):
    p = t(spark, d, "pages")
    a = p.select("page_id", F.regexp_replace("url", "^http://", "").alias("p"))
    b = p.select(F.regexp_extract("url", "/([^/]+/[^/]+)$", 1).alias("q")).where("q <> ''").distinct()
    return P.suffix_join(a, b, "p", "q").select("page_id", "q")


_GR = sql("groups")


@query("purity_entropy_mode", _GR + """, c AS (SELECT guideline_id, label, count(*) AS n FROM groups GROUP BY ALL), p AS (SELECT *, n / sum(n) OVER (PARTITION BY guideline_id) AS p FROM c)
SELECT guideline_id, round(max(p), 6) AS purity, round(CASE WHEN count(*) <= 1 THEN 0 ELSE -sum(p * ln(p)) / ln(count(*)) END, 6) AS entropy, first(label ORDER BY n DESC, label) AS majority FROM p GROUP BY guideline_id""")
def purity(spark, d):
    g = G.composition(fixture(spark, d, "groups"), ["guideline_id"], "label")
    return g.select("guideline_id", F.round("purity", 6).alias("purity"), F.round("entropy", 6).alias("entropy"), "majority")


@query("macro_weighted_means", _GR + ", g AS (SELECT guideline_id, round(avg(weight), 4) AS v, count(*) AS n FROM groups GROUP BY 1) SELECT round(avg(v), 5) AS macro, round(sum(v * n) / sum(n), 5) AS weighted FROM g")
def means(spark, d):
    g = fixture(spark, d, "groups").groupBy("guideline_id").agg(F.round(F.avg("weight"), 4).alias("v"), F.count(F.lit(1)).alias("n"))
    return G.means(g, "v", "n").select(F.round("macro", 5).alias("macro"), F.round("weighted", 5).alias("weighted"))


@query("count_by_with_missing", "SELECT coalesce(CASE WHEN o_custkey % 7 = 0 THEN NULL ELSE o_orderstatus END, 'missing') AS label, count(*) AS n FROM orders GROUP BY 1")
def count_by(spark, d):
    o = t(spark, d, "orders").withColumn("label", F.when(F.col("o_custkey") % 7 != 0, F.col("o_orderstatus")))
    return G.class_counts(o, [], "label")


@query("ordered_distinct_list", sql("ledger") + ", f AS (SELECT task_id, status, min(ord) AS o FROM ledger GROUP BY ALL) SELECT task_id, string_agg(status, '|' ORDER BY o) AS status FROM f GROUP BY task_id")
def ordered_distinct(spark, d):
    return G.ordered_distinct(fixture(spark, d, "ledger"), ["task_id"], "ord", "status", "|")


@query("set_aggregation_sorted", "SELECT n_regionkey, string_agg(DISTINCT n_name, ',' ORDER BY n_name) AS names, count(DISTINCT n_name) AS n FROM nation GROUP BY 1")
def set_agg(spark, d):
    return t(spark, d, "nation").groupBy("n_regionkey").agg(F.array_join(F.array_sort(F.collect_set("n_name")), ",").alias("names"), F.countDistinct("n_name").alias("n"))


@query("partial_final_summary_merge", "SELECT round(sum(l_quantity) / count(*), 6) AS mean, count(*) AS cnt FROM lineitem")
def partial_final(spark, d):
    p = t(spark, d, "lineitem").groupBy("l_suppkey").agg(F.avg("l_quantity").alias("mean"), F.count(F.lit(1)).alias("cnt"))
    return G.weighted_recombination(p, "mean", "cnt").select(F.round("mean", 6).alias("mean"), "cnt")


@query("count_map_merge", "SELECT l_returnflag AS key, count(*) AS n FROM lineitem GROUP BY 1")
def count_maps(spark, d):
    m = t(spark, d, "lineitem").groupBy("l_suppkey", "l_returnflag").agg(F.count(F.lit(1)).alias("n")).select(F.create_map("l_returnflag", "n").alias("m"))
    return G.merge_count_maps(m, "m")


@query("pivot_evidence_counts", "SELECT user_id, count(*) FILTER (event_type = 'click') AS click, count(*) FILTER (event_type = 'error') AS error, count(*) FILTER (event_type = 'view') AS view FROM events GROUP BY user_id")
def pivot_counts(spark, d):
    e = t(spark, d, "events")
    return e.groupBy("user_id").pivot("event_type", ["click", "error", "view"]).agg(F.count(F.lit(1))).fillna(0)


@query("token_usage_fold", sql("ledger") + " SELECT task_id, round(sum(tokens), 4) AS tokens, arg_max(status, ord) FILTER (status <> 'error') AS last_text FROM ledger GROUP BY task_id")
def token_fold(spark, d):
    ok = F.col("status") != "error"
    return fixture(spark, d, "ledger").groupBy("task_id").agg(F.round(F.sum("tokens"), 4).alias("tokens"), F.max_by(F.when(ok, F.col("status")), F.when(ok, F.col("ord"))).alias("last_text"))


@query("agreement_matrix", "SELECT concat(CAST(quality AS VARCHAR), '/', CAST(toxic AS VARCHAR)) AS cell, count(*) AS n FROM labels GROUP BY 1")
def agreement(spark, d):
    return t(spark, d, "labels").groupBy(F.concat_ws("/", F.col("quality").cast("string"), F.col("toxic").cast("string")).alias("cell")).agg(F.count(F.lit(1)).alias("n"))


@query("judge_score_statistics", "SELECT l_returnflag, round(avg(greatest(0, least(1, l_quantity / 40 - 0.1e0))), 6) AS mean, round(min(least(l_discount, l_tax)), 6) AS row_min, count(*) FILTER (least(l_discount, l_tax) < 0.02) AS low FROM lineitem GROUP BY 1")
def judge_scores(spark, d):
    low = F.least("l_discount", "l_tax")
    return t(spark, d, "lineitem").groupBy("l_returnflag").agg(
        F.round(F.avg(F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.col("l_quantity") / 40 - 0.1))), 6).alias("mean"), F.round(F.min(low), 6).alias("row_min"), F.count_if(low < 0.02).alias("low"))


@query("per_bucket_limit", "SELECT l_orderkey, l_linenumber, l_suppkey FROM (SELECT *, row_number() OVER (PARTITION BY l_returnflag, l_linestatus ORDER BY l_orderkey, l_linenumber, l_suppkey, l_partkey) AS rn FROM lineitem) WHERE rn <= 20")
def bucket_limit(spark, d):
    return G.per_bucket_limit(t(spark, d, "lineitem"), ["l_returnflag", "l_linestatus"], ["l_orderkey", "l_linenumber", "l_suppkey", "l_partkey"], 20).select("l_orderkey", "l_linenumber", "l_suppkey")


@query("stratified_hash_sample", """WITH c AS (SELECT c_mktsegment AS s, count(*) AS n FROM customer GROUP BY 1), u AS (SELECT s, n, sum(n) OVER (ORDER BY s) AS upto, sum(n) OVER () AS everything FROM c),
n AS (SELECT s, CAST(round_even(least(200, everything) * upto / everything, 0) - round_even(least(200, everything) * (upto - n) / everything, 0) AS BIGINT) AS t FROM u),
r AS (SELECT c_custkey, c_mktsegment, row_number() OVER (PARTITION BY c_mktsegment ORDER BY sha256(concat('seed7', chr(0), CAST(c_custkey AS VARCHAR))), c_custkey) AS rn FROM customer) SELECT c_custkey, c_mktsegment FROM r JOIN n ON s = c_mktsegment WHERE rn <= t""")
def stratified(spark, d):
    return S.stratified(t(spark, d, "customer"), "c_mktsegment", "c_custkey", "seed7", 200).select("c_custkey", "c_mktsegment")


@query("round_robin_sample", "SELECT c_custkey, c_mktsegment, turn FROM (SELECT c_custkey, c_mktsegment, row_number() OVER (PARTITION BY c_mktsegment ORDER BY c_custkey) AS turn FROM customer) ORDER BY turn, c_mktsegment LIMIT 23")
def round_robin(spark, d):
    return S.round_robin(t(spark, d, "customer"), "c_mktsegment", "c_custkey", 23)


@query("hash_bucket_split", "SELECT c_custkey, CAST(CAST('0x' || substr(sha256(CAST(c_custkey AS VARCHAR)), 1, 16) AS UBIGINT) % 4 AS INTEGER) AS bucket, CASE WHEN CAST('0x' || substr(sha256(CAST(c_custkey AS VARCHAR)), 1, 2) AS INTEGER) % 2 = 0 THEN 'A' ELSE 'B' END AS ab, round(CAST('0x' || substr(sha256(CAST(c_custkey AS VARCHAR)), 1, 13) AS BIGINT) / 4503599627370496e0, 9) AS u FROM customer")
def hash_split(spark, d):
    k = F.col("c_custkey")
    return t(spark, d, "customer").select("c_custkey", S.hash_bucket(k, 4).alias("bucket"), S.ab_label(k).alias("ab"), F.round(S.unit_float(k), 9).alias("u"))


@query("claim_next_task", "SELECT o_orderkey, o_totalprice FROM orders ORDER BY o_orderpriority, o_orderdate, o_orderkey LIMIT 1")
def claim_next(spark, d):
    return t(spark, d, "orders").orderBy("o_orderpriority", "o_orderdate", "o_orderkey").limit(1).select("o_orderkey", "o_totalprice")


@query("multi_key_priority_sort", "SELECT o_orderkey, row_number() OVER (ORDER BY CASE o_orderstatus WHEN 'F' THEN 0 WHEN 'O' THEN 1 ELSE 2 END, o_totalprice DESC, o_orderkey) AS pos FROM orders ORDER BY 2 LIMIT 50")
def priority_sort(spark, d):
    prio = F.create_map(F.lit("F"), F.lit(0), F.lit("O"), F.lit(1), F.lit("P"), F.lit(2))[F.col("o_orderstatus")]
    top = t(spark, d, "orders").orderBy(prio, F.col("o_totalprice").desc(), "o_orderkey").limit(50)
    from pyspark.sql import Window

    return top.select("o_orderkey", F.row_number().over(Window.orderBy(prio, F.col("o_totalprice").desc(), "o_orderkey")).alias("pos"))  # 50 rows


@query("null_last_sort", sql("ranks") + " SELECT identity_key, left_rank FROM ranks ORDER BY left_rank NULLS LAST, identity_key LIMIT 40 OFFSET 10")
def null_last(spark, d):
    return fixture(spark, d, "ranks").orderBy(F.asc_nulls_last("left_rank"), "identity_key").offset(10).limit(40).select("identity_key", "left_rank")


@query("set_union_intersect_except", """SELECT 'union' AS op, count(*) AS n FROM (SELECT o_custkey FROM orders UNION SELECT c_custkey FROM customer) UNION ALL SELECT 'intersect', count(*) FROM (SELECT o_custkey FROM orders INTERSECT SELECT c_custkey FROM customer)
UNION ALL SELECT 'except', count(*) FROM (SELECT c_custkey FROM customer EXCEPT SELECT o_custkey FROM orders) UNION ALL SELECT 'except_all', count(*) FROM (SELECT o_custkey FROM orders EXCEPT ALL SELECT c_custkey FROM customer) UNION ALL SELECT 'union_all', (SELECT count(*) FROM orders) + (SELECT count(*) FROM customer)""")
def set_ops(spark, d):
    a, b = t(spark, d, "orders").select(F.col("o_custkey").alias("k")), t(spark, d, "customer").select(F.col("c_custkey").alias("k"))
    parts = {"union": a.union(b).distinct(), "intersect": a.intersect(b), "except": b.subtract(a), "except_all": a.exceptAll(b), "union_all": a.unionByName(b)}
    out = None
    for k, v in parts.items():
        r = v.agg(F.count(F.lit(1)).alias("n")).select(F.lit(k).alias("op"), "n")
        out = r if out is None else out.unionByName(r)
    return out


@query("pairwise_difference_hash_sampled", sql("anchors") + """, p AS (SELECT a.case_id, a.anchor_id AS pos_id, b.anchor_id AS neg_id, a.score_a - b.score_a AS d_a, a.score_b - b.score_b AS d_b,
  row_number() OVER (PARTITION BY a.case_id ORDER BY sha256(concat(a.anchor_id, '|', b.anchor_id)), a.anchor_id, b.anchor_id) AS rn FROM anchors a JOIN anchors b ON a.case_id = b.case_id AND a.positive AND NOT b.positive)
SELECT case_id, pos_id, neg_id, round(d_a, 4) AS d_a, round(d_b, 4) AS d_b FROM p WHERE rn <= 3""")
def pairwise_diffs(spark, d):
    a = fixture(spark, d, "anchors")
    n = a.where("NOT positive").select("case_id", F.col("anchor_id").alias("neg_id"), F.col("score_a").alias("na"), F.col("score_b").alias("nb"))
    j = a.where("positive").withColumnRenamed("anchor_id", "pos_id").join(n, "case_id")
    j = R.hash_order(j, ["case_id"], ["pos_id", "neg_id"]).where("rn <= 3")
    return j.select("case_id", "pos_id", "neg_id", F.round(F.col("score_a") - F.col("na"), 4).alias("d_a"), F.round(F.col("score_b") - F.col("nb"), 4).alias("d_b"))

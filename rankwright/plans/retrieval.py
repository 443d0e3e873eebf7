"""Queries over retrieval, ranking and metrics operators."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from rankwright.operators import metrics as M
from rankwright.operators import ranking as R
from rankwright.operators import retrieval as V
from rankwright.operators import search as D
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


_BM25 = r"""
WITH q AS (SELECT item_id, lower(t) AS term, CAST(count(*) AS DOUBLE) AS qf FROM (
    SELECT item_id, unnest(regexp_extract_all(text, '[A-Za-z0-9_]+')) AS t FROM benchmark {qfilter}) GROUP BY ALL),
dt AS (SELECT doc_id, {corpus} regexp_extract_all(text, '[A-Za-z0-9_]+') AS ts FROM documents),
tf AS (SELECT doc_id, {corpus} len, lower(t) AS term, CAST(count(*) AS DOUBLE) AS f FROM (
    SELECT doc_id, {corpus} len(ts) AS len, unnest(ts) AS t FROM dt) GROUP BY ALL),
df AS (SELECT {corpus} term, CAST(count(*) AS DOUBLE) AS df FROM tf GROUP BY ALL),
n AS (SELECT {corpus} CAST(count(*) AS DOUBLE) AS n, avg(len(ts)) AS avgdl FROM dt {group}),
sc AS (SELECT item_id, doc_id, {tcorpus} sum(qf * ln(1 + (n - df + 0.5e0) / (df + 0.5e0)) * f * 2.5e0 / (f + 1.5e0 * (0.25e0 + 0.75e0 * len / avgdl))) AS score
  FROM tf JOIN df USING ({corpus} term) {njoin} JOIN q USING (term) GROUP BY ALL)
"""


@query("bm25_top10", _BM25.format(corpus="", tcorpus="", group="", njoin="CROSS JOIN n", qfilter="") + """
SELECT item_id, doc_id, round(score, 6) AS score, rn FROM (
  SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY round(score, 9) DESC, doc_id) AS rn FROM sc) WHERE rn <= 10""")
def bm25_top10(spark, d):
    s = D.bm25_top_k(table(spark, d, "benchmark"), "item_id", "text", table(spark, d, "documents"), "doc_id", "text", 10)
    return s.select("item_id", "doc_id", F.round("score", 6).alias("score"), "rn")


@query("bm25_per_repo", _BM25.format(corpus="source,", tcorpus="source,", group="GROUP BY source", njoin="JOIN n USING (source)", qfilter="") + """
SELECT item_id, source, doc_id, round(score, 6) AS score FROM (
  SELECT *, row_number() OVER (PARTITION BY item_id, source ORDER BY round(score, 9) DESC, doc_id) AS rn FROM sc) WHERE rn = 1""")
def bm25_per_repo(spark, d):
    s = D.bm25_top_k(table(spark, d, "benchmark"), "item_id", "text", table(spark, d, "documents"), "doc_id", "text", 1, "source")
    return s.select("item_id", "source", "doc_id", F.round("score", 6).alias("score"))


@query("bm25_zero_scores_stay", _BM25.format(corpus="", tcorpus="", group="", njoin="CROSS JOIN n", qfilter="") + """,
pool AS (SELECT item_id, doc_id FROM (SELECT item_id FROM benchmark), (SELECT doc_id FROM documents))
SELECT item_id, count(*) AS n, count(*) FILTER (coalesce(score, 0) = 0) AS zeros FROM pool LEFT JOIN sc USING (item_id, doc_id) GROUP BY item_id""")
def bm25_zero(spark, d):
    q, docs = table(spark, d, "benchmark"), table(spark, d, "documents")
    s = D.bm25_scored(q, "item_id", "text", docs, "doc_id", "text")
    n = q.select("item_id").join(s, "item_id", "left").crossJoin(F.broadcast(docs.agg(F.count(F.lit(1)).alias("n"))))  # one row
    return n.select("item_id", "n", (F.col("n") - F.coalesce("scored", F.lit(0))).alias("zeros"))


@query("corpus_statistics", r"""
WITH dt AS (SELECT doc_id, source, regexp_extract_all(text, '[A-Za-z0-9_]+') AS ts FROM documents),
tf AS (SELECT source, doc_id, lower(t) AS term FROM (SELECT source, doc_id, unnest(ts) AS t FROM dt) GROUP BY ALL)
SELECT source, (SELECT count(*) FROM dt d2 WHERE d2.source = s.source) AS n, round((SELECT avg(len(ts)) FROM dt d3 WHERE d3.source = s.source), 6) AS avgdl,
  count(DISTINCT term) AS terms, count(*) AS postings FROM tf s GROUP BY source""")
def corpus_statistics(spark, d):
    tf, df, size = V.term_stats(table(spark, d, "documents"), "doc_id", "text", ["source"])
    t = df.groupBy("source").agg(F.count(F.lit(1)).alias("terms"), F.sum("df").cast("long").alias("postings"))
    return t.join(size, "source").select("source", F.col("n").cast("long").alias("n"), F.round("avgdl", 6).alias("avgdl"), "terms", "postings")


_COS = """
WITH v AS (SELECT vec_id, label, [CAST(x AS DOUBLE) FOR x IN embedding] AS v FROM embeddings),
u AS (SELECT vec_id, label, list_transform(v, lambda x: x / sqrt(list_dot_product(v, v))) AS v FROM v),
p AS (SELECT q.vec_id AS query_id, c.vec_id AS cand_id, q.label = c.label AS positive, list_dot_product(q.v, c.v) AS score
  FROM u q JOIN u c ON q.vec_id % 100 = 0 AND q.vec_id <> c.vec_id)"""


def _vectors(spark, d):
    """The query set, every row whose id is divisible by 100, and all rows."""
    v = table(spark, d, "embeddings").select(F.col("vec_id").alias("id"), "label", F.col("embedding").alias("vec"))
    return v.where("id % 100 = 0"), v


@query("dense_first_positive_rank", _COS + """
SELECT query_id, first_rank, n, round((first_rank - 1) / greatest(n - 1, 1), 6) AS normalized_rank FROM (
  SELECT query_id, min(rn) FILTER (positive) AS first_rank, count(*) AS n FROM (
    SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY round(score, 9) DESC, cand_id) AS rn FROM p) GROUP BY query_id)""")
def dense_first(spark, d):
    f = D.dense_first_positive(*_vectors(spark, d))
    return f.select("query_id", "first_rank", "n", F.round(R.normalized_rank(F.col("first_rank"), F.col("n")), 6).alias("normalized_rank"))


@query("dense_top5", _COS + """
SELECT query_id, cand_id, rn FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY round(score, 9) DESC, cand_id) AS rn FROM p) WHERE rn <= 5""")
def dense_top5(spark, d):
    return D.dense_top_k(*_vectors(spark, d), 5).select("query_id", "cand_id", "rn")


@query("best_query_per_candidate", _COS + """
SELECT cand_id, arg_max(query_id, [round(score, 9), CAST(-query_id AS DOUBLE)]) AS query_id, round(max(score), 6) AS score FROM p GROUP BY cand_id""")
def best_query(spark, d):
    return D.dense_best_query(*_vectors(spark, d)).select("cand_id", "query_id", F.round("score", 6).alias("score"))


@query("centroid_similarity", """
WITH v AS (SELECT vec_id, label, [CAST(x AS DOUBLE) FOR x IN embedding] AS v FROM embeddings),
m AS (SELECT label, i, avg(x) AS m FROM (SELECT label, unnest(v) AS x, generate_subscripts(v, 1) AS i FROM v) GROUP BY ALL),
c AS (SELECT label, list(m ORDER BY i) AS c FROM m GROUP BY label)
SELECT vec_id, round(list_dot_product(v, c) / sqrt(list_dot_product(c, c)), 6) AS sim FROM v JOIN c USING (label)""")
def centroid_similarity(spark, d):
    e = table(spark, d, "embeddings")
    return e.join(V.centroid(e, ["label"], "embedding"), "label").select("vec_id", F.round(V.dot(F.col("embedding"), F.col("centroid")), 6).alias("sim"))


@query("centroid_interpolation", """
WITH v AS (SELECT vec_id, label, [CAST(x AS DOUBLE) FOR x IN embedding] AS v FROM embeddings),
m AS (SELECT label, i, avg(x) AS m FROM (SELECT label, unnest(v) AS x, generate_subscripts(v, 1) AS i FROM v) GROUP BY ALL),
c0 AS (SELECT label, list(m ORDER BY i) AS c FROM m GROUP BY label),
c AS (SELECT label, list_transform(c, lambda x: x / sqrt(list_dot_product(c, c))) AS c FROM c0),
z AS (SELECT vec_id, v, list_transform(list_zip(v, c), lambda p: 0.7e0 * p[1] + 0.3e0 * p[2]) AS q FROM v JOIN c USING (label))
SELECT vec_id, round(list_dot_product(v, q) / sqrt(list_dot_product(q, q)), 6) AS sim FROM z""")
def centroid_interpolation(spark, d):
    e = table(spark, d, "embeddings")
    z = e.join(V.centroid(e, ["label"], "embedding"), "label")
    return z.select("vec_id", F.round(V.dot(F.col("embedding"), V.interpolate(F.transform("embedding", lambda x: x.cast("double")), F.col("centroid"), 0.3)), 6).alias("sim"))


@query("embedding_cache_validation", """
SELECT label, count(*) AS n, count(*) FILTER (len(embedding) <> 64) AS bad_size,
  count(*) FILTER (abs(sqrt(list_dot_product([CAST(x AS DOUBLE) FOR x IN embedding], [CAST(x AS DOUBLE) FOR x IN embedding])) - 1) > 1e-4) AS bad_norm,
  count(*) FILTER (len(list_filter(embedding, lambda x: isnan(x))) > 0) AS bad_value FROM embeddings GROUP BY label""")
def cache_validation(spark, d):
    v = F.col("embedding")
    return table(spark, d, "embeddings").groupBy("label").agg(
        F.count(F.lit(1)).alias("n"), F.count_if(F.size(v) != 64).alias("bad_size"),
        F.count_if(F.abs(F.sqrt(V.dot(v, v)) - 1) > 1e-4).alias("bad_norm"), F.count_if(F.exists(v, F.isnan)).alias("bad_value"))


_A = sql("anchors")
_RN = "row_number() OVER (PARTITION BY case_id ORDER BY {} DESC, anchor_id)"


def _two_ranks(spark, d):
    a = fixture(spark, d, "anchors")
    return R.rank(R.rank(a, ["case_id"], "score_a", "anchor_id", "ra"), ["case_id"], "score_b", "anchor_id", "rb")


@query("rank_score_desc_id_asc", _A + f" SELECT anchor_id, {_RN.format('round(score_a, 9)')} AS rn FROM anchors")
def rank_asc(spark, d):
    return R.rank(fixture(spark, d, "anchors"), ["case_id"], "score_a", "anchor_id").select("anchor_id", "rn")


@query("rank_score_desc_id_desc", _A + " SELECT anchor_id, row_number() OVER (PARTITION BY case_id ORDER BY round(score_b, 9) DESC, anchor_id DESC) AS rn FROM anchors")
def rank_desc(spark, d):
    return R.rank(fixture(spark, d, "anchors"), ["case_id"], "score_b", "anchor_id", tie_desc=True).select("anchor_id", "rn")


@query("top3_per_case", _A + f" SELECT case_id, anchor_id, rn FROM (SELECT *, {_RN.format('round(score_a, 9)')} AS rn FROM anchors) WHERE rn <= 3")
def top3(spark, d):
    return R.top_k(fixture(spark, d, "anchors"), ["case_id"], "score_a", "anchor_id", 3).select("case_id", "anchor_id", "rn")


@query("first_positive_rank", _A + f", r AS (SELECT *, {_RN.format('round(score_b, 9)')} AS rn FROM anchors) SELECT case_id, min(rn) FILTER (positive) AS first_rank, arg_min(anchor_id, rn) FILTER (positive) AS first_id, count(*) AS n FROM r GROUP BY case_id")
def first_positive(spark, d):
    r = R.rank(fixture(spark, d, "anchors"), ["case_id"], "score_b", "anchor_id")
    return R.first_positive(r, ["case_id"], "rn", "positive", "anchor_id", "score_b").select("case_id", "first_rank", "first_id", "n")


@query("zscore_fusion", _A + """, z AS (SELECT case_id, anchor_id, score_a, score_b, avg(score_a) OVER w AS ma, stddev_pop(score_a) OVER w AS sa,
  avg(score_b) OVER w AS mb, stddev_pop(score_b) OVER w AS sb FROM anchors WINDOW w AS (PARTITION BY case_id))
SELECT anchor_id, round(CASE WHEN sa <= 1e-12 THEN 0 ELSE (score_a - ma) / sa END + CASE WHEN sb <= 1e-12 THEN 0 ELSE (score_b - mb) / sb END, 5) AS z FROM z""")
def zscore_fusion(spark, d):
    a = R.zscore(R.zscore(fixture(spark, d, "anchors"), ["case_id"], "score_a", "za"), ["case_id"], "score_b", "zb")
    return a.select("anchor_id", F.round(F.col("za") + F.col("zb"), 5).alias("z"))


@query("rrf_full_lists", _A + f""", r AS (SELECT *, {_RN.format('round(score_a, 9)')} AS ra, {_RN.format('round(score_b, 9)')} AS rb FROM anchors),
s AS (SELECT *, 0e0 + 1e0 / (60 + ra) + 1e0 / (60 + rb) AS score FROM r)
SELECT anchor_id, {_RN.format('round(score, 9)')} AS rn FROM s""")
def rrf_full(spark, d):
    r = _two_ranks(spark, d)
    return R.rank(r.withColumn("score", R.rrf(F.col("ra"), F.col("rb"))), ["case_id"], "score", "anchor_id").select("anchor_id", "rn")


@query("residual_three_lane_rrf", _A + f""", r AS (SELECT *, {_RN.format('round(score_a, 9)')} AS ra, {_RN.format('round(score_b, 9)')} AS rb, {_RN.format('round(disc, 9)')} AS rc FROM anchors),
s AS (SELECT *, 0e0 + 1e0 / (60 + ra) + 1e0 / (60 + rb) + 1e0 / (60 + rc) AS score FROM r)
SELECT anchor_id, {_RN.format('round(score, 9)')} AS rn FROM s""")
def rrf_three(spark, d):
    r = R.rank(_two_ranks(spark, d), ["case_id"], "disc", "anchor_id", "rc")
    return R.rank(r.withColumn("score", R.rrf(F.col("ra"), F.col("rb"), F.col("rc"))), ["case_id"], "score", "anchor_id").select("anchor_id", "rn")


_WRRF = _A + f""", r AS (SELECT case_id, concat(file, ':', CAST(s AS VARCHAR)) AS span, {_RN.format('round(score_a, 9)')} AS ra, {_RN.format('round(score_b, 9)')} AS rb FROM anchors),
l AS (SELECT case_id, span, max(ra) AS lr, min(ra) AS la FROM r WHERE ra <= 4 GROUP BY ALL),
q AS (SELECT case_id, span, max(rb) AS rr, min(rb) AS qa FROM r WHERE rb <= 4 GROUP BY ALL),
f AS (SELECT case_id, span, lr, rr, la, qa, coalesce(1.5e0 / (60 + lr), 0) + coalesce(1e0 / (60 + rr), 0) AS score FROM l FULL JOIN q USING (case_id, span))
SELECT case_id, span, lr AS left_rank, rr AS right_rank, row_number() OVER (PARTITION BY case_id ORDER BY round(score, 9) DESC, la NULLS LAST, qa NULLS LAST) AS rank FROM f"""


@query("weighted_rrf_partial_lists", _WRRF)
def weighted_rrf(spark, d):
    r = _two_ranks(spark, d).withColumn("span", F.concat_ws(":", "file", F.col("s").cast("string")))
    side = lambda c: r.select("case_id", "span", F.col(c).alias("pos"))
    return R.weighted_rrf(side("ra"), side("rb"), "case_id", "span", "pos", cap=4).select("case_id", "span", "left_rank", "right_rank", "rank")


@query("lane_allocation_queue", _A + f""", r AS (SELECT *, {_RN.format('round(score_a, 9)')} AS ra, {_RN.format('round(score_b, 9)')} AS rb FROM anchors),
l AS (SELECT case_id, anchor_id, 0 AS lane, ra AS rn FROM r WHERE ra <= 3 UNION ALL SELECT case_id, anchor_id, 1, rb FROM r WHERE rb <= 2),
f AS (SELECT case_id, anchor_id, min(lane * 1000 + rn) AS k FROM l GROUP BY ALL)
SELECT case_id, anchor_id, CAST(k // 1000 AS INTEGER) AS lane, row_number() OVER (PARTITION BY case_id ORDER BY k) AS queue_rank FROM f""")
def lane_queue(spark, d):
    r = _two_ranks(spark, d)
    lanes = r.select("case_id", "anchor_id", F.lit(0).alias("lane"), F.col("ra").alias("rn")).unionByName(
        r.select("case_id", "anchor_id", F.lit(1).alias("lane"), F.col("rb").alias("rn")))
    return R.lane_queue(lanes, "case_id", "anchor_id", "lane", "rn", {0: 3, 1: 2})


@query("ledger_keep_last", sql("ledger") + " SELECT task_id, max(ord) AS ord, arg_max(status, ord) AS status, arg_max(tokens, ord) AS tokens FROM ledger GROUP BY task_id")
def keep_last(spark, d):
    g = fixture(spark, d, "ledger").select("task_id", "ord", "status", "tokens")
    return R.keep_last(g.withColumn("_o", F.col("ord")), ["task_id"], "_o").drop("_o")


@query("ledger_keep_first", sql("ledger") + " SELECT task_id, status, min(ord) AS ord FROM ledger GROUP BY task_id, status")
def keep_first(spark, d):
    g = fixture(spark, d, "ledger").select("task_id", "status", "ord")
    return R.keep_first(g.withColumn("_o", F.col("ord")), ["task_id", "status"], "_o").drop("_o")


@query("chunk_index", sql("ledger") + " SELECT ord, CAST(floor((row_number() OVER (PARTITION BY task_id ORDER BY ord) - 1) / 4) + 1 AS BIGINT) AS chunk FROM ledger")
def chunk_index(spark, d):
    return R.chunk_index(fixture(spark, d, "ledger"), ["task_id"], "ord", 4).select("ord", "chunk")


@query("hash_ordered_ranking", _A + " SELECT anchor_id, row_number() OVER (PARTITION BY case_id ORDER BY sha256(concat(CAST(case_id AS VARCHAR), '|', anchor_id))) AS rn FROM anchors")
def hash_order(spark, d):
    return R.hash_order(fixture(spark, d, "anchors"), ["case_id"], ["case_id", "anchor_id"]).select("anchor_id", "rn")


@query("rank_delta_chain", sql("ledger") + " SELECT ord, CAST(lag(rk) OVER (PARTITION BY task_id ORDER BY ord) - rk AS BIGINT) AS delta FROM (SELECT *, ord % 101 AS rk FROM ledger)")
def rank_delta(spark, d):
    return R.rank_delta(fixture(spark, d, "ledger").withColumn("rk", F.col("ord") % 101), "task_id", "ord", "rk").select("ord", "delta")


@query("judge_reranking", _A + """ SELECT case_id, min(rn) FILTER (positive) AS best_rank FROM (
  SELECT *, row_number() OVER (PARTITION BY case_id ORDER BY disc DESC, CASE WHEN score_b > 30 THEN 0 WHEN score_b > 15 THEN 1 ELSE 2 END, pos, anchor_id) AS rn FROM anchors) GROUP BY case_id""")
def judge_rerank(spark, d):
    prio = F.when(F.col("score_b") > 30, 0).when(F.col("score_b") > 15, 1).otherwise(2)
    w = Window.partitionBy("case_id").orderBy(F.col("disc").desc(), prio, "pos", "anchor_id")
    return fixture(spark, d, "anchors").withColumn("rn", F.row_number().over(w)).groupBy("case_id").agg(F.min(F.when(F.col("positive"), F.col("rn"))).alias("best_rank"))


_R = sql("ranks")
_BUDGETS = [30, 50, 100, 200, 300, 500]


@query("hit_at_k_mrr", _R + " SELECT split, " + ", ".join(f"count(*) FILTER (left_rank <= {k}) AS hit_{k}, round(count(*) FILTER (left_rank <= {k}) / count(*), 6) AS rate_{k}" for k in _BUDGETS) + ", round(sum(coalesce(1e0 / left_rank, 0)) / count(*), 6) AS mrr FROM ranks GROUP BY split")
def hit_at_k(spark, d):
    return fixture(spark, d, "ranks").groupBy("split").agg(*M.hit_columns("left_rank", _BUDGETS), F.round(M.mrr("left_rank"), 6).alias("mrr"))


@query("rank_percentiles", _R + " SELECT track, " + ", ".join(f"round(quantile_cont(left_rank, {p}), 6) AS p{int(p * 100)}" for p in (0.25, 0.5, 0.75, 0.9, 0.95, 0.99)) + ", CAST(quantile_disc(left_rank, 0.5) AS BIGINT) AS nearest FROM ranks GROUP BY track")
def rank_percentiles(spark, d):
    return fixture(spark, d, "ranks").groupBy("track").agg(*M.percentiles("left_rank", [0.25, 0.5, 0.75, 0.9, 0.95, 0.99]), M.nearest_rank("left_rank", 0.5).cast("long").alias("nearest"))


@query("review_budget", _R + """ SELECT track, """ + ", ".join(f"CAST(list_sort(list(left_rank) FILTER (left_rank IS NOT NULL))[CAST(ceil(count(*) * {s}e0) AS BIGINT)] AS BIGINT) AS b{int(s * 100)}" for s in (0.25, 0.5, 0.75, 0.9)) + " FROM ranks GROUP BY track")
def review_budget(spark, d):
    return M.coverage_budgets(fixture(spark, d, "ranks"), "left_rank", [0.25, 0.5, 0.75, 0.9], ["track"])


@query("method_split_slice_metrics", _R + """, u AS (SELECT split, candidate_count, 'left' AS method, left_rank AS r FROM ranks UNION ALL SELECT split, candidate_count, 'right', right_rank FROM ranks),
s AS (SELECT *, 'all' AS slice FROM u UNION ALL SELECT *, 'gt1200' FROM u WHERE candidate_count > 1200 UNION ALL SELECT *, 'gt1400' FROM u WHERE candidate_count > 1400)
SELECT method, split, slice, count(*) AS n, count(*) FILTER (r <= 100) AS hits, round(sum(coalesce(1e0 / r, 0)) / count(*), 6) AS mrr FROM s GROUP BY ALL""")
def method_split_slice(spark, d):
    u = fixture(spark, d, "ranks").unpivot(["split", "candidate_count"], ["left_rank", "right_rank"], "method", "r")
    n = F.col("candidate_count")
    slices = F.array_compact(F.array(F.lit("all"), F.when(n > 1200, "gt1200"), F.when(n > 1400, "gt1400")))
    s = u.withColumn("method", F.regexp_replace("method", "_rank", "")).withColumn("slice", F.explode(slices))
    return s.groupBy("method", "split", "slice").agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("r") <= 100).alias("hits"), F.round(M.mrr("r"), 6).alias("mrr"))


@query("grouping_sets_rollup", _R + " SELECT coalesce(split, '*') AS split, coalesce(track, '*') AS track, count(*) AS n, count(left_rank) AS hits FROM ranks GROUP BY GROUPING SETS ((split), (track), ())")
def grouping_sets(spark, d):
    g = fixture(spark, d, "ranks").groupingSets([[F.col("split")], [F.col("track")], []], F.col("split"), F.col("track"))
    return g.agg(F.count(F.lit(1)).alias("n"), F.count("left_rank").alias("hits")).select(F.coalesce("split", F.lit("*")).alias("split"), F.coalesce("track", F.lit("*")).alias("track"), "n", "hits")


_L, _G = "coalesce(left_rank <= 200, false)", "coalesce(right_rank <= 200, false)"


@query("vector_cache_fallback", """WITH e AS (SELECT vec_id, [CAST(x AS DOUBLE) FOR x IN embedding] AS v FROM embeddings),
s AS (SELECT vec_id, n, CASE WHEN (vec_id + n) % 7 = 0 THEN 'miss' WHEN vec_id % 3 = n % 3 THEN 'stale' WHEN (vec_id + n) % 7 = 1 THEN 'bad_shape' WHEN (vec_id + n) % 7 = 2 THEN 'bad_norm' WHEN abs(sqrt(list_dot_product(v, v)) - 1) > 1e-4 THEN 'bad_norm' ELSE 'hit' END AS state FROM e, range(1, 4) t(n))
SELECT vec_id, CAST(min(n) FILTER (state = 'hit') AS INTEGER) AS place, string_agg(state, ',' ORDER BY n) AS states FROM s GROUP BY vec_id""")
def cache_fallback(spark, d):
    """Three caches with gaps, old fingerprints, short and long vectors; the first sound one answers."""
    e = table(spark, d, "embeddings").select("vec_id", "embedding")
    caches = []
    for n in (1, 2, 3):
        form = (F.col("vec_id") + n) % 7
        v = F.when(form == 1, F.slice("embedding", 1, 63)).when(form == 2, F.transform("embedding", lambda x: x * 2)).otherwise(F.col("embedding"))
        print_ = F.when(F.col("vec_id") % 3 == n % 3, "old").otherwise(F.col("vec_id").cast("string"))
        caches.append(e.where(form > 0).select("vec_id", print_.alias("fingerprint"), v.alias("embedding")))
    wanted = e.select("vec_id", F.col("vec_id").cast("string").alias("expected"))
    return V.first_hit(wanted, caches, "vec_id", "expected", 64).select("vec_id", "place", F.array_join("states", ",").alias("states"))


@query("query_vectors_by_text", "SELECT vec_id, round(list_sum([CAST(x AS DOUBLE) FOR x IN embedding]) / sqrt(list_dot_product([CAST(x AS DOUBLE) FOR x IN embedding], [CAST(x AS DOUBLE) FOR x IN embedding])), 6) AS total FROM embeddings")
def vectors_by_text(spark, d):
    e = table(spark, d, "embeddings").select("vec_id", F.concat(F.lit("text of "), F.col("vec_id").cast("string")).alias("text"), F.transform("embedding", lambda x: x.cast("double") * 3).alias("embedding"))
    q = V.query_vectors(e.select("vec_id", "text"), e.select("text", "embedding"), "text", "embedding")
    return q.select("vec_id", F.round(F.aggregate("embedding", F.lit(0.0), lambda n, x: n + x), 6).alias("total"))


_RANKS = sql("ranks")


@query("rank_metric_summary", _RANKS + """ SELECT track, count(*) AS n, round(count(*) FILTER (left_rank <= 50) / count(*), 9) AS r_at_50, round(sum(coalesce(1e0 / left_rank, 0)) / count(*), 9) AS mrr,
min(left_rank) AS first_min, round(quantile_cont(left_rank, 0.5), 6) AS first_median, max(left_rank) AS first_max, round(min(left_rank / candidate_count), 9) AS norm_min, round(quantile_cont(left_rank / candidate_count, 0.5), 9) AS norm_median, round(max(left_rank / candidate_count), 9) AS norm_max FROM ranks GROUP BY track""")
def rank_summary(spark, d):
    """Misses stay in the rates; the distributions are of the ranks that are there."""
    n, rank = F.count(F.lit(1)), F.col("left_rank")
    norm = rank / F.col("candidate_count")
    return fixture(spark, d, "ranks").groupBy("track").agg(
        n.alias("n"), F.round(F.count_if(rank <= 50) / n, 9).alias("r_at_50"), F.round(F.sum(F.coalesce(1.0 / rank, F.lit(0.0))) / n, 9).alias("mrr"),
        F.min(rank).alias("first_min"), F.round(F.percentile(rank, 0.5), 6).alias("first_median"), F.max(rank).alias("first_max"),
        F.round(F.min(norm), 9).alias("norm_min"), F.round(F.percentile(norm, 0.5), 9).alias("norm_median"), F.round(F.max(norm), 9).alias("norm_max"))


@query("paired_rescue_rows", _RANKS + " SELECT identity_key, CASE WHEN coalesce(right_rank <= 50, false) THEN 'rescued' ELSE 'regressed' END AS side, left_rank, right_rank FROM ranks WHERE coalesce(left_rank <= 50, false) <> coalesce(right_rank <= 50, false)")
def rescue_rows(spark, d):
    """The cases that one side alone hits, as rows and not as counts."""
    hit = lambda c: F.coalesce(F.col(c) <= 50, F.lit(False))
    r = fixture(spark, d, "ranks").where(hit("left_rank") != hit("right_rank"))
    return r.select("identity_key", F.when(hit("right_rank"), "rescued").otherwise("regressed").alias("side"), "left_rank", "right_rank")


@query("paired_rescue_regression", _R + f" SELECT track, count(*) FILTER ({_L} AND {_G}) AS both, count(*) FILTER ({_L} AND NOT {_G}) AS left_only, count(*) FILTER (NOT {_L} AND {_G}) AS right_only, count(*) FILTER (NOT {_L} AND NOT {_G}) AS neither FROM ranks GROUP BY track")
def paired(spark, d):
    return fixture(spark, d, "ranks").groupBy("track").agg(*M.paired("left_rank", "right_rank", 200))


@query("best_method_delta", _R + """, m AS (SELECT track, round(sum(coalesce(1e0 / left_rank, 0)) / count(*), 6) AS l, round(sum(coalesce(1e0 / right_rank, 0)) / count(*), 6) AS r FROM ranks GROUP BY track)
SELECT track, CASE WHEN l >= r THEN 'left' ELSE 'right' END AS best, round(r - l, 6) AS delta FROM m""")
def best_method(spark, d):
    m = fixture(spark, d, "ranks").groupBy("track").agg(F.round(M.mrr("left_rank"), 6).alias("left"), F.round(M.mrr("right_rank"), 6).alias("right"))
    u = m.unpivot(["track"], ["left", "right"], "method", "v").withColumn("o", F.when(F.col("method") == "left", 0).otherwise(1))
    return M.best_method(u, ["track"], "method", "v", "o").join(m, "track").select("track", "best", F.round(F.col("right") - F.col("left"), 6).alias("delta"))


_F = sql("findings")


@query("prf_localization", _F + """, c AS (SELECT case_id, bool_or(hit AND alarm) AS tp FROM findings GROUP BY case_id),
x AS (SELECT (SELECT count(*) FILTER (tp) * 1e0 / count(*) FROM c) AS recall, count(*) FILTER (hit AND alarm) * 1e0 / count(*) FILTER (alarm) AS prec FROM findings)
SELECT round(recall, 6) AS recall, round(prec, 6) AS prec, round(2 * recall * prec / (recall + prec), 6) AS f1 FROM x""")
def prf_localization(spark, d):
    f = fixture(spark, d, "findings")
    c = f.groupBy("case_id").agg(F.bool_or(F.col("hit") & F.col("alarm")).alias("tp")).agg(M.ratio(F.count_if("tp"), F.count(F.lit(1))).alias("recall"))
    x = f.agg(M.ratio(F.count_if(F.col("hit") & F.col("alarm")), F.count_if("alarm")).alias("prec")).crossJoin(c)  # one row each
    return x.select(F.round("recall", 6).alias("recall"), F.round("prec", 6).alias("prec"), F.round(M.f1_harmonic(F.col("recall"), F.col("prec")), 6).alias("f1"))


@query("prf_ablation", _F + """, c AS (SELECT case_id, CAST(bool_or(hit AND alarm) AS INTEGER) AS tp, count(*) FILTER (alarm AND NOT hit) AS fp, greatest(count(*) FILTER (alarm AND hit) - 1, 0) AS extra FROM findings GROUP BY case_id),
t AS (SELECT sum(tp) AS tp, sum(fp) AS fp, count(*) - sum(tp) AS fn, sum(extra) AS extra FROM c)
SELECT CAST(tp AS BIGINT) AS tp, CAST(fp AS BIGINT) AS fp, CAST(fn AS BIGINT) AS fn, CAST(extra AS BIGINT) AS extra_truth_hit, round(2e0 * tp / (2e0 * tp + fp + fn), 6) AS f1 FROM t""")
def prf_ablation(spark, d):
    hit = F.count_if(F.col("alarm") & F.col("hit"))
    c = fixture(spark, d, "findings").groupBy("case_id").agg(F.least(hit, F.lit(1)).alias("tp"), F.count_if(F.col("alarm") & ~F.col("hit")).alias("fp"), F.greatest(hit - 1, F.lit(0)).alias("extra"))
    t = c.agg(F.sum("tp").alias("tp"), F.sum("fp").alias("fp"), (F.count(F.lit(1)) - F.sum("tp")).alias("fn"), F.sum("extra").alias("extra_truth_hit"))
    return t.withColumn("f1", F.round(M.f1_counts(F.col("tp"), F.col("fp"), F.col("fn")), 6))


@query("case_tier_rollup", _F + " SELECT tier, count(*) AS n FROM (SELECT CASE WHEN bool_or(hit AND alarm) THEN 'exact' WHEN bool_or(alarm) THEN 'near' ELSE 'none' END AS tier FROM findings GROUP BY case_id) GROUP BY tier")
def case_tier(spark, d):
    tier = F.when(F.bool_or(F.col("hit") & F.col("alarm")), "exact").when(F.bool_or("alarm"), "near").otherwise("none")
    return fixture(spark, d, "findings").groupBy("case_id").agg(tier.alias("tier")).groupBy("tier").agg(F.count(F.lit(1)).alias("n"))


@query("sarif_asymmetric_precision", _F + " SELECT count(*) FILTER (hit) AS alarm_hits, count(*) FILTER (alarm) AS alarms, round(count(*) FILTER (hit) / count(*) FILTER (alarm), 6) AS prec, round(count(*) FILTER (hit AND alarm) / count(*) FILTER (alarm), 6) AS corrected FROM findings")
def sarif_precision(spark, d):
    return fixture(spark, d, "findings").agg(
        F.count_if("hit").alias("alarm_hits"), F.count_if("alarm").alias("alarms"), F.round(M.ratio(F.count_if("hit"), F.count_if("alarm")), 6).alias("prec"),
        F.round(M.ratio(F.count_if(F.col("hit") & F.col("alarm")), F.count_if("alarm")), 6).alias("corrected"))

"""Queries over review operators: triage, coverage, worklists, judges, lexicons, selections, gates, projections."""

from __future__ import annotations

from pyspark.sql import functions as F

from rankwright.functions import text as X
from rankwright.operators import boundaries as B
from rankwright.operators import grouping as G
from rankwright.operators import projection as P
from rankwright.operators import ranking as R
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


_B, _C, _BR = sql("boundaries"), sql("cases"), sql("boundaries", "ranks")
_LABELS, _BUDGETS = ["left", "right"], [50, 200]
_STATES = list(B.RECALL_STATES)
# a table that lacks some identities is what this operator is about
_RECALL = _BR + f""", m AS (SELECT b_id, unnest([r1, r2, r3]) AS identity FROM boundaries),
t AS (SELECT 'left' AS label, identity_key AS identity, left_rank AS rank FROM ranks WHERE identity_key % 11 > 0 UNION ALL SELECT 'right', identity_key, right_rank FROM ranks),
x AS (SELECT b_id, l.label, m.identity, t.identity IS NOT NULL AS present, rank FROM m CROSS JOIN (VALUES ('left'), ('right')) l(label) LEFT JOIN t ON t.label = l.label AND t.identity = m.identity),
g AS (SELECT b_id, label, count(*) AS representatives, count(*) FILTER (present) AS present, count(*) FILTER (rank <= 50) AS hit_50, count(*) FILTER (rank <= 200) AS hit_200 FROM x GROUP BY ALL),
r AS (SELECT *, CASE WHEN present < representatives THEN '{_STATES[0]}' WHEN present = 0 THEN '{_STATES[1]}' WHEN hit_200 = present THEN '{_STATES[2]}' WHEN hit_200 = 0 THEN '{_STATES[3]}' ELSE '{_STATES[4]}' END AS status FROM g)"""


def _recall(spark, d):
    m = fixture(spark, d, "boundaries").select("b_id", F.explode(F.array("r1", "r2", "r3")).alias("identity"))
    r = fixture(spark, d, "ranks").withColumnRenamed("identity_key", "identity").withColumn("ord", F.lit(0))
    left = r.where("identity % 11 > 0").select(F.lit("left").alias("label"), "identity", F.col("left_rank").alias("rank"), "ord")
    right = r.select(F.lit("right").alias("label"), "identity", F.col("right_rank").alias("rank"), "ord")
    return B.recall_by_boundary(m, left.unionByName(right), "b_id", _LABELS, _BUDGETS, 200)


@query("boundary_recall", _RECALL + " SELECT b_id, label, representatives, present, hit_50, hit_200, round(hit_200 * 1e0 / nullif(present, 0), 6) AS rate_present, round(hit_200 * 1e0 / representatives, 6) AS rate_all, status FROM r")
def boundary_recall(spark, d):
    return _recall(spark, d).withColumn("rate_present", F.round("rate_present", 6)).withColumn("rate_all", F.round("rate_all", 6))


@query("boundary_triage", _RECALL + f""", s AS (SELECT b_id, list(status) AS s FROM r GROUP BY 1)
SELECT b_id, CASE WHEN NOT bal > 0 THEN '{B.NEXT_ACTIONS[0]}' WHEN s IS NULL THEN '{B.NEXT_ACTIONS[1]}' WHEN list_has_any(s, ['{_STATES[0]}', '{_STATES[1]}']) THEN '{B.NEXT_ACTIONS[2]}'
  WHEN list_has_any(s, ['{_STATES[3]}', '{_STATES[4]}']) THEN '{B.NEXT_ACTIONS[3]}' ELSE '{B.NEXT_ACTIONS[4]}' END AS next_action FROM boundaries LEFT JOIN s USING (b_id)""")
def boundary_triage(spark, d):
    return B.triage(fixture(spark, d, "boundaries"), _recall(spark, d), "b_id", F.col("bal") > 0).select("b_id", "next_action")


_ACTIONS = ["split_mechanism_boundary", "revise_mechanism_text_from_evidence", "collect_source_sink_guard_evidence", "keep_as_control_group", "other"]
_ACTION_OF = "CASE n_nationkey % 5 " + " ".join(f"WHEN {k} THEN '{a}'" for k, a in enumerate(_ACTIONS)) + " END"
_COVER = _B + f""", v AS (SELECT guideline_id, label, bal > -500 AS valid FROM boundaries WHERE b_id % 5 > 0), j AS (SELECT guideline_id, label, CASE WHEN b_id % 7 = 0 THEN '' WHEN b_id % 6 < 4 THEN 'accept' ELSE 'revise' END AS verdict FROM boundaries WHERE b_id % 4 > 0),
w AS (SELECT n_nationkey + 2 AS guideline_id, {_ACTION_OF} AS action FROM nation),
x AS (SELECT b.*, v.label IS NOT NULL AS seen, v.valid, j.label IS NOT NULL AS jd, j.verdict FROM boundaries b LEFT JOIN v USING (guideline_id, label) LEFT JOIN j USING (guideline_id, label)),
g AS (SELECT guideline_id, count(*) AS boundaries, count(*) FILTER (seen AND valid) AS valid_n, count(*) FILTER (seen AND NOT valid) AS invalid_n, count(*) FILTER (decision = 'promote_boundary' AND coalesce(valid, true)) AS promotable_n,
  count(*) FILTER (decision = 'promote_boundary' AND coalesce(valid, true) AND verdict = 'accept') AS accepted_n, count(*) FILTER (decision = 'promote_boundary' AND coalesce(valid, true) AND NOT jd) AS unjudged_n,
  count(*) FILTER (coalesce(verdict, '') <> '' AND verdict <> 'accept') AS other_n FROM x GROUP BY 1),
y AS (SELECT w.guideline_id, w.action, coalesce(boundaries, 0) AS boundaries, coalesce(valid_n, 0) AS valid_n, coalesce(invalid_n, 0) AS invalid_n, coalesce(promotable_n, 0) AS promotable_n, coalesce(accepted_n, 0) AS accepted_n, coalesce(unjudged_n, 0) AS unjudged_n, coalesce(other_n, 0) AS other_n FROM w LEFT JOIN g USING (guideline_id)),
z AS (SELECT *, CASE WHEN boundaries = 0 THEN 'not_source_reviewed' WHEN invalid_n > 0 THEN 'invalid_ledger' WHEN promotable_n > 0 AND accepted_n = promotable_n THEN 'source_reviewed_and_judge_accepted' WHEN promotable_n > 0 AND unjudged_n > 0 THEN 'source_reviewed_validation_only'
  WHEN other_n > 0 THEN 'source_reviewed_needs_more_evidence' ELSE 'source_reviewed_no_promoted_boundary' END AS coverage_status FROM y)
SELECT *, CASE WHEN action = 'keep_as_control_group' AND boundaries = 0 THEN 'optional_control_source_review' ELSE CASE coverage_status """ + " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in B.COVERAGE.items()) + " END END AS next_action FROM z"


def _worklist(spark, d):
    action = F.create_map(*[x for k, a in enumerate(_ACTIONS) for x in (F.lit(k), F.lit(a))])[(F.col("n_nationkey") % 5).cast("int")]
    return table(spark, d, "nation").select((F.col("n_nationkey") + 2).alias("guideline_id"), action.alias("action"))


@query("evidence_coverage", _COVER)
def evidence_coverage(spark, d):
    b = fixture(spark, d, "boundaries")
    v = b.where("b_id % 5 > 0").select("guideline_id", "label", (F.col("bal") > -500).alias("valid"))
    verdict = F.when(F.col("b_id") % 7 == 0, "").when(F.col("b_id") % 6 < 4, "accept").otherwise("revise")
    j = b.where("b_id % 4 > 0").select("guideline_id", "label", verdict.alias("verdict"))
    return B.coverage(_worklist(spark, d), b.select("guideline_id", "label", "decision"), v, j, "guideline_id", "label")


_GAP_CASE = "CASE action " + " ".join(f"WHEN '{k}' THEN {v}" for k, v in B.GAPS.items()) + f" ELSE ['{B.OTHER_GAP}'] END"


@query("evidence_gaps", _C + f""", w AS (SELECT n_nationkey + 2 AS guideline_id, {_ACTION_OF} AS action FROM nation),
g AS (SELECT guideline_id, count(*) AS n, count(*) FILTER (bal < 0 OR identity % 4 = 0) AS weak, count(DISTINCT mechanism) > 4 AS mixed FROM cases WHERE guideline_id % 6 > 0 GROUP BY 1),
x AS (SELECT w.guideline_id, action, coalesce(n, 0) AS n, coalesce(weak, 0) AS weak, coalesce(mixed, false) AS mixed FROM w LEFT JOIN g USING (guideline_id))
SELECT guideline_id, n AS cases, array_to_string(list_sort(list_distinct(list_filter(list_concat({_GAP_CASE}, [CASE WHEN n = 0 THEN 'assigned_case_examples' END, CASE WHEN weak > 0 THEN 'source_level_trace_evidence' END, CASE WHEN mixed THEN 'mixed_membership_boundary' END,
  CASE WHEN guideline_id % 2 = 0 THEN 'candidate_split_validation' END]), lambda y: y IS NOT NULL))), ',') AS gaps FROM x""")
def evidence_gaps(spark, d):
    c = fixture(spark, d, "cases").where("guideline_id % 6 > 0")
    c = c.withColumn("state", B.evidence_state(F.col("identity") % 4 == 0, F.when(F.col("bal") >= 0, "trace")))
    g = c.groupBy("guideline_id").agg(F.count(F.lit(1)).alias("cases"), F.count_if(F.col("state") != "source_trace_present").alias("weak"), (F.countDistinct("mechanism") > 4).alias("mixed"))
    x = _worklist(spark, d).join(g, "guideline_id", "left").fillna(0, ["cases", "weak"]).fillna(False, ["mixed"])
    gaps = B.evidence_gaps(F.col("action"), F.col("cases"), F.col("weak"), F.col("mixed"), F.col("guideline_id") % 2 == 0)
    return x.select("guideline_id", "cases", F.array_join(gaps, ",").alias("gaps"))


@query("evidence_state_counts", _C + " SELECT CASE WHEN NOT bal >= 0 THEN 'missing_trace_evidence' WHEN identity % 4 = 0 THEN 'review_entry_only' ELSE 'source_trace_present' END AS state, count(*) AS n FROM cases GROUP BY 1")
def evidence_states(spark, d):
    s = B.evidence_state(F.col("identity") % 4 == 0, F.when(F.col("bal") >= 0, "trace"))
    return fixture(spark, d, "cases").groupBy(s.alias("state")).agg(F.count(F.lit(1)).alias("n"))


@query("judged_candidates", """WITH h AS (SELECT o_custkey AS item, o_orderkey AS cand, o_orderkey % 300 AS rank FROM orders WHERE o_orderstatus <> 'P'),
o AS (SELECT c_custkey AS item, CASE WHEN c_custkey % 5 = 0 THEN 'parse_error: bad json' ELSE 'parsed' END AS state FROM customer WHERE c_custkey % 7 > 0),
s AS (SELECT o_custkey AS item, o_orderkey AS cand, o_totalprice AS relevance FROM orders WHERE o_orderkey % 3 > 0),
k AS (SELECT h.*, coalesce(o.state, 'missing_output') AS state FROM h LEFT JOIN o USING (item)), p AS (SELECT s.* FROM s JOIN o USING (item) WHERE state = 'parsed'),
b AS (SELECT coalesce(k.item, p.item) AS item, CASE WHEN k.cand IS NULL THEN 'unknown_candidate' WHEN state <> 'parsed' THEN state WHEN p.cand IS NULL THEN 'missing_candidate_score' ELSE '' END AS parse_error, rank, relevance FROM k FULL JOIN p ON k.item = p.item AND k.cand = p.cand)
SELECT item, parse_error, count(*) AS n, count(relevance) AS scored, min(rank) AS best_rank FROM b GROUP BY ALL""")
def judged(spark, d):
    o = table(spark, d, "orders")
    hidden = o.where("o_orderstatus <> 'P'").select(F.col("o_custkey").alias("item"), F.col("o_orderkey").alias("cand"), (F.col("o_orderkey") % 300).alias("rank"))
    scores = o.where("o_orderkey % 3 > 0").select(F.col("o_custkey").alias("item"), F.col("o_orderkey").alias("cand"), F.col("o_totalprice").alias("relevance"))
    state = F.when(F.col("c_custkey") % 5 == 0, "parse_error: bad json").otherwise("parsed")
    outputs = table(spark, d, "customer").where("c_custkey % 7 > 0").select(F.col("c_custkey").alias("item"), state.alias("state"))
    return B.judged_candidates(hidden, scores, outputs, "item", "cand").groupBy("item", "parse_error").agg(F.count(F.lit(1)).alias("n"), F.count("relevance").alias("scored"), F.min("rank").alias("best_rank"))


@query("assignment_classes", _B + ", " + _C.removeprefix("WITH ") + """, m AS (SELECT b_id, guideline_id, unnest([r1, r2, r3]) AS identity FROM boundaries), a AS (SELECT DISTINCT identity, guideline_id AS g FROM cases UNION SELECT identity, guideline_id + 1 FROM cases WHERE identity % 6 = 0)
SELECT b_id, identity, CASE WHEN g IS NULL THEN 'absent' WHEN g = guideline_id THEN 'same_guideline' ELSE 'assigned_elsewhere' END AS assignment, CASE WHEN g <> guideline_id THEN g END AS elsewhere FROM m LEFT JOIN a USING (identity)""")
def assignment_classes(spark, d):
    m = fixture(spark, d, "boundaries").select("b_id", "guideline_id", F.explode(F.array("r1", "r2", "r3")).alias("identity"))
    c = fixture(spark, d, "cases")
    a = c.select("identity", "guideline_id").unionByName(c.where("identity % 6 = 0").select("identity", (F.col("guideline_id") + 1).alias("guideline_id")))
    return B.assignments(m, a, "b_id", "guideline_id")


@query("boundary_sidecar", _B + ", " + _C.removeprefix("WITH ") + """, p AS (SELECT b_id AS ord, guideline_id, label, CASE WHEN b_id % 4 = 0 THEN 'blocked' ELSE 'ready' END AS status FROM boundaries), t AS (SELECT guideline_id, label, CASE WHEN b_id % 5 = 0 THEN '' ELSE concat('text ', CAST(b_id % 30 AS VARCHAR(9))) END AS text FROM boundaries),
x AS (SELECT c.identity, label, ord, text FROM p JOIN t USING (guideline_id, label) JOIN cases c USING (guideline_id) WHERE status = 'ready' AND text <> '' AND c.bal > 0),
u AS (SELECT identity, text, min(ord) AS o FROM x GROUP BY ALL), n AS (SELECT identity, count(DISTINCT label) AS boundaries FROM x GROUP BY 1)
SELECT identity, string_agg(text, chr(10) || chr(10) ORDER BY o, text) AS guideline, any_value(boundaries) AS boundaries FROM u JOIN n USING (identity) GROUP BY identity""")
def boundary_sidecar(spark, d):
    b, c = fixture(spark, d, "boundaries"), fixture(spark, d, "cases")
    p = b.select(F.col("b_id").alias("ord"), "guideline_id", "label", F.when(F.col("b_id") % 4 == 0, "blocked").otherwise("ready").alias("status"))
    t = b.select("guideline_id", "label", F.when(F.col("b_id") % 5 == 0, "").otherwise(F.concat(F.lit("text "), (F.col("b_id") % 30).cast("string"))).alias("text"))
    return B.sidecar(p, t, c.select("identity", "guideline_id"), c.where("bal > 0"), "guideline_id", "label", ["ready"])


@query("work_items", """WITH m AS (SELECT c_nationkey AS cluster, list(c_custkey ORDER BY c_custkey) AS members FROM customer GROUP BY 1),
c AS (SELECT n_nationkey AS cluster, CASE WHEN n_nationkey % 3 > 0 THEN n_name END AS name, coalesce(members, []) AS members FROM nation LEFT JOIN m ON cluster = n_nationkey),
p AS (SELECT cluster, pos, CASE WHEN pos = 1 THEN concat('p', CAST(cluster AS VARCHAR(9))) END AS name, list_filter(members, lambda x: x % 4 = pos) AS members FROM c, (VALUES (1), (2)) q(pos) WHERE cluster % 4 > 0),
o AS (SELECT cluster, coalesce(name, 'sub_pattern_' || CAST(pos AS VARCHAR)) AS name, members, 'sub_pattern' AS kind FROM p WHERE len(members) > 0),
k AS (SELECT c.*, list_filter(members, lambda x: NOT (cluster % 4 > 0 AND x % 4 IN (1, 2))) AS rest FROM c),
f AS (SELECT cluster, coalesce(name, 'cluster_' || CAST(cluster AS VARCHAR)) AS name, CASE WHEN len(rest) > 0 THEN rest ELSE members END AS members, 'cluster_fallback' AS kind FROM k WHERE len(rest) > 0 OR cluster % 4 = 0)
SELECT cluster, name, kind, len(members) AS n, array_to_string(members, ',') AS members FROM (SELECT * FROM o UNION ALL SELECT * FROM f)""")
def work_items(spark, d):
    m = table(spark, d, "customer").groupBy(F.col("c_nationkey").alias("cluster")).agg(F.array_sort(F.collect_list("c_custkey")).alias("members"))
    n = table(spark, d, "nation").select(F.col("n_nationkey").alias("cluster"), F.when(F.col("n_nationkey") % 3 > 0, F.col("n_name")).alias("name"))
    c = n.join(m, "cluster", "left").withColumn("members", F.coalesce("members", F.array().cast("array<bigint>")))
    p = c.where("cluster % 4 > 0").select("cluster", "members", F.explode(F.array(F.lit(1), F.lit(2))).alias("pos"))
    p = p.select("cluster", "pos", F.when(F.col("pos") == 1, F.concat(F.lit("p"), F.col("cluster").cast("string"))).alias("name"), F.filter("members", lambda x: x % 4 == F.col("pos")).alias("members"))
    return B.work_items(c, p, "cluster").select("cluster", "name", "kind", F.size("members").cast("long").alias("n"), F.array_join(F.transform("members", lambda x: x.cast("string")), ",").alias("members"))


@query("evidence_support", """WITH r AS (SELECT l_orderkey AS item, l_quantity > 2 AS supported, CASE WHEN l_linenumber < 5 THEN l_returnflag END AS role, l_shipmode AS term FROM (SELECT *, CASE l_suppkey % 4 WHEN 0 THEN 'rail' WHEN 1 THEN 'air' WHEN 2 THEN 'ship' END AS l_shipmode FROM lineitem)),
a AS (SELECT item, bool_and(supported) AS supported FROM r GROUP BY 1), t AS (SELECT item, role, string_agg(DISTINCT term, '|' ORDER BY term) AS t FROM r WHERE role IS NOT NULL AND term IS NOT NULL GROUP BY ALL),
g AS (SELECT item, count(*) AS role_count, string_agg(role || '=' || t, ';' ORDER BY role || '=' || t) AS roles FROM t GROUP BY 1)
SELECT item, supported, coalesce(role_count, 0) AS role_count, coalesce(roles, '') AS roles FROM a LEFT JOIN g USING (item)""")
def evidence_support(spark, d):
    term = F.get(F.array(F.lit("rail"), F.lit("air"), F.lit("ship")), (F.col("l_suppkey") % 4).cast("int"))
    r = table(spark, d, "lineitem").select(F.col("l_orderkey").alias("item"), (F.col("l_quantity") > 2).alias("supported"), F.when(F.col("l_linenumber") < 5, F.col("l_returnflag")).alias("role"), term.alias("term"))
    return B.evidence_support(r, "item")


@query("lexicon_merge", """SELECT 1 AS file_ord, trim(n_name) AS mechanism_id, concat('name ', n_name) AS name, concat(lower(n_name), ',k', CAST(n_nationkey AS VARCHAR)) AS keywords FROM nation WHERE n_nationkey % 5 > 0 UNION ALL SELECT 2, concat('r_', r_name), r_name, lower(r_name) FROM region""")
def lexicon_merge(spark, d):
    n, r = table(spark, d, "nation"), table(spark, d, "region")
    seed = n.select(
        F.lit(1).alias("file_ord"), F.concat(F.lit(" "), "n_name", F.lit(" ")).alias("mechanism_id"), F.when(F.col("n_nationkey") % 5 > 0, F.concat(F.lit("name "), "n_name")).alias("name"),
        F.array(F.concat(F.lit(" "), "n_name"), F.lit("  "), F.concat(F.lit("K"), F.col("n_nationkey").cast("string"))).alias("keywords"))
    more = r.select(F.lit(2).alias("file_ord"), F.concat(F.lit("r_"), "r_name").alias("mechanism_id"), F.col("r_name").alias("name"), F.array("r_name").alias("keywords"))
    return B.merged_lexicon(seed.unionByName(more)).withColumn("keywords", F.array_join("keywords", ","))


@query("lexicon_duplicates", "SELECT c_mktsegment AS mechanism_id, count(*) AS n FROM customer GROUP BY 1 HAVING count(*) > 1")
def lexicon_duplicates(spark, d):
    return B.lexicon_duplicates(table(spark, d, "customer").select(F.col("c_mktsegment").alias("mechanism_id")))


@query("case_targets", """WITH b AS (SELECT o_orderkey AS ord, o_orderpriority AS track, o_custkey AS a, o_custkey + 1 AS b, o_orderkey % 50 AS c1, o_orderkey % 7 AS c2 FROM orders),
x AS (SELECT ord, track, unnest([a, b]) AS case_id, c1, c2 FROM b), h AS (SELECT case_id, count(*) AS source_targets, arg_min(track, ord) AS track FROM x GROUP BY 1),
c AS (SELECT case_id, count(DISTINCT c) AS candidates FROM (SELECT case_id, unnest([c1, c2]) AS c FROM x) GROUP BY 1) SELECT case_id, source_targets, track, candidates FROM h JOIN c USING (case_id)""")
def case_targets(spark, d):
    o = table(spark, d, "orders")
    return B.case_targets(o.select(F.col("o_orderkey").alias("ord"), F.col("o_orderpriority").alias("track"), F.array("o_custkey", F.col("o_custkey") + 1).alias("case_ids"), F.array(F.col("o_orderkey") % 50, F.col("o_orderkey") % 7).alias("candidate_ids")))


@query("pool_statistics", """WITH p AS (SELECT o_custkey AS case_id, o_orderstatus AS kind, o_orderkey % 5 = 0 AS positive FROM orders), k AS (SELECT case_id, string_agg(kind || ':' || CAST(n AS VARCHAR), ',' ORDER BY kind || ':' || CAST(n AS VARCHAR)) AS by_kind FROM (SELECT case_id, kind, count(*) AS n FROM p WHERE positive GROUP BY ALL) GROUP BY 1),
g AS (SELECT case_id, count(*) AS candidates, count(*) FILTER (positive) AS positives FROM p GROUP BY 1)
SELECT c_custkey AS case_id, coalesce(candidates, 0) AS candidates, coalesce(positives, 0) AS positives, coalesce(by_kind, '') AS by_kind, candidates IS NOT NULL AS present, coalesce(positives, 0) > 0 AS covered FROM customer LEFT JOIN g ON g.case_id = c_custkey LEFT JOIN k ON k.case_id = c_custkey""")
def pool_statistics(spark, d):
    p = table(spark, d, "orders").select(F.col("o_custkey").alias("case_id"), F.col("o_orderstatus").alias("kind"), (F.col("o_orderkey") % 5 == 0).alias("positive"))
    return B.pool_statistics(table(spark, d, "customer").select(F.col("c_custkey").alias("case_id")), p)


_A = sql("anchors")


@query("hard_competition", _A + """, g AS (SELECT case_id, count(*) AS n, count(*) FILTER (positive) AS p FROM anchors GROUP BY 1)
SELECT case_id, anchor_id, rn FROM (SELECT case_id, anchor_id, row_number() OVER (PARTITION BY case_id ORDER BY round(score_a, 9) DESC, anchor_id) AS rn FROM anchors JOIN g USING (case_id) WHERE NOT positive AND p > 0 AND n - p >= 2) WHERE rn <= 2""")
def hard_competition(spark, d):
    a = fixture(spark, d, "anchors").select("case_id", F.col("anchor_id").alias("cand"), F.col("score_a").alias("score"), "positive")
    return B.hard_competition(a, "case_id", 2)[0].select("case_id", F.col("cand").alias("anchor_id"), "rn")


@query("hard_competition_ledger", _A + """, g AS (SELECT case_id, count(*) AS n, count(*) FILTER (positive) AS p FROM anchors GROUP BY 1)
SELECT CASE WHEN p = 0 THEN 'no_positive' WHEN n - p < 2 THEN 'too_few_competitors' ELSE 'used' END AS state, count(*) AS cases, CAST(sum(n) AS BIGINT) AS candidates, CAST(sum(p) AS BIGINT) AS positives, CAST(sum(n - p) AS BIGINT) AS competitors FROM g GROUP BY 1""")
def hard_ledger(spark, d):
    a = fixture(spark, d, "anchors").select("case_id", F.col("anchor_id").alias("cand"), F.col("score_a").alias("score"), "positive")
    return B.hard_competition(a, "case_id", 2)[1].groupBy("state").agg(F.count(F.lit(1)).alias("cases"), *[F.sum(c).alias(c) for c in ("candidates", "positives", "competitors")])


@query("lane_tail_sample", _A + """, r AS (SELECT *, row_number() OVER (PARTITION BY case_id ORDER BY round(score_a, 9) DESC, anchor_id) AS ra, row_number() OVER (PARTITION BY case_id ORDER BY round(score_b, 9) DESC, anchor_id) AS rb FROM anchors),
x AS (SELECT case_id, anchor_id, CASE WHEN positive THEN 'positive' WHEN ra <= 1 OR rb <= 1 THEN 'lane' END AS reason FROM r),
y AS (SELECT *, row_number() OVER (PARTITION BY case_id ORDER BY sha256(concat(CAST(case_id AS VARCHAR), '|', anchor_id)), anchor_id) AS rn FROM x WHERE reason IS NULL)
SELECT case_id, anchor_id, reason FROM x WHERE reason IS NOT NULL UNION ALL SELECT case_id, anchor_id, 'tail' FROM y WHERE rn <= 1""")
def lane_tail(spark, d):
    a = fixture(spark, d, "anchors")
    r = R.rank(R.rank(a, ["case_id"], "score_a", "anchor_id", "ra"), ["case_id"], "score_b", "anchor_id", "rb")
    return B.tail_sample(r, "case_id", "anchor_id", ["ra", "rb"], 1, 1).select("case_id", "anchor_id", "reason")


# selections and gates


_SEL = "SELECT c_custkey AS identity, c_mktsegment = 'BUILDING' AS accepted, c_acctbal > 0 AS anchored FROM customer"


@query("case_selection_all", f"SELECT identity FROM ({_SEL}) WHERE accepted AND anchored AND identity NOT IN (SELECT o_custkey FROM orders WHERE o_orderkey % 10 = 0) ORDER BY identity LIMIT 3 OFFSET 1")
def select_all(spark, d):
    out = table(spark, d, "orders").where("o_orderkey % 10 = 0").select(F.col("o_custkey").alias("identity"))
    c = table(spark, d, "customer").select(F.col("c_custkey").alias("identity"), F.col("c_custkey").alias("ord"), (F.col("c_mktsegment") == "BUILDING").alias("accepted"), (F.col("c_acctbal") > 0).alias("anchored"))
    return P.select_cases(c.where("accepted AND anchored"), "identity", "ord", 3, 1, exclude=out).select("identity")


@query("allowlist_selection", f"SELECT identity, CAST(pos AS BIGINT) AS pos, accepted FROM ({_SEL}) JOIN (SELECT s_suppkey AS identity, row_number() OVER (ORDER BY s_acctbal DESC, s_suppkey) AS pos FROM supplier) USING (identity) WHERE pos BETWEEN 3 AND 8")
def allowlist(spark, d):
    a = R.numbered(table(spark, d, "supplier").select(F.col("s_suppkey").alias("identity"), "s_acctbal"), [F.col("s_acctbal").desc(), F.col("identity")], "pos").select("identity", "pos")
    c = table(spark, d, "customer").select(F.col("c_custkey").alias("identity"), (F.col("c_mktsegment") == "BUILDING").alias("accepted"))
    return P.select_listed(c, a, "identity", "pos", 6, 2)


@query("dataset_gate", "SELECT array_to_string(list_filter([CASE WHEN count(*) <> 1000 THEN 'case_count=' || CAST(count(*) AS VARCHAR) || ' expected 1000' END, CASE WHEN count(DISTINCT c_custkey) <> count(*) THEN 'identities repeat' END, CASE WHEN count(*) FILTER (c_acctbal < -900) > 0 THEN 'balances_below=' || CAST(count(*) FILTER (c_acctbal < -900) AS VARCHAR) END], lambda x: x IS NOT NULL), '; ') AS errors FROM customer")
def dataset_gate(spark, d):
    n, low = F.count(F.lit(1)), F.count_if(F.col("c_acctbal") < -900)
    return P.gate(table(spark, d, "customer"), [
        (n != 1000, F.concat(F.lit("case_count="), n.cast("string"), F.lit(" expected 1000"))), (F.countDistinct("c_custkey") != n, F.lit("identities repeat")),
        (low > 0, F.concat(F.lit("balances_below="), low.cast("string"))),
    ]).select(F.array_join("errors", "; ").alias("errors"))


@query("eligibility", "SELECT c_custkey, CASE WHEN f IS TRUE THEN 'keep' WHEN f IS FALSE THEN 'drop' ELSE 'unknown' END AS state FROM (SELECT c_custkey, CASE WHEN c_acctbal > 500 THEN true WHEN c_acctbal < 0 THEN false END AS f FROM customer) WHERE f IS NOT FALSE OR c_custkey % 2 = 0")
def eligibility(spark, d):
    c = table(spark, d, "customer").withColumn("f", F.when(F.col("c_acctbal") > 500, True).when(F.col("c_acctbal") < 0, False))
    return P.eligible(c, unless_false=["f"], or_=F.col("c_custkey") % 2 == 0).select("c_custkey", P.three_valued(F.col("f"), "keep", "drop", "unknown").alias("state"))


@query("slice_filter", sql("ranks") + " SELECT split, count(*) AS n FROM ranks WHERE candidate_count > 1200 GROUP BY 1")
def slices(spark, d):
    return P.slice_rows(fixture(spark, d, "ranks"), candidate_count_gt=1200).groupBy("split").agg(F.count(F.lit(1)).alias("n"))


@query("cross_table_checks", """SELECT 'unknown_customer' AS rule, count(*) AS n FROM orders WHERE o_custkey NOT IN (SELECT c_custkey FROM customer WHERE c_custkey % 50 > 0) UNION ALL
SELECT 'different_price', count(*) FROM orders o JOIN (SELECT l_orderkey, sum(l_extendedprice) AS s FROM lineitem GROUP BY 1) ON l_orderkey = o_orderkey WHERE abs(s - o_totalprice) > 1000 UNION ALL
SELECT 'orders_without_lines', count(*) FROM orders WHERE o_orderkey NOT IN (SELECT l_orderkey FROM lineitem) UNION ALL SELECT 'shared_families', count(*) FROM (SELECT DISTINCT c_nationkey FROM customer WHERE c_custkey % 2 = 0 INTERSECT SELECT DISTINCT c_nationkey FROM customer WHERE c_custkey % 2 = 1)""")
def cross_table(spark, d):
    o, c, li = table(spark, d, "orders"), table(spark, d, "customer"), table(spark, d, "lineitem")
    sums = li.groupBy(F.col("l_orderkey").alias("o_orderkey")).agg(F.sum("l_extendedprice").alias("s"))
    return P.violations({
        "unknown_customer": P.unknown_keys(o, "o_custkey", c.where("c_custkey % 50 > 0"), "c_custkey"),
        "different_price": P.differing(o.join(sums, "o_orderkey"), "s", "o_totalprice", 1000),
        "orders_without_lines": P.unknown_keys(o, "o_orderkey", li, "l_orderkey"),
        "shared_families": c.where("c_custkey % 2 = 0").select("c_nationkey").intersect(c.where("c_custkey % 2 = 1").select("c_nationkey")),
    })


# projections and ladders


@query("finding_repair", _A + " SELECT anchor_id, file, s AS start_line, greatest(s, coalesce(CASE WHEN pos % 3 > 0 THEN CASE WHEN pos % 2 = 0 THEN s - 5 ELSE e END END, s)) AS end_line FROM anchors WHERE s > 10")
def finding_repair(spark, d):
    a = fixture(spark, d, "anchors")
    end = F.when(F.col("pos") % 3 > 0, F.when(F.col("pos") % 2 == 0, F.col("s") - 5).otherwise(F.col("e")))
    raw = a.select("anchor_id", F.when(F.col("s") > 10, F.concat(F.lit(" "), "file")).alias("file"), F.col("s").cast("string").alias("start_line"), end.cast("string").alias("end_line"))
    return P.repair_findings(raw, "file", "start_line", "end_line")


@query("sparse_projection", "SELECT s_suppkey, concat('{\"id\":\"', CASE WHEN s_suppkey % 3 = 0 THEN s_name ELSE 'finding-' || CAST(s_suppkey AS VARCHAR) END, '\"', CASE WHEN s_acctbal > 0 THEN ',\"bal\":1' ELSE '' END, CASE WHEN s_suppkey % 2 = 0 THEN ',\"tags\":[\"even\"]' ELSE '' END, '}') AS payload FROM supplier")
def sparse(spark, d):
    s = table(spark, d, "supplier")
    id_ = F.coalesce(F.when(F.col("s_suppkey") % 3 == 0, F.col("s_name")), F.concat(F.lit("finding-"), F.col("s_suppkey").cast("string")))
    return s.select("s_suppkey", P.sparse_json(id=id_, bal=F.when(F.col("s_acctbal") > 0, 1), note=F.lit(""), tags=F.filter(F.array(F.lit("even")), lambda x: F.col("s_suppkey") % 2 == 0)).alias("payload"))


@query("private_columns_dropped", "SELECT r_regionkey, r_name FROM region")
def private_columns(spark, d):
    return P.drop_private(table(spark, d, "region").select("r_regionkey", "r_name", F.lit(1).alias("_score"), F.lit(2).alias("_rank")))


@query("visible_hidden_split", _A + " SELECT 'hidden' AS side, count(*) AS n, count(DISTINCT sha256(anchor_id)) AS ids, count(positive) AS labelled FROM anchors UNION ALL SELECT 'visible', count(*), count(DISTINCT sha256(anchor_id)), 0 FROM anchors")
def visible_hidden(spark, d):
    v, h = P.visible_hidden(fixture(spark, d, "anchors"), "anchor_id", hidden=["positive", "score_a", "score_b", "disc", "pos"])
    one = lambda df, name: df.agg(F.lit(name).alias("side"), F.count(F.lit(1)).alias("n"), F.countDistinct("public_id").alias("ids"), (F.count("positive") if "positive" in df.columns else F.lit(0).cast("long")).alias("labelled"))
    return one(h, "hidden").unionByName(one(v, "visible"))


@query("keyword_cooccurrence", "SELECT CASE WHEN (contains(lower(text), 'license') OR contains(lower(text), 'copyright')) AND (contains(lower(text), 'mit') OR contains(lower(text), 'apache')) THEN 'notice' WHEN contains(lower(text), 'http') AND contains(lower(text), '@') THEN 'contact' ELSE 'other' END AS kind, count(*) AS n FROM documents GROUP BY 1")
def cooccurrence(spark, d):
    kind = P.cooccurrence(F.col("text"), [("notice", ["license", "copyright"], ["mit", "apache"]), ("contact", ["http"], ["@"])], "other")
    return table(spark, d, "documents").groupBy(kind.alias("kind")).agg(F.count(F.lit(1)).alias("n"))


@query("field_defaults", "SELECT doc_id, coalesce(nullif(trim(lang), ''), 'unspecified') AS lang, array_to_string([CAST(doc_id AS VARCHAR), 'alias-' || CAST(doc_id % 10 AS VARCHAR)], ',') AS ids FROM documents")
def field_defaults(spark, d):
    id_ = F.col("doc_id").cast("string")
    ids = P.id_and_aliases(id_, F.array(F.concat(F.lit("alias-"), (F.col("doc_id") % 10).cast("string")), id_, F.lit("")))
    return table(spark, d, "documents").select("doc_id", P.or_default(F.col("lang"), "unspecified").alias("lang"), F.array_join(ids, ",").alias("ids"))


@query("mode_queries", "SELECT c_custkey, mode, text FROM (SELECT c_custkey, c_name AS base, CASE WHEN c_custkey % 3 = 0 THEN c_mktsegment WHEN c_custkey % 3 = 1 THEN c_name END AS over FROM customer), (VALUES ('baseline'), ('override')) m(mode), LATERAL (SELECT CASE mode WHEN 'baseline' THEN base ELSE over END AS text) WHERE text IS NOT NULL AND (mode = 'baseline' OR over <> base)")
def mode_queries(spark, d):
    over = F.when(F.col("c_custkey") % 3 == 0, F.col("c_mktsegment")).when(F.col("c_custkey") % 3 == 1, F.col("c_name"))
    return P.mode_queries(table(spark, d, "customer").withColumn("over", over), "c_custkey", "c_name", "over", both=True)


@query("risk_handoff", sql("findings") + " SELECT case_id, finding_id, concat('f', CAST(finding_id % 7 AS VARCHAR), ':', CAST(finding_id % 90 AS VARCHAR)) AS location FROM findings WHERE hit AND alarm")
def risk_handoff(spark, d):
    f = fixture(spark, d, "findings")
    f = f.withColumn("report", F.concat(F.lit("risk at f"), (F.col("finding_id") % 7).cast("string"), F.lit(".py line "), (F.col("finding_id") % 90).cast("string")))
    loc = F.concat_ws(":", F.regexp_extract("report", r"at (\w+)\.py", 1), F.regexp_extract("report", r"line (\d+)", 1))
    return P.handoff(f, F.col("hit"), F.col("alarm")).select("case_id", "finding_id", loc.alias("location"))


@query("numeric_totals", "SELECT o_orderstatus, count(try_cast(v AS DOUBLE)) AS n, round(sum(try_cast(v AS DOUBLE)), 3) AS total FROM (SELECT o_orderstatus, CASE WHEN o_orderkey % 7 = 0 THEN 'n/a' WHEN o_orderkey % 11 = 0 THEN NULL ELSE CAST(o_orderkey % 1000 AS VARCHAR) END AS v FROM orders) GROUP BY 1")
def numeric_totals(spark, d):
    v = F.when(F.col("o_orderkey") % 7 == 0, "n/a").when(F.col("o_orderkey") % 11 == 0, None).otherwise((F.col("o_orderkey") % 1000).cast("string"))
    return G.numeric_totals(table(spark, d, "orders").withColumn("v", v), ["o_orderstatus"], "v").withColumn("total", F.round("total", 3))


@query("call_counts", sql("ledger") + ", g AS (SELECT task_id, count(*) AS calls, round(coalesce(sum(tokens) FILTER (status <> 'error'), 0), 4) AS tokens FROM ledger GROUP BY 1) SELECT task_id, calls, tokens, c_custkey IS NOT NULL AS verified FROM g LEFT JOIN (SELECT c_custkey FROM customer WHERE c_acctbal > 0) ON c_custkey = task_id")
def call_counts(spark, d):
    receipts = table(spark, d, "customer").where("c_acctbal > 0").select(F.col("c_custkey").alias("task_id"))
    return G.call_counts(fixture(spark, d, "ledger"), "task_id", "tokens", F.col("status") != "error", receipts).withColumn("tokens", F.round("tokens", 4))


@query("progress_counts", sql("ledger") + """, l AS (SELECT task_id, arg_max(status, ord) AS status, count(*) AS attempts, string_agg(status, '>' ORDER BY ord) AS history FROM ledger GROUP BY 1)
SELECT status, count(*) AS tasks, CAST(sum(attempts) AS BIGINT) AS attempts, max(attempts) AS most, min(history) AS history FROM l GROUP BY 1""")
def progress(spark, d):
    p = G.progress(fixture(spark, d, "ledger"), "task_id", "ord", "status")
    return p.groupBy("status").agg(F.count(F.lit(1)).alias("tasks"), F.sum("attempts").alias("attempts"), F.max("attempts").alias("most"), F.min("history").alias("history"))


_BASE = sql("findings") + ", " + sql("ranks").removeprefix("WITH ")


@query("baseline_table", _BASE + " SELECT 'reused' AS method, count(*) AS n, count(*) FILTER (hit) AS hits FROM findings UNION ALL SELECT 'left', count(*), count(*) FILTER (left_rank <= 100) FROM ranks UNION ALL SELECT 'right', count(*), count(*) FILTER (right_rank <= 100) FROM ranks")
def baseline(spark, d):
    r = fixture(spark, d, "ranks")
    return G.method_rows({"reused": (fixture(spark, d, "findings"), F.col("hit")), "left": (r, F.col("left_rank") <= 100), "right": (r, F.col("right_rank") <= 100)})


@query("composite_keys", _B + """ SELECT b_id, CASE b_id % 3 WHEN 0 THEN CAST(guideline_id AS VARCHAR) WHEN 1 THEN CAST(guideline_id AS VARCHAR) || '__' || decision ELSE CAST(guideline_id AS VARCHAR) || '__' || decision || '__' || label END AS key, label AS boundary FROM boundaries""")
def composite_keys(spark, d):
    scope = F.get(F.array(F.lit("cluster"), F.lit("mechanism"), F.lit("boundary")), (F.col("b_id") % 3).cast("int"))
    b = fixture(spark, d, "boundaries").withColumn("file", F.concat(F.lit("out/g"), F.col("guideline_id").cast("string"), F.lit("__"), "label", F.lit(".json")))
    parts = [F.col("guideline_id").cast("string"), F.col("decision"), F.col("label")]
    return b.select("b_id", P.scoped_key(scope, ["cluster", "mechanism", "boundary"], parts).alias("key"), P.boundary_of(F.col("file")).alias("boundary"))


@query("pending_mechanisms", r"""WITH t AS (SELECT source, lower(t) AS w, count(*) AS n FROM (SELECT coalesce(source, 'none') AS source, unnest(regexp_extract_all(text, '[A-Za-z0-9_]+')) AS t FROM documents) GROUP BY ALL),
r AS (SELECT *, row_number() OVER (PARTITION BY source ORDER BY n DESC, w) AS rn FROM t) SELECT concat('pending_mech_cluster_', lower(source)) AS mechanism_id, string_agg(w, ',' ORDER BY rn) AS keywords FROM r WHERE rn <= 12 GROUP BY source""")
def pending(spark, d):
    docs = table(spark, d, "documents").select(F.coalesce("source", F.lit("none")).alias("source"), F.explode(X.tokens(F.col("text"))).alias("w"))
    p = P.pending_mechanisms(docs, "source", "w", 12)
    return p.select("mechanism_id", F.array_join("keywords", ",").alias("keywords"))


@query("split_proposals", "SELECT c_custkey, CAST(pos AS INTEGER) AS pos, CASE pos WHEN 1 THEN 'Split ' || c_mktsegment || '.' ELSE 'Merge ' || c_name END AS candidate FROM customer, (VALUES (1), (3)) p(pos) WHERE pos = 3 OR c_acctbal > 0")
def proposals(spark, d):
    c = table(spark, d, "customer")
    one = F.when(F.col("c_acctbal") > 0, F.concat(F.lit("Split "), "c_mktsegment", F.lit(". Then the rest")))
    c = c.withColumn("suggestions", F.array(one, F.lit("  "), F.concat(F.lit(" Merge "), "c_name")))
    return P.proposals(c, "c_custkey", "suggestions").select("c_custkey", "pos", "candidate")


@query("objective_status", _B + """, g AS (SELECT guideline_id, count(*) AS parsed, count(*) FILTER (bal > 0) AS accepted, count(*) FILTER (decision = 'needs_more_evidence') AS open_n, max(bal / 10000) AS delta FROM boundaries GROUP BY 1)
SELECT guideline_id, CASE WHEN guideline_id % 6 = 1 THEN 'satisfied_by_source_review_coverage' WHEN parsed > 0 AND accepted = parsed AND open_n = 0 THEN 'satisfied' WHEN parsed > 0 AND accepted > 0 THEN 'partially_satisfied_needs_evidence' ELSE 'not_satisfied_needs_semantic_evidence' END AS semantic,
  CASE WHEN guideline_id % 5 = 0 THEN 'not_satisfied_missing_recall_evidence' WHEN guideline_id % 5 = 1 THEN 'not_satisfied_stale' WHEN delta >= 0.5 THEN 'satisfied_for_reported_same_identity_budget' ELSE 'compatible_but_improvement_below_target' END AS recall FROM g""")
def objectives(spark, d):
    g = fixture(spark, d, "boundaries").groupBy("guideline_id").agg(
        F.count(F.lit(1)).alias("parsed"), F.count_if(F.col("bal") > 0).alias("accepted"), F.count_if(F.col("decision") == "needs_more_evidence").alias("open_n"), F.max(F.col("bal") / 10000).alias("delta"))
    cover = F.when(F.col("guideline_id") % 6 == 1, "satisfied_semantic_coverage")
    state = F.get(F.array(F.lit(None).cast("string"), F.lit("stale")), (F.col("guideline_id") % 5).cast("int"))
    state = F.when(F.col("guideline_id") % 5 > 1, "valid_same_identity").otherwise(state)
    return g.select("guideline_id", P.semantic_status(cover, F.col("parsed"), F.col("accepted"), F.col("open_n")).alias("semantic"), P.recall_status(state, F.col("delta"), 0.5).alias("recall"))


@query("scorecard", "SELECT 'present' AS release_state, (SELECT count(*) FROM nation) AS guidelines, 'missing' AS judge_state, 0 AS judged, 'present' AS recall_state, (SELECT round(avg(o_totalprice), 4) FROM orders) AS recall_mean")
def scorecard(spark, d):
    release = table(spark, d, "nation").agg(F.count(F.lit(1)).alias("guidelines"))
    judge = table(spark, d, "nation").where("n_nationkey < 0").groupBy("n_name").agg(F.count(F.lit(1)).alias("judged")).select("judged")
    recall = table(spark, d, "orders").agg(F.round(F.avg("o_totalprice"), 4).alias("recall_mean"))
    return P.scorecard({"release": release, "judge": judge, "recall": recall}).fillna(0, ["judged"])


@query("forbidden_keys", "SELECT s_suppkey, CASE WHEN s_suppkey % 2 = 0 THEN 'meta.Answer_Key,rows[0].gold_label,rows[1].gold_label' ELSE 'meta.Answer_Key' END AS paths FROM supplier")
def forbidden(spark, d):
    rows = F.when(F.col("s_suppkey") % 2 == 0, F.lit('[{"gold_label":1},{"gold_label":{"x":2}}]')).otherwise(F.lit('[{"value":1}, 7, null]'))
    doc = F.concat(F.lit('{"meta":{"Answer_Key":"a","n":'), F.col("s_suppkey").cast("string"), F.lit('},"rows":'), rows, F.lit("}"))
    found = P.forbidden_paths(table(spark, d, "supplier").select("s_suppkey", doc.alias("doc")), "doc", ["answer", "gold"])
    return found.select("s_suppkey", F.array_join(F.array_sort("paths"), ",").alias("paths"))


@query("timestamps_and_counts", "SELECT event_id, strftime(ts, '%Y-%m-%dT%H:%M:%SZ') AS at, CASE WHEN event_id % 3 = 0 THEN 'n/a' ELSE format('{:,}', event_id * 1000) END AS shown FROM events")
def stamps(spark, d):
    e = table(spark, d, "events")
    return e.select("event_id", P.iso_utc(F.col("ts")).alias("at"), P.count_text(F.when(F.col("event_id") % 3 != 0, F.col("event_id") * 1000)).alias("shown"))

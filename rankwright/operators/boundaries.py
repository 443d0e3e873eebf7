"""Guideline boundaries: recall triage, evidence coverage, worklists, assignments, sidecars, work items."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# fixed values: the states and actions of the review ladders
RECALL_STATES = {
    "recall_coverage_gap": "run_same_identity_recall_for_representative_cases_or_use_a_matching_rank_table",
    "recall_not_evaluated": "provide_same_identity_rank_table_before_making_recall_claim",
    "recall_supported_for_boundary_examples": "candidate_for_sidecar_ablation_after_release_text_changes",
    "recall_miss_for_boundary_examples": "inspect_query_wording_candidate_slicing_embedding_backend_or_ranking",
    "recall_partial_for_boundary_examples": "compare_hit_and_miss_cases_before_changing_guideline_boundary",
}
NEXT_ACTIONS = [
    "collect_source_sink_guard_fix_evidence_before_recall_interpretation",
    "attach_same_identity_recall_evidence",
    "run_same_identity_recall_for_this_boundary_before_claiming_embedding_effect",
    "preserve_semantic_boundary_and_debug_recall_side",
    "semantic_boundary_and_recall_examples_are_aligned_for_next_ablation",
]
COVERAGE = {
    "not_source_reviewed": "fill_source_review_ledger",
    "invalid_ledger": "fix_invalid_ledger_rows",
    "source_reviewed_and_judge_accepted": "run_same_identity_recall_after_sidecar_change",
    "source_reviewed_validation_only": "run_ledger_judge_pack",
    "source_reviewed_needs_more_evidence": "collect_missing_boundary_evidence",
    "source_reviewed_no_promoted_boundary": "collect_or_assign_representative_cases",
}
GAPS = {
    "split_mechanism_boundary": ["mechanism_boundary", "case_to_split_bucket_assignment", "split_specific_source_sink_guard"],
    "revise_mechanism_text_from_evidence": ["mechanism_scope_correction", "strong_positive_source_sink_guard", "safe_fix_semantics"],
    "collect_source_sink_guard_evidence": ["case_source_shape", "sink_or_sensitive_effect", "missing_guard", "safe_fix_semantics"],
    "keep_as_control_group": ["control_case_invariant"],
}
OTHER_GAP = "manual_review_scope"


def ladder(rules: list[tuple[Column, str]], default: str) -> Column:
    """The first rule that holds names the state; an unknown condition does not hold."""
    out = F.lit(default)
    for cond, name in reversed(rules):
        out = F.when(F.coalesce(cond, F.lit(False)), F.lit(name)).otherwise(out)
    return out


def label_of(state: Column, actions: dict[str, str]) -> Column:
    return F.create_map(*[F.lit(x) for kv in actions.items() for x in kv])[state]


def recall_by_boundary(members: DataFrame, tables: DataFrame, key: str, labels: list[str], budgets: list[int], primary: int) -> DataFrame:
    """Recall of each boundary's representative cases in each rank table.

    ``members``: (key, identity). ``tables``: (label, identity, rank), the
    first row of an identity counts, a null rank is a case without a hit. Rates
    are over present and over all representatives; a missing one is a gap.
    """
    first = tables.groupBy("label", "identity").agg(F.min_by("rank", "ord").alias("rank"), F.lit(True).alias("_in"))
    each = members.select(key, "identity", F.explode(F.array(*map(F.lit, labels))).alias("label"))
    rows = each.join(first, ["label", "identity"], "left")
    hits = [F.count_if(F.col("rank") <= b).alias(f"hit_{b}") for b in budgets]
    g = rows.groupBy(key, "label").agg(F.count(F.lit(1)).alias("representatives"), F.count("_in").alias("present"), *hits)
    hit, rules = F.col(f"hit_{primary}"), list(RECALL_STATES)
    state = ladder([
        (F.col("present") < F.col("representatives"), rules[0]), (F.col("present") == 0, rules[1]),
        (hit == F.col("present"), rules[2]), (hit == 0, rules[3]),
    ], rules[4])
    return g.withColumn("rate_present", hit / F.nullif(F.col("present"), F.lit(0))).withColumn("rate_all", hit / F.col("representatives")).withColumn("status", state)


def triage(boundaries: DataFrame, recall: DataFrame, key: str, ready: Column) -> DataFrame:
    """Next action of every boundary from its semantic readiness and the recall states of its tables."""
    states = recall.groupBy(key).agg(F.collect_set("status").alias("_s"))
    has = lambda *names: F.arrays_overlap("_s", F.array(*map(F.lit, names)))
    rules = list(RECALL_STATES)
    action = ladder([
        (~ready, NEXT_ACTIONS[0]), (F.col("_s").isNull(), NEXT_ACTIONS[1]),
        (has(rules[0], rules[1]), NEXT_ACTIONS[2]), (has(rules[3], rules[4]), NEXT_ACTIONS[3]),
    ], NEXT_ACTIONS[4])
    return boundaries.join(states, key, "left").withColumn("next_action", action).drop("_s")


def coverage(worklist: DataFrame, ledger: DataFrame, validation: DataFrame, judge: DataFrame, group: str, label: str) -> DataFrame:
    """Counts over a guideline's boundaries, then its coverage status and next action.

    ``ledger`` (group, label, decision), ``validation`` (group, label, valid),
    ``judge`` (group, label, verdict); every group of ``worklist`` has a row.
    """
    rows = ledger.join(validation.withColumn("_v", F.lit(True)), [group, label], "left").join(judge.withColumn("_j", F.lit(True)), [group, label], "left")
    seen, judged = F.col("_v").isNotNull(), F.coalesce(F.col("verdict"), F.lit("")) != ""
    valid = F.coalesce(F.col("valid"), F.lit(False))
    promoted = (F.col("decision") == "promote_boundary") & F.coalesce(F.col("valid"), F.lit(True))
    g = rows.groupBy(group).agg(
        F.count(F.lit(1)).alias("boundaries"), F.count_if(seen & valid).alias("valid_n"), F.count_if(seen & ~valid).alias("invalid_n"),
        F.count_if(promoted).alias("promotable_n"), F.count_if(promoted & (F.col("verdict") == "accept")).alias("accepted_n"),
        F.count_if(promoted & F.col("_j").isNull()).alias("unjudged_n"), F.count_if(judged & (F.col("verdict") != "accept")).alias("other_n"),
    )
    g = worklist.join(g, group, "left").fillna(0, ["boundaries", "valid_n", "invalid_n", "promotable_n", "accepted_n", "unjudged_n", "other_n"])
    names = list(COVERAGE)
    some = F.col("promotable_n") > 0
    state = ladder([
        (F.col("boundaries") == 0, names[0]), (F.col("invalid_n") > 0, names[1]), (some & (F.col("accepted_n") == F.col("promotable_n")), names[2]),
        (some & (F.col("unjudged_n") > 0), names[3]), (F.col("other_n") > 0, names[4]),
    ], names[5])
    g = g.withColumn("coverage_status", state)
    control = (F.col("action") == "keep_as_control_group") & (F.col("boundaries") == 0)
    return g.withColumn("next_action", F.when(control, "optional_control_source_review").otherwise(label_of(F.col("coverage_status"), COVERAGE)))


def evidence_state(review_entry: Column, trace: Column) -> Column:
    """Of a case: no trace evidence, a review entry alone, or a source trace."""
    return F.when(F.coalesce(trace, F.lit("")) == "", "missing_trace_evidence").when(review_entry, "review_entry_only").otherwise("source_trace_present")


def evidence_gaps(action: Column, cases: Column, weak: Column, mixed: Column, splits: Column) -> Column:
    """What a worklist item lacks: codes by its action and its cases, sorted, each once."""
    by = F.lit(None).cast("array<string>")
    for name, codes in GAPS.items():
        by = F.when(action == name, F.array(*map(F.lit, codes))).otherwise(by)
    more = F.array_compact(F.array(
        F.when(cases == 0, F.lit("assigned_case_examples")), F.when(weak > 0, F.lit("source_level_trace_evidence")),
        F.when(mixed, F.lit("mixed_membership_boundary")), F.when(splits, F.lit("candidate_split_validation")),
    ))
    return F.array_sort(F.array_distinct(F.concat(F.coalesce(by, F.array(F.lit(OTHER_GAP))), more)))


def judged_candidates(hidden: DataFrame, scores: DataFrame, outputs: DataFrame, item: str, cand: str) -> DataFrame:
    """Hidden candidates against a judge's scores.

    ``outputs`` (item, state): ``parsed``, ``missing_output`` or a parse error;
    an item without a row has no output. Scores of unknown ids are
    ``unknown_candidate``; hidden ids without a score stay, with a code.
    """
    state = outputs.select(item, F.col("state").alias("_state"))
    known = hidden.withColumn("_h", F.lit(True)).join(state, item, "left")
    known = known.withColumn("_state", F.coalesce("_state", F.lit("missing_output")))
    parsed = scores.join(state.where("_state = 'parsed'"), item, "left_semi").withColumn("_s", F.lit(True))
    both = known.join(parsed, [item, cand], "full_outer")
    code = ladder([
        (F.col("_h").isNull(), "unknown_candidate"), (F.col("_state") != "parsed", "_"), (F.col("_s").isNull(), "missing_candidate_score"),
    ], "")
    return both.withColumn("parse_error", F.when(code == "_", F.col("_state")).otherwise(code)).drop("_h", "_s", "_state")


def assignments(members: DataFrame, assigned: DataFrame, key: str, group: str) -> DataFrame:
    """Each representative as ``same_guideline``, ``assigned_elsewhere`` (a row for each other group) or ``absent``.

    ``members`` (key, group, identity); ``assigned`` (identity, group).
    """
    a = assigned.select("identity", F.col(group).alias("_to")).distinct()
    rows = members.join(a, "identity", "left")
    where = F.when(F.col("_to").isNull(), "absent").when(F.col("_to") == F.col(group), "same_guideline").otherwise("assigned_elsewhere")
    return rows.select(key, "identity", where.alias("assignment"), F.when(F.col("_to") != F.col(group), F.col("_to")).alias("elsewhere"))


def sidecar(propagation: DataFrame, texts: DataFrame, assigned: DataFrame, cases: DataFrame, group: str, label: str, allowed: list[str]) -> DataFrame:
    """One row an identity with the guideline texts of its group's allowed boundaries, in the order of ``ord``, each once.

    Boundaries without text or without assignments, and identities that are no
    case, fall away. Texts meet groups, not identities: they are put together
    once for every set of groups that some identity has.
    """
    chosen = propagation.where(F.col("status").isin(allowed)).join(texts.where("coalesce(text, '') <> ''"), [group, label])
    once = chosen.groupBy(group, "text").agg(F.min("ord").alias("_o"))
    labels = chosen.groupBy(group).agg(F.countDistinct(label).alias("_n"))
    own = assigned.select("identity", group).join(cases.select("identity"), "identity", "left_semi").groupBy("identity").agg(F.array_sort(F.collect_set(group)).alias("_set"))
    sets = own.select("_set").distinct().select("_set", F.explode("_set").alias(group))
    found = sets.join(once, group).groupBy("_set", "text").agg(F.min("_o").alias("_o"))
    found = found.groupBy("_set").agg(F.array_sort(F.collect_list(F.struct("_o", "text"))).alias("_t"))
    found = found.join(sets.join(labels, group).groupBy("_set").agg(F.sum("_n").alias("boundaries")), "_set")
    return own.join(found, "_set").select("identity", F.array_join(F.transform("_t", lambda x: x["text"]), "\n\n").alias("guideline"), "boundaries")


def work_items(clusters: DataFrame, patterns: DataFrame, cluster: str) -> DataFrame:
    """Items of a clustering: each sub-pattern with members, then what no sub-pattern claims, or the whole cluster where there is none.

    ``clusters`` (cluster, name, members); ``patterns`` (cluster, pos, name,
    members), with a null or empty array of members for a blank one.
    """
    own = patterns.where(F.size(F.coalesce("members", F.array().cast("array<bigint>"))) > 0)
    own = own.select(cluster, F.coalesce("name", F.concat(F.lit("sub_pattern_"), F.col("pos").cast("string"))).alias("name"), "members", F.lit("sub_pattern").alias("kind"))
    claimed = own.groupBy(cluster).agg(F.array_distinct(F.flatten(F.collect_list("members"))).alias("_claimed"))
    any_ = patterns.groupBy(cluster).agg(F.count(F.lit(1)).alias("_n"))
    rest = clusters.join(claimed, cluster, "left").join(any_, cluster, "left")
    left = F.array_except("members", F.coalesce("_claimed", F.array().cast("array<bigint>")))  # by hash; members are a set
    rest = rest.withColumn("_left", left).where((F.size("_left") > 0) | F.col("_n").isNull())
    rest = rest.select(
        cluster, F.coalesce("name", F.concat(F.lit("cluster_"), F.col(cluster).cast("string"))).alias("name"),
        F.when(F.size("_left") > 0, F.col("_left")).otherwise(F.col("members")).alias("members"), F.lit("cluster_fallback").alias("kind"),
    )
    return own.unionByName(rest)


def evidence_support(rows: DataFrame, by: str) -> DataFrame:
    """Of a group's members (supported, role, term): whether all are supported, the roles and each role's terms, sorted and joined."""
    all_ = rows.groupBy(by).agg(F.bool_and("supported").alias("supported"))
    roles = rows.where("role IS NOT NULL AND term IS NOT NULL").groupBy(by, "role").agg(F.array_join(F.array_sort(F.collect_set("term")), "|").alias("_t"))
    roles = roles.groupBy(by).agg(F.count(F.lit(1)).alias("role_count"), F.array_join(F.array_sort(F.collect_list(F.concat_ws("=", "role", "_t"))), ";").alias("roles"))
    return all_.join(roles, by, "left").fillna({"role_count": 0, "roles": ""})


def merged_lexicon(files: DataFrame) -> DataFrame:
    """Mechanisms of several lexicon files (file_ord, mechanism_id, name, keywords): blank ids and names are skipped, keywords trimmed and lower-cased.

    An id in two files, or twice in one, is an error when the row is read.
    """
    rows = files.withColumn("mechanism_id", F.trim("mechanism_id")).withColumn("name", F.trim("name"))
    rows = rows.where("coalesce(mechanism_id, '') <> '' AND coalesce(name, '') <> ''")
    n = F.count(F.lit(1)).over(Window.partitionBy("mechanism_id"))
    rows = rows.withColumn("_n", n)
    again = F.when(F.col("_n") > 1, F.raise_error(F.concat(F.lit("duplicate mechanism_id: "), F.col("mechanism_id"))).cast("string")).otherwise(F.col("mechanism_id"))
    words = F.filter(F.transform("keywords", lambda k: F.lower(F.trim(k))), lambda k: k != "")
    return rows.select("file_ord", again.alias("mechanism_id"), "name", words.alias("keywords"))


def lexicon_duplicates(files: DataFrame) -> DataFrame:
    """Ids that several rows of the files have."""
    return files.where("trim(coalesce(mechanism_id, '')) <> ''").groupBy(F.trim("mechanism_id").alias("mechanism_id")).agg(F.count(F.lit(1)).alias("n")).where("n > 1")


def case_targets(bindings: DataFrame) -> DataFrame:
    """Bindings (ord, track, case_ids, candidate_ids) by case: bindings that name it, its candidates, the track of the first."""
    rows = bindings.select("ord", "track", "candidate_ids", F.explode("case_ids").alias("case_id"))
    head = rows.groupBy("case_id").agg(F.count(F.lit(1)).alias("source_targets"), F.min_by("track", "ord").alias("track"))
    cands = rows.select("case_id", F.explode("candidate_ids").alias("c")).groupBy("case_id").agg(F.countDistinct("c").alias("candidates"))
    return head.join(cands, "case_id", "left").fillna(0, ["candidates"])


def pool_statistics(cases: DataFrame, pool: DataFrame) -> DataFrame:
    """Each case with its candidates, positives and positives by kind; cases without a pool stay as zero rows and are not covered.

    ``cases`` (case_id), ``pool`` (case_id, kind, positive).
    """
    kinds = pool.where("positive").groupBy("case_id", "kind").agg(F.count(F.lit(1)).alias("_n"))
    kinds = kinds.groupBy("case_id").agg(F.array_join(F.array_sort(F.collect_list(F.concat_ws(":", "kind", "_n"))), ",").alias("by_kind"))
    g = pool.groupBy("case_id").agg(F.count(F.lit(1)).alias("candidates"), F.count_if("positive").alias("positives"))
    out = cases.join(g, "case_id", "left").join(kinds, "case_id", "left")
    return out.withColumn("present", F.col("candidates").isNotNull()).fillna({"candidates": 0, "positives": 0, "by_kind": ""}).withColumn("covered", F.col("positives") > 0)


def hard_competition(scored: DataFrame, query: str, n: int) -> tuple[DataFrame, DataFrame]:
    """The ``n`` best non-positive candidates of every query by frozen score, ties by id; and a ledger.

    ``scored`` (query, cand, score, positive). Queries without a positive or
    with fewer than ``n`` others are skipped and say why; the ledger's counts
    add up to all candidates.
    """
    g = scored.groupBy(query).agg(F.count(F.lit(1)).alias("candidates"), F.count_if("positive").alias("positives"))
    reason = F.when(F.col("positives") == 0, "no_positive").when(F.col("candidates") - F.col("positives") < n, "too_few_competitors").otherwise("used")
    ledger = g.withColumn("state", reason).withColumn("competitors", F.col("candidates") - F.col("positives"))
    rank = F.row_number().over(Window.partitionBy(query).orderBy(F.round("score", 9).desc(), "cand"))
    rows = scored.where("NOT positive").join(ledger.where("state = 'used'").select(query), query, "left_semi")
    return rows.withColumn("rn", rank).where(F.col("rn") <= n), ledger


def tail_sample(rows: DataFrame, query: str, cand: str, lanes: list[str], k: int, tail: int) -> DataFrame:
    """Positives, the first ``k`` of every lane's ranks, and of the rest the ``tail`` with the lowest hash; with the reason of each."""
    lane = F.lit(False)
    for c in lanes:
        lane = lane | F.coalesce(F.col(c) <= k, F.lit(False))
    rows = rows.withColumn("reason", F.when(F.col("positive"), "positive").when(lane, "lane"))
    hash_ = F.sha2(F.concat_ws("|", F.col(query).cast("string"), F.col(cand).cast("string")), 256)
    rank = F.row_number().over(Window.partitionBy(query).orderBy(hash_, cand))
    rest = rows.where("reason IS NULL").withColumn("_rn", rank).where(F.col("_rn") <= tail).drop("_rn").withColumn("reason", F.lit("tail"))
    return rows.where("reason IS NOT NULL").unionByName(rest)

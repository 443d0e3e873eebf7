"""Selections, gates, projections and status ladders over records."""

from __future__ import annotations

import json
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rankwright.functions.text import first_clause, slug
from rankwright.operators.boundaries import ladder
from rankwright.operators.ranking import top_k
from rankwright.session import ship


def _exactly(df: DataFrame, n: int, what: str) -> DataFrame:
    """Fail when read unless there are n rows; the count is one row beside them."""
    total = df.agg(F.count(F.lit(1)).alias("_total"))
    message = F.concat(F.lit("only "), F.col("_total").cast("string"), F.lit(f" {what}, wanted {n}"))
    checked = total.select(F.when(F.col("_total") != n, F.raise_error(message).cast("boolean")).otherwise(True).alias("_ok"))
    return df.crossJoin(F.broadcast(checked)).where("_ok").drop("_ok")  # one row


def select_cases(cases: DataFrame, identity: str, ord_: str, limit: int, skip: int = 0, exclude: DataFrame | None = None) -> DataFrame:
    """``limit`` cases in order after ``skip``, without excluded identities; fewer is an error."""
    if exclude is not None:
        cases = cases.join(exclude.select(identity).distinct(), identity, "left_anti")
    return _exactly(cases.orderBy(ord_).offset(skip).limit(limit), limit, "cases selected")


def select_listed(cases: DataFrame, listed: DataFrame, identity: str, pos: str, limit: int, skip: int = 0) -> DataFrame:
    """The cases of a slice of a list (identity, pos from 1), with their position; a listed identity without a case is an error."""
    part = listed.where((F.col(pos) > skip) & (F.col(pos) <= skip + limit))
    rows = part.join(cases.withColumn("_in", F.lit(True)), identity, "left")
    message = F.concat(F.lit("listed identity missing: "), F.col(identity).cast("string"))
    return rows.withColumn("_in", F.when(F.col("_in").isNull(), F.raise_error(message).cast("boolean")).otherwise(True)).where("_in").drop("_in")


def gate(df: DataFrame, rules: list[tuple[Column, Column]]) -> DataFrame:
    """One row with ``errors``, the messages of the aggregate conditions that hold, and ``passed``."""
    row = df.agg(F.array_compact(F.array(*[F.when(bad, message) for bad, message in rules])).alias("errors"))
    return row.withColumn("passed", F.size("errors") == 0)


def three_valued(flag: Column, yes: str, no: str, unknown: str) -> Column:
    return F.when(flag.isNull(), unknown).when(flag, yes).otherwise(no)


def eligible(df: DataFrame, only_true: list[str] = (), unless_false: list[str] = (), or_: Column | None = None) -> DataFrame:
    """Rows whose ``only_true`` flags are true and whose ``unless_false`` flags are true or unknown, or for which ``or_`` holds."""
    ok = F.lit(True)
    for c in only_true:
        ok = ok & F.coalesce(F.col(c), F.lit(False))
    for c in unless_false:
        ok = ok & F.coalesce(F.col(c), F.lit(True))
    return df.where(ok | F.coalesce(or_, F.lit(False)) if or_ is not None else ok)


def slice_rows(df: DataFrame, candidate_count_gt: int | None = None, split: str | None = None) -> DataFrame:
    df = df.where(F.col("candidate_count") > candidate_count_gt) if candidate_count_gt is not None else df
    return df.where(F.col("split") == split) if split else df


def unknown_keys(df: DataFrame, key: str, known: DataFrame, known_key: str) -> DataFrame:
    return df.join(known.select(F.col(known_key).alias(key)).distinct(), key, "left_anti")


def differing(df: DataFrame, a: str, b: str, tolerance: float = 0.0) -> DataFrame:
    """Rows whose two values are further apart than the tolerance, or of which one alone is known."""
    return df.where((F.abs(F.col(a) - F.col(b)) > tolerance) | (F.col(a).isNull() != F.col(b).isNull()))


def violations(rules: dict[str, DataFrame]) -> DataFrame:
    """Each rule with the number of rows that break it."""
    out = None
    for name, rows in rules.items():
        one = rows.agg(F.lit(name).alias("rule"), F.count(F.lit(1)).alias("n"))
        out = one if out is None else out.unionByName(one)
    return out


def repair_findings(df: DataFrame, file: str, start: str, end: str) -> DataFrame:
    """Findings with a file and a start of at least 1; a missing end, or one before the start, is the start. Others fall away."""
    s, e = F.trim(F.col(start)).try_cast("long"), F.trim(F.col(end)).try_cast("long")
    bad_end = F.col(end).isNotNull() & (F.col(end) != "") & e.isNull()
    rows = df.where((F.trim(F.coalesce(F.col(file), F.lit(""))) != "") & (s >= 1) & ~bad_end)
    keep = [c for c in df.columns if c not in {file, start, end}]
    return rows.select(*keep, F.trim(F.col(file)).alias(file), s.alias(start), F.greatest(s, F.coalesce(F.when(e == 0, s).otherwise(e), s)).alias(end))


def sparse_json(**fields: Column) -> Column:
    """A JSON object of the fields that hold something: nulls, empty strings and empty arrays are left out."""
    def held(name: str, c: Column) -> Column:
        # strings and arrays alike have the JSON of emptiness
        text = F.to_json(F.struct(c.alias(name)))
        return F.when(~text.isin("{}", json.dumps({name: ""}, separators=(",", ":")), json.dumps({name: []}, separators=(",", ":"))), F.regexp_extract(text, r"(?s)^\{(.*)\}$", 1))

    return F.concat(F.lit("{"), F.concat_ws(",", *[held(k, c) for k, c in fields.items()]), F.lit("}"))


def drop_private(df: DataFrame) -> DataFrame:
    return df.drop(*[c for c in df.columns if c.startswith("_")])


def visible_hidden(df: DataFrame, key: str, hidden: list[str]) -> tuple[DataFrame, DataFrame]:
    """The same rows twice under an opaque public id: without the hidden columns and the key, and with them alone."""
    rows = df.withColumn("public_id", F.sha2(F.col(key).cast("string"), 256))
    return rows.drop(key, *hidden), rows.select("public_id", key, *hidden)


def cooccurrence(text: Column, rules: list[tuple[str, list[str], list[str]]], default: str) -> Column:
    """The first label of which a keyword of either set occurs."""
    low = F.lower(text)

    def any_of(words: list[str]) -> Column:
        found = F.lit(False)
        for w in words:
            found = found | F.contains(low, F.lit(w))
        return found

    return ladder([(any_of(a) & any_of(b), label) for label, a, b in rules], default)


def or_default(value: Column, default: str) -> Column:
    return F.coalesce(F.nullif(F.trim(value), F.lit("")), F.lit(default))


def id_and_aliases(id_: Column, aliases: Column) -> Column:
    """The id, then its aliases, blanks dropped, each once."""
    return F.array_distinct(F.filter(F.concat(F.array(id_), F.coalesce(aliases, F.array().cast("array<string>"))), lambda x: F.coalesce(F.trim(x), F.lit("")) != ""))


def mode_queries(df: DataFrame, key: str, base: str, override: str, both: bool) -> DataFrame:
    """(key, mode, text): the baseline, or the override where there is one; with ``both``, both where they differ."""
    b, o = F.nullif(F.trim(base), F.lit("")), F.nullif(F.trim(override), F.lit(""))
    q = lambda mode, text: F.struct(F.lit(mode).alias("mode"), text.alias("text"))
    two = F.filter(F.array(q("baseline", b), F.when(b.isNull() | (o != b), q("override", o))), lambda x: x["text"].isNotNull())
    one = F.filter(F.array(F.when(o.isNotNull(), q("override", o)).otherwise(q("baseline", b))), lambda x: x["text"].isNotNull())
    return df.select(key, F.explode(two if both else one).alias("_q")).select(key, "_q.*")


def handoff(df: DataFrame, completed: Column, risk: Column) -> DataFrame:
    """Rows that are completed and at risk, both for certain."""
    return df.where(F.coalesce(completed & risk, F.lit(False)))


def scoped_key(scope: Column, scopes: list[str], parts: list[Column]) -> Column:
    """The first parts up to the scope's, joined by two underscores."""
    out = F.lit(None).cast("string")
    for k, name in enumerate(scopes, 1):
        out = F.when(scope == name, F.concat_ws("__", *parts[:k])).otherwise(out)
    return out


def boundary_of(file: Column) -> Column:
    """The boundary's label in an output file's name: what follows the first two underscores."""
    return F.nullif(F.regexp_extract(file, r"([^/]*?)__([^/]*)\.json$", 2), F.lit(""))


def pending_mechanisms(tokens: DataFrame, group: str, token: str, n: int) -> DataFrame:
    """A placeholder mechanism of each group from its ``n`` most frequent terms, ties by term; the counts meet before the ranking."""
    counts = tokens.groupBy(group, token).agg(F.count(F.lit(1)).alias("_n"))
    top = _top(counts, group, token, n)
    id_ = F.concat(F.lit("pending_mech_"), slug(F.concat(F.lit("cluster "), F.col(group).cast("string"))))
    return top.select(group, id_.alias("mechanism_id"), F.col("_t").alias("keywords"), F.slice("_t", 1, 6).alias("aliases"), F.lit("pending_review").alias("family"))


def _top(counts: DataFrame, group: str, token: str, n: int) -> DataFrame:
    rows = top_k(counts, [group], "_n", token, n)
    return rows.groupBy(group).agg(F.array_sort(F.collect_list(F.struct("rn", token))).alias("_r")).select(group, F.transform("_r", lambda x: x[token]).alias("_t"))


def proposals(df: DataFrame, key: str, suggestions: str) -> DataFrame:
    """A proposal for each suggestion that says something, with its place and a name from its first clause."""
    rows = df.select(key, F.posexplode(suggestions).alias("_p", "_s")).where("trim(coalesce(_s, '')) <> ''")
    text = F.trim("_s")
    return rows.select(
        key, (F.col("_p") + 1).alias("pos"), first_clause(text, 120).alias("candidate"),
        F.sha2(F.concat_ws("|", F.col(key).cast("string"), F.lit("split"), (F.col("_p") + 1).cast("string"), text), 256).alias("proposal_id"),
        F.lit("candidate_new_mechanism").alias("kind"), F.lit("needs_human_source_validation").alias("review_status"),
    )


# fixed values: statuses of the objectives
_COVERED = ["satisfied_semantic_coverage", "satisfied_semantic_coverage_pending_recall_followup"]
_SAME = ["valid_same_identity", "inherited_same_identity_by_sidecar_equivalence"]


def semantic_status(coverage: Column, parsed: Column, accepted: Column, worklist: Column) -> Column:
    state = ladder([
        ((parsed > 0) & (accepted == parsed) & (worklist == 0), "satisfied"), ((parsed > 0) & (accepted > 0), "partially_satisfied_needs_evidence"),
    ], "not_satisfied_needs_semantic_evidence")
    return F.when(coverage.isin(_COVERED), "satisfied_by_source_review_coverage").when(F.startswith(coverage, F.lit("not_satisfied")), coverage).otherwise(state)


def recall_status(state: Column, max_delta: Column, target: float) -> Column:
    good = F.when(F.coalesce(max_delta, F.lit(0.0)) >= target, "satisfied_for_reported_same_identity_budget").otherwise("compatible_but_improvement_below_target")
    return F.when(state.isin(_SAME), good).when(F.coalesce(state, F.lit("")) != "", F.concat(F.lit("not_satisfied_"), state)).otherwise("not_satisfied_missing_recall_evidence")


def scorecard(parts: dict[str, DataFrame]) -> DataFrame:
    """Several one-row summaries side by side, each with ``<name>_state``: present or missing."""
    out = None
    for name, df in parts.items():
        # a left join to one row keeps it where the summary has none
        one = df.sparkSession.range(1).select(F.lit(1).alias("_k")).join(df.limit(1).withColumn("_has", F.lit(True)).withColumn("_k", F.lit(1)), "_k", "left")
        one = one.withColumn(f"{name}_state", F.when(F.col("_has"), "present").otherwise("missing")).drop("_has")
        out = one if out is None else out.join(one, "_k")
    return out.drop("_k")


def forbidden_paths(df: DataFrame, column: str, parts: list[str]) -> DataFrame:
    """Add ``paths``: every key, at any depth of the JSON documents in ``column``, whose name contains a forbidden part.

    In the order of the document. Texts that are no JSON have none; a document
    nested too deeply to be read has null, since its keys are not known.
    """
    ship(df.sparkSession)

    def walk(document) -> Iterator[str]:
        stack = [("", None, document)]
        while stack:
            path, key, value = stack.pop()
            if key is not None and any(p in key.lower() for p in parts):
                yield path
            if isinstance(value, dict):
                stack += [(f"{path}.{k}" if path else k, k, v) for k, v in reversed(value.items())]
            elif isinstance(value, list):
                stack += [(f"{path}[{i}]", None, value[i]) for i in range(len(value) - 1, -1, -1)]

    def found(text: str | None) -> list[str] | None:
        try:
            return list(walk(json.loads(text or "null")))
        except ValueError:
            return []
        except RecursionError:
            return None

    @F.pandas_udf("array<string>")
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for batch in batches:
            yield batch.map(found)

    return df.withColumn("paths", run(column))


def iso_utc(ts: Column) -> Column:
    return F.date_format(ts, "yyyy-MM-dd'T'HH:mm:ss'Z'")


def count_text(n: Column) -> Column:
    """A count with thousands set off by commas; ``n/a`` for none."""
    return F.coalesce(F.format_number(n, 0), F.lit("n/a"))

"""Queries over scalar functions, review ladders, ledgers and learned ranking."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Window
from pyspark.sql import functions as F

from rankwright.functions import text as X
from rankwright.operators import adapter as AD
from rankwright.operators import learned as L
from rankwright.operators import lexicon as P
from rankwright.operators import masking as M
from rankwright.operators import ranking as R
from rankwright.operators import review as V
from rankwright.plans.fixtures import fixture, source_file, sql
from rankwright.session import table
from rankwright.sources.readers import nested
from rankwright.streaming import leases
from rankwright.streaming import ledger as E

QUERIES, SQL = {}, {}


def query(name: str, oracle: str | None = None):
    def keep(f):
        QUERIES[name] = f
        if oracle:
            SQL[name] = oracle
        return f

    return keep


def docs(spark, d):
    return table(spark, d, "documents")


@query("tokenize", "SELECT doc_id, CAST(len(t) AS INTEGER) AS n, sha256(lower(array_to_string(t, ' '))) AS h FROM (SELECT doc_id, regexp_extract_all(text, '[A-Za-z0-9_]+') AS t FROM documents)")
def tokenize(spark, d):
    x = docs(spark, d).select("doc_id", X.tokens(F.col("text")).alias("t"))
    return x.select("doc_id", F.size("t").alias("n"), F.sha2(F.array_join("t", " "), 256).alias("h"))


@query("token_set_stop_words", r"SELECT doc_id, count(DISTINCT x) AS n FROM (SELECT doc_id, unnest(list_filter(regexp_extract_all(lower(text), '[a-z0-9][a-z0-9_.\-]*'), lambda x: len(x) >= 3 AND x NOT IN ('the', 'and', 'that', 'for', 'with'))) AS x FROM documents) GROUP BY doc_id")
def token_set(spark, d):
    x = docs(spark, d).select("doc_id", F.explode(X.token_set(F.col("text"), ["the", "and", "that", "for", "with"])).alias("x"))
    return x.groupBy("doc_id").agg(F.countDistinct("x").alias("n"))


@query("phrase_presence", "SELECT phrase, count(*) AS n FROM documents, (SELECT unnest(['of the', 'license', 'inonre', 'version 2.0']) AS phrase) WHERE CASE WHEN regexp_matches(phrase, '[^A-Za-z0-9_]') THEN contains(lower(text), phrase) ELSE list_contains(list_transform(regexp_extract_all(text, '[A-Za-z0-9_]+'), lambda x: lower(x)), phrase) END GROUP BY phrase")
def phrases(spark, d):
    p = F.explode(F.array(*map(F.lit, ["of the", "license", "inonre", "version 2.0"]))).alias("phrase")
    return docs(spark, d).select("text", p).where(X.phrase_present(F.col("phrase"), F.col("text"))).groupBy("phrase").agg(F.count(F.lit(1)).alias("n"))


@query("path_normalization", r"SELECT page_id, regexp_replace(trim(replace('./././' || replace(url, '/', '\'), '\', '/')), '^(\./)+', '') AS a, ltrim('../.github/x' || CAST(page_id AS VARCHAR), './') AS b FROM pages")
def paths(spark, d):
    dirty = F.concat(F.lit("./././"), F.replace("url", F.lit("/"), F.lit("\\")))
    return table(spark, d, "pages").select("page_id", X.normalize_path(dirty).alias("a"), X.strip_dots(F.concat(F.lit("../.github/x"), F.col("page_id").cast("string"))).alias("b"))


@query("strip_source_root", "SELECT page_id, regexp_replace(url, '^http://[^/]+/', '') AS p FROM pages")
def strip_root(spark, d):
    p = table(spark, d, "pages")
    return p.select("page_id", X.strip_root(F.regexp_replace("url", "^http://[^/]+", "file:///root/src"), "/root/src").alias("p"))


@query("safe_int_and_clamp", "SELECT c_custkey, TRY_CAST(trim(CASE WHEN c_custkey % 3 = 0 THEN ' 7 ' WHEN c_custkey % 3 = 1 THEN 'x1' ELSE CAST(c_custkey AS VARCHAR) END) AS INTEGER) AS i, round(greatest(0, least(1, c_acctbal / 5000)), 6) AS s, CASE WHEN lower(c_mktsegment) IN ('building', 'machinery') THEN lower(c_mktsegment) ELSE 'invalid' END AS e FROM customer")
def safe_int(spark, d):
    raw = F.when(F.col("c_custkey") % 3 == 0, " 7 ").when(F.col("c_custkey") % 3 == 1, "x1").otherwise(F.col("c_custkey").cast("string"))
    return table(spark, d, "customer").select("c_custkey", X.safe_int(raw).alias("i"), F.round(X.clamp(F.col("c_acctbal") / 5000), 6).alias("s"), X.one_of(F.col("c_mktsegment"), ["building", "machinery"]).alias("e"))


@query("slug_and_hash_ids", r"SELECT p_partkey, substr(regexp_replace(regexp_replace(lower(p_name || '/' || p_type), '[^a-z0-9]+', '_', 'g'), '^_+|_+$', '', 'g'), 1, 20) AS slug, substr(sha256(concat(p_brand, chr(0), CAST(p_partkey AS VARCHAR))), 1, 24) AS id, substr(sha1(concat(p_brand, '::', CAST(p_size AS VARCHAR))), 1, 12) AS short FROM part")
def slugs(spark, d):
    p = table(spark, d, "part")
    return p.select("p_partkey", X.slug(F.concat_ws("/", "p_name", "p_type"), 20).alias("slug"), X.hash_id([F.col("p_brand"), F.col("p_partkey")]).alias("id"), X.sha1_id([F.col("p_brand"), F.col("p_size")]).alias("short"))


@query("compact_text", r"SELECT doc_id, CASE WHEN length(o) > 60 THEN rtrim(substr(o, 1, 57)) || '...' ELSE o END AS c FROM (SELECT doc_id, trim(regexp_replace(text, '[ \t\n\r\f\x0b]+', ' ', 'g')) AS o FROM documents)")
def compact(spark, d):
    return docs(spark, d).select("doc_id", X.compact(F.col("text"), 60).alias("c"))


@query("redaction", r"SELECT doc_id, sha256(regexp_replace(regexp_replace(text, '[0-9]{4,}', 'N', 'g'), '[a-z]+@[a-z0-9.]+', 'M', 'g')) AS h FROM documents")
def redaction(spark, d):
    t = X.redact(X.redact(F.col("text"), ["[0-9]{4,}"], "N"), ["[a-z]+@[a-z0-9.]+"], "M")
    return docs(spark, d).select("doc_id", F.sha2(t, 256).alias("h"))


@query("footer_last_match", r"SELECT doc_id, regexp_extract_all(text, '([A-Z][a-z]+)\.', 1)[-1] AS last FROM documents")
def footer(spark, d):
    return docs(spark, d).select("doc_id", X.last_match(F.col("text"), r"([A-Z][a-z]+)\.").alias("last"))


@query("cwe_normalization", "SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, 'CWE-' || CAST(l_suppkey AS VARCHAR) AS cwe FROM lineitem WHERE l_suppkey > 0")
def cwe(spark, d):
    li = table(spark, d, "lineitem").where("l_suppkey > 0")
    return li.select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", X.cwe(F.concat(F.lit("see cwe_0"), F.col("l_suppkey").cast("string"))).alias("cwe"))


@query("candidate_text_rendering", "SELECT doc_id, sha256(substr('file: ' || source || chr(10) || 'lines: 1-' || CAST(n_chars AS VARCHAR) || chr(10) || 'symbol: ' || lang || chr(10) || text, 1, 4000)) AS h FROM documents")
def candidate_text(spark, d):
    c = X.candidate_text(F.col("lang"), F.col("source"), F.lit(1), F.col("n_chars"), F.col("text"))
    return docs(spark, d).select("doc_id", F.sha2(c, 256).alias("h"))


@query("project_family", "SELECT c_custkey, lower(c_name) AS family FROM customer")
def family(spark, d):
    return table(spark, d, "customer").select("c_custkey", X.project_family(F.concat("c_name", F.lit("__"), F.substring(F.sha2("c_name", 256), 1, 12))).alias("family"))


@query("sigmoid", "SELECT s_suppkey, round(1 / (1 + exp(-s_acctbal / 3000)), 9) AS p FROM supplier")
def sigmoid(spark, d):
    return table(spark, d, "supplier").select("s_suppkey", F.round(X.sigmoid(F.col("s_acctbal") / 3000), 9).alias("p"))


@query("log_loss", "SELECT s_suppkey, round(-ln(1 / (1 + exp(CASE WHEN s_nationkey % 2 = 0 THEN -s_acctbal ELSE s_acctbal END / 3000))), 9) AS loss FROM supplier")
def log_loss(spark, d):
    return table(spark, d, "supplier").select("s_suppkey", F.round(X.log_loss(F.col("s_acctbal") / 3000, F.col("s_nationkey") % 2 == 0), 9).alias("loss"))


@query("vulnerability_harvest", "SELECT doc_id, 'CVE-2024-' || CAST(10000 + doc_id AS VARCHAR) || ',GHSA-AB12-CD34-' || lpad(CAST(doc_id % 9973 AS VARCHAR), 4, '0') AS ids FROM documents")
def harvest(spark, d):
    """From the text and what is told of it: ids in any case, repeated, and one that is none."""
    a = F.concat(F.lit("see cve-2024-"), (F.col("doc_id") + 10000).cast("string"), F.lit(", CVE-1-2 and "), F.coalesce("text", F.lit("")))
    b = F.concat(F.lit("https://x.y/Ghsa-ab12-CD34-"), F.lpad((F.col("doc_id") % 9973).cast("string"), 4, "0"), F.lit("#CVE-2024-"), (F.col("doc_id") + 10000).cast("string"))
    return docs(spark, d).select("doc_id", F.array_join(X.vulnerability_ids(a, b, F.lit(None).cast("string")), ",").alias("ids"))


@query("identifier_masking", r"SELECT doc_id, sha256(regexp_replace(text, '\.\s*[A-Za-z_][A-Za-z0-9_]*', '.MEMBER', 'g')) AS h FROM documents")
def masking(spark, d):
    return docs(spark, d).select("doc_id", F.sha2(F.regexp_replace("text", r"\.\s*[A-Za-z_][A-Za-z0-9_]*", ".MEMBER"), 256).alias("h"))


@query("keep_list_masking")
def keep_list(spark, d):
    """Every text as prose and as a source file: members, calls and commands stay."""
    both = docs(spark, d).select("doc_id", F.explode(F.array("text", source_file(F.col("text")))).alias("t"))
    return both.select("doc_id", F.sha2(M.mask_api_shape("t"), 256).alias("h"))


#: Words with any $ between them, and what lies between words.
_SEGMENT = r"[\p{L}\p{N}_]+(?:\$+[\p{L}\p{N}_]+)*|[^\p{L}\p{N}_]+"
_KEPT = ", ".join(f"'{w}'" for w in M.KEEP)


def _masked(t: str, keep: str) -> str:
    return f"array_to_string(list_transform(regexp_extract_all({t}, '{_SEGMENT}'), lambda x: CASE WHEN regexp_full_match(x, '[A-Za-z_][A-Za-z0-9_$]*') AND {keep} THEN 'ID' ELSE x END), '')"


@query("symbol_masking", f"SELECT doc_id, sha256({_masked('text', f'x NOT IN ({_KEPT})')}) AS h FROM documents")
def symbol_masking(spark, d):
    return docs(spark, d).select("doc_id", F.sha2(M.mask_symbols(F.col("text")), 256).alias("h"))


_MIXED = "regexp_replace(text, ' (t|a)h', ' x_y see CWE-79 http://a.b/c?d a/b.c toDo \\1h', 'g')"


@query("query_symbol_masking", "SELECT doc_id, sha256(" + _masked(rf"regexp_replace(regexp_replace(regexp_replace({_MIXED}, 'https?://[^\s]+', 'URL', 'g'), '(?i)\b(?:CVE|CWE)-\d+(?:-\d+)?\b', 'ID', 'g'), '\b(?:[A-Za-z0-9_.+-]+/)+[A-Za-z0-9_.+-]+\b', 'PATH', 'g')", "(regexp_matches(x, '[_0-9$]') OR regexp_matches(x, '[a-z][A-Z]'))") + ") AS h FROM documents")
def query_symbol_masking(spark, d):
    t = F.regexp_replace("text", " (t|a)h", " x_y see CWE-79 http://a.b/c?d a/b.c toDo $1h")
    return docs(spark, d).select("doc_id", F.sha2(M.mask_query_symbols(t), 256).alias("h"))


@query("ordered_regex_classifier", "SELECT CASE WHEN regexp_matches(text, '[#$%&*]{3}') THEN 'junk' WHEN regexp_matches(text, '[|]') THEN 'table' WHEN regexp_matches(text, '(?i)license') THEN 'license' ELSE 'unclassified' END AS class, count(*) AS n FROM documents GROUP BY 1")
def classifier(spark, d):
    rules = [("junk", "[#$%&*]{3}"), ("table", "[|]"), ("license", "(?i)license")]
    return docs(spark, d).select(X.first_match(F.col("text"), rules, "unclassified").alias("class")).groupBy("class").agg(F.count(F.lit(1)).alias("n"))


@query("leak_predicate", r"SELECT doc_id, regexp_matches(text, '(?i)\b(cve-\d{4}-\d+)\b') OR regexp_matches(text, '(^|[^A-Za-z0-9])[A-Za-z0-9_/]+\.(java|py|c|js|go):\d+') AS leak FROM documents")
def leak(spark, d):
    return docs(spark, d).select("doc_id", X.leaks(F.col("text")).alias("leak"))


@query("filled_value_predicate", "SELECT event_id, lower(trim(v)) NOT IN ('', 'n/a', 'na', 'todo', 'tbd', 'none') AS filled FROM (SELECT event_id, CASE event_id % 4 WHEN 0 THEN ' TODO ' WHEN 1 THEN 'n/a' WHEN 2 THEN '' ELSE event_type END AS v FROM events)")
def filled(spark, d):
    i = F.col("event_id") % 4
    v = F.when(i == 0, " TODO ").when(i == 1, "n/a").when(i == 2, "").otherwise(F.col("event_type"))
    return table(spark, d, "events").select("event_id", X.is_filled(v).alias("filled"))


@query("nested_path_coalesce", "SELECT event_id, coalesce(json_extract_string(props, '$.missing'), json_extract_string(props, '$.k')) AS k FROM events")
def nested_path(spark, d):
    e = table(spark, d, "events").select("event_id", F.try_parse_json("props").alias("doc"))
    return e.select("event_id", nested("doc", "$.missing", "$.k").alias("k"))


_R = sql("ranks")


@query("rank_miss_state", _R + " SELECT CASE WHEN NOT (candidate_count > 1100) THEN 'coverage_gap' WHEN left_rank > 200 THEN 'below_budget' WHEN left_rank IS NULL THEN 'no_overlap' ELSE 'unexpected' END AS state, count(*) AS n FROM ranks GROUP BY 1")
def miss_state(spark, d):
    return fixture(spark, d, "ranks").select(V.miss_state(F.col("left_rank"), F.col("candidate_count") > 1100, 200).alias("state")).groupBy("state").agg(F.count(F.lit(1)).alias("n"))


@query("size_buckets", _R + " SELECT CASE WHEN candidate_count < 1100 THEN 'lt_1100' WHEN candidate_count < 1300 THEN 'lt_1300' ELSE 'ge_1300' END AS bucket, count(*) AS n FROM ranks GROUP BY 1")
def buckets(spark, d):
    return fixture(spark, d, "ranks").select(V.size_bucket(F.col("candidate_count"), [1100, 1300]).alias("bucket")).groupBy("bucket").agg(F.count(F.lit(1)).alias("n"))


@query("row_validation_codes", "SELECT o_orderkey, concat_ws(',', CASE WHEN o_custkey % 5 = 0 THEN 'bad_customer' END, CASE WHEN o_totalprice < 5000 THEN 'low_price' END) AS errors FROM orders")
def validation(spark, d):
    v = V.validate(table(spark, d, "orders"), [(F.col("o_custkey") % 5 == 0, "bad_customer"), (F.col("o_totalprice") < 5000, "low_price")])
    return v.select("o_orderkey", F.array_join("errors", ",").alias("errors"))


@query("actionability_score", "SELECT p_partkey, CASE WHEN p_size % 7 > 0 THEN round(((p_size > 10)::INT + (p_retailprice > 1000)::INT + (p_brand = 'Brand#2')::INT) / 3e0, 6) END AS score FROM part")
def actionability(spark, d):
    c = [F.col("p_size") > 10, F.col("p_retailprice") > 1000, F.col("p_brand") == "Brand#2"]
    return table(spark, d, "part").select("p_partkey", F.round(V.actionability(c, F.col("p_size") % 7 == 0), 6).alias("score"))


@query("claim_boundaries", _R + ", m AS (SELECT track, " + ", ".join(f"round(count(*) FILTER (right_rank <= {k}) / count(*) - count(*) FILTER (left_rank <= {k}) / count(*), 6) AS d{k}" for k in (50, 100, 200)) + " FROM ranks GROUP BY track) SELECT * FROM (UNPIVOT m ON d50, d100, d200 INTO NAME budget VALUE delta_rate) WHERE delta_rate >= 0.05")
def claims(spark, d):
    n = F.count(F.lit(1))
    m = fixture(spark, d, "ranks").groupBy("track").agg(*[F.round(F.count_if(F.col("right_rank") <= k) / n - F.count_if(F.col("left_rank") <= k) / n, 6).alias(f"d{k}") for k in (50, 100, 200)])
    return V.claims(m, "track", ["d50", "d100", "d200"], 0.05)


@query("release_gate", sql("groups") + " SELECT guideline_id, count(*) AS total, count(*) FILTER (weight > 0) AS supported, string_agg(DISTINCT CASE WHEN NOT weight > 0 THEN label END, ',' ORDER BY CASE WHEN NOT weight > 0 THEN label END) AS unsupported FROM groups GROUP BY 1")
def release_gate(spark, d):
    g = V.release_gate(fixture(spark, d, "groups").withColumn("ok", F.col("weight") > 0), "guideline_id", "label", "ok")
    return g.select("guideline_id", "total", "supported", F.nullif(F.array_join("unsupported", ","), F.lit("")).alias("unsupported"))


_LEX = [("m1", "license", 4.0, True), ("m1", "version", 1.0, False), ("m2", "token", 3.0, False), ("m2", "the", 0.25, False), ("m3", "with", 1.0, True), ("m3", "that", 1.0, True)]


@query("lexicon_attribution", "WITH lex(mechanism_id, word, weight, required) AS (VALUES " + ", ".join(f"('{a}', '{b}', {c}e0, {str(e).lower()})" for a, b, c, e in _LEX) + """),
w AS (SELECT DISTINCT doc_id, lower(t) AS word FROM (SELECT doc_id, unnest(regexp_extract_all(text, '[A-Za-z0-9_]+')) AS t FROM documents)),
need AS (SELECT mechanism_id, count(*) FILTER (required) AS need FROM lex GROUP BY 1),
s AS (SELECT doc_id, mechanism_id, CASE WHEN max(need) > count(*) FILTER (required) THEN 0 ELSE sum(weight) END AS score FROM w JOIN lex l USING (word) JOIN need USING (mechanism_id) GROUP BY doc_id, mechanism_id)
SELECT doc_id, mechanism_id, score FROM (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY score DESC, mechanism_id) AS rn FROM s WHERE score > 0) WHERE rn = 1""")
def lexicon(spark, d):
    lex = spark.createDataFrame(_LEX, "mechanism_id string, word string, weight double, required boolean")
    items = docs(spark, d).select("doc_id", X.tokens(F.col("text")).alias("tokens"))
    return V.attribute(V.lexicon_scores(items, "doc_id", "tokens", lex), "doc_id").select("doc_id", "mechanism_id", "score")

_PHRASES = [
    ("license_grant", "software_license_terms", ["license", "mit license", "version 2.0", "released under the"], ["apache license"], [["license", "licence"], ["mit", "apache license", "released under"]]),
    ("contact", "contact_detail call", ["call", "@", "555"], ["+1 ("], []),
    ("prose", "the_running_tion", ["of the", "shly", "edly", "in the and"], ["and in the"], [["of the", "de la"]]),
    ("romance", "lengua_el_los", ["de la", "los", "ción", "los"], ["de los", "que"], [["de la", "que"], ["del", "les", "las"]]),
    ("never", "the", ["of the"], [], [["no such phrase", " "], ["of the"]]),
]
_QUOTED = lambda x: "'" + x.replace("'", "''") + "'"


def _lexicon_sql(entries: str, needs: str) -> str:
    """Scores by their definition; ``e``: mechanism_id, phrase, shown, weight, need and ``n``: mechanism_id, groups."""
    stop = ", ".join(map(_QUOTED, P.STOP_WORDS))
    return f"""WITH e AS ({entries}), n AS ({needs}),
d AS (SELECT doc_id, lower(text) AS t, list_filter(regexp_extract_all(lower(text), '{P.TOKEN}'), lambda x: len(x) >= 3 AND x NOT IN ({stop})) AS w FROM documents),
h AS (SELECT doc_id, e.* FROM d JOIN e ON CASE WHEN regexp_matches(phrase, '[^a-z0-9]') THEN contains(t, phrase) ELSE list_contains(w, phrase) END)
SELECT doc_id, mechanism_id, CAST(sum(weight) AS DOUBLE) AS score, coalesce(string_agg(DISTINCT shown, '|' ORDER BY shown), '') AS matches
FROM h JOIN n USING (mechanism_id) GROUP BY doc_id, mechanism_id HAVING count(DISTINCT need) = max(groups)"""


def _phrase_entries() -> str:
    rows = []
    for m, family, keywords, aliases, required in _PHRASES:
        rows += [(m, k, _QUOTED(k), 3 if " " in k or "." in k else 1, "NULL") for k in keywords] + [(m, a, _QUOTED(a), 4, "NULL") for a in aliases]
        rows += [(m, t, "NULL", 0.25, "NULL") for t in sorted(set(family.replace("_", " ").split())) if len(t) >= 3 and t not in P.STOP_WORDS]
        rows += [(m, g, "NULL", 0, i) for i, group in enumerate(required) for g in group if g.strip()]
    return "SELECT * FROM (VALUES " + ", ".join(f"({_QUOTED(m)}, {_QUOTED(p)}, {s}, {w}, {n})" for m, p, s, w, n in rows) + ") t(mechanism_id, phrase, shown, weight, need)"


@query("phrase_lexicon_scores", _lexicon_sql(_phrase_entries(), "SELECT * FROM (VALUES " + ", ".join(f"('{m[0]}', {len(m[4])})" for m in _PHRASES) + ") t(mechanism_id, groups)"))
def phrase_scores(spark, d):
    s = P.mechanism_scores(docs(spark, d), "doc_id", "text", P.lexicon_of(spark, _PHRASES))
    return s.withColumn("matches", F.array_join("matches", "|"))


@query("phrase_lexicon_best", "SELECT doc_id, mechanism_id, score FROM (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY score DESC, mechanism_id) AS place FROM (" + SQL["phrase_lexicon_scores"] + ") WHERE score >= 4) WHERE place = 1")
def phrase_best(spark, d):
    s = P.mechanism_scores(docs(spark, d), "doc_id", "text", P.lexicon_of(spark, _PHRASES))
    return P.ranked_mechanisms(s, "doc_id", 4.0).where("place = 1").select("doc_id", "mechanism_id", "score")


_WORDS = "string_split(text, ' ')"


@query("phrase_lexicon_passages", _lexicon_sql(
    f"""WITH b AS (SELECT CAST(item_id AS VARCHAR) AS m, lower(array_to_string({_WORDS}[1:3], ' ')) AS a, array_to_string({_WORDS}[1:3], ' ') AS a_shown, lower(array_to_string({_WORDS}[4:6], ' ')) AS b, array_to_string({_WORDS}[1:8], ' ') AS c FROM benchmark)
    SELECT m AS mechanism_id, a AS phrase, a_shown AS shown, 3 AS weight, NULL AS need FROM b UNION ALL SELECT m, lower(c), c, 4, NULL FROM b UNION ALL SELECT m, a, NULL, 0, 0 FROM b UNION ALL SELECT m, b, NULL, 0, 0 FROM b""",
    "SELECT CAST(item_id AS VARCHAR) AS mechanism_id, 1 AS groups FROM benchmark"))
def phrase_passages(spark, d):
    """A lexicon that grows with the data: the beginnings of the benchmark's passages."""
    words = F.split("text", " ")
    join = lambda a, n: F.array_join(F.slice(words, a, n), " ")
    lex = table(spark, d, "benchmark").select(F.col("item_id").cast("string").alias("mechanism_id"), F.lit("").alias("family"), F.array(join(1, 3)).alias("keywords"), F.array(join(1, 8)).alias("aliases"), F.array(F.array(join(1, 3), join(4, 3))).alias("required"))
    return P.mechanism_scores(docs(spark, d), "doc_id", "text", lex).withColumn("matches", F.array_join("matches", "|"))


@query("multiset_difference", "(SELECT o_custkey AS id, 'missing' AS side FROM (SELECT o_custkey FROM orders WHERE o_orderkey % 2 = 0 EXCEPT ALL SELECT o_custkey FROM orders WHERE o_orderkey % 2 = 1)) UNION ALL (SELECT o_custkey, 'extra' FROM (SELECT o_custkey FROM orders WHERE o_orderkey % 2 = 1 EXCEPT ALL SELECT o_custkey FROM orders WHERE o_orderkey % 2 = 0))")
def multiset(spark, d):
    o = table(spark, d, "orders").withColumnRenamed("o_custkey", "id")
    return V.multiset_difference(o.where("o_orderkey % 2 = 0").select("id"), o.where("o_orderkey % 2 = 1").select("id"))


@query("array_set_algebra", "WITH a AS (SELECT o_custkey AS k, list_sort(list(DISTINCT o_orderstatus)) AS x FROM orders WHERE o_totalprice > 250000 GROUP BY 1), b AS (SELECT o_custkey AS k, list_sort(list(DISTINCT o_orderstatus)) AS y FROM orders WHERE o_totalprice <= 250000 GROUP BY 1) SELECT k, array_to_string(list_sort(list_intersect(x, y)), ',') AS common, array_to_string(list_sort(list_filter(x, lambda v: NOT list_contains(y, v))), ',') AS gone FROM a JOIN b USING (k)")
def array_sets(spark, d):
    o = table(spark, d, "orders").withColumnRenamed("o_custkey", "k")
    a = o.where("o_totalprice > 250000").groupBy("k").agg(F.collect_set("o_orderstatus").alias("x"))
    b = o.where("o_totalprice <= 250000").groupBy("k").agg(F.collect_set("o_orderstatus").alias("y"))
    return a.join(b, "k").select("k", F.array_join(F.array_sort(F.array_intersect("x", "y")), ",").alias("common"), F.array_join(F.array_sort(F.array_except("x", "y")), ",").alias("gone"))


_MAP = "CASE status WHEN 'signup' THEN 'queued' WHEN 'click' THEN 'running' WHEN 'view' THEN 'verifying' WHEN 'purchase' THEN 'succeeded' ELSE 'failed' END"


def _states(spark, d):
    return fixture(spark, d, "ledger").withColumn("state_", F.expr(_MAP))


@query("task_state_machine", sql("ledger") + f""", m AS (SELECT task_id, ord, {_MAP} AS s FROM ledger), p AS (SELECT *, lag(s) OVER (PARTITION BY task_id ORDER BY ord) AS p FROM m)
SELECT task_id, arg_max(s, ord) AS state, count(*) AS events, count(*) FILTER (p IS NOT NULL AND NOT ((p = 'queued' AND s IN ('running', 'cancelled')) OR (p = 'running' AND s IN ('verifying', 'failed', 'queued')) OR (p = 'verifying' AND s IN ('succeeded', 'failed', 'queued')))) AS violations FROM p GROUP BY task_id""")
def state_machine(spark, d):
    return E.task_states(_states(spark, d), "task_id", "ord", "state_")


@query("lease_expiry", sql("ledger") + " SELECT ord, round(gap - 3600, 3) AS late FROM (SELECT ord, (epoch_us(at_ts) - epoch_us(lag(at_ts) OVER (PARTITION BY task_id ORDER BY at_ts))) / 1e6 AS gap FROM ledger) WHERE gap > 3600")
def lease_expiry(spark, d):
    return E.expired_leases(fixture(spark, d, "ledger"), "task_id", "at_ts", 3600.0).select("ord", F.round("late", 3).alias("late"))


@query("lease_expirations", sql("ledger") + " SELECT task_id, epoch_us(at_ts) + 3600000000 AS expired_at FROM (SELECT task_id, at_ts, coalesce(lead(at_ts) OVER (PARTITION BY task_id ORDER BY at_ts), max(at_ts) OVER ()) AS nxt FROM ledger) WHERE epoch_us(at_ts) + 3600000000 < epoch_us(nxt)")
def lease_expirations(spark, d):
    return leases.lease_expirations(fixture(spark, d, "ledger"), "task_id", "at_ts", 3600).select("task_id", F.unix_micros("expired_at").alias("expired_at"))


@query("lease_fold")
def lease_fold(spark, d):
    """Events as claims, heartbeats and finishes of three tasks a project by two owners; some events are of no project."""
    e = table(spark, d, "events").select(
        F.when(F.col("user_id") % 11 > 0, F.col("user_id")).alias("project"), F.concat_ws("/", "user_id", (F.col("event_id") % 3).cast("string")).alias("task"),
        F.when(F.col("event_id") % 2 == 0, "a").otherwise("b").alias("owner"), F.expr("CASE event_type WHEN 'click' THEN 'claim' WHEN 'purchase' THEN 'finish' WHEN 'error' THEN 'other' ELSE 'heartbeat' END").alias("kind"),
        "ts", F.col("event_id").alias("ord"))
    return leases.fold_leases(e, 86400.0)


@query("attempt_sequence", sql("ledger") + " SELECT ord, row_number() OVER (PARTITION BY task_id ORDER BY ord) AS attempt FROM ledger")
def attempts(spark, d):
    return E.attempt_index(fixture(spark, d, "ledger"), "task_id", "ord").select("ord", "attempt")


@query("resume_pending_work", "SELECT c_custkey FROM customer WHERE c_custkey NOT IN (SELECT user_id FROM events WHERE event_type = 'purchase')")
def resume(spark, d):
    done = table(spark, d, "events").where("event_type = 'purchase'").select(F.col("user_id").alias("c_custkey"))
    return E.pending(table(spark, d, "customer").select("c_custkey"), done, "c_custkey")


@query("token_running_totals", "SELECT user_id, round(sum(value), 4) AS tokens, count(*) AS events FROM events GROUP BY 1")
def token_totals(spark, d):
    return E.token_totals(table(spark, d, "events"), "user_id", "value").withColumn("tokens", F.round("tokens", 4))


@query("terminal_state_markers", "SELECT user_id, coalesce(arg_min(m, p) FILTER (p > 0), 'unfinished') AS state FROM (SELECT user_id, m, list_position(['done', 'failed', 'timeout', 'skipped'], m) AS p FROM (SELECT user_id, CASE WHEN value <= 95 THEN 'log' WHEN event_type = 'purchase' THEN 'done' WHEN event_type = 'error' THEN 'failed' ELSE 'log' END AS m FROM events)) GROUP BY 1")
def markers(spark, d):
    m = F.when(F.col("value") <= 95, "log").when(F.col("event_type") == "purchase", "done").when(F.col("event_type") == "error", "failed").otherwise("log")
    return E.terminal_state(table(spark, d, "events").withColumn("m", m), "user_id", "m")


@query("event_time_windows", "SELECT strftime(time_bucket(INTERVAL 1 HOUR, ts), '%Y-%m-%d %H') AS hour, event_type, count(*) AS n FROM events GROUP BY ALL")
def event_windows(spark, d):
    w = E.windowed_counts(table(spark, d, "events"), "ts", "event_type", width="1 hour")
    return w.select(F.date_format("window.start", "yyyy-MM-dd HH").alias("hour"), "event_type", "n")


@query("lane_feature_matrix", sql("anchors") + ", r AS (SELECT *, row_number() OVER (PARTITION BY case_id ORDER BY round(score_a, 9) DESC, anchor_id) AS ra, row_number() OVER (PARTITION BY case_id ORDER BY round(score_b, 9) DESC, anchor_id) AS rb FROM anchors) SELECT anchor_id, round(1e0 / (60 + ra) + 1e0 / (60 + rb), 9) AS f3, round(CASE WHEN file = 'f1' THEN greatest(1e0 / (60 + ra), 1e0 / (60 + rb)) ELSE 0 END, 9) AS f17 FROM r")
def lane_matrix(spark, d):
    a = fixture(spark, d, "anchors")
    r = R.rank(R.rank(a, ["case_id"], "score_a", "anchor_id", "ra"), ["case_id"], "score_b", "anchor_id", "rb")
    f = L.lane_features(r, "ra", "rb", "file", ["f0", "f1"])
    return f.select("anchor_id", F.round(F.get("features", F.lit(2)), 9).alias("f3"), F.round(F.get("features", F.lit(16)), 9).alias("f17"))


def _pool_sql(top: int) -> str:
    return sql("anchors") + f""", u AS (SELECT case_id, anchor_id, max(score_a) AS score_a, max(score_b) AS score_b, bool_or(positive) AS positive FROM anchors GROUP BY ALL),
k AS (SELECT *, row_number() OVER (PARTITION BY case_id ORDER BY score_a DESC, anchor_id) AS ra, row_number() OVER (PARTITION BY case_id ORDER BY score_b DESC, anchor_id) AS rb FROM u),
c AS (SELECT * FROM k WHERE positive OR ra <= {top} OR rb <= {top}), o AS (SELECT *, row_number() OVER (PARTITION BY case_id ORDER BY substr(sha256(concat('s', chr(0), CAST(case_id AS VARCHAR), chr(0), anchor_id)), 1, 16), anchor_id) AS rt FROM k ANTI JOIN c USING (case_id, anchor_id)),
pool AS (SELECT case_id, anchor_id, positive FROM c UNION ALL SELECT case_id, anchor_id, positive FROM o WHERE rt <= 1)"""


_POOL = ("case_id", "anchor_id", "positive", ["score_a", "score_b"])


@query("competitor_pool", _pool_sql(1) + " SELECT case_id, anchor_id, positive FROM pool")
def pool(spark, d):
    return L.competitor_pool(fixture(spark, d, "anchors"), *_POOL, 1, 1, "s")


@query("competitor_pairs", _pool_sql(2) + """, good AS (SELECT case_id, anchor_id AS pos_id, row_number() OVER (PARTITION BY case_id ORDER BY anchor_id) - 1 AS at_pos FROM pool WHERE positive),
bad AS (SELECT case_id, anchor_id AS neg_id, row_number() OVER (PARTITION BY case_id ORDER BY anchor_id) - 1 AS at_neg, count(*) OVER (PARTITION BY case_id) AS many FROM pool WHERE NOT positive),
j AS (SELECT *, at_pos * many + at_neg AS pair FROM good JOIN bad USING (case_id)), r AS (SELECT *, row_number() OVER (PARTITION BY case_id ORDER BY substr(sha256(concat('s', chr(0), CAST(case_id AS VARCHAR), chr(0), CAST(pair AS VARCHAR))), 1, 16), pair) AS rn FROM j)
SELECT r.case_id, pair, pos_id, neg_id, round(x.score_a - y.score_a, 4) AS d_a, round(x.score_b - y.score_b, 4) AS d_b FROM r JOIN u x ON x.case_id = r.case_id AND x.anchor_id = pos_id JOIN u y ON y.case_id = r.case_id AND y.anchor_id = neg_id WHERE rn <= 3""")
def competitor_pairs(spark, d):
    diffs = L.competitor_pairs(fixture(spark, d, "anchors"), *_POOL, 2, 1, 3, "s", F.array("score_a", "score_b"))
    return diffs.select("case_id", "pair", "pos_id", "neg_id", F.round(F.get("d", F.lit(0)), 4).alias("d_a"), F.round(F.get("d", F.lit(1)), 4).alias("d_b"))


@query("pairwise_router_ranking")
def router(spark, d):
    """Trained on at most eight sampled pairs a case."""
    rows, x = fixture(spark, d, "anchors"), F.array(F.col("score_a") / 1e5, F.col("score_b") / 50, F.col("disc") * 10)
    w = L.train_pairwise(L.competitor_pairs(rows, *_POOL, 2, 1, 8, "s", x, ["disc"]), "d", 3, epochs=5)
    a = L.best_rows(rows, "case_id", "anchor_id", "positive", ["score_a", "score_b", "disc"]).withColumn("x", x)
    r = R.rank(L.score(a, "x", w), ["case_id"], "router_score", "anchor_id")
    return r.groupBy("case_id").agg(F.min(F.when(F.col("positive"), F.col("rn"))).alias("first_rank"))


@query("greedy_directory_groups")
def directory_groups(spark, d):
    p = table(spark, d, "pages").select((F.col("page_id") % 40).alias("case_id"), F.regexp_replace("url", "^http://", "").alias("path"), F.col("page_id").alias("rank"))
    return L.group_by_directory(p, "case_id", "path", "rank", 3)


@query("query_residual_adapter")
def adapter(spark, d):
    g = np.random.default_rng(5)
    w = (g.normal(size=(16, 64)) / 8, g.normal(size=16), g.normal(size=(64, 16)) / 4, g.normal(size=64))
    e = L.residual_adapter(table(spark, d, "embeddings").select("vec_id", "embedding"), "embedding", *w)
    return e.select("vec_id", F.transform("embedding", lambda x: F.round(x, 6)).alias("adapted"))


@query("adapter_training")
def adapter_training(spark, d):
    """Every vector as a query: four vectors of its label are its positives, four of the next label its competition; the margin before and after."""
    e = table(spark, d, "embeddings").select("vec_id", F.col("embedding").cast("array<double>").alias("q"), "label")
    first = F.row_number().over(Window.partitionBy("label").orderBy(F.xxhash64("vec_id"), "vec_id"))
    pool = e.withColumn("_rn", first).where("_rn <= 4").groupBy("label").agg(F.array_sort(F.collect_list("q")).alias("bag"))  # four rows a label
    labels = F.lit(e.agg(F.max("label")).first()[0] + 1)
    rows = e.join(pool.withColumnRenamed("bag", "p"), "label").withColumn("_next", (F.col("label") + 1) % labels)
    rows = rows.join(pool.select(F.col("label").alias("_next"), F.col("bag").alias("c")), "_next")
    s = AD.Settings(rate=0.01, epochs=3, scale=0.5)
    w, _ = AD.train_adapter(rows, "vec_id", "q", "p", "c", AD.start_weights(64, 8, 5), s)
    dot = lambda a, b: F.aggregate(F.zip_with(a, b, lambda x, y: x * y), F.lit(0.0), lambda n, x: n + x)
    mean = lambda q, bag: F.aggregate(F.transform(bag, lambda v: dot(F.col(q), v)), F.lit(0.0), lambda n, x: n + x) / F.size(bag)
    out = L.residual_adapter(rows.withColumn("old", F.col("q")), "q", *w, scale=s.scale)
    return out.select("vec_id", F.round(mean("old", "p") - mean("old", "c"), 5).alias("before"), F.round(mean("q", "p") - mean("q", "c"), 5).alias("after"))


@query("embedder_protocol", """WITH w AS (SELECT doc_id, CAST('0x' || substr(md5(t), 1, 8) AS BIGINT) AS h FROM (SELECT doc_id, unnest(regexp_extract_all(lower(text), '[a-z0-9_]+')) AS t FROM documents)),
b AS (SELECT doc_id, h % 64 AS pos, sum(CASE WHEN h >= 2147483648 THEN 1e0 ELSE -1e0 END) AS v FROM w GROUP BY ALL), n AS (SELECT doc_id, sqrt(sum(v * v)) AS norm FROM b GROUP BY 1)
SELECT doc_id, pos, round(v / norm, 6) AS value FROM b JOIN n USING (doc_id) WHERE v <> 0""")
def embedder(spark, d):
    e = L.embed(docs(spark, d).select("doc_id", "text"), "text", L.hashing_encoder())
    return e.select("doc_id", F.posexplode("embedding").alias("pos", "value")).where("value <> 0").select("doc_id", F.col("pos").cast("long").alias("pos"), F.round("value", 6).alias("value"))

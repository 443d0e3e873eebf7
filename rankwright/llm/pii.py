"""PII: patterns, then information-theoretic sanitisation of what gives them away.

Base spans come from four patterns with validity checks. Each value found is a
protected entity. Words are counted over whole documents:
``P(entity | word) = documents with both / documents with the word``. A word's
disclosure is its pointwise mutual information with the entity as a share of
the entity's information content, ``1 + ln P(entity | word) / IC(entity)``: one
if the word gives the entity away for certain, zero if it says nothing. Words
met with the entity in MIN_CONTEXTS different contexts (CONTEXT code points on
either side of it; copies of a passage are one context) and in more than one
text are generalised at GENERALISE and removed at REMOVE; all their occurrences
in all documents are spans of the kind ``term``. DataFrame operations only.

Cases: a null text is empty; a document without base spans has terms only;
spans are code points, end exclusive, and refer to the text as it stands;
equal texts have equal spans; rows repeat as they stand; an empty table gives
an empty result; more columns pass untouched.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from rankwright.llm.common import cut, matches, spread, table, whole_text

KINDS = ["email", "ip", "card", "phone"]
#: The four patterns with possessive loops, which cannot back up and need no deep stack. A start inside a run of the
#: first class never matches more than the run's start does, so only that start, or the end of the last match, is tried.
PATTERNS = {
    "email": r"(?:(?<![A-Za-z0-9._%+-])|\G)[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?:(?<![0-9])|\G)[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    "card": r"[0-9]++(?:[\x20-][0-9]++)*+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
GATES = {"ip": r"[0-9]\.[0-9]++\.[0-9]", "card": r"[0-9](?:[\x20-]?[0-9]){15}"}
CONTEXT = 60
MIN_CONTEXTS = 2  # find() tells two by the least and the largest hash
GENERALISE = 0.8
REMOVE = 0.95
#: Tables of words, pairs or texts up to so many rows are broadcast; larger ones join by shuffle.
BROADCAST_ROWS = 200_000
#: ... and with at most so many spans in them (about 64 MB).
BROADCAST_SPANS = 2_000_000
_SPAN = "array<struct<s:int,e:int,v:string>>"
_WORD = r"\p{L}++"


def intervals(text: Column, pattern: str) -> Column:
    """All matches as (start, end, value)."""
    item = lambda s, e, v: F.struct(s.alias("s"), e.alias("e"), v.alias("v"))
    return matches(text, F.lit(pattern), item, "struct<s:int,e:int,v:string>")


def _digits(v: Column) -> Column:
    return F.regexp_replace(v, "[^0-9]", "")


def _valid(kind: str, v: Column) -> Column:
    if kind == "ip":
        small = lambda p: F.coalesce(F.ltrim(p, F.lit("0")).try_cast("int") <= 255, p.rlike("^0+$"))
        return F.forall(F.split(v, r"\."), small)
    n = F.length(_digits(v))
    if kind == "phone":
        return (n >= 8) & (n <= 15)
    if kind == "card":
        d = lambda i: F.substring(_digits(v), -i, F.lit(1)).cast("int")
        one = lambda i: F.when(i % 2 == 1, d(i)).otherwise(d(i) * 2 - F.when(d(i) > 4, 9).otherwise(0))
        luhn = F.aggregate(F.sequence(F.lit(1), n), F.lit(0), lambda acc, i: acc + one(i)) % 10 == 0
        return (n >= 16) & (n <= 19) & F.when((n >= 16) & (n <= 19), luhn)
    return F.lit(True)


def _check(kind: str):
    return lambda x: _valid(kind, x["v"])


def base_spans(rows: DataFrame, text: str) -> DataFrame:
    """Add ``_email`` ... ``_phone``: arrays of valid spans."""
    for kind in KINDS:
        gate = {"email": F.contains(text, F.lit("@")), "phone": F.contains(text, F.lit("+"))}.get(kind)
        gate = F.col(text).rlike(GATES[kind]) if gate is None else gate
        found = F.filter(intervals(F.col(text), PATTERNS[kind]), _check(kind))
        rows = rows.withColumn(f"_{kind}", F.when(gate, found).otherwise(F.array().cast(_SPAN)))
    return rows


def _contexts(text: Column) -> Column:
    """The entities of a text, each with the least and the largest hash of its surroundings."""

    def around(kind: str):
        def one(x: Column) -> Column:
            at = F.greatest(x["s"] - CONTEXT, F.lit(0))
            before, after = F.substring(text, at + 1, x["s"] - at), F.substring(text, x["e"] + 1, F.lit(CONTEXT))
            value = F.lower(x["v"]) if kind == "email" else x["v"] if kind == "ip" else _digits(x["v"])
            return F.struct(F.concat(F.lit(f"{kind}:"), value).alias("entity"), F.xxhash64(before, after).alias("ctx"))

        return one

    return F.concat(*[F.transform(f"_{k}", around(k)) for k in KINDS]).cast("array<struct<entity:string,ctx:bigint>>")


def _words(text: Column) -> Column:
    return F.transform(F.regexp_extract_all(text, F.lit(_WORD), F.lit(0)), F.lower)


def _placed(hits: Column, gaps: Column, lengths: Column) -> Column:
    """Spans of the words at the indexes ``hits`` (i, v), from the lengths of the gaps before words and of the words."""

    def step(acc: Column, h: Column) -> Column:
        n = h["i"] - acc["i"]
        passed = lambda c: F.aggregate(F.slice(c, acc["i"] + 1, n), F.lit(0), lambda x, y: x + y)
        at = acc["at"] + passed(gaps) + passed(lengths)
        start = at + F.get(gaps, h["i"])
        found = F.struct(start.alias("s"), (start + F.get(lengths, h["i"])).alias("e"), h["v"].alias("v"))
        return F.struct(h["i"].alias("i"), at.alias("at"), F.concat(acc["out"], F.array(found)).cast(_SPAN).alias("out"))

    start = F.struct(F.lit(0).alias("i"), F.lit(0).alias("at"), F.array().cast(_SPAN).alias("out"))
    return F.aggregate(F.array_sort(hits), start, step, lambda a: a["out"])


def _bounded(df: DataFrame, spans: str | None = None) -> DataFrame:
    """``df`` to be broadcast if it has at most BROADCAST_ROWS rows and, in its arrays ``spans``, BROADCAST_SPANS elements."""
    few = df.limit(BROADCAST_ROWS + 1).count() <= BROADCAST_ROWS
    if few and spans:
        few = df.agg(F.coalesce(F.sum(F.size(spans)), F.lit(0))).first()[0] <= BROADCAST_SPANS
    return F.broadcast(df) if few else df


def find(docs: DataFrame) -> DataFrame:
    """Each row of ``docs`` (without its text) with ``_email`` ... ``_phone`` and ``_term`` (s, e, v = action); columns of these names are replaced."""
    others = [docs[c] for c in docs.columns if c not in {"text", "_term", *(f"_{k}" for k in KINDS)}]
    rows = base_spans(docs.select(F.struct(*others).alias("_doc"), whole_text().alias("_text")), "_text")
    any_ = sum((F.size(f"_{k}") for k in KINDS), F.lit(0)) > 0
    spans = [f"_{k}" for k in KINDS]
    rows = rows.withColumn("_ctx", F.when(any_, F.array_distinct(_contexts(F.col("_text"))))).withColumn("_key", F.sha2("_text", 256))
    rows = rows.withColumn("_bag", F.when(any_, F.array_distinct(_words(F.col("_text")))))
    rows = cut(rows.drop("_text").withColumn("_row", F.monotonically_increasing_id()), "base")
    ends = [F.min("_key").alias("_lo"), F.max("_key").alias("_hi")]
    met = rows.where("_ctx IS NOT NULL").select("_row", "_key", F.explode("_ctx").alias("_c"))
    met = met.groupBy("_row", "_key", "_c.entity").agg(F.min("_c.ctx").alias("_from"), F.max("_c.ctx").alias("_to"))
    met = cut(met, "met")
    sizes = met.groupBy("entity").agg(F.count(F.lit(1)).alias("around"), *ends, F.min("_from").alias("_from"), F.max("_to").alias("_to"))
    # what one text or one context holds alone cannot be asked
    sizes = cut(sizes.where("_lo < _hi AND _from < _to").select("entity", "around"), "sizes")
    near = met.join(_bounded(sizes.select("entity")), "entity", "left_semi")
    near = near.join(rows.where("_bag IS NOT NULL").select("_row", "_bag"), "_row").select("_key", "entity", "_from", "_to", F.explode("_bag").alias("word"))
    pairs = near.groupBy("entity", "word").agg(F.count(F.lit(1)).alias("near"), *ends, F.min("_from").alias("_from"), F.max("_to").alias("_to"))
    asked = cut(pairs.where("_lo < _hi AND _from < _to").select("entity", "word", "near"), "asked")
    wanted = asked.select("word").distinct()
    words = docs.select(F.explode(F.array_distinct(_words(whole_text()))).alias("word"))
    few = wanted.limit(BROADCAST_ROWS + 1).count() <= BROADCAST_ROWS
    # words are counted on the task that reads them, and only the wanted ones if those can be told there
    words = words.join(F.broadcast(wanted), "word", "left_semi") if few else words
    totals = words.groupBy("word").agg(F.count(F.lit(1)).alias("total"))
    size = rows.count()
    given = F.least(F.lit(1.0), F.col("near") / F.col("total"))
    content = F.greatest(F.lit(1e-9), -F.ln(F.least(F.lit(1.0), F.col("around") / F.lit(max(1.0, float(size))))))
    told = asked.join(totals, "word").join(sizes, "entity").select(
        "entity", "word", (F.lit(1.0) + F.ln(given) / content).alias("disclosure")
    )
    told = told.where(F.col("disclosure") >= GENERALISE).select(
        "entity", "word", F.when(F.col("disclosure") >= REMOVE, "remove").otherwise("generalise").alias("v")
    )
    told = cut(told.groupBy("word").agg(F.max("v").alias("v")), "told")
    texts = docs.select(whole_text().alias("_text")).withColumn("_key", F.sha2("_text", 256))
    at = texts.select("_key", F.posexplode(_words(F.col("_text"))).alias("i", "word")).join(_bounded(told), "word")
    at = at.select("_key", "i", "v").distinct().groupBy("_key").agg(F.collect_list(F.struct("i", "v")).alias("_at"))
    held = texts.join(_bounded(cut(at, "at"), "_at"), "_key").select(
        "_key", "_at", F.transform(F.split("_text", _WORD, -1), F.length).alias("_gaps"),
        F.transform(F.regexp_extract_all("_text", F.lit(_WORD), F.lit(0)), F.length).alias("_lengths"),
    )
    terms = held.select("_key", _placed(F.col("_at"), F.col("_gaps"), F.col("_lengths")).alias("_found")).distinct()
    rows = rows.join(_bounded(cut(terms, "terms"), "_found"), "_key", "left")
    taken = F.concat(*spans)
    clear = F.filter(F.coalesce("_found", F.array().cast(_SPAN)), lambda t: ~F.exists(taken, lambda b: (b["s"] < t["e"]) & (t["s"] < b["e"])))
    return rows.select("_doc.*", *spans, clear.alias("_term"))


def _listed(kinds: list[str]) -> Column:
    spelled = lambda k: lambda x: F.concat_ws(":", F.lit(k), x["s"], x["e"])
    parts = [F.transform(f"_{k}", spelled(k)) for k in kinds]
    return F.array_join(F.concat(*parts), ",")


def digest(found: DataFrame) -> DataFrame:
    counts = [F.size(f"_{k}").cast("long").alias(f"n_{k}") for k in KINDS]
    both = [sum((F.size(f"_{k}") for k in KINDS), F.lit(0)).cast("long").alias("n_base"), F.size("_term").cast("long").alias("n_terms")]
    return found.select("doc_id", *counts, F.sha2(_listed(KINDS), 256).alias("base_sha256"), _listed([*KINDS, "term"]).alias("spans"), *both)


def redacted(text: Column, spans: Column) -> Column:
    """The text with each span (s, e, v) replaced by v; of overlapping spans the first, then longest, stands."""

    def step(acc: Column, x: Column) -> Column:
        clear = x["s"] >= acc["at"]
        return F.struct(
            F.when(clear, x["e"]).otherwise(acc["at"]).alias("at"),
            F.when(clear, F.concat(acc["out"], F.substring(text, acc["at"] + 1, x["s"] - acc["at"]), x["v"])).otherwise(acc["out"]).alias("out"),
        )

    start = F.struct(F.lit(0).alias("at"), F.lit("").alias("out"))
    return F.aggregate(F.array_sort(spans), start, step, lambda a: F.concat(a["out"], F.substring(text, a["at"] + 1, F.length(text))))


def sanitise(docs: DataFrame) -> DataFrame:
    """``docs`` with ``text`` sanitised: entities by their kind, terms generalised to ``[TERM]`` or removed."""
    found = find(docs.select(F.struct(*[docs[c] for c in docs.columns]).alias("_doc"), "text"))
    named = lambda k: lambda x: F.struct(x["s"].alias("s"), x["e"].alias("e"), F.lit(f"[{k.upper()}]").alias("v"))
    kinds = [F.transform(f"_{k}", named(k)) for k in KINDS]
    terms = F.transform("_term", lambda x: F.struct(x["s"].alias("s"), x["e"].alias("e"), F.when(x["v"] == "remove", "").otherwise("[TERM]").alias("v")))
    clean = redacted(F.coalesce(F.col("_doc.text"), F.lit("")), F.concat(*kinds, terms).cast(_SPAN))
    rows = found.withColumn("_clean", F.when(F.col("_doc.text").isNotNull(), clean))
    return rows.select(*[(F.col("_clean") if c == "text" else F.col(f"_doc.{c}")).alias(c) for c in docs.columns])


def op7_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return digest(find(spread(table(spark, sf_dir, "documents").select("doc_id", "text"))))


QUERIES = {"op7_pii": op7_pii}
SQL: dict[str, str] = {}

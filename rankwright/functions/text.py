"""Scalar functions over text, paths and ids: built-in expressions only."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F


def tokens(t: Column) -> Column:
    """Runs of letters, digits and underscores, lower-cased, repeats kept."""
    return F.transform(F.regexp_extract_all(t, F.lit("[A-Za-z0-9_]+"), F.lit(0)), F.lower)


def token_set(t: Column, stop: list[str], least: int = 3) -> Column:
    found = F.regexp_extract_all(F.lower(t), F.lit(r"[a-z0-9][a-z0-9_.\-]*"), F.lit(0))
    return F.array_except(F.filter(found, lambda x: F.length(x) >= least), F.array(*map(F.lit, stop)))


def phrase_present(phrase: Column, text: Column) -> Column:
    """A phrase with blanks or signs by substring, a single word by token."""
    return F.when(phrase.rlike("[^A-Za-z0-9_]"), F.contains(F.lower(text), F.lower(phrase))).otherwise(
        F.array_contains(tokens(text), F.lower(phrase))
    )


def normalize_path(p: Column) -> Column:
    return F.regexp_replace(F.trim(F.replace(p, F.lit("\\"), F.lit("/"))), r"^(\./)+", "")


def strip_dots(p: Column) -> Column:
    """Any leading dots and slashes go."""
    return F.ltrim(p, F.lit("./"))


def strip_root(p: Column, root: str) -> Column:
    p = F.regexp_replace(normalize_path(p), "^file://", "")
    return F.when(F.startswith(p, F.lit(f"{root}/")), F.substr(p, F.lit(len(root) + 2))).otherwise(p)


def safe_int(x: Column) -> Column:
    return F.trim(x).try_cast("int")


def symbol_leaf(name: Column) -> Column:
    """What follows the last ::, # or . before any bracket."""
    return F.regexp_extract(F.substring_index(name, "(", 1), r"([^:#.]*)$", 1)


def slug(t: Column, limit: int = 64) -> Column:
    return F.substring(F.regexp_replace(F.regexp_replace(F.lower(t), "[^a-z0-9]+", "_"), "^_+|_+$", ""), 1, limit)


def compact(t: Column, limit: int) -> Column:
    one = F.trim(F.regexp_replace(t, r"[ \t\n\r\f\x0b]+", " "))
    return F.when(F.length(one) > limit, F.concat(F.rtrim(F.substring(one, 1, limit - 3)), F.lit("..."))).otherwise(one)


def first_clause(t: Column, limit: int) -> Column:
    return F.substring(F.get(F.split(F.trim(t), r"(?<=[.;:])\s+", 2), F.lit(0)), 1, limit)


def redact(t: Column, patterns: list[str], by: str = "") -> Column:
    return reduce(lambda c, p: F.regexp_replace(c, p, by), patterns, t)


def file_lines(t: Column) -> Column:
    """Ordered distinct file:line pairs as text."""
    return F.array_distinct(F.regexp_extract_all(t, F.lit(r"([A-Za-z0-9_./\-]+\.[a-z]{1,4}):(\d+)"), F.lit(0)))


def last_match(t: Column, pattern: str, group: int = 1) -> Column:
    return F.try_element_at(F.regexp_extract_all(t, F.lit(pattern), F.lit(group)), F.lit(-1))


def fenced_json(t: Column) -> Column:
    """The first fenced object, else the text itself where it is one, else null."""
    fence = F.regexp_extract(t, r"(?s)```(?:json)?\s*(\{.*?\})\s*```", 1)
    whole = F.trim(t)
    return F.when(fence != "", fence).when(F.startswith(whole, F.lit("{")) & F.endswith(whole, F.lit("}")), whole)


def cwe(t: Column) -> Column:
    n = F.regexp_extract(F.upper(t), r"CWE[-_ ]?0*(\d+)", 1)
    return F.when(n != "", F.concat(F.lit("CWE-"), n))


def clamp(x: Column) -> Column:
    return F.greatest(F.lit(0.0), F.least(F.lit(1.0), x.try_cast("double")))


def one_of(x: Column, allowed: list[str]) -> Column:
    v = F.lower(F.trim(x))
    return F.when(v.isin(allowed), v).otherwise(F.lit("invalid"))


def hash_id(parts: list[Column], length: int = 24, sep: str = "\0") -> Column:
    return F.substring(F.sha2(F.concat_ws(sep, *[p.cast("string") for p in parts]), 256), 1, length)


def sha1_id(parts: list[Column], length: int = 12) -> Column:
    return F.substring(F.sha1(F.concat_ws("::", *[p.cast("string") for p in parts])), 1, length)


def canonical_hash(**fields: Column) -> Column:
    """SHA-256 of a record as compact JSON with its keys in order; null fields are left out."""
    return F.sha2(F.to_json(F.struct(*[fields[k].alias(k) for k in sorted(fields)])), 256)


def log_loss(score: Column, positive: Column) -> Column:
    """-log of the sigmoid of the score, or of its complement: stable on both sides."""
    z = F.when(positive, score).otherwise(-score)
    return F.log1p(F.exp(-F.abs(z))) + F.greatest(-z, F.lit(0.0))


def vulnerability_ids(*texts: Column) -> Column:
    """Distinct CVE and GHSA ids of several texts, upper-cased and sorted; null texts hold none."""
    pattern = F.lit(r"(?i)\b(CVE-\d{4}-\d{4,}|GHSA(?:-[0-9a-z]{4}){3})\b")
    found = F.flatten(F.array(*[F.coalesce(F.regexp_extract_all(t, pattern, F.lit(1)), F.array().cast("array<string>")) for t in texts]))
    return F.array_sort(F.array_distinct(F.transform(found, F.upper)))


def cwe_numbers(*texts: Column) -> Column:
    """Distinct CWE ids of several texts by number."""
    found = F.flatten(F.array(*[F.coalesce(F.regexp_extract_all(F.upper(t), F.lit(r"CWE[-_ ]?0*(\d+)"), F.lit(1)), F.array().cast("array<string>")) for t in texts]))
    return F.transform(F.array_sort(F.array_distinct(F.transform(found, lambda n: n.cast("long")))), lambda n: F.concat(F.lit("CWE-"), n.cast("string")))


def evidence_preview(t: Column, words: list[str], most: int = 3, limit: int = 600) -> Column:
    """The first sentences with one of the words; sentences end in Latin or CJK marks before a blank."""
    parts = F.split(t, r"(?<=[.!?。！？])\s+")
    kept = F.filter(parts, lambda s: F.lower(s).rlike("|".join(words)))
    return F.substring(F.array_join(F.slice(kept, 1, most), " "), 1, limit)


def sigmoid(x: Column) -> Column:
    return F.when(x >= 0, 1 / (1 + F.exp(-x))).otherwise(F.exp(x) / (1 + F.exp(x)))


def project_family(key: Column) -> Column:
    return F.regexp_replace(F.lower(key), "__[0-9a-f]{8,64}$", "")


def candidate_text(symbol: Column, file: Column, start: Column, end: Column, body: Column, limit: int = 4000) -> Column:
    head = F.concat(F.lit("file: "), file, F.lit("\nlines: "), start.cast("string"), F.lit("-"), end.cast("string"))
    return F.substring(F.concat_ws("\n", head, F.concat(F.lit("symbol: "), symbol), body), 1, limit)


def numbered_snippet(text: Column, start: Column, end: Column, limit: int = 0) -> Column:
    """Lines with their numbers; with a limit, no more code points than that."""
    part = F.slice(lines(text), start, F.greatest(end - start + 1, F.lit(0)))
    out = F.array_join(F.transform(part, lambda x, i: F.concat_ws(": ", (i + start).cast("string"), x)), "\n")
    return F.substring(out, 1, limit) if limit > 0 else out


def stays_below(path: Column) -> Column:
    """Whether a relative path stays below its root however its dots are followed."""
    parts = F.filter(F.split(F.replace(path, F.lit("\\"), F.lit("/")), "/"), lambda x: ~x.isin("", "."))
    depth = F.aggregate(parts, F.struct(F.lit(0).alias("now"), F.lit(0).alias("least")), lambda a, x: F.struct(
        (a["now"] + F.when(x == "..", -1).otherwise(1)).alias("now"), F.least(a["least"], a["now"] + F.when(x == "..", -1).otherwise(1)).alias("least")))
    return ~path.rlike(r"^([/\\\\]|[A-Za-z]:)") & (depth["least"] >= 0)


def lines(t: Column) -> Column:
    """Lines as Python splits them: all Unicode line ends, no empty line after the last end."""
    parts = F.split(t, r"\R|[\x1c-\x1e]")
    return F.when(t == "", F.array().cast("array<string>")).when(
        F.element_at(parts, -1) == "", F.slice(parts, F.lit(1), F.size(parts) - 1)
    ).otherwise(parts)


def is_filled(x: Column) -> Column:
    return x.isNotNull() & ~F.lower(F.trim(x)).isin("", "n/a", "na", "todo", "tbd", "none")


def leaks(t: Column) -> Column:
    """Vulnerability ids, file:line shapes or field names in a text."""
    return t.rlike(r"(?i)\b(cve-\d{4}-\d+|ghsa(-[0-9a-z]{4}){3})\b|(?<![A-Za-z0-9])[A-Za-z0-9_/]+\.(java|py|c|js|go):\d+")


def first_match(t: Column, rules: list[tuple[str, str]], default: str) -> Column:
    """Ordered-pattern classifier: the first that matches names the class."""
    out = None
    for name, pattern in rules:
        out = F.when(t.rlike(pattern), name) if out is None else out.when(t.rlike(pattern), name)
    return out.otherwise(default)


def codes(*pairs: tuple[Column, str]) -> Column:
    """Array of the codes whose condition holds, in order."""
    return F.array_compact(F.array(*[F.when(c, F.lit(s)) for c, s in pairs]))

"""Line windows and span overlap."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from rankwright.functions.text import lines
from rankwright.session import spread


def overlaps(s1: Column, e1: Column, s2: Column, e2: Column, dialect: str) -> Column:
    """Whether two line spans meet.

    ``zero``: a missing bound counts as 0. ``strict``: any missing bound means
    no. ``wildcard``: a start of 0 or less matches everything, an end of 0 or
    less is the start. ``repair``: reversed bounds are swapped, bounds of 0 or
    less are missing and mean no.
    """
    if dialect == "zero":
        s1, e1, s2, e2 = (F.coalesce(c, F.lit(0)) for c in (s1, e1, s2, e2))
        return F.greatest(s1, s2) <= F.least(e1, e2)
    if dialect == "strict":
        known = s1.isNotNull() & e1.isNotNull() & s2.isNotNull() & e2.isNotNull()
        return F.coalesce(known & (F.greatest(s1, s2) <= F.least(e1, e2)), F.lit(False))
    if dialect == "wildcard":
        s1, s2 = F.coalesce(s1, F.lit(0)), F.coalesce(s2, F.lit(0))
        e1, e2 = (F.when(F.coalesce(e, F.lit(0)) <= 0, s).otherwise(e) for s, e in ((s1, e1), (s2, e2)))
        return (s1 <= 0) | (s2 <= 0) | (F.greatest(s1, s2) <= F.least(e1, e2))
    if dialect == "repair":
        pos = lambda c: F.when(c > 0, c)
        s1, e1, s2, e2 = map(pos, (s1, e1, s2, e2))
        lo1, hi1, lo2, hi2 = F.least(s1, e1), F.greatest(s1, e1), F.least(s2, e2), F.greatest(s2, e2)
        known = s1.isNotNull() & e1.isNotNull() & s2.isNotNull() & e2.isNotNull()
        return F.coalesce(known & (F.greatest(lo1, lo2) <= F.least(hi1, hi2)), F.lit(False))
    raise ValueError(dialect)


def distance(s1: Column, e1: Column, s2: Column, e2: Column) -> Column:
    """0 where spans meet, else the gap in lines."""
    return F.when(F.greatest(s1, s2) <= F.least(e1, e2), 0).when(e1 < s2, s2 - e1).otherwise(s1 - e2)


def windows(df: DataFrame, key: list[str], text: str, width: int = 80, stride: int = 40) -> DataFrame:
    """Overlapping line windows (1-based, inclusive); the one that reaches the end is the last."""
    rows = spread(df.select(*key, text)).select(*key, lines(F.col(text)).alias("_l")).where(F.size("_l") > 0)
    n = F.size("_l")
    starts = F.filter(F.sequence(F.lit(0), n - 1, F.lit(stride)), lambda s: (s == 0) | (s + width - stride < n))
    rows = rows.select(*key, "_l", F.explode(starts).alias("_s"))
    return rows.select(
        *key, (F.col("_s") + 1).alias("start_line"), F.least(F.col("_s") + width, n).alias("end_line"),
        F.array_join(F.slice("_l", F.col("_s") + 1, F.lit(width)), "\n").alias("body"),
    )


def filled_windows(df: DataFrame, key: list[str], text: str, width: int = 80, stride: int = 40) -> DataFrame:
    """The same, bodies trimmed and blank ones dropped."""
    out = windows(df, key, text, width, stride).withColumn("body", F.btrim("body", F.lit(" \t\n\r\f\x0b")))
    return out.where("body <> ''")


def nearest_symbol(rows: DataFrame, by: list[str], line: str, symbol: str, back: int = 40) -> DataFrame:
    """The last declaration at or up to ``back`` lines before each line."""
    w = Window.partitionBy(*by).orderBy(line).rowsBetween(-back, 0)
    return rows.withColumn("nearest", F.last(symbol, ignorenulls=True).over(w))


#: Lines of a bin; a span lies in one bin for every so many of its lines.
BIN = 64


def _bounds(s: Column, e: Column, dialect: str) -> tuple[Column, Column, Column]:
    """Lower and upper bound of a span as the dialect reads it, null where it meets nothing; and whether it meets everything."""
    no = F.lit(False)
    if dialect == "zero":
        return F.coalesce(s, F.lit(0)), F.coalesce(e, F.lit(0)), no
    if dialect == "strict":
        known = s.isNotNull() & e.isNotNull()
        return F.when(known, s), F.when(known, e), no
    if dialect == "wildcard":
        s = F.coalesce(s, F.lit(0))
        return s, F.when(F.coalesce(e, F.lit(0)) <= 0, s).otherwise(e), s <= 0
    if dialect == "repair":
        known = (s > 0) & (e > 0)
        return F.when(known, F.least(s, e)), F.when(known, F.greatest(s, e)), no
    raise ValueError(dialect)


#: Lines of a range: a file is swept range by range, each in a task of its own.
RANGE = 4096


def _swept(cand: DataFrame, truth: DataFrame, file: list[str], dialect: str, following: bool = False) -> DataFrame:
    """Each distinct candidate span with the farthest end of truth that begins in time (_reach), flags, and with ``following`` the next beginning (_next).

    Spans of a file are distinct first, so a file has as many rows as it has
    different spans however often they repeat. A file is cut into ranges of
    lines; what a range needs to know of those before and behind it is one
    bound from each, carried along the ranges of the file. Within a range one
    sorted pass (and one in reverse for ``following``) answers for all: no
    pairs, and no file is one task.
    """
    c, t = cand.select(*file, "s", "e").distinct(), truth.select(*file, "ts", "te").distinct()
    for f in file:
        c, t = c.where(F.col(f).isNotNull()), t.where(F.col(f).isNotNull())
    lo, hi, every = _bounds(F.col("s"), F.col("e"), dialect)
    c = c.select(*file, "s", "e", lo.alias("_lo"), hi.alias("_hi"), every.alias("_all"), F.lit(1).alias("_kind"), hi.alias("_at"))
    lo, hi, every = _bounds(F.col("ts"), F.col("te"), dialect)
    t = t.select(*file, lo.alias("_lo"), hi.alias("_hi"), every.alias("_all"), F.lit(0).alias("_kind"), lo.alias("_at"))
    t = t.where("_all OR _lo <= _hi")
    line = c.unionByName(t, allowMissingColumns=True)
    line = line.withColumn("_range", F.coalesce(F.floor(F.col("_at") / RANGE), F.lit(-(1 << 62))))  # a span that meets nothing has no place
    is_truth = (F.col("_kind") == 0) & (F.col("_lo") <= F.col("_hi"))
    end, begin = F.when(is_truth, F.col("_hi")), F.when(is_truth, F.col("_lo"))
    ranges = line.groupBy(*file, "_range").agg(F.max(end).alias("_end"), F.min(begin).alias("_begin"), F.max(F.when(F.col("_kind") == 0, F.col("_all"))).alias("_any"))
    of_file = Window.partitionBy(*file)  # one row for each range of a file
    before = of_file.orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    behind = of_file.orderBy(F.col("_range").desc()).rowsBetween(Window.unboundedPreceding, -1)
    ranges = ranges.select(*file, "_range", F.max("_end").over(before).alias("_carried"), F.min("_begin").over(behind).alias("_ahead"), F.max("_any").over(of_file).alias("_any"))
    line = line.join(ranges, [*file, "_range"])
    along = Window.partitionBy(*file, "_range")
    line = line.withColumn("_reach", F.greatest("_carried", F.max(end).over(along.orderBy("_at", "_kind").rowsBetween(Window.unboundedPreceding, 0))))
    if following:
        back = along.orderBy(F.col("_at").desc(), F.col("_kind").desc()).rowsBetween(Window.unboundedPreceding, -1)
        line = line.withColumn("_next", F.least("_ahead", F.min(begin).over(back)))
    line = line.withColumn("_met", F.coalesce((F.col("_lo") <= F.col("_hi")) & (F.col("_reach") >= F.col("_lo")), F.lit(False)))
    return line.where("_kind = 1 AND _any IS NOT NULL")


def _same(file: list[str], left: DataFrame) -> Column:
    """The condition that joins candidates to spans renamed by ``_named``."""
    on = F.lit(True)
    for c in [*file, "s", "e"]:
        on = on & left[c].eqNullSafe(F.col(f"_of_{c}"))
    return on


def _named(file: list[str]) -> list[Column]:
    return [F.col(c).alias(f"_of_{c}") for c in [*file, "s", "e"]]


def overlap_join(cand: DataFrame, truth: DataFrame, file: list[str], dialect: str = "zero", how: str = "left_semi") -> DataFrame:
    """Candidates (s, e) that meet (``left_semi``) or don't meet (``left_anti``) a truth span (ts, te) of the same file."""
    hits = _swept(cand, truth, file, dialect).where("_met OR _all OR _any").select(*_named(file))
    return cand.join(hits, _same(file, cand), how)


def closest_truth(cand: DataFrame, truth: DataFrame, file: list[str]) -> DataFrame:
    """Candidates of files with truth, with ``exact`` (a span overlaps) and ``closest`` (lines to the nearest one, 0 if it overlaps)."""
    near = _swept(cand, truth, file, "strict", following=True)
    gap = F.when(F.col("_met"), 0).otherwise(F.least(F.col("_lo") - F.col("_reach"), F.col("_next") - F.col("_hi")))
    near = near.select(*_named(file), F.col("_met").alias("exact"), gap.alias("closest"))
    return cand.join(near, _same(file, cand)).drop(*[f"_of_{c}" for c in [*file, "s", "e"]])


def span_pairs(cand: DataFrame, truth: DataFrame, file: str) -> DataFrame:
    """Pairs of overlapping spans (s, e) and (ts, te) of a file: an equi-join on bins of lines, each pair taken in its first common bin."""
    bins = lambda lo, hi: F.explode(F.sequence(F.floor(F.col(lo) / BIN), F.floor(F.col(hi) / BIN)))
    c = cand.where("s <= e").withColumn("_bin", bins("s", "e"))
    t = truth.where("ts <= te").withColumn("_bin", bins("ts", "te"))
    first = F.col("_bin") == F.greatest(F.floor(F.col("s") / BIN), F.floor(F.col("ts") / BIN))
    return c.join(t, [file, "_bin"]).where(first & (F.greatest("s", "ts") <= F.least("e", "te"))).drop("_bin")


def best_overlap(cand: DataFrame, funcs: DataFrame, file: str, key: str) -> DataFrame:
    """Of the functions a span meets: largest overlap, nearest midpoint, smallest span, then first. Decided once for each distinct span."""
    funcs = funcs.groupBy(file, "ts", "te").agg(F.min("fid").alias("fid"))
    j = span_pairs(cand.select(file, "s", "e").distinct(), funcs, file)
    common = F.least("e", "te") - F.greatest("s", "ts") + 1
    mid = F.abs(F.col("s") + F.col("e") - F.col("ts") - F.col("te"))
    best = j.groupBy(file, "s", "e").agg(F.min(F.struct((-common).alias("c"), mid.alias("m"), (F.col("te") - F.col("ts")).alias("n"), "fid", "ts", "te")).alias("_b"))
    return cand.join(best, [file, "s", "e"]).select(*[cand[c] for c in cand.columns], "_b.fid", "_b.ts", "_b.te")


def start_or_overlap(cand: DataFrame, truth: DataFrame, file: str, value: str) -> DataFrame:
    """Candidates with the least ``value`` of the truth spans that begin where they begin or overlap them: two equi-joins for the two ways."""
    spans = cand.select(file, "s", "e").distinct()
    truth = truth.groupBy(file, "ts", "te").agg(F.min(value).alias(value))
    start = spans.join(truth.select(file, F.col("ts").alias("s"), value), [file, "s"]).select(file, "s", "e", value)
    both = start.unionByName(span_pairs(spans, truth, file).select(file, "s", "e", value))
    return cand.join(both.groupBy(file, "s", "e").agg(F.min(value).alias(value)), [file, "s", "e"])


def symbol_or_overlap(cand: DataFrame, truth: DataFrame, file: str, symbol: str, value: str) -> DataFrame:
    """Candidates with the least ``value`` of the truth of their file that bears the same symbol, blank ones apart, or overlaps them.

    ``truth`` has its symbol under the same name. Decided once for each distinct
    span and symbol, by an equi-join for each of the two ways; symbols are
    reduced to one row before they meet.
    """
    named = F.coalesce(F.btrim(symbol), F.lit("")) != ""
    spans = cand.select(file, "s", "e", symbol).distinct()
    same = truth.where(named).groupBy(file, symbol).agg(F.min(value).alias(value))
    by_name = spans.where(named).join(same, [file, symbol]).select(file, "s", "e", symbol, value)
    least = truth.groupBy(file, "ts", "te").agg(F.min(value).alias(value))
    pairs = span_pairs(spans.select(file, "s", "e").distinct(), least, file).groupBy(file, "s", "e").agg(F.min(value).alias(value))
    by_span = spans.join(pairs, [file, "s", "e"]).select(file, "s", "e", symbol, value)
    best = by_name.unionByName(by_span).groupBy(*[F.col(c).alias(f"_of_{c}") for c in (file, "s", "e", symbol)]).agg(F.min(value).alias(value))
    on = F.lit(True)
    for c in (file, "s", "e", symbol):
        on = on & cand[c].eqNullSafe(F.col(f"_of_{c}"))
    return cand.join(best, on).select(*[cand[c] for c in cand.columns], value)


def suffixes(path: Column) -> Column:
    """All whole-component suffixes of a path."""
    parts = F.split(path, "/")
    return F.transform(F.sequence(F.lit(1), F.size(parts)), lambda i: F.array_join(F.slice(parts, i, F.size(parts)), "/"))


def suffix_join(left: DataFrame, right: DataFrame, lp: str, rp: str) -> DataFrame:
    """Pairs where either path is a whole-component suffix of the other: two equi-joins, no nested loop."""
    a = left.withColumn("_k", F.explode(suffixes(F.col(lp)))).join(right, F.col("_k") == F.col(rp)).drop("_k")
    b = right.withColumn("_k", F.explode(suffixes(F.col(rp)))).join(left, F.col("_k") == F.col(lp)).drop("_k")
    return a.unionByName(b.select(*a.columns)).distinct()

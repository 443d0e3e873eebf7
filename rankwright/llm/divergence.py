"""How far the sources of a language lie apart: term audit with upper bounds, pair sums from postings.

Counts: every text is cut into its words and counted in the task that reads it
(in Arrow batches), and one shuffle with map-side sums gives the occurrences and
the documents of each (lang, source, term). Terms in
too few documents of their language go; what is left, with the source's
probability p and the language's q, is the *postings* table.

Terms of a group that stand out: its terms are put into buckets of like
counts, and each bucket's largest p and smallest q bound what any of its terms
can reach, since f(p, q) grows with p and falls with q while p > q. Buckets are
opened best bound first, a few a round, for all groups at once; a group is done
when the best unopened bound is strictly below its k-th value, so that equal
values still compete by name. Only opened buckets are evaluated.

Pairs of sources: a term that source i lacks has i's base probability b_i, so

    sum f(p_i, p_j) = sum over i's terms f(p_i, b_j) + sum over j's terms f(b_i, p_j)
                      + (V - |i| - |j|) f(b_i, b_j)
                      + sum over terms of both [f(p_i, p_j) - f(p_i, b_j) - f(b_i, p_j) + f(b_i, b_j)]

with every f rounded down first, so the identity is exact. The first two sums
need one row for each distinct p of a source. The last one is the postings': the
list of a term's sources is worked off in the task that holds it into a matrix
of TILE * TILE sources, and only the matrix leaves the task. A term in more
than TILE sources is split into tiles, so no list has over 2 * TILE entries.

All arithmetic is on integers: counts times 10^9 as decimals, the rest in 64 bits.

Cases: null text, lang and source are ''; a group of empty texts is a group
whose counts are all zero; a language without kept terms has pairs of value 0
and no terms; a language of one source has no pairs; repeated rows and repeated
ids are documents of their own; an empty table gives no row; other columns are
not read.
"""

from __future__ import annotations

import re
from collections import Counter, defaultdict
from collections.abc import Iterator
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from rankwright.llm.common import attach_groups, cut, scratch, ship, small_batches, spread, table, whole_text

#: ASCII letters and everything beyond ASCII.
WORD = r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+"
LEAST_DOCUMENTS, TOP, UNIT = 10, 10, 1_000_000_000
#: Buckets of counts for each doubling.
FINE = 8
#: Buckets of a group opened in the first round; each later round opens GROWTH times as many.
FIRST, GROWTH = 4, 4
#: Terms of groups that a task counts before it hands them on.
ENTRIES = 200_000
#: Sources of a tile.
TILE = 512
#: Parts into which the probabilities of a language are dealt.
SALTS = 32
GROUP = ["lang", "source"]


def f_of(p: Column, q: Column) -> Column:
    """floor((p - q)^2 / (p + q)); 0 where both are 0."""
    return F.when(p + q > 0, F.call_function("div", (p - q) * (p - q), p + q)).otherwise(F.lit(0).cast("long"))


def probability(n: Column, total: Column, terms: Column) -> Column:
    """1 + floor(10^9 (n + 2) / (total + 2 terms)), exact for any counts; null without terms."""
    up = (n + 2).cast("decimal(20,0)") * F.lit(UNIT).cast("decimal(10,0)")
    return F.when(terms > 0, 1 + F.call_function("div", up, (total + 2 * terms).cast("decimal(20,0)")))


def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """From lang, source and text as UTF-8 to the occurrences n and documents d of each term in its group, summed up until ENTRIES are held.

    In UTF-8 the bytes below 128 are ASCII alone, and ``bytes.lower`` folds A-Z alone.
    """
    find, counts, held = re.compile(WORD.encode()).findall, defaultdict(lambda: (Counter(), Counter())), 0

    def flush() -> Iterator[pa.RecordBatch]:
        for (lang, source), (n, d) in counts.items():
            columns = [pa.array([lang] * len(n), pa.binary()), pa.array([source] * len(n), pa.binary()), pa.array(list(n), pa.binary()), pa.array(list(n.values()), pa.int64()), pa.array([d[t] for t in n], pa.int64())]
            yield pa.RecordBatch.from_arrays(columns, [*GROUP, "term", "n", "d"])
        counts.clear()

    for batch in batches:
        for lang, source, text in zip(*(batch.column(c).to_pylist() for c in (*GROUP, "text"))):
            words = find(text.lower())
            if not words:
                continue
            n, d = counts[lang, source]
            held -= len(n)
            n.update(words)
            d.update(set(words))
            held += len(n)
            if held >= ENTRIES:
                yield from flush()
                held = 0
    yield from flush()


def term_counts(docs: DataFrame, least: int = LEAST_DOCUMENTS) -> DataFrame:
    """lang, source, term, n of the kept terms, with n_lang (of the language) and first (one row for each term of a language)."""
    small_batches(docs.sparkSession)
    texts = spread(docs.select(*_names(), whole_text().alias("text"))).select(*[F.col(c).cast("binary") for c in (*GROUP, "text")])
    rows = texts.mapInArrow(counted, "lang binary, source binary, term binary, n long, d long").select(*[F.col(c).cast("string") for c in (*GROUP, "term")], "n", "d")
    counts = rows.groupBy(*GROUP, "term").agg(F.sum("n").alias("n"), F.sum("d").alias("d"))
    w = Window.partitionBy("lang", "term")  # a row for each source
    counts = counts.withColumn("_d", F.sum("d").over(w)).withColumn("n_lang", F.sum("n").over(w)).withColumn("first", F.min("source").over(w) == F.col("source"))
    return counts.where(F.col("_d") >= least).select(*GROUP, "term", "n", "n_lang", "first")


def _names() -> list[Column]:
    return [F.coalesce(F.col(c), F.lit("")).alias(c) for c in GROUP]


def group_table(docs: DataFrame, counts: DataFrame) -> DataFrame:
    """One row for each group: number i within its language, sums, sources of the language, base probability."""
    found = docs.select(*_names()).groupBy(*GROUP).agg(F.count(F.lit(1)).alias("documents"))
    own = counts.groupBy(*GROUP).agg(F.sum("n").alias("total"), F.count(F.lit(1)).alias("terms"))
    of_lang = counts.groupBy("lang").agg(F.sum("n").alias("total_lang"), F.count_if("first").alias("v"))
    zero = lambda c: F.coalesce(F.col(c), F.lit(0)).alias(c)
    g = found.join(own, GROUP, "left").join(of_lang, "lang", "left").select(*GROUP, "documents", *map(zero, ["total", "terms", "total_lang", "v"]))
    g = g.withColumn("i", F.row_number().over(Window.partitionBy("lang").orderBy("source")) - 1)
    g = g.withColumn("sources", F.count(F.lit(1)).over(Window.partitionBy("lang")).cast("int"))
    return g.withColumn("b", F.coalesce(probability(F.lit(0), F.col("total"), F.col("v")), F.lit(0)))


def postings_of(counts: DataFrame, groups: DataFrame) -> DataFrame:
    """The kept terms of each group with p, q and the group's number, base and bucket of counts."""
    met = attach_groups(counts, groups, GROUP, "terms", counts.count())
    p, q = probability(F.col("n"), F.col("total"), F.col("v")), probability(F.col("n_lang"), F.col("total_lang"), F.col("v"))
    return met.select(*GROUP, "term", "i", "sources", "b", p.alias("p"), q.alias("q"), F.floor(F.log2("n") * FINE).cast("int").alias("bucket"))


def _best(rows: DataFrame, top: int) -> DataFrame:
    """The first ``top`` of each group: each task keeps its own first ones before they meet."""
    w = Window.partitionBy(*GROUP).orderBy(F.col("value").desc(), "term")
    return rows.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= top)


def top_terms(postings: DataFrame, top: int = TOP) -> DataFrame:
    """lang, source, term, value, rank of the terms with p > q that lie farthest from their language."""
    key = [*GROUP, "bucket"]
    b = postings.groupBy(*key).agg(F.max("p").alias("_p"), F.min("q").alias("_q"), F.count(F.lit(1)).alias("_size"))
    b = b.where("_p > _q").withColumn("_bound", f_of(F.col("_p"), F.col("_q")))
    w = Window.partitionBy(*GROUP).orderBy(F.col("_bound").desc(), "bucket")  # a row for each bucket of a group
    ranked = cut(b.select(*key, "_size", "_bound", F.row_number().over(w).alias("_at")), "buckets")
    total = postings.count()
    seen, step, best = 0, FIRST, None
    while True:
        chosen = ranked.where((F.col("_at") > seen) & (F.col("_at") <= seen + step))
        chosen = _still(chosen, best, top).select(*key, "_size")
        met = attach_groups(postings, chosen, key, "_size", total).where("p > q").select(*GROUP, "term", f_of(F.col("p"), F.col("q")).alias("value"))
        best = cut(_best(met if best is None else best.drop("rank").unionByName(met), top), "best")
        seen, step = seen + step, step * GROWTH
        if _still(ranked.where(F.col("_at") > seen), best, top).isEmpty():
            return best


def _still(buckets: DataFrame, best: DataFrame | None, top: int) -> DataFrame:
    """Buckets that may hold a term of the first ``top``: not strictly below the k-th value so far."""
    if best is None:
        return buckets
    kth = best.where(F.col("rank") == top).select(*GROUP, F.col("value").alias("_kth"))
    return buckets.join(kth, GROUP, "left").where("_kth IS NULL OR _bound >= _kth").drop("_kth")


def _one_sided(postings: DataFrame, groups: DataFrame, tile: int) -> DataFrame:
    """lang, i, j, value: what the terms of each one source give against the bases of all others, i < j."""
    hist = postings.groupBy("lang", "i", "p").agg(F.count(F.lit(1)).alias("h")).withColumn("v", F.lit(0).cast("long"))
    # the terms that neither has, by the base: -|i| from each side and V once
    base = groups.select("lang", "i", F.col("b").alias("p"), (-F.col("terms")).alias("h"), "v")
    hist = hist.unionByName(base).withColumn("_salt", F.pmod(F.xxhash64("i", "p"), F.lit(SALTS)))
    tiles = groups.groupBy("lang", F.floor(F.col("i") / tile).alias("_tile")).agg(F.collect_list(F.struct("i", "b")).alias("_others"))
    tiles = tiles.select("lang", "_others", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(SALTS - 1).cast("long"))).alias("_salt"))
    met = hist.join(tiles, ["lang", "_salt"]).select("lang", "i", "p", "h", "v", F.explode("_others").alias("_o")).where("_o.i <> i")
    value = (F.col("h") + F.when(F.col("i") < F.col("_o.i"), F.col("v")).otherwise(0)) * f_of(F.col("p"), F.col("_o.b"))
    return met.select("lang", F.least("i", "_o.i").alias("i"), F.greatest("i", "_o.i").alias("j"), value.alias("value"))


def _f(p: np.ndarray, q: np.ndarray) -> np.ndarray:
    return (p - q) ** 2 // (p + q)


def shared_sums(batches: Iterator[pa.RecordBatch], tile: int) -> Iterator[pa.RecordBatch]:
    """From lists of a term's sources, sorted by tile, to one matrix of corrections for each tile."""
    now, m = None, np.zeros((tile, tile), np.int64)

    def flush() -> Iterator[pa.RecordBatch]:
        i, j = np.nonzero(m)
        if now is not None and len(i):
            lang, lo, hi = now
            yield pa.RecordBatch.from_arrays([pa.array([lang] * len(i), pa.string()), pa.array((i + lo * tile).astype(np.int32)), pa.array((j + hi * tile).astype(np.int32)), pa.array(m[i, j])], ["lang", "i", "j", "value"])
        m[:] = 0

    for batch in batches:
        lists = batch.column("_list")
        flat = lists.flatten()
        n, p, b = (flat.field(c).to_numpy(zero_copy_only=False).astype(np.int64) for c in ("i", "p", "b"))
        sizes = np.diff(lists.offsets.to_numpy())
        ends = np.cumsum(sizes)
        keys = list(zip(*(batch.column(c).to_pylist() for c in ("lang", "_lo", "_hi"))))
        at = 0
        while at < len(keys):
            stop = at + 1
            while stop < len(keys) and keys[stop] == keys[at]:
                stop += 1
            if keys[at] != now:
                yield from flush()
                now = keys[at]
            _, lo, hi = now
            first = ends[at] - sizes[at]
            left = np.repeat(ends[at:stop], sizes[at:stop]) - np.arange(first, ends[stop - 1]) - 1  # entries of the list after each one
            e, d = np.arange(first, ends[stop - 1]), 0
            while True:
                d += 1
                e = e[left[e - first] >= d]
                if not len(e):
                    break
                x, y = e, e + d
                if lo != hi:
                    apart = (n[x] // tile) != (n[y] // tile)
                    x, y = x[apart], y[apart]
                value = _f(p[x], p[y]) - _f(p[x], b[y]) - _f(b[x], p[y]) + _f(b[x], b[y])
                np.add.at(m, (n[x] - lo * tile, n[y] - hi * tile), value)
            at = stop
    yield from flush()


def pair_values(postings: DataFrame, groups: DataFrame, tile: int = TILE) -> DataFrame:
    """lang, i, j, value for every two sources of a language, i < j by number."""
    ship(postings.sparkSession)
    own = F.floor(F.col("i") / tile).cast("int")
    spots = postings.select("lang", "term", "i", "p", "b", own.alias("_a"), F.explode(F.sequence(F.lit(0), F.floor((F.col("sources") - 1) / tile).cast("int"))).alias("_b"))
    spots = spots.select("lang", "term", F.least("_a", "_b").alias("_lo"), F.greatest("_a", "_b").alias("_hi"), F.struct("i", "p", "b").alias("_x"))
    lists = spots.groupBy("lang", "_lo", "_hi", "term").agg(F.array_sort(F.collect_list("_x")).alias("_list")).where("size(_list) > 1")
    lists = lists.select("lang", "_lo", "_hi", "_list").sortWithinPartitions("lang", "_lo", "_hi")
    both = lists.mapInArrow(partial(shared_sums, tile=tile), "lang string, i int, j int, value long")
    return both.unionByName(_one_sided(postings, groups, tile)).groupBy("lang", "i", "j").agg(F.sum("value").alias("value"))


def audit(docs: DataFrame, top: int = TOP, least: int = LEAST_DOCUMENTS, tile: int = TILE) -> DataFrame:
    """lang, source, part, item, value, rank: other sources by distance (``pair``) and terms that stand out (``term``)."""
    with scratch(docs.sparkSession) as kept:
        counts = cut(term_counts(docs, least), "counts")
        groups = cut(group_table(docs, counts), "groups")
        postings = cut(postings_of(counts, groups), "postings")
        terms = top_terms(postings, top).select(*GROUP, F.lit("term").alias("part"), F.col("term").alias("item"), "value", "rank")
        sums = pair_values(postings, groups, tile)
        both = sums.select("lang", F.explode(F.array(F.struct("i", "j"), F.struct(F.col("j").alias("i"), F.col("i").alias("j")))).alias("_x"), "value").select("lang", "_x.i", "_x.j", "value")
        names = groups.select("lang", "i", "source")
        ranked = both.withColumn("rank", F.row_number().over(Window.partitionBy("lang", "i").orderBy(F.col("value").desc(), "j")))  # numbers are in the order of names
        pairs = ranked.join(names, ["lang", "i"]).join(names.select("lang", F.col("i").alias("j"), F.col("source").alias("item")), ["lang", "j"])
        pairs = pairs.select(*GROUP, F.lit("pair").alias("part"), "item", "value", "rank")
        return kept(cut(pairs.unionByName(terms), "divergence"))


def op11_source_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return audit(table(spark, sf_dir, "documents"))


ORACLE = r"""
WITH d AS (SELECT row_number() OVER () AS r, coalesce(lang, '') AS lang, coalesce(source, '') AS source,
    translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS t FROM documents),
w AS (SELECT r, lang, source, unnest(regexp_extract_all(t, '[^\x00-\x40\x5B-\x60\x7B-\x7F]+')) AS term FROM d),
k AS (SELECT lang, term, count(*) AS n FROM w GROUP BY lang, term HAVING count(DISTINCT r) >= 10),
g AS (SELECT DISTINCT lang, source FROM d),
lv AS (SELECT lang, CAST(count(*) AS BIGINT) AS v, CAST(sum(n) AS BIGINT) AS nl FROM k GROUP BY lang),
seen AS (SELECT lang, source, term, count(*) AS n FROM w SEMI JOIN k USING (lang, term) GROUP BY lang, source, term),
c AS (SELECT g.lang, g.source, k.term, k.n AS nk, coalesce(s.n, 0) AS n FROM g JOIN k USING (lang) LEFT JOIN seen s ON s.lang = g.lang AND s.source = g.source AND s.term = k.term),
p AS (SELECT lang, source, term, n, 1 + (1000000000 * (n + 2)) // (CAST(sum(n) OVER (PARTITION BY lang, source) AS BIGINT) + 2 * v) AS p, 1 + (1000000000 * (nk + 2)) // (nl + 2 * v) AS q
  FROM c JOIN lv USING (lang)),
pairs AS (SELECT a.lang, a.source, b.source AS item, sum((a.p - b.p) * (a.p - b.p) // (a.p + b.p)) AS value FROM p a JOIN p b ON a.lang = b.lang AND a.term = b.term AND a.source <> b.source GROUP BY 1, 2, 3),
allp AS (SELECT a.lang, a.source, 'pair' AS part, b.source AS item, CAST(coalesce(value, 0) AS BIGINT) AS value
  FROM g a JOIN g b ON a.lang = b.lang AND a.source <> b.source LEFT JOIN pairs x ON x.lang = a.lang AND x.source = a.source AND x.item = b.source),
t AS (SELECT lang, source, 'term' AS part, term AS item, CAST((p - q) * (p - q) // (p + q) AS BIGINT) AS value FROM p WHERE n > 0 AND p > q),
u AS (SELECT * FROM allp UNION ALL SELECT * FROM t)
SELECT * FROM (SELECT *, CAST(row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item) AS INTEGER) AS rank FROM u) WHERE part = 'pair' OR rank <= 10
"""

QUERIES = {"op11_source_divergence": op11_source_divergence}
SQL = {"op11_source_divergence": ORACLE}

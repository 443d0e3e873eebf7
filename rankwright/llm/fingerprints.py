"""Document fingerprints by Order MinHash, DataFrame operations only.

The k-mers of a text are its runs of K words, numbered by occurrence, so that
the second "a b c d e" of a text differs from the first. Each of ENTRIES
permutations (a mask laid over the hash by exclusive or) splits the k-mers in
two by one bit of their hash and takes the minimum of either part.
The two k-mers are put in the order in which they stand in the text and hashed
as a tuple: two texts share an entry if they share both minima *and* their
order, so the share of equal entries falls with edit distance and not only
with the overlap of sets. Hashing happens in the row; the minima are ordinary
partial aggregates, so equal rows and hot texts meet as one row a map task.

Cases: null is empty; an empty text has the fingerprint ``-`` and is like
another empty text alone; a text of fewer than K words is one k-mer; rows that
repeat a doc_id are ordered by the hash of their text, null ids first, and
equal rows count as one document with as many result rows; one document is its
own next; k-mers beyond the 2**24th of a text all count as standing there; an
empty table gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from rankwright.llm.common import cut, spread, table, whole_text

K = 5
ENTRIES = 32
#: A k-mer travels as 40 bits of hash and 24 bits of position.
POSITION_BITS = 24
_SPACE = " \t\n\x0b\x0c\r"
_STEPS = [1 << k for k in range(POSITION_BITS - 1, -1, -1)]


def _permutations(n: int) -> list[int]:
    """n signed 64-bit masks that leave the position bits alone: a linear congruential sequence."""
    out, x = [], 0x9E3779B97F4A7C15
    for _ in range(n):
        x = (x * 6364136223846793005 + 1442695040888963407) % (1 << 64)
        out.append(((x >> POSITION_BITS << POSITION_BITS) + (1 << 63)) % (1 << 64) - (1 << 63))
    return out


def add_kmers(rows: DataFrame, text: Column) -> DataFrame:
    """Add ``_kmers``: occurrence-numbered k-mer hashes with positions, in any order; null for empty texts."""
    trimmed = F.btrim(text, F.lit(_SPACE))
    rows = rows.withColumn("_words", F.when(trimmed != "", F.split(trimmed, r"[\x20\x09-\x0D]+")))
    at = F.when(F.col("_words").isNotNull(), F.sequence(F.lit(0), F.greatest(F.size("_words") - K, F.lit(0))))
    rows = rows.withColumn("_h", F.transform(at, lambda i: F.xxhash64(*[F.get("_words", i + j) for j in range(K)])))
    mask = F.lit(-(1 << POSITION_BITS))
    rows = rows.withColumn("_p", F.transform("_h", lambda h, i: h.bitwiseAND(mask).bitwiseOR(F.least(i, F.lit((1 << POSITION_BITS) - 1)).cast("long")))).drop("_words")
    # only where k-mers repeat: sort by hash and position, number each run
    repeats = F.size(F.array_distinct("_h")) < F.size("_h")
    rows = rows.withColumn("_s", F.when(repeats, F.sort_array("_p"))).drop("_h")
    same = lambda x, i: F.shiftright(F.get("_s", i), POSITION_BITS) == F.shiftright(x, POSITION_BITS)

    def numbered(x: Column, i: Column) -> Column:
        count = F.aggregate(
            F.array(*map(F.lit, _STEPS)),
            F.lit(0),
            lambda n, p: F.when((i - n - p >= 0) & same(x, i - n - p), n + p).otherwise(n),
        )
        again = F.xxhash64(F.shiftright(x, POSITION_BITS), count).bitwiseAND(mask)
        return F.when(
            (i > 0) & same(x, i - 1), again.bitwiseOR(x.bitwiseAND(F.lit((1 << POSITION_BITS) - 1)))
        ).otherwise(x)

    return rows.withColumn("_kmers", F.when(F.col("_s").isNull(), F.col("_p")).otherwise(F.transform("_s", numbered))).drop("_p", "_s")


def sketch(rows: DataFrame, text: Column, keys: list[str], entries: int = ENTRIES) -> DataFrame:
    """keys, ``_entries`` (null for an empty text) and ``_copies``, the rows that share the keys."""
    rows = add_kmers(rows.select(*keys, text.alias("_text")), F.col("_text")).drop("_text")
    rows = rows.select(*keys, F.posexplode_outer("_kmers").alias("_i", "_kmer"))
    low = F.lit((1 << POSITION_BITS) - 1)
    minima = []
    for j, c in enumerate(_permutations(entries)):
        mixed = F.col("_kmer").bitwiseXOR(F.lit(c))
        part = F.col("_kmer").bitwiseAND(F.lit(1 << (POSITION_BITS + 2 + j % 38))) == 0
        minima += [F.min(F.when(part, mixed)).alias(f"_a{j}"), F.min(F.when(~part, mixed)).alias(f"_b{j}")]
    copies = F.sum(F.when(F.coalesce(F.col("_i"), F.lit(0)) == 0, 1)).alias("_copies")
    rows = rows.groupBy(*keys).agg(copies, F.count("_kmer").alias("_n"), *minima)

    def entry(j: int) -> Column:
        a, b = F.col(f"_a{j}"), F.col(f"_b{j}")
        first = a.bitwiseAND(low) < b.bitwiseAND(low)
        x, y = F.shiftright(a, POSITION_BITS), F.shiftright(b, POSITION_BITS)
        return F.when(first, F.hash(x, y, F.lit(1))).otherwise(F.hash(x, y, F.lit(2)))

    return rows.select(*keys, "_copies", F.when(F.col("_n") > 0, F.array(*[entry(j) for j in range(entries)])).alias("_entries"))


def spell(entries: Column) -> Column:
    """A fingerprint as hex digits, eight an entry."""
    digits = F.transform(entries, lambda x: F.lpad(F.lower(F.hex(x.cast("long").bitwiseAND(F.lit(0xFFFFFFFF)))), 8, "0"))
    return F.coalesce(F.array_join(digits, ""), F.lit("-"))


def likeness(a: Column, b: Column) -> Column:
    """The share of equal entries."""
    equal = F.aggregate(F.zip_with(a, b, lambda x, y: (x == y).cast("int")), F.lit(0), lambda n, x: n + x)
    both = a.isNull() & b.isNull()
    return F.when(both, F.lit(1.0)).otherwise(F.coalesce(equal / F.size(a), F.lit(0.0)))


def neighbours(docs: DataFrame) -> DataFrame:
    """Each row's next and previous in the order of (doc_id, _sha), first after last, without a global sort in one task.

    ``docs`` is range-partitioned and cut; inside a range lead and lag do, and
    the ranges' first and last rows, one each, link the ranges.
    """
    ranged = cut(
        docs.repartitionByRange(F.col("doc_id").asc_nulls_first(), "_sha").withColumn("_range", F.spark_partition_id()),
        "ranged",
    )
    own = F.struct("_k", "_chars", "_entries")
    order = Window.partitionBy("_range").orderBy(F.col("doc_id").asc_nulls_first(), "_sha")
    rows = ranged.withColumn("_own", own)
    rows = rows.withColumn("_next", F.lead("_own").over(order)).withColumn("_prev", F.lag("_own").over(order))
    key = F.struct(F.col("doc_id").isNotNull(), "doc_id", "_sha")
    ends = rows.groupBy("_range").agg(F.min_by("_own", key).alias("_first"), F.max_by("_own", key).alias("_last"))
    along, every = Window.orderBy("_range"), Window.orderBy("_range").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    ends = ends.select(  # one row a range
        F.col("_range"),
        F.coalesce(F.lead("_first").over(along), F.first("_first").over(every)).alias("_over"),
        F.coalesce(F.lag("_last").over(along), F.last("_last").over(every)).alias("_under"),
    )
    rows = rows.join(F.broadcast(ends), "_range")
    back = F.coalesce("_prev", "_under")
    return rows.select(
        "_k", "doc_id", "_chars", "_copies", "_entries", F.coalesce("_next", "_over")["_entries"].alias("_next"),
        back["_k"].alias("_pk"), back["_chars"].alias("_pn"),
    )


def row_key(doc_id: str, sha: str) -> Column:
    """One string for doc_id, null included, and text."""
    return F.concat_ws(":", doc_id, sha)


def fingerprints(docs: DataFrame) -> DataFrame:
    """_k, doc_id, _sha, _chars, _copies and _entries of every distinct (doc_id, text)."""
    text = whole_text()
    rows = docs.select("doc_id", F.sha2(text, 256).alias("_sha"), F.length(text).alias("_chars"), text.alias("text"))
    return sketch(rows, F.col("text"), ["doc_id", "_sha", "_chars"]).withColumn("_k", row_key("doc_id", "_sha"))


def op6_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spread(table(spark, sf_dir, "documents").select("doc_id", "text"))
    order = cut(neighbours(cut(fingerprints(docs), "fingerprints")), "order")
    texts = docs.select(row_key("doc_id", F.sha2(whole_text(), 256)).alias("_k"), whole_text().alias("_text"))
    half = lambda c: F.floor(c / 2).cast("int")
    links = order.select("_k", "_pk", "_pn")
    heads = texts.join(links, "_k").select(F.col("_pk").alias("_k"), F.substring(F.col("_text"), F.lit(1), half(F.col("_pn"))).alias("_head"))
    heads = heads.groupBy("_k").agg(F.first("_head").alias("_head"))  # rows that repeat give one head
    n = F.length("_text")
    edited = texts.join(heads, "_k").select("_k", F.concat(F.substring(F.col("_text"), F.lit(1), n - half(n)), F.col("_head")).alias("_edited"))
    # grouped by the key it was joined on: no further shuffle
    edited = sketch(edited.withColumn("edited_sha256", F.sha2("_edited", 256)), F.col("_edited"), ["_k", "edited_sha256"])
    edited = edited.select("_k", "edited_sha256", F.col("_entries").alias("_edited"))
    rows = order.join(edited, "_k").select(
        "doc_id",
        F.col("_chars").cast("long").alias("n_chars"),
        "edited_sha256",
        spell(F.col("_entries")).alias("fingerprint"),
        spell(F.col("_edited")).alias("edited_fingerprint"),
        likeness(F.col("_entries"), F.col("_edited")).alias("near_edited"),
        likeness(F.col("_entries"), F.col("_next")).alias("near_next"),
        F.explode(F.sequence(F.lit(1).cast("long"), F.col("_copies"))).alias("_"),
    )
    return rows.drop("_")


QUERIES = {"op6_fingerprints": op6_fingerprints}
SQL: dict[str, str] = {}

"""Near-dedup by order MinHash, candidates verified by banded alignment.

Texts are lower-cased and split at white space; equal texts are one node from
the start. A text's k-mers are its runs of K words, numbered by occurrence.
Each of ENTRIES permutations picks its LEAST_KMERS smallest k-mers, puts them
back in text order and hashes the tuple; texts that share an entry share a
bucket. Short texts, where a few edits spoil most runs of five, have further
entries over shorter runs (SHORT).

Alignment is edit distance d over words, found diagonal by diagonal inside a
band; with n the words of the longer text the likeness is ``(n - d) / (n + d)``,
what the Jaccard index is if an alignment says which words are common. Texts
link at SIMILARITY, so at ``d <= n / 9``. Texts of fewer than nine words link
only to equal ones. A pair at the very threshold with its edits scattered has
about 0.385 of its runs in common, so an entry is equal with a chance of 0.057
and one of 64 with 0.977; recall is measured in the tests.

Buckets of up to SMALL texts give their pairs, larger ones tie each member to
one pivot, the text first in hash order, so a family meets the same pivot in
all its buckets. Each text's best pair is aligned first, then the pairs that
still lie across components. Large buckets that still hold several components
are then met in full, block by block: texts that lengths or counts of words
don't rule out are brought together with their words, and each pair across
components is aligned in the first bucket that both share, unless links found
there have joined it already. Only links leave a block, never pairs, so no
link between components is lost and none is repeated.

Cases: a null text is empty; empty texts are equal to each other and near to
nothing else; of equal or near texts the row with the smallest doc_id (nulls
last) represents the class; rows that repeat are in one class; an empty table
gives an empty result; more columns pass untouched.
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from rankwright.llm.common import attach_groups, cut, scratch, small_batches, spread, table
from rankwright.llm.graph import Roots, components

K = 5
ENTRIES = 64
LEAST_KMERS = 3
#: Texts of fewer words than the first number have, over runs of the second, as many further entries as the third says.
SHORT = ((128, 3, 32), (24, 2, 32))
SIMILARITY = 0.8
#: Buckets of up to so many texts give all their pairs.
SMALL = 8
#: Large buckets are met in pairs of blocks of about so many texts and so many words.
BLOCK = 4096
BLOCK_WORDS = 1 << 22
#: Pairs that a block compares at once.
TILE = 1 << 20
#: Words are counted by so many remainders of their hashes, which bounds what two texts have in common from above.
COUNTS = 128
MOST_COUNTED = 65_535
CACHE = 500_000
#: Tables of ids up to so many rows (16 MB) are broadcast, larger ones join by shuffle.
BROADCAST_IDS = 1_000_000
#: Pairs of one pivot that meet one copy of its words.
SHARED = 512

_C1, _C2 = np.uint64(0xFF51AFD7ED558CCD), np.uint64(0xC4CEB9FE1A85EC53)


def mix64(h: np.ndarray) -> np.ndarray:
    h = h ^ (h >> np.uint64(33))
    h = h * _C1
    h = h ^ (h >> np.uint64(33))
    h = h * _C2
    return h ^ (h >> np.uint64(33))


_SEEDS = mix64(np.arange(1, ENTRIES + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15))


class Words:
    """32-bit hashes of a text's words, remembered."""

    def __init__(self) -> None:
        self._seen: dict[str, int] = {}

    def of(self, text: str) -> np.ndarray:
        words = text.lower().split()
        new = set(words).difference(self._seen)
        if new:
            if len(self._seen) > CACHE:
                self._seen, new = {}, set(words)
            for w in new:
                self._seen[w] = zlib.crc32(w.encode("utf-8", "surrogatepass"))
        return np.fromiter(map(self._seen.__getitem__, words), dtype=np.uint32, count=len(words))


@lru_cache(maxsize=1)
def words() -> Words:
    return Words()


def kmers(h: np.ndarray, k: int = K) -> np.ndarray:
    """Occurrence-numbered k-mer hashes in text order."""
    if not len(h):
        return np.empty(0, dtype=np.uint64)
    h = mix64(h.astype(np.uint64) + np.uint64(1))
    n = max(1, len(h) - k + 1)
    out = np.zeros(n, dtype=np.uint64)
    for j in range(min(k, len(h))):
        out = out * np.uint64(0x100000001B3) + h[j : j + n]
    out = mix64(out)
    order = np.argsort(out, kind="stable")
    s = out[order]
    new = np.r_[True, s[1:] != s[:-1]]
    if not new.all():
        first = np.flatnonzero(new)[np.cumsum(new) - 1]
        count = np.empty(n, dtype=np.uint64)
        count[order] = (np.arange(n) - first).astype(np.uint64)
        out = np.where(count > 0, mix64(out + count * np.uint64(0x9E3779B97F4A7C15)), out)
    return out


def _entries(x: np.ndarray, seeds: np.ndarray) -> np.ndarray:
    """For each seed the hash of the LEAST_KMERS k-mers it puts first, in text order. Positions ride in the low bits of the permuted hashes."""
    n = len(x)
    low = np.uint64((1 << max(1, (n - 1).bit_length())) - 1)
    at, take, step = np.arange(n, dtype=np.uint64), min(LEAST_KMERS, n), max(1, (1 << 15) // n)
    least = []
    for k in range(0, len(seeds), step):  # so many seeds at a time as stay in the cache
        order = (((x[None, :] ^ seeds[k : k + step, None]) * _C1) & ~low) | at
        least.append((np.partition(order, take - 1, axis=1)[:, :take] & low).astype(np.int64))
    least = np.sort(np.concatenate(least), axis=1)
    out = seeds.copy()
    for c in range(take):
        out = out * np.uint64(0x100000001B3) + x[least[:, c]]
    return mix64(out)


def sketch(h: np.ndarray) -> np.ndarray:
    """The 64-bit entries of a text; none where no other text can be near."""
    if len(h) < fewest():
        return np.empty(0, dtype=np.uint64)
    out = _entries(kmers(h), _SEEDS)
    for below, k, entries in SHORT:
        if len(h) < below:
            out = np.r_[out, _entries(kmers(h, k), mix64(_SEEDS[:entries] + np.uint64(k)))]
    return out


def allowed(longest: int, least: float = SIMILARITY) -> int:
    """The edits that two texts may differ by."""
    return int(longest * (1 - least) / (1 + least) + 1e-9)


def fewest(least: float = SIMILARITY) -> int:
    """Words of the shortest text that may be near to another one."""
    return int(np.ceil((1 + least) / (1 - least) - 1e-9)) - 1


def _shared_most(a: np.ndarray, b: np.ndarray) -> int:
    """An upper bound of the size of the intersection of two multisets of hashes: counts by remainder."""
    bins = np.uint64(1 << max(10, 3 + max(len(a), len(b)).bit_length()))
    counts = (np.bincount((x & (bins - np.uint64(1))).astype(np.int64), minlength=int(bins)) for x in (a, b))
    return int(np.minimum(*counts).sum())


def _runs(a: np.ndarray, q: int) -> np.ndarray:
    h = a.astype(np.uint64)
    out = h[: len(a) - q + 1]
    for j in range(1, q):
        out = out * np.uint64(0x100000001B3) + h[j : len(a) - q + 1 + j]
    return out ^ (out >> np.uint64(29))


def _hopeless(a: np.ndarray, b: np.ndarray, most: int) -> bool:
    """Whether more than ``most`` edits are sure: an edit spoils one word, and at most q runs of q words."""
    longest = max(len(a), len(b))
    for q in (1, 3):
        if min(len(a), len(b)) >= q and longest - q + 1 - _shared_most(_runs(a, q), _runs(b, q)) > q * most:
            return True
    return False


def distance(a: np.ndarray, b: np.ndarray, most: int) -> int | None:
    """Edit distance of two arrays if at most ``most``, else None.

    The band of ``most`` rows on either side of the diagonal is one integer of
    ``2 * most + 1`` bits a column, its differences to the row above held as
    bit vectors, so a column costs a few operations on integers.
    """
    if abs(len(a) - len(b)) > most:
        return None
    both = min(len(a), len(b))
    head = int(np.argmax(np.r_[a[:both] != b[:both], True]))
    a, b, both = a[head:], b[head:], both - head
    tail = int(np.argmax(np.r_[a[::-1][:both] != b[::-1][:both], True]))
    a, b = a[: len(a) - tail], b[: len(b) - tail]
    n, m = len(a), len(b)
    if not n or not m:
        return n + m
    if not most or _hopeless(a, b, most):
        return None
    rows: dict[int, list[int]] = {}
    for i, word in enumerate(a.tolist()):
        rows.setdefault(word, []).append(i + most + 1)
    # a frequent word has its rows as bits; few words are so frequent that this takes much room
    often = max(8, n >> 6)
    bits = {w: sum(1 << r for r in at) for w, at in rows.items() if len(at) > often}
    mask, top = (1 << (2 * most + 1)) - 1, 1 << (2 * most)
    up, down, score = ((1 << (most + 1)) - 1) << most, 0, min(most, n)
    for j, word in enumerate(b.tolist(), 1):
        if word in bits:
            same = (bits[word] >> j) & mask
        else:
            same = 0
            for r in rows.get(word, ()):
                if 0 <= r - j <= 2 * most:
                    same |= 1 << (r - j)
        diagonal = (((((same & up) + up) ^ up) & mask) | same | down)
        right = down | ((diagonal | up) ^ mask)
        left = diagonal & up
        if j + most <= n:  # along the lower edge of the band
            score += not diagonal & top
        else:  # along the last row
            at = n - j + most
            score += ((right >> at) & 1) - ((left >> at) & 1)
        if score > most + (m - max(j, n - most)):
            return None
        diagonal >>= 1
        up, down = left | ((diagonal | right) ^ mask), diagonal & right
    return score if score <= most else None


def similarity(a: np.ndarray, b: np.ndarray, least: float = SIMILARITY) -> float:
    """(n - d) / (n + d) for edit distance d and the longer length n; 0 where that is below ``least``."""
    longest = max(len(a), len(b))
    if not longest:
        return 1.0
    d = distance(a, b, allowed(longest, least))
    return 0.0 if d is None else (longest - d) / (longest + d)


def _digest(text: str) -> bytes:
    """Digest of a text's normal form."""
    return hashlib.blake2b(" ".join(text.lower().split()).encode("utf-8", "surrogatepass"), digest_size=16).digest()


def _sketched(docs: DataFrame) -> DataFrame:
    """doc_id, _text (a digest of the normal form), _keys and _words of every row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ("doc_id", "_text", "_keys", "_words")
        for batch in batches:
            digests, keys, hashes = [], [], []
            for text in batch.column(1):
                text = text.as_py() or ""
                h = words().of(text)
                digests.append(_digest(text))
                keys.append(sketch(h).view(np.int64))
                hashes.append(h.astype("<u4").tobytes())
            columns = [batch.column(0), pa.array(digests, pa.binary()), pa.array(keys, pa.list_(pa.int64())), pa.array(hashes, pa.binary())]
            yield pa.RecordBatch.from_arrays(columns, names=names)

    return spread(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")).mapInArrow(run, "doc_id long, _text binary, _keys array<long>, _words binary")


def _buckets(texts: DataFrame) -> DataFrame:
    """(key, id): one row for each text and entry."""
    return texts.select(F.explode("_keys").alias("key"), "id")


def _order(id_: str) -> Column:
    return F.xxhash64(F.col(id_), F.lit(0))


def _pairs(rows: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Candidate pairs (a before b in hash order) with the number of buckets they share, and rows (key, id) of large buckets."""
    groups = rows.groupBy("key").agg(F.count(F.lit(1)).alias("n"), F.min_by("id", _order("id")).alias("p"))
    groups = cut(groups.where("n > 1"), "groups")
    met = cut(attach_groups(rows, groups, "key", "n", rows.count()), "met")
    star = met.where((F.col("n") > SMALL) & (F.col("id") != F.col("p"))).select(F.col("p").alias("a"), F.col("id").alias("b"))
    few = met.where(F.col("n") <= SMALL).groupBy("key").agg(F.collect_list("id").alias("ids"))
    few = few.select(F.explode("ids").alias("a"), "ids").select("a", F.explode("ids").alias("b"))
    few = few.where((_order("a") < _order("b")) | ((_order("a") == _order("b")) & (F.col("a") < F.col("b"))))
    pairs = star.unionByName(few).groupBy("a", "b").agg(F.count(F.lit(1)).alias("est"))
    return pairs, met.where(F.col("n") > SMALL).select("key", "id")


def _few(df: DataFrame) -> DataFrame:
    """``df``, a written table of ids, to be broadcast if it is small."""
    return F.broadcast(df) if df.count() <= BROADCAST_IDS else df


def _verified(pairs: DataFrame, rows: DataFrame, least: float) -> DataFrame:
    """The pairs whose texts align, with their similarity. Only words of texts in a pair are shuffled, those of a pivot in as many copies as SHARED asks for."""
    spark = rows.sparkSession
    pairs = cut(pairs.select("a", "b"), "asked")
    hubs = pairs.groupBy("a").agg(F.ceil(F.count(F.lit(1)) / SHARED).alias("_parts")).where("_parts > 1")
    hubs = _few(cut(hubs.select(F.col("a").alias("_hub"), "_parts"), "hubs"))
    parts = F.coalesce("_parts", F.lit(1))

    def held(c: str) -> DataFrame:
        ids = _few(cut(pairs.select(F.col(c).alias("_row")).distinct(), "ids"))
        return rows.join(ids, "_row", "left_semi").select(F.col("_row").alias(c), F.col("_words").alias(f"_w{c}"))

    left = held("a").join(hubs, F.col("a") == F.col("_hub"), "left").select("a", "_wa", F.explode(F.sequence(F.lit(1), parts.cast("int"))).alias("_part"))
    asked = pairs.join(hubs, F.col("a") == F.col("_hub"), "left").select("a", "b", (F.pmod(F.xxhash64("b"), parts) + 1).cast("int").alias("_part"))
    # as many tasks as the session has shuffle partitions: aligning is work, however few the bytes
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    both = asked.join(left, ["a", "_part"]).select("a", "b", "_wa").repartition(n, "b").join(held("b").repartition(n, "b"), "b").select("a", "b", "_wa", "_wb")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for a, b, wa, wb in zip(*(batch.column(i) for i in range(4))):
                s = similarity(np.frombuffer(wa.as_buffer(), dtype="<u4"), np.frombuffer(wb.as_buffer(), dtype="<u4"), least)
                if s >= least:
                    out.append((a.as_py(), b.as_py(), s))
            yield _links(out)

    return both.mapInArrow(run, LINKS)


LINKS = "a long, b long, similarity double"


def _links(out: list[tuple[int, int, float]]) -> pa.RecordBatch:
    columns = list(zip(*out)) if out else [[], [], []]
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, (pa.int64(), pa.int64(), pa.float64()))], names=("a", "b", "similarity"))


def _across(pairs: DataFrame, labels: DataFrame) -> DataFrame:
    """The pairs whose ends are not in one component yet."""
    for c in ("a", "b"):
        pairs = pairs.join(labels.select(F.col("node").alias(c), F.col("label").alias(f"_l{c}")), c, "left")
        pairs = pairs.withColumn(f"_l{c}", F.coalesce(f"_l{c}", c))
    return pairs.where("_la <> _lb").drop("_la", "_lb")


def _counted(ids: DataFrame, rows: DataFrame) -> DataFrame:
    """Number of words, entries and counts of words by remainder of the texts ``ids`` (id)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sizes, counts = [], []
            for w in batch.column(2):
                h = np.frombuffer(w.as_buffer(), dtype="<u4")
                sizes.append(len(h))
                counts.append(np.minimum(np.bincount(h % COUNTS, minlength=COUNTS), MOST_COUNTED).astype("<u2").tobytes())
            columns = [batch.column(0), pa.array(sizes, pa.int64()), batch.column(1), pa.array(counts, pa.binary())]
            yield pa.RecordBatch.from_arrays(columns, names=("id", "_n", "_keys", "_counts"))

    held = rows.join(_few(cut(ids.select(F.col("id").alias("_row")), "ids")), "_row", "left_semi")
    return held.select("_row", "_keys", "_words").mapInArrow(run, "id long, _n long, _keys array<long>, _counts binary")


def _shared(block: pa.Table) -> np.ndarray:
    """The entries of a block's texts, a row each, zeros after the last."""
    lists = block["_keys"].to_pylist()
    out = np.zeros((len(lists), max(map(len, lists))), dtype=np.int64)
    for k, x in enumerate(lists):
        out[k, : len(x)] = x
    return out


def _cross(block: pa.Table) -> tuple[np.ndarray, np.ndarray]:
    """Texts of the first and of the second side of a block; within one block all are on both."""
    own, lo, hi = block["own"].to_numpy(), block["lo"][0].as_py(), block["hi"][0].as_py()
    return np.flatnonzero(own == lo), np.flatnonzero(own == hi)


def _open(label: np.ndarray, size: np.ndarray, x: np.ndarray, y: np.ndarray, least: float) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Pairs across components whose lengths allow a link, in tiles."""
    share = (1 - least) / (1 + least)
    for k in range(0, len(x), step := max(1, TILE // max(1, len(y)))):
        part = x[k : k + step]
        p, q = size[part][:, None], size[y][None, :]
        i, j = np.nonzero((label[part][:, None] != label[y][None, :]) & (np.abs(p - q) <= np.maximum(p, q) * share + 1e-9))
        for at in range(0, len(i), 1 << 14):
            yield part[i[at : at + (1 << 14)]], y[j[at : at + (1 << 14)]]


def meet(block: pa.Table, least: float) -> pa.Table:
    """The texts of two blocks (or one) that may align with one across components, by lengths and counts of words."""
    ids, label, size = (block[c].to_numpy() for c in ("id", "label", "_n"))
    keys, counts = _shared(block), np.frombuffer(b"".join(block["_counts"].to_pylist()), "<u2").reshape(-1, COUNTS)
    found, key = np.zeros(len(ids), dtype=bool), block["key"][0].as_py()
    for a, b in _open(label, size, *_cross(block), least):
        longest = np.maximum(size[a], size[b])
        both = np.minimum(counts[a], counts[b]).sum(axis=1, dtype=np.int64)
        ok = (longest - both <= longest * ((1 - least) / (1 + least)) + 1e-9) | (longest > MOST_COUNTED)
        a, b = a[ok], b[ok]
        same = (keys[a] == keys[b]) & (keys[a] != 0)
        first = keys[a, same.argmax(axis=1)] == key
        found[a[first]] = found[b[first]] = True
    at = np.flatnonzero(found)
    return pa.table({"key": pa.array([key] * len(at), pa.int64()), "lo": block["lo"].take(at), "hi": block["hi"].take(at), "own": block["own"].take(at), "id": ids[at], "label": label[at]})


def align(block: pa.Table, least: float) -> pa.Table:
    """Links between components of two blocks (or one): the likeliest pairs first, and none that earlier links have joined."""
    ids, label, keys = block["id"].to_numpy(), block["label"].to_numpy(), _shared(block)
    h = [np.frombuffer(w.as_buffer(), dtype="<u4") for w in block["_words"].combine_chunks()] if len(ids) else []
    size, key = np.array([len(w) for w in h]), block["key"][0].as_py()
    asked = []
    for a, b in _open(label, size, *_cross(block), least):
        same = (keys[a] == keys[b]) & (keys[a] != 0)
        ok = keys[a, same.argmax(axis=1)] == key
        asked.append(np.stack([a[ok], b[ok], same[ok].sum(axis=1)]))
    a, b, est = np.concatenate(asked, axis=1) if asked else np.zeros((3, 0), dtype=int)
    top, out = Roots(), []
    for k in np.argsort(-est, kind="stable"):
        la, lb = top.of(int(label[a[k]])), top.of(int(label[b[k]]))
        if la != lb and (s := similarity(h[a[k]], h[b[k]], least)) >= least:
            top.join(la, lb)
            out.append((int(ids[a[k]]), int(ids[b[k]]), s))
    return pa.Table.from_batches([_links(out)])


def _rest(large: DataFrame, texts: DataFrame, rows: DataFrame, labels: DataFrame, least: float) -> DataFrame:
    """Links across components of large buckets (key, id)."""
    facts = texts.select(F.col("id").alias("_of"), "_n").join(labels.select(F.col("node").alias("_of"), "label"), "_of", "left")
    inside = large.join(cut(facts, "facts"), F.col("id") == F.col("_of"), "left")
    inside = cut(inside.select("key", "id", "_n", F.coalesce("label", "id").alias("label")), "inside")
    several = inside.groupBy("key").agg(
        F.count(F.lit(1)).alias("n"), F.min("label").alias("lo"), F.max("label").alias("hi"),
        F.ceil(F.greatest(F.count(F.lit(1)) / BLOCK, F.sum("_n") / BLOCK_WORDS)).alias("_blocks"),
    )
    several = cut(several.where("lo < hi").select("key", "n", "_blocks"), "several")
    dealt = attach_groups(inside.select("key", "id", "label"), several, "key", "n", inside.count())
    own = F.pmod(F.xxhash64("id", F.lit(1)), F.col("_blocks")).alias("own")
    dealt = dealt.select("key", "id", "label", own, F.explode(F.sequence(F.lit(0).cast("long"), F.col("_blocks") - 1)).alias("other"))
    dealt = cut(dealt.select("key", F.least("own", "other").alias("lo"), F.greatest("own", "other").alias("hi"), "own", "id", "label"), "dealt")
    counted = cut(_counted(dealt.select("id").distinct(), rows), "counts")
    kind = "key long, lo long, hi long, own long, id long, label long"
    # blocks are work however few their bytes, so they spread over as many tasks as the session has shuffle partitions
    n = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    spread = lambda df: df.repartition(n, "key", "lo", "hi").groupBy("key", "lo", "hi")
    asked = cut(spread(dealt.join(counted, "id")).applyInArrow(lambda block: meet(block, least), kind), "may")
    held = rows.join(_few(cut(asked.select(F.col("id").alias("_row")).distinct(), "ids")), "_row", "left_semi")
    met = asked.join(held.select(F.col("_row").alias("id"), "_keys", "_words"), "id")
    return spread(met).applyInArrow(lambda block: align(block, least), LINKS)


def classes(docs: DataFrame, least: float = SIMILARITY) -> tuple[DataFrame, DataFrame]:
    """Rows (doc_id, class_id, text_copies, near, kept) for every row of ``docs``; and links (a, b, similarity) between text ids that hold the classes together."""
    found, links = _classed(docs, least)
    return found.drop("_text"), links


def _classed(docs: DataFrame, least: float = SIMILARITY) -> tuple[DataFrame, DataFrame]:
    """``classes`` with the digest ``_text`` of each row's text."""
    spark = docs.sparkSession
    small_batches(spark)
    with scratch(spark) as kept:
        rows = cut(_sketched(docs).withColumn("_row", F.monotonically_increasing_id()), "sketches")
        total = rows.count()
        texts = rows.groupBy("_text").agg(
            F.min("_row").alias("id"), F.min("doc_id").alias("rep"), F.count(F.lit(1)).alias("text_copies"),
            F.first("_keys").alias("_keys"), F.max(F.octet_length("_words") / 4).cast("long").alias("_n"),
        )
        texts = cut(texts, "texts")
        pairs, large = _pairs(_buckets(texts))
        pairs = cut(pairs, "pairs")
        best = pairs.groupBy("b").agg(F.max_by("a", "est").alias("a"))
        links = cut(_verified(best, rows, least), "aligned")
        labels = components(links)
        links = links.unionByName(cut(_verified(_across(pairs, labels), rows, least), "aligned"))
        labels = components(links)
        if large.limit(1).count():
            links = links.unionByName(cut(_rest(large, texts, rows, labels, least), "aligned"))
            labels = components(links)
        known = cut(texts.drop("_keys", "_n").join(labels.withColumnRenamed("node", "id"), "id", "left"), "known")
        linked = known.where("label IS NOT NULL")
        heads = linked.groupBy("label").agg(
            F.min("rep").alias("_head"), F.min(F.struct(F.col("rep").isNull(), "rep", "_text"))["_text"].alias("_first"), F.count(F.lit(1)).alias("near")
        )
        linked = attach_groups(linked, cut(heads, "heads"), "label", "near", texts.count())
        known = linked.unionByName(known.where("label IS NULL"), allowMissingColumns=True).select(
            "_text", F.coalesce("_head", "rep").alias("class_id"), F.coalesce("near", F.lit(1)).cast("long").alias("near"),
            "text_copies", F.coalesce(F.col("_first") == F.col("_text"), F.lit(True)).alias("kept"),
        )
        found = attach_groups(rows.select("doc_id", "_text"), cut(known, "known"), "_text", "text_copies", total)
        found = found.withColumn("kept", F.col("kept") & F.col("class_id").eqNullSafe(F.col("doc_id")))
        return kept(cut(found, "classes")), kept(cut(links, "links"))


def _digested(packed: DataFrame) -> DataFrame:
    """Rows (_doc) with the digest ``_text`` of their text."""

    def run(texts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for t in texts:
            yield t.map(lambda x: _digest(x or ""))

    return packed.withColumn("_text", F.pandas_udf(run, "binary")(F.col("_doc.text")))


def keep_one(docs: DataFrame) -> DataFrame:
    """One row of each class, the one that represents it; columns as they were.

    Rows of an id whose rows are all kept or all dropped are told by doc_id;
    those of other ids, and without one, by doc_id and text. Rows that repeat
    a representative's id and text are reduced to one.
    """
    found, _ = _classed(docs)
    found = cut(found.groupBy("doc_id", "_text").agg(F.bool_or("kept").alias("_kept"), F.count(F.lit(1)).alias("_n")), "classes")
    by_id = found.where("doc_id IS NOT NULL").groupBy("doc_id").agg(
        F.sum("_n").alias("_n"), F.bool_or("_kept").alias("_any"), F.bool_and("_kept").alias("_all")
    )
    gone = _few(cut(by_id.where("NOT _any").select(F.col("doc_id").alias("_id")), "gone"))
    told = cut(by_id.where("_any AND NOT (_all AND _n = 1)").select(F.col("doc_id").alias("_id")), "told")
    plain = docs.where(docs["doc_id"].isNotNull()).join(gone, docs["doc_id"] == F.col("_id"), "left_anti")
    pack = F.struct(*[docs[c] for c in docs.columns]).alias("_doc")
    open_ = docs.where(docs["doc_id"].isNull()).select(pack).unionByName(
        docs.join(_few(told), docs["doc_id"] == told["_id"], "left_semi").select(pack)
    )
    heads = found.where("_kept").select(F.col("doc_id").alias("_id"), F.col("_text").alias("_t"), "_n")
    heads = heads.where("_id IS NULL").unionByName(heads.join(_few(told), "_id", "left_semi"))
    open_ = _digested(open_).join(_few(cut(heads, "heads")), (F.col("_text") == F.col("_t")) & F.col("_doc.doc_id").cast("long").eqNullSafe(F.col("_id")))
    once = open_.where("_n = 1").select("_doc.*")
    more = open_.where("_n > 1").groupBy("_id", "_t").agg(F.min_by("_doc", F.xxhash64("_doc")).alias("_doc")).select("_doc.*")
    return plain.join(_few(told), docs["doc_id"] == told["_id"], "left_anti").unionByName(once).unionByName(more)


def op3_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found, _ = classes(table(spark, sf_dir, "documents"))
    return found.select("doc_id", "class_id", "text_copies", "near", "kept")


QUERIES = {"op3_near_dedup": op3_near_dedup}
SQL: dict[str, str] = {}

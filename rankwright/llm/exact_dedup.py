"""Exact dedup by two-pass Bloom filtering, DataFrame operations only.

Pass one hashes every text (A-Z lower-cased) into ``K`` cells of a filter of
``BITS_PER_ROW`` bits a row, counts each cell with map-side combining and
keeps, as 4 KB bitmaps, the cells hit more than once. Pass two probes the
filter: a row with a cell hit once is unique and passes straight through;
only the others are grouped by their SHA-256. False positives cost a little
shuffle and never a wrong result.

A filter of more than BROADCAST_BITS bits is built and probed in parts: the
hashes, written once, are split by ranges into folders as they are written,
and each part has a filter of its own that is broadcast; its rows are probed
and written before the next one is built. So however many rows there are, only
possible repeats shuffle, and one filter at a time is held. What counts the
cells is 16 bytes a row: bitmaps of single tasks would be sparse, 4 KB for each
bucket that a task hits, and more to move. The stage that returns whole rows
then probes them with a filter of the *repeated* hashes alone, which takes
further scans of the rows only where more than BROADCAST_BITS / BITS_PER_ROW
texts are repeated.

Cases: a null text counts as empty, and empty texts are equal to each other;
rows of one text and one doc_id are ordered by a row number fixed by the
first pass, and one of them stays; a null doc_id sorts before all others; an
empty table gives an empty result; other columns pass untouched.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from rankwright.llm.common import attach_groups, cut, fold_ascii, table, whole_text

K = 2
BITS_PER_ROW = 16
#: A filter that is broadcast has at most so many bits (32 MB); larger ones are split.
BROADCAST_BITS = 1 << 28


def text_key() -> Column:
    return F.sha2(fold_ascii(whole_text()), 256)


def _bits(total: int) -> int:
    return 1 << max(15, math.ceil(math.log2(BITS_PER_ROW * total + 1)))


def parts_of(total: int) -> int:
    """Parts of a filter for so many rows."""
    return max(1, _bits(total) // BROADCAST_BITS)


def _part(key: Column, parts: int) -> Column:
    return F.pmod(F.xxhash64(key, F.lit(-1)), F.lit(parts)).cast("int")


def _cells(key: Column, bits: int) -> list[Column]:
    return [F.xxhash64(key, F.lit(j)).bitwiseAND(F.lit(bits - 1)) + 1 for j in range(K)]


def bitmaps_of(slim: DataFrame, key: str, bits: int, least: int) -> DataFrame:
    """The bitmaps of cells that at least ``least`` rows hit, a row for each 32768 bits."""
    cells = slim.select(F.explode(F.array(*_cells(F.col(key), bits))).alias("_cell"))
    hit = cells.groupBy("_cell").count().where(F.col("count") >= least)
    return hit.groupBy(F.bitmap_bucket_number("_cell").alias("_bucket")).agg(
        F.bitmap_construct_agg(F.bitmap_bit_position("_cell")).alias("_bits")
    )


def probe(rows: DataFrame, key: str, bitmaps: DataFrame, bits: int) -> DataFrame:
    """Add ``_again``: whether all cells of the key are in the bitmaps, which are broadcast (at most BROADCAST_BITS)."""
    for j, cell in enumerate(_cells(F.col(key), bits)):
        part = F.broadcast(bitmaps.select(F.col("_bucket").alias(f"_b{j}"), F.col("_bits").alias(f"_m{j}")))
        at = F.bitmap_bit_position(cell)
        byte = F.conv(F.hex(F.substring(F.col(f"_m{j}"), F.floor(at / 8).cast("int") + 1, F.lit(1))), 16, 10)
        bit = F.expr(f"pmod(bitmap_bit_position(_c{j}), 8)").cast("int")
        hit = F.call_function("shiftright", byte.cast("int"), bit).bitwiseAND(F.lit(1)) == 1
        rows = (
            rows.withColumn(f"_c{j}", cell)
            .join(part, F.bitmap_bucket_number(F.col(f"_c{j}")) == F.col(f"_b{j}"), "left")
            .withColumn(f"_h{j}", F.coalesce(hit, F.lit(False)))
            .drop(f"_b{j}", f"_m{j}", f"_c{j}")
        )
    again = F.col("_h0")
    for j in range(1, K):
        again = again & F.col(f"_h{j}")
    return rows.withColumn("_again", again).drop(*[f"_h{j}" for j in range(K)])


def _union(frames: list[DataFrame]) -> DataFrame:
    out = frames[0]
    for df in frames[1:]:
        out = out.unionByName(df)
    return out


def _hashed(docs: DataFrame) -> tuple[DataFrame, int]:
    """doc_id, _key, _row and _part of every row, written by parts; and the number of rows."""
    slim = docs.select("doc_id", text_key().alias("_key")).withColumn("_row", F.monotonically_increasing_id())
    slim = cut(slim, "exact")
    total = slim.count()
    parts = parts_of(total)
    if parts == 1:
        return slim.withColumn("_part", F.lit(0)), total
    return cut(slim.withColumn("_part", _part(F.col("_key"), parts)), "parts", by="_part"), total


def _probed(slim: DataFrame, total: int) -> DataFrame:
    """The rows of ``_hashed`` with ``_again``: whether their text may repeat."""
    parts = parts_of(total)
    bits = min(_bits(total), BROADCAST_BITS)
    if parts == 1:
        return probe(slim, "_key", cut(bitmaps_of(slim, "_key", bits, 2), "bloom"), bits)
    # a part is probed and written before the next filter is built: one broadcast is alive at a time
    each = [slim.where(F.col("_part") == p) for p in range(parts)]
    return _union([cut(probe(x, "_key", cut(bitmaps_of(x, "_key", bits, 2), "bloom"), bits), "probed") for x in each])


def copy_groups(docs: DataFrame) -> DataFrame:
    """doc_id, keep_id, group_size, kept, text_sha256 for every row."""
    slim, total = _hashed(docs)
    probed = _probed(slim, total)
    alone = probed.where(~F.col("_again")).select(
        "doc_id",
        F.col("doc_id").alias("keep_id"),
        F.lit(1).cast("long").alias("group_size"),
        F.lit(True).alias("kept"),
        F.col("_key").alias("text_sha256"),
    )
    again = cut(probed.where("_again").select("doc_id", "_key", "_row"), "again")
    groups = again.groupBy("_key").agg(
        F.max(F.struct("doc_id", "_row")).alias("_keep"), F.count(F.lit(1)).alias("group_size")
    )
    met = attach_groups(again, cut(groups, "groups"), "_key", "group_size", total).select(
        "doc_id",
        F.col("_keep.doc_id").alias("keep_id"),
        "group_size",
        (F.col("_keep._row") == F.col("_row")).alias("kept"),
        F.col("_key").alias("text_sha256"),
    )
    return alone.unionByName(met)


def drop_copies(docs: DataFrame) -> DataFrame:
    """The rows of ``docs`` that stay, all columns as they were.

    Rows that the filter clears never shuffle. The others are reduced to one
    row a text on each map task before they meet.
    """
    slim, total = _hashed(docs)
    again = _probed(slim, total).where("_again").groupBy("_key").count().where("count > 1").select("_key")
    again = cut(again, "repeated")
    repeated = again.count()
    parts, bits = parts_of(repeated), min(_bits(repeated), BROADCAST_BITS)
    packed = docs.select(F.struct(*[docs[c] for c in docs.columns]).alias("_doc"), text_key().alias("_key"))

    def kept(p: int) -> DataFrame:
        mine = lambda df: df.where(_part(F.col("_key"), parts) == p) if parts > 1 else df
        probed = probe(mine(packed), "_key", cut(bitmaps_of(mine(again), "_key", bits, 1), "bloom"), bits)
        met = probed.where("_again").groupBy("_key").agg(F.max_by("_doc", F.struct(F.col("_doc.doc_id"), F.xxhash64("_doc"))).alias("_doc"))
        return probed.where(~F.col("_again")).select("_doc.*").unionByName(met.select("_doc.*"))

    return _union([kept(p) for p in range(parts)])


def op8_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return copy_groups(table(spark, sf_dir, "documents"))


ORACLE = """
WITH t AS (
  SELECT doc_id, sha256(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')) AS text_sha256
  FROM documents)
SELECT doc_id, max(doc_id) OVER w AS keep_id, count(*) OVER w AS group_size,
       doc_id = max(doc_id) OVER w AS kept, text_sha256
FROM t WINDOW w AS (PARTITION BY text_sha256)
"""

QUERIES = {"op8_exact_dedup": op8_exact_dedup}
SQL = {"op8_exact_dedup": ORACLE}

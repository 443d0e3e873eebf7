"""Packing by concatenate and cut.

Pass one encodes every document on the task that reads it and writes ids with
the running token count of that task. The token totals of the tasks, one row
each, are prefix-summed into global offsets. Pass two lays every document at
its offset and cuts at multiples of the window; documents that cross a
boundary give several pieces. Only the totals meet in one place.

Cases: a null or empty text is the end id alone; rows may repeat; the order is
that in which the first pass wrote, fixed by its table; an empty table gives
no pieces; only ``doc_id`` and ``text`` are read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from rankwright.llm.common import cut, small_batches, spread, table
from rankwright.llm.tokens import VOCABULARY, encoder

WINDOW = 4096
END = 2
#: Pass one hands rows on in chunks of about so many bytes.
CHUNK_BYTES = 8 << 20

_PASS_ONE = "_task int, _at long, doc_id long, doc_tokens long, _ids binary"
_PASS_TWO = "doc_id long, start long, length long, doc_tokens long, sequence_id long, offset long, ids binary"


def _encode(vocabulary: str, end: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task, at, coder = TaskContext.get().partitionId(), 0, encoder(vocabulary)
        tail = np.asarray([end], dtype="<u2").tobytes()
        kinds = (pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.binary())
        schema = pa.schema(zip(("_task", "_at", "doc_id", "doc_tokens", "_ids"), kinds))

        def batch_of(ids, starts, counts, keys):
            columns = ([task] * len(ids), starts, keys, counts, ids)
            return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds)], schema=schema)

        for batch in batches:
            ids, starts, counts, keys, held = [], [], [], [], 0
            for key, text in zip(batch.column(0), batch.column(1)):
                got = coder.encode(text.as_py() or "") + tail
                n = len(got) // 2
                ids.append(got), starts.append(at), counts.append(n), keys.append(key.as_py())
                at, held = at + n, held + len(got)
                if held > CHUNK_BYTES:
                    yield batch_of(ids, starts, counts, keys)
                    ids, starts, counts, keys, held = [], [], [], [], 0
            if ids:
                yield batch_of(ids, starts, counts, keys)

    return run


def _cut_windows(window: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schema = pa.schema([(n, pa.int64()) for n in ("doc_id", "start", "length", "doc_tokens", "sequence_id", "offset")] + [("ids", pa.binary())])
        for batch in batches:
            out: list[list] = [[] for _ in schema]
            for key, first, n, raw in zip(*(batch.column(i) for i in range(4))):
                ids = np.frombuffer(raw.as_buffer(), dtype="<u2").astype("<u4")
                first, n, start = first.as_py(), n.as_py(), 0
                while start < n:
                    sequence, offset = divmod(first + start, window)
                    length = min(n - start, window - offset)
                    for column, value in zip(out, (key.as_py(), start, length, n, sequence, offset, ids[start : start + length].tobytes())):
                        column.append(value)
                    start += length
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(out, schema)], schema=schema)

    return run


def pack(docs: DataFrame, window: int = WINDOW, vocabulary: str = VOCABULARY, end: int = END) -> DataFrame:
    """Pieces: doc_id, start, length, doc_tokens, sequence_id, offset and the ids (32-bit little-endian)."""
    small_batches(docs.sparkSession)
    coded = cut(
        spread(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")).mapInArrow(_encode(vocabulary, end), _PASS_ONE),
        "tokens",
    )
    totals = coded.groupBy("_task").agg(F.sum("doc_tokens").alias("_n"))
    before = Window.orderBy("_task").rowsBetween(Window.unboundedPreceding, -1)
    # one row for each task of pass one
    bases = totals.select("_task", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_base"))
    laid = coded.join(F.broadcast(bases), "_task")
    laid = laid.select("doc_id", (F.col("_base") + F.col("_at")).alias("_first"), "doc_tokens", "_ids")
    return laid.mapInArrow(_cut_windows(window), _PASS_TWO)


def digest(pieces: DataFrame) -> DataFrame:
    return pieces.select(
        "doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset"
    )


def op5_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return digest(pack(table(spark, sf_dir, "documents")))


QUERIES = {"op5_packing": op5_packing}
SQL: dict[str, str] = {}

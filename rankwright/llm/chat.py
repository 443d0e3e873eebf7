"""Chat formatting in budgeted, turn-aligned windows.

Turns get token counts; prefix sums of them along each conversation say where
a turn starts and ends. Cells of ``budget`` tokens cut that line: the turns
that lie inside a cell are one window, and a turn that crosses a cell's end is
a window of its own, so own turns never go beyond the budget unless a single
turn does. Before its own turns a window holds the conversation's system turn,
always and whole, and the history: the turns just before, as many as fit
``history`` tokens in a row; a turn that does not fit ends it. Both are
repeats. Assistant turns are the targets: their text is under the loss mask in
their own window and masked where it is repeated.

The prefix sums are two-pass: conversations are dealt out by ranges of
(conv_id, turn), summed inside each range, and the ranges' totals, a row for
each conversation that crosses a range border, are carried over. So one
conversation of any length spreads over many tasks, and a window gathers a
bounded group: a budget or one turn, a history and a system turn.

The template is ``<|im_start|>role\\ntext<|im_end|>\\n``. Control strings
inside roles and texts are broken up by an escape character and come back
exactly (``unescape(escape(t)) == t``).

Cases: a null text or role is empty; turns are ordered by turn (nulls first),
role and text, and rows that repeat are turns of their own; a null conv_id is
a conversation of its own; only the first turn counts as the system turn, and
only if its role is ``system``; an empty table gives no windows; other columns
are not read.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from rankwright.llm.common import cut, small_batches, table
from rankwright.llm.tokens import VOCABULARY, encoder

BUDGET = 1024
HISTORY = 256
#: Windows of one conversation that share a copy of its system turn on the way to the join.
SYSTEM_SHARE = 64

#: Control strings of common chat templates, fixed values.
CONTROLS = ["<|im_start|>", "<|im_end|>", "<|endoftext|>", "<|startoftext|>", "<|system|>", "<|user|>", "<|assistant|>", "<s>", "</s>", "[INST]", "[/INST]", "<<SYS>>", "<</SYS>>"]
OPEN, CLOSE = "<|im_start|>", "<|im_end|>\n"
ESC = "\x1b"
_CONTROL = re.compile("|".join(re.escape(c) for c in sorted(CONTROLS, key=len, reverse=True)))
_TURN = re.compile(re.escape(OPEN) + "(.*?)\n(.*?)" + re.escape(CLOSE), re.S)


def escape(text: str) -> str:
    """No control string is left in the result; an escape character is followed by 0 (itself) or 1 (a break)."""
    return _CONTROL.sub(lambda m: m[0][0] + ESC + "1" + m[0][1:], text.replace(ESC, ESC + "0"))


def unescape(text: str) -> str:
    return text.replace(ESC + "1", "").replace(ESC + "0", ESC)


def escape_role(role: str) -> str:
    return escape(role).replace("\n", ESC + "2")


def unescape_role(role: str) -> str:
    return unescape(role.replace(ESC + "2", "\n"))


def _order() -> list[Column]:
    return [F.col("conv_id").asc_nulls_first(), F.col("turn").asc_nulls_first(), F.col("role"), F.col("text")]


def _placed(turns: DataFrame, vocabulary: str) -> DataFrame:
    """conv_id, role, text, _tokens, and the tokens (_start) and turns (_nth) before each turn of its conversation."""
    small_batches(turns.sparkSession)

    @F.pandas_udf("long")
    def counted(texts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for batch in texts:
            yield pd.Series([len(encoder(vocabulary).encode(t)) // 2 + 4 for t in batch], dtype="int64")

    rows = turns.select("conv_id", "turn", F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"))
    rows = cut(rows.withColumn("_tokens", counted("text")), "turns")
    rows = cut(rows.repartitionByRange(*_order()).withColumn("_range", F.spark_partition_id()), "ranged")
    inside = Window.partitionBy("_range", "conv_id").orderBy(*_order()[1:]).rowsBetween(Window.unboundedPreceding, -1)
    rows = rows.withColumn("_start", F.coalesce(F.sum("_tokens").over(inside), F.lit(0).cast("long"))).withColumn("_nth", F.count(F.lit(1)).over(inside))
    parts = rows.groupBy("conv_id", "_range").agg(F.sum("_tokens").alias("_t"), F.count(F.lit(1)).alias("_c"))
    first = parts.groupBy("conv_id").agg(F.min("_range").alias("_lo"), F.max("_range").alias("_hi")).where("_lo < _hi")
    # conversations that cross a border: at most one a border, so their parts number at most two a range
    parts = parts.join(F.broadcast(first.select(F.col("conv_id").alias("_id"))), F.col("conv_id").eqNullSafe(F.col("_id")), "left_semi")
    along = Window.partitionBy("conv_id").orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    carry = parts.select(
        F.col("conv_id").alias("_id"), F.col("_range").alias("_r"),
        F.coalesce(F.sum("_t").over(along), F.lit(0)).alias("_t0"), F.coalesce(F.sum("_c").over(along), F.lit(0)).alias("_c0"),
    )
    rows = rows.join(F.broadcast(carry), F.col("conv_id").eqNullSafe(F.col("_id")) & (F.col("_range") == F.col("_r")), "left")
    return rows.select(
        "conv_id", "role", "text", "_tokens",
        (F.col("_start") + F.coalesce("_t0", F.lit(0))).alias("_start"), (F.col("_nth") + F.coalesce("_c0", F.lit(0))).alias("_nth"),
    )


def format_chat(turns: DataFrame, budget: int = BUDGET, history: int = HISTORY, vocabulary: str = VOCABULARY) -> DataFrame:
    """Windows: conv_id, window, formatted text, repeats (leading repeated turns) and loss spans [start, end) in code points."""
    placed = _placed(turns, vocabulary)
    cell = F.floor(F.col("_start") / budget)
    crosses = F.col("_start") + F.col("_tokens") > (cell + 1) * budget
    placed = cut(placed.withColumn("window", 2 * cell + crosses.cast("long")), "placed")
    turn = lambda again: F.struct("_nth", "role", "text", F.lit(again).alias("again")).alias("_turn")
    own = placed.select("conv_id", "window", turn(False))
    system = (F.col("_nth") == 0) & (F.col("role") == "system")
    windows = placed.groupBy("conv_id", "window").agg(F.min("_start").alias("_first"))
    # a turn meets the windows that begin in the cells it may be history for: at most two begin in one cell
    near = windows.select(F.col("conv_id").alias("_id"), "window", "_first", F.floor(F.col("_first") / budget).alias("_cell"))
    late = placed.where(~system & (F.col("_tokens") <= history)).drop("window")
    late = late.withColumn("_cell", F.explode(F.sequence(cell, F.floor((F.col("_start") + history) / budget))))
    late = late.join(near, F.col("conv_id").eqNullSafe(F.col("_id")) & (late["_cell"] == near["_cell"]))
    late = late.where((F.col("_start") < F.col("_first")) & (F.col("_first") <= F.col("_start") + history))
    before = late.select("conv_id", "window", turn(True))
    share = F.floor(F.col("window") / SYSTEM_SHARE)
    reach = windows.groupBy("conv_id").agg(F.max("window").alias("_last"))
    heads = placed.where(system).select("conv_id", turn(True), F.col("window").alias("_own")).join(reach.withColumnRenamed("conv_id", "_id"), F.col("conv_id").eqNullSafe(F.col("_id")))
    heads = heads.select(F.col("conv_id").alias("_id"), "_turn", "_own", F.explode(F.sequence(F.lit(0).cast("long"), F.floor(F.col("_last") / SYSTEM_SHARE))).alias("_share"))
    heads = windows.join(heads, F.col("conv_id").eqNullSafe(F.col("_id")) & (share == F.col("_share"))).where("window > _own").select("conv_id", "window", "_turn")
    groups = own.unionByName(before).unionByName(heads).groupBy("conv_id", "window").agg(F.array_sort(F.collect_list("_turn")).alias("_turns"))

    @F.pandas_udf("formatted string, repeats int, loss array<struct<start:long,end:long>>")
    def rendered(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            out = []
            for window in batch:
                parts, at, spans, repeats = [], 0, [], 0
                for t in window:
                    head, body = f"{OPEN}{escape_role(t['role'])}\n", escape(t["text"])
                    if t["again"]:
                        repeats += 1
                    elif t["role"] == "assistant":
                        spans.append({"start": at + len(head), "end": at + len(head) + len(body)})
                    parts += [head, body, CLOSE]
                    at += len(head) + len(body) + len(CLOSE)
                out.append(("".join(parts), repeats, spans))
            yield pd.DataFrame(out, columns=["formatted", "repeats", "loss"])

    return groups.select("conv_id", "window", rendered("_turns").alias("_w")).select("conv_id", "window", "_w.*")


def read_back(windows: DataFrame) -> DataFrame:
    """What the windows hold, one row a conversation: the digests of its turns and of the text under the loss mask.

    A digest runs through all of a conversation in order, so its windows go to
    one task; they are streamed in sorted order and never held together.
    """
    small_batches(windows.sparkSession)
    rows = windows.withColumn("_key", F.coalesce(F.col("conv_id").cast("string"), F.lit("null")))
    rows = rows.repartition("_key").sortWithinPartitions("_key", "window")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        columns = ["conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars"]
        key, conv, n, loss, chars, all_, under = None, None, 0, 0, 0, hashlib.sha256(), hashlib.sha256()

        def done() -> list:
            return [None if conv is None or pd.isna(conv) else int(conv), n, all_.hexdigest(), loss, under.hexdigest(), chars]

        for batch in batches:
            out = []
            for k, c, text, repeats, spans in zip(batch["_key"], batch["conv_id"], batch["formatted"], batch["repeats"], batch["loss"]):
                if k != key:
                    if key is not None:
                        out.append(done())
                    key, conv, n, loss, chars, all_, under = k, c, 0, 0, 0, hashlib.sha256(), hashlib.sha256()
                chars += len(text)
                for i, m in enumerate(_TURN.finditer(text)):
                    if i >= repeats:
                        n += 1
                        all_.update(f"{unescape_role(m[1])}\n{unescape(m[2])}\n".encode("utf-8", "surrogatepass"))
                for s in spans:
                    part = unescape(text[s["start"] : s["end"]])
                    loss += len(part)
                    under.update(part.encode("utf-8", "surrogatepass"))
            yield pd.DataFrame(out, columns=columns).astype({"conv_id": "Int64"})
        if key is not None:
            yield pd.DataFrame([done()], columns=columns).astype({"conv_id": "Int64"})

    return rows.mapInPandas(run, "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long")


def op9_chat(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = table(spark, sf_dir, "conversations").select(F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), "role", "text")
    trap = "</s>[INST] ok [/INST]"
    extra = spark.createDataFrame([(-7, 0, "user", trap), (-7, 1, "assistant", trap)], turns.schema)
    return read_back(format_chat(turns.unionByName(extra)))


QUERIES = {"op9_chat": op9_chat}
SQL: dict[str, str] = {}

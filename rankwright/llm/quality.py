"""Quality classifier: logistic regression on hashed word n-grams, trained by FTRL.

Words and punctuation runs are hashed, single and in pairs, into 2**BITS
features; a pair of one word twice is one feature whatever the word. A
document's values are ``1 + ln(count)``, scaled to just under unit length
(SMOOTH holds short texts back). Weights come from follow-the-regularised-leader updates over a sample
of at most TRAIN_ROWS labelled documents (those of the smallest hash of their
id, so the sample does not depend on partitions; of those the ones of up to
TRAIN_CHARS characters are learned from); every document, whole, is
then scored as a sparse dot product with the broadcast weights (2**BITS
floats).

Cases: a null or empty text has the score of the bias alone; null labels are
not learned from; a doc_id with several labels counts as labelled by the
largest, one with several rows gives several examples; with no label of either
kind every score is one half; rows repeat as they stand; an empty table gives
an empty result; more columns pass untouched.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from rankwright.llm.common import small_batches, spread, table
from rankwright.llm.ftrl import Ftrl, mix32

BITS = 18
TRAIN_ROWS = 6000
#: Longer documents are not learned from, which bounds what the driver holds.
TRAIN_CHARS = 100_000
EPOCHS = 4
THRESHOLD = 0.7
HELD_OUT = (4, 2)
CACHE = 500_000
SMOOTH = 10.0
_TWICE = 0x2545F491
_TOKEN = re.compile(r"\w+|[^\w\s]+")


class Hasher:
    """Distinct hashed features of whole texts; word hashes are remembered."""

    def __init__(self) -> None:
        self._seen: dict[str, int] = {}

    def features(self, text: str) -> tuple[np.ndarray, np.ndarray]:
        words = _TOKEN.findall(text.lower())
        if not words:
            return np.empty(0, dtype=np.int64), np.empty(0)
        new = set(words).difference(self._seen)
        if new:
            if len(self._seen) > CACHE:
                self._seen, new = {}, set(words)
            for word in new:
                self._seen[word] = zlib.crc32(word.encode("utf-8", "surrogatepass"))
        h = np.fromiter(map(self._seen.__getitem__, words), dtype=np.uint32, count=len(words))
        pairs = h[:-1] * np.uint32(0x9E3779B1) + (h[1:] ^ np.uint32(0x5BD1E995))
        pairs[h[:-1] == h[1:]] = _TWICE
        idx, count = np.unique(mix32(np.concatenate([h, pairs])) >> np.uint32(32 - BITS), return_counts=True)
        x = 1.0 + np.log(count)
        return idx.astype(np.int64), x / np.sqrt(x @ x + SMOOTH)


@lru_cache(maxsize=1)
def hasher() -> Hasher:
    return Hasher()


def held_out(by: int, at: int):
    key = F.coalesce(F.col("doc_id").cast("string"), F.lit(""))
    return F.pmod(F.crc32(key.cast("binary")), F.lit(by)) == at


def train(docs: DataFrame, labels: DataFrame, rows: int = TRAIN_ROWS, epochs: int = EPOCHS, fold: tuple[int, int] | None = HELD_OUT) -> tuple[np.ndarray, float]:
    """Weights and bias. ``fold``: (mod, remainder) of crc32(doc_id) that is never learned from."""
    small_batches(docs.sparkSession)
    known = labels.where("quality IS NOT NULL AND doc_id IS NOT NULL")
    if fold:
        known = known.where(~held_out(*fold))
    known = known.groupBy("doc_id").agg(F.max("quality").alias("_y"))
    # at most ``rows`` ids: small enough to broadcast
    picked = known.orderBy(F.xxhash64("doc_id"), "doc_id").limit(rows)
    found = docs.select("doc_id", "text").where(F.length(F.coalesce("text", F.lit(""))) <= TRAIN_CHARS)
    found = found.join(F.broadcast(picked), "doc_id").select("doc_id", "text", "_y")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            got = [hasher().features(t or "") for t in batch["text"]]
            yield pd.DataFrame({
                "doc_id": batch["doc_id"], "y": batch["_y"],
                "f": [i.astype("<u4").tobytes() for i, _ in got], "x": [x.astype("<f4").tobytes() for _, x in got],
            })

    hashed = found.mapInPandas(run, "doc_id long, y int, f binary, x binary")
    got = hashed.orderBy(F.xxhash64("doc_id"), "doc_id", "f").limit(rows).collect()
    examples = [
        (np.frombuffer(bytes(r.f), dtype="<u4").astype(np.int64), np.frombuffer(bytes(r.x), dtype="<f4").astype(float), r.y)
        for r in sorted(got, key=lambda r: (r.doc_id, bytes(r.f), r.y))
    ]
    model = Ftrl(1 << BITS, alpha=3.0, l1=0.1, l2=0.1)
    if examples:
        model.fit(examples, epochs)
    return model.weights()[:, 0].astype(np.float32), float(model.bias()[0])


def score(docs: DataFrame, weights: np.ndarray, bias: float, column: str = "score") -> DataFrame:
    """Add the score: the likelihood of label 1, between 0 and 1."""
    small_batches(docs.sparkSession)
    shared = docs.sparkSession.sparkContext.broadcast(weights)

    @F.pandas_udf("double")
    def scored(texts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        w, features = shared.value, hasher().features
        for batch in texts:
            raw = np.empty(len(batch))
            for k, text in enumerate(batch):
                idx, x = features(text or "")
                raw[k] = bias + w[idx].astype(np.float64) @ x
            yield pd.Series(1.0 / (1.0 + np.exp(-np.clip(raw, -35, 35))))

    return spread(docs).withColumn(column, scored("text"))


def keep_good(docs: DataFrame, labels: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """The rows of ``docs`` whose score reaches the threshold, columns as they were."""
    packed = docs.select(F.struct(*[docs[c] for c in docs.columns]).alias("_doc"), "text")
    return score(packed, *train(docs, labels), "_score").where(F.col("_score") >= threshold).select("_doc.*")


def op4_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    model = train(docs, table(spark, sf_dir, "labels"))
    return score(docs, *model).select(
        "doc_id", held_out(*HELD_OUT).alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted")
    )


QUERIES = {"op4_quality": op4_quality}
SQL: dict[str, str] = {}

"""Language ID: sparse multinomial logistic regression on TF-IDF of character n-grams.

Words (runs of letters, lower-cased) are set between boundary marks and cut
into n-grams of 1 to 4 characters, hashed into 2**BITS features. Document
frequencies are counted over *all* documents to learn from, in one distributed
pass whose partial sums are at most 2**BITS rows a task; a document's values
are ``(1 + ln tf) * idf`` at unit length. FTRL with elastic-net penalties
trains on a sample of at most TRAIN_ROWS of them, those with the smallest hash
of their id among those of up to TRAIN_CHARS characters; CALIBRATION_ROWS others fix the temperature of the softmax. All
documents, whole, are scored with the broadcast weights (2**BITS floats a
language). ``score`` is the calibrated likelihood of the predicted language.

Cases: a null text or one without a letter is ``und`` with score 0; a null
lang is never learned from; with nothing to learn from everything is ``und``;
ties go to the first language by code point; rows repeat as they stand; an
empty table gives an empty result; more columns pass untouched.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from rankwright.llm.common import small_batches, spread, table
from rankwright.llm.ftrl import Ftrl, mix32, softmax, temperature
from rankwright.llm.quality import held_out

BITS = 16
NGRAMS = (1, 2, 3, 4)
TRAIN_ROWS = 4000
CALIBRATION_ROWS = 1000
#: Documents of up to so many characters make up the sample, which bounds what the driver holds; frequencies come from all.
TRAIN_CHARS = 100_000
EPOCHS = 3
HELD_OUT = (5, 0)
UNKNOWN = "und"
_OTHER = re.compile(r"[\W\d_]+")


def features(text: str) -> tuple[np.ndarray, np.ndarray]:
    """Distinct hashed n-grams of a whole text with their counts.

    All at once: runs of other characters become one boundary mark, and a
    gram may have the mark at its ends alone.
    """
    marked = _OTHER.sub("\x02", f"\x02{text.lower()}\x02")
    raw = np.frombuffer(marked.encode("utf-32-le", "surrogatepass"), dtype="<u4").astype(np.uint32, copy=False)
    mark = raw == 2
    h, parts = np.zeros(len(raw), dtype=np.uint32), []
    for n in NGRAMS:
        m = len(raw) - n + 1
        if m <= 0:
            break
        h = h[:m] * np.uint32(0x01000193) + raw[n - 1 :]
        ok = ~mark if n == 1 else np.ones(m, dtype=bool)
        for inner in range(1, n - 1):
            ok &= ~mark[inner : inner + m]
        parts.append(mix32(h[ok] ^ np.uint32(n * 0x9E3779B1 & 0xFFFFFFFF)) >> np.uint32(32 - BITS))
    counts = np.bincount(np.concatenate(parts), minlength=1)
    idx = np.flatnonzero(counts)
    return idx, counts[idx].astype(np.float64)


def has_letter(text: str) -> bool:
    return any(map(str.isalpha, text))


def values(idx: np.ndarray, count: np.ndarray, idf: np.ndarray) -> np.ndarray:
    x = (1.0 + np.log(count)) * idf[idx]
    norm = np.sqrt(x @ x)
    return x / norm if norm else x


def _document_frequencies(known: DataFrame) -> tuple[np.ndarray, int]:
    size = 1 << BITS

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        df, n = np.zeros(size, dtype=np.int64), 0
        for batch in batches:
            for text in batch["text"]:
                df[features(text or "")[0]] += 1
                n += 1
        at = np.flatnonzero(df)
        yield pd.DataFrame({"f": np.append(at, -1), "df": np.append(df[at], n)})

    rows = spread(known.select("text")).mapInPandas(run, "f long, df long").groupBy("f").agg(F.sum("df").alias("df")).collect()
    df, n = np.zeros(size), 0
    for f, c in rows:  # at most 2**BITS + 1 rows
        if f < 0:
            n = c
        else:
            df[f] = c
    return df, n


class Model:
    def __init__(self, langs: list[str], weights: np.ndarray, bias: np.ndarray, heat: float, idf: np.ndarray) -> None:
        self.langs, self.weights, self.bias, self.heat, self.idf = langs, weights, bias, heat, idf

    def predict(self, text: str | None) -> tuple[str, float]:
        if not text or not self.langs or not has_letter(text):
            return UNKNOWN, 0.0
        idx, count = features(text)
        raw = (values(idx, count, self.idf) @ self.weights[idx] + self.bias) / self.heat
        p = softmax(raw[None, :])[0]
        k = int(p.argmax())
        return self.langs[k], float(p[k])


def train(docs: DataFrame, rows: int = TRAIN_ROWS, calibration: int = CALIBRATION_ROWS, fold: tuple[int, int] | None = HELD_OUT) -> Model:
    """A model from ``text`` and ``lang``. ``fold``: (mod, remainder) of crc32(doc_id) that is never learned from."""
    small_batches(docs.sparkSession)
    known = docs.select("doc_id", "text", "lang").where("lang IS NOT NULL")
    if fold:
        known = known.where(~held_out(*fold))
    df, n = _document_frequencies(known)
    idf = np.log((1.0 + n) / (1.0 + df)) + 1.0

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            got = [features(t or "") for t in batch["text"]]
            yield pd.DataFrame({
                "h": batch["h"], "doc_id": batch["doc_id"], "lang": batch["lang"],
                "f": [i.astype("<u4").tobytes() for i, _ in got], "c": [c.astype("<f4").tobytes() for _, c in got],
            })

    # ids first, then only their texts: at most rows + calibration of them, so they broadcast
    order = ["h", F.col("doc_id").asc_nulls_first(), "_t"]
    keyed = known.where(F.length("text") <= TRAIN_CHARS).withColumn("h", F.xxhash64("doc_id")).withColumn("_t", F.xxhash64("text", "lang"))
    picked = keyed.select("h", "doc_id", "_t").orderBy(*order).limit(rows + calibration).select("h", "_t").distinct()
    found = keyed.join(F.broadcast(picked), ["h", "_t"]).select("h", "doc_id", "text", "lang")
    got = found.mapInPandas(run, "h long, doc_id long, lang string, f binary, c binary").orderBy("h", "doc_id", "lang", "f").limit(rows + calibration).collect()
    langs = sorted({r.lang for r in got})
    examples = []
    for r in got:
        idx = np.frombuffer(bytes(r.f), dtype="<u4").astype(np.int64)
        if len(idx):
            examples.append((idx, values(idx, np.frombuffer(bytes(r.c), dtype="<f4").astype(float), idf), langs.index(r.lang)))
    held = examples[:: max(2, (rows + calibration) // max(1, calibration))][:calibration]
    rest = [e for k, e in enumerate(examples) if k % max(2, (rows + calibration) // max(1, calibration)) or len(examples) < 10]
    model = Ftrl(1 << BITS, max(2, len(langs)), alpha=1.0, l1=0.05, l2=0.1)
    if rest:
        model.fit(rest, EPOCHS)
    w, b = model.weights()[:, : len(langs)], model.bias()[: len(langs)]
    heat = temperature(np.array([x @ w[i] + b for i, x, _ in held]), np.array([y for *_, y in held])) if len(langs) > 1 and held else 1.0
    return Model(langs, w.astype(np.float32), b, heat, idf)


def identify(docs: DataFrame, model: Model) -> DataFrame:
    """Add ``lang_pred`` and ``score``."""
    small_batches(docs.sparkSession)
    shared = docs.sparkSession.sparkContext.broadcast(model)

    @F.pandas_udf("lang_pred string, score double")
    def predicted(texts: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        for batch in texts:
            yield pd.DataFrame([shared.value.predict(t) for t in batch], columns=["lang_pred", "score"])

    keep = [docs[c] for c in docs.columns if c not in {"lang_pred", "score"}]
    return spread(docs).select(F.struct(*keep).alias("_doc"), predicted("text").alias("_p")).select("_doc.*", "_p.*")


def op1_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model = train(docs)
    return identify(docs.select("doc_id", "text", held_out(*HELD_OUT).alias("held_out")), model).drop("text")


QUERIES = {"op1_language_id": op1_language_id}
SQL: dict[str, str] = {}

"""Searches of a query set against all rows: scores stay in the task that reads the rows, only the best leave it.

Queries are taken in blocks of bounded size; a block is broadcast and the rows
are scanned once for it. A task keeps, for each query, the k-th best score so
far and hands on rows that reach it, ties included; the final ranking runs on
those few.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rankwright.functions.text import tokens
from rankwright.operators import ranking as R
from rankwright.operators.retrieval import K1, B
from rankwright.session import cut, ship, spread

#: Postings (query, term) or vectors of queries that are broadcast at once: about 16 MB of either.
BLOCK_POSTINGS = 500_000
BLOCK_VECTORS = 2048


class Best:
    """The rows of successive score matrices (rows x queries) that reach the k-th best score of their query."""

    def __init__(self, queries: int, k: int) -> None:
        self._top = np.full((k, queries), -np.inf)

    def take(self, scores: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        k = len(self._top)
        self._top = np.partition(np.concatenate([self._top, scores]), -k, axis=0)[-k:]
        return np.nonzero((scores >= self._top.min(axis=0)) & (scores > -np.inf))


def _blocks(rows: DataFrame, key: str, size: int) -> Iterator[list]:
    """Rows of the queries in blocks of about ``size`` rows; a query's rows stay together."""
    n = max(1, -(-rows.count() // size))
    for b in range(n):
        part = rows.where(F.pmod(F.xxhash64(key), F.lit(n)) == b) if n > 1 else rows
        if got := part.collect():
            yield got


def _union(parts: list[DataFrame], empty: DataFrame) -> DataFrame:
    out = empty
    for p in parts:
        out = out.unionByName(p)
    return out


def bm25_index(docs: DataFrame, doc_id: str, text: str, corpus: str | None = None) -> tuple[DataFrame, DataFrame, DataFrame]:
    """The written index of a corpus: documents (_doc, _corpus, _len and their terms with counts), document frequencies, sizes.

    Texts are read for this alone: every block of queries is scored from the
    index, a row for each document, so that no score has to be shuffled.
    """
    ship(docs.sparkSession)
    kinds = f"_doc {dict(docs.dtypes)[doc_id]}, _corpus string, _len int, terms array<string>, tfs array<int>"

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            found = [Counter(t) for t in b["_t"]]
            yield pd.DataFrame({"_doc": b["_doc"], "_corpus": b["_corpus"], "_len": b["_t"].map(len).astype("int32"), "terms": [list(c) for c in found], "tfs": [list(c.values()) for c in found]})

    name = F.coalesce(F.col(corpus).cast("string"), F.lit("")) if corpus else F.lit("")
    rows = spread(docs.select(F.col(doc_id).alias("_doc"), name.alias("_corpus"), F.coalesce(F.col(text), F.lit("")).alias("_text")))
    index = cut(rows.select("_doc", "_corpus", tokens(F.col("_text")).alias("_t")).mapInPandas(count, kinds), "index")
    df = index.select("_corpus", F.explode("terms").alias("term")).groupBy("_corpus", "term").agg(F.count(F.lit(1)).alias("df"))
    size = index.groupBy("_corpus").agg(F.count(F.lit(1)).alias("n"), F.avg("_len").alias("avgdl"))
    return index, cut(df, "terms"), size


class Block:
    """A block of queries as arrays: for each of its terms the queries that ask for it, and its weight in each corpus."""

    def __init__(self, postings: list, df: list, size: list) -> None:
        self.queries = sorted({q for q, *_ in postings})
        at = {q: k for k, q in enumerate(self.queries)}
        self.terms = pd.Index(sorted({t for _, t, _ in postings}))
        term = self.terms.get_indexer([t for _, t, _ in postings])
        order = np.argsort(term, kind="stable")
        self.asks = np.array([at[q] for q, *_ in postings], dtype=np.int64)[order]
        self.qf = np.array([f for *_, f in postings], dtype=float)[order]
        self.many = np.bincount(term, minlength=len(self.terms))
        self.first = np.cumsum(self.many) - self.many
        self.avgdl = {r["_corpus"]: r["avgdl"] for r in size}
        self.idf = {c: np.zeros(len(self.terms)) for c in self.avgdl}
        n = {r["_corpus"]: r["n"] for r in size}
        for r in df:
            self.idf[r["_corpus"]][self.terms.get_loc(r["term"])] = np.log(1 + (n[r["_corpus"]] - r["df"] + 0.5) / (r["df"] + 0.5))

    def scores(self, part: pd.DataFrame, corpus: str) -> np.ndarray:
        """(documents, queries): every count of a document meets the queries of its term at once."""
        width = part["terms"].map(len).to_numpy()
        doc, tf = np.repeat(np.arange(len(part)), width), np.concatenate([np.zeros(0), *part["tfs"]])
        term = self.terms.get_indexer(np.concatenate([np.zeros(0, object), *part["terms"]]))
        doc, tf, term = doc[term >= 0], tf[term >= 0], term[term >= 0]
        norm = K1 * ((1 - B) + B * part["_len"].to_numpy() / (self.avgdl[corpus] or 1.0))
        weight = self.idf[corpus][term] * tf * (K1 + 1) / (tf + norm[doc])
        many = self.many[term]
        within = np.arange(many.sum()) - np.repeat(np.cumsum(many) - many, many)
        ask = np.repeat(self.first[term], many) + within
        at = np.repeat(doc, many) * len(self.queries) + self.asks[ask]
        return np.bincount(at, weights=np.repeat(weight, many) * self.qf[ask], minlength=len(part) * len(self.queries)).reshape(len(part), -1)


#: Scores that a task holds at once.
CELLS = 1 << 20


def _bm25_scan(queries: DataFrame, query_id: str, query_text: str, docs: DataFrame, doc_id: str, text: str, corpus: str | None, each: Callable[[DataFrame, object], DataFrame]) -> list[DataFrame]:
    """``each`` over every block: (the index's documents, the broadcast block)."""
    spark = docs.sparkSession
    q = queries.select(query_id, F.explode(tokens(F.col(query_text))).alias("term"))
    q = cut(q.groupBy(query_id, "term").agg(F.count(F.lit(1)).cast("double").alias("qf")), "queries")
    index, df, size = bm25_index(docs, doc_id, text, corpus)
    size, out = size.collect(), []  # a row for each corpus
    for block in _blocks(q, query_id, BLOCK_POSTINGS):
        asked = spark.createDataFrame([(t,) for t in {r.term for r in block}], "term string")  # at most a block's terms
        known = df.join(F.broadcast(asked), "term").collect()  # a row for each corpus and term of the block
        out.append(each(index, spark.sparkContext.broadcast(Block([tuple(r) for r in block], known, size))))
    return out


def _parts(batch: pd.DataFrame, queries: int) -> Iterator[tuple[str, pd.DataFrame]]:
    """Rows of one corpus, a bounded number of scores at a time."""
    step = max(1, CELLS // max(1, queries))
    for c, part in batch.groupby("_corpus", sort=False):
        for at in range(0, len(part), step):
            yield c, part.iloc[at : at + step]


def bm25_top_k(queries: DataFrame, query_id: str, query_text: str, docs: DataFrame, doc_id: str, text: str, k: int, corpus: str | None = None) -> DataFrame:
    """The k best documents of every query (of every query and corpus): query_id, doc_id, [corpus], score, rn. Ties go to the smaller doc_id.

    Documents that share no term with a query have no row. Statistics (size,
    mean length, document frequencies) are those of the corpus.
    """
    kinds = f"`{query_id}` {dict(queries.dtypes)[query_id]}, `{doc_id}` {dict(docs.dtypes)[doc_id]}, _corpus string, score double"

    def scan(rows: DataFrame, shared) -> DataFrame:
        def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            index, best = shared.value, {}
            names = np.array(index.queries)
            for batch in batches:
                for c, some in _parts(batch, len(names)):
                    s = index.scores(some, c)
                    keep = best.setdefault(c, Best(len(names), k))
                    i, j = keep.take(np.where(s > 0, np.round(s, R.SCORE_DIGITS), -np.inf))
                    yield pd.DataFrame({query_id: names[j], doc_id: some["_doc"].to_numpy()[i], "_corpus": c, "score": s[i, j]})

        return rows.mapInPandas(run, kinds)

    parts = _bm25_scan(queries, query_id, query_text, docs, doc_id, text, corpus, scan)
    found = _union(parts, docs.sparkSession.createDataFrame([], kinds))
    found = R.top_k(found, [query_id, "_corpus"], "score", doc_id, k)
    return found.withColumnRenamed("_corpus", corpus) if corpus else found.drop("_corpus")


def bm25_scored(queries: DataFrame, query_id: str, query_text: str, docs: DataFrame, doc_id: str, text: str) -> DataFrame:
    """query_id and ``scored``, the number of documents whose score is not zero; queries without any are left out."""
    kinds = f"`{query_id}` {dict(queries.dtypes)[query_id]}, scored long"

    def scan(rows: DataFrame, shared) -> DataFrame:
        def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            index = shared.value
            n = np.zeros(len(index.queries), dtype=np.int64)
            for batch in batches:
                for c, some in _parts(batch, len(index.queries)):
                    n += (index.scores(some, c) != 0).sum(axis=0)
            yield pd.DataFrame({query_id: index.queries, "scored": n})

        return rows.mapInPandas(run, kinds)

    parts = _bm25_scan(queries, query_id, query_text, docs, doc_id, text, None, scan)
    found = _union(parts, docs.sparkSession.createDataFrame([], kinds))
    return found.groupBy(query_id).agg(F.sum("scored").alias("scored")).where("scored > 0")


def unit(v: pd.Series) -> np.ndarray:
    """Vectors as rows of unit length; a zero vector stays zero."""
    m = np.stack(v.to_numpy()).astype(np.float64)
    norm = np.sqrt((m * m).sum(axis=1, keepdims=True))
    return m / np.where(norm == 0, 1, norm)


def _dense_scan(queries: DataFrame, cands: DataFrame, kinds: str, each: Callable, extra: list[str] = ()) -> DataFrame:
    """``each(scores, cand_ids, cand_labels, query block)`` over Arrow batches of candidates (id, label, vec); own pairs score minus infinity."""
    ship(cands.sparkSession)
    parts = []
    for block in _blocks(cut(queries.select("id", "label", "vec", *extra), "queries"), "id", BLOCK_VECTORS):
        ids = np.array([r.id for r in block])
        held = (ids, [r.label for r in block], unit(pd.Series([r.vec for r in block])), [[r[c] for r in block] for c in extra])
        shared = cands.sparkSession.sparkContext.broadcast(held)

        def run(batches: Iterator[pd.DataFrame], shared=shared) -> Iterator[pd.DataFrame]:
            ids, labels, q, more = shared.value
            state: dict = {}
            for batch in batches:
                for at in range(0, len(batch), 1024):
                    part = batch.iloc[at : at + 1024]
                    own, names = part["id"].to_numpy(), part["label"].to_numpy()
                    s = unit(part["vec"]) @ q.T
                    s[own[:, None] == ids[None, :]] = -np.inf
                    yield each(np.round(s, R.SCORE_DIGITS), own, names, ids, np.array(labels), more, state)

        parts.append(cands.select("id", "label", "vec").mapInPandas(run, kinds))
    return _union(parts, cands.sparkSession.createDataFrame([], kinds))


def dense_top_k(queries: DataFrame, cands: DataFrame, k: int) -> DataFrame:
    """The k most similar candidates of every query, itself left out: query_id, cand_id, score, rn. Both sides are (id, label, vec)."""

    def each(s, own, names, ids, labels, more, state) -> pd.DataFrame:
        i, j = state.setdefault("best", Best(len(ids), k)).take(s)
        return pd.DataFrame({"query_id": ids[j], "cand_id": own[i], "score": s[i, j]})

    found = _dense_scan(queries, cands, "query_id long, cand_id long, score double", each)
    return R.top_k(found, ["query_id"], "score", "cand_id", k)


def dense_first_positive(queries: DataFrame, cands: DataFrame) -> DataFrame:
    """query_id, first_rank (the rank of the best candidate of the query's label; null without one) and n (candidates).

    Two scans: the best positive of each query, then the number of candidates
    before it. Neither emits pairs.
    """

    def best(s, own, names, ids, labels, more, state) -> pd.DataFrame:
        s = np.where(names[:, None] == labels[None, :], s, -np.inf)
        top = s.max(axis=0)
        first = np.where(s == top, own[:, None], np.iinfo(np.int64).max).min(axis=0)
        ok = top > -np.inf
        return pd.DataFrame({"query_id": ids[ok], "score": top[ok], "cand_id": first[ok]})

    found = _dense_scan(queries, cands, "query_id long, score double, cand_id long", best)
    found = found.groupBy("query_id").agg(F.max(F.struct("score", -F.col("cand_id"))).alias("_b"))
    found = found.select(F.col("query_id").alias("id"), F.col("_b.score").alias("_score"), (-F.col("_b.col2")).alias("_cand"))
    known = queries.join(found, "id", "left")

    def count(s, own, names, ids, labels, more, state) -> pd.DataFrame:
        score = np.array([np.nan if x is None else x for x in more[0]], dtype=float)
        cand = np.array([-1 if x is None else x for x in more[1]])
        before = (s > score) | ((s == score) & (own[:, None] < cand[None, :]))
        return pd.DataFrame({"query_id": ids, "before": (before & (s > -np.inf)).sum(axis=0), "n": (s > -np.inf).sum(axis=0), "has": ~np.isnan(score)})

    got = _dense_scan(known, cands, "query_id long, before long, n long, has boolean", count, ["_score", "_cand"])
    got = got.groupBy("query_id").agg(F.sum("before").alias("_b"), F.sum("n").alias("n"), F.first("has").alias("_has"))
    return got.select("query_id", F.when(F.col("_has"), F.col("_b") + 1).alias("first_rank"), "n")


def dense_best_query(queries: DataFrame, cands: DataFrame) -> DataFrame:
    """Each candidate's most similar query, itself left out: cand_id, query_id, score. Ties go to the smaller query id."""

    def each(s, own, names, ids, labels, more, state) -> pd.DataFrame:
        top = s.max(axis=1)
        first = np.where(s == top[:, None], ids[None, :], np.iinfo(np.int64).max).min(axis=1)
        ok = top > -np.inf
        return pd.DataFrame({"cand_id": own[ok], "query_id": first[ok], "score": top[ok]})

    found = _dense_scan(queries, cands, "cand_id long, query_id long, score double", each)
    return found.groupBy("cand_id").agg(F.max_by("query_id", F.struct("score", -F.col("query_id"))).alias("query_id"), F.max("score").alias("score"))

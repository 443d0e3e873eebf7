"""The corpus pipeline: STAGES in order, each over all that the one before kept.

Quality classifier, exact dedup, near-dedup, mixing, packing. All but the last
return rows of ``documents``; mixing repeats a row as often as it is taken, and
packing lays out what the mix holds. A stage first deletes what the stage
before has written for itself alone; by then its result is a table.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import wraps

from pyspark.sql import DataFrame, SparkSession

from rankwright.llm import exact_dedup, mixing, near_dedup, packing, quality
from rankwright.llm.common import cut, table
from rankwright.session import collected, remove

Stage = Callable[[SparkSession, DataFrame, str], DataFrame]
_left: list[str] = []


def stage(f: Stage) -> Stage:
    @wraps(f)
    def run_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
        if f.__name__ != "good":  # the first stage leaves the end of an earlier run alone
            remove(spark, _left)
        _left.clear()
        with collected() as paths:
            out = f(spark, docs, sf_dir)
        _left.extend(paths)
        return out

    return run_stage


@stage
def good(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier accepts."""
    return quality.keep_good(docs, table(spark, sf_dir, "labels"))


@stage
def exact(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each text."""
    return exact_dedup.drop_copies(docs)


@stage
def near(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each class of near copies."""
    return near_dedup.keep_one(docs)


@stage
def mixed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the source weights take them."""
    return mixing.mix(docs)


@stage
def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of sequences."""
    return packing.digest(packing.pack(docs))


STAGES = [("quality", good), ("exact_dedup", exact), ("near_dedup", near), ("mixing", mixed), ("packing", packed)]

#: Trained models and token ids are not SQL; tests hold run() against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for k, (name, one) in enumerate(STAGES):
        docs = one(spark, docs, sf_dir)
        if k + 1 < len(STAGES):
            docs = cut(docs, name)
    return docs

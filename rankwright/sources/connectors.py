"""Lookups and encoders behind an injected transport: batches, retries by class, order by index, sources in turn, misses as rows.

A source is a function from a list of keys to items with an ``index`` into that
list and a ``value``, in any order; it lives on the executors and is all that
knows of a network. Work is dealt by partitions, a batch at a time, so a task
holds one batch and a lost task asks again for its own keys alone.
"""

from __future__ import annotations

import time
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rankwright.session import ship


class Unavailable(Exception):
    """The service may answer later: a time-out, a lost connection, a status of 500 or more."""


class Refused(Exception):
    """The service will not answer this: a status below 500."""


@dataclass(frozen=True)
class Source:
    """``call(keys) -> [{"index": i, "value": v}]``; a value of None is no answer. ``accepts`` says which keys it is asked for."""

    name: str
    call: Callable[[list], list[dict]]
    accepts: Callable[[object], bool] = lambda key: True


def answers(call: Callable[[list], list[dict]], keys: list, tries: int, wait: float) -> list:
    """The values of one batch in the order of its keys. Unavailable services are asked up to ``tries`` times, ever more slowly."""
    for n in range(1, tries + 1):
        try:
            items = call(keys)
            break
        except Unavailable:
            if n == tries:
                raise
            time.sleep(wait * n)
    by = {int(x.get("index", i)): x["value"] for i, x in enumerate(items)}
    if sorted(by) != list(range(len(keys))):
        raise Refused(f"{len(items)} items for {len(keys)} keys")
    return [by[i] for i in range(len(keys))]


def lookup(keys: DataFrame, cache: DataFrame, key: str, value: str, sources: list[Source], batch: int = 64, tries: int = 3, wait: float = 1.0, offline: bool = False) -> DataFrame:
    """key, value, origin, attempts of every distinct key.

    ``cache`` (key, value, origin) comes first: a row with a value answers
    (``cache:`` and where it came from). A row without one is a miss; it is
    asked for again unless ``offline``. Then the sources in order; the first
    with a value wins. A source that fails after its retries is told in
    ``attempts`` and the next one is tried. ``unresolved``: nobody had a value.
    A null key is no key.
    """
    ship(keys.sparkSession)
    asked = keys.where(F.col(key).isNotNull()).select(key).distinct()
    told = "array<struct<source: string, ok: boolean, error: string>>"
    known = cache.where(F.col(value).isNotNull()).groupBy(key).agg(F.max(F.struct(F.coalesce("origin", F.lit("unknown")).alias("origin"), value)).alias("_c"))
    hit = asked.join(known, key).select(key, f"_c.{value}", F.concat(F.lit("cache:"), "_c.origin").alias("origin"), F.array().cast(told).alias("attempts"))
    miss = asked.join(known, key, "left_anti")
    if offline:
        return hit.unionByName(miss.select(key, F.lit(None).cast(dict(cache.dtypes)[value]).alias(value), F.lit("unresolved").alias("origin"), F.array().cast(told).alias("attempts")))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            for at in range(0, len(b), batch):
                mine = b[key].iloc[at : at + batch].tolist()
                got, origin, attempts = {}, {}, {k: [] for k in mine}
                for s in sources:
                    left = [k for k in mine if k not in got and s.accepts(k)]
                    if not left:
                        continue
                    try:
                        found, error = answers(s.call, left, tries, wait), None
                    except (Unavailable, Refused) as e:
                        found, error = [None] * len(left), repr(e)
                    for k, v in zip(left, found):
                        attempts[k].append((s.name, error is None, error))
                        if v is not None:
                            got[k], origin[k] = v, s.name
                yield pd.DataFrame({key: mine, value: [got.get(k) for k in mine], "origin": [origin.get(k, "unresolved") for k in mine], "attempts": [attempts[k] for k in mine]})

    return hit.unionByName(miss.mapInPandas(run, f"`{key}` {dict(keys.dtypes)[key]}, `{value}` {dict(cache.dtypes)[value]}, origin string, attempts {told}"))


def to_cache(found: DataFrame, key: str, value: str) -> DataFrame:
    """The rows of a lookup that the cache does not hold yet, misses included."""
    return found.where(~F.startswith("origin", F.lit("cache:"))).select(key, value, "origin")


def encode(df: DataFrame, text: str, call: Callable[[list], list[dict]], out: str = "embedding", batch: int = 64, tries: int = 3, wait: float = 1.0) -> DataFrame:
    """Adds the unit vector of each text; a null text has none. A batch that still fails after its retries ends the query."""
    ship(df.sparkSession)

    @F.pandas_udf("array<double>")
    def run(parts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for s in parts:
            there = [i for i, t in enumerate(s) if t is not None]
            vectors: list = [None] * len(s)
            for at in range(0, len(there), batch):
                some = there[at : at + batch]
                for i, v in zip(some, answers(call, [s.iloc[i] for i in some], tries, wait)):
                    v = np.asarray(v, dtype=float)
                    norm = np.sqrt(v @ v)
                    vectors[i] = v / norm if norm else v
            yield pd.Series(vectors)

    return df.withColumn(out, run(text))

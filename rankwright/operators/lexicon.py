"""Phrase lexicons: which of any number of words and phrases stand in a text, and what they say for each mechanism.

A mechanism has keywords, aliases, a family and required groups. A phrase with a
blank or any sign is looked for in the lower-cased text as it stands, a plain
word among the text's tokens. All phrases of the lexicon become one automaton,
so a text is read once however many there are. A lexicon beyond ``BLOCK``
phrases is dealt into blocks by number; a block's automaton is broadcast, its
hits are written, and the next one follows, so that neither the driver nor a
worker ever holds more than one block.

Scores: 0 where a required group has no member in the text; else 3 for each
keyword of several words (or with a dot) and 1 for each other one, 4 for each
alias, a quarter for each token of the family's name.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from rankwright.session import cut, ship, spread

#: Phrases of one automaton, some 100 MB of it.
BLOCK = 200_000
KEYWORD, SEVERAL, ALIAS, FAMILY = 1.0, 3.0, 4.0, 0.25
TOKEN = "[a-z0-9][a-z0-9_.-]*[a-z0-9]|[a-z0-9]"
# fixed values: words that are no tokens
STOP_WORDS = (
    "able about after also and any are before being between both can case class code could data does due during each file for from function had has have into its may "
    "method more most new not object only other over result should some such than that the then these this through too under user using value very was were when where "
    "which while with without would"
).split()


def text_tokens(text: str, stop: frozenset[str]) -> set[str]:
    """The tokens of a lower-cased text: three signs at least, no stop words."""
    return {t for t in re.findall(TOKEN, text) if len(t) >= 3 and t not in stop}


def entries(mechanisms: DataFrame, stop: list[str] = STOP_WORDS) -> DataFrame:
    """One row for each thing a mechanism looks for: mechanism_id, phrase, shown, weight, need.

    ``mechanisms``: mechanism_id, family, keywords, aliases (arrays of text) and
    required (an array of arrays); null arrays are empty. ``shown`` is null
    where a hit is no match to report, ``need`` is the number of the required
    group and null elsewhere.
    """
    none = F.lit(None)

    def part(items: Column, weight, shown: Column | None, need: Column | None = None) -> DataFrame:
        x = F.col("_x")
        row = mechanisms.select("mechanism_id", F.explode(items).alias("_x"))
        return row.select("mechanism_id", F.lower(F.btrim(x)).alias("phrase"), (x if shown is None else shown).alias("shown"), weight(x).alias("weight"), none.cast("int").alias("need"))

    tokens = F.array_distinct(F.filter(F.regexp_extract_all(F.lower(F.replace("family", F.lit("_"), F.lit(" "))), F.lit(f"({TOKEN})"), F.lit(1)), lambda t: (F.length(t) >= 3) & ~t.isin(stop)))
    several = lambda x: F.when(x.contains(" ") | x.contains("."), SEVERAL).otherwise(KEYWORD)
    groups = mechanisms.select("mechanism_id", F.posexplode("required").alias("need", "_g")).select("mechanism_id", "need", F.explode("_g").alias("_x"))
    groups = groups.select("mechanism_id", F.lower(F.btrim("_x")).alias("phrase"), none.cast("string").alias("shown"), F.lit(0.0).alias("weight"), "need")
    out = part(F.col("keywords"), several, None).unionByName(part(F.col("aliases"), lambda x: F.lit(ALIAS), None))
    return out.unionByName(part(tokens, lambda x: F.lit(FAMILY), none.cast("string"))).unionByName(groups).where("phrase <> ''")


def phrase_hits(items: DataFrame, key: str, text: str, phrases: DataFrame, stop: list[str] = STOP_WORDS, block: int = BLOCK) -> DataFrame:
    """key, phrase_id of every phrase (phrase_id, phrase) that stands in a text, once for each text.

    The ids count from 0 without gaps. A null text holds nothing. Phrases are
    lower-cased already; the family's tokens are looked for like words.
    """
    spark = items.sparkSession
    ship(spark)
    kind = dict(items.dtypes)[key]
    rows, out = spread(items.select(key, text)), None
    for b in range(max(1, -(-phrases.count() // block))):
        mine = phrases.where(F.floor(F.col("phrase_id") / block) == b).collect()  # at most ``block`` rows
        held = spark.sparkContext.broadcast([(r["phrase_id"], r["phrase"]) for r in mine])
        hits = rows.mapInPandas(_finder(held, key, text, frozenset(stop)), f"`{key}` {kind}, phrase_id long")
        if len(mine) == block:  # more to come: this block's automaton goes
            hits = cut(hits, "phrase-hits")
            held.unpersist()
        out = hits if out is None else out.unionByName(hits)
    return out


def _finder(held, key: str, text: str, stop: frozenset[str]):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        import ahocorasick

        words, signs = {}, ahocorasick.Automaton()
        for i, p in held.value:
            if re.search("[^a-z0-9]", p):
                signs.add_word(p, i)
            else:
                words[p] = i
        if len(signs):
            signs.make_automaton()
        for batch in batches:
            ids, found = [], []
            for k, t in zip(batch[key], batch[text]):
                if t is None:
                    continue
                low = t.lower()
                hit = {words[w] for w in text_tokens(low, stop) & words.keys()}
                if len(signs):
                    hit.update(i for _, i in signs.iter(low))
                ids += [k] * len(hit)
                found += hit
            yield pd.DataFrame({key: pd.Series(ids, dtype=batch[key].dtype), "phrase_id": pd.Series(found, dtype="int64")})

    return run


#: A table of entries of up to so many rows is broadcast; a larger one joins by shuffle.
BROADCAST_ENTRIES = 200_000


def mechanism_scores(items: DataFrame, key: str, text: str, mechanisms: DataFrame, stop: list[str] = STOP_WORDS, block: int = BLOCK) -> DataFrame:
    """key, mechanism_id, score, matches (sorted, distinct) of every mechanism with a hit in an item and all its required groups met.

    A pair that is not there scores 0. Keys are taken as unique. An item meets
    only the entries of phrases that it holds; sums and the sets of met groups
    combine on the map side.
    """
    look = cut(entries(mechanisms, stop), "lexicon")
    few = look.limit(BROADCAST_ENTRIES + 1).count() <= BROADCAST_ENTRIES
    phrases = cut(_numbered(look.select("phrase").distinct()), "phrases")
    hits = phrase_hits(items, key, text, phrases, stop, block)
    need = mechanisms.select("mechanism_id", F.size(F.filter(F.coalesce("required", F.array().cast("array<array<string>>")), lambda g: F.exists(g, lambda x: F.btrim(x) != ""))).alias("_need"))
    side = F.broadcast if few else (lambda df: df)
    met = hits.join(side(look.join(phrases, "phrase")), "phrase_id")
    s = met.groupBy(key, "mechanism_id").agg(F.sum("weight").alias("score"), F.sort_array(F.collect_set("shown")).alias("matches"), F.size(F.collect_set("need")).alias("_met"))
    return s.join(side(need), "mechanism_id").where("_met = _need").select(key, "mechanism_id", "score", "matches")


def _numbered(phrases: DataFrame) -> DataFrame:
    """phrase_id 0, 1, ... by order of the phrases; a lexicon's range partitions are counted first, so no task sees it whole."""
    part = phrases.repartitionByRange("phrase").sortWithinPartitions("phrase").select("phrase", F.spark_partition_id().alias("_p"), F.monotonically_increasing_id().alias("_m"))
    part = cut(part, "ranges")
    sizes = part.groupBy("_p").agg(F.count(F.lit(1)).alias("_n"), F.min("_m").alias("_first"))
    w = Window.orderBy("_p").rowsBetween(Window.unboundedPreceding, -1)  # one row for each partition
    start = sizes.select("_p", "_first", F.coalesce(F.sum("_n").over(w), F.lit(0)).alias("_start"))
    return part.join(F.broadcast(start), "_p").select((F.col("_start") + F.col("_m") - F.col("_first")).alias("phrase_id"), "phrase")


def ranked_mechanisms(scores: DataFrame, key: str, least: float) -> DataFrame:
    """Mechanisms of each item that reach ``least``, best first, by id on ties: adds ``place`` from 1."""
    w = Window.partitionBy(key).orderBy(F.col("score").desc(), "mechanism_id")
    return scores.where(F.col("score") >= least).withColumn("place", F.row_number().over(w))


def lexicon_of(spark: SparkSession, rows: list[tuple]) -> DataFrame:
    """A lexicon from (mechanism_id, family, keywords, aliases, required)."""
    return spark.createDataFrame(rows, "mechanism_id string, family string, keywords array<string>, aliases array<string>, required array<array<string>>")

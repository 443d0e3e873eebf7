"""Review pipelines: ladders, gaps, gates, lexicon attribution."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def miss_state(rank: Column, covered: Column, budget: int) -> Column:
    return F.when(~covered, "coverage_gap").when(rank > budget, "below_budget").when(rank.isNull(), "no_overlap").otherwise("unexpected")


def size_bucket(n: Column, bounds: list[int]) -> Column:
    c = F.when(n.isNull(), "unknown")
    for b in bounds:
        c = c.when(n < b, f"lt_{b}")
    return c.otherwise(f"ge_{bounds[-1]}")


def validate(df: DataFrame, rules: list[tuple[Column, str]]) -> DataFrame:
    """Add ``errors`` (codes in rule order) and ``valid``."""
    errors = F.array_compact(F.array(*[F.when(bad, F.lit(code)) for bad, code in rules]))
    return df.withColumn("errors", errors).withColumn("valid", F.size("errors") == 0)


def actionability(filled: list[Column], text_only: Column | None = None) -> Column:
    """Share of required fields that are filled; null, not 0, for a row of text alone, which has no such fields."""
    share = sum((c.cast("int") for c in filled), F.lit(0)) / F.lit(float(len(filled)))
    return share if text_only is None else F.when(~text_only, share)


def claims(df: DataFrame, key: str, rates: list[str], least: float) -> DataFrame:
    """Budgets whose delta rate reaches the threshold."""
    return df.unpivot([key], rates, "budget", "delta_rate").where(F.col("delta_rate") >= least)


def release_gate(df: DataFrame, by: str, member: str, supported: str) -> DataFrame:
    """Supported and total members, the unsupported ones sorted, blocker codes."""
    g = df.groupBy(by).agg(
        F.count(F.lit(1)).alias("total"), F.count_if(supported).alias("supported"),
        F.array_sort(F.collect_set(F.when(~F.col(supported), F.col(member)))).alias("unsupported"),
    )
    blockers = F.array_compact(F.array(F.when(F.col("supported") < F.col("total"), "unsupported_members"), F.when(F.col("total") < 3, "too_few_members")))
    return g.withColumn("blockers", blockers)


#: A lexicon of up to so many words is broadcast; a larger one joins by shuffle.
BROADCAST_WORDS = 200_000


def lexicon_scores(items: DataFrame, key: str, tokens: str, lexicon: DataFrame) -> DataFrame:
    """Weighted keyword score of each (item, mechanism).

    ``lexicon``: mechanism_id, word, weight, required. A mechanism scores 0
    where one of its required words is absent. Items meet the lexicon by word,
    an equi-join on the lexicon's few words.
    """
    known = lexicon.select("word").distinct()
    few = known.limit(BROADCAST_WORDS + 1).count() <= BROADCAST_WORDS
    side = F.broadcast if few else (lambda df: df)
    words = items.select(key, F.explode(F.array_distinct(tokens)).alias("word"))
    hit = words.join(side(lexicon), "word")
    need = lexicon.where("required").groupBy("mechanism_id").agg(F.countDistinct("word").alias("_need"))
    s = hit.groupBy(key, "mechanism_id").agg(F.sum("weight").alias("score"), F.count_if("required").alias("_have"))
    s = s.join(side(need), "mechanism_id", "left")
    return s.select(key, "mechanism_id", F.when(F.coalesce("_need", F.lit(0)) > F.col("_have"), 0.0).otherwise(F.col("score")).alias("score"))


def attribute(scores: DataFrame, key: str) -> DataFrame:
    """The best mechanism of each item, smallest id on ties; nothing where all score 0."""
    w = Window.partitionBy(key).orderBy(F.col("score").desc(), "mechanism_id")
    return scores.where("score > 0").withColumn("_rn", F.row_number().over(w)).where("_rn = 1").drop("_rn")


def multiset_difference(sent: DataFrame, back: DataFrame) -> DataFrame:
    """Ids sent but not returned, and returned but not sent, repeats counted."""
    a = sent.exceptAll(back).withColumn("side", F.lit("missing"))
    return a.unionByName(back.exceptAll(sent).withColumn("side", F.lit("extra")))

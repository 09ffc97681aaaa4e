"""Training statistics: distributed aggregations over a corpus."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from loomtok.config import DIVERSITY_WEIGHT, ENTROPY_WEIGHT, FREQUENCY_WEIGHT
from loomtok.functions.text import split_whitespace


def word_counts(docs: DataFrame) -> DataFrame:
    """word, cnt: partial counts before the shuffle, so that it carries distinct words."""
    return docs.select(F.explode(split_whitespace(F.col("text"))).alias("word")).groupBy("word").agg(F.count("*").alias("cnt"))


def pair_counts(words: DataFrame) -> DataFrame:
    """lch, rch, cnt of adjacent characters, each word once, weighed by its count."""
    chars = F.split("word", "")
    pairs = F.transform(F.sequence(F.lit(1), F.length("word") - 1), lambda i: F.struct(F.element_at(chars, i).alias("l"), F.element_at(chars, i + 1).alias("r")))
    return words.where(F.length("word") > 1).select("cnt", F.explode(pairs).alias("p")).groupBy(F.col("p.l").alias("lch"), F.col("p.r").alias("rch")).agg(F.sum("cnt").alias("cnt"))


def token_pair_counts(words: DataFrame) -> DataFrame:
    """l, r, cnt over words(toks ARRAY<INT>, cnt)."""
    n = F.size("toks")
    pairs = F.transform(F.sequence(F.lit(1), n - 1), lambda i: F.struct(F.element_at("toks", i).alias("l"), F.element_at("toks", i + 1).alias("r")))
    return words.where(n > 1).select("cnt", F.explode(pairs).alias("p")).groupBy("p.l", "p.r").agg(F.sum("cnt").alias("cnt"))


def char_entropy(docs: DataFrame) -> DataFrame:
    """ch, cnt, p, entropy over every character, white space too."""
    counts = docs.select(F.explode(F.split("text", "")).alias("ch")).where("ch <> ''").groupBy("ch").agg(F.count("*").alias("cnt"))
    p = F.col("cnt") / F.sum("cnt").over(Window.partitionBy(F.lit(0)))  # an alphabet, not the corpus
    return counts.withColumn("p", p).withColumn("entropy", -F.col("p") * F.log2("p"))


def token_entropy(tokens: DataFrame, entropies: DataFrame) -> DataFrame:
    """token, entropy: the mean over its characters, unknown ones as 0."""
    chars = tokens.select("token", F.posexplode(F.split("token", "")).alias("pos", "ch")).where("ch <> ''")
    return chars.join(F.broadcast(entropies.select("ch", "entropy")), "ch", "left").groupBy("token").agg(F.avg(F.coalesce("entropy", F.lit(0.0))).alias("entropy"))


def pair_diversity(words: DataFrame) -> DataFrame:
    """lch, rch, diversity: how many distinct pairs stand one or two places away in some word, both ways."""
    chars = F.split("word", "")
    pairs = words.where(F.length("word") > 2).select(F.transform(F.sequence(F.lit(1), F.length("word") - 1), lambda i: F.concat(F.element_at(chars, i), F.element_at(chars, i + 1))).alias("p"))
    near = pairs.select(F.explode(F.flatten(F.transform("p", lambda x, i: F.transform(F.slice("p", i + 2, 2), lambda y: F.struct(x.alias("a"), y.alias("b")))))).alias("x")).select("x.a", "x.b").distinct()
    both = near.union(near.select("b", "a")).groupBy("a").agg(F.countDistinct("b").alias("diversity"))
    return both.select(F.substring("a", 1, 1).alias("lch"), F.substring("a", 2, 1).alias("rch"), "diversity")


def diversity_score(n: Column) -> Column:
    return F.log1p(F.coalesce(n, F.lit(0)))


def merge_score(count: Column, left: Column, right: Column, diversity: Column) -> Column:
    """From a pair's count, the entropies of both sides and the diversity score."""
    return FREQUENCY_WEIGHT * F.log(count + 2) + ENTROPY_WEIGHT * (left + right) / 2 + DIVERSITY_WEIGHT * diversity


def pair_scores(pairs: DataFrame, entropies: DataFrame, min_frequency: int = 2, diversity: DataFrame | None = None) -> DataFrame:
    """lch, rch, cnt, score of the candidates; without diversity it counts as 0, as in the first queue."""
    e = F.broadcast(entropies.select("ch", "entropy"))  # an alphabet
    scored = pairs.where(F.col("cnt") >= min_frequency)
    scored = scored.join(e.select(F.col("ch").alias("lch"), F.col("entropy").alias("le")), "lch").join(e.select(F.col("ch").alias("rch"), F.col("entropy").alias("re")), "rch")
    d = F.lit(0.0)
    if diversity is not None:
        scored, d = scored.join(diversity, ["lch", "rch"], "left"), diversity_score(F.col("diversity"))
    return scored.select("lch", "rch", "cnt", merge_score(F.col("cnt"), F.col("le"), F.col("re"), d).alias("score"))


def top_candidates(scores: DataFrame, k: int) -> DataFrame:
    """The k best, ties to the larger pair; a top-k operator, not a sort."""
    return scores.orderBy(F.desc(F.round("score", 6)), F.desc("lch"), F.desc("rch")).limit(k)


def token_utility(priority: Column, token: Column) -> Column:
    return F.log1p(priority) * (1 + F.octet_length(token) / 10.0)

"""Measures over encoded tables, timings, synthetic text and a sink for results."""

from __future__ import annotations

import json
import resource
import time
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Parts that the words of synthetic texts are made of.
_ONSETS, _ENDS = ("b", "dr", "f", "k", "l", "m", "pl", "s", "t", "v"), ("a", "en", "il", "o", "ur")


def compression(encoded: DataFrame, *by: str, text: str = "text", ids: str = "ids") -> DataFrame:
    """n_docs, n_chars, n_bytes, n_tokens and characters a token, of all or of groups."""
    n, chars = F.sum(F.size(ids).cast("long")), F.sum(F.length(text).cast("long"))
    return encoded.groupBy(*by).agg(F.count("*").alias("n_docs"), chars.alias("n_chars"), F.sum(F.octet_length(text).cast("long")).alias("n_bytes"), n.alias("n_tokens"), (chars / n).alias("chars_per_token"))


def token_frequency(encoded: DataFrame, k: int, ids: str = "ids") -> DataFrame:
    return encoded.select(F.explode(ids).alias("id")).groupBy("id").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "id").limit(k)


def distinct_tokens(encoded: DataFrame, ids: str = "ids", error: float = 0.01) -> DataFrame:
    """How many different ids occur, about."""
    return encoded.select(F.explode(ids).alias("id")).agg(F.approx_count_distinct("id", error).alias("n_distinct"))


def timings(spark: SparkSession, action: Callable[[], object], times: int = 5) -> DataFrame:
    """Mean and deviation, in milliseconds, of an action run several times after once."""
    action()
    took = []
    for _ in range(times):
        began = time.perf_counter()
        action()
        took.append((1000 * (time.perf_counter() - began),))
    return spark.createDataFrame(took, "ms double").agg(F.avg("ms").alias("mean_ms"), F.stddev_pop("ms").alias("std_ms"), F.count("*").alias("n"))


def throughput(encoded: DataFrame, text: str = "text", ids: str = "ids") -> dict[str, float]:
    """Tokens, characters and megabytes a second of computing the ids of a table."""
    began = time.perf_counter()
    r = compression(encoded, text=text, ids=ids).first()
    s = time.perf_counter() - began
    return {"tokens_per_s": (r.n_tokens or 0) / s, "chars_per_s": (r.n_chars or 0) / s, "mb_per_s": (r.n_bytes or 0) / 1e6 / s, "seconds": s}


def memory_mb() -> float:
    """The driver's largest resident size so far."""
    return resource.getrusage(resource.RUSAGE_SELF).ru_maxrss / 1024


def synthetic_text(spark: SparkSession, docs: int, words: int, seed: int = 0) -> DataFrame:
    """doc_id, text: texts of so many words of one to three syllables, made where they are used."""
    syllables = [a + b for a in _ONSETS for b in _ENDS]
    number = F.pmod(F.xxhash64("doc_id", "at", F.lit(seed)), F.lit(3 * len(syllables) ** 2))
    of = lambda n: F.get(F.array(*map(F.lit, syllables)), F.pmod(n, F.lit(len(syllables))).cast("int"))
    pick = F.concat(of(number), F.when(number % 3 > 0, of(F.floor(number / 150))).otherwise(""), F.when(number % 3 > 1, of(F.floor(number / 7))).otherwise(""))
    at = spark.range(docs).withColumnRenamed("id", "doc_id").select("doc_id", F.explode(F.sequence(F.lit(1), F.lit(words))).alias("at"))
    return at.groupBy("doc_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("at", pick.alias("w")))), lambda x: x["w"]), " ").alias("text"))


def save_results(results: dict, path: str) -> None:
    with open(path, "w", encoding="utf-8") as f:
        json.dump(results, f, indent=2)

"""The bounded sample of labelled rows that classifiers are fitted on."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomtok.llm.common import crc_mod

#: Labelled ids that a fit sees at most; and in how many folds one is kept out of every fit.
SAMPLE, FOLDS = 20_000, 5


def labelled_sample(docs: DataFrame, labels: DataFrame, label: str, most: int = SAMPLE) -> DataFrame:
    """doc_id, text and y of at most `most` labelled ids outside fold 0, one row each. Rows without id or label aren't used.

    Of more ids those stay whose hash is a multiple of a number that leaves
    nine tenths of `most`; the limit only holds that bound for certain. Of rows
    that share an id the one of the least text hash teaches.
    """
    known = labels.where(F.col("doc_id").isNotNull() & F.col(label).isNotNull() & (crc_mod("doc_id", FOLDS) != 0))
    known = known.groupBy("doc_id").agg(F.max(label).cast("int").alias("y"))
    n = known.count()
    chosen = known if n <= most else known.where(F.pmod(F.xxhash64("doc_id"), F.lit(-(-10 * n // (9 * most)))) == 0).limit(most)
    found = docs.select("doc_id", "text").join(F.broadcast(chosen), "doc_id")  # `most` pairs of numbers
    return found.groupBy("doc_id").agg(F.min_by("text", F.xxhash64("text")).alias("text"), F.first("y").alias("y"))

"""From documents to packed sequences, one operator after the other.

Every stage reads what the one before it wrote, and works on all of it.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from loomtok.llm.common import materialize, table
from loomtok.llm.decontaminate import without_matches
from loomtok.llm.jaccard import keep_one
from loomtok.llm.packing import pack
from loomtok.llm.pii import mask
from loomtok.llm.quality_classifier import fit, keep


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops what the rule ensemble, fitted on the labels, predicts to be of no quality.

    Null and empty texts are scored as empty; rows with one id are judged each;
    columns of docs stay as they are, whatever their names.
    """
    return keep(docs, fit(docs, table(spark, sf_dir, "labels")))


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps one row of each group of near copies: word 5-shingles of Jaccard 0.8 or more, exactly.

    SimHash proposes pairs, which are checked; a prefix filter completes them.
    The row of the least id stays, null ids last, any one of those with that id.
    Null, empty and wordless texts are one group. Equal rows are near copies.
    """
    return keep_one(docs)


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents that hold an item of the benchmark; null and empty texts hold none, and no items drop nothing."""
    return without_matches(docs, table(spark, sf_dir, "benchmark"))


def pii(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Replaces personal data by its kind; n_chars stays as it was in the source, and null and empty texts stay."""
    return mask(docs)


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Packs the token ids; a row for each piece. Null and empty texts are the end id; repeated rows are packed each."""
    return pack(docs, public_tokenizers.path("byte_bpe_50k.json"))


STAGES = [
    ("quality_classifier", quality),
    ("simhash_near_dedup", near_dedup),
    ("benchmark_decontamination", decontaminate),
    ("pii", pii),
    ("best_fit_packing", packing),
]

#: A fitted classifier, connected components and packing are beyond SQL; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = materialize(stage(spark, docs, sf_dir), name)
    return docs

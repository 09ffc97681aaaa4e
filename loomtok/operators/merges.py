"""Merge-rule operators over merges(l INT, r INT, rank INT, new_id INT)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

SCHEMA = "l int, r int, rank int, new_id int"
NO_ID = 2**32 - 1


def upsert(merges: DataFrame, new: DataFrame) -> DataFrame:
    """The last rule of a pair wins; new carries seq, the order of arrival."""
    both = merges.withColumn("seq", F.lit(-1).cast("long")).unionByName(new)
    return both.groupBy("l", "r").agg(F.max_by(F.struct("rank", "new_id"), "seq").alias("x")).select("l", "r", "x.rank", "x.new_id")


def lookup(merges: DataFrame, pairs: DataFrame) -> DataFrame:
    return pairs.join(merges, ["l", "r"], "left")


def before(rank1: Column, rank2: Column) -> Column:
    """Whether the first rule goes before: the lower rank, and present before absent."""
    return F.coalesce(rank1 < rank2, rank1.isNotNull() & rank2.isNull())


def from_pairs(pairs: Column) -> Column:
    """Rules of an array of structs (l, r): rank is the index, without ids."""
    return F.transform(pairs, lambda p, i: F.struct(p["l"].alias("l"), p["r"].alias("r"), i.alias("rank"), F.lit(NO_ID).alias("new_id")))


def stats(merges: DataFrame) -> DataFrame:
    zero = F.lit(0)
    return merges.agg(F.count("*").alias("n"), F.coalesce(F.min("rank"), zero).alias("min_rank"), F.coalesce(F.max("rank"), zero).alias("max_rank"))

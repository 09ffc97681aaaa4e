"""Vocabulary operators over vocab(id INT, token STRING)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from loomtok.config import SPECIAL_ORDER, InvalidConfigError, SpecialTokensConfig

SCHEMA = "id int, token string"


def empty(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([], SCHEMA)


def add_tokens(vocab: DataFrame, tokens: DataFrame, order: str = "ord") -> DataFrame:
    """Appends tokens (token, order) not yet there; new ids follow the size in that order.

    Ranks are one window over new tokens, whose number a vocabulary bounds.
    """
    new = tokens.groupBy("token").agg(F.min(order).alias(order)).join(vocab.select("token"), "token", "left_anti")
    size = vocab.agg(F.count("*").cast("int").alias("size"))
    ranked = new.select("token", (F.row_number().over(Window.orderBy(order, "token")) - 1).alias("k"))
    return vocab.select("id", "token").unionByName(ranked.join(F.broadcast(size)).select((F.col("size") + F.col("k")).cast("int").alias("id"), "token"))


def add_tokens_with_ids(vocab: DataFrame, tokens: DataFrame) -> DataFrame:
    """Appends (id, token); an id taken twice is an error."""
    out = vocab.select("id", "token").unionByName(tokens.select("id", "token"))
    if out.groupBy("id").count().where("count > 1").limit(1).count():
        raise InvalidConfigError("id already in use")
    return out


def special_rows(spark: SparkSession, config: SpecialTokensConfig) -> DataFrame:
    """name, token, ord of the configured special tokens in their fixed order."""
    rows = [(k, v, SPECIAL_ORDER.index(k)) for k, v in config.configured()]
    return spark.createDataFrame(rows, "name string, token string, ord int")


def get_ids(vocab: DataFrame, wanted: DataFrame) -> DataFrame:
    return wanted.join(vocab, "token", "left")


def get_tokens(vocab: DataFrame, wanted: DataFrame) -> DataFrame:
    return wanted.join(vocab, "id", "left")


def size(vocab: DataFrame) -> int:
    return vocab.count()


def is_special(c: Column, ids: list[int]) -> Column:
    return c.isin(ids)


def byte_completion(vocab: DataFrame) -> DataFrame:
    """Appends, in order, the bytes that no token spells alone; vocab has hex, the token's bytes in hex."""
    every = vocab.sparkSession.range(256).select(F.lpad(F.hex("id"), 2, "0").alias("hex"))
    new = every.join(vocab.select("hex"), "hex", "left_anti")
    size = vocab.agg(F.count("*").cast("int").alias("size"))
    ranked = new.select("hex", (F.row_number().over(Window.orderBy("hex")) - 1).alias("k"))
    return vocab.select("id", "hex").unionByName(ranked.join(F.broadcast(size)).select((F.col("size") + F.col("k")).cast("int").alias("id"), "hex"))


def base_characters(docs: DataFrame) -> DataFrame:
    """id, ch: the distinct characters of docs (doc_id, text), in the order in which the corpus first shows them.

    The first place of a character is a partial aggregate, so that what is
    shuffled and ranked is the alphabet.
    """
    seen = docs.select("doc_id", F.posexplode(F.split("text", "")).alias("pos", "ch")).where("ch <> ''")
    first = seen.groupBy("ch").agg(F.min(F.struct("doc_id", "pos")).alias("at"))
    return first.select((F.row_number().over(Window.orderBy("at")) - 1).cast("int").alias("id"), "ch")


def token_strings(merges: DataFrame, vocab: DataFrame) -> DataFrame:
    """rank, l, r, token of each merge, by two joins with the vocabulary."""
    left, right = vocab.select(F.col("id").alias("l"), F.col("token").alias("tl")), vocab.select(F.col("id").alias("r"), F.col("token").alias("tr"))
    return merges.join(left, "l").join(right, "r").select("rank", "l", "r", F.concat("tl", "tr").alias("token"))

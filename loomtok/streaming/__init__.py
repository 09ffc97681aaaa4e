"""Streams: encoding and decoding are stateless and run unchanged; counts of tokens keep state."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loomtok.model import Model
from loomtok.operators.encoding import encode


def read_stream(spark: SparkSession, path: str, schema, files: int = 16) -> DataFrame:  # noqa: ANN001
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files).parquet(path)


def encode_stream(stream: DataFrame, model: Model, column: str = "text") -> DataFrame:
    return encode(stream, model, column)


def running_token_counts(stream: DataFrame, model: Model, column: str = "text") -> DataFrame:
    """id, n over all that has arrived; the state is as large as the vocabulary."""
    return encode(stream.select(column), model, column).select(F.explode("ids").alias("id")).groupBy("id").agg(F.count("*").alias("n"))


def windowed_tokens(stream: DataFrame, model: Model, time: str, column: str, window: str = "1 hour", late: str = "2 hours") -> DataFrame:
    """Tokens of each window of event time; the watermark bounds the state and drops what comes later."""
    timed = encode(stream.select(F.col(time).cast("timestamp").alias(time), column).withWatermark(time, late), model, column)
    return timed.groupBy(F.window(time, window).alias("w")).agg(F.sum(F.size("ids")).alias("n_tokens"), F.count("*").alias("n")).select("w.start", "w.end", "n_tokens", "n")

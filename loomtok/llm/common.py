"""Helpers shared by the training-data operators."""

from __future__ import annotations

import os
import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: A word is a maximal run of anything but these bytes, as bytes.split() has it.
WORD = r"[^\x20\x09-\x0D]+"
#: While a table is written: its shuffle files go with the write, and batches for Python hold few bytes, however long the texts.
_WRITING = {"spark.sql.classic.shuffleDependency.fileCleanup.enabled": "true", "spark.sql.execution.arrow.maxBytesPerBatch": "16m"}
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def ascii_lower(c: Column) -> Column:
    """A-Z only, unlike lower()."""
    return F.translate(c, _UPPER, _LOWER)


def shared_dir(spark: SparkSession) -> str:
    """The cluster's shared folder. Where the session names none: a temporary one in local mode, else an error, since a folder of one machine would lose rows."""
    at = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    named = spark.sparkContext._jsc.sc().getCheckpointDir()
    if not at and named.isDefined():
        at = named.get()
    if not at:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        at = f"file://{tempfile.gettempdir()}/loomtok-{os.getpid()}"
    return at.rstrip("/")


def materialize(df: DataFrame, name: str, compression: str = "snappy") -> DataFrame:
    """Writes df as a table in the shared folder and reads it again: cuts lineage, survives lost executors.

    All tables of an application are below loomtok/<its id>, to be removed with
    it. The shuffles behind the table aren't needed once it stands, and their
    files go with the write.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/loomtok/{spark.sparkContext.applicationId}/{name}-{uuid.uuid4().hex}"
    before = {k: spark.conf.get(k) for k in _WRITING}
    try:
        for k, v in _WRITING.items():
            spark.conf.set(k, v)
        df.write.option("compression", compression).parquet(path)
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)
    return spark.read.schema(df.schema).parquet(path)


def shuffle_partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def crc_mod(column: str, n: int) -> Column:
    """crc32 of the id as text, modulo n; a null id counts as the empty text."""
    return F.crc32(F.coalesce(F.col(column).cast("string"), F.lit("")).cast("binary")) % n

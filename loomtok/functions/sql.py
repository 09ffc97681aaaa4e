"""SQL functions of a model: bpe_encode, bpe_decode, bpe_count and the table function bpe_tokens."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from loomtok.model import Model
from loomtok.operators.decoding import decode_ids
from loomtok.operators.encoding import Encoder


def register(spark: SparkSession, model: Model) -> None:
    """Registers the four functions; the model goes to workers as a broadcast."""
    shared = spark.sparkContext.broadcast(model)

    @F.pandas_udf("array<int>")
    def bpe_encode(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        encoder = Encoder(shared.value)
        for s in batches:
            yield s.map(lambda x: None if x is None else np.frombuffer(encoder(x), "<i4"))

    @F.pandas_udf("long")
    def bpe_count(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        encoder = Encoder(shared.value)
        for s in batches:
            yield s.map(lambda x: None if x is None else len(encoder(x)) // 4).astype("Int64")

    @F.pandas_udf("string")
    def bpe_decode(s: pd.Series) -> pd.Series:
        return s.map(lambda x: None if x is None else decode_ids(shared.value, list(x)))

    @F.udtf(returnType="pos int, id int, token string")
    class BpeTokens:
        def __init__(self) -> None:
            self.encoder = Encoder(model)

        def eval(self, text: str):  # noqa: ANN201
            if text is not None:
                for pos, i in enumerate(np.frombuffer(self.encoder(text), "<i4").tolist()):
                    yield pos, i, model.tokens[i].decode("utf-8", "replace")

    for name, f in (("bpe_encode", bpe_encode), ("bpe_count", bpe_count), ("bpe_decode", bpe_decode)):
        spark.udf.register(name, f)
    spark.udtf.register("bpe_tokens", BpeTokens)

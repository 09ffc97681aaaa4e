"""The tokenizer for users: train, encode, decode, save and load, over DataFrames and single texts."""

from __future__ import annotations

from dataclasses import replace

import numpy as np
from pyspark.sql import DataFrame, SparkSession

from loomtok import __version__
from loomtok.config import EncodingMode, SpecialTokensConfig, TokenizerConfig, TrainingConfig, UnknownTokenError
from loomtok.model import Model
from loomtok.operators import decoding, encoding, training
from loomtok.sources import models


class Encoding:
    """Ids and the text they came from."""

    def __init__(self, ids: list[int], text: str) -> None:
        self.ids, self.text = ids, text

    def __len__(self) -> int:
        return len(self.ids)

    def is_empty(self) -> bool:
        return not self.ids

    def get_tokens(self) -> list[str]:
        return [str(i) for i in self.ids]


class Tokenizer:
    def __init__(self, config: TokenizerConfig | None = None, model: Model | None = None) -> None:
        self.config = model.config if model else config or TokenizerConfig()
        self._use(model or Model.untrained(self.config))

    def _use(self, model: Model) -> None:
        self.model, self._encoder = model, encoding.Encoder(model)

    @staticmethod
    def builder() -> TokenizerBuilder:
        return TokenizerBuilder()

    @property
    def name(self) -> str:
        return "loomtok"

    @property
    def vocab_size(self) -> int:
        return len(self.model.tokens)

    n_vocab = vocab_size

    @property
    def max_token_value(self) -> int:
        return len(self.model.tokens) - 1

    def __repr__(self) -> str:
        return f"Tokenizer(vocab_size={self.vocab_size}, mode={self.config.encoding_mode}, version={__version__})"

    def fit(self, docs: DataFrame, text: str = "text", key: str = "doc_id", training_config: TrainingConfig | None = None) -> Tokenizer:
        """Trains on a table and gives the tokenizer back."""
        self._use(training.fit(docs.selectExpr(f"`{key}` AS doc_id", f"`{text}` AS text"), self.config, training_config))
        return self

    def train(self, spark: SparkSession, text: str) -> Tokenizer:
        return self.fit(spark.createDataFrame([(0, text)], "doc_id long, text string"))

    def encode(self, text: str, add_special_tokens: bool = True) -> list[int]:
        ids = np.frombuffer(self._encoder(text), "<i4").tolist()
        s = self.model.specials
        return ([s["bos"]] if add_special_tokens and "bos" in s else []) + ids + ([s["eos"]] if add_special_tokens and "eos" in s else [])

    def encode_full(self, text: str, add_special_tokens: bool = True) -> Encoding:
        return Encoding(self.encode(text, add_special_tokens), text)

    def encode_ordinary(self, text: str) -> list[int]:
        return self.encode(text, False)

    def encode_batch(self, texts: list[str], add_special_tokens: bool = True) -> list[list[int]]:
        return [self.encode(x, add_special_tokens) for x in texts]

    def encode_ordinary_batch(self, texts: list[str]) -> list[list[int]]:
        return self.encode_batch(texts, False)

    def encode_single_token(self, token: str | bytes) -> int:
        raw = token.encode() if isinstance(token, str) else token
        raw.decode()  # a ValueError where it isn't UTF-8
        if raw not in self.model.ids:
            raise UnknownTokenError(token)
        return self.model.ids[raw]

    def decode(self, ids: list[int], skip_special_tokens: bool = False) -> str:
        if not all(isinstance(i, (int, np.integer)) for i in ids):
            raise ValueError("ids must be integers")
        return decoding.decode_ids(self.model, list(ids), skip_special_tokens)

    def decode_batch(self, many: list[list[int]]) -> list[str]:
        return [self.decode(x) for x in many]

    def decode_single_token_bytes(self, i: int) -> bytes:
        return decoding.single_token_bytes(self.model, i)

    def decode_with_offsets(self, ids: list[int]) -> tuple[str, list[int]]:
        return self.decode(ids), decoding.offsets(self.model, ids)

    def encode_frame(self, df: DataFrame, column: str = "text", out: str = "ids", add_special_tokens: bool = False) -> DataFrame:
        return encoding.encode(df, self.model, column, out, add_special_tokens)

    def decode_frame(self, df: DataFrame, column: str = "ids", out: str = "decoded", skip_special_tokens: bool = False) -> DataFrame:
        return decoding.decode(df, self.model, column, out, skip_special_tokens)

    def save(self, folder: str, form: str = "json") -> None:
        (models.save_pair if form == "huggingface" else models.save_json)(self.model, folder)

    @classmethod
    def load(cls, folder: str) -> Tokenizer:
        return cls(model=models.load_json(folder))

    @classmethod
    def load_huggingface(cls, folder: str) -> Tokenizer:
        return cls(model=models.load_pair(folder))


class TokenizerBuilder:
    def __init__(self) -> None:
        self._config = TokenizerConfig()

    def _with(self, **changes) -> TokenizerBuilder:  # noqa: ANN003
        self._config = replace(self._config, **changes)
        return self

    def vocab_size(self, n: int) -> TokenizerBuilder:
        return self._with(vocab_size=n)

    def min_frequency(self, n: int) -> TokenizerBuilder:
        return self._with(min_frequency=n)

    def encoding_mode(self, mode: EncodingMode) -> TokenizerBuilder:
        return self._with(encoding_mode=mode)

    def with_special_tokens(self, specials: SpecialTokensConfig) -> TokenizerBuilder:
        return self._with(special_tokens=specials)

    def canonical(self, on: bool = True) -> TokenizerBuilder:
        return self._with(canonical=on)

    def build(self) -> Tokenizer:
        return Tokenizer(self._config)

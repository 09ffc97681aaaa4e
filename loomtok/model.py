"""A tokenizer model: tokens as bytes, merge rules in order of rank, special tokens."""

from __future__ import annotations

from dataclasses import dataclass, field
from functools import cached_property

from pyspark.sql import DataFrame, SparkSession

from loomtok.config import TokenizerConfig


@dataclass
class Model:
    config: TokenizerConfig
    #: Token bytes by id; ids are dense.
    tokens: list[bytes]
    #: special, char, merge or byte, by id.
    kinds: list[str]
    #: (l, r, new id) by rank.
    merges: list[tuple[int, int, int]] = field(default_factory=list)
    #: Ids of the configured special tokens by name.
    specials: dict[str, int] = field(default_factory=dict)

    @classmethod
    def untrained(cls, config: TokenizerConfig) -> Model:
        """Special tokens first, then all bytes in order."""
        named = config.special_tokens.configured()
        tokens = [v.encode() for _, v in named] + [bytes([b]) for b in range(256)]
        return cls(config, tokens, ["special"] * len(named) + ["byte"] * 256, [], {k: i for i, (k, _) in enumerate(named)})

    @cached_property
    def byte_ids(self) -> list[int]:
        at = {t: i for i, (t, k) in enumerate(zip(self.tokens, self.kinds, strict=True)) if len(t) == 1 and k != "special"}
        return [at[bytes([b])] for b in range(256)]

    @cached_property
    def ids(self) -> dict[bytes, int]:
        return {t: i for i, t in reversed(list(enumerate(self.tokens)))}

    @cached_property
    def special_ids(self) -> set[int]:
        return set(self.specials.values())

    def vocab_frame(self, spark: SparkSession) -> DataFrame:
        rows = [(i, t.decode("utf-8", "replace"), bytearray(t), k) for i, (t, k) in enumerate(zip(self.tokens, self.kinds, strict=True))]
        return spark.createDataFrame(rows, "id int, token string, bytes binary, kind string")

    def merges_frame(self, spark: SparkSession) -> DataFrame:
        rows = [(rank, a, b, n, self.tokens[n].decode("utf-8", "replace")) for rank, (a, b, n) in enumerate(self.merges)]
        return spark.createDataFrame(rows, "rank int, l int, r int, new_id int, token string")

"""Configuration, modes, special tokens and errors."""

from __future__ import annotations

from dataclasses import asdict, dataclass, field
from enum import Enum

VERSION = "1.0"
#: Fixed values of the data model.
MAX_TEXT_BYTES = 10_000_000
SPECIAL_ORDER = ("pad", "unk", "bos", "eos", "mask", "user", "assistant", "system")
SWEEP_RANKS, SWEEPS, RECOUNT = 1000, 3, 100
FREQUENCY_WEIGHT, ENTROPY_WEIGHT, DIVERSITY_WEIGHT, UTILITY_THRESHOLD = 0.6, 0.3, 0.1, 0.01


class LoomError(Exception):
    """Base of the engine's errors."""


class TokenizerError(LoomError):
    """A text can't be tokenized."""


class InvalidConfigError(LoomError, ValueError):
    """A setting is out of range."""


class UnknownTokenIdError(LoomError, KeyError):
    """No token has this id."""


class UnknownTokenError(LoomError, KeyError):
    """No id has this token."""


class LoadError(LoomError):
    """A model can't be read."""


class SaveError(LoomError):
    """A model can't be written."""


class EncodingMode(Enum):
    BYTE_LEVEL = "ByteLevel"
    CHAR_LEVEL = "CharLevel"
    HYBRID = "Hybrid"

    def __str__(self) -> str:
        return self.value


@dataclass
class SpecialTokensConfig:
    pad: str | None = None
    unk: str | None = None
    bos: str | None = None
    eos: str | None = None
    mask: str | None = None
    user: str | None = None
    assistant: str | None = None
    system: str | None = None

    def configured(self) -> list[tuple[str, str]]:
        """(name, literal) of those set, in the fixed order."""
        return [(k, getattr(self, k)) for k in SPECIAL_ORDER if getattr(self, k) is not None]

    def to_dict(self) -> dict[str, str | None]:
        return asdict(self)


@dataclass
class TokenizerConfig:
    vocab_size: int = 30_000
    min_frequency: int = 2
    encoding_mode: EncodingMode = EncodingMode.BYTE_LEVEL
    special_tokens: SpecialTokensConfig = field(default_factory=SpecialTokensConfig)
    #: Min-rank-first merging instead of greedy sweeps; see README.
    canonical: bool = False
    allow_special_literals: bool = False
    max_text_bytes: int = MAX_TEXT_BYTES

    def __post_init__(self) -> None:
        if self.vocab_size < 1:
            raise InvalidConfigError("vocab_size must be positive")
        if self.min_frequency < 1:
            raise InvalidConfigError("min_frequency must be positive")


@dataclass
class TrainingConfig:
    vocab_size: int = 30_000
    min_frequency: int = 2
    #: Exact weighted counts after each merge, instead of those that drift until the recount.
    weighted_deltas: bool = False
    #: Words below this count are left out; above 1 it makes training approximate.
    min_word_count: int = 1
    #: More distinct words than this are an error; None: any number, since they needn't fit the driver.
    max_words: int | None = None

"""Distributed byte-pair-encoding analytics on Spark."""

from importlib import import_module

__version__ = "0.1.0"

_HOMES = {
    "loomtok.tokenizer": ("Encoding", "Tokenizer", "TokenizerBuilder"),
    "loomtok.config": ("EncodingMode", "SpecialTokensConfig", "TokenizerConfig", "TrainingConfig", "LoomError", "TokenizerError", "InvalidConfigError", "UnknownTokenError", "UnknownTokenIdError", "LoadError", "SaveError"),
    "loomtok.model": ("Model",),
    "loomtok.functions.cache": ("EncodingCache",),
}


def __getattr__(name: str) -> object:
    """Loaded when asked for, so that workers import no more than they need."""
    for module, names in _HOMES.items():
        if name in names:
            return getattr(import_module(module), name)
    raise AttributeError(name)

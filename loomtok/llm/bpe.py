"""Byte-level BPE ids by chunk, the unit of both caches.

A text is cut at every space that follows a non-space character. The
pre-tokenizer of the vocabulary always has a boundary there, so the ids of the
chunks, each with its space in front, joined are the ids of the text. Special
strings are cut out first, as the tokenizers library does by default. Chunks
that no cache holds go to tiktoken with the same vocabulary as ranks where
that file lies beside the .json, which is faster and gives the same ids (a test
holds both against each other), and to tokenizers otherwise or when long.
"""

from __future__ import annotations

import base64
import os
import re
from collections.abc import Callable

import numpy as np

#: Longer chunks aren't cached, and go to the library whose merges take n log n.
LONG = 96
#: Chunks in one generation of a worker's cache; two generations are held at most.
CACHED = 250_000
_SPACE_AFTER_SPACE, _CUT = re.compile(r"\s "), re.compile(r"(?<=\S) ")


def chunks(text: str) -> list[str]:
    """The parts between the cuts, without the space of each cut. Only a cut after a non-space is one."""
    if _SPACE_AFTER_SPACE.search(text):
        return _CUT.split(text)
    if text[:1] == " ":
        first, *rest = text[1:].split(" ")
        return [" " + first, *rest]
    return text.split(" ")


class ChunkEncoder:
    """value(ids as little-endian uint32 bytes) of each chunk, through two generations of a bounded cache."""

    def __init__(self, path: str, value: Callable[[bytes], object], frequent: dict | None = None) -> None:
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        self.library, self.value, self.frequent = Tokenizer.from_file(path), value, frequent or {}
        added = self.library.get_added_tokens_decoder()
        self.specials = {x.content: i for i, x in added.items()}
        self.cut = re.compile("(" + "|".join(map(re.escape, sorted(self.specials, key=len, reverse=True))) + ")") if added else None
        self.new: dict[str, object] = {}
        self.old: dict[str, object] = {}
        ranks = path.removesuffix(".json") + ".tiktoken"
        self.quick = None
        if os.path.exists(ranks):
            import public_tokenizers
            import tiktoken

            with open(ranks, "rb") as f:
                merged = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
            self.quick = tiktoken.Encoding("chunks", pat_str=public_tokenizers.PATTERN, mergeable_ranks=merged, special_tokens={})._core_bpe.encode_ordinary

    def _ids(self, text: str) -> bytes:
        ids = self.quick(text) if self.quick and len(text) <= LONG else self.library.encode(text, add_special_tokens=False).ids
        return np.array(ids, dtype="<u4").tobytes()

    def _missed(self, chunk: str) -> object:
        x = self.old.get(chunk)
        if x is None:
            x = self.value(self._ids(" " + chunk))
        if len(chunk) <= LONG:
            if len(self.new) >= CACHED:
                self.old, self.new = self.new, {}
            self.new[chunk] = x
        return x

    def values(self, text: str) -> list:
        """One value for each chunk and each special string of the text, in order."""
        out: list = []
        for i, part in enumerate(self.cut.split(text) if self.cut else (text,)):
            if i % 2:
                out.append(self.value(np.array([self.specials[part]], dtype="<u4").tobytes()))
            elif part:
                first, *rest = chunks(part)
                if first:
                    out.append(self.value(self._ids(first)))
                if rest:
                    often, new, missed = self.frequent.get, self.new.get, self._missed
                    out += [often(c) or new(c) or missed(c) for c in rest] if self.frequent else [self.new.get(c) or missed(c) for c in rest]
        return out

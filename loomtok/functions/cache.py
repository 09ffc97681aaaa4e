"""A cache of encodings for single texts; tables are served by the workers' own."""

from __future__ import annotations

from collections import OrderedDict
from collections.abc import Callable
from dataclasses import dataclass


@dataclass(frozen=True)
class CacheStats:
    size: int
    capacity: int
    hits: int
    misses: int

    @property
    def hit_rate(self) -> float | None:
        return self.hits / (self.hits + self.misses) if self.hits + self.misses else None


class EncodingCache:
    """Keeps the encodings used last, up to a capacity."""

    def __init__(self, capacity: int = 1000) -> None:
        self.capacity, self._held, self._hits, self._misses = max(1, capacity), OrderedDict(), 0, 0

    def get_or_encode(self, text: str, encode: Callable[[str], list[int]]) -> list[int]:
        if text in self._held:
            self._hits += 1
            self._held.move_to_end(text)
            return self._held[text]
        self._misses += 1
        ids = encode(text)
        self.insert(text, ids)
        return ids

    def insert(self, text: str, ids: list[int]) -> None:
        self._held[text] = ids
        self._held.move_to_end(text)
        self._shrink()

    def _shrink(self) -> None:
        while len(self._held) > self.capacity:
            self._held.popitem(last=False)

    def clear(self) -> None:
        self._held.clear()

    def resize(self, capacity: int) -> None:
        self.capacity = max(1, capacity)
        self._shrink()

    def is_empty(self) -> bool:
        return not self._held

    def __len__(self) -> int:
        return len(self._held)

    def stats(self) -> CacheStats:
        return CacheStats(len(self._held), self.capacity, self._hits, self._misses)

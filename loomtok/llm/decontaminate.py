"""Benchmark decontamination by pigeonhole edit matching.

Texts and items are words: lower case, ASCII punctuation as blanks. An item of
m words may differ by k = floor(ERRORS * m) word edits. Cut into k + 1 pieces,
at least one piece of any such match is exact, so an automaton over all pieces
finds every candidate; Myers' bit-parallel distance over words then decides.
"""

from __future__ import annotations

from bisect import bisect_left
from collections.abc import Iterator
from itertools import accumulate

import ahocorasick
import pyarrow as pa
from pyspark.sql import DataFrame

ERRORS = 0.2
#: Bytes of item texts in one automaton; more items take another pass over the texts.
BLOCK = 4_000_000
_PLAIN = bytes(c if c >= 128 or chr(c).isalnum() else 32 for c in range(256))


def normalize(text: str) -> list[str]:
    """Words as latin-1 strings of their UTF-8 bytes."""
    return [w.decode("latin-1") for w in text.lower().encode().translate(_PLAIN).split()]


def myers(pattern: list[str], text: list[str], most: int) -> tuple[int, int] | None:
    """The least edit distance of the pattern to any part of the text, if at most `most`, and where that part ends."""
    m = len(pattern)
    where: dict[str, int] = {}
    for i, w in enumerate(pattern):
        where[w] = where.get(w, 0) | 1 << i
    full, high = (1 << m) - 1, 1 << (m - 1)
    up, down, score, best = full, 0, m, None
    for j, w in enumerate(text):
        eq = where.get(w, 0)
        diagonal = ((((eq & up) + up) ^ up) | eq | down) & full
        plus, minus = (down | ~(diagonal | up)) & full, up & diagonal
        score += bool(plus & high) - bool(minus & high)
        plus, minus = plus << 1 & full, minus << 1 & full
        up, down = (minus | ~(diagonal | plus)) & full, plus & diagonal
        if score <= most and (best is None or score < best[0]):
            best = (score, j + 1)
    return best


class Matcher:
    """Finds the items of one block in texts."""

    def __init__(self, items: list[tuple[object, str]], errors: float = ERRORS) -> None:
        self.items = [(i, w, int(errors * len(w))) for i, t in items if (w := normalize(t))]
        pieces: dict[str, list[tuple[int, int]]] = {}
        for n, (_, words, k) in enumerate(self.items):
            cuts = [len(words) * j // (k + 1) for j in range(k + 2)]
            for a, b in zip(cuts, cuts[1:], strict=False):
                pieces.setdefault(f" {' '.join(words[a:b])} ", []).append((n, a))
        self.pieces = ahocorasick.Automaton()
        for piece, at in pieces.items():
            self.pieces.add_word(piece, (len(piece), at))
        if pieces:
            self.pieces.make_automaton()

    def __call__(self, text: str | None) -> list[tuple[object, int, int, int]]:
        """(item id, distance, first word after the match, words of the item) of each item that the text holds, best match each."""
        if not text or not self.items:
            return []
        plain = b" ".join(text.lower().encode().translate(_PLAIN).split()).decode("latin-1")
        hits = list(self.pieces.iter(f" {plain} "))
        if not hits:
            return []
        words = plain.split(" ")
        starts = list(accumulate((len(w) + 1 for w in words), initial=0))
        tried: set[tuple[int, int]] = set()
        best: dict[int, tuple[int, int]] = {}
        for end, (length, at) in hits:
            first = bisect_left(starts, end - length + 1)
            for n, offset in at:
                _, item, k = self.items[n]
                if (n, first - offset) in tried or best.get(n, (1,))[0] == 0:
                    continue
                tried.add((n, first - offset))
                low = max(0, first - offset - k)
                got = myers(item, words[low : first - offset + len(item) + k], k)
                if got and (n not in best or (got[0], low + got[1]) < best[n]):
                    best[n] = (got[0], low + got[1])
        return [(self.items[n][0], d, e, len(self.items[n][1])) for n, (d, e) in sorted(best.items())]


def item_blocks(items: DataFrame, block: int = BLOCK) -> Iterator[list[tuple[object, str]]]:
    """The items, a bounded number of bytes at a time. Items without id, text or words match nothing."""
    held, size = [], 0
    for r in items.select("item_id", "text").where("item_id is not null and text is not null").distinct().orderBy("item_id", "text").toLocalIterator():
        if held and size + len(r.text) > block:
            yield held
            held, size = [], 0
        held.append((r.item_id, r.text))
        size += len(r.text)
    if held:
        yield held


def matches(docs: DataFrame, items: DataFrame, errors: float = ERRORS) -> DataFrame:
    """doc_id, item_id, distance, end_word, item_words: a row for each item that a row of docs holds.

    Items that share an id and not a text are items each. Null and empty texts hold nothing; rows of docs with one id give rows each;
    without items there are no rows; other columns are ignored.
    """
    kind = docs.select("doc_id").schema.add(items.schema["item_id"]).add("distance", "integer").add("end_word", "long").add("item_words", "integer")
    out = docs.sparkSession.createDataFrame([], kind)
    for block in item_blocks(items):
        shared = docs.sparkSession.sparkContext.broadcast(block)  # at most BLOCK bytes of text

        def run(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            find = Matcher(shared.value, errors)
            for batch in batches:
                rows = [(n, *hit) for n, x in enumerate(batch.column("text").to_pylist()) for hit in find(x)]
                n, *cols = zip(*rows, strict=True) if rows else ((),) * 5
                kinds = [pa.int64() if f.dataType.simpleString() == "bigint" else pa.int32() if f.dataType.simpleString() == "int" else None for f in kind.fields[1:]]
                yield pa.RecordBatch.from_arrays([batch.column("doc_id").take(pa.array(n, pa.int64())), *(pa.array(c, k) if k else pa.array(c, pa.string()) for c, k in zip(cols, kinds, strict=True))], names=kind.names)

        out = out.unionAll(docs.select("doc_id", "text").mapInArrow(run, kind))
    return out


def without_matches(docs: DataFrame, items: DataFrame, errors: float = ERRORS) -> DataFrame:
    """The rows of docs, all their columns, that hold no item; a filter in place, with no join."""
    for block in item_blocks(items):
        shared = docs.sparkSession.sparkContext.broadcast(block)

        def run(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            find = Matcher(shared.value, errors)
            for batch in batches:
                yield batch.filter(pa.array([not find(x) for x in batch.column("text").to_pylist()], pa.bool_()))

        docs = docs.mapInArrow(run, docs.schema)
    return docs

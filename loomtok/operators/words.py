"""Distinct words while merges are learned: flat blocks of token ids, on the driver while they are few, else on the cluster.

A block holds its words one after the other, a mark before the first and after
each, and their counts. A merge is a scan of every block; what comes out of it
are the changes of pair counts, which grow with the vocabulary only.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import RDD, StorageLevel
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Token ids of a block, bytes of ids that the driver takes, and ids that a task takes.
BLOCK, DRIVER_BYTES, TASK = 1 << 19, 48 << 20, 1 << 21
#: Merges after which the blocks on the cluster are written anew, how many times before their lineage is cut, and merges that a job tries.
REFRESH, CUT, AHEAD = 8, 25, 6

#: Token ids and counts.
Block = tuple[np.ndarray, np.ndarray]
#: Pairs in order, in how many places of distinct words each came or went, and the same by the words' counts.
Changes = tuple[np.ndarray, np.ndarray, np.ndarray]
#: Left, right and new id.
Merge = tuple[int, int, int]


def id_type(most: int) -> type:
    """The type of so many ids and a mark, which is its largest value."""
    return np.uint16 if most < 0xFFFF else np.uint32


def _mark(tokens: np.ndarray) -> int:
    return np.iinfo(tokens.dtype).max


def block(words: list[list[int]], counts: Iterable[int], dtype: type = np.uint32) -> Block:
    mark = np.iinfo(dtype).max
    return np.array([mark, *(x for w in words for x in (*w, mark))], dtype), np.array(counts, np.int64)


def places(tokens: np.ndarray, left: int, right: int) -> np.ndarray:
    """Where the pair is merged: from the left, no two places overlap."""
    at = np.flatnonzero((tokens[:-1] == left) & (tokens[1:] == right))
    if left == right and len(at):
        heads = np.flatnonzero(np.diff(at, prepend=at[0] - 2) != 1)
        nth = np.arange(len(at)) - np.repeat(heads, np.diff(heads, append=len(at)))
        at = at[nth % 2 == 0]
    return at


def merged(tokens: np.ndarray, at: np.ndarray, new: int) -> np.ndarray:
    if not len(at):
        return tokens
    out = np.delete(tokens, at + 1)
    out[at - np.arange(len(at))] = new
    return out


def replay(tokens: np.ndarray, merges: list[Merge]) -> np.ndarray:
    for left, right, new in merges:
        tokens = merged(tokens, places(tokens, left, right), new)
    return tokens


def summed(parts: list[Changes]) -> Changes:
    """The sums by pair; pairs whose changes cancel out stay."""
    pairs, n, weight = (np.concatenate([np.zeros(0, np.int64), *(p[k] for p in parts)]) for k in range(3))
    if not len(pairs):
        return pairs, n, weight
    order = np.argsort(pairs, kind="stable")
    pairs = pairs[order]
    at = np.flatnonzero(np.diff(pairs, prepend=pairs[0] - 1))
    return pairs[at], np.add.reduceat(n[order], at), np.add.reduceat(weight[order], at)


def changes(tokens: np.ndarray, counts: np.ndarray, at: np.ndarray, left: int, right: int, new: int) -> Changes:
    """What merging at these places does to pair counts; the merged pair itself loses its places besides."""
    if not len(at):
        return summed([])
    mark = _mark(tokens)
    weight = counts[np.searchsorted(np.flatnonzero(tokens == mark), at) - 1]
    before, behind = tokens[at - 1].astype(np.int64), tokens[at + 2].astype(np.int64)
    before[1:][at[1:] == at[:-1] + 2] = new
    has, more = before != mark, behind != mark
    p, q, v, w = before[has], behind[more], weight[has], weight[more]
    pairs = np.concatenate([p << 32 | left, p << 32 | new, right << 32 | q, new << 32 | q, [left << 32 | right]])
    one, two = np.ones(len(p), np.int64), np.ones(len(q), np.int64)
    # the pair is listed with no change in places: its count is exact, and it is never looked at again
    return summed([(pairs, np.concatenate([-one, one, -two, two, [0]]), np.concatenate([-v, v, -w, w, [-weight.sum()]]))])


def _inner(tokens: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Pairs of neighbours in a word, and the word of each."""
    inside = tokens != _mark(tokens)
    at = np.flatnonzero(inside[:-1] & inside[1:])
    return tokens[at].astype(np.int64) << 32 | tokens[at + 1], (np.cumsum(~inside) - 1)[at]


def pair_counts(blocks: Iterable[Block]) -> Changes:
    out = summed([])
    for tokens, counts in blocks:
        codes, rows = _inner(tokens)
        out = summed([out, summed([(codes, np.ones(len(codes), np.int64), counts[rows])])])
    return out


def contexts(blocks: Iterable[Block], kinds: np.ndarray) -> np.ndarray:
    """The distinct (pair, pair one or two places away in a word), both ways, as place in kinds * len(kinds) + place in kinds."""
    out = np.zeros(0, np.int64)
    for tokens, _ in blocks:
        codes, rows = _inner(tokens)
        at = np.searchsorted(kinds, codes)
        for k in (1, 2):
            same = np.flatnonzero(rows[k:] == rows[:-k])
            a, b = at[same], at[same + k]
            out = np.union1d(out, np.unique(np.concatenate([a * len(kinds) + b, b * len(kinds) + a])))
    return out


class Local:
    """Blocks in memory."""

    def __init__(self, blocks: list[Block]) -> None:
        self.blocks = blocks

    def pair_counts(self) -> Changes:
        return pair_counts(self.blocks)

    def diversity(self, kinds: np.ndarray) -> np.ndarray:
        """In how many contexts each of these pairs is."""
        return np.bincount(contexts(self.blocks, kinds) // max(1, len(kinds)), minlength=len(kinds))

    def merge(self, left: int, right: int, new: int, guess: Callable[[int], list[Merge]]) -> Changes:  # noqa: ARG002
        parts = []
        for i, (tokens, counts) in enumerate(self.blocks):
            if len(at := places(tokens, left, right)):
                parts.append(changes(tokens, counts, at, left, right, new))
                self.blocks[i] = merged(tokens, at, new), counts
        return summed(parts)

    def close(self) -> None:
        self.blocks = []


def _of(rows: Iterator[tuple[bytes, bytes]], dtype: type) -> Iterator[Block]:
    return ((np.frombuffer(t, dtype), np.frombuffer(c, np.int64)) for t, c in rows)


class Spread:
    """Blocks in the storage of the executors. A job tries some merges; those since the last refresh are replayed in it."""

    def __init__(self, packed: DataFrame, dtype: type, ids: int) -> None:
        self.packed, self.dtype = packed, dtype
        rows = packed.rdd.map(lambda r: (bytes(r.tokens), bytes(r.counts)))
        tasks = max(packed.sparkSession.sparkContext.defaultParallelism, -(-ids // TASK))
        self.rdd: RDD = rows.coalesce(tasks).persist(StorageLevel.MEMORY_AND_DISK)
        self.pending: list[Merge] = []
        self.known: list[tuple[Merge, Changes]] = []
        self.refreshed = 0
        self.rdd.count()

    def _columns(self, f: Callable[[Iterator[Block]], list[np.ndarray]], names: list[str]) -> DataFrame:
        dtype = self.dtype

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            rows = ((t.as_py(), c.as_py()) for b in batches for t, c in zip(b.column("tokens"), b.column("counts"), strict=True))
            yield pa.RecordBatch.from_arrays([pa.array(x) for x in f(_of(rows, dtype))], names)

        return self.packed.mapInArrow(run, ", ".join(f"{n} long" for n in names))

    def pair_counts(self) -> Changes:
        rows = self._columns(lambda b: list(pair_counts(b)), ["pair", "n", "weight"])
        out = rows.groupBy("pair").agg(F.sum("n").alias("n"), F.sum("weight").alias("weight")).toArrow()
        return summed([tuple(out.column(c).to_numpy() for c in ("pair", "n", "weight"))])

    def diversity(self, kinds: np.ndarray) -> np.ndarray:
        rows = self._columns(lambda b: [contexts(b, kinds)], ["both"]).distinct()
        out = rows.groupBy(F.expr(f"both div {max(1, len(kinds))}").alias("at")).count().toArrow()
        n = np.zeros(len(kinds), np.int64)
        n[out.column("at").to_numpy()] = out.column("count").to_numpy()
        self.packed.unpersist()  # the blocks have been counted, and so are held apart
        return n

    def merge(self, left: int, right: int, new: int, guess: Callable[[int], list[Merge]]) -> Changes:
        """The changes by a merge. `guess` tells what merges may follow; the same job tries them, and what comes otherwise is asked for anew."""
        if not self.known or self.known[0][0] != (left, right, new):
            tried = [(left, right, new), *guess(AHEAD - 1)]
            self.known = list(zip(tried, self._try(tried), strict=True))
        merge, out = self.known.pop(0)
        self.pending.append(merge)
        if len(self.pending) >= REFRESH and not self.known:
            self._refresh()
        return out

    def _try(self, tried: list[Merge]) -> list[Changes]:
        if len(self.pending) >= REFRESH:
            self._refresh()
        dtype, pending = self.dtype, list(self.pending)

        def run(rows: Iterator[tuple[bytes, bytes]]) -> Iterator[list[Changes]]:
            parts: list[list[Changes]] = [[] for _ in tried]
            for tokens, counts in _of(rows, dtype):
                tokens = replay(tokens, pending)
                for part, (left, right, new) in zip(parts, tried, strict=True):
                    at = places(tokens, left, right)
                    part.append(changes(tokens, counts, at, left, right, new))
                    tokens = merged(tokens, at, new)
            yield [summed(p) for p in parts]

        found = self.rdd.mapPartitions(run).collect()  # a few rows for each token next to the pairs
        return [summed(list(p)) for p in zip(*found, strict=True)] if found else [summed([])] * len(tried)

    def _refresh(self) -> None:
        dtype, pending, old = self.dtype, self.pending, self.rdd
        self.rdd = old.mapPartitions(lambda rows: ((replay(t, pending).tobytes(), c.tobytes()) for t, c in _of(rows, dtype))).persist(StorageLevel.MEMORY_AND_DISK)
        self.pending, self.refreshed = [], self.refreshed + 1
        if self.refreshed % CUT == 0:
            self.rdd.checkpoint() if old.context.getCheckpointDir() else self.rdd.localCheckpoint()
        self.rdd.count()
        old.unpersist()

    def close(self) -> None:
        self.packed.unpersist()
        self.rdd.unpersist()


def gather(words: DataFrame, at: dict[str, int], most: int) -> Local | Spread:
    """The words (key, n) as ids of their characters, which `at` gives; `most` is the number of ids there can be."""
    dtype = id_type(most)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words, counts, size = [], [], 0

        def out() -> pa.RecordBatch:
            tokens, n = block(words, counts, dtype)
            return pa.RecordBatch.from_arrays([pa.array([tokens.tobytes()], pa.binary()), pa.array([n.tobytes()], pa.binary()), pa.array([len(tokens)], pa.int64())], ["tokens", "counts", "ids"])

        for batch in batches:
            for key, n in zip(batch.column("key").to_pylist(), batch.column("n").to_pylist(), strict=True):
                words.append([at[c] for c in key])
                counts.append(n)
                size += len(key) + 1
                if size >= BLOCK:
                    yield out()
                    words, counts, size = [], [], 0
        if words:
            yield out()

    packed = words.select("key", "n").mapInArrow(run, "tokens binary, counts binary, ids long").persist()
    ids = packed.agg(F.sum("ids")).first()[0] or 0
    if ids * np.dtype(dtype).itemsize > DRIVER_BYTES:
        return Spread(packed, dtype, ids)
    rows = packed.select("tokens", "counts").toArrow()
    packed.unpersist()
    return Local([(np.frombuffer(t.as_buffer(), dtype), np.frombuffer(c.as_buffer(), np.int64)) for t, c in zip(rows.column("tokens"), rows.column("counts"), strict=True)])

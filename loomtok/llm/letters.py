"""How likely a word's spelling is: logistic mixing of hashed letter contexts.

A word is its bytes and a closing blank, each a path through a binary tree, so
that it is a row of bits. Three predictors, the counts of ones and zeros in
tables of hashed contexts (two, three and five letters back), say how likely
each bit is; their log odds are mixed with weights that a gate picks by how
much the contexts have seen, learned online, and a last table of corrections
refines the result. Every distinct training word is learned from once: each
task predicts a stretch of bits from what it has seen so far, learns from the
errors, and then counts them; the counts of tasks meet block by block, weights
and corrections are averaged. Contexts hold five letters at most, so what they
can be follows from the alphabet and not from the size of the corpus.
"""

from __future__ import annotations

import heapq
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from loomtok.llm.common import shuffle_partitions

#: Slots of a context's table, as bits; slots of a block of counts that tasks exchange.
BITS, BLOCK = 20, 1 << 12
LETTERS, GATES, STEPS = (2, 3, 5), 16, 33
ORDERS = len(LETTERS)
#: Words looked at together, and bits to an update of the weights.
WORDS, BATCH = 5_000, 1 << 16
_A = np.uint64(0x9E3779B97F4A7C15)
_B = np.uint64(0xC2B2AE3D27D4EB4F)


def huffman(weights: list[float]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Where each symbol's path starts (one more entry than symbols), and the inner nodes and bits along the paths."""
    n = len(weights)
    heap = [(w, i) for i, w in enumerate(weights)]
    heapq.heapify(heap)
    up = [(0, 0)] * (2 * n - 1)
    for node in range(n, 2 * n - 1):
        (a, x), (b, y) = heapq.heappop(heap), heapq.heappop(heap)
        up[x], up[y] = (node, 0), (node, 1)
        heapq.heappush(heap, (a + b, node))
    starts, nodes, bits = [0], [], []
    for i in range(n):
        path = []
        while i != 2 * n - 2:
            i, bit = up[i]
            path.append((i - n, bit))
        nodes += [x for x, _ in reversed(path)]
        bits += [b for _, b in reversed(path)]
        starts.append(len(nodes))
    return np.array(starts), np.array(nodes, np.int64), np.array(bits, np.int8)


#: By a count, up to where they level off: its part of log odds, and how much it is (0 to 3).
_LOG = np.log(np.arange(1 << 16) + 0.3).astype(np.float32)
_LEVEL = np.minimum(3, (np.arange(1 << 16) > 0).astype(np.int32) + (np.arange(1 << 16) > 3) + (np.arange(1 << 16) > 30))
_MOST = (1 << 16) - 1


def _state(zero: np.ndarray, one: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Log odds of a one, and level, from counts."""
    return _LOG.take(np.minimum(one, _MOST)) - _LOG.take(np.minimum(zero, _MOST)), _LEVEL.take(np.minimum(zero + one, _MOST))


def _mix(weights: np.ndarray, gate: np.ndarray, odds: list[np.ndarray]) -> np.ndarray:
    """weights: a contiguous row for each order and one for the bias."""
    z = weights[ORDERS].take(gate)
    for k in range(ORDERS):
        z += weights[k].take(gate) * odds[k]
    return np.clip(z, -12, 12, out=z)


def _cell(gate: np.ndarray, z: np.ndarray) -> np.ndarray:
    return gate * STEPS + np.clip(np.rint(z * 2) + STEPS // 2, 0, STEPS - 1).astype(np.int32)


class Letters:
    """Tree, counts, mixing weights and corrections; untrained, every bit has one half."""

    def __init__(self, frequency: np.ndarray) -> None:
        """frequency: of every byte, in the training words."""
        letters = np.ones(256) + frequency
        letters[32] += max(1.0, frequency.sum() / 8)
        self.tree = huffman(letters.tolist())
        self.seen = np.zeros((ORDERS, 2 << BITS), np.uint16)
        self.weights = np.tile(np.array([0.3] * ORDERS + [0.0]), (GATES, 1))
        self.corrected = np.full((GATES, STEPS), 0.5, np.float32)
        self.fixed = None

    def bits(self, words: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Word, value and slots (a row for each order) of every bit of the words, each closed by a blank."""
        text = np.frombuffer(b" ".join(words) + b" ", np.uint8).astype(np.int64)
        length = np.array([len(x) + 1 for x in words])
        inside = np.arange(len(text)) - np.repeat(np.cumsum(length) - length, length)
        starts, nodes, values = self.tree
        size = starts[text + 1] - starts[text]
        of = np.repeat(np.arange(len(text)), size)
        at = np.arange(len(of)) - np.repeat(np.cumsum(size) - size - starts[text], size)
        node = nodes[at].astype(np.uint64) * _B
        context, slots = np.full(len(text), 77, np.uint64), np.empty((ORDERS, len(of)), np.int32)
        for k in range(1, LETTERS[-1] + 1):
            shifted = np.zeros(len(text), np.int64)
            shifted[k:] = text[: max(0, len(text) - k)]
            context = (context + np.where(inside >= k, shifted, 256).astype(np.uint64)) * _A
            context ^= context >> np.uint64(31)
            if k in LETTERS:
                h = (context + np.uint64(k))[of] + node
                h *= _A
                h >>= np.uint64(64 - BITS)
                slots[LETTERS.index(k)] = h
        return np.repeat(np.arange(len(words)), length)[of], values[at], slots

    def log10_bits(self, bit: np.ndarray, slots: np.ndarray) -> np.ndarray:
        """log10 of the probability of each bit: mixed, then refined by the corrections."""
        if self.fixed is None:  # once in each worker
            state = [_state(*self.seen[k].astype(np.int64).reshape(-1, 2).T) for k in range(ORDERS)]
            self.fixed = [np.ascontiguousarray(o) for o, _ in state], [x.astype(np.int8) for _, x in state], np.ascontiguousarray(self.weights.T, np.float32), self.corrected.ravel()
        odds, levels, weights, corrected = self.fixed
        gate = levels[1].take(slots[1]).astype(np.int32) * 4 + levels[2].take(slots[2])
        z = _mix(weights, gate, [odds[k].take(slots[k]) for k in range(ORDERS)])
        p = corrected.take(_cell(gate, z)) + 1 / (1 + np.exp(-z))
        return np.log10(np.where(bit == 1, p, 2 - p) * np.float32(0.5))

    def spelled(self, words: list[bytes]) -> np.ndarray:
        """log10 of the probability of each word's spelling."""
        out = [np.zeros(0)]
        for a in range(0, len(words), WORDS):
            part = words[a : a + WORDS]
            of, bit, slots = self.bits(part)
            out.append(np.bincount(of, self.log10_bits(bit, slots), len(part)))
        return np.concatenate(out)


class Learner:
    """Counts, weights and corrections of one task."""

    def __init__(self, weights: np.ndarray) -> None:
        self.seen = np.zeros((ORDERS, 2 << BITS), np.uint32)
        self.weights, self.squares = weights.copy(), np.full((GATES, ORDERS + 1), 1e-3)
        self.met, self.sums = np.zeros(GATES), np.zeros((2, GATES * STEPS))

    def learn(self, every: np.ndarray, all_slots: np.ndarray) -> None:
        """Predicts these bits, BATCH at a time, moves the weights, and counts them."""
        for a in range(0, len(every), BATCH):
            bit, slots = every[a : a + BATCH].astype(np.int32), all_slots[:, a : a + BATCH]
            odds, levels = zip(*(_state(self.seen[k].take(2 * slots[k]), self.seen[k].take(2 * slots[k] + 1)) for k in range(ORDERS)), strict=True)
            gate = levels[1] * 4 + levels[2]
            z = _mix(np.ascontiguousarray(self.weights.T, np.float32), gate, list(odds))
            error = bit - 1 / (1 + np.exp(-z))
            met = np.bincount(gate, minlength=GATES)
            slope = np.stack([*(np.bincount(gate, error * o, GATES) for o in odds), np.bincount(gate, error, GATES)], 1) / np.maximum(met, 1)[:, None]
            self.squares += slope**2
            self.weights += 0.05 * slope / np.sqrt(self.squares)
            self.met += met
            cell = _cell(gate, z)
            self.sums[0] += np.bincount(cell, minlength=GATES * STEPS)
            self.sums[1] += np.bincount(cell, bit, GATES * STEPS)
            for k in range(ORDERS):
                np.add.at(self.seen[k], 2 * slots[k] + bit, np.uint32(1))

    def blocks(self) -> Iterator[pa.RecordBatch]:
        """(block, counts) of what was counted, and the weights and corrections as block -1."""
        blocks = self.seen.reshape(-1, 2 * BLOCK)
        some = np.flatnonzero(blocks.any(1))
        for a in range(0, len(some), 256):
            part = some[a : a + 256]
            yield pa.RecordBatch.from_arrays([pa.array(part, pa.int64()), pa.array([zlib.compress(blocks[i].tobytes(), 1) for i in part], pa.binary())], ["block", "counts"])
        rest = np.concatenate([(self.weights * self.met[:, None]).ravel(), self.met, self.sums.ravel()])
        yield pa.RecordBatch.from_arrays([pa.array([-1], pa.int64()), pa.array([zlib.compress(rest.tobytes(), 1)], pa.binary())], ["block", "counts"])


def _add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Sums of each block; of counts, pairs are scaled down together where they outgrow 16 bits."""
    sums: dict[int, np.ndarray] = {}
    for batch in batches:
        for block, counts in zip(batch.column("block").to_pylist(), batch.column("counts").to_pylist(), strict=True):
            x = np.frombuffer(zlib.decompress(counts), np.float64 if block < 0 else np.uint32)
            if block not in sums:
                sums[block] = x.astype(np.float64 if block < 0 else np.uint64)
            else:
                sums[block] += x
    for block, x in sums.items():
        if block >= 0:
            pairs = x.reshape(-1, 2)
            scale = np.maximum(1.0, pairs.max(1, keepdims=True) / 65_000)
            x = np.where((pairs > 0) & (scale > 1), np.maximum(1, np.rint(pairs / scale)), np.rint(pairs / scale)).astype(np.uint16)
        yield pa.RecordBatch.from_arrays([pa.array([block], pa.int64()), pa.array([zlib.compress(x.tobytes(), 1)], pa.binary())], ["block", "counts"])


def fit(lexicon: DataFrame, frequency: np.ndarray) -> Letters:
    """Learned from lexicon: a column `words` of blank-separated distinct words, as bytes."""
    spark = lexicon.sparkSession
    model = Letters(frequency)
    shared = spark.sparkContext.broadcast(model)

    def learn(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = shared.value
        learner = Learner(model.weights)
        for batch in batches:
            for joined in batch.column("words").to_pylist():
                words = joined.split(b" ") if joined else []
                for a in range(0, len(words), WORDS):
                    _, bit, slots = model.bits(words[a : a + WORDS])
                    learner.learn(bit, slots)
        yield from learner.blocks()

    kind = "block long, counts binary"
    seen, values = model.seen.reshape(-1, 2 * BLOCK), np.zeros(GATES * (ORDERS + 1) + GATES + 2 * GATES * STEPS)
    reducers = min(len(seen), shuffle_partitions(spark))
    for r in lexicon.select("words").mapInArrow(learn, kind).repartition(reducers, "block").mapInArrow(_add, kind).collect():  # ORDERS << BITS slots
        if r.block < 0:
            values = np.frombuffer(zlib.decompress(r.counts), np.float64)
        else:
            seen[r.block] = np.frombuffer(zlib.decompress(r.counts), np.uint16)
    size = GATES * (ORDERS + 1)
    met = values[size : size + GATES]
    model.weights[met > 0] = (values[:size].reshape(GATES, -1) / np.maximum(met, 1)[:, None])[met > 0]
    n, ones = values[size + GATES :].reshape(2, GATES, STEPS)
    prior = 1 / (1 + np.exp(-(np.arange(STEPS) - STEPS // 2) / 2))
    model.corrected = ((ones + 20 * prior) / (n + 20)).astype(np.float32)
    return model

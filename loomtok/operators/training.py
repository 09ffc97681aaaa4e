"""Vocabulary training: distributed counts, then a merge loop over distinct words.

What grows with the corpus is counted on the cluster: words with partial
counts, and characters with their first place. Each merge depends on the one
before, so the loop runs on the driver, over the counts of pairs. The distinct
words are ids in flat arrays (words.py), which stay on the cluster where they
are many; a merge brings the changes of the counts of pairs, and nothing else.
"""

from __future__ import annotations

import heapq
import math
import re
from collections import Counter, defaultdict
from collections.abc import Iterator
from contextlib import contextmanager

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomtok.config import DIVERSITY_WEIGHT, ENTROPY_WEIGHT, FREQUENCY_WEIGHT, RECOUNT, InvalidConfigError, TokenizerConfig, TrainingConfig
from loomtok.model import Model
from loomtok.operators.words import Local, Spread, block, gather

#: str.split() also splits at these, which aren't white space.
_CONTROLS = re.compile("[\x1c-\x1f]")
_WORDS = re.compile("[\\S\x1c-\x1f]+")


def split_words(text: str) -> list[str]:
    return _WORDS.findall(text) if _CONTROLS.search(text) else text.split()


def _counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """kind w: words and counts; kind c: characters, counts and first place, of each task."""
    words: Counter = Counter()
    chars: Counter = Counter()
    first: dict[str, tuple[int, int]] = {}

    def out(kind: str, c: Counter) -> pa.RecordBatch:
        at = [first.get(k, (None, None)) for k in c] if kind == "c" else [(None, None)] * len(c)
        return pa.RecordBatch.from_arrays([pa.array([kind] * len(c)), pa.array(list(c), pa.string()), pa.array(list(c.values()), pa.int64()), pa.array([a for a, _ in at], pa.int64()), pa.array([b for _, b in at], pa.int64())], ["kind", "key", "n", "doc", "pos"])

    for batch in batches:
        for doc, text in zip(batch.column("doc_id").to_pylist(), batch.column("text").to_pylist(), strict=True):
            if not text:
                continue
            words.update(split_words(text))
            here = Counter(text)
            chars.update(here)
            for ch in here:
                if ch not in first or first[ch][0] >= doc:
                    at = (doc, text.index(ch))
                    first[ch] = min(first.get(ch, at), at)
            if len(words) > 200_000:
                yield out("w", words)
                words.clear()
    yield out("w", words)
    yield out("c", chars)


@contextmanager
def corpus_counts(docs: DataFrame, config: TrainingConfig) -> Iterator[tuple[DataFrame, list[str], dict[str, int]]]:
    """Words with counts (key, n), characters by first appearance, and character counts.

    The training text is the documents by doc_id, with a line feed between
    them; rows without id or text aren't part of it.
    """
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").where("doc_id is not null and text is not null")
    parts = rows.mapInArrow(_counts, "kind string, key string, n long, doc long, pos long")
    sums = parts.groupBy("kind", "key").agg(F.sum("n").alias("n"), F.min(F.struct("doc", "pos")).alias("at"))
    sums = sums.where((F.col("kind") == "c") | (F.col("n") >= config.min_word_count)).persist()
    try:
        if config.max_words is not None and (n := sums.where("kind = 'w'").count()) > config.max_words:
            raise InvalidConfigError(f"{n} distinct words; max_words is {config.max_words}: set min_word_count or max_words")
        chars = sums.where("kind = 'c'").select("key", "n", "at").collect()
        edge = rows.agg(F.min(F.struct("doc_id", F.length("text").alias("n"))).alias("first"), F.count("*").alias("n")).first()
        places = {r.key: (r["at"].doc, r["at"].pos) for r in chars}
        counts = {r.key: r.n for r in chars}
        if edge.n > 1:
            counts["\n"] = counts.get("\n", 0) + edge.n - 1
            between = (edge.first.doc_id, edge.first.n)
            places["\n"] = min(places.get("\n", between), between)
        yield sums.where("kind = 'w'").select("key", "n"), sorted(places, key=places.get), counts
    finally:
        sums.unpersist()


class MergeLoop:
    """Chooses merges over words, as blocks or as lists of token ids with their counts.

    A pair is one number, left << 32 | right. Between recounts at most RECOUNT
    merges are taken, so a rebuilt queue holds the best HELD pairs first, and
    the others only once those are used up.
    """

    HELD = 3_000

    def __init__(self, words: Local | Spread | list[list[int]], counts: list[int] | None, tokens: list[str], entropy: dict[str, float], config: TrainingConfig) -> None:
        self.words = Local([block(words, counts)]) if isinstance(words, list) else words
        self.tokens, self.config = list(tokens), config
        self.ids = {t: i for i, t in enumerate(self.tokens)}
        self.char_entropy = {k: np.float32(v) for k, v in entropy.items()}
        self.entropy = np.zeros(max(1024, 2 * len(tokens)), np.float32)
        for i, t in enumerate(self.tokens):
            self._set_entropy(i, t)
        self.merges: set[int] = set()
        self.near: dict[int, np.float32] = {}
        pairs, _, weights = self.words.pair_counts()
        self.exact: dict[int, int] = defaultdict(int, zip(pairs.tolist(), weights.tolist(), strict=True))
        self.drift = dict(self.exact)
        self.rebuild()
        # after the first queue: its scores have no diversity, the ln(1 + distinct pairs one or two places away in a word)
        self.near = dict(zip(pairs.tolist(), np.log1p(self.words.diversity(pairs).astype(np.float32)), strict=True))

    def _set_entropy(self, i: int, token: str) -> None:
        if i >= len(self.entropy):
            self.entropy = np.concatenate([self.entropy, np.zeros_like(self.entropy)])
        total = np.float32(0)
        for ch in token:
            total += self.char_entropy.get(ch, np.float32(0))
        self.entropy[i] = total / np.float32(len(token) or 1)

    def priorities(self, pairs: np.ndarray, counts: np.ndarray) -> np.ndarray:
        f = np.float32
        both = (self.entropy[pairs >> 32] + self.entropy[pairs & 0xFFFFFFFF]) / f(2)
        near = np.fromiter((self.near.get(p, 0) for p in pairs.tolist()), f, len(pairs)) if self.near else np.zeros(len(pairs), f)
        score = f(FREQUENCY_WEIGHT) * np.log1p(counts.astype(f) + f(1)) + f(ENTROPY_WEIGHT) * both + f(DIVERSITY_WEIGHT) * near
        return (score * f(1000)).astype(np.int64)

    def push(self, pairs: list[int], counts: list[int]) -> None:
        for pair, p in zip(pairs, self.priorities(np.array(pairs, np.int64), np.array(counts, np.int64)).tolist(), strict=True):
            self.current[pair] = p
            heapq.heappush(self.heap, (-p, -pair))

    def rebuild(self) -> None:
        pairs, counts = (np.fromiter(x, np.int64, len(self.drift)) for x in (self.drift.keys(), self.drift.values()))
        some = counts >= self.config.min_frequency
        pairs = pairs[some]
        p = self.priorities(pairs, counts[some])
        self.heap, self.current = [], {}
        best = np.argpartition(-p, self.HELD)[: self.HELD] if len(p) > self.HELD else np.arange(len(p))
        self.floor = int(p[best].min()) if len(p) > self.HELD else None
        self.rest = (pairs, p)
        self._hold(pairs[best], p[best])

    def _hold(self, pairs: np.ndarray, p: np.ndarray) -> None:
        for pair, x in zip(pairs.tolist(), p.tolist(), strict=True):
            if pair not in self.current:
                self.current[pair] = x
                self.heap.append((-x, -pair))
        heapq.heapify(self.heap)

    def pop(self) -> tuple[int, int] | None:
        while True:
            if self.floor is not None and (not self.heap or -self.heap[0][0] <= self.floor):
                self.floor = None
                self._hold(*self.rest)  # those that are used up or changed stay in current
            if not self.heap:
                return None
            p, pair = heapq.heappop(self.heap)
            if self.current.get(-pair) == -p:
                self.current[-pair] = -1
                return -pair, -p

    def apply(self, left: int, right: int, new: int) -> dict[int, int]:
        """Merges the pair in every word that has it; changes of neighbouring pairs, once for each distinct word."""
        pairs, places, weights = (x.tolist() for x in self.words.merge(left, right, new, self.next))
        for pair, weight in zip(pairs, weights, strict=True):
            self.exact[pair] += weight
        out = dict(zip(pairs, places, strict=True))
        out.pop(left << 32 | right, None)  # has its merge
        return out

    def next(self, n: int) -> list[tuple[int, int, int]]:
        """The merges that come next, if no count changes."""
        out, made = [], {}
        for p, pair in heapq.nsmallest(4 * n, self.heap):
            if self.current.get(-pair) == -p and -pair not in self.merges and len(out) < n:
                text = self.tokens[-pair >> 32] + self.tokens[-pair & 0xFFFFFFFF]
                new = self.ids.get(text)
                out.append((-pair >> 32, -pair & 0xFFFFFFFF, made.setdefault(text, len(self.tokens) + len(made)) if new is None else new))
        return list(dict.fromkeys(out))  # a pair may be in the heap twice

    def run(self) -> list[tuple[int, int, int]]:
        """(l, r, new id) in order of rank; self.tokens grows with them."""
        out: list[tuple[int, int, int]] = []
        least = self.config.min_frequency
        while len(self.tokens) < self.config.vocab_size and (got := self.pop()):
            pair, priority = got
            if priority < least:
                break
            if pair in self.merges:
                continue
            left, right = pair >> 32, pair & 0xFFFFFFFF
            text = self.tokens[left] + self.tokens[right]
            new = self.ids.setdefault(text, len(self.tokens))
            if new == len(self.tokens):
                self.tokens.append(text)
                self._set_entropy(new, text)
            self.merges.add(pair)
            out.append((left, right, new))
            pushed, counts = [], []
            for p, delta in self.apply(left, right, new).items():
                count = self.exact[p] if self.config.weighted_deltas else max(0, self.drift.get(p, 0) + delta)
                if count > 0:
                    self.drift[p] = count
                    if count >= least:
                        pushed.append(p)
                        counts.append(count)
                else:
                    self.drift.pop(p, None)
            if pushed:
                self.push(pushed, counts)
            if len(out) % RECOUNT == 0:
                self.exact = defaultdict(int, {p: c for p, c in self.exact.items() if c > 0})
                self.drift = dict(self.exact)
                self.rebuild()
        return out


def fit(docs: DataFrame, config: TokenizerConfig, training: TrainingConfig | None = None) -> Model:
    """Trains on docs (doc_id, text): characters, merges, missing bytes, then special tokens, in this order of ids."""
    training = training or TrainingConfig(config.vocab_size, config.min_frequency, weighted_deltas=config.canonical)
    with corpus_counts(docs, training) as (keys, chars, counts):
        words = gather(keys, {c: i for i, c in enumerate(chars)}, max(training.vocab_size, len(chars)))
    total = sum(counts.values())
    entropy = {c: -(n / total) * math.log2(n / total) for c, n in counts.items()}
    try:
        loop = MergeLoop(words, None, chars, entropy, training)
        merges = loop.run()
    finally:
        words.close()
    tokens = [t.encode() for t in loop.tokens]
    kinds = ["char"] * len(chars) + ["merge"] * (len(tokens) - len(chars))
    have = set(tokens)
    rest = [bytes([b]) for b in range(256) if bytes([b]) not in have]
    named = config.special_tokens.configured()
    specials = {k: len(tokens) + len(rest) + i for i, (k, _) in enumerate(named)}
    return Model(config, tokens + rest + [v.encode() for _, v in named], kinds + ["byte"] * len(rest) + ["special"] * len(named), merges, specials)

"""Scoring by logistic mixing of hashed-context bit predictors.

A text is its tokens, words and one end. Contexts are the three, two and one
words before a token, hashed. What a context predicts is the word that holds
more than half of what followed it in the training texts, so that a token is
up to three bits: is it what the three words predict, what the two, what the
one? A context never seen predicts nothing and has no bit. Each bit is told by
three predictors, which take how often each context was seen to a probability
kept for that state; their log odds are mixed with weights that a gate picks by
how much the bit's own context has seen, learned online, and a last table of
corrections refines the result. A token that no context predicts is told by
its counts after the contexts, each order backing the one above, down to the
spelling of the word, itself a row of mixed bits (letters.py). The product over
all is the probability of the text, in bits per byte as well.

Nothing has a fixed size but the tables of states: every one-, two-, three- and
four-word sequence of all training texts is counted, as a key whose width
follows the corpus. Texts are dealt in chunks. A chunk sends each range of keys
the sorted keys it has, as one packed value, and gets their counts over all
chunks back in the same order; so a key travels once a chunk however often it
occurs, hot ones are not felt, and the sizes of chunks and ranges grow as the
square root of the corpus, which holds the number of values sent in proportion
to it. What is predicted is never counted already: from the counts that a
training token meets its own occurrence is taken out, in learning and in its
score, so that training texts are told as others are and one that occurs twice
differs from one that occurs once.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from math import isqrt

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from loomtok.llm import letters
from loomtok.llm.common import crc_mod, materialize, shuffle_partitions

FOLDS = 10
#: Bytes of text in a chunk and behind a range, at least, and what they grow with.
CHUNK, RANGE, GROWTH = 3_000_000, 2_000_000, 400
#: Bits of a key beyond those that count the bytes of the corpus: at most one key in a hundred meets another.
SPARE = 6
#: Words before a token that are looked at; kinds of words in a chunk's table.
ORDERS = 3
#: Counts from which a context is in the next state; 0 is never seen.
STATES = np.array([1, 2, 3, 4, 6, 10, 16, 32, 128, 1024])
LEVELS = len(STATES) + 1
CELLS, STEPS = LEVELS**ORDERS, 33
#: log10 of the probability that a word the counts don't tell is the end.
END = -3.0
_STATE = np.searchsorted(STATES, np.arange(STATES[-1] + 1), "right")
_START, _END = np.uint64(0x5851F42D4C957F2D), np.uint64(0x14057B7EF767814F)
_A, _B = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F)
_ZIP, _UNZIP = zstandard.ZstdCompressor(level=1), zstandard.ZstdDecompressor()
#: Numbers of a range's tally: for words and the three orders, occurrences and kinds by bits of the count; then letters.
_TALLY = 2 * (ORDERS + 1) * 64


@dataclass(frozen=True)
class Shape:
    """What follows the size of the corpus."""

    bits: int
    ranges: int

    @classmethod
    def of(cls, size: int) -> Shape:
        return cls(min(60, max(24, int(size).bit_length() + SPARE)), -(-size // max(RANGE, isqrt(GROWTH * size))) or 1)

    def edges(self, bits: int) -> np.ndarray:
        """The first key of each range but the first, of keys of so many bits."""
        return np.array([(i << bits) // self.ranges for i in range(1, self.ranges)], np.uint64)


def pack(x: np.ndarray) -> bytes:
    """Whole numbers, byte by byte of their places, as wide as the largest needs, compressed."""
    width = max(1, (int(x.max(initial=0)).bit_length() + 7) // 8)
    return bytes([width]) + _ZIP.compress(np.ascontiguousarray(x, "<u8").view(np.uint8).reshape(-1, 8)[:, :width].T.tobytes())


def unpack(b: bytes) -> np.ndarray:
    places = np.frombuffer(_UNZIP.decompress(memoryview(b)[1:]), np.uint8).reshape(b[0], -1)
    out = np.zeros((places.shape[1], 8), np.uint8)
    out[:, : b[0]] = places.T
    return out.view("<u8").ravel()


def pack_sorted(x: np.ndarray) -> bytes:
    return int(x[0]).to_bytes(8, "little") + pack(np.diff(x))


def unpack_sorted(b: bytes) -> np.ndarray:
    return np.cumsum(np.concatenate([np.frombuffer(b, "<u8", 1), unpack(b[8:])]), dtype=np.uint64)


def _mixed(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    x = (a ^ (b * _B)) * _A
    x ^= x >> np.uint64(31)
    x *= _B
    return x


def _hashes(words: pa.Array) -> np.ndarray:
    """64 bits of each word, none of which is empty: its bytes by powers of an odd number, mixed."""
    ends = np.frombuffer(words.buffers()[1], np.int32, len(words) + 1, 4 * words.offset)
    if not len(words):
        return np.zeros(0, np.uint64)
    text = np.frombuffer(words.buffers()[2], np.uint8)[ends[0] : ends[-1]].astype(np.uint64)
    length, starts = np.diff(ends), ends[:-1] - ends[0]
    powers = np.cumprod(np.full(length.max(), _A), dtype=np.uint64)
    text += np.uint64(1)
    text *= powers[np.arange(len(text)) - np.repeat(starts, length)]
    return _mixed(np.add.reduceat(text, starts), length.astype(np.uint64))


class Chunk:
    """The tokens of some texts: each text's start, words and end in a row."""

    def __init__(self, texts: pa.Array) -> None:
        """texts: strings without nulls."""
        parts = pc.ascii_split_whitespace(pc.ascii_lower(texts))
        words = parts.flatten()
        some = pc.greater(pc.binary_length(words), 0)
        place = np.concatenate([[0], np.cumsum(some.to_numpy(zero_copy_only=False))])
        ends = place[np.cumsum(pc.list_value_length(parts).to_numpy(zero_copy_only=False))] if len(texts) else place[:0]
        self.lengths = np.diff(ends, prepend=0)
        coded = words.filter(some).dictionary_encode()
        hashes = _hashes(coded.dictionary)
        order = np.argsort(hashes, kind="stable")
        #: Distinct words by hash, and the place there of each word of the texts.
        self.words, self.hashes = coded.dictionary.take(pa.array(order)), hashes[order]
        rank = np.empty(len(order), np.int64)
        rank[order] = np.arange(len(order))
        self.ids = rank[coded.indices.to_numpy()]
        size = self.lengths + 2
        self.ends = np.cumsum(size) - 1
        self.starts = self.ends - size + 1
        self.text = np.repeat(np.arange(len(texts)), size)
        self.body = np.arange(len(self.ids)) + 2 * np.repeat(np.arange(len(texts)), self.lengths) + 1

    def spread(self, start: float, of_words: np.ndarray, end: float) -> np.ndarray:
        """A value for every place from those of starts, of the distinct words and of ends."""
        out = np.empty(len(self.text), of_words.dtype)
        out[self.body] = of_words[self.ids]
        out[self.starts], out[self.ends] = start, end
        return out

    def keys(self, bits: int) -> np.ndarray:
        """For each order, a row: the key of the sequence that ends at each place, its order in the two lowest bits."""
        words = self.spread(_START, self.hashes, _END)
        out, sofar, before = np.empty((ORDERS, len(words)), np.uint64), words, words
        for k in range(ORDERS):
            before = np.concatenate([before[:1], before[:-1]])
            before[self.starts] = _START
            sofar = _mixed(sofar, before)
            out[k] = (sofar >> np.uint64(64 - bits)) << np.uint64(2) | np.uint64(k)
        return out


_SENT = T.StructType().add("kind", "integer").add("part", "integer").add("chunk", "long").add("a", "binary").add("b", "binary")


def _batch(rows: list[tuple], schema: T.StructType) -> pa.RecordBatch:
    types = {"integer": pa.int32(), "long": pa.int64(), "binary": pa.binary(), "array": pa.list_(pa.float64())}
    return pa.RecordBatch.from_arrays([pa.array(c, types[f.dataType.typeName()]) for c, f in zip(zip(*rows, strict=True) if rows else [()] * len(schema), schema, strict=True)], schema.names)


def _deal(batches: Iterator[pa.RecordBatch], size: int) -> Iterator[pa.RecordBatch]:
    """chunk and texts of each chunk: rows in a row, of `size` bytes of text or of the text that goes beyond, compressed."""
    at = TaskContext.get().partitionId() << 32
    for batch in batches:
        length = pc.binary_length(batch.column("text")).to_numpy(zero_copy_only=False).astype(np.int64)
        of = (np.cumsum(length + 1) - length - 1) // size
        first = np.flatnonzero(np.diff(of, prepend=-1)).tolist()
        for a, b in zip(first, [*first[1:], len(of)], strict=True):
            sink = pa.BufferOutputStream()
            with pa.ipc.new_stream(sink, batch.schema, options=pa.ipc.IpcWriteOptions(compression="zstd")) as writer:
                writer.write_batch(batch.slice(a, b - a))
            yield pa.RecordBatch.from_arrays([pa.array([at], pa.int64()), pa.array([sink.getvalue().to_pybytes()], pa.binary())], ["chunk", "texts"])
            at += 1


def _texts(packed: pa.Buffer) -> pa.RecordBatch:
    return pa.ipc.open_stream(packed).read_next_batch()


def _send(shape: Shape, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Words and keys of each chunk, with their counts in training texts, to their ranges."""
    word_edges, key_edges = shape.edges(64), shape.edges(shape.bits + 2)
    for batch in batches:
        for number, packed in zip(batch.column("chunk").to_pylist(), batch.column("texts"), strict=True):
            texts = _texts(packed.as_buffer())
            c, train = Chunk(texts.column("text")), ~texts.column("held_out").to_numpy(zero_copy_only=False)
            learned = np.repeat(train, c.lengths)
            counts = np.bincount(c.ids[learned], minlength=len(c.words)).astype(np.uint64)
            spaced = pc.binary_join_element_wise(c.words, "", " ")
            joined, ends = (spaced.buffers()[2] or pa.py_buffer(b"")).to_pybytes(), np.frombuffer(spaced.buffers()[1], np.int32).tolist()
            rows, cuts = [], [0, *np.searchsorted(c.hashes, word_edges).tolist(), len(c.words)]
            for part, (a, b) in enumerate(zip(cuts, cuts[1:], strict=False)):
                if b > a:
                    rows.append((0, part, number, joined[ends[a] : ends[b] - 1], pack(counts[a:b])))
            keys = c.keys(shape.bits)
            keys <<= np.uint64(1)
            keys |= train[c.text].astype(np.uint64)
            keys = keys.ravel()
            keys.sort()
            kinds = keys >> np.uint64(1)
            first = np.flatnonzero(np.concatenate([[True], kinds[1:] != kinds[:-1]]))
            counts, kinds = np.add.reduceat(keys & np.uint64(1), first), kinds[first]
            cuts = [0, *np.searchsorted(kinds, key_edges).tolist(), len(kinds)]
            for part, (a, b) in enumerate(zip(cuts, cuts[1:], strict=False)):
                if b > a:
                    rows.append((1, part, number, pack_sorted(kinds[a:b]), pack(counts[a:b])))
            yield _batch(rows, _SENT)


_BACK = T.StructType().add("kind", "integer").add("part", "integer").add("chunk", "long").add("a", "binary").add("b", "binary").add("tally", T.ArrayType(T.DoubleType()))


def _by_bits(n: np.ndarray) -> np.ndarray:
    """Occurrences, and kinds, by the bits of the count."""
    n = n[n > 0].astype(np.float64)
    bits = np.frexp(n)[1]
    return np.concatenate([np.bincount(bits, n, 64)[:64], np.bincount(bits, minlength=64)[:64]])


def _words_of_range(rows: list[tuple]) -> Iterator[tuple]:
    """The range's distinct words with their counts, first, and for each chunk where its words are among them."""
    ids: dict[bytes, int] = {}
    found = []
    for _, words, counts in rows:
        words = words.split(b" ")
        found.append((np.fromiter((ids.setdefault(x, len(ids)) for x in words), np.uint64, len(words)), unpack(counts)))
    total = np.zeros(len(ids), np.uint64)
    for at, n in found:
        total[at.astype(np.int64)] += n  # a chunk has a word once
    words, tally = list(ids), np.zeros(_TALLY + 256)
    tally[:128] = _by_bits(total)
    known = np.frombuffer(b"".join(w for w, n in zip(words, total.tolist(), strict=True) if n), np.uint8)
    tally[_TALLY:] = np.bincount(known, minlength=256)
    yield -1, b" ".join(words), pack(total), tally
    for (chunk, *_), (at, _) in zip(rows, found, strict=True):
        yield chunk, pack(at), None, None


def _keys_of_range(rows: list[tuple]) -> Iterator[tuple]:
    """For each chunk the counts over all chunks of the keys it sent."""
    keys = [unpack_sorted(a) for _, a, _ in rows]
    every, n = np.concatenate(keys), np.concatenate([unpack(b) for *_, b in rows])
    order = np.argsort(every, kind="stable")  # runs that are sorted
    kinds = every[order]
    new = np.concatenate([[True], kinds[1:] != kinds[:-1]])
    first = np.flatnonzero(new)
    sums, total = np.add.reduceat(n[order], first), np.empty(len(every), np.uint64)
    total[order] = sums[np.cumsum(new) - 1]
    tally, tag = np.zeros(_TALLY + 256), kinds[first] & np.uint64(3)
    for k in range(ORDERS):
        tally[128 * (k + 1) : 128 * (k + 2)] = _by_bits(sums[tag == k])
    yield -1, None, None, tally
    for (chunk, *_), x in zip(rows, np.split(total, np.cumsum([len(k) for k in keys])[:-1]), strict=True):
        yield chunk, pack(x), None, None


def _gather(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of rows sorted by kind and part, what goes back from each range."""

    def out(held: list[tuple], kind: int, part: int) -> Iterator[pa.RecordBatch]:
        rows = []
        for chunk, a, b, tally in (_keys_of_range if kind else _words_of_range)(held):
            rows.append((kind, part, chunk, a, b, tally))
            if len(rows) >= 1000:
                yield _batch(rows, _BACK)
                rows = []
        yield _batch(rows, _BACK)

    held, at = [], None
    for batch in batches:
        for kind, part, chunk, a, b in zip(*(batch.column(c).to_pylist() for c in ("kind", "part", "chunk")), batch.column("a"), batch.column("b"), strict=True):
            if (kind, part) != at:
                if held:
                    yield from out(held, *at)
                held, at = [], (kind, part)
            held.append((chunk, a.as_py(), b.as_py()))
    if held:
        yield from out(held, *at)


_SPELT = T.StructType().add("kind", "integer").add("part", "integer").add("chunk", "long").add("a", "binary").add("b", "binary")


def _spell(model: letters.Letters, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """For each chunk counts and spellings of its words; a range's own row comes first."""
    total = spelling = None
    for batch in batches:
        rows = []
        for part, chunk, a, b in zip(*(batch.column(c).to_pylist() for c in ("part", "chunk", "a", "b")), strict=True):
            if chunk < 0:
                total, spelling = unpack(b), model.spelled(a.split(b" ")).astype("<f4")
            else:
                at = unpack(a).astype(np.int64)
                rows.append((0, part, chunk, pack(total[at]), spelling[at].tobytes()))
        yield _batch(rows, _SPELT)


def concentrations(tally: np.ndarray) -> list[float]:
    """For words and the orders above: how much the order below counts, such that it tells as much as occurrences that are the only one of their kind."""
    n, kinds = tally[:_TALLY].reshape(ORDERS + 1, 2, 64).transpose(1, 0, 2)
    total = n[0].sum()
    out = [max(1.0, kinds[0, 1] * max(0.0, total - 1) / max(1.0, total - kinds[0, 1]))]
    for k in range(1, ORDERS + 1):
        some = kinds[k - 1] > 0
        seen, mean = n[k - 1][some], n[k - 1][some] / kinds[k - 1][some]
        low, high = -7.0, 14.0
        for _ in range(50):
            middle = (low + high) / 2
            m = 10.0**middle
            low, high = (middle, high) if (seen * m / (mean - 1 + m)).sum() < kinds[k, 1] else (low, middle)
        out.append(10.0**low)
    return out


@dataclass(frozen=True)
class Totals:
    """Of the training texts: tokens, distinct tokens, texts, and the weights of lower orders."""

    tokens: int
    kinds: int
    texts: int
    concentration: list[float]


def code(contexts: np.ndarray, hits: np.ndarray) -> np.ndarray:
    """4 x the cell of the states of the contexts (a row for each order, of one word first), and which of them predicts the token: 0 the longest, 3 none."""
    states = _STATE[np.minimum(contexts, STATES[-1])]
    cell = (states[2] * LEVELS + states[1]) * LEVELS + states[0]
    right = 2 * hits > contexts
    return 4 * cell + np.where(right[2], 0, np.where(right[1], 1, np.where(right[0], 2, 3)))


def fallback(count: np.ndarray, spelling: np.ndarray, contexts: np.ndarray, hits: np.ndarray, t: Totals) -> np.ndarray:
    """log10 of the probability by counts after the contexts, each order backed by the one below."""
    p = (count + t.concentration[0] * 10.0 ** np.maximum(spelling, -300)) / (t.tokens + t.concentration[0])
    for m, n, weight in zip(contexts, hits, t.concentration[1:], strict=True):
        p = (np.minimum(n, m) + weight * p) / (m + weight)
    return np.log10(np.maximum(p, 1e-300))


_FOUND = T.StructType().add("n_tokens", "long").add("n_known", "long").add("n_bytes", "long").add("base_score", "double").add("rest", "double").add("codes", T.ArrayType(T.IntegerType())).add("times", T.ArrayType(T.IntegerType())).add("tally", T.ArrayType(T.DoubleType()))


def _returned(mine: np.ndarray, counts: list[bytes]) -> np.ndarray:
    """The count of each key, from those of the distinct keys in order."""
    order = np.argsort(mine)
    mine = mine[order]
    place = np.cumsum(np.concatenate([[False], mine[1:] != mine[:-1]]))
    total = np.concatenate([unpack(x) for x in counts]).astype(np.int64)
    if len(total) != place[-1] + 1:
        raise RuntimeError("counts came back for other keys than were sent")
    out = np.empty(len(mine), np.int64)
    out[order] = total[place]
    return out


def _judge(texts: pa.RecordBatch, words: list[tuple[bytes, bytes]], keys: list[bytes], shape: Shape, t: Totals, tally: np.ndarray) -> pa.RecordBatch:
    """What a chunk's texts are told by; adds the codes of training tokens to the tally."""
    c = Chunk(texts.column("text"))
    held_out = texts.column("held_out").to_numpy(zero_copy_only=False)
    count = np.concatenate([np.zeros(0, np.uint64), *(unpack(a) for a, _ in words)]).astype(np.int64)
    spelling = np.concatenate([np.zeros(0, "<f4"), *(np.frombuffer(b, "<f4") for _, b in words)]).astype(np.float64)
    if len(count) != len(c.words):
        raise RuntimeError("counts came back for other words than were sent")
    # words, and sequences of two, three and four
    seen = np.concatenate([c.spread(t.texts, count, t.texts)[None], _returned(c.keys(shape.bits).ravel(), keys).reshape(ORDERS, -1)])
    told = np.ones(len(c.text), bool)
    told[c.starts] = False
    told = np.flatnonzero(told)
    row, n, count = c.text[told], texts.num_rows, seen[0, told]
    own = (~held_out[row]).astype(np.int64)  # a training token's own occurrence
    contexts, hits = seen[:ORDERS, told - 1] - own, seen[1:, told] - own
    del seen
    codes = code(contexts, hits)
    tally += np.bincount(codes[own > 0], minlength=4 * CELLS)
    base = np.log10((count + 0.1) / (t.tokens + 0.1 * (t.kinds + 1)))
    rest, open_ones = np.zeros(len(told)), np.flatnonzero(codes % 4 == 3)
    tail = c.spread(0.0, np.log10(1 - 10**END) + spelling, END)[told]
    rest[open_ones] = fallback((count - own)[open_ones], tail[open_ones], contexts[:, open_ones], hits[:, open_ones], t)
    both, times = np.unique(row * (4 * CELLS) + codes, return_counts=True)
    offsets = pa.array(np.searchsorted(both // (4 * CELLS), np.arange(n + 1)), pa.int32())
    sums = lambda x: pa.array(np.bincount(row, x, n))
    long = lambda x: pa.array(x.astype(np.int64))
    lists = [pa.ListArray.from_arrays(offsets, pa.array(x, pa.int32())) for x in (both % (4 * CELLS), times)]
    columns = [long(c.lengths + 1), long(np.bincount(row, count > 0, n)), pc.binary_length(texts.column("text")).cast(pa.int64()), sums(base), sums(rest), *lists, pa.nulls(n, pa.list_(pa.float64()))]
    return pa.RecordBatch.from_arrays([texts.column("doc_id"), texts.column("held_out"), *columns], ["doc_id", "held_out", *_FOUND.names])


def _states(odds: np.ndarray, weights: np.ndarray, gate: np.ndarray) -> np.ndarray:
    return np.clip((weights[gate] * odds).sum(1), -12, 12)


def mixed_table(tally: np.ndarray) -> np.ndarray:
    """log10 of the probability of every code, from the tally of training tokens.

    For each bit: a probability for each state of each context; weights for each
    state of the bit's own context, by online steps over pieces of the tally;
    corrections for each state and step of the mixed log odds.
    """
    tally = tally.reshape(CELLS, 4)
    cells = np.arange(CELLS)
    states = np.stack([cells % LEVELS, cells // LEVELS % LEVELS, cells // LEVELS**2])
    told, stopped = np.zeros((CELLS, 4)), np.zeros(CELLS)
    order = np.random.default_rng(0).permutation(CELLS)
    for outcome, k in enumerate(range(ORDERS - 1, -1, -1)):
        gate, here = states[k], states[k] > 0
        ones = np.where(here, tally[:, outcome], 0.0)
        n = np.where(here, tally[:, outcome:].sum(1), 0.0)
        odds = np.ones((CELLS, ORDERS + 1))
        for j in range(ORDERS):
            p = ((np.bincount(states[j], ones, LEVELS) + 0.4) / (np.bincount(states[j], n, LEVELS) + 1))[states[j]]
            odds[:, j] = np.log(p / (1 - p))
        weights, squares = np.tile(np.array([1 / ORDERS] * ORDERS + [0.0]), (LEVELS, 1)), np.full((LEVELS, ORDERS + 1), 1e-6)
        for _ in range(60):
            for some in np.array_split(order[here[order]], 8):
                error = ones[some] - n[some] / (1 + np.exp(-_states(odds[some], weights, gate[some])))
                met = np.maximum(np.bincount(gate[some], n[some], LEVELS), 1)[:, None]
                slope = np.stack([np.bincount(gate[some], error * odds[some, j], LEVELS) for j in range(ORDERS + 1)], 1) / met
                squares += slope**2
                weights += 0.05 * slope / np.sqrt(squares)
        z = _states(odds, weights, gate)
        step = gate * STEPS + np.clip(np.rint(z * 2) + STEPS // 2, 0, STEPS - 1).astype(int)
        prior = 1 / (1 + np.exp(-(np.arange(LEVELS * STEPS) % STEPS - STEPS // 2) / 2))
        corrected = (np.bincount(step, ones, LEVELS * STEPS) + 20 * prior) / (np.bincount(step, n, LEVELS * STEPS) + 20)
        p = (corrected[step] + 1 / (1 + np.exp(-z))) / 2
        told[:, outcome] = stopped + np.where(here, np.log10(p), 0)
        stopped += np.where(here, np.log10(1 - p), 0)
    told[:, 3] = stopped
    return told.ravel()


def score(docs: DataFrame) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score, bits_per_byte of each row of docs.

    A null or empty text is the end alone; a null id counts as the empty text
    in the fold; rows with one id are scored each; no rows give no rows; other
    columns are ignored. With no training rows only spellings tell words, each
    bit with one half. base_score counts a training text's own tokens, as the
    contract has it; score doesn't.
    """
    spark = docs.sparkSession
    sp = shuffle_partitions(spark)
    rows = docs.select("doc_id", (crc_mod("doc_id", FOLDS) == 0).alias("held_out"), F.coalesce("text", F.lit("")).alias("text"))
    size = rows.agg(F.sum(F.octet_length("text") + 2)).first()[0] or 0
    shape, text_bytes = Shape.of(size), max(CHUNK, isqrt(GROWTH * size))
    kind = T.StructType().add("chunk", "long").add("texts", "binary")
    chunks = materialize(rows.mapInArrow(lambda it: _deal(it, text_bytes), kind), "chunks")
    sent = chunks.mapInArrow(lambda it: _send(shape, it), _SENT)
    back = materialize(sent.repartition(sp, "kind", "part").sortWithinPartitions("kind", "part").mapInArrow(_gather, _BACK), "counts")

    tally = np.zeros(_TALLY + 256)
    for r in back.where("chunk < 0").select(F.posexplode("tally")).groupBy("pos").agg(F.sum("col").alias("n")).collect():  # one row for each number of a tally
        tally[r.pos] = r.n
    train = rows.where(~F.col("held_out")).count()
    by_count = tally[:128].reshape(2, 64).sum(1)
    total = Totals(int(by_count[0]) + train, int(by_count[1]) + (train > 0), train, concentrations(tally))
    lexicon = back.where("kind = 0 and chunk < 0")
    spell = spark.sparkContext.broadcast(letters.fit(lexicon.select(F.col("a").alias("words"), "b").mapInArrow(_known, "words binary"), tally[_TALLY:]))
    mine = back.where("kind = 0").select("part", "chunk", "a", "b").repartition(sp, "part").sortWithinPartitions("part", "chunk")
    spelt = mine.mapInArrow(lambda it: _spell(spell.value, it), _SPELT)

    meet = chunks.select("chunk", F.lit(-1).alias("kind"), F.lit(0).alias("part"), F.col("texts").alias("a"), F.lit(None).cast("binary").alias("b"))
    for more in (spelt, back.where("kind = 1 and chunk >= 0")):
        meet = meet.union(more.select("chunk", "kind", "part", "a", "b"))
    meet = meet.repartition(sp, "chunk").sortWithinPartitions("chunk", "kind", "part")
    found = T.StructType([docs.schema["doc_id"], T.StructField("held_out", T.BooleanType()), *_FOUND.fields])
    judged = materialize(meet.mapInArrow(lambda it: _judge_all(it, shape, total), found), "judged", compression="zstd")

    tally = np.zeros(4 * CELLS)
    for r in judged.where("tally is not null").select(F.posexplode("tally")).groupBy("pos").agg(F.sum("col").alias("n")).collect():  # one row for each code
        tally[r.pos] = r.n
    table = spark.sparkContext.broadcast(mixed_table(tally))  # a number for each code
    final = T.StructType(found.fields[:6]).add("train_tokens", "long").add("score", "double").add("bits_per_byte", "double")

    def finish(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            codes, times = (batch.column(c).flatten().to_numpy() for c in ("codes", "times"))
            row = np.repeat(np.arange(batch.num_rows), pc.list_value_length(batch.column("codes")).to_numpy())
            value = batch.column("rest").to_numpy() + np.bincount(row, table.value[codes] * times, batch.num_rows)
            n = batch.column("n_bytes").to_numpy().astype(float)
            each = pa.array(-value * np.log2(10) / np.maximum(n, 1), mask=n == 0)
            yield pa.RecordBatch.from_arrays([*batch.columns[:6], pa.array(np.full(batch.num_rows, total.tokens)), pa.array(value), each], names=final.names)

    out = judged.where("tally is null").select(*found.names[:6], "rest", "codes", "times").mapInArrow(finish, final)
    return out.select("doc_id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score", "bits_per_byte")


def _known(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The words of ranges that training texts have."""
    for batch in batches:
        out = [b" ".join(w for w, n in zip(a.split(b" "), unpack(b).tolist(), strict=True) if n) for a, b in zip(batch.column("words").to_pylist(), batch.column("b").to_pylist(), strict=True)]
        yield pa.RecordBatch.from_arrays([pa.array(out, pa.binary())], ["words"])


def _judge_all(batches: Iterator[pa.RecordBatch], shape: Shape, t: Totals) -> Iterator[pa.RecordBatch]:
    """Of rows sorted by chunk, kind and part: a chunk's texts, then counts of its words, then of its keys."""
    tally, texts, held = np.zeros(4 * CELLS), None, ([], [])
    last = None
    for batch in batches:
        for kind, a, b in zip(batch.column("kind").to_pylist(), batch.column("a"), batch.column("b"), strict=True):
            if kind < 0:
                if texts is not None:
                    yield (last := _judge(texts, *held, shape, t, tally))
                texts, held = _texts(a.as_buffer()), ([], [])
            elif kind == 0:
                held[0].append((a.as_py(), b.as_py()))
            else:
                held[1].append(a.as_py())
    if texts is not None:
        yield (last := _judge(texts, *held, shape, t, tally))
    if last is not None:
        yield pa.RecordBatch.from_arrays([pa.array([tally.tolist()], f.type) if f.name == "tally" else pa.nulls(1, f.type) for f in last.schema], names=last.schema.names)

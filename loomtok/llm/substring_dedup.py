"""Removal of repeated passages with FM-indexes.

A window of 35 words is a duplicate if its words start anywhere else. To keep
every search in one shard, windows are dealt by content: each belongs to its
least hashed 8-word gram (its anchor), consecutive windows of one anchor form a
segment, and equal windows always meet under equal anchors. Only segments whose
anchor occurs again can hold duplicates; equal segments enter once, with their
number. Each shard builds a compressed FM-index (the Burrows-Wheeler transform
of its segments in a wavelet matrix of packed bits); backward search walks the
windows of its segments, all at once, and drops those whose interval has shrunk
to themselves; what is left after 35 words occurs elsewhere.

An anchor under which too many different segments meet for one shard is settled
by hashes of whole windows instead, so no passage is left out however common.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from numpy.lib.stride_tricks import sliding_window_view
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loomtok.llm.common import materialize

WINDOW, GRAM = 35, 8
#: Words of one shard's index, about, and different segments of one anchor above which its windows are hashed.
SHARD, CROWD = 150_000, 2_000
_MIX, _STEP = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xD6E8FEB86659FD93)


def segments(words: list[bytes], window: int = WINDOW, gram: int = GRAM) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Anchor (signed), first window and number of windows of each segment; none if the text is shorter than a window."""
    n = len(words)
    if n < window:
        return (np.zeros(0, np.int64),) * 3
    h = np.fromiter(map(xxhash.xxh64_intdigest, words), np.uint64, n)
    m = n - gram + 1
    g = h[:m].copy()
    for j in range(1, gram):
        g *= _STEP
        g += h[j : m + j]
    g ^= g >> np.uint64(31)
    g *= _MIX
    g ^= g >> np.uint64(29)
    span = window - gram + 1
    at = sliding_window_view(g, span).argmin(1) + np.arange(n - window + 1)
    first = np.flatnonzero(np.concatenate([[True], at[1:] != at[:-1]]))
    return g[at[first]].view(np.int64), first, np.diff(np.concatenate([first, [len(at)]]))


class WaveletMatrix:
    """Ranks over a sequence of small integers, a packed bit vector for each bit of the alphabet."""

    def __init__(self, seq: np.ndarray, sigma: int) -> None:
        self.levels = []
        for b in range(max(1, int(sigma).bit_length()) - 1, -1, -1):
            bit = (seq >> b) & 1
            packed = np.packbits(np.concatenate([bit.astype(np.uint8), np.zeros(-len(bit) % 64 + 64, np.uint8)]), bitorder="little").view("<u8")
            before = np.concatenate([[0], np.bitwise_count(packed).astype(np.int32).cumsum(dtype=np.int32)])
            zeros = int(len(bit) - bit.sum())
            self.levels.append((b, packed, before, zeros))
            seq = np.concatenate([seq[bit == 0], seq[bit == 1]])

    def rank(self, c: np.ndarray, i: np.ndarray, start: np.ndarray) -> np.ndarray:
        """How many of c are before i; start is where c's block begins in the last level (see starts())."""
        for b, packed, before, zeros in self.levels:
            block = i >> 6
            ones = before[block] + np.bitwise_count(packed[block] & ((np.uint64(1) << (i & 63).astype(np.uint64)) - np.uint64(1))).astype(np.int64)
            i = np.where((c >> b) & 1, zeros + ones, i - ones)
        return i - start

    def starts(self, symbols: np.ndarray) -> np.ndarray:
        return self.rank(symbols, np.zeros(len(symbols), np.int64), np.zeros(len(symbols), np.int64))


class FMIndex:
    """Counts of patterns up to `depth` symbols; suffixes are sorted by no more than that."""

    def __init__(self, seq: np.ndarray, depth: int) -> None:
        n, rank, step = len(seq), seq.astype(np.int64), 1
        while step < depth:
            nxt = np.concatenate([rank[step:], np.full(min(step, n), -1)])[:n] + 1
            key = rank * (n + 2) + nxt
            rank = np.unique(key, return_inverse=True)[1].astype(np.int64)
            step *= 2
            if rank.max() == n - 1:
                break
        order = np.argsort(rank, kind="stable")
        sigma = int(seq.max()) + 1
        self.less = np.concatenate([[0], np.bincount(seq, minlength=sigma).cumsum()])
        self.bwt = WaveletMatrix(seq[order - 1], sigma)
        self.at = self.bwt.starts(np.arange(sigma))
        self.n = n

    def repeated(self, seq: np.ndarray, first: np.ndarray, length: int) -> np.ndarray:
        """Of each pattern seq[first : first + length], whether it occurs twice or more."""
        live = np.arange(len(first))
        low, high = np.zeros(len(first), np.int64), np.full(len(first), self.n)
        for k in range(length - 1, -1, -1):
            c = seq[first[live] + k]
            start = self.at[c]
            low, high = self.less[c] + self.bwt.rank(c, low, start), self.less[c] + self.bwt.rank(c, high, start)
            keep = high - low > 1
            live, low, high = live[keep], low[keep], high[keep]
            if not len(live):
                break
        out = np.zeros(len(first), bool)
        out[live] = True
        return out


def _search(shard: pd.DataFrame) -> pd.DataFrame:
    """Runs of repeated windows (h1, h2, first, windows) of the segments to be searched in one shard.

    Equal windows have equal anchors, so a shard that got too many words is
    searched some anchors at a time; an anchor has at most CROWD segments.
    """
    shard = shard.sort_values("g")
    size = (shard.windows.to_numpy() + WINDOW - 1).cumsum()
    ends = np.flatnonzero(np.concatenate([shard.g.to_numpy()[1:] != shard.g.to_numpy()[:-1], [True]])) + 1
    found, first, done = [], 0, 0
    for end in ends.tolist():
        if size[end - 1] - done >= SHARD or end == len(shard):
            part = shard.iloc[first:end]
            if part.ask.any():
                found.append(_search_index(part))
            first, done = end, size[end - 1]
    return pd.concat(found) if found else pd.DataFrame({c: np.zeros(0, np.int64) for c in ("h1", "h2", "first", "windows")})


def _search_index(shard: pd.DataFrame) -> pd.DataFrame:
    ids: dict[bytes, int] = {}
    parts, starts, at = [], [], 0
    for text in shard.text:
        words = text.split(b" ")
        parts.append(np.array([ids.setdefault(w, len(ids) + 1) for w in words] + [0], np.int64))
        starts.append(at)
        at += len(words) + 1
    seq = np.concatenate(parts)
    ask = np.flatnonzero(shard.ask.to_numpy())
    windows = shard.windows.to_numpy()
    row = np.repeat(ask, windows[ask])
    inside = np.arange(len(row)) - np.repeat(np.cumsum(windows[ask]) - windows[ask], windows[ask])
    found = FMIndex(seq, WINDOW).repeated(seq, np.array(starts, np.int64)[row] + inside, WINDOW)
    row, inside = row[found], inside[found]
    new = np.concatenate([[True], (row[1:] != row[:-1]) | (inside[1:] != inside[:-1] + 1)]) if len(row) else np.zeros(0, bool)
    at = np.flatnonzero(new)
    pick = row[at]
    return pd.DataFrame({"h1": shard.h1.to_numpy()[pick], "h2": shard.h2.to_numpy()[pick], "first": shard["first"].to_numpy()[pick] + inside[at], "windows": np.diff(np.concatenate([at, [len(row)]])).astype(np.int64)})


def _digest(words: list[bytes]) -> bytes:
    return hashlib.sha256(b" ".join(words)).digest()


def _first_pass(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        n, sha, anchors = [], [], []
        for text in batch.column("text").to_pylist():
            words = text.encode().split() if text else []
            n.append(len(words)), sha.append(_digest(words)), anchors.append(segments(words)[0])
        yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in ("doc_id", "h1", "h2")), pa.array(n, pa.int64()), pa.array(sha, pa.binary()), pa.array(anchors, pa.list_(pa.int64()))], ["doc_id", "h1", "h2", "n_words", "sha", "anchors"])


def _cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The segments with an anchor that occurs again, with their words and a hash of them."""
    for batch in batches:
        rows: list[tuple] = []
        for n, (text, again) in enumerate(zip(batch.column("text").to_pylist(), batch.column("again").to_pylist(), strict=True)):
            words = text.encode().split()
            again = set(again)
            for g, first, windows in zip(*(x.tolist() for x in segments(words)), strict=True):
                if g in again:
                    part = b" ".join(words[first : first + windows + WINDOW - 1])
                    h = xxhash.xxh3_128_intdigest(part)
                    rows.append((n, g, first, windows, (h & (1 << 63) - 1), h >> 65, part))
        n, *cols = zip(*rows, strict=True) if rows else ((),) * 7
        take = pa.array(n, pa.int64())
        yield pa.RecordBatch.from_arrays([*(batch.column(c).take(take) for c in ("h1", "h2", "copies")), *(pa.array(c, pa.int64()) for c in cols[:5]), pa.array(cols[5], pa.binary())], ["h1", "h2", "copies", "g", "first", "windows", "s1", "s2", "text"])


def _windows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Hashes of every window of segments under a crowded anchor."""
    for batch in batches:
        rows = []
        for n, (text, first, windows) in enumerate(zip(batch.column("text").to_pylist(), batch.column("first").to_pylist(), batch.column("windows").to_pylist(), strict=True)):
            words = text.split(b" ")
            for k in range(windows):
                h = xxhash.xxh3_128_intdigest(b" ".join(words[k : k + WINDOW]))
                rows.append((n, first + k, h & (1 << 63) - 1, h >> 65))
        n, *cols = zip(*rows, strict=True) if rows else ((),) * 4
        take = pa.array(n, pa.int64())
        yield pa.RecordBatch.from_arrays([*(batch.column(c).take(take) for c in ("h1", "h2")), *(pa.array(c, pa.int64()) for c in cols)], ["h1", "h2", "first", "w1", "w2"])


def _remove(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        removed, sha = [], []
        for text, marks in zip(batch.column("text").to_pylist(), batch.column("marks").to_pylist(), strict=True):
            words = text.encode().split()
            edge = np.zeros(len(words) + 1, np.int64)
            for m in marks:
                edge[m["first"]] += 1
                edge[m["first"] + m["windows"] + WINDOW - 1] -= 1
            keep = edge.cumsum()[:-1] == 0
            removed.append(int(len(words) - keep.sum()))
            sha.append(_digest([w for w, k in zip(words, keep.tolist(), strict=True) if k]))
        yield pa.RecordBatch.from_arrays([batch.column("h1"), batch.column("h2"), pa.array(removed, pa.int64()), pa.array(sha, pa.binary())], ["h1", "h2", "removed", "kept"])


def _apart(c: str) -> Column:
    """Hides how a table is partitioned, so that a hot key can be split in a join."""
    return F.col(c).bitwiseXOR(F.lit(0)).alias(c)


def remove_repeats(docs: DataFrame) -> DataFrame:
    """doc_id, n_words, n_removed, kept_sha256 of each row of docs.

    Null, empty and short texts lose nothing; rows with the same or a null id
    are documents of their own, so repeated rows lose every window; no rows give
    no rows; other columns are ignored. Texts count as equal by 128 bits of hash.
    """
    keyed = docs.select("doc_id", "text", F.xxhash64("text").alias("h1"), F.xxhash64(F.lit(1), "text").alias("h2"))
    kind = f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, h1 long, h2 long, n_words long, sha binary, anchors array<long>"
    seen = materialize(keyed.select("doc_id", "h1", "h2", "text").mapInArrow(_first_pass, kind), "anchors")

    every = seen.select("h1", "h2", F.explode("anchors").alias("g"))
    again = every.groupBy("g").count().where("count > 1").select(_apart("g"))
    asked = every.join(again, "g").groupBy("h1", "h2").agg(F.collect_set("g").alias("again"))
    copies = seen.groupBy("h1", "h2").agg(F.count("*").alias("copies"))
    texts = keyed.where("text is not null").select("h1", "h2", "text").dropDuplicates(["h1", "h2"])
    held = materialize(texts.join(asked, ["h1", "h2"]).join(copies, ["h1", "h2"]), "texts")

    cut = materialize(held.mapInArrow(_cut, "h1 long, h2 long, copies long, g long, first long, windows long, s1 long, s2 long, text binary"), "segments")
    same = ["g", "s1", "s2"]
    kinds = cut.groupBy(same).agg(F.sum("copies").alias("n"), F.min(F.struct("h1", "h2", "first")).alias("one"))
    kinds = materialize(kinds, "kinds")
    met = kinds.groupBy("g").agg(F.count("*").alias("met")).where("met > 1").select(_apart("g"), "met")
    wanted = kinds.select("g", "s1", "s2", "n", "one").join(met, "g").select(*same, "one.*", (F.col("n") == 1).alias("ask"), (F.col("met") > CROWD).alias("crowd"))
    index = materialize(cut.drop("copies").join(wanted.select(*(_apart(c) for c in same), "h1", "h2", "first", "ask", "crowd"), [*same, "h1", "h2", "first"]), "index")

    words = index.where("not crowd").agg(F.sum(F.col("windows") + WINDOW - 1)).first()[0] or 0
    shards = max(1, -(-words // SHARD))
    dealt = index.where("not crowd").select(F.pmod(F.xxhash64("g"), F.lit(shards)).alias("shard"), "g", "h1", "h2", "first", "windows", "text", "ask")
    by_index = dealt.groupBy("shard").applyInPandas(_search, "h1 long, h2 long, first long, windows long")
    hashed = index.where("crowd").select("h1", "h2", "first", "windows", "text").mapInArrow(_windows, "h1 long, h2 long, first long, w1 long, w2 long")
    twice = hashed.groupBy("w1", "w2").count().where("count > 1").select(_apart("w1"), _apart("w2"))
    by_hash = hashed.join(twice, ["w1", "w2"]).select("h1", "h2", "first", F.lit(1).cast("long").alias("windows"))
    repeated = kinds.where("n > 1").select(*(_apart(c) for c in same))
    equal = cut.select(*same, "h1", "h2", "first", "windows").join(repeated, same).select("h1", "h2", "first", "windows")
    marks = equal.union(by_index).union(by_hash).groupBy("h1", "h2").agg(F.collect_list(F.struct("first", "windows")).alias("marks"))
    done = held.select("h1", "h2", "text").join(marks, ["h1", "h2"]).mapInArrow(_remove, "h1 long, h2 long, removed long, kept binary")
    out = seen.drop("anchors").join(done, ["h1", "h2"], "left")
    return out.select("doc_id", "n_words", F.coalesce("removed", F.lit(0).cast("long")).alias("n_removed"), F.lower(F.hex(F.coalesce("kept", "sha"))).alias("kept_sha256"))

"""Encoding: text to ids.

No rule holds white space, so a text can be cut at any blank: its ids are those
of the parts, each with its blank in front, and the ids of a part are those of
its runs of white space and of anything else. Each worker keeps the ids of
parts it has met, as bytes, and a batch becomes one Arrow list column with a
single join. Models without merges map UTF-8 bytes to ids for a whole batch at once.
"""

from __future__ import annotations

import heapq
import re
import unicodedata
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from loomtok.config import SWEEP_RANKS, SWEEPS, EncodingMode, TokenizerError, UnknownTokenError
from loomtok.functions.text import byte_values
from loomtok.model import Model

_RUNS = re.compile("[^\\S\x1c-\x1f]+|[\\S\x1c-\x1f]+")
#: Parts in one generation of a worker's cache, and characters above which a part isn't kept.
CACHED, LONG = 200_000, 64


def sweep(ids: list[int], rules: dict[tuple[int, int], int]) -> list[int]:
    """One pass from the left; a merged token meets its right neighbour next."""
    out: list[int] = []
    for x in ids:
        if out and (new := rules.get((out[-1], x))) is not None:
            out[-1] = new
        else:
            out.append(x)
    return out


def lowest_first(ids: list[int], rules: dict[tuple[int, int], tuple[int, int]]) -> list[int]:
    """Merges all places of the pair of the lowest rank, from the left, until no pair has a rule.

    Ids are linked to their neighbours, and a heap holds (rank, place) of every
    pair, so that a run costs n log n; a place that changed is passed over.
    """
    n = len(ids)
    if n < 2:
        return ids
    ids, after, before = list(ids), [*range(1, n), -1], [-1, *range(n - 1)]
    heap = [(rules[p][0], i) for i, p in enumerate(zip(ids, ids[1:], strict=False)) if p in rules]
    heapq.heapify(heap)
    while heap:
        rank, made = heap[0][0], []
        while heap and heap[0][0] == rank:  # the places there are now, before any that this makes
            i = heapq.heappop(heap)[1]
            j = after[i]
            if ids[i] is None or j < 0 or (rule := rules.get((ids[i], ids[j]))) is None or rule[0] != rank or made and made[-1] == i:
                continue
            ids[i], ids[j], k = rule[1], None, after[j]
            after[i], after[j] = k, -1
            if k >= 0:
                before[k] = i
            made.append(i)
        for i in made:
            for x in (before[i], i):
                if x >= 0 and ids[x] is not None and after[x] >= 0 and (rule := rules.get((ids[x], ids[after[x]]))) is not None:
                    heapq.heappush(heap, (rule[0], x))
    return [x for x in ids if x is not None]


class Encoder:
    """Ids of texts under a model; one lives in each worker."""

    def __init__(self, model: Model) -> None:
        self.model = model
        self.mode, self.byte_ids = model.config.encoding_mode, model.byte_ids
        ranked = {(a, b): (r, n) for r, (a, b, n) in enumerate(model.merges)}
        self.every = ranked
        self.early = {p: n for p, (r, n) in ranked.items() if r < SWEEP_RANKS}
        self.late = {p: x for p, x in ranked.items() if x[0] >= SWEEP_RANKS}
        self.new: dict[str, bytes] = {}
        self.old: dict[str, bytes] = {}
        literals = {model.tokens[i].decode(): i for i in model.specials.values()}
        self.literals = literals if model.config.allow_special_literals else {}
        self.cut = re.compile("(" + "|".join(map(re.escape, sorted(self.literals, key=len, reverse=True))) + ")") if self.literals else None
        if self.mode is EncodingMode.CHAR_LEVEL:
            self.strings = {t.decode("utf-8", "replace"): i for i, (t, k) in enumerate(zip(model.tokens, model.kinds, strict=True)) if k != "byte" or t.isascii()}
            self.longest = max(map(len, self.strings))
            held = {x for rule in model.merges for x in rule}
            self.parted = not any(" " in t and len(t) > 1 for t in self.strings) and not any(b" " in model.tokens[i] for i in held)

    def run(self, run: str) -> list[int]:
        """Ids of one run under the byte level."""
        ids = [self.byte_ids[b] for b in run.encode()]
        if self.model.config.canonical:
            return lowest_first(ids, self.every)
        for _ in range(SWEEPS):
            now = sweep(ids, self.early)
            if len(now) == len(ids):
                break
            ids = now
        return lowest_first(ids, self.late) if self.late else ids

    def _part(self, part: str) -> bytes:
        if self.mode is EncodingMode.CHAR_LEVEL:
            return np.array(self.characters(part), "<i4").tobytes()
        return np.array([i for r in _RUNS.findall(part) for i in self.run(r)], "<i4").tobytes()

    def _missed(self, part: str) -> bytes:
        x = self.old.get(part) or self._part(" " + part)
        if len(part) <= LONG:
            if len(self.new) >= CACHED:
                self.old, self.new = self.new, {}
            self.new[part] = x
        return x

    def characters(self, text: str) -> list[int]:
        """Longest tokens by grapheme, then merges, lowest rank first; unknown graphemes are an error."""
        import regex

        parts, out, i = regex.findall(r"\X", text), [], 0
        while i < len(parts):
            for j in range(min(len(parts), i + self.longest), i, -1):
                if (x := self.strings.get("".join(parts[i:j]))) is not None:
                    out.append(x)
                    i = j
                    break
            else:
                raise UnknownTokenError(parts[i])
        return lowest_first(out, self.every)

    def plain(self, text: str) -> bytes:
        if self.mode is EncodingMode.CHAR_LEVEL:
            import regex

            # a blank begins a grapheme, but after those that take in what follows
            if not self.parted or not text.isascii() and regex.search(r"\p{GCB=Prepend}", text):
                return self._part(text)
        elif not self.model.merges:
            return np.array(self.byte_ids, "<i4")[np.frombuffer(text.encode(), np.uint8)].tobytes()
        first, *rest = text.split(" ")
        missed = self._missed
        return self._part(first) + b"".join([self.new.get(x) or missed(x) for x in rest])

    def __call__(self, text: str) -> bytes:
        """Ids as little-endian int32, after the size guard and NFC; special tokens aren't added here."""
        if (n := len(text) if text.isascii() else len(text.encode())) > self.model.config.max_text_bytes:
            raise TokenizerError(f"text of {n} bytes; the limit is {self.model.config.max_text_bytes}")
        if not text.isascii():
            text = unicodedata.normalize("NFC", text)
        if self.cut is None:
            return self.plain(text)
        return b"".join(np.array([self.literals[x]], "<i4").tobytes() if i % 2 else self.plain(x) for i, x in enumerate(self.cut.split(text)))


def _list_array(parts: list[bytes | None]) -> pa.Array:
    lengths = np.array([0 if p is None else len(p) // 4 for p in parts], np.int32)
    offsets = np.concatenate([[0], lengths.cumsum()]).astype(np.int32)
    values = pa.Array.from_buffers(pa.int32(), int(offsets[-1]), [None, pa.py_buffer(b"".join(p for p in parts if p))])
    mask = pa.array([p is None for p in parts]) if None in parts else None
    return pa.ListArray.from_arrays(pa.array(offsets), values, mask=mask)


def encode(df: DataFrame, model: Model, column: str = "text", out: str = "ids", special: bool = False) -> DataFrame:
    """df and the ids of a text column; null texts have null ids. No shuffle; works on streams."""
    shared = df.sparkSession.sparkContext.broadcast(model)  # a vocabulary
    start = [model.specials["bos"]] if special and "bos" in model.specials else []
    end = [model.specials["eos"]] if special and "eos" in model.specials else []
    at = df.columns.index(column)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = Encoder(shared.value)
        a, b = (np.array(x, "<i4").tobytes() for x in (start, end))
        for batch in batches:
            ids = [None if x is None else a + encoder(x) + b for x in batch.column(at).to_pylist()]
            yield pa.RecordBatch.from_arrays([*batch.columns, _list_array(ids)], names=[*batch.schema.names, out])

    return df.mapInArrow(run, T.StructType([*df.schema.fields, T.StructField(out, T.ArrayType(T.IntegerType()))]))


def add_special(ids: Column, bos: int | None = None, eos: int | None = None) -> Column:
    parts = ([F.array(F.lit(bos))] if bos is not None else []) + [ids] + ([F.array(F.lit(eos))] if eos is not None else [])
    return F.concat(*parts)


def within_limit(c: Column, limit: int) -> Column:
    return F.octet_length(c) <= limit


def byte_ids(c: Column, offset: int = 0) -> Column:
    """Ids of an untrained model whose special tokens take the first `offset` ids; stays in the JVM."""
    return F.transform(byte_values(c), lambda b: b + F.lit(offset)) if offset else byte_values(c)


def rule_map(rules: list[tuple[int, int, int]]) -> Column:
    """A literal map of l * 65536 + r to the new id, for small models."""
    return F.create_map(*(F.lit(x) for a, b, n in rules for x in (a * 65536 + b, n)))


def fold_sweep(ids: Column, rules: Column) -> Column:
    """One greedy sweep as an aggregate: right for short runs, whose arrays are cheap to copy."""

    def step(acc: Column, x: Column) -> Column:
        new = F.try_element_at(rules, F.try_element_at(acc, F.lit(-1)) * 65536 + x)
        return F.when(new.isNull(), F.concat(acc, F.array(x))).otherwise(F.concat(F.slice(acc, 1, F.size(acc) - 1), F.array(new)))

    return F.aggregate(ids, F.array().cast("array<int>"), step)


def encode_fold(df: DataFrame, key: str, column: str, ids: Column, rules: list[tuple[int, int, int]]) -> DataFrame:
    """key and ids of each row under a small rule table, in Catalyst alone: distinct words are folded once and joined back."""
    table = rule_map(rules)
    words = df.select(key, F.posexplode(F.split(column, r"((?<=\s)(?=\S))|((?<=\S)(?=\s))")).alias("pos", "run"))
    kinds = words.select("run").distinct().withColumn("ids", ids)
    for _ in range(SWEEPS):
        kinds = kinds.withColumn("ids", fold_sweep(F.col("ids"), table))
    return words.join(kinds, "run").groupBy(key).agg(F.flatten(F.transform(F.array_sort(F.collect_list(F.struct("pos", "ids"))), lambda x: x["ids"])).alias("ids"))


def meta(ids: Column) -> list[Column]:
    """Length, emptiness and ids as decimal strings."""
    return [F.size(ids).alias("n_ids"), (F.size(ids) == 0).alias("is_empty"), F.transform(ids, lambda x: x.cast("string")).alias("tokens")]

"""SimHash near-duplicates with a generalised pigeonhole search.

The 64 bits are grouped so that correlated bits share a partition. If two
fingerprints differ in at most t bits, then with thresholds t_i that sum to
t - m + 1 over m partitions some partition i differs in at most t_i bits (-1:
never probed). Thresholds, and m itself, come from a dynamic program over the
estimated candidates of every partition and threshold. Fingerprints are probed
once each, however many documents share them; values held by very many are
split again on their other bits in the same way, so nothing is left out.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import accumulate, combinations, pairwise
from math import comb

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomtok.llm.common import materialize
from loomtok.llm.components import components

SHINGLE, SEED, DIFFER = 3, 42, 2
#: Fingerprints with one value of a partition from which the value is split again.
HEAVY = 1_000


def majority(hashes: np.ndarray) -> int:
    """Signed 64 bits: each is 1 if set in over half of these hashes of 64 bits. No hashes: 0."""
    bits = np.unpackbits(hashes.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
    return int(np.packbits(2 * bits.sum(0) > len(hashes), bitorder="little").view("<i8")[0])


def fingerprint(text: str | None, shingle: int = SHINGLE) -> int:
    """The majority of the hashes of the shingles. No words: 0."""
    words = text.encode().lower().split() if text else ()
    if not words:
        return 0
    joined = b" ".join(words)
    if len(words) <= shingle:
        hashes = [xxhash.xxh64_intdigest(joined, SEED)]
    else:
        ends = list(accumulate(map(len, words), lambda a, n: a + n + 1))
        starts, digest = [0, *(e + 1 for e in ends)], xxhash.xxh64_intdigest
        hashes = [digest(joined[a:b], SEED) for a, b in zip(starts, ends[shingle - 1 :], strict=False)]
    return majority(np.array(hashes, "<u8"))


def fingerprints(docs: DataFrame, shingle: int = SHINGLE) -> DataFrame:
    """doc_id and fp of each row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            fp = pa.array([fingerprint(x, shingle) for x in batch.column("text").to_pylist()], pa.int64())
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), fp], ["doc_id", "fp"])

    return docs.select("doc_id", "text").mapInArrow(run, docs.select("doc_id").schema.add("fp", "long"))


def correlations(fps: DataFrame) -> np.ndarray:
    """64 x 64 absolute correlations of the bits, over all rows."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        both = np.zeros((65, 65))
        for batch in batches:
            v = batch.column("fp").to_numpy()
            bits = np.unpackbits(v.astype("<i8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
            b = np.concatenate([bits, np.ones((len(v), 1), np.uint8)], 1).astype(np.float64)
            both += b.T @ b
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(65 * 65)), pa.array(both.ravel())], ["at", "n"])

    out = np.zeros(65 * 65)
    for r in fps.select("fp").mapInArrow(run, "at long, n double").groupBy("at").agg(F.sum("n").alias("n")).collect():  # 65 x 65 rows
        out[r["at"]] = r["n"]
    out = out.reshape(65, 65) / max(1.0, out[-1])
    p = out[:64, 64]
    return np.abs((out[:64, :64] - np.outer(p, p)) / np.sqrt(np.maximum(np.outer(p * (1 - p), p * (1 - p)), 1e-9)))


def group_bits(corr: np.ndarray, bits: list[int], parts: int) -> list[list[int]]:
    """Groups of nearly one size; each grows by the bit that correlates most with it."""
    left, out = list(bits), []
    for k in range(parts):
        size = len(left) // (parts - k)
        group = [max(left, key=lambda b: (corr[b, left].sum(), -b))]
        left.remove(group[0])
        while len(group) < size:
            group.append(max(left, key=lambda b: (corr[b, group].sum(), -b)))  # noqa: B023
            left.remove(group[-1])
        out.append(sorted(group))
    return out


def allocate(costs: list[list[float]], total: int) -> tuple[float, list[int]]:
    """The cheapest thresholds, each from -1, that sum to total; costs[i][t + 1] is what partition i costs at t."""
    best = {0: (0.0, [])}
    for row in costs:
        then: dict[int, tuple[float, list[int]]] = {}
        for s, (cost, chosen) in best.items():
            for t, c in enumerate(row, -1):
                if s + t not in then or cost + c < then[s + t][0]:
                    then[s + t] = (cost + c, [*chosen, t])
        best = then
    return best[total]


def _mask(bits: list[int]) -> int:
    x = sum(1 << b for b in bits)
    return x - (1 << 64) if x >> 63 else x


def plan(fps: DataFrame, differ: int = DIFFER) -> list[tuple[list[int], int]]:
    """(bits, threshold) of each partition that is probed."""
    corr = correlations(fps)
    options = [group_bits(corr, list(range(64)), m) for m in range(2, differ + 2)]
    every = [g for o in options for g in o]
    values = F.explode(F.array(*(F.struct(F.lit(i).alias("part"), F.col("fp").bitwiseAND(F.lit(_mask(g))).alias("value")) for i, g in enumerate(every)))).alias("x")
    counts = fps.select(values).groupBy("x.part", "x.value").count()
    same = {r.part: (r.n, r.pairs) for r in counts.groupBy("part").agg(F.sum("count").alias("n"), F.sum(F.col("count") * (F.col("count") - 1) / 2).alias("pairs")).collect()}
    found = []
    for o in options:
        costs = []
        for g in o:
            n, pairs = same.get(every.index(g), (0, 0.0))
            near = [sum(comb(len(g), j) for j in range(t + 1)) for t in range(differ + 1)]
            costs.append([0.0, *(20.0 * n * x + max(pairs, n * n / 2 ** len(g) / 2) * x for x in near)])
        found.append((*allocate(costs, differ - len(o) + 1), o))
    _, thresholds, groups = min(found, key=lambda x: x[0])
    return [(g, t) for g, t in zip(groups, thresholds, strict=True) if t >= 0]


def _probes(fp: str, part: int, bits: list[int], t: int) -> F.Column:
    """The values within t bits of this one's, as an array of structs (part, value)."""
    flips = [_mask(list(c)) for k in range(t + 1) for c in combinations(bits, k)]
    value = F.col(fp).bitwiseAND(F.lit(_mask(bits)))
    return F.transform(F.array(*map(F.lit, flips)), lambda x: F.struct(F.lit(part).alias("part"), value.bitwiseXOR(x).alias("value")))


def links(fps: DataFrame, differ: int = DIFFER, heavy: int = HEAVY) -> DataFrame:
    """Pairs a < b of distinct fingerprints that differ in at most `differ` bits; a pair may come more than once."""
    probed = plan(fps, differ)
    held = F.flatten(F.array(*(_probes("fp", i, g, 0) for i, (g, _) in enumerate(probed))))
    sought = F.flatten(F.array(*(_probes("fp", i, g, t) for i, (g, t) in enumerate(probed))))
    index = fps.select("fp", F.explode(held).alias("x")).select("fp", "x.part", "x.value")
    probe = fps.select("fp", F.explode(sought).alias("x")).select("fp", "x.part", "x.value") if any(t for _, t in probed) else index
    full = index.groupBy("part", "value").count().where(F.col("count") >= heavy).select("part", "value", F.lit(True).alias("full"))

    def split(rows: DataFrame) -> DataFrame:
        """Rows of full values once for each of differ + 1 groups of the other bits, with those bits; others with 0."""
        subs = F.when(F.lit(False), F.array(F.lit(0).cast("long")))
        for i, (g, _) in enumerate(probed):
            rest = [b for b in range(64) if b not in g]
            cuts = [len(rest) * k // (differ + 1) for k in range(differ + 2)]
            subs = subs.when(F.col("full") & (F.col("part") == i), F.array(*(F.col("fp").bitwiseAND(F.lit(_mask(rest[a:b]))) for a, b in pairwise(cuts))))
        return rows.join(full, ["part", "value"], "left").select("fp", "part", "value", F.posexplode(subs.otherwise(F.array(F.lit(0).cast("long")))).alias("sub", "subvalue"))

    key = ["part", "value", "sub", "subvalue"]
    a, b = split(index).withColumnRenamed("fp", "a"), split(probe).withColumnRenamed("fp", "b")
    near = F.bit_count(F.col("a").bitwiseXOR(F.col("b"))) <= differ
    order = F.col("a") < F.col("b") if probe is index else F.col("a") != F.col("b")
    on = [F.col(f"l.{k}") == F.col(f"r.{k}") for k in key]
    return a.alias("l").join(b.alias("r"), [*on, near, order]).select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"))


def near_duplicates(docs: DataFrame, shingle: int = SHINGLE, differ: int = DIFFER) -> DataFrame:
    """doc_id, fingerprint, component_id of each row of docs.

    Null and wordless texts have fingerprint 0 and link like others. A null id
    takes part in links and never is the id of a component, unless there is no
    other (then null). Repeated rows are returned each; no rows give no rows;
    other columns are ignored.
    """
    rows = materialize(fingerprints(docs, shingle), "fingerprints")
    nodes = materialize(rows.groupBy("fp").agg(F.min("doc_id").alias("first")), "distinct")
    tree = components(links(nodes.select("fp"), differ))
    named = nodes.join(tree.withColumnRenamed("node", "fp"), "fp", "left").select("fp", "first", F.coalesce("component", "fp").alias("root"))
    least = named.groupBy("root").agg(F.min("first").alias("component_id")).select(F.col("root").bitwiseXOR(F.lit(0)).alias("root"), "component_id")
    of = named.join(least, "root").select(F.col("fp").bitwiseXOR(F.lit(0)).alias("fp"), "component_id")
    return rows.join(of, "fp").select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


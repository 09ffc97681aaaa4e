"""Best-fit packing of token sequences, in bulk-synchronous sweeps.

Lengths are whole numbers up to the capacity, so documents and gaps, once
sorted by size, are runs: so many of one length, so many of one gap. A sweep
has every run of a band of lengths seek its successor, the smallest gap that
holds it; where several want the same gap, the longest goes first and the rest
try again in the next sweep; then the gaps are updated. The sweeps exchange
runs only: at most `capacity` of documents, and as many kinds of gaps, whatever
the corpus holds. Range sort and ranks of the documents themselves are
distributed, and each document finds its place from its rank within its run.
"""

from __future__ import annotations

import zlib
from bisect import bisect_left
from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from loomtok.llm.bpe import ChunkEncoder
from loomtok.llm.common import materialize, shuffle_partitions

CAPACITY = 2048


def pieces(docs: DataFrame, path: str, capacity: int = CAPACITY, end_id: int = 0) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32: each text's ids and end_id, longer ones cut so that the first piece is the short one."""
    kind = docs.select("doc_id").schema.add("piece", "integer").add("start", "long").add("length", "long").add("ids_crc32", "long")

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder, last = ChunkEncoder(path, bytes), int(end_id).to_bytes(4, "little")
        for batch in batches:
            row, piece, start, length, crc = [], [], [], [], []
            for i, text in enumerate(batch.column("text").to_pylist()):
                ids = memoryview(b"".join(encoder.values(text)) + last if text else last)
                n, at = len(ids) // 4, 0
                k = -(-n // capacity)
                for j in range(k):
                    size = n - capacity * (k - 1) if j == 0 else capacity
                    row.append(i), piece.append(j), start.append(at), length.append(size)
                    crc.append(zlib.crc32(ids[4 * at : 4 * (at + size)]))
                    at += size
            yield pa.RecordBatch.from_arrays([batch.column("doc_id").take(pa.array(row, pa.int32())), pa.array(piece, pa.int32()), *(pa.array(x, pa.int64()) for x in (start, length, crc))], names=kind.names)

    return docs.select("doc_id", "text").mapInArrow(cut, kind)


def sweep(counts: np.ndarray, capacity: int) -> tuple[list[tuple[int, ...]], int]:
    """Places for counts[l] pieces of each length l, and the number of sequences.

    A place is (length, first rank, how many, first sequence, pieces a sequence, offset).
    """
    left, rank = counts.astype(np.int64).tolist(), [0] * (capacity + 1)
    places: list[tuple[int, ...]] = []
    gaps: dict[int, list[tuple[int, int]]] = defaultdict(list)
    sequences = 0

    def put(length: int, first: int, bins: int, gap: int) -> int:
        """Into `bins` sequences that have the gap; gives how many of those stay untouched."""
        each, n = gap // length, left[length]
        full, rest = divmod(min(n, each * bins), each)
        if full:
            places.append((length, rank[length], full * each, first, each, capacity - gap))
            if gap - each * length:
                gaps[gap - each * length].append((first, full))
        if rest:
            places.append((length, rank[length] + full * each, rest, first + full, each, capacity - gap))
            gaps[gap - rest * length].append((first + full, 1))
        left[length] -= full * each + rest
        rank[length] += full * each + rest
        return bins - full - (rest > 0)

    parts = 1
    top = capacity
    while top > 0:
        low = capacity // (parts + 1) if parts < 16 else 0
        band = [x for x in range(top, low, -1) if left[x]]
        while band:
            sizes = sorted(k for k, v in gaps.items() if v)
            wanted: dict[int, list[int]] = defaultdict(list)
            for length in band:
                if (i := bisect_left(sizes, length)) < len(sizes):
                    wanted[sizes[i]].append(length)
            for gap, lengths in wanted.items():
                runs = gaps.pop(gap)
                while runs and lengths:
                    first, bins = runs.pop()
                    if untouched := put(lengths[0], first, bins, gap):
                        runs.append((first + bins - untouched, untouched))
                    if not left[lengths[0]]:
                        lengths.pop(0)
                if runs:
                    gaps[gap] += runs
            if not wanted:
                length = band[0]
                bins = -(-left[length] // (capacity // length))
                put(length, sequences, bins, capacity)
                sequences += bins
            band = [x for x in band if left[x]]
        top, parts = low, parts + 1
    return places, sequences


def pack(docs: DataFrame, path: str, capacity: int = CAPACITY, end_id: int = 0) -> DataFrame:
    """Packs all texts into sequences of at most `capacity` tokens; one row for each piece.

    Returns doc_id, piece, start, length, ids_crc32, sequence_id, offset. A null
    or empty text is the end id alone; repeated rows are packed each; no rows
    give no rows; columns other than doc_id and text are ignored.
    """
    spark = docs.sparkSession
    cut = materialize(pieces(docs, path, capacity, end_id), "pieces")
    counts = np.zeros(capacity + 1, np.int64)
    for r in cut.groupBy("length").count().collect():  # at most `capacity` rows
        counts[r.length] = r["count"]
    places, _ = sweep(counts, capacity)
    plan = np.array(sorted(places), np.int64).reshape(-1, 6)
    shared = spark.sparkContext.broadcast(plan)

    key = ["length", "bucket"]
    salted = cut.withColumn("bucket", F.pmod(F.xxhash64("doc_id", "piece"), F.lit(shuffle_partitions(spark))).cast("int"))
    before = Window.partitionBy("length").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    offsets = salted.groupBy(key).count().select(*key, F.coalesce(F.sum("count").over(before), F.lit(0)).alias("first"))
    ranked = salted.withColumn("rank", F.row_number().over(Window.partitionBy(key).orderBy("doc_id", "piece", "start", "ids_crc32")) - 1)
    ranked = ranked.join(offsets, key).select(*cut.columns, (F.col("rank") + F.col("first")).alias("rank"))
    kind = ranked.drop("rank").schema.add("sequence_id", "long").add("offset", "long")

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        length, first, n, sequence, each, offset = shared.value.T
        order = (length << 44) + first
        for batch in batches:
            size, rank = batch.column("length").to_numpy(), batch.column("rank").to_numpy()
            at = np.searchsorted(order, (size << 44) + rank, "right") - 1
            turn, place = np.divmod(rank - first[at], each[at])
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array(sequence[at] + turn), pa.array(offset[at] + place * size)], names=kind.names)

    return ranked.mapInArrow(place, kind)

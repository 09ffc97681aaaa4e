"""Token counts by a map-side two-tier lookup.

Tier 1 is a broadcast hash table of the lengths of the most frequent chunks of
the whole corpus, at most TOP of them; tier 2 is each worker's own bounded
cache, whose misses are encoded. No chunk is ever shuffled: the frequent ones
come from bounded heavy-hitter summaries (Misra-Gries), one row for each task,
merged in two steps. The table only saves work: no result depends on it.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from itertools import islice

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomtok.llm.bpe import LONG, ChunkEncoder, chunks

#: Entries of the broadcast table, and of a summary; a chunk has at most LONG characters, so both are bounded.
TOP = 20_000


def _trim(c: Counter, most: int) -> Counter:
    if len(c) <= most:
        return c
    cut = c.most_common(most + 1)[-1][1]
    return Counter({k: v - cut for k, v in c.items() if v > cut})


def _summary(c: Counter) -> pa.RecordBatch:
    c = _trim(c, TOP)
    return pa.RecordBatch.from_pydict({"chunk": [list(c)], "n": [list(c.values())]}, schema=pa.schema([("chunk", pa.list_(pa.string())), ("n", pa.list_(pa.int64()))]))


def _summarize(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    seen: Counter = Counter()
    for batch in batches:
        for text in batch.column("text").to_pylist():
            if text:
                seen.update(islice(chunks(text), 1, None))
                if len(seen) > 10 * TOP:
                    seen = _trim(seen, 5 * TOP)
    yield _summary(Counter({k: v for k, v in seen.items() if v > 1 and len(k) <= LONG}))


def _merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    seen: Counter = Counter()
    for batch in batches:
        for keys, counts in zip(batch.column("chunk").to_pylist(), batch.column("n").to_pylist(), strict=True):
            seen.update(dict(zip(keys, counts, strict=True)))
            if len(seen) > 10 * TOP:
                seen = _trim(seen, 5 * TOP)
    yield _summary(seen)


def frequent_chunks(docs: DataFrame) -> list[str]:
    """At most TOP chunks, of those that occur most over all texts."""
    kind = "chunk array<string>, n array<bigint>"
    parts = docs.select("text").mapInArrow(_summarize, kind)
    merged = parts.repartition(16).mapInArrow(_merge, kind).repartition(1).mapInArrow(_merge, kind)
    return [x for r in merged.collect() for x in r.chunk]


def count_tokens(docs: DataFrame, path: str, limit: int = 1024) -> DataFrame:
    """doc_id, n_bytes, n_tokens and over_limit (n_tokens > limit) of each row of docs.

    docs needs doc_id and text; other columns are ignored. Null and empty texts
    have 0 bytes and tokens; rows with the same or a null doc_id are counted
    one by one; no rows give no rows. Texts are never cut.
    """
    encoder = ChunkEncoder(path, lambda b: len(b) // 4)
    table = {x: len(encoder._ids(" " + x)) // 4 for x in frequent_chunks(docs)}
    shared = docs.sparkSession.sparkContext.broadcast(table)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = ChunkEncoder(path, lambda b: len(b) // 4, shared.value)
        for batch in batches:
            n = [sum(encoder.values(x)) if x else 0 for x in batch.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("n_bytes"), pa.array(n, pa.int64())], ["doc_id", "n_bytes", "n_tokens"])

    rows = docs.select("doc_id", "text", F.coalesce(F.octet_length("text"), F.lit(0)).cast("long").alias("n_bytes"))
    kind = docs.select("doc_id").schema.add("n_bytes", "long").add("n_tokens", "long")
    return rows.mapInArrow(count, kind).withColumn("over_limit", F.col("n_tokens") > limit)

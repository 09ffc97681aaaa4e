"""Connected components by alternating large and small stars."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomtok.llm.common import materialize


#: Nodes that a task joins at once.
NODES = 500_000


def find(root: dict[int, int], x: int) -> int:
    """The least node of the tree that holds x."""
    while (y := root.setdefault(x, x)) != x:
        root[x] = x = root[y]
    return x


def join(root: dict[int, int], a: int, b: int) -> bool:
    """Joins the trees of a and b; whether they were two."""
    p, q = find(root, a), find(root, b)
    root[max(p, q)] = min(p, q)
    return p != q


def _forest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A spanning forest of the edges (a, b) of a task, every node tied to the least of its tree; beyond NODES, one of each part."""
    root: dict[int, int] = {}

    def out() -> pa.RecordBatch:
        pairs = [(find(root, x), x) for x in list(root)]
        pairs = [(a, b) for a, b in pairs if a != b]
        return pa.RecordBatch.from_arrays([pa.array([p[i] for p in pairs], pa.int64()) for i in (0, 1)], ["a", "b"])

    for batch in batches:
        for a, b in zip(batch.column("a").to_pylist(), batch.column("b").to_pylist(), strict=True):
            join(root, a, b)
        if len(root) >= NODES:
            yield out()
            root.clear()
    yield out()


def thinned(edges: DataFrame) -> DataFrame:
    """Fewer edges (a, b) with the same components: a forest of each task's, and of what 32 tasks have left.

    A group whose pairs are all linked has edges by its square; from here on it
    has some for each node.
    """
    some = materialize(edges.where("a <> b").select("a", "b").mapInArrow(_forest, "a long, b long"), "forest")
    return some.coalesce(max(1, some.rdd.getNumPartitions() // 32)).mapInArrow(_forest, "a long, b long").distinct()


def _spanning(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of the edges (a, b) of a task those that join two trees; beyond NODES, of each part."""
    root: dict[int, int] = {}
    for batch in batches:
        keep = [join(root, a, b) for a, b in zip(batch.column("a").to_pylist(), batch.column("b").to_pylist(), strict=True)]
        yield batch.select(["a", "b"]).filter(pa.array(keep, pa.bool_()))
        if len(root) >= NODES:
            root.clear()


def spanning(edges: DataFrame) -> DataFrame:
    """Some of the edges (a, b), with the same components: as thinned(), but none that wasn't there."""
    some = materialize(edges.select("a", "b").mapInArrow(_spanning, "a long, b long"), "spanning")
    return some.coalesce(max(1, some.rdd.getNumPartitions() // 32)).mapInArrow(_spanning, "a long, b long").distinct()


def _least(pairs: DataFrame) -> DataFrame:
    """The least b of each a. The xor with 0 hides the partitioning, so that a hot a can be split in the join."""
    return pairs.groupBy("a").agg(F.min("b").alias("m")).select(F.col("a").bitwiseXOR(F.lit(0)).alias("a"), F.least("a", "m").alias("m"))


def components(edges: DataFrame) -> DataFrame:
    """node, component (its least node) of each node in edges (a, b), both long and not null.

    Repeated edges, loops and either direction are fine; no edges give no rows.
    Each round writes its edges to the shared folder.
    """
    now = materialize(thinned(edges), "edges")
    state = None
    while True:
        both = now.union(now.select(F.col("b").alias("a"), F.col("a").alias("b")))
        large = both.join(_least(both), "a").where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).distinct()
        small = large.join(_least(large), "a")
        now = materialize(small.select("b", "m").union(small.select("a", "m")).toDF("b", "a").where("a <> b").distinct().select("a", "b"), "edges")
        last, state = state, now.agg(F.count("*"), F.sum(F.xxhash64("a", "b") % 1_000_003)).first()
        if state == last:
            return now.select(F.col("b").alias("node"), F.col("a").alias("component"))

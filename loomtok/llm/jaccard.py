"""Near copies by SimHash, checked and completed by the exact Jaccard similarity of word shingles.

SimHash comes first: fingerprints of the shingles that differ in at most three
bits are found by the generalised pigeonhole search of simhash.py, and the texts
of such a pair are compared whole.

Pairs of similarity 4/5 differ by ten bits of 64 on average and by 16 at times,
and partitions for 16 bits make candidates of a share of all pairs. So what lies
beyond three bits is found by a prefix filter: under any one order of all
shingles, two sets of similarity 4/5 or more share one of the first n -
ceil(4n/5) + 1 shingles of each, n being the size of the set. The order puts
shingles that are common in a sample last, which changes the cost and not the
result. Sketches drop candidates that can't be similar, and the others are
compared whole. Of the sets that share a shingle all are compared with one of
them, and then only those pairs that aren't in one component already, by
SimHash or by that comparison. Those go in rounds: of a crowd's pairs a round
hands on the closest that would join its components, and the next one looks at
what is left between the components that these have made. So a crowd of near
copies costs its sets and not its pairs; only pairs that sketches can't tell
apart, in components that never meet, are compared whole each.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import accumulate, count

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, LongType

from loomtok.llm.common import materialize
from loomtok.llm.components import components, join, spanning
from loomtok.llm.simhash import links, majority

SHINGLE, SEED = 5, 42
#: Bits by which fingerprints of near copies may differ.
DIFFER = 3
#: Texts of the sample that orders shingles, and the shingles it tells apart.
SAMPLE, COMMON = 20_000, 200_000
#: Sets of a block that is compared within itself and with other blocks, and the bits of their sketches there.
BLOCK, BRIEF = 1_000, 8_192
#: Shared shingles listed with a set, by which a pair is handed on once; pairs that meet beyond them come more than once.
LEAST = 64
#: Pairs of two blocks that are handed on without a choice, if they aren't more than the sets there; and the growth of both in a round.
FEW, MORE = 64, 4


def shingles(text: str | None, shingle: int = SHINGLE) -> tuple[int, np.ndarray]:
    """A hash of the words in order, and the distinct hashes of their shingles; one shingle for fewer words, none for no words."""
    words = text.encode().lower().split() if text else ()
    joined = b" ".join(words)
    node = xxhash.xxh64_intdigest(joined, SEED)
    if len(words) <= shingle:
        hashes = [node] if words else []
    else:
        ends = list(accumulate(map(len, words), lambda a, n: a + n + 1))
        starts, digest = [0, *(e + 1 for e in ends)], xxhash.xxh64_intdigest
        hashes = [digest(joined[a:b], SEED) for a, b in zip(starts, ends[shingle - 1 :], strict=False)]
    return node - ((node >> 63) << 64), np.unique(np.array(hashes, "<u8").view("<i8"))


def similar(a: np.ndarray, b: np.ndarray) -> bool:
    """Whether the Jaccard similarity of two sorted sets is 4/5 or more; two empty ones are alike."""
    both = len(np.intersect1d(a, b, assume_unique=True))
    return 5 * both >= 4 * (len(a) + len(b) - both)


def common_shingles(docs: DataFrame, shingle: int) -> tuple[np.ndarray, np.ndarray]:
    """Shingles that more than three texts of a sample hold, sorted, and in how many."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sets = [shingles(x, shingle)[1] for x in batch.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate([np.zeros(0, "<i8"), *sets]), pa.int64())], ["token"])

    every = max(1, docs.count() // SAMPLE)
    some = docs.select("text").where(F.pmod(F.xxhash64("text"), F.lit(every)) == 0)
    counts = some.mapInArrow(run, "token long").groupBy("token").count().where("count > 3")
    rows = counts.orderBy(F.desc("count"), "token").limit(COMMON).toArrow()
    token, n = rows.column("token").to_numpy(), rows.column("count").to_numpy()
    order = np.argsort(token)
    return token[order], n[order]


def prefixes(docs: DataFrame, shingle: int) -> DataFrame:
    """docs with __node (hash of the words), __n (shingles), __fp (their SimHash), __prefix (the first of them) and __sketch."""
    common, counts = common_shingles(docs, shingle)

    def prefix(s: np.ndarray) -> np.ndarray:
        rank = np.zeros(len(s), np.int64)
        if len(common):
            at = np.minimum(np.searchsorted(common, s), len(common) - 1)
            rank = np.where(common[at] == s, counts[at], 0)
        return s[np.lexsort((s, rank))][: len(s) - (4 * len(s) + 4) // 5 + 1]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [shingles(x, shingle) for x in batch.column("text").to_pylist()]
            new = [pa.array([x for x, _ in found], pa.int64()), pa.array([len(s) for _, s in found], pa.int64()), pa.array([majority(s) for _, s in found], pa.int64()), pa.array([prefix(s) if len(s) else [] for _, s in found], pa.list_(pa.int64())), pa.array([sketch(s) for _, s in found], pa.binary())]
            yield pa.RecordBatch.from_arrays([*batch.columns, *new], [*batch.schema.names, "__node", "__n", "__fp", "__prefix", "__sketch"])

    schema = docs.select("*").schema.add("__node", "long").add("__n", "long").add("__fp", "long").add("__prefix", ArrayType(LongType())).add("__sketch", "binary")
    return docs.mapInArrow(run, schema)


def verified(pairs: DataFrame, texts: DataFrame, shingle: int) -> DataFrame:
    """The pairs (a, b) of nodes whose texts are similar."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sets: dict[int, np.ndarray] = {}

        def of(node: int, text: pa.Scalar) -> np.ndarray:
            if node not in sets:
                if len(sets) >= 500:
                    sets.clear()
                sets[node] = shingles(text.as_py(), shingle)[1]
            return sets[node]

        for batch in batches:
            a, b = batch.column("a").to_pylist(), batch.column("b").to_pylist()
            ok = [similar(of(x, s), of(y, t)) for x, y, s, t in zip(a, b, batch.column("s"), batch.column("t"), strict=True)]
            yield batch.select(["a", "b"]).filter(pa.array(ok, pa.bool_()))

    one = texts.select(F.col("__node").alias("a"), F.col("text").alias("s"))
    two = texts.select(F.col("__node").alias("b"), F.col("text").alias("t"))
    return pairs.distinct().join(one, "a").join(two, "b").select("a", "b", "s", "t").mapInArrow(run, "a long, b long")


def _chosen(ends: list[tuple[int, int]], forests: int) -> list[int]:
    """Which of the edges, in order of preference, make up so many forests, each of what the ones before have left."""
    chosen, rest = [], range(len(ends))
    for _ in range(forests):
        root: dict[int, int] = {}
        joins = [join(root, *ends[e]) for e in rest]
        chosen += [e for e, new in zip(rest, joins, strict=True) if new]
        rest = [e for e, new in zip(rest, joins, strict=True) if not new]
        if not rest:
            break
    return chosen


def _across(batches: Iterator[pa.RecordBatch], more: int = 1) -> Iterator[pa.RecordBatch]:
    """Of each list, pairs of two components, of like size, whose brief sketches leave a similarity of 4/5 possible.

    A list is one block of the sets that share a shingle, or two, of which only
    pairs across are looked at. Pairs that both hold a lesser shared shingle, as
    far as it is listed, are left to the list of that one; pairs known not to be
    similar are left out. If there are many, `more` forests of the closest ones
    are taken, and a row without a pair names the shingle, whose list is open.
    """
    for batch in batches:
        out, left_open = [np.zeros((2, 0), np.int64)], []
        for token, x in zip(batch.column("token").to_pylist(), batch.column("sets"), strict=True):
            comp, node, n, block = (x.values.field(k).to_numpy() for k in ("comp", "node", "n", "block"))
            brief = [np.frombuffer(v, "<u8") for v in x.values.field("brief").to_pylist()]
            lesser = [{t for t in v if t < token} for v in x.values.field("least").to_pylist()]
            unlike = {(a, b) for a, v in zip(node.tolist(), x.values.field("unlike").to_pylist(), strict=True) for b in v or ()}
            width = np.array([len(v) for v in brief])
            first, inner = block == block.min(), block.min() == block.max()
            classes = [(w, side, np.flatnonzero(side & (width == w))) for side in (first, first if inner else ~first) for w in np.unique(width)]
            half, found = len(classes) // 2, []
            for wa, _, left in classes[:half]:
                for wb, _, right in classes[half:]:
                    if not len(left) or not len(right):
                        continue
                    one, two = (_fold(np.stack([brief[i] for i in part]), min(wa, wb)) for part in (left, right))
                    step = max(1, (1 << 21) // (len(right) * int(min(wa, wb))))
                    for at in range(0, len(left), step):
                        rows = left[at : at + step]
                        alike = (comp[rows, None] != comp[right]) & (5 * n[rows, None] >= 4 * n[right]) & (5 * n[right] >= 4 * n[rows, None])
                        r, c = np.nonzero(alike & (node[rows, None] < node[right]) if inner else alike)
                        apart, both = np.bitwise_count(one[at + r] ^ two[c]).sum(1, dtype=np.int64), n[rows[r]] + n[right[c]]
                        near = 9 * apart <= both
                        i, j = rows[r[near]], right[c[near]]
                        a, b = np.minimum(node[i], node[j]).tolist(), np.maximum(node[i], node[j]).tolist()
                        each = zip((apart[near] / both[near]).tolist(), a, b, comp[i].tolist(), comp[j].tolist(), i.tolist(), j.tolist(), strict=True)
                        found += [v[:5] for v in each if lesser[v[5]].isdisjoint(lesser[v[6]]) and v[1:3] not in unlike]
            if len(found) > more * max(FEW, len(node)):
                found.sort()
                chosen = _chosen([v[3:] for v in found], more)
                if len(chosen) < len(found):
                    left_open.append(token)
                found = [found[e] for e in chosen]
            out.append(np.array([v[1:3] for v in found], np.int64).reshape(-1, 2).T)
        a, b = np.unique(np.concatenate(out, 1), axis=1)
        yield pa.RecordBatch.from_arrays([pa.array(a), pa.array(b), pa.nulls(len(a), pa.int64())], ["a", "b", "open"])
        none = pa.nulls(len(left_open), pa.int64())
        yield pa.RecordBatch.from_arrays([none, none, pa.array(left_open, pa.int64())], ["a", "b", "open"])


def _fold(sketches: np.ndarray, words: int) -> np.ndarray:
    """Sketches as rows of 64-bit words, folded to so many words, half on half."""
    while sketches.shape[-1] > words:
        half = sketches.shape[-1] // 2
        sketches = sketches[..., :half] ^ sketches[..., half:]
    return sketches


def _brief(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Sketches, folded to BRIEF bits at most."""
    for batch in batches:
        short = [_fold(np.frombuffer(v, "<u8"), BRIEF // 64).tobytes() for v in batch.column("__sketch").to_pylist()]
        yield pa.RecordBatch.from_arrays([batch.column("__node"), pa.array(short, pa.binary())], ["node", "brief"])


def mixed_lists(shared: DataFrame, tree: DataFrame) -> DataFrame:
    """token, main, n_main, n_other of the lists of three sets or more that hold several components; main is the one that most of a list is in."""
    named = shared.select("token", "node").join(tree, "node", "left")
    parts = named.groupBy("token", F.coalesce("component", "node").alias("comp")).agg(F.count("*").alias("n"))
    most = F.max(F.struct("n", "comp")).alias("most")
    lists = parts.groupBy("token").agg(most, F.sum("n").alias("n")).where((F.col("n") > 2) & (F.col("n") > F.col("most.n")))
    return lists.select("token", F.col("most.comp").alias("main"), F.col("most.n").alias("n_main"), (F.col("n") - F.col("most.n")).alias("n_other"))


def across(shared: DataFrame, lists: DataFrame, tree: DataFrame, nodes: DataFrame, unlike: DataFrame, more: int = 1) -> DataFrame:
    """Pairs (a, b) in two components of the tree that may be similar, of those that share a shingle and aren't in unlike; open: a list that has more of them.

    The sets of a list are dealt into blocks of about BLOCK, those of its main
    component apart from the others, and blocks are compared two by two, but for
    two of the main component. So the sets of one component cost what the others
    are, and not their own number; no task holds more than two blocks.
    """
    members = shared.select("token", "node", "n").join(lists, "token").join(tree, "node", "left").withColumn("comp", F.coalesce("component", "node"))
    blocks = [F.ceil(F.col(c) / BLOCK).cast("int") for c in ("n_main", "n_other")]
    members = members.select("token", "node", "n", "comp", (F.col("comp") == F.col("main")).alias("inside"), blocks[0].alias("p"), blocks[1].alias("q"), F.xxhash64("node").alias("h"))
    block = F.when(F.col("inside"), F.pmod("h", "p")).otherwise(F.col("p") + F.pmod("h", "q")).cast("int")
    start = F.when(F.col("inside"), F.col("p")).otherwise(F.lit(0))
    members = members.select("token", "node", "n", "comp", block.alias("block"), F.sequence(start, F.col("p") + F.col("q") - 1).alias("others"))
    least = members.groupBy("node").agg(F.slice(F.sort_array(F.collect_set("token")), 1, LEAST).alias("least"))
    least = least.join(unlike.groupBy(F.col("a").alias("node")).agg(F.collect_set("b").alias("unlike")), "node", "left")
    members = members.join(least.join(nodes.select("__node", "__sketch").mapInArrow(_brief, "node long, brief binary"), "node"), "node")
    cells = members.withColumn("other", F.explode("others"))
    cells = cells.groupBy("token", F.least("block", "other").alias("i"), F.greatest("block", "other").alias("j"))
    sets = cells.agg(F.collect_list(F.struct("comp", "node", "n", "block", "brief", "least", "unlike")).alias("sets")).select("token", "sets")
    return sets.mapInArrow(lambda batches: _across(batches, more), "a long, b long, open long")


def sketch(s: np.ndarray) -> bytes:
    """Bits, 1,024 or the power of two from the size of the set on: each is whether an odd number of the set's hashes fall on it.

    Two sets differ in at least as many hashes as their sketches in bits. A
    longer sketch is folded onto a shorter one, half on half.
    """
    size = max(1024, 1 << (len(s) - 1).bit_length())
    return np.packbits(np.bincount(s & (size - 1), minlength=size) & 1).tobytes()


def _apart(one: bytes, two: bytes) -> int:
    """In how many bits two sketches differ, the longer one folded."""
    a, b = sorted((np.frombuffer(one, "<u8"), np.frombuffer(two, "<u8")), key=len)
    return int(np.bitwise_count(a ^ _fold(b, len(a))).sum())


def possible(pairs: DataFrame, nodes: DataFrame) -> DataFrame:
    """The pairs (a, b) whose sketches leave a similarity of 4/5 possible, each once."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ok = [9 * _apart(x, y) <= n for x, y, n in zip(*(batch.column(c).to_pylist() for c in ("s", "t", "n")), strict=True)]
            yield batch.select(["a", "b"]).filter(pa.array(ok, pa.bool_()))

    one = nodes.select(F.col("__node").alias("a"), F.col("__n").alias("na"), F.col("__sketch").alias("s"))
    two = nodes.select(F.col("__node").alias("b"), F.col("__n").alias("nb"), F.col("__sketch").alias("t"))
    return pairs.distinct().join(one, "a").join(two, "b").select("a", "b", (F.col("na") + F.col("nb")).alias("n"), "s", "t").mapInArrow(run, "a long, b long")


def by_fingerprint(nodes: DataFrame) -> DataFrame:
    """The pairs (a, b) of nodes that SimHash proposes: of one fingerprint, and the first ones of two that differ in at most DIFFER bits.

    Of the latter as many as join all fingerprints that such pairs join; the
    others cost a crowd the square of its size, and where one of these fails,
    the prefix filter has the pairs that are similar.
    """
    prints = materialize(nodes.groupBy("__fp").agg(F.min("__node").alias("first")), "prints")
    same = nodes.select("__fp", "__node").join(prints, "__fp").where("__node > first").select(F.col("first").alias("a"), F.col("__node").alias("b"))
    one, two = (prints.select(F.col("__fp").alias(c), F.col("first").alias("f" + c)) for c in "xy")
    near = spanning(links(prints.select(F.col("__fp").alias("fp")), DIFFER)).toDF("x", "y").join(one, "x").join(two, "y").select(F.least("fx", "fy").alias("a"), F.greatest("fx", "fy").alias("b"))
    return same.union(near)


def stars(shared: DataFrame) -> DataFrame:
    """The pairs (a, b) of the least set of each list and the others of like size."""
    return shared.where("node > first and 5 * n >= 4 * m and 5 * m >= 4 * n").select(F.col("first").alias("a"), F.col("node").alias("b")).distinct()


def similar_components(rows: DataFrame, shingle: int = SHINGLE) -> DataFrame:
    """node, component of each node of rows (as of prefixes(), numbered) that has a near copy with other words."""
    nodes = rows.join(rows.groupBy("__node").agg(F.min("__row").alias("__row")).select("__row"), "__row", "left_semi")
    sets = nodes.select(F.explode("__prefix").alias("token"), F.col("__node").alias("node"), F.col("__n").alias("n"))
    ends = sets.groupBy("token").agg(F.min(F.struct("node", "n")).alias("first"), F.max("node").alias("last")).where("first.node < last")
    shared = materialize(sets.join(materialize(ends.select("token", F.col("first.node").alias("first"), F.col("first.n").alias("m")), "lists"), "token"), "shared")

    def linked(pairs: DataFrame) -> DataFrame:
        left = materialize(possible(pairs, nodes), "candidates")
        held = left.select(F.explode(F.array("a", "b")).alias("__node")).distinct()
        return materialize(verified(left, nodes.select("__node", "text").join(held, "__node", "left_semi"), shingle), "similar")

    edges = linked(by_fingerprint(nodes).union(stars(shared)))
    tree, unlike = materialize(components(edges), "tree"), edges.limit(0)
    for k in count():
        lists = materialize(mixed_lists(shared, tree), "mixed")
        if lists.isEmpty():
            break
        found = materialize(across(shared, lists, tree, nodes, unlike, MORE**k), "across")
        pairs, left = found.where("open IS NULL").select("a", "b").distinct(), found.select("open").where("open IS NOT NULL").distinct()
        edges = linked(pairs)
        tree = materialize(components(tree.toDF("a", "b").union(edges)), "tree")
        if left.isEmpty():
            break
        unlike = materialize(unlike.union(pairs.join(edges, ["a", "b"], "left_anti")), "unlike")
        shared = materialize(shared.join(left.toDF("token"), "token", "left_semi"), "open")
    return tree


def keep_one(docs: DataFrame, shingle: int = SHINGLE) -> DataFrame:
    """One row of each group of near copies, all columns: that of the least id, and any one of those with that id.

    Groups are the components of rows whose sets of word shingles have a Jaccard
    similarity of 4/5 or more; texts without words are alike. Null ids come
    last. Rows with one id and different texts are different rows.
    """
    rows = materialize(prefixes(docs, shingle).withColumn("__row", F.monotonically_increasing_id()), "prefixes", "zstd")
    best = F.min(F.struct(F.col("doc_id").isNull().alias("none"), F.col("doc_id").alias("id"), F.col("__row").alias("row"))).alias("best")
    tree = similar_components(rows, shingle).withColumnRenamed("node", "__node")
    least = rows.groupBy("__node").agg(best).join(tree, "__node", "left").groupBy(F.coalesce("component", "__node").alias("root")).agg(F.min("best").alias("best"))
    return rows.join(least.select(F.col("best.row").alias("__row")), "__row", "left_semi").select(*docs.columns)

"""LM scoring against a plain version of its counts, states and probabilities."""

import math
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from loomtok.llm import letters, lm_scoring


def tokens(text):
    raw = bytes(c + 32 if 65 <= c <= 90 else c for c in (text or "").encode())
    return [*raw.split(), None]


def plain(rows, spelling):
    """The score of each row; spelling gives log10 of a word's probability."""
    held = [zlib.crc32(("" if i is None else str(i)).encode()) % 10 == 0 for i, _ in rows]
    texts = [[0, *tokens(t)] for _, t in rows]
    grams = [Counter() for _ in range(4)]

    def before(w, j, k):
        """The sequence of k that ends at j; before the start there are starts only."""
        return tuple(w[max(0, x)] for x in range(j - k + 1, j + 1))

    for w, h in zip(texts, held, strict=True):
        for j in range(len(w)):
            for k in range(4):
                grams[k][before(w, j, k + 1)] += not h
    grams = [Counter({g: n for g, n in c.items() if n}) for c in grams]
    starts = grams[0][(0,)]
    total, kinds = sum(grams[0].values()) - starts, len(grams[0]) - bool(starts)
    words = Counter({g: n for g, n in grams[0].items() if g not in ((0,), (None,))})
    once = sum(n == 1 for n in words.values())
    weights = [max(1, once * max(0, sum(words.values()) - 1) / max(1, sum(words.values()) - once))]
    for k in range(1, 4):
        below, bins = words if k == 1 else grams[k - 1], {}
        for n in below.values():
            x = bins.setdefault(n.bit_length(), [0, 0])
            x[0], x[1] = x[0] + n, x[1] + 1
        target, low, high = sum(n == 1 for n in grams[k].values()), -7.0, 14.0
        for _ in range(50):
            m = 10 ** ((low + high) / 2)
            if sum(s * m / (s / c - 1 + m) for s, c in bins.values()) < target:
                low = (low + high) / 2
            else:
                high = (low + high) / 2
        weights.append(10**low)
    level = lambda n: sum(n >= x for x in lm_scoring.STATES)
    told, tally = [], Counter()
    for w, h in zip(texts, held, strict=True):
        codes, rest, own = [], 0.0, 0 if h else 1
        for j in range(1, len(w)):
            seen = [grams[k][before(w, j - 1, k + 1)] - own for k in range(3)]
            hits = [grams[k + 1][before(w, j, k + 2)] - own for k in range(3)]
            right = [k for k in (2, 1, 0) if 2 * hits[k] > seen[k]]
            outcome = 2 - right[0] if right else 3
            codes.append(4 * ((level(seen[2]) * lm_scoring.LEVELS + level(seen[1])) * lm_scoring.LEVELS + level(seen[0])) + outcome)
            if outcome == 3:
                tail = lm_scoring.END if w[j] is None else math.log10(1 - 10**lm_scoring.END) + spelling(w[j])
                p = (grams[0][(w[j],)] - own + weights[0] * 10**tail) / (total + weights[0])
                for k in range(3):
                    p = (hits[k] + weights[k + 1] * p) / (seen[k] + weights[k + 1])
                rest += math.log10(p)
        tally.update(codes if own else ())
        told.append((codes, rest))
    table = lm_scoring.mixed_table(np.array([tally[c] for c in range(4 * lm_scoring.CELLS)], float))
    assert kinds >= 0
    return [sum(table[c] for c in codes) + rest for codes, rest in told]


@pytest.mark.parametrize("chunk", [200_000, 3_000_000])
def test_scores_are_those_of_a_plain_version(spark, edge, docs, monkeypatch, chunk):
    fixed = letters.Letters(np.zeros(256))
    monkeypatch.setattr(lm_scoring.letters, "fit", lambda lexicon, frequency: fixed)
    monkeypatch.setattr(lm_scoring, "SPARE", 30)
    monkeypatch.setattr(lm_scoring, "CHUNK", chunk)
    monkeypatch.setattr(lm_scoring, "RANGE", 100_000)
    both = edge.select("doc_id", "text").where("doc_id is null or doc_id != 6").union(docs.select("doc_id", "text"))
    rows = [(r.doc_id, r.text) for r in both.collect()]
    known = {}

    def spelling(word):
        if word not in known:
            known[word] = float(np.float32(fixed.spelled([word])[0]))
        return known[word]

    want = sorted((str(i), s) for (i, _), s in zip(rows, plain(rows, spelling), strict=True))
    got = sorted((str(r.doc_id), r.score) for r in lm_scoring.score(both).collect())
    assert [i for i, _ in got] == [i for i, _ in want]
    assert np.allclose([s for _, s in got], [s for _, s in want], rtol=1e-4, atol=1e-3)


def test_a_text_that_occurs_twice_differs(spark, data):
    docs = spark.read.parquet(f"{data}/documents.parquet").select("doc_id", "text").where("length(text) > 400")
    once = docs.dropDuplicates(["text"])
    out = lm_scoring.score(once.union(once.where("doc_id % 7 = 3").select((F.col("doc_id") + 100_000).alias("doc_id"), "text"))).where("not held_out")
    low = out.where("doc_id % 7 = 3 and doc_id < 100000").approxQuantile("bits_per_byte", [0.5], 0)[0]
    high = out.where("doc_id % 7 != 3 and doc_id < 100000").approxQuantile("bits_per_byte", [0.5], 0)[0]
    assert low < high / 4


def test_no_training_rows(spark):
    rows = lm_scoring.score(spark.createDataFrame([(i, "some words here") for i in range(400) if zlib.crc32(str(i).encode()) % 10 == 0], "doc_id long, text string")).collect()
    assert rows and all(r.held_out and r.train_tokens == 0 and r.n_known == 0 and r.score < 0 and math.isfinite(r.score) for r in rows)


def test_outcomes_sum_to_one():
    rng = np.random.default_rng(0)
    table = lm_scoring.mixed_table(rng.integers(0, 1000, 4 * lm_scoring.CELLS).astype(float)).reshape(-1, 4)
    cells = np.arange(lm_scoring.CELLS)
    seen = [cells // lm_scoring.LEVELS**k % lm_scoring.LEVELS > 0 for k in (2, 1, 0)]
    p = 10**table
    assert np.allclose(p[:, 3] + sum(np.where(s, p[:, k], 0) for k, s in enumerate(seen)), 1)


def test_frequent_predictions_are_learned():
    tally = np.zeros((lm_scoring.CELLS, 4))
    tally[(5 * lm_scoring.LEVELS + 5) * lm_scoring.LEVELS + 5] = [900, 10, 10, 80]
    p = 10 ** lm_scoring.mixed_table(tally.ravel()).reshape(-1, 4)
    assert abs(p[(5 * lm_scoring.LEVELS + 5) * lm_scoring.LEVELS + 5, 0] - 0.9) < 0.03


def test_letters_are_probabilities():
    starts, nodes, bits = letters.huffman([5, 1, 1, 3, 2])
    assert sum(2.0 ** -(starts[i + 1] - starts[i]) for i in range(5)) == 1
    m = letters.Letters(np.zeros(256))
    of, bit, slots = m.bits([b"new", b"", b"\xc3\xa9"])
    assert set(of) == {0, 1, 2}
    for v in (0, 1):
        p = 10 ** m.log10_bits(np.full(len(bit), v), slots) + 10 ** m.log10_bits(np.full(len(bit), 1 - v), slots)
        assert np.allclose(p, 1)


def test_letters_learn(spark):
    words = [b"".join(p) for a in (b"th", b"er", b"on", b"qu") for b in (b"ing", b"ed", b"ly", b"s") for c in (b"", b"a", b"xo") for p in [(a, b, c)]]
    lexicon = spark.createDataFrame([(bytearray(b" ".join(words)),)], "words binary")
    frequency = np.bincount(np.frombuffer(b"".join(words), np.uint8), minlength=256)
    m = letters.fit(lexicon, frequency)
    assert m.spelled([b"thing"])[0] > letters.Letters(frequency).spelled([b"thing"])[0] > m.spelled([b"zzwkv"])[0]


def test_packing_of_numbers():
    rng = np.random.default_rng(0)
    for top in (0, 1, 255, 256, 2**40, 2**63):
        x = rng.integers(0, top + 1, 1000, dtype=np.uint64)
        assert (lm_scoring.unpack(lm_scoring.pack(x)) == x).all()
        x = np.unique(x)
        assert (lm_scoring.unpack_sorted(lm_scoring.pack_sorted(x)) == x).all()


def test_chunks_have_the_tokens_of_texts():
    texts = [" a  B\t\n c ", "", "É é\x0b\x0cx\x1cy", "   ", "a a b"]
    c = lm_scoring.Chunk(pa.array(texts))
    words = c.words.cast(pa.binary()).to_pylist()
    at = np.cumsum([0, *c.lengths])
    assert [[words[i] for i in c.ids[a:b]] for a, b in zip(at, at[1:], strict=False)] == [tokens(t)[:-1] for t in texts]
    assert len(lm_scoring.Chunk(pa.array([""])).ids) == 0

"""The pipeline's near-dedup stage against brute-force Jaccard of 5-word shingles."""

import random
from collections import Counter

import corpus_pipeline as p
import numpy as np

from loomtok.llm import jaccard


def shingles(text):
    words = text.encode().lower().split() if text else []
    return set(zip(*(words[i:] for i in range(5)), strict=False)) if len(words) >= 5 else {tuple(words)} - {()}


def groups(texts):
    """The group of each row, by comparing all."""
    sets, up = [shingles(t) for t in texts], list(range(len(texts)))
    for i, a in enumerate(sets):
        for j in range(i):
            if up[i] != up[j] and 5 * len(a & sets[j]) >= 4 * len(a | sets[j]):
                lost, won = max(up[i], up[j]), min(up[i], up[j])
                up = [won if x == lost else x for x in up]
    return up


def check(spark, rows, keep):
    kept = Counter((r.doc_id, r.text) for r in keep(spark.createDataFrame(rows, "doc_id long, text string")).collect())
    least = {}
    for (i, t), g in zip(rows, groups([t for _, t in rows]), strict=True):
        least.setdefault(g, []).append((i is None, i or 0, i, t))
    assert sum(kept.values()) == len(least)
    for g in least.values():
        assert sum(kept[(i, t)] for i, t in {x[2:] for x in g}) == 1
        assert any(kept[x[2:]] for x in g if x[:2] == min(y[:2] for y in g))


def near(seed, copies=3):
    """Texts of many lengths with copies in which some words differ, on both sides of 0.8."""
    pick, out = random.Random(seed), []
    for n in (5, 6, 12, 40, 60, 200, 200, 1000):
        words = [f"w{pick.randrange(10**6)}" for _ in range(n)]
        out.append(" ".join(words))
        for _ in range(copies):
            new = list(words)
            for _ in range(max(1, n * pick.randrange(1, 7) // 100)):
                new[pick.randrange(n)] = f"e{pick.randrange(10**6)}"
            out.append(" ".join(new))
    return out


def test_recall_is_that_of_brute_force(spark):
    texts = [*near(1), *near(2), "", None, "  ", "one", "One", "two"]
    check(spark, list(enumerate(texts)), lambda docs: p.near_dedup(spark, docs, ""))


def test_crowds(spark):
    """Shingles held by many: pairs that the first comparison doesn't link are found by the second."""
    rows = list(enumerate(near(3, copies=12)))
    check(spark, rows, jaccard.keep_one)


def test_crowds_in_blocks(spark, monkeypatch):
    """The same with crowds that are dealt into several blocks, and sketches of two lengths, the longer one folded."""
    monkeypatch.setattr(jaccard, "BLOCK", 4)
    monkeypatch.setattr(jaccard, "LEAST", 3)
    pick = random.Random(5)
    base = [f"w{pick.randrange(10**6)}" for _ in range(1035)]
    long = [" ".join([*base[: n - cut], *(f"e{pick.randrange(10**6)}" for _ in range(cut))]) for n in (1020, 1026, 1033) for cut in (0, 90, 115, 260)]
    check(spark, list(enumerate([*near(4, copies=12), *long])), jaccard.keep_one)


def test_given_documents(spark, docs):
    rows = [(r.doc_id, r.text) for r in docs.collect()]
    check(spark, rows, lambda d: p.near_dedup(spark, d, ""))


def test_rows_that_share_an_id(spark):
    a, b, c = ("".join(f"{k}{i} " for i in range(30)) for k in "abc")
    check(spark, [(1, a), (1, b), (1, b + "more"), (2, a), (None, c), (None, c), (3, c)], lambda docs: p.near_dedup(spark, docs, ""))


def test_sketches_bound_the_difference():
    pick = np.random.default_rng(0)
    for n, m, both in ((10, 12, 5), (900, 2500, 700), (5000, 5000, 4900), (5000, 4000, 10), (1, 3000, 1)):
        every = np.unique(pick.integers(-(2**63), 2**63, 20_000))[: n + m - both]
        a, b = every[:n], every[n - both :]
        assert jaccard._apart(jaccard.sketch(a), jaccard.sketch(b)) <= len(np.setxor1d(a, b))
    a, b = (np.unique(pick.integers(-(2**63), 2**63, 5000)) for _ in range(2))
    assert 9 * jaccard._apart(jaccard.sketch(a), jaccard.sketch(b)) > len(a) + len(b)

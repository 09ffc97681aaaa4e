"""What the near-dedup stage compares of a crowd of near copies."""

import random

from loomtok.llm import jaccard
from tests.llm.test_near_dedup import check


def crowd(seed, n):
    """Texts of 150 words with none to twelve of one text's words changed."""
    pick = random.Random(seed)
    base = [f"w{i}" for i in range(150)]
    out = []
    for _ in range(n):
        words = list(base)
        for at in pick.sample(range(150), pick.randrange(13)):
            words[at] = f"e{pick.randrange(10**6)}"
        out.append(" ".join(words))
    return out


def test_a_crowd_costs_its_sets(spark, monkeypatch):
    """400 near copies that only the search across components links: few of about 2,000 pairs are compared, and what stays is that of brute force."""
    compared, verified = [], jaccard.verified

    def counted(pairs, *more):
        compared.append(pairs.distinct().count())
        return verified(pairs, *more)

    monkeypatch.setattr(jaccard, "verified", counted)
    monkeypatch.setattr(jaccard, "stars", lambda shared: shared.limit(0).selectExpr("first AS a", "node AS b"))
    check(spark, list(enumerate(crowd(1, 400))), jaccard.keep_one)
    assert sum(compared) < 2 * 400


def test_rounds_lose_no_link(spark, monkeypatch):
    """The same where nearly every list is left open, in blocks and by the shortest steps."""
    for name, value in (("FEW", 1), ("MORE", 2), ("BLOCK", 30), ("LEAST", 3)):
        monkeypatch.setattr(jaccard, name, value, raising=False)
    rows = list(enumerate([*crowd(2, 150), *crowd(3, 3), None, "one"]))
    check(spark, rows, jaccard.keep_one)


def test_few_edges_of_fingerprints(spark):
    """Fingerprints that are all linked are handed on by a tree, and each edge is one that was there."""
    from loomtok.llm import components

    pairs = [(a, b) for a in range(100) for b in range(a)] + [(200, 201), (201, 202)]
    left = [(r.a, r.b) for r in components.spanning(spark.createDataFrame(pairs, "a long, b long").repartition(3)).collect()]
    assert {*left} <= {*pairs} and len(left) < 310
    assert {(r.node, r.component) for r in components.components(spark.createDataFrame(left, "a long, b long")).collect()} == {(i, 0) for i in range(1, 100)} | {(201, 200), (202, 200)}

"""The near-dedup stage's SimHash, by itself."""

import random

from loomtok.llm import jaccard
from tests.llm.test_near_dedup import groups, near


def rows():
    pick, out = random.Random(9), [*near(6), "", None, "one"]
    for _ in range(12):
        words = [f"w{pick.randrange(10**6)}" for _ in range(400)]
        out += [" ".join(words), " ".join([*words[:-1], "end"]), " ".join(["start", *words[1:]])]
    return list(enumerate(out))


def test_simhash_links_without_the_prefix_filter(spark, monkeypatch):
    """What is linked is what differs in three bits at most and is similar."""
    monkeypatch.setattr(jaccard, "stars", lambda shared: shared.limit(0).selectExpr("first AS a", "node AS b"))
    monkeypatch.setattr(jaccard, "mixed_lists", lambda shared, tree: shared.limit(0))
    texts = [t for _, t in rows()]
    sets = [jaccard.shingles(t)[1] for t in texts]
    prints = [jaccard.majority(s) % 2**64 for s in sets]
    up = list(range(len(texts)))
    for i in up[:]:
        for j in range(i):
            if up[i] != up[j] and (prints[i] ^ prints[j]).bit_count() <= 3 and jaccard.similar(sets[i], sets[j]):
                lost, won = max(up[i], up[j]), min(up[i], up[j])
                up = [won if x == lost else x for x in up]
    kept = {r.doc_id for r in jaccard.keep_one(spark.createDataFrame(rows(), "doc_id long, text string")).collect()}
    assert kept == set(up) and len(set(groups(texts))) < len(kept) < len(texts) - 8

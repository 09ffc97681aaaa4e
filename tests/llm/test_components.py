"""What connected components cost."""

import numpy as np

from loomtok.llm import components


def test_groups_cost_their_nodes(spark, monkeypatch):
    """300 nodes, all of them linked: 44,850 edges, of which the rounds take few."""
    sizes, write = [], components.materialize

    def counted(df, name, *more):
        out = write(df, name, *more)
        if name == "edges":
            sizes.append(out.count())
        return out

    monkeypatch.setattr(components, "materialize", counted)
    pairs = [(a, b) for a in range(300) for b in range(a)] + [(1000, 1001), (1001, 1002), (7, 7)]
    order = np.random.default_rng(0).permutation(len(pairs))
    edges = spark.createDataFrame([pairs[i] for i in order], "a long, b long").repartition(40)
    found = {r.node: r.component for r in components.components(edges).collect()}
    assert found == {**dict.fromkeys(range(1, 300), 0), 1001: 1000, 1002: 1000}
    assert max(sizes) < 1200

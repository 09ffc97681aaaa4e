"""The pipeline's stages, each on its own input, against plain versions."""

import corpus_pipeline as p

from loomtok.llm.common import table
from loomtok.llm.decontaminate import Matcher
from loomtok.llm.queries import QUERIES
from tests.llm.test_near_dedup import groups


def test_stages(spark, data, tmp_path):
    docs = table(spark, data, "documents")
    items = [(r.item_id, r.text) for r in table(spark, data, "benchmark").collect()]
    columns = docs.columns
    seen = {}
    for k, (name, stage) in enumerate(p.STAGES):
        stage(spark, docs, data).write.parquet(f"file://{tmp_path}/{k}")
        before, docs = docs, spark.read.parquet(f"file://{tmp_path}/{k}")
        seen[name] = (before.toPandas().set_index("doc_id").text, docs)
        if k < len(p.STAGES) - 1:
            assert docs.columns == columns and docs.count()
    ids = lambda name: {r.doc_id for r in seen[name][1].select("doc_id").collect()}
    scores = {r.doc_id: r.predicted for r in QUERIES["op8_quality_classifier"](spark, data).collect()}
    assert ids("quality_classifier") == {i for i, v in scores.items() if v}
    before, _ = seen["simhash_near_dedup"]
    ids_in = list(before.index)
    root = groups(list(before))
    least = {}
    for i, g in zip(ids_in, root, strict=True):
        least[g] = min(i, least.get(g, i))
    assert ids("simhash_near_dedup") == set(least.values())
    before, _ = seen["benchmark_decontamination"]
    find = Matcher(items)
    assert ids("benchmark_decontamination") == {i for i, t in before.items() if not find(t)}
    before, after = seen["pii"]
    texts = after.toPandas().set_index("doc_id").text
    assert set(texts.index) == set(before.index) and not texts.str.contains("@").any() and texts.str.contains(r"\[EMAIL\]").any()
    assert (texts[~before.str.contains("[0-9@]")] == before[~before.str.contains("[0-9@]")]).all()
    assert {r.doc_id for r in seen["best_fit_packing"][1].collect()} == set(texts.index)


def test_run(spark, data):
    out = p.run(spark, data)
    assert out.columns[:4] == ["doc_id", "piece", "start", "length"] and out.count()


def test_odd_rows(spark, data, edge):
    """Every stage takes null ids, null, empty and very long texts, repeated rows and clashing columns."""
    docs = edge
    for _, stage in p.STAGES[:-1]:
        docs = stage(spark, docs, data)
        assert docs.columns == edge.columns
    kept = docs.collect()
    assert len({(r.doc_id, r.text) for r in kept}) == len(kept) and all(r.score == "z" for r in kept)
    assert p.packing(spark, docs, data).count() >= len(kept)

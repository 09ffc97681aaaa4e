from pyspark.sql import functions as F

import loomtok
from loomtok.config import TokenizerConfig
from loomtok.model import Model
from loomtok.operators.encoding import encode
from loomtok.plans import metrics


def test_cache():
    c, asked = loomtok.EncodingCache(2), []
    get = lambda x: c.get_or_encode(x, lambda t: asked.append(t) or [len(t)])
    assert get("a") == [1] and get("bb") == [2] and get("a") == [1] and get("ccc") == [3] and get("bb") == [2]
    assert asked == ["a", "bb", "ccc", "bb"] and len(c) == 2 and c.stats().hits == 1
    c.resize(1)
    assert len(c) == 1
    c.clear()
    assert c.is_empty() and loomtok.EncodingCache().stats().hit_rate is None


def test_exports():
    assert loomtok.Tokenizer().name == "loomtok"
    assert str(loomtok.EncodingMode.BYTE_LEVEL) == "ByteLevel"
    assert loomtok.SpecialTokensConfig(bos="<s>").configured() == [("bos", "<s>")]


def test_metrics(spark, tmp_path):
    texts = metrics.synthetic_text(spark, 5, 40, 1)
    assert texts.where(F.size(F.split("text", " ")) == 40).count() == 5
    assert texts.collect() == metrics.synthetic_text(spark, 5, 40, 1).collect()
    ids = encode(texts, Model.untrained(TokenizerConfig()))
    r = metrics.compression(ids).first()
    assert r.n_docs == 5 and r.n_tokens == r.n_bytes == r.n_chars and r.chars_per_token == 1
    assert metrics.token_frequency(ids, 3).count() == 3
    assert 5 < metrics.distinct_tokens(ids).first()[0] < 30
    assert metrics.timings(spark, lambda: None, 3).first().n == 3
    assert metrics.throughput(ids)["tokens_per_s"] > 0 and metrics.memory_mb() > 1
    metrics.save_results({"a": 1}, str(tmp_path / "r.json"))
    assert (tmp_path / "r.json").read_text().count("1") == 1

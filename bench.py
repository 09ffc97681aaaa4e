"""Headline queries at $BENCH_SF_DIR on local[$BENCH_CPUS]; prints one line of JSON."""

from __future__ import annotations

import json
import os
import time

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

SF_DIR, CPUS = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1"), os.environ.get("BENCH_CPUS", "8")


def main() -> None:
    spark = (
        SparkSession.builder.master(f"local[{CPUS}]")
        .config("spark.driver.memory", "8g")
        .config("spark.sql.shuffle.partitions", CPUS)
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.files.maxPartitionBytes", "4m")
        .config("spark.sql.files.openCostInBytes", "1m")
        .config("spark.ui.enabled", "false")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    from loomtok.config import TokenizerConfig
    from loomtok.model import Model
    from loomtok.operators import decoding, encoding, training
    from loomtok.plans.reference import QUERIES

    took: dict[str, float] = {}
    facts: dict[str, float] = {"cores": int(CPUS)}

    def timed(name: str, f, warm: bool = False):  # noqa: ANN001, ANN202
        if warm:
            f()
        began = time.time()
        out = f()
        took[name] = round(time.time() - began, 3)
        return out

    force = lambda df: df.write.format("noop").mode("overwrite").save()
    docs = spark.read.parquet(f"{SF_DIR}/documents.parquet")
    texts = docs.select("doc_id", "text").repartition(int(CPUS)).persist()
    size = texts.agg(F.sum(F.octet_length("text")).alias("b"), F.sum(F.length("text")).alias("c")).first()
    model = timed("fit_vocab_4000", lambda: training.fit(docs, TokenizerConfig(vocab_size=4000)))
    facts["fit_mb_per_s"] = round(size.b / 1e6 / took["fit_vocab_4000"], 3)

    plain = Model.untrained(TokenizerConfig())
    for name, m in (("bytes", plain), ("trained", model)):
        ids = encoding.encode(texts, m).select("ids").persist()
        n = ids.agg(F.sum(F.size("ids").cast("long")).alias("n")).first().n
        timed(f"encode_{name}", lambda m=m: force(encoding.encode(texts, m)), True)
        timed(f"decode_{name}", lambda m=m, ids=ids: force(decoding.decode(ids, m).select("decoded")), True)
        facts |= {f"encode_{name}_mtok_per_s": round(n / 1e6 / took[f"encode_{name}"], 2), f"decode_{name}_mtok_per_s": round(n / 1e6 / took[f"decode_{name}"], 2), f"{name}_chars_per_token": round(size.c / n, 3)}
        ids.unpersist()
    texts.unpersist()
    for name in ("byte_tokens_by_lang", "word_counts_topk", "pair_counts", "char_entropy", "pair_context_diversity", "merge_scores_topk", "encode_fixed_model", "compression_by_source", "token_frequency_topk"):
        timed(name, lambda name=name: force(QUERIES[name](spark, SF_DIR)))
    print(json.dumps({"metric": "headline queries, total", "value": round(sum(took.values()), 3), "unit": "sec", "queries": took, "sf": os.path.basename(SF_DIR.rstrip("/")), "rates": facts}))


if __name__ == "__main__":
    main()

"""Training over blocks of words: on the cluster as on the driver, in little memory, and as a plain loop over words has it."""

import random
import tracemalloc
from collections import defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from loomtok.config import EncodingMode, TokenizerConfig, UnknownTokenError
from loomtok.operators import encoding, training, words


def many(spark, n):
    """n documents of ten distinct words each, of ten letters."""
    word = lambda k: F.substring(F.translate(F.md5(F.concat("id", F.lit(f"-{k}"))), "0123456789", "ghijklmnop"), 1, 10)
    return spark.range(n).select(F.col("id").alias("doc_id"), F.concat_ws(" ", *map(word, range(10))).alias("text"))


@pytest.mark.parametrize("mode", [EncodingMode.BYTE_LEVEL, EncodingMode.CHAR_LEVEL, EncodingMode.HYBRID])
def test_driver_memory(spark, mode):
    """A merge loop that held words as lists took some 800 bytes a word: over 100 MB here."""
    docs = many(spark, 15_000)
    tracemalloc.start()
    try:
        model = training.fit(docs, TokenizerConfig(vocab_size=40, encoding_mode=mode))
        peak = tracemalloc.get_traced_memory()[1]
    finally:
        tracemalloc.stop()
    assert len(model.merges) > 5 and peak < 60e6


@pytest.mark.parametrize("canonical", [False, True])
def test_words_on_the_cluster(spark, data, monkeypatch, canonical):
    docs, config = spark.read.parquet(f"{data}/documents.parquet"), TokenizerConfig(vocab_size=240, canonical=canonical)
    here = training.fit(docs, config)
    for name, value in (("DRIVER_BYTES", 0), ("BLOCK", 20_000), ("TASK", 100_000), ("REFRESH", 9), ("CUT", 3), ("AHEAD", 4)):
        monkeypatch.setattr(words, name, value)
    there = training.fit(docs, config)
    assert len(here.merges) > 120 and there.merges == here.merges and there.tokens == here.tokens


def test_changes_of_a_merge():
    pick = random.Random(0)
    for n in range(300):
        kinds = pick.randrange(1, 4)
        texts = [[pick.randrange(kinds) for _ in range(pick.randrange(1, 9))] for _ in range(5)]
        left, right, new = pick.randrange(kinds), pick.randrange(kinds), 9
        counts = [pick.randrange(1, 5) for _ in texts]

        def weights(texts, counts=counts):
            out = defaultdict(int)
            for w, c in zip(texts, counts, strict=True):
                for p in zip(w, w[1:], strict=False):
                    out[p[0] << 32 | p[1]] += c
            return out

        after = []
        for w in texts:
            out, i = [], 0
            while i < len(w):
                hit = w[i : i + 2] == [left, right]
                out.append(new if hit else w[i])
                i += 1 + hit
            after.append(out)
        tokens, held = words.block(texts, counts, words.id_type(10 if n % 2 else 10**6))
        at = words.places(tokens, left, right)
        want, got = weights(texts), words.changes(tokens, held, at, left, right, new)
        for p, c in zip(got[0].tolist(), got[2].tolist(), strict=True):
            want[p] += c
        assert {p: c for p, c in want.items() if c} == weights(after)
        assert np.array_equal(words.merged(tokens, at, new), words.block(after, counts, tokens.dtype)[0])


def test_characters_by_parts(spark):
    """Cut at blanks, kept by part: the ids are those of the whole text, and a part that was met costs no search."""
    text = "hé llo  hello\u0300 \u0300x \r\n hello wörld \u0600 hello "
    model = training.fit(spark.createDataFrame([(0, text * 3)], "doc_id long, text string"), TokenizerConfig(vocab_size=40, encoding_mode=EncodingMode.CHAR_LEVEL))
    encoder = encoding.Encoder(model)
    searched = []
    whole, encoder.characters = encoder.characters, lambda t: searched.append(t) or encoding.Encoder.characters(encoder, t)
    for t in ("hello  hello ll hello", " hello", "wörld hello ", "\n hello", ""):
        assert encoder.plain(t) == np.array(whole(t), "<i4").tobytes()
    assert searched.count(" hello") == 1
    for t in ("hello \u0600 hello", "hello  \u0300x"):  # blanks within a grapheme
        with pytest.raises(UnknownTokenError):
            whole(t)
        with pytest.raises(UnknownTokenError):
            encoder.plain(t)

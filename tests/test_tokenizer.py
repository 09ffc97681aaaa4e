"""Vectors worked out by hand, round trips, files, SQL functions, streams and the command line."""

import unicodedata

import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from loomtok.config import EncodingMode, InvalidConfigError, LoadError, SpecialTokensConfig, TokenizerConfig, TokenizerError, TrainingConfig, UnknownTokenError, UnknownTokenIdError
from loomtok.functions import text as T
from loomtok.functions.sql import register
from loomtok.model import Model
from loomtok.operators import decoding, encoding, merges, training, vocabulary
from loomtok.sources import models
from loomtok.tokenizer import Tokenizer

HELLO = "hello world hello world"


@pytest.fixture(scope="session")
def hello(spark):
    return Tokenizer.builder().vocab_size(50).build().train(spark, HELLO)


def test_bytes():
    t = Tokenizer()
    assert t.encode("Hello") == [72, 101, 108, 108, 111]
    assert t.encode("café") == [99, 97, 102, 195, 169]
    assert t.encode("请") == [232, 175, 183]
    assert t.encode("ł") == [197, 130]
    assert t.decode([999999999]) == "<invalid token 999999999>"
    assert t.decode([228]) == "<decoding error>"
    assert t.decode_with_offsets(t.encode("hi")) == ("hi", [0, 1])
    assert t.decode_with_offsets(t.encode("世")) == ("世", [0, 0, 0])
    assert t.vocab_size == 256 and t.max_token_value == 255


def test_training_order(hello):
    m = hello.model
    assert [(*x, m.tokens[x[2]].decode()) for x in m.merges] == [(2, 2, 8, "ll"), (2, 3, 9, "lo"), (6, 2, 10, "rl"), (2, 7, 11, "ld"), (1, 2, 12, "el"), (5, 3, 13, "wo"), (3, 6, 14, "or"), (0, 1, 15, "he")]
    assert hello.vocab_size == 264 and m.byte_ids[0x70] == 122
    assert hello.encode("hello world") == [15, 8, 3, 4, 13, 10, 7]
    assert hello.encode("help") == [15, 2, 122] and hello.encode("hold") == [0, 3, 11]
    assert hello.decode(hello.encode("hello  wörld\n")) == "hello  wörld\n"


def test_first_priorities():
    words = [[0, 1, 2, 2, 3], [5, 3, 6, 2, 7]]
    import math

    counts = {c: HELLO.count(c) for c in HELLO}
    entropy = {c: -(n / 23) * math.log2(n / 23) for c, n in counts.items()}
    loop = training.MergeLoop(words, [2, 2], list("helo wrd"), entropy, TrainingConfig(50))
    assert [loop.pop()[1] for _ in range(8)] == [983, 973, 953, 953, 953, 943, 943, 923]


def test_canonical(spark):
    t = Tokenizer.builder().vocab_size(50).canonical().build()
    t._use(Model(t.config, (h := Tokenizer.builder().vocab_size(50).build().train(spark, HELLO).model).tokens, h.kinds, h.merges))
    assert t.encode("help") == [0, 12, 122]


def test_specials(spark):
    t = Tokenizer.builder().vocab_size(50).with_special_tokens(SpecialTokensConfig(bos="<bos>", eos="<eos>")).build()
    assert t.encode("Hi") == [0, 74, 107, 1]
    t.train(spark, HELLO)
    ids = t.encode("hello")
    assert ids == [264, 15, 8, 3, 265]
    assert t.decode(ids) == "<bos>hello<eos>" and t.decode(ids, True) == "hello"
    assert t.encode("<bos>", False) != [264]
    t.config.allow_special_literals = True
    t._use(t.model)
    assert t.encode("a<bos>b", False)[1] == 264


def test_errors(hello):
    t = Tokenizer(TokenizerConfig(max_text_bytes=10))
    with pytest.raises(TokenizerError):
        t.encode("x" * 11)
    with pytest.raises(UnknownTokenError):
        hello.encode_single_token("zz")
    with pytest.raises(UnknownTokenIdError):
        hello.decode_single_token_bytes(10**6)
    with pytest.raises(ValueError):
        hello.decode(["a"])
    with pytest.raises(InvalidConfigError):
        TokenizerConfig(vocab_size=0)
    assert hello.encode_single_token("ll") == 8 and hello.decode_single_token_bytes(8) == b"ll"
    assert hello.decode([]) == "" and hello.encode_batch([]) == []
    full = hello.encode_full("hold")
    assert len(full) == 3 and full.get_tokens() == ["0", "3", "11"] and not full.is_empty()


@settings(deadline=None, max_examples=80, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.text())
def test_round_trip(hello, text):
    assert hello.decode(hello.encode(text)) == unicodedata.normalize("NFC", text)


def test_tables_round_trip(spark, data, hello):
    for name in ("documents", "conversations"):
        rows = spark.read.parquet(f"{data}/{name}.parquet").select("text")
        out = hello.decode_frame(hello.encode_frame(rows))
        assert out.where("decoded <> text").count() == 0
    odd = spark.createDataFrame([(None,), ("",), ("é",)], "text string")
    assert [r.decoded for r in hello.decode_frame(hello.encode_frame(odd)).collect()] == [None, "", "é"]


def test_frame_equals_single(spark, data, hello):
    rows = spark.read.parquet(f"{data}/documents.parquet").select("text").limit(30)
    for r in hello.encode_frame(rows).collect():
        assert list(r.ids) == hello.encode(r.text, False)
    fold = encoding.encode_fold(rows.withColumn("k", F.monotonically_increasing_id()), "k", "text", encoding.byte_ids(F.col("run")), [(116, 104, 256)])
    assert fold.count() == rows.count()


def test_partitions_do_not_matter(spark, data):
    docs = spark.read.parquet(f"{data}/documents.parquet")
    a = training.fit(docs.repartition(7), TokenizerConfig(vocab_size=200))
    b = training.fit(docs.coalesce(1), TokenizerConfig(vocab_size=200))
    assert a.tokens == b.tokens and a.merges == b.merges
    assert all(a.tokens[n] == a.tokens[x] + a.tokens[y] for x, y, n in a.merges)


def test_too_many_words(spark):
    with pytest.raises(InvalidConfigError):
        training.fit(spark.createDataFrame([(0, "a b c")], "doc_id long, text string"), TokenizerConfig(), TrainingConfig(max_words=2))


def test_files(spark, hello, tmp_path):
    hello.save(str(tmp_path / "json"))
    hello.save(str(tmp_path / "pair"), "huggingface")
    models.save_parquet(hello.model, spark, f"file://{tmp_path}/tables")
    for m in (models.load_json(str(tmp_path / "json")), models.load_pair(str(tmp_path / "pair")), models.load_parquet(spark, f"file://{tmp_path}/tables")):
        assert m.tokens == hello.model.tokens and m.merges == hello.model.merges
    named = Tokenizer.builder().with_special_tokens(SpecialTokensConfig(bos="<s>", unk="<u>")).build()
    named.save(str(tmp_path / "named"))
    again = Tokenizer.load(str(tmp_path / "named"))
    assert again.model.specials == {"unk": 0, "bos": 1} and again.encode("a") == [1, 99]
    rows = models.document_merges(models.read_documents(spark, f"file://{tmp_path}/json/tokenizer.json")).orderBy("rank").collect()
    assert [(r.l, r.r, r.new_id) for r in rows] == hello.model.merges
    with pytest.raises(LoadError):
        models.load_json(str(tmp_path / "none"))
    (tmp_path / "pair" / "merges.txt").write_text("#version\nx y z\n")
    with pytest.raises(LoadError):
        models.load_pair(str(tmp_path / "pair"))


def test_char_level(spark):
    t = Tokenizer.builder().vocab_size(60).encoding_mode(EncodingMode.CHAR_LEVEL).build().train(spark, "héllo héllo wörld")
    assert t.decode(t.encode("héllo wörld")) == "héllo wörld"
    with pytest.raises(UnknownTokenError):
        t.encode("日")
    h = Tokenizer.builder().vocab_size(60).encoding_mode(EncodingMode.HYBRID).build().train(spark, "héllo")
    assert h.decode(h.encode("日")) == "日"


def test_late_rules_reach_short_runs():
    base = Model.untrained(TokenizerConfig())
    pairs = [(a, b) for a in range(9) for b in range(112)][:1000] + [(97, 98)]
    m = Model(base.config, base.tokens + [bytes(p) for p in pairs], base.kinds + ["merge"] * 1001, [(a, b, 256 + i) for i, (a, b) in enumerate(pairs)], {})
    assert Tokenizer(model=m).encode("ab ab abc") == [1256, 32, 1256, 32, 1256, 99]


def plain_lowest_first(ids, rules):
    while ranked := [(rules[p][0], p) for p in zip(ids, ids[1:], strict=False) if p in rules]:
        pair, out, i = min(ranked)[1], [], 0
        while i < len(ids):
            hit = tuple(ids[i : i + 2]) == pair
            out.append(rules[pair][1] if hit else ids[i])
            i += 1 + hit
        ids = out
    return ids


@settings(max_examples=400, deadline=None)
@given(st.lists(st.integers(0, 3), max_size=16), st.lists(st.tuples(st.integers(0, 9), st.integers(0, 9)), unique=True, max_size=12))
def test_lowest_first_is_that_of_plain_loops(ids, pairs):
    rules = {p: (rank, 4 + rank) for rank, p in enumerate(pairs)}
    assert encoding.lowest_first(ids, rules) == plain_lowest_first(ids, rules)


def test_a_long_run_takes_seconds():
    import random
    import time

    pick, rules = random.Random(0), {(a, b): (50 * a + b, 50 + 50 * a + b) for a in range(50) for b in range(50)}
    began = time.time()
    assert len(encoding.lowest_first([pick.randrange(50) for _ in range(200_000)], rules)) < 200_000
    assert time.time() - began < 30


def test_char_level_files(spark, tmp_path):
    t = Tokenizer.builder().vocab_size(60).encoding_mode(EncodingMode.CHAR_LEVEL).build().train(spark, "łódź łódź Bń D Ł")
    t.save(str(tmp_path))
    again = Tokenizer.load(str(tmp_path))
    assert again.model.tokens == t.model.tokens and again.model.kinds == t.model.kinds and again.model.merges == t.model.merges
    assert again.encode("łódź D") == t.encode("łódź D") and again.decode(t.encode("łódź Bń")) == "łódź Bń"


def test_text_files(spark, tmp_path):
    for name, text in (("b.txt", "three\nfour"), ("a.txt", "one\ntwo")):
        (tmp_path / name).write_text(text)
    assert sorted(map(tuple, models.read_text(spark, f"file://{tmp_path}").collect())) == [(0, "one\ntwo"), (1, "three\nfour")]
    lines = sorted(map(tuple, models.read_text(spark, f"file://{tmp_path}", whole=False).collect()))
    assert lines == [(0, "one"), (1, "two"), (1 << 40, "three"), ((1 << 40) + 1, "four")]


def test_vocabulary(spark):
    rows = vocabulary.special_rows(spark, SpecialTokensConfig(eos="</s>", pad="<p>"))
    v = vocabulary.add_tokens(vocabulary.empty(spark), rows.select("token", "ord"))
    assert [(r.id, r.token) for r in v.orderBy("id").collect()] == [(0, "<p>"), (1, "</s>")]
    with pytest.raises(InvalidConfigError):
        vocabulary.add_tokens_with_ids(v, spark.createDataFrame([(1, "x")], vocabulary.SCHEMA))
    assert vocabulary.size(v) == 2
    assert merges.stats(spark.createDataFrame([], merges.SCHEMA)).first().asDict() == {"n": 0, "min_rank": 0, "max_rank": 0}


def test_text(spark):
    df = spark.createDataFrame([("hello  world\x1cx y",)], "t string")
    assert df.select(T.split_whitespace(F.col("t")).alias("x")).first().x == ["hello", "world\x1cx", "y"]
    assert training.split_words("hello  world\x1cx y") == ["hello", "world\x1cx", "y"]
    assert spark.createDataFrame([("ab,,c",)], "t string").select(T.split_custom(F.col("t"), ",").alias("x")).first().x == ["ab", "", "c"]
    assert spark.createDataFrame([("éx",)], "t string").select(T.graphemes(F.col("t")).alias("x")).first().x == ["é", "x"]
    assert not T.is_enabled("None")


def test_sql_functions(spark, hello):
    register(spark, hello.model)
    r = spark.sql("SELECT bpe_encode('help') AS a, bpe_count('help') AS n, bpe_decode(array(15, 2, 122)) AS d").first()
    assert list(r.a) == [15, 2, 122] and r.n == 3 and r.d == "help"
    assert [x.token for x in spark.sql("SELECT * FROM bpe_tokens('hold')").collect()] == ["h", "o", "ld"]


def test_streams(spark, data, hello, tmp_path):
    from loomtok.streaming import encode_stream, read_stream, running_token_counts, windowed_tokens

    schema = spark.read.parquet(f"{data}/events.parquet").schema
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "a.parquet").symlink_to(f"{data}/events.parquet")
    stream = read_stream(spark, str(tmp_path / "in"), schema)
    for name, df, mode in (("s1", encode_stream(stream, hello.model, "props").select("ids"), "append"), ("s2", running_token_counts(stream, hello.model, "props"), "complete"), ("s3", windowed_tokens(stream, hello.model, "ts", "props"), "append")):
        q = df.writeStream.format("memory").queryName(name).outputMode(mode).option("checkpointLocation", str(tmp_path / name)).trigger(availableNow=True).start()
        q.awaitTermination(120)
    assert spark.table("s1").count() == spark.read.parquet(f"{data}/events.parquet").count()
    whole = hello.encode_frame(spark.read.parquet(f"{data}/events.parquet").select("props"), "props").select(F.explode("ids")).count()
    assert spark.table("s2").agg(F.sum("n")).first()[0] == whole


def test_command_line(spark, tmp_path, capsys):
    from loomtok.__main__ import main

    (tmp_path / "t.txt").write_text(HELLO)
    main(["train", f"file://{tmp_path}/t.txt", str(tmp_path / "m"), "--vocab-size", "50"])
    main(["encode", str(tmp_path / "m"), "help"])
    main(["decode", str(tmp_path / "m"), "15,2,122"])
    assert "15 2 122\nhelp" in capsys.readouterr().out


def test_decoder_rows_apart(spark):
    m = Model.untrained(TokenizerConfig())
    rows = spark.createDataFrame([([195],), ([169],), ([65],)], "ids array<int>").coalesce(1)
    assert [r.decoded for r in decoding.decode(rows, m).collect()] == ["<decoding error>", "<decoding error>", "A"]

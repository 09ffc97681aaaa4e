"""Registered queries and the SQL that they are checked against.

Every query runs over whole tables; a limit is part of a top-k report only.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from loomtok.config import EncodingMode, SpecialTokensConfig, TokenizerConfig
from loomtok.functions import text as T
from loomtok.model import Model
from loomtok.operators import decoding, encoding, merges, statistics, training, vocabulary
from loomtok.plans.samples import RULES, SPECIALS
from loomtok.sources import models

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}


def query(sql: str | None = None) -> Callable:
    def add(f: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
        QUERIES[f.__name__] = f
        if sql:
            ORACLE_SQL[f.__name__] = sql
        return f

    return add


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def docs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents")


def said(ids: F.Column) -> F.Column:
    return F.array_join(F.transform(ids, lambda x: x.cast("string")), " ")


# sources and sinks


@query("SELECT doc_id, length(text)::BIGINT AS n_chars_read, md5(text) AS digest FROM documents")
def read_training_text(spark, d):
    return docs(spark, d).select("doc_id", F.length("text").cast("long").alias("n_chars_read"), F.md5(F.col("text").cast("binary")).alias("digest"))


@query("SELECT doc_id, md5(array_to_string(list_transform(regexp_extract_all(hex(encode(text)), '..'), lambda x: (concat('0x', x)::INT)::VARCHAR), ' ')) AS digest FROM documents")
def write_encoded_ids(spark, d):
    return docs(spark, d).select("doc_id", F.md5(T.join_ids(encoding.byte_ids(F.col("text"))).cast("binary")).alias("digest"))


@query("SELECT doc_id, list_sum(list_transform(string_split(concat(doc_id, ', ', n_chars, ',  7'), ','), lambda x: trim(x)::INT))::BIGINT AS total FROM documents")
def parse_ids(spark, d):
    ids = T.parse_ids(F.concat("doc_id", F.lit(", "), "n_chars", F.lit(",  7")))
    return docs(spark, d).select("doc_id", F.aggregate(ids, F.lit(0).cast("long"), lambda a, x: a + x).alias("total"))


def _words_model(top: int = 40) -> str:
    """SQL of a vocabulary of the characters of documents, and merges of its commonest pairs."""
    return f"""
    ch AS (SELECT c AS token, row_number() OVER (ORDER BY min(struct_pack(d := doc_id, p := p))) - 1 AS id
      FROM (SELECT doc_id, unnest(string_split(text, '')) AS c, generate_subscripts(string_split(text, ''), 1) AS p FROM documents) WHERE c <> '' GROUP BY c),
    w AS (SELECT w, count(*) AS n FROM (SELECT unnest(regexp_split_to_array(text, '\\s+')) AS w FROM documents) WHERE w <> '' GROUP BY w),
    pr AS (SELECT w[i] AS a, w[i + 1] AS b, sum(n)::BIGINT AS n FROM (SELECT w, n, unnest(range(1, length(w))) AS i FROM w) GROUP BY 1, 2),
    top AS (SELECT a, b, row_number() OVER (ORDER BY n DESC, a, b) - 1 AS rank FROM pr QUALIFY rank < {top})"""


def _sample_vocab(spark, d, top: int = 40) -> tuple[DataFrame, DataFrame]:
    """The same: (id, token) of characters, and (rank, a, b) of the commonest pairs."""
    chars = vocabulary.base_characters(docs(spark, d)).withColumnRenamed("ch", "token")
    best = statistics.pair_counts(statistics.word_counts(docs(spark, d))).orderBy(F.desc("cnt"), "lch", "rch").limit(top)
    ranked = best.select("lch", "rch", (F.row_number().over(Window.orderBy(F.desc("cnt"), "lch", "rch")) - 1).cast("int").alias("rank"))
    return chars, ranked.select("rank", F.col("lch").alias("a"), F.col("rch").alias("b"))


@query(f"WITH {_words_model()} SELECT rank::INT AS rank, concat(a, ' ', b) AS line FROM top")
def hf_merges_export(spark, d):
    vocab, top = _sample_vocab(spark, d)
    rules = top.join(vocab.select(F.col("token").alias("a"), F.col("id").alias("l")), "a").join(vocab.select(F.col("token").alias("b"), F.col("id").alias("r")), "b")
    return models.pair_lines(rules.select("l", "r", "rank"), vocab)


@query(f"""WITH {_words_model()}, n AS (SELECT count(*) AS n FROM ch)
SELECT rank::INT AS rank, x.id::INT AS l, y.id::INT AS r, (n.n + rank)::INT AS new_id FROM top JOIN ch x ON x.token = a JOIN ch y ON y.token = b, n""")
def hf_merges_import(spark, d):
    vocab, top = _sample_vocab(spark, d)
    new = top.select(F.concat("a", "b").alias("token"), F.col("rank").alias("ord"))
    full = vocabulary.add_tokens(vocab, new)
    return models.lines_to_merges(top.select("rank", F.concat_ws(" ", "a", "b").alias("line")), full)


@query(f"""WITH {_words_model(20)}, n AS (SELECT count(*) AS n FROM ch)
SELECT rank::INT AS rank, x.id::INT AS l, y.id::INT AS r, (n.n + rank)::INT AS new_id FROM top JOIN ch x ON x.token = a JOIN ch y ON y.token = b, n""")
def model_json_merges(spark, d):
    vocab, top = _sample_vocab(spark, d, 20)
    full = vocabulary.add_tokens(vocab, top.select(F.concat("a", "b").alias("token"), F.col("rank").alias("ord")))
    entries = full.agg(F.map_from_entries(F.collect_list(F.struct("token", "id"))).alias("vocab"), F.map_from_entries(F.collect_list(F.struct(F.col("id").cast("string"), "token"))).alias("vocab_r"))
    new = full.select(F.col("id").alias("new_token_id"), F.col("token").alias("ab"))
    rules = top.withColumn("ab", F.concat("a", "b")).join(new, "ab").agg(F.collect_list(F.struct(F.array("a", "b").alias("pair"), "rank", "new_token_id")).alias("merges"))
    document = entries.join(rules).select(F.to_json(F.struct("vocab", "vocab_r", "merges")).alias("json"))
    return models.document_merges(document.select(F.from_json("json", models.JSON_SCHEMA).alias("x")).select("x.*"))


@query("""WITH v(token, id) AS (VALUES ('a', 0), ('b', 1)), r(id, token) AS (VALUES ('0', 'a'), ('1', 'b'), ('2', 'ab'))
SELECT id::INT AS id, token FROM v UNION ALL SELECT id::INT, token FROM r WHERE token NOT IN (SELECT token FROM v)""")
def vocab_consistency_fill(spark, d):
    v = spark.createDataFrame([("a", 0), ("b", 1)], "token string, id int")
    r = spark.createDataFrame([("0", "a"), ("1", "b"), ("2", "ab")], "id string, token string")
    return v.select("id", "token").unionByName(r.join(v.select("token"), "token", "left_anti").select(F.col("id").cast("int").alias("id"), "token"))


# text


@query("SELECT doc_id, md5(nfc_normalize(concat(text, 'e', chr(769), ' A', chr(778)))) AS digest FROM documents")
def nfc_normalize(spark, d):
    rows = docs(spark, d).select("doc_id", F.concat("text", F.lit("é Å")).alias("text"))
    return T.normalize(rows).select("doc_id", F.md5(F.col("text").cast("binary")).alias("digest"))


@query()
def other_normal_forms(spark, d):
    rows = docs(spark, d).select("doc_id", F.concat("text", F.lit("éﬁ")).alias("text"))
    for form in ("NFD", "NFKC", "NFKD", "None"):
        rows = T.normalize(rows, "text", form, form.lower())
    return rows.select("doc_id", *(F.length(f).cast("long").alias(f"n_{f}") for f in ("nfd", "nfkc", "nfkd", "none")))


@query("SELECT doc_id, md5(text) AS digest, 1::INT AS n FROM documents")
def split_none(spark, d):
    parts = T.split_none(F.col("text"))
    return docs(spark, d).select("doc_id", F.md5(parts[0].cast("binary")).alias("digest"), F.size(parts).alias("n"))


@query(r"SELECT doc_id, len(list_filter(regexp_split_to_array(text, '\s+'), lambda w: w <> ''))::INT AS n FROM documents")
def split_whitespace(spark, d):
    return docs(spark, d).select("doc_id", F.size(T.split_whitespace(F.col("text"))).alias("n"))


@query("SELECT doc_id, len(string_split(text, ''))::INT AS n, string_split(text, '')[2] AS second FROM documents")
def split_chars(spark, d):
    parts = T.split_characters(F.col("text"))
    return docs(spark, d).select("doc_id", F.size(parts).alias("n"), F.get(parts, F.lit(1)).alias("second"))


@query("SELECT doc_id, len(regexp_split_to_array(text, '[,.]'))::INT AS n FROM documents")
def split_regex(spark, d):
    return docs(spark, d).select("doc_id", F.size(T.split_custom(F.col("text"), "[,.]")).alias("n"))


@query()
def grapheme_counts(spark, d):
    return docs(spark, d).select("doc_id", F.size(T.graphemes(F.col("text"))).alias("n"))


@query("""SELECT doc_id, list_sum(list_transform(regexp_extract_all(hex(encode(text)), '..'), lambda x: CASE x WHEN '61' THEN 5 WHEN 'C3' THEN 6 ELSE 1 END))::BIGINT AS total,
1::INT AS when_off FROM documents""")
def byte_fallback_ids(spark, d):
    vocab = F.create_map(F.lit("<0x61>"), F.lit(5), F.lit("<0xc3>"), F.lit(6))
    ids = T.byte_fallback(F.col("text"), vocab, 1)
    return docs(spark, d).select("doc_id", F.aggregate(ids, F.lit(0).cast("long"), lambda a, x: a + x).alias("total"), F.element_at(T.byte_fallback(F.col("text"), vocab, 1, False), 1).alias("when_off"))


# vocabulary and merges


@query(f"WITH {_words_model()} SELECT id::INT AS id, token AS ch FROM ch")
def base_char_vocab(spark, d):
    return vocabulary.base_characters(docs(spark, d))


@query(f"""WITH {_words_model()}, h AS (SELECT id, hex(encode(token)) AS hex FROM ch), n AS (SELECT count(*) AS n FROM h),
m AS (SELECT upper(printf('%02x', i)) AS hex FROM range(256) t(i) WHERE NOT EXISTS (SELECT 1 FROM h WHERE h.hex = upper(printf('%02x', i))))
SELECT id::INT AS id, hex FROM h UNION ALL SELECT (n.n + row_number() OVER (ORDER BY hex) - 1)::INT, hex FROM m, n""")
def byte_vocab_completion(spark, d):
    chars = vocabulary.base_characters(docs(spark, d)).select("id", F.hex(F.encode("ch", "UTF-8")).alias("hex"))
    return vocabulary.byte_completion(chars)


@query(f"SELECT * FROM (VALUES {', '.join(f'({i}, {chr(39)}{t}{chr(39)}, {str(i in (2, 3)).upper()})' for i, t in enumerate(SPECIALS))}) t(id, token, is_edge)")
def special_vocab(spark, d):
    rows = vocabulary.special_rows(spark, SpecialTokensConfig(*SPECIALS))
    vocab = vocabulary.add_tokens(vocabulary.empty(spark), rows.select("token", "ord"))
    return vocab.withColumn("is_edge", vocabulary.is_special(F.col("id"), [2, 3]))


@query(f"""WITH {_words_model()}, n AS (SELECT count(*) AS n, max(id) AS m FROM ch)
SELECT x.token AS left_token, y.token AS right_token, concat(x.token, y.token) AS token, rank::INT AS rank, n.n::BIGINT AS n_vocab, n.m::INT AS max_id FROM top JOIN ch x ON x.token = a JOIN ch y ON y.token = b, n""")
def merge_token_strings(spark, d):
    vocab, top = _sample_vocab(spark, d)
    rules = top.join(vocab.select(F.col("token").alias("a"), F.col("id").alias("l")), "a").join(vocab.select(F.col("token").alias("b"), F.col("id").alias("r")), "b")
    named = vocabulary.token_strings(rules.select("l", "r", "rank"), vocab)
    size = vocab.agg(F.count("*").alias("n_vocab"), F.max("id").alias("max_id"))
    by_id = lambda c, n: vocab.select(F.col("id").alias(c), F.col("token").alias(n))
    return named.join(by_id("l", "left_token"), "l").join(by_id("r", "right_token"), "r").join(F.broadcast(size)).select("left_token", "right_token", "token", "rank", "n_vocab", "max_id")


_LEFT = ", ".join(f"({a}, {b}, {r}, {n})" for r, (a, b, n) in enumerate(RULES))


@query(f"""WITH m(l, r, rank, new_id) AS (VALUES {_LEFT}), p AS (SELECT x.l AS l1, x.r AS r1, y.l AS l2, y.r + 1 AS r2 FROM m x, m y)
SELECT p.l1::INT AS l1, p.r1::INT AS r1, p.l2::INT AS l2, p.r2::INT AS r2, coalesce(a.rank < b.rank, a.rank IS NOT NULL AND b.rank IS NULL) AS first_goes
FROM p LEFT JOIN m a ON a.l = l1 AND a.r = r1 LEFT JOIN m b ON b.l = l2 AND b.r = r2""")
def merge_rank_compare(spark, d):
    m = spark.createDataFrame([(a, b, r, n) for r, (a, b, n) in enumerate(RULES)], merges.SCHEMA)
    p = m.select(F.col("l").alias("l1"), F.col("r").alias("r1")).join(m.select(F.col("l").alias("l2"), (F.col("r") + 1).alias("r2")))
    side = lambda k: m.select(F.col("l").alias(f"l{k}"), F.col("r").alias(f"r{k}"), F.col("rank").alias(f"rank{k}"))
    out = p.join(side(1), ["l1", "r1"], "left").join(side(2), ["l2", "r2"], "left")
    return out.select("l1", "r1", "l2", "r2", merges.before(F.col("rank1"), F.col("rank2")).alias("first_goes"))


@query(f"WITH m(l, r, rank, new_id) AS (VALUES {_LEFT}, (116, 104, 20, 300)) SELECT count(DISTINCT (l, r))::BIGINT AS n, 1::INT AS min_rank, 20::INT AS max_rank FROM m")
def merge_stats(spark, d):
    m = spark.createDataFrame([(a, b, r, n) for r, (a, b, n) in enumerate(RULES)], merges.SCHEMA)
    again = spark.createDataFrame([(116, 104, 20, 300, 0)], merges.SCHEMA + ", seq long")
    return merges.stats(merges.upsert(m, again))


@query("SELECT * FROM (VALUES (0, 116, 104, 4294967295), (1, 104, 101, 4294967295)) t(rank, l, r, new_id)")
def merges_from_pairs(spark, d):
    pairs = F.array(*(F.struct(F.lit(a).alias("l"), F.lit(b).alias("r")) for a, b, _ in RULES[:2]))
    return spark.range(1).select(F.explode(merges.from_pairs(pairs)).alias("m")).select("m.rank", "m.l", "m.r", F.col("m.new_id").cast("long").alias("new_id"))


@query("""SELECT doc_id, text[1] AS token, unicode(text[1])::INT AS code, CASE WHEN unicode(text[1]) < 128 THEN unicode(text[1])::INT END AS id FROM documents""")
def single_token_lookup(spark, d):
    vocab = spark.range(128).select(F.col("id").cast("int").alias("id"), F.chr("id").alias("token"))
    rows = docs(spark, d).select("doc_id", F.substring("text", 1, 1).alias("token"))
    return vocabulary.get_ids(vocab, rows).select("doc_id", "token", F.ascii("token").alias("code"), "id")


# training statistics

_WORDS = r"w AS (SELECT w, count(*) AS n FROM (SELECT unnest(regexp_split_to_array(text, '\s+')) AS w FROM documents) WHERE w <> '' GROUP BY w)"
_CHARS = "c AS (SELECT c, count(*) AS n FROM (SELECT unnest(string_split(text, '')) AS c FROM documents) WHERE c <> '' GROUP BY c), e AS (SELECT c, n, n / sum(n) OVER () AS p FROM c)"
_PAIRS = "pr AS (SELECT w[i] AS a, w[i + 1] AS b, sum(n)::BIGINT AS n FROM (SELECT w, n, unnest(range(1, length(w))) AS i FROM w) GROUP BY 1, 2)"


@query(f"WITH {_WORDS} SELECT w AS word, n AS cnt FROM w ORDER BY n DESC, w LIMIT 100")
def word_counts_topk(spark, d):
    return statistics.word_counts(docs(spark, d)).orderBy(F.desc("cnt"), "word").limit(100)


@query(f"WITH {_WORDS} SELECT count(*)::BIGINT AS n_words, sum(n)::BIGINT AS n_occurrences FROM w")
def word_totals(spark, d):
    return statistics.word_counts(docs(spark, d)).agg(F.count("*").alias("n_words"), F.sum("cnt").alias("n_occurrences"))


@query(f"WITH {_WORDS}, {_PAIRS} SELECT a AS lch, b AS rch, n AS cnt FROM pr")
def pair_counts(spark, d):
    return statistics.pair_counts(statistics.word_counts(docs(spark, d)))


@query(f"WITH {_CHARS} SELECT c AS ch, n AS cnt, round(-p * log2(p), 6) AS entropy FROM e")
def char_entropy(spark, d):
    return statistics.char_entropy(docs(spark, d)).select("ch", "cnt", F.round("entropy", 6).alias("entropy"))


@query(f"""WITH {_WORDS}, {_CHARS}, t AS (SELECT w FROM w ORDER BY n DESC, w LIMIT 500)
SELECT w AS token, round(avg(-p * log2(p)), 6) AS entropy FROM (SELECT w, unnest(string_split(w, '')) AS c FROM t) JOIN e USING (c) GROUP BY w""")
def token_entropy(spark, d):
    top = statistics.word_counts(docs(spark, d)).orderBy(F.desc("cnt"), "word").limit(500).select(F.col("word").alias("token"))
    return statistics.token_entropy(top, statistics.char_entropy(docs(spark, d))).select("token", F.round("entropy", 6).alias("entropy"))


@query(f"""WITH {_WORDS}, {_CHARS}
SELECT w AS token, round(avg(-p * log2(p)), 6) AS entropy FROM (SELECT w, unnest(string_split(w, '')) AS c FROM w) JOIN e USING (c) GROUP BY w""")
def token_entropy_all(spark, d):
    words = statistics.word_counts(docs(spark, d)).select(F.col("word").alias("token"))
    return statistics.token_entropy(words, statistics.char_entropy(docs(spark, d))).select("token", F.round("entropy", 6).alias("entropy"))


_NEAR = """s AS (SELECT list_transform(range(1, length(w)), lambda i: w[i:i+1]) AS p FROM w WHERE length(w) > 2),
x AS (SELECT DISTINCT p[i] AS a, p[i + k] AS b FROM (SELECT p, unnest(range(1, len(p))) AS i FROM s), (VALUES (1), (2)) t(k) WHERE i + k <= len(p)),
dv AS (SELECT a, count(DISTINCT b)::BIGINT AS n FROM (SELECT a, b FROM x UNION SELECT b, a FROM x) GROUP BY a)"""


@query(f"WITH {_WORDS}, {_NEAR} SELECT a[1] AS lch, a[2] AS rch, n AS diversity, round(ln(1 + n), 6) AS score FROM dv")
def pair_context_diversity(spark, d):
    return statistics.pair_diversity(statistics.word_counts(docs(spark, d))).withColumn("score", F.round(statistics.diversity_score(F.col("diversity")), 6))


_SCORED = """SELECT pr.a AS lch, pr.b AS rch, pr.n AS cnt, round(0.6 * ln(pr.n + 2) + 0.3 * (-x.p * log2(x.p) - y.p * log2(y.p)) / 2 + {}, 6) AS score
FROM pr JOIN e x ON x.c = pr.a JOIN e y ON y.c = pr.b {} WHERE pr.n >= 2"""


@query(f"WITH {_WORDS}, {_CHARS}, {_PAIRS} {_SCORED.format('0', '')} ORDER BY score DESC, lch DESC, rch DESC LIMIT 100")
def merge_scores_topk(spark, d):
    scores = statistics.pair_scores(statistics.pair_counts(statistics.word_counts(docs(spark, d))), statistics.char_entropy(docs(spark, d)))
    return statistics.top_candidates(scores, 100).withColumn("score", F.round("score", 6))


@query(f"WITH {_WORDS}, {_CHARS}, {_PAIRS}, {_NEAR} {_SCORED.format('0.1 * ln(1 + coalesce(dv.n, 0))', 'LEFT JOIN dv ON dv.a = concat(pr.a, pr.b)')}")
def merge_scores_with_diversity(spark, d):
    words = statistics.word_counts(docs(spark, d))
    scores = statistics.pair_scores(statistics.pair_counts(words), statistics.char_entropy(docs(spark, d)), diversity=statistics.pair_diversity(words))
    return scores.withColumn("score", F.round("score", 6))


@query(f"WITH {_WORDS}, {_PAIRS} SELECT concat(a, b) AS token, n AS priority, round(ln(1 + n) * (1 + strlen(concat(a, b)) / 10.0), 6) AS utility, (n < 5) AS low FROM pr")
def token_utility(spark, d):
    pairs = statistics.pair_counts(statistics.word_counts(docs(spark, d))).select(F.concat("lch", "rch").alias("token"), F.col("cnt").alias("priority"))
    return pairs.select("token", "priority", F.round(statistics.token_utility(F.col("priority"), F.col("token")), 6).alias("utility"), (F.col("priority") < 5).alias("low"))


@query(f"""WITH {_WORDS}, z AS (SELECT n, list_transform(string_split(w, ''), lambda c: c) AS t, replace(concat(' ', array_to_string(string_split(w, ''), '  '), ' '), ' t  h ', ' th ') AS m FROM w),
y AS (SELECT n, string_split(trim(m), '  ') AS t FROM z)
SELECT t[i] AS l, t[i + 1] AS r, sum(n)::BIGINT AS cnt FROM (SELECT t, n, unnest(range(1, len(t))) AS i FROM y) GROUP BY 1, 2""")
def merge_step_once(spark, d):
    words = statistics.word_counts(docs(spark, d)).select("cnt", T.split_characters(F.col("word")).alias("t"))

    def step(acc, x):
        return F.when((F.element_at(acc, -1) == "t") & (x == "h"), F.concat(F.slice(acc, 1, F.size(acc) - 1), F.array(F.lit("th")))).otherwise(F.concat(acc, F.array(x)))

    merged = words.select("cnt", F.aggregate(F.slice("t", 2, F.size("t")), F.slice("t", 1, 1), step).alias("toks"))
    return statistics.token_pair_counts(merged)


@query(f"""WITH {_WORDS}, {_PAIRS}, u AS (SELECT concat(a, b) AS token, ln(1 + n) * (1 + strlen(concat(a, b)) / 10.0) AS utility FROM pr)
SELECT token, round(utility, 6) AS utility FROM u QUALIFY row_number() OVER (ORDER BY round(utility, 6), token) <= greatest(1, (SELECT count(*) FROM u) // 100)""")
def final_prune_report(spark, d):
    pairs = statistics.pair_counts(statistics.word_counts(docs(spark, d))).select(F.concat("lch", "rch").alias("token"), F.col("cnt").alias("priority"))
    u = pairs.select("token", F.round(statistics.token_utility(F.col("priority"), F.col("token")), 6).alias("utility"))
    return u.orderBy("utility", "token").limit(max(1, u.count() // 100))


@query()
def train_small_model(spark, d):
    return training.fit(docs(spark, d), TokenizerConfig(vocab_size=400)).merges_frame(spark)


# encoding


@query("SELECT lang, sum(strlen(text))::BIGINT AS n_tokens, round(sum(length(text)) / sum(strlen(text)), 6) AS chars_per_token FROM documents GROUP BY lang")
def byte_tokens_by_lang(spark, d):
    n = F.octet_length("text")  # the size of byte_ids, without making them
    return docs(spark, d).groupBy("lang").agg(F.sum(n).alias("n_tokens"), F.round(F.sum(F.length("text")) / F.sum(n), 6).alias("chars_per_token"))


@query("SELECT doc_id, md5(array_to_string(list_transform(regexp_extract_all(hex(encode(text)), '..'), lambda x: (concat('0x', x)::INT)::VARCHAR), ' ')) AS digest, strlen(text)::INT AS n FROM documents")
def byte_encode_ids(spark, d):
    out = encoding.encode(docs(spark, d).select("doc_id", "text"), Model.untrained(TokenizerConfig()))
    return out.select("doc_id", F.md5(said(F.col("ids")).cast("binary")).alias("digest"), F.size("ids").alias("n"))


_RUNS = r"regexp_extract_all(text, '\s+|\S+')"
_SWEEP = "list_reduce(list_prepend([-1], list_transform({}, lambda t: [t])), lambda a, x: CASE {} ELSE list_concat(a, x) END)"
_CASES = " ".join(f"WHEN a[-1] = {a} AND x[1] = {b} THEN list_append(a[:-2], {n})" for a, b, n in RULES)


def _sweep_sql(times: int) -> str:
    ids = "list_transform(regexp_extract_all(hex(encode(r)), '..'), lambda h: concat('0x', h)::INT)"
    for _ in range(times):
        ids = f"list_filter({_SWEEP.format(ids, _CASES)}, lambda t: t >= 0)"
    return ids


def _fixed_model(**more) -> Model:
    base = Model.untrained(TokenizerConfig(**more))
    tokens = list(base.tokens)
    for a, b, _ in RULES:
        tokens.append(tokens[a] + tokens[b])
    return Model(base.config, tokens, base.kinds + ["merge"] * len(RULES), [*RULES], base.specials)


@query(f"""WITH r AS (SELECT doc_id, unnest({_RUNS}) AS r, generate_subscripts({_RUNS}, 1) AS i FROM documents),
k AS (SELECT r, {_sweep_sql(3)} AS ids FROM (SELECT DISTINCT r FROM r))
SELECT doc_id, md5(array_to_string(list_transform(flatten(list(ids ORDER BY i)), lambda t: t::VARCHAR), ' ')) AS digest, sum(len(ids))::INT AS n FROM r JOIN k USING (r) GROUP BY doc_id""")
def encode_fixed_model(spark, d):
    out = encoding.encode(docs(spark, d).select("doc_id", "text"), _fixed_model())
    return out.select("doc_id", F.md5(said(F.col("ids")).cast("binary")).alias("digest"), F.size("ids").alias("n"))


def _late_model() -> Model:
    """A thousand rules over bytes that no text of the tables has, then t and h as rule 1000."""
    base = Model.untrained(TokenizerConfig())
    absent = [*range(9), *range(14, 32), 0xC0, 0xC1, *range(0xF8, 0x100)]
    pairs = [(a, b) for a in absent for b in absent][:1000] + [(ord("t"), ord("h"))]
    rules = [(a, b, 256 + i) for i, (a, b) in enumerate(pairs)]
    return Model(base.config, base.tokens + [bytes(p) for p in pairs], base.kinds + ["merge"] * len(rules), rules, base.specials)


@query("""SELECT doc_id, strlen(t)::INT - n AS n_ids, n AS n_merged FROM (SELECT doc_id, nfc_normalize(text) AS t, ((strlen(nfc_normalize(text)) - strlen(replace(nfc_normalize(text), 'th', ''))) // 2)::INT AS n FROM documents)""")
def encode_late_rules(spark, d):
    out = encoding.encode(docs(spark, d).select("doc_id", "text"), _late_model())
    return out.select("doc_id", F.size("ids").alias("n_ids"), F.size(F.filter("ids", lambda i: i == 1256)).alias("n_merged"))


@query(ORACLE_SQL["encode_fixed_model"])
def encode_fixed_model_fold(spark, d):
    out = encoding.encode_fold(docs(spark, d), "doc_id", "text", encoding.byte_ids(F.col("run")), list(RULES))
    return out.select("doc_id", F.md5(said(F.col("ids")).cast("binary")).alias("digest"), F.size("ids").alias("n"))


def _canonical_sql() -> str:
    out = "concat(' ', array_to_string(list_transform(regexp_extract_all(hex(encode(r)), '..'), lambda h: (concat('0x', h)::INT)::VARCHAR), '  '), ' ')"
    for a, b, n in RULES:
        out = f"replace({out}, ' {a}  {b} ', ' {n} ')"
    return f"string_split(trim({out}), '  ')"


@query(f"""WITH r AS (SELECT doc_id, unnest({_RUNS}) AS r, generate_subscripts({_RUNS}, 1) AS i FROM documents),
k AS (SELECT r, {_canonical_sql()} AS ids FROM (SELECT DISTINCT r FROM r))
SELECT doc_id, md5(array_to_string(flatten(list(ids ORDER BY i)), ' ')) AS digest, sum(len(ids))::INT AS n FROM r JOIN k USING (r) GROUP BY doc_id""")
def encode_canonical_fixed(spark, d):
    out = encoding.encode(docs(spark, d).select("doc_id", "text"), _fixed_model(canonical=True))
    return out.select("doc_id", F.md5(said(F.col("ids")).cast("binary")).alias("digest"), F.size("ids").alias("n"))


@query("SELECT doc_id, (strlen(text) + 2)::INT AS n, 0::INT AS first_id, 1::INT AS last_id FROM documents")
def encode_special_tokens(spark, d):
    model = Model.untrained(TokenizerConfig(special_tokens=SpecialTokensConfig(bos="<bos>", eos="<eos>")))
    ids = encoding.encode(docs(spark, d).select("doc_id", "text"), model, special=True)
    return ids.select("doc_id", F.size("ids").alias("n"), F.element_at("ids", 1).alias("first_id"), F.element_at("ids", -1).alias("last_id"))


@query("SELECT doc_id, strlen(text)::INT AS n_bytes, strlen(text) <= 1000 AS accepted FROM documents")
def encode_guard(spark, d):
    return docs(spark, d).select("doc_id", F.octet_length("text").alias("n_bytes"), encoding.within_limit(F.col("text"), 1000).alias("accepted"))


@query("SELECT conv_id, turn, strlen(text)::INT AS n_ids, strlen(text) = 0 AS is_empty, (('0x' || hex(encode(text))[1:2])::INT)::VARCHAR AS first_token FROM conversations")
def encoding_meta(spark, d):
    n, empty, tokens = encoding.meta(encoding.byte_ids(F.col("text")))
    return table(spark, d, "conversations").select("conv_id", "turn", n, empty, F.get(tokens, F.lit(0)).alias("first_token"))


@query("SELECT p_partkey, md5(array_to_string(list_transform(regexp_extract_all(hex(encode(p_name)), '..'), lambda x: (concat('0x', x)::INT)::VARCHAR), ' ')) AS digest FROM part")
def encode_short_texts(spark, d):
    out = encoding.encode(table(spark, d, "part").select("p_partkey", "p_name"), Model.untrained(TokenizerConfig()), "p_name")
    return out.select("p_partkey", F.md5(said(F.col("ids")).cast("binary")).alias("digest"))


@query()
def char_level_encode(spark, d):
    model = training.fit(docs(spark, d), TokenizerConfig(vocab_size=300, encoding_mode=EncodingMode.CHAR_LEVEL))
    return encoding.encode(docs(spark, d).select("doc_id", "text"), model).select("doc_id", F.size("ids").alias("n"))


@query()
def hybrid_encode(spark, d):
    model = training.fit(docs(spark, d), TokenizerConfig(vocab_size=300, encoding_mode=EncodingMode.HYBRID))
    return encoding.encode(docs(spark, d).select("doc_id", "text"), model).select("doc_id", F.size("ids").alias("n"))


# decoding


@query("SELECT count(*)::BIGINT AS n, count(*)::BIGINT AS n_same FROM documents")
def byte_roundtrip(spark, d):
    model = _fixed_model()
    out = decoding.decode(encoding.encode(docs(spark, d).select("text"), model), model)
    return out.agg(F.count("*").alias("n"), F.count(F.when(F.col("decoded") == F.col("text"), 1)).alias("n_same"))


def _hex_table() -> F.Column:
    model = _fixed_model()
    return F.create_map(*(F.lit(x) for i, t in enumerate(model.tokens) for x in (i, t.hex())))


_ID_LISTS = ([72, 105], [228], [262, 32, 263], [999999999, 5], [195, 169, 33], [])


def _id_rows(spark) -> DataFrame:
    return spark.createDataFrame(list(enumerate(_ID_LISTS)), "k int, ids array<int>")


def _decode_sql(skip: str = "FALSE") -> str:
    lists = ", ".join(f"({k}, {v}::INT[])" for k, v in enumerate(_ID_LISTS))
    tokens = ", ".join(f"({i}, '{t.hex()}')" for i, t in enumerate(_fixed_model().tokens))
    return f"""WITH l(k, ids) AS (VALUES {lists}), v(id, h) AS (VALUES {tokens}),
y AS (SELECT k, unnest(ids) AS id, generate_subscripts(ids, 1) AS i FROM l),
b AS (SELECT k, arg_min(id, i) AS bad FROM y WHERE id >= 264 GROUP BY k),
t AS (SELECT k, string_agg(h, '' ORDER BY i) AS h FROM y JOIN v USING (id) WHERE NOT ({skip}) GROUP BY k)
SELECT l.k::INT AS k, CASE WHEN b.bad IS NOT NULL THEN concat('<invalid token ', b.bad, '>') ELSE coalesce(try(decode(unhex(coalesce(t.h, '')))), '<decoding error>') END AS decoded FROM l LEFT JOIN b USING (k) LEFT JOIN t USING (k)"""


@query(_decode_sql())
def decode_ids(spark, d):
    return decoding.decode(_id_rows(spark), _fixed_model()).select("k", "decoded")


@query(_decode_sql())
def decode_ids_catalyst(spark, d):
    return _id_rows(spark).select("k", decoding.decode_column(F.col("ids"), _hex_table(), 264).alias("decoded"))


@query(_decode_sql("id IN (32, 33)"))
def decode_skip_special(spark, d):
    return _id_rows(spark).select("k", decoding.decode_column(F.col("ids"), _hex_table(), 264, [32, 33]).alias("decoded"))


@query(r"""WITH r AS (SELECT conv_id, turn, unnest(regexp_extract_all(text, '[ -~]')) AS r, generate_subscripts(regexp_extract_all(text, '[ -~]'), 1) AS i FROM conversations)
SELECT conv_id, turn, max(i - 1)::INT AS last_start, count(*)::INT AS n FROM r GROUP BY conv_id, turn""")
def decode_offsets(spark, d):
    model = Model.untrained(TokenizerConfig())
    rows = table(spark, d, "conversations").select("conv_id", "turn", F.regexp_replace("text", "[^ -~]", "").alias("text"))
    out = decoding.decode_with_offsets(encoding.encode(rows, model), model)
    return out.where(F.size("ids") > 0).select("conv_id", "turn", F.element_at("offsets", -1).alias("last_start"), F.size("offsets").alias("n"))


# metrics


@query("SELECT source, sum(length(text))::BIGINT AS n_chars_all, sum(strlen(text))::BIGINT AS n_tokens, count(*)::BIGINT AS n_docs, round(sum(length(text)) / sum(strlen(text)), 6) AS compression FROM documents GROUP BY source")
def compression_by_source(spark, d):
    n = F.octet_length("text")
    return docs(spark, d).groupBy("source").agg(F.sum(F.length("text")).alias("n_chars_all"), F.sum(n).alias("n_tokens"), F.count("*").alias("n_docs"), F.round(F.sum(F.length("text")) / F.sum(n), 6).alias("compression"))


@query("SELECT (concat('0x', h)::INT) AS id, count(*)::BIGINT AS n FROM (SELECT unnest(regexp_extract_all(hex(encode(text)), '..')) AS h FROM documents) GROUP BY 1 ORDER BY n DESC, id LIMIT 50")
def token_frequency_topk(spark, d):
    ids = encoding.encode(docs(spark, d).select("text"), Model.untrained(TokenizerConfig()))
    return ids.select(F.explode("ids").alias("id")).groupBy("id").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "id").limit(50)


@query("SELECT role, count(*)::BIGINT AS n, sum(strlen(text) + strlen(role) + 2)::BIGINT AS n_tokens FROM conversations GROUP BY role")
def conversation_role_tokens(spark, d):
    marked = table(spark, d, "conversations").select("role", F.concat(F.lit("<"), "role", F.lit(">"), "text").alias("text"))
    return encoding.encode(marked, Model.untrained(TokenizerConfig())).groupBy("role").agg(F.count("*").alias("n"), F.sum(F.size("ids").cast("long")).alias("n_tokens"))


@query("SELECT lang, round(avg(strlen(text)), 6) AS mean_tokens, round(stddev_pop(strlen(text)), 4) AS std_tokens FROM documents GROUP BY lang")
def token_count_spread(spark, d):
    n = F.octet_length("text")
    return docs(spark, d).groupBy("lang").agg(F.round(F.avg(n), 6).alias("mean_tokens"), F.round(F.stddev_pop(n), 4).alias("std_tokens"))


@query("SELECT event_type, count(*)::BIGINT AS n, sum(strlen(props))::BIGINT AS n_tokens FROM events WHERE props IS NOT NULL GROUP BY event_type")
def event_props_tokens(spark, d):
    rows = table(spark, d, "events").select("event_type", "props").where("props is not null")
    return encoding.encode(rows, Model.untrained(TokenizerConfig()), "props").groupBy("event_type").agg(F.count("*").alias("n"), F.sum(F.size("ids").cast("long")).alias("n_tokens"))


@query("SELECT doc_id, lang, strlen(text)::INT AS n_tokens, sum(strlen(text)) OVER (PARTITION BY lang ORDER BY doc_id)::BIGINT AS running FROM documents")
def running_tokens_by_lang(spark, d):
    n = F.octet_length("text")
    return docs(spark, d).select("doc_id", "lang", n.alias("n_tokens")).withColumn("running", F.sum("n_tokens").over(Window.partitionBy("lang").orderBy("doc_id")))

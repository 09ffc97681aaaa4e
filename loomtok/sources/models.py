"""Model files: one JSON document, the vocabulary and merges pair, Parquet tables.

In files the byte b of a token is spelled as the one character U+0100 + b;
special tokens, and all tokens of the character level but single bytes, are
spelled as they are. A byte of the character level whose spelling is that of
another token has a NUL in front.
"""

from __future__ import annotations

import json
import os

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from loomtok.config import SPECIAL_ORDER, VERSION, EncodingMode, LoadError, SaveError, SpecialTokensConfig, TokenizerConfig
from loomtok.model import Model

JSON_SCHEMA = (
    "version string, vocab map<string,int>, vocab_r map<string,string>, merges array<struct<pair:array<string>,rank:int,new_token_id:int>>, "
    "special_tokens struct<pad:string,unk:string,bos:string,eos:string,mask:string,user:string,assistant:string,system:string>, "
    "config struct<vocab_size:bigint,min_frequency:bigint,encoding_mode:string>"
)


def spell(model: Model, i: int) -> str:
    token, char_level = model.tokens[i], model.config.encoding_mode is EncodingMode.CHAR_LEVEL
    if model.kinds[i] == "special" or char_level and model.kinds[i] != "byte":
        return token.decode()
    mapped = "".join(chr(256 + b) for b in token)
    return f"\0{mapped}" if char_level and mapped.encode() in model.ids else mapped


def unspell(text: str) -> bytes:
    return bytes(ord(c) - 256 for c in text) if text and all(256 <= ord(c) < 512 for c in text) else text.encode()


def _token(text: str, char_level: bool, single: set[str]) -> bytes:
    """The bytes of a token that isn't special; single: the spellings that the file has for bytes."""
    if not char_level:
        return unspell(text)
    return unspell(text.removeprefix("\0")) if text in single else text.encode()


def _single_bytes(vocab: dict[str, int]) -> set[str]:
    """Spellings of single bytes in a file of the character level: bytes are the 256 values, less those that are characters, at the end of the vocabulary."""
    out: set[str] = set()
    for b in range(256):
        mapped = chr(256 + b)
        if f"\0{mapped}" in vocab:
            out.add(f"\0{mapped}")
        elif mapped in vocab and not (b < 128 and chr(b) in vocab):
            out.add(mapped)
    return out


def to_document(model: Model) -> dict:
    vocab = {spell(model, i): i for i in range(len(model.tokens))}
    return {
        "version": VERSION,
        "vocab": vocab,
        "vocab_r": {str(i): t for t, i in vocab.items()},
        "merges": [{"pair": [spell(model, a), spell(model, b)], "rank": r, "new_token_id": n} for r, (a, b, n) in enumerate(model.merges)],
        "special_tokens": model.config.special_tokens.to_dict(),
        "config": {"vocab_size": len(model.tokens), "min_frequency": model.config.min_frequency, "encoding_mode": str(model.config.encoding_mode)},
    }


def _from_maps(vocab: dict[str, int], merges: list[tuple[str, str, int | None]], config: TokenizerConfig) -> Model:
    by_id = {i: t for t, i in vocab.items()}
    if sorted(by_id) != list(range(len(by_id))):
        raise LoadError("ids aren't dense")
    named = dict(config.special_tokens.configured())
    tokens, kinds = [], []
    made = {n for *_, n in merges if n is not None}
    char_level = config.encoding_mode is EncodingMode.CHAR_LEVEL
    single = _single_bytes(vocab) if char_level else set()
    for i in range(len(by_id)):
        special = by_id[i] in named.values()
        tokens.append(by_id[i].encode() if special else _token(by_id[i], char_level, single))
        byte = by_id[i] in single if char_level else len(tokens[-1]) == 1
        kinds.append("special" if special else "merge" if i in made else "byte" if byte else "char")
    rules = []
    for a, b, n in merges:
        if a not in vocab or b not in vocab:
            raise LoadError(f"unknown token in merges: {a if a not in vocab else b}")
        n = vocab.get(a + b) if n is None else n
        if n is None:
            raise LoadError(f"no token for the merge of {a} and {b}")
        rules.append((vocab[a], vocab[b], n))
    return Model(config, tokens, kinds, rules, {k: vocab[v] for k, v in named.items() if v in vocab})


def save_json(model: Model, folder: str) -> None:
    """tokenizer.json in the folder, which is made."""
    try:
        os.makedirs(folder, exist_ok=True)
        with open(os.path.join(folder, "tokenizer.json"), "w", encoding="utf-8") as f:
            json.dump(to_document(model), f, ensure_ascii=False, indent=2)
    except OSError as e:
        raise SaveError(str(e)) from e


def load_json(folder: str) -> Model:
    try:
        with open(os.path.join(folder, "tokenizer.json"), encoding="utf-8") as f:
            d = json.load(f)
    except (OSError, ValueError) as e:
        raise LoadError(str(e)) from e
    vocab = dict(d["vocab"])
    for i, t in d.get("vocab_r", {}).items():  # tokens that only the reverse map has
        vocab.setdefault(t, int(i))
    c = d["config"]
    specials = SpecialTokensConfig(**{k: d.get("special_tokens", {}).get(k) for k in SPECIAL_ORDER})
    config = TokenizerConfig(max(1, c["vocab_size"]), max(1, c["min_frequency"]), EncodingMode(c["encoding_mode"]), specials)
    merges = sorted(d["merges"], key=lambda m: m["rank"])
    return _from_maps(vocab, [(*m["pair"], m["new_token_id"]) for m in merges], config)


def save_pair(model: Model, folder: str) -> None:
    """vocab.json, and merges.txt by rank."""
    try:
        os.makedirs(folder, exist_ok=True)
        with open(os.path.join(folder, "vocab.json"), "w", encoding="utf-8") as f:
            json.dump({spell(model, i): i for i in range(len(model.tokens))}, f, ensure_ascii=False)
        with open(os.path.join(folder, "merges.txt"), "w", encoding="utf-8") as f:
            f.writelines(f"{spell(model, a)} {spell(model, b)}\n" for a, b, _ in model.merges)
    except OSError as e:
        raise SaveError(str(e)) from e


def load_pair(folder: str, config: TokenizerConfig | None = None) -> Model:
    """The id of a merge is that of its two spellings joined; lines that start with # are comments."""
    try:
        with open(os.path.join(folder, "vocab.json"), encoding="utf-8") as f:
            vocab = json.load(f)
        with open(os.path.join(folder, "merges.txt"), encoding="utf-8") as f:
            lines = [x.split() for x in f.read().split("\n") if x.strip() and not x.startswith("#")]
    except (OSError, ValueError) as e:
        raise LoadError(str(e)) from e
    if bad := [x for x in lines if len(x) != 2]:
        raise LoadError(f"invalid merge: {bad[0]}")
    return _from_maps(vocab, [(a, b, None) for a, b in lines], config or TokenizerConfig())


def save_parquet(model: Model, spark: SparkSession, path: str) -> None:
    """Two tables and the document's settings, anywhere Spark writes."""
    model.vocab_frame(spark).write.mode("overwrite").parquet(f"{path}/vocab")
    model.merges_frame(spark).write.mode("overwrite").parquet(f"{path}/merges")
    d = {k: v for k, v in to_document(model).items() if k not in ("vocab", "vocab_r", "merges")}
    spark.createDataFrame([(json.dumps(d),)], "settings string").write.mode("overwrite").parquet(f"{path}/settings")


def load_parquet(spark: SparkSession, path: str) -> Model:
    d = json.loads(spark.read.parquet(f"{path}/settings").first().settings)
    rows = spark.read.parquet(f"{path}/vocab").orderBy("id").collect()
    merges = spark.read.parquet(f"{path}/merges").orderBy("rank").collect()
    named = SpecialTokensConfig(**d["special_tokens"])
    config = TokenizerConfig(max(1, d["config"]["vocab_size"]), d["config"]["min_frequency"], EncodingMode(d["config"]["encoding_mode"]), named)
    tokens = [bytes(r.bytes) for r in rows]
    at = {t: i for i, (t, r) in enumerate(zip(tokens, rows, strict=True)) if r.kind == "special"}
    return Model(config, tokens, [r.kind for r in rows], [(r.l, r.r, r.new_id) for r in merges], {k: at[v.encode()] for k, v in named.configured() if v.encode() in at})


def read_documents(spark: SparkSession, path: str) -> DataFrame:
    """A JSON model as a one-row table of JSON_SCHEMA."""
    return spark.read.schema(JSON_SCHEMA).option("multiLine", True).json(path)


def document_merges(documents: DataFrame) -> DataFrame:
    """rank, l, r, new_id of a JSON model: pairs are resolved by two joins with its own vocabulary, made whole from vocab_r."""
    vocab = documents.select(F.explode("vocab").alias("token", "id"))
    more = documents.select(F.explode("vocab_r").alias("id", "token")).select("token", F.col("id").cast("int").alias("id"))
    vocab = vocab.unionByName(more.join(vocab.select("token"), "token", "left_anti"))
    m = documents.select(F.explode("merges").alias("m")).select("m.rank", F.get("m.pair", F.lit(0)).alias("a"), F.get("m.pair", F.lit(1)).alias("b"), F.col("m.new_token_id").alias("new_id"))
    left, right = (vocab.select(F.col("token").alias(c), F.col("id").alias(i)) for c, i in (("a", "l"), ("b", "r")))
    return m.join(left, "a").join(right, "b").select("rank", "l", "r", "new_id")


def pair_lines(merges: DataFrame, vocab: DataFrame) -> DataFrame:
    """rank and line of merges.txt, from merges(l, r, rank) and vocab(id, token)."""
    left, right = vocab.select(F.col("id").alias("l"), F.col("token").alias("a")), vocab.select(F.col("id").alias("r"), F.col("token").alias("b"))
    return merges.join(left, "l").join(right, "r").select("rank", F.concat_ws(" ", "a", "b").alias("line"))


def lines_to_merges(lines: DataFrame, vocab: DataFrame) -> DataFrame:
    """rank, l, r, new_id from (rank, line); the new id is that of the joined spelling."""
    halves = lines.where(~F.col("line").startswith("#")).select("rank", F.split("line", " ").alias("x"))
    halves = halves.select("rank", F.get("x", F.lit(0)).alias("a"), F.get("x", F.lit(1)).alias("b"))
    of = lambda token, i: vocab.select(F.col("token").alias(token), F.col("id").alias(i))
    return halves.withColumn("ab", F.concat("a", "b")).join(of("a", "l"), "a").join(of("b", "r"), "b").join(of("ab", "new_id"), "ab").select("rank", "l", "r", "new_id")


def read_text(spark: SparkSession, path: str, whole: bool = True) -> DataFrame:
    """doc_id, text: one document a file, or a line.

    Files are numbered by path, from 0, and lines within their file, so that ids
    don't depend on how files are split; a file has at most 2^40 lines.
    """
    rows = spark.read.text(path, wholetext=whole).select(F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("at"), F.monotonically_increasing_id().alias("part"), F.col("value").alias("text"))
    files = rows.select("file").distinct().select("file", (F.row_number().over(Window.orderBy("file")) - 1).cast("long").alias("n"))  # a row a file
    if whole:
        return rows.join(files, "file").select(F.col("n").alias("doc_id"), "text")
    line = (F.row_number().over(Window.partitionBy("file").orderBy("at", "part")) - 1).cast("long")
    return rows.withColumn("line", line).join(files, "file").select((F.shiftleft("n", 40) + F.col("line")).alias("doc_id"), "text")


def write_ids(df: DataFrame, path: str, column: str = "ids") -> None:
    df.select(F.concat_ws(" ", F.transform(column, lambda x: x.cast("string"))).alias("value")).write.text(path)


def spelled_bytes(token: Column) -> Column:
    """Bytes of a mapped spelling, as numbers."""
    return F.transform(F.split(token, ""), lambda c: F.ascii(c) - 256)

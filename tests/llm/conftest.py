import pytest
from pyspark.sql import types as T

LONG_WORD, LONG_TEXT = "x" * 200_000, " ".join(f"w{i % 997} und.so {i}" for i in range(20_000))

#: id, text: null ids, null, empty and blank texts, ties, repeated rows, very long texts.
ROWS = [
    (1, "the cat sat on the mat and the dog ran off to the big red barn by the old mill stream at dawn " * 3),
    (1, "the cat sat on the mat and the dog ran off to the big red barn by the old mill stream at dawn " * 3),
    (2, "the cat sat on the mat and the dog ran off to the big red barn by the old mill stream at dawn " * 3),
    (None, "a text of no id"),
    (None, None),
    (3, None),
    (4, ""),
    (5, " \t\n\v\f\r "),
    (6, LONG_WORD),
    (7, LONG_TEXT),
    (8, "Mail bob.07@mail1.example.com or +1 (599) 555-3756, 10.0.0.1 and 999.1.1.1, card 4539 1488 0343 6467."),
    (9, "<|endoftext|> two  blanks\n\n  and é世 🙂 <|endoftext|>"),
    (-10, "one"),
    (11, "one two"),
]
#: Names that operators use inside; they must neither clash nor matter.
EXTRA = ["score", "predicted", "fp", "h1", "row", "rank", "length", "bucket", "items", "n_words", "spans", "word", "n", "component_id", "y", "held_out"]


@pytest.fixture(scope="session")
def edge(spark):
    schema = T.StructType([T.StructField("doc_id", T.LongType()), T.StructField("text", T.StringType()), T.StructField("lang", T.StringType()), T.StructField("source", T.StringType()), *(T.StructField(c, T.StringType()) for c in EXTRA)])
    return spark.createDataFrame([(i, t, "en", None, *["z"] * len(EXTRA)) for i, t in ROWS], schema)


@pytest.fixture(scope="session")
def empty(edge):
    return edge.where("false")


@pytest.fixture(scope="session")
def labels(spark, data):
    odd = spark.createDataFrame([(None, 1, 0), (8, None, None), (1, 1, 0), (1, 1, 0)], "doc_id long, quality int, toxic int")
    return spark.read.parquet(f"{data}/labels.parquet").unionByName(odd)


@pytest.fixture(scope="session")
def docs(spark, data):
    return spark.read.parquet(f"{data}/documents.parquet")

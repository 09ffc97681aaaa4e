"""Text pre-processing as column expressions."""

from __future__ import annotations

import unicodedata

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

FORMS = ("NFC", "NFD", "NFKC", "NFKD", "None")
#: Unicode white space; unlike \s alone it covers no-break and ideographic blanks, and not U+001C to U+001F.
WHITE = r"(?U)\s+"


def is_enabled(form: str) -> bool:
    return form != "None"


def normalize_column(c: Column, form: str = "NFC") -> Column:
    """Any form of every row in an Arrow UDF; normalize() spares ASCII rows."""
    if not is_enabled(form):
        return c

    @F.pandas_udf("string")
    def run(s: pd.Series) -> pd.Series:
        return s.map(lambda x: x if x is None or x.isascii() else unicodedata.normalize(form, x))

    return run(c)


def normalize(df: DataFrame, column: str = "text", form: str = "NFC", out: str | None = None) -> DataFrame:
    """Adds or replaces a column by its normal form. Only rows that are not ASCII go through Python."""
    out = out or column
    if not is_enabled(form):
        return df.withColumn(out, F.col(column))
    plain = F.col(column).isNull() | (F.octet_length(column) == F.length(column))
    return df.where(plain).withColumn(out, F.col(column)).unionByName(df.where(~plain).withColumn(out, normalize_column(F.col(column), form)))


def split_none(c: Column) -> Column:
    return F.array(c)


def split_whitespace(c: Column) -> Column:
    return F.filter(F.split(c, WHITE), lambda w: w != "")


def split_characters(c: Column) -> Column:
    return F.filter(F.split(c, ""), lambda x: x != "")


def split_custom(c: Column, pattern: str) -> Column:
    """Pieces between matches, empty ones too; each call has its own pattern."""
    return F.split(c, pattern)


def graphemes(c: Column) -> Column:
    return F.regexp_extract_all(c, F.lit(r"\X"), F.lit(0))


def byte_values(c: Column) -> Column:
    """UTF-8 bytes as numbers."""
    return F.transform(F.regexp_extract_all(F.hex(F.encode(c, "UTF-8")), F.lit(".."), F.lit(0)), lambda x: F.conv(x, 16, 10).cast("int"))


def byte_fallback(c: Column, vocab: Column, unk: Column | int | None = None, enabled: bool = True) -> Column:
    """Ids of <0xhh> for each byte, else unk, else 0; when off one unk, or 0. vocab is a map of token to id."""
    other = F.lit(None).cast("int") if unk is None else F.lit(unk)
    if not enabled:
        return F.array(F.coalesce(other, F.lit(0)))
    return F.transform(byte_values(c), lambda b: F.coalesce(F.try_element_at(vocab, F.format_string("<0x%02x>", b)), other, F.lit(0)))


def parse_ids(c: Column, separator: str = ",") -> Column:
    return F.transform(F.split(c, separator), lambda x: F.trim(x).cast("int"))


def join_ids(c: Column, separator: str = " ") -> Column:
    return F.concat_ws(separator, F.transform(c, lambda x: x.cast("string")))

"""Decoding: ids to text."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from loomtok.config import UnknownTokenIdError
from loomtok.model import Model

ERROR = "<decoding error>"


def invalid(i: int) -> str:
    return f"<invalid token {i}>"


def decode_ids(model: Model, ids: list[int], skip_special: bool = False) -> str:
    """Text of ids; the first id out of range, or bytes that aren't UTF-8, give a message in its place."""
    n = len(model.tokens)
    for i in ids:
        if not 0 <= i < n:
            return invalid(i)
    if skip_special and model.special_ids:
        ids = [i for i in ids if i not in model.special_ids]
    try:
        return b"".join(map(model.tokens.__getitem__, ids)).decode()
    except UnicodeDecodeError:
        return ERROR


class Decoder:
    """Texts of a whole Arrow list column: bytes are gathered at once, rows that need a message one by one."""

    def __init__(self, model: Model, skip_special: bool) -> None:
        self.model, self.skip = model, skip_special
        self.length = np.array([*map(len, model.tokens)], np.int64)
        self.start = np.concatenate([[0], self.length.cumsum()])[:-1]
        self.blob = np.frombuffer(b"".join(model.tokens), np.uint8)
        self.drop = np.isin(np.arange(len(model.tokens)), list(model.special_ids))

    def __call__(self, column: pa.ListArray) -> pa.Array:
        offsets = column.offsets.to_numpy().astype(np.int64)
        ids = column.values.to_numpy(zero_copy_only=False)[offsets[0] : offsets[-1]]
        offsets = offsets - offsets[0]
        bad = np.any((ids < 0) | (ids >= len(self.length))) if len(ids) else False
        if bad or column.null_count:
            return pa.array([None if x is None else decode_ids(self.model, x, self.skip) for x in column.to_pylist()], pa.string())
        length = np.where(self.drop[ids], 0, self.length[ids]) if self.skip else self.length[ids]
        ends = np.concatenate([[0], length.cumsum()])
        data = self.blob[np.repeat(self.start[ids] - ends[:-1], length) + np.arange(ends[-1])] if len(ids) else np.zeros(0, np.uint8)
        at = ends[offsets]
        raw = data.tobytes()
        try:
            raw.decode()
            whole = not np.any((data[at[:-1][at[:-1] < len(data)]] & 0xC0) == 0x80)
        except UnicodeDecodeError:
            whole = False
        if not whole or at[-1] >= 1 << 31:
            return pa.array([decode_ids(self.model, x, self.skip) for x in column.to_pylist()], pa.string())
        return pa.StringArray.from_buffers(len(column), pa.py_buffer(at.astype(np.int32)), pa.py_buffer(raw))


def decode(df: DataFrame, model: Model, column: str = "ids", out: str = "decoded", skip_special: bool = False) -> DataFrame:
    """df and the text of an id column; null ids give null. No shuffle; works on streams."""
    shared = df.sparkSession.sparkContext.broadcast(model)  # a vocabulary
    at = df.columns.index(column)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        decoder = Decoder(shared.value, skip_special)
        for batch in batches:
            yield pa.RecordBatch.from_arrays([*batch.columns, decoder(batch.column(at))], names=[*batch.schema.names, out])

    return df.mapInArrow(run, T.StructType([*df.schema.fields, T.StructField(out, T.StringType())]))


def hex_text(hexes: Column) -> Column:
    """UTF-8 text of an array of hex strings; null where the bytes aren't UTF-8."""
    return F.try_validate_utf8(F.unhex(F.array_join(hexes, "")).cast("string"))


def decode_column(ids: Column, table: Column, size: int, special: list[int] | None = None) -> Column:
    """The same as decode() in Catalyst, with a map of id to hex; special ids are left out."""
    bad = F.filter(ids, lambda i: (i < 0) | (i >= size))
    kept = ids if not special else F.filter(ids, lambda i: ~i.isin(special))
    text = hex_text(F.transform(kept, lambda i: F.coalesce(F.try_element_at(table, i), F.lit(""))))
    return F.when(F.size(bad) > 0, F.concat(F.lit("<invalid token "), F.get(bad, F.lit(0)), F.lit(">"))).otherwise(F.coalesce(text, F.lit(ERROR)))


def offsets(model: Model, ids: list[int]) -> list[int]:
    """The character where each token starts: bytes before it that begin a character, or the one it continues."""
    out, seen = [], 0
    total = sum((b & 0xC0) != 0x80 for i in ids for b in model.tokens[i])
    for i in ids:
        token = model.tokens[i]
        inside = bool(token) and (token[0] & 0xC0) == 0x80
        out.append(max(0, min(seen - inside, total - 1)))
        seen += sum((b & 0xC0) != 0x80 for b in token)
    return out


def decode_with_offsets(df: DataFrame, model: Model, column: str = "ids") -> DataFrame:
    """df, decoded and offsets. Ids out of range have no offsets."""
    out = decode(df, model, column)
    shared = df.sparkSession.sparkContext.broadcast(model)
    at = df.columns.index(column)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = shared.value
        n = len(model.tokens)
        for batch in batches:
            rows = [None if x is None or any(not 0 <= i < n for i in x) else offsets(model, x) for x in batch.column(at).to_pylist()]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(rows, pa.list_(pa.int32()))], names=[*batch.schema.names, "offsets"])

    return out.mapInArrow(run, T.StructType([*out.schema.fields, T.StructField("offsets", T.ArrayType(T.IntegerType()))]))


def offsets_column(lengths: Column) -> Column:
    """Starts of whole-character tokens from their lengths."""
    return F.transform(lengths, lambda x, i: F.aggregate(F.slice(lengths, 1, i), F.lit(0), lambda a, y: a + y))


def single_token_bytes(model: Model, i: int) -> bytes:
    if not 0 <= i < len(model.tokens):
        raise UnknownTokenIdError(i)
    return model.tokens[i]

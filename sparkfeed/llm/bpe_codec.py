"""Byte-level BPE encoding and decoding by prefix dynamic programming."""

from __future__ import annotations

import hashlib
from array import array
from functools import cache

import numpy as np
import public_tokenizers
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ._shared import bounded, col, field_type, hold_only, slices, strings
from .byte_pairs import PrefixEncoder, Splitter, read_ranks, unknown


@cache
def _codec(path: str):
    return PrefixEncoder(read_ranks(path)), Splitter(public_tokenizers.PATTERN), {}


def packed_ids(texts: list[str], encoder: PrefixEncoder, split: Splitter, known: dict[str, bytes]) -> list[bytes]:
    """The ids of each text as 32-bit integers; pieces not ``known`` are encoded in sorted order, by
    exact appends."""
    parts = [split(t) for t in texts]
    new = unknown(known, parts)
    known.update(zip(new, (array("i", ids).tobytes() for ids in encoder.ids_of_sorted(new)), strict=True))
    look = known.__getitem__
    return [b"".join(map(look, pieces)) for pieces in parts]


def encode(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", ranks: str | None = None) -> DataFrame:
    """``(id, ids array<int>)``: the BPE ids of each whole text, piece by piece.

    ``ranks`` is a rank file that every executor can read. Null and empty texts give an empty
    array; null or repeated ids give a row each; other columns are ignored, so their names can't clash;
    an empty table gives no rows. Whole texts are encoded, however long. No shuffle.
    """
    path = ranks or public_tokenizers.path("byte_bpe_50k.tiktoken")
    schema = T.StructType([T.StructField("id", field_type(docs, id_col)), T.StructField("ids", T.ArrayType(T.IntegerType()))])

    def run(batches):
        hold_only("codec", _codec.cache_clear)
        codec = _codec(path)
        for batch in slices(batches):
            packed = packed_ids(strings(batch.column(1)), *codec)
            ends = np.cumsum([0, *(len(x) // 4 for x in packed)], dtype=np.int32)
            ids = pa.ListArray.from_arrays(pa.array(ends), pa.array(np.frombuffer(b"".join(packed), np.int32)))
            yield pa.RecordBatch.from_arrays([batch.column(0), ids], names=["id", "ids"])

    return bounded(docs.select(col(id_col).alias("id"), col(text_col).alias("text"))).mapInArrow(run, schema).select(F.col("id").alias(id_col), "ids")


def decode(encoded: DataFrame, id_col: str = "doc_id", ids_col: str = "ids", ranks: str | None = None) -> DataFrame:
    """``(id, ids, data binary)``: the bytes that the ids stand for.

    Null and empty ``ids`` give empty bytes; null or repeated row ids give a row each; other columns
    are ignored, so their names can't clash; an empty table gives no rows. No shuffle.
    """
    path = ranks or public_tokenizers.path("byte_bpe_50k.tiktoken")
    schema = T.StructType(
        [T.StructField("id", field_type(encoded, id_col)), T.StructField("ids", T.ArrayType(T.IntegerType())), T.StructField("data", T.BinaryType())]
    )

    def run(batches):
        hold_only("codec", _codec.cache_clear)
        encoder, _, _ = _codec(path)
        for batch in slices(batches):
            lists = batch.column(1).fill_null([]) if batch.column(1).null_count else batch.column(1)
            ends, ids = lists.offsets.to_numpy(), lists.values.to_numpy()
            data = [encoder.decode(ids[a:b].tolist()) for a, b in zip(ends[:-1], ends[1:], strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(data, pa.binary())], names=["id", "ids", "data"])

    return bounded(encoded.select(col(id_col).alias("id"), col(ids_col).alias("ids"))).mapInArrow(run, schema).select(F.col("id").alias(id_col), "ids", "data")


def ids_digest(ids: Column) -> Column:
    """Lowercase hex SHA-256 of the decimal ids joined by one space."""
    return F.sha2(F.array_join(ids.cast("array<string>"), " "), 256)


def file_digest(path: str) -> str:
    """SHA-256 of a vocabulary file, to tell which vocabulary a table of ids belongs to."""
    with open(path, "rb") as f:
        return hashlib.file_digest(f, "sha256").hexdigest()

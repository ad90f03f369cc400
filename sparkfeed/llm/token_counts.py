"""Token counts by heap-and-linked-list byte-pair merging."""

from __future__ import annotations

from functools import cache

import public_tokenizers
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ._shared import bounded, col, field_type, hold_only, slices, strings
from .byte_pairs import MergeCounter, Remembered, Splitter, read_merges, split_specials


@cache
def _counter(path: str):
    """One worker's counter of a whole text's tokens; pieces met before are looked up."""
    merges, specials = read_merges(path)
    split, pieces = Splitter(public_tokenizers.PATTERN), Remembered(MergeCounter(merges))
    look = pieces.__getitem__

    def count(text: str) -> int:
        return sum(1 if special else sum(map(look, split(part))) for special, part in split_specials(text, specials))

    return count


def count_tokens(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", tokenizer: str | None = None) -> DataFrame:
    """``(id, n_bytes, n_tokens)`` for each row of ``docs``.

    ``tokenizer`` is a byte-level BPE file in JSON that every executor can read. A special string
    inside a text counts as one token, as is the library's default. Null and empty texts have 0
    bytes and 0 tokens; null or repeated ids give a row each; other columns are ignored, so their
    names can't clash. Whole texts are counted, however long. No shuffle.
    """
    path = tokenizer or public_tokenizers.path("byte_bpe_50k.json")
    schema = T.StructType(
        [T.StructField("id", field_type(docs, id_col)), T.StructField("n_bytes", T.LongType()), T.StructField("n_tokens", T.LongType())]
    )

    def run(batches):
        hold_only("counts", _counter.cache_clear)
        count = _counter(path)
        for batch in slices(batches):
            texts = strings(batch.column(1))
            sizes = [len(t.encode("utf-8")) for t in texts]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(sizes, pa.int64()), pa.array([count(t) for t in texts], pa.int64())],
                names=["id", "n_bytes", "n_tokens"],
            )

    found = bounded(docs.select(col(id_col).alias("id"), col(text_col).alias("text"))).mapInArrow(run, schema)
    return found.select(F.col("id").alias(id_col), "n_bytes", "n_tokens")

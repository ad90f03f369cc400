"""Best-fit packing of documents into sequences, planned on the histogram of lengths.

The plan is made over counts: a table of at most as many rows as there are lengths, however many
documents there are. Documents then take its slots by joining on their rank within their length.
"""

from __future__ import annotations

import re
import zlib
from functools import cache

import numpy as np
import public_tokenizers
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ._shared import bounded, col, field_type, hold_only, slices, strings, written
from .byte_pairs import is_plain, unknown

CAPACITY = 2048
_PLAIN_PIECES = re.compile(r"'s|'t|'re|'ve|'m|'ll|'d|[a-zß-öø-ÿ]+|[0-9]|[^\sa-z0-9ß-öø-ÿ]+")
#: Pieces that a worker remembers.
CACHE_PIECES = 600_000
#: Pieces that go to the tokenizer in one call.
_TOGETHER = 256


class _Encoder:
    """Whole texts to the bytes of their little-endian 32-bit ids, as the library gives them.

    The library's own split into pieces costs most of its time. Texts of ASCII and Latin-1 letters
    are split here by the same pattern, and only pieces not met before go to the library, many in a
    call: each piece ends in the one token of it that closes a word. Other texts, and those that may
    hold a special string, go to the library as they are.
    """

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.closing = frozenset(i for t, i in self.tokenizer.get_vocab(with_added_tokens=False).items() if t.endswith("</w>"))
        self.pieces: dict[str, bytes] = {}

    def _whole(self, text: str) -> bytes:
        return np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, "<u4").tobytes()

    def _learn(self, pieces: list[str]) -> None:
        for at in range(0, len(pieces), _TOGETHER):
            some = pieces[at : at + _TOGETHER]
            ids = self.tokenizer.encode(" ".join(some), add_special_tokens=False).ids
            ends = [k + 1 for k, i in enumerate(ids) if i in self.closing]
            if len(ends) != len(some) or ends[-1] != len(ids):
                self.pieces.update((p, self._whole(p)) for p in some)
                continue
            data, start = np.array(ids, "<u4").tobytes(), 0
            for p, end in zip(some, ends, strict=True):
                self.pieces[p] = data[4 * start : 4 * end]
                start = end

    def __call__(self, texts: list[str]) -> list[bytes]:
        split = [_PLAIN_PIECES.findall(t.lower()) if "<|" not in t and is_plain(t) else None for t in texts]
        self._learn(unknown(self.pieces, [p for p in split if p is not None], CACHE_PIECES))
        look = self.pieces.__getitem__
        return [self._whole(t) if p is None else b"".join(map(look, p)) for t, p in zip(texts, split, strict=True)]


@cache
def _encoder(path: str) -> _Encoder:
    """A worker's encoder, kept between tasks."""
    return _Encoder(path)


def tokenised_pieces(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", tokenizer: str | None = None, capacity: int = CAPACITY, end_id: int = 0) -> DataFrame:
    """``(id, piece, start, length, ids_crc32, part, turn)``, written to the shared folder.

    A document is its ids and ``end_id``; only longer ones than ``capacity`` are cut, into pieces of
    that length, the last maybe shorter. ``turn`` counts the pieces of one length in partition
    ``part`` of this very table, so that ranks need no sort.
    """
    path = tokenizer or public_tokenizers.path("word_bpe_49k.json")
    schema = T.StructType(
        [T.StructField("id", field_type(docs, id_col)), T.StructField("piece", T.IntegerType()), *(T.StructField(n, T.LongType()) for n in ("start", "length", "ids_crc32")), T.StructField("part", T.IntegerType()), T.StructField("turn", T.LongType())]
    )
    close = end_id.to_bytes(4, "little")

    def run(batches):
        from pyspark import TaskContext

        hold_only("pack", _encoder.cache_clear)
        encode, part, turns = _encoder(path), TaskContext.get().partitionId(), np.zeros(capacity + 1, np.int64).tolist()
        for batch in slices(batches):
            rows: list[tuple] = []
            which = []
            for k, data in enumerate(encode(strings(batch.column(1)))):
                data = memoryview(data + close)
                n = len(data) // 4
                for piece, start in enumerate(range(0, n, capacity)):
                    some = data[4 * start : 4 * (start + capacity)]
                    length = len(some) // 4
                    rows.append((piece, start, length, zlib.crc32(some), part, turns[length]))
                    turns[length] += 1
                    which.append(k)
            columns = list(zip(*rows, strict=True))
            types = (pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.int64())
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(which, pa.int64())), *(pa.array(c, t) for c, t in zip(columns, types, strict=True))], names=schema.names)

    return written(bounded(docs.select(col(id_col).alias("id"), col(text_col).alias("text"))).mapInArrow(run, schema), "pieces")


def plan(histogram: dict[int, int], capacity: int = CAPACITY) -> list[tuple[int, int, int, int, int, int]]:
    """Best-fit over counts: rows ``(length, first_rank, end_rank, first_sequence, offset, each)``.

    Lengths go from the longest down, and each piece into a sequence with the least room that holds
    it. A sequence that took a piece has less room than those it was like, so it takes the next ones
    too while it can: ``each`` pieces of a row's range go into one sequence, side by side from
    ``offset`` on. Sequences with equal room are kept as ranges of numbers, so a step handles a whole
    range at once; pieces for which no room is left open new sequences. Work and rows grow with the
    number of lengths and ranges, not of documents.
    """
    room: dict[int, list[tuple[int, int]]] = {}  # room left -> ranges [first, end) of sequences
    rows, opened = [], 0
    for length in sorted(histogram, reverse=True):
        rank, left = 0, histogram[length]
        while left:
            best = min((r for r in room if r >= length), default=None)
            if best is None:
                best = capacity
                first, end = opened, opened + -(-left // (capacity // length))
                opened = end
            else:
                first, end = room[best].pop()
                if not room[best]:
                    del room[best]
            each = best // length
            full = min(end - first, left // each)
            # whole sequences, and one that the last pieces don't fill
            for sequences, pieces in ((full, each), (1, left - full * each)) if full < end - first and left > full * each else ((full, each),):
                if sequences and pieces:
                    rows.append((length, rank, rank + sequences * pieces, first, capacity - best, pieces))
                    rank, left = rank + sequences * pieces, left - sequences * pieces
                    if best > pieces * length:
                        room.setdefault(best - pieces * length, []).append((first, first + sequences))
                    first += sequences
            if first < end:
                room.setdefault(best, []).append((first, end))
    return rows


def pack(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", tokenizer: str | None = None, capacity: int = CAPACITY, end_id: int = 0) -> DataFrame:
    """``(id, piece, start, length, ids_crc32, sequence_id, offset)``: where each piece goes.

    Null and empty texts are the end id alone. Repeated rows and ids, and null ids, each get pieces
    of their own; other columns are ignored. At most ``capacity`` counts come to the driver, and the
    plan that goes out from there has a few rows a length, so both have a fixed bound. An empty
    table gives no rows.
    """
    spark = docs.sparkSession
    pieces = tokenised_pieces(docs, id_col, text_col, tokenizer, capacity, end_id)
    counts = written(pieces.groupBy("length", "part").agg(F.count("*").alias("n")), "piece-counts")
    histogram = {r["length"]: r["n"] for r in counts.groupBy("length").agg(F.sum("n").alias("n")).collect()}
    # pieces of one length in earlier partitions come first
    before = W.partitionBy("length").orderBy("part").rowsBetween(W.unboundedPreceding, -1)
    starts = counts.select(F.col("length").alias("of_length"), F.col("part").alias("of_part"), F.coalesce(F.sum("n").over(before), F.lit(0)).alias("ahead"))
    slots = spark.createDataFrame(plan(histogram, capacity), "slot_length long, first_rank long, end_rank long, first_sequence long, first_offset long, each long")
    ranked = pieces.join(starts, (F.col("length") == F.col("of_length")) & (F.col("part") == F.col("of_part"))).withColumn("rank", F.col("ahead") + F.col("turn"))
    placed = ranked.join(F.broadcast(slots), (F.col("length") == F.col("slot_length")) & (F.col("rank") >= F.col("first_rank")) & (F.col("rank") < F.col("end_rank")))
    at = F.col("rank") - F.col("first_rank")
    sequence, offset = F.col("first_sequence") + F.floor(at / F.col("each")), F.col("first_offset") + at % F.col("each") * F.col("length")
    return placed.select(F.col("id").alias(id_col), "piece", "start", "length", "ids_crc32", sequence.alias("sequence_id"), offset.alias("offset"))

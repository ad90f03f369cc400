"""Fill-in-middle transformation: texts cut into prefix, middle and suffix, and put together anew.

A text's units are the runs of letters A-Z and every other character by itself. Where a text is cut,
and into which form, follows from a hash of its id, so that a run repeats itself under any
partitioning. The work on a batch is Arrow kernels alone: split into lists, flatten with the index of
the parent, ordinals, filter by role, lists again, and joined pieces.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ._shared import bounded, col, field_type, let

PREFIX, SUFFIX, MIDDLE = "<P>", "<S>", "<M>"
PLAIN, PSM, SPM = "plain", "psm", "spm"
#: A unit, over the bytes of UTF-8: letters, another ASCII character, or a longer character.
_UNIT = r"[A-Za-z]+|[\x00-@\[-`{-\x7F]|[\x80-\xFF][\x80-\xBF]*"
_CUT = b"\xff"  # stands in no UTF-8
#: Bytes of texts that are lists of units at a time; a longer text is alone.
SLICE_BYTES = 1 << 20


def _pieces(text: pa.Array) -> Iterator[tuple[int, int]]:
    """Ranges of rows with about ``SLICE_BYTES`` bytes each."""
    ends = np.cumsum(pc.fill_null(pc.binary_length(text), 0).to_numpy(zero_copy_only=False), dtype=np.int64)
    at, rows = 0, len(text)
    while at < rows:
        past = ends[at - 1] if at else 0
        to = max(at + 1, int(np.searchsorted(ends, past + SLICE_BYTES, side="right")))
        yield at, min(to, rows)
        at = to


def _take(values: np.ndarray, parents: pa.Array) -> pa.Array:
    return pc.take(pa.array(values, pa.int64()), parents)


def _cut(text: pa.Array, h: list[np.ndarray], fim_percent: int, spm_percent: int) -> list[pa.Array]:
    """``(n, form, prefix_chars, middle_chars, output)`` of each text, by its four hash values."""
    raw = text.cast(pa.large_string()).cast(pa.large_binary())
    raw = pc.fill_null(raw, pa.scalar(b"", pa.large_binary()))
    lists = pc.split_pattern(pc.replace_substring_regex(raw, pattern=_UNIT, replacement=b"\\0" + _CUT), pattern=_CUT)
    n = pc.subtract(pc.list_value_length(lists), 1).to_numpy().astype(np.int64)  # a last, empty part ends each list
    one, two = h[0] % (n + 1), h[1] % (n + 1)
    low, high = np.minimum(one, two), np.maximum(one, two)
    flat, parents = pc.list_flatten(lists), pc.list_parent_indices(lists)
    first = np.concatenate([[0], np.cumsum(n + 1)[:-1]]) if len(n) else n
    ordinal = pc.subtract(pa.array(np.arange(len(flat), dtype=np.int64)), _take(first, parents))
    starts, ends = pc.less(ordinal, _take(low, parents)), pc.less(ordinal, _take(high, parents))
    rest = pc.and_(pc.invert(ends), pc.less(ordinal, _take(n, parents)))

    def joined(role: pa.Array, count: np.ndarray) -> pa.Array:
        offsets = pa.array(np.concatenate([[0], np.cumsum(count)]), pa.int32())
        return pc.binary_join(pa.ListArray.from_arrays(offsets, flat.filter(role)), pa.scalar(b"", pa.large_binary()))

    prefix, middle, suffix = joined(starts, low), joined(pc.and_(ends, pc.invert(starts)), high - low), joined(rest, n - high)
    mark = {m: pa.scalar(m.encode(), pa.large_binary()) for m in (PREFIX, SUFFIX, MIDDLE)}
    glue = lambda *parts: pc.binary_join_element_wise(*parts, pa.scalar(b"", pa.large_binary()))
    marked = pc.or_(pc.or_(*(pc.match_substring(raw, pattern=m.encode()) for m in (PREFIX, SUFFIX))), pc.match_substring(raw, pattern=MIDDLE.encode()))
    plain = pc.or_(marked, pa.array((n == 0) | (h[2] % 100 >= fim_percent)))
    spm = pa.array(h[3] % 100 < spm_percent)
    form = pc.if_else(plain, PLAIN, pc.if_else(spm, SPM, PSM))
    output = pc.if_else(
        plain, raw,
        pc.if_else(spm, glue(mark[SUFFIX], suffix, mark[PREFIX], prefix, mark[MIDDLE], middle), glue(mark[PREFIX], prefix, mark[SUFFIX], suffix, mark[MIDDLE], middle)),
    )
    chars = lambda part: pc.if_else(plain, pa.scalar(None, pa.int64()), pc.utf8_length(part.cast(pa.large_string(), safe=False)).cast(pa.int64()))
    return [pa.array(n), form.cast(pa.string()), chars(prefix), chars(middle), output.cast(pa.large_string(), safe=False).cast(pa.string())]


def fill_in_middle(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", seed: str = "1", fim_percent: int = 90, spm_percent: int = 20) -> DataFrame:
    """``(id, n, form, prefix_chars, middle_chars, output)`` for each row of ``docs``; no shuffle.

    ``n`` counts the text's units. The hex SHA-256 of ``seed``, a colon and the id gives four numbers:
    two cuts between units, whether the text is rearranged (``fim_percent`` of texts) and whether the
    suffix comes first (``spm_percent`` of those). Empty texts, and texts that hold a marker, stay
    plain, with null counts of characters. Null text counts as empty, a null id as an empty one. A
    repeated id cuts each of its texts by the same numbers. Other columns are ignored, so their names
    can't clash; an empty table gives no rows. Whole texts are worked on, however long.
    """
    digest = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(col(id_col).cast("string"), F.lit(""))), 256)
    numbers = let(digest, lambda d: F.array(*(F.conv(F.substring(d, 1 + 8 * k, 8), 16, 10).cast("bigint") for k in range(4))))
    fields = [("n", T.LongType()), ("form", T.StringType()), ("prefix_chars", T.LongType()), ("middle_chars", T.LongType()), ("output", T.StringType())]
    schema = T.StructType([T.StructField("id", field_type(docs, id_col)), *(T.StructField(name, kind) for name, kind in fields)])

    def run(batches):
        for batch in batches:
            for at, to in _pieces(batch.column(1)):
                part = batch.slice(at, to - at)
                h = part.column(2).flatten().to_numpy(zero_copy_only=False).reshape(-1, 4).T
                yield pa.RecordBatch.from_arrays([part.column(0), *_cut(part.column(1), list(h), fim_percent, spm_percent)], names=schema.names)

    made = bounded(docs.select(col(id_col).alias("id"), col(text_col).alias("text"), numbers.alias("h"))).mapInArrow(run, schema)
    return made.withColumnRenamed("id", id_col)


def restored(output: Column, form: Column) -> Column:
    """The text that ``fill_in_middle`` rearranged, as a native expression.

    No piece holds a marker, and no marker can begin within another, so the three markers cut the
    output into its pieces. Null stays null.
    """
    parts = F.split(output, "<[PSM]>")
    return F.when(form == PLAIN, output).otherwise(
        let(parts, lambda p: F.when(form == PSM, F.concat(p[1], p[3], p[2])).otherwise(F.concat(p[2], p[3], p[1])))
    )

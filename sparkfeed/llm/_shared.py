"""What the corpus operators share: scratch tables, column names, Arrow batches."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.scratch import Scratch, scratch_path, written

__all__ = ["Scratch", "scratch_path", "written"]

#: Rows that a Python loop over a batch holds as Python objects at a time.
SLICE_ROWS = 256

#: Rows of an Arrow batch at most: Spark's default of 10,000 whole texts is too much for small executors.
BATCH_ROWS = 1000

#: Rows of one key beyond which a join deals them over tasks, if they are a thousandth of all rows too.
HOT_ROWS = 200


def fresh(df: DataFrame, *bases: str) -> list[str]:
    """Names, one for each of ``bases``, that clash with no column of ``df``."""
    taken = {c.lower() for c in df.columns}
    names = []
    for base in bases:
        name = base
        while name.lower() in taken:
            name += "_"
        taken.add(name.lower())
        names.append(name)
    return names


def col(name: str) -> Column:
    """A column by its exact name, dots and spaces included."""
    return F.col("`" + name.replace("`", "``") + "`")


def let(value: Column, body) -> Column:
    """``body(value)`` with ``value`` computed once a row, also where lambdas use it again and again."""
    return F.transform(F.array(value), body)[0]


def field_type(df: DataFrame, name: str):
    return df.schema[name].dataType


def slices(batches: Iterator[pa.RecordBatch], rows: int = SLICE_ROWS) -> Iterator[pa.RecordBatch]:
    """The batches in short pieces, so that few rows at a time become Python objects."""
    for batch in batches:
        for at in range(0, batch.num_rows, rows):
            yield batch.slice(at, rows)


def bounded(df: DataFrame) -> DataFrame:
    """``df``, in a session whose Arrow batches have at most ``BATCH_ROWS`` rows."""
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    now = int(df.sparkSession.conf.get(name))
    if now <= 0 or now > BATCH_ROWS:
        df.sparkSession.conf.set(name, str(BATCH_ROWS))
    return df


_held: dict[str, Callable[[], None]] = {}


def hold_only(name: str, clear: Callable[[], None]) -> None:
    """Says that a Python worker now works for one operator: what it remembers for others goes."""
    for other, forget in _held.items():
        if other != name:
            forget()
    _held[name] = clear


def utf8(column: pa.Array) -> list[bytes]:
    """The UTF-8 bytes of each string; null counts as empty."""
    return [x or b"" for x in column.cast(pa.binary()).to_pylist()]


def strings(column: pa.Array) -> list[str]:
    """Each string; null counts as empty."""
    return [x or "" for x in column.to_pylist()]


#: Bits of a membership filter, least and most: 16 a key between them, so 32 MB at most.
FILTER_BITS = 1 << 20, 1 << 28
_BUCKET_BITS = 32768  # of Spark's bitmap functions


class KeyFilter:
    """A bit for each hashed key, as rows ``(bucket, bits)`` of 4 kB, 8,192 of them at most.

    It grows with the number of keys up to a fixed size, so it may always be broadcast. It lets
    rows that surely have no partner stay where they are; those it lets through are still to be
    joined. Beyond 16 million keys it gets fuller and lets more rows through.
    """

    def __init__(self, keys: DataFrame, key: Column, save: Callable[[DataFrame, str], DataFrame] = written, name: str = "filter"):
        wanted, (least, most) = 16 * keys.count(), FILTER_BITS
        self.size = min(most, max(least, 1 << max(0, wanted - 1).bit_length()))
        place = self.place(key)
        marked = keys.select(F.bitmap_bucket_number(place).alias("bucket"), F.bitmap_bit_position(place).alias("bit"))
        self.bits = save(marked.groupBy("bucket").agg(F.bitmap_construct_agg("bit").alias("bits")), name)

    def place(self, key: Column) -> Column:
        return F.pmod(F.xxhash64(key), F.lit(self.size)) + 1

    def maybe(self, df: DataFrame, key: Column, flag: str) -> DataFrame:
        """``df`` with a boolean ``flag``: false where ``key`` is surely none of the filter's keys."""
        bucket, position, there = fresh(df, "sf_bucket", "sf_position", "sf_bits")
        place = self.place(key)
        placed = df.withColumns({bucket: F.bitmap_bucket_number(place), position: F.bitmap_bit_position(place).cast("int")})
        joined = placed.join(F.broadcast(self.bits.select(F.col("bucket").alias(bucket), F.col("bits").alias(there))), bucket, "left")
        byte = F.conv(F.hex(F.substring(col(there), (F.floor(col(position) / 8) + 1).cast("int"), F.lit(1))), 16, 10).cast("int")
        bit = F.getbit(byte, F.pmod(col(position), F.lit(8)))
        return joined.select(*map(col, df.columns), F.coalesce(bit == 1, F.lit(False)).alias(flag))


def spread_join(left: DataFrame, right: DataFrame, key: str, by: Column, how: str = "inner", like: DataFrame | None = None) -> DataFrame:
    """``left`` joined with ``right``, in which ``key`` is unique, with hot keys dealt over tasks.

    A key with more than a thousandth of the rows of ``left`` (``HOT_ROWS`` at least) is hot: its rows
    are dealt by a hash of ``by`` into slices of about that many, and its one row of ``right`` is
    copied to each. There are 1,000 hot keys at most, whatever the size of ``left``, so they may come
    to the driver and be broadcast; without any it is a plain join. Keys are counted in ``like``, a
    written table with the keys of ``left``, or ``left`` itself.
    """
    like = left if like is None else like
    rows = like.count()
    if rows <= 10 * HOT_ROWS:  # no key can have more than a task easily holds
        return left.join(right, key, how)
    most = max(HOT_ROWS, rows // 1000)
    hot_key, n, at, at_right, key_right = fresh(left.crossJoin(right.drop(key)), "sf_hot", "sf_n", "sf_slice", "sf_slice_right", "sf_key_right")
    counts = like.groupBy(col(key).alias(hot_key)).agg(F.count("*").alias(n)).where((col(n) > most) & col(hot_key).isNotNull())
    hot = counts.select(hot_key, F.ceil(col(n) / most).cast("int").alias(n))
    found = hot.collect()
    if not found:
        return left.join(right, key, how)
    hot = left.sparkSession.createDataFrame(found, hot.schema)
    count = F.coalesce(col(n), F.lit(1))
    marked = lambda df: df.join(F.broadcast(hot), col(key) == col(hot_key), "left").drop(hot_key)
    dealt = marked(left).withColumn(at, F.pmod(F.xxhash64(by), count).cast("int")).drop(n)
    copied = marked(right).withColumn(at_right, F.explode(F.sequence(F.lit(0), count - 1))).drop(n).withColumnRenamed(key, key_right)
    return dealt.join(copied, (col(key) == col(key_right)) & (col(at) == col(at_right)), how).drop(key_right, at, at_right)

"""Functions of single values and arrays, as column expressions."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F


def once(*values: Column, f: Callable[..., Column]) -> Column:
    """``f`` of ``values``, each worked out once a row: Spark works out what a lambda over elements
    holds for each element again, also where the optimizer puts an expression in a column's place."""
    bound = F.array(F.struct(*(v.alias(f"_{k}") for k, v in enumerate(values))))
    return F.get(F.transform(bound, lambda s: f(*(s[f"_{k}"] for k in range(len(values))))), F.lit(0))


def roundup(x: Column, align: int) -> Column:
    return (F.ceil(x / align) * align).cast("bigint")


def to_uint8(values: Column) -> Column:
    """Least to greatest as 0..255, half to even; constant arrays give zeros."""
    scaled = lambda x, low, span: F.transform(x, lambda v: F.when(span == 0, 0).otherwise(F.bround((v - low) * 255 / F.when(span == 0, 1).otherwise(span))).cast("int"))
    return once(values, f=lambda x: once(F.array_min(x), F.array_max(x) - F.array_min(x), f=lambda low, span: scaled(x, low, span)))


def interleave(values: Column, channels: int, height: int, width: int) -> Column:
    """``[channel, row, column]`` order to ``[row, column, channel]``."""
    return once(values, f=lambda x: F.transform(F.sequence(F.lit(0), F.lit(channels * height * width - 1)), lambda i: F.get(x, ((i % channels) * height * width + F.floor(i / channels)).cast("int"))))


def gray_encode(x: Column) -> Column:
    return x.bitwiseXOR(F.shiftright(x, 1))


def gray_decode(g: Column, bits: int = 32) -> Column:
    shift = 1
    while shift < bits:
        g = g.bitwiseXOR(F.shiftright(g, shift))
        shift *= 2
    return g


def encode_gene(x: Column, accuracy: float, bits: int) -> Column:
    """A number as a sign, 1 above zero, and the Gray code of its whole steps of ``accuracy``.

    A number whose code needs more than ``bits`` is an error, as a cut code would stand for another.
    """
    steps = F.floor(F.abs(x) / accuracy).cast("bigint")
    code = F.bin(gray_encode(steps))
    wide = F.raise_error(F.concat(F.lit(f"more than {bits} bits for gene "), x.cast("string"))).cast("string")
    return F.when(F.length(code) > bits, wide).otherwise(F.concat(F.when(x > 0, "1").otherwise("0"), F.lpad(code, bits, "0")))


def decode_gene(code: Column, accuracy: float) -> Column:
    steps = gray_decode(F.conv(F.substr(code, F.lit(2)), 2, 10).cast("bigint"), 64)
    return steps * F.lit(accuracy) * F.when(F.substring(code, 1, 1) == "0", -1).otherwise(1)


def sine_root_fitness(genes: Column) -> Column:
    """``1 / (418.9829 n - sum x sin sqrt |x|)``; 0 for no genes."""
    total = F.aggregate(genes, F.lit(0.0), lambda a, x: a + x * F.sin(F.sqrt(F.abs(x))))
    return F.when(F.size(genes) == 0, 0.0).otherwise(1 / (418.9829 * F.size(genes) - total))


def wrap_range(x: Column, low: float, high: float) -> Column:
    """``x`` moved by whole spans until it lies within the range."""
    span = high - low
    below = x + F.ceil((low - x) / span) * span
    above = x - F.ceil((x - high) / span) * span
    return F.when(x < low, below).when(x > high, above).otherwise(x)


def elapsed_parts(seconds: Column) -> list[Column]:
    s = F.floor(seconds).cast("bigint")
    return [F.floor(s / 86400).alias("days"), F.floor(s % 86400 / 3600).alias("hours"), F.floor(s % 3600 / 60).alias("mins"), (s % 60).alias("secs")]


def clock(seconds: Column) -> Column:
    s = F.floor(seconds).cast("bigint")
    return F.format_string("%02d:%02d:%02d", F.floor(s / 3600), F.floor(s % 3600 / 60), s % 60)


def split_author(author: Column) -> list[Column]:
    """``Name <mail>`` as name and mail."""
    return [F.trim(F.regexp_extract(author, r"^([^<]*)", 1)).alias("name"), F.regexp_extract(author, r"<([^>]*)>", 1).alias("mail")]

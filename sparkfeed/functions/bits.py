"""64-bit arithmetic that wraps, and xorshift steps, as column expressions on ``bigint`` bits."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

_LOW = 0xFFFFFFFF


def unsigned(x: Column) -> Column:
    """The bits as an unsigned decimal."""
    return F.conv(F.hex(x), 16, 10).cast("decimal(20,0)")


def from_hex(text: Column) -> Column:
    """Up to 16 hex digits as the bits of a ``bigint``."""
    return F.conv(text, 16, -10).cast("bigint")


def add64(a: Column, b: Column) -> Column:
    """The sum modulo 2^64; added by halves, so that no step overflows."""
    half = lambda x: (x.bitwiseAND(F.lit(_LOW)), F.shiftrightunsigned(x, 32))
    (a_low, a_high), (b_low, b_high) = half(a), half(b)
    low = a_low + b_low
    return F.shiftleft(a_high + b_high + F.shiftrightunsigned(low, 32), 32).bitwiseOR(low.bitwiseAND(F.lit(_LOW)))


def mul64(a: Column, factor: int) -> Column:
    """The product with an unsigned ``factor`` below 2^62, modulo 2^64."""
    modulus = F.lit(str(2**64)).cast("decimal(20,0)")
    rest = (unsigned(a) * F.lit(str(factor)).cast("decimal(19,0)")) % modulus
    return F.when(rest < F.lit(str(2**63)).cast("decimal(20,0)"), rest).otherwise(rest - modulus).cast("bigint")


def xorshift128plus(first: Column, second: Column) -> Column:
    """One step: ``(first, second, value)``."""
    x = first.bitwiseXOR(F.shiftleft(first, 23))
    mixed = x.bitwiseXOR(second).bitwiseXOR(F.shiftrightunsigned(x, 17)).bitwiseXOR(F.shiftrightunsigned(second, 26))
    return F.struct(second.alias("first"), mixed.alias("second"), add64(mixed, second).alias("value"))


#: Fixed value: the factor of xorshift1024*.
STAR = 1181783497276652981


def xorshift1024star(state: Column, rounds: int) -> Column:
    """``(state, values)`` after 16 steps a round on 16 words, from word 0."""

    def step(acc: Column, i: Column) -> Column:
        at = (i + 1) % 16
        old, x = F.get(acc["state"], (i % 16).cast("int")), F.get(acc["state"], at.cast("int"))
        x = x.bitwiseXOR(F.shiftleft(x, 31))
        x = x.bitwiseXOR(F.shiftrightunsigned(x, 11))
        new = F.transform(F.array(old.bitwiseXOR(F.shiftrightunsigned(old, 30)).bitwiseXOR(x)), lambda w: w)[0]
        return F.struct(F.transform(acc["state"], lambda w, j: F.when(j == at, new).otherwise(w)).alias("state"), F.concat(acc["words"], F.array(new)).alias("words"))

    start = F.struct(state.alias("state"), F.array().cast("array<bigint>").alias("words"))
    end = F.aggregate(F.sequence(F.lit(0), F.lit(16 * rounds - 1)), start, step)
    return F.transform(F.array(end), lambda e: F.struct(e["state"].alias("state"), F.transform(e["words"], lambda w: mul64(w, STAR)).alias("values")))[0]

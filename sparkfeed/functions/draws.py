"""Random order and draws from hashes: the same at each run and under any partitioning."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F


def h(seed, key: Column, epoch=0) -> Column:
    """The hex digest by which rows are put in random order."""
    return F.md5(F.concat_ws("|", F.lit(str(seed)), F.lit(str(epoch)), key.cast("string")))


def unit(digest: Column) -> Column:
    """A number in [0, 1) from a digest's first 13 hex digits, exact in a double."""
    return F.conv(F.substring(digest, 1, 13), 16, 10).cast("double") / F.lit(float(2**52))


def uniform(seed, key: Column, a: float = 0.0, b: float = 1.0, epoch=0) -> Column:
    return F.lit(a) + unit(h(seed, key, epoch)) * F.lit(b - a)


def integer(seed, key: Column, n, epoch=0) -> Column:
    """An integer in [0, n)."""
    return F.floor(unit(h(seed, key, epoch)) * n).cast("bigint")


def normal(seed, key: Column, mean: float = 0.0, sigma: float = 1.0, clip: float = 5.0) -> Column:
    """Box-Muller on two draws, clipped at ``clip`` standard deviations."""
    u, v = unit(h(f"{seed}:u", key)), unit(h(f"{seed}:v", key))
    z = F.sqrt(-2 * F.log(1 - u)) * F.cos(v * 2 * math.pi)
    return F.lit(mean) + F.lit(sigma) * F.greatest(F.lit(-clip), F.least(F.lit(clip), z))


def random_bytes(seed, key: Column, n: int) -> Column:
    """``n`` bytes, 16 of a digest at a time."""
    parts = [F.unhex(h(seed, key, f"b{k}")) for k in range(-(-n // 16))]
    return F.substring(F.concat(*parts), 1, n)


def choice(seed, key: Column, values: list, weights: list[float] | None = None) -> Column:
    """One of few ``values``, evenly or by weight."""
    weights = weights or [1.0] * len(values)
    u, total, upto = unit(h(seed, key)) * sum(weights), 0.0, None
    for value, weight in zip(values[:-1], weights[:-1], strict=True):
        total += weight
        upto = F.when(u < total, F.lit(value)) if upto is None else upto.when(u < total, F.lit(value))
    return F.lit(values[-1]) if upto is None else upto.otherwise(F.lit(values[-1]))


def permutation(seed, key: Column, n: int) -> Column:
    """0 to ``n - 1`` in an order of each key's own."""
    drawn = F.transform(F.sequence(F.lit(0), F.lit(n - 1)), lambda i: F.struct(F.md5(F.concat_ws("|", F.lit(f"{seed}|p"), key.cast("string"), i)).alias("h"), i.alias("i")))
    return F.transform(F.array_sort(drawn), lambda s: s["i"])

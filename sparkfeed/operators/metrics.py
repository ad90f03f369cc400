"""Confusion matrices, histograms, matrices, histories and ratings."""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.scan import neighbours, rank_in_series


def confusion_matrix(df: DataFrame, target: str, predicted: str) -> DataFrame:
    """``(predicted, target, n, pct)``; totals are over the few cells."""
    cells = df.groupBy(F.col(predicted).alias("predicted"), F.col(target).alias("target")).agg(F.count("*").alias("n"))
    return cells.withColumn("pct", 100.0 * F.col("n") / F.sum("n").over(W.partitionBy(F.lit(0))))


def confusion_summary(cells: DataFrame) -> DataFrame:
    hit = F.col("predicted").eqNullSafe(F.col("target"))
    return cells.agg(F.sum(F.when(hit, F.col("n")).otherwise(0)).alias("right"), F.sum("n").alias("total"), F.max(F.when(~hit, F.col("n"))).alias("worst")).withColumn("accuracy", 100.0 * F.col("right") / F.col("total"))


#: Cells of a histogram by which an order statistic is closed in on; so many counts come to the driver at once.
CELLS = 4096


def order_statistics(df: DataFrame, col: str, places: list[int]) -> list[float]:
    """The values at ``places`` (from 0) of the sorted finite values of ``col``, without sorting them.

    A pass counts the values of each cell of the interval that holds a place, and finds the cell's own
    least and greatest value, which are the next interval; a few passes leave a single value. Nothing
    but counts by cell is shuffled. A place beyond the values is an error.
    """
    values = df.select(F.col(col).cast("double").alias("v")).where(F.col("v").isNotNull() & (F.abs("v") < float("inf")))
    low, high, n = values.agg(F.min("v"), F.max("v"), F.count("*")).first()
    if any(not 0 <= k < n for k in places):
        raise ValueError(f"places {places} of {n} values")
    spans = {k: (low, high, 0) for k in places}
    while open_ := sorted({s for s in spans.values() if s[0] < s[1]}):
        # halves, as the whole span may be beyond what a double holds
        cell = lambda s: F.least(F.floor((F.col("v") / 2 - s[0] / 2) / (s[1] / 2 - s[0] / 2) * CELLS), F.lit(CELLS - 1))
        cells = F.array(*(F.when(F.col("v").between(s[0], s[1]), F.struct(F.lit(i).alias("i"), cell(s).alias("cell"))) for i, s in enumerate(open_)))
        rows = values.select("v", F.explode(F.filter(cells, lambda c: c.isNotNull())).alias("c")).groupBy("c.i", "c.cell").agg(F.count("*").alias("n"), F.min("v").alias("low"), F.max("v").alias("high")).collect()
        for k, span in spans.items():
            if span not in open_:
                continue
            before = span[2]
            for r in sorted((r for r in rows if r["i"] == open_.index(span)), key=lambda r: r["cell"]):
                if before + r["n"] > k:
                    spans[k] = (r["low"], r["high"], before)
                    break
                before += r["n"]
    return [spans[k][0] for k in places]


def auto_histogram(df: DataFrame, col: str) -> DataFrame:
    """``(bin, low, high, n)`` with bins by the Freedman-Diaconis rule.

    Quartiles are order statistics (the upper one rounded up, the lower down), closed in on by counts.
    There are at least 3 bins, and 3 if the quartiles are equal. Null, NaN and infinite values are
    left out; without any other there are no bins.
    """
    values = df.select(F.col(col).cast("double").alias("v")).where(F.col("v").isNotNull() & (F.abs("v") < float("inf")))
    low, high, n = values.agg(F.min("v"), F.max("v"), F.count("*")).first()
    if not n:
        return df.sparkSession.createDataFrame([], "bin int, low double, high double, n bigint")
    upper, lower = order_statistics(values, "v", [math.ceil((n - 1) * 0.75), math.floor((n - 1) * 0.25)])
    width = 2 * (upper - lower) * n ** (-1 / 3)
    bins = max(3, round((high - low) / width)) if upper > lower else 3
    span = high - low if high > low else 1.0
    counts = values.select(F.least(F.floor((F.col("v") - low) * bins / span), F.lit(bins - 1)).cast("int").alias("bin")).groupBy("bin").agg(F.count("*").alias("n"))
    every = df.sparkSession.range(bins).select(F.col("id").cast("int").alias("bin"))
    edge = lambda k: F.lit(low) + F.lit(high - low) * k / bins
    return every.join(counts, "bin", "left").select("bin", edge(F.col("bin")).alias("low"), edge(F.col("bin") + 1).alias("high"), F.coalesce("n", F.lit(0)).alias("n"))


def row_histograms(df: DataFrame, key: str, features: str = "features", n_bars: int = 25, rows: int = 16) -> DataFrame:
    """``(key, bars)`` of the first rows by key; a constant row has only zeros."""
    first = df.select(key, F.col(features).cast("array<double>").alias("x")).orderBy(key).limit(rows)
    low, high = F.array_min("x"), F.array_max("x")
    place = F.transform("x", lambda v: F.when(high > low, F.floor((v - low) * (n_bars - 1) / (high - low))).otherwise(-1).cast("int"))
    return first.withColumn("at", place).select(key, F.transform(F.sequence(F.lit(0), F.lit(n_bars - 1)), lambda b: F.size(F.filter("at", lambda k: k == b))).alias("bars"))


def max_min_table(df: DataFrame, cols: list[str]) -> DataFrame:
    """``(series, max, min)`` of each column, in one pass; an empty series has nulls."""
    one = df.agg(F.array(*(F.struct(F.lit(c).alias("series"), F.max(c).cast("double").alias("max"), F.min(c).cast("double").alias("min")) for c in cols)).alias("s"))
    return one.select(F.explode("s").alias("s")).select("s.*")


def matmul(a: DataFrame, b: DataFrame, c: DataFrame | None = None, alpha: float = 1.0, beta: float = 0.0, ta: bool = False, tb: bool = False) -> DataFrame:
    """``alpha A B + beta C`` for matrices in coordinates ``(i, j, v)``."""
    flip = lambda m, t: m.select(F.col("j" if t else "i").alias("i"), F.col("i" if t else "j").alias("j"), "v")
    a, b = flip(a, ta).select("i", F.col("j").alias("k"), F.col("v").alias("x")), flip(b, tb).select(F.col("i").alias("k"), "j", F.col("v").alias("y"))
    product = a.join(b, "k").groupBy("i", "j").agg((F.sum(F.col("x") * F.col("y")) * alpha).alias("v"))
    if c is None or beta == 0:
        return product
    return product.unionByName(c.select("i", "j", (F.col("v") * beta).alias("v"))).groupBy("i", "j").agg(F.sum("v").alias("v"))


def block_matmul(a: DataFrame, b: DataFrame, block: int = 256) -> DataFrame:
    """The same for dense matrices: blocks ``(bi, bj)`` meet, and their product is one of arrays."""

    def blocks(m: DataFrame, side: str) -> DataFrame:
        return m.groupBy(F.floor(F.col("i") / block).alias("bi"), F.floor(F.col("j") / block).alias("bj")).agg(F.collect_list(F.struct((F.col("i") % block).alias("i"), (F.col("j") % block).alias("j"), "v")).alias(side))

    def multiply(frames):
        for f in frames:
            out = []
            for r in f.itertuples(index=False):
                x, y = np.zeros((block, block)), np.zeros((block, block))
                for cell in r.x:
                    x[cell["i"], cell["j"]] = cell["v"]
                for cell in r.y:
                    y[cell["i"], cell["j"]] = cell["v"]
                z = x @ y
                i, j = np.nonzero(z)
                out.append(pd.DataFrame({"i": r.bi * block + i, "j": r.bj * block + j, "v": z[i, j]}))
            yield pd.concat(out) if out else pd.DataFrame({"i": [], "j": [], "v": []})

    x, y = blocks(a, "x"), blocks(b, "y").select(F.col("bi").alias("bk"), "bj", "y")
    pairs = x.select("bi", F.col("bj").alias("bk"), "x").join(y, "bk").select("bi", "bj", "x", "y")
    return pairs.mapInPandas(multiply, "i bigint, j bigint, v double").groupBy("i", "j").agg(F.sum("v").alias("v"))


def matrix_sums(m: DataFrame, axis: str) -> DataFrame:
    return m.groupBy("i" if axis == "row" else "j").agg(F.sum("v").alias("total"))


def largest_parts(df: DataFrame, key: str, data: str, threshold: int, n: int = 5) -> DataFrame:
    """The ``n`` largest parts if all together exceed ``threshold`` bytes."""
    sizes = df.groupBy(key).agg(F.sum(F.octet_length(data)).alias("bytes"))
    total = sizes.agg(F.sum("bytes").alias("_total"))
    return sizes.crossJoin(F.broadcast(total)).where(F.col("_total") > threshold).orderBy(F.desc("bytes"), key).limit(n).select(key, "bytes")


def metric_tail(df: DataFrame, by: str, order: str, n: int = 11) -> DataFrame:
    """The last ``n`` points of each series with their places in it, from 0."""
    placed = rank_in_series(df, [by], [order], "position", "_n")
    return placed.where(F.col("position") >= F.col("_n") - n).drop("_n")


def poly_trend(tail: DataFrame, by: str, y: str, degree: int = 2, points: int = 100) -> DataFrame:
    """A least-squares polynomial through each series' points, at evenly spaced places."""

    def fit(f: pd.DataFrame) -> pd.DataFrame:
        at = np.linspace(f["position"].min(), f["position"].max(), points)
        p = np.polyfit(f["position"], f[y], min(degree, len(f) - 1))
        return pd.DataFrame({by: f[by].iloc[0], "x": at, "trend": np.polyval(p, at)})

    return tail.groupBy(by).applyInPandas(fit, f"{by} {dict(tail.dtypes)[by]}, x double, trend double")


def relative_rating(df: DataFrame, group: str, value: str) -> DataFrame:
    """Least value of the group over a row's own; the least is found before the join back."""
    best = df.groupBy(group).agg(F.min(value).alias("_best"))
    return df.join(best, group).withColumn("rating", F.col("_best") / F.col(value)).drop("_best")


def generation_stats(df: DataFrame) -> DataFrame:
    """Sum, mean, best, worst and the element ``n div 2`` from the best, of each generation."""
    ranked = rank_in_series(df.select("generation", "fitness", "cand_id"), ["generation"], [F.desc("fitness"), "cand_id"], "_k", "_n")
    return ranked.groupBy("generation").agg(
        F.sum("fitness").alias("sum"), F.avg("fitness").alias("average"), F.max("fitness").alias("best"), F.min("fitness").alias("worst"),
        F.max(F.when(F.col("_k") == F.floor(F.col("_n") / 2), F.col("fitness"))).alias("median"),
    )


def convergence(stats: DataFrame, most: int) -> DataFrame:
    """Whether a generation, a row each, improved on none of the statistics of the one before, or is beyond ``most``."""
    w = W.partitionBy(F.lit(0)).orderBy("generation")
    names = ("sum", "average", "best", "worst", "median")
    better = [F.col(c) > F.lag(c).over(w) for c in names]
    any_ = better[0]
    for b in better[1:]:
        any_ = any_ | b
    return stats.select("generation", (F.coalesce(~any_, F.lit(False)) | (F.col("generation") > most)).alias("stop"))


def numeric_derivative(df: DataFrame, by: str, x: str, y: str, h: float) -> DataFrame:
    """Fourth-order central differences on an even grid; null at the two ends of a series."""
    near = neighbours(df, [by], [x], y, {"sf_b2": -2, "sf_b1": -1, "sf_f1": 1, "sf_f2": 2})
    b2, b1, f1, f2 = (F.col(c) for c in ("sf_b2", "sf_b1", "sf_f1", "sf_f2"))
    return near.withColumn("derivative", (-f2 + 8 * f1 - 8 * b1 + b2) / (12 * h)).drop("sf_b2", "sf_b1", "sf_f1", "sf_f2")

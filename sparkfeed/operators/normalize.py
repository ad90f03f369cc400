"""Feature statistics, and normalisers that are applied with them and inverted.

Statistics are one row of arrays; it is as wide as a sample, so it may always be broadcast.
"""

from __future__ import annotations

from collections.abc import Callable
from typing import NamedTuple

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.scalars import once
from .labels import apply_label_mapping

_PART = "size int, n array<bigint>, sum array<double>, min array<double>, max array<double>"


def fit_stats(df: DataFrame, features: str = "features", where: str | None = "split = 'train'") -> DataFrame:
    """``(feature_idx, n, sum, min, max)`` of each element, over train rows only.

    ``n`` is of each element by itself: null, NaN and infinite elements are left out of all four, so
    an element without any finite value has n 0, sum 0 and no least or greatest. Null and empty
    features are left out whole. Features of different lengths are an error, in one task or in
    several. Each task sums its rows up in one row of arrays; only these are merged.
    """

    def partial(frames):
        n = total = low = high = None
        for frame in frames:
            if not len(frame):
                continue
            lengths = set(map(len, frame["x"])) | ({len(total)} if total is not None else set())
            if len(lengths) > 1:
                raise ValueError(f"features differ in length: {sorted(lengths)}")
            x = np.stack(frame["x"].to_numpy()).astype(np.float64)
            if total is None:
                n, total = np.zeros(x.shape[1], np.int64), np.zeros(x.shape[1])
                low, high = np.full(x.shape[1], np.inf), np.full(x.shape[1], -np.inf)
            good = np.isfinite(x)
            n, total = n + good.sum(axis=0), total + np.where(good, x, 0.0).sum(axis=0)
            low, high = np.minimum(low, np.where(good, x, np.inf).min(axis=0)), np.maximum(high, np.where(good, x, -np.inf).max(axis=0))
        if total is not None:
            yield pd.DataFrame({"size": [len(total)], "n": [n], "sum": [total], "min": [low], "max": [high]})

    rows = df.where(where) if where else df
    parts = rows.where(F.size(features) > 0).select(F.col(features).cast("array<double>").alias("x")).mapInPandas(partial, _PART)
    each = parts.select("size", F.posexplode(F.arrays_zip("n", "sum", "min", "max")).alias("feature_idx", "s"))
    some = lambda x: F.when(F.col("s.n") > 0, x)
    merged = each.groupBy("feature_idx").agg(F.sum("s.n").alias("n"), F.sum("s.sum").alias("sum"), F.min(some(F.col("s.min"))).alias("min"), F.max(some(F.col("s.max"))).alias("max"), F.min("size").alias("_least"), F.max("size").alias("_most"))
    # a filter, so that no choice of columns can lose it
    differ = F.raise_error(F.concat(F.lit("features differ in length: "), F.col("_least"), F.lit(" and "), F.col("_most"))).cast("boolean")
    return merged.where(F.when(F.col("_least") == F.col("_most"), F.lit(True)).otherwise(differ)).drop("_least", "_most")


def merge_stats(*stats: DataFrame) -> DataFrame:
    """Statistics of several parts as those of the whole; an element counts where it had values."""
    both = stats[0]
    for s in stats[1:]:
        both = both.unionByName(s)
    return both.groupBy("feature_idx").agg(F.sum("n").alias("n"), F.sum("sum").alias("sum"), F.min("min").alias("min"), F.max("max").alias("max"))


def stats_row(stats: DataFrame) -> DataFrame:
    """The statistics as one row of arrays, in the order of the elements."""
    row = F.sort_array(F.collect_list(F.struct("feature_idx", "n", "sum", "min", "max")))
    one = stats.agg(row.alias("s"))
    return one.select(F.transform("s", lambda x: x["sum"] / F.nullif(x["n"], F.lit(0))).alias("mean"), F.col("s.min").alias("low"), F.col("s.max").alias("high"))


def data_range(df: DataFrame, features: str = "features") -> DataFrame:
    return df.agg(F.min(F.array_min(features)).alias("low"), F.max(F.array_max(features)).alias("high"))


def check_range(df: DataFrame, batch: str, features: str = "features") -> DataFrame:
    """Batches whose range differs from that of the first."""
    by = df.groupBy(batch).agg(F.min(F.array_min(features)).alias("low"), F.max(F.array_max(features)).alias("high"))
    first = by.orderBy(batch).limit(1).select(F.col("low").alias("_low"), F.col("high").alias("_high"))
    return by.crossJoin(F.broadcast(first)).where("low <> _low OR high <> _high").select(batch, "low", "high")


def _zip(x: Column, *others: Column, f: Callable) -> Column:
    return once(*others, f=lambda *o: F.transform(x, lambda v, i: f(v, *(F.get(c, i) for c in o))))


def _span(low: Column, high: Column) -> Column:
    return F.when(high == low, 1.0).otherwise(high - low)


def _linear(x: Column, interval: tuple[float, float]) -> Column:
    a, b = interval
    scaled = lambda x, low, high: F.transform(x, lambda v: F.when(high == low, (a + b) / 2).otherwise((v - low) * (b - a) / _span(low, high) + a))
    return once(x, f=lambda x: once(F.array_min(x), F.array_max(x), f=lambda low, high: scaled(x, low, high)))


def _unlinear(x: Column, low: Column, high: Column, interval: tuple[float, float]) -> Column:
    a, b = interval
    return once(low, high, f=lambda low, high: F.transform(x, lambda v: F.when(high == low, low).otherwise((v - a) * (high - low) / (b - a) + low)))


def _exp_sum(x: Column, top: Column) -> Column:
    return F.aggregate(x, F.lit(0.0), lambda a, w: a + F.exp(w - top))


def _exp(x: Column) -> Column:
    share = lambda x, top: once(_exp_sum(x, top), f=lambda total: F.transform(x, lambda v: F.exp(v - top) / total))
    return once(x, f=lambda x: once(F.array_max(x), f=lambda top: share(x, top)))


class Normalizer(NamedTuple):
    """``apply`` and ``invert`` take the features and, by name, statistics and options."""

    needs_stats: bool
    apply: Callable[..., Column]
    invert: Callable[..., Column]


#: Keys are names by which data sets ask for a normaliser.
NORMALIZERS: dict[str, Normalizer] = {
    "none": Normalizer(False, lambda x, **_: x, lambda x, **_: x),
    "mean_disp": Normalizer(
        True,
        lambda x, mean, low, high, **_: _zip(x, mean, low, high, f=lambda v, m, a, b: (v - m) / _span(a, b)),
        lambda x, mean, low, high, **_: _zip(x, mean, low, high, f=lambda v, m, a, b: v * _span(a, b) + m),
    ),
    "linear": Normalizer(False, lambda x, interval=(-1.0, 1.0), **_: _linear(x, interval), lambda x, dmin, dmax, interval=(-1.0, 1.0), **_: _unlinear(x, dmin, dmax, interval)),
    "range_linear": Normalizer(
        True,
        lambda x, interval=(-1.0, 1.0), **_: _linear(x, interval),
        lambda x, low, high, interval=(-1.0, 1.0), **_: _unlinear(x, F.array_min(low), F.array_max(high), interval),
    ),
    "exp": Normalizer(
        False,
        lambda x, **_: _exp(x),
        lambda x, dmax, dsum, **_: once(dmax, dsum, f=lambda dmax, dsum: F.transform(x, lambda v: F.log(v * dsum) + dmax)),
    ),
    "pointwise": Normalizer(
        True,
        lambda x, low, high, **_: _zip(x, low, high, f=lambda v, a, b: F.when(a == b, 0.0).otherwise((v - a) * 2 / _span(a, b) - 1)),
        lambda x, low, high, **_: _zip(x, low, high, f=lambda v, a, b: F.when(a == b, a).otherwise((v + 1) * (b - a) / 2 + a)),
    ),
    "external_mean": Normalizer(False, lambda x, mean, scale=1.0, **_: _zip(x, mean, f=lambda v, m: (v - m) * scale), lambda x, mean, scale=1.0, **_: _zip(x, mean, f=lambda v, m: v / scale + m)),
    "internal_mean": Normalizer(True, lambda x, mean, scale=1.0, **_: _zip(x, mean, f=lambda v, m: (v - m) * scale), lambda x, mean, scale=1.0, **_: _zip(x, mean, f=lambda v, m: v / scale + m)),
}
#: Kinds that may stand for targets: those that can be inverted without what a row alone tells.
TARGET_KINDS = ("none", "mean_disp", "range_linear", "pointwise", "external_mean", "internal_mean")


def register_normalizer(name: str, needs_stats: bool, apply: Callable[..., Column], invert: Callable[..., Column]) -> None:
    NORMALIZERS[name] = Normalizer(needs_stats, apply, invert)


def _with(df: DataFrame, kind: Normalizer, f: Callable[..., Column], column: str, stats: DataFrame | None, options: dict) -> DataFrame:
    if not kind.needs_stats:
        return df.withColumn(column, f(F.col(column), **options))
    own = ["mean", "low", "high"]
    row = stats_row(stats).select(*(F.col(c).alias(f"_{c}") for c in own))
    joined = df.crossJoin(F.broadcast(row))
    return joined.withColumn(column, f(F.col(column), **{c: F.col(f"_{c}") for c in own}, **options)).select(*df.columns)


def fit_range(df: DataFrame, batch: str, features: str = "features", where: str | None = "split = 'train'") -> DataFrame:
    """Statistics as of ``fit_stats``; a batch whose least or greatest value is not that of the first
    is an error, raised by a filter that no choice of columns can lose."""
    rows = df.where(where) if where else df
    wrong = check_range(rows, batch, features).agg(F.count("*").alias("_wrong"), F.min(F.struct(batch, "low", "high")).cast("string").alias("_which"))
    failed = F.raise_error(F.concat(F.lit("batches differ in range from the first, as "), F.col("_which"))).cast("boolean")
    return fit_stats(df, features, where).crossJoin(F.broadcast(wrong)).where(F.when(F.col("_wrong") == 0, F.lit(True)).otherwise(failed)).drop("_wrong", "_which")


def check_learnt_range(df: DataFrame, stats: DataFrame, column: str = "features") -> DataFrame:
    """``df``, in which a value beyond the least and greatest of ``stats`` is an error.

    The check is a filter over every row, so no choice of columns can lose it; null and NaN pass.
    """
    bounds = stats.agg(F.min("min").alias("_from"), F.max("max").alias("_to"))
    seen = F.filter(column, lambda v: ~F.isnan(v))
    outside = (F.array_min(seen) < F.col("_from")) | (F.array_max(seen) > F.col("_to"))
    wrong = F.raise_error(F.concat(F.lit("values beyond the learnt range: "), F.array_min(seen), F.lit(" to "), F.array_max(seen))).cast("boolean")
    return df.crossJoin(F.broadcast(bounds)).where(F.when(F.coalesce(outside, F.lit(False)), wrong).otherwise(F.lit(True))).drop("_from", "_to")


def normalize(df: DataFrame, name: str, stats: DataFrame | None = None, column: str = "features", **options) -> DataFrame:
    """``df`` with ``column`` normalised; ``linear`` and ``exp`` add what their inverse needs of each row.

    ``range_linear`` is for data all of whose batches have one range: learn it by ``fit_range``, which
    sees to that. With ``checked=True`` a value beyond the learnt range is an error, with any normaliser.
    """
    kind = NORMALIZERS[name]
    if options.pop("checked", False):
        df = check_learnt_range(df, stats, column)
    if name == "linear":
        df = df.withColumns({"dmin": F.array_min(column), "dmax": F.array_max(column)})
    if name == "exp":
        x = F.col(column)
        df = df.withColumns({"dmax": F.array_max(x), "dsum": once(x, f=lambda x: once(F.array_max(x), f=lambda top: _exp_sum(x, top)))})
    return _with(df, kind, kind.apply, column, stats, options)


def denormalize(df: DataFrame, name: str, stats: DataFrame | None = None, column: str = "features", **options) -> DataFrame:
    kind = NORMALIZERS[name]
    if name == "linear":
        options |= {"dmin": F.col("dmin"), "dmax": F.col("dmax")}
    if name == "exp":
        options |= {"dmax": F.col("dmax"), "dsum": F.col("dsum")}
    return _with(df, kind, kind.invert, column, stats, options)


def normalize_targets(df: DataFrame, name: str, column: str = "target", **options) -> DataFrame:
    """Targets normalised by statistics of all targets."""
    if name not in TARGET_KINDS:
        raise ValueError(f"{name} can't be inverted for targets")
    stats = fit_stats(df, column, where=None) if NORMALIZERS[name].needs_stats else None
    return normalize(df, name, stats, column, **options)


def mean_rdisp(df: DataFrame, mean: Column, rdisp: Column, column: str = "features") -> DataFrame:
    """``(x - mean) rdisp`` for each element; lengths must agree."""
    fits = (F.size(column) == F.size(mean)) & (F.size(mean) == F.size(rdisp))
    value = _zip(F.col(column), mean, rdisp, f=lambda v, m, r: (v - m) * r)
    return df.withColumn(column, F.when(fits, value).otherwise(F.raise_error(F.lit("lengths differ")).cast("array<double>")))


def save_stats(stats: DataFrame, path: str) -> None:
    stats.write.mode("overwrite").parquet(path)


def load_stats(spark, path: str) -> DataFrame:
    return spark.read.parquet(path)


class Bundle(NamedTuple):
    """What a data set leaves to others: its normaliser, statistics and label numbers."""

    name: str
    stats: DataFrame | None
    mapping: DataFrame | None


def save_bundle(bundle: Bundle, spark, path: str) -> None:
    spark.createDataFrame([(bundle.name, bundle.stats is not None, bundle.mapping is not None)], "name string, stats boolean, mapping boolean").write.parquet(f"{path}/name")
    for part, df in (("stats", bundle.stats), ("mapping", bundle.mapping)):
        if df is not None:
            df.write.parquet(f"{path}/{part}")


def load_bundle(spark, path: str) -> Bundle:
    head = spark.read.parquet(f"{path}/name").first()
    return Bundle(head["name"], *(spark.read.parquet(f"{path}/{part}") if head[part] else None for part in ("stats", "mapping")))


def derive_from(df: DataFrame, bundle: Bundle, on_missing: str = "null", **options) -> DataFrame:
    """New data as the data set of ``bundle`` has it: its statistics, not its own, and its label numbers."""
    out = normalize(df, bundle.name, bundle.stats, **options)
    return apply_label_mapping(out, bundle.mapping, on_missing) if bundle.mapping is not None else out

"""Labels of samples: mapping to numbers, checks between splits, counts and distributions."""

from __future__ import annotations

import math

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.index import dense_index

SPLITS = ("test", "validation", "train")


def build_label_mapping(df: DataFrame, split: str = "train") -> DataFrame:
    """``(label, label_id)``: labels of the train split in sorted order, from 0.

    Null labels have no number. However many labels there are, no task sorts all of them.
    """
    labels = df.where((F.col("split") == split) & F.col("label").isNotNull()).select("label").distinct()
    return dense_index(labels, ["label"], "label_id").withColumn("label_id", F.col("label_id").cast("int"))


def apply_label_mapping(df: DataFrame, mapping: DataFrame, on_missing: str = "null") -> DataFrame:
    """``df`` with ``label_id``; a label that the mapping lacks gives null, no row, or an error."""
    joined = df.join(mapping, "label", "inner" if on_missing == "drop" else "left")
    if on_missing == "error":
        bad = F.col("label").isNotNull() & F.col("label_id").isNull()
        joined = joined.withColumn("label_id", F.when(bad, F.raise_error(F.concat(F.lit("no number for label "), F.col("label"))).cast("int")).otherwise(F.col("label_id")))
    return joined


def unseen_labels(df: DataFrame) -> DataFrame:
    """``(split, label)`` of labels outside the train split that it lacks."""
    seen = df.where("split = 'train'").select("label").distinct()
    return df.where("split <> 'train' AND label IS NOT NULL").select("split", "label").distinct().join(seen, "label", "left_anti").select("split", "label")


def label_counts(df: DataFrame, fill: bool = True) -> DataFrame:
    """``(split, label, n)``; with ``fill``, 0 where a split lacks a train label."""
    counts = df.where("label IS NOT NULL").groupBy("split", "label").agg(F.count("*").alias("n"))
    if not fill:
        return counts
    wanted = counts.where("split = 'train'").select("label").crossJoin(counts.select("split").distinct())
    return wanted.join(counts, ["split", "label"], "full").select("split", "label", F.coalesce("n", F.lit(0)).alias("n"))


def label_stats(df: DataFrame, bar: int = 25) -> tuple[DataFrame, DataFrame]:
    """Summary a split (least and most frequent label, mean, deviation, also as % of the mean) and a row a label with its
    share and the length of its bar."""
    counts = label_counts(df, fill=False)
    low, high = F.struct("n", "label"), F.struct((-F.col("n")).alias("n"), "label")
    summary = counts.groupBy("split").agg(
        F.min(low)["label"].alias("min_label"), F.min("n").alias("min_n"), F.min(high)["label"].alias("max_label"), F.max("n").alias("max_n"),
        F.avg("n").alias("mean_n"), F.stddev_pop("n").alias("sigma"), (100 * F.stddev_pop("n") / F.avg("n")).alias("sigma_pct"),
    )
    by = W.partitionBy("split")
    rows = counts.select("split", "label", "n", (100.0 * F.col("n") / F.sum("n").over(by)).alias("share"), F.floor(F.col("n") * bar / F.max("n").over(by)).alias("bar"))
    return summary, rows


def unique_labels(df: DataFrame, approx: bool = False) -> DataFrame:
    count = F.approx_count_distinct("label") if approx else F.count_distinct("label")
    return df.where("split = 'train'").agg(count.alias("labels"))


def samples_by_label(df: DataFrame, cap: int | None = None) -> DataFrame:
    """``(label, ids)``, a row a label; ``cap`` keeps the smallest ids of each. For labels too large
    for a row, ``sample_chunks`` has all ids."""
    rows = df.where("label IS NOT NULL").select("label", "sample_id")
    if cap is not None:
        rows = rows.withColumn("k", F.row_number().over(W.partitionBy("label").orderBy("sample_id"))).where(F.col("k") <= cap)
    return rows.groupBy("label").agg(F.sort_array(F.collect_set("sample_id")).alias("ids"))


def sample_chunks(df: DataFrame, size: int = 10_000) -> DataFrame:
    """``(label, chunk, ids)``: all distinct ids of each label, sorted, at most ``size`` of them a row;
    the chunks of a label are in the order of their numbers."""
    rows = dense_index(df.where("label IS NOT NULL").select("label", "sample_id").distinct(), ["label", "sample_id"], "sf_at")
    return rows.groupBy("label", F.floor(F.col("sf_at") / size).alias("chunk")).agg(F.sort_array(F.collect_list("sample_id")).alias("ids"))


def label_distribution(df: DataFrame) -> DataFrame:
    """``(split, label, p)`` with the shares of each split."""
    counts = label_counts(df)
    total = F.sum("n").over(W.partitionBy("split"))
    return counts.select("split", "label", F.when(total > 0, F.col("n") / total).otherwise(0.0).alias("p"))


def _upper_gamma(a: float, x: float) -> float:
    """The regularised upper incomplete gamma function: a series below ``a + 1``, a continued fraction above."""
    if x <= 0:
        return 1.0
    front = math.exp(a * math.log(x) - x - math.lgamma(a))
    if x < a + 1:
        term = total = 1 / a
        k = a
        while abs(term) > 1e-16 * abs(total):
            k += 1
            term *= x / k
            total += term
        return max(0.0, 1 - front * total)
    b, c = x + 1 - a, 1e300
    d = 1 / b
    out = d
    for k in range(1, 10_000):
        step = -k * (k - a)
        b += 2
        d, c = 1 / (step * d + b), b + step / c
        out *= c * d
        if abs(c * d - 1) < 1e-15:
            break
    return front * out


@F.pandas_udf(T.DoubleType())
def chi_square_p(statistic: pd.Series, degrees: pd.Series) -> pd.Series:
    """The chance of such a statistic or a larger one if both are alike."""
    return pd.Series([None if pd.isna(s) or k < 1 else _upper_gamma(k / 2, s / 2) for s, k in zip(statistic, degrees, strict=True)], dtype="float64")


def compare_label_distributions(df: DataFrame, basis: str = "proportion") -> DataFrame:
    """``(split, statistic, degrees, p, same)`` of chi-square against the train split, by shares or
    counts, a row a split that has rows; ``same`` if ``p`` exceeds 0.95."""
    shares = label_distribution(df)
    n = label_counts(df).groupBy("split").agg(F.sum("n").alias("total"))
    train = shares.where("split = 'train'").select("label", F.col("p").alias("e"))
    terms = shares.where("split <> 'train'").join(train, "label").where("e > 0").join(n, "split")
    scale = F.lit(1.0) if basis == "proportion" else F.col("total")
    return terms.groupBy("split").agg(F.sum(scale * (F.col("p") - F.col("e")) * (F.col("p") - F.col("e")) / F.col("e")).alias("statistic"), (F.count("*") - 1).alias("degrees")).withColumn("p", chi_square_p("statistic", "degrees")).withColumn("same", F.col("p") > 0.95)


def label_set_diff(a: DataFrame, b: DataFrame) -> DataFrame:
    """``(label, side)``: only in the one, only in the other, or in both."""
    a, b = a.select("label"), b.select("label")
    side = lambda df, s: df.select("label", F.lit(s).alias("side"))
    return side(a.subtract(b), "left").unionByName(side(b.subtract(a), "right")).unionByName(side(a.intersect(b), "both"))


def split_label_report(df: DataFrame) -> DataFrame:
    """Counts by split and label with all totals, null standing for a total."""
    return df.where("label IS NOT NULL").cube("split", "label").agg(F.count("*").alias("n"))


def label_table(df: DataFrame) -> DataFrame:
    """A row a label, a column a split."""
    return df.where("label IS NOT NULL").groupBy("label").pivot("split", list(SPLITS)).count().na.fill(0)

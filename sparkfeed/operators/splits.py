"""Test, validation and train splits of exact sizes, bagged subsets, and keys of splits."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.draws import h
from ..functions.index import dense_index


def union_splits(splits: dict[str, DataFrame]) -> DataFrame:
    """One dataset of all splits; their columns must agree."""
    out = None
    for name, df in splits.items():
        part = df.withColumn("split", F.lit(name))
        out = part if out is None else out.unionByName(part)
    return out


def validate_samples(df: DataFrame) -> DataFrame:
    """``(rule, split)`` of what breaks the contract of a dataset; no rows if all is well.

    Rules: one sample shape in all splits, labels for all or none of a split, and train rows.
    """
    by = df.groupBy("split").agg(F.min(F.size("features")).alias("least"), F.max(F.size("features")).alias("most"), F.count("label").alias("labelled"), F.count("*").alias("n"))
    all_ = by.agg(F.min("least").alias("a"), F.max("most").alias("b"), F.max((F.col("split") == "train").cast("int")).alias("train"))
    uneven = by.where("least <> most").select(F.lit("shape within split").alias("rule"), "split")
    part = by.where("labelled > 0 AND labelled < n").select(F.lit("labels for some only").alias("rule"), "split")
    across = all_.where("a <> b").select(F.lit("shape across splits").alias("rule"), F.lit(None).cast("string").alias("split"))
    none = all_.where("coalesce(train, 0) = 0").select(F.lit("no train rows").alias("rule"), F.lit(None).cast("string").alias("split"))
    return uneven.unionByName(part).unionByName(across).unionByName(none)


def take_train_ratio(df: DataFrame, ratio: float, seed=0, epoch=0) -> DataFrame:
    """Other splits as they are, and the first ``n - int((1 - ratio) n)`` train rows of the epoch's order."""
    train = df.where("split = 'train'")
    n = train.count()
    ranked = dense_index(train.withColumn("_h", h(seed, F.col("sample_id"), epoch)), ["_h", "sample_id"], "_rank")
    kept = ranked.where(F.col("_rank") < n - int((1 - ratio) * n)).select(*df.columns)
    return df.where("split <> 'train' OR split IS NULL").unionByName(kept)


def resplit_validation(df: DataFrame, ratio: float | None, seed=0, stratify: str | None = None) -> DataFrame:
    """Validation rows drawn anew from validation and train rows.

    ``stratify=None``: exactly ``round(ratio n)`` rows, halves to even; ``"label"``: for each label
    ``max(round(ratio n), 1)`` rows, an error if that is all of them; ``"cover"``: ``int(ratio n)``
    rows with each label in both splits. None keeps all; a ratio of 0 or less merges validation
    into train. Sample ids are unique.
    """
    if ratio is None:
        return df
    if ratio >= 1:
        raise ValueError("the ratio must be below 1")
    pool, rest = df.where("split IN ('validation', 'train')"), df.where("split NOT IN ('validation', 'train') OR split IS NULL")
    own = [c for c in df.columns if c != "split"]
    if ratio <= 0:
        return rest.unionByName(pool.withColumn("split", F.lit("train")))
    # only ids and labels are ranked; what a row holds besides is joined to its new split
    drawn = pool.select("sample_id", *(["label"] if stratify else []), h(seed, F.col("sample_id")).alias("_h"))
    if stratify is None:
        n = pool.count()
        ranked = dense_index(drawn, ["_h", "sample_id"], "_rank")
        chosen = F.col("_rank") < round(ratio * n)
    else:
        sizes = pool.groupBy("label").agg(F.count("*").alias("_n"))
        ranked = dense_index(drawn, ["label", "_h", "sample_id"], "_at")
        # the rank in a label is the place in all less the label's first place: no window a label
        firsts = ranked.groupBy("label").agg(F.min("_at").alias("_first"), F.count("*").alias("_n"))
        ranked = ranked.join(firsts.withColumnRenamed("label", "_label"), F.col("label").eqNullSafe(F.col("_label"))).withColumn("_rank", F.col("_at") - F.col("_first"))
        if stratify == "label":
            quota = F.greatest(F.bround(F.col("_n") * ratio), F.lit(1))
            chosen = F.col("_rank") < F.when(quota >= F.col("_n"), F.raise_error(F.lit("a label has too few rows for this ratio")).cast("double")).otherwise(quota)
        else:
            small, k, n = sizes.where("_n < 2").count(), sizes.count(), pool.count()
            if small or k > int(ratio * n) or k > n - int(ratio * n):
                raise ValueError("too few rows for each label to be in both splits")
            free = dense_index(ranked.where("_rank > 1"), ["_h", "sample_id"], "_free").where(F.col("_free") < int(ratio * n) - k).select("sample_id", F.lit(True).alias("_more"))
            ranked = ranked.join(free, "sample_id", "left")
            chosen = (F.col("_rank") == 0) | F.coalesce(F.col("_more"), F.lit(False))
    taken = ranked.where(chosen).select(F.col("sample_id").alias("_id"), F.lit(True).alias("_taken"))
    out = pool.join(taken, F.col("sample_id").eqNullSafe(F.col("_id")), "left").select(*own, F.when(F.col("_taken"), "validation").otherwise("train").alias("split"))
    return rest.unionByName(out.select(*df.columns))


def bag_splits(df: DataFrame, models: int, ratio: float, seed=0) -> DataFrame:
    """``(model, sample_id)``: each model's own ``ratio`` of the train rows, in its own order."""
    train = df.where("split = 'train'").select("sample_id")
    n = train.count()
    each = train.crossJoin(F.broadcast(df.sparkSession.range(models).select(F.col("id").cast("int").alias("model"))))
    each = each.withColumn("_h", F.md5(F.concat_ws("|", F.lit(str(seed)), "model", "sample_id")))
    ranked = dense_index(each, ["model", "_h", "sample_id"], "_at")
    return ranked.where(F.col("_at") - F.col("model") * n < n - int((1 - ratio) * n)).select("model", "sample_id")


def split_keys(df: DataFrame) -> DataFrame:
    return df.select("split", "label").dropDuplicates().orderBy("split", "label")

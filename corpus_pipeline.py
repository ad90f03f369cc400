"""A corpus pipeline: quality rules, quality classifier, exact and near duplicates, packing.

Each stage takes ``(spark, docs, sf_dir)`` and returns the rows that stay with the columns of
``documents``; the last returns the packed pieces. Between stages the rows are written as Parquet,
to the folder that ``spark.checkpoint.dir`` names. Extra columns, whatever their names, go through
all stages but the last; an empty table stays one.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from sparkfeed.llm import exact_dedup, packing, probminhash, quality_mil, quality_rules
from sparkfeed.functions.scratch import remove, scratch_path, scratch_run, written


def quality_rule_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The rows that break no quality rule; null, empty and short texts go."""
    return quality_rules.keep_good(docs)


def quality_classifier_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The rows whose score, learnt from the labels of rows that are not held out, reaches the threshold; repeated rows share their fate."""
    return quality_mil.keep_quality(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))


def exact_dedup_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each group of texts that are equal without white space: the longest original, then the smallest id, null last."""
    return exact_dedup.drop_exact_duplicates(docs)


def near_dedup_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each class of near duplicates: that of the smallest id, null last."""
    return probminhash.drop_near_duplicates(docs)


def packing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every piece of every text, null as empty, with its sequence and its place there; the columns are those of ``packing.pack``."""
    return packing.pack(docs)


STAGES = [
    ("quality_rules", quality_rule_stage),
    ("quality_classifier", quality_classifier_stage),
    ("exact_dedup", exact_dedup_stage),
    ("near_dedup", near_dedup_stage),
    ("best_fit_packing", packing_stage),
]

#: The classifier and the near duplicates can't be put in SQL; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The pieces of the last stage. Each stage's own tables go when its rows are written, and these
    when the next stage's are; those that the result reads stay, below ``spark.checkpoint.dir``."""
    docs, last = spark.read.parquet(f"{sf_dir}/documents.parquet"), None
    for name, stage in STAGES[:-1]:
        path = scratch_path(spark, f"stage-{name}")
        with scratch_run(spark):
            docs = written(stage(spark, docs, sf_dir), name, path)
        if last:
            remove(spark, last)
        last = path
    return STAGES[-1][1](spark, docs, sf_dir)

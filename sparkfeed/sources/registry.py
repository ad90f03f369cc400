"""Sources by name: what a user supplies as samples, held to the contract of a dataset."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession

from ..operators.splits import validate_samples

SOURCES: dict[str, Callable[..., DataFrame]] = {}


class BrokenSource(ValueError):
    """A source whose rows break the contract."""


def register_source(name: str, read: Callable[..., DataFrame]) -> None:
    """``read(spark, **options)`` gives ``(sample_id, split, features, label)``."""
    SOURCES[name] = read


def load_source(spark: SparkSession, name: str, check: bool = True, **options) -> DataFrame:
    """The rows of a source; with ``check``, only if they keep the contract."""
    if name not in SOURCES:
        raise KeyError(f"no source {name}; there are {', '.join(sorted(SOURCES)) or 'none'}")
    df = SOURCES[name](spark, **options)
    if check and (broken := validate_samples(df).limit(20).collect()):
        raise BrokenSource("; ".join(sorted(f"{r['rule']} ({r['split']})" for r in broken)))
    return df


def with_label(df: DataFrame, label: Callable[[Column], Column], key: str = "path") -> DataFrame:
    """``df`` with the label that a user's function finds in a key."""
    return df.withColumn("label", label(df[key]))

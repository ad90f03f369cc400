"""A dense index in a global order, without a one-task sort."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .scratch import written


def dense_index(df: DataFrame, order: list[Column | str], name: str = "idx", partitions: int | None = None) -> DataFrame:
    """``df`` with 0, 1, 2, ... in the given order, which must be total.

    Rows are range partitioned and sorted where they are, and written with their place in their
    partition; partition totals, a row each, then give the offset. Only that small table has an
    ordered window.
    """
    spark = df.sparkSession
    n = partitions or int(spark.conf.get("spark.sql.shuffle.partitions"))
    placed = df.repartitionByRange(n, *order).sortWithinPartitions(*order)
    low = F.monotonically_increasing_id()
    placed = written(placed.select("*", F.spark_partition_id().alias("sf_index_part"), low.bitwiseAND(F.lit((1 << 33) - 1)).alias("sf_index_at")), "index")
    totals = placed.groupBy("sf_index_part").agg(F.count("*").alias("sf_index_n"))
    before = W.orderBy("sf_index_part").rowsBetween(W.unboundedPreceding, -1)
    starts = totals.select("sf_index_part", F.coalesce(F.sum("sf_index_n").over(before), F.lit(0)).alias("sf_index_ahead"))
    return placed.join(F.broadcast(starts), "sf_index_part").select(*df.columns, (F.col("sf_index_ahead") + F.col("sf_index_at")).alias(name))


def index_by_key(df: DataFrame, order: list[Column | str], key: list[str], name: str = "idx", partitions: int | None = None) -> DataFrame:
    """The same for wide rows: only ``key`` and ``order`` are sorted and written, and the number is
    joined back. Keys must be unique, nulls among them; a repeated one is an error."""
    places = [f"sf_o{k}" for k in range(len(order))]
    slim = df.select(*key, *((F.col(o) if isinstance(o, str) else o).alias(p) for o, p in zip(order, places, strict=True)))
    each = slim.groupBy(*key).agg(F.count("*").alias("sf_n"), *(F.first(p).alias(p) for p in places))
    again = F.raise_error(F.concat(F.lit("repeated key "), F.to_json(F.struct(*key)))).cast("boolean")
    ranked = dense_index(each.where(F.when(F.col("sf_n") == 1, F.lit(True)).otherwise(again)).drop("sf_n"), places, name, partitions)
    right = ranked.select(*(F.col(k).alias(f"sf_k_{k}") for k in key), name)
    fits = df[key[0]].eqNullSafe(right[f"sf_k_{key[0]}"])
    for k in key[1:]:
        fits &= df[k].eqNullSafe(right[f"sf_k_{k}"])
    return df.join(right, fits).select(*df.columns, name)

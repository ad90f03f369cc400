"""Segmented scans: what a row learns from rows before or behind it in its series, however long.

An ordered window holds a whole series in one task. Here rows are range partitioned by series and
order, so that a long series is cut into runs, a run for each partition it touches. Windows work
within runs; runs are folded to a row each (counts, moments, or their outermost rows), a window over
that small table gives what lies ahead of each run, and it is added to the rows. A series has as many
runs as partitions at most, so neither window holds many rows.

Orders must be total within a series for results that don't depend on the partitioning.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .scratch import written

_RUN = "sf_run"


@dataclass
class Runs:
    """Rows with the number of their run, and by what they are series and in order."""

    rows: DataFrame
    by: list[str]
    order: list[Column]
    columns: list[str]

    def window(self) -> W:
        return W.partitionBy(_RUN, *self.by).orderBy(*self.order)

    def whole(self) -> W:
        return W.partitionBy(_RUN, *self.by)

    def joined(self, rows: DataFrame, folded: DataFrame) -> DataFrame:
        """``rows`` with what is known of their runs; a run's rows are together already."""
        right = folded.select(*(F.col(c).alias(f"sf_right_{c}") for c in (_RUN, *self.by)), *(c for c in folded.columns if c not in (_RUN, *self.by)))
        fits = rows[_RUN] == right[f"sf_right_{_RUN}"]
        for c in self.by:
            fits &= rows[c].eqNullSafe(right[f"sf_right_{c}"])
        return rows.join(right, fits).drop(*(f"sf_right_{c}" for c in (_RUN, *self.by)))


def runs(df: DataFrame, by: list[str], order: list[Column | str], partitions: int | None = None) -> Runs:
    """``df`` range partitioned by series and order, and written with the number of each row's run."""
    n = partitions or int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    order = [F.col(c) if isinstance(c, str) else c for c in order]
    placed = written(df.repartitionByRange(n, *map(F.col, by), *order).withColumn(_RUN, F.spark_partition_id()), "runs")
    return Runs(placed.repartitionById(n, F.col(_RUN)), by, order, df.columns)


def rank_in_series(df: DataFrame, by: list[str], order: list[Column | str], name: str = "place", size: str | None = None, partitions: int | None = None) -> DataFrame:
    """``df`` with each row's place in its series, from 0, and the ``size`` of the series if it is named."""
    r = runs(df, by, order, partitions)
    counts = r.rows.groupBy(_RUN, *by).agg(F.count("*").alias("sf_n"))
    series = W.partitionBy(*by)
    ahead = F.coalesce(F.sum("sf_n").over(series.orderBy(_RUN).rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    folded = counts.select(_RUN, *by, ahead.alias("sf_ahead"), F.sum("sf_n").over(series).alias("sf_size"))
    own = r.rows.withColumn("sf_own", F.row_number().over(r.window()) - 1)
    out = r.joined(own, folded)
    more = [F.col("sf_size").alias(size)] if size else []
    return out.select(*r.columns, (F.col("sf_ahead") + F.col("sf_own")).alias(name), *more)


def neighbours(df: DataFrame, by: list[str], order: list[Column | str], value: str, at: dict[str, int], partitions: int | None = None) -> DataFrame:
    """``df`` with, for each name of ``at``, ``value`` of the row so many places behind (before, if negative)
    in the series; null where there is none.

    Only a run's outermost rows, as many as the farthest neighbour, are known to other runs.
    """
    r = runs(df, by, order, partitions)
    back, forth = max([0, *(-k for k in at.values())]), max([0, *at.values()])
    rows = r.rows.withColumns({"sf_k": F.row_number().over(r.window()), "sf_n": F.count("*").over(r.whole()), "sf_v": F.struct(F.col(value).alias("v"))})
    outer = rows.where((F.col("sf_k") <= forth) | (F.col("sf_k") > F.col("sf_n") - back))
    part = lambda keep: F.transform(F.sort_array(F.collect_list(F.when(keep, F.struct("sf_k", "sf_v")))), lambda x: x["sf_v"])
    folded = outer.groupBy(_RUN, *by).agg(part(F.col("sf_k") > F.col("sf_n") - back).alias("tail"), part(F.col("sf_k") <= forth).alias("head"))
    series = W.partitionBy(*by).orderBy(_RUN)
    gather = lambda side, first, last: F.flatten(F.collect_list(side).over(series.rowsBetween(first, last)))
    known = folded.select(_RUN, *by, gather("tail", -max(1, back), -1).alias("sf_before"), gather("head", 1, max(1, forth)).alias("sf_behind"))
    local = {}
    for name, k in at.items():
        over = F.lag("sf_v", -k).over(r.window()) if k < 0 else F.lead("sf_v", k).over(r.window())
        local[f"sf_at_{name}"] = over
    out = r.joined(rows.withColumns(local), known)
    found = []
    for name, k in at.items():
        far = F.try_element_at("sf_before", (F.col("sf_k") + k - 1).cast("int")) if k < 0 else F.try_element_at("sf_behind", (F.col("sf_k") + k - F.col("sf_n")).cast("int"))
        outside = F.col("sf_k") + k < 1 if k < 0 else F.col("sf_k") + k > F.col("sf_n")
        found.append(F.when(outside, far["v"]).otherwise(F.col(f"sf_at_{name}")["v"]).alias(name))
    return out.select(*r.columns, *found)


def running_moments(df: DataFrame, by: list[str], order: list[Column | str], value: str, names: tuple[str, str, str] = ("n", "mean", "deviation"), partitions: int | None = None) -> DataFrame:
    """``df`` with count, mean and population deviation of ``value`` over the rows before, nulls left out.

    Runs are folded to count, sum of differences from their series' mean, and sum of squared ones, so
    that what is added up stays small beside what it tells.
    """
    r = runs(df, by, order, partitions)
    before = r.window().rowsBetween(W.unboundedPreceding, -1)
    one = r.rows.groupBy(_RUN, *by).agg(F.count(value).alias("c"), F.avg(value).alias("m"), F.var_pop(value).alias("q"))
    series = W.partitionBy(*by)
    centre = F.sum(F.col("c") * F.col("m")).over(series) / F.nullif(F.sum("c").over(series), F.lit(0))
    off = one.withColumn("centre", centre).withColumn("d", F.col("m") - F.col("centre"))
    earlier = series.orderBy(_RUN).rowsBetween(W.unboundedPreceding, -1)
    sum_of = lambda x: F.coalesce(F.sum(x).over(earlier), F.lit(0))
    folded = off.select(
        _RUN, *by, F.col("centre").alias("sf_centre"), sum_of("c").alias("sf_c"), sum_of(F.col("c") * F.col("d")).alias("sf_d"), sum_of(F.col("c") * (F.col("q") + F.col("d") * F.col("d"))).alias("sf_q")
    )
    own = r.rows.withColumns({"sf_n": F.count(value).over(before), "sf_m": F.avg(value).over(before), "sf_v": F.var_pop(value).over(before)})
    out = r.joined(own, folded)
    shift = F.coalesce(F.col("sf_m") - F.col("sf_centre"), F.lit(0.0))
    n = F.col("sf_c") + F.col("sf_n")
    total = F.col("sf_d") + F.col("sf_n") * shift
    squares = F.col("sf_q") + F.col("sf_n") * (F.coalesce("sf_v", F.lit(0.0)) + shift * shift)
    some = F.nullif(n, F.lit(0))
    # within one run the window's own figures stand, as exact as they are
    alone = F.col("sf_c") == 0
    mean = F.when(alone, F.col("sf_m")).otherwise(F.col("sf_centre") + total / some)
    variance = F.when(alone, F.col("sf_v")).otherwise(F.greatest(squares / some - (total / some) * (total / some), F.lit(0.0)))
    return out.select(*r.columns, n.alias(names[0]), mean.alias(names[1]), F.sqrt(variance).alias(names[2]))

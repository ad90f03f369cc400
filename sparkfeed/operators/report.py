"""Reports of a run, and values as JSON."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .events import unit_time_stats
from .labels import label_table


def result_rows(results: DataFrame) -> DataFrame:
    """``(metric, set, value)`` of ``results (metric, values: map of set to value)``; an empty map gives no row."""
    return results.select("metric", F.explode("values").alias("set", "value"))


def provided_results(df: DataFrame, providers: list[Callable[[DataFrame], DataFrame]]) -> DataFrame:
    """``(metric, set, value)`` of all providers; of equal metrics and sets, the later provider's."""
    rows = None
    for k, f in enumerate(providers):
        part = f(df).select("metric", "set", F.col("value").cast("string").alias("value"), F.lit(k).alias("_k"))
        rows = part if rows is None else rows.unionByName(part)
    return rows.groupBy("metric", "set").agg(F.max_by("value", "_k").alias("value"))


def build_report(samples: DataFrame, results: DataFrame, timings: DataFrame, normalization: str = "none", top: int = 5) -> dict[str, DataFrame]:
    """The tables of a report by name: ``samples`` a split, ``labels``, ``normalization``, ``results``, ``unit_times``."""
    return {
        "samples": samples.groupBy("split").agg(F.count("*").alias("n")),
        "labels": label_table(samples),
        "normalization": samples.groupBy().agg(F.lit(normalization).alias("name"), F.max(F.size("features")).alias("features")),
        "results": results.select("metric", "set", "value"),
        "unit_times": unit_time_stats(timings, "unit", "seconds", top),
    }


def write_markdown(report: dict[str, DataFrame], path: str, most: int = 1000) -> None:
    """The report as a Markdown file of the driver; a table of more than ``most`` rows says how many there are."""
    cell = lambda v: "" if v is None else str(v).replace("|", "\\|").replace("\n", " ")
    with open(path, "w", encoding="utf-8") as out:
        for name, df in report.items():
            rows = df.orderBy(*df.columns[:2]).limit(most + 1).collect()
            out.write(f"## {name}\n\n| {' | '.join(map(cell, df.columns))} |\n|{'-|' * len(df.columns)}\n")
            out.writelines(f"| {' | '.join(map(cell, r))} |\n" for r in rows[:most])
            out.write(f"\nThe first {most} of {df.count()} rows.\n\n" if len(rows) > most else "\n")


def complex_value(value: Column) -> Column:
    """``(re, im)`` as the list ``[re, im]``."""
    return F.array(value["re"], value["im"])


def bytes_value(value: Column) -> Column:
    """Each byte as the character of its number."""
    return F.decode(value, "ISO-8859-1")


def json_value(**values: Column) -> Column:
    """A JSON object of named values; null ones are left out."""
    return F.to_json(F.struct(*(v.alias(k) for k, v in values.items())))

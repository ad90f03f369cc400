"""Snapshots, results and versions."""

from __future__ import annotations

from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.scan import rank_in_series, runs
from ..functions.scratch import Scratch, written


def gather_results(parts: list[DataFrame]) -> DataFrame:
    """``(metric, value)`` of all parts; of equal metrics, the later part's."""
    all_ = None
    for k, p in enumerate(parts):
        p = p.select("metric", "value", F.lit(k).alias("_k"))
        all_ = p if all_ is None else all_.unionByName(p)
    return all_.groupBy("metric").agg(F.max_by("value", "_k").alias("value"))


def results_json(results: DataFrame) -> DataFrame:
    """One row: the results as a JSON object with sorted keys."""
    return results.agg(F.to_json(F.map_from_entries(F.sort_array(F.collect_list(F.struct("metric", "value"))))).alias("json"))


def write_results(results: DataFrame, path: str) -> None:
    """The results as one JSON object in a file below ``path``, in place of what is there."""
    results_json(results).coalesce(1).write.mode("overwrite").text(path)


def read_results(spark, path: str) -> DataFrame:
    """``(metric, value)`` of what ``write_results`` wrote."""
    rows = spark.read.option("wholetext", True).text(path).select(F.explode(F.from_json("value", "map<string,string>")))
    return rows.select(F.col("key").alias("metric"), "value")


def latest_snapshot(df: DataFrame) -> DataFrame:
    """The newest row of each ``(id, log_id)``; of ties, the largest name."""
    return df.groupBy("id", "log_id").agg(F.max(F.struct("timestamp", "name")).alias("s")).select("id", "log_id", "s.timestamp", "s.name")


def append_snapshots(df: DataFrame, path: str) -> None:
    df.write.mode("append").parquet(path)


def version_history(df: DataFrame) -> DataFrame:
    """Versions of each package, newest first; older entries named master show their place."""
    placed = rank_in_series(df, ["name"], [F.desc("commit_time"), F.col("commit_id")], "place")
    shown = F.when((F.col("place") > 0) & (F.col("message") == "master"), F.concat(F.lit("HEAD@{"), F.col("place"), F.lit("}"))).otherwise(F.col("message"))
    return placed.withColumn("version", shown)


def package_list(df: DataFrame) -> DataFrame:
    return df.groupBy("name").agg(F.min(F.struct((-F.unix_micros(F.col("commit_time").cast("timestamp"))).alias("t"), "commit_id", "message", "commit_time")).alias("s")).select("name", "s.commit_id", "s.message", "s.commit_time").orderBy("name")


def _first_behind(df: DataFrame, by: list[str], order: list[str], value: str, name: str) -> DataFrame:
    """``df`` with the first known ``value`` at or behind each row of its series."""
    r = runs(df, by, order)
    behind = F.first(value, ignorenulls=True).over(r.window().rowsBetween(0, W.unboundedFollowing))
    folded = r.rows.groupBy("sf_run", *by).agg(F.min_by(value, F.when(F.col(value).isNotNull(), F.struct(*order))).alias("sf_first"))
    later = F.first("sf_first", ignorenulls=True).over(W.partitionBy(*by).orderBy("sf_run").rowsBetween(1, W.unboundedFollowing))
    known = folded.select("sf_run", *by, later.alias("sf_later"))
    return r.joined(r.rows.withColumn("sf_here", behind), known).select(*r.columns, F.coalesce("sf_here", "sf_later").alias(name))


def thin_events(df: DataFrame, by: str, order: str, ts: str, interval: int, time_interval: float) -> DataFrame:
    """Every ``interval``-th row of a series, if ``time_interval`` has passed since the last one kept,
    and the last row of one that ends between two of them.

    Each choice depends on the one before, but not on more of the past. So a series is cut into runs,
    and each run is a function of the last kept row before it: it tells which of its rows would be
    kept first, for each of those that may be (they lie within ``time_interval`` of the run's
    beginning), and then which last. These pointers, from run to run, are composed by doubling: with
    2, 4, 8, ... runs at a step, all runs that a series passes through are found in as many rounds as
    the logarithm of their number. Then each run is walked from its own first row.

    Rows are in the order of ``ts``, then ``order``; a time that is null, NaN or infinite is never kept.
    """
    scratch = Scratch(df.sparkSession, "thin")
    small = df.select(F.col(by).alias("s"), F.col(order).alias("o"), F.col(ts).alias("x"), F.col(ts).cast("double").alias("t"))
    placed = rank_in_series(small, ["s"], [F.col("x").asc_nulls_last(), F.col("o").asc_nulls_last()], "k", "size")
    ticks = scratch.written(placed.where((F.col("k") + 1) % interval == 0).where(F.col("t").isNotNull() & ~F.isnan("t") & (F.abs("t") < float("inf"))).select("s", "k", "t"), "ticks")
    cut = runs(ticks, ["s"], ["k"])

    def reach(k, t):
        """For each row the next to be kept after it, its own number where that is beyond the run."""
        ahead = np.maximum(np.searchsorted(t, t + time_interval, side="left"), np.arange(len(t)) + 1)
        return np.where(ahead < len(t), ahead, np.arange(len(t)))

    def entries(run: pa.Table) -> pa.Table:
        k, t = (run.column(c).to_numpy() for c in ("k", "t"))
        at = np.argsort(k)
        k, t = k[at], t[at]
        last = reach(k, t)
        while (further := last[last]).tolist() != last.tolist():
            last = further
        may = np.concatenate([[True], t[:-1] <= t[0] + time_interval])
        n = int(may.sum())
        same = run.slice(0, 1).take(pa.array(np.zeros(n, np.int64)))
        return pa.table({"run": same.column("sf_run"), "s": same.column("s"), "k": k[may], "t": t[may], "wants": t[last[may]] + time_interval})

    kind = small.schema["s"].dataType.simpleString()
    nodes = scratch.written(cut.rows.groupBy("sf_run", "s").applyInArrow(entries, f"run int, s {kind}, k bigint, t double, wants double"), "entries")
    # the first entry, of a later run, at or after the time that each wants
    probes = nodes.select("s", F.col("wants").alias("t"), F.lit(0).alias("probe"), F.col("k"), F.lit(None).cast("bigint").alias("entry"), "run")
    found = _first_behind(probes.unionByName(nodes.select("s", "t", F.lit(1).alias("probe"), "k", F.col("k").alias("entry"), "run")), ["s"], ["t", "probe", "k"], "entry", "next")
    steps = [scratch.written(found.where("probe = 0 AND next IS NOT NULL").select("s", "k", "next"), "step-0")]
    most = nodes.groupBy("s").agg(F.count_distinct("run").alias("n")).agg(F.max("n")).first()[0] or 1
    while 2 ** len(steps) < most:
        far = steps[-1]
        steps.append(scratch.written(far.alias("a").join(far.alias("b"), F.expr("a.s <=> b.s AND a.next = b.k")).select("a.s", "a.k", "b.next"), f"step-{len(steps)}"))
    true = nodes.groupBy("s").agg(F.min("k").alias("k"))
    for step in reversed(steps):
        reached = true.alias("a").join(step.alias("b"), F.expr("a.s <=> b.s AND a.k = b.k")).select("a.s", F.col("b.next").alias("k"))
        true = scratch.written(true.unionByName(reached), "true")
    entry = true.alias("a").join(nodes.alias("b"), F.expr("a.s <=> b.s AND a.k = b.k")).select(F.col("b.run").alias("sf_run"), "b.s", F.col("b.k").alias("entry"))

    def walk(run: pa.Table) -> pa.Table:
        k, t = (run.column(c).to_numpy() for c in ("k", "t"))
        order_, first = np.argsort(k), run.column("entry")[0].as_py()
        k, t = k[order_], t[order_]
        ahead, i, kept = reach(k, t), int(np.searchsorted(k, first)), []
        while not kept or ahead[kept[-1]] != kept[-1]:
            kept.append(i)
            i = int(ahead[i])
        return pa.table({"s": run.column("s").take(pa.array(np.zeros(len(kept), np.int64))), "k": k[kept]})

    rows = cut.rows.join(entry.withColumnsRenamed({"sf_run": "r", "s": "z"}), (F.col("sf_run") == F.col("r")) & F.col("s").eqNullSafe(F.col("z"))).select("sf_run", "s", "k", "t", "entry")
    kept = rows.groupBy("sf_run", "s").applyInArrow(walk, f"s {kind}, k bigint")
    ends = placed.where((F.col("k") == F.col("size") - 1) & (F.col("size") % interval != 0)).select("s", "k")
    chosen = written(kept.unionByName(ends), "thinned")
    scratch.drop()
    whole = rank_in_series(df, [by], [F.col(ts).asc_nulls_last(), F.col(order).asc_nulls_last()], "sf_k")
    return whole.join(chosen.withColumnsRenamed({"s": "sf_s", "k": "sf_p"}), F.col(by).eqNullSafe(F.col("sf_s")) & (F.col("sf_k") == F.col("sf_p")), "left_semi").drop("sf_k")


def merge_model_results(parts: list[DataFrame]) -> DataFrame:
    """Models of several runs in one table, numbered on; each part's numbers stay in order.

    How far a part's numbers move follows from the largest number of each part before, a small table;
    parts without rows move nothing.
    """
    tagged = reduce(DataFrame.unionByName, (p.withColumn("sf_part", F.lit(k)) for k, p in enumerate(parts)))
    most = tagged.groupBy("sf_part").agg((F.max("model_pos") + 1).alias("sf_n"))
    before = W.orderBy("sf_part").rowsBetween(W.unboundedPreceding, -1)
    ahead = most.select("sf_part", F.coalesce(F.sum("sf_n").over(before), F.lit(0)).alias("sf_ahead"))
    kind = parts[0].schema["model_pos"].dataType
    moved = tagged.join(F.broadcast(ahead), "sf_part").withColumn("model_pos", (F.col("model_pos") + F.col("sf_ahead")).cast(kind))
    return moved.select(parts[0].columns)

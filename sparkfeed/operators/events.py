"""Run events, logs, worker health and times."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.scan import neighbours, rank_in_series, running_moments

LEVELS = {"DEBUG": 10, "INFO": 20, "WARNING": 30, "ERROR": 40, "CRITICAL": 50}


def filter_logs(df: DataFrame, level: str, session: str | None = None, node: str | None = None) -> DataFrame:
    """Rows of at least a level; errors and worse always."""
    shown = [k for k, v in LEVELS.items() if v >= min(LEVELS[level], LEVELS["ERROR"])]
    out = df.where(F.col("levelname").isin(shown))
    out = out.where(F.col("session") == session) if session is not None else out
    return out.where(F.col("node") == node) if node is not None else out


def slice_events(df: DataFrame, session=None, instance=None, names: list[str] | None = None, after: float | None = None, before: float | None = None) -> DataFrame:
    """Events of an open interval; bounds themselves are outside."""
    for column, value in (("session", session), ("instance", instance)):
        df = df.where(F.col(column) == value) if value is not None else df
    df = df.where(F.col("name").isin(names)) if names is not None else df
    df = df.where(F.col("time") > after) if after is not None else df
    return df.where(F.col("time") < before) if before is not None else df


def events_to_series(df: DataFrame, meta: list[str] | None = None) -> DataFrame:
    """``(session, instance, name, t, height, k, meta)``: steps that stand for the events, t from the
    session's start; ``meta`` is a JSON object of the given other columns, by default of all."""
    start = df.groupBy("session").agg(F.min("time").alias("_start"))
    others = [c for c in df.columns if c not in ("session", "instance", "name", "type", "time", "height")] if meta is None else meta
    rows = df.join(start, "session").withColumns({"_t": F.col("time") - F.col("_start"), "_h": F.coalesce("height", F.lit(1.0)), "_meta": F.to_json(F.struct(*others)) if others else F.lit("{}")})
    zero = F.lit(0.0)
    steps = F.when(F.col("type") == "begin", F.array(zero, F.col("_h"))).when(F.col("type") == "end", F.array(F.col("_h"), zero)).otherwise(F.array(zero, F.col("_h"), zero))
    return rows.select("session", "instance", "name", F.col("_t").alias("t"), F.col("_meta").alias("meta"), F.posexplode(steps).alias("k", "height"))


def event_extras(df: DataFrame, props: str, fixed: list[str]) -> DataFrame:
    """``df`` with ``extras`` (a map) and ``clashes``: extra keys that shadow fixed ones."""
    parsed = df.withColumn("extras", F.from_json(props, "map<string,string>"))
    return parsed.withColumn("clashes", F.array_intersect(F.map_keys("extras"), F.array(*map(F.lit, fixed))))


def event_profile(df: DataFrame) -> DataFrame:
    """``(session, instance, details)``: for each name its count, first and last time, names in order."""
    one = df.groupBy("session", "instance", "name").agg(F.count("*").alias("n"), F.min("time").alias("first"), F.max("time").alias("last"))
    return one.groupBy("session", "instance").agg(F.sort_array(F.collect_set(F.struct("name", "n", "first", "last"))).alias("details"), F.min("first").alias("first"), F.max("last").alias("last"))


def cap_series(df: DataFrame, most: int = 600) -> DataFrame:
    """Rows of series with at most ``most`` points, and first and last time alone of the others.

    Counts are a small table; only they are joined back, so no window holds a long series.
    """
    counts = df.groupBy("session", "instance", "name").agg(F.count("*").alias("n"), F.min("time").alias("lo"), F.max("time").alias("hi"))
    few = df.join(counts.where(F.col("n") <= most), ["session", "instance", "name"]).select("session", "instance", "name", "time", F.lit(False).alias("collapsed"))
    many = counts.where(F.col("n") > most).select("session", "instance", "name", F.explode(F.array("lo", "hi")).alias("time"), F.lit(True).alias("collapsed"))
    return few.unionByName(many)


def expire_sessions(df: DataFrame, ts: str, now: float, threshold: float) -> tuple[DataFrame, DataFrame]:
    """Rows of sessions whose newest row is no older than ``threshold``, and the others."""
    old = df.groupBy("session").agg(F.max(ts).alias("_last")).where(F.lit(now) - F.col("_last") > threshold).select("session")
    return df.join(old, "session", "left_anti"), df.join(old, "session", "left_semi")


def iteration_deltas(df: DataFrame) -> DataFrame:
    """``delta``: time since the worker's row before; null for its first. A worker's rows may be in any number of tasks."""
    near = neighbours(df, ["worker"], ["ts", "id"], "ts", {"sf_last": -1})
    return near.withColumn("delta", F.col("ts") - F.col("sf_last")).drop("sf_last")


def aligned_timings(df: DataFrame, period: int = 100) -> DataFrame:
    """Each worker's last ``period`` points, from the latest of their first times on; workers whose
    last point is before that are left out."""
    last = rank_in_series(df, ["worker"], [F.desc("ts"), F.desc("id")], "_k").where(F.col("_k") < period)
    ends = last.groupBy("worker").agg(F.min("ts").alias("_first"), F.max("ts").alias("_last"))
    start = ends.agg(F.max("_first").alias("_start"))
    kept = ends.crossJoin(F.broadcast(start)).where("_last > _start").select("worker", "_start")
    return last.join(kept, "worker").where("ts >= _start").drop("_k", "_start")


def latest_status(df: DataFrame, now: float, ttl: float = 60.0) -> DataFrame:
    """The newest row of each run, but for runs silent for longer than ``ttl``; of ties, the largest id."""
    newest = df.groupBy("run_id").agg(F.max(F.struct("ts", "id", "status")).alias("s"))
    return newest.select("run_id", "s.ts", "s.id", "s.status").where(F.lit(now) - F.col("ts") <= ttl)


def job_timeouts(df: DataFrame, floor_s: float = 120.0) -> DataFrame:
    """``limit`` from a worker's earlier jobs (mean and three deviations, once there are three), and ``late``.

    A job without a duration counts for none of them. A worker's jobs may be in any number of tasks.
    """
    seen = running_moments(df, ["worker"], ["ts", "id"], "duration_s", ("sf_n", "sf_mean", "sf_dev"))
    limit = F.greatest(F.col("sf_mean") + 3 * F.col("sf_dev"), F.lit(floor_s))
    out = seen.withColumn("limit", F.when(F.col("sf_n") >= 3, limit)).drop("sf_n", "sf_mean", "sf_dev")
    return out.withColumn("late", F.coalesce(F.col("duration_s") > F.col("limit"), F.lit(False)))


def unit_time_stats(df: DataFrame, by: str, seconds: str, top: int = 5) -> DataFrame:
    """The ``top`` units by time with their share, and a row for all."""
    each = df.groupBy(F.col(by).cast("string").alias("unit")).agg(F.sum(seconds).alias("seconds"))
    total = each.agg(F.sum("seconds").alias("_all"))
    best = each.crossJoin(F.broadcast(total)).select("unit", "seconds", (100 * F.col("seconds") / F.col("_all")).alias("pct")).orderBy(F.desc("seconds"), "unit").limit(top)
    return best.unionByName(total.select(F.lit("all").alias("unit"), F.col("_all").alias("seconds"), F.lit(100.0).alias("pct")))


def efficiency(df: DataFrame, seconds: str, wall: str) -> DataFrame:
    return df.groupBy("run_id").agg((F.sum(seconds) / F.max(wall)).alias("efficiency"))


def worker_health(df: DataFrame) -> DataFrame:
    """Online workers' mean jobs and sample deviation, a warning for those far below, power tiers, and how many are online and not."""
    online = df.where("state <> 'Offline'").agg(F.avg("jobs").alias("mean_jobs"), F.stddev_samp("jobs").alias("sigma"), F.greatest(F.max("power"), F.lit(1.0)).alias("_top"))
    totals = df.agg(F.count_if(F.col("state") != "Offline").alias("online"), F.count_if(F.col("state") == "Offline").alias("offline"))
    rows = df.crossJoin(F.broadcast(online)).crossJoin(F.broadcast(totals))
    slow = (F.col("state") == "Working") & (F.col("jobs") < F.col("mean_jobs") - 2 * F.col("sigma"))
    share = F.col("power") / F.col("_top")
    return rows.select("worker", "state", "jobs", "mean_jobs", "sigma", F.coalesce(slow, F.lit(False)).alias("warning"), F.when(share >= 0.7, "high").when(share >= 0.4, "middle").otherwise("low").alias("tier"), "online", "offline")


def hung_workers(workers: DataFrame, jobs: DataFrame) -> DataFrame:
    return workers.join(jobs.select("worker").distinct(), "worker", "left_anti")


def micro_batches(df: DataFrame, size: int, tick: str) -> DataFrame:
    """``(tick, batch, n)``: what arrives in a tick, cut into batches of ``size`` in order of arrival."""
    placed = rank_in_series(df.select(F.window("ts", tick)["start"].alias("tick"), "ts", "event_id"), ["tick"], ["ts", "event_id"], "_k")
    return placed.groupBy("tick", F.floor(F.col("_k") / size).alias("batch")).agg(F.count("*").alias("n"))


def liveness(df: DataFrame, key: str, ttl: str) -> DataFrame:
    """``(key, first, last, beats)``: spans in which a run was never silent for ``ttl``."""
    spans = df.groupBy(key, F.session_window("ts", ttl)).agg(F.min("ts").alias("first"), F.max("ts").alias("last"), F.count("*").alias("beats"))
    return spans.select(key, "first", "last", "beats")

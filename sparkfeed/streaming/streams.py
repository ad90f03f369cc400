"""Streams of events, heartbeats, logs and samples."""

from __future__ import annotations

import math

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupStateTimeout

from ..operators import normalize
from ..operators.events import filter_logs


def event_profile(stream: DataFrame, window: str = "1 hour", watermark: str = "1 day") -> DataFrame:
    """Count, first and last time of each instance's events of a name in a window; append mode."""
    late = stream.withWatermark("ts", watermark)
    out = late.groupBy(F.window("ts", window).alias("w"), "instance", "name").agg(F.count("*").alias("n"), F.min("ts").alias("first"), F.max("ts").alias("last"))
    return out.select(F.col("w.start").alias("start"), "instance", "name", "n", "first", "last")


def liveness(stream: DataFrame, key: str, ttl: str = "60 seconds", watermark: str = "5 minutes") -> DataFrame:
    """Spans in which a run was never silent for ``ttl``; a span comes out when its end is certain."""
    spans = stream.withWatermark("ts", watermark).groupBy(key, F.session_window("ts", ttl).alias("w")).agg(F.count("*").alias("beats"))
    return spans.select(key, F.col("w.start").alias("first"), F.col("w.end").alias("end"), "beats")


def log_tail(stream: DataFrame, level: str, watermark: str = "10 minutes", keys: tuple[str, ...] = ("id",)) -> DataFrame:
    """New log rows of at least a level, each once even if it is sent again within the watermark."""
    return filter_logs(stream, level).withWatermark("ts", watermark).dropDuplicatesWithinWatermark(list(keys))


def fit_stats_stream(stream: DataFrame, path: str, checkpoint: str, features: str = "features"):
    """Statistics of each micro-batch as a file of its own number, so a batch that is run again
    replaces itself; ``merged_stats`` reads them all."""

    def save(batch: DataFrame, number: int) -> None:
        normalize.fit_stats(batch, features, where=None).write.mode("overwrite").parquet(f"{path}/batch={number}")

    return stream.writeStream.foreachBatch(save).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def merged_stats(spark, path: str) -> DataFrame:
    return normalize.merge_stats(spark.read.parquet(path).drop("batch"))


def micro_batches(stream: DataFrame, tick: str = "1 second", watermark: str = "1 minute") -> DataFrame:
    """What arrives in each tick; batches of a size are cut from it downstream."""
    slots = stream.withWatermark("ts", watermark).groupBy(F.window("ts", tick).alias("w")).agg(F.count("*").alias("n"))
    return slots.select(F.col("w.start").alias("tick"), "n")


def size_or_time_batches(stream: DataFrame, size: int, wait: str = "100 milliseconds", key: str = "loader") -> DataFrame:
    """``(key, batch, pos, id, payload)``: rows ``(key, id, payload)`` of each loader in batches of
    ``size``, or of what has come when ``wait`` has passed since the first of them; append mode.

    The state of a loader is the rows of its unfinished batch, so at most ``size`` of them. A timer
    fires at the next trigger, so batches may wait longer than ``wait`` but never less.
    """
    value, _, unit = wait.partition(" ")
    millis = int(float(value) * {"milliseconds": 1, "seconds": 1000, "minutes": 60_000}[unit])

    def follow(k, frames, state):
        number, ids, payloads = state.get if state.exists else (0, [], [])
        ids, payloads = list(ids), list(payloads)
        full = []
        if state.hasTimedOut:
            full, ids, payloads = [(ids, payloads)], [], []
        else:
            for frame in frames:
                for i, p in zip(frame["id"], frame["payload"], strict=True):
                    ids.append(int(i))
                    payloads.append(p)
                    if len(ids) == size:
                        full.append((ids, payloads))
                        ids, payloads = [], []
        for some, data in full:
            if some:
                yield pd.DataFrame({"key": k[0], "batch": number, "pos": range(len(some)), "id": some, "payload": data})
                number += 1
        state.update((number, ids, payloads))
        if ids:
            state.setTimeoutDuration(millis)

    rows = stream.select(F.col(key).cast("string").alias("key"), F.col("id").cast("bigint").alias("id"), F.col("payload").cast("string").alias("payload"))
    return rows.groupBy("key").applyInPandasWithState(follow, "key string, batch bigint, pos bigint, id bigint, payload string", "number bigint, ids array<bigint>, payloads array<string>", "append", GroupStateTimeout.ProcessingTimeTimeout)


def job_timeouts(stream: DataFrame, floor_s: float = 120.0) -> DataFrame:
    """``(worker, ts, id, duration_s, limit, late)`` of jobs as they end; append mode.

    A worker's state is the number, mean and squared deviations of its jobs so far. Jobs of a
    micro-batch count in order of time; those of later micro-batches after them. A worker's jobs of
    a micro-batch are in memory at once.
    """

    def follow(key, frames, state):
        n, mean, m2 = state.get if state.exists else (0, 0.0, 0.0)
        jobs = pd.concat(list(frames)).sort_values(["ts", "id"])
        limits, late = [], []
        for d in jobs["duration_s"]:
            limit = max(mean + 3 * math.sqrt(m2 / n), floor_s) if n >= 3 else None
            limits.append(limit)
            late.append(limit is not None and bool(d > limit))
            if not pd.isna(d):
                n += 1
                step = d - mean
                mean += step / n
                m2 += step * (d - mean)
        state.update((n, mean, m2))
        yield pd.DataFrame({"worker": jobs["worker"], "ts": jobs["ts"], "id": jobs["id"], "duration_s": jobs["duration_s"], "limit": pd.array(limits, "Float64"), "late": late})

    jobs = stream.select(F.col("worker").cast("string").alias("worker"), "ts", F.col("id").cast("bigint").alias("id"), F.col("duration_s").cast("double").alias("duration_s"))
    schema = "worker string, ts timestamp, id bigint, duration_s double, limit double, late boolean"
    return jobs.groupBy("worker").applyInPandasWithState(follow, schema, "n bigint, mean double, m2 double", "append", GroupStateTimeout.NoTimeout)

"""Streams with state in event time, and sinks that a restart leaves as they are.

The state API needs Spark's RocksDB state store, which ``use_state_store`` asks the session for.
What arrives out of order, but not behind the watermark, waits in the state until the watermark has
passed it, and is then taken in order; so results don't depend on the order of arrival, and equal
those of the batch twins.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator
from contextlib import contextmanager

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor
from pyspark.sql.streaming.query import StreamingQuery

from ..functions.scan import neighbours
from ..functions.scratch import remove
from ..operators import normalize

_PROVIDER = "spark.sql.streaming.stateStore.providerClass"
ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def use_state_store(spark: SparkSession) -> None:
    spark.conf.set(_PROVIDER, ROCKS)


@contextmanager
def state_store(spark: SparkSession) -> Iterator[None]:
    """The same for streams that start within; the session's own store is set again at the end."""
    before = spark.conf.get(_PROVIDER)
    use_state_store(spark)
    try:
        yield
    finally:
        spark.conf.set(_PROVIDER, before)


class InOrder(StatefulProcessor):
    """Takes a key's rows in order of time, as soon as the watermark has passed them.

    The state is the rows that still wait, no more than come within the watermark's delay, and what
    ``step`` and ``rest`` remember. Both give rows of the output.
    """

    ROWS = "at bigint, id bigint, value double"
    KNOWN = "at bigint"

    def init(self, handle) -> None:
        self.handle = handle
        self.waiting = handle.getListState("waiting", self.ROWS)
        self.known = handle.getValueState("known", self.KNOWN)

    def step(self, key, row: tuple, known: tuple | None) -> tuple[list[tuple], tuple]:
        raise NotImplementedError

    def rest(self, key, known: tuple | None, now: int) -> tuple[list[tuple], tuple | None, int | None]:
        """What is due by ``now`` without a row, what is known then, and when to ask again."""
        return [], known, None

    def frame(self, rows: list[tuple]) -> pd.DataFrame:
        raise NotImplementedError

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        new = []
        for f in rows:
            new += [(int(a), int(i), None if pd.isna(v) else float(v)) for a, i, v in zip(f["at"], f["id"], f["value"], strict=True)]
        if new:
            self.waiting.appendList(new)
            self.handle.registerTimer(min(r[0] for r in new) // 1000 + 1)
        yield from ()

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        now = timerValues.getCurrentWatermarkInMs() * 1000
        known = self.known.get() if self.known.exists() else None
        rows = sorted((tuple(r) for r in self.waiting.get()), key=lambda r: (r[0], r[1]))
        due, later = [r for r in rows if r[0] <= now], [r for r in rows if r[0] > now]
        out = []
        for row in due:
            silent, known, _ = self.rest(key, known, row[0] - 1)
            made, known = self.step(key, row, known)
            out += silent + made
        made, known, ask = self.rest(key, known, now)
        out += made
        if due:
            self.waiting.clear()
            if later:
                self.waiting.put(later)
        if known is not None:
            self.known.update(known)
        elif self.known.exists():
            self.known.clear()
        for at in (later[0][0] // 1000 + 1 if later else None, ask // 1000 + 1 if ask is not None else None):
            if at is not None and at * 1000 > now:
                self.handle.registerTimer(at)
        if out:
            yield self.frame([(key[0], *r) for r in out])

    def close(self) -> None:
        pass


def _prepared(stream: DataFrame, key: str, ts: str, delay: str, id_col: str | None, value: str | None) -> DataFrame:
    late = stream.withWatermark(ts, delay).where(F.col(ts).isNotNull())
    number = F.col(id_col).cast("bigint") if id_col else F.lit(0).cast("bigint")
    measure = F.col(value).cast("double") if value else F.lit(None).cast("double")
    return late.select(F.col(key).cast("string").alias("key"), ts, F.unix_micros(F.col(ts).cast("timestamp")).alias("at"), number.alias("id"), measure.alias("value"))


class _Changes(InOrder):
    """``known``: the last beat, and 1 if its silence has been told."""

    KNOWN = "at bigint, told int"

    def __init__(self, ttl: int, forget: int | None):
        self.ttl, self.forget = ttl, forget

    def rest(self, key, known, now):
        if known is None:
            return [], None, None
        at, told = known
        end = at + self.ttl
        if end > now:
            return [], known, end
        out = [] if told else [("dropped", end)]
        if self.forget is None:
            return out, (at, 1), None
        return (out, None, None) if end + self.forget <= now else (out, (at, 1), end + self.forget)

    def step(self, key, row, known):
        return ([("revived", row[0])] if known is not None and known[1] else []), (row[0], 0)

    def frame(self, rows):
        return pd.DataFrame(rows, columns=["key", "kind", "at"])


def _micros(span: str) -> int:
    value, _, unit = span.partition(" ")
    return int(float(value) * {"millisecond": 1000, "second": 10**6, "minute": 60 * 10**6, "hour": 3600 * 10**6, "day": 86400 * 10**6}[unit.rstrip("s")])


def status_changes(stream: DataFrame, key: str, ttl: str = "60 seconds", delay: str = "5 minutes", ts: str = "ts", forget: str | None = "7 days") -> DataFrame:
    """``(key, kind, at)``: ``dropped`` when a run has been silent for ``ttl``, ``revived`` with its next
    beat. Timers in event time tell a silence that no further beat ends. A run that stays away for
    ``forget`` more leaves the state, so that it doesn't grow with all runs there ever were; a later
    beat is then a new run's first."""
    rows = _prepared(stream, key, ts, delay, None, None).groupBy("key")
    out = rows.transformWithStateInPandas(_Changes(_micros(ttl), _micros(forget) if forget else None), "key string, kind string, at bigint", "Append", "EventTime")
    return out.select("key", "kind", F.timestamp_micros("at").alias("at"))


def status_changes_batch(df: DataFrame, key: str, ttl: str = "60 seconds", until: int | None = None, ts: str = "ts", forget: str | None = "7 days") -> DataFrame:
    """The same of a whole table, silences that end by ``until`` (microseconds; by default all) among them."""
    beats = df.where(F.col(ts).isNotNull()).select(F.col(key).cast("string").alias("key"), F.unix_micros(F.col(ts).cast("timestamp")).alias("at")).distinct()
    near = neighbours(beats, ["key"], ["at"], "at", {"last": -1, "next": 1})
    end = F.col("at") + _micros(ttl)
    told = F.lit(True) if until is None else end <= until
    dropped = near.where((F.coalesce(F.col("next") > end, F.lit(True))) & told).select("key", F.lit("dropped").alias("kind"), F.timestamp_micros(end).alias("at"))
    away = F.col("at") - F.col("last")
    back = (away > _micros(ttl)) & (away <= _micros(ttl) + _micros(forget)) if forget else away > _micros(ttl)
    revived = near.where(back).select("key", F.lit("revived").alias("kind"), F.timestamp_micros("at").alias("at"))
    return dropped.unionByName(revived if until is None else revived.where(F.unix_micros("at") <= until))


class _Timeouts(InOrder):
    """``known``: number, mean and squared deviations of a worker's jobs so far."""

    KNOWN = "n bigint, mean double, m2 double"

    def __init__(self, floor_s: float):
        self.floor_s = floor_s

    def step(self, key, row, known):
        n, mean, m2 = known or (0, 0.0, 0.0)
        at, job, d = row
        limit = max(mean + 3 * math.sqrt(m2 / n), self.floor_s) if n >= 3 else None
        late = limit is not None and d is not None and d > limit
        if d is not None:
            n, off = n + 1, d - mean
            mean += off / n
            m2 += off * (d - mean)
        return [(at, job, d, limit, late)], (n, mean, m2)

    def frame(self, rows):
        f = pd.DataFrame(rows, columns=["worker", "at", "id", "duration_s", "limit", "late"])
        return f.astype({"duration_s": "Float64", "limit": "Float64"})


def job_timeouts(stream: DataFrame, floor_s: float = 120.0, delay: str = "10 minutes", ts: str = "ts") -> DataFrame:
    """``(worker, ts, id, duration_s, limit, late)`` of jobs in order of time, whatever the order in
    which they arrive within ``delay``; as the batch ``events.job_timeouts``."""
    rows = _prepared(stream, "worker", ts, delay, "id", "duration_s").groupBy("key")
    out = rows.transformWithStateInPandas(_Timeouts(floor_s), "worker string, at bigint, id bigint, duration_s double, limit double, late boolean", "Append", "EventTime")
    return out.select("worker", F.timestamp_micros("at").alias("ts"), "id", "duration_s", "limit", "late")


# Sinks. Each writes what belongs to a micro-batch under its number, so that a batch which is run
# again after a failure replaces what it left.
def _start(stream: DataFrame, f: Callable[[DataFrame, int], None], checkpoint: str, **trigger) -> StreamingQuery:
    return stream.writeStream.foreachBatch(f).option("checkpointLocation", checkpoint).trigger(**(trigger or {"availableNow": True})).start()


def _read(spark: SparkSession, path: str) -> DataFrame | None:
    """The table of all batches so far, with the number of each as ``batch``; None before the first."""
    hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    there = hadoop.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(hadoop)
    return spark.read.option("basePath", path).parquet(path) if there else None


def split_late(stream: DataFrame, path: str, checkpoint: str, delay: str, handle: Callable[[DataFrame, int], None], ts: str = "ts", **trigger) -> StreamingQuery:
    """Hands each micro-batch's rows to ``handle`` but for late ones, which are kept by themselves.

    A row is late if its time is not after the watermark: the greatest time of the batches before,
    less ``delay``. Spark's own operators leave such rows out without a word. Here they are a table,
    ``late_rows``, whose counts are exact. Each batch writes its greatest time under its number.
    """

    def run(batch: DataFrame, number: int) -> None:
        spark, batch = batch.sparkSession, batch.persist()
        seen = _read(spark, f"{path}/seen")
        mark = seen.where(F.col("batch") < number).agg(F.max("most")).first()[0] if seen is not None else None
        time = F.unix_micros(F.col(ts).cast("timestamp"))
        late = F.coalesce(time <= mark - _micros(delay), F.lit(False)) if mark is not None else F.lit(False)
        batch.where(late).write.mode("overwrite").parquet(f"{path}/late/batch={number}")
        batch.agg(F.max(time).alias("most")).write.mode("overwrite").parquet(f"{path}/seen/batch={number}")
        handle(batch.where(~late), number)
        batch.unpersist()

    return _start(stream, run, checkpoint, **trigger)


def late_rows(spark: SparkSession, path: str) -> DataFrame:
    """The rows that came too late, with the number of the batch in which they did."""
    return _read(spark, f"{path}/late")


def late_rows_batch(df: DataFrame, batch: str, delay: str, ts: str = "ts") -> DataFrame:
    """The rows of a whole table that ``split_late`` would find late, if ``batch`` numbers the batches
    in which they arrive. Only the greatest time of each batch is put in order."""
    time = F.unix_micros(F.col(ts).cast("timestamp"))
    most = df.groupBy(batch).agg(F.max(time).alias("sf_most"))
    marks = most.select(batch, F.max("sf_most").over(W.orderBy(batch).rowsBetween(W.unboundedPreceding, -1)).alias("sf_mark"))
    return df.join(marks, batch).where(time <= F.col("sf_mark") - _micros(delay)).select(*df.columns)


#: Batches after whose statistics those so far are written as one table.
COMPACT = 16


def stats_until(spark: SparkSession, path: str, number: int) -> DataFrame:
    """Statistics of all rows up to a batch: the last table of merged ones before it, and what came since."""
    whole, each = _read(spark, f"{path}/merged"), _read(spark, f"{path}/stats")
    done = whole.where(F.col("batch") <= number).agg(F.max("batch")).first()[0] if whole is not None else None
    since = each.where(F.col("batch").between(-1 if done is None else done + 1, number)).drop("batch")
    return normalize.merge_stats(*([whole.where(F.col("batch") == done).drop("batch")] if done is not None else []), since)


def normalize_stream(stream: DataFrame, name: str, path: str, checkpoint: str, features: str = "features", **trigger) -> StreamingQuery:
    """Learns statistics from a stream and normalises it by them, each batch by those up to itself.

    Rows go to ``normalized_rows`` with the ``version`` of the statistics, the batch's number, by
    which ``stats_until`` gives them again. A batch that is run again replaces its own statistics and
    rows, so they count once. Every ``COMPACT`` batches statistics are merged into one table.
    """

    def run(batch: DataFrame, number: int) -> None:
        spark, batch = batch.sparkSession, batch.persist()
        normalize.fit_stats(batch, features, where=None).write.mode("overwrite").parquet(f"{path}/stats/batch={number}")
        stats = stats_until(spark, path, number)
        out = normalize.normalize(batch, name, stats, features).withColumn("version", F.lit(number).cast("bigint"))
        out.write.mode("overwrite").parquet(f"{path}/rows/batch={number}")
        if (number + 1) % COMPACT == 0:
            stats.write.mode("overwrite").parquet(f"{path}/merged/batch={number}")
        batch.unpersist()

    return _start(stream, run, checkpoint, **trigger)


def normalized_rows(spark: SparkSession, path: str) -> DataFrame:
    return _read(spark, f"{path}/rows").drop("batch")


def send_results(stream: DataFrame, path: str, checkpoint: str, cid: str = "cid", **trigger) -> StreamingQuery:
    """Results ``(cid, ...)`` of requests, each id once, however often its request or batch is sent.

    A batch's results are files under its number. Ids that an earlier batch has answered, and
    repeats in a batch, are left out; null ids can't be sent back and are left out too.
    """

    def run(batch: DataFrame, number: int) -> None:
        before = _read(batch.sparkSession, f"{path}/results")
        new = batch.where(F.col(cid).isNotNull()).dropDuplicates([cid])
        if before is not None:
            new = new.join(before.where(F.col("batch") < number).select(cid), cid, "left_anti")
        new.write.mode("overwrite").parquet(f"{path}/results/batch={number}")

    return _start(stream, run, checkpoint, **trigger)


def results(spark: SparkSession, path: str) -> DataFrame:
    return _read(spark, f"{path}/results").drop("batch")


def forget_batches(spark: SparkSession, path: str, before: int) -> None:
    """Removes statistics by batch that a merged table before ``before`` holds already."""
    whole = _read(spark, f"{path}/merged")
    done = whole.where(F.col("batch") < before).agg(F.max("batch")).first()[0] if whole is not None else None
    if done is not None:
        each = _read(spark, f"{path}/stats")
        for r in each.where(F.col("batch") <= done).select("batch").distinct().collect():
            remove(spark, f"{path}/stats/batch={r['batch']}")

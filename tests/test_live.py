"""Streams in event time, late rows, statistics and results that survive a restart."""

import random

import pytest
from pyspark.sql import functions as F

from sparkfeed.operators import events, normalize
from sparkfeed.streaming import live


def write_parts(df, path, part, parts):
    for k in range(parts):
        df.where(F.col(part) == k).drop(part).coalesce(1).write.mode("append").parquet(path)


def stream(spark, path):
    return spark.readStream.schema(spark.read.parquet(path).schema).option("maxFilesPerTrigger", 1).parquet(path)


def into_memory(query, name, checkpoint):
    q = query.writeStream.format("memory").queryName(name).outputMode("append").option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    assert q.awaitTermination(180)


@pytest.fixture(scope="module", autouse=True)
def store(spark):
    name = "spark.sql.streaming.stateStore.providerClass"
    before = spark.conf.get(name)
    live.use_state_store(spark)
    yield
    spark.conf.set(name, before)


def test_the_sessions_own_store_is_set_again(spark):
    name = "spark.sql.streaming.stateStore.providerClass"
    spark.conf.set(name, "own")
    with pytest.raises(KeyError), live.state_store(spark):
        assert spark.conf.get(name) == live.ROCKS
        raise KeyError
    assert spark.conf.get(name) == "own"
    live.use_state_store(spark)


@pytest.mark.parametrize("forget", [None, "40 seconds"])
def test_status_changes_equal_the_batch_on_shuffled_arrival(spark, tmp_path, forget):
    rng = random.Random(3)
    beats = [(f"r{k % 4}", t) for k in range(4) for t in sorted(rng.sample(range(1000, 3000), 40))]
    rng.shuffle(beats)
    rows = [(run, t, min(3, max(0, (t - 1000) // 500 + rng.randrange(-1, 2)))) for run, t in beats] + [("end", 20_000, 4)]
    df = spark.createDataFrame(rows, "run string, t int, part int").select("run", F.timestamp_seconds("t").alias("ts"), "part")
    write_parts(df, f"{tmp_path}/in", "part", 5)
    into_memory(live.status_changes(stream(spark, f"{tmp_path}/in"), "run", "60 seconds", "2000 seconds", forget=forget), f"changes_{bool(forget)}", f"{tmp_path}/c")
    tidy = lambda d: sorted((r.key, r.kind, r.at) for r in d.collect())
    got = tidy(spark.table(f"changes_{bool(forget)}"))
    assert got == tidy(live.status_changes_batch(df, "run", "60 seconds", 18_000 * 10**6, forget=forget)) and len(got) > 20
    assert {k for _, k, _ in got} == {"dropped", "revived"}


def test_jobs_in_event_time_equal_the_batch_on_shuffled_arrival(spark, tmp_path):
    rng = random.Random(5)
    jobs = [(f"w{k % 3}", 1000 + k, k, None if k % 17 == 5 else rng.gammavariate(2, 40) if k % 11 else 900.0, min(2, k // 40)) for k in range(120)]
    jobs = [(w, t, k, d, rng.choice([p, max(0, p - 1), min(2, p + 1)])) for w, t, k, d, p in jobs] + [("end", 9000, 999, 1.0, 3)]
    df = spark.createDataFrame(jobs, "worker string, t int, id long, duration_s double, part int").select("worker", F.timestamp_seconds("t").alias("ts"), "id", "duration_s", "part")
    write_parts(df, f"{tmp_path}/in", "part", 4)
    into_memory(live.job_timeouts(stream(spark, f"{tmp_path}/in"), 20.0, "500 seconds"), "jobs", f"{tmp_path}/c")
    tidy = lambda d: [(r.id, r.worker, r.duration_s, None if r.limit is None else round(r.limit, 6), r.late) for r in d.where("worker <> 'end'").orderBy("id").collect()]
    got = tidy(spark.table("jobs"))
    assert got == tidy(events.job_timeouts(df.drop("part"), 20.0)) and any(x[4] for x in got)


def test_late_rows_are_counted_exactly(spark, tmp_path):
    rows = [(k, 1000 + k, k // 25) for k in range(100)] + [(500, 1000, 1), (501, 900, 2), (502, 1024 - 10, 1), (503, 1024 - 9, 1), (504, 3000, 2), (505, 2990, 3), (506, 2991, 3), (507, None, 3)]
    df = spark.createDataFrame(rows, "id long, t int, part int").select("id", F.timestamp_seconds("t").alias("ts"), "part")
    write_parts(df, f"{tmp_path}/in", "part", 4)
    kept, fail = [], [True]

    def handle(batch, number):
        kept.append((number, sorted(r.id for r in batch.collect())))
        if number == 2 and fail.pop():
            raise RuntimeError("executor lost")

    start = lambda: live.split_late(stream(spark, f"{tmp_path}/in"), f"{tmp_path}/late", f"{tmp_path}/c", "10 seconds", handle)
    with pytest.raises(Exception, match="lost"):
        start().awaitTermination(180)
    fail.append(False)
    assert start().awaitTermination(180)
    late = sorted((r.batch, r.id) for r in live.late_rows(spark, f"{tmp_path}/late").collect())
    # the mark after the first batch is 1014, after the second 1039, after the third 2990
    assert late == [(1, 500), (1, 502), (2, 501), *((3, k) for k in range(75, 100)), (3, 505)]
    last = dict(kept)
    assert last[1] == [*range(25, 50), 503] and last[3] == [506, 507] and [n for n, _ in kept] == [0, 1, 2, 2, 3]


def test_statistics_are_applied_and_count_once(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(live, "COMPACT", 2)
    rows = [(k, [float(k), 100.0 - k * k], k // 10) for k in range(50)]
    df = spark.createDataFrame(rows, "id long, features array<double>, part int")
    write_parts(df, f"{tmp_path}/in", "part", 5)
    real, fail = normalize.normalize, [True]

    def once(batch, name, stats, column, **options):
        if fail and batch.agg(F.min("id")).first()[0] == 30 and fail.pop():
            raise RuntimeError("executor lost")
        return real(batch, name, stats, column, **options)

    monkeypatch.setattr(normalize, "normalize", once)
    start = lambda: live.normalize_stream(stream(spark, f"{tmp_path}/in"), "pointwise", f"{tmp_path}/n", f"{tmp_path}/c")
    with pytest.raises(Exception, match="lost"):
        start().awaitTermination(180)
    assert start().awaitTermination(180) and start().awaitTermination(180)
    got = live.normalized_rows(spark, f"{tmp_path}/n")
    assert got.count() == 50 and {r.version for r in got.collect()} == set(range(5))
    for version in range(5):
        stats = live.stats_until(spark, f"{tmp_path}/n", version)
        seen = df.where(F.col("id") < 10 * (version + 1))
        plain = {r.feature_idx: tuple(r)[1:] for r in normalize.fit_stats(seen, where=None).collect()}
        assert {r.feature_idx: tuple(r)[1:] for r in stats.collect()} == plain
        want = real(df.where(F.col("part") == version), "pointwise", stats)
        assert sorted((r.id, r.features) for r in got.where(F.col("version") == version).collect()) == sorted((r.id, r.features) for r in want.collect())
    last = sorted(live.stats_until(spark, f"{tmp_path}/n", 4).collect())
    live.forget_batches(spark, f"{tmp_path}/n", 5)
    assert sorted(live.stats_until(spark, f"{tmp_path}/n", 4).collect()) == last


def test_each_result_is_sent_once(spark, tmp_path):
    rows = [(f"c{k}", k * 1.0, k // 10) for k in range(30)] + [("c3", 3.0, 1), ("c12", 12.0, 2), ("c25", 25.0, 2), (None, 1.0, 2)]
    df = spark.createDataFrame(rows, "cid string, output double, part int")
    write_parts(df, f"{tmp_path}/in", "part", 3)

    def start():
        return live.send_results(stream(spark, f"{tmp_path}/in"), f"{tmp_path}/out", f"{tmp_path}/c")

    q = live.send_results(stream(spark, f"{tmp_path}/in").withColumn("output", F.when(F.col("cid") == "c17", F.raise_error(F.lit("executor lost")).cast("double")).otherwise(F.col("output"))), f"{tmp_path}/out", f"{tmp_path}/c")
    with pytest.raises(Exception, match="lost"):
        q.awaitTermination(180)
    assert start().awaitTermination(180) and start().awaitTermination(180)
    assert sorted((r.cid, r.output) for r in live.results(spark, f"{tmp_path}/out").collect()) == sorted((f"c{k}", k * 1.0) for k in range(30))

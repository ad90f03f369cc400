"""Series, rectangles, statistics and files that are cut over many tasks, against plain versions."""

import glob
import math
import os
import random
import time

import numpy as np
import pytest
from pyspark.sql import functions as F

from sparkfeed.functions import scalars, scan, scratch
from sparkfeed.operators import batching, events, evolution, joins, metrics, normalize, registry
from sparkfeed.sources import arrays, readers


def series(n=4000, hot=0.9, seed=1):
    """Rows ``(s, k, v)``; nine of ten are of one series; some series and values are null."""
    rng = random.Random(seed)
    rows = [(None if rng.random() < 0.01 else "hot" if rng.random() < hot else f"s{rng.randrange(9)}", k, None if rng.random() < 0.05 else rng.uniform(0, 100)) for k in range(n)]
    rng.shuffle(rows)
    return rows


def by_series(rows):
    out = {}
    for r in sorted(rows, key=lambda r: r[1]):
        out.setdefault(r[0], []).append(r)
    return out


@pytest.mark.parametrize("parts", [1, 7, 64])
def test_scans_equal_plain_ones(spark, parts):
    rows = series()
    df = spark.createDataFrame(rows, "s string, k long, v double")
    got = {(r.s, r.k): (r.place, r.size) for r in scan.rank_in_series(df, ["s"], ["k"], "place", "size", parts).collect()}
    assert got == {(s, r[1]): (i, len(x)) for s, x in by_series(rows).items() for i, r in enumerate(x)}
    at = {"a": -3, "b": -1, "c": 1, "d": 2}
    got = {(r.s, r.k): (r.v, r.a, r.b, r.c, r.d) for r in scan.neighbours(df, ["s"], ["k"], "v", at, parts).collect()}
    value = lambda x, i: x[i][2] if 0 <= i < len(x) else None
    assert got == {(s, r[1]): (r[2], *(value(x, i + k) for k in at.values())) for s, x in by_series(rows).items() for i, r in enumerate(x)}
    for r in scan.running_moments(df, ["s"], ["k"], "v", partitions=parts).collect():
        seen = [x[2] for x in by_series(rows)[r.s] if x[1] < r.k and x[2] is not None] if r.k < 200 or r.k > 3900 else None
        if seen is not None:
            assert r.n == len(seen) and (r.mean is None) == (not seen)
            if seen:
                assert r.mean == pytest.approx(np.mean(seen), abs=1e-9) and r.deviation == pytest.approx(np.std(seen), abs=1e-8)


def test_runs_are_even(spark):
    df = spark.createDataFrame(series(20_000), "s string, k long, v double")
    sizes = sorted(r["count"] for r in scan.runs(df, ["s"], ["k"], 16).rows.groupBy(F.spark_partition_id()).count().collect())
    assert len(sizes) >= 14 and sizes[-1] <= 3 * sizes[len(sizes) // 2] and sum(sizes) == 20_000


def test_scans_of_few_rows(spark):
    empty = spark.createDataFrame([], "s string, k long, v double")
    assert scan.rank_in_series(empty, ["s"], ["k"]).collect() == [] and scan.neighbours(empty, ["s"], ["k"], "v", {"a": -1}).collect() == []
    one = spark.createDataFrame([("x", 1, 2.0)], "s string, k long, v double")
    assert [tuple(r) for r in scan.neighbours(one, ["s"], ["k"], "v", {"a": -1, "b": 1}, 5).collect()] == [("x", 1, 2.0, None, None)]
    assert [tuple(r) for r in scan.running_moments(one, ["s"], ["k"], "v").collect()] == [("x", 1, 2.0, 0, None, None)]


def test_running_moments_far_from_zero(spark):
    rows = [("a", k, 1e9 + (k % 3)) for k in range(900)]
    got = scan.running_moments(spark.createDataFrame(rows, "s string, k long, v double"), ["s"], ["k"], "v", partitions=30).where("k = 899").first()
    assert got.deviation == pytest.approx(np.std([k % 3 for k in range(899)]), rel=1e-6)


def test_jobs_of_one_hot_worker(spark):
    rows = [("w", float(k), k, 10.0 + k % 5) for k in range(500)] + [("w", 500.0, 500, 1000.0), ("x", 1.0, 1, None)]
    got = {r.id: r for r in events.job_timeouts(spark.createDataFrame(rows, "worker string, ts double, id long, duration_s double"), 1.0).where("worker = 'w'").collect()}
    assert got[2].limit is None and not got[2].late and got[500].late
    past = [10.0 + k % 5 for k in range(500)]
    assert got[500].limit == pytest.approx(np.mean(past) + 3 * np.std(past), rel=1e-9)


# thinning
def walked(rows, interval, gap):
    out = []
    for s, x in by_series(rows).items():
        x = sorted(x, key=lambda r: (r[2] is None, r[2] if r[2] is not None else 0.0, r[1]))
        last = None
        for i, r in enumerate(x, 1):
            t = r[2]
            if i % interval == 0 and t is not None and (last is None or t >= last + gap):
                out.append((s, r[1]))
                last = t
        if len(x) % interval:
            out.append((s, x[-1][1]))
    return sorted(out, key=str)


@pytest.mark.parametrize("interval,gap,parts", [(1, 5.0, 8), (3, 0.5, 16), (2, 0.0, 5), (3, 1e9, 8), (4, 60.0, 32), (1, 0.01, 8)])
def test_thinning_by_runs_equals_the_walk(spark, interval, gap, parts):
    rows = series(1500, seed=interval)
    df = spark.createDataFrame(rows, "s string, k long, t double")
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", str(parts))
    try:
        got = [(r.s, r.k) for r in registry.thin_events(df, "s", "k", "t", interval, gap).collect()]
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)
    assert sorted(got, key=str) == walked(rows, interval, gap)


def test_thinning_keeps_columns_and_stands_odd_tables(spark):
    kind = "s string, k long, t double, s_ string, note string"
    assert registry.thin_events(spark.createDataFrame([], kind), "s", "k", "t", 2, 1.0).collect() == []
    rows = [("a", 1, None, "x", "n"), ("a", 2, float("nan"), "x", "n"), (None, 1, 1.0, None, "m"), (None, 2, 5.0, "y", "m"), (None, 3, 6.0, None, None)]
    got = registry.thin_events(spark.createDataFrame(rows, kind), "s", "k", "t", 2, 1.0)
    assert got.columns == ["s", "k", "t", "s_", "note"] and sorted((r.s or "", r.k) for r in got.collect()) == [("", 2), ("", 3)]


# rectangles
def overlaps(boxes, crops):
    out = []
    for i, b, y0, y1, x0, x1 in boxes:
        for j, c, v0, v1, u0, u1 in crops:
            if i == j and None not in (y0, y1, x0, x1, v0, v1, u0, u1):
                area = max(0.0, min(y1, v1) - max(y0, v0)) * max(0.0, min(x1, u1) - max(x0, u0))
                if area > 0 and y1 > y0 and x1 > x0 and v1 > v0 and u1 > u0:
                    out.append((b, c, round(area, 6)))
    return sorted(out)


BOX = "image string, {} long, ymin double, ymax double, xmin double, xmax double"


@pytest.mark.parametrize("most", [1, 5, 256])
def test_boxes_of_all_sizes_by_tiles(spark, most):
    rng = random.Random(most)

    def some(n):
        for k in range(n):
            size = 2.0 ** rng.uniform(-6, 12)
            y, x = rng.uniform(-2000, 2000), rng.uniform(-2000, 2000)
            yield ("one" if rng.random() < 0.9 else "two", k, y, y + size * rng.uniform(0.1, 1), x, x + size * rng.uniform(0.1, 1))

    boxes, crops = [*some(150), ("one", 900, 0.0, 0.0, 0.0, 5.0), ("one", 901, None, 1.0, 0.0, 5.0), ("one", 902, 0.0, 8.0, 0.0, 8.0)], [*some(120), ("one", 800, 8.0, 9.0, 0.0, 8.0), ("one", 801, 4.0, 8.0, 0.0, 4.0)]
    b, c = spark.createDataFrame(boxes, BOX.format("box")), spark.createDataFrame(crops, BOX.format("crop"))
    got = sorted((r.box, r.crop, round(r.area, 6)) for r in joins.box_overlap(b, c, most=most).collect())
    assert got == overlaps(boxes, crops) and len(got) > 100 and (902, 801, 16.0) in got
    assert joins.box_overlap(b.limit(0), c).collect() == [] and joins.box_overlap(b, c.limit(0)).collect() == []


def test_no_cell_is_fuller_than_its_bound(spark):
    same = spark.range(3000).select(F.lit("one").alias("image"), F.col("id").alias("box"), F.lit(0.0).alias("ymin"), F.lit(4.0).alias("ymax"), (F.col("id") % 3).cast("double").alias("xmin"), (F.col("id") % 3 + 4.0).alias("xmax"))
    crops = same.limit(40).withColumnRenamed("box", "crop")
    out = joins.box_overlap(same, crops, most=64)
    assert out.count() == 3000 * 40


def joined_rows(df):
    """Rows that the joins of the plan which ran have put out, those of earlier stages left out."""

    def walk(node):
        if "Join" in node.nodeName():
            yield node.metrics().apply("numOutputRows").value()
        for k in range(node.children().size()):
            yield from walk(node.children().apply(k))

    last = df._jdf.queryExecution().executedPlan().executedPlan()
    return sum(walk(last.plan() if "Stage" in last.nodeName() else last))


def test_rectangles_with_the_same_corners_meet_once(spark):
    # names that are null or come twice, and types of images that differ
    boxes = [("1", None if k < 5 else k // 2, 0.0, 4.0, k % 3 + 0.0, k % 3 + 4.0) for k in range(900)] + [(None, 1, 0.0, 4.0, 0.0, 4.0)]
    crops = [("1", k, 2.0, 6.0, 3.0, 7.0 + k % 2) for k in range(70)]
    b = spark.createDataFrame(boxes, BOX.format("box")).withColumn("image", F.col("image").cast("int"))
    c = spark.createDataFrame(crops, BOX.format("crop")).withColumn("image", F.col("image").cast("long"))
    for most in (16, 256):
        out = joins.box_overlap(b, c, most=most, digits=3)
        got = out.collect()
        want = sorted((b[1] or 0, c[1], 2.0 * (b[5] - 3)) for b in boxes[:900] for c in crops)
        assert sorted((r.box or 0, r.crop, r.area) for r in got) == want
        assert out.schema["image"].dataType.simpleString() == "int" and {r.image for r in got} == {1} and {r.ratio for r in got} == {0.125, 0.25, 0.375}
        assert 0 < joined_rows(out) <= len(got) / most


def shuffled(df, what):
    """What all shuffles of the plan which ran have written: ``dataSize`` or ``shuffleRecordsWritten``."""

    def walk(node):
        if node.nodeName() == "Exchange":
            yield node.metrics().apply(what).value()
        if "QueryStage" in node.nodeName():
            yield from walk(node.plan())
        for k in range(node.children().size()):
            yield from walk(node.children().apply(k))

    return sum(walk(df._jdf.queryExecution().executedPlan().executedPlan()))


def test_full_cells_are_copied_a_few_times(spark):
    same = spark.range(6000).select(F.lit("one").alias("image"), F.col("id").alias("box"), *(F.lit(v).alias(c) for c, v in (("ymin", 0.5), ("ymax", 4.0), ("xmin", 0.5), ("xmax", 4.0))))
    out = joins.box_overlap(same, same.withColumnRenamed("box", "crop"))
    got = out.groupBy((F.col("box") * 6000 + F.col("crop")).alias("k") % 97).agg(F.count("*").alias("n"), F.sum("box"), F.sum("crop"))
    assert sum(r.n for r in got.collect()) == 6000 * 6000
    # six copies of each of 12,000 names; 24 were 2,819,960 bytes
    assert shuffled(got, "dataSize") < 2_000_000


def test_rectangles_lie_only_on_grids_where_others_meet_them(spark):
    at = lambda name, size: [F.lit("one").alias("image"), F.col("id").alias(name), F.col("id").cast("double").alias("ymin"), (F.col("id") + size).cast("double").alias("ymax"), F.lit(0.5).alias("xmin"), F.lit(0.9).alias("xmax")]
    sizes = F.when(F.col("id") % 2 == 0, 1).otherwise(F.pow(F.lit(2), F.col("id") % 8))
    b, c = spark.range(4000).select(*at("box", sizes)), spark.range(20).select(*at("crop", F.lit(8)))
    out = joins.box_overlap(b, c)
    got = sorted((r.box, r.crop, round(r.area, 6)) for r in out.collect())
    assert got == overlaps([tuple(r) for r in b.collect()], [tuple(r) for r in c.collect()])
    # on all grids as coarse as their own or coarser, they were 42,720 rows
    assert shuffled(out, "shuffleRecordsWritten") < 30_000


# statistics
def test_row_values_are_worked_out_once(spark):
    # a row's least and greatest must not be found anew for each element: with 2,000 elements that took minutes
    rows = spark.range(0, 8, 1, 4).select(F.col("id").alias("sample_id"), F.transform(F.sequence(F.lit(1), F.lit(2000)), lambda k: (k * 37 % 1999 + F.col("id")) / 100.0).alias("features"))
    stats, s, began = normalize.fit_stats(rows, where=None), rows, time.time()
    for name in ("mean_disp", "linear", "exp"):
        s = normalize.denormalize(normalize.normalize(s, name, stats), name, stats).select("sample_id", "features")
    back = s.select("sample_id", F.posexplode("features").alias("k", "v")).agg(F.count("*"), F.sum("v")).first()
    want = [(k * 37 % 1999 + i) / 100 for i in range(8) for k in range(1, 2001)]
    assert back[0] == len(want) and abs(back[1] - sum(want)) < 1e-3 * len(want) and time.time() - began < 30


def test_statistics_leave_out_what_is_no_number(spark):
    nan, inf = float("nan"), float("inf")
    rows = [([float(k), 1.0, nan],) for k in range(1000)] + [([nan, None, nan],), ([None, inf, nan],), (None,), ([],)]
    for parts in (1, 2, 8):
        got = {r.feature_idx: tuple(r)[1:] for r in normalize.fit_stats(spark.createDataFrame(rows, "features array<double>").repartition(parts), where=None).collect()}
        assert got == {0: (1000, 499500.0, 0.0, 999.0), 1: (1000, 1000.0, 1.0, 1.0), 2: (0, 0.0, None, None)}
    df = spark.createDataFrame(rows[:3] + [([nan, None, nan],)], "features array<double>")
    out = normalize.normalize(df, "mean_disp", normalize.fit_stats(df, where=None)).collect()
    assert out[0].features[:2] == [-0.5, 0.0] and out[0].features[2] is None and math.isnan(out[3].features[0]) and out[3].features[1] is None


@pytest.mark.parametrize("parts", [1, 2, 8])
def test_statistics_of_unequal_lengths_fail(spark, parts):
    df = spark.createDataFrame([([1.0, 2.0],)] * 20 + [([1.0],)] * 20, "features array<double>").repartitionByRange(parts, F.size("features"))
    with pytest.raises(Exception, match="differ in length"):
        normalize.fit_stats(df, where=None).select("feature_idx").collect()


def test_range_of_batches_is_asked_for(spark):
    same = spark.createDataFrame([(0, [0.0, 1.0]), (0, [0.5, 0.5]), (1, [1.0, 0.0])], "batch int, features array<double>")
    assert normalize.fit_range(same, "batch", where=None).count() == 2
    with pytest.raises(Exception, match="differ in range"):
        normalize.fit_range(same.union(spark.createDataFrame([(2, [0.0, 2.0])], "batch int, features array<double>")), "batch", where=None).select("n").collect()
    stats = normalize.fit_stats(same, where=None)
    with pytest.raises(Exception, match="beyond the learnt range"):
        normalize.normalize(spark.createDataFrame([([0.0, 1.5],)], "features array<double>"), "pointwise", stats, checked=True).count()


# files
@pytest.mark.parametrize("block", [64, 100, 1000, 1 << 20])
@pytest.mark.parametrize("skip", [0, 1, 100, 199, 500])
def test_skipped_rows_over_blocks(spark, tmp_path, block, skip):
    for name in ("a", "b"):
        (tmp_path / f"{name}.csv").write_text("".join(f"{k},{k * 2}\n" if k % 10 else "# note\n" for k in range(200)))
    old = {k: spark.conf.get(k) for k in ("spark.sql.files.maxPartitionBytes", "spark.sql.files.openCostInBytes")}
    spark.conf.set("spark.sql.files.maxPartitionBytes", str(block))
    spark.conf.set("spark.sql.files.openCostInBytes", "0")
    try:
        got = sorted(r.features[0] for r in readers.read_matrix(spark, str(tmp_path), 2, skiprows=skip).collect())
    finally:
        for k, v in old.items():
            spark.conf.set(k, v)
    assert got == sorted(2 * [float(k) for k in range(skip, 200) if k % 10])


# checks that no choice of columns loses
def test_unequal_counts_fail_whatever_is_read(spark):
    samples = spark.createDataFrame([(1,), (2,)], "sample_id long")
    targets = spark.createDataFrame([(1, "a"), (2, "b"), (3, "c")], "target_id long, target string")
    for read in (lambda d: d.count(), lambda d: d.select("sample_id").collect()):
        with pytest.raises(Exception, match="differ in number"):
            read(joins.attach_targets(samples, targets, on=None))


def test_a_gene_that_does_not_fit_fails(spark):
    df = spark.createDataFrame([(300.0,)], "x double")
    assert df.select(scalars.decode_gene(scalars.encode_gene(F.col("x"), 1.0, 9), 1.0).alias("y")).first().y == 300
    with pytest.raises(Exception, match="more than 4 bits"):
        df.select(scalars.encode_gene(F.col("x"), 1.0, 4)).collect()


def test_array_rows_by_offset(spark, tmp_path):
    x = np.arange(7 * 3 * 2, dtype=np.float32).reshape(7, 3, 2)
    for name, a in (("c", x), ("f", np.asfortranarray(x)), ("big", x.astype(">i4")), ("flat", np.arange(5.0)), ("none", np.empty((0, 4)))):
        np.save(tmp_path / f"{name}.npy", a)
    for name, want in (("c", x), ("f", x), ("big", x), ("flat", np.arange(5.0)), ("none", np.empty((0, 4)))):
        for size in (1, 50, 1 << 20):
            df = arrays.read_arrays(spark, str(tmp_path / f"{name}.npy"), size)
            rows = df.orderBy("row").collect()
            assert [r.row for r in rows] == list(range(len(want))) and [r.features for r in rows] == want.reshape(len(want), int(np.prod(want.shape[1:]))).tolist()
    assert arrays.read_arrays(spark, str(tmp_path / "c.npy"), 24).rdd.getNumPartitions() == 7
    assert arrays.read_arrays(spark, str(tmp_path)).groupBy("path").count().count() == 4


def test_arrays_are_written_in_files_of_a_size(spark, tmp_path):
    df = spark.range(0, 1000, 1, 4).select(F.array(F.col("id").cast("float"), (F.col("id") * 2).cast("float")).alias("features"))
    assert arrays.write_arrays(df, f"{tmp_path}/a", part_bytes=16 * 60) == 1000
    files = sorted((tmp_path / "a").glob("*"))
    assert len(files) == 20 and {f.suffix for f in files} == {".npy"}
    assert [np.load(f).shape for f in files[:5]] == [(60, 2)] * 4 + [(10, 2)]
    assert arrays.write_arrays(df, f"{tmp_path}/a", part_bytes=16 * 60) == 1000  # a task that runs again replaces its files
    rows = arrays.read_arrays(spark, f"{tmp_path}/a", 100).collect()
    assert sorted(r.features for r in rows) == [[float(k), 2.0 * k] for k in range(1000)]
    assert arrays.write_arrays(df.limit(0), f"{tmp_path}/none") == 0 and arrays.read_arrays(spark, f"{tmp_path}/none").count() == 0


@pytest.mark.parametrize("odd, why", [("array(1.0D)", "differ in length"), ("array(1.0D, NULL)", "null in features"), ("CAST(NULL AS array<double>)", "null in features")])
@pytest.mark.parametrize("parts", [1, 8])
def test_arrays_of_odd_rows_are_not_written(spark, tmp_path, odd, why, parts):
    df = spark.range(0, 16, 1, parts).select(F.when(F.col("id") == 11, F.expr(odd)).otherwise(F.array(F.lit(1.0), F.lit(2.0))).alias("features"))
    with pytest.raises(Exception, match=why):
        arrays.write_arrays(df, f"{tmp_path}/a")


def test_runs_without_models_move_no_numbers(spark):
    run = lambda *pos: spark.createDataFrame([(k, f"m{k}") for k in pos], "model_pos int, id string")
    out = registry.merge_model_results([run(), run(0, 2), run(), run(1, 0)])
    assert out.schema == run().schema and sorted(map(tuple, out.collect())) == [(0, "m0"), (2, "m2"), (3, "m0"), (4, "m1")]
    assert registry.merge_model_results([run(), run()]).collect() == []


def test_wrong_array_files_fail(spark, tmp_path):
    (tmp_path / "no.npy").write_bytes(b"no array at all")
    np.save(tmp_path / "objects.npy", np.array([{}, 1], object), allow_pickle=True)
    np.save(tmp_path / "scalar.npy", np.float64(1))
    np.save(tmp_path / "short.npy", np.arange(100.0))
    cut = (tmp_path / "short.npy").read_bytes()[:-9]
    (tmp_path / "short.npy").write_bytes(cut)
    for name, why in (("no", "no array file"), ("objects", "no rows of numbers"), ("scalar", "no rows of numbers"), ("short", "cut short"), ("missing", "missing")):
        with pytest.raises(Exception, match=why):
            arrays.read_arrays(spark, str(tmp_path / f"{name}.npy")).collect()


def test_a_file_beyond_what_a_row_holds_is_planned_by_its_header(tmp_path):
    path = tmp_path / "large.npy"
    with path.open("wb") as f:
        np.lib.format.write_array_header_1_0(f, {"descr": "<f8", "fortran_order": False, "shape": (400_000, 1000)})
        start = f.tell()
        f.seek(start + 399_999 * 8000)
        f.write(np.arange(1000.0).tobytes())  # the rest is a hole
    reader = arrays.ArrayReader(str(path), 64 << 20)
    parts = reader.partitions()
    assert path.stat().st_size > 2 << 30 and len(parts) == 48 and sum(p.count for p in parts) == 400_000
    *_, last = reader.read(arrays.Rows(str(path), 399_990, 10, parts[0].header))
    assert last.column(1)[-1].as_py() == 399_999 and last.column(2)[-1].as_py() == list(range(1000))


def test_only_folders_of_wanted_chunks_are_read(spark, tmp_path):
    path = f"{tmp_path}/store"
    df = spark.range(2000).select(F.col("id").alias("sample_id"), F.when(F.col("id") < 300, "test").otherwise("train").alias("split"), F.array(F.col("id").cast("double")).alias("features"))
    batching.write_chunks(batching.index_samples(df, epoch=1, seed=3), path, 50, (0, 0, 10), folder_rows=100)
    at = {(r.split, r.split_pos): r.sample_id for r in batching.read_chunks(spark, path).collect()}
    want = [("test", 7), ("test", 7), ("train", 5), ("train", 99), ("train", 1650), ("train", 10_000_000)]
    wanted = spark.createDataFrame(want, "split string, split_pos long")
    for folder in glob.glob(f"{path}/chunks/split=*/folder=*"):
        if not any(folder.endswith(x) for x in ("split=test/folder=0", "split=train/folder=0", "split=train/folder=16")):
            for file in glob.glob(f"{folder}/*.parquet"):
                with open(file, "wb") as f:
                    f.write(b"not to be opened")
    got = batching.fetch_samples(spark, path, wanted).collect()
    assert sorted((r.split, r.split_pos, r.sample_id) for r in got) == sorted((*w, at[w]) for w in want if w in at) and len(got) == 5
    assert batching.fetch_samples(spark, path, wanted.limit(0)).collect() == []


# quartiles
@pytest.mark.parametrize("cells", [2, 7, 4096])
def test_order_statistics_without_a_sort(spark, monkeypatch, cells):
    monkeypatch.setattr(metrics, "CELLS", cells)
    rng = random.Random(cells)
    for values in ([rng.choice([0.0, 1.0, 1.0, 5.5, -3.0]) for _ in range(300)], [rng.gauss(0, 1e-9) + 1e9 for _ in range(200)], [7.0], [-1e308, 1e308, 0.0, 1e-300]):
        df = spark.createDataFrame([(v,) for v in [*values, None, float("nan"), float("inf")]], "x double")
        places = sorted({0, len(values) // 4, len(values) // 2, len(values) - 1})
        assert metrics.order_statistics(df, "x", places) == [sorted(values)[k] for k in places]
    with pytest.raises(ValueError, match="places"):
        metrics.order_statistics(spark.createDataFrame([(1.0,)], "x double"), "x", [1])
    assert metrics.auto_histogram(spark.createDataFrame([(None,)], "x double"), "x").collect() == []


# scratch tables
def test_a_run_leaves_nothing(spark):
    folder = scratch.shared_dir(spark)
    before = set(os.listdir(folder.removeprefix("file:"))) if os.path.isdir(folder.removeprefix("file:")) else set()
    with scratch.scratch_run(spark) as path:
        df = spark.range(50).select(F.col("id").alias("sample_id"), F.lit("train").alias("split"), F.lit("a").alias("label"))
        got = batching.index_samples(df, epoch=1).collect()
        assert len(got) == 50 and os.listdir(path.removeprefix("file:"))
    assert set(os.listdir(folder.removeprefix("file:"))) == before


def test_only_keys_are_written_to_rank_rows(spark):
    wide = spark.range(2000).select(F.col("id").alias("sample_id"), F.lit("train").alias("split"), F.array_repeat(F.rand(1), 200).alias("features"))
    with scratch.scratch_run(spark) as path:
        out = batching.index_samples(wide, epoch=1)
        size = sum(os.path.getsize(os.path.join(d, f)) for d, _, fs in os.walk(path.removeprefix("file:")) for f in fs)
        assert size < 2000 * 120 and sorted(r.global_index for r in out.select("global_index").collect()) == list(range(2000))
    again = spark.createDataFrame([(1, "train"), (1, "train")], "sample_id long, split string")
    with pytest.raises(Exception, match="repeated key"):
        batching.index_samples(again).collect()


def test_results_are_written_as_one_object(spark, tmp_path):
    r = spark.createDataFrame([("b", "2"), ("a", 'x"y')], "metric string, value string")
    registry.write_results(r, f"{tmp_path}/r")
    registry.write_results(r, f"{tmp_path}/r")
    assert sorted(tuple(x) for x in registry.read_results(spark, f"{tmp_path}/r").collect()) == [("a", 'x"y'), ("b", "2")]


# candidates
def test_failures_are_a_candidates_own_and_are_tried_again(spark, tmp_path):
    cands = spark.createDataFrame([(k, float(k)) for k in range(12)], "cand_id long, w double")
    data = spark.range(100).select(F.col("id").cast("double").alias("x")).repartition(5)
    mark = str(tmp_path / "seen")

    def part(c, rows):
        if c["cand_id"] == 3:
            raise ValueError("never")
        if c["cand_id"] == 4 and not os.path.exists(mark):
            raise OSError("once")
        return [float((rows["x"] * c["w"]).sum())]

    run = lambda **k: {r.cand_id: (r.fitness, r.error) for r in evolution.evaluate_candidates(cands, data, part, lambda s: s[0], **k).collect()}
    got = run(most=5)
    assert got[3] == (None, "ValueError: never") and got[4] == (None, "OSError: once") and all(got[k] == (4950.0 * k, None) for k in range(12) if k not in (3, 4))
    real = evolution.Scratch.written

    def written(self, df, name):
        out = real(self, df, name)
        open(mark, "w").close()  # what was lost is there again for the second attempt
        return out

    evolution.Scratch.written = written
    try:
        got = run(attempts=2)
    finally:
        evolution.Scratch.written = real
    assert len(got) == 12 and got[3] == (None, "ValueError: never") and got[4] == (4950.0 * 4, None)
    assert {e for _, e in {r.cand_id: (r.fitness, r.error) for r in evolution.evaluate_candidates(cands, data.limit(0), part, lambda s: s[0]).collect()}.values()} == {"no fitness"}


def test_generations_improve_and_stop(spark):
    start = spark.range(60).select(F.col("id").alias("cand_id"), F.array(F.lit(1.0), (F.col("id") % 17).cast("double"), (F.col("id") % 23).cast("double")).alias("genes"))
    value = lambda c: c.select("cand_id", (500 - F.aggregate("genes", F.lit(0.0), lambda a, x: a + (x - 9) * (x - 9))).alias("fitness"))
    out = evolution.evolve(start, value, 0.0, 25.0, 40, 4, seed=1)
    rows = out.history.orderBy("generation").collect()
    assert len(rows) == 4 and all(b.best >= a.best and b["sum"] > a["sum"] for a, b in zip(rows, rows[1:], strict=False)) and out.population.count() == 40
    flat = evolution.evolve(start, lambda c: c.select("cand_id", F.lit(1.0).alias("fitness")), 0.0, 25.0, 40, 9)
    assert [r.stop for r in flat.history.orderBy("generation").collect()] == [False, True]
    none = evolution.evolve(start.limit(0), value, 0.0, 25.0, 40, 3)
    assert none.history.count() == 0 and none.population.count() == 0

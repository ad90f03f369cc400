"""The library's operators: against SQL on the test tables, and on hand-made values."""

import glob
import json
import os

import duckdb
import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from sparkfeed.functions import draws, index, scalars, scratch
from sparkfeed.jobs import queries
from sparkfeed.operators import batching, events, joins, labels, metrics, normalize, pixels, registry, search, splits
from sparkfeed.sources import readers
from sparkfeed.streaming import streams

SF = "/root/testdata/sf0.01"


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    for f in glob.glob(f"{SF}/*.parquet"):
        c.execute(f"CREATE VIEW {os.path.basename(f)[:-8]} AS SELECT * FROM '{f}'")
    return c


def plain(frame):
    def value(x):
        return None if pd.isna(x) else round(float(x), 6) if isinstance(x, float | np.floating) else x

    return sorted((tuple(value(x) for x in r) for r in frame[sorted(frame.columns)].itertuples(index=False)), key=str)


@pytest.mark.parametrize("name", sorted(queries.ORACLE_SQL))
def test_sql(spark, con, name):
    got, want = queries.QUERIES[name](spark, SF).toPandas(), con.execute(queries.ORACLE_SQL[name]).df()
    assert sorted(got.columns) == sorted(want.columns) and plain(got) == plain(want)


def samples(spark, rows, split="train"):
    return spark.createDataFrame([(k, split, "a", [float(x) for x in r]) for k, r in enumerate(rows)], "sample_id long, split string, label string, features array<double>")


def features(df):
    return [r.features for r in df.orderBy("sample_id").collect()]


MATRIX = [[1, 2, 3], [6, 5, 4], [7, 8, 9], [10, 11, 12]]


def test_pointwise_values(spark):
    s = samples(spark, MATRIX)
    stats = normalize.fit_stats(s)
    out = features(normalize.normalize(s, "pointwise", stats))
    want = [[-1, -1, -1], [0.5 / 4.5, -1.5 / 4.5, -3.5 / 4.5], [1.5 / 4.5] * 3, [1, 1, 1]]
    assert np.allclose(out, want)
    doubled = normalize.merge_stats(stats, normalize.fit_stats(samples(spark, [[2 * x for x in r] for r in MATRIX])))
    assert {(r["min"], r["max"], r["n"]) for r in doubled.collect()} == {(1, 20, 8), (2, 22, 8), (3, 24, 8)}


@pytest.mark.parametrize("name", sorted(normalize.NORMALIZERS))
def test_inverses(spark, name):
    rows = MATRIX if name != "range_linear" else [[1, 5, 12], [12, 2, 1]]
    s = samples(spark, rows)
    stats = normalize.fit_stats(s) if normalize.NORMALIZERS[name].needs_stats else None
    options = {"mean": F.array(*map(F.lit, (1.0, 1.0, 1.0)))} if name == "external_mean" else {}
    back = normalize.denormalize(normalize.normalize(s, name, stats, **options), name, stats, **options)
    assert np.allclose(features(back), rows, atol=1e-6)


def test_constant_rows_and_elements(spark):
    s = samples(spark, [[0, 0, 1, 1], [1, 1, 1, 1]])
    assert features(normalize.normalize(s, "linear"))[1] == [0.0] * 4
    assert features(normalize.normalize(s, "linear", interval=(0.0, 1.0)))[1] == [0.5] * 4
    p = samples(spark, [[3, 1], [3, 2]])
    stats = normalize.fit_stats(p)
    assert features(normalize.denormalize(normalize.normalize(p, "pointwise", stats), "pointwise", stats)) == [[3, 1], [3, 2]]
    assert features(normalize.normalize(p, "mean_disp", stats))[0][0] == 0


@pytest.mark.parametrize("partitions", [1, 4, 17])
def test_dense_index_is_the_same_under_any_partitioning(spark, partitions):
    df = spark.range(1000).repartition(partitions).select((F.col("id") * 7919 % 1000).alias("v"))
    assert all(r.v == r.idx for r in index.dense_index(df, ["v"], partitions=partitions).collect())
    assert index.dense_index(df.limit(0), ["v"]).count() == 0


def test_cover_split_has_each_label_on_both_sides(spark):
    df = spark.range(200).select(F.col("id").alias("sample_id"), (F.col("id") % 20).cast("string").alias("label"), F.lit("train").alias("split"))
    out = splits.resplit_validation(df, 0.3, seed=1, stratify="cover")
    assert {(r["split"], r.n) for r in out.groupBy("split").agg(F.count("*").alias("n")).collect()} == {("validation", 60), ("train", 140)}
    assert out.groupBy("label").agg(F.count_distinct("split").alias("n")).where("n < 2").count() == 0
    with pytest.raises(ValueError):
        splits.resplit_validation(df, 0.05, stratify="cover")
    assert splits.resplit_validation(out, 0.0).where("split <> 'train'").count() == 0


def test_shuffle_limit_keeps_the_last_order(spark):
    df = spark.range(100).select(F.col("id").alias("sample_id"), F.lit("train").alias("split"))
    order = lambda **k: [r.sample_id for r in batching.index_samples(df, **k).orderBy("split_pos").collect()]
    assert order(epoch=0, shuffle_limit=0) == list(range(100)) != order(epoch=0)
    assert order(epoch=5, shuffle_limit=2) == order(epoch=1) != order(epoch=5)


def test_chunk_store_round_trip(spark, tmp_path):
    df = spark.range(1000).select(F.col("id").alias("sample_id"), F.lit("test").alias("split"), F.array(F.col("id").cast("double")).alias("features"))
    batching.write_chunks(batching.index_samples(df), f"{tmp_path}/store", 100, (30, 0, 1))
    store = batching.read_chunks(spark, f"{tmp_path}/store")
    assert [r.features[0] for r in store.orderBy("chunk_id", "chunk_offset").collect()] == [float(k) for k in range(1000)]
    got = batching.fetch_samples(spark, f"{tmp_path}/store", spark.createDataFrame([("test", 777)], "split string, split_pos long")).collect()
    assert [r.sample_id for r in got] == [777] and (got[0].chunk_id, got[0].chunk_offset) == (30, 17)


def test_feature_blocks(spark):
    blocks = [samples(spark, [[k * 100 + j for j in range(n)] for k in range(10)]) for n in (25, 5, 35)]
    out, layout = joins.join_features(blocks)
    assert [(r.offset, r.length) for r in layout.orderBy("block").collect()] == [(0, 25), (25, 5), (30, 35)]
    assert all(len(x) == 65 for x in features(out))


def test_feature_blocks_are_cut_to_the_shortest(spark):
    a = spark.createDataFrame([(0, [1.0, 2.0, 3.0]), (1, [4.0, 5.0]), (2, [9.0])], "sample_id long, features array<double>")
    b = spark.createDataFrame([(0, [6.0]), (1, [7.0, 8.0])], "sample_id long, features array<double>")
    out, layout = joins.join_features([a, b])
    assert {r.sample_id: r.features for r in out.collect()} == {0: [1, 2, 6], 1: [4, 5, 7]}
    assert [(r.offset, r.length) for r in layout.orderBy("block").collect()] == [(0, 2), (2, 1)]


def test_targets_keep_their_contract(spark):
    s = spark.createDataFrame([(1, "a"), (2, "b"), (3, "a")], "sample_id long, label string")
    t = lambda *rows: spark.createDataFrame(rows, "target_id long, label string, target double")
    assert {r.sample_id: r.target for r in joins.attach_targets(s, t((1, "a", 0.5), (2, "b", 1.5), (3, "c", 9.0))).collect()} == {1: 0.5, 2: 1.5, 3: 0.5}
    for bad, why in ((t((1, "a", 0.5), (2, "b", 1.5), (3, "b", 2.5)), "several targets for label b"), (t((1, "a", 0.5)), "no target for label b")):
        with pytest.raises(Exception, match=why):
            joins.attach_targets(s, bad).collect()
    broken = joins.target_violations(s, t((1, "a", 0.5), (2, "c", 1.5), (3, "c", 2.5))).collect()
    assert {(r.rule, r.label) for r in broken} == {("several targets", "c"), ("no target", "b")}
    assert {r.sample_id: r.target for r in joins.attach_targets(s, t((7, "x", 3.0), (5, "y", 1.0), (6, "z", 2.0)), on=None).collect()} == {1: 1.0, 2: 2.0, 3: 3.0}
    for n in (2, 4):
        with pytest.raises(Exception, match="differ in number"):
            joins.attach_targets(s, t(*((k, "x", 1.0) for k in range(n))), on=None).collect()


def test_stacking_keeps_its_contract(spark):
    made = lambda *rows: joins.stack_outputs(spark.createDataFrame(rows, "model_pos int, labels array<string>, output array<array<double>>"))
    first = (0, ["a", "b"], [[1.0, 2.0], [3.0, 4.0]])
    for second, why in (((1, ["a", "c"], [[1.0, 2.0], [3.0, 4.0]]), "labels"), ((1, ["a"], [[1.0], [3.0]]), "labels"), ((1, ["b", "a"], [[1.0, 2.0]]), "shape")):
        with pytest.raises(Exception, match=f"models differ in (their )?{why}"):
            made(first, second).collect()
    stacked = made(first)
    winners = spark.createDataFrame([(0, "b"), (1, "a")], "sample_pos int, label string")
    assert {r.sample_pos: r.label for r in joins.attach_winners(stacked, winners).collect()} == {0: "b", 1: "a"}
    mapping = spark.createDataFrame([("a", 0), ("b", 1)], "label string, label_id int")
    assert {r.sample_pos: (r.features, r.label_id) for r in joins.attach_winners(stacked, winners, mapping).collect()} == {0: ([1, 2], 1), 1: ([3, 4], 0)}


def test_chunks_of_each_split(spark, tmp_path):
    df = spark.range(300).select(F.col("id").alias("sample_id"), F.when(F.col("id") < 100, "test").when(F.col("id") < 150, "validation").otherwise("train").alias("split"), F.array(F.lit(1.0), F.lit(2.0)).alias("features"), F.concat(F.lit("l"), F.col("id") % 3).alias("label"))
    indexed = batching.index_samples(labels.apply_label_mapping(df, labels.build_label_mapping(df)))
    for bad in ((0, 0, 41), (0, -1, 0)):
        with pytest.raises(ValueError, match="do not fit"):
            batching.write_chunks(indexed, f"{tmp_path}/no", 40, bad)
    batching.write_chunks(indexed, f"{tmp_path}/store", 40, (0, 20, 1), "zstd")
    header = json.loads(spark.read.text(f"{tmp_path}/store/header").first().value)
    assert header["chunks"] == {"test": 40, "validation": 20, "train": 1} and header["class_lengths"] == {"test": 100, "validation": 50, "train": 150}
    assert header["shape"] == [2] and header["types"]["features"] == "array<double>" and header["codec"] == "zstd"
    sizes = {r.split: (r.most, r.n) for r in batching.read_chunks(spark, f"{tmp_path}/store").groupBy("split", "chunk_id").count().groupBy("split").agg(F.max("count").alias("most"), F.count("*").alias("n")).collect()}
    assert sizes == {"test": (40, 3), "validation": (20, 3), "train": (1, 150)}
    assert {(r.label, r.label_id) for r in spark.read.parquet(f"{tmp_path}/store/labels").collect()} == {("l0", 0), ("l1", 1), ("l2", 2)}


def test_statistics_and_labels_go_on_to_new_data(spark, tmp_path):
    old = samples(spark, [[0.0, 10.0], [4.0, 30.0]])
    bundle = normalize.Bundle("pointwise", normalize.fit_stats(old), labels.build_label_mapping(old))
    normalize.save_bundle(bundle, spark, f"{tmp_path}/bundle")
    normalize.save_stats(bundle.stats, f"{tmp_path}/stats")
    assert sorted(normalize.load_stats(spark, f"{tmp_path}/stats").collect()) == sorted(bundle.stats.collect())
    new = spark.createDataFrame([(9, "train", [2.0, 40.0], old.first().label), (8, "test", [4.0, 10.0], "never seen")], "sample_id long, split string, features array<double>, label string")
    out = {r.sample_id: (r.features, r.label_id) for r in normalize.derive_from(new, normalize.load_bundle(spark, f"{tmp_path}/bundle")).collect()}
    assert out[9] == ([0.0, 2.0], 0) and out[8] == ([1.0, -1.0], None)
    with pytest.raises(Exception, match="differ in length"):
        normalize.fit_stats(samples(spark, [[1.0], [1.0, 2.0]]).coalesce(1)).collect()


def test_chi_square_p(spark):
    from pyspark.mllib.linalg import Vectors
    from pyspark.mllib.stat import Statistics

    rng = np.random.default_rng(3)
    for k in (2, 3, 10, 60):
        seen, want = rng.integers(1, 200, k).astype(float), rng.integers(20, 200, k).astype(float)
        test = Statistics.chiSqTest(Vectors.dense(seen), Vectors.dense(want / want.sum() * seen.sum()))
        assert abs(labels._upper_gamma(test.degreesOfFreedom / 2, test.statistic / 2) - test.pValue) < 1e-9
    df = spark.createDataFrame([("train", x) for x in "aabb" * 25] + [("test", x) for x in "ab" * 50] + [("validation", x) for x in "aaab" * 25], "split string, label string")
    out = {r.split: (r.p, r.same) for r in labels.compare_label_distributions(df, "count").collect()}
    assert out["test"] == (1.0, True) and out["validation"][0] < 1e-5 and not out["validation"][1]


def test_mutations(spark):
    df = spark.createDataFrame([(k, [float(j) for j in range(10)]) for k in range(200)], "cand_id long, genes array<double>")
    made = lambda *a, **k: {r.cand_id: r.genes for r in search.mutate(df, *a, **k).collect()}
    changed = lambda g: sum(x != j for j, x in enumerate(g))
    out = made("gaussian", 0.0, 9.0, 1.0, points=3)
    assert all(len(g) == 10 and changed(g) == 3 and all(0 <= x <= 9 for x in g) for g in out.values())
    some = made("uniform", 20.0, 30.0, 1.0, share=0.3, points=2)
    assert 30 < sum(changed(g) == 2 for g in some.values()) < 90 and all(changed(g) in (0, 2) for g in some.values())
    swapped = made("swap", 0.0, 9.0, 1.0, points=1)
    assert all(sorted(g) == list(range(10)) and changed(g) in (0, 2) for g in swapped.values()) and any(map(changed, swapped.values()))
    bits = spark.createDataFrame([(k, [0.0, 1.0] * 4) for k in range(50)], "cand_id long, genes array<double>")
    flipped = [r.genes for r in search.mutate(bits, "flip", 0, 1, 0.5).collect()]
    assert all(x in (0.0, 1.0) for g in flipped for x in g) and 100 < sum(x != j % 2 for g in flipped for j, x in enumerate(g)) < 300


def test_draws(spark):
    df = spark.range(4000)
    z = np.array([r[0] for r in df.select(draws.normal(1, F.col("id"), 3.0, 2.0)).collect()])
    assert abs(z.mean() - 3) < 0.15 and abs(z.std() - 2) < 0.1 and np.abs(z - 3).max() <= 10
    counts = dict(df.groupBy(draws.choice(2, F.col("id"), ["a", "b", "c"], [6, 3, 1]).alias("c")).count().collect())
    assert abs(counts["a"] - 2400) < 150 and abs(counts["c"] - 400) < 90
    assert all(sorted(r[0]) == list(range(7)) for r in df.limit(50).select(draws.permutation(1, F.col("id"), 7)).collect())
    assert len(df.select(draws.random_bytes(1, F.col("id"), 33).alias("b")).where("octet_length(b) = 33").distinct().collect()) == 4000


def test_scores_in_blocks_of_candidates(spark):
    cands = spark.range(50).select(F.col("id").alias("cand_id"), F.col("id").cast("double").alias("w"))
    data = spark.range(100).select(F.col("id").cast("double").alias("x"))
    want = {r.cand_id: r.fitness for r in search.score_candidates(cands, data, F.sum(F.col("x") * F.col("w"))).collect()}
    assert {r.cand_id: r.fitness for r in search.score_candidates(cands, data, F.sum(F.col("x") * F.col("w")), most=7).collect()} == want and len(want) == 50
    assert {r.draw for r in search.weighted_sample(cands, "w", 300, buckets=3).collect()} == set(range(300))
    assert search.weighted_sample(cands, "w", 300, buckets=3).exceptAll(search.weighted_sample(cands, "w", 300)).count() == 0


def test_trend_and_efficiency(spark):
    tail = spark.createDataFrame([("a", k, float(k * k)) for k in range(11)], "by string, position int, y double")
    out = metrics.poly_trend(tail, "by", "y", points=5).orderBy("x").collect()
    assert np.allclose([r.trend for r in out], [0, 6.25, 25, 56.25, 100])
    runs = spark.createDataFrame([("r", 2.0, 10.0), ("r", 3.0, 10.0)], "run_id string, s double, wall double")
    assert events.efficiency(runs, "s", "wall").first().efficiency == 0.5


def test_snapshots_are_appended(spark, tmp_path):
    one = spark.createDataFrame([("i", "l", 1, "n1")], "id string, log_id string, timestamp long, name string")
    for df in (one, one.withColumn("timestamp", F.lit(2))):
        registry.append_snapshots(df.withColumn("timestamp", F.col("timestamp").cast("long")), f"{tmp_path}/s")
    assert registry.latest_snapshot(spark.read.parquet(f"{tmp_path}/s")).first().timestamp == 2


def test_pixels(spark):
    rng = np.random.default_rng(1)
    x = rng.integers(0, 256, (5, 6, 3)).astype(float)
    for space in ("BGR", "YCR_CB", "HSV", "RGB"):
        assert np.allclose(pixels.convert_color(pixels.convert_color(x, "RGB", space), space, "RGB"), x)
    assert np.allclose(pixels.convert_color(np.array([[[255.0, 0, 0], [0, 255.0, 0]]]), "RGB", "HSV"), [[[0, 255, 255], [60, 255, 255]]])
    assert np.allclose(pixels.resize(x, 5, 6), x) and np.allclose(pixels.resize(x, 10, 12).reshape(5, 2, 6, 2, 3).mean(axis=(1, 3))[1:-1, 1:-1].shape, (3, 4, 3))
    odd = rng.random((7, 7, 2))
    assert np.allclose(pixels.rotate(odd, 0.0), odd) and np.allclose(pixels.rotate(odd, np.pi / 2), np.rot90(odd))
    assert np.allclose(pixels.rotate(np.ones((9, 9, 1)), np.pi / 4, 5.0)[0, 0], 5.0)
    ramp = np.tile(np.arange(5.0), (4, 1))
    assert np.allclose(pixels.sobel(ramp)[:, 1:-1], 8) and np.allclose(pixels.sobel(ramp * 0), 0)
    rows = [(k, 4, 6, 3, None if k == 3 else bytearray(rng.integers(0, 256, 72).astype(np.uint8).tobytes()), k % 2 == 0, 0.1 * k) for k in range(40)]
    df = spark.createDataFrame(rows, "id long, height int, width int, channels int, data binary, flip boolean, angle double")
    out = pixels.transform_images(df, [("mirror", "flip"), ("rotate", "angle", 7.0), ("color", "GRAY"), ("crop", 1, 3, 0, 6), ("resize", 8, 8), ("sobel",)]).collect()
    assert all((r.height, r.width, r.channels, len(r.pixels)) == (8, 8, 2, 128) for r in out if r.id != 3) and [r.pixels for r in out if r.id == 3] == [None] and len(out) == 40
    plain = {r.id: r.pixels for r in pixels.transform_images(df, [("mirror", "flip")]).collect()}
    for k, *_, data, flip, _ in rows:
        if data is not None:
            image = np.frombuffer(bytes(data), np.uint8).reshape(4, 6, 3)
            assert plain[k] == (image[:, ::-1] if flip else image).ravel().tolist()
    with pytest.raises(ValueError, match="no step blur"):
        pixels.transform_images(df, [("blur",)])


def test_stacking_puts_labels_in_the_first_models_order(spark):
    results = spark.createDataFrame([(0, ["a", "b"], [[1.0, 2.0], [3.0, 4.0]]), (1, ["b", "a"], [[20.0, 10.0], [40.0, 30.0]])], "model_pos int, labels array<string>, output array<array<double>>")
    assert {r.sample_pos: r.features for r in joins.stack_outputs(results).collect()} == {0: [1, 2, 10, 20], 1: [3, 4, 30, 40]}


def test_missing_label_is_an_error(spark):
    s = samples(spark, [[1]])
    mapping = labels.build_label_mapping(s)
    other = s.withColumn("label", F.lit("zzz"))
    assert labels.apply_label_mapping(other, mapping, "drop").count() == 0
    with pytest.raises(Exception, match="zzz"):
        labels.apply_label_mapping(other, mapping, "error").collect()


def test_strict_bounds_and_caps(spark):
    rows = [("s", "i", n, float(k), "single", None) for n, size in (("few", 600), ("many", 601)) for k in range(size)]
    df = spark.createDataFrame(rows, "session string, instance string, name string, time double, type string, height double")
    capped = {(r["name"], r["collapsed"]): r["n"] for r in events.cap_series(df).groupBy("name", "collapsed").agg(F.count("*").alias("n")).collect()}
    assert capped == {("few", False): 600, ("many", True): 2}
    assert events.slice_events(df, names=["few"], after=0.0, before=3.0).count() == 2


def test_timeouts_need_three_jobs(spark):
    df = spark.createDataFrame([("w", k, float(k), d) for k, d in enumerate([1.0, 1.0, 1.0, 500.0, 1.0])], "worker string, id int, ts double, duration_s double")
    out = events.job_timeouts(df, 120.0).orderBy("id").collect()
    assert [r.late for r in out] == [False, False, False, True, False] and out[2].limit is None and out[3].limit == 120.0


def test_thinning(spark):
    df = spark.createDataFrame([("a", k, k * 10.0) for k in range(10)], "by string, k long, t double")
    assert sorted(r.k for r in registry.thin_events(df, "by", "k", "t", 2, 35.0).collect()) == [1, 5, 9]


def test_thinning_holds_no_whole_series(spark):
    rows = [(by, k, float(k * k % 97)) for by, n in (("a", 100), ("b", 1), ("c", 33), (None, 50), ("d", 14)) for k in range(n)]
    want = []
    for by in {r[0] for r in rows}:
        last, series = float("-inf"), sorted((t, k) for b, k, t in rows if b == by)
        for n, (t, k) in enumerate(series, 1):
            if n % 3 == 0 and t - last >= 5.0:
                want.append((by, k))
                last = t
        want += [(by, series[-1][1])] if len(series) % 3 else []
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(name)
    spark.conf.set(name, "7")
    try:
        out = registry.thin_events(spark.createDataFrame(rows, "by string, k long, t double"), "by", "k", "t", 3, 5.0)
        assert sorted(((r.by, r.k) for r in out.collect()), key=str) == sorted(want, key=str)
        assert "FlatMapGroups" not in out._jdf.queryExecution().toString()
    finally:
        spark.conf.set(name, before)


def test_unknown_kinds(spark):
    with pytest.raises(ValueError, match="harmonic"):
        search.crossover(spark.createDataFrame([(1, [1.0], [2.0])], "pair long, a array<double>, b array<double>"), "harmonic")
    with pytest.raises(ValueError, match="range"):
        search.crossover(spark.createDataFrame([(1, [1.0], [2.0])], "pair long, a array<double>, b array<double>"), "geometric")
    with pytest.raises(ValueError, match="invert"):
        search.mutate(spark.createDataFrame([(1, [1.0])], "cand_id long, genes array<double>"), "invert", 0, 1, 1)


def test_samples_in_chunks(spark):
    rows = [("big", k % 250) for k in range(500)] + [("small", 3), (None, 4)]
    out = labels.sample_chunks(spark.createDataFrame(rows, "label string, sample_id long"), 40).orderBy("label", "chunk").collect()
    assert max(len(r.ids) for r in out) <= 40
    assert [i for r in out if r.label == "big" for i in r.ids] == list(range(250)) and [r.ids for r in out if r.label != "big"] == [[3]]


def test_results_and_merging(spark):
    a = spark.createDataFrame([("b", "1"), ("a", "2")], "metric string, value string")
    b = spark.createDataFrame([("b", "3")], "metric string, value string")
    assert registry.results_json(registry.gather_results([a, b])).first().json == '{"a":"2","b":"3"}'
    m = spark.createDataFrame([(0, "x"), (1, "y")], "model_pos long, model_id string")
    assert [r.model_pos for r in registry.merge_model_results([m, m]).orderBy("model_pos").collect()] == [0, 1, 2, 3]


def test_search(spark):
    pairs = spark.createDataFrame([(0, [1.0, 2.0], [3.0, 6.0])], "pair int, a array<double>, b array<double>")
    two = [r.genes for r in search.crossover(pairs, "arithmetic").orderBy("child").collect()]
    assert np.allclose(np.sum(two, axis=0), [4, 8])
    c = spark.createDataFrame([(1, [5.0] * 50)], "cand_id long, genes array<double>")
    out = search.mutate_uniform(c, 0.0, 1.0, 0.5).first().genes
    assert 10 < sum(x == 5.0 for x in out) < 40 and all(x == 5.0 or 0 <= x < 1 for x in out)


def test_matrix_shapes(spark):
    rng = np.random.default_rng(1)
    coords = lambda m: spark.createDataFrame([(int(i), int(j), float(m[i, j])) for i in range(m.shape[0]) for j in range(m.shape[1])], "i long, j long, v double")
    for n, k, m in ((7, 9, 8), (9, 7, 20), (1, 1, 1)):
        a, b = rng.normal(size=(n, k)), rng.normal(size=(k, m))
        for out in (metrics.matmul(coords(a), coords(b)), metrics.block_matmul(coords(a), coords(b), 4)):
            got = np.zeros((n, m))
            for r in out.collect():
                got[r.i, r.j] = r.v
            assert np.allclose(got, a @ b)


def test_scalars(spark):
    row = spark.range(1).select(scalars.clock(F.lit(3661.9)).alias("c"), *scalars.split_author(F.lit("A B <a@b>")), scalars.sine_root_fitness(F.array().cast("array<double>")).alias("z"), scalars.to_uint8(F.array(F.lit(2.0), F.lit(2.0))).alias("u")).first()
    assert (row.c, row.name, row.mail, row.z, row.u) == ("01:01:01", "A B", "a@b", 0.0, [0, 0])


def test_readers(spark, tmp_path):
    np.save(f"{tmp_path}/x.npy", np.arange(6, dtype=">i2").reshape(3, 2, order="F"))
    assert [r.features for r in readers.read_npy(spark, str(tmp_path)).orderBy("row").collect()] == [[0, 3], [1, 4], [2, 5]]
    (tmp_path / "t").mkdir()
    (tmp_path / "t/a.txt").write_text("\n".join(map(str, range(25))))
    assert [len(r.lines) for r in readers.read_text_chunks(spark, str(tmp_path / "t"), 10).orderBy("chunk").collect()] == [10, 10, 5]
    (tmp_path / "m.csv").write_text("# c\n1,2,3\n4,5,6\n")
    assert sorted(r.features for r in readers.read_matrix(spark, str(tmp_path / "m.csv"), 3, usecols=[0, 2]).collect()) == [[1, 3], [4, 6]]
    assert readers.scan_files(spark, {"train": [str(tmp_path / "t")]}).count() == 1


def stream_of(spark, path, df, files=4):
    df.repartition(files).write.parquet(path)
    return spark.readStream.schema(df.schema).option("maxFilesPerTrigger", 1).parquet(path)


def drain(query_writer, name, tmp_path):
    q = query_writer.format("memory").queryName(name).option("checkpointLocation", f"{tmp_path}/{name}").trigger(availableNow=True).start()
    assert q.awaitTermination(120)


def test_streams_match_their_batch_twins(spark, tmp_path):
    e = spark.read.parquet(f"{SF}/events.parquet").where("user_id < 5").select("event_id", F.col("ts").cast("timestamp").alias("ts"), F.col("user_id").cast("string").alias("instance"), F.col("event_type").alias("name"))
    source = stream_of(spark, f"{tmp_path}/e", e)
    drain(streams.event_profile(source, "1 day", "60 days").writeStream.outputMode("append"), "profile", tmp_path)
    assert spark.table("profile").count() == 0  # nothing is final within the watermark
    drain(streams.event_profile(source, "1 day", "60 days").writeStream.outputMode("complete"), "full", tmp_path)
    twin = e.groupBy(F.window("ts", "1 day")["start"].alias("start"), "instance", "name").agg(F.count("*").alias("n"))
    assert spark.table("full").select("start", "instance", "name", "n").exceptAll(twin).count() == 0 and spark.table("full").count() == twin.count()
    drain(streams.liveness(source, "instance", "6 hours", "60 days").writeStream.outputMode("complete"), "alive", tmp_path)
    assert spark.table("alive").count() == events.liveness(e, "instance", "6 hours").count()


def test_log_tail_drops_repeats(spark, tmp_path):
    logs = spark.createDataFrame([(k // 2, "ERROR" if k % 4 < 2 else "INFO", 1000 + k) for k in range(40)], "id int, levelname string, t int").select("id", "levelname", F.timestamp_seconds("t").alias("ts"))
    drain(streams.log_tail(stream_of(spark, f"{tmp_path}/l", logs, 1), "WARNING").writeStream.outputMode("append"), "tail", tmp_path)
    assert sorted(r.id for r in spark.table("tail").collect()) == list(range(0, 20, 2))


def test_stream_statistics_survive_a_restart(spark, tmp_path):
    s = queries.samples(spark, SF)
    source = stream_of(spark, f"{tmp_path}/s", s, 3)
    for _ in range(2):  # the second run finds nothing new
        assert streams.fit_stats_stream(source, f"{tmp_path}/stats", f"{tmp_path}/c").awaitTermination(120)
    got = {r.feature_idx: (r.n, r["min"], r["max"]) for r in streams.merged_stats(spark, f"{tmp_path}/stats").collect()}
    assert got == {r.feature_idx: (r.n, r["min"], r["max"]) for r in normalize.fit_stats(s, where=None).collect()}


def test_scratch_goes_where_spark_keeps_its_checkpoints(spark, tmp_path):
    sc, conf = spark.sparkContext, spark.conf.get("spark.checkpoint.dir", None)
    before = scratch.shared_dir(spark)
    if conf is None:
        sc.setCheckpointDir(f"{tmp_path}/user")
        assert f"{tmp_path}/user" in scratch.shared_dir(spark)
        sc.setCheckpointDir(before)
    run = scratch.Scratch(spark, "run")
    df = run.written(spark.range(5), "five")
    assert df.count() == 5 and run.path.startswith(scratch.shared_dir(spark))
    run.drop()
    with pytest.raises(Exception, match="PATH_NOT_FOUND"):
        spark.read.parquet(f"{run.path}/five-1")

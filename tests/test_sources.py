"""Images, result files, annotations, requests, sources, reports, xorshift and the live time-outs."""

import base64
import json
import os
import struct
import time
import zlib

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from sparkfeed.functions import bits
from sparkfeed.operators import events, joins, report, scoring
from sparkfeed.sources import images, readers, registry
from sparkfeed.streaming import streams


def png(path, pixels):
    h, w, _ = pixels.shape
    chunk = lambda kind, data: struct.pack(">I", len(data)) + kind + data + struct.pack(">I", zlib.crc32(kind + data))
    rows = b"".join(b"\0" + pixels[k].tobytes() for k in range(h))
    os.makedirs(os.path.dirname(path), exist_ok=True)
    with open(path, "wb") as f:
        f.write(b"\x89PNG\r\n\x1a\n" + chunk(b"IHDR", struct.pack(">IIBBBBB", w, h, 8, 2, 0, 0, 0)) + chunk(b"IDAT", zlib.compress(rows)) + chunk(b"IEND", b""))


def test_images_are_decoded_and_held_to_one_shape(spark, tmp_path):
    pixels = np.arange(2 * 3 * 3, dtype=np.uint8).reshape(2, 3, 3)
    png(f"{tmp_path}/i/a.png", pixels)
    png(f"{tmp_path}/i/sub/b.png", pixels)
    png(f"{tmp_path}/i/c.png", np.zeros((4, 4, 3), np.uint8))
    (tmp_path / "i" / "d.png").write_bytes(b"no image")
    read = images.read_images(spark, [f"{tmp_path}/i"])
    rows = {os.path.basename(r.path): r for r in read.collect()}
    assert sorted(rows) == ["a.png", "b.png", "c.png"] and (rows["a.png"].height, rows["a.png"].width, rows["a.png"].channels) == (2, 3, 3)
    assert np.array_equal(np.frombuffer(rows["a.png"].data, np.uint8).reshape(2, 3, 3), pixels[:, :, ::-1])
    names = lambda df: sorted(os.path.basename(r.path) for r in df.collect())
    assert names(images.filter_uniform_shape(read)) == ["a.png", "b.png"] and names(images.filter_uniform_shape(read, (4, 4))) == ["c.png"]
    assert images.filter_uniform_shape(read.limit(0)).count() == 0


def test_crop_that_fits_nowhere_is_null(spark):
    df = spark.createDataFrame([(1, 10, 10, 2, 4, 2, 4)], "id int, height int, width int, ymin int, ymax int, xmin int, xmax int")
    r = images.crop_windows(df, (100, 5)).first()
    assert r.crop_ymin is None and r.ratio is None and r.crop_xmax - r.crop_xmin == 5
    whole = images.crop_windows(df, (1.0, 1.0)).first()
    assert (whole.crop_ymin, whole.crop_ymax, whole.ratio) == (0, 10, 1.0)


def test_model_results_stack(spark, tmp_path):
    rng = np.random.default_rng(1)
    out = [rng.random((5, 3)).tolist() for _ in range(3)]
    orders = [["a", "b", "c"], ["c", "a", "b"], ["a", "b", "c"]]
    (tmp_path / "r.json").write_text(json.dumps({"models": [{"id": f"m{k}", "Output": out[k], "Labels": orders[k]} for k in range(3)]}, indent=1))
    results = readers.read_model_results(spark, f"{tmp_path}/r.json")
    assert [(r.model_pos, r.model_id) for r in results.orderBy("model_pos").collect()] == [(0, "m0"), (1, "m1"), (2, "m2")]
    got = [r.features for r in joins.stack_outputs(results).orderBy("sample_pos").collect()]
    want = [out[0][i] + [out[1][i][orders[1].index(x)] for x in orders[0]] + out[2][i] for i in range(5)]
    assert np.allclose(got, want)


def test_annotation_files(spark, tmp_path):
    (tmp_path / "x.png.json").write_text(json.dumps([{"left": 1, "top": 2, "width": 3, "height": 4, "name": "cat"}, {"left": 0, "top": 0, "width": 1, "height": 1}]))
    (tmp_path / "y.png.json").write_text("[]")
    (tmp_path / "z.png.json").write_text("oops")
    rows = readers.read_annotations(spark, str(tmp_path)).orderBy("box").collect()
    assert [(os.path.basename(r.image), r.box, r.ymin, r.ymax, r.xmin, r.xmax, r.name) for r in rows] == [("x.png", 0, 2, 6, 1, 4, "cat"), ("x.png", 1, 0, 1, 0, 1, None)]


def requests(spark):
    pack = lambda x: base64.b64encode(x.tobytes()).decode()
    ones = np.ones((10, 20), np.int32)
    made = {
        "list": {"input": [1, 2.5], "codec": "list"},
        "packed": {"input": pack(ones), "codec": "base64", "shape": [10, 20], "type": "int32="},
        "big": {"input": pack(np.array([1.5, -2], ">f4")), "codec": "base64", "shape": [2], "type": "float32>"},
        "short": {"input": pack(ones), "codec": "base64", "shape": [10, 21], "type": "int32="},
        "kind": {"input": pack(ones), "codec": "base64", "shape": [10, 20], "type": "object"},
        "junk": {"input": "?!", "codec": "base64", "shape": [1], "type": "int8"},
        "bare": {"input": "AA==", "codec": "base64"},
    }
    return spark.createDataFrame([(k, json.dumps(v)) for k, v in made.items()] + [("null", None), ("odd", "{")], "cid string, payload string")


def test_requests_are_decoded_or_say_why_not(spark):
    got = {r.cid: r for r in readers.decode_requests(requests(spark), "payload").collect()}
    assert got["list"].input == [1, 2.5] and got["packed"].input == [1.0] * 200 and got["packed"].shape == [10, 20] and got["big"].input == [1.5, -2.0]
    assert {k: r.error for k, r in got.items() if r.error} == {"short": "shape does not fit the data", "kind": "unknown type", "junk": "bad base64", "bare": "base64 needs shape and type", "null": "not JSON", "odd": "not JSON"}
    assert all(got[k].input is None for k in got if got[k].error)


def test_scores_go_back_under_their_ids_from_a_stream(spark, tmp_path):
    requests(spark).repartition(3).write.parquet(f"{tmp_path}/q")
    stream = spark.readStream.schema("cid string, payload string").option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/q")
    scored = scoring.score_requests(stream, lambda x: x.sum(axis=1))
    q = scored.writeStream.format("memory").queryName("scored").option("checkpointLocation", f"{tmp_path}/qc").trigger(availableNow=True).start()
    assert q.awaitTermination(120)
    got = {r.cid: r for r in spark.table("scored").collect()}
    assert len(got) == 9 and {k: r.output for k, r in got.items() if not r.error} == {"list": [3.5], "packed": [200.0], "big": [-0.5]} and all(r.output is None for r in got.values() if r.error)


def test_score_takes_batches(spark):
    out = scoring.score(spark.range(10), lambda f: pd.DataFrame({"id": f["id"], "twice": f["id"] * 2}), "id long, twice long")
    assert out.where("twice = 2 * id").count() == 10


def test_sources_are_held_to_the_contract(spark):
    good = lambda s, n=3: s.createDataFrame([(k, "train", [1.0, 2.0], "a") for k in range(n)], "sample_id long, split string, features array<double>, label string")
    registry.register_source("good", good)
    registry.register_source("ragged", lambda s: good(s).unionByName(good(s, 1).withColumn("features", F.array(F.lit(1.0)))))
    assert registry.load_source(spark, "good", n=5).count() == 5
    with pytest.raises(registry.BrokenSource):
        registry.load_source(spark, "ragged")
    with pytest.raises(KeyError):
        registry.load_source(spark, "none")
    df = spark.createDataFrame([("a/cat/1.png",)], "path string")
    assert registry.with_label(df, readers.path_label).first().label == "cat"


def test_report_as_markdown(spark, tmp_path):
    samples = spark.createDataFrame([(0, "train", "a|b", [1.0]), (1, "test", "c", [1.0])], "sample_id long, split string, label string, features array<double>")
    results = report.result_rows(spark.createDataFrame([("error", {"train": 1.5, "validation": 2.0}), ("none", {})], "metric string, values map<string,double>"))
    timings = spark.createDataFrame([("u", 1.0), ("v", 3.0)], "unit string, seconds double")
    made = report.build_report(samples, results, timings, "pointwise")
    assert made["results"].count() == 2 and made["normalization"].first().name == "pointwise"
    report.write_markdown(made, f"{tmp_path}/r.md", most=1)
    text = (tmp_path / "r.md").read_text()
    assert "## samples" in text and "a\\|b" in text and "The first 1 of 2 rows." in text


def test_json_values(spark):
    df = spark.createDataFrame([(bytearray(b"\xe9a"), None)], "b binary, n int")
    assert df.select(report.json_value(text=report.bytes_value(F.col("b")), n=F.col("n")).alias("j")).first().j == '{"text":"éa"}'


def test_xorshift_is_bit_exact(spark):
    whole, mask = np.random.default_rng(5).integers(0, 2**64, (5, 16), np.uint64), 2**64 - 1
    df = spark.createDataFrame([(k, [int(x) for x in row.view(np.int64)]) for k, row in enumerate(whole)], "k int, state array<bigint>")
    got = df.orderBy("k").select(bits.xorshift1024star(F.col("state"), 3).alias("r")).select("r.*").collect()
    for row, r in zip(whole, got, strict=True):
        s, values = [int(x) for x in row], []
        for k in range(48):
            p, q = k % 16, (k + 1) % 16
            x = s[q] ^ (s[q] << 31 & mask)
            s[q] = s[p] ^ s[p] >> 30 ^ x ^ x >> 11
            values.append(s[q] * bits.STAR & mask)
        assert [x & mask for x in r["values"]] == values and [x & mask for x in r.state] == s


def test_live_timeouts_match_the_batch(spark, tmp_path):
    rng = np.random.default_rng(2)
    rows = [(f"w{k % 3}", 1000 + k, k, float(rng.gamma(2, 40)) if k % 11 else 500.0) for k in range(90)] + [("new", 5, 900, 1.0)]
    jobs = spark.createDataFrame(rows, "worker string, t int, id long, duration_s double").select("worker", F.timestamp_seconds("t").alias("ts"), "id", "duration_s")
    for part in range(3):  # one file a micro-batch, in order of time
        jobs.where(F.floor(F.col("id") / 30) == part if part < 2 else F.col("id") >= 60).coalesce(1).write.mode("append").parquet(f"{tmp_path}/j")
    stream = spark.readStream.schema(jobs.schema).option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/j")
    q = streams.job_timeouts(stream, 20.0).writeStream.format("memory").queryName("late_jobs").outputMode("append").option("checkpointLocation", f"{tmp_path}/jc").trigger(availableNow=True).start()
    assert q.awaitTermination(120)
    tidy = lambda df: [(r.id, r.worker, None if r.limit is None else round(r.limit, 6), r.late) for r in df.orderBy("id").collect()]
    got = tidy(spark.table("late_jobs"))
    assert got == tidy(events.job_timeouts(jobs, 20.0)) and any(x[3] for x in got)


def test_list_files(spark, tmp_path):
    (tmp_path / "l.txt").write_text("a/b.png two words\n\nc.png x\n")
    (tmp_path / "t.txt").write_text("a.png\n")
    (tmp_path / "l.json").write_text('{"k": {"path": "p.png", "label": ["z", "y"]}, "e": {"path": "q.png", "label": []}}')
    read = lambda name, **k: {(r.path, r.label) for r in readers.read_file_list(spark, str(tmp_path / name), **k).collect()}
    assert read("l.txt", base_dir="/d") == {("/d/a/b.png", "two words"), ("/d/c.png", "x")} and read("l.json") == {("p.png", "z")}
    assert read("t.txt", labelled=False) == {("a.png", None)}
    with pytest.raises(Exception, match="no label for a.png"):
        read("t.txt")


def test_matrix_without_its_first_lines(spark, tmp_path):
    for k in range(3):
        (tmp_path / f"m{k}.csv").write_text("a,b\n# c\n" + "".join(f"{k},{j}\n" for j in range(4)))
    got = readers.read_matrix(spark, str(tmp_path), 2, skiprows=3).collect()
    assert sorted(tuple(r.features) for r in got) == [(k, j) for k in range(3) for j in range(1, 4)]


def test_sample_sets(spark, tmp_path):
    part = lambda name, rows, schema="sample_id long, features array<double>, label string": spark.createDataFrame(rows, schema).write.parquet(str(tmp_path / name))
    part("train", [(1, [1.0, 2.0], "a"), (2, [1.0, 2.0], "b")])
    part("test", [(3, [1.0, 2.0], "a")])
    part("wide", [(3, [1.0, 2.0, 3.0], "a")])
    part("some", [(3, [1.0, 2.0], "a"), (4, [1.0, 2.0], None)])
    part("bare", [(3, [1.0, 2.0])], "sample_id long, features array<double>")
    read = lambda **paths: readers.read_sample_sets(spark, {k: str(tmp_path / v) for k, v in paths.items()})
    assert {(r.sample_id, r.split) for r in read(train="train", test="test").collect()} == {(1, "train"), (2, "train"), (3, "test")}
    assert read(train="bare").count() == 1
    for test, why in (("wide", "shape across splits"), ("some", "labels for some only"), ("bare", "differ in columns")):
        with pytest.raises(ValueError, match=why):
            read(train="train", test=test)


def test_event_and_log_files(spark, tmp_path):
    (tmp_path / "e.json").write_text('{"session":"s","name":"n","type":"begin","time":1.5,"extra":7}\n')
    (tmp_path / "l.json").write_text('{"session":"s","node":"1","levelname":"ERROR","message":"m"}\n')
    e = readers.read_events(spark, str(tmp_path / "e.json"))
    assert (e.first().name, e.first().time) == ("n", 1.5)
    assert events.event_extras(e, "line", ["session"]).first().extras["extra"] == "7"
    assert events.filter_logs(readers.read_logs(spark, str(tmp_path / "l.json")), "WARNING").first().message == "m"
    series = events.events_to_series(e.drop("line", "props")).collect()
    assert [(r.t, r.height, r.meta) for r in series] == [(0.0, 0.0, "{}"), (0.0, 1.0, "{}")]


def test_batches_by_size_or_time(spark, tmp_path):
    rows = spark.createDataFrame([(k // 4, f"k{k % 2}", k, f"p{k}") for k in range(20)], "part int, loader string, id long, payload string")
    for part in range(5):
        rows.where(F.col("part") == part).coalesce(1).drop("part").write.mode("append").parquet(f"{tmp_path}/in")
    stream = spark.readStream.schema("loader string, id long, payload string").option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/in")
    out = streams.size_or_time_batches(stream, 3, "200 milliseconds").writeStream.format("memory").queryName("batches").outputMode("append").trigger(processingTime="100 milliseconds").option("checkpointLocation", f"{tmp_path}/c").start()
    try:
        until = time.time() + 90
        while time.time() < until and spark.table("batches").count() < 20:
            time.sleep(0.5)
    finally:
        out.stop()
    got = spark.table("batches").collect()
    assert sorted(r.id for r in got) == list(range(20)) and all(r.payload == f"p{r.id}" for r in got)
    sizes = {}
    for r in got:
        sizes.setdefault((r.key, r.batch), []).append(r.pos)
    assert all(sorted(p) == list(range(len(p))) and len(p) <= 3 for p in sizes.values())

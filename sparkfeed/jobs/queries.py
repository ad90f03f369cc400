"""The operators as queries over the given tables, each with SQL that gives the same rows."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import bits, draws, scalars
from ..functions.index import dense_index
from ..functions.scratch import scratch_path
from ..operators import batching, events, evolution, joins, labels, metrics, normalize, pixels, registry, report, scoring, search, splits
from ..sources import arrays, images, readers
from ..sources import registry as sources
from ..streaming import live, streams

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLE_SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f: Query) -> Query:
        QUERIES[f.__name__] = f
        if sql is not None:
            ORACLE_SQL[f.__name__] = sql
        return f

    return add


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


# Samples: embeddings, dealt to splits by a hash of their id; one label is test-only and one train-only.
def samples(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "embeddings")
    k = F.conv(F.substring(F.md5(F.col("vec_id").cast("string")), 1, 2), 16, 10).cast("int")
    split = F.when(k < 38, "test").when(k < 90, "validation").otherwise("train")
    return e.select(F.col("vec_id").alias("sample_id"), F.concat(F.lit("L"), F.col("label")).alias("label"), split.alias("split"), F.col("embedding").cast("array<double>").alias("features"))


S = """s AS (SELECT vec_id AS sample_id, 'L' || label AS label, CAST(embedding AS DOUBLE[]) AS features,
  CASE WHEN k < 38 THEN 'test' WHEN k < 90 THEN 'validation' ELSE 'train' END AS split
  FROM (SELECT *, ('0x' || substr(md5(CAST(vec_id AS VARCHAR)), 1, 2))::INTEGER AS k FROM embeddings))"""


def parts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Parts as samples, their brands as labels and prices as fitness."""
    p = table(spark, sf_dir, "part")
    k = F.conv(F.substring(F.md5(F.col("p_partkey").cast("string")), 1, 2), 16, 10).cast("int")
    return p.select(F.col("p_partkey").alias("sample_id"), F.col("p_brand").alias("label"), F.when(k < 26, "test").when(k < 64, "validation").otherwise("train").alias("split"))


P = """p AS (SELECT p_partkey AS sample_id, p_brand AS label, CASE WHEN k < 26 THEN 'test' WHEN k < 64 THEN 'validation' ELSE 'train' END AS split
  FROM (SELECT *, ('0x' || substr(md5(CAST(p_partkey AS VARCHAR)), 1, 2))::INTEGER AS k FROM part))"""


def run_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as those of a run: a day is a session, a user an instance."""
    e = table(spark, sf_dir, "events")
    kind = F.when(F.col("event_id") % 3 == 0, "single").when(F.col("event_id") % 3 == 1, "begin").otherwise("end")
    return e.select(
        "event_id", F.date_format("ts", "yyyy-MM-dd").alias("session"), F.col("user_id").cast("string").alias("instance"), F.col("event_type").alias("name"),
        (F.unix_micros(F.col("ts").cast("timestamp")) / 1e6).alias("time"), kind.alias("type"), F.col("value").alias("height"), "props", "ts",
    )


E = """e AS (SELECT event_id, strftime(ts, '%Y-%m-%d') AS session, CAST(user_id AS VARCHAR) AS instance, event_type AS name, epoch_us(ts) / 1e6 AS time,
  CASE event_id % 3 WHEN 0 THEN 'single' WHEN 1 THEN 'begin' ELSE 'end' END AS type, value AS height, props, ts FROM events)"""


# Labels
@query(f"WITH {S} SELECT label, row_number() OVER (ORDER BY label) - 1 AS label_id FROM (SELECT DISTINCT label FROM s WHERE split = 'train')")
def x1_label_mapping(spark, sf_dir):
    return labels.build_label_mapping(samples(spark, sf_dir))


@query(f"WITH {S}, m AS (SELECT label, row_number() OVER (ORDER BY label) - 1 AS label_id FROM (SELECT DISTINCT label FROM s WHERE split = 'train')) SELECT sample_id, split, label, label_id FROM s LEFT JOIN m USING (label)")
def j1_apply_labels(spark, sf_dir):
    s = samples(spark, sf_dir)
    return labels.apply_label_mapping(s, labels.build_label_mapping(s)).select("sample_id", "split", "label", "label_id")


@query(f"WITH {P} SELECT DISTINCT split, label FROM p WHERE split <> 'train' AND label NOT IN (SELECT label FROM p WHERE split = 'train' AND label < 'Brand#40') AND label IS NOT NULL")
def j2_unseen_labels(spark, sf_dir):
    return labels.unseen_labels(parts(spark, sf_dir).where("split <> 'train' OR label < 'Brand#40'"))


@query(f"WITH {P}, q AS (SELECT * FROM p WHERE split = 'train' OR label > 'Brand#2') SELECT split, label, count(sample_id) AS n FROM (SELECT DISTINCT split FROM q) CROSS JOIN (SELECT DISTINCT label FROM q) LEFT JOIN q USING (split, label) GROUP BY ALL")
def j3_label_counts(spark, sf_dir):
    return labels.label_counts(parts(spark, sf_dir).where("split = 'train' OR label > 'Brand#2'"))


@query(f"""WITH {P}, c AS (SELECT split, label, count(*) AS n FROM p GROUP BY ALL)
SELECT split, min_by(label, (n, label)) AS min_label, min(n) AS min_n, min_by(label, (-n, label)) AS max_label, max(n) AS max_n, round(avg(n), 6) AS mean_n, round(stddev_pop(n), 6) AS sigma, round(100 * stddev_pop(n) / avg(n), 6) AS sigma_pct FROM c GROUP BY split""")
def d3_label_summary(spark, sf_dir):
    return labels.label_stats(parts(spark, sf_dir))[0].withColumns({"mean_n": F.round("mean_n", 6), "sigma": F.round("sigma", 6), "sigma_pct": F.round("sigma_pct", 6)})


@query(f"WITH {P}, c AS (SELECT split, label, count(*) AS n FROM p GROUP BY ALL) SELECT split, label, n, round(100.0 * n / sum(n) OVER w, 6) AS share, n * 25 // max(n) OVER w AS bar FROM c WINDOW w AS (PARTITION BY split)")
def d3_label_bars(spark, sf_dir):
    return labels.label_stats(parts(spark, sf_dir))[1].withColumn("share", F.round("share", 6))


@query(f"WITH {P} SELECT count(DISTINCT label) AS labels FROM p WHERE split = 'train'")
def d4_unique_labels(spark, sf_dir):
    return labels.unique_labels(parts(spark, sf_dir))


@query(f"WITH {P}, r AS (SELECT label, sample_id, row_number() OVER (ORDER BY label, sample_id) - 1 AS k FROM (SELECT DISTINCT label, sample_id FROM p)) SELECT label, k // 100 AS chunk, array_to_string(list(sample_id ORDER BY sample_id), ',') AS ids FROM r GROUP BY ALL")
def d5_samples_by_label(spark, sf_dir):
    return labels.sample_chunks(parts(spark, sf_dir), 100).select("label", "chunk", F.array_join(F.col("ids").cast("array<string>"), ",").alias("ids"))


@query(f"WITH {P}, c AS (SELECT split, label, count(*) AS n FROM p GROUP BY ALL) SELECT split, label, round(n / sum(n) OVER (PARTITION BY split), 9) AS p FROM c")
def d6_label_distribution(spark, sf_dir):
    return labels.label_distribution(parts(spark, sf_dir)).withColumn("p", F.round("p", 9))


@query(f"""WITH {P}, c AS (SELECT split, label, count(*) AS n FROM p GROUP BY ALL), d AS (SELECT split, label, n / sum(n) OVER (PARTITION BY split) AS q FROM c)
SELECT d.split, round(sum((d.q - t.q) ** 2 / t.q), 8) AS statistic, count(*) - 1 AS degrees FROM d JOIN d t ON d.label = t.label AND t.split = 'train' WHERE d.split <> 'train' GROUP BY d.split""")
def d7_compare_distributions(spark, sf_dir):
    return labels.compare_label_distributions(parts(spark, sf_dir)).select("split", F.round("statistic", 8).alias("statistic"), "degrees")


@query(f"WITH {P} SELECT split, label, count(*) AS n FROM p GROUP BY CUBE (split, label)")
def d10_split_label_cube(spark, sf_dir):
    return labels.split_label_report(parts(spark, sf_dir))


@query(f"WITH {P} SELECT label, count(*) FILTER (split = 'test') AS test, count(*) FILTER (split = 'validation') AS validation, count(*) FILTER (split = 'train') AS train FROM p GROUP BY label")
def d10_label_table(spark, sf_dir):
    return labels.label_table(parts(spark, sf_dir))


@query(f"""WITH {P}, a AS (SELECT DISTINCT label FROM p WHERE split = 'test' AND label < 'Brand#4'), b AS (SELECT DISTINCT label FROM p WHERE split = 'train' AND label > 'Brand#2')
SELECT coalesce(a.label, b.label) AS label, CASE WHEN b.label IS NULL THEN 'left' WHEN a.label IS NULL THEN 'right' ELSE 'both' END AS side FROM a FULL JOIN b ON a.label = b.label""")
def s2_label_set_diff(spark, sf_dir):
    p = parts(spark, sf_dir)
    return labels.label_set_diff(p.where("split = 'test' AND label < 'Brand#4'"), p.where("split = 'train' AND label > 'Brand#2'"))


# Splits
RANKED = "row_number() OVER (PARTITION BY {by} ORDER BY md5('{seed}|0|' || sample_id), sample_id) - 1"


@query(f"WITH {P}, r AS (SELECT *, {RANKED.format(by='split', seed=5)} AS k, count(*) OVER (PARTITION BY split) AS n FROM p) SELECT sample_id, label, split FROM r WHERE split <> 'train' OR k < n - CAST(floor(0.3 * n) AS BIGINT)")
def f4_train_ratio(spark, sf_dir):
    return splits.take_train_ratio(parts(spark, sf_dir), 0.7, seed=5)


@query(f"WITH {P}, r AS (SELECT *, {RANKED.format(by='split = $$test$$', seed=1)} AS k, count(*) OVER (PARTITION BY split = 'test') AS n FROM p) SELECT sample_id, label, CASE WHEN split = 'test' THEN split WHEN k < round_even(0.15 * n, 0) THEN 'validation' ELSE 'train' END AS split FROM r")
def e5_random_validation(spark, sf_dir):
    return splits.resplit_validation(parts(spark, sf_dir), 0.15, seed=1)


@query(f"WITH {P}, r AS (SELECT *, {RANKED.format(by='split = $$test$$, label', seed=2)} AS k, count(*) OVER (PARTITION BY split = 'test', label) AS n FROM p) SELECT sample_id, label, CASE WHEN split = 'test' THEN split WHEN k < greatest(round_even(0.2 * n, 0), 1) THEN 'validation' ELSE 'train' END AS split FROM r")
def e6_stratified_validation(spark, sf_dir):
    return splits.resplit_validation(parts(spark, sf_dir), 0.2, seed=2, stratify="label")


@query(f"""WITH {P}, r AS (SELECT *, {RANKED.format(by='split = $$test$$, label', seed=3)} AS k, count(*) OVER (PARTITION BY split = 'test') AS n FROM p),
f AS (SELECT *, row_number() OVER (PARTITION BY split = 'test', k > 1 ORDER BY md5('3|0|' || sample_id), sample_id) - 1 AS f FROM r), c AS (SELECT count(DISTINCT label) AS labels FROM p WHERE split <> 'test')
SELECT sample_id, label, CASE WHEN split = 'test' THEN split WHEN k = 0 OR k > 1 AND f < CAST(floor(0.25 * n) AS BIGINT) - labels THEN 'validation' ELSE 'train' END AS split FROM f, c""")
def e7_covering_validation(spark, sf_dir):
    return splits.resplit_validation(parts(spark, sf_dir), 0.25, seed=3, stratify="cover")


@query(f"""WITH {P}, r AS (SELECT model, sample_id, row_number() OVER (PARTITION BY model ORDER BY md5('4|' || model || '|' || sample_id), sample_id) - 1 AS k, count(*) OVER (PARTITION BY model) AS n
  FROM p CROSS JOIN (SELECT CAST(unnest(range(5)) AS INTEGER) AS model) WHERE split = 'train') SELECT model, sample_id FROM r WHERE k < n - CAST(floor(0.1 * n) AS BIGINT)""")
def e8_bagged_subsets(spark, sf_dir):
    return splits.bag_splits(parts(spark, sf_dir), 5, 0.9, seed=4)


@query(f"WITH {P} SELECT DISTINCT split, label FROM p")
def t4_split_keys(spark, sf_dir):
    return splits.split_keys(parts(spark, sf_dir))


@query(f"WITH {P} SELECT DISTINCT 'labels for some only' AS rule, split FROM p WHERE split = 'train' OR split = 'test'")
def f8_violations(spark, sf_dir):
    bad = parts(spark, sf_dir).withColumn("label", F.when((F.col("split") == "validation") | (F.col("sample_id") % 2 == 0), F.col("label")))
    return splits.validate_samples(bad.withColumn("features", F.array(F.lit(1.0))))


@query(f"WITH {P} SELECT split, count(*) AS n, min(sample_id) AS first FROM p GROUP BY split")
def s1_union_splits(spark, sf_dir):
    p = parts(spark, sf_dir)
    one = splits.union_splits({k: p.where(F.col("split") == k).drop("split") for k in labels.SPLITS})
    return one.groupBy("split").agg(F.count("*").alias("n"), F.min("sample_id").alias("first"))


# Batches
INDEXED = """i AS (SELECT *, row_number() OVER (ORDER BY CASE split WHEN 'test' THEN 0 WHEN 'validation' THEN 1 ELSE 2 END, CASE WHEN split = 'train' THEN md5('7|2|' || sample_id) ELSE '' END, sample_id) - 1 AS global_index FROM p),
j AS (SELECT *, global_index - min(global_index) OVER (PARTITION BY split) AS split_pos FROM i)"""


@query(f"WITH {P}, {INDEXED} SELECT sample_id, split, global_index, split_pos FROM j")
def e1_sample_index(spark, sf_dir):
    return batching.index_samples(parts(spark, sf_dir), epoch=1, seed=7).select("sample_id", "split", "global_index", "split_pos")


@query(f"""WITH {P}, {INDEXED}, f AS (SELECT split, CAST(coalesce(sum(ceil(n / 32)) OVER (ORDER BY o ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS first FROM (SELECT split, count(*) AS n, min(global_index) AS o FROM j GROUP BY split))
SELECT sample_id, first + split_pos // 32 AS batch_id, split_pos % 32 AS pos_in_batch FROM j JOIN f USING (split)""")
def e2_minibatches(spark, sf_dir):
    indexed = batching.index_samples(parts(spark, sf_dir), epoch=1, seed=7)
    return batching.assign_batches(indexed, 32).select("sample_id", "batch_id", "pos_in_batch")


@query(f"""WITH {P}, c AS (SELECT split, count(*) AS n, CASE split WHEN 'test' THEN 0 WHEN 'validation' THEN 1 ELSE 2 END AS o FROM p GROUP BY split), d AS (SELECT *, CAST(sum(n) OVER (ORDER BY o) - n AS BIGINT) AS s, CAST(sum(n) OVER () AS BIGINT) AS total FROM c),
b AS (SELECT *, unnest(range(CAST(ceil(n / 32) AS BIGINT))) AS k FROM d), e AS (SELECT unnest(range(3)) AS epoch)
SELECT epoch, split, s + 32 * k AS start, least(32, n - 32 * k) AS n, epoch * total + s + 32 * k + least(32, n - 32 * k) AS served, 32 * (k + 1) >= n AS last,
  32 * (k + 1) >= n AND split = 'validation' AS epoch_ended, 32 * (k + 1) >= n AND split = 'train' AS train_ended, 32 * (k + 1) >= n AND split = 'test' AS test_ended FROM b, e""")
def e3_batch_schedule(spark, sf_dir):
    return batching.batch_schedule(parts(spark, sf_dir), 32, 3)


@query(f"WITH {P}, c AS (SELECT split, count(*) AS n FROM p GROUP BY split) SELECT CAST(sum(ceil(n / 32) * 32) AS BIGINT) AS places, CAST(sum(ceil(n / 32) * 32 - n) AS BIGINT) AS padded FROM c")
def e4_padding(spark, sf_dir):
    p = parts(spark, sf_dir).withColumns({"label_id": F.lit(1), "features": F.array(F.lit(1.0), F.lit(2.0))})
    batches = batching.assign_batches(batching.index_samples(p, epoch=1, seed=7), 32)
    return batching.pad_batches(batches, 32, 2).agg(F.count("*").alias("places"), F.sum((F.col("sample_id") == -1).cast("bigint")).alias("padded"))


@query(f"""WITH {P}, c AS (SELECT split, count(*) AS n, CASE split WHEN 'test' THEN 0 WHEN 'validation' THEN 1 ELSE 2 END AS o FROM p GROUP BY split), d AS (SELECT split, CAST(sum(n) OVER (ORDER BY o) - n AS BIGINT) AS s, CAST(sum(n) OVER (ORDER BY o) AS BIGINT) AS t FROM c)
SELECT p_partkey AS idx, split, p_partkey - s AS split_pos FROM part JOIN d ON p_partkey >= s AND p_partkey < t""")
def j9_locate_class(spark, sf_dir):
    return batching.locate_class(table(spark, sf_dir, "part").select(F.col("p_partkey").alias("idx")), batching.class_lengths(parts(spark, sf_dir)))


@query("SELECT p_partkey AS split_pos, (p_partkey // 100) * 4 + p_partkey % 100 // 30 AS chunk, p_partkey % 100 % 30 AS place FROM part")
def a11_chunk_address(spark, sf_dir):
    chunk, place = batching.chunk_address(F.col("p_partkey"), 100, 30)
    return table(spark, sf_dir, "part").select(F.col("p_partkey").alias("split_pos"), chunk.alias("chunk"), place.alias("place"))


@query(f"WITH {P}, {INDEXED} SELECT split, split_pos, sample_id, label FROM j WHERE split_pos % 20 = 7")
def a11_fetch_samples(spark, sf_dir):
    """Every twentieth sample of each split, fetched from a store of chunks by its position."""
    indexed = batching.index_samples(parts(spark, sf_dir), epoch=1, seed=7).select("split", "split_pos", "sample_id", "label")
    path = scratch_path(spark, "store")
    batching.write_chunks(indexed, path, 40, (0, 20, 10), folder_rows=200)
    wanted = batching.read_chunks(spark, path).select("split", "split_pos").where("split_pos % 20 = 7")
    return batching.fetch_samples(spark, path, wanted).select("split", "split_pos", "sample_id", "label")


@query(f"""WITH {P}, {INDEXED}, f AS (SELECT split, CAST(coalesce(sum(ceil(n / 24)) OVER (ORDER BY o ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS first FROM (SELECT split, count(*) AS n, min(global_index) AS o FROM j GROUP BY split))
SELECT sample_id, first + split_pos // 24 AS batch_id, split_pos % 24 AS pos_in_batch FROM j JOIN f USING (split)""")
def a11_rebatch(spark, sf_dir):
    """A store written in batches of 40, read in batches of 24."""
    indexed = batching.index_samples(parts(spark, sf_dir), epoch=1, seed=7).select("split", "split_pos", "sample_id", "label")
    path = scratch_path(spark, "store")
    batching.write_chunks(indexed, path, 40, (0, 20, 10), folder_rows=200)
    return batching.rebatch(spark, path, 24).select("sample_id", "batch_id", "pos_in_batch")


@query("SELECT l.event_id AS pos, l.user_id * 5 AS sample_id, coalesce(e.label, -1) AS label_id, CAST(coalesce(e.embedding[1], 0) AS DOUBLE) AS first FROM events l LEFT JOIN embeddings e ON e.vec_id = l.user_id * 5")
def j18_gather(spark, sf_dir):
    wanted = table(spark, sf_dir, "events").select(F.col("event_id").alias("pos"), (F.col("user_id") * 5).alias("sample_id"))
    have = table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("sample_id"), F.col("label").alias("label_id"), F.col("embedding").cast("array<double>").alias("features"))
    return batching.gather(wanted, have, 64).select("pos", "sample_id", "label_id", F.get("features", 0).alias("first"))


# Normalisers
ELEMENTS = "x AS (SELECT sample_id, split, label, generate_subscripts(features, 1) - 1 AS k, unnest(features) AS v FROM s)"
STATS = "t AS (SELECT k, count(*) AS n, sum(v) AS total, avg(v) AS m, min(v) AS a, max(v) AS b FROM x WHERE split = 'train' GROUP BY k)"


def _elements(df: DataFrame, *more: str) -> DataFrame:
    # an outer one, as for others the optimizer works out the features a second time to see whether they are empty
    return df.select("sample_id", *more, F.posexplode_outer("features").alias("k", "v")).where("k IS NOT NULL").withColumn("v", F.round("v", 6))


def holed(df: DataFrame) -> DataFrame:
    """Samples some of whose elements are null, NaN or infinite."""
    hole = lambda v, k: F.when((F.col("sample_id") + k) % 11 == 0, F.lit(None)).when((F.col("sample_id") + k) % 13 == 0, F.lit(float("nan"))).when((F.col("sample_id") + k) % 17 == 0, F.lit(float("inf"))).otherwise(v)
    return df.withColumn("features", F.transform("features", hole))


@query(f"WITH {S}, {ELEMENTS} SELECT k AS feature_idx, count(*) FILTER (ok) AS n, round(coalesce(sum(v) FILTER (ok), 0), 6) AS sum, min(v) FILTER (ok) AS min, max(v) FILTER (ok) AS max FROM (SELECT *, (sample_id + k) % 11 <> 0 AND (sample_id + k) % 13 <> 0 AND (sample_id + k) % 17 <> 0 AS ok FROM x) WHERE split = 'train' GROUP BY k")
def d1_fit_stats(spark, sf_dir):
    return normalize.fit_stats(holed(samples(spark, sf_dir))).withColumn("sum", F.round("sum", 6))


@query("SELECT c_custkey AS id, c_acctbal AS balance FROM (SELECT *, row_number() OVER (PARTITION BY c_nationkey ORDER BY c_custkey) AS k FROM customer) WHERE k > 3")
def a7_skip_rows(spark, sf_dir):
    """Customers as a text file for each nation, read without the first three lines of each."""
    c = table(spark, sf_dir, "customer").repartition("c_nationkey").sortWithinPartitions("c_nationkey", "c_custkey")
    path = scratch_path(spark, "matrix")
    c.select("c_nationkey", F.concat_ws(",", "c_custkey", "c_acctbal").alias("value")).write.partitionBy("c_nationkey").text(path)
    return readers.read_matrix(spark, path, 2, skiprows=3).select(F.get("features", 0).cast("bigint").alias("id"), F.get("features", 1).alias("balance"))


@query("SELECT CASE WHEN c_nationkey < 5 THEN 'test' WHEN c_nationkey < 12 THEN 'validation' ELSE 'train' END AS split, 'nation=' || c_nationkey AS label, CAST(sum(octet_length(encode(c_name)) + 1) AS BIGINT) AS length FROM customer WHERE c_nationkey <> 9 GROUP BY ALL")
def a2_scan_files(spark, sf_dir):
    """Customers as a text file for each nation, found below a folder a split and filtered by name."""
    n = F.col("c_nationkey")
    c = table(spark, sf_dir, "customer").select(F.when(n < 5, "test").when(n < 12, "validation").otherwise("train").alias("split"), n.alias("nation"), F.col("c_name").alias("value"))
    path = scratch_path(spark, "folders")
    c.repartition("split", "nation").write.partitionBy("split", "nation").text(path)
    files = readers.scan_files(spark, {k: [f"{path}/split={k}"] for k in labels.SPLITS})
    found = readers.filter_files(files, ignored=[".*/nation=9/.*"], included=[r".*\.txt"], file_type="text", subtypes=["plain"])
    return found.select("split", readers.path_label(F.col("path")).alias("label"), "length")


@query(f"WITH {S}, {ELEMENTS} SELECT sample_id, k, round(v, 6) AS v FROM x")
def a6_array_rows(spark, sf_dir):
    """Samples written as array files, their ids ahead of their features, and read again by offset."""
    path = scratch_path(spark, "arrays")
    arrays.write_arrays(samples(spark, sf_dir).select(F.concat(F.array(F.col("sample_id").cast("double")), "features").alias("features")), path, part_bytes=1 << 20)
    rows = arrays.read_arrays(spark, path, part_bytes=1 << 18)
    return _elements(rows.select(F.get("features", 0).cast("bigint").alias("sample_id"), F.slice("features", 2, F.size("features") - 1).alias("features")))


@query(f"WITH {S} SELECT sample_id, split, label, len(features) AS size FROM s")
def u2_named_source(spark, sf_dir):
    """Samples that a user's source gives, held to the contract of a data set."""
    sources.register_source("embeddings", samples)
    return sources.load_source(spark, "embeddings", sf_dir=sf_dir).select("sample_id", "split", "label", F.size("features").alias("size"))


@query(f"WITH {S} SELECT sample_id, round(list_sum(features), 5) AS total, round(list_max(features), 5) AS most FROM s")
def u6_score(spark, sf_dir):
    """A user's function of the matrix of features."""
    scored = scoring.score_features(samples(spark, sf_dir), lambda x: np.stack([x.sum(axis=1), x.max(axis=1)], axis=1))
    return scored.select("sample_id", F.round(F.get("output", 0), 5).alias("total"), F.round(F.get("output", 1), 5).alias("most"))


@query(f"WITH {S}, {ELEMENTS} SELECT k AS feature_idx, count(*) AS n, round(sum(v), 6) AS sum, min(v) AS min, max(v) AS max FROM x GROUP BY k")
def d2_merge_stats(spark, sf_dir):
    s = samples(spark, sf_dir)
    return normalize.merge_stats(*(normalize.fit_stats(s, where=f"split = '{k}'") for k in labels.SPLITS)).withColumn("sum", F.round("sum", 6))


@query(f"WITH {S}, {ELEMENTS} SELECT min(v) AS low, max(v) AS high FROM x")
def d8_data_range(spark, sf_dir):
    return normalize.data_range(samples(spark, sf_dir))


@query(f"WITH {S}, {ELEMENTS}, r AS (SELECT label, min(v) AS low, max(v) AS high FROM x GROUP BY label) SELECT label, low, high FROM r WHERE (low, high) <> (SELECT (low, high) FROM r ORDER BY label LIMIT 1)")
def d9_check_range(spark, sf_dir):
    return normalize.check_range(samples(spark, sf_dir), "label")


def _normalized(name: str, formula: str, needs_stats: bool):
    sql = f"WITH {S}, {ELEMENTS}, {STATS}, w AS (SELECT sample_id, min(v) AS lo, max(v) AS hi FROM x GROUP BY sample_id), y AS (SELECT sample_id, sum(exp(v - hi)) AS z FROM x JOIN w USING (sample_id) GROUP BY sample_id) SELECT sample_id, k, round({formula}, 6) AS v FROM x JOIN t USING (k) JOIN w USING (sample_id) JOIN y USING (sample_id)"

    def run(spark, sf_dir):
        s = samples(spark, sf_dir)
        return _elements(normalize.normalize(s, name, normalize.fit_stats(s) if needs_stats else None))

    run.__name__ = f"n_{name}"
    query(sql)(run)


for _name, _formula, _stats in (
    ("mean_disp", "(v - m) / CASE WHEN a = b THEN 1 ELSE b - a END", True),
    ("linear", "CASE WHEN hi = lo THEN 0 ELSE (v - lo) * 2 / (hi - lo) - 1 END", False),
    ("range_linear", "CASE WHEN hi = lo THEN 0 ELSE (v - lo) * 2 / (hi - lo) - 1 END", True),
    ("exp", "exp(v - hi) / z", False),
    ("none", "v", False),
    ("pointwise", "CASE WHEN a = b THEN 0 ELSE (v - a) * 2 / (b - a) - 1 END", True),
    ("internal_mean", "v - m", True),
):
    _normalized(_name, _formula, _stats)


@query(f"WITH {S}, {ELEMENTS} SELECT sample_id, k, round((v - 0.5) * 2, 6) AS v FROM x")
def n7_external_mean(spark, sf_dir):
    mean = F.array_repeat(F.lit(0.5), 64)
    return _elements(normalize.normalize(samples(spark, sf_dir), "external_mean", mean=mean, scale=2.0))


@query(f"WITH {S}, {ELEMENTS} SELECT sample_id, k, round((v - 1.5) * 0.25, 6) AS v FROM x")
def n9_mean_rdisp(spark, sf_dir):
    return _elements(normalize.mean_rdisp(samples(spark, sf_dir), F.array_repeat(F.lit(1.5), 64), F.array_repeat(F.lit(0.25), 64)))


@query(f"WITH {S}, {ELEMENTS} SELECT sample_id, k, round(v, 6) AS v FROM x")
def n_inverse_round_trip(spark, sf_dir):
    s = samples(spark, sf_dir)
    stats = normalize.fit_stats(s, where=None)
    for name in ("pointwise", "mean_disp", "linear"):
        s = normalize.denormalize(normalize.normalize(s, name, stats), name, stats).select("sample_id", "features")
    return _elements(s)


@query("WITH t AS (SELECT min(o_totalprice) AS a, max(o_totalprice) AS b FROM orders) SELECT o_orderkey AS sample_id, round((o_totalprice - a) * 2 / (b - a) - 1, 6) AS v FROM orders, t")
def n11_targets(spark, sf_dir):
    o = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("sample_id"), F.array("o_totalprice").alias("target"))
    return normalize.normalize_targets(o, "pointwise").select("sample_id", F.round(F.get("target", 0), 6).alias("v"))


@query(f"""WITH {S}, {ELEMENTS}, {STATS}, m AS (SELECT label, row_number() OVER (ORDER BY label) - 1 AS label_id FROM (SELECT DISTINCT label FROM s WHERE split = 'train'))
SELECT sample_id, label_id, k, round(CASE WHEN a = b THEN 0 ELSE (v - a) * 2 / (b - a) - 1 END, 6) AS v FROM x JOIN t USING (k) LEFT JOIN m USING (label) WHERE split <> 'train'""")
def n10_derive(spark, sf_dir):
    """New data by the normaliser, statistics and label numbers that the train split left, saved and read again."""
    s, path = samples(spark, sf_dir), scratch_path(spark, "bundle")
    normalize.save_bundle(normalize.Bundle("pointwise", normalize.fit_stats(s), labels.build_label_mapping(s)), spark, path)
    return _elements(normalize.derive_from(s.where("split <> 'train'"), normalize.load_bundle(spark, path)), "label_id")


# Joins
@query("SELECT c_custkey AS sample_id, n_name AS target FROM customer JOIN nation ON c_nationkey = n_nationkey")
def j4_targets_by_label(spark, sf_dir):
    c = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("sample_id"), F.col("c_nationkey").alias("label"))
    n = table(spark, sf_dir, "nation").select(F.col("n_nationkey").alias("label"), F.col("n_name").alias("target"))
    return joins.attach_targets(c, n).select("sample_id", "target")


@query("WITH a AS (SELECT o_orderkey, row_number() OVER (ORDER BY o_orderkey) AS k FROM orders), b AS (SELECT o_totalprice, row_number() OVER (ORDER BY o_custkey, o_orderkey) AS k FROM orders) SELECT o_orderkey AS sample_id, o_totalprice AS target FROM a JOIN b USING (k)")
def j5_targets_by_place(spark, sf_dir):
    o = table(spark, sf_dir, "orders")
    targets = o.select(F.struct("o_custkey", "o_orderkey").alias("target_id"), F.col("o_totalprice").alias("target"))
    return joins.attach_targets(o.select(F.col("o_orderkey").alias("sample_id")), targets, on=None)


@query("""WITH l AS (SELECT l_orderkey AS k, count(*) AS n, round(sum(l_quantity), 2) AS q FROM lineitem GROUP BY 1)
SELECT o_orderkey AS sample_id, array_to_string([o_totalprice, n, q, c_acctbal], '|') AS features FROM orders JOIN l ON o_orderkey = k JOIN customer ON o_custkey = c_custkey""")
def j6_feature_blocks(spark, sf_dir):
    o, c = table(spark, sf_dir, "orders"), table(spark, sf_dir, "customer")
    items = table(spark, sf_dir, "lineitem").groupBy(F.col("l_orderkey").alias("sample_id")).agg(F.array(F.count("*").cast("double"), F.round(F.sum("l_quantity"), 2)).alias("features"))
    first = o.select(F.col("o_orderkey").alias("sample_id"), F.array("o_totalprice").alias("features"))
    last = o.join(c, F.col("o_custkey") == F.col("c_custkey")).select(F.col("o_orderkey").alias("sample_id"), F.array("c_acctbal").alias("features"))
    out, _ = joins.join_features([first, items, last])
    return out.select("sample_id", F.array_join(F.transform("features", lambda x: x.cast("string")), "|").alias("features"))


@query("""WITH l AS (SELECT l_orderkey AS k, count(*) AS n, CAST(sum(CAST(l_quantity AS BIGINT)) AS BIGINT) AS q FROM lineitem GROUP BY 1)
SELECT o_orderkey AS sample_id, array_to_string([o_totalprice, n, q], '|') AS features FROM orders JOIN l ON o_orderkey = k""")
def j6_ragged_blocks(spark, sf_dir):
    """Every third order has one value more in the first block, every second in the last."""
    k = F.col("o_orderkey")
    more = lambda every, first, extra: F.when(k % every == 0, F.concat(first, F.array(extra.cast("double")))).otherwise(first)
    o = table(spark, sf_dir, "orders").select(k.alias("sample_id"), more(3, F.array("o_totalprice"), F.col("o_custkey")).alias("features"))
    items = table(spark, sf_dir, "lineitem").groupBy(F.col("l_orderkey").alias("o_orderkey")).agg(F.count("*").cast("double").alias("n"), F.sum(F.col("l_quantity").cast("bigint")).cast("double").alias("q"))
    out, _ = joins.join_features([o, items.select(k.alias("sample_id"), more(2, F.array("n", "q"), k).alias("features"))])
    return out.select("sample_id", F.array_join(F.transform("features", lambda x: x.cast("string")), "|").alias("features"))


@query("""WITH m AS (SELECT l_returnflag AS f, l_suppkey AS s, round(sum(l_quantity), 2) AS a, round(sum(l_tax), 2) AS b FROM lineitem GROUP BY ALL)
SELECT s AS sample_pos, string_agg(a || '|' || b, '|' ORDER BY f) AS features FROM m GROUP BY s""")
def j7_stack_outputs(spark, sf_dir):
    by = table(spark, sf_dir, "lineitem").groupBy("l_returnflag", F.col("l_suppkey").alias("sample_pos")).agg(F.round(F.sum("l_quantity"), 2).alias("a"), F.round(F.sum("l_tax"), 2).alias("b"))
    model = F.when(F.col("l_returnflag") == "A", 0).when(F.col("l_returnflag") == "N", 1).otherwise(2)
    pair = F.when(model == 1, F.array(F.struct(F.lit("b").alias("label"), F.col("b").alias("value")), F.struct(F.lit("a").alias("label"), F.col("a").alias("value")))).otherwise(F.array(F.struct(F.lit("a").alias("label"), F.col("a").alias("value")), F.struct(F.lit("b").alias("label"), F.col("b").alias("value"))))
    rows = by.select(model.alias("model_pos"), "sample_pos", F.posexplode(pair).alias("class_pos", "c")).select("model_pos", "sample_pos", "class_pos", "c.label", "c.value")
    return joins.stack_rows(rows).select("sample_pos", F.array_join(F.transform("features", lambda x: x.cast("string")), "|").alias("features"))


@query(f"""WITH j AS ({ORACLE_SQL["j7_stack_outputs"]}), m AS (SELECT label, row_number() OVER (ORDER BY label) - 1 AS label_id FROM (SELECT DISTINCT 'N' || s_nationkey AS label FROM supplier WHERE s_suppkey % 3 <> 0))
SELECT sample_pos, features, label_id FROM j JOIN supplier ON sample_pos = s_suppkey LEFT JOIN m ON label = 'N' || s_nationkey""")
def j8_winners(spark, sf_dir):
    """Stacked outputs with the numbers of their true labels; a label that no train row has gives none."""
    s = table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("sample_pos"), F.concat(F.lit("N"), "s_nationkey").alias("label"), F.when(F.col("s_suppkey") % 3 != 0, "train").otherwise("test").alias("split"))
    return joins.attach_winners(j7_stack_outputs(spark, sf_dir), s.select("sample_pos", "label"), labels.build_label_mapping(s))


@query("""WITH p AS (SELECT o_orderstatus AS s, o_custkey % CASE o_orderstatus WHEN 'F' THEN 5 WHEN 'O' THEN 6 ELSE 7 END AS pos, count(*) AS n, round(sum(o_totalprice), 2) AS total FROM orders WHERE o_orderstatus IN ('F', 'O', 'P') GROUP BY ALL),
a AS (SELECT s, CAST(coalesce(sum(max(pos) + 1) OVER (ORDER BY s ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS ahead FROM p GROUP BY s) SELECT pos + ahead AS model_pos, s AS run, n, total FROM p JOIN a USING (s)""")
def s3_merge_results(spark, sf_dir):
    """Models of three runs in one table, numbered on."""
    o = table(spark, sf_dir, "orders")
    run = lambda s, width: o.where(F.col("o_orderstatus") == s).groupBy((F.col("o_custkey") % width).alias("model_pos")).agg(F.count("*").alias("n"), F.round(F.sum("o_totalprice"), 2).alias("total")).withColumn("run", F.lit(s))
    return registry.merge_model_results([run("F", 5), run("O", 6), run("P", 7)])


@query("""WITH b AS (SELECT p_partkey AS id, p_size % 5 AS image, p_size AS y, p_size % 7 AS x FROM part) SELECT b.image, b.id AS box, c.s_suppkey AS crop,
  greatest(0, least(y + 10, s_nationkey + 20) - greatest(y, s_nationkey)) * greatest(0, least(x + 6, 8) - greatest(x, 2)) AS area,
  round(greatest(0, least(y + 10, s_nationkey + 20) - greatest(y, s_nationkey)) * greatest(0, least(x + 6, 8) - greatest(x, 2)) / 60, 6) AS ratio
FROM b JOIN supplier c ON b.image = s_suppkey % 5 WHERE greatest(0, least(y + 10, s_nationkey + 20) - greatest(y, s_nationkey)) * greatest(0, least(x + 6, 8) - greatest(x, 2)) > 0""")
def j11_box_overlap(spark, sf_dir):
    b = table(spark, sf_dir, "part").select((F.col("p_size") % 5).alias("image"), F.col("p_partkey").alias("box"), F.col("p_size").alias("ymin"), (F.col("p_size") + 10).alias("ymax"), (F.col("p_size") % 7).alias("xmin"), (F.col("p_size") % 7 + 6).alias("xmax"))
    c = table(spark, sf_dir, "supplier").select((F.col("s_suppkey") % 5).alias("image"), F.col("s_suppkey").alias("crop"), F.col("s_nationkey").alias("ymin"), (F.col("s_nationkey") + 20).alias("ymax"), F.lit(2).alias("xmin"), F.lit(8).alias("xmax"))
    return joins.box_overlap(b, c, digits=6)


@query("SELECT p_partkey AS image, EXISTS (SELECT 1 FROM lineitem WHERE l_partkey = p_partkey AND l_quantity > 48) AS annotated FROM part")
def j12_annotation_coverage(spark, sf_dir):
    images = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("image"))
    return joins.annotation_coverage(images, table(spark, sf_dir, "lineitem").where("l_quantity > 48").select(F.col("l_partkey").alias("image")))


@query("SELECT vec_id AS sample_id, CAST(m * 6 + r * 3 + c AS INTEGER) AS distortion, m = 1 AS mirrored, CASE r WHEN 0 THEN 0.0 ELSE 0.5 END::DOUBLE AS rotation, CAST(c AS INTEGER) AS crop FROM embeddings, (SELECT unnest(range(2)) AS m), (SELECT unnest(range(2)) AS r), (SELECT unnest(range(3)) AS c)")
def j13_distortions(spark, sf_dir):
    return joins.expand_distortions(samples(spark, sf_dir).select("sample_id"), True, [0.0, 0.5], 3)


@query(f"""WITH d AS (SELECT vec_id, CAST(d AS INTEGER) AS distortion FROM embeddings, (SELECT unnest(range(6)) AS d))
SELECT vec_id AS sample_id, distortion, ('0x' || substr(md5('5|0|' || vec_id || '|' || distortion), 1, 13))::BIGINT / 4503599627370496.0::DOUBLE < 0.5 AS mirrored, CASE distortion // 3 WHEN 0 THEN 0.0 ELSE 0.5 END::DOUBLE AS rotation, distortion % 3 AS crop FROM d""")
def j13_random_mirror(spark, sf_dir):
    return joins.expand_distortions(samples(spark, sf_dir).select("sample_id"), "random", [0.0, 0.5], 3, seed=5)


@query("""WITH v AS (SELECT l_returnflag AS unit, l_linestatus AS attr, l_linenumber AS i, round(sum(l_quantity), 2) AS a, round(sum(l_extendedprice), 2) AS b FROM lineitem GROUP BY ALL)
SELECT unit, attr, true AS comparable, round(avg(abs(a - b)), 4) AS avg_abs_diff, round(max(abs(a - b)), 4) AS max_abs_diff, round(coalesce(avg(CASE WHEN a + b <> 0 THEN abs(2 * (a - b) / (a + b)) END), CASE WHEN max(abs(a - b)) > 0 THEN 1.0 ELSE 0.0 END), 6) AS avg_rel_diff FROM v GROUP BY ALL""")
def j14_compare_tensors(spark, sf_dir):
    v = table(spark, sf_dir, "lineitem").groupBy("l_returnflag", "l_linestatus", "l_linenumber").agg(F.round(F.sum("l_quantity"), 2).alias("a"), F.round(F.sum("l_extendedprice"), 2).alias("b"))
    side = lambda c: v.groupBy(F.col("l_returnflag").alias("unit"), F.col("l_linestatus").alias("attr")).agg(F.transform(F.sort_array(F.collect_list(F.struct("l_linenumber", c))), lambda s: s[c]).alias("values"))
    out = joins.compare_tensors(side("a"), side("b"))
    return out.withColumns({"avg_abs_diff": F.round("avg_abs_diff", 4), "max_abs_diff": F.round("max_abs_diff", 4), "avg_rel_diff": F.round("avg_rel_diff", 6)})


@query("""WITH d AS (SELECT *, least(224 / (p_size * 10 + 100), 224 / (p_partkey % 300 + 50)) AS z FROM part)
SELECT p_partkey AS id, CAST(floor((224 - floor((p_size * 10 + 100) * z)) / 2) AS BIGINT) AS top, CAST(floor((224 - floor((p_partkey % 300 + 50) * z)) / 2) AS BIGINT) AS "left", CAST(floor((p_size * 10 + 100) * z) AS BIGINT) AS height, CAST(floor((p_partkey % 300 + 50) * z) AS BIGINT) AS width FROM d""")
def x5_letterbox(spark, sf_dir):
    return table(spark, sf_dir, "part").select(F.col("p_partkey").alias("id"), *joins.letterbox(F.col("p_size") * 10 + 100, F.col("p_partkey") % 300 + 50, 224, 224))


# Metrics
@query("SELECT toxic AS predicted, quality AS target, count(*) AS n, round(100.0 * count(*) / sum(count(*)) OVER (), 6) AS pct FROM labels GROUP BY ALL")
def d11_confusion_matrix(spark, sf_dir):
    return metrics.confusion_matrix(table(spark, sf_dir, "labels"), "quality", "toxic").withColumn("pct", F.round("pct", 6))


@query("""WITH c AS (SELECT toxic AS p, quality AS t, count(*) AS n FROM labels GROUP BY ALL)
SELECT CAST(sum(CASE WHEN p = t THEN n ELSE 0 END) AS BIGINT) AS "right", CAST(sum(n) AS BIGINT) AS total, max(CASE WHEN p <> t THEN n END) AS worst, round(100.0 * sum(CASE WHEN p = t THEN n ELSE 0 END) / sum(n), 6) AS accuracy FROM c""")
def d11_confusion_summary(spark, sf_dir):
    return metrics.confusion_summary(metrics.confusion_matrix(table(spark, sf_dir, "labels"), "quality", "toxic")).withColumn("accuracy", F.round("accuracy", 6))


@query("""WITH o AS (SELECT o_totalprice AS v, row_number() OVER (ORDER BY o_totalprice) - 1 AS k, count(*) OVER () AS n FROM orders),
q AS (SELECT max(n) AS n, max(CASE WHEN k = ceil((n - 1) * 0.75) THEN v END) - max(CASE WHEN k = floor((n - 1) * 0.25) THEN v END) AS iqr, min(v) AS lo, max(v) AS hi FROM o),
b AS (SELECT *, CAST(CASE WHEN iqr > 0 THEN greatest(3, round_even((hi - lo) / (2 * iqr * pow(n, -1.0 / 3)), 0)) ELSE 3 END AS INTEGER) AS bins FROM q),
c AS (SELECT CAST(least(floor((o_totalprice - lo) * bins / (hi - lo)), bins - 1) AS INTEGER) AS bin, count(*) AS n FROM orders, b GROUP BY 1),
e AS (SELECT lo, hi, bins, CAST(unnest(range(bins)) AS INTEGER) AS bin FROM b)
SELECT bin, round(lo + (hi - lo) * bin / bins, 4) AS low, round(lo + (hi - lo) * (bin + 1) / bins, 4) AS high, coalesce(n, 0) AS n FROM e LEFT JOIN c USING (bin)""")
def d12_auto_histogram(spark, sf_dir):
    return metrics.auto_histogram(table(spark, sf_dir, "orders"), "o_totalprice").withColumns({"low": F.round("low", 4), "high": F.round("high", 4)})


@query("""WITH f AS (SELECT vec_id, CAST(embedding AS DOUBLE[]) AS x FROM embeddings ORDER BY vec_id LIMIT 16), y AS (SELECT vec_id, list_transform(x, lambda v: CAST(floor((v - list_min(x)) * 24 / (list_max(x) - list_min(x))) AS INTEGER)) AS b FROM f)
SELECT vec_id, array_to_string(list_transform(range(25), lambda k: len(list_filter(b, lambda v: v = k))), ',') AS bars FROM y""")
def d13_row_histograms(spark, sf_dir):
    return metrics.row_histograms(table(spark, sf_dir, "embeddings"), "vec_id", "embedding").select("vec_id", F.array_join(F.col("bars").cast("array<string>"), ",").alias("bars"))


@query("SELECT 'l_quantity' AS series, max(l_quantity) AS max, min(l_quantity) AS min FROM lineitem UNION ALL SELECT 'l_tax', max(l_tax), min(l_tax) FROM lineitem UNION ALL SELECT 'l_discount', max(l_discount), min(l_discount) FROM lineitem")
def d14_max_min(spark, sf_dir):
    return metrics.max_min_table(table(spark, sf_dir, "lineitem"), ["l_quantity", "l_tax", "l_discount"])


@query("SELECT p_size AS generation, round(sum(p_retailprice), 2) AS sum, round(avg(p_retailprice), 4) AS average, max(p_retailprice) AS best, min(p_retailprice) AS worst, max(CASE WHEN k = n // 2 THEN p_retailprice END) AS median FROM (SELECT *, row_number() OVER (PARTITION BY p_size ORDER BY p_retailprice DESC, p_partkey) - 1 AS k, count(*) OVER (PARTITION BY p_size) AS n FROM part) GROUP BY p_size")
def d18_generation_stats(spark, sf_dir):
    return metrics.generation_stats(candidates(spark, sf_dir)).withColumns({"sum": F.round("sum", 2), "average": F.round("average", 4)})


def candidates(spark, sf_dir):
    return table(spark, sf_dir, "part").select(F.col("p_size").alias("generation"), F.col("p_partkey").alias("cand_id"), F.col("p_retailprice").alias("fitness"))


@query("""WITH g AS (SELECT p_size AS generation, round(sum(p_retailprice), 2) AS a, round(avg(p_retailprice), 4) AS b, max(p_retailprice) AS c, min(p_retailprice) AS d, max(CASE WHEN k = n // 2 THEN p_retailprice END) AS e
  FROM (SELECT *, row_number() OVER (PARTITION BY p_size ORDER BY p_retailprice DESC, p_partkey) - 1 AS k, count(*) OVER (PARTITION BY p_size) AS n FROM part) GROUP BY p_size)
SELECT generation, coalesce(NOT (a > lag(a) OVER w OR b > lag(b) OVER w OR c > lag(c) OVER w OR d > lag(d) OVER w OR e > lag(e) OVER w), false) OR generation > 45 AS stop FROM g WINDOW w AS (ORDER BY generation)""")
def e15_convergence(spark, sf_dir):
    stats = metrics.generation_stats(candidates(spark, sf_dir)).withColumns({"sum": F.round("sum", 2), "average": F.round("average", 4)})
    return metrics.convergence(stats, 45)


MATRIX = "m AS (SELECT l_suppkey AS i, l_linenumber AS j, CAST(sum(CAST(l_quantity AS BIGINT)) AS DOUBLE) AS v FROM lineitem GROUP BY ALL)"


def _matrix(spark, sf_dir):
    return table(spark, sf_dir, "lineitem").groupBy(F.col("l_suppkey").alias("i"), F.col("l_linenumber").cast("bigint").alias("j")).agg(F.sum(F.col("l_quantity").cast("bigint")).cast("double").alias("v"))


@query(f"WITH {MATRIX} SELECT a.j AS i, b.j AS j, sum(a.v * b.v) * 2 AS v FROM m a JOIN m b ON a.i = b.i GROUP BY ALL")
def d19_matmul(spark, sf_dir):
    m = _matrix(spark, sf_dir)
    return metrics.matmul(m, m, alpha=2.0, ta=True)


@query(f"WITH {MATRIX} SELECT a.j AS i, b.j AS j, sum(a.v * b.v) AS v FROM m a JOIN m b ON a.i = b.i GROUP BY ALL")
def d19_block_matmul(spark, sf_dir):
    m = _matrix(spark, sf_dir)
    return metrics.block_matmul(m.select(F.col("j").alias("i"), F.col("i").alias("j"), "v"), m, 64)


@query(f"WITH {MATRIX} SELECT i, sum(v) AS total FROM m GROUP BY i")
def d20_row_sums(spark, sf_dir):
    return metrics.matrix_sums(_matrix(spark, sf_dir), "row")


@query("SELECT source, CAST(sum(strlen(text)) AS BIGINT) AS bytes FROM documents GROUP BY source ORDER BY 2 DESC, 1 LIMIT 5")
def d21_largest_parts(spark, sf_dir):
    return metrics.largest_parts(table(spark, sf_dir, "documents"), "source", "text", 1000)


@query("SELECT user_id, event_id, position FROM (SELECT user_id, event_id, row_number() OVER (PARTITION BY user_id ORDER BY event_id) - 1 AS position, row_number() OVER (PARTITION BY user_id ORDER BY event_id DESC) AS k FROM events) WHERE k <= 11")
def e9_metric_tail(spark, sf_dir):
    return metrics.metric_tail(table(spark, sf_dir, "events").select("user_id", "event_id"), "user_id", "event_id")


@query("SELECT p_partkey, p_type, round(min(p_retailprice) OVER (PARTITION BY p_type) / p_retailprice, 9) AS rating FROM part")
def e14_relative_rating(spark, sf_dir):
    return metrics.relative_rating(table(spark, sf_dir, "part"), "p_type", "p_retailprice").select("p_partkey", "p_type", F.round("rating", 9).alias("rating"))


@query("SELECT p_brand, p_partkey, round((-lead(y, 2) OVER w + 8 * lead(y) OVER w - 8 * lag(y) OVER w + lag(y, 2) OVER w) / 6, 4) + 0.0 AS derivative FROM (SELECT *, p_retailprice AS y FROM part) WINDOW w AS (PARTITION BY p_brand ORDER BY p_partkey)")
def e16_derivative(spark, sf_dir):
    out = metrics.numeric_derivative(table(spark, sf_dir, "part"), "p_brand", "p_partkey", "p_retailprice", 0.5)
    return out.select("p_brand", "p_partkey", (F.round("derivative", 4) + 0.0).alias("derivative"))


# Events
@query(f"WITH {E} SELECT event_id, time FROM e WHERE name IN ('click', 'view') AND time > 1704153600 AND time < 1705000000")
def f6_slice_events(spark, sf_dir):
    return events.slice_events(run_events(spark, sf_dir), names=["click", "view"], after=1704153600.0, before=1705000000.0).select("event_id", "time")


LEVEL = "CASE event_id % 5 WHEN 0 THEN 'DEBUG' WHEN 1 THEN 'INFO' WHEN 2 THEN 'WARNING' WHEN 3 THEN 'ERROR' ELSE 'CRITICAL' END"


@query(f"SELECT event_id, {LEVEL} AS levelname FROM events WHERE event_id % 5 >= 2 AND user_id = 7")
def f5_filter_logs(spark, sf_dir):
    logs = table(spark, sf_dir, "events").select("event_id", F.expr(LEVEL).alias("levelname"), F.col("user_id").alias("node"), F.lit("s").alias("session"))
    return events.filter_logs(logs, "WARNING", "s", 7).select("event_id", "levelname")


@query(f"""WITH {E}, g AS (SELECT *, time - min(time) OVER (PARTITION BY session) AS t FROM e)
SELECT event_id, round(t, 3) AS t, to_json({{'event_id': event_id, 'props': props}}) AS meta, k, CASE WHEN type = 'single' THEN CASE k WHEN 1 THEN h ELSE 0 END WHEN type = 'begin' THEN CASE k WHEN 1 THEN h ELSE 0 END ELSE CASE k WHEN 0 THEN h ELSE 0 END END AS height
FROM (SELECT *, coalesce(height, 1.0) AS h, CAST(unnest(range(CASE WHEN type = 'single' THEN 3 ELSE 2 END)) AS INTEGER) AS k FROM g)""")
def f7_event_series(spark, sf_dir):
    e = run_events(spark, sf_dir).withColumn("name", F.col("event_id"))
    return events.events_to_series(e, ["event_id", "props"]).select(F.col("name").alias("event_id"), F.round("t", 3).alias("t"), "meta", "k", "height")


@query("SELECT event_id, CAST(json_extract_string(props, '$.k') AS VARCHAR) AS k, 0 AS clashes FROM events")
def a15_event_extras(spark, sf_dir):
    out = events.event_extras(table(spark, sf_dir, "events"), "props", ["session", "time", "name"])
    return out.select("event_id", F.col("extras")["k"].alias("k"), F.size("clashes").alias("clashes"))


@query(f"""WITH {E}, o AS (SELECT session, instance, name, count(*) AS n, min(time) AS a, max(time) AS b FROM e GROUP BY ALL)
SELECT session, instance, count(*) AS names, CAST(sum(n) AS BIGINT) AS n, min(a) AS first, max(b) AS last, string_agg(name || ':' || n, ',' ORDER BY name) AS details FROM o GROUP BY ALL""")
def d15_event_profile(spark, sf_dir):
    out = events.event_profile(run_events(spark, sf_dir))
    return out.select("session", "instance", F.size("details").alias("names"), F.aggregate("details", F.lit(0).cast("bigint"), lambda a, d: a + d["n"]).alias("n"), "first", "last", F.array_join(F.transform("details", lambda d: F.concat(d["name"], F.lit(":"), d["n"])), ",").alias("details"))


@query("""WITH c AS (SELECT event_type AS name, user_id % 3 AS instance, count(*) AS n, min(event_id) AS lo, max(event_id) AS hi FROM events GROUP BY ALL)
SELECT instance, name, CAST(event_id AS BIGINT) AS time, false AS collapsed FROM events JOIN c ON name = event_type AND instance = user_id % 3 WHERE n <= 660 UNION ALL SELECT instance, name, unnest([lo, hi]), true FROM c WHERE n > 660""")
def d22_cap_series(spark, sf_dir):
    e = table(spark, sf_dir, "events").select(F.lit("s").alias("session"), (F.col("user_id") % 3).alias("instance"), F.col("event_type").alias("name"), F.col("event_id").alias("time"))
    return events.cap_series(e, 660).drop("session")


@query(f"WITH {E}, m AS (SELECT instance, max(time) AS last FROM e GROUP BY 1) SELECT count(*) AS n, count(DISTINCT instance) AS sessions FROM e JOIN m USING (instance) WHERE (SELECT max(time) FROM e) - last <= 20000")
def j15_retention(spark, sf_dir):
    e = run_events(spark, sf_dir).select(F.col("instance").alias("session"), "time")
    now = e.agg(F.max("time")).first()[0] or 0.0
    return events.expire_sessions(e, "time", now, 20000.0)[0].agg(F.count("*").alias("n"), F.count_distinct("session").alias("sessions"))


def worker_points(spark, sf_dir):
    return run_events(spark, sf_dir).select(F.col("instance").alias("worker"), F.col("time").alias("ts"), F.col("event_id").alias("id"), F.col("height").alias("duration_s"))


@query(f"WITH {E} SELECT instance AS worker, event_id AS id, round(time - lag(time) OVER (PARTITION BY instance ORDER BY time, event_id), 3) AS delta FROM e")
def e10_iteration_deltas(spark, sf_dir):
    return events.iteration_deltas(worker_points(spark, sf_dir)).select("worker", "id", F.round("delta", 3).alias("delta"))


@query(f"""WITH {E}, l AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY instance ORDER BY time DESC, event_id DESC) AS k FROM e) WHERE k <= 30), d AS (SELECT instance, min(time) AS a, max(time) AS b FROM l GROUP BY 1), s AS (SELECT max(a) AS s FROM d)
SELECT instance AS worker, event_id AS id FROM l JOIN d USING (instance), s WHERE b > s AND time >= s""")
def e11_aligned_timings(spark, sf_dir):
    return events.aligned_timings(worker_points(spark, sf_dir), 30).select("worker", "id")


@query(f"WITH {E}, l AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY instance ORDER BY ts DESC, event_id DESC) AS k FROM e) WHERE k = 1) SELECT instance AS run_id, event_id AS id, name AS status FROM l WHERE (SELECT max(time) FROM e) - time <= 10000")
def e12_latest_status(spark, sf_dir):
    e = run_events(spark, sf_dir).select(F.col("instance").alias("run_id"), F.col("time").alias("ts"), F.col("event_id").alias("id"), F.col("name").alias("status"))
    now = e.agg(F.max("ts")).first()[0] or 0.0
    return events.latest_status(e, now, 10000.0).select("run_id", "id", "status")


@query(f"""WITH {E}, l AS (SELECT instance AS worker, event_id AS id, height AS d, CASE WHEN count(height) OVER w >= 3 THEN greatest(avg(height) OVER w + 3 * stddev_pop(height) OVER w, 20) END AS lim FROM e WINDOW w AS (PARTITION BY instance ORDER BY time, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING))
SELECT worker, id, round(lim, 4) AS "limit", coalesce(d > lim, false) AS late FROM l""")
def e13_job_timeouts(spark, sf_dir):
    return events.job_timeouts(worker_points(spark, sf_dir), 20.0).select("worker", "id", F.round("limit", 4).alias("limit"), "late")


@query("""WITH t AS (SELECT l_shipmode AS unit, s FROM (SELECT CAST(l_suppkey AS VARCHAR) AS l_shipmode, CAST(sum(CAST(l_quantity AS BIGINT)) AS BIGINT) AS s FROM lineitem GROUP BY 1)), a AS (SELECT CAST(sum(s) AS BIGINT) AS z FROM t)
SELECT * FROM (SELECT unit, s AS seconds, round(100.0 * s / z, 6) AS pct FROM t, a ORDER BY s DESC, unit LIMIT 5) UNION ALL SELECT 'all', z, 100.0 FROM a""")
def d16_unit_times(spark, sf_dir):
    rows = table(spark, sf_dir, "lineitem").select("l_suppkey", F.col("l_quantity").cast("bigint").alias("q"))
    return events.unit_time_stats(rows, "l_suppkey", "q").withColumn("pct", F.round("pct", 6))


@query("""WITH w AS (SELECT s_suppkey AS worker, CASE s_suppkey % 4 WHEN 0 THEN 'Offline' WHEN 1 THEN 'Idle' ELSE 'Working' END AS state, (SELECT count(*) FROM lineitem WHERE l_suppkey = s_suppkey) * (s_suppkey % 9) AS jobs, s_acctbal AS power FROM supplier),
o AS (SELECT avg(jobs) AS m, stddev_samp(jobs) AS s, greatest(max(power), 1) AS p FROM w WHERE state <> 'Offline'), c AS (SELECT count(*) FILTER (state <> 'Offline') AS online, count(*) FILTER (state = 'Offline') AS offline FROM w)
SELECT worker, state, jobs, round(m, 4) AS mean_jobs, round(s, 4) AS sigma, coalesce(state = 'Working' AND jobs < m - 2 * s, false) AS warning, CASE WHEN power / p >= 0.7 THEN 'high' WHEN power / p >= 0.4 THEN 'middle' ELSE 'low' END AS tier, online, offline FROM w, o, c""")
def d17_worker_health(spark, sf_dir):
    jobs = table(spark, sf_dir, "lineitem").groupBy(F.col("l_suppkey").alias("s_suppkey")).agg(F.count("*").alias("n"))
    state = F.when(F.col("s_suppkey") % 4 == 0, "Offline").when(F.col("s_suppkey") % 4 == 1, "Idle").otherwise("Working")
    w = table(spark, sf_dir, "supplier").join(jobs, "s_suppkey", "left").select(F.col("s_suppkey").alias("worker"), state.alias("state"), (F.coalesce("n", F.lit(0)) * (F.col("s_suppkey") % 9)).alias("jobs"), F.col("s_acctbal").alias("power"))
    return events.worker_health(w).withColumns({"mean_jobs": F.round("mean_jobs", 4), "sigma": F.round("sigma", 4)})


@query("SELECT c_custkey AS worker FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders WHERE o_orderstatus = 'F')")
def j16_hung_workers(spark, sf_dir):
    return events.hung_workers(table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("worker")), table(spark, sf_dir, "orders").where("o_orderstatus = 'F'").select(F.col("o_custkey").alias("worker")))


@query("SELECT tick, k // 4 AS batch, count(*) AS n FROM (SELECT time_bucket(INTERVAL 1 HOUR, ts) AS tick, row_number() OVER (PARTITION BY time_bucket(INTERVAL 1 HOUR, ts) ORDER BY ts, event_id) - 1 AS k FROM events) GROUP BY ALL")
def w1_micro_batches(spark, sf_dir):
    return events.micro_batches(table(spark, sf_dir, "events"), 4, "1 hour")


@query("""WITH g AS (SELECT *, CASE WHEN ts - lag(ts) OVER (PARTITION BY user_id ORDER BY ts) < INTERVAL 6 HOUR THEN 0 ELSE 1 END AS new FROM events), h AS (SELECT *, sum(new) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS span FROM g)
SELECT user_id, min(ts) AS first, max(ts) AS last, count(*) AS beats FROM h GROUP BY user_id, span""")
def w3_liveness(spark, sf_dir):
    return events.liveness(table(spark, sf_dir, "events"), "user_id", "6 hours")


@query("""WITH e AS (SELECT DISTINCT user_id, epoch_us(ts) AS t FROM events), n AS (SELECT *, lag(t) OVER w AS p, lead(t) OVER w AS q FROM e WINDOW w AS (PARTITION BY user_id ORDER BY t))
SELECT CAST(user_id AS VARCHAR) AS key, 'dropped' AS kind, t + 21600000000 AS at FROM n WHERE q IS NULL OR q > t + 21600000000 UNION ALL SELECT CAST(user_id AS VARCHAR), 'revived', t FROM n WHERE t - p > 21600000000""")
def w6_status_changes(spark, sf_dir):
    """The batch twin of the stream with state: when users fall silent for six hours, and come back."""
    return live.status_changes_batch(table(spark, sf_dir, "events"), "user_id", "6 hours", forget=None).withColumn("at", F.unix_micros("at"))


@query("""WITH e AS (SELECT event_id, epoch_us(ts) AS t, event_id * 7919 % 40 AS batch FROM events), m AS (SELECT batch, max(t) AS m FROM e GROUP BY 1), k AS (SELECT batch, max(m) OVER (ORDER BY batch ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS mark FROM m)
SELECT batch, event_id FROM e JOIN k USING (batch) WHERE t <= mark - 1728000000000""")
def w7_late_rows(spark, sf_dir):
    """Events that arrive in forty batches, out of order, and more than twenty days behind."""
    e = table(spark, sf_dir, "events").withColumn("batch", F.col("event_id") * 7919 % 40)
    return live.late_rows_batch(e, "batch", "20 days").select("batch", "event_id")


# Streams. The table comes as files of a folder, which the stream reads until there are no more.
def _arriving(spark: SparkSession, df: DataFrame, path: str) -> DataFrame:
    """A stream of the rows that are, or will be, in the folder ``path``, which gets those of ``df``."""
    df.write.mode("append").parquet(path)
    return spark.readStream.schema(df.schema).parquet(path)


def _arrived(stream: DataFrame, path: str) -> DataFrame:
    """The rows that a stream gives in append mode until all that there is has been read."""
    sink = stream.writeStream.format("parquet").option("path", f"{path}/rows").option("checkpointLocation", f"{path}/checkpoint")
    sink.outputMode("append").trigger(availableNow=True).start().awaitTermination()
    return stream.sparkSession.read.schema(stream.schema).parquet(f"{path}/rows")


def _timed(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events").withColumn("ts", F.col("ts").cast("timestamp"))


@query("""WITH w AS (SELECT epoch_us(time_bucket(INTERVAL 1 HOUR, ts)) AS start, CAST(user_id AS VARCHAR) AS instance, event_type AS name, epoch_us(ts) AS t FROM events)
SELECT start, instance, name, count(*) AS n, min(t) AS first, max(t) AS last FROM w WHERE start + 3600000000 <= (SELECT (max(epoch_us(ts)) // 1000 - 86400000) * 1000 FROM events) GROUP BY ALL""")
def w2_event_profile(spark, sf_dir):
    """Events by the hour, as a stream gives them: hours that end a day before the last event."""
    path = scratch_path(spark, "profile")
    e = _timed(spark, sf_dir).select("ts", F.col("user_id").cast("string").alias("instance"), F.col("event_type").alias("name"))
    out = _arrived(streams.event_profile(_arriving(spark, e, f"{path}/in"), "1 hour", "1 day"), path)
    return out.withColumns({c: F.unix_micros(c) for c in ("start", "first", "last")})


@query(f"""WITH {S}, {ELEMENTS}, v AS (SELECT *, CASE split WHEN 'validation' THEN 0 WHEN 'test' THEN 1 ELSE 2 END AS version FROM x),
g AS (SELECT version, k, min(v) AS a, max(v) AS b FROM v GROUP BY ALL), t AS (SELECT version, k, min(a) OVER w AS a, max(b) OVER w AS b FROM g WINDOW w AS (PARTITION BY k ORDER BY version))
SELECT sample_id, version, k, round(CASE WHEN a = b THEN 0 ELSE (v - a) * 2 / (b - a) - 1 END, 6) AS v FROM v JOIN t USING (version, k)""")
def w4_normalized_stream(spark, sf_dir):
    """Splits that arrive one after the other, each normalised by the statistics of those so far; the
    stream is started anew for each."""
    path, s = scratch_path(spark, "normalized"), samples(spark, sf_dir).select("sample_id", "split", "features")
    for split in ("validation", "test", "train"):
        live.normalize_stream(_arriving(spark, s.where(F.col("split") == split), f"{path}/in"), "pointwise", path, f"{path}/checkpoint").awaitTermination()
    return _elements(live.normalized_rows(spark, path), "version")


@query("SELECT 'c' || event_id AS cid, CASE WHEN event_id % 3 = 0 THEN round(value * 2, 4) END AS total, CASE event_id % 3 WHEN 1 THEN 'not JSON' WHEN 2 THEN 'unknown codec' END AS error FROM events")
def w5_results_by_id(spark, sf_dir):
    """Requests that arrive twice, scored by a user's function, each result once under its request's id."""
    v, k = F.col("value").cast("string"), F.col("event_id") % 3
    payload = F.when(k == 0, F.concat(F.lit('{"input":['), v, F.lit(","), v, F.lit('],"codec":"list"}'))).when(k == 1, F.lit("{oops")).otherwise(F.lit('{"input":[1],"codec":"zip"}'))
    requests = table(spark, sf_dir, "events").select(F.concat(F.lit("c"), "event_id").alias("cid"), payload.alias("payload"))
    path = scratch_path(spark, "requests")
    for again in (requests.where("substr(cid, -1) < '7'"), requests):
        scored = scoring.score_requests(_arriving(spark, again, f"{path}/in"), lambda x: x.sum(axis=1))
        live.send_results(scored, path, f"{path}/checkpoint").awaitTermination()
    return live.results(spark, path).select("cid", F.round(F.get("output", 0), 4).alias("total"), "error")


@query(f"""WITH {E}, l AS (SELECT instance AS worker, event_id AS id, epoch_us(ts) AS us, height AS d, CASE WHEN count(height) OVER w >= 3 THEN greatest(avg(height) OVER w + 3 * stddev_pop(height) OVER w, 20) END AS lim FROM e WINDOW w AS (PARTITION BY instance ORDER BY ts, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING))
SELECT worker, id, round(lim, 4) AS "limit", coalesce(d > lim, false) AS late FROM l WHERE us <= (SELECT (max(us) // 1000 - 600000) * 1000 FROM l)""")
def w6_job_timeouts(spark, sf_dir):
    """Jobs that take too long, as a stream with state tells them: those ten minutes before the last event."""
    path = scratch_path(spark, "jobs")
    jobs = _timed(spark, sf_dir).select(F.col("user_id").cast("string").alias("worker"), "ts", F.col("event_id").alias("id"), F.col("value").alias("duration_s"))
    with live.state_store(spark):
        out = _arrived(live.job_timeouts(_arriving(spark, jobs, f"{path}/in"), 20.0, "10 minutes"), path)
    return out.select("worker", "id", F.round("limit", 4).alias("limit"), F.coalesce("late", F.lit(False)).alias("late"))


@query(f"SELECT event_id, {LEVEL} AS levelname FROM events WHERE event_id % 5 >= 2")
def w7_log_tail(spark, sf_dir):
    """Log rows of a level or worse, some of which are sent twice, each once."""
    path = scratch_path(spark, "logs")
    logs = _timed(spark, sf_dir).select("event_id", "ts", F.expr(LEVEL).alias("levelname"), F.lit("s").alias("session"))
    sent = logs.unionByName(logs.where("event_id % 4 = 1"))
    return _arrived(streams.log_tail(_arriving(spark, sent, f"{path}/in"), "WARNING", keys=("event_id",)), path).select("event_id", "levelname")


# Snapshots and versions
@query("SELECT o_custkey AS id, o_orderpriority AS log_id, max(o_orderdate) AS timestamp, max_by(CAST(o_orderkey AS VARCHAR), (o_orderdate, CAST(o_orderkey AS VARCHAR))) AS name FROM orders GROUP BY ALL")
def a13_latest_snapshot(spark, sf_dir):
    o = table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("id"), F.col("o_orderpriority").alias("log_id"), F.col("o_orderdate").alias("timestamp"), F.col("o_orderkey").cast("string").alias("name"))
    return registry.latest_snapshot(o)


@query("""SELECT name, commit_id, place, CASE WHEN place > 0 AND message = 'master' THEN 'HEAD@{' || place || '}' ELSE message END AS version FROM (SELECT o_custkey AS name, o_orderkey AS commit_id, CASE WHEN o_orderkey % 2 = 0 THEN 'master' ELSE o_orderstatus END AS message,
  row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate DESC, o_orderkey) - 1 AS place FROM orders)""")
def e17_version_history(spark, sf_dir):
    return registry.version_history(_packages(spark, sf_dir)).select("name", "commit_id", "place", "version")


def _packages(spark, sf_dir):
    o = table(spark, sf_dir, "orders")
    return o.select(F.col("o_custkey").alias("name"), F.col("o_orderkey").alias("commit_id"), F.col("o_orderdate").alias("commit_time"), F.when(F.col("o_orderkey") % 2 == 0, "master").otherwise(F.col("o_orderstatus")).alias("message"))


@query("SELECT o_custkey AS name, min_by(o_orderkey, (-epoch_us(o_orderdate), o_orderkey)) AS commit_id, max(o_orderdate) AS commit_time FROM orders GROUP BY 1")
def e17_package_list(spark, sf_dir):
    return registry.package_list(_packages(spark, sf_dir)).select("name", "commit_id", "commit_time")


@query(f"""WITH RECURSIVE {E}, n AS (SELECT event_id, instance, time, row_number() OVER (PARTITION BY instance ORDER BY time, event_id) AS k, count(*) OVER (PARTITION BY instance) AS c FROM e),
w AS (SELECT DISTINCT instance, CAST(0 AS BIGINT) AS r, CAST(NULL AS BIGINT) AS event_id, CAST(NULL AS DOUBLE) AS time, CAST(-1e300 AS DOUBLE) AS last, false AS kept FROM n
  UNION ALL SELECT n.instance, w.r + 1, n.event_id, n.time, CASE WHEN n.time - w.last >= 3600 THEN n.time ELSE w.last END, n.time - w.last >= 3600 FROM w JOIN n ON n.instance = w.instance AND n.k = 3 * (w.r + 1))
SELECT event_id, instance, time FROM w WHERE kept UNION ALL SELECT event_id, instance, time FROM n WHERE k = c AND c % 3 <> 0""")
def e18_thin_events(spark, sf_dir):
    return registry.thin_events(run_events(spark, sf_dir).select("event_id", "instance", "time"), "instance", "event_id", "time", 3, 3600.0)


@query("SELECT metric, value FROM (SELECT 'n_' || event_type AS metric, CAST(count(*) AS VARCHAR) AS value FROM events GROUP BY event_type) WHERE metric <> 'n_click' UNION ALL SELECT 'n_click', 'later'")
def a12_gather_results(spark, sf_dir):
    counts = table(spark, sf_dir, "events").groupBy("event_type").agg(F.count("*").cast("string").alias("value")).select(F.concat(F.lit("n_"), F.col("event_type")).alias("metric"), "value")
    return registry.gather_results([counts, counts.where("metric = 'n_click'").withColumn("value", F.lit("later"))])


# Candidates
@query("SELECT p_size AS generation, p_partkey AS cand_id, p_retailprice AS fitness FROM part ORDER BY p_retailprice DESC, p_partkey LIMIT 50")
def t1_top_candidates(spark, sf_dir):
    return search.top_candidates(candidates(spark, sf_dir), 50)


UNIT = "('0x' || substr(md5('{seed}|0|' || id), 1, 13))::BIGINT / 4503599627370496.0::DOUBLE"


@query(f"""WITH c AS (SELECT p_partkey AS cand_id, CAST(sum(p_size) OVER (ORDER BY p_partkey) - p_size AS DOUBLE) / sum(p_size) OVER () AS lo, CAST(sum(p_size) OVER (ORDER BY p_partkey) AS DOUBLE) / sum(p_size) OVER () AS hi FROM part),
d AS (SELECT id AS draw, {UNIT.format(seed=9)} AS u FROM (SELECT unnest(range(1500)) AS id)) SELECT draw, cand_id FROM d JOIN c ON u > lo AND u <= hi""")
def j10_weighted_sample(spark, sf_dir):
    p = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("cand_id"), F.col("p_size").alias("w"))
    return search.weighted_sample(p, "w", 1500, seed=9)


DRAWN = f"k AS (SELECT p_partkey AS cand_id, p_retailprice AS fitness, row_number() OVER (ORDER BY p_partkey) - 1 AS k FROM part), n AS (SELECT count(*) AS n FROM part), d AS (SELECT id AS draw, CAST(floor({UNIT.format(seed=11)} * n) AS BIGINT) AS k FROM (SELECT unnest(range(n // 2)) AS id, n FROM n))"


@query(f"WITH {DRAWN} SELECT draw, cand_id FROM d JOIN k USING (k)")
def t3_random_parents(spark, sf_dir):
    c = candidates(spark, sf_dir)
    return search.sample_with_replacement(c, c.count() // 2, seed=11)


@query(f"WITH {DRAWN} SELECT draw, cand_id, fitness FROM d JOIN k USING (k) ORDER BY fitness, cand_id, draw LIMIT (SELECT n // 10 FROM n)")
def t2_tournament(spark, sf_dir):
    return search.tournament(candidates(spark, sf_dir), seed=11)


@query("SELECT CAST(c AS BIGINT) AS cand_id, round(avg(l_extendedprice * (1 - l_discount * c / 10)), 4) AS fitness FROM lineitem, (SELECT unnest(range(8)) AS c) GROUP BY c")
def j17_score_candidates(spark, sf_dir):
    cands = spark.range(8).select(F.col("id").alias("cand_id"), (F.col("id") / 10).alias("w"))
    out = search.score_candidates(cands, table(spark, sf_dir, "lineitem"), F.avg(F.col("l_extendedprice") * (1 - F.col("l_discount") * F.col("w"))))
    return out.withColumn("fitness", F.round("fitness", 4))


@query("""WITH g AS (SELECT p_partkey, [CAST(p_size AS DOUBLE), p_retailprice % 100, 3.0] AS a, [1.0, 2.0, CAST(p_size AS DOUBLE)] AS b FROM part), d AS (SELECT *, [0, 1, 2] AS i FROM g)
SELECT p_partkey AS pair, 0 AS child, array_to_string(list_transform(i, lambda k: CAST(round(CASE WHEN ('0x' || substr(md5('3|' || p_partkey || '|' || k), 1, 13))::BIGINT / 4503599627370496.0::DOUBLE < 0.5 THEN a[k + 1] ELSE b[k + 1] END, 4) AS VARCHAR)), '|') AS genes FROM d""")
def x11_uniform_crossover(spark, sf_dir):
    pairs = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("pair"), F.array(F.col("p_size").cast("double"), F.col("p_retailprice") % 100, F.lit(3.0)).alias("a"), F.array(F.lit(1.0), F.lit(2.0), F.col("p_size").cast("double")).alias("b"))
    return search.crossover(pairs, "uniform", 3).withColumn("genes", F.array_join(F.transform("genes", lambda x: F.round(x, 4).cast("string")), "|"))


@query("""WITH d AS (SELECT p_partkey AS k, [CAST(p_size AS DOUBLE), p_retailprice % 100, 3.0] AS a, [1.0, 2.0, CAST(p_size AS DOUBLE)] AS b FROM part),
u AS (SELECT *, list_transform([0, 1, 2], lambda i: ('0x' || substr(md5('4|' || k || '|' || i), 1, 13))::BIGINT / 4503599627370496.0::DOUBLE) AS u FROM d)
SELECT k AS pair, CAST(c AS INTEGER) AS child, round(list_sum(list_transform([1, 2, 3], lambda i: i * (u[i] * (CASE c WHEN 0 THEN a ELSE b END)[i] + (1 - u[i]) * (CASE c WHEN 0 THEN b ELSE a END)[i]))), 5) AS genes FROM u, (SELECT unnest(range(2)) AS c)
UNION ALL SELECT k, 2, round(list_sum(list_transform([1, 2, 3], lambda i: i * (pow(a[i] + 5, u[i]) * pow(b[i] + 5, 1 - u[i]) - 5))), 5) FROM u""")
def x11_crossovers(spark, sf_dir):
    """Both children of the arithmetic crossover, and that of the geometric one, as weighted sums of their genes."""
    pairs = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("pair"), F.array(F.col("p_size").cast("double"), F.col("p_retailprice") % 100, F.lit(3.0)).alias("a"), F.array(F.lit(1.0), F.lit(2.0), F.col("p_size").cast("double")).alias("b"))
    both = search.crossover(pairs, "arithmetic", 4).unionByName(search.crossover(pairs, "geometric", 4, -5.0, 100.0).withColumn("child", F.lit(2)))
    return both.withColumn("genes", F.round(F.get("genes", 0) + 2 * F.get("genes", 1) + 3 * F.get("genes", 2), 5))


_DRAW = "('0x' || substr(md5('{s}{w}|' || k || '|' || {i}), 1, 13))::BIGINT / 4503599627370496.0::DOUBLE"


@query(f"""WITH g AS (SELECT p_partkey AS k, [CAST(p_size AS DOUBLE), CAST(p_size % 7 AS DOUBLE), 25.0] AS g FROM part),
o AS (SELECT *, list_transform(list_sort(list_transform([0, 1, 2], lambda i: {{'o': {_DRAW.format(s=6, w="o", i="i")}, 'i': i}})), lambda s: s.i)[1:2] AS places, ('0x' || substr(md5('6r|' || k), 1, 13))::BIGINT / 4503599627370496.0::DOUBLE < 0.8 AS taken FROM g),
n AS (SELECT *, list_transform([0, 1, 2], lambda i: (25 + sqrt(50 / 6.0) * sqrt(-2 * ln(1 - {_DRAW.format(s=6, w="u", i="i")})) * cos(2 * pi() * {_DRAW.format(s=6, w="v", i="i")})) * CASE WHEN {_DRAW.format(s=6, w="s", i="i")} < 0.5 THEN -1 ELSE 1 END) AS z,
  list_transform([0, 1, 2], lambda i: taken AND list_contains(places, i) AND {_DRAW.format(s=6, w="p", i="i")} < 0.6) AS hit FROM o),
m AS (SELECT k, list_transform([1, 2, 3], lambda i: CASE WHEN hit[i] THEN CASE WHEN g[i] + z[i] < 0 THEN g[i] + z[i] + ceil(-(g[i] + z[i]) / 50) * 50 WHEN g[i] + z[i] > 50 THEN g[i] + z[i] - ceil((g[i] + z[i] - 50) / 50) * 50 ELSE g[i] + z[i] END ELSE g[i] END) AS v FROM n)
SELECT k AS cand_id, round(v[1] + 2 * v[2] + 3 * v[3], 5) AS genes FROM m""")
def x12_gaussian_mutation(spark, sf_dir):
    p = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("cand_id"), F.array(F.col("p_size").cast("double"), (F.col("p_size") % 7).cast("double"), F.lit(25.0)).alias("genes"))
    out = search.mutate(p, "gaussian", 0.0, 50.0, 0.6, seed=6, share=0.8, points=2)
    return out.select("cand_id", F.round(F.get("genes", 0) + 2 * F.get("genes", 1) + 3 * F.get("genes", 2), 5).alias("genes"))


def _evolution_sql(generations: int, size: int, low: float, high: float, seed: int) -> str:
    """The generations of ``evolution.evolve`` unrolled, for genes of three places."""
    digest = lambda tag, what, at: f"('0x' || substr(md5('{tag}{what}|' || {at}), 1, 13))::BIGINT / 4503599627370496.0::DOUBLE"
    unit = lambda tag, at: f"('0x' || substr(md5('{tag}|0|' || {at}), 1, 13))::BIGINT / 4503599627370496.0::DOUBLE"
    fitness = "1000 - list_sum(list_transform(genes, lambda x: (x - 12.5) * (x - 12.5)))"
    many, span, points = int(0.75 * size), high - low, int(0.05 * size)
    sql = [f"n0 AS (SELECT p_partkey AS cand_id, [CAST(p_size AS DOUBLE), CAST(p_partkey % 50 AS DOUBLE), p_retailprice % 50] AS genes FROM part), e0 AS (SELECT *, {fitness} AS fitness FROM n0 WHERE cand_id % 9 <> 4)"]
    for g in range(generations):
        old = f" UNION ALL SELECT cand_id, genes, fitness FROM t{g - 1}" if g else ""
        sql.append(f"t{g} AS (SELECT *, row_number() OVER (ORDER BY fitness DESC, cand_id) - 1 AS place, {g} AS generation FROM (SELECT cand_id, genes, fitness FROM e{g}{old}) ORDER BY fitness DESC, cand_id LIMIT {size})")
        if g + 1 == generations:
            break
        tag, first = f"{seed}.{g}", f"(SELECT max(p_partkey) + {1 + 4 * size * g} FROM part)"
        sql.append(f"c{g} AS (SELECT genes, (sum(fitness) OVER (ORDER BY cand_id) - fitness) / sum(fitness) OVER () AS lo, sum(fitness) OVER (ORDER BY cand_id) / sum(fitness) OVER () AS hi FROM t{g})")
        sql.append(f"p{g} AS (SELECT draw, genes FROM (SELECT id AS draw, {unit(f'{tag}:p', 'id')} AS u FROM (SELECT unnest(range({many})) AS id)) JOIN c{g} ON u > lo AND u <= hi)")
        parts = []
        for k, (kind, share) in enumerate((("uniform", 0.15), ("arithmetic", 0.15), ("geometric", 0.2))):
            at, pick = f"{tag}:{kind}", lambda x: f"CAST(floor({x} * {many}) AS BIGINT)"  # noqa: B023, E731
            sql.append(f"""q{g}{k} AS (SELECT pair, a.genes AS a, b.genes AS b, list_transform([0, 1, 2], lambda i: {digest(at, '', "pair || '|' || i")}) AS u
  FROM (SELECT id AS pair, {pick(unit(at + ':a', 'id'))} AS i, {pick(unit(at + ':b', 'id'))} AS j FROM (SELECT unnest(range({int(share * size)})) AS id)) JOIN p{g} a ON a.draw = i JOIN p{g} b ON b.draw = j)""")
            child = {
                "uniform": [("0", "CASE WHEN u[i] < 0.5 THEN a[i] ELSE b[i] END")],
                "arithmetic": [("0", "u[i] * a[i] + (1 - u[i]) * b[i]"), ("1", "u[i] * b[i] + (1 - u[i]) * a[i]")],
                "geometric": [("0", f"pow(a[i] + {-low}, u[i]) * pow(b[i] + {-low}, 1 - u[i]) - {-low}")],
            }[kind]
            parts += [f"SELECT {first} + {k * size} + 2 * pair + {c} AS cand_id, list_transform([1, 2, 3], lambda i: {x}) AS genes FROM q{g}{k}" for c, x in child]
        for k, kind in enumerate(("gaussian", "uniform")):
            at = f"{tag}:{kind}"
            draw = lambda what: digest(at, what, "cand_id || '|' || i")  # noqa: B023, E731
            z = f"({low + span / 2} + sqrt({span / 6}) * sqrt(-2 * ln(1 - {draw('u')})) * cos(2 * pi() * {draw('v')})) * CASE WHEN {draw('s')} < 0.5 THEN -1 ELSE 1 END"
            moved = f"genes[i + 1] + {z}" if kind == "gaussian" else f"{low} + {draw('v')} * {span}"
            sql.append(f"""s{g}{k} AS (SELECT cand_id, genes FROM t{g} ORDER BY md5('{at}|0|' || cand_id), cand_id LIMIT {int(0.35 * size)}),
m{g}{k} AS (SELECT cand_id, genes, list_transform([0, 1, 2], lambda i: {moved}) AS z, list_transform([0, 1, 2], lambda i: {draw('p')} < 0.7) AS hit,
  list_transform(list_sort(list_transform([0, 1, 2], lambda i: {{'o': {draw('o')}, 'i': i}})), lambda s: s.i)[1:{points}] AS places FROM s{g}{k})""")
            wrapped = f"CASE WHEN z[i] < {low} THEN z[i] + ceil(({low} - z[i]) / {span}) * {span} WHEN z[i] > {high} THEN z[i] - ceil((z[i] - {high}) / {span}) * {span} ELSE z[i] END"
            parts.append(f"SELECT {first} + {3 * size + k * (size // 2)} + row_number() OVER (ORDER BY cand_id) - 1 AS cand_id, list_transform([1, 2, 3], lambda i: CASE WHEN hit[i] AND list_contains(places, i - 1) THEN {wrapped} ELSE genes[i] END) AS genes FROM m{g}{k}")
        sql.append(f"n{g + 1} AS ({' UNION ALL '.join(parts)}), e{g + 1} AS (SELECT *, {fitness} AS fitness FROM n{g + 1} WHERE cand_id % 9 <> 4)")
    every = " UNION ALL ".join(f"SELECT * FROM t{g}" for g in range(generations))
    lost = ", ".join(f"(SELECT count(*) FROM n{g} WHERE cand_id % 9 = 4)" for g in range(generations))
    return f"""WITH {", ".join(sql)}, every AS ({every}), s AS (SELECT generation, sum(fitness) AS a, avg(fitness) AS b, max(fitness) AS c, min(fitness) AS d, max(CASE WHEN place = {size // 2} THEN fitness END) AS e FROM every GROUP BY 1)
SELECT CAST(generation AS INTEGER) AS generation, round(a, 4) AS sum, round(c, 6) AS best, round(d, 6) AS worst, round(e, 6) AS median, CAST([{lost}][generation + 1] AS BIGINT) AS failed FROM s"""


@query(_evolution_sql(3, 100, -5.0, 50.0, 21))
def x11_generations(spark, sf_dir):
    """Three generations of a hundred candidates, bred from all parts; a ninth of the candidates fails."""
    genes = F.array(F.col("p_size").cast("double"), (F.col("p_partkey") % 50).cast("double"), F.col("p_retailprice") % 50)
    population = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("cand_id"), genes.alias("genes"))
    value = 1000 - F.aggregate("genes", F.lit(0.0), lambda s, x: s + (x - 12.5) * (x - 12.5))
    fails = F.col("cand_id") % 9 == 4
    evaluate = lambda c: c.select("cand_id", F.when(~fails, value).alias("fitness"), F.when(fails, "lost").alias("error"))
    out = evolution.evolve(population, evaluate, -5.0, 50.0, 100, 3, seed=21).history
    return out.select("generation", F.round("sum", 4).alias("sum"), F.round("best", 6).alias("best"), F.round("worst", 6).alias("worst"), F.round("median", 6).alias("median"), "failed")


@query("""SELECT CAST(c AS BIGINT) AS cand_id, CASE WHEN c <> 3 AND c <> 5 THEN round(sum(l_extendedprice / (c - 3.0)) / count(*), 4) END AS fitness,
  CASE c WHEN 3 THEN 'ZeroDivisionError: float division by zero' WHEN 5 THEN 'no fitness' END AS error FROM lineitem, (SELECT unnest(range(8)) AS c) GROUP BY c""")
def j17_evaluate_candidates(spark, sf_dir):
    """A user's function over all line items for each candidate; one divides by zero, one has no fitness."""
    cands = spark.range(8).select(F.col("id").alias("cand_id"), (F.col("id") - 3.0).alias("w"))

    def part(c, rows):
        share = 1.0 / c["w"]
        return [float(rows["l_extendedprice"].sum() * share), 0.0 if c["cand_id"] == 5 else float(len(rows))]

    out = evolution.evaluate_candidates(cands, table(spark, sf_dir, "lineitem").select("l_extendedprice"), part, lambda s: F.try_divide(s[0], s[1]), attempts=2)
    return out.select("cand_id", F.round("fitness", 4).alias("fitness"), "error")


@query("SELECT p_partkey AS cand_id, p_retailprice - 0.5 * p_size AS fitness FROM part")
def x15_fitness(spark, sf_dir):
    p = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("cand_id"), F.col("p_retailprice").alias("validation"), F.col("p_size").alias("train"))
    return search.fitness(p, F.col("validation") - 0.5 * F.col("train")).select("cand_id", "fitness")


# Scalars
@query("SELECT p_partkey, CASE WHEN x > 0 THEN '1' ELSE '0' END || lpad(bin(xor(s, s >> 1)), 12, '0') AS code, round(s * 0.5 * CASE WHEN x > 0 THEN 1 ELSE -1 END, 6) + 0.0 AS back FROM (SELECT p_partkey, p_retailprice - 1200 AS x, CAST(floor(abs(p_retailprice - 1200) / 0.5) AS BIGINT) AS s FROM part)")
def x8_gene_code(spark, sf_dir):
    code = scalars.encode_gene(F.col("p_retailprice") - 1200, 0.5, 12)
    return table(spark, sf_dir, "part").select("p_partkey", code.alias("code"), (F.round(scalars.decode_gene(code, 0.5), 6) + 0.0).alias("back"))


@query("SELECT p_partkey, xor(p_partkey, p_partkey >> 1) AS gray, p_partkey AS back FROM part")
def x8_gray_code(spark, sf_dir):
    g = scalars.gray_encode(F.col("p_partkey"))
    return table(spark, sf_dir, "part").select("p_partkey", g.alias("gray"), scalars.gray_decode(g).alias("back"))


@query("SELECT vec_id, round(1 / (418.9829 * 64 - list_sum(list_transform(embedding, lambda x: x::DOUBLE * 100 * sin(sqrt(abs(x::DOUBLE * 100)))))), 9) AS fitness FROM embeddings")
def x9_sine_root(spark, sf_dir):
    e = table(spark, sf_dir, "embeddings")
    return e.select("vec_id", F.round(scalars.sine_root_fitness(F.transform("embedding", lambda x: x.cast("double") * 100)), 9).alias("fitness"))


@query("SELECT p_partkey, CASE WHEN p_size < 10 THEN p_size + ceil((10 - p_size) / 7) * 7 WHEN p_size > 17 THEN p_size - ceil((p_size - 17) / 7) * 7 ELSE p_size END::DOUBLE AS v FROM part")
def x10_wrap_range(spark, sf_dir):
    return table(spark, sf_dir, "part").select("p_partkey", scalars.wrap_range(F.col("p_size").cast("double"), 10.0, 17.0).cast("double").alias("v"))


@query("SELECT p_partkey, CAST(ceil(p_size / 16) * 16 AS BIGINT) AS up FROM part")
def x3_roundup(spark, sf_dir):
    return table(spark, sf_dir, "part").select("p_partkey", scalars.roundup(F.col("p_size"), 16).alias("up"))


@query("WITH f AS (SELECT vec_id, CAST(embedding AS DOUBLE[]) AS x FROM embeddings) SELECT vec_id, array_to_string(list_transform(x, lambda v: CAST(round_even((v - list_min(x)) * 255 / (list_max(x) - list_min(x)), 0) AS INTEGER)), ',') AS pixels FROM f")
def x4_to_uint8(spark, sf_dir):
    return samples(spark, sf_dir).select(F.col("sample_id").alias("vec_id"), F.array_join(scalars.to_uint8(F.col("features")).cast("array<string>"), ",").alias("pixels"))


@query("SELECT vec_id, i, CAST(embedding[(i % 4) * 16 + i // 4 + 1] AS DOUBLE) AS v FROM embeddings, (SELECT CAST(unnest(range(64)) AS INTEGER) AS i)")
def x2_interleave(spark, sf_dir):
    return samples(spark, sf_dir).select(F.col("sample_id").alias("vec_id"), F.posexplode(scalars.interleave(F.col("features"), 4, 4, 4)).alias("i", "v"))


@query("SELECT o_orderkey, CAST(floor(o_totalprice) AS BIGINT) // 86400 AS days, CAST(floor(o_totalprice) AS BIGINT) % 86400 // 3600 AS hours, CAST(floor(o_totalprice) AS BIGINT) % 3600 // 60 AS mins, CAST(floor(o_totalprice) AS BIGINT) % 60 AS secs FROM orders")
def x17_elapsed(spark, sf_dir):
    return table(spark, sf_dir, "orders").select("o_orderkey", *scalars.elapsed_parts(F.col("o_totalprice")))


@query("SELECT c_custkey, c_name AS name, c_mktsegment || '@x' AS mail FROM customer")
def x18_split_author(spark, sf_dir):
    author = F.concat("c_name", F.lit(" <"), "c_mktsegment", F.lit("@x>"))
    return table(spark, sf_dir, "customer").select("c_custkey", *scalars.split_author(author))


@query(f"SELECT id AS key, round(2 + 3 * {UNIT.format(seed=6)}, 9) AS u, CAST(floor({UNIT.format(seed=8)} * 100) AS BIGINT) AS i FROM (SELECT p_partkey AS id FROM part)")
def x13_draws(spark, sf_dir):
    k = F.col("p_partkey")
    return table(spark, sf_dir, "part").select(k.alias("key"), F.round(draws.uniform(6, k, 2.0, 5.0), 9).alias("u"), draws.integer(8, k, 100).alias("i"))


@query("""SELECT p_partkey AS key, substr(md5('1|b0|' || p_partkey) || md5('1|b1|' || p_partkey), 1, 40) AS bytes,
  CASE WHEN u < 0.5 THEN 'a' WHEN u < 0.75 THEN 'b' ELSE 'c' END AS choice,
  array_to_string(list_transform(list_sort(list_transform([0, 1, 2, 3, 4], lambda i: {'h': md5('3|p|' || p_partkey || '|' || i), 'i': i})), lambda s: s.i), ',') AS places
FROM (SELECT p_partkey, ('0x' || substr(md5('2|0|' || p_partkey), 1, 13))::BIGINT / 4503599627370496.0::DOUBLE AS u FROM part)""")
def x13_more_draws(spark, sf_dir):
    k = F.col("p_partkey")
    return table(spark, sf_dir, "part").select(
        k.alias("key"), F.lower(F.hex(draws.random_bytes(1, k, 20))).alias("bytes"), draws.choice(2, k, ["a", "b", "c"], [2.0, 1.0, 1.0]).alias("choice"), F.array_join(draws.permutation(3, k, 5).cast("array<string>"), ",").alias("places")
    )


@query("SELECT event_id, row_number() OVER (ORDER BY md5('0|0|' || event_id), event_id) - 1 AS idx FROM events")
def h1_dense_index(spark, sf_dir):
    e = table(spark, sf_dir, "events").select("event_id").withColumn("_h", draws.h(0, F.col("event_id")))
    return dense_index(e, ["_h", "event_id"]).select("event_id", "idx")


# Sources
@query("SELECT k // 100 AS chunk, count(*) AS n, min(p_name) AS low FROM (SELECT p_name, row_number() OVER (ORDER BY p_partkey) - 1 AS k FROM part) GROUP BY 1")
def a1_text_chunks(spark, sf_dir):
    lines = table(spark, sf_dir, "part").select("p_partkey", F.col("p_name").alias("value"))
    return readers.text_chunks(lines, "p_partkey", 100).select("chunk", F.size("lines").cast("bigint").alias("n"), F.array_min("lines").alias("low"))


@query("SELECT page_id, 'base/' || url AS path, 'two words' AS label FROM pages")
def a3_list_lines(spark, sf_dir):
    return table(spark, sf_dir, "pages").select("page_id", *readers.parse_list_line(F.concat("url", F.lit(" two words\n")), "base/"))


@query("SELECT page_id, url AS path, 'c' || page_id % 7 AS label FROM pages WHERE page_id % 3 <> 0")
def a4_list_json(spark, sf_dir):
    entry = F.struct(F.col("url").alias("path"), F.when(F.col("page_id") % 3 == 0, F.array().cast("array<string>")).otherwise(F.array(F.concat(F.lit("c"), F.col("page_id") % 7))).alias("label"))
    doc = F.to_json(F.create_map(F.lit("k"), entry))
    return table(spark, sf_dir, "pages").select("page_id", F.explode(readers.parse_list_json(doc)).alias("e")).select("page_id", "e.path", "e.label")


@query("SELECT event_id, CASE event_id % 5 WHEN 0 THEN NULL WHEN 1 THEN 'not JSON' WHEN 2 THEN 'no codec' WHEN 3 THEN 'unknown codec' ELSE 'no input' END AS error, CASE WHEN event_id % 5 = 0 THEN value * 2 END AS total FROM events")
def a8_decode_requests(spark, sf_dir):
    v = F.col("value").cast("string")
    k = F.col("event_id") % 5
    payload = (
        F.when(k == 0, F.concat(F.lit('{"input":['), v, F.lit(","), v, F.lit('],"codec":"list"}'))).when(k == 1, F.lit("{oops")).when(k == 2, F.lit('{"input":[1]}'))
        .when(k == 3, F.lit('{"input":[1],"codec":"zip"}')).otherwise(F.lit('{"codec":"list"}'))
    )
    out = readers.decode_requests(table(spark, sf_dir, "events").select("event_id", payload.alias("payload")), "payload")
    return out.select("event_id", "error", (F.get("input", 0) + F.get("input", 1)).alias("total"))


FILES = "f AS (SELECT page_id, 'd' || page_id % 4 || '/n' || page_id || CASE page_id % 5 WHEN 0 THEN '.png' WHEN 1 THEN '.JPG' WHEN 2 THEN '.svg' WHEN 3 THEN '.txt' ELSE '.odd' END AS path FROM pages)"


def _files(spark, sf_dir):
    k = F.col("page_id") % 5
    ext = F.when(k == 0, ".png").when(k == 1, ".JPG").when(k == 2, ".svg").when(k == 3, ".txt").otherwise(".odd")
    return table(spark, sf_dir, "pages").select("page_id", F.concat(F.lit("d"), F.col("page_id") % 4, F.lit("/n"), F.col("page_id"), ext).alias("path"))


@query(f"WITH {FILES} SELECT page_id, path FROM f WHERE page_id % 5 IN (0, 1) AND page_id % 4 <> 2 AND path NOT LIKE '%7%'")
def f1_filter_files(spark, sf_dir):
    return readers.filter_files(_files(spark, sf_dir), ignored=[".*7.*", "d2/.*"], included=["d.*"], file_type="image", subtypes=["png", "jpeg"])


@query(f"WITH {FILES} SELECT page_id, 'd' || page_id % 4 AS label FROM f")
def f2_path_label(spark, sf_dir):
    return _files(spark, sf_dir).select("page_id", readers.path_label(F.col("path")).alias("label"))


@query(f"WITH {FILES} SELECT page_id, path FROM f WHERE page_id % 5 < 2")
def f9_annotatable(spark, sf_dir):
    return readers.list_annotatable(_files(spark, sf_dir))


# Images, annotations, model results
@query("SELECT p_partkey AS path, p_size AS height, p_partkey % 3 AS width FROM part WHERE p_size = (SELECT arg_min(p_size, p_partkey) FROM part) AND p_partkey % 3 = (SELECT min(p_partkey) % 3 FROM part)")
def f3_uniform_shape(spark, sf_dir):
    return images.filter_uniform_shape(table(spark, sf_dir, "part").select(F.col("p_partkey").alias("path"), F.col("p_size").alias("height"), (F.col("p_partkey") % 3).alias("width")))


@query(f"""WITH b AS (SELECT p_partkey AS id, 100 + p_size AS height, p_size AS ymin, p_size + 20 AS ymax, 10 + p_partkey % 50 AS xmin, 40 + p_partkey % 50 AS xmax FROM part),
l AS (SELECT *, greatest(ymin - 40, 0) AS ly, greatest(xmin - 30, 0) AS lx, least(height - 39, ymax + 40) AS hy, least(91, xmax + 30) AS hx FROM b),
c AS (SELECT *, ly + CAST(floor({UNIT.format(seed="0:y")} * (hy - ly)) AS INTEGER) AS cy, lx + CAST(floor({UNIT.format(seed="0:x")} * (hx - lx)) AS INTEGER) AS cx FROM l)
SELECT id, cy AS crop_ymin, cy + 40 AS crop_ymax, cx AS crop_xmin, cx + 30 AS crop_xmax, round(greatest(least(ymax, cy + 40) - greatest(ymin, cy), 0) * greatest(least(xmax, cx + 30) - greatest(xmin, cx), 0) / 600.0, 6) AS ratio FROM c""")
def x6_crop_windows(spark, sf_dir):
    k, size = F.col("p_partkey"), F.col("p_size")
    boxes = table(spark, sf_dir, "part").select(k.alias("id"), (size + 100).alias("height"), F.lit(120).alias("width"), size.alias("ymin"), (size + 20).alias("ymax"), (k % 50 + 10).alias("xmin"), (k % 50 + 40).alias("xmax"))
    return images.crop_windows(boxes, (40, 0.25)).select("id", "crop_ymin", "crop_ymax", "crop_xmin", "crop_xmax", F.round("ratio", 6).alias("ratio"))


@query("SELECT p_partkey AS image, CAST(k AS INTEGER) AS box, p_size + k AS ymin, p_size + k + 10.5 AS ymax, 3.0 AS xmin, 3.0 + p_size AS xmax, p_brand AS name FROM part, (SELECT unnest(range(2)) AS k) WHERE p_partkey % 4 > 0 AND k < p_partkey % 4")
def a16_annotations(spark, sf_dir):
    box = lambda i: F.struct(F.lit(3.0).alias("left"), (F.col("p_size") + i).alias("top"), F.col("p_size").alias("width"), F.lit(10.5).alias("height"), F.col("p_brand").alias("name"))
    sidecar = F.when(F.col("p_partkey") % 4 == 0, "no list").otherwise(F.to_json(F.slice(F.array(box(0), box(1)), 1, F.least(F.col("p_partkey") % 4, F.lit(2)).cast("int"))))
    return readers.annotation_rows(table(spark, sf_dir, "part").select("p_partkey", sidecar.alias("json")), "p_partkey", "json")


@query("""WITH l AS (SELECT l_suppkey AS s, l_returnflag AS f, l_linenumber AS i, round(sum(l_quantity), 2) AS q FROM lineitem GROUP BY ALL)
SELECT s AS supplier, CAST(dense_rank() OVER (PARTITION BY s ORDER BY f) - 1 AS INTEGER) AS model_pos, f AS model_id, count(*) AS samples, round(sum(q), 2) AS total FROM l GROUP BY s, f""")
def a9_model_results(spark, sf_dir):
    """A result document a supplier, its return flags as models, lines as samples."""
    by = table(spark, sf_dir, "lineitem").groupBy("l_suppkey", "l_returnflag", "l_linenumber").agg(F.round(F.sum("l_quantity"), 2).alias("q"))
    models = by.groupBy("l_suppkey", "l_returnflag").agg(F.transform(F.sort_array(F.collect_list(F.struct("l_linenumber", "q"))), lambda r: F.array(r["q"])).alias("Output"))
    model = F.struct(F.col("l_returnflag").alias("id"), F.array(F.lit("q")).alias("Labels"), "Output")
    docs = models.groupBy("l_suppkey").agg(F.sort_array(F.collect_list(model)).alias("models"))
    text = docs.select(F.col("l_suppkey").alias("supplier"), F.to_json(F.struct("models")).alias("json"))
    rows = readers.model_results(text.select("supplier", F.from_json("json", readers.RESULTS)["models"].alias("models")), "supplier")
    return rows.select("supplier", "model_pos", "model_id", F.size("output").cast("bigint").alias("samples"), F.round(F.aggregate("output", F.lit(0.0), lambda a, x: a + x[0]), 2).alias("total"))


@query("""WITH x AS (SELECT vec_id, CAST(embedding AS DOUBLE[]) AS x, unnest(range(64)) AS i FROM embeddings), y AS (SELECT *, i // 8 AS r, i % 8 AS c FROM x),
z AS (SELECT *, 1 + greatest(r - 1, 0) * 8 AS u, 1 + r * 8 AS m, 1 + least(r + 1, 7) * 8 AS d, greatest(c - 1, 0) AS w, least(c + 1, 7) AS e FROM y)
SELECT vec_id, CAST(i AS INTEGER) AS i, round(x[m + 7 - c], 4) + 0.0 AS mirrored,
  round(sqrt((x[u + e] - x[u + w] + 2 * x[m + e] - 2 * x[m + w] + x[d + e] - x[d + w]) ** 2 + (x[d + w] - x[u + w] + 2 * x[d + c] - 2 * x[u + c] + x[d + e] - x[u + e]) ** 2), 3) AS sobel FROM z""")
def x7_mirror_sobel(spark, sf_dir):
    e = samples(spark, sf_dir).select(F.col("sample_id").alias("vec_id"), F.lit(8).alias("height"), F.lit(8).alias("width"), F.lit(1).alias("channels"), "features")
    mirrored = pixels.transform_images(e, [("mirror",)], "GRAY", "features").select("vec_id", F.posexplode("pixels").alias("i", "mirrored"))
    edges = pixels.transform_images(e, [("sobel",)], "GRAY", "features").select("vec_id", F.posexplode("pixels").alias("j", "sobel")).where("j % 2 = 1")
    both = mirrored.join(edges.select("vec_id", (F.col("j") / 2).cast("int").alias("i"), "sobel"), ["vec_id", "i"])
    return both.select("vec_id", "i", (F.round(F.col("mirrored").cast("double"), 4) + 0.0).alias("mirrored"), F.round(F.col("sobel").cast("double"), 3).alias("sobel"))


@query("""WITH x AS (SELECT vec_id, CAST(embedding AS DOUBLE[]) AS x, unnest(range(64)) AS i FROM embeddings)
SELECT vec_id, CAST(i AS INTEGER) AS i, round(0.299 * x[(i + 2) % 64 + 1] + 0.587 * x[(i + 1) % 64 + 1] + 0.114 * x[i + 1], 3) + 0.0 AS gray FROM x""")
def x7_gray(spark, sf_dir):
    """Vectors as images of 8 x 8, whose channels are the vector and two shifts of it."""
    shifted = F.flatten(F.transform("features", lambda v, i: F.array(v, *(F.get("features", (i + k) % 64) for k in (1, 2)))))
    e = samples(spark, sf_dir).select(F.col("sample_id").alias("vec_id"), F.lit(8).alias("height"), F.lit(8).alias("width"), F.lit(3).alias("channels"), shifted.alias("features"))
    return pixels.transform_images(e, [("color", "GRAY")], "BGR", "features").select("vec_id", F.posexplode("pixels").alias("i", "v")).select("vec_id", "i", (F.round(F.col("v").cast("double"), 3) + 0.0).alias("gray"))


# Reports
@query(f"""WITH {P} SELECT 'samples' AS part, split AS a, NULL AS b, CAST(count(*) AS VARCHAR) AS value FROM p GROUP BY split
UNION ALL SELECT 'labels', x.label, split, CAST(count(p.label) AS VARCHAR) FROM (SELECT * FROM (SELECT DISTINCT label FROM p), (SELECT unnest(['test', 'validation', 'train']) AS split)) x LEFT JOIN p USING (label, split) GROUP BY x.label, split
UNION ALL SELECT 'results', event_type, set, CAST(n AS VARCHAR) FROM (SELECT event_type, count(*) AS events, count(DISTINCT user_id) AS users FROM events GROUP BY 1) UNPIVOT (n FOR set IN (events, users))
UNION ALL SELECT 'normalization', 'none', '1', NULL
UNION ALL SELECT 'unit_times', unit, NULL, CAST(s AS VARCHAR) FROM (SELECT CAST(o_orderpriority AS VARCHAR) AS unit, sum(CAST(floor(o_totalprice) AS BIGINT)) AS s FROM orders GROUP BY 1 UNION ALL SELECT 'all', sum(CAST(floor(o_totalprice) AS BIGINT)) FROM orders)""")
def a14_report(spark, sf_dir):
    counts = table(spark, sf_dir, "events").groupBy(F.col("event_type").alias("metric")).agg(F.create_map(F.lit("events"), F.count("*"), F.lit("users"), F.count_distinct("user_id")).alias("values"))
    timings = table(spark, sf_dir, "orders").select(F.col("o_orderpriority").alias("unit"), F.floor("o_totalprice").alias("seconds"))
    made = report.build_report(parts(spark, sf_dir).withColumn("features", F.array(F.lit(1.0))), report.result_rows(counts), timings)
    row = lambda part, a, b, v: [F.lit(part).alias("part"), a.alias("a"), b.alias("b"), v.cast("string").alias("value")]
    splits_ = made["samples"].select(row("samples", F.col("split"), F.lit(None).cast("string"), F.col("n")))
    labels_ = made["labels"].unpivot("label", ["test", "validation", "train"], "split", "n").select(row("labels", F.col("label"), F.col("split"), F.col("n")))
    null = F.lit(None).cast("string")
    size = made["normalization"].select(row("normalization", F.col("name"), F.col("features").cast("string"), null))
    times = made["unit_times"].select(row("unit_times", F.col("unit"), null, F.col("seconds")))
    return splits_.unionByName(labels_).unionByName(made["results"].select(row("results", F.col("metric"), F.col("set"), F.col("value")))).unionByName(size).unionByName(times)


@query("SELECT event_type AS metric, set, CASE WHEN set = 'users' AND event_type = 'click' THEN 'later' ELSE CAST(n AS VARCHAR) END AS value FROM (SELECT event_type, count(*) AS events, count(DISTINCT user_id) AS users FROM events GROUP BY 1) UNPIVOT (n FOR set IN (events, users))")
def u4_result_providers(spark, sf_dir):
    each = lambda name, n: lambda e: e.groupBy(F.col("event_type").alias("metric")).agg(n.alias("value")).withColumn("set", F.lit(name))
    last = lambda e: e.where("event_type = 'click'").select(F.col("event_type").alias("metric"), F.lit("users").alias("set"), F.lit("later").alias("value")).distinct()
    return report.provided_results(table(spark, sf_dir, "events"), [each("events", F.count("*")), each("users", F.count_distinct("user_id")), last])


@query("""SELECT p_partkey AS id, '{"list":[' || p_size || ',' || p_partkey || '],"number":[' || p_size || ',-1],"text":"' || p_brand || '"}' AS json FROM part""")
def x16_json_value(spark, sf_dir):
    k, size = F.col("p_partkey"), F.col("p_size")
    number = report.complex_value(F.struct(size.alias("re"), F.lit(-1).alias("im")))
    return table(spark, sf_dir, "part").select(k.alias("id"), report.json_value(list=F.array(size.cast("bigint"), k), number=number, text=report.bytes_value(F.encode("p_brand", "ISO-8859-1"))).alias("json"))


@query("""WITH a AS (SELECT o_orderkey AS id, ('0x' || substr(md5(CAST(o_orderkey AS VARCHAR)), 1, 16))::UBIGINT::UHUGEINT AS x, ('0x' || substr(md5(CAST(o_orderkey AS VARCHAR)), 17, 16))::UBIGINT::UHUGEINT AS y FROM orders),
b AS (SELECT id, y, xor(x, (x << 23) & 18446744073709551615::UHUGEINT) AS t FROM a), c AS (SELECT id, y, xor(xor(t, y), xor(t >> 17, y >> 26)) AS z FROM b)
SELECT id, CAST(y AS VARCHAR) AS first, CAST(z AS VARCHAR) AS second, CAST((z + y) & 18446744073709551615::UHUGEINT AS VARCHAR) AS value FROM c""")
def x14_xorshift(spark, sf_dir):
    digest = F.md5(F.col("o_orderkey").cast("string"))
    step = bits.xorshift128plus(bits.from_hex(F.substring(digest, 1, 16)), bits.from_hex(F.substring(digest, 17, 16)))
    return table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("id"), step.alias("s")).select("id", *(bits.unsigned(F.col(f"s.{c}")).cast("string").alias(c) for c in ("first", "second", "value")))


# The way through: labels, split, statistics, normaliser, batches
@query(f"""WITH {S}, r AS (SELECT *, row_number() OVER (PARTITION BY split = 'test', label ORDER BY md5('0|0|' || sample_id), sample_id) - 1 AS k, count(*) OVER (PARTITION BY split = 'test', label) AS n FROM s),
u AS (SELECT sample_id, label, features, CASE WHEN split = 'test' THEN split WHEN k < greatest(round_even(0.2 * n, 0), 1) THEN 'validation' ELSE 'train' END AS split FROM r),
i AS (SELECT *, row_number() OVER (PARTITION BY split ORDER BY CASE WHEN split = 'train' THEN md5('0|1|' || sample_id) ELSE '' END, sample_id) - 1 AS pos FROM u),
x AS (SELECT split, pos // 32 AS b, generate_subscripts(features, 1) AS j, unnest(features) AS v FROM i), t AS (SELECT j, min(v) AS lo, max(v) AS hi FROM x WHERE split = 'train' GROUP BY j)
SELECT split, b AS batch, count(*) // 64 AS n, round(avg(CASE WHEN hi = lo THEN 0 ELSE (v - lo) * 2 / (hi - lo) - 1 END), 6) AS mean FROM x JOIN t USING (j) GROUP BY split, b""")
def dataset_preparation(spark, sf_dir):
    s = splits.resplit_validation(samples(spark, sf_dir), 0.2, seed=0, stratify="label")
    s = normalize.normalize(s, "pointwise", normalize.fit_stats(s))
    batches = batching.index_samples(s, epoch=0, seed=0).withColumn("batch", F.floor(F.col("split_pos") / 32))
    total = F.aggregate("features", F.lit(0.0), lambda a, v: a + v)
    return batches.groupBy("split", "batch").agg(F.count("*").alias("n"), F.round(F.sum(total) / F.sum(F.size("features")), 6).alias("mean"))

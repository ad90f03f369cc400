"""Sample order of an epoch, minibatches and their flags, padding, chunk stores and lookups."""

from __future__ import annotations

import json

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.draws import h
from ..functions.index import index_by_key

ORDER = {"test": 0, "validation": 1, "train": 2}


def split_number(split: Column) -> Column:
    return F.when(split == "test", 0).when(split == "validation", 1).when(split == "train", 2)


def class_lengths(df: DataFrame) -> DataFrame:
    """``(split, start, end)``: half-open intervals in the order test, validation, train."""
    sizes = df.groupBy("split").agg(F.count("*").alias("n"))
    upto = F.sum("n").over(W.orderBy(split_number(F.col("split"))))
    return sizes.select("split", (upto - F.col("n")).alias("start"), upto.alias("end"))


def index_samples(df: DataFrame, epoch: int = 0, seed=0, shuffle_limit: int | None = None) -> DataFrame:
    """``df`` with ``global_index`` and ``split_pos``: test and validation in fixed order, train
    shuffled for each epoch up to ``shuffle_limit`` shuffles, after which the last order stays.

    Sample ids are unique in a split. Only they are sorted; other columns stay where they are until
    the numbers are joined to them."""
    shuffles = epoch + 1 if shuffle_limit is None else min(epoch + 1, shuffle_limit)
    key = F.when((F.col("split") == "train") & F.lit(shuffles > 0), h(seed, F.col("sample_id"), shuffles)).otherwise("")
    placed = index_by_key(df, [split_number(F.col("split")), key, "sample_id"], ["split", "sample_id"], "global_index")
    starts = class_lengths(df).select("split", "start")
    return placed.join(F.broadcast(starts), "split").select(*df.columns, "global_index", (F.col("global_index") - F.col("start")).alias("split_pos"))


def assign_batches(indexed: DataFrame, size: int) -> DataFrame:
    """``batch_id`` and ``pos_in_batch``: batches of at most ``size`` that never cross a split."""
    sizes = class_lengths(indexed)
    first = F.sum(F.ceil((F.col("end") - F.col("start")) / size)).over(W.orderBy("start", "end").rowsBetween(W.unboundedPreceding, -1))
    offsets = sizes.select("split", F.coalesce(first, F.lit(0)).cast("bigint").alias("_first"))
    return indexed.join(F.broadcast(offsets), "split").select(*indexed.columns, (F.col("_first") + F.floor(F.col("split_pos") / size)).alias("batch_id"), (F.col("split_pos") % size).alias("pos_in_batch"))


def batch_schedule(df: DataFrame, size: int, epochs: int = 1) -> DataFrame:
    """A row a batch and epoch: its size, samples served so far, and whether it is the last of its
    split, ends the epoch (after validation, else train, else test), or ends train or test."""
    sizes = class_lengths(df).where("end > start")
    one = sizes.select("split", "start", "end", F.explode(F.sequence(F.lit(0), F.ceil((F.col("end") - F.col("start")) / size).cast("bigint") - 1)).alias("k"))
    one = one.select("split", (F.col("start") + F.col("k") * size).alias("at"), F.least(F.lit(size), F.col("end") - F.col("start") - F.col("k") * size).cast("bigint").alias("n"), ((F.col("k") + 1) * size >= F.col("end") - F.col("start")).alias("last"))
    ends = sizes.agg(F.max(F.when(F.col("split") == "validation", 2).when(F.col("split") == "train", 1).otherwise(0)).alias("e"), F.max("end").alias("total"))
    each = one.crossJoin(F.broadcast(ends)).crossJoin(F.broadcast(df.sparkSession.range(epochs).select(F.col("id").alias("epoch"))))
    ending = F.when(F.col("e") == 2, "validation").when(F.col("e") == 1, "train").otherwise("test")
    return each.select(
        "epoch", "split", F.col("at").alias("start"), "n", (F.col("epoch") * F.col("total") + F.col("at") + F.col("n")).alias("served"), "last",
        (F.col("last") & (F.col("split") == ending)).alias("epoch_ended"), (F.col("last") & (F.col("split") == "train")).alias("train_ended"), (F.col("last") & (F.col("split") == "test")).alias("test_ended"),
    )


def pad_batches(batches: DataFrame, size: int, width: int) -> DataFrame:
    """``(batch_id, pos_in_batch, sample_id, label_id, features)`` with short batches filled up: zeros
    for data, -1 for labels and indices."""
    rows = batches.select("batch_id", F.col("pos_in_batch").cast("bigint").alias("pos_in_batch"), "sample_id", "label_id", "features")
    short = rows.groupBy("batch_id").agg(F.count("*").alias("n")).where(F.col("n") < size)
    fill = short.select("batch_id", F.explode(F.sequence(F.col("n"), F.lit(size - 1).cast("bigint"))).alias("pos_in_batch"))
    blank = F.array_repeat(F.lit(0.0), width)
    return rows.unionByName(fill.select("batch_id", "pos_in_batch", F.lit(-1).cast("bigint").alias("sample_id"), F.lit(-1).alias("label_id"), blank.alias("features")))


def locate_class(indices: DataFrame, lengths: DataFrame) -> DataFrame:
    """For each ``idx``, the split whose interval holds it, and its place there; three intervals."""
    hit = (F.col("idx") >= F.col("start")) & (F.col("idx") < F.col("end"))
    return indices.join(F.broadcast(lengths), hit).select("idx", "split", (F.col("idx") - F.col("start")).alias("split_pos"))


def gather(indices: DataFrame, df: DataFrame, width: int) -> DataFrame:
    """``(pos, sample_id, label_id, features)`` for ordered ``indices (pos, sample_id)``; an index that
    isn't there gives zeros and label -1."""
    found = indices.join(df.select("sample_id", "label_id", "features"), "sample_id", "left")
    return found.select("pos", "sample_id", F.coalesce("label_id", F.lit(-1)).alias("label_id"), F.coalesce("features", F.array_repeat(F.lit(0.0), width)).alias("features"))


def chunk_address(pos: Column, batch: int, chunk: int) -> tuple[Column, Column]:
    """Chunk and place in it of a position, for batches cut into chunks."""
    per = -(-batch // chunk)
    return (F.floor(pos / batch) * per + F.floor(pos % batch / chunk)).cast("bigint"), (pos % batch % chunk).cast("bigint")


#: Samples of a folder of the store, about; what is fetched is read by folders, and by row groups in them.
FOLDER_ROWS = 1 << 20
#: Folders that are asked for by name at most.
MOST_FOLDERS = 10_000


def _address(sizes: dict[str, int], folders: dict[str, int], batch: int) -> dict[str, Column]:
    """Chunk, place in it, and folder of ``(split, split_pos)``."""
    each = {split: chunk_address(F.col("split_pos"), batch, size) for split, size in sizes.items()}
    each = {split: (*found, F.floor(found[0] / folders[split])) for split, found in each.items()}
    pick = lambda k: F.when(F.col("split") == "test", each["test"][k]).when(F.col("split") == "validation", each["validation"][k]).otherwise(each["train"][k])
    return {"chunk_id": pick(0), "chunk_offset": pick(1), "folder": pick(2)}


def write_chunks(indexed: DataFrame, path: str, batch: int, chunks: tuple[int, int, int] = (0, 0, 1), codec: str = "snappy", folder_rows: int = FOLDER_ROWS) -> None:
    """Minibatches as Parquet by split, folder and chunk, a header, and the labels' numbers; codecs are Parquet's.

    ``chunks`` are the samples of a chunk in test, validation and train, 0 for a whole batch; they may
    not exceed it. Chunks of about ``folder_rows`` samples make a folder, of one file or several, in
    which rows lie in order. The header says sizes, the shape of a sample, and column types. Labels are a table of their own, as there may be
    many.
    """
    if batch < 1 or any(c < 0 or c > batch for c in chunks):
        raise ValueError(f"chunks {chunks} do not fit a batch of {batch}")
    sizes_of = dict(zip(ORDER, (c or batch for c in chunks), strict=True))
    folders = {split: max(1, folder_rows // size) for split, size in sizes_of.items()}
    rows = indexed.withColumns(_address(sizes_of, folders, batch))
    rows.repartitionByRange("split", "folder", "chunk_id").sortWithinPartitions("split", "folder", "chunk_id", "chunk_offset").write.partitionBy("split", "folder").option("compression", codec).parquet(f"{path}/chunks")
    shape = [F.min(F.size("features")).alias("least"), F.max(F.size("features")).alias("most")] if "features" in indexed.columns else [F.lit(None).alias("least"), F.lit(None).alias("most")]
    found = indexed.groupBy("split").agg(F.count("*").alias("n"), *shape).collect()  # three rows
    header = {
        "batch": batch, "chunks": sizes_of, "folders": folders, "codec": codec, "class_lengths": {r["split"]: r["n"] for r in found}, "types": dict(indexed.dtypes),
        "shape": sorted({n for r in found for n in (r["least"], r["most"]) if n is not None}),
    }
    if "label" in indexed.columns:
        mapping = indexed.where("label IS NOT NULL").select("label", *(["label_id"] if "label_id" in indexed.columns else [])).distinct()
        mapping.write.parquet(f"{path}/labels")
    indexed.sparkSession.createDataFrame([(json.dumps(header, sort_keys=True),)], "value string").coalesce(1).write.text(f"{path}/header")


def read_chunk_header(spark: SparkSession, path: str) -> dict:
    """What ``write_chunks`` said of the store."""
    return json.loads(spark.read.text(f"{path}/header").first()["value"])


def read_chunks(spark: SparkSession, path: str) -> DataFrame:
    """The whole store; its schema is the header's, so no file is opened to infer it."""
    types = read_chunk_header(spark, path)["types"]
    own = ", ".join(f"`{c}` {kind}" for c, kind in types.items() if c != "split")
    return spark.read.schema(f"{own}, chunk_id bigint, chunk_offset bigint, split string, folder bigint").parquet(f"{path}/chunks").select(*types, "chunk_id", "chunk_offset", "folder")


def fetch_samples(spark: SparkSession, path: str, wanted: DataFrame) -> DataFrame:
    """The rows of a store at ``wanted (split, split_pos)``, each as often as it is wanted.

    Addresses follow from the header by arithmetic. Only the folders that hold a wanted chunk are
    read, if they are no more than ``MOST_FOLDERS``; in them, row groups outside the wanted chunks'
    range are left out by Parquet's own statistics. If more are wanted, it is a join with the store.
    """
    header = read_chunk_header(spark, path)
    addressed = wanted.select("split", "split_pos").withColumns(_address(header["chunks"], header["folders"], header["batch"])).drop("split_pos")
    store = read_chunks(spark, path)
    folders = addressed.groupBy("split", "folder").agg(F.min("chunk_id").alias("low"), F.max("chunk_id").alias("high")).limit(MOST_FOLDERS + 1).collect()
    if len(folders) <= MOST_FOLDERS:
        by_split: dict[str, list] = {}
        for r in folders:
            by_split.setdefault(r["split"], []).append(r)
        there = F.lit(False)
        for split, rows in by_split.items():
            span = F.col("chunk_id").between(min(r["low"] for r in rows), max(r["high"] for r in rows))
            there |= (F.col("split") == split) & F.col("folder").isin([r["folder"] for r in rows]) & span
        store = store.where(there)
    return store.join(addressed, ["split", "folder", "chunk_id", "chunk_offset"]).select(*header["types"], "chunk_id", "chunk_offset")


def rebatch(spark: SparkSession, path: str, size: int) -> DataFrame:
    """A store's rows in batches of another size: ``batch_id`` and ``pos_in_batch`` by arithmetic.

    Batches are numbered over test, validation and train, as ``assign_batches`` has them; the header
    knows the splits' sizes, so no row is counted or moved.
    """
    lengths, first, ahead = read_chunk_header(spark, path)["class_lengths"], {}, 0
    for split in ORDER:
        first[split] = ahead
        ahead += -(-lengths.get(split, 0) // size)
    start = F.when(F.col("split") == "test", first["test"]).when(F.col("split") == "validation", first["validation"]).otherwise(first["train"])
    return read_chunks(spark, path).withColumns({"batch_id": (start + F.floor(F.col("split_pos") / size)).cast("bigint"), "pos_in_batch": (F.col("split_pos") % size).cast("bigint")}).drop("folder")

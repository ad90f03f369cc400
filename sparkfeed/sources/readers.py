"""Readers of text, lists, matrices, arrays, requests and annotations, and file filters."""

from __future__ import annotations

import io

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.index import dense_index
from ..operators.splits import union_splits, validate_samples

#: Extension -> MIME type, for what data sets are made of.
MIME = {
    "png": "image/png", "jpg": "image/jpeg", "jpeg": "image/jpeg", "gif": "image/gif", "bmp": "image/bmp", "tif": "image/tiff", "tiff": "image/tiff", "webp": "image/webp", "svg": "image/svg+xml",
    "txt": "text/plain", "csv": "text/csv", "html": "text/html", "json": "application/json", "wav": "audio/x-wav", "mp3": "audio/mpeg", "flac": "audio/flac",
}


def text_chunks(lines: DataFrame, order: str, chunk: int = 1000) -> DataFrame:
    """``(chunk, lines)``: ordered lines in chunks; the last is short."""
    placed = dense_index(lines, [order], "_k")
    rows = placed.groupBy(F.floor(F.col("_k") / chunk).alias("chunk")).agg(F.sort_array(F.collect_list(F.struct("_k", "value"))).alias("s"))
    return rows.select("chunk", F.transform("s", lambda x: x["value"]).alias("lines"))


def read_text_chunks(spark: SparkSession, path: str, chunk: int = 1000) -> DataFrame:
    lines = spark.read.text(path).withColumn("_at", F.struct(F.input_file_name(), F.monotonically_increasing_id()))
    return text_chunks(lines, "_at", chunk)


def scan_files(spark: SparkSession, folders: dict[str, list[str]]) -> DataFrame:
    """``(path, length, modificationTime, split)`` below the folders; contents are not read."""
    out = None
    for split, paths in folders.items():
        files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(paths).select("path", "length", "modificationTime", F.lit(split).alias("split"))
        out = files if out is None else out.unionByName(files)
    return out


def parse_list_line(value: Column, base: str = "") -> list[Column]:
    """``path label``, split at the first space; the label may hold more."""
    parts = F.split(value, " ", 2)
    return [F.concat(F.lit(base), F.get(parts, 0)).alias("path"), F.btrim(F.get(parts, 1), F.lit(" \t\r\n")).alias("label")]


def read_file_list(spark: SparkSession, path: str, base_dir: str = "", labelled: bool = True) -> DataFrame:
    """``(path, label)`` of a list file, ``.json`` or text; a line without a label is an error unless
    the list is ``labelled=False``, as test sets may be."""
    base = base_dir.rstrip("/") + "/" if base_dir else ""
    if path.endswith(".json"):
        entries = spark.read.option("wholetext", True).text(path).select(F.explode(parse_list_json(F.col("value"))).alias("e"))
        return entries.select(F.concat(F.lit(base), F.col("e.path")).alias("path"), "e.label")
    lines = spark.read.text(path).where(F.btrim("value") != "").select(*parse_list_line(F.col("value"), base))
    missing = F.coalesce(F.col("label"), F.lit("")) == ""
    return lines.withColumn("label", F.when(missing, F.raise_error(F.concat(F.lit("no label for "), F.col("path"))).cast("string") if labelled else F.lit(None)).otherwise(F.col("label")))


def parse_list_json(value: Column) -> Column:
    """Rows ``(path, label)`` of ``{key: {path, label: [...]}}``; entries without a label are left out."""
    entries = F.map_values(F.from_json(value, "map<string,struct<path:string,label:array<string>>>"))
    return F.transform(F.filter(entries, lambda e: F.size(e["label"]) > 0), lambda e: F.struct(e["path"].alias("path"), F.get(e["label"], 0).alias("label")))


def read_matrix(spark: SparkSession, path: str, columns: int, sep: str = ",", comment: str = "#", usecols: list[int] | None = None, skiprows: int = 0) -> DataFrame:
    """``features`` of each line, but for the first ``skiprows`` lines of each file, comments among them.

    Files stay splittable: lines are counted by block, and a small table of a file's first blocks,
    those that begin before the last line to skip, says how many lines are ahead of each.
    """
    schema = ", ".join(f"c{k} double" for k in range(columns))
    chosen = F.array(*(f"c{k}" for k in (usecols or range(columns)))).alias("features")
    if not skiprows:
        return spark.read.schema(schema).option("sep", sep).option("comment", comment).csv(path).select(chosen)
    lines = spark.read.text(path).select("value", F.input_file_name().alias("_file"), F.input_file_block_start().alias("_block"), F.monotonically_increasing_id().alias("_at"))
    blocks = lines.groupBy("_file", "_block").agg(F.min("_at").alias("_start"), F.count("*").alias("_n"))
    ahead = F.coalesce(F.sum("_n").over(W.partitionBy("_file").orderBy("_block").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    first = blocks.withColumn("_ahead", ahead).where(F.col("_ahead") < skiprows).select("_file", "_block", "_start", "_ahead")
    kept = lines.join(first, ["_file", "_block"], "left").where(F.col("_ahead").isNull() | (F.col("_ahead") + F.col("_at") - F.col("_start") >= skiprows))
    kept = kept.where((F.btrim("value") != "") & ~F.col("value").startswith(comment))
    return kept.select(F.from_csv("value", schema, {"sep": sep, "mode": "FAILFAST"}).alias("r")).select("r.*").select(chosen)


def read_npy(spark: SparkSession, path: str) -> DataFrame:
    """``(path, row, features)`` of array files: the first axis is the sample.

    Files come whole through Spark's own reader, so any path that Spark opens will do, but a file is
    one task and 2 GB at most; ``arrays.read_arrays`` has no such bound.
    """

    def run(frames):
        for f in frames:
            for p, content in zip(f["path"], f["content"], strict=True):
                x = np.load(io.BytesIO(content), allow_pickle=False)
                x = x.reshape(len(x), -1).astype(np.float64)
                yield pd.DataFrame({"path": p, "row": np.arange(len(x)), "features": list(x)})

    files = spark.read.format("binaryFile").load(path).select("path", "content")
    return files.mapInPandas(run, "path string, row bigint, features array<double>")


def read_sample_sets(spark: SparkSession, paths: dict[str, str]) -> DataFrame:
    """Parquet tables ``(sample_id, features, label)`` of splits as one data set.

    Splits must agree in columns and in the shape of their samples, and have labels for all rows or
    for none; else it is an error. This takes one pass over sizes and labels.
    """
    sets = {split: spark.read.parquet(path) for split, path in paths.items()}
    names = {split: sorted(df.columns) for split, df in sets.items()}
    if len({tuple(n) for n in names.values()}) > 1:
        raise ValueError(f"splits differ in columns: {names}")
    df = union_splits(sets)
    checked = df if "label" in df.columns else df.withColumn("label", F.lit(None).cast("string"))
    if broken := validate_samples(checked).where("rule <> 'no train rows'").limit(20).collect():
        raise ValueError("; ".join(sorted(f"{r['rule']} ({r['split']})" for r in broken)))
    return df


def read_events(spark: SparkSession, path: str, fields: str = "session string, instance string, name string, type string, time double, height double, props string") -> DataFrame:
    """Events of JSON lines; the fixed fields as columns, and the line itself as ``line``, from which
    ``event_extras`` has the others."""
    lines = spark.read.text(path)
    return lines.select(F.from_json("value", fields).alias("e"), F.col("value").alias("line")).select("e.*", "line")


def read_logs(spark: SparkSession, path: str) -> DataFrame:
    """Log rows of JSON lines, as ``filter_logs`` takes them."""
    return read_events(spark, path, "session string, node string, levelname string, name string, message string, created double")


#: Types of base64 payloads: kind, bits, byte order.
TENSOR_TYPE = r"^(u?int(?:8|16|32|64)|float(?:16|32|64))([<=>]?)$"


def _dtype(kind: str) -> np.dtype:
    """``float32>`` as a type of arrays; without a mark, the machine's byte order."""
    name = kind.rstrip("<=>")
    return np.dtype(name).newbyteorder(kind[len(name) :] or "=")


@F.pandas_udf(T.ArrayType(T.DoubleType()))
def _numbers(data: pd.Series, kind: pd.Series) -> pd.Series:
    return pd.Series([None if x is None else np.frombuffer(x, _dtype(k)).astype(np.float64) for x, k in zip(data, kind, strict=True)], dtype=object)


def decode_requests(df: DataFrame, payload: str) -> DataFrame:
    """``df`` with ``input`` (an array), its ``shape`` and ``error`` (why there is none) of each JSON request.

    A list has the shape of its length; base64 data is as long as its shape and type say.
    """
    r = F.from_json(payload, "input string, codec string, shape array<int>, type string")
    values = F.from_json(r["input"], "array<double>")
    data = F.try_to_binary(r["input"], F.lit("base64"))
    width = (F.regexp_extract(r["type"], r"(\d+)", 1).try_cast("int") / 8).cast("int")
    length = F.aggregate(r["shape"], F.lit(1).cast("bigint"), lambda n, x: n * x) * width
    is_list, packed = r["codec"] == "list", r["codec"] == "base64"
    error = (
        F.when(F.col(payload).isNull() | F.try_parse_json(payload).isNull(), "not JSON")
        .when(r["codec"].isNull(), "no codec")
        .when(~r["codec"].isin("list", "base64"), "unknown codec")
        .when(r["input"].isNull(), "no input")
        .when(is_list & values.isNull(), "input is no list")
        .when(packed & (r["shape"].isNull() | r["type"].isNull()), "base64 needs shape and type")
        .when(packed & ~r["type"].rlike(TENSOR_TYPE), "unknown type")
        .when(packed & data.isNull(), "bad base64")
        .when(packed & ~F.coalesce(F.octet_length(data) == length, F.lit(False)), "shape does not fit the data")
    )
    out = df.withColumn("error", error)
    fine = F.col("error").isNull()
    tensor = _numbers(F.when(fine & packed, data), F.when(fine & packed, r["type"]))
    return out.withColumns({"input": F.when(fine & is_list, values).when(fine & packed, tensor), "shape": F.when(fine & is_list, F.array(F.size(values))).when(fine & packed, r["shape"])})


RESULTS = "models array<struct<id:string, Labels:array<string>, Output:array<array<double>>>>"


def model_results(doc: DataFrame, *keep: str) -> DataFrame:
    """``(model_pos, model_id, labels, output)`` of a ``models`` column, after the columns to ``keep``;
    models in the order of the file."""
    return doc.select(*keep, F.posexplode("models").alias("model_pos", "m")).select(*keep, "model_pos", F.col("m.id").alias("model_id"), F.col("m.Labels").alias("labels"), F.col("m.Output").alias("output"))


def read_model_results(spark: SparkSession, path: str) -> DataFrame:
    """What an ensemble's result file holds of each model, ready for ``stack_outputs``."""
    return model_results(spark.read.schema(RESULTS).option("multiLine", True).json(path))


def annotation_rows(df: DataFrame, image: str, value: str) -> DataFrame:
    """``(image, box, ymin, ymax, xmin, xmax, name)``: a row a rectangle; text that is no list gives none."""
    rows = df.select(F.col(image).alias("image"), F.posexplode(annotations(F.col(value))).alias("box", "a"))
    return rows.select("image", "box", F.col("a.top").alias("ymin"), (F.col("a.top") + F.col("a.height")).alias("ymax"), F.col("a.left").alias("xmin"), (F.col("a.left") + F.col("a.width")).alias("xmax"), F.col("a.name").alias("name"))


def read_annotations(spark: SparkSession, path: str) -> DataFrame:
    """Rectangles of the files ``<image>.json``."""
    files = spark.read.option("wholetext", True).text(path).select(F.regexp_replace(F.input_file_name(), r"\.json$", "").alias("image"), "value")
    return annotation_rows(files, "image", "value")


def annotations(value: Column) -> Column:
    return F.from_json(value, "array<struct<left:double,top:double,width:double,height:double,name:string>>")


def extension(path: Column) -> Column:
    return F.lower(F.regexp_extract(path, r"\.([A-Za-z0-9]+)$", 1))


def mime_type(path: Column) -> Column:
    known = F.create_map(*(F.lit(x) for kv in MIME.items() for x in kv))
    return F.element_at(known, extension(path))


def filter_files(df: DataFrame, path: str = "path", ignored: list[str] = (), included: list[str] = (), file_type: str | None = None, subtypes: list[str] = ()) -> DataFrame:
    """Files that no ``ignored`` pattern matches as a whole, that an ``included`` one does, of the type asked for."""
    p = F.col(path)
    out = df
    if ignored:
        out = out.where(~p.rlike("^(?:" + "|".join(f"(?:{x})" for x in ignored) + ")$"))
    if included:
        out = out.where(p.rlike("^(?:" + "|".join(f"(?:{x})" for x in included) + ")$"))
    if file_type:
        kind = mime_type(p)
        out = out.where(kind.isNotNull() & kind.rlike(f"^{file_type}/(?:{'|'.join(subtypes) if subtypes else '.*'})$"))
    return out


def path_label(path: Column, pattern: str = r"([^/]+)/[^/]*$") -> Column:
    """The label that a path holds, by default its folder; null if there is none."""
    return F.nullif(F.regexp_extract(path, pattern, 1), F.lit(""))


def list_annotatable(df: DataFrame, path: str = "path") -> DataFrame:
    """Raster images, by path."""
    kind = mime_type(F.col(path))
    return df.where(kind.startswith("image/") & (kind != "image/svg+xml")).orderBy(path)

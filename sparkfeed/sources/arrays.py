"""Array files: a data source that reads rows by their offset, so that one file may be many tasks, and a writer."""

from __future__ import annotations

import io
import math
import uuid
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.fs as pafs
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

SCHEMA = "path string, row bigint, features array<double>"
#: Bytes of a partition, and of what is turned into rows at a time.
PART_BYTES, BATCH_BYTES = 64 << 20, 4 << 20


@dataclass
class Header:
    """What an array file says of itself; ``data`` is where its numbers begin."""

    shape: tuple[int, ...]
    fortran: bool
    kind: str
    data: int

    @property
    def width(self) -> int:
        return math.prod(self.shape[1:])

    @property
    def row_bytes(self) -> int:
        return self.width * np.dtype(self.kind).itemsize


def read_header(file, path: str, size: int) -> Header:
    """The header of an open file of ``size`` bytes; what can't be read as rows of numbers is an error."""
    try:
        start = io.BytesIO(file.read(min(size, 1 << 16)))
        version = np.lib.format.read_magic(start)
        if version not in ((1, 0), (2, 0)):
            raise ValueError(f"version {version}")
        shape, fortran, kind = (np.lib.format.read_array_header_1_0 if version == (1, 0) else np.lib.format.read_array_header_2_0)(start)
    except (ValueError, EOFError, SyntaxError) as e:
        raise ValueError(f"{path} is no array file: {e}") from e
    if not shape or kind.kind not in "biuf":
        raise ValueError(f"{path} holds no rows of numbers: shape {shape}, type {kind}")
    found = Header(tuple(shape), fortran and len(shape) > 1, kind.str, start.tell())
    if size - found.data < shape[0] * found.row_bytes:
        raise ValueError(f"{path} is cut short: {size - found.data} bytes of {shape[0] * found.row_bytes}")
    return found


@dataclass
class Rows(InputPartition):
    path: str
    first: int
    count: int
    header: Header


def _open(path: str):
    system, at = pafs.FileSystem.from_uri(path)
    return system.open_input_file(at)


class ArrayReader(DataSourceReader):
    def __init__(self, path: str, part_bytes: int):
        self.path, self.part_bytes = path, part_bytes

    def files(self) -> list[tuple[str, int]]:
        """The file, or those in the folder that end in .npy, with their sizes."""
        system, at = pafs.FileSystem.from_uri(self.path)
        root = self.path[: len(self.path) - len(at)] if self.path.endswith(at) else ""
        one = system.get_file_info(at)
        if one.type == pafs.FileType.NotFound:
            raise FileNotFoundError(self.path)
        found = [one] if one.is_file else [f for f in system.get_file_info(pafs.FileSelector(at)) if f.is_file and f.path.endswith(".npy")]
        return sorted((root + f.path, f.size) for f in found)

    def partitions(self) -> list[Rows]:
        parts = []
        for path, size in self.files():
            with _open(path) as f:
                header = read_header(f, path, size)
            each = max(1, self.part_bytes // max(1, header.row_bytes))
            parts += [Rows(path, at, min(each, header.shape[0] - at), header) for at in range(0, header.shape[0], each)]
        return parts

    def read(self, part: Rows) -> Iterator[pa.RecordBatch]:
        if part is None:  # no files: Spark asks once all the same
            return
        h, kind = part.header, np.dtype(part.header.kind)
        step = max(1, BATCH_BYTES // max(1, h.row_bytes))
        with _open(part.path) as f:
            for first in range(part.first, part.first + part.count, step):
                count = min(step, part.first + part.count - first)
                if h.fortran:
                    x = np.empty((count, h.width), kind, order="F")
                    for k in range(h.width):
                        f.seek(h.data + (k * h.shape[0] + first) * kind.itemsize)
                        x[:, k] = np.frombuffer(f.read(count * kind.itemsize), kind)
                    x = x.reshape((count, *h.shape[1:]), order="F").reshape(count, -1)
                else:
                    f.seek(h.data + first * h.row_bytes)
                    x = np.frombuffer(f.read(count * h.row_bytes), kind).reshape(count, h.width)
                flat = pa.array(np.ascontiguousarray(x, np.float64).reshape(-1))
                offsets = pa.array(np.arange(count + 1, dtype=np.int32) * h.width)
                yield pa.RecordBatch.from_arrays(
                    [pa.array([part.path] * count, pa.string()), pa.array(np.arange(first, first + count)), pa.ListArray.from_arrays(offsets, flat)], names=["path", "row", "features"]
                )


class ArrayFiles(DataSource):
    """``spark.read.format("array_files").load(path)``; option ``part_bytes`` is the size of a partition."""

    @classmethod
    def name(cls) -> str:
        return "array_files"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> ArrayReader:
        return ArrayReader(self.options["path"], int(self.options.get("part_bytes", PART_BYTES)))


def read_arrays(spark: SparkSession, path: str, part_bytes: int = PART_BYTES) -> DataFrame:
    """``(path, row, features)`` of an array file or of a folder of them: the first axis is the sample.

    Only headers are read to plan. A task reads its own rows by offset, a few megabytes at a time; in
    column order it reads its rows' stretch of each column. Files may be of any size. The path is one
    that pyarrow opens (a local or shared folder, hdfs, s3, gs).
    """
    spark.dataSource.register(ArrayFiles)
    return spark.read.format("array_files").option("part_bytes", part_bytes).load(path)


def _save(system: pafs.FileSystem, path: str, rows: np.ndarray) -> None:
    """An array file, which has its name only once it is whole."""
    begun = f"{path}.{uuid.uuid4().hex}"
    with system.open_output_stream(begun) as f:
        start = io.BytesIO()
        np.lib.format.write_array_header_1_0(start, {"descr": "<f8", "fortran_order": False, "shape": rows.shape})
        f.write(start.getvalue())
        f.write(np.ascontiguousarray(rows, "<f8"))
    system.move(begun, path)


def write_arrays(df: DataFrame, path: str, features: str = "features", part_bytes: int = PART_BYTES) -> int:
    """Writes ``features`` as array files of about ``part_bytes`` below a new folder; returns the number of rows.

    Files are named by partition and number, so a task that runs again replaces its own. A task holds
    the rows of one file. Null features, null elements, and lengths that differ, in one task or in
    several, are errors; no rows give no files. The path is one that pyarrow opens.
    """
    system, at = pafs.FileSystem.from_uri(path)
    system.create_dir(at, recursive=True)

    def run(batches):
        system, at = pafs.FileSystem.from_uri(path)
        task, held, count, number, total, width = TaskContext.get().partitionId(), [], 0, 0, 0, None
        for batch in batches:
            x = batch.column(0)
            if x.null_count or x.flatten().null_count:
                raise ValueError("null in features")
            lengths = set(x.value_lengths().to_pylist()) | ({width} if width is not None else set())
            if len(lengths) > 1:
                raise ValueError(f"features differ in length: {sorted(lengths)}")
            if not batch.num_rows:
                continue
            width = lengths.pop()
            each = max(1, part_bytes // max(1, 8 * width))
            rows = x.flatten().to_numpy(zero_copy_only=False).reshape(batch.num_rows, width)
            while len(rows):
                take = rows[: each - count]
                held.append(take)
                rows, count, total = rows[len(take) :], count + len(take), total + len(take)
                if count == each:
                    _save(system, f"{at}/part-{task:06d}-{number:06d}.npy", np.concatenate(held))
                    held, count, number = [], 0, number + 1
        if held:
            _save(system, f"{at}/part-{task:06d}-{number:06d}.npy", np.concatenate(held))
        if total:
            yield pa.RecordBatch.from_pydict({"n": [total], "width": [width]}, schema=pa.schema([("n", pa.int64()), ("width", pa.int64())]))

    told = df.select(F.col(features).cast("array<double>").alias("x")).mapInArrow(run, "n bigint, width bigint")
    n, least, most = told.agg(F.sum("n"), F.min("width"), F.max("width")).first()
    if least != most:
        raise ValueError(f"features differ in length: {least} to {most}")
    return n or 0

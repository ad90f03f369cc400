"""Tables written once to the folder that driver and executors share."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager
from contextvars import ContextVar

from pyspark.sql import DataFrame, SparkSession

_below: ContextVar[str | None] = ContextVar("_below", default=None)


def shared_dir(spark: SparkSession) -> str:
    """``spark.checkpoint.dir``, else the checkpoint directory that the user gave Spark.

    A local session with neither gets a folder of its own; on a cluster that is an error, as
    executors would write where nobody else can read.
    """
    sc = spark.sparkContext
    found = spark.conf.get("spark.checkpoint.dir", None) or sc.getCheckpointDir()
    if not found:
        if not sc.master.startswith("local") or sc.master.startswith("local-cluster"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that driver and executors share")
        found = tempfile.mkdtemp(prefix="sparkfeed-")
        sc.setCheckpointDir(found)
    return found.rstrip("/")


def scratch_path(spark: SparkSession, name: str) -> str:
    """A new path below the folder of the run that is open, else below the shared one, where the
    caller's application owns it."""
    return f"{_below.get() or shared_dir(spark)}/{name}-{uuid.uuid4().hex}"


@contextmanager
def scratch_run(spark: SparkSession) -> Iterator[str]:
    """Within, every table that operators write goes below one folder, which is gone at the end.

    Results are lazy and read these tables, so write or collect them before.
    """
    path = scratch_path(spark, "run")
    token = _below.set(path)
    try:
        yield path
    finally:
        _below.reset(token)
        remove(spark, path)


def written(df: DataFrame, name: str, path: str | None = None) -> DataFrame:
    """``df`` written once as files that outlive executors, and read again.

    This cuts the lineage, and gives Catalyst the true size of the table, by which it decides
    whether a join may broadcast it.
    """
    path = path or scratch_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


class Scratch:
    """The tables of one run below one path, removed together when nothing reads them any more, or
    one by one before."""

    def __init__(self, spark: SparkSession, name: str):
        self.spark, self.path, self.tables = spark, scratch_path(spark, name), 0
        self.paths: dict[int, tuple[DataFrame, str]] = {}

    def written(self, df: DataFrame, name: str) -> DataFrame:
        self.tables += 1
        path = f"{self.path}/{name}-{self.tables}"
        table = written(df, name, path)
        self.paths[id(table)] = table, path
        return table

    def forget(self, *tables: DataFrame) -> None:
        """Removes tables that nothing will read again; others than this run's are left alone."""
        for table in tables:
            found = self.paths.pop(id(table), None)
            if found:
                remove(self.spark, found[1])

    def drop(self) -> None:
        remove(self.spark, self.path)
        self.paths.clear()


def remove(spark: SparkSession, path: str) -> None:
    hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    hadoop.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(hadoop, True)

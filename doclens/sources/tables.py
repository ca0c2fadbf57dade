"""Tables that are written between jobs, in the folder that driver and executors share."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession

#: Paths made inside each open temporary_tables block.
_open: list[list[str]] = []


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share, from spark.checkpoint.dir.

    Where the setting is absent in a local session (tests, a laptop) a temporary folder is set
    once and removed when the driver ends; on a cluster that is an error.
    """
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that driver and executors share")
        folder = tempfile.mkdtemp(prefix="spark-doclens-")
        atexit.register(shutil.rmtree, folder, True)
        folder = f"file://{folder}"
        spark.conf.set("spark.checkpoint.dir", folder)
    return folder


def new_path(spark: SparkSession, label: str) -> str:
    path = f"{shared_dir(spark)}/doclens/{label}-{uuid.uuid4().hex}"
    for paths in _open:
        paths.append(path)
    return path


def remove(spark: SparkSession, path: str) -> None:
    """Deletes a table that nothing reads any more."""
    target = spark._jvm.org.apache.hadoop.fs.Path(path)
    target.getFileSystem(spark._jsc.hadoopConfiguration()).delete(target, True)


@contextmanager
def temporary_tables(spark: SparkSession) -> Iterator[None]:
    """Tables written inside go at the end: for results that are committed elsewhere before it, such as a stream's batch."""
    _open.append([])
    try:
        yield
    finally:
        for path in _open.pop():
            remove(spark, path)


def written(df: DataFrame, label: str, compression: str | None = None) -> DataFrame:
    """The rows of df from a table in the shared folder: computed once, and safe from lost executors.

    The table stays, as results are read from such tables when an action runs; the folder
    doclens/ below spark.checkpoint.dir may be removed when no job runs.
    """
    spark = df.sparkSession
    path = new_path(spark, label)
    df.write.parquet(path, compression=compression)
    return spark.read.schema(df.schema).parquet(path)

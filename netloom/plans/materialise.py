"""Cutting lineage with written tables in the folder that all executors share."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession

_WRITTEN: list[str] = []


def shared_dir(spark: SparkSession) -> str:
    """The folder of ``spark.checkpoint.dir``; in local mode alone one of our own where none is set."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        master = spark.sparkContext.master
        if not master.startswith("local") or master.startswith("local-cluster"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        own = tempfile.mkdtemp(prefix="netloom-")
        atexit.register(shutil.rmtree, own, ignore_errors=True)
        folder = f"file://{own}"
        spark.conf.set("spark.checkpoint.dir", folder)
    return folder.rstrip("/")


def materialise(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` to the shared folder and read it back: computed once, and it outlives any executor."""
    path = f"{shared_dir(df.sparkSession)}/{name}-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    _WRITTEN.append(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def drop_written(spark: SparkSession, paths: list[str] | None = None) -> int:
    """Delete tables that :func:`materialise` wrote (all, or those given); results that read them must have been written before."""
    context = spark.sparkContext
    paths = list(_WRITTEN) if paths is None else paths
    for path in paths:
        at = context._jvm.org.apache.hadoop.fs.Path(path)
        at.getFileSystem(context._jsc.hadoopConfiguration()).delete(at, True)
        _WRITTEN.remove(path)
    return len(paths)


@contextmanager
def scratch(spark: SparkSession) -> Iterator[None]:
    """Everything materialised inside is deleted at the end; write results within."""
    before = len(_WRITTEN)
    try:
        yield
    finally:
        drop_written(spark, _WRITTEN[before:])

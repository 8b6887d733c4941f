"""Parquet sources, and the shared folder for tables that cut lineage."""

from __future__ import annotations

import atexit
import os
import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession

#: Folders written by ``cut`` that were not released yet, in order.
_OPEN: dict[str, SparkSession] = {}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """The Parquet table ``name`` (a file or a folder) of a data directory."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def checkpoint_dir(spark: SparkSession) -> str:
    """The shared folder named in ``spark.checkpoint.dir``.

    Only where a session names none (tests on one machine) a local folder is set.
    """
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named
    sc = spark.sparkContext
    if (set_ := sc.getCheckpointDir()) is not None:
        # The folder that was set, without the one Spark makes below it.
        return os.path.dirname(set_.rstrip("/"))
    if not sc.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
    return os.path.join(tempfile.gettempdir(), "weftline-checkpoints")


def cut(df: DataFrame) -> DataFrame:
    """The same rows, written as Parquet to the shared folder and read again.

    A table survives lost executors and, unlike ``checkpoint()``, is columnar:
    later reads take only the columns and row groups they need.  It stays until
    it is released, its ``cuts`` scope ends, or the program does.
    """
    spark = df.sparkSession
    path = f"{checkpoint_dir(spark).rstrip('/')}/cut-{uuid.uuid4().hex}"
    _OPEN[path] = spark
    df.write.option("compression", "zstd").parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._cut_path = path
    return out


def _delete(spark: SparkSession, path: str) -> None:
    """Delete a folder through Spark's file system, so also on shared storage."""
    jvm = spark.sparkContext._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)


def release(*tables: DataFrame) -> None:
    """Delete tables written by ``cut`` that no plan reads any more."""
    for df in tables:
        path = getattr(df, "_cut_path", None)
        if path in _OPEN:
            _delete(_OPEN.pop(path), path)


@contextmanager
def cuts() -> Iterator[None]:
    """Scope whose tables written by ``cut`` are deleted at its end: write results inside it."""
    before = set(_OPEN)
    try:
        yield
    finally:
        for path in [p for p in _OPEN if p not in before]:
            _delete(_OPEN.pop(path), path)


@atexit.register
def _delete_all() -> None:
    for path, spark in list(_OPEN.items()):
        try:
            _delete(spark, path)
        except Exception:  # the session may have ended
            if "://" not in path:
                import shutil

                shutil.rmtree(path, ignore_errors=True)
    _OPEN.clear()

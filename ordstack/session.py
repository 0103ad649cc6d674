"""Stored intermediate tables.

A fitted mapping or a prepared feature table is used by several later jobs. It is written once, as
Parquet, to the shared folder the cluster names in ``spark.checkpoint.dir``: that cuts the lineage,
survives the loss of executors, and gives Catalyst exact sizes to pick join strategies by.
"""

from __future__ import annotations

import os
import shutil
import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession

_local_scratch: tempfile.TemporaryDirectory | None = None


def scratch_root(spark: SparkSession) -> str:
    """Shared folder of this application; a private local one only in local mode."""
    global _local_scratch
    shared = spark.conf.get("spark.checkpoint.dir", None)
    if shared:
        return f"{shared.rstrip('/')}/ordstack/{spark.sparkContext.applicationId}"
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder every executor can reach")
    if _local_scratch is None:
        _local_scratch = tempfile.TemporaryDirectory(prefix="ordstack-")
    return _local_scratch.name


def scratch_path(spark: SparkSession, label: str) -> str:
    """A fresh path below the scratch root."""
    return f"{scratch_root(spark)}/{label}-{uuid.uuid4().hex}"


def store(df: DataFrame, label: str, partition_by: str | None = None) -> DataFrame:
    """Write ``df`` once and return the written table."""
    spark = df.sparkSession
    path = scratch_path(spark, label)
    for paths in _passing:
        paths.append(path)
    writer = df.write.partitionBy(partition_by) if partition_by else df.write
    writer.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


_passing: list[list[str]] = []


@contextmanager
def passing(spark: SparkSession) -> Iterator[None]:
    """Tables stored inside are deleted at the end: nothing that is still to be computed may read them."""
    paths: list[str] = []
    _passing.append(paths)
    try:
        yield
    finally:
        _passing[:] = [x for x in _passing if x is not paths]
        for p in paths:
            folder = spark._jvm.org.apache.hadoop.fs.Path(p)
            folder.getFileSystem(spark._jsc.hadoopConfiguration()).delete(folder, True)


_shipped: dict[str, tempfile.TemporaryDirectory] = {}  # kept while executors may still fetch it


def ship(spark: SparkSession) -> None:
    """Send this package to the Python workers, as ``--py-files`` does, unless they can import it anyway."""
    root = Path(__file__).resolve().parents[1]
    known = [os.getcwd(), *os.environ.get("PYTHONPATH", "").split(os.pathsep)]
    context = spark.sparkContext
    if any(p and Path(p).resolve() == root for p in known) or context.applicationId in _shipped:
        return
    folder = _shipped[context.applicationId] = tempfile.TemporaryDirectory(prefix="ordstack-")
    context.addPyFile(shutil.make_archive(f"{folder.name}/ordstack-core", "zip", root, "ordstack"))

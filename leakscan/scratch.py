"""Intermediate results as parquet tables in the cluster's shared checkpoint folder.

A written table cuts lineage, outlives a lost executor, and has a measured size that
the optimizer can use when it decides on a broadcast.
"""

from __future__ import annotations

import atexit
import contextlib
import shutil
import tempfile
import threading
import uuid
from collections.abc import Iterator

from pyspark.sql import DataFrame, SparkSession

SETTING = "spark.checkpoint.dir"
CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"

_local_root: str | None = None
_lock = threading.Lock()
_written: list[tuple[object, object, object]] = []


def scratch_root(spark: SparkSession) -> str:
    """Folder named by ``spark.checkpoint.dir``; a temporary one only in local mode."""
    global _local_root
    configured = spark.conf.get(SETTING, None) or spark.sparkContext.getCheckpointDir()
    if configured:
        return configured.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise RuntimeError(f"set {SETTING} to a folder that every executor can reach")
    if _local_root is None:
        _local_root = tempfile.mkdtemp(prefix="leakscan-")
        atexit.register(shutil.rmtree, _local_root, True)
    return _local_root


def materialize(df: DataFrame, name: str, codec: str | None = None) -> DataFrame:
    """Write ``df`` once and return a DataFrame that reads the written table. ``codec`` names a Parquet compression."""
    spark = df.sparkSession
    path = f"{scratch_root(spark)}/leakscan/{uuid.uuid4().hex}/{name}"
    with with_settings(spark, {CLEANUP: "true"}):
        df.write.parquet(path, compression=codec)
    table = spark.read.schema(df.schema).parquet(path)
    _remember(spark, table, path)
    return table


def claim(spark: SparkSession, name: str) -> str:
    """A new folder's path for files that a caller writes itself; ``release_scratch`` deletes it too, and so does ``discard`` of this path."""
    path = f"{scratch_root(spark)}/leakscan/{uuid.uuid4().hex}/{name}"
    _remember(spark, path, path)
    return path


def _remember(spark: SparkSession, kept: object, path: str) -> None:
    folder = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path).getParent()
    with _lock:
        _written.append((kept, folder, folder.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())))


@contextlib.contextmanager
def with_settings(spark: SparkSession, settings: dict[str, str]) -> Iterator[None]:
    """Settings that hold within the block, as CLEANUP does for a written table.

    By CLEANUP shuffle files go when the query ends, as later steps read the written table; else they stay until the driver collects garbage.
    """
    before = {name: spark.conf.get(name, None) for name in settings}
    for name, value in settings.items():
        spark.conf.set(name, value)
    try:
        yield
    finally:
        for name, value in before.items():
            if value is None:
                spark.conf.unset(name)
            else:
                spark.conf.set(name, value)


def discard(*tables: DataFrame | str) -> None:
    """Delete written tables and claimed folders that no later step reads. Other DataFrames are left alone."""
    gone = {id(table) for table in tables}
    with _lock:
        doomed = [entry for entry in _written if id(entry[0]) in gone]
        _written[:] = [entry for entry in _written if id(entry[0]) not in gone]
    for _, folder, files in doomed:
        files.delete(folder, True)


@contextlib.contextmanager
def written_meanwhile() -> Iterator[list[DataFrame]]:
    """A list that holds, at the end of the block, the tables written in it and not discarded since."""
    tables: list[DataFrame] = []
    with _lock:
        before = {id(entry[0]) for entry in _written}
    try:
        yield tables
    finally:
        with _lock:
            tables += [entry[0] for entry in _written if id(entry[0]) not in before and isinstance(entry[0], DataFrame)]


def release_scratch() -> int:
    """Delete every table this process still keeps; results that read them stop working."""
    count = len(_written)
    discard(*[entry[0] for entry in _written])
    return count


def _release_at_exit() -> None:
    with contextlib.suppress(Exception):
        release_scratch()


atexit.register(_release_at_exit)

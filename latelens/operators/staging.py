"""Cut points in a job: write a frame to shared storage and read it back.

A staged table survives the loss of executors, is read with column pruning and
filter push-down, and has a known size, so that Spark's own broadcast threshold
decides about join strategies from measured bytes instead of guesses.

The folder is the one named by ``spark.checkpoint.dir``.  Only a local session that
names none gets a folder of its own.  Staged tables end with the session; those staged
inside ``staged_until_done`` end with its block, also when it fails.
"""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession

_local_roots: dict[str, str] = {}
_folders: set[str] = set()
_scopes: list[list[str]] = []


def _hadoop(spark: SparkSession, name: str):
    path = spark._jvm.org.apache.hadoop.fs.Path(name)
    return path, path.getFileSystem(spark._jsc.hadoopConfiguration())


def staging_folder(spark: SparkSession) -> str:
    app = spark.sparkContext.applicationId
    shared = spark.conf.get("spark.checkpoint.dir", None)
    if shared:
        folder = f"{shared.rstrip('/')}/staged-{app}"
    else:
        master = spark.sparkContext.master
        if master != "local" and not master.startswith("local["):
            raise RuntimeError("set spark.checkpoint.dir to a folder all executors can reach")
        if app not in _local_roots:
            _local_roots[app] = tempfile.mkdtemp(prefix="latelens-")
        folder = _local_roots[app]
    if folder not in _folders:
        path, fs = _hadoop(spark, folder)
        fs.deleteOnExit(path)
        _folders.add(folder)
    return folder


@contextmanager
def staged_until_done(spark: SparkSession) -> Iterator[None]:
    """Deletes, at the end of the block, what is staged inside it."""
    _scopes.append([])
    try:
        yield
    finally:
        for name in _scopes.pop():
            path, fs = _hadoop(spark, name)
            fs.delete(path, True)


@contextmanager
def scratch_folder(spark: SparkSession, label: str) -> Iterator[str]:
    """The full name of a new folder in shared storage, deleted with all in it at the end of the block."""
    path, fs = _hadoop(spark, f"{staging_folder(spark)}/{label}-{uuid.uuid4().hex}")
    try:
        yield fs.makeQualified(path).toString()
    finally:
        fs.delete(path, True)


@contextmanager
def shuffles_dropped(spark: SparkSession) -> Iterator[None]:
    """What is written inside the block leaves no shuffle files; else they stay until the driver collects garbage."""
    name = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    before = spark.conf.get(name, None)
    spark.conf.set(name, "true")
    try:
        yield
    finally:
        if before is None:
            spark.conf.unset(name)
        else:
            spark.conf.set(name, before)


def stage(df: DataFrame, label: str = "table", partition_by: list[str] | None = None, outlives: bool = False) -> DataFrame:
    """Materialise a frame once; the result is a plain Parquet scan.

    With ``partition_by``, the last columns, a filter on them reads and sizes only its own files.
    ``outlives``: the table stays when the innermost ``staged_until_done`` ends.
    """
    path = f"{staging_folder(df.sparkSession)}/{label}-{uuid.uuid4().hex}"
    scopes = _scopes[:-1] if outlives else _scopes
    if scopes:
        scopes[-1].append(path)
    with shuffles_dropped(df.sparkSession):
        df.write.partitionBy(*(partition_by or [])).option("compression", "zstd").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def unstage(df: DataFrame) -> None:
    """Delete a staged table that nothing reads any more."""
    for name in {file.rpartition("/")[0] for file in df.inputFiles()}:
        path, fs = _hadoop(df.sparkSession, name)
        fs.delete(path, True)


def drop_staged(spark: SparkSession) -> None:
    """Delete everything this session staged, once its frames are no longer needed."""
    path, fs = _hadoop(spark, staging_folder(spark))
    fs.delete(path, True)

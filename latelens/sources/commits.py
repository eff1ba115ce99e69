"""Sinks that replace a table as a whole or by partition, with nothing half done.

A write goes to a hidden folder beside the table.  Once Spark has committed it there, a manifest beside the
table names the folders to be moved, and the moves follow.  A writer that fails before the manifest leaves the
old table as it was; one that dies after it has its moves finished by the next reader or writer of the table.
Every move can be repeated.  The table itself is a plain folder of files.

One writer per table at a time; folders that dead writers left are cleared by the next one.  While moves are
pending, a reader that does not come through ``finish_commit`` may meet old and new partitions.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession


class _Place:
    """A table's folder, its parent and the names beside it."""

    def __init__(self, spark: SparkSession, path: str):
        self.jvm = spark._jvm
        path = self.jvm.org.apache.hadoop.fs.Path(path.rstrip("/"))
        self.fs = path.getFileSystem(spark._jsc.hadoopConfiguration())
        self.path = self.fs.makeQualified(path)
        self.name, self.parent = self.path.getName(), self.path.getParent()
        self.manifest = self.beside(f"_{self.name}.commit")

    def beside(self, name: str):
        return self.jvm.org.apache.hadoop.fs.Path(self.parent, name)

    def children(self, path) -> list:
        return [s for s in self.fs.listStatus(path) if not s.getPath().getName().startswith(("_", "."))]

    def partitions(self, folder: str, depth: int) -> list[str]:
        """Partition folders that many levels below ``folder``, as paths relative to it."""
        found = [""]
        for _ in range(depth):
            found = [f"{f}/{s.getPath().getName()}".lstrip("/") for f in found
                     for s in self.children(self.beside(f"{folder}/{f}".rstrip("/"))) if s.isDirectory()]
        return found

    def move(self, source: str, target: str) -> None:
        """Put a folder in another's place; nothing to do if it has gone there already."""
        a, b = self.beside(source), self.beside(target)
        if not self.fs.exists(a):
            return
        self.fs.delete(b, True)
        self.fs.mkdirs(b.getParent())
        if not self.fs.rename(a, b):
            raise OSError(f"cannot move {a} to {b}")

    def write_manifest(self, content: dict) -> None:
        draft = self.beside(f"_{self.name}.draft")
        out = self.fs.create(draft, True)
        out.write(json.dumps(content).encode())
        out.close()
        if not self.fs.rename(draft, self.manifest):
            raise OSError(f"cannot write {self.manifest}")

    def finish(self) -> bool:
        if not self.fs.exists(self.manifest):
            return False
        stream = self.fs.open(self.manifest)
        content = json.loads(self.jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8"))
        stream.close()
        for source, target in content["moves"]:
            self.move(source, target)
        self.fs.delete(self.beside(content["staged"]), True)
        self.fs.delete(self.manifest, False)
        return True

    def clear(self) -> None:
        for status in self.fs.listStatus(self.parent) if self.fs.exists(self.parent) else []:
            if status.getPath().getName().startswith(f"_{self.name}.new-"):
                self.fs.delete(status.getPath(), True)


def finish_commit(spark: SparkSession, path: str) -> bool:
    """Finish the moves of a writer that died among them; whether there were any."""
    return _Place(spark, path).finish()


@contextmanager
def replacing(spark: SparkSession, path: str, partition_by: list[str] | None = None) -> Iterator[str]:
    """A new folder to write to, which takes the place of ``path`` when the block ends without an error.

    With ``partition_by``, only the partitions written replace their namesakes; the others stay.
    """
    place = _Place(spark, path)
    place.finish()
    place.clear()
    staged = f"_{place.name}.new-{uuid.uuid4().hex}"
    try:
        yield place.beside(staged).toString()
        if partition_by:
            moves = [[f"{staged}/{p}", f"{place.name}/{p}"] for p in place.partitions(staged, len(partition_by))]
        else:
            moves = [[staged, place.name]]
        place.write_manifest({"staged": staged, "moves": moves})
    except BaseException:
        if not place.fs.exists(place.manifest):
            place.fs.delete(place.beside(staged), True)
        raise
    place.finish()


def _same_shape(df: DataFrame, path: str, partition_by: list[str]) -> None:
    place = _Place(df.sparkSession, path)
    if not place.fs.exists(place.path):
        return
    strange = [s.getPath().getName() for s in place.children(place.path)
               if not s.getPath().getName().startswith(f"{partition_by[0]}=")]
    if strange:
        raise ValueError(f"{path} is not partitioned by {partition_by}: it holds {strange[0]}")
    old = df.sparkSession.read.parquet(path).schema
    kinds = {f.name: f.dataType.simpleString() for f in old if f.name not in partition_by}
    new = {f.name: f.dataType.simpleString() for f in df.schema if f.name not in partition_by}
    if kinds != new or old.names[len(kinds):] != partition_by:
        raise ValueError(f"columns of {path} differ: {sorted(set(kinds.items()) ^ set(new.items()))}, {partition_by}")


def write_partitions(df: DataFrame, path: str, partition_by: list[str]) -> None:
    """Replace those partitions of a Parquet table that ``df`` has rows of; without rows nothing changes.

    Columns, their types and the partitioning must be those of the table.  NULL is a partition like others.
    The rows may come from the table itself.
    """
    finish_commit(df.sparkSession, path)
    _same_shape(df, path, partition_by)
    with replacing(df.sparkSession, path, partition_by) as folder:
        df.write.partitionBy(*partition_by).parquet(folder)

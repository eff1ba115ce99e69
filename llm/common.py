"""What the operators share: staged tables, streams of groups, connected components.

Staged tables are Parquet files below the folder named by ``spark.checkpoint.dir``, so a
lost executor costs a re-read and never a result.  A ``Scratch`` deletes its inner tables
when the operator is done; the final table of an operator lives until the session ends.
"""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: Rows of one Arrow batch: bounds a Python worker's memory even for very long texts.
BATCH_ROWS = 1000

_own_roots: dict[str, str] = {}


def shared_folder(spark: SparkSession) -> str:
    """The folder in ``spark.checkpoint.dir``; a local session without one gets its own."""
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named.rstrip("/")
    if not spark.sparkContext.master.startswith("local["):
        raise RuntimeError("set spark.checkpoint.dir to a folder all executors can reach")
    app = spark.sparkContext.applicationId
    if app not in _own_roots:
        _own_roots[app] = tempfile.mkdtemp(prefix="llm-")
    return _own_roots[app]


def small_batches(spark: SparkSession) -> None:
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(BATCH_ROWS))


class Scratch:
    """``with Scratch(spark) as s``: tables of ``s.keep`` go at the end, those of ``s.result`` with the session."""

    def __init__(self, spark: SparkSession):
        self.spark = spark
        self.folder = f"{shared_folder(spark)}/llm-{uuid.uuid4().hex}"
        small_batches(spark)

    def __enter__(self) -> Scratch:
        return self

    def __exit__(self, *_) -> None:
        path, fs = self._at(f"{self.folder}/inner")
        fs.delete(path, True)

    def _at(self, name: str):
        path = self.spark._jvm.org.apache.hadoop.fs.Path(name)
        return path, path.getFileSystem(self.spark._jsc.hadoopConfiguration())

    def _written(self, df: DataFrame, name: str) -> DataFrame:
        df.write.parquet(name)
        return self.spark.read.schema(df.schema).parquet(name)

    def keep(self, df: DataFrame, label: str = "table") -> DataFrame:
        return self._written(df, f"{self.folder}/inner/{label}-{uuid.uuid4().hex[:12]}")

    def drop(self, df: DataFrame) -> None:
        """Delete a kept table before the end."""
        for name in {f.rsplit("/", 1)[0] for f in df.inputFiles()}:
            if f"{self.folder}/inner/".split(":", 1)[-1].lstrip("/") in name:
                path, fs = self._at(name)
                fs.delete(path, True)

    def result(self, df: DataFrame, label: str = "result") -> DataFrame:
        out = self._written(df, f"{self.folder}/{label}")
        path, fs = self._at(self.folder)
        fs.deleteOnExit(path)
        return out


def as_bytes(column: pa.Array) -> list[bytes | None]:
    """The texts of an Arrow column as UTF-8 bytes, without decoding them."""
    return column.cast(pa.large_binary()).to_pylist()


def by_group(batches: Iterator[pa.RecordBatch], keys: list[str]) -> Iterator[pa.Table]:
    """The groups of a stream sorted by ``keys``; holds one group and one batch at a time.

    Groups must be of bounded size: callers cut hot keys into blocks beforehand.
    """
    held: list[pa.RecordBatch] = []
    last = None
    for batch in batches:
        if not batch.num_rows:
            continue
        columns = [batch.column(k).to_numpy(zero_copy_only=False) for k in keys]
        change = np.zeros(batch.num_rows, bool)
        for c in columns:
            change[1:] |= c[1:] != c[:-1]
        starts = np.concatenate([[0], np.flatnonzero(change), [batch.num_rows]])
        first = tuple(c[0] for c in columns)
        if held and first != last:
            yield pa.Table.from_batches(held)
            held = []
        for a, b in zip(starts[:-1], starts[1:], strict=True):
            held.append(batch.slice(a, b - a))
            if b < batch.num_rows:
                yield pa.Table.from_batches(held)
                held = []
        last = tuple(c[-1] for c in columns)
    if held:
        yield pa.Table.from_batches(held)


def bounded_sample(scratch: Scratch, rows: DataFrame, by: str, id_col: str, per: int) -> DataFrame:
    """About ``per`` rows of each value of ``by``, at most, chosen by a hash of the id; adds ``place`` 1, 2, ...

    A threshold on the hash, from the counts, thins the rows out before any are ranked, so a hot
    value sends no more rows to the ranking than a rare one.
    """
    counts = scratch.keep(rows.groupBy(F.col(by).alias("_by")).agg(F.count(F.lit(1)).alias("_n")), "counts")
    draw = F.xxhash64(F.lit("sample"), F.col(id_col)).bitwiseAND((1 << 53) - 1) / F.lit(float(1 << 53))
    thin = rows.join(counts, F.col(by) == F.col("_by")).where(draw * F.col("_n") <= 1.2 * per + 50).drop("_by", "_n")
    place = F.row_number().over(Window.partitionBy(by).orderBy(draw, id_col))
    return thin.withColumn("place", place).where(F.col("place") <= per)


class Forest:
    """Union-find over positions 0..n-1; the root of a set is its smallest member."""

    def __init__(self, n: int):
        self.up = list(range(n))

    def root(self, i: int) -> int:
        while self.up[i] != i:
            self.up[i] = i = self.up[self.up[i]]
        return i

    def join(self, i: int, j: int) -> None:
        a, b = self.root(i), self.root(j)
        if a != b:
            self.up[max(a, b)] = min(a, b)


def connected_components(scratch: Scratch, links: DataFrame) -> DataFrame:
    """(id, component) of every id in ``links`` (a, b): component is the smallest id reachable.

    Alternating large-star and small-star rounds; each is a minimum per key with map-side
    combine and a join, so a hub with any number of links is split like any skewed join.
    """
    small = scratch.keep(
        links.where("a != b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct(), "links")
    mark = None
    while True:
        both = small.union(small.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        large = both.join(low, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        large = scratch.keep(large, "large")
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        pairs = large.join(low, "u").where("v != m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        after = scratch.keep(pairs.union(low.select("u", F.col("m").alias("v"))).distinct(), "small")
        now = after.agg(F.count(F.lit(1)), F.bit_xor(F.xxhash64("u", "v"))).first()
        scratch.drop(small)
        scratch.drop(large)
        small = after
        if tuple(now) == mark:
            break
        mark = tuple(now)
    roots = small.select(F.col("v").alias("id"), F.col("v").alias("component")).distinct()
    return small.select(F.col("u").alias("id"), F.col("v").alias("component")).union(roots)

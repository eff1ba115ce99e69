"""Which id came first among rows of equal content, with hot contents split over many tasks."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from llm.common import Scratch

#: Rows of one content are dealt over so many keys, by a hash of their id.
SALTS = 4096


def first_copies(scratch: Scratch, rows: DataFrame, key: str, id_col: str) -> DataFrame:
    """(key, salt, first): the smallest id of every key that several ids share, once per salt in use.

    Join it to ``rows`` on ``key`` and ``salt_of(id_col)``: each partition then holds at most one row per
    partial, however many rows one key has.  Two aggregations, both combined before their shuffle; the
    table never has more rows than there are rows with repeated content.
    """
    some = rows.where(F.col(key).isNotNull() & F.col(id_col).isNotNull())
    parts = some.groupBy(F.col(key).alias("key"), salt_of(id_col).alias("salt")).agg(
        F.min(id_col).alias("low"), F.max(id_col).alias("high"))
    firsts = parts.groupBy("key").agg(
        F.min("low").alias("first"), F.max("high").alias("last"), F.collect_set("salt").alias("salts"))
    shared = firsts.where(F.col("first") < F.col("last"))
    return scratch.keep(shared.select("key", F.explode("salts").alias("salt"), "first"), "first-copies")


def salt_of(id_col: str):
    return F.pmod(F.xxhash64(F.col(id_col)), F.lit(SALTS)).cast("int")

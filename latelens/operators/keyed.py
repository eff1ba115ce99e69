"""Per-key aggregates, lookups and integrity checks."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from latelens.operators.staging import stage


def latest_per_key(df: DataFrame, key: str, time: str, tie: str, columns: list[str]) -> DataFrame:
    """One row per key: the latest by time, a missing time counting as latest.

    An arg-max aggregate, so rows are combined before the shuffle and a key with very
    many rows is no problem (a row-number window would sort them in one task).
    """
    recency = F.struct(F.col(time).isNull(), F.col(time), F.col(tie))
    best = df.groupBy(key).agg(F.max_by(F.struct(*columns), recency).alias("__b"))
    return best.select(key, "__b.*")


def first_per_key(df: DataFrame, key: str, order: str, columns: list[str]) -> DataFrame:
    """One row per key: the one that comes first by ``order``."""
    best = df.groupBy(key).agg(F.min_by(F.struct(*columns), F.col(order)).alias("__b"))
    return best.select(key, "__b.*")


def first_non_null(column: str, order: str) -> Column:
    """Aggregate: the first value present, looking at each column on its own."""
    return F.min_by(F.col(column), F.when(F.col(column).isNotNull(), F.col(order)))


def frequency(df: DataFrame, column: str) -> DataFrame:
    """Rows per value and their share of all rows."""
    counts = df.groupBy(column).agg(F.count(F.lit(1)).alias("n"))
    total = df.agg(F.count(F.lit(1)).alias("__all"))
    return counts.crossJoin(F.broadcast(total)).select(  # one row
        column, "n", (F.col("n") / F.col("__all")).alias("share")
    )


def orphans(child: DataFrame, parent: DataFrame, key: str, parent_key: str | None = None) -> DataFrame:
    """One row: child rows whose key the parent table does not have."""
    per_key = child.groupBy(key).agg(F.count(F.lit(1)).alias("__n"))
    keys = parent.select(F.col(parent_key or key).alias(key)).distinct()
    lost = per_key.join(keys, key, "left_anti")
    return lost.agg(F.coalesce(F.sum("__n"), F.lit(0)).alias("orphans"))


def orphan_report(tables: dict[str, DataFrame], references: dict[str, tuple[str, str, str, str]]) -> DataFrame:
    """Orphan rows per named check, (child table, child key, parent table, parent key): one job per parent.

    The keys of a parent and of all its children meet in one shuffle of counts per key, and its files
    go before those of the next parent come.  A row without key is an orphan.  Keys compare as text.
    """
    by_parent: dict[tuple[str, str], list[tuple[str, str, str]]] = {}
    for name, (child, key, parent, parent_key) in references.items():
        by_parent.setdefault((parent, parent_key), []).append((name, child, key))
    found = []
    for (parent, parent_key), checks in by_parent.items():
        counts = [f"n{i}" for i in range(len(checks))]

        def keyed(table, key, check):
            return tables[table].select(F.col(key).cast("string").alias("key"), F.lit(check is None).alias("known"), *[
                F.lit(int(i == check)).cast("bigint").alias(c) for i, c in enumerate(counts)])

        asked = [keyed(child, key, i) for i, (_, child, key) in enumerate(checks)]
        known = keyed(parent, parent_key, None).where("key is not null")
        per_key = reduce(DataFrame.unionAll, [*asked, known]).groupBy("key").agg(
            F.max("known").alias("known"), *[F.sum(c).alias(c) for c in counts])
        lost = per_key.where("not known").agg(*[F.coalesce(F.sum(c), F.lit(0)).alias(c) for c in counts])
        found.append(stage(lost.select(F.inline(F.array(*[
            F.struct(F.lit(name).alias("check_name"), F.col(c).alias("orphans")) for (name, _, _), c in zip(checks, counts)
        ]))), "orphans"))
    return reduce(DataFrame.unionAll, found)


def null_profile(df: DataFrame, columns: list[str]) -> DataFrame:
    """Rows and share missing, one row per column, from a single pass."""
    counted = df.agg(
        F.count(F.lit(1)).alias("__rows"),
        *[F.count_if(F.col(c).isNull()).alias(c) for c in columns],
    )
    cells = F.array(*[F.struct(F.lit(c).alias("column_name"), F.col(c).alias("n_null")) for c in columns])
    return counted.select("__rows", F.inline(cells)).select(
        "column_name", "n_null", (F.col("n_null") / F.col("__rows")).alias("null_share")
    )


def hash_sample(df: DataFrame, key: str, n: int, seed: int = 42) -> DataFrame:
    """At most n rows, the same ones on every run: smallest hashes of (key, seed) first."""
    mark = F.md5(F.concat_ws(":", F.col(key).cast("string"), F.lit(str(seed))))
    return df.orderBy(mark, F.col(key)).limit(n)

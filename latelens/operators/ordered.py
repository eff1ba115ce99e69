"""Ordered computations without one huge window partition.

A window partition lives in one task.  Here a key (a seller, a single global group)
may hold any share of the rows, so ordered work is cut into *ranges*: the rows are
range-partitioned by (keys, order), each range is scanned on its own, and what came
before a range is added from a table with at most one row per range.  Inputs of every
size take this path.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from latelens.operators.staging import stage

#: A key with more rows than this is numbered range by range, not in one task.
HOT_KEY_ROWS = 1_000_000
_RANGE = "__range"


def _as_columns(columns) -> list[Column]:
    return [F.col(c) if isinstance(c, str) else c for c in columns]


def range_count(df: DataFrame) -> int:
    """Ranges to cut a frame into: the session's shuffle width."""
    return max(1, int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")))


def cut_into_ranges(df: DataFrame, by: list, ranges: int, label: str = "ranges") -> DataFrame:
    """Stage the frame in sorted ranges, numbered by ``__range``.

    Staging fixes the numbers: a range keeps its rows however often it is read.
    """
    ranged = df.repartitionByRange(ranges, *by).withColumn(_RANGE, F.spark_partition_id())
    return stage(ranged, label)


def running_totals(
    df: DataFrame,
    keys: list[str],
    order: list,
    measures: dict[str, Column | str],
    ranges: int | None = None,
) -> DataFrame:
    """Add, per measure, its total over all *earlier* rows of the same key.

    ``order`` must be a total order within a key (end it with an id).  ``keys`` may be
    empty for a global running total.
    """
    order = _as_columns(order)
    values = {name: (F.col(m) if isinstance(m, str) else m) for name, m in measures.items()}
    ranges = ranges or range_count(df)
    ranged = cut_into_ranges(df, [*keys, *order], ranges)

    earlier = (
        Window.partitionBy(_RANGE, *keys)
        .orderBy(*order)
        .rowsBetween(Window.unboundedPreceding, -1)
    )
    scanned = ranged.select(
        "*", *[F.coalesce(F.sum(v).over(earlier), F.lit(0)).alias(name) for name, v in values.items()]
    )
    # What earlier ranges of the same key add up to.  A range has at most one key that
    # began before it, so this table never has more rows than there are ranges.
    per_range = ranged.groupBy(_RANGE, *keys).agg(*[F.sum(v).alias(name) for name, v in values.items()])
    before = Window.partitionBy(*keys).orderBy(_RANGE).rowsBetween(Window.unboundedPreceding, -1)
    carried = per_range.select(
        F.col(_RANGE).alias("__r"),
        *[F.col(k).alias(f"__k_{k}") for k in keys],
        F.count(F.lit(1)).over(before).alias("__parts"),
        *[F.sum(name).over(before).alias(f"__c_{name}") for name in values],
    ).where("__parts > 0")

    match = F.col(_RANGE) == F.col("__r")
    for k in keys:
        match = match & F.col(k).eqNullSafe(F.col(f"__k_{k}"))
    joined = scanned.join(F.broadcast(carried), match, "left")
    kept = [F.col(c) for c in df.columns]
    totals = [
        (F.col(name) + F.coalesce(F.col(f"__c_{name}"), F.lit(0))).alias(name) for name in values
    ]
    return joined.select(*kept, *totals)


def rows_at_positions(df: DataFrame, order: list, positions: list[int]) -> DataFrame:
    """The rows at the given 0-based positions of the global sort order.

    Only the ranges that hold a wanted position are sorted.
    """
    order = _as_columns(order)
    ranged = cut_into_ranges(df, order, range_count(df))
    # One count per range comes to the driver, nothing that grows with the rows.
    counts = ranged.groupBy(_RANGE).count().orderBy(_RANGE).collect()
    wanted, start = None, 0
    within = F.row_number().over(Window.partitionBy(_RANGE).orderBy(*order)) - 1
    for c in counts:
        inside = [p for p in positions if start <= p < start + c["count"]]
        if inside:
            part = (
                ranged.where(F.col(_RANGE) == c[_RANGE])
                .withColumn("position", (within + F.lit(start)).cast("bigint"))
                .where(F.col("position").isin(inside))
            )
            wanted = part if wanted is None else wanted.unionByName(part)
        start += c["count"]
    if wanted is None:
        wanted = ranged.where("false").withColumn("position", F.lit(0).cast("bigint"))
    return wanted.drop(_RANGE)


def rolling_means(
    df: DataFrame,
    keys: list[str],
    position: str,
    value: str,
    widths: dict[str, int],
    chunk_rows: int = 100_000,
) -> DataFrame:
    """Mean of the last N earlier rows of a key, NULL until there are N of them.

    ``position`` is the row's 0-based number within its key.  A key is cut into chunks
    of ``chunk_rows``; the last rows of a chunk are repeated in front of the next one,
    so every frame is complete within its chunk.
    """
    halo = max(widths.values())
    if chunk_rows < halo:
        raise ValueError("a chunk must be at least as long as the widest frame")
    home = F.floor(F.col(position) / F.lit(chunk_rows)).cast("bigint")
    at_end = F.col(position) % chunk_rows >= chunk_rows - halo
    spread = df.withColumn("__home", home).withColumn(
        "__chunk",
        F.explode(F.when(at_end, F.array(F.col("__home"), F.col("__home") + 1)).otherwise(F.array("__home"))),
    )
    ordered = Window.partitionBy(*keys, "__chunk").orderBy(position)
    out = spread
    for name, width in widths.items():
        frame = ordered.rowsBetween(-width, -1)
        full = F.count(value).over(frame) == width
        out = out.withColumn(name, F.when(full, F.avg(F.col(value).cast("double")).over(frame)))
    return out.where("__chunk = __home").drop("__home", "__chunk")


def number_rows(
    df: DataFrame,
    key: str,
    order: list,
    number: str,
    first_value: dict[str, str] | None = None,
    hot_rows: int | None = None,
) -> DataFrame:
    """Number the rows of each key from 1 and repeat chosen values of row 1 on all rows.

    Keys are expected to be small; a key above ``hot_rows`` is numbered range by range
    instead of in one task.  Looking for such keys reads one column, while the plan is built.
    """
    hot_rows = HOT_KEY_ROWS if hot_rows is None else hot_rows
    first_value = first_value or {}
    order = _as_columns(order)

    def in_one_window(part: DataFrame) -> DataFrame:
        w = Window.partitionBy(key).orderBy(*order)
        first = [F.first(c).over(w).alias(a) for a, c in first_value.items()]
        return part.select("*", F.row_number().over(w).alias(number), *first)

    hot = stage(df.groupBy(key).count().where(F.col("count") > hot_rows).select(key), "hot_keys")
    if hot.isEmpty():
        return in_one_window(df)

    in_hot = stage(df.join(hot, key, "left_semi"), "hot_rows")
    counted = running_totals(in_hot, [key], order, {"__n": F.lit(1)})
    numbered = counted.withColumn(number, (F.col("__n") + 1).cast("int")).drop("__n")
    if first_value:
        firsts = numbered.where(F.col(number) == 1).select(
            key, *[F.col(c).alias(a) for a, c in first_value.items()]
        )
        numbered = numbered.join(firsts, key, "left")
    return in_one_window(df.join(hot, key, "left_anti")).unionByName(numbered)

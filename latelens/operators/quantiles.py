"""Exact quantiles, quantile bins and histograms at any size.

``percentile`` and ``median`` keep every distinct value of a group in one task.  Here a
bounded sketch first brackets each wanted rank, and a second pass keeps exact counts
only for values inside a bracket; everything between brackets is a plain count.  A bracket
that misses its rank is widened, and the second pass repeated, until it holds it.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from latelens.functions.expressions import bin_by_inner_edges, clip
from latelens.operators import ordered
from latelens.operators.staging import stage

SKETCH_ACCURACY = 10_000


def exact_quantiles(
    df: DataFrame,
    value: str,
    probabilities: list[float],
    by: list[str] | None = None,
    names: list[str] | None = None,
    accuracy: int = SKETCH_ACCURACY,
    margin: float | None = None,
) -> DataFrame:
    """Linearly interpolated quantiles, one row per group; NULL values and NULL groups drop out.

    The input is read more than once: hand in a scan or a staged frame.  ``margin`` is the
    first width of the brackets as a share of the rows, on either side of a rank.
    """
    by = by or []
    names = names or [f"q{i}" for i in range(len(probabilities))]
    base = df.select(*by, F.col(value).cast("double").alias("__v")).dropna()
    # A rank found by the sketch is off by at most n/accuracy: three times that is safe.
    margin = 3.0 / accuracy if margin is None else margin
    while True:
        edges = stage(_edges(base, probabilities, by, accuracy, margin), "quantiles")  # a row per group
        if margin >= 1 or edges.where("__missed").isEmpty():
            break
        margin = max(margin * 16, 1.0 / accuracy)
    out = []
    for i, (p, name) in enumerate(zip(probabilities, names)):
        place = (F.col("__n") - 1) * F.lit(float(p))
        a, b = F.col(f"__a{i}"), F.col(f"__b{i}")
        out.append((a + (b - a) * (place - F.floor(place))).alias(name))
    return edges.select(*by, F.col("__n").alias("n"), *out)


def _edges(base: DataFrame, probabilities: list[float], by: list[str], accuracy: int, margin: float) -> DataFrame:
    """Per group: its size, the values on both sides of each rank, and whether a bracket missed one."""
    brackets = _brackets(base, probabilities, by, accuracy, margin)
    tally = _bracketed_tally(base, brackets, probabilities, by)
    order = ["__begun", F.col("__v").asc_nulls_last()]
    before = ordered.running_totals(tally, by, order, {"__before": "__c"})
    sizes = brackets.select(*by, "__n")
    counted = before.join(sizes, by) if by else before.crossJoin(F.broadcast(sizes))  # one row
    picks, missed = [], F.lit(False)
    for i, p in enumerate(probabilities):
        place = (F.col("__n") - 1) * F.lit(float(p))
        for side, rank in (("a", F.floor(place)), ("b", F.ceil(place))):
            holds = (F.col("__before") <= rank) & (rank < F.col("__before") + F.col("__c"))
            picks.append(F.max(F.when(holds, F.col("__v"))).alias(f"__{side}{i}"))
            missed = missed | (holds & F.col("__v").isNull())
    return counted.groupBy(*by).agg(F.max("__n").alias("__n"), F.max(missed).alias("__missed"), *picks)


def _brackets(base: DataFrame, probabilities: list[float], by: list[str], accuracy: int, margin: float) -> DataFrame:
    """First pass, staged: per group its size and, from a sketch, bounds around each rank.

    Small groups are bracketed by their extremes.
    """
    points = [min(max(p + s, 0.0), 1.0) for p in probabilities for s in (-margin, margin)]
    sketch = base.groupBy(*by).agg(
        F.count(F.lit(1)).alias("__n"),
        F.min("__v").alias("__min"),
        F.max("__v").alias("__max"),
        F.percentile_approx("__v", F.lit(points), accuracy).alias("__p"),
    )
    small = F.col("__n") <= accuracy
    bounds = []
    for i, p in enumerate(probabilities):
        low = F.col("__min") if p <= margin else F.when(small, F.col("__min")).otherwise(F.col("__p")[2 * i])
        high = F.col("__max") if p >= 1 - margin else F.when(small, F.col("__max")).otherwise(F.col("__p")[2 * i + 1])
        bounds += [low.alias(f"__lo{i}"), high.alias(f"__hi{i}")]
    return stage(sketch.select(*by, "__n", *bounds), "brackets")


def _bracketed_tally(base: DataFrame, brackets: DataFrame, probabilities: list[float], by: list[str]) -> DataFrame:
    """Second pass: counts per (brackets begun, value if bracketed); between brackets only a count survives."""
    joined = base.join(brackets, by) if by else base.crossJoin(F.broadcast(brackets))  # one row
    inside, begun = F.lit(False), F.lit(0)
    for i in range(len(probabilities)):
        inside = inside | F.col("__v").between(F.col(f"__lo{i}"), F.col(f"__hi{i}"))
        begun = begun + (F.col("__v") >= F.col(f"__lo{i}")).cast("int")
    return joined.groupBy(*by, begun.alias("__begun"), F.when(inside, F.col("__v")).alias("__v")).agg(
        F.count(F.lit(1)).alias("__c"))


def long_form(df: DataFrame, columns: list[str], kind: str) -> DataFrame:
    """(column_name, value), one row per cell; to be counted or sketched, not to be stored."""
    cells = F.array(*[
        F.struct(F.lit(c).alias("column_name"), F.col(c).cast(kind).alias("value")) for c in columns
    ])
    return df.select(F.inline(cells))


def medians_of(df: DataFrame, columns: list[str], names: list[str] | None = None) -> DataFrame:
    """One row: the exact medians of several columns, from one sketch pass and one exact pass over all of them."""
    found = exact_quantiles(long_form(df, columns, "double"), "value", [0.5], ["column_name"], ["median"])
    return found.agg(*[
        F.max(F.when(F.col("column_name") == c, F.col("median"))).alias(n) for c, n in zip(columns, names or columns, strict=True)
    ])


def median_by(df: DataFrame, value: str, by: list[str] | None = None, name: str = "median") -> DataFrame:
    """Exact median per group (or one row)."""
    return exact_quantiles(df, value, [0.5], by, [name]).drop("n")


def quantile_edges(df: DataFrame, value: str, bins: int) -> list[float]:
    """Distinct bin edges; equal up to noise counts as equal.  bins + 1 numbers at most."""
    step = 1.0 / bins
    row = exact_quantiles(df, value, [i * step for i in range(bins)] + [1.0]).first()
    edges: list[float] = []
    for edge in [] if row is None else row[1:]:
        if not edges or round(edge, 12) != round(edges[-1], 12):
            edges.append(edge)
    return edges


def with_quantile_bin(df: DataFrame, value: str, bins: int, name: str) -> DataFrame:
    """Add the 0-based equal-count bin; ties share a bin, so there may be fewer bins."""
    edges = quantile_edges(df, value, bins)
    return df.withColumn(name, bin_by_inner_edges(value, edges[1:-1]))


def histogram(
    df: DataFrame,
    value: str,
    bins: int,
    low: float | None = None,
    high: float | None = None,
    by: str | None = None,
) -> DataFrame:
    """Counts in equal-width bins between the extremes of the (clipped) values.

    Empty bins are listed.  With ``by``, every class also gets a density that
    integrates to 1 over the common bins.
    """
    x = clip(value, low, high) if low is not None and high is not None else F.col(value).cast("double")
    base = df.select(*([by] if by else []), x.alias("__x")).where("__x is not null")
    span = base.agg(F.min("__x").alias("__lo"), F.max("__x").alias("__hi")).select(
        # A single distinct value gets a bin range of width 1 around it.
        F.when(F.col("__lo") == F.col("__hi"), F.col("__lo") - 0.5).otherwise(F.col("__lo")).alias("__lo"),
        F.when(F.col("__lo") == F.col("__hi"), F.col("__hi") + 0.5).otherwise(F.col("__hi")).alias("__hi"),
    )
    keys = [by] if by else []
    width = (F.col("__hi") - F.col("__lo")) / bins
    # The quotient may be off by a rounding error next to an edge: the edges decide.
    guess = F.least(F.floor((F.col("__x") - F.col("__lo")) / width).cast("int"), F.lit(bins - 1))
    lower, upper = F.col("__lo") + F.col("__g") * width, F.col("__lo") + (F.col("__g") + 1) * width
    settled = (
        F.when(F.col("__x") < lower, F.col("__g") - 1)
        .when((F.col("__x") >= upper) & (F.col("__g") < bins - 1), F.col("__g") + 1)
        .otherwise(F.col("__g"))
    )
    counts = (
        base.crossJoin(F.broadcast(span))  # one row
        .withColumn("__g", guess)
        .groupBy(*keys, (settled + 1).alias("bin"))
        .agg(F.count(F.lit(1)).alias("n"))
    )
    grid = df.sparkSession.range(1, bins + 1).select(F.col("id").cast("int").alias("bin"))
    if by:
        counts = stage(counts, "histogram")  # at most classes x bins rows
        totals = counts.groupBy(by).agg(F.sum("n").alias("__total"))
        grid = totals.crossJoin(grid)
    filled = grid.join(counts, [*keys, "bin"], "left").crossJoin(F.broadcast(span))
    out = filled.select(
        *keys,
        "bin",
        (F.col("__lo") + (F.col("bin") - 1) * width).alias("left_edge"),
        F.coalesce("n", F.lit(0)).alias("n"),
        *([(F.coalesce("n", F.lit(0)) / F.col("__total") / width).alias("density")] if by else []),
    )
    return out

"""Scalar building blocks as Column expressions (no Python UDFs).

Missing values are SQL NULL throughout.  Comparisons with a missing side count as
"no", division by zero gives NULL, and unparsable dates give NULL.
"""

from __future__ import annotations

from itertools import chain
from math import inf

from pyspark.sql import Column
from pyspark.sql import functions as F

EARTH_RADIUS_KM = 6371.0
SECONDS_PER_DAY = 86400.0


def col(c: str | Column) -> Column:
    return F.col(c) if isinstance(c, str) else c


# -- time -------------------------------------------------------------------
def parse_timestamp(c) -> Column:
    """Text to a naive timestamp; anything unparsable becomes NULL."""
    return col(c).try_cast("timestamp_ntz")


def days_between(start, end) -> Column:
    """Fractional days from start to end."""
    return F.timestamp_diff("SECOND", col(start), col(end)) / F.lit(SECONDS_PER_DAY)


def whole_days_between(start, end) -> Column:
    """Days from start to end rounded towards the past (-0.5 days gives -1)."""
    return F.floor(days_between(start, end)).cast("int")


def month_label(c) -> Column:
    return F.date_format(col(c), "yyyy-MM")


def weekday_from_monday(c) -> Column:
    """Day of the week, Monday = 0."""
    return F.weekday(col(c)).cast("int")


# -- flags ------------------------------------------------------------------
def yes(condition: Column) -> Column:
    """A condition whose missing outcome counts as False."""
    return F.coalesce(condition, F.lit(False))


def flag(condition: Column) -> Column:
    """0/1 form of ``yes``."""
    return yes(condition).cast("int")


def after(left, right) -> Column:
    return flag(col(left) > col(right))


def any_null(*columns) -> Column:
    out = F.lit(False)
    for c in columns:
        out = out | col(c).isNull()
    return out


# -- numbers ----------------------------------------------------------------
def clip(c, low: float, high: float) -> Column:
    """Bound a value on both sides; NULL stays NULL."""
    x = col(c)
    return F.when(x < low, F.lit(float(low))).when(x > high, F.lit(float(high))).otherwise(x.cast("double"))


def ratio(numerator, denominator) -> Column:
    """Quotient, NULL when the denominator is zero or missing."""
    return F.try_divide(col(numerator).cast("double"), col(denominator).cast("double"))


def percent(share) -> Column:
    return col(share) * F.lit(100.0)


def haversine_km(lat1, lng1, lat2, lng2) -> Column:
    """Great-circle distance in km; NULL if any coordinate is missing."""
    phi1, phi2 = F.radians(col(lat1)), F.radians(col(lat2))
    half_dphi = F.radians(col(lat2) - col(lat1)) / 2
    half_dlng = F.radians(col(lng2) - col(lng1)) / 2
    h = F.pow(F.sin(half_dphi), 2) + F.cos(phi1) * F.cos(phi2) * F.pow(F.sin(half_dlng), 2)
    # Rounding noise may push h a hair above 1 for antipodal points.  (``least`` would
    # skip a NULL and turn a missing coordinate into the longest distance there is.)
    return F.lit(2 * EARTH_RADIUS_KM) * F.asin(F.sqrt(F.when(h > 1, F.lit(1.0)).otherwise(h)))


# -- bins -------------------------------------------------------------------
def right_closed_bin(c, edges: list[float]) -> Column:
    """0-based number of the bin (edge[i], edge[i+1]] holding the value, NULL outside."""
    x = col(c)
    out = F.when(x.isNull() | (x <= edges[0]), F.lit(None).cast("int"))
    for i, upper in enumerate(edges[1:]):
        if upper != inf:
            out = out.when(x <= upper, F.lit(i))
        else:
            out = out.otherwise(F.lit(i))
    return out


def bin_by_inner_edges(c, inner: list[float]) -> Column:
    """0-based bin = how many inner edges lie strictly below the value."""
    x = col(c)
    out = F.lit(0)
    for edge in inner:
        out = out + (x > F.lit(float(edge))).cast("int")
    return F.when(x.isNotNull(), out)


def pick_label(ordinal, labels: list[str]) -> Column:
    return F.element_at(F.array(*[F.lit(v) for v in labels]), (col(ordinal) + 1).cast("int"))


# -- fixed maps -------------------------------------------------------------
def map_values(c, mapping: dict, default=None) -> Column:
    """Look a value up in a small fixed dictionary."""
    pairs = F.create_map(*[F.lit(v) for v in chain.from_iterable(mapping.items())])
    found = F.try_element_at(pairs, col(c))
    return found if default is None else F.coalesce(found, F.lit(default))


def optional_column(columns: list[str], name: str, data_type: str) -> Column:
    """The column if the table has it, else a NULL of the given type."""
    return F.col(name) if name in columns else F.lit(None).cast(data_type)

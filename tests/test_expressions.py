"""Scalar rules on hand-made rows."""

import datetime as dt
import math

from pyspark.sql import functions as F

from latelens.functions import expressions as fx


def ts(text):
    return F.lit(text).cast("timestamp_ntz")


def value(spark, expression):
    return spark.range(1).select(expression.alias("v")).first()[0]


def test_bad_date_becomes_null(spark):
    df = spark.createDataFrame([("2017-10-02 10:56:33",), ("bad",), (None,)], "s string")
    got = [r[0] for r in df.select(fx.parse_timestamp("s")).collect()]
    assert got == [dt.datetime(2017, 10, 2, 10, 56, 33), None, None]


def test_fractional_and_floored_days_differ(spark):
    promise, delivery = ts("2018-01-10 00:00:00"), ts("2018-01-09 12:00:00")
    assert value(spark, fx.days_between(promise, delivery)) == -0.5
    assert value(spark, fx.whole_days_between(promise, delivery)) == -1
    assert value(spark, fx.whole_days_between(delivery, promise)) == 0


def test_missing_side_of_a_comparison_counts_as_no(spark):
    null = F.lit(None).cast("string")
    assert value(spark, fx.flag(null == F.lit("SP"))) == 0
    assert value(spark, fx.yes(F.lit(None).cast("int") <= 2)) is False
    assert value(spark, fx.after(ts("2018-01-01"), F.lit(None).cast("timestamp_ntz"))) == 0


def test_division_by_zero_is_null(spark):
    assert value(spark, fx.ratio(F.lit(3.0), F.lit(0.0))) is None
    assert value(spark, fx.ratio(F.lit(3), F.lit(2))) == 1.5


def test_weekday_starts_on_monday(spark):
    assert value(spark, fx.weekday_from_monday(ts("2024-01-01"))) == 0
    assert value(spark, fx.weekday_from_monday(ts("2024-01-07"))) == 6


def test_month_label(spark):
    assert value(spark, fx.month_label(ts("2017-11-30 23:59:59"))) == "2017-11"


def test_haversine(spark):
    quarter = value(spark, fx.haversine_km(F.lit(0.0), F.lit(0.0), F.lit(0.0), F.lit(90.0)))
    assert math.isclose(quarter, 6371 * math.pi / 2)
    half = value(spark, fx.haversine_km(F.lit(0.0), F.lit(0.0), F.lit(0.0), F.lit(180.0)))
    assert math.isclose(half, 6371 * math.pi)
    assert value(spark, fx.haversine_km(F.lit(None).cast("double"), F.lit(0.0), F.lit(0.0), F.lit(1.0))) is None


def test_right_closed_bins(spark):
    edges = [-1000.0, -10.0, 0.0, 5.0]
    got = [value(spark, fx.right_closed_bin(F.lit(x), edges)) for x in (-1000, -999, -10, -9, 0, 1, 5, 6)]
    assert got == [None, 0, 0, 1, 1, 2, 2, None]


def test_clip_keeps_null(spark):
    assert [value(spark, fx.clip(F.lit(x), 0, 1)) for x in (-1.0, 0.5, 2.0)] == [0.0, 0.5, 1.0]
    assert value(spark, fx.clip(F.lit(None).cast("double"), 0, 1)) is None


def test_map_values_with_default(spark):
    assert value(spark, fx.map_values(F.lit("a"), {"a": "x"}, "other")) == "x"
    assert value(spark, fx.map_values(F.lit("b"), {"a": "x"}, "other")) == "other"
    assert value(spark, fx.map_values(F.lit("b"), {"a": "x"})) is None


def test_optional_column(spark):
    df = spark.range(1)
    row = df.select(fx.optional_column(df.columns, "id", "int"), fx.optional_column(df.columns, "no", "int").alias("no")).first()
    assert (row["id"], row["no"]) == (0, None)

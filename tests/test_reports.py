"""Keyed operators and exploration reports on hand-made rows."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from latelens.operators.keyed import frequency, hash_sample, latest_per_key, null_profile, orphans
from latelens.plans import exploration as ex

DAY = dt.timedelta(days=1)
T0 = dt.datetime(2018, 1, 1)


def test_review_without_a_time_counts_as_latest(spark):
    rows = [(1, "o", T0, 5), (2, "o", None, 1), (3, "p", T0, 3), (4, "p", T0, 4)]
    df = spark.createDataFrame(rows, "review_id int, order_id string, at timestamp_ntz, score int")
    got = {r["order_id"]: (r["review_id"], r["score"]) for r in
           latest_per_key(df, "order_id", "at", "review_id", ["review_id", "score"]).collect()}
    assert got == {"o": (2, 1), "p": (4, 4)}


def test_orphans_and_frequency(spark):
    child = spark.createDataFrame([(1,), (1,), (2,), (9,), (9,)], "k int")
    parent = spark.createDataFrame([(1,), (1,), (2,)], "id int")
    assert orphans(child, parent, "k", "id").first()[0] == 2
    assert orphans(parent, child, "id", "k").first()[0] == 0
    assert {r["k"]: (r["n"], r["share"]) for r in frequency(child, "k").collect()}[9] == (2, 0.4)


def test_null_profile(spark):
    df = spark.createDataFrame([(1, None), (None, None)], "a int, b int")
    assert {r[0]: (r[1], r[2]) for r in null_profile(df, ["a", "b"]).collect()} == {"a": (1, 0.5), "b": (2, 1.0)}


def test_sample_is_repeatable_and_bounded(spark):
    df = spark.range(1000).select(F.col("id").alias("k"))
    a = {r[0] for r in hash_sample(df.repartition(7), "k", 50).collect()}
    b = {r[0] for r in hash_sample(df.repartition(3), "k", 50).collect()}
    assert a == b and len(a) == 50
    assert hash_sample(df, "k", 5000).count() == 1000
    assert a != {r[0] for r in hash_sample(df, "k", 50, seed=7).collect()}


@pytest.fixture(scope="module")
def labelled(spark):
    rows = [(f"o{i}", T0 + i * DAY, T0 + (i + 10) * DAY, T0 + (i + 10 + i % 3 - 1) * DAY, "SP" if i % 2 else None,
             None if i == 0 else 1 + i % 5) for i in range(12)]
    schema = ("order_id string, order_purchase_timestamp timestamp_ntz, order_estimated_delivery_date timestamp_ntz, "
              "order_delivered_customer_date timestamp_ntz, customer_state string, review_score int")
    return ex.label_base(spark.createDataFrame(rows, schema))


def test_missing_score_is_dropped_in_one_report_and_content_in_the_other(labelled):
    assert sum(r["n"] for r in ex.review_distribution(labelled).collect()) == 11
    row = ex.pain_by_state(labelled, 1).first()
    assert (row["customer_state"], row["n"]) == ("SP", 6)  # orders without a state are in no group


def test_gap_days_are_floored(labelled):
    assert {r[0] for r in labelled.select("gap_days").distinct().collect()} == {-1, 0, 1}
    assert labelled.where("late").count() == 4


def test_extremes_break_ties_by_key(spark):
    df = spark.createDataFrame([("b", 1.0), ("a", 1.0), ("c", 2.0)], "k string, v double")
    got = [(r["end"], r["k"]) for r in ex.extremes(df, "v", "k", 1).collect()]
    assert got == [("low", "a"), ("high", "c")]


def test_spearman_uses_pairwise_complete_rows_and_average_ranks(spark):
    import pandas as pd

    data = {"late": [0.0, 1, 0, 1, 1, None], "dist_km": [1.0, 5, None, 2, 2, 9], "freight_ratio": [3.0, None, 1, 1, 2, 2]}
    rows = [tuple(None if v is None else float(v) for v in row) for row in zip(*data.values())]
    df = spark.createDataFrame(rows, "late double, dist_km double, freight_ratio double")
    for r in ex.spearman_matrix(df, list(data)).collect():
        pair = pd.DataFrame(rows, columns=list(data)).astype(float)[[r["left_column"], r["right_column"]]].dropna()
        ranks = pair.rank()
        assert r["n"] == len(pair)
        assert r["rho"] == pytest.approx(ranks.iloc[:, 0].corr(ranks.iloc[:, 1]))


def test_month_report_and_its_complement(labelled):
    assert ex.late_by_month(labelled, 12).count() == 1
    assert [r[0] for r in ex.months_dropped(labelled, 13).collect()] == ["2018-01"]
    assert ex.season_summary(labelled, 1).first()["peak_month"] == "2018-01"


def test_product_chain_keeps_items_without_product(spark):
    items = spark.createDataFrame([("o", "p1"), ("o", "px")], "order_id string, product_id string")
    products = spark.createDataFrame([("p1", "brinquedos", 10.0)], "product_id string, product_category_name string, product_weight_g double")
    names = spark.createDataFrame([("brinquedos", "toys")], "product_category_name string, product_category_name_english string")
    got = {r["product_id"]: r["product_category_name_english"] for r in ex.product_attributes(items, products, names).collect()}
    assert got == {"p1": "toys", "px": None}

"""The feature build on hand-made items: null rules, history rules, split points."""

import datetime as dt
import random

import pytest
from pyspark.sql import functions as F

from latelens.operators import ordered
from latelens.operators.staging import stage
from latelens.plans import features as fe
from latelens.schemas import CONSOLIDATED, FEATURE_TABLE_COLUMNS

DAY = dt.timedelta(days=1)
START = dt.datetime(2018, 1, 1, 8)


def item(order, number=1, **changes):
    row = dict(
        order_id=order, order_item_id=number, customer_id=f"c{order}", customer_unique_id=f"u{order}", seller_id="s1",
        order_status="delivered", order_purchase_timestamp=START, order_approved_at=START,
        order_delivered_carrier_date=START + DAY, order_delivered_customer_date=START + 5 * DAY,
        order_estimated_delivery_date=START + 10 * DAY, price=10.0, freight_value=2.0,
        product_category_name_english="toys", product_weight_g=100.0, product_length_cm=2.0, product_height_cm=3.0,
        product_width_cm=4.0, customer_state="SP", customer_lat=-23.0, customer_lng=-46.0, seller_state="SP",
        seller_lat=-22.0, seller_lng=-45.0,
    )
    assert set(changes) <= set(row)
    row.update(changes)
    return tuple(row[f] for f in CONSOLIDATED.fieldNames())


def items(spark, *rows):
    return spark.createDataFrame(list(rows), CONSOLIDATED)


def one(df):
    rows = df.collect()
    assert len(rows) == 1
    return rows[0]


def test_only_labelable_deliveries_stay(spark):
    df = items(spark, item("a"), item("b", order_status="canceled"), item("c", order_delivered_customer_date=None))
    assert [r["order_id"] for r in fe.load_delivered(df).collect()] == ["a"]


def test_text_dates_are_parsed(spark):
    df = items(spark, item("a")).withColumn("order_delivered_customer_date", F.lit("not a date"))
    assert fe.load_delivered(df).count() == 0


def test_principal_attributes(spark):
    df = items(
        spark,
        item("a", 3, product_category_name_english="c", seller_id="s3"),
        item("a", 1, product_category_name_english=None, seller_id="s9"),
        item("a", 2, product_category_name_english="b", seller_id="s2"),
    )
    got = one(fe.order_rollup(df))
    assert (got["categoria_principal"], got["seller_id"], got["n_items"]) == ("b", "s9", 3)
    assert one(fe.order_rollup(df, principal="first_row"))["categoria_principal"] is None
    with pytest.raises(ValueError):
        fe.order_rollup(df, principal="any")


def test_all_null_totals(spark):
    df = items(spark, item("a", 1, product_weight_g=None), item("a", 2, product_weight_g=None))
    assert one(fe.order_rollup(df))["peso_total_g"] == 0.0
    assert one(fe.order_rollup(df, empty_sum="null"))["peso_total_g"] is None


@pytest.mark.parametrize("gap_hours, late, name", [
    (-73, 0, "muy_temprano"), (-72, 0, "a_tiempo"), (-12, 0, "a_tiempo"), (0, 0, "a_tiempo"), (1, 1, "tarde"),
])
def test_label_boundaries(spark, gap_hours, late, name):
    due = START + 10 * DAY
    df = items(spark, item("a", order_estimated_delivery_date=due,
                           order_delivered_customer_date=due + dt.timedelta(hours=gap_hours)))
    got = one(fe.add_targets(fe.order_rollup(df)))
    assert (got["entrega_tarde"], got["clase_entrega"]) == (late, name)
    assert got["dias_vs_promesa"] == pytest.approx(gap_hours / 24)


def test_missing_values_in_direct_features(spark):
    df = items(spark, item("a", customer_state=None, price=0.0, order_estimated_delivery_date=None, customer_lat=None))
    got = one(fe.labelled_orders(df))
    assert (got["mismo_estado"], got["entrega_tarde"]) == (0, 0)
    assert got["ratio_flete"] is None and got["dist_haversine_km"] is None and got["dias_prometidos"] is None


def test_gap_filling_goes_category_then_overall(spark):
    df = items(
        spark,
        item("a", product_weight_g=100.0), item("b", product_weight_g=300.0), item("c", product_weight_g=None),
        item("d", product_weight_g=900.0, product_category_name_english="pets"),
        item("e", product_weight_g=None, product_category_name_english=None),
        item("f", price=0.0),
    )
    orders = stage(fe.labelled_orders(df, empty_sum="null"), "gaps")
    got = {r["order_id"]: r for r in fe.impute_business(orders).collect()}
    assert got["c"]["peso_total_g"] == 100.0  # toys: 100, 300, 100
    assert got["e"]["peso_total_g"] == 200.0  # all: 100, 100, 300, 900
    assert got["f"]["ratio_flete"] == pytest.approx(0.2)
    assert set(orders.columns) == set(fe.impute_business(orders).columns)


def test_cut_positions_truncate():
    assert fe.cut_positions(7) == (4, 5)
    assert fe.cut_positions(96_470) == (67_529, 81_999)


def test_temporal_split(spark):
    rows = [(f"{i:03d}", START + (i // 3) * DAY) for i in range(40)]
    random.Random(1).shuffle(rows)
    df = stage(spark.createDataFrame(rows, "order_id string, order_purchase_timestamp timestamp_ntz"), "split_input")
    got = {r["order_id"]: r["split"] for r in fe.temporal_split(df).collect()}
    i_val, i_test = fe.cut_positions(40)
    want = {f"{i:03d}": "train" if i < i_val else "val" if i < i_test else "test" for i in range(40)}
    assert got == want


def test_tiny_split_is_all_train(spark):
    df = stage(spark.createDataFrame([("a", START)], "order_id string, order_purchase_timestamp timestamp_ntz"), "tiny")
    assert one(fe.temporal_split(df))["split"] == "test"  # int(0.7) = int(0.85) = 0: the only row is past both cuts


ORDERS = ("order_id string, seller_id string, order_purchase_timestamp timestamp_ntz, "
          "order_delivered_customer_date timestamp_ntz, entrega_tarde int")


def rate_frame(spark, value=0.25):
    return spark.range(1).select(F.lit(value).alias("global_rate"))


def rates(df, spark, **options):
    out = fe.add_seller_rate(df, rate_frame(spark), **options).collect()
    return {r["order_id"]: (r["prior_orders"], r["tasa_vendedor"], r["sin_historial_vendedor"]) for r in out}


def test_same_instant_orders(spark):
    rows = [(str(i), "s", START + min(i, 5) * DAY, START + 20 * DAY, i % 2) for i in range(7)]  # 5 and 6 tie
    df = stage(spark.createDataFrame(rows, ORDERS), "ties")
    by_row, by_time = rates(df, spark), rates(df, spark, history="strict_time")
    assert by_row["5"] == by_time["5"] == (5, 0.4, 0)
    assert by_row["6"] == (6, 0.5, 0)
    assert by_time["6"] == (5, 0.4, 0)


def test_order_without_seller_has_no_history(spark):
    rows = [(str(i), None, START + i * DAY, START + 20 * DAY, 1) for i in range(9)]
    got = rates(stage(spark.createDataFrame(rows, ORDERS), "no_seller"), spark)
    assert {v[1:] for v in got.values()} == {(0.25, 1)}


def test_unknown_outcomes_can_be_left_out(spark):
    rows = [(str(i), "s", START + i * DAY, START + (100 if i == 0 else i) * DAY + dt.timedelta(hours=1), int(i == 0)) for i in range(7)]
    df = stage(spark.createDataFrame(rows, ORDERS), "unknown")
    assert rates(df, spark)["6"] == (6, pytest.approx(1 / 6), 0)
    assert rates(df, spark, history="known_outcome")["6"] == (5, 0.0, 0)


@pytest.mark.parametrize("history", ["row_order", "strict_time", "known_outcome"])
def test_rate_ignores_own_and_later_labels(spark, history):
    """Flipping labels from some order on never changes the rates up to it."""
    rng = random.Random(5)
    rows = [(f"{i:03d}", f"s{rng.randrange(3)}", START + rng.randrange(60) * DAY, START + (60 + rng.randrange(9)) * DAY,
             rng.randrange(2)) for i in range(120)]
    rows.sort(key=lambda r: (r[2], r[0]))
    cut = 80
    flipped = rows[:cut] + [(*r[:4], 1 - r[4]) for r in rows[cut:]]
    a = rates(stage(spark.createDataFrame(rows, ORDERS), "a"), spark, history=history)
    b = rates(stage(spark.createDataFrame(flipped, ORDERS), "b"), spark, history=history)
    for r in rows[:cut + 1]:
        assert a[r[0]] == b[r[0]]


def test_known_outcomes_against_a_plain_count(spark, monkeypatch):
    """A hot seller, ties of both clocks, missing deliveries, deliveries before the purchase; only slim rows are staged."""
    rng = random.Random(9)
    rows = [(f"{i:03d}", rng.choice(["hot", "hot", "b", None]), START + rng.randrange(40) * DAY,
             rng.choice([None, START + rng.randrange(60) * DAY]), rng.randrange(2)) for i in range(300)]
    df = stage(spark.createDataFrame(rows, ORDERS), "two_clocks").withColumn("wide", F.lit("x" * 50))
    staged = []
    monkeypatch.setattr(ordered, "stage", lambda frame, label: staged.append(frame.columns) or stage(frame, label))
    got = {r["order_id"]: (r["prior_orders"], r["prior_late"]) for r in fe.prior_counts(df, "known_outcome").collect()}
    for order, seller, bought, _, _ in rows:
        known = [r[4] for r in rows if r[1] == seller and r[3] is not None and max(r[3], r[2]) < bought]
        assert got[order] == (len(known), sum(known))
    assert staged and all("wide" not in columns for columns in staged)


def test_audit_finds_a_leak(spark):
    rows = [(f"{i:02d}", "s", START + i * DAY, START + 50 * DAY, i % 2) for i in range(12)]
    df = stage(spark.createDataFrame(rows, ORDERS), "audit")
    good = fe.add_seller_rate(df, rate_frame(spark))
    fe.assert_no_leak(fe.audit_seller_rate(good))
    bad = good.withColumn("tasa_vendedor", F.col("tasa_vendedor") + 0.01)
    with pytest.raises(AssertionError):
        fe.assert_no_leak(fe.audit_seller_rate(bad))


def test_feature_table_columns(spark):
    rows = [item(f"{i:02d}", order_purchase_timestamp=START + i * DAY, order_delivered_customer_date=START + (i + 5) * DAY,
                 order_estimated_delivery_date=START + (i + 4 + i % 3) * DAY) for i in range(20)]
    build = fe.build_feature_table(items(spark, *rows))
    assert build.table.columns == FEATURE_TABLE_COLUMNS and len(FEATURE_TABLE_COLUMNS) == 23
    assert build.table.count() == 20
    fe.assert_no_leak(fe.audit_seller_rate(build.full))

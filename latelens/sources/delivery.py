"""Delivery tables derived from TPC-H-like star-schema tables.

The item view is the consolidated input of the feature build: one row per order item
with its order, product, seller and buyer attributes.  Purchase times, promises,
deliveries, gaps and missing values come from integer formulas of the keys.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType, LongType, StructField, StructType, TimestampNTZType

from latelens.operators.ordered import number_rows
from latelens.operators.staging import stage, unstage
from latelens.schemas import RAW_TABLES

#: Up to so many rows of a key and a number, about 50 bytes each in memory, are copied to every executor.
COPIED_ROWS = 1_000_000
LAT_LOW, LAT_HIGH, LNG_LOW, LNG_HIGH = -34.0, 6.0, -74.0, -34.0


def star(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def _in_days(ts, days):
    return ts + F.make_dt_interval(days=days.cast("int"))


def _promised(purchase):
    return _in_days(F.to_date(purchase).cast("timestamp_ntz"), F.col("promised_days"))


def _carried(oid, purchase):
    return F.when(oid % 307 != 0, _in_days(purchase, 1 + oid % 6))


def copied(df: DataFrame) -> DataFrame:
    """A table of a key and a number, copied to every executor as long as it is small."""
    return F.broadcast(df) if df.count() <= COPIED_ROWS else df


def bought_orders(spark: SparkSession, folder: str) -> DataFrame:
    """One row per order, with or without items: buyer, the buyer's nation, date."""
    buyers = star(spark, folder, "customer").select(F.col("c_custkey").alias("customer_id"), "c_nationkey")
    orders = star(spark, folder, "orders")
    return orders.select(F.col("o_orderkey").alias("order_id"), F.col("o_custkey").alias("customer_id"), "o_orderdate").join(
        buyers, "customer_id")


def placed_orders(spark: SparkSession, folder: str, bought: DataFrame | None = None) -> DataFrame:
    """Rows of ``bought_orders``, whatever else is in them, with status, purchase time, promise, state."""
    buyer_nation = star(spark, folder, "nation").select(
        F.col("n_nationkey").alias("c_nationkey"), F.col("n_name").alias("customer_state"),
        F.col("n_regionkey").alias("c_region"),
    )
    oid = F.col("order_id")
    return (
        (bought_orders(spark, folder) if bought is None else bought)
        .join(buyer_nation, "c_nationkey")
        .withColumn("order_status", F.when(oid % 33 == 0, "canceled").otherwise("delivered"))
        .withColumn(
            "purchase_ts",
            F.col("o_orderdate") + F.make_dt_interval(secs=((oid * 7919) % 86400).cast("decimal(18,6)")),
        )
        .withColumn("promised_days", (13 + (oid * 13) % 17).cast("int"))
    )


def item_view(spark: SparkSession, folder: str, staged: bool = False) -> DataFrame:
    """One row per order item.

    With ``staged`` the steps are cut: rows travel narrow, numbered by order, given their sizes by product, and back to
    their orders, whose columns come last; the shuffle files of a step and the rows before it go before the next begins.
    """
    cut = stage if staged else lambda df, label: df
    line = star(spark, folder, "lineitem").select(
        F.col("l_orderkey").alias("order_id"), "l_linenumber", F.col("l_partkey").alias("product_id"),
        F.col("l_suppkey").alias("seller_id"), "l_shipdate", "l_quantity", "l_extendedprice",
        "l_discount", "l_tax",
    )
    numbered = number_rows(
        line,
        "order_id",
        ["l_linenumber", "product_id", "seller_id", "l_shipdate", "l_quantity", "l_extendedprice",
         "l_discount", "l_tax"],
        "order_item_id",
        first_value={"first_seller": "seller_id"},
    ).select("order_id", "order_item_id", "product_id", "seller_id", "first_seller", "l_extendedprice", "l_tax")

    numbered = cut(numbered, "numbered")
    parts = star(spark, folder, "part").select(F.col("p_partkey").alias("product_id"), "p_type", "p_size")
    sized = cut(numbered.join(parts, "product_id"), "sized")
    if staged:
        unstage(numbered)
    bought = cut(bought_orders(spark, folder), "bought")

    # Every dimension is joined as the table it is, so that its own size decides between
    # broadcast and shuffle; joins of joins would only have a guessed size.
    nation = star(spark, folder, "nation")
    supplier = star(spark, folder, "supplier")
    sellers = copied(supplier.select(F.col("s_suppkey").alias("seller_id"), "s_nationkey"))
    first_sellers = copied(supplier.select(F.col("s_suppkey").alias("first_seller"), F.col("s_nationkey").alias("first_nation")))
    seller_nation = nation.select(F.col("n_nationkey").alias("s_nationkey"), F.col("n_name").alias("seller_state"))
    first_nation = nation.select(F.col("n_nationkey").alias("first_nation"), F.col("n_regionkey").alias("first_region"))

    oid = F.col("order_id")
    actual_days = (
        1 + (oid * 7 + F.col("customer_id") * 3) % 12 + F.col("first_seller") % 5
        + F.when(F.col("c_region") != F.col("first_region"), 3).otherwise(0)
        + F.when(oid % 19 == 0, 6).otherwise(0)
    ).cast("int")
    undelivered = (F.col("order_status") != "delivered") | (oid % 401 == 0)
    purchase = F.col("purchase_ts")
    seller_unplaced = F.col("seller_id") % 23 == 5

    return (
        # Merged, so that the items of an order lie side by side.
        placed_orders(spark, folder, sized.join(bought.hint("merge"), "order_id"))
        .join(first_sellers, "first_seller")
        .join(first_nation, "first_nation")
        .join(sellers, "seller_id")
        .join(seller_nation, "s_nationkey")
        .select(
            "order_id", "order_item_id", "customer_id", "seller_id", "product_id", "order_status", "purchase_ts",
            _promised(purchase).alias("estimated_ts"),
            F.when(
                ~undelivered,
                _in_days(purchase, actual_days) + F.make_dt_interval(hours=((oid * 131) % 24).cast("int")),
            ).alias("delivered_ts"),
            _carried(oid, purchase).alias("carrier_ts"),
            _in_days(purchase, F.lit(4)).alias("shipping_limit_ts"),
            F.when(oid % 211 == 0, F.lit(0.0)).otherwise(F.col("l_extendedprice")).alias("price"),
            (F.col("l_extendedprice") * F.col("l_tax")).alias("freight_value"),
            F.when(F.col("product_id") % 97 != 0, F.col("p_type")).alias("product_category"),
            F.when(F.col("product_id") % 89 != 0, F.col("p_size") * 100.0).alias("product_weight_g"),
            F.when(F.col("product_id") % 83 != 0, F.col("p_size") * 1.0).alias("product_length_cm"),
            F.lit(5.0).alias("product_height_cm"),
            F.lit(10.0).alias("product_width_cm"),
            "customer_state",
            "seller_state",
            F.when(F.col("c_nationkey") != 11, -34.0 + ((F.col("c_nationkey") * 37) % 400) * 0.1).alias("customer_lat"),
            F.when(F.col("c_nationkey") != 11, -74.0 + ((F.col("c_nationkey") * 53) % 400) * 0.1).alias("customer_lng"),
            F.when(~seller_unplaced, -34.0 + ((F.col("s_nationkey") * 37) % 400) * 0.1).alias("seller_lat"),
            F.when(~seller_unplaced, -74.0 + ((F.col("s_nationkey") * 53) % 400) * 0.1).alias("seller_lng"),
        )
    )


def consolidated(items: DataFrame) -> DataFrame:
    """The item view under the column names of the consolidated input."""
    return items.withColumnsRenamed({
        "purchase_ts": "order_purchase_timestamp",
        "estimated_ts": "order_estimated_delivery_date",
        "delivered_ts": "order_delivered_customer_date",
        "carrier_ts": "order_delivered_carrier_date",
        "shipping_limit_ts": "shipping_limit_date",
        "product_category": "product_category_name_english",
    })


def order_rows(spark: SparkSession, folder: str, items: DataFrame) -> DataFrame:
    """The raw orders table: order-level columns, one row per order; one without items was never delivered."""
    oid, purchase = F.col("order_id"), F.col("purchase_ts")
    first = items.where("order_item_id = 1")
    bare = placed_orders(spark, folder).join(first.select("order_id"), "order_id", "left_anti").select(
        "order_id", "customer_id", "order_status", "purchase_ts", _carried(oid, purchase).alias("carrier_ts"),
        F.lit(None).cast("timestamp_ntz").alias("delivered_ts"), _promised(purchase).alias("estimated_ts"),
    )
    every = first.select(*bare.columns).unionByName(bare)
    return every.select(
        "order_id", "customer_id", "order_status",
        purchase.alias("order_purchase_timestamp"),
        F.when(oid % 251 != 0, purchase + F.make_dt_interval(hours=(oid % 48).cast("int"))).alias("order_approved_at"),
        F.col("carrier_ts").alias("order_delivered_carrier_date"),
        F.col("delivered_ts").alias("order_delivered_customer_date"),
        F.col("estimated_ts").alias("order_estimated_delivery_date"),
    )


def review_rows(items: DataFrame) -> DataFrame:
    first = items.where("order_item_id = 1")
    oid = F.col("order_id")
    regular = first.where(oid % 40 != 0).select(
        (oid * 10).alias("review_id"),
        "order_id",
        F.when(F.col("delivered_ts") > F.col("estimated_ts"), 1 + oid % 3).otherwise(2 + oid % 4).alias("review_score"),
        F.when(oid % 331 != 0, _in_days(F.col("delivered_ts"), 1 + oid % 5)).alias("review_answer_timestamp"),
    )
    second = first.where(oid % 50 == 1).select(
        (oid * 10 + 1).alias("review_id"),
        "order_id",
        F.lit(5).cast("bigint").alias("review_score"),
        _in_days(F.col("delivered_ts"), F.lit(9)).alias("review_answer_timestamp"),
    )
    return regular.unionByName(second)


def raw_tables(spark: SparkSession, folder: str, items: DataFrame) -> dict[str, DataFrame]:
    """The nine raw tables: by the key, some products and translations are missing and some payments have no order."""
    nation = star(spark, folder, "nation").select(F.col("n_nationkey").alias("__n"), F.col("n_name").alias("__state"))
    oid, part = F.col("order_id"), F.col("p_partkey")

    def placed(table, key, nationkey, who):
        rows = star(spark, folder, table).join(nation, F.col(nationkey) == F.col("__n"))
        return rows.select(F.col(key).alias(f"{who}_id"), (F.col(key) % 53).alias(f"{who}_zip_code_prefix"),
                           F.col("__state").alias(f"{who}_state"))

    parts = star(spark, folder, "part").where(part % 61 != 0)
    tables = {
        "orders": order_rows(spark, folder, items),
        "items": items.withColumnRenamed("shipping_limit_ts", "shipping_limit_date"),
        "customers": placed("customer", "c_custkey", "c_nationkey", "customer"),
        "sellers": placed("supplier", "s_suppkey", "s_nationkey", "seller"),
        "products": parts.select(
            part.alias("product_id"), F.when(part % 97 != 0, F.lower("p_type")).alias("product_category_name"),
            F.when(part % 89 != 0, F.col("p_size") * 100.0).alias("product_weight_g"),
            F.when(part % 83 != 0, F.col("p_size") * 1.0).alias("product_length_cm"),
            F.lit(5.0).alias("product_height_cm"), F.lit(10.0).alias("product_width_cm")),
        "reviews": review_rows(items).withColumn(
            "review_comment_message", F.when(oid % 3 == 0, F.concat(F.lit('it said "'), F.col("review_score"), F.lit('",\nno more')))),
        "geolocation": geolocation_rows(spark, folder).select(
            F.col("zip_prefix").alias("geolocation_zip_code_prefix"), F.col("lat").alias("geolocation_lat"),
            F.col("lng").alias("geolocation_lng")),
        "cat_trans": star(spark, folder, "part").where(F.length("p_type") != 5).select(
            F.lower("p_type").alias("product_category_name"), F.col("p_type").alias("product_category_name_english")).distinct(),
        "payments": star(spark, folder, "orders").select(F.col("o_orderkey").alias("order_id"), "o_totalprice").select(
            F.when(oid % 500 == 0, -oid - 1).otherwise(oid).alias("order_id"),
            F.when(oid % 4 == 0, "boleto").otherwise("credit_card").alias("payment_type"),
            F.col("o_totalprice").alias("payment_value")),
    }
    return {name: df.select(*[F.col(f.name).cast(f.dataType).alias(f.name) for f in RAW_TABLES[name].fields])
            for name, df in tables.items()}


ORDER_TEXT = StructType([
    StructField("order_id", LongType()), StructField("customer_id", LongType()),
    StructField("purchase_ts", TimestampNTZType()), StructField("promised_days", IntegerType()),
])


def write_order_text(spark: SparkSession, folder: str, path: str) -> None:
    """The orders as CSV text, as a careless source would deliver them.

    By the key, some rows lack the last field or have one too many, some have a text for the
    buyer or no buyer, some a date that is none.
    """
    oid = F.col("order_id")
    fields = [
        oid.cast("string"),
        F.when(oid % 107 == 0, "n/a").when(oid % 113 == 0, "").otherwise(F.col("customer_id").cast("string")),
        F.when(oid % 109 == 0, "never").otherwise(F.date_format("purchase_ts", "yyyy-MM-dd HH:mm:ss")),
    ]
    days = F.col("promised_days").cast("string")
    last = F.when(oid % 101 == 0, "").when(oid % 103 == 0, F.concat(F.lit(","), days, F.lit(",x"))).otherwise(
        F.concat(F.lit(","), days))
    lines = placed_orders(spark, folder).select(
        F.concat(F.concat_ws(",", *fields), last).alias(",".join(ORDER_TEXT.fieldNames())))
    # One column, named like the header line and with a separator that no line has: lines are written as they are.
    lines.write.option("header", True).option("sep", "\x01").option("quote", "\0").csv(path)


def geolocation_rows(spark: SparkSession, folder: str) -> DataFrame:
    key = F.col("c_custkey")
    return star(spark, folder, "customer").select(
        (key % 50).alias("zip_prefix"),
        (-40.0 + ((key * 29) % 500) * 0.1).alias("lat"),
        (-80.0 + ((key * 31) % 500) * 0.1).alias("lng"),
    )


def state_regions(spark: SparkSession, folder: str) -> DataFrame:
    """State to region, from the nation and region tables."""
    return star(spark, folder, "nation").join(
        star(spark, folder, "region"), F.col("n_regionkey") == F.col("r_regionkey")
    ).select(F.col("n_name").alias("state"), F.col("r_name").alias("region"))

"""Reports that compare the raw item table with the feature table."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from latelens.functions.expressions import any_null, percent, ratio
from latelens.operators.keyed import first_non_null, frequency
from latelens.operators.quantiles import medians_of, with_quantile_bin
from latelens.schemas import CLASS_ORDER

def late_rate() -> Column:
    return F.avg(F.col("entrega_tarde").cast("double"))


def item_status_counts(items: DataFrame) -> DataFrame:
    return frequency(items, "order_status")


def grain_before_after(items: DataFrame, features: DataFrame) -> DataFrame:
    """One row: item rows, distinct orders and rows of the feature table."""
    return items.agg(
        F.count(F.lit(1)).alias("item_rows"), F.count_distinct("order_id").alias("distinct_orders")
    ).crossJoin(features.agg(F.count(F.lit(1)).alias("feature_rows")))


def label_distribution(features: DataFrame) -> DataFrame:
    """Binary and three-class label shares in report order; absent classes count 0."""
    total = features.agg(F.count(F.lit(1)).alias("__all"))
    counts = features.groupBy("entrega_tarde", "clase_entrega").agg(F.count(F.lit(1)).alias("c"))
    binary = counts.groupBy(F.when(F.col("entrega_tarde") == 1, "late").otherwise("on_time").alias("class")).agg(F.sum("c").alias("c"))
    multi = counts.groupBy(F.col("clase_entrega").alias("class")).agg(F.sum("c").alias("c"))
    listed = [("entrega_tarde", 0, "on_time"), ("entrega_tarde", 1, "late")] + [
        ("clase_entrega", i, c) for i, c in enumerate(CLASS_ORDER)
    ]
    classes = features.sparkSession.range(1).select(F.inline(F.array(*[
        F.struct(F.lit(label).alias("label"), F.lit(i).alias("position"), F.lit(c).alias("class")) for label, i, c in listed
    ])))
    both = binary.withColumn("label", F.lit("entrega_tarde")).unionByName(multi.withColumn("label", F.lit("clase_entrega")))
    return classes.join(both, ["label", "class"], "left").crossJoin(F.broadcast(total)).select(
        "label", "position", "class", F.coalesce("c", F.lit(0)).alias("n"),
        percent(ratio(F.coalesce("c", F.lit(0)), F.col("__all"))).alias("pct"),
    )


def label_medians(features: DataFrame) -> DataFrame:
    """One row: mean and median of the two day labels."""
    out = features.agg(
        F.avg("dias_vs_promesa").alias("dias_vs_promesa_mean"), F.avg("dias_entrega_real").alias("dias_entrega_real_mean")
    )
    days = ["dias_vs_promesa", "dias_entrega_real"]
    return out.crossJoin(F.broadcast(medians_of(features, days, [f"{c}_median" for c in days])))  # one row each


def regional_gradient(features: DataFrame, more_than: int = 200) -> DataFrame:
    """Late rate per buyer state with more than the given orders, beside the overall rate."""
    overall = features.agg(late_rate().alias("overall_rate"))
    return (
        features.where("customer_state is not null").groupBy("customer_state")
        .agg(F.count("entrega_tarde").alias("n"), late_rate().alias("late_rate"))
        .where(F.col("n") > more_than)
        .crossJoin(F.broadcast(overall))  # one row
        .withColumn("above_overall", F.col("late_rate") > F.col("overall_rate"))
    )


def state_contrast(features: DataFrame, high: str, low: str) -> DataFrame:
    """One row: late rates of two states and their ratio."""
    of = lambda s: F.avg(F.when(F.col("customer_state") == s, F.col("entrega_tarde").cast("double")))
    return features.agg(of(high).alias("high_rate"), of(low).alias("low_rate")).withColumn(
        "times", ratio("high_rate", "low_rate")
    )


def rate_deciles(features: DataFrame, bins: int = 10) -> DataFrame:
    """Historic seller rate against observed late rate per equal-count group."""
    binned = with_quantile_bin(features, "tasa_vendedor", bins, "__bin")
    return binned.groupBy((F.col("__bin") + 1).alias("decile")).agg(
        F.count(F.lit(1)).alias("n"),
        percent(F.avg("tasa_vendedor")).alias("historic_pct"),
        percent(late_rate()).alias("observed_pct"),
    )


def null_before_after(items: DataFrame, features: DataFrame) -> DataFrame:
    """Missing share before (first value per delivered order) and after the build."""
    sources = ["product_weight_g", "product_category_name_english", "customer_lat", "seller_lat"]
    first = items.where("order_status = 'delivered'").groupBy("order_id").agg(
        *[first_non_null(c, "order_item_id").alias(c) for c in sources]
    )
    missing = lambda c: percent(F.avg(c.cast("double")))
    null = lambda c: F.col(c).isNull()
    before = first.agg(
        missing(null("product_weight_g")).alias("b_weight"),
        missing(null("product_category_name_english")).alias("b_category"),
        missing(any_null("customer_lat", "seller_lat")).alias("b_distance"),
        missing(null("customer_lat")).alias("b_buyer"),
        missing(null("seller_lat")).alias("b_seller"),
    )
    after = features.agg(
        missing(null("peso_total_g")).alias("a_weight"),
        missing(null("categoria_principal")).alias("a_category"),
        missing(null("dist_haversine_km")).alias("a_distance"),
    )
    rows = [("weight", "b_weight", "a_weight"), ("category", "b_category", "a_category"),
            ("distance", "b_distance", "a_distance"), ("buyer_position", "b_buyer", None),
            ("seller_position", "b_seller", None)]
    cells = F.array(*[
        F.struct(F.lit(n).alias("field"), F.col(b).alias("before_pct"),
                 (F.col(a) if a else F.lit(None).cast("double")).alias("after_pct"))
        for n, b, a in rows
    ])
    return before.crossJoin(after).select(F.inline(cells))


def monthly_regime(features: DataFrame) -> DataFrame:
    """Orders and late rate per purchase month."""
    month = F.trunc(F.to_date("order_purchase_timestamp"), "month")
    return features.groupBy(month.alias("month")).agg(F.count(F.lit(1)).alias("n"), percent(late_rate()).alias("late_pct"))


def split_spans(features: DataFrame) -> DataFrame:
    """Size, late rate and time span of each split."""
    return features.groupBy("split").agg(
        F.count(F.lit(1)).alias("n"),
        late_rate().alias("late_rate"),
        F.min("order_purchase_timestamp").alias("first_purchase"),
        F.max("order_purchase_timestamp").alias("last_purchase"),
    )

"""Exploration reports over the raw delivery tables.

Input names: ``orders`` (one row per order), ``items`` (one row per order item),
``reviews``, ``customers``, ``geo``.  ``base`` is the delivered universe of
``order_base``; ``labelled`` is ``label_base(base)``, the frame most reports read.
Stage it once and run the reports from it.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from latelens.functions.expressions import (
    any_null,
    haversine_km,
    month_label,
    percent,
    ratio,
    right_closed_bin,
    weekday_from_monday,
    whole_days_between,
    yes,
)
from latelens.operators.keyed import first_per_key, frequency, latest_per_key, null_profile, orphans
from latelens.operators.ordered import rolling_means, running_totals
from latelens.operators.quantiles import exact_quantiles, median_by, medians_of, with_quantile_bin
from latelens.operators.staging import stage

PURCHASE, CARRIER, DELIVERY, PROMISE = (
    "order_purchase_timestamp",
    "order_delivered_carrier_date",
    "order_delivered_customer_date",
    "order_estimated_delivery_date",
)
LIFECYCLE = [PURCHASE, "order_approved_at", CARRIER, DELIVERY, PROMISE]

# Day-gap bins against the promise (right-closed).
GAP_EDGES = [-1000.0, -10.0, -5.0, -1.0, 0.0, 5.0, 10.0, 1000.0]


def late_share() -> Column:
    return F.avg(F.col("late").cast("double"))


# -- data quality -------------------------------------------------------------
def lifecycle_nulls(orders: DataFrame) -> DataFrame:
    """Missing timestamps along the life of an order; a column the table lacks is missing everywhere."""
    absent = [c for c in LIFECYCLE if c not in orders.columns]
    return null_profile(orders.select("*", *[F.lit(None).cast("timestamp_ntz").alias(c) for c in absent]), LIFECYCLE)


def status_counts(orders: DataFrame) -> DataFrame:
    return frequency(orders, "order_status")


def granularity(reviews: DataFrame, items: DataFrame) -> DataFrame:
    """One row: orders with several reviews, reviews on several orders, sellers per order."""
    def groups(df, key, counted, *conditions):
        per = df.groupBy(key).agg(F.count_distinct(counted).alias("d"))
        return per.agg(*[F.count_if(c).alias(name) for name, c in conditions])

    several = F.col("d") >= 2
    return (
        groups(reviews, "order_id", "review_id", ("orders_with_several_reviews", several))
        .crossJoin(groups(reviews, "review_id", "order_id", ("reviews_on_several_orders", several)))
        .crossJoin(
            groups(items, "order_id", "seller_id",
                   ("single_seller_orders", F.col("d") == 1), ("multi_seller_orders", several))
        )
    )


def integrity(checks: dict[str, tuple[DataFrame, DataFrame, str, str]]) -> DataFrame:
    """Orphan rows per named check (child, parent, child key, parent key)."""
    out = None
    for name, (child, parent, key, parent_key) in checks.items():
        row = orphans(child, parent, key, parent_key).select(F.lit(name).alias("check_name"), "orphans")
        out = row if out is None else out.unionByName(row)
    return out


# -- the delivered universe ---------------------------------------------------
def order_base(orders: DataFrame, reviews: DataFrame, customers: DataFrame) -> DataFrame:
    """Delivered orders with their most recent review and their buyer."""
    review_columns = [c for c in ("review_id", "review_score", "review_comment_message") if c in reviews.columns]
    latest = latest_per_key(reviews, "order_id", "review_answer_timestamp", "review_id", review_columns)
    delivered = orders.where("order_status = 'delivered'")
    return delivered.join(latest, "order_id", "left").join(customers, "customer_id", "left")


def label_base(base: DataFrame) -> DataFrame:
    """Orders with both dates: late or not, whole days against the promise."""
    return base.where(F.col(DELIVERY).isNotNull() & F.col(PROMISE).isNotNull()).withColumns({
        "late": F.col(DELIVERY) > F.col(PROMISE),
        "gap_days": whole_days_between(PROMISE, DELIVERY),
    })


def order_values(items: DataFrame) -> DataFrame:
    return items.groupBy("order_id").agg(
        F.coalesce(F.sum("price"), F.lit(0.0)).alias("gmv"),
        F.coalesce(F.sum("freight_value"), F.lit(0.0)).alias("freight"),
    )


# -- orders that never arrived ------------------------------------------------
def undelivered_summary(orders: DataFrame, items: DataFrame) -> DataFrame:
    """One row: undelivered orders, their share, the value that was not realised."""
    counts = orders.agg(
        F.count(F.lit(1)).alias("orders"),
        F.count_if(F.col("order_status") != "delivered").alias("undelivered"),
    )
    missing = orders.where(F.col("order_status") != "delivered").select("order_id").distinct()
    value = items.groupBy("order_id").agg(F.sum("price").alias("gmv"))
    total = value.agg(F.sum("gmv").alias("gmv_total"))
    lost = value.join(missing, "order_id", "left_semi").agg(F.coalesce(F.sum("gmv"), F.lit(0.0)).alias("gmv_undelivered"))
    return counts.crossJoin(total).crossJoin(lost).select(
        "orders", "undelivered", percent(ratio("undelivered", "orders")).alias("undelivered_pct"),
        "gmv_total", "gmv_undelivered", percent(ratio("gmv_undelivered", "gmv_total")).alias("gmv_undelivered_pct"),
    )


def undelivered_by_state(orders: DataFrame, customers: DataFrame, min_orders: int = 500, top: int | None = None) -> DataFrame:
    """States by share of undelivered orders; states without any are left out."""
    placed = orders.join(customers.select("customer_id", "customer_state"), "customer_id", "left")
    return _undelivered_rate(placed.where("customer_state is not null"), "customer_state", min_orders, top)


def undelivered_by_seller(orders: DataFrame, items: DataFrame, min_items: int = 50, top: int | None = None) -> DataFrame:
    """Sellers by share of item rows in undelivered orders."""
    status = orders.select("order_id", "order_status")
    rows = items.select("order_id", "seller_id").join(status, "order_id", "left")
    return _undelivered_rate(rows.where("seller_id is not null"), "seller_id", min_items, top)


def _undelivered_rate(rows: DataFrame, key: str, minimum: int, top: int | None) -> DataFrame:
    out = (
        rows.groupBy(key)
        .agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("order_status") != "delivered").alias("undelivered"))
        .where((F.col("undelivered") > 0) & (F.col("n") >= minimum))
        .select(key, "n", "undelivered", percent(ratio("undelivered", "n")).alias("undelivered_pct"))
    )
    return out if top is None else out.orderBy(F.desc("undelivered_pct"), key).limit(top)


# -- lateness and satisfaction ------------------------------------------------
def lateness_summary(labelled: DataFrame) -> DataFrame:
    """One row: orders, late share, and the spread of days against the promise."""
    plain = labelled.agg(
        F.count(F.lit(1)).alias("n"),
        percent(late_share()).alias("late_pct"),
        F.avg("gap_days").alias("gap_mean"),
    )
    spread = exact_quantiles(labelled, "gap_days", [0.1, 0.5, 0.9], names=["gap_p10", "gap_median", "gap_p90"])
    return plain.crossJoin(spread.drop("n"))


def _reviewed(labelled: DataFrame) -> DataFrame:
    return labelled.where("review_score is not null").withColumn("unhappy", F.col("review_score") <= 2)


def review_distribution(labelled: DataFrame) -> DataFrame:
    return frequency(_reviewed(labelled), "review_score")


def dissatisfaction_by_lateness(labelled: DataFrame) -> DataFrame:
    """One row: share of scores of 2 or less, on time against late, and their ratio."""
    share = lambda late: F.avg(F.when(F.col("late") == late, F.col("unhappy").cast("double")))
    both = _reviewed(labelled).agg(
        percent(share(False)).alias("unhappy_on_time_pct"), percent(share(True)).alias("unhappy_late_pct")
    )
    return both.withColumn("times_more", ratio("unhappy_late_pct", "unhappy_on_time_pct"))


def dissatisfaction_by_gap(labelled: DataFrame) -> DataFrame:
    """Share of low scores per day-gap bin; only bins that occur."""
    return (
        _reviewed(labelled)
        .withColumn("gap_bin", right_closed_bin("gap_days", GAP_EDGES))
        .where("gap_bin is not null")
        .groupBy("gap_bin")
        .agg(F.count(F.lit(1)).alias("n"), percent(F.avg(F.col("unhappy").cast("double"))).alias("unhappy_pct"))
    )


def gmv_exposure(labelled: DataFrame, orders: DataFrame, items: DataFrame) -> DataFrame:
    """One row: order value delivered, delivered late, never delivered; mean order values."""
    value = order_values(items).select("order_id", "gmv")
    late = F.col("late")
    arrived = labelled.join(value, "order_id", "left").agg(
        F.count(F.lit(1)).alias("n"),
        F.count_if(late).alias("n_late"),
        F.sum("gmv").alias("gmv_base"),
        F.coalesce(F.sum(F.when(late, F.col("gmv"))), F.lit(0.0)).alias("gmv_late"),
        F.avg(F.when(late, F.col("gmv"))).alias("aov_late"),
        F.avg(F.when(~late, F.col("gmv"))).alias("aov_on_time"),
    )
    missing = undelivered_summary(orders, items).select("gmv_undelivered")
    return arrived.crossJoin(missing).withColumns({
        "gmv_late_pct": percent(ratio("gmv_late", "gmv_base")),
        "gmv_at_risk": F.col("gmv_late") + F.col("gmv_undelivered"),
    })


# -- the promise itself ---------------------------------------------------------
def with_cushion(labelled: DataFrame) -> DataFrame:
    """Whole days delivered, whole days promised, and what was left between them."""
    days = labelled.withColumns({
        "real_days": whole_days_between(PURCHASE, DELIVERY),
        "promised_days": whole_days_between(PURCHASE, PROMISE),
    })
    return days.withColumn("cushion", F.col("promised_days") - F.col("real_days"))


def promise_cushion(cushioned: DataFrame) -> DataFrame:
    """One row: medians and means of real, promised and spare days; share that fell short."""
    names = ["real_days", "promised_days", "cushion"]
    out = cushioned.agg(
        *[F.avg(c).alias(f"{c}_mean") for c in names],
        percent(F.avg((F.col("cushion") < 0).cast("double"))).alias("short_pct"),
    )
    return out.crossJoin(F.broadcast(medians_of(cushioned, names, [f"{c}_median" for c in names])))  # one row each


def cushion_by_state(cushioned: DataFrame, min_orders: int = 200) -> DataFrame:
    """Median cushion per buyer state with enough orders."""
    counts = cushioned.where("customer_state is not null").groupBy("customer_state").agg(
        F.count(F.lit(1)).alias("n"), percent(late_share()).alias("late_pct")
    ).where(F.col("n") >= min_orders)
    medians = median_by(cushioned, "cushion", ["customer_state"], "cushion_median")
    return counts.join(medians, "customer_state")


def extremes(report: DataFrame, metric: str, key: str, k: int) -> DataFrame:
    """The k lowest and the k highest rows of a report, marked by ``end``."""
    report = stage(report, "report")  # a row per key, read twice
    low = report.orderBy(F.asc(metric), F.asc(key)).limit(k).withColumn("end", F.lit("low"))
    high = report.orderBy(F.desc(metric), F.asc(key)).limit(k).withColumn("end", F.lit("high"))
    return low.unionByName(high)


# -- sellers --------------------------------------------------------------------
def single_seller_orders(labelled: DataFrame, items: DataFrame) -> DataFrame:
    """Labelled orders served by exactly one seller, with late dispatch and low scores."""
    sellers = items.groupBy("order_id").agg(
        F.min("seller_id").alias("seller_id"),
        F.max("seller_id").alias("__other"),
        F.min_by("shipping_limit_date", "order_item_id").alias("shipping_limit_date"),
    ).where("seller_id = __other").drop("__other")
    return labelled.join(sellers, "order_id").withColumns({
        "dispatched_late": yes(F.col(CARRIER) > F.col("shipping_limit_date")),
        "unhappy": yes(F.col("review_score") <= 2),
    })


def seller_rates(single: DataFrame, min_orders: int = 30) -> DataFrame:
    return single.groupBy("seller_id").agg(
        F.count(F.lit(1)).alias("n"),
        late_share().alias("late_rate"),
        F.avg(F.col("dispatched_late").cast("double")).alias("late_dispatch_rate"),
    ).where(F.col("n") >= min_orders)


def seller_dispersion(single: DataFrame, min_orders: int = 30) -> DataFrame:
    """One row: how much late rates differ between sellers with enough orders."""
    rates = stage(seller_rates(single, min_orders), "seller_rates")
    overall = single.agg(
        F.count(F.lit(1)).alias("orders"),
        F.count_distinct("seller_id").alias("sellers"),
        percent(F.avg(F.col("dispatched_late").cast("double"))).alias("late_dispatch_pct"),
    )
    covered = rates.agg(F.count(F.lit(1)).alias("sellers_kept"), F.sum("n").alias("__kept"))
    names = ["p10", "p25", "p50", "p75", "p90"]
    spread = exact_quantiles(rates, "late_rate", [0.1, 0.25, 0.5, 0.75, 0.9], names=names)
    return overall.crossJoin(covered).crossJoin(spread.drop("n")).select(
        "orders", "sellers", "late_dispatch_pct", "sellers_kept",
        percent(ratio("__kept", "orders")).alias("orders_kept_pct"), *[percent(c).alias(c) for c in names],
    )


HISTORY_WIDTHS = {"last_5": 5, "last_10": 10, "last_20": 20}


def seller_history(single: DataFrame, widths: dict[str, int] = HISTORY_WIDTHS) -> DataFrame:
    """Late share of a seller's earlier orders: all of them, and the last N."""
    late = F.col("late").cast("bigint")
    slim = stage(single.select("seller_id", PURCHASE, "order_id", late.alias("t")), "history_input")
    counted = running_totals(
        slim, ["seller_id"], [PURCHASE, "order_id"], {"n_prior": F.lit(1), "late_prior": F.col("t")}
    )
    rolled = rolling_means(counted, ["seller_id"], "n_prior", "t", widths)
    return rolled.withColumn("all_prior", ratio("late_prior", "n_prior"))


def history_sensitivity(
    single: DataFrame, widths: dict[str, int] = HISTORY_WIDTHS, min_rows: int = 100
) -> DataFrame:
    """Per history window: late share in the upper minus the lower third, and coverage."""
    history = stage(seller_history(single, widths), "seller_history")
    names = ["all_prior", *widths]
    long = stage(
        history.select("t", F.inline(F.array(*[
            F.struct(F.lit(n).alias("history"), F.col(n).alias("rate")) for n in names
        ]))),
        "history_long",
    )
    thirds = exact_quantiles(long, "rate", [1 / 3, 2 / 3], ["history"], ["low", "high"]).drop("n")
    # One row of thirds per history window; a window nobody fills has none.
    rated = long.join(F.broadcast(thirds), "history", "left")
    t = F.col("t").cast("double")
    return rated.groupBy("history").agg(
        F.count("rate").alias("__n"),
        F.avg(F.when(F.col("rate") >= F.col("high"), t)).alias("__top"),
        F.avg(F.when(F.col("rate") <= F.col("low"), t)).alias("__bottom"),
        F.count(F.lit(1)).alias("__all"),
    ).select(
        "history",
        F.when(F.col("__n") >= min_rows, percent(F.col("__top") - F.col("__bottom"))).alias("separation_pts"),
        F.when(F.col("__n") >= min_rows, percent(ratio("__n", "__all"))).alias("coverage_pct"),
    )


# -- freight, product, season ----------------------------------------------------
def with_freight_ratio(labelled: DataFrame, items: DataFrame) -> DataFrame:
    """Labelled orders with a positive price and their freight share."""
    priced = labelled.join(order_values(items), "order_id").where("gmv > 0")
    return priced.withColumn("freight_ratio", ratio("freight", "gmv"))


def late_by_quantile(df: DataFrame, value: str, bins: int = 5) -> DataFrame:
    """Orders, late share and median value per equal-count bin of a column."""
    slim = stage(df.where(F.col(value).isNotNull()).select("late", F.col(value).alias("__x")), "binned_input")
    binned = with_quantile_bin(slim, "__x", bins, "bin")
    rates = binned.groupBy("bin").agg(F.count(F.lit(1)).alias("n"), percent(late_share()).alias("late_pct"))
    return rates.join(median_by(binned, "__x", ["bin"], "median_value"), "bin")


def with_first_product(labelled: DataFrame, items: DataFrame) -> DataFrame:
    """Labelled orders with the product attributes of their first item."""
    columns = ["product_id", "product_category_name_english", "product_weight_g",
               "product_length_cm", "product_height_cm", "product_width_cm"]
    first = first_per_key(items, "order_id", "order_item_id", columns).withColumn(
        "volume_cm3", F.col("product_length_cm") * F.col("product_height_cm") * F.col("product_width_cm")
    )
    return labelled.join(first, "order_id", "left")


def product_attributes(items: DataFrame, products: DataFrame, translation: DataFrame) -> DataFrame:
    """Item rows with product sizes and the translated category, for separate raw tables."""
    return items.join(products, "product_id", "left").join(translation, "product_category_name", "left")


def late_by_category(with_product: DataFrame, min_orders: int = 300, top: int | None = 8) -> DataFrame:
    """Categories with the highest late share."""
    key = "product_category_name_english"
    out = with_product.where(F.col(key).isNotNull()).groupBy(key).agg(
        F.count(F.lit(1)).alias("n"), percent(late_share()).alias("late_pct")
    ).where(F.col("n") >= min_orders)
    return out if top is None else out.orderBy(F.desc("late_pct"), key).limit(top)


def _months(labelled: DataFrame) -> DataFrame:
    return labelled.groupBy(month_label(PURCHASE).alias("month")).agg(
        F.count(F.lit(1)).alias("n"), percent(late_share()).alias("late_pct")
    )


def late_by_month(labelled: DataFrame, min_orders: int = 200) -> DataFrame:
    return _months(labelled).where(F.col("n") >= min_orders)


def late_by_weekday(labelled: DataFrame) -> DataFrame:
    return labelled.groupBy(weekday_from_monday(PURCHASE).alias("weekday")).agg(
        F.count(F.lit(1)).alias("n"), percent(late_share()).alias("late_pct")
    )


def months_dropped(labelled: DataFrame, min_orders: int = 200) -> DataFrame:
    """Months left out of the monthly report because of low volume."""
    months = _months(labelled)
    return months.select("month").exceptAll(months.where(F.col("n") >= min_orders).select("month"))


def season_summary(labelled: DataFrame, min_orders: int = 200) -> DataFrame:
    """One row: time span, lowest and highest monthly late share, and the peak month."""
    span = labelled.agg(
        F.to_date(F.min(PURCHASE)).alias("first_day"), F.to_date(F.max(PURCHASE)).alias("last_day")
    )
    peak = late_by_month(labelled, min_orders).agg(
        F.min("late_pct").alias("lowest_pct"),
        F.max("late_pct").alias("highest_pct"),
        # The earliest month wins a tie.
        F.min_by("month", F.struct((-F.col("late_pct")).alias("x"), F.col("month"))).alias("peak_month"),
    )
    return span.crossJoin(peak)


# -- geography ---------------------------------------------------------------------
def pain_by_state(labelled: DataFrame, min_orders: int = 200) -> DataFrame:
    """Late share and low-score share per buyer state; a missing score is not a low one."""
    return labelled.where("customer_state is not null").groupBy("customer_state").agg(
        F.count(F.lit(1)).alias("n"),
        percent(late_share()).alias("late_pct"),
        percent(F.avg(yes(F.col("review_score") <= 2).cast("double"))).alias("unhappy_pct"),
    ).where(F.col("n") >= min_orders)


def zip_centroids(
    geo: DataFrame, lat: tuple[float, float] = (-34.0, 6.0), lng: tuple[float, float] = (-74.0, -34.0)
) -> DataFrame:
    """Mean position per zip prefix; points outside the country's box are ignored."""
    return geo.where(F.col("lat").between(*lat) & F.col("lng").between(*lng)).groupBy("zip_prefix").agg(
        F.avg("lat").alias("lat"), F.avg("lng").alias("lng")
    )


def distance_table(labelled: DataFrame, items: DataFrame, sellers: DataFrame, centroids: DataFrame) -> DataFrame:
    """Labelled orders with buyer and first-seller positions, distance and same-state flag.

    ``labelled`` needs ``customer_zip``, ``sellers`` has seller_id, seller_zip and
    seller_state.  Orders without both positions keep a NULL distance.
    """
    first = first_per_key(items, "order_id", "order_item_id", ["seller_id"])
    near = centroids.withColumnsRenamed({"zip_prefix": "customer_zip", "lat": "c_lat", "lng": "c_lng"})
    far = centroids.withColumnsRenamed({"zip_prefix": "seller_zip", "lat": "s_lat", "lng": "s_lng"})
    return (
        labelled.join(first, "order_id")
        .join(sellers, "seller_id", "left")
        .join(near, "customer_zip", "left")
        .join(far, "seller_zip", "left")
        .withColumns({
            "dist_km": haversine_km("c_lat", "c_lng", "s_lat", "s_lng"),
            "same_state": yes(F.col("customer_state") == F.col("seller_state")),
        })
    )


def distance_coverage(distances: DataFrame) -> DataFrame:
    """One row: orders with and without both positions, median and p90 distance."""
    counts = distances.agg(
        F.count_if(F.col("dist_km").isNotNull()).alias("placed"),
        F.count_if(any_null("c_lat", "s_lat")).alias("unplaced"),
    )
    spread = exact_quantiles(distances, "dist_km", [0.5, 0.9], names=["median_km", "p90_km"])
    return counts.crossJoin(spread.drop("n"))


def late_by_same_state(distances: DataFrame) -> DataFrame:
    return distances.where("dist_km is not null").groupBy("same_state").agg(
        F.count(F.lit(1)).alias("n"), percent(late_share()).alias("late_pct")
    )


# -- all features together -----------------------------------------------------------
MATRIX_COLUMNS = ["late", "promised_days", "dist_km", "same_state", "freight_ratio",
                  "product_weight_g", "volume_cm3", "seller_late_rate"]


def feature_matrix(
    labelled: DataFrame, cushioned: DataFrame, distances: DataFrame, freight: DataFrame,
    products: DataFrame, items: DataFrame, single: DataFrame,
) -> DataFrame:
    """One row per labelled order with the candidate features of the other reports.

    The seller rate here is the plain rate over all of a seller's orders.
    """
    rate = single.groupBy("seller_id").agg(late_share().alias("seller_late_rate"))
    sellers = first_per_key(items, "order_id", "order_item_id", ["seller_id"])
    d = distances.where("dist_km is not null")
    return (
        labelled.select("order_id", F.col("late").cast("int").cast("double").alias("late"))
        .join(cushioned.select("order_id", F.col("promised_days").cast("double")), "order_id", "left")
        .join(d.select("order_id", "dist_km", F.col("same_state").cast("int").cast("double").alias("same_state")), "order_id", "left")
        .join(freight.select("order_id", "freight_ratio"), "order_id", "left")
        .join(products.select("order_id", "product_weight_g", "volume_cm3"), "order_id", "left")
        .join(sellers, "order_id", "left")
        .join(rate, "seller_id", "left")
        .select("order_id", *MATRIX_COLUMNS)
    )


def feature_coverage(matrix: DataFrame) -> DataFrame:
    """Share of orders that have each feature, that have all of them, and that have every matrix column."""
    names = ["promised_days", "dist_km", "freight_ratio", "product_weight_g", "seller_late_rate"]
    counted = matrix.agg(
        F.count(F.lit(1)).alias("__rows"),
        *[F.count(c).alias(c) for c in names],
        F.count_if(~any_null(*names)).alias("all_features"),
        F.count_if(~any_null(*MATRIX_COLUMNS)).alias("all_columns"),
    )
    cells = F.array(*[F.struct(F.lit(c).alias("feature"), F.col(c).alias("n")) for c in [*names, "all_features", "all_columns"]])
    return counted.select("__rows", F.inline(cells)).select(
        "feature", "n", percent(ratio("n", "__rows")).alias("coverage_pct")
    )


def spearman_matrix(matrix: DataFrame, columns: list[str] = MATRIX_COLUMNS) -> DataFrame:
    """Rank correlation of every pair of columns over the rows that have both.

    Ranks of a column depend on which rows its partner lacks.  One count per (column, value) therefore
    has a field per partner, with the rows that have the partner too; running totals over a column's
    values turn all fields into mean ranks at once.  Each value then looks up its ranks, and a single
    aggregate over the rows sums the products of all pairs.  Rows are copied once per column for the
    counts, where equal values meet before the shuffle, and never per pair.
    """
    places = range(len(columns))
    pairs = [(i, j) for i in places for j in places if i < j]
    wide = matrix.select(*[F.col(c).cast("double").alias(f"__v{i}") for i, c in enumerate(columns)])
    has = [F.col(f"__v{i}").isNotNull().cast("int") for i in places]
    cells = F.array(*[F.struct(F.lit(i).alias("column"), F.col(f"__v{i}").alias("v")) for i in places])
    values = (
        wide.select(*[h.alias(f"__h{j}") for j, h in enumerate(has)], F.inline(cells)).where("v is not null")
        .groupBy("column", "v").agg(*[F.sum(f"__h{j}").alias(f"n{j}") for j in places])
    )
    totals = running_totals(values, ["column"], ["v"], {f"below{j}": f"n{j}" for j in places})
    ranked = stage(
        totals.select("v", *[f"n{j}" for j in places],
                      *[(F.col(f"below{j}") + (F.col(f"n{j}") + 1) / 2).alias(f"r{j}") for j in places], "column"),
        "ranks", partition_by=["column"],
    )
    # Sums over one column's ranks need no row: ties and ranks are enough.
    own = ranked.groupBy("column").agg(
        *[F.sum(f"n{j}").alias(f"n{j}") for j in places],
        *[F.sum(F.col(f"n{j}") * F.col(f"r{j}") * F.col(f"r{j}")).alias(f"s{j}") for j in places],
    )
    looked_up = wide
    for i in places:
        ranks = ranked.where(F.col("column") == i).select(
            F.col("v").alias(f"__v{i}"), *[F.col(f"r{j}").alias(f"__r{i}_{j}") for j in places if j != i])
        looked_up = looked_up.join(ranks, f"__v{i}", "left")
    products = looked_up.agg(*[F.sum(F.col(f"__r{i}_{j}") * F.col(f"__r{j}_{i}")).alias(f"xy{i}_{j}") for i, j in pairs])
    sums = own.agg(*[  # one row per column
        F.max(F.when(F.col("column") == i, F.col(f"{f}{j}"))).alias(f"{f}{i}_{j}") for f in ("n", "s") for i in places for j in places
    ]).crossJoin(F.broadcast(products))
    rows = F.array(*[
        F.struct(F.lit(columns[i]).alias("left_column"), F.lit(columns[j]).alias("right_column"), F.col(f"n{i}_{j}").alias("n"),
                 F.col(f"s{i}_{j}").alias("xx"), F.col(f"s{j}_{i}").alias("yy"), F.col(f"xy{i}_{j}").alias("xy"))
        for i, j in pairs
    ])
    # Mean ranks are (n + 1) / 2, known without another pass.
    mean2 = F.col("n") * F.pow((F.col("n") + 1) / 2, 2)
    rho = ratio(F.col("xy") - mean2, F.sqrt((F.col("xx") - mean2) * (F.col("yy") - mean2)))
    return sums.select(F.inline(rows)).where("n > 0").select("left_column", "right_column", "n", rho.alias("rho"))

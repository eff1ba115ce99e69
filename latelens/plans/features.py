"""The feature build: item rows in, one row per delivered order with labels and features out.

Order of work: keep labelable deliveries, roll items up to orders, label, derive the
features known at purchase time, split by time, learn the late rate of the training
part, fill gaps, add the seller history.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from latelens.functions.expressions import (
    after,
    days_between,
    flag,
    haversine_km,
    parse_timestamp,
    ratio,
    weekday_from_monday,
    yes,
)
from latelens.operators.keyed import first_non_null, first_per_key, hash_sample
from latelens.operators.ordered import rows_at_positions, running_totals
from latelens.operators.quantiles import exact_quantiles
from latelens.operators.staging import stage, staged_until_done, unstage
from latelens.schemas import (
    CLASS_LATE,
    CLASS_ON_TIME,
    CLASS_VERY_EARLY,
    FEATURE_TABLE_COLUMNS,
    MIN_SELLER_ORDERS,
    TRAIN_FRACTION,
    VALIDATION_FRACTION,
    VERY_EARLY_DAYS,
)

PURCHASE, PROMISE, DELIVERY = (
    "order_purchase_timestamp",
    "order_estimated_delivery_date",
    "order_delivered_customer_date",
)
PARSED_DATES = [PURCHASE, "order_approved_at", DELIVERY, PROMISE]
TIME_ORDER = [PURCHASE, "order_id"]


def load_delivered(items: DataFrame) -> DataFrame:
    """Item rows of delivered orders that can be labeled."""
    text_dates = [c for c, t in items.dtypes if c in PARSED_DATES and t == "string"]
    parsed = items.withColumns({c: parse_timestamp(c) for c in text_dates})
    return parsed.where((F.col("order_status") == "delivered") & F.col(DELIVERY).isNotNull())


def order_rollup(
    items: DataFrame, principal: str = "first_non_null", empty_sum: str = "zero"
) -> DataFrame:
    """Items to orders in one aggregation.

    ``principal``: take each attribute from the first item that has it
    (``"first_non_null"``) or all of them from item 1 (``"first_row"``).
    ``empty_sum``: total of an order none of whose items has the value (``"zero"`` or
    ``"null"``).
    """
    items = items.withColumn(
        "item_volume_cm3",
        F.col("product_length_cm") * F.col("product_height_cm") * F.col("product_width_cm"),
    )
    attributes = {
        "customer_id": "customer_id", "customer_unique_id": "customer_unique_id", "seller_id": "seller_id",
        PURCHASE: PURCHASE, PROMISE: PROMISE, DELIVERY: DELIVERY,
        "product_category_name_english": "categoria_principal",
        "customer_state": "customer_state", "customer_lat": "customer_lat", "customer_lng": "customer_lng",
        "seller_state": "seller_state", "seller_lat": "seller_lat", "seller_lng": "seller_lng",
        "product_weight_g": "peso_principal_g", "item_volume_cm3": "volumen_principal_cm3",
    }
    attributes = {source: name for source, name in attributes.items() if source in items.columns}

    def total(column):
        return F.coalesce(F.sum(column), F.lit(0.0)) if empty_sum == "zero" else F.sum(column)

    if principal == "first_non_null":
        chosen = [first_non_null(source, "order_item_id").alias(name) for source, name in attributes.items()]
    elif principal == "first_row":
        row = F.min_by(F.struct(*attributes), F.col("order_item_id"))
        chosen = [row[source].alias(name) for source, name in attributes.items()]
    else:
        raise ValueError(f"unknown principal rule {principal!r}")
    return items.groupBy("order_id").agg(
        *chosen,
        F.count("order_item_id").alias("n_items"),
        F.coalesce(F.sum("price"), F.lit(0.0)).alias("precio_total"),
        F.coalesce(F.sum("freight_value"), F.lit(0.0)).alias("flete_total"),
        total("product_weight_g").alias("peso_total_g"),
        total("item_volume_cm3").alias("volumen_total_cm3"),
    )


def add_targets(orders: DataFrame, early_days: float = VERY_EARLY_DAYS) -> DataFrame:
    """Four labels; exactly on the promise, or exactly ``early_days`` before it, is on time."""
    gap = F.col("dias_vs_promesa")
    return orders.withColumns({
        "entrega_tarde": after(DELIVERY, PROMISE),
        "dias_vs_promesa": days_between(PROMISE, DELIVERY),
        "dias_entrega_real": days_between(PURCHASE, DELIVERY),
    }).withColumn(
        "clase_entrega",
        F.when(gap > 0, CLASS_LATE).when(gap < -early_days, CLASS_VERY_EARLY).otherwise(CLASS_ON_TIME),
    )


def add_direct_features(orders: DataFrame) -> DataFrame:
    """Features that need nothing but the order's own row."""
    return orders.withColumns({
        "dias_prometidos": days_between(PURCHASE, PROMISE),
        "ratio_flete": ratio("flete_total", "precio_total"),
        "mes_compra": F.month(PURCHASE),
        "dia_semana_compra": weekday_from_monday(PURCHASE),
        "mismo_estado": flag(F.col("customer_state") == F.col("seller_state")),
        "dist_haversine_km": haversine_km("customer_lat", "customer_lng", "seller_lat", "seller_lng"),
        "peso_total_g": F.coalesce("peso_total_g", "peso_principal_g"),
        "volumen_total_cm3": F.coalesce("volumen_total_cm3", "volumen_principal_cm3"),
    })


def cut_positions(rows: int, train: float = TRAIN_FRACTION, val: float = VALIDATION_FRACTION) -> tuple[int, int]:
    """Where validation and test begin; fractions of rows are cut off, not rounded."""
    return int(rows * train), int(rows * (train + val))


def temporal_split(
    orders: DataFrame, train: float = TRAIN_FRACTION, val: float = VALIDATION_FRACTION
) -> DataFrame:
    """Label rows train / val / test by purchase time (ties by order id).

    Only the two rows at the cut points are looked up; every other row compares its own
    key with them, so the table itself is neither sorted nor shuffled.
    """
    rows = orders.count()
    i_val, i_test = cut_positions(rows, train, val)
    marks = rows_at_positions(orders.select(*TIME_ORDER), TIME_ORDER, [i_val, i_test])
    key = F.struct(*TIME_ORDER)
    cuts = stage(
        marks.agg(
            F.max(F.when(F.col("position") == i_val, key)).alias("__val"),
            F.max(F.when(F.col("position") == i_test, key)).alias("__test"),
        ),
        "cuts",
    )
    # A cut beyond the last row is NULL: nothing lies on its far side.
    labelled = orders.crossJoin(F.broadcast(cuts)).withColumn(  # one row
        "split",
        F.when(yes(key >= F.col("__test")), "test").when(yes(key >= F.col("__val")), "val").otherwise("train"),
    )
    return labelled.drop("__val", "__test")


def train_late_rate(orders: DataFrame) -> DataFrame:
    """One row: late rate of the training part."""
    return orders.where("split = 'train'").agg(F.avg("entrega_tarde").alias("global_rate"))


def prior_counts(orders: DataFrame, history: str = "row_order") -> DataFrame:
    """Earlier orders of the same seller and how many of them were late.

    ``history``: which orders count as earlier -
    ``"row_order"``   all before this one by (purchase time, order id);
    ``"strict_time"`` only those with a strictly earlier purchase time;
    ``"known_outcome"`` only those whose delivery was known before this purchase.
    """
    late = F.col("entrega_tarde").cast("bigint")
    if history == "row_order":
        return running_totals(
            orders, ["seller_id"], TIME_ORDER, {"prior_orders": F.lit(1), "prior_late": late}
        )
    if history == "strict_time":
        # One row per seller and instant, then a running total, then back to the orders.
        instants = stage(
            orders.groupBy("seller_id", PURCHASE).agg(F.count(F.lit(1)).alias("__n"), F.sum(late).alias("__l")),
            "instants",
        )
        totals = running_totals(
            instants, ["seller_id"], [PURCHASE], {"prior_orders": "__n", "prior_late": "__l"}
        ).drop("__n", "__l")
        return orders.join(
            totals.withColumnsRenamed({"seller_id": "__s", PURCHASE: "__t"}),
            F.col("seller_id").eqNullSafe(F.col("__s")) & F.col(PURCHASE).eqNullSafe(F.col("__t")),
            "left",
        ).drop("__s", "__t")
    if history == "known_outcome":
        return known_before(orders, late)
    raise ValueError(f"unknown history rule {history!r}")


def known_before(orders: DataFrame, late: Column) -> DataFrame:
    """Counts, per order, the seller's outcomes that were known before its purchase.

    Two clocks on one time line: purchases ask, deliveries tell, and an ask sees the tells before it.
    At the same instant the ask comes first, so nothing sees itself.  Only keys, times and the
    label go through the sweep; its counts come back to the orders by ``order_id``, which is unique.
    """
    told_at = F.when(F.col(DELIVERY).isNotNull(), F.greatest(DELIVERY, PURCHASE))

    def event(at, kind, n, late_n):
        return F.struct(at.alias("at"), F.lit(kind).alias("kind"), F.lit(n).alias("n"), late_n.alias("l"))

    none = F.lit(0).cast("bigint")
    asks_and_tells = orders.select(
        "seller_id", "order_id",
        F.inline(F.array(event(F.col(PURCHASE), 0, 0, none), event(told_at, 1, 1, late))),
    ).where("kind = 0 or at is not null")
    counted = running_totals(
        asks_and_tells, ["seller_id"], ["at", "kind", "order_id"], {"prior_orders": "n", "prior_late": "l"}
    ).where("kind = 0").select(F.col("order_id").alias("__o"), "prior_orders", "prior_late")
    return orders.join(counted, F.col("order_id").eqNullSafe(F.col("__o"))).drop("__o")


def add_seller_rate(
    orders: DataFrame,
    global_rate: DataFrame,
    min_orders: int = MIN_SELLER_ORDERS,
    history: str = "row_order",
) -> DataFrame:
    """Late rate over the seller's earlier orders, else the training rate and a flag.

    ``global_rate`` is a one-row frame.  An order without a seller has no history.
    """
    counted = prior_counts(orders, history)
    enough = yes((F.col("prior_orders") >= min_orders) & F.col("seller_id").isNotNull())
    rated = counted.crossJoin(F.broadcast(global_rate.select(F.col("global_rate").alias("__g"))))
    return rated.withColumns({
        "sin_historial_vendedor": flag(~enough),
        "tasa_vendedor": F.when(enough, ratio("prior_late", "prior_orders")).otherwise(F.col("__g")),
    }).drop("__g")


def impute_business(orders: DataFrame, fit_on: str = "all") -> DataFrame:
    """Fill size gaps from the category, then overall; fill the freight ratio overall.

    ``fit_on`` is ``"all"`` rows or only ``"train"``.  Distance gaps stay: the
    preprocessing pipeline fills them from the training part.
    """
    sizes = ["peso_total_g", "volumen_total_cm3"]
    counted = orders.agg(*[F.count_if(F.col(c).isNull()).alias(c) for c in [*sizes, "ratio_flete"]]).first()
    gaps = [c for c in [*sizes, "ratio_flete"] if counted[c]]
    if not gaps:
        return orders  # nothing to fill: no medians to compute
    fit = orders if fit_on == "all" else orders.where("split = 'train'")

    # All medians at once: each column over all rows, sizes also per category.
    scopes = [(c, F.lit("all")) for c in gaps] + [
        (c, F.concat(F.lit("of "), F.col("categoria_principal"))) for c in gaps if c in sizes
    ]
    long = stage(
        fit.select(F.inline(F.array(*[
            F.struct(F.lit(c).alias("column_name"), scope.alias("scope"), F.col(c).alias("value")) for c, scope in scopes
        ]))),
        "gap_columns",
    )
    medians = stage(exact_quantiles(long, "value", [0.5], ["column_name", "scope"], ["median"]), "medians")
    unstage(long)

    def pick(c):
        return F.max(F.when(F.col("column_name") == c, F.col("median")))

    overall = medians.where("scope = 'all'").agg(*[pick(c).alias(f"__all_{c}") for c in gaps])
    per_category = medians.where("scope <> 'all'").groupBy("scope").agg(*[pick(c).alias(f"__of_{c}") for c in gaps])
    in_scope = F.concat(F.lit("of "), F.col("categoria_principal")) == F.col("scope")
    wide = orders.join(per_category, in_scope, "left").crossJoin(F.broadcast(overall))  # one row
    filled = wide.withColumns({c: F.coalesce(c, f"__of_{c}", f"__all_{c}") for c in gaps})
    return filled.drop("scope", *[f"__of_{c}" for c in gaps], *[f"__all_{c}" for c in gaps])


@dataclass
class FeatureBuild:
    """``full`` holds every working column, ``table`` the published ones."""

    full: DataFrame
    global_rate: DataFrame

    @property
    def table(self) -> DataFrame:
        return self.full.select(*FEATURE_TABLE_COLUMNS)


def labelled_orders(items: DataFrame, principal: str = "first_non_null", empty_sum: str = "zero") -> DataFrame:
    """Rollup, labels and direct features."""
    return add_direct_features(add_targets(order_rollup(load_delivered(items), principal, empty_sum)))


def build_feature_table(
    items: DataFrame,
    principal: str = "first_non_null",
    empty_sum: str = "zero",
    history: str = "row_order",
    impute_fit: str = "all",
    min_orders: int = MIN_SELLER_ORDERS,
) -> FeatureBuild:
    """The whole feature build.

    Orders are staged once after the rollup.  Splitting and gap filling only look at an
    order's own row and a few constants, so they run in the same pass that feeds the
    seller history, the one step that has to bring orders together again.  Only the result stays staged.
    """
    with staged_until_done(items.sparkSession):
        orders = stage(labelled_orders(items, principal, empty_sum), "orders")
        split = temporal_split(orders)
        rate = stage(train_late_rate(split), "train_rate", outlives=True)
        filled = impute_business(split, impute_fit)
        rated = add_seller_rate(filled, rate, min_orders, history)
        if history == "row_order":
            unstage(orders)  # all its rows lie in the ranges of the history
        full = rated.withColumns({"n_items": F.col("n_items").cast("int")})
        return FeatureBuild(stage(full, "features", outlives=True), rate)


def audit_seller_rate(
    orders: DataFrame, n: int = 200, min_orders: int = MIN_SELLER_ORDERS, tolerance: float = 1e-6
) -> DataFrame:
    """Recompute the seller rate of sampled orders straight from the orders before them.

    One row per sampled order that has a history: expected and stored rate and whether
    they agree.  A seller's sampled orders are points on the seller's time line.  The points (at most
    n) go to the orders; every order of such a seller is read once, finds the stretch between two
    points it lies in, and is counted there.  Totals over the stretches before a point, at
    most n + 1 in all, then give its history, however many orders a seller has.
    """
    sample = hash_sample(orders.where("sin_historial_vendedor = 0"), "order_id", n).select(
        F.col("seller_id").alias("__seller"),
        F.struct(F.struct(*TIME_ORDER).alias("key"), F.col("order_id").alias("audited_order"),
                 F.col("tasa_vendedor").alias("stored_rate")).alias("__point"),
    )
    points = stage(sample.groupBy("__seller").agg(F.sort_array(F.collect_list("__point")).alias("__points")), "audit_points")
    key = F.struct(*TIME_ORDER)
    stretch = F.size(F.filter("__points", lambda p: p["key"] <= key))
    counted = (
        orders.select("seller_id", *TIME_ORDER, "entrega_tarde")
        .join(F.broadcast(points), F.col("seller_id") == F.col("__seller"))  # at most n rows
        .withColumn("__at", stretch)
        .where(F.col("__at") < F.size("__points"))
        .groupBy("__seller", "__at").agg(F.count(F.lit(1)).alias("__n"), F.sum("entrega_tarde").alias("__late"))
    )
    each = points.select("__seller", F.posexplode("__points").alias("__at", "__point"))
    upto = Window.partitionBy("__seller").orderBy("__at")
    recomputed = each.join(counted, ["__seller", "__at"], "left").select(
        F.col("__point.audited_order"),
        F.coalesce(F.sum("__n").over(upto), F.lit(0)).alias("prior_orders"),
        ratio(F.sum("__late").over(upto), F.sum("__n").over(upto)).alias("expected_rate"),
        F.col("__point.stored_rate"),
    )
    return recomputed.where((F.col("prior_orders") >= min_orders) & (F.col("prior_orders") > 0)).withColumn(
        "agrees", F.abs(F.col("expected_rate") - F.col("stored_rate")) <= tolerance
    )


def assert_no_leak(audit: DataFrame) -> None:
    if not audit.where("not agrees").isEmpty():
        raise AssertionError("the seller rate depends on the order itself or on later ones")


def first_item(items: DataFrame, columns: list[str]) -> DataFrame:
    """Attributes of the lowest-numbered item of every order."""
    return first_per_key(items, "order_id", "order_item_id", columns)



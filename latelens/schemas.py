"""Column roles and explicit table schemas.

Every column is either known when the order is placed (it may be a feature) or
known later (it may only be a label).  The guards in ``latelens.sources.guards``
are built on the lists below.
"""

from __future__ import annotations

from pyspark.sql.types import (
    DoubleType,
    IntegerType,
    StringType,
    StructField,
    StructType,
    TimestampNTZType,
)

# --------------------------------------------------------------------------
# Output column names that users of the feature table rely on.
# --------------------------------------------------------------------------
KEY_COLUMNS = ["order_id", "order_purchase_timestamp", "split"]

LATE_LABEL = "entrega_tarde"
CLASS_LABEL = "clase_entrega"
DAY_LABELS = ["dias_vs_promesa", "dias_entrega_real"]
LABELS = [LATE_LABEL, CLASS_LABEL] + DAY_LABELS

NUMERIC_FEATURES = [
    "dias_prometidos",
    "dist_haversine_km",
    "ratio_flete",
    "precio_total",
    "flete_total",
    "n_items",
    "peso_total_g",
    "volumen_total_cm3",
    "tasa_vendedor",
    "mes_compra",
    "dia_semana_compra",
]
CATEGORICAL_FEATURES = [
    "customer_state",
    "seller_state",
    "categoria_principal",
    "mismo_estado",
    "sin_historial_vendedor",
]
FEATURES = NUMERIC_FEATURES + CATEGORICAL_FEATURES
FEATURE_TABLE_COLUMNS = KEY_COLUMNS + LABELS + FEATURES

# The three delivery classes, in report order.
CLASS_VERY_EARLY, CLASS_ON_TIME, CLASS_LATE = "muy_temprano", "a_tiempo", "tarde"
CLASS_ORDER = [CLASS_VERY_EARLY, CLASS_ON_TIME, CLASS_LATE]

# Columns only known after the purchase.
AFTER_PURCHASE_COLUMNS = [
    "order_delivered_carrier_date",
    "order_delivered_customer_date",
    "delivery_days",
    "delivery_delay_days",
    "is_late_delivery",
    "review_count",
    "avg_review_score",
    "min_review_score",
    "max_review_score",
    "has_review_comment",
    "review_comment_titles",
    "review_comment_messages",
    "last_review_creation_date",
    "last_review_answer_timestamp",
    "is_dissatisfied",
]

# Brazilian states by region.
STATES_BY_REGION = {
    "Norte": ["AC", "AP", "AM", "PA", "RO", "RR", "TO"],
    "Nordeste": ["AL", "BA", "CE", "MA", "PB", "PE", "PI", "RN", "SE"],
    "Centro-Oeste": ["DF", "GO", "MT", "MS"],
    "Sudeste": ["ES", "MG", "RJ", "SP"],
    "Sul": ["PR", "RS", "SC"],
}
OTHER_REGION = "Otro"

# Business parameters with their usual values.
MIN_SELLER_ORDERS = 5
VERY_EARLY_DAYS = 3
TRAIN_FRACTION, VALIDATION_FRACTION = 0.70, 0.15
RECALL_TARGET = 0.50


def _table(**columns) -> StructType:
    return StructType([StructField(name, kind(), True) for name, kind in columns.items()])


_S, _I, _D, _T = StringType, IntegerType, DoubleType, TimestampNTZType

# Item-level consolidated input: one row per order item, all statuses.
CONSOLIDATED = _table(
    order_id=_S, order_item_id=_I, customer_id=_S, customer_unique_id=_S, seller_id=_S,
    order_status=_S, order_purchase_timestamp=_T, order_approved_at=_T,
    order_delivered_carrier_date=_T, order_delivered_customer_date=_T,
    order_estimated_delivery_date=_T, price=_D, freight_value=_D,
    product_category_name_english=_S, product_weight_g=_D, product_length_cm=_D,
    product_height_cm=_D, product_width_cm=_D, customer_state=_S, customer_lat=_D,
    customer_lng=_D, seller_state=_S, seller_lat=_D, seller_lng=_D,
)

# The nine raw tables of the exploration job.
RAW_TABLES = {
    "orders": _table(
        order_id=_S, customer_id=_S, order_status=_S, order_purchase_timestamp=_T,
        order_approved_at=_T, order_delivered_carrier_date=_T,
        order_delivered_customer_date=_T, order_estimated_delivery_date=_T,
    ),
    "items": _table(
        order_id=_S, order_item_id=_I, product_id=_S, seller_id=_S,
        shipping_limit_date=_T, price=_D, freight_value=_D,
    ),
    "customers": _table(customer_id=_S, customer_zip_code_prefix=_S, customer_state=_S),
    "sellers": _table(seller_id=_S, seller_zip_code_prefix=_S, seller_state=_S),
    "products": _table(
        product_id=_S, product_category_name=_S, product_weight_g=_D,
        product_length_cm=_D, product_height_cm=_D, product_width_cm=_D,
    ),
    "reviews": _table(
        review_id=_S, order_id=_S, review_score=_I, review_comment_message=_S,
        review_answer_timestamp=_T,
    ),
    "geolocation": _table(
        geolocation_zip_code_prefix=_S, geolocation_lat=_D, geolocation_lng=_D,
    ),
    "cat_trans": _table(product_category_name=_S, product_category_name_english=_S),
    "payments": _table(order_id=_S, payment_type=_S, payment_value=_D),
}

FEATURE_TABLE = _table(
    order_id=_S, order_purchase_timestamp=_T, split=_S, entrega_tarde=_I, clase_entrega=_S,
    dias_vs_promesa=_D, dias_entrega_real=_D, dias_prometidos=_D, dist_haversine_km=_D,
    ratio_flete=_D, precio_total=_D, flete_total=_D, n_items=_I, peso_total_g=_D,
    volumen_total_cm3=_D, tasa_vendedor=_D, mes_compra=_I, dia_semana_compra=_I,
    customer_state=_S, seller_state=_S, categoria_principal=_S, mismo_estado=_I,
    sin_historial_vendedor=_I,
)

"""The exploration from the nine raw tables: references between them, the product chain, the reports."""

from __future__ import annotations

from pyspark.sql import DataFrame

from latelens.operators.keyed import orphan_report
from latelens.plans import exploration as ex

#: check: (child table, child key, parent table, parent key)
REFERENCES = {
    "items_without_order": ("items", "order_id", "orders", "order_id"),
    "items_without_product": ("items", "product_id", "products", "product_id"),
    "items_without_seller": ("items", "seller_id", "sellers", "seller_id"),
    "orders_without_customer": ("orders", "customer_id", "customers", "customer_id"),
    "orders_without_items": ("orders", "order_id", "items", "order_id"),
    "reviews_without_order": ("reviews", "order_id", "orders", "order_id"),
    "payments_without_order": ("payments", "order_id", "orders", "order_id"),
    "products_without_translation": ("products", "product_category_name", "cat_trans", "product_category_name"),
}


def item_products(tables: dict[str, DataFrame]) -> DataFrame:
    """Item rows with the sizes of their product and its translated category."""
    return ex.product_attributes(tables["items"], tables["products"], tables["cat_trans"])


def labelled(tables: dict[str, DataFrame]) -> DataFrame:
    """Delivered orders with both dates, their latest review and their buyer."""
    return ex.label_base(ex.order_base(tables["orders"], tables["reviews"], tables["customers"]))


def late_by_category(tables: dict[str, DataFrame], min_orders: int = 300, top: int | None = 8) -> DataFrame:
    """Late share by the category of an order's first item, over the product chain."""
    return ex.late_by_category(ex.with_first_product(labelled(tables), item_products(tables)), min_orders, top)


def reports(tables: dict[str, DataFrame]) -> dict[str, DataFrame]:
    """The reports that need nothing but the raw tables, by name."""
    orders, items = tables["orders"], tables["items"]
    return {
        "integrity": orphan_report(tables, REFERENCES),
        "lifecycle_nulls": ex.lifecycle_nulls(orders),
        "status_counts": ex.status_counts(orders),
        "granularity": ex.granularity(tables["reviews"], items),
        "undelivered": ex.undelivered_summary(orders, items),
        "undelivered_by_state": ex.undelivered_by_state(orders, tables["customers"]),
        "undelivered_by_seller": ex.undelivered_by_seller(orders, items),
        "late_by_month": ex.late_by_month(labelled(tables)),
        "late_by_category": late_by_category(tables),
    }

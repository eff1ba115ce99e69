"""SQL twins of the registered queries, for an independent engine (DuckDB).

``STEPS`` are named sub-queries; a query text pulls in the steps it mentions.
"""

from __future__ import annotations

import re

from latelens.plans.exploration import GAP_EDGES, MATRIX_COLUMNS
from latelens.schemas import CATEGORICAL_FEATURES, CLASS_ORDER, NUMERIC_FEATURES

_CHORD = (
    "(pow(sin(radians({b} - {a}) / 2), 2)"
    " + cos(radians({a})) * cos(radians({b})) * pow(sin(radians({d} - {c}) / 2), 2))"
)
# Not least(): it skips NULL.
HAVERSINE = f"12742e0 * asin(sqrt(CASE WHEN {_CHORD} > 1 THEN 1e0 ELSE {_CHORD} END))"


def haversine(lat1, lng1, lat2, lng2):
    return HAVERSINE.format(a=lat1, b=lat2, c=lng1, d=lng2)


def days(start, end):
    return f"(date_diff('second', {start}, {end}) / 86400e0)"


def whole_days(start, end):
    return f"CAST(floor({days(start, end)}) AS INT)"


STEPS: dict[str, str] = {}

STEPS["numbered"] = """
  SELECT l_orderkey AS order_id,
         ROW_NUMBER() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_shipdate,
                            l_quantity, l_extendedprice, l_discount, l_tax) AS order_item_id,
         l_partkey AS product_id, l_suppkey AS seller_id, l_extendedprice, l_tax
  FROM lineitem"""
STEPS["orders_x"] = """
  SELECT o_orderkey AS order_id, o_custkey AS customer_id, c_nationkey, n_name AS customer_state, n_regionkey AS c_region,
         CASE WHEN o_orderkey % 33 = 0 THEN 'canceled' ELSE 'delivered' END AS order_status,
         o_orderdate + INTERVAL '1' SECOND * CAST((o_orderkey * 7919) % 86400 AS INT) AS purchase_ts,
         CAST(13 + (o_orderkey * 13) % 17 AS INT) AS promised_days
  FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey"""
STEPS["order_text"] = """
  SELECT order_id, purchase_ts, promised_days, order_id % 101 = 0 AS short, order_id % 103 = 0 AND order_id % 101 <> 0 AS long,
         order_id % 107 = 0 AS bad_buyer, order_id % 109 = 0 AS bad_date,
         CASE WHEN order_id % 107 = 0 THEN 'n/a' WHEN order_id % 113 = 0 THEN '' ELSE CAST(customer_id AS VARCHAR) END AS buyer,
         CASE WHEN order_id % 109 = 0 THEN 'never' ELSE strftime(purchase_ts, '%Y-%m-%d %H:%M:%S') END AS bought
  FROM orders_x"""
STEPS["raw_products"] = """
  SELECT p_partkey AS product_id, CASE WHEN p_partkey % 97 = 0 THEN NULL ELSE lower(p_type) END AS category,
         CASE WHEN p_partkey % 97 = 0 OR length(p_type) = 5 THEN NULL ELSE p_type END AS english,
         CASE WHEN p_partkey % 89 = 0 THEN NULL ELSE p_size * 1e2 END AS product_weight_g,
         CASE WHEN p_partkey % 83 = 0 THEN NULL ELSE p_size * 1e0 END AS product_length_cm
  FROM part WHERE p_partkey % 61 <> 0"""
STEPS["sellers_x"] = """
  SELECT s_suppkey AS seller_id, s_nationkey, n_name AS seller_state, n_regionkey AS s_region
  FROM supplier JOIN nation ON s_nationkey = n_nationkey"""
STEPS["timing"] = """
  SELECT o.*,
         CAST(1 + (o.order_id * 7 + o.customer_id * 3) % 12 + f.seller_id % 5
              + CASE WHEN o.c_region <> s.s_region THEN 3 ELSE 0 END
              + CASE WHEN o.order_id % 19 = 0 THEN 6 ELSE 0 END AS INT) AS actual_days
  FROM orders_x o
  JOIN numbered f ON f.order_id = o.order_id AND f.order_item_id = 1
  JOIN sellers_x s ON s.seller_id = f.seller_id"""
STEPS["dated"] = """
  SELECT t.*,
         DATE_TRUNC('day', purchase_ts) + INTERVAL '1' DAY * promised_days AS estimated_ts,
         CASE WHEN order_status <> 'delivered' OR order_id % 401 = 0 THEN NULL
              ELSE purchase_ts + INTERVAL '1' DAY * actual_days + INTERVAL '1' HOUR * CAST((order_id * 131) % 24 AS INT) END AS delivered_ts,
         CASE WHEN order_id % 307 = 0 THEN NULL
              ELSE purchase_ts + INTERVAL '1' DAY * CAST(1 + order_id % 6 AS INT) END AS carrier_ts,
         purchase_ts + INTERVAL '1' DAY * 4 AS shipping_limit_ts
  FROM timing t"""
STEPS["items"] = """
  SELECT d.order_id, i.order_item_id, d.customer_id, i.seller_id, i.product_id, d.order_status,
         d.purchase_ts, d.estimated_ts, d.delivered_ts, d.carrier_ts, d.shipping_limit_ts,
         CASE WHEN i.order_id % 211 = 0 THEN 0e0 ELSE i.l_extendedprice END AS price,
         i.l_extendedprice * i.l_tax AS freight_value,
         CASE WHEN i.product_id % 97 = 0 THEN NULL ELSE p.p_type END AS product_category,
         CASE WHEN i.product_id % 89 = 0 THEN NULL ELSE p.p_size * 1e2 END AS product_weight_g,
         CASE WHEN i.product_id % 83 = 0 THEN NULL ELSE p.p_size * 1e0 END AS product_length_cm,
         5e0 AS product_height_cm, 1e1 AS product_width_cm,
         d.customer_state, s.seller_state,
         CASE WHEN d.c_nationkey = 11 THEN NULL ELSE -34e0 + ((d.c_nationkey * 37) % 400) * 1e-1 END AS customer_lat,
         CASE WHEN d.c_nationkey = 11 THEN NULL ELSE -74e0 + ((d.c_nationkey * 53) % 400) * 1e-1 END AS customer_lng,
         CASE WHEN i.seller_id % 23 = 5 THEN NULL ELSE -34e0 + ((s.s_nationkey * 37) % 400) * 1e-1 END AS seller_lat,
         CASE WHEN i.seller_id % 23 = 5 THEN NULL ELSE -74e0 + ((s.s_nationkey * 53) % 400) * 1e-1 END AS seller_lng
  FROM dated d JOIN numbered i ON i.order_id = d.order_id
  JOIN part p ON p.p_partkey = i.product_id
  JOIN sellers_x s ON s.seller_id = i.seller_id"""
STEPS["reviews"] = """
  SELECT order_id * 10 AS review_id, order_id,
         CASE WHEN delivered_ts > estimated_ts THEN 1 + order_id % 3 ELSE 2 + order_id % 4 END AS review_score,
         CASE WHEN order_id % 331 = 0 THEN NULL
              ELSE delivered_ts + INTERVAL '1' DAY * CAST(1 + order_id % 5 AS INT) END AS review_answer_ts
  FROM items WHERE order_item_id = 1 AND order_id % 40 <> 0
  UNION ALL
  SELECT order_id * 10 + 1, order_id, 5, delivered_ts + INTERVAL '1' DAY * 9
  FROM items WHERE order_item_id = 1 AND order_id % 50 = 1"""
STEPS["geolocation"] = """
  SELECT c_custkey % 50 AS zip_prefix,
         -40e0 + ((c_custkey * 29) % 500) * 1e-1 AS lat,
         -80e0 + ((c_custkey * 31) % 500) * 1e-1 AS lng
  FROM customer"""
STEPS["order_rows"] = """
  SELECT *, CASE WHEN order_id % 251 <> 0 THEN purchase_ts + INTERVAL '1' HOUR * CAST(order_id % 48 AS INT) END AS approved_ts
  FROM (SELECT order_id, customer_id, customer_state, order_status, purchase_ts, carrier_ts, delivered_ts, estimated_ts
        FROM items WHERE order_item_id = 1
        UNION ALL
        SELECT order_id, customer_id, customer_state, order_status, purchase_ts,
               CASE WHEN order_id % 307 = 0 THEN NULL ELSE purchase_ts + INTERVAL '1' DAY * CAST(1 + order_id % 6 AS INT) END,
               NULL, DATE_TRUNC('day', purchase_ts) + INTERVAL '1' DAY * promised_days
        FROM orders_x WHERE order_id NOT IN (SELECT order_id FROM items))"""
STEPS["first_rows"] = """
  SELECT *, product_length_cm * product_height_cm * product_width_cm AS volume_cm3 FROM items WHERE order_item_id = 1"""

# -- feature build ------------------------------------------------------------------
STEPS["delivered"] = """
  SELECT *, product_length_cm * product_height_cm * product_width_cm AS item_volume
  FROM items WHERE order_status = 'delivered' AND delivered_ts IS NOT NULL"""


def _first(column):
    return f"arg_min({column}, order_item_id) FILTER ({column} IS NOT NULL)"


_ATTRIBUTES = {
    "customer_id": "customer_id", "seller_id": "seller_id", "order_purchase_timestamp": "purchase_ts",
    "order_estimated_delivery_date": "estimated_ts", "order_delivered_customer_date": "delivered_ts",
    "categoria_principal": "product_category", "customer_state": "customer_state", "customer_lat": "customer_lat",
    "customer_lng": "customer_lng", "seller_state": "seller_state", "seller_lat": "seller_lat",
    "seller_lng": "seller_lng", "peso_principal_g": "product_weight_g", "volumen_principal_cm3": "item_volume",
}
_TOTALS = """CAST(COUNT(order_item_id) AS BIGINT) AS n_items, COALESCE(SUM(price), 0e0) AS precio_total,
  COALESCE(SUM(freight_value), 0e0) AS flete_total"""
STEPS["rollup"] = f"""
  SELECT order_id, {', '.join(f'{_first(c)} AS {a}' for a, c in _ATTRIBUTES.items())}, {_TOTALS},
         COALESCE(SUM(product_weight_g), 0e0) AS peso_total_g, COALESCE(SUM(item_volume), 0e0) AS volumen_total_cm3
  FROM delivered GROUP BY order_id"""
STEPS["rollup_first_row"] = f"""
  SELECT order_id, {', '.join(f'MAX({c}) FILTER (order_item_id = 1) AS {a}' for a, c in _ATTRIBUTES.items())}, {_TOTALS},
         SUM(product_weight_g) AS peso_total_g, SUM(item_volume) AS volumen_total_cm3
  FROM delivered GROUP BY order_id"""
STEPS["rollup_gaps"] = f"""
  SELECT order_id, {_first('product_category')} AS categoria_principal, {_TOTALS},
         COALESCE(SUM(product_weight_g), {_first('product_weight_g')}) AS peso,
         COALESCE(SUM(item_volume), {_first('item_volume')}) AS volumen
  FROM delivered GROUP BY order_id"""
_GAP = days("order_estimated_delivery_date", "order_delivered_customer_date")
STEPS["direct"] = f"""
  SELECT *,
         CAST(COALESCE(order_delivered_customer_date > order_estimated_delivery_date, FALSE) AS INT) AS entrega_tarde,
         {_GAP} AS dias_vs_promesa,
         {days('order_purchase_timestamp', 'order_delivered_customer_date')} AS dias_entrega_real,
         CASE WHEN {_GAP} > 0 THEN 'tarde' WHEN {_GAP} < -3 THEN 'muy_temprano' ELSE 'a_tiempo' END AS clase_entrega,
         {days('order_purchase_timestamp', 'order_estimated_delivery_date')} AS dias_prometidos,
         flete_total / NULLIF(precio_total, 0e0) AS ratio_flete,
         CAST(EXTRACT(month FROM order_purchase_timestamp) AS INT) AS mes_compra,
         CAST(EXTRACT(isodow FROM order_purchase_timestamp) - 1 AS INT) AS dia_semana_compra,
         CAST(COALESCE(customer_state = seller_state, FALSE) AS INT) AS mismo_estado,
         {haversine('customer_lat', 'customer_lng', 'seller_lat', 'seller_lng')} AS dist_haversine_km
  FROM rollup"""
STEPS["split_orders"] = """
  SELECT *, CASE WHEN pos < CAST(floor(n * 0.7e0) AS BIGINT) THEN 'train'
                 WHEN pos < CAST(floor(n * (0.7e0 + 0.15e0)) AS BIGINT) THEN 'val' ELSE 'test' END AS split
  FROM (SELECT *, ROW_NUMBER() OVER (ORDER BY order_purchase_timestamp, order_id) - 1 AS pos, COUNT(*) OVER () AS n FROM direct)"""
STEPS["train_rate"] = "SELECT AVG(entrega_tarde) AS g FROM split_orders WHERE split = 'train'"
STEPS["rated"] = """
  SELECT s.*, CAST(CASE WHEN prior_orders >= 5 THEN 0 ELSE 1 END AS INT) AS sin_historial_vendedor,
         CASE WHEN prior_orders >= 5 THEN prior_late / CAST(prior_orders AS DOUBLE) ELSE g END AS tasa_vendedor
  FROM (SELECT *, COUNT(*) OVER w AS prior_orders, CAST(COALESCE(SUM(entrega_tarde) OVER w, 0) AS BIGINT) AS prior_late
        FROM split_orders
        WINDOW w AS (PARTITION BY seller_id ORDER BY order_purchase_timestamp, order_id
                     ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)) s, train_rate"""
STEPS["features"] = """
  SELECT * REPLACE (COALESCE(ratio_flete, (SELECT median(ratio_flete) FROM rated)) AS ratio_flete, CAST(n_items AS INT) AS n_items)
  FROM rated"""

# -- exploration -------------------------------------------------------------------
STEPS["latest"] = """
  SELECT order_id, review_id, review_score FROM (
    SELECT *, ROW_NUMBER() OVER (PARTITION BY order_id ORDER BY review_answer_ts DESC NULLS FIRST, review_id DESC) AS rn
    FROM reviews) WHERE rn = 1"""
STEPS["labelled"] = f"""
  SELECT o.*, r.review_id, r.review_score, delivered_ts > estimated_ts AS late,
         {whole_days('estimated_ts', 'delivered_ts')} AS gap_days,
         {whole_days('purchase_ts', 'delivered_ts')} AS real_days,
         {whole_days('purchase_ts', 'estimated_ts')} AS promised_days,
         {whole_days('purchase_ts', 'estimated_ts')} - {whole_days('purchase_ts', 'delivered_ts')} AS cushion
  FROM order_rows o LEFT JOIN latest r USING (order_id)
  WHERE order_status = 'delivered' AND delivered_ts IS NOT NULL AND estimated_ts IS NOT NULL"""
STEPS["values_by_order"] = "SELECT order_id, SUM(price) AS gmv, SUM(freight_value) AS freight FROM items GROUP BY order_id"
STEPS["undelivered"] = """
  SELECT COUNT(*) AS orders, COUNT(*) FILTER (order_status <> 'delivered') AS undelivered,
         (SELECT SUM(gmv) FROM values_by_order) AS gmv_total,
         (SELECT COALESCE(SUM(gmv), 0e0) FROM values_by_order
          WHERE order_id IN (SELECT order_id FROM order_rows WHERE order_status <> 'delivered')) AS gmv_undelivered
  FROM order_rows"""
STEPS["single"] = """
  SELECT l.*, s.seller_id, COALESCE(l.carrier_ts > s.shipping_limit, FALSE) AS dispatched_late
  FROM labelled l JOIN (
    SELECT order_id, MIN(seller_id) AS seller_id, arg_min(shipping_limit_ts, order_item_id) AS shipping_limit
    FROM items GROUP BY order_id HAVING COUNT(DISTINCT seller_id) = 1) s USING (order_id)"""
STEPS["seller_rate_table"] = """
  SELECT seller_id, COUNT(*) AS n, AVG(CAST(late AS INT)) AS late_rate, AVG(CAST(dispatched_late AS INT)) AS late_dispatch_rate
  FROM single GROUP BY seller_id HAVING COUNT(*) >= 3"""


def _rolling(n):
    frame = f"(PARTITION BY seller_id ORDER BY purchase_ts, order_id ROWS BETWEEN {n} PRECEDING AND 1 PRECEDING)"
    return f"CASE WHEN COUNT(*) OVER {frame} = {n} THEN AVG(t) OVER {frame} END AS last_{n}"


STEPS["history"] = f"""
  SELECT order_id, t, n_prior, late_prior / CAST(NULLIF(n_prior, 0) AS DOUBLE) AS all_prior, last_5, last_10, last_20
  FROM (SELECT *, COUNT(*) OVER w AS n_prior, COALESCE(SUM(t) OVER w, 0) AS late_prior, {_rolling(5)}, {_rolling(10)}, {_rolling(20)}
        FROM (SELECT seller_id, purchase_ts, order_id, CAST(late AS INT) AS t FROM single)
        WINDOW w AS (PARTITION BY seller_id ORDER BY purchase_ts, order_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING))"""
STEPS["freight_orders"] = """
  SELECT order_id, late, ROUND(freight / gmv, 9) AS freight_ratio FROM labelled JOIN values_by_order USING (order_id) WHERE gmv > 0"""
STEPS["product_orders"] = """
  SELECT l.order_id, l.late, f.product_category, f.product_weight_g, f.volume_cm3
  FROM labelled l JOIN first_rows f USING (order_id)"""
STEPS["centroids"] = """
  SELECT zip_prefix, AVG(lat) AS lat, AVG(lng) AS lng FROM geolocation
  WHERE lat BETWEEN -34e0 AND 6e0 AND lng BETWEEN -74e0 AND -34e0 GROUP BY zip_prefix"""
STEPS["distances"] = f"""
  SELECT l.order_id, l.late, f.seller_id, c.lat AS c_lat, c.lng AS c_lng, s.lat AS s_lat, s.lng AS s_lng,
         ROUND({haversine('c.lat', 'c.lng', 's.lat', 's.lng')}, 6) AS dist_km,
         COALESCE(l.customer_state = f.seller_state, FALSE) AS same_state
  FROM labelled l JOIN first_rows f USING (order_id)
  LEFT JOIN centroids c ON c.zip_prefix = l.customer_id % 53
  LEFT JOIN centroids s ON s.zip_prefix = f.seller_id % 53"""
STEPS["matrix"] = """
  SELECT l.order_id, CAST(CAST(l.late AS INT) AS DOUBLE) AS late, CAST(l.promised_days AS DOUBLE) AS promised_days, d.dist_km,
         CASE WHEN d.dist_km IS NOT NULL THEN CAST(CAST(d.same_state AS INT) AS DOUBLE) END AS same_state,
         f.freight_ratio, p.product_weight_g, p.volume_cm3, r.rate AS seller_late_rate
  FROM labelled l JOIN distances d USING (order_id) LEFT JOIN freight_orders f USING (order_id)
  JOIN product_orders p USING (order_id)
  LEFT JOIN (SELECT seller_id, AVG(CAST(late AS INT)) AS rate FROM single GROUP BY seller_id) r ON r.seller_id = d.seller_id"""

# -- scores ---------------------------------------------------------------------------
STEPS["train_km"] = "SELECT median(dist_haversine_km) AS m FROM features WHERE split = 'train'"
STEPS["scores"] = """
  SELECT order_id, split, customer_state, sin_historial_vendedor, entrega_tarde,
         ROUND(least(1e0, greatest(0e0, 0.7e0 * (d / (d + m + 1e-9)) + 0.3e0 * CAST(mismo_estado = 0 AS INT))), 9) AS score,
         CAST(d > m AND mismo_estado = 0 AS INT) AS pred
  FROM (SELECT *, COALESCE(dist_haversine_km, m) AS d FROM features, train_km)"""


def _curve(source, groups="", where=""):
    part = f"PARTITION BY {groups}" if groups else ""
    keys = f"{groups}, " if groups else ""
    return f"""
  SELECT *, SUM(n) OVER ({part} ORDER BY threshold DESC) AS predicted, SUM(pos) OVER ({part} ORDER BY threshold DESC) AS hits,
         SUM(n) OVER ({part}) AS total, SUM(pos) OVER ({part}) AS positives
  FROM (SELECT {keys}score AS threshold, COUNT(*) AS n, SUM(entrega_tarde) AS pos FROM {source} {where} GROUP BY {keys}score)"""


STEPS["val_curve"] = _curve("scores", where="WHERE split = 'val'")
STEPS["test_curve"] = _curve("scores", where="WHERE split = 'test'")
STEPS["split_curve"] = _curve("scores", "split")
STEPS["segments"] = """
  SELECT *, CASE WHEN sin_historial_vendedor = 1 THEN 'cold-start (sin historial)' ELSE 'con historial' END AS segmento
  FROM scores WHERE split = 'train'"""
STEPS["segment_curve"] = _curve("segments", "segmento")
STEPS["best_f1"] = """
  SELECT threshold AS umbral FROM val_curve
  ORDER BY 2 * (hits / CAST(predicted AS DOUBLE)) * (hits / CAST(positives AS DOUBLE))
           / (hits / CAST(predicted AS DOUBLE) + hits / CAST(positives AS DOUBLE) + 1e-12) DESC, threshold LIMIT 1"""
STEPS["constant_scores"] = """
  SELECT entrega_tarde, ROUND(g, 9) AS score FROM features, train_rate WHERE split = 'test'"""
STEPS["constant_curve"] = _curve("constant_scores")

_AP = "SUM(pos / CAST(positives AS DOUBLE) * hits / predicted)"
_AUC = "SUM((n - pos) * (hits - pos + pos / 2e0)) / MAX(CAST(positives AS DOUBLE) * (total - positives))"


def _metrics(curve, threshold, groups=""):
    keys = f"{groups}, " if groups else ""
    return f"""
  SELECT {keys}pr_auc, roc_auc, COALESCE(2e0 * hit / NULLIF(alerts + p, 0), 0) AS f1,
         COALESCE(hit / CAST(NULLIF(alerts, 0) AS DOUBLE), 0) AS "precision", COALESCE(hit / CAST(NULLIF(p, 0) AS DOUBLE), 0) AS recall,
         sq / all_rows AS brier, umbral, p / CAST(all_rows AS DOUBLE) AS tasa_base, alerts / CAST(all_rows AS DOUBLE) AS frac_alertas, all_rows
  FROM (SELECT {keys}umbral, {_AP} AS pr_auc, {_AUC} AS roc_auc,
               SUM(pos * (1 - threshold) * (1 - threshold) + (n - pos) * threshold * threshold) AS sq,
               COALESCE(SUM(n) FILTER (threshold >= umbral), 0) AS alerts, COALESCE(SUM(pos) FILTER (threshold >= umbral), 0) AS hit,
               MAX(total) AS all_rows, MAX(positives) AS p
        FROM {curve}, {threshold} GROUP BY {keys}umbral)"""


_METRIC_COLUMNS = ["pr_auc", "roc_auc", "f1", '"precision"', "recall", "brier", "umbral", "tasa_base", "frac_alertas"]
STEPS["test_metrics"] = _metrics("test_curve", "best_f1")
STEPS["constant_threshold"] = "SELECT ROUND(g, 9) AS umbral FROM train_rate"
STEPS["constant_metrics"] = _metrics("constant_curve", "constant_threshold")
STEPS["segment_metrics"] = _metrics("segment_curve", "best_f1", "segmento")


def r(expression, name=None, digits=6):
    return f"ROUND({expression}, {digits}) AS {name or expression}"


def rr(*columns, digits=6):
    return ", ".join(r(c, digits=digits) for c in columns)


def count(expression="*"):
    return f"CAST(COUNT({expression}) AS BIGINT)"


def big(expression):
    return f"CAST({expression} AS BIGINT)"


LATE_PCT = r("AVG(CAST(late AS INT)) * 100", "late_pct")
LATE_RATE = "AVG(CAST(entrega_tarde AS DOUBLE))"


def _bins(source, value, bins, columns, ordinal="bin", shift=0):
    """Equal-count bins: exact distinct edges, a bin is the number of inner edges below."""
    inner = [f"quantile_cont({value}, {i / bins!r})" for i in range(1, bins)]
    return f"""
  SELECT bin + {shift} AS {ordinal}, {columns} FROM (
    SELECT s.*, CAST(len(list_filter(inner_edges, lambda e: e < {value})) AS INT) AS bin
    FROM {source} s, (
      SELECT list_filter(list_distinct([{', '.join(inner)}]), lambda e: e > MIN({value}) AND e < MAX({value})) AS inner_edges
      FROM (SELECT {value} FROM {source} WHERE {value} IS NOT NULL) q0 ) q
    WHERE {value} IS NOT NULL) GROUP BY bin"""


def _quantile_bins(source, value):
    return _bins(source, value, 5, f"{count()} AS n, {LATE_PCT}, {r(f'median({value})', 'median_value', 9)}")


def _histogram(source, value, bins, low, high, groups=None, digits=6):
    x = f"CAST(least({high}, greatest({low}, {value})) AS DOUBLE)" if low is not None else value
    keys = f"{groups}, " if groups else ""
    grid = f"(SELECT {keys}COUNT(*) AS c FROM x0 GROUP BY {groups})" if groups else "(SELECT COUNT(*) AS c FROM x0)"
    match = f"h.bin = g.bin{f' AND h.{groups} = t.{groups}' if groups else ''}"
    density = f", {r(f'COALESCE(h.n, 0) / CAST(t.c AS DOUBLE) / ((hi - lo) / {bins})', 'density')}" if groups else ""
    prefix = f"t.{groups}, " if groups else ""
    return f"""
  SELECT {prefix}CAST(g.bin AS INT) AS bin, {r(f'lo + (g.bin - 1) * ((hi - lo) / {bins})', 'left_edge', digits)}, {big('COALESCE(h.n, 0)')} AS n{density}
  FROM (SELECT unnest(range(1, {bins + 1})) AS bin) g CROSS JOIN {grid} t CROSS JOIN span
  LEFT JOIN (SELECT {keys}len(list_filter(range(1, {bins}), lambda i: lo + i * ((hi - lo) / {bins}) <= x)) + 1 AS bin, COUNT(*) AS n
             FROM x0, span GROUP BY ALL) h ON {match}""", {
        "x0": f"SELECT {keys}{x} AS x FROM {source} WHERE {value} IS NOT NULL",
        "span": "SELECT MIN(x) AS lo, MAX(x) AS hi FROM x0",
    }


def _gap_bins():
    cases = " ".join(f"WHEN gap_days <= {upper} THEN {i}" for i, upper in enumerate(GAP_EDGES[1:]))
    return f"CAST(CASE WHEN gap_days <= {GAP_EDGES[0]} THEN NULL {cases} END AS INT)"


def _spearman():
    pairs = []
    for i, a in enumerate(MATRIX_COLUMNS):
        for b in MATRIX_COLUMNS[i + 1:]:
            pairs.append(f"""
  SELECT '{a}' AS left_column, '{b}' AS right_column, {count()} AS n, {r('corr(rx, ry)', 'rho')} FROM (
    SELECT RANK() OVER (ORDER BY {a}) + (COUNT(*) OVER (PARTITION BY {a}) - 1) / 2e0 AS rx,
           RANK() OVER (ORDER BY {b}) + (COUNT(*) OVER (PARTITION BY {b}) - 1) / 2e0 AS ry
    FROM matrix WHERE {a} IS NOT NULL AND {b} IS NOT NULL)""")
    return " UNION ALL ".join(pairs)


def _null_rows(source, columns):
    return " UNION ALL ".join(
        f"SELECT '{name}' AS column_name, {big(f'COUNT(*) FILTER ({c} IS NULL)')} AS n_null, "
        f"{r(f'AVG(CAST({c} IS NULL AS INT))', 'null_share')} FROM {source}"
        for name, c in columns.items()
    )


def _frequency(source, column):
    return f"SELECT {column}, {count()} AS n, {r('COUNT(*) / CAST(SUM(COUNT(*)) OVER () AS DOUBLE)', 'share')} FROM {source} GROUP BY {column}"


def _levels():
    parts = []
    for c in CATEGORICAL_FEATURES:
        parts.append(f"""
  SELECT '{c}' AS column_name, v AS value, {count()} AS n, {r('COUNT(*) / CAST(SUM(COUNT(*)) OVER () AS DOUBLE)', 'share')},
         COUNT(*) >= 0.04e0 * SUM(COUNT(*)) OVER () AS kept, v = MAX(m) AS is_mode
  FROM (SELECT COALESCE(CAST({c} AS VARCHAR), m) AS v, m FROM features, (
          SELECT CAST({c} AS VARCHAR) AS m FROM features WHERE split = 'train' AND {c} IS NOT NULL
          GROUP BY 1 ORDER BY COUNT(*) DESC, 1 LIMIT 1)
        WHERE split = 'train') GROUP BY v""")
    return " UNION ALL ".join(parts)


def _numeric(c):
    return f"(SELECT COALESCE({c}, m) AS x, m FROM features, (SELECT median({c}) AS m FROM features WHERE split = 'train') WHERE split = 'train')"


def _scaled():
    fits = ", ".join(
        f"(SELECT MAX(m) AS m_{c}, AVG(x) AS a_{c}, STDDEV_POP(x) AS s_{c} FROM {_numeric(c)})" for c in NUMERIC_FEATURES
    )
    outs = ", ".join(r(f"(COALESCE({c}, m_{c}) - a_{c}) / s_{c}", c, 5) for c in NUMERIC_FEATURES)
    return f"SELECT order_id, {outs} FROM features, {fits}"


def _ends(report, metric, key, k):
    return f"""
  SELECT * FROM (SELECT *, 'low' AS "end" FROM {report} ORDER BY {metric}, {key} LIMIT {k})
  UNION ALL SELECT * FROM (SELECT *, 'high' AS "end" FROM {report} ORDER BY {metric} DESC, {key} LIMIT {k})"""


def _rates(prior):
    return f"""
  SELECT order_id, {big('prior_orders')} AS prior_orders, {big('prior_late')} AS prior_late,
         CAST(CASE WHEN prior_orders >= 5 THEN 0 ELSE 1 END AS INT) AS sin_historial_vendedor,
         {r('CASE WHEN prior_orders >= 5 THEN prior_late / CAST(prior_orders AS DOUBLE) ELSE g END', 'tasa_vendedor', 9)}
  FROM ({prior}), train_rate"""


def _region_errors(region_table, keep="TRUE", default="Otro"):
    return f"""
  SELECT COALESCE(r_name, '{default}') AS region, {count()} AS n_ordenes, {r('AVG(entrega_tarde)', 'tasa_tarde_real')},
         {r('AVG(pred) FILTER (entrega_tarde = 1)', 'recall_tarde')}, {big('SUM(entrega_tarde)')} AS n_tarde
  FROM scores LEFT JOIN {region_table} ON n_name = customer_state WHERE split = 'test' AND {keep} GROUP BY 1"""


def _vector_sums():
    parts = [f"""
  SELECT split, 'num__{c}' AS feature, {r(f'SUM((COALESCE({c}, m) - a) / COALESCE(NULLIF(s, 0), 1))', 'total', 4)}
  FROM features, (SELECT MAX(m) AS m, AVG(x) AS a, STDDEV_POP(x) AS s FROM {_numeric(c)}) GROUP BY split""" for c in NUMERIC_FEATURES]
    for c in CATEGORICAL_FEATURES:
        parts.append(f"""
  SELECT split, name AS feature, CAST(COUNT(*) FILTER (own = name) AS DOUBLE) AS total FROM (
    WITH mode AS (SELECT CAST({c} AS VARCHAR) AS m FROM features WHERE split = 'train' AND {c} IS NOT NULL
                  GROUP BY 1 ORDER BY COUNT(*) DESC, 1 LIMIT 1),
         filled AS (SELECT split, COALESCE(CAST({c} AS VARCHAR), m) AS v FROM features, mode),
         levels AS (SELECT v, 'cat__{c}_' || CASE WHEN COUNT(*) >= 0.01e0 * SUM(COUNT(*)) OVER () THEN v ELSE 'infrequent' END AS own
                    FROM filled WHERE split = 'train' GROUP BY v)
    SELECT split, own, name FROM filled LEFT JOIN levels USING (v), (SELECT DISTINCT own AS name FROM levels))
  GROUP BY split, name""")
    return " UNION ALL ".join(parts)


def _texts() -> dict[str, str | tuple[str, dict[str, str]]]:
    q: dict[str, str | tuple[str, dict[str, str]]] = {}
    t = "order_purchase_timestamp"
    q["late_by_state"] = f"SELECT customer_state, {count()} AS n, {r(LATE_RATE + ' * 100', 'late_pct')} FROM direct GROUP BY customer_state HAVING COUNT(*) >= 10"
    q["delivered_items"] = f"""
      SELECT order_id, CAST(order_item_id AS INT) AS order_item_id, customer_id, seller_id, product_id,
             purchase_ts AS order_purchase_timestamp, delivered_ts AS order_delivered_customer_date,
             estimated_ts AS order_estimated_delivery_date, {rr('price', 'freight_value', 'customer_lat', 'seller_lng')} FROM delivered"""
    plain = ["order_id", "customer_id", "seller_id", t, "order_estimated_delivery_date", "order_delivered_customer_date",
             "categoria_principal", "customer_state", "seller_state", "n_items"]
    numbers = ["customer_lat", "customer_lng", "seller_lat", "seller_lng", "peso_principal_g", "volumen_principal_cm3",
               "precio_total", "flete_total", "peso_total_g", "volumen_total_cm3"]
    q["order_rollup"] = f"SELECT {', '.join(plain)}, {rr(*numbers)} FROM rollup"
    q["order_rollup_first_row"] = f"SELECT {', '.join(plain)}, {rr(*numbers)} FROM rollup_first_row"
    q["order_targets"] = f"SELECT order_id, entrega_tarde, clase_entrega, {rr('dias_vs_promesa', 'dias_entrega_real', digits=8)} FROM direct"
    q["direct_features"] = f"""
      SELECT order_id, mes_compra, dia_semana_compra, mismo_estado,
             {r('dias_prometidos', digits=8)}, {rr('ratio_flete', 'dist_haversine_km', 'peso_total_g', 'volumen_total_cm3')} FROM direct"""
    q["text_orders"] = """
      SELECT order_id, TRY_CAST(buyer AS BIGINT) AS customer_id, CASE WHEN bad_date THEN NULL ELSE purchase_ts END AS purchase_ts,
             promised_days FROM order_text WHERE NOT (short OR long OR bad_buyer)"""
    q["text_rejects"] = """
      SELECT CASE WHEN short OR long THEN 'fields' ELSE 'values' END AS reason,
             CASE WHEN short OR long THEN '' WHEN bad_date THEN 'customer_id,purchase_ts' ELSE 'customer_id' END AS bad_columns,
             concat(order_id, ',', buyer, ',', bought, CASE WHEN short THEN '' WHEN long THEN concat(',', promised_days, ',x')
                                                       ELSE concat(',', promised_days) END) AS record
      FROM order_text WHERE short OR long OR bad_buyer"""
    q["text_load_report"] = """
      SELECT COUNT(*) AS "rows", COUNT(*) FILTER (WHERE short OR long OR bad_buyer) AS rejected,
             COUNT(*) FILTER (WHERE bad_date AND NOT (short OR long OR bad_buyer)) AS patched FROM order_text"""
    orphan_counts = {
        "items_without_order": "lineitem WHERE l_orderkey NOT IN (SELECT o_orderkey FROM orders)",
        "items_without_product": "lineitem WHERE l_partkey NOT IN (SELECT product_id FROM raw_products)",
        "items_without_seller": "lineitem WHERE l_suppkey NOT IN (SELECT s_suppkey FROM supplier)",
        "orders_without_customer": "orders WHERE o_custkey NOT IN (SELECT c_custkey FROM customer)",
        "orders_without_items": "orders WHERE o_orderkey NOT IN (SELECT l_orderkey FROM lineitem)",
        "reviews_without_order": "reviews WHERE order_id NOT IN (SELECT o_orderkey FROM orders)",
        "payments_without_order": "orders WHERE o_orderkey % 500 = 0",
        "products_without_translation": "raw_products WHERE english IS NULL",
    }
    q["catalog_orphans"] = " UNION ALL ".join(
        f"SELECT '{name}' AS check_name, {count()} AS orphans FROM {source}" for name, source in orphan_counts.items())
    q["catalog_item_products"] = """
      SELECT CAST(order_id AS VARCHAR) AS order_id, CAST(order_item_id AS INT) AS order_item_id, CAST(product_id AS VARCHAR) AS product_id,
             category AS product_category_name, english AS product_category_name_english, p.product_weight_g, p.product_length_cm
      FROM numbered LEFT JOIN raw_products p USING (product_id)"""
    q["catalog_late_by_category"] = f"""
      SELECT english AS product_category_name_english, {count()} AS n, {LATE_PCT}
      FROM labelled JOIN numbered USING (order_id) JOIN raw_products USING (product_id)
      WHERE order_item_id = 1 AND english IS NOT NULL GROUP BY english"""
    q["catalog_reviews"] = """
      SELECT CAST(review_id AS VARCHAR) AS review_id, CAST(order_id AS VARCHAR) AS order_id, CAST(review_score AS INT) AS review_score,
             CASE WHEN order_id % 3 = 0 THEN concat('it said "', review_score, '",', chr(10), 'no more') END AS review_comment_message,
             review_answer_ts AS review_answer_timestamp FROM reviews"""
    q["temporal_split"] = "SELECT order_id, split FROM split_orders"
    q["seller_rate"] = _rates("SELECT order_id, prior_orders, prior_late FROM rated")
    q["seller_rate_strict"] = _rates(f"""
      SELECT order_id, COUNT(*) OVER w AS prior_orders, COALESCE(SUM(entrega_tarde) OVER w, 0) AS prior_late FROM split_orders
      WINDOW w AS (PARTITION BY seller_id ORDER BY {t}
                   RANGE BETWEEN UNBOUNDED PRECEDING AND INTERVAL '1' SECOND PRECEDING)""")
    q["seller_rate_known_outcome"] = _rates(f"""
      SELECT a.order_id, COUNT(b.order_id) AS prior_orders, COALESCE(SUM(b.entrega_tarde), 0) AS prior_late
      FROM split_orders a LEFT JOIN split_orders b ON a.seller_id = b.seller_id
       AND greatest(b.order_delivered_customer_date, b.{t}) < a.{t} GROUP BY a.order_id""")
    q["seller_rate_audit"] = f"""
      SELECT order_id AS audited_order, prior_orders, {r('tasa_vendedor', 'expected_rate')}, {r('tasa_vendedor', 'stored_rate')}, TRUE AS agrees
      FROM rated WHERE sin_historial_vendedor = 0
      ORDER BY md5(concat_ws(':', CAST(order_id AS VARCHAR), '42')), order_id LIMIT 200"""
    q["impute_business"] = f"""
      SELECT order_id, {r('COALESCE(peso, mp, (SELECT median(peso) FROM rollup_gaps))', 'peso_total_g')},
             {r('COALESCE(volumen, mv, (SELECT median(volumen) FROM rollup_gaps))', 'volumen_total_cm3')},
             {r('COALESCE(flete_total / NULLIF(precio_total, 0e0), (SELECT median(flete_total / NULLIF(precio_total, 0e0)) FROM rollup_gaps))', 'ratio_flete')}
      FROM rollup_gaps LEFT JOIN (SELECT categoria_principal, median(peso) AS mp, median(volumen) AS mv FROM rollup_gaps
                                  WHERE categoria_principal IS NOT NULL GROUP BY 1) USING (categoria_principal)"""
    feature_days = ["dias_vs_promesa", "dias_entrega_real", "dias_prometidos"]
    feature_numbers = ["dist_haversine_km", "ratio_flete", "precio_total",
                       "flete_total", "peso_total_g", "volumen_total_cm3"]
    q["feature_table"] = f"""
      SELECT order_id, {t}, split, entrega_tarde, clase_entrega, n_items, mes_compra, dia_semana_compra, customer_state,
             seller_state, categoria_principal, mismo_estado, sin_historial_vendedor, {rr(*feature_days, digits=8)}, {rr(*feature_numbers)}, {r('tasa_vendedor', digits=9)} FROM features"""
    q["first_item"] = "SELECT order_id, seller_id, product_id FROM first_rows"
    q["hash_sample"] = """
      SELECT order_id, entrega_tarde FROM direct ORDER BY md5(concat_ws(':', CAST(order_id AS VARCHAR), '42')), order_id LIMIT 500"""

    q["lifecycle_nulls"] = _null_rows("order_rows", {
        "order_purchase_timestamp": "purchase_ts", "order_approved_at": "approved_ts",
        "order_delivered_carrier_date": "carrier_ts",
        "order_delivered_customer_date": "delivered_ts", "order_estimated_delivery_date": "estimated_ts",
    })
    q["order_status_counts"] = _frequency("order_rows", "order_status")
    q["granularity"] = """
      SELECT CAST((SELECT COUNT(*) FROM (SELECT order_id FROM reviews GROUP BY 1 HAVING COUNT(DISTINCT review_id) >= 2)) AS BIGINT) AS orders_with_several_reviews,
             CAST((SELECT COUNT(*) FROM (SELECT review_id FROM reviews GROUP BY 1 HAVING COUNT(DISTINCT order_id) >= 2)) AS BIGINT) AS reviews_on_several_orders,
             CAST((SELECT COUNT(*) FROM (SELECT order_id FROM items GROUP BY 1 HAVING COUNT(DISTINCT seller_id) = 1)) AS BIGINT) AS single_seller_orders,
             CAST((SELECT COUNT(*) FROM (SELECT order_id FROM items GROUP BY 1 HAVING COUNT(DISTINCT seller_id) >= 2)) AS BIGINT) AS multi_seller_orders"""
    q["orphan_rows"] = f"""
      SELECT 'items_without_order' AS check_name, {count()} AS orphans FROM lineitem WHERE l_orderkey NOT IN (SELECT o_orderkey FROM orders)
      UNION ALL SELECT 'orders_without_customer', {count()} FROM orders WHERE o_custkey NOT IN (SELECT c_custkey FROM customer)
      UNION ALL SELECT 'orders_without_items', {count()} FROM orders WHERE o_orderkey NOT IN (SELECT l_orderkey FROM lineitem)"""
    q["latest_review"] = "SELECT order_id, review_id, review_score FROM latest"
    q["order_base"] = "SELECT order_id, customer_id, customer_state, review_id, review_score, late, gap_days FROM labelled"
    q["undelivered_summary"] = f"""
      SELECT {big('orders')} AS orders, {big('undelivered')} AS undelivered, {r('undelivered / CAST(orders AS DOUBLE) * 100', 'undelivered_pct')},
             {rr('gmv_total', 'gmv_undelivered', digits=2)}, {r('gmv_undelivered / gmv_total * 100', 'gmv_undelivered_pct')} FROM undelivered"""

    def rate(key, source, minimum, limit=""):
        return f"""
      SELECT {key}, {count()} AS n, {big("COUNT(*) FILTER (order_status <> 'delivered')")} AS undelivered,
             {r("COUNT(*) FILTER (order_status <> 'delivered') / CAST(COUNT(*) AS DOUBLE) * 100", 'undelivered_pct')}
      FROM {source} GROUP BY {key} HAVING COUNT(*) >= {minimum} AND COUNT(*) FILTER (order_status <> 'delivered') > 0 {limit}"""

    top = "ORDER BY COUNT(*) FILTER (order_status <> 'delivered') / CAST(COUNT(*) AS DOUBLE) * 100 DESC, {} LIMIT {}"
    q["undelivered_by_state"] = rate("customer_state", "order_rows", 500)
    q["undelivered_by_state_top"] = rate("customer_state", "order_rows", 100, top.format("customer_state", 6))
    q["undelivered_by_seller"] = rate("seller_id", "items", 50)
    q["undelivered_by_seller_top"] = rate("seller_id", "items", 50, top.format("seller_id", 5))
    q["lateness_summary"] = f"""
      SELECT {count()} AS n, {LATE_PCT}, {r('AVG(gap_days)', 'gap_mean')}, {r('quantile_cont(gap_days, 0.1)', 'gap_p10')},
             {r('quantile_cont(gap_days, 0.5)', 'gap_median')}, {r('quantile_cont(gap_days, 0.9)', 'gap_p90')} FROM labelled"""
    q["review_distribution"] = _frequency("(SELECT * FROM labelled WHERE review_score IS NOT NULL)", "review_score")
    unhappy = "AVG(CAST(review_score <= 2 AS INT))"
    q["dissatisfaction_by_lateness"] = f"""
      SELECT {r('a', 'unhappy_on_time_pct')}, {r('b', 'unhappy_late_pct')}, {r('b / a', 'times_more')}
      FROM (SELECT {unhappy} FILTER (NOT late) * 100 AS a, {unhappy} FILTER (late) * 100 AS b FROM labelled WHERE review_score IS NOT NULL)"""
    q["dissatisfaction_gap_bins"] = f"""
      SELECT {_gap_bins()} AS gap_bin, {count()} AS n, {r(unhappy + ' * 100', 'unhappy_pct')}
      FROM labelled WHERE review_score IS NOT NULL AND {_gap_bins()} IS NOT NULL GROUP BY 1"""
    q["gmv_exposure"] = f"""
      SELECT {big('n')} AS n, {big('n_late')} AS n_late, {rr('gmv_base', 'gmv_late', digits=2)}, {rr('aov_late', 'aov_on_time', digits=4)},
             {r('gmv_undelivered', digits=2)}, {r('gmv_late / gmv_base * 100', 'gmv_late_pct')}, {r('gmv_late + gmv_undelivered', 'gmv_at_risk', 2)}
      FROM (SELECT COUNT(*) AS n, COUNT(*) FILTER (late) AS n_late, SUM(gmv) AS gmv_base, COALESCE(SUM(gmv) FILTER (late), 0e0) AS gmv_late,
                   AVG(gmv) FILTER (late) AS aov_late, AVG(gmv) FILTER (NOT late) AS aov_on_time
            FROM labelled LEFT JOIN values_by_order USING (order_id)), (SELECT gmv_undelivered FROM undelivered)"""
    q["promise_cushion"] = "SELECT " + ", ".join(
        [r(f"AVG({c})", f"{c}_mean") + ", " + r(f"quantile_cont({c}, 0.5)", f"{c}_median") for c in ("real_days", "promised_days", "cushion")]
        + [r("AVG(CAST(cushion < 0 AS INT)) * 100", "short_pct")]
    ) + " FROM labelled"
    cushion = f"""SELECT customer_state, {count()} AS n, {LATE_PCT}, {r('quantile_cont(cushion, 0.5)', 'cushion_median')}
      FROM labelled WHERE customer_state IS NOT NULL GROUP BY customer_state HAVING COUNT(*) >= 100"""
    q["cushion_by_state"] = cushion
    q["cushion_extremes"] = (_ends("report", "cushion_median", "customer_state", 8), {"report": cushion})
    q["seller_rates"] = f"SELECT seller_id, {big('n')} AS n, {rr('late_rate', 'late_dispatch_rate')} FROM seller_rate_table"
    q["seller_dispersion"] = f"""
      SELECT {big('orders')} AS orders, {big('sellers')} AS sellers, {rr('late_dispatch_pct')}, {big('sellers_kept')} AS sellers_kept,
             {r('kept / CAST(orders AS DOUBLE) * 100', 'orders_kept_pct')}, {rr('p10', 'p25', 'p50', 'p75', 'p90')}
      FROM (SELECT COUNT(*) AS orders, COUNT(DISTINCT seller_id) AS sellers, AVG(CAST(dispatched_late AS INT)) * 100 AS late_dispatch_pct FROM single),
           (SELECT COUNT(*) AS sellers_kept, SUM(n) AS kept, {', '.join(f'quantile_cont(late_rate, {p / 100}) * 100 AS p{p}' for p in (10, 25, 50, 75, 90))}
            FROM seller_rate_table)"""
    q["rolling_history"] = f"SELECT order_id, {big('n_prior')} AS n_prior, {rr('all_prior', 'last_5', 'last_10', 'last_20')} FROM history"
    q["history_window_sensitivity"] = " UNION ALL ".join(f"""
      SELECT '{c}' AS history, {r(f"CASE WHEN COUNT({c}) >= 100 THEN (AVG(t) FILTER ({c} >= hi) - AVG(t) FILTER ({c} <= lo)) * 100 END", 'separation_pts')},
             {r(f"CASE WHEN COUNT({c}) >= 100 THEN COUNT({c}) / CAST(COUNT(*) AS DOUBLE) * 100 END", 'coverage_pct')}
      FROM history, (SELECT quantile_cont({c}, 1e0 / 3) AS lo, quantile_cont({c}, 2e0 / 3) AS hi FROM history)"""
        for c in ("all_prior", "last_5", "last_10", "last_20"))
    q["freight_quintiles"] = _quantile_bins("freight_orders", "freight_ratio")
    q["weight_quintiles"] = _quantile_bins("product_orders", "product_weight_g")
    q["category_lateness"] = f"""
      SELECT product_category AS product_category_name_english, {count()} AS n, {LATE_PCT} FROM product_orders
      WHERE product_category IS NOT NULL GROUP BY 1 HAVING COUNT(*) >= 300 ORDER BY AVG(CAST(late AS INT)) DESC, 1 LIMIT 8"""
    months = f"SELECT strftime(purchase_ts, '%Y-%m') AS month, {count()} AS n, {LATE_PCT} FROM labelled GROUP BY 1 HAVING COUNT(*)"
    q["seasonality_month"] = f"{months} >= 150"
    q["seasonality_weekday"] = f"SELECT CAST(EXTRACT(isodow FROM purchase_ts) - 1 AS INT) AS weekday, {count()} AS n, {LATE_PCT} FROM labelled GROUP BY 1"
    q["months_dropped"] = f"SELECT month FROM ({months} < 150)"
    q["season_summary"] = f"""
      SELECT CAST(CAST(MIN(purchase_ts) AS DATE) AS VARCHAR) AS first_day, CAST(CAST(MAX(purchase_ts) AS DATE) AS VARCHAR) AS last_day,
             (SELECT MIN(late_pct) FROM ({months} >= 150)) AS lowest_pct, (SELECT MAX(late_pct) FROM ({months} >= 150)) AS highest_pct,
             (SELECT month FROM ({months} >= 150) ORDER BY late_pct DESC, month LIMIT 1) AS peak_month FROM labelled"""
    pain = f"""SELECT customer_state, {count()} AS n, {LATE_PCT}, {r('AVG(CAST(COALESCE(review_score <= 2, FALSE) AS INT)) * 100', 'unhappy_pct')}
      FROM labelled WHERE customer_state IS NOT NULL GROUP BY customer_state HAVING COUNT(*) >= 200"""
    q["pain_by_state"] = pain
    q["pain_extremes"] = (_ends("report", "late_pct", "customer_state", 6), {"report": pain})
    q["zip_centroids"] = f"SELECT zip_prefix, {rr('lat', 'lng')} FROM centroids"
    q["distance_table"] = f"SELECT order_id, seller_id, {rr('c_lat', 'c_lng', 's_lat', 's_lng', 'dist_km')}, same_state FROM distances"
    q["distance_coverage"] = f"""
      SELECT {count('dist_km')} AS placed, {big('COUNT(*) FILTER (c_lat IS NULL OR s_lat IS NULL)')} AS unplaced,
             {r('quantile_cont(dist_km, 0.5)', 'median_km', 9)}, {r('quantile_cont(dist_km, 0.9)', 'p90_km', 9)} FROM distances"""
    q["distance_quintiles"] = _quantile_bins("distances", "dist_km")
    q["same_state_rate"] = f"SELECT same_state, {count()} AS n, {LATE_PCT} FROM distances WHERE dist_km IS NOT NULL GROUP BY 1"
    q["feature_matrix"] = f"SELECT order_id, {rr(*MATRIX_COLUMNS, digits=9)} FROM matrix"
    names = ["promised_days", "dist_km", "freight_ratio", "product_weight_g", "seller_late_rate"]
    complete, every = (" AND ".join(f"{c} IS NOT NULL" for c in part) for part in (names, MATRIX_COLUMNS))
    q["feature_coverage"] = " UNION ALL ".join(
        f"SELECT '{n}' AS feature, {big(f'COUNT(*) FILTER ({c})')} AS n, {r(f'COUNT(*) FILTER ({c}) / CAST(COUNT(*) AS DOUBLE) * 100', 'coverage_pct')} FROM matrix"
        for n, c in [(n, f"{n} IS NOT NULL") for n in names] + [("all_features", complete), ("all_columns", every)]
    )
    q["spearman_matrix"] = _spearman()

    q["item_status_counts"] = _frequency("items", "order_status")
    q["grain_before_after"] = f"SELECT {count()} AS item_rows, {count('DISTINCT order_id')} AS distinct_orders, (SELECT {count()} FROM features) AS feature_rows FROM items"
    labels = [("entrega_tarde", 0, "on_time", "entrega_tarde = 0"), ("entrega_tarde", 1, "late", "entrega_tarde = 1")] + [
        ("clase_entrega", i, c, f"clase_entrega = '{c}'") for i, c in enumerate(CLASS_ORDER)]
    q["label_distribution"] = " UNION ALL ".join(
        f"SELECT '{a}' AS label, CAST({i} AS INT) AS position, '{c}' AS class, {big(f'COUNT(*) FILTER ({w})')} AS n, "
        f"{r(f'COUNT(*) FILTER ({w}) / CAST(COUNT(*) AS DOUBLE) * 100', 'pct')} FROM features" for a, i, c, w in labels)
    q["label_medians"] = "SELECT " + ", ".join(
        r(f"AVG({c})", f"{c}_mean") + ", " + r(f"median({c})", f"{c}_median") for c in ("dias_vs_promesa", "dias_entrega_real")
    ) + " FROM features"
    q["regional_gradient"] = f"""
      SELECT customer_state, {count()} AS n, {r(LATE_RATE, 'late_rate')}, {r('MAX(o)', 'overall_rate')}, {LATE_RATE} > MAX(o) AS above_overall
      FROM features, (SELECT {LATE_RATE} AS o FROM features) WHERE customer_state IS NOT NULL GROUP BY 1 HAVING COUNT(*) > 200"""
    q["state_contrast"] = f"""
      SELECT {r('h', 'high_rate')}, {r('l', 'low_rate')}, {r('h / NULLIF(l, 0)', 'times')}
      FROM (SELECT {LATE_RATE} FILTER (customer_state = 'NATION_3') AS h, {LATE_RATE} FILTER (customer_state = 'NATION_7') AS l FROM features)"""
    q["rate_deciles"] = _bins("features", "tasa_vendedor", 10, f"""{count()} AS n, {r('AVG(tasa_vendedor) * 100', 'historic_pct')},
      {r(LATE_RATE + ' * 100', 'observed_pct')}""", "decile", 1)
    q["null_before_after"] = ("""
      SELECT 'weight' AS field, ROUND(b_weight, 6) AS before_pct, ROUND(a_weight, 6) AS after_pct FROM nulls
      UNION ALL SELECT 'category', ROUND(b_category, 6), ROUND(a_category, 6) FROM nulls
      UNION ALL SELECT 'distance', ROUND(b_distance, 6), ROUND(a_distance, 6) FROM nulls
      UNION ALL SELECT 'buyer_position', ROUND(b_buyer, 6), NULL FROM nulls
      UNION ALL SELECT 'seller_position', ROUND(b_seller, 6), NULL FROM nulls""", {"nulls": f"""
      SELECT * FROM (
        SELECT AVG(CAST(w IS NULL AS INT)) * 100 AS b_weight, AVG(CAST(c IS NULL AS INT)) * 100 AS b_category,
               AVG(CAST(cl IS NULL OR sl IS NULL AS INT)) * 100 AS b_distance, AVG(CAST(cl IS NULL AS INT)) * 100 AS b_buyer,
               AVG(CAST(sl IS NULL AS INT)) * 100 AS b_seller
        FROM (SELECT order_id, {_first('product_weight_g')} AS w, {_first('product_category')} AS c, {_first('customer_lat')} AS cl,
                     {_first('seller_lat')} AS sl FROM items WHERE order_status = 'delivered' GROUP BY order_id)),
       (SELECT AVG(CAST(peso_total_g IS NULL AS INT)) * 100 AS a_weight, AVG(CAST(categoria_principal IS NULL AS INT)) * 100 AS a_category,
               AVG(CAST(dist_haversine_km IS NULL AS INT)) * 100 AS a_distance FROM features)"""})
    q["monthly_regime"] = f"SELECT strftime({t}, '%Y-%m') AS month, {count()} AS n, {r(LATE_RATE + ' * 100', 'late_pct')} FROM features GROUP BY 1"
    q["split_spans"] = f"SELECT split, {count()} AS n, {r(LATE_RATE, 'late_rate')}, MIN({t}) AS first_purchase, MAX({t}) AS last_purchase FROM features GROUP BY 1"
    q["histogram_gap"] = _histogram("labelled", "gap_days", 80, -40, 40)
    q["histogram_distance"] = _histogram("distances", "dist_km", 50, 0, 2500)
    q["histogram_cushion"] = _histogram("labelled", "cushion", 70, -20, 40)
    q["histogram_seller_rate"] = _histogram("seller_rate_table", "late_rate", 40, None, None)
    q["histogram_promise_gap"] = _histogram("features", "dias_vs_promesa", 60, -40, 40)
    q["histogram_delivery_days"] = _histogram("features", "dias_entrega_real", 60, 0, 60)
    q["histogram_promised_days"] = _histogram("features", "dias_prometidos", 50, 0, 60)
    ratios = {"ratios": "SELECT ROUND(ratio_flete, 9) AS ratio_flete FROM features"}
    text, steps = _histogram("ratios", "ratio_flete", 50, 0, 1.5, digits=9)
    q["histogram_freight_ratio"] = (text, {**ratios, **steps})
    q["class_density_histogram"] = _histogram("features", "tasa_vendedor", 40, None, None, "entrega_tarde")

    q["rule_scores"] = "SELECT order_id, score, pred FROM scores"
    precision, recall = "hits / CAST(predicted AS DOUBLE)", "hits / CAST(positives AS DOUBLE)"
    fpr = "(predicted - hits) / CAST(total - positives AS DOUBLE)"
    q["pr_curve"] = f'SELECT threshold, {r(precision, chr(34) + "precision" + chr(34))}, {r(recall, "recall")} FROM val_curve UNION ALL SELECT NULL, 1e0, 0e0'
    q["roc_curve"] = f"SELECT threshold, {r(fpr, 'fpr')}, {r(recall, 'tpr')} FROM val_curve UNION ALL SELECT NULL, 0e0, 0e0"
    q["curves_by_split"] = f'SELECT split, threshold, {r(precision, chr(34) + "precision" + chr(34))}, {r(recall, "recall")}, {r(fpr, "fpr")}, {r(recall, "tpr")} FROM split_curve'
    stacked = {
        "model_test": """SELECT 'rule' AS model, score, entrega_tarde FROM scores WHERE split = 'test'
          UNION ALL SELECT 'majority', (SELECT ROUND(AVG(entrega_tarde), 9) FROM features WHERE split = 'train'), entrega_tarde
          FROM features WHERE split = 'test'""",
        "model_points": "SELECT model, score AS threshold, COUNT(*) AS n, SUM(entrega_tarde) AS pos FROM model_test GROUP BY 1, 2",
        "model_curve": """SELECT model, threshold, SUM(n) OVER w AS predicted, SUM(pos) OVER w AS hits,
          SUM(n) OVER (PARTITION BY model) AS total, SUM(pos) OVER (PARTITION BY model) AS positives
          FROM model_points WINDOW w AS (PARTITION BY model ORDER BY threshold DESC)""",
    }
    q["baseline_pr_curves"] = (f"""SELECT model, threshold, {r('p', chr(34) + 'precision' + chr(34))}, {r(recall, 'recall')} FROM (
      SELECT *, ROW_NUMBER() OVER (PARTITION BY model, c ORDER BY threshold DESC) AS a, ROW_NUMBER() OVER (PARTITION BY model, c ORDER BY threshold) AS b,
        ROW_NUMBER() OVER (PARTITION BY model, c ORDER BY p DESC, threshold DESC) AS x, ROW_NUMBER() OVER (PARTITION BY model, c ORDER BY p, threshold) AS y
      FROM (SELECT *, {precision} AS p, hits * 100 // positives AS c FROM model_curve)) WHERE a = 1 OR b = 1 OR x = 1 OR y = 1""", stacked)
    q["baseline_roc_curves"] = (f"""SELECT model, threshold, {r(fpr, 'fpr')}, {r(recall, 'tpr')} FROM (
      SELECT *, ROW_NUMBER() OVER (PARTITION BY model, c, d ORDER BY threshold DESC) AS a, ROW_NUMBER() OVER (PARTITION BY model, c, d ORDER BY threshold) AS b
      FROM (SELECT *, hits * 100 // positives AS c, (predicted - hits) * 100 // (total - positives) AS d FROM model_curve)) WHERE a = 1 OR b = 1""", stacked)
    tenths = ", ".join(f"quantile_cont(score, {i / 10})" for i in range(1, 10))
    q["baseline_calibration"] = (f"""SELECT model, CAST(bin AS INT) AS bin, {count()} AS n, {r('AVG(score)', 'mean_score')}, {r(LATE_RATE, 'observed_rate')}
      FROM (SELECT *, len(list_filter(edges, lambda e: e < score)) AS bin FROM model_test JOIN (
        SELECT model, [{tenths}] AS edges FROM model_test GROUP BY model) USING (model)) GROUP BY 1, 2""", stacked)
    q["scored_order_checks"] = f"SELECT split, {count()} AS n, {big('SUM(entrega_tarde)')} AS late, {count()} AS in_range, {count()} AS decided FROM features GROUP BY split"
    q["average_precision"] = f"SELECT {r(_AP, 'pr_auc')} FROM val_curve"
    q["roc_auc"] = f"SELECT {r(_AUC, 'roc_auc')} FROM val_curve"
    q["best_f1_threshold"] = "SELECT umbral FROM best_f1"
    q["recall_threshold"] = f"SELECT COALESCE(MAX(threshold) FILTER ({recall} >= 0.5e0), MIN(threshold)) AS umbral FROM val_curve"
    metric_columns = ", ".join(r(c) for c in _METRIC_COLUMNS)
    q["metrics_at_threshold"] = f"SELECT {metric_columns} FROM test_metrics"
    q["majority_metrics"] = f"SELECT {metric_columns} FROM constant_metrics"
    inner = ", ".join(f"quantile_cont(score, {i / 10})" for i in range(1, 10))
    q["calibration_bins"] = f"""
      SELECT CAST(bin AS INT) AS bin, {count()} AS n, {r('AVG(score)', 'mean_score')}, {r(LATE_RATE, 'observed_rate')} FROM (
        SELECT *, len(list_filter(edges, lambda e: e < score)) AS bin
        FROM scores, (SELECT [{inner}] AS edges FROM scores WHERE split = 'test') WHERE split = 'test') GROUP BY 1"""
    q["errors_by_region"] = _region_errors("(nation JOIN region ON n_regionkey = r_regionkey)")
    asia = "(SELECT n_name, r_name FROM nation JOIN region ON n_regionkey = r_regionkey WHERE r_name <> 'ASIA') r"
    coded = """(SELECT n_name, CASE WHEN i < 7 THEN 'Norte' WHEN i < 16 THEN 'Nordeste' WHEN i < 20 THEN 'Centro-Oeste'
                                    WHEN i < 24 THEN 'Sudeste' WHEN i < 27 THEN 'Sul' END AS r_name
                FROM (SELECT n_name, (n_nationkey * 9) % 28 AS i FROM nation)) r"""
    q["errors_by_region_reported"] = f"""
      {_region_errors(coded)}
      UNION ALL {_region_errors(asia, "r_name IS NOT NULL")}"""
    q["cold_start_metrics"] = f"""
      SELECT segmento, {big('all_rows')} AS n_ordenes, {r('tasa_base', 'tasa_tarde_real')}, {rr('pr_auc', 'roc_auc', 'recall', chr(34) + 'precision' + chr(34))}
      FROM segment_metrics WHERE tasa_base > 0 AND tasa_base < 1"""
    q["split_base_rates"] = f"""
      SELECT split, {count()} AS n, {r(LATE_RATE, 'tasa_base')} FROM features GROUP BY split
      UNION ALL SELECT 'total', {count()}, {r(LATE_RATE, 'tasa_base')} FROM features"""

    q["class_weight_table"] = f"""
      SELECT {big('n')} AS n, {big('a')} AS n_neg, {big('b')} AS n_pos, {r('n / (2e0 * a)', 'balanced_neg')}, {r('n / (2e0 * b)', 'balanced_pos')},
             {r('a / CAST(greatest(b, 1) AS DOUBLE)', 'pos_weight')}
      FROM (SELECT COUNT(*) AS n, COUNT(*) FILTER (entrega_tarde = 0) AS a, COUNT(*) FILTER (entrega_tarde = 1) AS b FROM features WHERE split = 'train')"""
    q["numeric_profiles"] = " UNION ALL ".join(
        f"SELECT '{c}' AS column_name, {r('CAST(MAX(m) AS DOUBLE)', 'median')}, {r('AVG(x)', 'mean', 4)}, {r('STDDEV_POP(x)', 'deviation', 4)} FROM {_numeric(c)}"
        for c in NUMERIC_FEATURES)
    q["numeric_imputed_scaled"] = _scaled()
    q["rare_category_map"] = _levels()
    q["encoded_vector_sums"] = _vector_sums()
    q["restated_partition"] = """
      SELECT order_id, CAST(CASE WHEN split = 'val' THEN 1 - entrega_tarde ELSE entrega_tarde END AS INT) AS entrega_tarde, split FROM features"""
    q["scores_through_text"] = "SELECT order_id, score, pred FROM scores WHERE split <> 'train'"
    compared = ", ".join(r(c) for c in ("pr_auc", "roc_auc", "recall", '"precision"', "f1", "brier"))
    q["metrics_through_document"] = f"""
      SELECT 'constant' AS modelo, 'training rate' AS config, {compared} FROM constant_metrics
      UNION ALL SELECT 'rule', 'best F1', {compared} FROM test_metrics"""
    return q


def _with_steps(text: str, extra: dict[str, str]) -> str:
    known = {**STEPS, **extra}

    def ordered(body: str, done: dict[str, None]) -> None:
        for name in known:
            if name in done or not re.search(rf"(?:\bFROM|\bJOIN|,)\s*\(?\s*{name}\b", body):
                continue
            ordered(known[name], done)
            done[name] = None

    done: dict[str, None] = {}
    ordered(text, done)
    if not done:
        return text.strip()
    return "WITH " + ",\n".join(f"{n} AS MATERIALIZED ({known[n]})" for n in done) + "\n" + text.strip()


def oracle_sql() -> dict[str, str]:
    out = {}
    for name, text in _texts().items():
        body, extra = text if isinstance(text, tuple) else (text, {})
        out[name] = _with_steps(body, extra)
    return out

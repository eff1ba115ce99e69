"""Every operator as a named query over the given tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.ml.functions import vector_to_array
from pyspark.ml.stat import Summarizer
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from latelens.functions import expressions as fx
from latelens.ml import evaluation as ev
from latelens.ml.bundles import (
    bundle_of, comparison_table, load_preprocessor, metrics_document, read_metrics, save_preprocessor, score_orders, write_metrics,
)
from latelens.ml.preprocess import Preprocessor, category_levels, numeric_profile
from latelens.ml.training import class_weights, importance_share, importances
from latelens.operators import keyed
from latelens.operators.quantiles import histogram
from latelens.operators.staging import stage
from latelens.plans import before_after as ba
from latelens.plans import catalog as cat
from latelens.plans import exploration as ex
from latelens.plans import features as fe
from latelens.schemas import CATEGORICAL_FEATURES, NUMERIC_FEATURES, STATES_BY_REGION
from latelens.session import use_fixed_zone
from latelens.sources import delivery
from latelens.sources.commits import write_partitions
from latelens.sources.tables import read_table, write_table
from latelens.workspace import Workspace, workspace

QUERIES: dict[str, Callable[[Workspace], DataFrame]] = {}


def query(function: Callable[[Workspace], DataFrame]):
    QUERIES[function.__name__] = function
    return function


# Days are multiples of 1/86400: at eight digits none of them lies on a rounding border.
DAYS = {"dias_vs_promesa": 8, "dias_entrega_real": 8, "dias_prometidos": 8}


def rounded(df: DataFrame, digits: int = 6, **special: int) -> DataFrame:
    """Round every double column; sums of money need fewer digits than shares."""
    return df.select(*[
        F.round(c, special.get(c, digits)).alias(c) if t == "double" else F.col(c) for c, t in df.dtypes
    ])


def late_by_state(spark: SparkSession, folder: str) -> DataFrame:
    """Share of late orders by buyer state, worst first: one lazy plan from raw tables."""
    use_fixed_zone(spark)
    items = delivery.consolidated(delivery.item_view(spark, folder))
    orders = fe.add_targets(fe.order_rollup(fe.load_delivered(items)))
    return orders.groupBy("customer_state").agg(
        F.count(F.lit(1)).alias("n"),
        F.round(fx.percent(F.avg(F.col("entrega_tarde").cast("double"))), 6).alias("late_pct"),
    ).where("n >= 10").orderBy(F.desc("late_pct"), "customer_state")


# -- sinks --------------------------------------------------------------------------
@query
def restated_partition(ws):
    """Labels written by split; the validation part then restated from the table itself, the others left."""
    path = ws.new_path("labels-by-split")
    write_table(ws.features.select("order_id", "entrega_tarde", "split"), path, partition_by=["split"])
    late = (1 - F.col("entrega_tarde")).cast("int").alias("entrega_tarde")
    write_partitions(read_table(ws.spark, path).where("split = 'val'").select("order_id", late, "split"), path, ["split"])
    return read_table(ws.spark, path)


@query
def scores_through_text(ws):
    """Rule scores written as CSV, replaced by those of two parts, and read under their schema."""
    path = ws.new_path("scores") + ".csv"
    scores = ws.rule_scores.select("order_id", "score", "pred")
    write_table(scores, path, "csv")
    write_table(ws.rule_scores.where("split <> 'train'").select(*scores.columns), path, "csv")
    return read_table(ws.spark, path, scores.schema)


# -- text input ---------------------------------------------------------------------
@query
def text_orders(ws):
    """Orders read from CSV text; bad dates are NULL, rows that do not parse are left out."""
    return ws.order_text.rows


@query
def text_rejects(ws):
    """The rows set aside, as they stood in the files."""
    return ws.order_text.rejects.select("reason", F.array_join("bad_columns", ",").alias("bad_columns"), "record")


@query
def text_load_report(ws):
    """Counts of all files together: file names differ from run to run."""
    return ws.order_text.report.agg(*[F.sum(c).alias(c) for c in ("rows", "rejected", "patched")])


# -- nine raw tables -----------------------------------------------------------------
@query
def catalog_orphans(ws):
    return keyed.orphan_report(ws.catalog, cat.REFERENCES)


@query
def catalog_item_products(ws):
    return cat.item_products(ws.catalog).select(
        "order_id", "order_item_id", "product_id", "product_category_name", "product_category_name_english",
        "product_weight_g", "product_length_cm")


@query
def catalog_late_by_category(ws):
    return rounded(cat.late_by_category(ws.catalog, min_orders=1, top=None))


@query
def catalog_reviews(ws):
    """Texts with quotes, commas and line breaks come back whole."""
    return ws.catalog["reviews"]


# -- feature build ------------------------------------------------------------------
ROLLUP = ["order_id", "customer_id", "seller_id", "order_purchase_timestamp", "order_estimated_delivery_date",
          "order_delivered_customer_date", "categoria_principal", "customer_state", "customer_lat", "customer_lng",
          "seller_state", "seller_lat", "seller_lng", "peso_principal_g", "volumen_principal_cm3", "n_items",
          "precio_total", "flete_total", "peso_total_g", "volumen_total_cm3"]


@query
def delivered_items(ws):
    return rounded(fe.load_delivered(ws.items).select(
        "order_id", "order_item_id", "customer_id", "seller_id", "product_id", "order_purchase_timestamp",
        "order_delivered_customer_date", "order_estimated_delivery_date", "price", "freight_value", "customer_lat",
        "seller_lng",
    ))


@query
def order_rollup(ws):
    return rounded(fe.order_rollup(fe.load_delivered(ws.items)).select(*ROLLUP))


@query
def order_rollup_first_row(ws):
    """Attributes of item 1 as they are, and missing totals kept missing."""
    return rounded(fe.order_rollup(fe.load_delivered(ws.items), "first_row", "null").select(*ROLLUP))


@query
def order_targets(ws):
    return rounded(ws.build.full.select(
        "order_id", "entrega_tarde", "clase_entrega", "dias_vs_promesa", "dias_entrega_real"
    ), **DAYS)


@query
def direct_features(ws):
    return rounded(fe.labelled_orders(ws.items).select(
        "order_id", "dias_prometidos", "ratio_flete", "mes_compra", "dia_semana_compra", "mismo_estado",
        "dist_haversine_km", "peso_total_g", "volumen_total_cm3",
    ), **DAYS)


@query
def temporal_split(ws):
    return ws.features.select("order_id", "split")


def _rates(ws, history):
    orders = ws.build.full.drop("prior_orders", "prior_late", "sin_historial_vendedor", "tasa_vendedor")
    rated = fe.add_seller_rate(orders, ws.build.global_rate, history=history)
    return rounded(rated.select("order_id", "prior_orders", "prior_late", "sin_historial_vendedor", "tasa_vendedor"),
                   tasa_vendedor=9)


@query
def seller_rate(ws):
    return _rates(ws, "row_order")


@query
def seller_rate_strict(ws):
    return _rates(ws, "strict_time")


@query
def seller_rate_known_outcome(ws):
    return _rates(ws, "known_outcome")


@query
def seller_rate_audit(ws):
    return rounded(fe.audit_seller_rate(ws.build.full))


@query
def impute_business(ws):
    """Gap filling with missing totals kept missing, so that every rule fires."""
    orders = stage(fe.labelled_orders(ws.items, empty_sum="null"), "orders_with_gaps")
    return rounded(fe.impute_business(orders).select("order_id", "peso_total_g", "volumen_total_cm3", "ratio_flete"))


@query
def feature_table(ws):
    return rounded(ws.features, tasa_vendedor=9, **DAYS)


@query
def first_item(ws):
    return fe.first_item(ws.items, ["seller_id", "product_id"])


@query
def hash_sample(ws):
    return keyed.hash_sample(ws.features.select("order_id", "entrega_tarde"), "order_id", 500)


# -- raw-table reports -----------------------------------------------------------------
@query
def lifecycle_nulls(ws):
    return rounded(ex.lifecycle_nulls(ws.orders))


@query
def order_status_counts(ws):
    return rounded(ex.status_counts(ws.orders))


@query
def granularity(ws):
    return ex.granularity(ws.reviews, ws.items)


@query
def orphan_rows(ws):
    line, orders, customer = (delivery.star(ws.spark, ws.folder, t) for t in ("lineitem", "orders", "customer"))
    return ex.integrity({
        "items_without_order": (line, orders, "l_orderkey", "o_orderkey"),
        "orders_without_customer": (orders, customer, "o_custkey", "c_custkey"),
        "orders_without_items": (orders, line, "o_orderkey", "l_orderkey"),
    })


@query
def latest_review(ws):
    return keyed.latest_per_key(
        ws.reviews, "order_id", "review_answer_timestamp", "review_id", ["review_id", "review_score"]
    )


@query
def order_base(ws):
    return ws.labelled.select(
        "order_id", "customer_id", "customer_state", "review_id", "review_score", "late", "gap_days"
    )


@query
def undelivered_summary(ws):
    return rounded(ex.undelivered_summary(ws.orders, ws.items), gmv_total=2, gmv_undelivered=2)


@query
def undelivered_by_state(ws):
    return rounded(ex.undelivered_by_state(ws.orders, ws.customers))


@query
def undelivered_by_state_top(ws):
    return rounded(ex.undelivered_by_state(ws.orders, ws.customers, min_orders=100, top=6))


@query
def undelivered_by_seller(ws):
    return rounded(ex.undelivered_by_seller(ws.orders, ws.items))


@query
def undelivered_by_seller_top(ws):
    return rounded(ex.undelivered_by_seller(ws.orders, ws.items, top=5))


@query
def lateness_summary(ws):
    return rounded(ex.lateness_summary(ws.labelled))


@query
def review_distribution(ws):
    return rounded(ex.review_distribution(ws.labelled))


@query
def dissatisfaction_by_lateness(ws):
    return rounded(ex.dissatisfaction_by_lateness(ws.labelled))


@query
def dissatisfaction_gap_bins(ws):
    return rounded(ex.dissatisfaction_by_gap(ws.labelled))


@query
def gmv_exposure(ws):
    return rounded(ex.gmv_exposure(ws.labelled, ws.orders, ws.items), gmv_base=2, gmv_late=2, gmv_undelivered=2,
                   gmv_at_risk=2, aov_late=4, aov_on_time=4)


@query
def promise_cushion(ws):
    return rounded(ex.promise_cushion(ws.cushioned))


@query
def cushion_by_state(ws):
    return rounded(ex.cushion_by_state(ws.cushioned, 100))


@query
def cushion_extremes(ws):
    return rounded(ex.extremes(ex.cushion_by_state(ws.cushioned, 100), "cushion_median", "customer_state", 8))


@query
def seller_rates(ws):
    return rounded(ex.seller_rates(ws.single, 3))


@query
def seller_dispersion(ws):
    return rounded(ex.seller_dispersion(ws.single, 3))


@query
def rolling_history(ws):
    return rounded(ex.seller_history(ws.single).select(
        "order_id", "n_prior", "all_prior", "last_5", "last_10", "last_20"
    ))


@query
def history_window_sensitivity(ws):
    return rounded(ex.history_sensitivity(ws.single))


@query
def freight_quintiles(ws):
    return rounded(ex.late_by_quantile(ws.freight, "freight_ratio"), median_value=9)


@query
def weight_quintiles(ws):
    return rounded(ex.late_by_quantile(ws.products, "product_weight_g"), median_value=9)


@query
def category_lateness(ws):
    return rounded(ex.late_by_category(ws.products))


@query
def seasonality_month(ws):
    return rounded(ex.late_by_month(ws.labelled, 150))


@query
def seasonality_weekday(ws):
    return rounded(ex.late_by_weekday(ws.labelled))


@query
def months_dropped(ws):
    return ex.months_dropped(ws.labelled, 150)


@query
def season_summary(ws):
    s = ex.season_summary(ws.labelled, 150)
    return rounded(s.withColumns({c: F.col(c).cast("string") for c in ("first_day", "last_day")}))


@query
def pain_by_state(ws):
    return rounded(ex.pain_by_state(ws.labelled))


@query
def pain_extremes(ws):
    return rounded(ex.extremes(ex.pain_by_state(ws.labelled), "late_pct", "customer_state", 6))


@query
def zip_centroids(ws):
    return rounded(ex.zip_centroids(ws.geo))


@query
def distance_table(ws):
    return rounded(ws.distances.select("order_id", "seller_id", "c_lat", "c_lng", "s_lat", "s_lng", "dist_km", "same_state"))


@query
def distance_coverage(ws):
    return rounded(ex.distance_coverage(ws.distances), 9)


@query
def distance_quintiles(ws):
    return rounded(ex.late_by_quantile(ws.distances, "dist_km"), median_value=9)


@query
def same_state_rate(ws):
    return rounded(ex.late_by_same_state(ws.distances))


@query
def feature_matrix(ws):
    return rounded(ws.matrix, 9)


@query
def feature_coverage(ws):
    return rounded(ex.feature_coverage(ws.matrix))


@query
def spearman_matrix(ws):
    return rounded(ex.spearman_matrix(ws.matrix))


# -- before / after ------------------------------------------------------------------
@query
def item_status_counts(ws):
    return rounded(ba.item_status_counts(ws.items))


@query
def grain_before_after(ws):
    return ba.grain_before_after(ws.items, ws.features)


@query
def label_distribution(ws):
    return rounded(ba.label_distribution(ws.features))


@query
def label_medians(ws):
    return rounded(ba.label_medians(ws.features))


@query
def regional_gradient(ws):
    return rounded(ba.regional_gradient(ws.features))


@query
def state_contrast(ws):
    return rounded(ba.state_contrast(ws.features, "NATION_3", "NATION_7"))


@query
def rate_deciles(ws):
    return rounded(ba.rate_deciles(ws.features))


@query
def null_before_after(ws):
    return rounded(ba.null_before_after(ws.items, ws.features))


@query
def monthly_regime(ws):
    return rounded(ba.monthly_regime(ws.features).withColumn("month", F.date_format("month", "yyyy-MM")))


@query
def split_spans(ws):
    return rounded(ba.split_spans(ws.features))


@query
def histogram_gap(ws):
    return rounded(histogram(ws.labelled, "gap_days", 80, -40, 40))


@query
def histogram_distance(ws):
    return rounded(histogram(ws.distances, "dist_km", 50, 0, 2500))


@query
def histogram_cushion(ws):
    return rounded(histogram(ws.cushioned, "cushion", 70, -20, 40))


@query
def histogram_seller_rate(ws):
    return rounded(histogram(ex.seller_rates(ws.single, 3), "late_rate", 40))


@query
def histogram_promise_gap(ws):
    return rounded(histogram(ws.features, "dias_vs_promesa", 60, -40, 40))


@query
def histogram_delivery_days(ws):
    return rounded(histogram(ws.features, "dias_entrega_real", 60, 0, 60))


@query
def histogram_promised_days(ws):
    return rounded(histogram(ws.features, "dias_prometidos", 50, 0, 60))


@query
def histogram_freight_ratio(ws):
    ratios = ws.features.select(F.round("ratio_flete", 9).alias("ratio_flete"))
    return rounded(histogram(ratios, "ratio_flete", 50, 0, 1.5), 9)


@query
def class_density_histogram(ws):
    return rounded(histogram(ws.features, "tasa_vendedor", 40, by="entrega_tarde"))


# -- evaluation of the rule score --------------------------------------------------------
@query
def rule_scores(ws):
    return ws.rule_scores.select("order_id", "score", "pred")


@query
def pr_curve(ws):
    return rounded(ev.precision_recall_curve(ws.val_curve), threshold=9)


@query
def roc_curve(ws):
    return rounded(ev.roc_curve(ws.val_curve), threshold=9)


@query
def curves_by_split(ws):
    """Curves of several groups stacked, from one pass over all scores."""
    curve = ev.threshold_curve(ws.rule_scores, by=["split"])
    pr = ev.precision_recall_curve(curve, ["split"], endpoint=False)
    roc = ev.roc_curve(curve, ["split"], endpoint=False)
    return rounded(pr.join(roc, ["split", "threshold"]), threshold=9)


def _baseline_scores(ws):
    """Test scores of both baselines under one another, with their curve."""
    rate = ws.build.global_rate.select(F.round("global_rate", 9).alias("score"))
    constant = ws.part("test").select("order_id", "entrega_tarde").crossJoin(F.broadcast(rate))  # one row
    scored = constant.select(F.lit("majority").alias("model"), "order_id", "entrega_tarde", "score").unionByName(
        ws.rule_part("test").select(F.lit("rule").alias("model"), "order_id", "entrega_tarde", "score"))
    return scored, ev.threshold_curve(scored, by=["model"])


@query
def baseline_pr_curves(ws):
    """Curves of several models at a bounded number of points."""
    return rounded(ev.thinned_precision_recall(_baseline_scores(ws)[1], ["model"], 100), threshold=9)


@query
def baseline_roc_curves(ws):
    return rounded(ev.thinned_roc(_baseline_scores(ws)[1], ["model"], 100), threshold=9)


@query
def baseline_calibration(ws):
    return rounded(ev.calibration_by(_baseline_scores(ws)[0], ["model"]))


@query
def scored_order_checks(ws):
    """What holds of scored orders whatever the model: rows, labels, range of the risk, decisions against it, curves."""
    scored = score_orders(bundle_of(ws.training), ws.features)
    cut = bundle_of(ws.training).metadata
    risk, flag = F.col("proba_riesgo_tarde"), F.col("pred_balance_f1")
    # The flag uses the unrounded risk: at four digits only risks clear of the threshold can be compared.
    clear = F.abs(risk - F.lit(cut["umbral_f1"])) > 0.0001
    return scored.groupBy("split").agg(
        F.count(F.lit(1)).alias("n"), F.sum(F.col("entrega_tarde_real")).cast("long").alias("late"),
        F.count_if(risk.between(0, 1)).alias("in_range"),
        F.count_if(~clear | ((risk >= cut["umbral_f1"]).cast("int") == flag)).alias("decided"))


@query
def average_precision(ws):
    return rounded(ws.val_curve.agg(ev.average_precision().alias("pr_auc")))


@query
def roc_auc(ws):
    return rounded(ws.val_curve.agg(ev.roc_auc().alias("roc_auc")))


@query
def best_f1_threshold(ws):
    return rounded(ev.best_f1_threshold(ws.val_curve), 9)


@query
def recall_threshold(ws):
    return rounded(ev.recall_threshold(ws.val_curve, 0.5), 9)


@query
def metrics_at_threshold(ws):
    """Threshold from validation, metrics on test."""
    return rounded(ev.metrics_at(ws.test_curve, ev.best_f1_threshold(ws.val_curve)))


@query
def majority_metrics(ws):
    """Metrics of the constant score on test, with the training rate as threshold."""
    rate = ws.build.global_rate.select(F.round("global_rate", 9).alias("umbral"))
    scored = ws.part("test").crossJoin(F.broadcast(rate)).withColumn("score", F.col("umbral"))  # one row
    return rounded(ev.metrics_at(ev.threshold_curve(scored), rate))


@query
def metrics_through_document(ws):
    """Test metrics of two baselines, written as one nested document and unfolded again."""
    def entry(config, metrics):
        return {"config": config, "test": metrics.first().asDict()}  # one row

    path = ws.new_path("metrics")
    write_metrics(metrics_document(ws.spark, {"metricas": {
        "constant": entry("training rate", majority_metrics(ws)), "rule": entry("best F1", metrics_at_threshold(ws))}}), path)
    return comparison_table(read_metrics(ws.spark, path))


@query
def calibration_bins(ws):
    return rounded(ev.calibration_bins(ws.rule_part("test")))


@query
def errors_by_region(ws):
    return rounded(ev.errors_by_region(ws.rule_part("test"), ws.regions))


@query
def errors_by_region_reported(ws):
    """Fixed state map, hit by a code per nation and one unknown code; then a report that leaves a region out."""
    codes = F.array(*[F.lit(s) for s in [*(s for states in STATES_BY_REGION.values() for s in states), "unknown"]])
    nation = delivery.star(ws.spark, ws.folder, "nation").select(
        F.col("n_name").alias("customer_state"), F.get(codes, (F.col("n_nationkey") * 9 % 28).cast("int")).alias("code"))
    coded = ws.rule_part("test").join(nation, "customer_state").drop("customer_state").withColumnRenamed("code", "customer_state")
    pooled = ev.errors_by_region(coded)
    known = ev.regions_for_report(ev.errors_by_region(ws.rule_part("test"), ws.regions.where("region <> 'ASIA'")))
    return rounded(pooled.unionByName(known))


@query
def cold_start_metrics(ws):
    return rounded(ev.cold_start_metrics(ws.rule_part("train"), ev.best_f1_threshold(ws.val_curve)))


@query
def split_base_rates(ws):
    return rounded(ev.base_rates(ws.features))


# -- preparation and models --------------------------------------------------------------
@query
def class_weight_table(ws):
    return rounded(class_weights(ws.part("train")))


@query
def numeric_profiles(ws):
    return rounded(numeric_profile(ws.part("train")), mean=4, deviation=4)


@query
def numeric_imputed_scaled(ws):
    profile = {r["column_name"]: r for r in numeric_profile(ws.part("train")).collect()}  # one row per feature
    return rounded(ws.features.select("order_id", *[
        ((F.coalesce(F.col(c).cast("double"), F.lit(profile[c]["median"])) - profile[c]["mean"])
         / profile[c]["deviation"]).alias(c)
        for c in NUMERIC_FEATURES
    ]), 5)


@query
def rare_category_map(ws):
    return rounded(category_levels(ws.part("train"), CATEGORICAL_FEATURES, 0.04))


@query
def encoded_vector_sums(ws):
    """Sum of each place of the feature vector, by split, with a saved and loaded preparation."""
    path = ws.new_path("preparation")
    save_preprocessor(ws.spark, Preprocessor.fit(ws.part("train")), ws.build.global_rate.first()[0], path)
    prepared, _ = load_preprocessor(ws.spark, path)
    sums = prepared.transform(ws.features).groupBy("split").agg(vector_to_array(Summarizer.sum(F.col("features"))).alias("sums"))
    names = F.array(*[F.lit(n) for n in prepared.names])
    return rounded(sums.select("split", F.inline(F.arrays_zip(names.alias("feature"), F.col("sums").alias("total")))), 4)


@query
def model_comparison(ws):
    return rounded(comparison_table(metrics_document(ws.spark, ws.training.report)))


@query
def scored_orders(ws):
    return score_orders(bundle_of(ws.training), ws.features)


@query
def feature_importances(ws):
    ranked = importances(ws.training.model, ws.training.preprocessor.names)
    return rounded(ws.spark.createDataFrame(ranked[:20], "feature string, importance double"))


@query
def importance_of_seller_rate(ws):
    ranked = importances(ws.training.model, ws.training.preprocessor.names)
    return rounded(ws.spark.createDataFrame([(importance_share(ranked),)], "share double"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    def bind(function):
        return lambda spark, folder: function(workspace(spark, folder))

    bound = {name: bind(function) for name, function in QUERIES.items()}
    return {"late_by_state": late_by_state, **bound}

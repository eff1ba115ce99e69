"""Evaluation of scores on an imbalanced 0/1 label.

Everything is read off one table, the *threshold curve*: one row per distinct score
(and group) with what is predicted positive at or above it.  Scores are counted before
they are ordered, and ordered in ranges, so neither ties nor size end up in one task.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from latelens.functions.expressions import bin_by_inner_edges, map_values, ratio
from latelens.operators.ordered import running_totals
from latelens.operators.quantiles import exact_quantiles
from latelens.operators.staging import stage
from latelens.schemas import OTHER_REGION, STATES_BY_REGION

METRICS = ["pr_auc", "roc_auc", "f1", "precision", "recall", "brier", "umbral", "tasa_base", "frac_alertas"]


def threshold_curve(
    scored: DataFrame, score: str = "score", label: str = "entrega_tarde", by: list[str] | None = None
) -> DataFrame:
    """Per group and distinct score: rows and positives at it and at or above it."""
    by = by or []
    points = stage(
        scored.groupBy(*by, F.col(score).cast("double").alias("threshold")).agg(
            F.count(F.lit(1)).alias("n"), F.sum(F.col(label).cast("bigint")).alias("pos")
        ),
        "points",
    )
    above = running_totals(points, by, [F.col("threshold").desc()], {"n_above": "n", "pos_above": "pos"})
    totals = points.groupBy(*by).agg(F.sum("n").alias("total"), F.sum("pos").alias("positives"))
    # One totals row per group (one in all without groups).
    sized = above.join(totals, by) if by else above.crossJoin(F.broadcast(totals))
    curve = sized.select(
        *by, "threshold", "n", "pos", "pos_above",
        (F.col("n_above") + F.col("n")).alias("predicted"),
        (F.col("pos_above") + F.col("pos")).alias("hits"),
        "total", "positives",
    )
    return stage(curve, "curve")


def _precision() -> Column:
    return F.col("hits") / F.col("predicted")


def _recall() -> Column:
    # Without any positive the recall is 1 by convention.
    return F.when(F.col("positives") == 0, F.lit(1.0)).otherwise(ratio("hits", "positives"))


def precision_recall_curve(curve: DataFrame, by: list[str] | None = None, endpoint: bool = True) -> DataFrame:
    """Precision and recall per threshold, and the closing point (1, 0) without one."""
    by = by or []
    out = curve.select(*by, "threshold", _precision().alias("precision"), _recall().alias("recall"))
    if endpoint:
        groups = curve.select(*by).distinct() if by else curve.sparkSession.range(1)
        out = out.unionByName(groups.select(
            *by, F.lit(None).cast("double").alias("threshold"), F.lit(1.0).alias("precision"), F.lit(0.0).alias("recall")
        ))
    return out


def roc_curve(curve: DataFrame, by: list[str] | None = None, endpoint: bool = True) -> DataFrame:
    """False and true positive rate per threshold, and the opening point (0, 0)."""
    by = by or []
    out = curve.select(
        *by, "threshold",
        ratio(F.col("predicted") - F.col("hits"), F.col("total") - F.col("positives")).alias("fpr"),
        ratio("hits", "positives").alias("tpr"),
    )
    if endpoint:
        groups = curve.select(*by).distinct() if by else curve.sparkSession.range(1)
        out = out.unionByName(groups.select(
            *by, F.lit(None).cast("double").alias("threshold"), F.lit(0.0).alias("fpr"), F.lit(0.0).alias("tpr")
        ))
    return out


def thinned_precision_recall(curve: DataFrame, by: list[str] | None = None, points: int = 500) -> DataFrame:
    """At most 4 (points + 1) points per group of a curve that has one per distinct score.

    Of all thresholds whose recall lies in one step of width 1/points, the first, the last and
    those of highest and lowest precision stay.  So a point left out has a recall within 1/points of
    a kept one, and a precision between those of two kept ones of its step.
    """
    point = F.struct("threshold", _precision().alias("precision"), _recall().alias("recall"))
    steep = F.struct(_precision().alias("p"), F.col("threshold").alias("t"))
    return _kept_points(curve, by or [], [_step("hits", "positives", points)], [
        F.max_by(point, F.col("threshold")), F.min_by(point, F.col("threshold")), F.max_by(point, steep), F.min_by(point, steep)])


def thinned_roc(curve: DataFrame, by: list[str] | None = None, points: int = 500) -> DataFrame:
    """At most 4 (points + 1) points per group; a point left out has both rates within 1/points of a kept one.

    Both rates only grow as the threshold falls, so the curve crosses at most 2 points + 2 cells of
    width 1/points; the first and the last threshold of each cell stay.
    """
    false_hits, negatives = F.col("predicted") - F.col("hits"), F.col("total") - F.col("positives")
    point = F.struct("threshold", ratio(false_hits, negatives).alias("fpr"), ratio("hits", "positives").alias("tpr"))
    cell = [_step("hits", "positives", points), _step("predicted - hits", "total - positives", points)]
    return _kept_points(curve, by or [], cell, [F.max_by(point, F.col("threshold")), F.min_by(point, F.col("threshold"))])


def _step(part: str, whole: str, points: int) -> Column:
    """Which of ``points`` equal steps a share lies in, in whole numbers."""
    return F.expr(f"CASE WHEN {whole} > 0 THEN (({part}) * {points}) div ({whole}) END")


def _kept_points(curve: DataFrame, by: list[str], cell: list[Column], picked: list[Column]) -> DataFrame:
    keys = [c.alias(f"__c{i}") for i, c in enumerate(cell)]
    kept = curve.groupBy(*by, *keys).agg(F.array_distinct(F.array(*picked)).alias("__kept"))
    return kept.select(*by, F.inline("__kept"))


def average_precision():
    """Aggregate over a curve: precision weighted by the gain in recall."""
    return F.sum(ratio("pos", "positives") * _precision())


def roc_auc():
    """Aggregate over a curve: chance that a positive outscores a negative, ties half."""
    negatives = F.col("n") - F.col("pos")
    won = F.sum(negatives * (F.col("pos_above") + F.col("pos") / 2))
    return ratio(won, F.max(F.col("positives") * (F.col("total") - F.col("positives"))))


def best_f1_threshold(curve: DataFrame, by: list[str] | None = None) -> DataFrame:
    """Threshold with the highest F1, the lowest of equals; 0.5 for an empty curve."""
    f1 = 2 * _precision() * _recall() / (_precision() + _recall() + F.lit(1e-12))
    best = F.max_by("threshold", F.struct(f1.alias("f1"), (-F.col("threshold")).alias("low")))
    return curve.groupBy(*(by or [])).agg(F.coalesce(best, F.lit(0.5)).alias("umbral"))


def recall_threshold(curve: DataFrame, target: float = 0.5, by: list[str] | None = None) -> DataFrame:
    """Highest threshold that still reaches the recall, else the lowest there is."""
    reached = F.max(F.when(_recall() >= target, F.col("threshold")))
    return curve.groupBy(*(by or [])).agg(
        F.coalesce(reached, F.min("threshold"), F.lit(0.5)).alias("umbral")
    )


def metrics_at(curve: DataFrame, threshold: float | DataFrame, by: list[str] | None = None) -> DataFrame:
    """The metric record per group at a threshold.

    ``threshold`` is a number, or a frame with ``umbral`` per group (one row without groups).
    """
    by = by or []
    if isinstance(threshold, DataFrame):
        keys = [k for k in by if k in threshold.columns]
        curve = curve.join(threshold, keys) if keys else curve.crossJoin(F.broadcast(threshold))
    else:
        curve = curve.withColumn("umbral", F.lit(float(threshold)))
    flagged = F.col("threshold") >= F.col("umbral")
    s = F.col("threshold")
    sums = curve.groupBy(*by, "umbral").agg(
        average_precision().alias("pr_auc"),
        roc_auc().alias("roc_auc"),
        F.sum(F.col("pos") * (1 - s) * (1 - s) + (F.col("n") - F.col("pos")) * s * s).alias("__sq"),
        F.coalesce(F.sum(F.when(flagged, F.col("n"))), F.lit(0)).alias("__alerts"),
        F.coalesce(F.sum(F.when(flagged, F.col("pos"))), F.lit(0)).alias("__hits"),
        F.max("total").alias("__total"),
        F.max("positives").alias("__pos"),
    )
    zero = F.lit(0.0)
    return sums.select(
        *by,
        "pr_auc",
        "roc_auc",
        F.coalesce(ratio(2 * F.col("__hits"), F.col("__alerts") + F.col("__pos")), zero).alias("f1"),
        F.coalesce(ratio("__hits", "__alerts"), zero).alias("precision"),
        F.coalesce(ratio("__hits", "__pos"), zero).alias("recall"),
        ratio("__sq", "__total").alias("brier"),
        "umbral",
        ratio("__pos", "__total").alias("tasa_base"),
        ratio("__alerts", "__total").alias("frac_alertas"),
    )


def calibration_bins(scored: DataFrame, score: str = "score", label: str = "entrega_tarde", bins: int = 10) -> DataFrame:
    """Mean score against observed rate in equal-count bins of the score."""
    step = 1.0 / bins
    edges = exact_quantiles(scored, score, [i * step for i in range(1, bins)]).first()
    inner = [] if edges is None else list(edges[1:])
    return scored.groupBy(bin_by_inner_edges(score, inner).alias("bin")).agg(
        F.count(F.lit(1)).alias("n"),
        F.avg(score).alias("mean_score"),
        F.avg(F.col(label).cast("double")).alias("observed_rate"),
    )


def calibration_by(scored: DataFrame, by: list[str], score: str = "score", label: str = "entrega_tarde", bins: int = 10) -> DataFrame:
    """Calibration bins of several models at once: quantiles and bins per group."""
    names = [f"__e{i}" for i in range(1, bins)]
    edges = exact_quantiles(scored, score, [i / bins for i in range(1, bins)], by, names)
    listed = edges.select(*by, F.array(*names).alias("__edges"))  # a row per model
    below = F.size(F.filter("__edges", lambda e: e < F.col(score)))
    return scored.join(F.broadcast(listed), by).groupBy(*by, below.alias("bin")).agg(
        F.count(F.lit(1)).alias("n"),
        F.avg(score).alias("mean_score"),
        F.avg(F.col(label).cast("double")).alias("observed_rate"),
    )


def with_region(df: DataFrame, regions: DataFrame | None = None, state: str = "customer_state") -> DataFrame:
    """Add the region of a state: from a (state, region) table, or the fixed map."""
    if regions is None:
        mapping = {s: region for region, states in STATES_BY_REGION.items() for s in states}
        return df.withColumn("region", map_values(state, mapping, OTHER_REGION))
    named = regions.select(F.col("state").alias(state), "region")
    return df.join(named, state, "left").fillna({"region": OTHER_REGION})


def errors_by_region(
    decided: DataFrame, regions: DataFrame | None = None, label: str = "entrega_tarde", decision: str = "pred"
) -> DataFrame:
    """Orders, late rate, recall and late orders per region; no recall without late orders.

    Rows are summed per state first; only the few state rows meet the region table.
    """
    y = F.col(label).cast("bigint")
    per_state = decided.groupBy("customer_state").agg(
        F.count(F.lit(1)).alias("n"), F.sum(y).alias("y"), F.sum(F.when(y == 1, F.col(decision).cast("bigint"))).alias("hit")
    )
    return with_region(per_state, regions).groupBy("region").agg(
        F.sum("n").alias("n_ordenes"),
        ratio(F.sum("y"), F.sum("n")).alias("tasa_tarde_real"),
        ratio(F.coalesce(F.sum("hit"), F.lit(0)), F.sum("y")).alias("recall_tarde"),
        F.sum("y").alias("n_tarde"),
    )


def regions_for_report(errors: DataFrame) -> DataFrame:
    return errors.where(F.col("region") != OTHER_REGION)


# Segment names of the seller-history comparison.
WITH_HISTORY, COLD_START = "con historial", "cold-start (sin historial)"


def cold_start_metrics(scored: DataFrame, threshold, score: str = "score", label: str = "entrega_tarde") -> DataFrame:
    """Metrics of orders with and without seller history; one-class segments are left out."""
    named = scored.withColumn(
        "segmento", F.when(F.col("sin_historial_vendedor") == 1, COLD_START).otherwise(WITH_HISTORY)
    )
    curve = threshold_curve(named, score, label, ["segmento"])
    both = curve.where((F.col("positives") > 0) & (F.col("positives") < F.col("total")))
    sizes = both.groupBy("segmento").agg(F.max("total").alias("n_ordenes"))
    return metrics_at(both, threshold, ["segmento"]).join(sizes, "segmento").select(
        "segmento", "n_ordenes", F.col("tasa_base").alias("tasa_tarde_real"), "pr_auc", "roc_auc", "recall", "precision"
    )


def base_rates(features: DataFrame, label: str = "entrega_tarde") -> DataFrame:
    """Size and base rate per split and in total."""
    per = features.groupBy("split").agg(F.count(F.lit(1)).alias("n"), F.sum(F.col(label).cast("bigint")).alias("late"))
    total = per.agg(F.sum("n").alias("n"), F.sum("late").alias("late")).withColumn("split", F.lit("total"))
    return per.unionByName(total).select("split", "n", ratio("late", "n").alias("tasa_base"))

"""Train, choose and report late-delivery models.

Candidates are fitted on ``train``, chosen by average precision on ``val``; thresholds
come from ``val``; ``test`` is looked at once.  No random cross-validation: it would mix
past and future.
"""

from __future__ import annotations

from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass, field
from datetime import datetime

from pyspark import inheritable_thread_target
from pyspark.ml.classification import LogisticRegression
from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from latelens.ml.baselines import MajorityBaseline, RuleBaseline
from latelens.ml.boosting import BoostedModel, BoostedTrees
from latelens.ml.evaluation import (
    METRICS,
    best_f1_threshold,
    calibration_by,
    cold_start_metrics,
    errors_by_region,
    metrics_at,
    recall_threshold,
    thinned_precision_recall,
    thinned_roc,
    threshold_curve,
)
from latelens.ml.preprocess import Preprocessor
from latelens.operators.staging import stage
from latelens.schemas import FEATURES, LATE_LABEL, RECALL_TARGET
from latelens.sources.guards import forbid_late_knowledge, require_columns

SEED = 42
LINEAR, BOOSTED = "logistic_regression", "gradient_boosting"
MAJORITY, RULE = "baseline_mayoritaria", "baseline_regla"

# The candidate grid.
LINEAR_GRID = [("lr_C1.0", 1.0), ("lr_C0.3", 0.3)]
BOOSTED_GRID = [
    ("gbt_d4", {"rounds": 300, "depth": 4, "penalty": 2.0, "least_hessian": 5.0, "row_share": 0.9, "column_share": 0.9}),
    ("gbt_d6", {"rounds": 350, "depth": 6, "penalty": 5.0, "least_hessian": 10.0, "row_share": 0.8, "column_share": 0.8}),
]


def split_parts(features: DataFrame) -> dict[str, DataFrame]:
    """train / val / test, after the column guards."""
    require_columns(features.columns, [LATE_LABEL, "split", *FEATURES], "feature table")
    forbid_late_knowledge(FEATURES)
    return {name: features.where(F.col("split") == name) for name in ("train", "val", "test")}


def class_weights(train: DataFrame) -> DataFrame:
    """One row: class sizes, balanced weights, and the weight of a positive against a negative."""
    counts = train.agg(
        F.count(F.lit(1)).alias("n"),
        F.count_if(F.col(LATE_LABEL) == 1).alias("n_pos"),
        F.count_if(F.col(LATE_LABEL) == 0).alias("n_neg"),
    )
    return counts.select(
        "n", "n_neg", "n_pos",
        F.try_divide(F.col("n"), F.col("n_neg") * 2).alias("balanced_neg"),
        F.try_divide(F.col("n"), F.col("n_pos") * 2).alias("balanced_pos"),
        (F.col("n_neg") / F.greatest(F.col("n_pos"), F.lit(1))).alias("pos_weight"),
    )


def candidates(
    rows: int, max_iter: int | None = None, groups: list[tuple[int, int]] | None = None
) -> dict[str, list[tuple[str, object]]]:
    """Estimators per family; the first of a family is its default.

    The linear penalty is given per row, so 1/(C n).  ``groups`` are the runs of indicators in the
    feature vector of which at most one is set.  ``max_iter`` caps the number of trees for quick runs.
    """
    linear = [
        (name, LogisticRegression(
            labelCol=LATE_LABEL, weightCol="balanced_weight", maxIter=1000, elasticNetParam=0.0,
            regParam=1.0 / (c * rows), standardization=False,
        ))
        for name, c in LINEAR_GRID
    ]
    boosted = []
    for name, knobs in BOOSTED_GRID:
        knobs = dict(knobs, rounds=min(knobs["rounds"], max_iter or knobs["rounds"]))
        boosted.append((name, BoostedTrees(
            label=LATE_LABEL, weight="pos_weight", key="order_id", rate=0.05, seed=SEED, groups=groups or [], **knobs)))
    return {LINEAR: linear, BOOSTED: boosted}


def default_models(rows: int, max_iter: int | None = None) -> dict[str, object]:
    return {family: grid[0][1] for family, grid in candidates(rows, max_iter).items()}


def positive_probability(model, prepared: DataFrame) -> DataFrame:
    if isinstance(model, BoostedModel):
        return model.score(prepared)
    return model.transform(prepared).withColumn("score", vector_to_array("probability")[1])


def prepare(pre: Preprocessor, features: DataFrame, weights) -> DataFrame:
    """Feature vectors, weights and the columns reports need, staged once for all fits."""
    late = F.col(LATE_LABEL) == 1
    vectors = pre.transform(features).select(
        "order_id", "split", LATE_LABEL, "features", "customer_state", "sin_historial_vendedor",
        F.when(late, F.lit(weights["balanced_pos"])).otherwise(F.lit(weights["balanced_neg"])).alias("balanced_weight"),
        F.when(late, F.lit(weights["pos_weight"])).otherwise(F.lit(1.0)).alias("pos_weight"),
    )
    return stage(vectors, "vectors")


def importances(model, names: list[str]) -> list[tuple[str, float]]:
    """Mean gain or absolute coefficient per output feature, largest first."""
    if isinstance(model, BoostedModel):
        values = model.importances().tolist()
    elif hasattr(model, "coefficients"):
        values = [abs(float(v)) for v in model.coefficients.toArray()]
    else:
        raise ValueError("the model has neither importances nor coefficients")
    return sorted(zip(names, values), key=lambda p: (-p[1], p[0]))


def importance_share(ranked: list[tuple[str, float]], source: str = "tasa_vendedor") -> float | None:
    """Part of all importance held by one source column."""
    total = sum(v for _, v in ranked)
    return sum(v for n, v in ranked if source in n) / total if total > 0 else None


def too_good(test_metrics: dict, limit: float = 0.99) -> bool:
    """Near-perfect test results usually mean a leak."""
    return max(test_metrics["roc_auc"] or 0.0, test_metrics["pr_auc"] or 0.0) > limit


@dataclass
class TrainingRun:
    preprocessor: Preprocessor
    model: object
    report: dict
    scored_test: DataFrame
    curves: dict[str, DataFrame] = field(default_factory=dict)


def _stack(scored: dict[str, DataFrame], label: str) -> DataFrame:
    """Scores of several models under one another, staged."""
    out = None
    for name, df in scored.items():
        part = df.select(
            F.lit(name).alias("model"), "order_id", LATE_LABEL, "customer_state", "sin_historial_vendedor", "score"
        )
        out = part if out is None else out.unionByName(part)
    return stage(out, label)


def model_curves(scored: DataFrame, curve: DataFrame) -> dict[str, DataFrame]:
    """Tables behind the figures of all models: both curves at a bounded number of points, and calibration."""
    return {"precision_recall": thinned_precision_recall(curve, ["model"]), "roc": thinned_roc(curve, ["model"]),
            "calibration": calibration_by(scored, ["model"])}


def _fit_all(grid: dict[str, list[tuple[str, object]]], train: DataFrame) -> dict[str, object]:
    """Linear candidates side by side: each iteration is a small job.  Boosted ones take all slots, one after another."""
    with ThreadPoolExecutor(max(1, len(grid[LINEAR]))) as pool:
        runs = [(label, pool.submit(inheritable_thread_target(train.sparkSession)(estimator.fit), train)) for label, estimator in grid[LINEAR]]
        fitted = {label: run.result() for label, run in runs}
    layout = None
    for label, estimator in grid[BOOSTED]:
        layout = layout or estimator.layout(train)
        fitted[label] = estimator.fit(train, layout)
    return fitted


def _by_model(df: DataFrame) -> dict[str, dict]:
    """Metric records by model; one row per model comes to the driver."""
    return {r["model"]: {m: r[m] for m in METRICS} for r in df.collect()}


def train_models(features: DataFrame, max_iter: int | None = None, regions: DataFrame | None = None) -> TrainingRun:
    """The whole training job; ``report`` is the metrics document.

    All models of a step are evaluated together, from one curve grouped by model.
    """
    parts = split_parts(features)
    weights = class_weights(parts["train"]).first()
    pre = Preprocessor.fit(parts["train"])
    vectors = prepare(pre, features, weights)
    ready = {name: vectors.where(F.col("split") == name) for name in parts}

    baselines = {MAJORITY: MajorityBaseline.fit(parts["train"]), RULE: RuleBaseline.fit(parts["train"])}
    grid = candidates(weights["n"], max_iter, pre.groups())
    fitted = _fit_all(grid, ready["train"])

    # Validation: candidates, thresholds, selection.
    by = ["model"]
    val = _stack(
        {**{n: b.score(parts["val"]) for n, b in baselines.items()},
         **{n: positive_probability(m, ready["val"]) for n, m in fitted.items()}},
        "val_scores",
    )
    val_curve = threshold_curve(val, by=by)
    thresholds = stage(best_f1_threshold(val_curve, by), "thresholds")
    on_val = _by_model(metrics_at(val_curve, thresholds, by))

    search, config = {}, {}
    for family, members in grid.items():
        tried = {label: on_val[label]["pr_auc"] for label, _ in members}
        config[family] = max(tried, key=tried.get)  # the first of equals
        search[family] = {"elegido": config[family], "pr_auc_val": {k: round(v, 4) for k, v in tried.items()}}
    chosen = max(config, key=lambda family: on_val[config[family]]["pr_auc"])
    best = config[chosen]
    best_curve = val_curve.where(F.col("model") == best)
    umbral, wide_umbral = on_val[best]["umbral"], recall_threshold(best_curve, RECALL_TARGET).first()[0]

    # Test: looked at once, with everything decided.
    test = _stack(
        {**{n: b.score(parts["test"]) for n, b in baselines.items()},
         **{n: positive_probability(fitted[n], ready["test"]) for n in config.values()}},
        "test_scores",
    )
    test_curve = threshold_curve(test, by=by)
    on_test = _by_model(metrics_at(test_curve, thresholds, by))
    wide = _by_model(metrics_at(test_curve.where(F.col("model") == best), wide_umbral, by))[best]

    results = {n: {"val": on_val[n], "test": on_test[n]} for n in baselines}
    for family, label in config.items():
        results[family] = {"config": label, "val": on_val[label], "test": on_test[label]}

    test_best = test.where(F.col("model") == best)
    decided = test_best.withColumn("pred", (F.col("score") >= umbral).cast("int"))
    ranked = importances(fitted[best], pre.names)
    sizes = features.groupBy("split").agg(F.count(F.lit(1)).alias("n"), F.sum(LATE_LABEL).alias("late")).collect()
    by_region = errors_by_region(decided, regions).orderBy(F.desc("tasa_tarde_real"), "region")
    by_history = cold_start_metrics(test_best, umbral).orderBy(F.desc("segmento"))

    report = {
        "generado": datetime.now().strftime("%Y-%m-%d %H:%M"),
        "tasa_base_total": sum(r["late"] for r in sizes) / sum(r["n"] for r in sizes),
        "tasa_base_por_split": {r["split"]: r["late"] / r["n"] for r in sizes},
        "tamanos_split": {r["split"]: r["n"] for r in sizes},
        "busqueda_hiperparametros": search,
        "mejor_modelo": chosen,
        "config_mejor": best,
        "umbral_f1": umbral,
        "operativo_alta_cobertura": wide,
        "peso_tasa_vendedor": importance_share(ranked),
        "alerta_fuga": too_good(on_test[best]),
        "metricas": results,
        "importancias_top": dict(ranked[:20]),
        "analisis_region": [r.asDict() for r in by_region.collect()],
        "analisis_cold_start": [r.asDict() for r in by_history.collect()],
    }
    return TrainingRun(pre, fitted[best], report, test_best, model_curves(test, test_curve))

"""Saved models, batch scoring and the metrics document."""

from __future__ import annotations

import json
from dataclasses import dataclass

from pyspark.ml.classification import LogisticRegressionModel
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from latelens.functions.expressions import optional_column
from latelens.ml.boosting import BoostedModel
from latelens.ml.preprocess import Preprocessor
from latelens.ml.training import BOOSTED, LINEAR, TrainingRun, positive_probability
from latelens.schemas import (
    CATEGORICAL_FEATURES,
    CLASS_LABEL,
    DAY_LABELS,
    LATE_LABEL,
    MIN_SELLER_ORDERS,
    NUMERIC_FEATURES,
)
from latelens.sources.commits import finish_commit, replacing

_LOADERS = {
    LINEAR: lambda spark, path: LogisticRegressionModel.load(path),
    BOOSTED: BoostedModel.load,
}

_METRIC = (
    "struct<pr_auc:double,roc_auc:double,f1:double,precision:double,recall:double,brier:double,"
    "umbral:double,tasa_base:double,frac_alertas:double>"
)
METRICS_DOCUMENT = f"""
    generado string, tasa_base_total double, tasa_base_por_split map<string,double>,
    tamanos_split map<string,bigint>,
    busqueda_hiperparametros map<string,struct<elegido:string,pr_auc_val:map<string,double>>>,
    mejor_modelo string, config_mejor string, umbral_f1 double, operativo_alta_cobertura {_METRIC},
    peso_tasa_vendedor double, alerta_fuga boolean,
    metricas map<string,struct<config:string,val:{_METRIC},test:{_METRIC}>>,
    importancias_top map<string,double>,
    analisis_region array<struct<region:string,n_ordenes:bigint,tasa_tarde_real:double,recall_tarde:double,n_tarde:bigint>>,
    analisis_cold_start array<struct<segmento:string,n_ordenes:bigint,tasa_tarde_real:double,pr_auc:double,
    roc_auc:double,recall:double,precision:double>>
"""


def _write_json(spark: SparkSession, content: dict, path: str) -> None:
    spark.createDataFrame([(json.dumps(content),)], "content string").coalesce(1).write.mode("overwrite").text(path)


def _read_json(spark: SparkSession, path: str) -> dict:
    return json.loads(spark.read.text(path).first()[0])


# -- preprocessor bundle ---------------------------------------------------------
def save_preprocessor(spark: SparkSession, pre: Preprocessor, global_rate: float, path: str) -> None:
    """Both parts replace the old ones together."""
    with replacing(spark, path) as folder:
        pre.save(spark, f"{folder}/preprocessor")
        _write_json(spark, {
            "numeric_features": NUMERIC_FEATURES,
            "categorical_features": CATEGORICAL_FEATURES,
            "classification_target": LATE_LABEL,
            "multiclass_target": CLASS_LABEL,
            "regression_targets": DAY_LABELS,
            "min_ordenes_vendedor": MIN_SELLER_ORDERS,
            "global_rate_train": global_rate,
        }, f"{folder}/metadata")


def load_preprocessor(spark: SparkSession, path: str) -> tuple[Preprocessor, dict]:
    finish_commit(spark, path)
    return Preprocessor.load(spark, f"{path}/preprocessor"), _read_json(spark, f"{path}/metadata")


# -- model bundle ------------------------------------------------------------------
@dataclass
class ModelBundle:
    preprocessor: Preprocessor
    model: object
    metadata: dict


def bundle_of(run: TrainingRun) -> ModelBundle:
    r = run.report
    return ModelBundle(run.preprocessor, run.model, {
        "nombre_modelo": r["mejor_modelo"],
        "config": r["config_mejor"],
        "umbral_f1": r["umbral_f1"],
        "umbral_alta_cobertura": r["operativo_alta_cobertura"]["umbral"],
        "numeric_features": NUMERIC_FEATURES,
        "categorical_features": CATEGORICAL_FEATURES,
        "target": LATE_LABEL,
        "metricas_test": r["metricas"][r["mejor_modelo"]]["test"],
    })


def save_bundle(spark: SparkSession, bundle: ModelBundle, path: str) -> None:
    """Preparation, model and metadata replace the old ones together."""
    with replacing(spark, path) as folder:
        bundle.preprocessor.save(spark, f"{folder}/preprocessor")
        if isinstance(bundle.model, BoostedModel):
            bundle.model.save(spark, f"{folder}/model")
        else:
            bundle.model.write().save(f"{folder}/model")
        _write_json(spark, bundle.metadata, f"{folder}/metadata")


def load_bundle(spark: SparkSession, path: str) -> ModelBundle:
    finish_commit(spark, path)
    metadata = _read_json(spark, f"{path}/metadata")
    model = _LOADERS[metadata["nombre_modelo"]](spark, f"{path}/model")
    return ModelBundle(Preprocessor.load(spark, f"{path}/preprocessor"), model, metadata)


def score_orders(bundle: ModelBundle, df: DataFrame) -> DataFrame:
    """Risk and two decisions per order; the flags use the unrounded risk."""
    present = df.columns
    scored = positive_probability(bundle.model, bundle.preprocessor.transform(df))
    risk = F.col("score")
    return scored.select(
        "order_id",
        optional_column(present, "order_purchase_timestamp", "timestamp_ntz").alias("order_purchase_timestamp"),
        optional_column(present, "split", "string").alias("split"),
        optional_column(present, bundle.metadata["target"], "int").alias("entrega_tarde_real"),
        F.round(risk, 4).alias("proba_riesgo_tarde"),
        (risk >= bundle.metadata["umbral_f1"]).cast("int").alias("pred_balance_f1"),
        (risk >= bundle.metadata["umbral_alta_cobertura"]).cast("int").alias("pred_alta_cobertura"),
    )


# -- metrics document ----------------------------------------------------------------
def metrics_document(spark: SparkSession, report: dict) -> DataFrame:
    """The training report as one nested row."""
    row = {**report, "metricas": {k: {"config": v.get("config"), **v} for k, v in report["metricas"].items()}}
    parsed = spark.createDataFrame([(json.dumps(row),)], "content string")
    return parsed.select(F.from_json("content", METRICS_DOCUMENT).alias("d")).select("d.*")


def write_metrics(document: DataFrame, path: str) -> None:
    with replacing(document.sparkSession, path) as folder:
        document.coalesce(1).write.json(folder)


def read_metrics(spark: SparkSession, path: str) -> DataFrame:
    finish_commit(spark, path)
    return spark.read.schema(METRICS_DOCUMENT).json(path)


def comparison_table(document: DataFrame) -> DataFrame:
    """One row per model with its test metrics."""
    models = document.select(F.explode("metricas").alias("modelo", "m"))
    return models.select(
        "modelo", F.col("m.config").alias("config"), "m.test.pr_auc", "m.test.roc_auc",
        "m.test.recall", "m.test.precision", "m.test.f1", "m.test.brier",
    )

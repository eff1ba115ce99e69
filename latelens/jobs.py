"""The four batch jobs, from files to files; what they stage on the way is deleted at their end."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from latelens.ml import bundles
from latelens.ml.preprocess import Preprocessor
from latelens.ml.training import split_parts, train_models
from latelens.operators.staging import stage, staged_until_done
from latelens.plans import catalog
from latelens.plans.features import assert_no_leak, audit_seller_rate, build_feature_table
from latelens.schemas import CONSOLIDATED, FEATURE_TABLE
from latelens.session import use_fixed_zone
from latelens.sources.rescue import load_text
from latelens.sources.tables import load_catalog, read_consolidated, read_features, write_table


def build_features(spark: SparkSession, items_path: str, features_path: str, preprocessor_path: str,
                   format: str = "parquet", quarantine_path: str | None = None, most_rejected: float | None = None,
                   **options) -> DataFrame:
    """Consolidated item table in, feature table and fitted preprocessor out.

    With ``quarantine_path`` the items are text, and rows that do not parse are written there; the job
    stops if they are more than the share ``most_rejected``.  Nothing else is written if the audit
    finds a leak in the seller rate.
    """
    use_fixed_zone(spark)
    with staged_until_done(spark):
        if quarantine_path is None:
            items = read_consolidated(spark, items_path)
        else:
            items = load_text(spark, items_path, CONSOLIDATED, quarantine_path, most_rejected).rows
        build = build_feature_table(items, **options)
        assert_no_leak(audit_seller_rate(build.full))
        train = split_parts(build.table)["train"]
        bundles.save_preprocessor(spark, Preprocessor.fit(train), build.global_rate.first()[0], preprocessor_path)
        write_table(build.table, features_path, format, partition_by=["split"] if format == "parquet" else None)
    return read_features(spark, features_path).select(*FEATURE_TABLE.fieldNames())


def explore(spark: SparkSession, paths: dict[str, str], output_path: str) -> list[str]:
    """The nine raw tables in, one small table per exploration report out, below ``output_path``."""
    use_fixed_zone(spark)
    with staged_until_done(spark):
        # Each table is parsed once; the reports read its staged columns.
        tables = {name: stage(df, name) for name, df in load_catalog(spark, paths, views=False).items()}
        written = []
        for name, table in catalog.reports(tables).items():
            write_table(table, f"{output_path}/{name}")
            written.append(name)
    return written


def train(spark: SparkSession, features_path: str, bundle_path: str, metrics_path: str,
          max_iter: int | None = None, regions: DataFrame | None = None, curves_path: str | None = None) -> dict:
    """Feature table in, chosen model, metrics document and, if asked for, the curves of all models out."""
    use_fixed_zone(spark)
    with staged_until_done(spark):
        run = train_models(read_features(spark, features_path), max_iter, regions)
        bundles.save_bundle(spark, bundles.bundle_of(run), bundle_path)
        bundles.write_metrics(bundles.metrics_document(spark, run.report), metrics_path)
        for name, table in run.curves.items() if curves_path else []:
            write_table(table, f"{curves_path}/{name}", "parquet")
    return run.report


def predict(spark: SparkSession, features_path: str, bundle_path: str, output_path: str, format: str = "parquet") -> DataFrame:
    """Feature table and saved model in, scored orders out: one pass, no shuffle."""
    use_fixed_zone(spark)
    scored = bundles.score_orders(bundles.load_bundle(spark, bundle_path), read_features(spark, features_path))
    write_table(scored, output_path, format)
    return scored

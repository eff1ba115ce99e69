"""Shared intermediate tables of one data folder.

Reports read the same few frames: item rows, labelled orders, the feature table.  A
workspace derives each of them from the given tables once per session and stages it in
shared storage; everything after that is a scan.
"""

from __future__ import annotations

import uuid
from functools import cached_property

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from latelens.ml import evaluation as ev
from latelens.ml.baselines import RuleBaseline
from latelens.ml.training import TrainingRun, train_models
from latelens.operators.staging import shuffles_dropped, stage, staged_until_done, staging_folder
from latelens.plans import exploration as ex
from latelens.plans.features import FeatureBuild, build_feature_table
from latelens.session import use_fixed_zone
from latelens.sources import delivery
from latelens.sources.rescue import TextLoad, load_text
from latelens.sources.tables import load_catalog

ZIP_PREFIXES = 53  # the last three have no position

ROWS_PER_FILE = 1_000_000

_open: dict[tuple[str, str], "Workspace"] = {}


def workspace(spark: SparkSession, folder: str) -> "Workspace":
    use_fixed_zone(spark)
    key = (spark.sparkContext.applicationId, folder)
    if key not in _open:
        _open[key] = Workspace(spark, folder)
    return _open[key]


class Workspace:
    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = spark, folder

    # -- raw side -----------------------------------------------------------------
    def new_path(self, label: str) -> str:
        return f"{staging_folder(self.spark)}/{label}-{uuid.uuid4().hex}"

    @cached_property
    def view(self) -> DataFrame:
        with staged_until_done(self.spark):
            return stage(delivery.item_view(self.spark, self.folder, staged=True), "items", outlives=True)

    @property
    def items(self) -> DataFrame:
        return delivery.consolidated(self.view)

    @property
    def orders(self) -> DataFrame:
        return delivery.order_rows(self.spark, self.folder, self.view)

    @property
    def reviews(self) -> DataFrame:
        return delivery.review_rows(self.view)

    @property
    def geo(self) -> DataFrame:
        return delivery.geolocation_rows(self.spark, self.folder)

    @property
    def regions(self) -> DataFrame:
        return delivery.state_regions(self.spark, self.folder)

    @property
    def customers(self) -> DataFrame:
        nation = delivery.star(self.spark, self.folder, "nation")
        return delivery.star(self.spark, self.folder, "customer").join(
            nation, F.col("c_nationkey") == F.col("n_nationkey")
        ).select(
            F.col("c_custkey").alias("customer_id"), F.col("n_name").alias("customer_state"),
            (F.col("c_custkey") % ZIP_PREFIXES).alias("customer_zip"),
        )

    @property
    def sellers(self) -> DataFrame:
        nation = delivery.star(self.spark, self.folder, "nation")
        return delivery.star(self.spark, self.folder, "supplier").join(
            nation, F.col("s_nationkey") == F.col("n_nationkey")
        ).select(
            F.col("s_suppkey").alias("seller_id"), F.col("n_name").alias("seller_state"),
            (F.col("s_suppkey") % ZIP_PREFIXES).alias("seller_zip"),
        )

    @cached_property
    def order_text(self) -> TextLoad:
        path = self.new_path("order-text")
        delivery.write_order_text(self.spark, self.folder, path)
        return load_text(self.spark, path, delivery.ORDER_TEXT, quarantine_path=f"{path}-rejects")

    @cached_property
    def catalog(self) -> dict[str, DataFrame]:
        """The nine raw tables as CSV text, opened as a job would."""
        root = self.new_path("catalog")
        paths = {}
        for name, df in delivery.raw_tables(self.spark, self.folder, self.view).items():
            paths[name] = f"{root}/{name}.csv"
            # Packed text is read by one task a file, so files are bounded.
            writer = df.write.option("header", True).option("escape", '"').option("compression", "gzip")
            with shuffles_dropped(self.spark):
                writer.option("maxRecordsPerFile", ROWS_PER_FILE).csv(paths[name])
        return load_catalog(self.spark, paths, views=False)

    # -- exploration side ------------------------------------------------------------
    @cached_property
    def labelled(self) -> DataFrame:
        base = ex.order_base(self.orders, self.reviews, self.customers)
        return stage(ex.label_base(base), "labelled")

    @property
    def cushioned(self) -> DataFrame:
        return ex.with_cushion(self.labelled)

    @cached_property
    def single(self) -> DataFrame:
        return stage(ex.single_seller_orders(self.labelled, self.items), "single")

    @cached_property
    def freight(self) -> DataFrame:
        # Nine digits: equal ratios stay equal in whatever order their sums were added up.
        ratios = ex.with_freight_ratio(self.labelled, self.items).select("order_id", "late", "freight_ratio")
        return stage(ratios.withColumn("freight_ratio", F.round("freight_ratio", 9)), "freight")

    @property
    def products(self) -> DataFrame:
        return ex.with_first_product(self.labelled, self.items)

    @cached_property
    def distances(self) -> DataFrame:
        table = ex.distance_table(self.labelled, self.items, self.sellers, ex.zip_centroids(self.geo))
        # Millimetres: the same pair of places gives the same number in both directions.
        return stage(table.withColumn("dist_km", F.round("dist_km", 6)), "distances")

    @cached_property
    def matrix(self) -> DataFrame:
        return stage(
            ex.feature_matrix(
                self.labelled, self.cushioned, self.distances, self.freight, self.products, self.items, self.single
            ),
            "matrix",
        )

    # -- model side ---------------------------------------------------------------------
    @cached_property
    def build(self) -> FeatureBuild:
        return build_feature_table(self.items)

    @property
    def features(self) -> DataFrame:
        return self.build.table

    def part(self, name: str) -> DataFrame:
        return self.features.where(F.col("split") == name)

    @cached_property
    def rule(self) -> RuleBaseline:
        return RuleBaseline.fit(self.part("train"))

    @cached_property
    def rule_scores(self) -> DataFrame:
        """Rule score and hard rule for every order, at nine decimals."""
        scored = self.rule.decide(self.rule.score(self.features)).withColumn("score", F.round("score", 9))
        return stage(
            scored.select("order_id", "split", "customer_state", "sin_historial_vendedor", "entrega_tarde", "score", "pred"),
            "rule_scores",
        )

    def rule_part(self, name: str) -> DataFrame:
        return self.rule_scores.where(F.col("split") == name)

    @cached_property
    def val_curve(self) -> DataFrame:
        return ev.threshold_curve(self.rule_part("val"))

    @cached_property
    def test_curve(self) -> DataFrame:
        return ev.threshold_curve(self.rule_part("test"))

    @cached_property
    def training(self) -> TrainingRun:
        """Both families with the full grid, fitted once per session, as ``jobs.train`` does."""
        return train_models(self.features, regions=self.regions)

"""The three jobs chained through files."""

from pyspark.sql import functions as F

from latelens import jobs
from latelens.ml.bundles import comparison_table, read_metrics
from latelens.operators.keyed import orphan_report
from latelens.plans.catalog import REFERENCES
from latelens.schemas import CONSOLIDATED, FEATURE_TABLE
from latelens.sources import delivery
from latelens.workspace import workspace

FOLDER = "/root/testdata/sf0.001"


def test_files_to_files(spark, tmp_path):
    path = {n: str(tmp_path / n) for n in ("items.parquet", "features", "pre", "bundle", "metrics", "scored.csv")}
    ws = workspace(spark, FOLDER)
    items = ws.items.withColumns({"customer_unique_id": F.col("customer_id"), "order_approved_at": F.col("order_purchase_timestamp")})
    items.select(*CONSOLIDATED.fieldNames()).write.parquet(path["items.parquet"])

    table = jobs.build_features(spark, path["items.parquet"], path["features"], path["pre"])
    assert table.columns == FEATURE_TABLE.fieldNames()
    report = jobs.train(spark, path["features"], path["bundle"], path["metrics"], max_iter=1, regions=ws.regions,
                        curves_path=str(tmp_path / "curves"))
    for name, columns in [("precision_recall", ["threshold", "precision", "recall"]), ("roc", ["threshold", "fpr", "tpr"]),
                          ("calibration", ["bin", "n", "mean_score", "observed_rate"])]:
        curve = spark.read.parquet(str(tmp_path / "curves" / name))
        assert curve.columns == ["model", *columns] and curve.select("model").distinct().count() == 4
    jobs.predict(spark, path["features"], path["bundle"], path["scored.csv"], "csv")

    scored = spark.read.option("header", True).csv(path["scored.csv"])
    assert scored.count() == table.count() == 1425
    models = {r["modelo"] for r in comparison_table(read_metrics(spark, path["metrics"])).collect()}
    assert models == set(report["metricas"]) and len(models) == 4


def test_jobs_leave_nothing_staged(spark, tmp_path):
    from latelens.operators import staging

    with staging.staged_until_done(spark):
        kept = staging.stage(spark.range(3), "probe")
        assert kept.count() == 3
        path, fs = staging._hadoop(spark, kept.inputFiles()[0])
        assert fs.exists(path)
    assert not fs.exists(path)
    try:
        with staging.staged_until_done(spark):
            path, fs = staging._hadoop(spark, staging.stage(spark.range(3), "probe").inputFiles()[0])
            raise RuntimeError
    except RuntimeError:
        assert not fs.exists(path)


def test_features_from_text_with_broken_rows(spark, tmp_path):
    ws = workspace(spark, FOLDER)
    items = ws.items.withColumns({"customer_unique_id": F.col("customer_id"), "order_approved_at": F.col("order_purchase_timestamp")})
    folder = tmp_path / "items.csv"
    items.select(*CONSOLIDATED.fieldNames()).write.option("header", True).csv(str(folder))
    names = CONSOLIDATED.fieldNames()
    bad_price = ",".join("cheap" if n == "price" else "" for n in names)
    (folder / "late.csv").write_text(",".join(names) + "\nonly,three,fields\n" + bad_price + "\n")
    quarantine = str(tmp_path / "quarantine")
    table = jobs.build_features(spark, str(folder), str(tmp_path / "features"), str(tmp_path / "pre"), quarantine_path=quarantine,
                                most_rejected=0.01)
    assert table.count() == 1425
    assert {(r.reason, r.record) for r in spark.read.parquet(quarantine).collect()} == {
        ("fields", "only,three,fields"), ("values", bad_price)}


def test_exploration_from_nine_raw_tables(spark, tmp_path):
    ws = workspace(spark, FOLDER)
    paths = {}
    for name, df in delivery.raw_tables(spark, FOLDER, ws.view).items():
        paths[name] = str(tmp_path / f"{name}.csv")
        df.write.option("header", True).option("escape", '"').csv(paths[name])
    names = jobs.explore(spark, paths, str(tmp_path / "reports"))
    read = {n: spark.read.parquet(str(tmp_path / "reports" / n)) for n in names}
    orphans = {r.check_name: r.orphans for r in read["integrity"].collect()}
    assert set(orphans) == set(REFERENCES) and orphans["payments_without_order"] == 3 and orphans["items_without_order"] == 0
    assert read["status_counts"].agg(F.sum("n")).first()[0] == spark.read.parquet(f"{FOLDER}/orders.parquet").count()
    assert read["undelivered"].count() == read["granularity"].count() == 1 and read["lifecycle_nulls"].count() > 3


def test_orphans_without_keys_and_of_empty_tables(spark):
    child = spark.createDataFrame([("1", 9), ("2", None), (None, 1), ("2", 1)], "a string, b int")
    tables = {"c": child, "p": spark.createDataFrame([("1",), (None,), ("1",)], "k string"),
              "q": spark.createDataFrame([(1,)], "k int"), "e": child.limit(0)}
    report = orphan_report(tables, {"c_p": ("c", "a", "p", "k"), "c_q": ("c", "b", "q", "k"), "e_p": ("e", "a", "p", "k")})
    assert {r.check_name: r.orphans for r in report.collect()} == {"c_p": 3, "c_q": 2, "e_p": 0}

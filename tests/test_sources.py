"""Readers, guards and sinks."""

import pytest
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType, StringType, StructField, StructType, TimestampNTZType

from latelens.schemas import CONSOLIDATED, FEATURE_TABLE, RAW_TABLES
from latelens.sources import tables
from latelens.sources.guards import MissingColumns
from latelens.sources.rescue import TooManyRejects, load_text
from latelens.workspace import workspace

FOLDER = "/root/testdata/sf0.001"


def write(path, text):
    path.write_text(text, encoding="utf-8")
    return str(path)


def test_csv_by_name_with_bad_dates(spark, tmp_path):
    path = write(tmp_path / "reviews.csv", 'order_id,extra,review_id,review_score,review_comment_message,review_answer_timestamp\n'
                 'o1,x,r1,5,"bom, ""muito"" bom",2018-01-02 03:04:05\no2,x,r2,,,never\n')
    rows = tables.read_table(spark, path, RAW_TABLES["reviews"]).orderBy("order_id").collect()
    assert rows[0]["review_comment_message"] == 'bom, "muito" bom' and rows[0]["review_score"] == 5
    assert str(rows[0]["review_answer_timestamp"]) == "2018-01-02 03:04:05"
    assert rows[1]["review_answer_timestamp"] is None and rows[1]["review_score"] is None


BROKEN = StructType([StructField("a", IntegerType()), StructField("t", StringType()), StructField("at", TimestampNTZType())])


def broken_folder(tmp_path):
    folder = tmp_path / "broken"
    folder.mkdir()
    write(folder / "one.csv", 'a,t,at\n1,"x, ""y""",2018-01-01\n2,z\nq,"u, v",soon\n3,z,never,9\n4,,\n\n5,z,never\n')
    write(folder / "two.csv", 'a,t,at\n6,u,2018-01-02 03:04:05\n')
    return str(folder)


def test_rows_that_do_not_parse_are_set_aside(spark, tmp_path):
    quarantine = str(tmp_path / "quarantine")
    load = load_text(spark, broken_folder(tmp_path), BROKEN, quarantine)
    assert {(r.a, r.t, str(r["at"])) for r in load.rows.collect()} == {
        (1, 'x, "y"', "2018-01-01 00:00:00"), (4, None, "None"), (5, "z", "None"), (6, "u", "2018-01-02 03:04:05")}
    kept = {(r.source_file[-7:], r.reason, tuple(r.bad_columns), r.record) for r in spark.read.parquet(quarantine).collect()}
    assert kept == {("one.csv", "fields", (), "2,z"), ("one.csv", "fields", (), "3,z,never,9"),
                    ("one.csv", "values", ("a", "at"), 'q,"u, v",soon')}
    assert {(r.source_file[-7:], *r[1:]) for r in load.report.collect()} == {("one.csv", 6, 3, 1), ("two.csv", 1, 0, 0)}
    # counts do not depend on the columns asked for
    assert load.rows.select("t").count() == 4 and load.rejects.count() == 3


def test_too_many_rejects_stop_the_load(spark, tmp_path):
    folder, quarantine = broken_folder(tmp_path), str(tmp_path / "quarantine")
    load_text(spark, folder, BROKEN, most_rejected=0.5)
    with pytest.raises(TooManyRejects, match="3 of 7"):
        load_text(spark, folder, BROKEN, quarantine, most_rejected=0.4)
    assert spark.read.parquet(quarantine).count() == 3


def test_rescue_of_texts_only_and_of_an_empty_file(spark, tmp_path):
    texts = StructType([StructField("t", StringType())])
    path = write(tmp_path / "t.csv", "t,extra\nx,1\ny\n")
    load = load_text(spark, path, texts)
    assert [r.t for r in load.rows.collect()] == ["x"] and [r.record for r in load.rejects.collect()] == ["y"]
    empty = load_text(spark, write(tmp_path / "e.csv", "t,extra\n"), texts, most_rejected=0.0)
    assert empty.rows.count() == empty.rejects.count() == empty.report.count() == 0
    with pytest.raises(MissingColumns):
        load_text(spark, path, BROKEN)


def test_text_with_line_breaks(spark, tmp_path):
    path = write(tmp_path / "reviews.csv", 'review_id,order_id,review_score,review_comment_message,review_answer_timestamp\n'
                 'r1,o1,5,"one\ntwo",2018-01-02 03:04:05\n')
    assert tables.read_table(spark, path, RAW_TABLES["reviews"], line_breaks=True).first()["review_comment_message"] == "one\ntwo"


def test_missing_csv_column(spark, tmp_path):
    path = write(tmp_path / "items.csv", "order_id\no1\n")
    with pytest.raises(MissingColumns):
        tables.read_table(spark, path, CONSOLIDATED)


def test_catalog_fails_before_work_begins(spark, tmp_path):
    with pytest.raises(FileNotFoundError):
        tables.load_catalog(spark, {"orders": "/nowhere"})
    with pytest.raises(FileNotFoundError, match="orders"):
        tables.load_catalog(spark, {name: str(tmp_path / f"{name}.csv") for name in RAW_TABLES})


def test_catalog_of_nine_tables(spark, tmp_path):
    paths = {}
    for name, schema in RAW_TABLES.items():
        header = ",".join(schema.fieldNames())
        paths[name] = write(tmp_path / f"{name}.csv", header + "\n" + ",".join("1" for _ in schema) + "\n")
    catalog = tables.load_catalog(spark, paths)
    assert set(catalog) == set(RAW_TABLES)
    assert spark.table("payments").count() == 1
    assert catalog["orders"].schema == RAW_TABLES["orders"]


@pytest.mark.parametrize("format", ["parquet", "csv"])
def test_feature_table_sinks(spark, tmp_path, format):
    features = workspace(spark, FOLDER).features
    path = str(tmp_path / f"features.{format}")
    tables.write_table(features, path, format)
    back = tables.read_features(spark, path)
    assert back.columns == FEATURE_TABLE.fieldNames()
    same = lambda df: df.select(
        F.col("order_id").cast("string"), "split", "order_purchase_timestamp", "entrega_tarde", "tasa_vendedor", "dist_haversine_km")
    assert same(features).exceptAll(same(back)).count() == 0 and back.count() == features.count()


def test_partitioned_sink_prunes(spark, tmp_path):
    path = str(tmp_path / "by_split")
    tables.write_table(workspace(spark, FOLDER).features, path, partition_by=["split"])
    test = spark.read.parquet(path).where("split = 'test'")
    plan = test._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(split" in plan and test.count() == 214

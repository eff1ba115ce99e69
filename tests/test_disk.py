"""What steps leave on disk: no shuffle files, no tables that nothing reads any more, packed text."""

from datetime import datetime

import pytest
from pyspark.sql import functions as F

from latelens.operators.keyed import orphan_report
from latelens.operators.staging import stage, staged_until_done, staging_folder, unstage
from latelens.plans.features import build_feature_table
from latelens.sources import delivery
from latelens.workspace import workspace


def names(spark):
    path = spark._jvm.org.apache.hadoop.fs.Path(staging_folder(spark))
    fs = path.getFileSystem(spark._jsc.hadoopConfiguration())
    return {s.getPath().getName() for s in fs.listStatus(path)} if fs.exists(path) else set()


def shuffled(spark):
    """Shuffle files on the disk of a local session."""
    files = spark.sparkContext._jsc.sc().env().blockManager().diskBlockManager().getAllFiles()
    return {files.apply(i).getName() for i in range(files.size()) if files.apply(i).getName().startswith("shuffle_")}


@pytest.fixture(scope="module")
def tables(spark, tmp_path_factory):
    """Star-schema tables with keys that repeat, are missing or lead nowhere."""
    folder = str(tmp_path_factory.mktemp("star"))
    day = datetime(1996, 3, 1)

    def write(name, rows, schema):
        spark.createDataFrame(rows, schema).coalesce(2).write.parquet(f"{folder}/{name}.parquet")

    write("region", [(0, "EAST"), (1, "WEST")], "r_regionkey int, r_name string")
    write("nation", [(n, f"N{n}", n % 2) for n in range(4)], "n_nationkey int, n_name string, n_regionkey int")
    write("customer", [(c, c % 4) for c in range(20)] + [(3, 1), (None, 2)], "c_custkey long, c_nationkey int")
    write("supplier", [(s, s % 4) for s in range(1, 9)] + [(5, 1), (None, 0)], "s_suppkey long, s_nationkey int")
    write("part", [(p, "BRASS" if p % 3 else None, p) for p in range(1, 11)] + [(4, "TIN", 9)], "p_partkey long, p_type string, p_size int")
    write("orders", [(o, o % 22, day, 10.0 * o) for o in range(1, 120)] + [(7, 3, day, 1.0), (None, 2, day, 2.0)],
          "o_orderkey long, o_custkey long, o_orderdate timestamp_ntz, o_totalprice double")
    lines = [(o if o % 29 else None, (o * k) % 12 + 1, (o + k) % 10, k, day, 1.0 * k, 5.0 * o + k, 0.1, 0.02)
             for o in range(1, 130) for k in range(1, 1 + o % 5)]
    write("lineitem", lines + lines[:6], "l_orderkey long, l_partkey long, l_suppkey long, l_linenumber int, l_shipdate timestamp_ntz, "
          "l_quantity double, l_extendedprice double, l_discount double, l_tax double")
    return folder


def test_staging_leaves_no_shuffle_files(spark):
    before = shuffled(spark)
    out = stage(spark.range(5000).groupBy((F.col("id") % 700).alias("k")).agg(F.count(F.lit(1)).alias("n")), "counted")
    assert shuffled(spark) <= before
    assert out.agg(F.sum("n")).first()[0] == 5000 and out.groupBy("n").count().count() == 2


def test_a_table_may_outlive_its_block_or_end_early(spark):
    before = names(spark)
    with staged_until_done(spark):
        inner, kept = stage(spark.range(3), "inner"), stage(spark.range(4), "kept", outlives=True)
        unstage(inner)
        assert len(names(spark) - before) == 1
        stage(spark.range(5), "other")
    assert kept.count() == 4 and len(names(spark) - before) == 1
    unstage(kept)
    assert names(spark) == before


def test_cut_steps_give_the_same_items_and_leave_nothing(spark, tables):
    before = names(spark)
    with staged_until_done(spark):
        cut = stage(delivery.item_view(spark, tables, staged=True), "items", outlives=True)
    assert {n.rpartition("-")[0][:5] for n in names(spark) - before} == {"items"}
    whole = delivery.item_view(spark, tables)
    assert cut.columns == whole.columns and cut.count() == whole.count() > 100
    assert cut.exceptAll(whole).isEmpty()
    # The items of an order lie side by side: per file no order comes back once another has begun.
    lying = cut.select(F.input_file_name().alias("f"), F.monotonically_increasing_id().alias("i"), "order_id")
    seen = sorted(lying.collect(), key=lambda r: (r["f"], r["i"]))
    runs = [b for a, b in zip([None, *seen], seen) if a is None or (a["f"], a["order_id"]) != (b["f"], b["order_id"])]
    assert len(runs) == len({(r["f"], r["order_id"]) for r in seen})


@pytest.mark.parametrize("history", ["row_order", "strict_time", "known_outcome"])
def test_the_feature_build_keeps_its_result_alone(spark, tables, history):
    before = names(spark)
    items = delivery.consolidated(stage(delivery.item_view(spark, tables), "view"))
    build = build_feature_table(items, history=history)
    left = {n.rpartition("-")[0] for n in names(spark) - before} - {"hot_keys"}
    assert left == {"view", "features", "train_rate"}
    assert build.table.count() == build.full.count() > 50 and build.global_rate.count() == 1


def test_orphans_of_keys_that_repeat_or_are_missing(spark):
    def table(rows, schema):
        return spark.createDataFrame(rows, schema)

    tables = {
        "a": table([(1, "x"), (1, "y"), (2, None), (None, "z"), (9, "x")], "k long, c string"),
        "b": table([(1,), (1,), (None,), (2,)], "k long"),
        "c": table([("x",), (None,), ("w",)], "c string"),
        "none": table([], "k long"),
    }
    before = shuffled(spark)
    report = orphan_report(tables, {
        "a_in_b": ("a", "k", "b", "k"), "b_in_a": ("b", "k", "a", "k"), "a_in_c": ("a", "c", "c", "c"), "c_in_a": ("c", "c", "a", "c"),
        "none_in_b": ("none", "k", "b", "k"), "a_in_none": ("a", "k", "none", "k")})
    assert dict(map(tuple, report.collect())) == {
        "a_in_b": 2, "b_in_a": 1, "a_in_c": 3, "c_in_a": 2, "none_in_b": 0, "a_in_none": 5}
    assert shuffled(spark) <= before


def test_raw_text_is_packed(spark):
    ws = workspace(spark, "/root/testdata/sf0.001")
    for name in ("items", "orders", "reviews"):
        files = ws.catalog[name].inputFiles()
        assert files and all(f.endswith(".csv.gz") for f in files)
    assert ws.catalog["items"].count() == ws.view.count()

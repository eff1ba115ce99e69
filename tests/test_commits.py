"""Sinks leave the old table or the new one, never a mixture."""

import os

import pytest
from pyspark.sql import functions as F

from latelens.sources import commits
from latelens.sources.commits import finish_commit, replacing, write_partitions
from latelens.sources.tables import read_table, write_table


def rows(spark, path):
    return sorted((tuple(r) for r in read_table(spark, path).collect()), key=str)


def files(path, part):
    return sorted(f for f in os.listdir(f"{path}/k={part}") if f.endswith(".parquet"))


def table(spark, *cells):
    return spark.createDataFrame(list(cells), "v long, k string")


FIRST = [(1, "a"), (2, "b"), (3, "c")]


@pytest.fixture
def path(spark, tmp_path):
    place = str(tmp_path / "table")
    write_table(table(spark, *FIRST), place, partition_by=["k"])
    return place


def test_failing_writer_leaves_the_old_table(spark, path, tmp_path):
    bad = spark.range(0, 1000, 1, 4).select(
        F.when(F.col("id") == 900, F.raise_error(F.lit("broken"))).otherwise(F.col("id")).cast("long").alias("v"), F.lit("a").alias("k"))
    for write in (lambda: write_table(bad, path, partition_by=["k"]), lambda: write_partitions(bad, path, ["k"])):
        with pytest.raises(Exception, match="broken"):
            write()
        assert rows(spark, path) == FIRST and os.listdir(tmp_path) == ["table"]


def test_a_table_can_be_rewritten_from_itself(spark, path):
    write_table(read_table(spark, path).where("k <> 'b'"), path, partition_by=["k"])
    assert rows(spark, path) == [(1, "a"), (3, "c")]
    write_table(read_table(spark, path).select("v"), path)
    assert rows(spark, path) == [(1,), (3,)]


def test_only_touched_partitions_are_replaced(spark, path):
    kept = files(path, "c")
    write_partitions(table(spark, (9, "b"), (8, "d"), (7, None), (6, "x/y=z: %")), path, ["k"])
    write_partitions(read_table(spark, path).where("k = 'a'").selectExpr("v + 10 as v", "k"), path, ["k"])
    assert set(rows(spark, path)) == {(11, "a"), (9, "b"), (3, "c"), (8, "d"), (7, None), (6, "x/y=z: %")}
    assert files(path, "c") == kept
    write_partitions(table(spark, (5, None), (4, "x/y=z: %")), path, ["k"])
    assert set(rows(spark, path)) == {(11, "a"), (9, "b"), (3, "c"), (8, "d"), (5, None), (4, "x/y=z: %")}
    before = rows(spark, path)
    write_partitions(table(spark, (1, "a")).limit(0), path, ["k"])
    assert rows(spark, path) == before


def test_two_levels_of_partitions_and_a_new_table(spark, tmp_path):
    path = str(tmp_path / "deep")
    cells = "v long, j int, k string"
    write_partitions(spark.createDataFrame([(1, 1, "a"), (2, 1, "b"), (3, 2, "a")], cells), path, ["j", "k"])
    write_partitions(spark.createDataFrame([(9, 1, "b"), (8, 3, "a")], cells), path, ["j", "k"])
    assert rows(spark, path) == [(1, 1, "a"), (3, 2, "a"), (8, 3, "a"), (9, 1, "b")]


def test_moves_cut_off_are_finished_by_the_next_reader_or_writer(spark, path, tmp_path, monkeypatch):
    real, done = commits._Place.move, []

    def dies_after_one(self, source, target):
        if done:
            raise KeyboardInterrupt
        done.append(source)
        real(self, source, target)

    for finisher in (lambda: None, lambda: write_partitions(table(spark, (0, "z")), path, ["k"])):
        done.clear()
        monkeypatch.setattr(commits._Place, "move", dies_after_one)
        with pytest.raises(KeyboardInterrupt):
            write_partitions(table(spark, (21, "a"), (22, "b"), (24, "d")), path, ["k"])
        monkeypatch.setattr(commits._Place, "move", real)
        finisher()
        assert set(rows(spark, path)) >= {(21, "a"), (22, "b"), (3, "c"), (24, "d")}
        assert os.listdir(tmp_path) == ["table"] and not finish_commit(spark, path)


def test_death_before_the_manifest_leaves_the_old_table_and_its_folder_is_cleared(spark, path, tmp_path):
    os.makedirs(tmp_path / "_table.new-dead" / "k=a")
    with pytest.raises(ZeroDivisionError), replacing(spark, path) as folder:
        table(spark, (5, "e")).write.parquet(folder)
        raise ZeroDivisionError
    assert rows(spark, path) == FIRST and os.listdir(tmp_path) == ["table"]


def test_tables_of_another_shape_are_refused(spark, path, tmp_path):
    for other in ("cast(v as int) v, k", "v as w, k", "v, 1 as w, k"):
        with pytest.raises(ValueError, match="differ"):
            write_partitions(table(spark, (5, "e")).selectExpr(*other.split(", ")), path, ["k"])
    flat = str(tmp_path / "flat")
    write_table(table(spark, (5, "e")), flat)
    with pytest.raises(ValueError, match="not partitioned"):
        write_partitions(table(spark, (5, "e")), flat, ["k"])
    assert rows(spark, path) == FIRST and rows(spark, flat) == [(5, "e")]

"""Quantiles, bins and histograms against numpy."""

import numpy as np
import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from latelens.operators.quantiles import exact_quantiles, histogram, median_by, quantile_edges, with_quantile_bin
from latelens.operators.staging import stage

PROBS = [0.0, 0.1, 1 / 3, 0.5, 0.9, 1.0]


def frame(spark, values):
    return spark.createDataFrame([(float(v) if v is not None else None,) for v in values], "x double")


@pytest.fixture(scope="module")
def grouped(spark):
    rng = np.random.default_rng(3)
    rows = [("a", float(v)) for v in rng.normal(size=3000)]
    rows += [("b", float(v)) for v in rng.integers(0, 4, size=1500)]  # heavy ties
    rows += [("c", 5.0), (None, 1.0), ("a", None)]
    return rows, stage(spark.createDataFrame(rows, "g string, x double").repartition(4), "grouped")


@pytest.mark.parametrize(("accuracy", "margin"), [(10_000, None), (50, None), (2000, None), (50, 0.0), (50, 0.001)])
def test_quantiles_by_group(grouped, accuracy, margin):
    """accuracy 10,000: whole groups; 50: real brackets; 2000: both; tight margins: brackets miss and are widened."""
    rows, df = grouped
    out = exact_quantiles(df, "x", PROBS, ["g"], accuracy=accuracy, margin=margin).collect()
    got = {r["g"]: [r[f"q{i}"] for i in range(len(PROBS))] for r in out}
    assert set(got) == {"a", "b", "c"}
    for g in got:
        values = [x for k, x in rows if k == g and x is not None]
        assert got[g] == pytest.approx(list(np.quantile(values, PROBS)), abs=1e-12)


@pytest.mark.parametrize(("accuracy", "margin"), [(10_000, None), (40, None), (40, 0.0)])
def test_global_quantiles(grouped, accuracy, margin):
    rows, df = grouped
    row = exact_quantiles(df, "x", PROBS, accuracy=accuracy, margin=margin).first()
    values = [x for _, x in rows if x is not None]
    assert row["n"] == len(values)
    assert list(row[1:]) == pytest.approx(list(np.quantile(values, PROBS)), abs=1e-12)


def test_median_interpolates(spark):
    assert median_by(frame(spark, [1, 2, 4, 10, None]), "x").first()[0] == 3.0


def test_no_rows(spark):
    assert median_by(frame(spark, [None]), "x").first()[0] is None


def test_ties_share_a_quantile_bin(spark):
    out = with_quantile_bin(frame(spark, [1, 1, 1, 1, 2, 3]), "x", 5, "bin")
    bins = {}
    for r in out.collect():
        bins.setdefault(r["bin"], set()).add(r["x"])
    assert sorted(map(sorted, bins.values())) == [[1.0], [2.0, 3.0]] or len(bins) == 2


def test_quantile_bins_are_right_closed(spark):
    df = frame(spark, range(1, 11))
    out = {r["x"]: r["bin"] for r in with_quantile_bin(df, "x", 5, "bin").collect()}
    edges = quantile_edges(df, "x", 5)
    want = np.clip(np.searchsorted(edges[1:-1], list(out), side="left"), 0, 4)
    assert list(out.values()) == list(want)


def test_histogram_top_edge_is_inclusive(spark):
    out = {r["bin"]: r["n"] for r in histogram(frame(spark, [-99, -40, 0, 40, 99, None]), "x", 80, -40, 40).collect()}
    assert len(out) == 80 and sum(out.values()) == 5
    assert out[1] == 2 and out[80] == 2


@settings(max_examples=8, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.lists(st.integers(-20, 20), min_size=1, max_size=40), st.sampled_from([1, 4, 7]))
def test_histogram_matches_numpy(spark, values, bins):
    counts, edges = np.histogram(values, bins=bins)
    out = histogram(frame(spark, values), "x", bins).orderBy("bin").collect()
    assert [r["n"] for r in out] == list(counts)
    assert [r["left_edge"] for r in out] == pytest.approx(list(edges[:-1]))


def test_class_density_integrates_to_one(spark):
    df = spark.range(200).select((F.col("id") % 2).alias("y"), (F.col("id") % 17).cast("double").alias("x"))
    rows = histogram(df, "x", 4, by="y").collect()
    assert len(rows) == 8
    for y in (0, 1):
        assert sum(r["density"] * 16 / 4 for r in rows if r["y"] == y) == pytest.approx(1)

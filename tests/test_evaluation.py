"""Evaluation operators on scores with known answers."""

import random

import numpy as np
import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from latelens.ml import evaluation as ev


def scored(spark, pairs, **extra):
    names = list(extra)
    rows = [(float(s), int(y), *[extra[n][i] for n in names]) for i, (s, y) in enumerate(pairs)]
    kinds = "".join(f", {n} {'int' if isinstance(extra[n][0], int) else 'string'}" for n in names)
    return spark.createDataFrame(rows, f"score double, entrega_tarde int{kinds}")


def brute(pairs):
    """Average precision and ROC-AUC straight from their definitions."""
    p = sum(y for _, y in pairs)
    n = len(pairs) - p
    ap, last = 0.0, 0.0
    for t in sorted({s for s, _ in pairs}, reverse=True):
        above = [y for s, y in pairs if s >= t]
        recall = sum(above) / p
        ap += (recall - last) * sum(above) / len(above)
        last = recall
    wins = sum((a > b) + (a == b) / 2 for a, y in pairs if y for b, z in pairs if not z)
    return ap, wins / (p * n)


EXAMPLE = [(0.9, 0), (0.8, 1), (0.7, 1), (0.2, 0)]


def test_average_precision_is_not_the_trapezoid(spark):
    curve = ev.threshold_curve(scored(spark, EXAMPLE))
    assert curve.agg(ev.average_precision()).first()[0] == pytest.approx(0.58333, abs=1e-5)


def test_random_scores_with_ties(spark):
    rng = random.Random(11)
    pairs = [(rng.randrange(30) / 30, int(rng.random() < 0.2)) for _ in range(400)]
    row = ev.threshold_curve(scored(spark, pairs)).agg(ev.average_precision(), ev.roc_auc()).first()
    assert tuple(row) == pytest.approx(brute(pairs))


@settings(max_examples=6, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.lists(st.tuples(st.integers(0, 9), st.booleans()), min_size=2, max_size=40).filter(
    lambda p: 0 < sum(y for _, y in p) < len(p)))
def test_auc_ignores_monotone_transforms(spark, pairs):
    pairs = [(s / 10, y) for s, y in pairs]
    plain = ev.threshold_curve(scored(spark, pairs)).agg(ev.average_precision(), ev.roc_auc()).first()
    bent = ev.threshold_curve(scored(spark, [(s ** 3 + 1, y) for s, y in pairs])).agg(ev.average_precision(), ev.roc_auc()).first()
    assert tuple(plain) == pytest.approx(tuple(bent))
    assert tuple(plain) == pytest.approx(brute(pairs))


def test_constant_score(spark):
    pairs = [(0.3, y) for y in (1, 0, 0, 0)]
    row = ev.metrics_at(ev.threshold_curve(scored(spark, pairs)), 0.3).first()
    assert (row["pr_auc"], row["roc_auc"], row["recall"], row["precision"], row["frac_alertas"]) == (0.25, 0.5, 1.0, 0.25, 1.0)


def test_thresholds(spark):
    curve = ev.threshold_curve(scored(spark, EXAMPLE))
    assert ev.best_f1_threshold(curve).first()[0] == 0.7
    assert ev.recall_threshold(curve, 0.5).first()[0] == 0.8
    assert ev.recall_threshold(curve, 1.0).first()[0] == 0.7
    assert ev.recall_threshold(curve, 2.0).first()[0] == 0.2  # out of reach: the lowest


def test_equal_f1_takes_the_lowest_threshold(spark):
    pairs = [(0.9, 1), (0.8, 0), (0.7, 1), (0.6, 0), (0.5, 0), (0.4, 0)]
    curve = ev.threshold_curve(scored(spark, pairs))
    f1 = {r["threshold"]: 2 * r["precision"] * r["recall"] / (r["precision"] + r["recall"])
          for r in ev.precision_recall_curve(curve, endpoint=False).collect() if r["recall"]}
    top = max(f1.values())
    assert ev.best_f1_threshold(curve).first()[0] == min(t for t, v in f1.items() if v == pytest.approx(top))


def test_empty_curve_defaults(spark):
    curve = ev.threshold_curve(scored(spark, EXAMPLE).where("false"))
    assert ev.best_f1_threshold(curve).first()[0] == 0.5
    assert ev.recall_threshold(curve).first()[0] == 0.5


def test_metric_record(spark):
    row = ev.metrics_at(ev.threshold_curve(scored(spark, EXAMPLE)), 0.75).first()
    assert (row["precision"], row["recall"], row["f1"]) == (0.5, 0.5, 0.5)
    assert row["brier"] == pytest.approx(np.mean([(s - y) ** 2 for s, y in EXAMPLE]))
    assert (row["tasa_base"], row["frac_alertas"]) == (0.5, 0.5)
    none = ev.metrics_at(ev.threshold_curve(scored(spark, EXAMPLE)), 5.0).first()
    assert (none["precision"], none["recall"], none["f1"]) == (0.0, 0.0, 0.0)


def test_metrics_per_group_equal_metrics_of_each(spark):
    rng = random.Random(2)
    pairs = [(rng.randrange(9) / 9, int(rng.random() < 0.4)) for _ in range(90)]
    group = [f"m{i % 3}" for i in range(90)]
    df = scored(spark, pairs, model=group)
    together = {r["model"]: r["pr_auc"] for r in ev.metrics_at(ev.threshold_curve(df, by=["model"]), 0.5, ["model"]).collect()}
    for m in together:
        alone = ev.metrics_at(ev.threshold_curve(df.where(F.col("model") == m)), 0.5).first()["pr_auc"]
        assert together[m] == pytest.approx(alone)


def test_curve_endpoints(spark):
    curve = ev.threshold_curve(scored(spark, EXAMPLE))
    end = [r for r in ev.precision_recall_curve(curve).collect() if r["threshold"] is None]
    start = [r for r in ev.roc_curve(curve).collect() if r["threshold"] is None]
    assert [(r["precision"], r["recall"]) for r in end] == [(1.0, 0.0)]
    assert [(r["fpr"], r["tpr"]) for r in start] == [(0.0, 0.0)]


def test_calibration_bins(spark):
    pairs = [(i / 100, int(i % 3 == 0)) for i in range(100)]
    rows = ev.calibration_bins(scored(spark, pairs)).orderBy("bin").collect()
    assert [r["n"] for r in rows] == [10] * 10
    assert rows[0]["mean_score"] == pytest.approx(0.045)
    same = ev.calibration_bins(scored(spark, [(0.5, 1), (0.5, 0)])).collect()
    assert len(same) == 1 and same[0]["observed_rate"] == 0.5


def test_region_errors_with_fixed_map(spark):
    df = scored(spark, [(1, 1), (1, 0), (1, 1), (1, 0)], customer_state=["SP", "SP", "AL", "??"], pred=[1, 0, 0, 1])
    got = {r["region"]: r for r in ev.errors_by_region(df).collect()}
    assert set(got) == {"Sudeste", "Nordeste", "Otro"}
    assert got["Sudeste"]["recall_tarde"] == 1.0 and got["Nordeste"]["recall_tarde"] == 0.0
    assert got["Otro"]["recall_tarde"] is None and got["Otro"]["n_tarde"] == 0
    assert {r["region"] for r in ev.regions_for_report(ev.errors_by_region(df)).collect()} == {"Sudeste", "Nordeste"}


def test_one_class_segment_is_left_out(spark):
    df = scored(spark, EXAMPLE + [(0.1, 0)], sin_historial_vendedor=[0, 0, 0, 0, 1])
    rows = ev.cold_start_metrics(df, 0.5).collect()
    assert [(r["segmento"], r["n_ordenes"]) for r in rows] == [(ev.WITH_HISTORY, 4)]


def test_thinned_curves_are_bounded_and_near(spark):
    rng = random.Random(8)
    rows = [("m", rng.random(), 0) for _ in range(3000)] + [("m", rng.betavariate(3, 2), 1) for _ in range(400)]
    rows += [("flat", 0.5, k % 2) for k in range(10)] + [("none", rng.random(), 0) for _ in range(20)]
    curve = ev.threshold_curve(spark.createDataFrame(rows, "model string, score double, entrega_tarde int"), by=["model"])
    points = 20
    for exact, thin, (x, y) in [
        (ev.precision_recall_curve(curve, ["model"], endpoint=False), ev.thinned_precision_recall(curve, ["model"], points), ("recall", "precision")),
        (ev.roc_curve(curve, ["model"], endpoint=False), ev.thinned_roc(curve, ["model"], points), ("fpr", "tpr")),
    ]:
        every, kept = {tuple(r) for r in exact.collect()}, [tuple(r) for r in thin.collect()]
        assert set(kept) <= every and len(kept) == len(set(kept))
        mine = [(r[2], r[3]) for r in kept if r[0] == "m"]
        assert len(mine) <= 4 * (points + 1) < sum(r[0] == "m" for r in every)
        for r in every:
            if r[0] == "m":
                a, b = r[2], r[3]
                if x == "fpr":
                    assert any(abs(a - c) <= 1 / points and abs(b - d) <= 1 / points for c, d in mine)
                else:
                    near = [p for p, q in mine if abs(q - b) <= 1 / points]
                    assert near and min(near) <= a <= max(near)
        assert sum(r[0] == "flat" for r in kept) == 1 and any(r[0] == "none" for r in kept)


def test_calibration_per_model_equals_one_by_one(spark):
    rows = [(m, (k * 37 % 101) / 101 if m == "a" else 0.25, k % 3 // 2) for m in ("a", "b") for k in range(60)]
    df = spark.createDataFrame(rows, "model string, score double, entrega_tarde int")
    both = {tuple(r) for r in ev.calibration_by(df, ["model"]).collect()}
    alone = {("a", *r) for r in map(tuple, ev.calibration_bins(df.where("model = 'a'")).collect())}
    assert alone <= both and [r for r in both if r[0] == "b"][0][2] == 60

"""Boosted trees against a plain version that looks at rows, not at sums per bin."""

import time
from contextlib import contextmanager

import numpy as np
import pytest
from pyspark.ml.functions import array_to_vector
from pyspark.sql import functions as F

from latelens.ml import boosting
from latelens.ml.boosting import UNIT, BoostedModel, BoostedTrees, Layout, add_packed, packed, sampled_features, sampled_rows

WIDTH = 6  # two numbers, four indicators of one group


@pytest.fixture(scope="module")
def frame(spark):
    rng = np.random.default_rng(3)
    rows = []
    for i in range(900):
        a, b, level = float(rng.integers(0, 40)), float(np.round(rng.normal(), 2)), int(rng.integers(0, 5))
        risk = 0.15 + 0.5 * (a > 25) * (level == 2) + 0.2 * (b > 0.5)
        rows.append((i, int(rng.random() < risk), [a, b, *[float(level == k + 1) for k in range(4)]]))
    df = spark.createDataFrame(rows, "id long, y int, x array<double>")
    return df.select("id", "y", F.when(F.col("y") == 1, 3.0).otherwise(1.0).alias("w"), array_to_vector("x").alias("features"))


def plain(x, y, w, keys, plan, edges):
    """Trees as nested splits over row sets."""
    score, trees = np.zeros(len(y)), []
    for tree in range(plan.rounds):
        p = 1 / (1 + np.exp(-score))
        taken = sampled_rows(keys, tree, plan.row_share)
        g, h = np.rint(w * (p - y) * UNIT) * taken, np.rint(w * p * (1 - p) * UNIT) * taken
        allowed = np.flatnonzero(sampled_features(WIDTH, tree, plan.column_share, plan.seed))

        def grow(rows, depth):
            gs, hs = g[rows].sum() / UNIT, h[rows].sum() / UNIT
            best = None
            for f in sorted(allowed) if depth else []:
                for t in (edges[f][:-1] if f < 2 else [0.0]):
                    right = x[rows, f] > t
                    gr, hr = g[rows][right].sum() / UNIT, h[rows][right].sum() / UNIT
                    gl, hl = gs - gr, hs - hr
                    if hl >= plan.least_hessian and hr >= plan.least_hessian:
                        gain = gl**2 / (hl + plan.penalty) + gr**2 / (hr + plan.penalty) - gs**2 / (hs + plan.penalty)
                        if gain > 1e-6 and (best is None or gain > best[0]):
                            best = (gain, f, t, right)
            if best is None:
                value = -plan.rate * gs / (hs + plan.penalty)
                score[rows] += value
                return value
            return best[1], best[2], grow(rows[~best[3]], depth - 1), grow(rows[best[3]], depth - 1)

        trees.append(grow(np.arange(len(y)), plan.depth))
    return score, trees


def as_nested(model, tree, node=0, depth=0):
    if depth == model.depth:
        return model.leaf[tree][node - ((1 << model.depth) - 1)]
    if model.threshold[tree][node] == np.inf:
        return as_nested(model, tree, 2 * node + 1, depth + 1)
    return (model.feature[tree][node], model.threshold[tree][node],
            as_nested(model, tree, 2 * node + 1, depth + 1), as_nested(model, tree, 2 * node + 2, depth + 1))


@pytest.mark.parametrize("rows_per_task", [100_000, 150])
def test_equals_a_plain_version(frame, rows_per_task):
    plan = BoostedTrees("y", "w", "id", rounds=8, depth=3, penalty=2.0, least_hessian=5.0, rate=0.3, row_share=0.8,
                        column_share=0.7, groups=[(2, 4)], rows_per_task=rows_per_task)
    model = plan.fit(frame)
    rows = frame.select(F.xxhash64("id").alias("k"), "y", "w", "features").collect()
    x = np.array([r["features"].toArray() for r in rows])
    y, w, keys = (np.array([r[c] for r in rows]) for c in ("y", "w", "k"))
    score, trees = plain(x, y, w, keys, plan, plan.layout(frame).edges)
    flat = lambda t: [t] if not isinstance(t, tuple) else [t[0], t[1], *flat(t[2]), *flat(t[3])]
    for tree, want in enumerate(trees):
        assert flat(as_nested(model, tree)) == pytest.approx(flat(want), abs=1e-9)
    assert model.margins(x) == pytest.approx(score, abs=1e-9)
    got = np.array([r[0] for r in model.score(frame).orderBy("id").select("score").collect()])
    order = np.argsort([r[0] for r in frame.select("id").collect()])
    assert got == pytest.approx((1 / (1 + np.exp(-score)))[order], abs=1e-9)


def test_partitions_do_not_matter_and_save_keeps_all(spark, frame, tmp_path):
    plan = dict(label="y", weight="w", key="id", rounds=5, depth=4, row_share=0.9, column_share=0.9, groups=[(2, 4)])
    one = BoostedTrees(**plan).fit(frame)
    many = BoostedTrees(**plan, rows_per_task=130).fit(frame.repartition(5))
    for name in ("feature", "threshold", "leaf", "gain"):
        assert np.array_equal(getattr(one, name), getattr(many, name))
    one.save(spark, str(tmp_path / "m"))
    again = BoostedModel.load(spark, str(tmp_path / "m"))
    assert np.array_equal(again.threshold, one.threshold) and again.depth == 4 and again.width == WIDTH
    assert one.importances().sum() == pytest.approx(1.0) and (one.importances() >= 0).all()


def test_a_penalty_shrinks_and_a_hessian_bound_stops(frame):
    base = dict(label="y", weight="w", key="id", rounds=1, depth=4, groups=[(2, 4)])
    free = BoostedTrees(**base).fit(frame)
    heavy = BoostedTrees(**base, penalty=1e6).fit(frame)
    assert np.abs(heavy.leaf).max() < np.abs(free.leaf).max() / 100
    stump = BoostedTrees(**base, least_hessian=1e9).fit(frame)
    assert (stump.threshold == np.inf).all() and len(set(stump.leaf[0])) >= 1


def test_edge_layouts(frame):
    layout = Layout(3, {0: np.array([5.0])}, [(1, 2)])
    assert layout.binned(np.array([[4.0, 0, 0], [9.0, 0, 1]])).tolist() == [[0, 0], [0, 2]]
    assert [c[0] for c in layout.cuts()] == [1, 2]  # a constant cannot be split
    assert Layout(1, {0: np.array([5.0])}, []).cuts()[0][1] == np.inf
    with pytest.raises(ValueError):
        BoostedTrees("y", "w", "id", 1, 2).fit(frame.where("false"))
    nothing = BoostedTrees("y", "w", "id", rounds=2, depth=2).fit(
        frame.select("id", "y", "w", array_to_vector(F.array(F.lit(1.0))).alias("features")))
    assert (nothing.threshold == np.inf).all()


@pytest.mark.parametrize("values", [[0, 0], [5, 0, -7], [1 << 40, -(1 << 40), 127, 128, -128, -129], [-(1 << 63), (1 << 63) - 1]])
def test_packed_sums_add_up(values):
    own = np.array(values, np.int64)
    out = np.arange(len(own)) * 0 + 0
    add_packed(packed(own), out)
    assert out.tolist() == values


def test_tasks_do_not_wait_a_second_for_each_sum(frame):
    plan = dict(label="y", weight="w", key="id", depth=3, least_hessian=1e-3, rows_per_task=300, groups=[(2, 4)])
    BoostedTrees(**plan, rounds=1).fit(frame)  # starts the workers
    begun = time.monotonic()
    model = BoostedTrees(**plan, rounds=40).fit(frame)  # 120 sums of three tasks
    assert time.monotonic() - begun < 40 and len(model.leaf) == 40


def test_tasks_that_share_no_folder_gather_by_spark(frame, monkeypatch):
    plan = BoostedTrees("y", "w", "id", rounds=2, depth=2, groups=[(2, 4)], rows_per_task=300)
    one = plan.fit(frame)

    @contextmanager
    def nowhere(spark, label):
        yield "nowhere://at-all"

    monkeypatch.setattr(boosting, "scratch_folder", nowhere)
    other = plan.fit(frame, plan.layout(frame))
    assert np.array_equal(one.threshold, other.threshold) and np.array_equal(one.leaf, other.leaf)

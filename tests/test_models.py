"""Guards, preparation, training and scoring on the smallest data folder."""

import random

import pytest
from pyspark.ml.classification import LogisticRegression
from pyspark.sql import functions as F

from latelens import workspace as workspaces
from latelens.ml import bundles, training
from latelens.ml.baselines import MajorityBaseline, RuleBaseline
from latelens.ml.evaluation import average_precision, threshold_curve
from latelens.ml.preprocess import Preprocessor, category_levels, numeric_profile
from latelens.operators.keyed import hash_sample
from latelens.operators.staging import stage
from latelens.schemas import AFTER_PURCHASE_COLUMNS, FEATURES, LABELS
from latelens.sources.guards import LeakingFeature, MissingColumns, forbid_late_knowledge
from latelens.workspace import workspace

FOLDER = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def features(spark):
    return workspace(spark, FOLDER).features


@pytest.fixture(scope="module")
def linear(features):
    """The default linear model on sampled train and validation rows."""
    parts = training.split_parts(features)
    train = stage(hash_sample(parts["train"], "order_id", 15_000), "train")
    val = stage(hash_sample(parts["val"], "order_id", 5_000), "val")
    weights = training.class_weights(train).first()
    pre = Preprocessor.fit(train)
    model = training.default_models(weights["n"])[training.LINEAR].fit(training.prepare(pre, train, weights))
    return train, val, pre, model, weights


@pytest.fixture(scope="module")
def run(features, spark):
    return training.train_models(features, max_iter=2, regions=workspace(spark, FOLDER).regions)


def test_no_late_knowledge_among_the_features():
    forbid_late_knowledge(FEATURES)
    for column in [*LABELS, *AFTER_PURCHASE_COLUMNS]:
        with pytest.raises(LeakingFeature):
            forbid_late_knowledge([*FEATURES, column])


def test_missing_columns_are_an_error(features):
    with pytest.raises(MissingColumns):
        training.split_parts(features.drop("ratio_flete"))


def test_label_is_binary_and_rare(features):
    train = training.split_parts(features)["train"]
    assert {r[0] for r in train.select("entrega_tarde").distinct().collect()} <= {0, 1}
    assert 0 < train.agg(F.avg("entrega_tarde")).first()[0] < 0.5


def test_probabilities_are_complete_and_in_range(linear):
    _, val, pre, model, weights = linear
    scores = training.positive_probability(model, training.prepare(pre, val, weights))
    low, high, n = scores.agg(F.min("score"), F.max("score"), F.count("score")).first()
    assert n == val.count() and 0 <= low <= high <= 1


def test_linear_model_beats_the_majority_baseline(linear):
    train, val, pre, model, weights = linear

    def ap(scored):
        return threshold_curve(scored.select("entrega_tarde", "score")).agg(average_precision()).first()[0]

    base = ap(MajorityBaseline.fit(train).score(val))
    assert base == pytest.approx(val.agg(F.avg("entrega_tarde")).first()[0])
    assert ap(training.positive_probability(model, training.prepare(pre, val, weights))) > base


def test_bundle_round_trip(spark, run, features, tmp_path):
    bundle = bundles.bundle_of(run)
    bundles.save_bundle(spark, bundle, str(tmp_path / "bundle"))
    loaded = bundles.load_bundle(spark, str(tmp_path / "bundle"))
    assert loaded.metadata == bundle.metadata
    before = {tuple(r) for r in bundles.score_orders(bundle, features).collect()}
    after = {tuple(r) for r in bundles.score_orders(loaded, features).collect()}
    assert before == after and len(before) == features.count()


def test_scored_columns_and_optional_inputs(run, features):
    bundle = bundles.bundle_of(run)
    scored = bundles.score_orders(bundle, features.drop("split", "entrega_tarde"))
    assert scored.columns == ["order_id", "order_purchase_timestamp", "split", "entrega_tarde_real",
                              "proba_riesgo_tarde", "pred_balance_f1", "pred_alta_cobertura"]
    assert scored.where("split is not null or entrega_tarde_real is not null").count() == 0


def test_scoring_does_not_shuffle(run, features):
    plan = bundles.score_orders(bundles.bundle_of(run), features)._jdf.queryExecution().executedPlan().toString()
    assert "hashpartitioning" not in plan and "SinglePartition" not in plan


def test_report_follows_the_procedure(run):
    r = run.report
    for family, found in r["busqueda_hiperparametros"].items():
        tried = found["pr_auc_val"]
        assert tried[found["elegido"]] == max(tried.values())
        assert r["metricas"][family]["val"]["umbral"] == r["metricas"][family]["test"]["umbral"]
    families = r["busqueda_hiperparametros"]
    assert r["metricas"][r["mejor_modelo"]]["val"]["pr_auc"] == max(r["metricas"][f]["val"]["pr_auc"] for f in families)
    assert r["alerta_fuga"] is False and 0 <= r["peso_tasa_vendedor"] <= 1
    assert sum(r["tamanos_split"].values()) == 1425
    assert r["umbral_f1"] == r["metricas"][r["mejor_modelo"]]["test"]["umbral"]


def test_metrics_document_round_trip(spark, run, tmp_path):
    bundles.write_metrics(bundles.metrics_document(spark, run.report), str(tmp_path / "metrics"))
    document = bundles.read_metrics(spark, str(tmp_path / "metrics"))
    assert document.first()["mejor_modelo"] == run.report["mejor_modelo"]
    table = {r["modelo"]: r["pr_auc"] for r in bundles.comparison_table(document).collect()}
    assert table == {k: v["test"]["pr_auc"] for k, v in run.report["metricas"].items()}


def test_preprocessor_bundle(spark, linear, features, tmp_path):
    pre = linear[2]
    bundles.save_preprocessor(spark, pre, 0.09, str(tmp_path / "pre"))
    loaded, metadata = bundles.load_preprocessor(spark, str(tmp_path / "pre"))
    assert metadata["global_rate_train"] == 0.09 and loaded.names == pre.names
    same = pre.transform(features).select("order_id", "features").exceptAll(loaded.transform(features).select("order_id", "features"))
    assert same.count() == 0


def test_median_and_population_deviation(spark):
    df = spark.createDataFrame([(1.0,), (2.0,), (4.0,), (10.0,), (None,)], "x double")
    row = numeric_profile(df, ["x"]).first()
    assert row["median"] == 3.0 and row["mean"] == 4.0
    assert row["deviation"] == pytest.approx(10 ** 0.5)  # of 1, 2, 4, 10, 3


def test_rare_levels_share_an_indicator_and_unseen_get_zeros(spark):
    rng = random.Random(1)
    rows = [("a",)] * 250 + [("b",)] * 250 + [(f"r{i}",) for i in range(4)] + [(None,)] * 10
    rng.shuffle(rows)
    train = stage(spark.createDataFrame(rows, "c string").withColumn("x", F.lit(1.0)), "levels_input")
    levels = {r["value"]: r for r in category_levels(train, ["c"]).collect()}
    assert levels["a"]["is_mode"] and levels["a"]["n"] == 260  # the smaller of equals takes the gaps
    assert levels["b"]["kept"] and not levels["r0"]["kept"]
    pre = Preprocessor.fit(train, ["x"], ["c"])
    assert pre.names == ["num__x", "cat__c_a", "cat__c_b", "cat__c_infrequent"]
    new = spark.createDataFrame([("a",), ("r1",), ("unseen",), (None,)], "c string").withColumn("x", F.lit(1.0))
    got = {r["c"]: list(r["features"].toArray()[1:]) for r in pre.transform(new).collect()}
    assert got == {"a": [1, 0, 0], "r1": [0, 0, 1], "unseen": [0, 0, 0], None: [1, 0, 0]}


def test_class_weights_sum_to_the_rows(features):
    w = training.class_weights(features).first()
    assert w["balanced_neg"] * w["n_neg"] + w["balanced_pos"] * w["n_pos"] == pytest.approx(w["n"])
    assert w["pos_weight"] == pytest.approx(w["n_neg"] / w["n_pos"])


def test_rule_baseline(spark):
    df = spark.createDataFrame([(100.0, 1), (300.0, 0), (None, 0)], "dist_haversine_km double, mismo_estado int")
    rule = RuleBaseline.fit(df)
    assert rule.median_km == 200.0
    got = rule.decide(rule.score(df)).collect()
    assert [r["pred"] for r in got] == [0, 1, 0]
    assert [r["score"] for r in got] == pytest.approx([0.7 / 3, 0.7 * 0.6 + 0.3, 0.7 * 0.5 + 0.3])


def test_importance_share():
    ranked = [("num__tasa_vendedor", 1.0), ("num__x", 3.0)]
    assert training.importance_share(ranked) == 0.25
    assert training.importance_share([("num__x", 0.0)]) is None
    assert training.too_good({"roc_auc": 0.995, "pr_auc": 0.2}) and not training.too_good({"roc_auc": 0.7, "pr_auc": 0.2})


def test_candidate_grid_keeps_its_tree_counts(spark):
    grid = training.candidates(1000)
    assert [label for label, _ in grid[training.LINEAR]] == ["lr_C1.0", "lr_C0.3"]
    assert [e.rounds for _, e in grid[training.BOOSTED]] == [300, 350]
    assert all(isinstance(e, LogisticRegression) for _, e in grid[training.LINEAR])


def test_registered_queries_train_the_full_grid(monkeypatch):
    asked = []
    monkeypatch.setattr(workspaces, "train_models", lambda features, max_iter=None, regions=None: asked.append(max_iter))
    monkeypatch.setattr(workspaces.Workspace, "features", None)
    monkeypatch.setattr(workspaces.Workspace, "regions", None)
    workspaces.Workspace(None, FOLDER).training  # noqa: B018
    assert asked == [None]

"""Evaluation table, binary suite, feature sets, findings, best runs and cross-validation in the fit."""

import numpy as np
import pytest
from pyspark.ml.functions import array_to_vector

from tidewatch.operators import baselines as BL
from tidewatch.operators import supervised as S
from tidewatch.sources import adapters as A

TINY = {"numTrees": 5, "maxDepth": 4}


@pytest.fixture(scope="module")
def scored(spark):
    rnd = np.random.default_rng(0)
    y = rnd.integers(0, 2, 400)
    score = np.clip(0.5 + 0.25 * (y - 0.5) + rnd.normal(scale=0.2, size=400), 0, 1).round(3)
    return spark.createDataFrame([(int(a), int(b >= 0.5), float(b)) for a, b in zip(y, score)], "y int, pred int, score double")


def test_evaluation_table_with_intervals(scored):
    rows = {(r["section"], r["item"], r["measure"]): r["value"] for r in BL.evaluation_table(scored, "y", "pred", "score", n_boot=200).collect()}
    data = scored.collect()
    assert rows["summary", "all", "n"] == 400
    assert rows["confusion", "1>0", "count"] == sum(r["y"] == 1 and r["pred"] == 0 for r in data)
    pos, neg = [r["score"] for r in data if r["y"]], [r["score"] for r in data if not r["y"]]
    auc = np.mean([(a > b) + 0.5 * (a == b) for a in pos for b in neg])
    assert rows["summary", "all", "roc_auc"] == pytest.approx(auc)
    for name in ("roc_auc", "f1_weighted"):
        low, mid, high = (rows["interval", name, m] for m in ("lower", "point", "upper"))
        assert low < mid < high and mid == pytest.approx(rows["summary", "all", name])


def test_evaluation_of_one_class_has_no_auc(spark):
    one = spark.createDataFrame([(1, 1, 0.5), (1, 0, 0.2)], "y int, pred int, score double")
    rows = {(r["section"], r["measure"]): r["value"] for r in BL.evaluation_table(one, "y", "pred", "score").collect()}
    assert rows["summary", "roc_auc"] is None and rows["summary", "accuracy"] == 0.5


@pytest.fixture(scope="module")
def flows(spark, sf):
    return A.network_events(spark, sf)


def test_detector_is_cross_validated_in_the_fit(flows):
    model = S.fit_two_stage(flows.where("split = 'train'"), type_col=None, stage1_overrides=TINY, cv=3)
    assert len(model.cv["aucs"]) == 3 and 0 <= model.cv["auc_mean"] <= 1
    assert model.cv["auc_std"] == pytest.approx(float(np.std(model.cv["aucs"])))
    rows = S.evaluate(model, flows.where("split = 'test'"), n_boot=50).collect()
    assert {r["section"] for r in rows} == {"summary", "confusion", "report", "interval"}


def test_folds_of_a_known_score_are_fitted_apart(spark):
    rnd = np.random.default_rng(1)
    rows = [([float(v), float(rnd.normal())], float(v > 0), 1.0) for v in rnd.normal(size=300)]
    x = spark.createDataFrame(rows, "x array<double>, _y double, _w double").withColumn("features", array_to_vector("x"))
    assert min(S._fold_aucs(x, 3, "lr", None)) > 0.99


def test_binary_suite_compares_all_models(flows):
    small = {"rf": TINY, "lr": {"maxIter": 20}, "gbt": {"maxIter": 3, "maxDepth": 3}}
    rows = BL.binary_suite(flows.where("split = 'train'"), flows.where("split = 'test'"), overrides=small).collect()
    assert {r["algorithm"] for r in rows} == {"lr", "rf", "gbt"}
    assert [r["roc_auc"] for r in rows] == sorted((r["roc_auc"] for r in rows), reverse=True)
    assert len({(r["n_train"], r["n_test"]) for r in rows}) == 1


def test_feature_sets_side_by_side(flows):
    sets = {"few": (["dur"], []), "more": (["dur", "sbytes"], ["proto"])}
    rows = BL.feature_set_comparison(flows.where("label = 1"), "attack_cat", sets, models=("rf",), overrides={"rf": TINY}).collect()
    assert [(r["feature_set"], r["n_features"]) for r in rows] == [("few", 1), ("more", 3)]
    assert rows[0]["gain"] == 0 and rows[1]["gain"] == pytest.approx(rows[1]["accuracy"] - rows[0]["accuracy"])


def test_findings_and_best_runs(spark):
    df = spark.createDataFrame([("a", 1.0, None), ("a", 3.0, "x"), ("b", None, "y")], "k string, s double, t string")
    rows = {(r["area"], r["item"], r["measure"]): r["value"] for r in BL.findings(df, "k", "s", many=1).collect()}
    assert rows["s", "a", "mean"] == 2 and rows["s", "b", "mean"] is None
    assert rows["Missingness", "all", "missing_pct"] == pytest.approx(200 / 9)
    assert rows["High-cardinality fields", "all", "high_cardinality"] == 2
    assert BL.findings(df.where("k = 'z'"), "nope", "s").count() == 3
    runs = spark.createDataFrame([(1, "x", "m", "d", 0.5), (2, "x", "m", "d", None), (3, "x", "m", "d", 0.7), (4, "x", "m", "e", 0.9)],
                                 "id int, algorithm string, model_type string, dataset_name string, recall double")
    assert sorted((r["id"], r["is_best"]) for r in BL.best_runs(runs, "d", "recall", "m").collect()) == [(1, False), (2, False), (3, True)]

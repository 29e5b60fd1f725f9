"""Supervised detectors.

Stage 1 flags attacks on every row; stage 2 names the attack type and is
trained on attack rows only.  Both are MLlib estimators (tree learning
aggregates histograms on executors; only split decisions reach the
driver).  Class balancing is a ``weightCol`` joined from a k-row table.
"""

from __future__ import annotations

import json
import os
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass

from pyspark import StorageLevel
from pyspark.ml import PipelineModel
from pyspark.ml.classification import (LogisticRegression, LogisticRegressionModel,
                                       RandomForestClassificationModel, RandomForestClassifier)
from pyspark.ml.feature import StringIndexer, StringIndexerModel, VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.scalar import confidence
from ..plans.ordered import hash_rank, spread, with_row_id
from . import features as FE
from .boosting import BoostedModel, GradientBoosting
from .metrics import binary_metrics, roc_auc

# Fixed hyper-parameters of the reference's detector.
STAGE1_PARAMS = {
    "rf": {"numTrees": 200, "maxDepth": 15},
    "lr": {"C": 1.0, "maxIter": 1000},
    "gbt": {"maxIter": 300, "maxDepth": 6, "stepSize": 0.1},
}
STAGE2_PARAMS = {"rf": {"numTrees": 200, "maxDepth": 30}, "gbt": {"maxIter": 300, "maxDepth": 6, "stepSize": 0.1}}
SEED = 42
TREE_ROWS = 1 << 20
FOLD_ROWS = 1 << 25  # up to so many rows the fits of all folds run at once; each keeps its own copy of its rows
# A level of a forest is a pass over all rows; with the node of every row and tree at hand it does not walk down from the root. Same trees.
FOREST = {"cacheNodeIds": True}


def _weight_col(df: DataFrame, y: str, out: str = "_w") -> DataFrame:
    """Balanced class weights n / (k · n_c) attached as a column."""
    return FE.with_class_weight(df, y, out)


def _for_trees(df: DataFrame, rows: int) -> DataFrame:
    """``df`` in no more partitions than cores, or one a million rows: every partition sends the
    histograms of all open nodes, whatever its rows."""
    return df.coalesce(max(df.sparkSession.sparkContext.defaultParallelism, -(-rows // TREE_ROWS)))


def _boosting(p: dict, weight_col: str | None, **columns) -> GradientBoosting:
    return GradientBoosting(weightCol=weight_col, rounds=p["maxIter"], depth=p["maxDepth"], rate=p["stepSize"],
                            patience=p.get("patience"), seed=SEED, **columns)


def stage1_estimator(name: str, n_rows: int | None = None, weight_col: str | None = "_w",
                     overrides: dict | None = None):
    """Stage-1 learner by name."""
    p = {**STAGE1_PARAMS[name], **(overrides or {})}
    common = dict(featuresCol="features", labelCol="_y")
    if name == "rf":
        return RandomForestClassifier(numTrees=p["numTrees"], maxDepth=min(p["maxDepth"], 30),
                                      seed=SEED, weightCol=weight_col, **FOREST, **common)
    if name == "lr":
        # sklearn C penalises the summed loss; MLlib the mean: regParam = 1 / (C·n)
        reg = 1.0 / (p["C"] * max(n_rows or 1, 1))
        return LogisticRegression(maxIter=p["maxIter"], regParam=reg, elasticNetParam=0.0,
                                  standardization=False, weightCol=weight_col, **common)
    if name == "gbt":
        return _boosting(p, weight_col, **common)
    raise ValueError(f"unknown stage-1 model {name!r}")


def stage2_estimator(name: str, overrides: dict | None = None):
    """Stage-2 learner (RF depth ≤ 30, MLlib's limit; boosting grows the
    trees of all classes together)."""
    p = {**STAGE2_PARAMS[name], **(overrides or {})}
    if name == "rf":
        return RandomForestClassifier(numTrees=p["numTrees"], maxDepth=min(p["maxDepth"], 30), seed=SEED,
                                      featuresCol="features", labelCol="_t", weightCol="_w", **FOREST)
    if name == "gbt":
        return _boosting(p, "_w", featuresCol="features", labelCol="_t")
    raise ValueError(f"unknown stage-2 model {name!r}")


@dataclass
class TwoStageModel:
    preprocessor: PipelineModel
    stage1: object
    stage2: object | None
    type_indexer: StringIndexerModel | None
    numeric: list
    categorical: list

    def transform_features(self, df: DataFrame) -> DataFrame:
        """Add absent live fields with defaults, then the fitted preprocessor."""
        return self.preprocessor.transform(FE.with_defaults(df, self.numeric, self.categorical))

    def predict(self, df: DataFrame, threshold: float = 0.5) -> DataFrame:
        """``is_attack``, ``attack_probability``, ``attack_type``
        (``normal`` unless flagged) and ``confidence`` (H7)."""
        x = self.transform_features(df)
        s1 = self.stage1.transform(x).withColumn("attack_probability", vector_to_array("probability")[1]) \
            .drop("rawPrediction", "probability", "prediction")
        s1 = s1.withColumn("is_attack", (F.col("attack_probability") >= threshold).cast("int"))
        if self.stage2 is not None:
            s2 = self.stage2.transform(s1)
            labels = self.type_indexer.labels
            lab = F.element_at(F.array(*[F.lit(v) for v in labels]), F.col("prediction").cast("int") + 1)
            s2 = s2.withColumn("_type", lab).drop("rawPrediction", "probability", "prediction")
        else:
            s2 = s1.withColumn("_type", F.lit("attack"))
        out = s2.withColumn("attack_type", F.when(F.col("is_attack") == 1, F.col("_type")).otherwise("normal")) \
                .withColumn("confidence", confidence("is_attack", "attack_probability")).drop("_type")
        drop = [c for c in out.columns if c.endswith("__f") or c.endswith("__idx") or c.endswith("__ohe")]
        return out.drop(*drop)

    def bulk_scores(self, df: DataFrame, version: str, threshold: float = 0.5) -> DataFrame:
        """The bulk answer per row: flag, probability and confidence with 4
        decimals, the attack type (NULL unless flagged) and the model version."""
        s = self.predict(df, threshold)
        return (s.withColumn("attack_type", F.when(F.col("is_attack") == 1, F.col("attack_type")))
                .withColumn("attack_probability", F.round("attack_probability", 4))
                .withColumn("confidence", F.round("confidence", 4)).withColumn("model_version", F.lit(version)))

    def feature_importance(self) -> list[tuple[str, float]]:
        """Importance per encoded feature, sorted descending; models
        without importances raise."""
        m = self.stage1
        if not hasattr(m, "featureImportances"):
            raise TypeError(f"{type(m).__name__} has no feature importances")
        names = self._names
        imp = m.featureImportances.toArray()
        return sorted(zip(names, map(float, imp)), key=lambda t: -t[1])

    def save(self, path: str) -> None:
        """Preprocessor + both stages + side-car JSON."""
        self.preprocessor.write().overwrite().save(os.path.join(path, "preprocessor"))
        _save_stage(self.stage1, os.path.join(path, "stage1"))
        if self.stage2 is not None:
            _save_stage(self.stage2, os.path.join(path, "stage2"))
            self.type_indexer.write().overwrite().save(os.path.join(path, "type_indexer"))
        meta = {"stage1": type(self.stage1).__name__,
                "stage2": type(self.stage2).__name__ if self.stage2 is not None else None,
                "numeric": self.numeric, "categorical": self.categorical, "names": self._names}
        _write_json(path, meta)

    @classmethod
    def load(cls, path: str) -> "TwoStageModel":
        meta = _read_json(path)
        kinds = {"RandomForestClassificationModel": RandomForestClassificationModel,
                 "LogisticRegressionModel": LogisticRegressionModel,
                 "BoostedModel": BoostedModel}
        s1 = kinds[meta["stage1"]].load(os.path.join(path, "stage1"))
        s2 = ti = None
        if meta["stage2"]:
            s2 = kinds[meta["stage2"]].load(os.path.join(path, "stage2"))
            ti = StringIndexerModel.load(os.path.join(path, "type_indexer"))
        m = cls(PipelineModel.load(os.path.join(path, "preprocessor")), s1, s2, ti,
                meta["numeric"], meta["categorical"])
        m._names = meta["names"]
        return m


def _save_stage(stage, path: str) -> None:
    if isinstance(stage, BoostedModel):
        stage.save(path)
    else:
        stage.write().overwrite().save(path)


def _write_json(path: str, meta: dict) -> None:
    from pyspark.sql import SparkSession
    spark = SparkSession.getActiveSession()
    spark.createDataFrame([(json.dumps(meta),)], "meta string").coalesce(1) \
         .write.mode("overwrite").text(os.path.join(path, "meta"))


def _read_json(path: str) -> dict:
    from pyspark.sql import SparkSession
    spark = SparkSession.getActiveSession()
    return json.loads(spark.read.text(os.path.join(path, "meta")).first()[0])


def fit_two_stage(df: DataFrame, label: str = "label", type_col: str | None = "attack_cat",
                  stage1: str = "rf", stage2: str = "rf", numeric=None, categorical=None,
                  stage1_overrides: dict | None = None, stage2_overrides: dict | None = None,
                  smote: bool = True, cv: int | None = None) -> TwoStageModel:
    """Fit the preprocessor and both stages.

    With ``cv``, stage 1 is also cross-validated on as many folds of the
    encoded frame; the model's ``cv`` has the folds' AUCs, mean and std (J7).

    With several attack types, stage 2 is fitted on classes grown to equal
    size by SMOTE (``smote=False``: on the rows as they are).

    Stage 1 sees every row (balanced weights; boosted trees use the
    computed n_neg/n_pos instead, J3).  Stage 2 sees attack rows only and
    requires the real category column (trap T18)."""
    if numeric is None or categorical is None:
        numeric, categorical = FE.flow_columns(df, label)
    kinds = [type_col] if type_col is not None else []
    # the statistics take several scans each: the view is read once
    df, rows = spread(df.select(*dict.fromkeys([*numeric, *categorical, label, *kinds])))
    pre = FE.build_preprocessor(numeric, categorical).fit(df)
    # both fits, the weights and the class counts read the features: encode once
    x = pre.transform(df).withColumn("_y", F.col(label).cast("double")).select("features", "_y", *kinds).persist(StorageLevel.MEMORY_AND_DISK)
    encoded = x
    x.count()
    df.unpersist()
    if stage1 == "gbt":
        ratio = FE.positive_weight(x, "_y").first()["scale_pos_weight"] or 1.0
        x = x.withColumn("_w", F.when(F.col("_y") == 1, F.lit(float(ratio))).otherwise(F.lit(1.0)))
    else:
        x = _weight_col(x, "_y")
    n = rows if stage1 == "lr" else None
    aucs = _fold_aucs(x, cv, stage1, stage1_overrides) if cv else None
    s1 = stage1_estimator(stage1, n, overrides=stage1_overrides).fit(_for_trees(x, rows))
    s2 = ti = grown = None
    if type_col is not None:
        att = x.where(F.col("_y") == 1)
        ti = StringIndexer(inputCol=type_col, outputCol="_t", stringOrderType="alphabetAsc",
                           handleInvalid="error").fit(att)
        att = ti.transform(att)
        if smote and len(ti.labels) > 1:
            from .resample import smote as smote_fn
            # the weights and the fit read the grown rows: neighbours are searched once
            att = grown = smote_fn(att, "_t", "features").persist(StorageLevel.MEMORY_AND_DISK)
        att = _weight_col(att.drop("_w"), "_t")
        if len(ti.labels) > 1:
            s2 = stage2_estimator(stage2, overrides=stage2_overrides).fit(_for_trees(att, rows))
        else:
            ti = None
    m = TwoStageModel(pre, s1, s2, ti, list(numeric), list(categorical))
    m._names = FE.feature_names(x)
    m.cv = None if aucs is None else dict(zip(("auc_mean", "auc_std"), _spread(aucs))) | {"aucs": aucs}
    if grown is not None:
        grown.unpersist()
    encoded.unpersist()
    return m


def evaluate(model: TwoStageModel, df: DataFrame, label: str = "label", n_boot: int | None = None) -> DataFrame:
    """Stage 1 on a labelled frame: summary, confusion matrix, class report
    and, with ``n_boot``, intervals (:func:`~.baselines.evaluation_table`)."""
    from .baselines import evaluation_table
    return evaluation_table(model.predict(df), label, "is_attack", "attack_probability", n_boot)


def stratified_folds(df: DataFrame, label: str, k: int = 3, seed: int = SEED) -> DataFrame:
    """Exact stratified fold ids: rank rows by a seeded hash of a stored row
    id within their class (blocked prefix count, no single-task window) and
    take rank % k."""
    r = hash_rank(with_row_id(df), F.col("_rid"), [label], seed=seed)
    return r.withColumn("fold", (F.col("_rank") % k).cast("int")).drop("_h", "_rank", "_group_n", "_rid")


def _fold_aucs(x: DataFrame, k: int, stage1: str, overrides: dict | None) -> list[float | None]:
    """AUC of stage 1 on each of ``k`` stratified folds of an encoded frame
    (features, _y, _w), fitted on the others; the folds of up to ``FOLD_ROWS`` rows run at once."""
    folded = stratified_folds(x.select("features", "_y", "_w"), "_y", k).persist(StorageLevel.MEMORY_AND_DISK)
    n = folded.count()

    def one(i: int) -> float | None:
        model = stage1_estimator(stage1, n, overrides=overrides).fit(_for_trees(folded.where(F.col("fold") != i), n))
        scored = model.transform(folded.where(F.col("fold") == i)).select("_y", vector_to_array("probability")[1].alias("p"))
        return roc_auc(scored, "_y", "p").first()["roc_auc"]

    with ThreadPoolExecutor(k if n <= FOLD_ROWS else 1) as pool:
        aucs = list(pool.map(one, range(k)))
    folded.unpersist()
    return aucs


def _spread(aucs: list[float | None]) -> tuple[float, float]:
    """Mean and population deviation of the folds that have an AUC."""
    known = [a for a in aucs if a is not None]
    mu = sum(known) / len(known)
    return mu, (sum((a - mu) ** 2 for a in known) / len(known)) ** 0.5


def cross_val_auc(df: DataFrame, label: str = "label", k: int = 3, stage1: str = "rf",
                  overrides: dict | None = None) -> tuple[float, float]:
    """K-fold stratified CV of stage 1 over one encoded frame → (mean AUC, population std)."""
    numeric, categorical = FE.flow_columns(df, label)
    df, _ = spread(df.select(*dict.fromkeys([*numeric, *categorical, label])))
    x = FE.build_preprocessor(numeric, categorical).fit(df).transform(df).withColumn("_y", F.col(label).cast("double"))
    found = _spread(_fold_aucs(_weight_col(x, "_y"), k, stage1, overrides))
    df.unpersist()
    return found


def stratified_split(df: DataFrame, label: str, test_frac: float, seed: int = SEED):
    """C20: exact stratified split — round(frac · n_c) test rows per class,
    chosen by a seeded hash rank of a stored row id within the class (no
    single-task window, no approximate ``sampleBy``); NULL labels are a
    class.  Returns (train, test)."""
    r = hash_rank(with_row_id(df), F.col("_rid"), [label], seed=seed)
    k = F.floor(F.lit(float(test_frac)) * F.col("_group_n") + F.lit(0.5))
    r = r.withColumn("_test", F.col("_rank") <= k)
    cols = [F.col(f"`{c}`") for c in df.columns]
    return r.where(~F.col("_test")).select(*cols), r.where(F.col("_test")).select(*cols)


def _multiclass_estimator(name: str, overrides: dict | None = None):
    p = overrides or {}
    if name == "lr":
        return LogisticRegression(maxIter=p.get("maxIter", 2000), featuresCol="features", labelCol="_t",
                                  family="multinomial", weightCol="_w")
    if name == "rf":
        return RandomForestClassifier(numTrees=p.get("numTrees", 300), maxDepth=min(p.get("maxDepth", 30), 30),
                                      seed=SEED, featuresCol="features", labelCol="_t", weightCol="_w", **FOREST)
    if name == "gbt":
        p = {"maxIter": 200, "maxDepth": 6, "stepSize": 0.05, "patience": 10, **p}
        return _boosting(p, None, featuresCol="numeric", labelCol="_t")
    raise ValueError(f"unknown model {name!r}")


def multiclass_suite(df: DataFrame, label: str, numeric, categorical, models=("lr", "rf", "gbt"),
                     test_frac: float = 0.3, overrides: dict | None = None) -> DataFrame:
    """Fit each classifier on a stratified split and report
    accuracy, macro / weighted F1 and macro one-vs-rest AUC (NULL when
    undefined, as with one class).
    Logistic regression and forest have balanced class weights; boosting
    sees the numeric columns only."""
    from .metrics import class_report
    from .resample import macro_ovr_auc
    df = df.select(*dict.fromkeys([*numeric, *categorical, label]))
    (train, _), (test, _) = (spread(d) for d in stratified_split(df, label, test_frac))  # the statistics take several scans: rows are ranked once
    pre = FE.build_preprocessor(numeric, categorical).fit(train)
    idx = StringIndexer(inputCol=label, outputCol="_t", stringOrderType="alphabetAsc",
                        handleInvalid="skip").fit(train)
    plain = VectorAssembler(inputCols=[f"{c}__f" for c in numeric], outputCol="numeric")
    encode = lambda d: plain.transform(idx.transform(pre.transform(d)))
    used = ("features", "numeric", "_t")
    tr = _weight_col(encode(train).select(*used), "_t").persist(StorageLevel.MEMORY_AND_DISK)
    te = encode(test).select(*used).persist(StorageLevel.MEMORY_AND_DISK)
    n_train, n_test = tr.count(), te.count()
    train.unpersist()
    test.unpersist()
    rows = []
    for name in models:
        m = _multiclass_estimator(name, (overrides or {}).get(name)).fit(_for_trees(tr, n_train))
        # every measure reads the scores: a model scores once
        s = m.transform(te)
        s = s.select(*[c for c in ("_t", "prediction", "probability") if c in s.columns]).persist(StorageLevel.MEMORY_AND_DISK)
        rep = {r["cls"]: r for r in class_report(s, "_t", "prediction").collect()}
        acc = s.agg(F.avg((F.col("_t") == F.col("prediction")).cast("double"))).first()[0]
        auc = None
        if "probability" in s.columns:
            auc = macro_ovr_auc(s.withColumn("_p", vector_to_array("probability")), "_t", "_p",
                                [float(i) for i in range(len(idx.labels))])
        rows.append((name, float(acc), float(rep["macro avg"]["f1"]), float(rep["weighted avg"]["f1"]),
                     auc, n_train, n_test))
        s.unpersist()
    tr.unpersist()
    te.unpersist()
    return df.sparkSession.createDataFrame(
        rows, "model string, accuracy double, f1_macro double, f1_weighted double, roc_auc_ovr double, "
              "n_train long, n_test long")


def training_job(df: DataFrame, out_dir: str, stage1: str = "rf", stage1_overrides: dict | None = None,
                 stage2_overrides: dict | None = None, n_boot: int = 1000) -> DataFrame:
    """Validate (abort on errors) → features → two-stage fit → evaluate
    with a bootstrap AUC CI → save the model → one ``model_runs`` row (B6)."""
    import time as _time
    from ..sources.ingest import run_record
    from .quality import report_status, validate_flows
    from .resample import bootstrap_ci
    df = df.persist(StorageLevel.MEMORY_AND_DISK)  # validation, fit and scores read the view
    train, test = df.where("split = 'train'"), df.where("split = 'test'")
    status = report_status(validate_flows(train, "train")).first()
    if status is not None and not status["passed"]:
        raise ValueError("validation failed: the training data has errors")
    t0 = _time.time()
    model = fit_two_stage(train, stage1=stage1, stage1_overrides=stage1_overrides,
                          stage2_overrides=stage2_overrides)
    duration = _time.time() - t0
    scored = model.predict(test).select("label", "is_attack", "attack_probability").persist(StorageLevel.MEMORY_AND_DISK)
    ev = binary_metrics(scored, "label", "is_attack").first()
    auc = roc_auc(scored, "label", "attack_probability").first()["roc_auc"]
    ci = bootstrap_ci(scored, "label", "attack_probability", "roc_auc", n_boot=n_boot).first()
    scored.unpersist()
    df.unpersist()
    model.save(out_dir)
    metrics = {"accuracy": ev["accuracy"], "roc_auc": auc, "f1_weighted": ev["f1_weighted"],
               "f1_macro": ev["f1_macro"], "precision": ev["precision"], "recall": ev["recall"],
               "roc_auc_ci": {"lower": ci["lower"], "upper": ci["upper"]}}
    hp = {"stage1": stage1, **STAGE1_PARAMS[stage1], **(stage1_overrides or {})}
    return run_record(df.sparkSession, f"two_stage_{stage1}", "supervised", "flows", f"two_stage_{stage1}",
                      hp, metrics, duration, notes=out_dir)

"""permutation importance holds a pass of rows at a time, large folds are fitted one by one, and a walk down a tree gives the same nodes as before."""

import threading
import time

import numpy as np
from pyspark.sql import functions as F

from tidewatch.operators import boosting as B
from tidewatch.operators import resample as RS
from tidewatch.operators import supervised as S


def test_importance_in_passes_is_that_of_one_pass(spark, monkeypatch):
    u = lambda s: F.pmod(F.xxhash64("id", F.lit(s)), F.lit(50)).cast("double") / 50
    df = spark.range(400).select(u(1).alias("a"), u(2).cast("string").alias("b"), u(3).alias("c"),
                                 F.when(u(1) + u(2) + u(4) / 2 > 1.2, 1).otherwise(0).alias("y")).persist()
    frames = []

    def score(d):
        frames.append(d.count())
        return d.withColumn("s", F.col("a") + F.col("b").cast("double"))

    results = []
    for stack in (1 << 24, 0):
        monkeypatch.setattr(RS, "STACK", stack)
        frames.clear()
        rows = {r["feature"]: r for r in RS.permutation_importance(score, df, ["a", "b", "c"], "y", "s", n_repeats=4).collect()}
        results.append(rows)
        assert max(frames) == (4800 if stack else 1200)  # features by repeats by rows, or features by rows
    for f, r in results[0].items():
        np.testing.assert_allclose([r["importance_mean"], r["importance_std"]],
                                   [results[1][f]["importance_mean"], results[1][f]["importance_std"]], rtol=1e-12, atol=1e-12)
    assert results[0]["c"]["importance_mean"] == 0 and results[0]["a"]["importance_mean"] > 0.05
    df.unpersist()


def test_large_folds_are_fitted_one_by_one(spark, monkeypatch):
    running, most = [0], [0]
    lock = threading.Lock()

    class Slow:
        def fit(self, df):
            with lock:
                running[0] += 1
                most[0] = max(most[0], running[0])
            time.sleep(0.5)
            with lock:
                running[0] -= 1
            return self

        def transform(self, df):
            from pyspark.ml.functions import array_to_vector
            return df.withColumn("probability", array_to_vector(F.array(F.lit(0.5), F.lit(0.5))))

    monkeypatch.setattr(S, "stage1_estimator", lambda *a, **b: Slow())
    x = spark.range(90).select(F.col("id").alias("features"), (F.col("id") % 2).cast("double").alias("_y"), F.lit(1.0).alias("_w"))
    assert S._fold_aucs(x, 3, "rf", None) == [0.5] * 3 and most[0] == 3
    monkeypatch.setattr(S, "FOLD_ROWS", 10)
    most[0] = 0
    assert S._fold_aucs(x, 3, "rf", None) == [0.5] * 3 and most[0] == 1


def test_a_walk_stays_in_leaves_and_sends_missing_values_left():
    rng = np.random.default_rng(5)
    t = B.Tree.empty(4)
    for i in range(15):
        if (i == 0 or t.column[(i - 1) // 2] >= 0) and (i < 2 or rng.random() < 0.7):
            t.column[i], t.bin[i] = rng.integers(0, 3), rng.integers(2, 14)
            t.cut[i] = t.bin[i] + 0.5
    rows = rng.integers(0, 16, (500, 3)).astype(np.uint8)
    missing = rows.astype(float)
    missing[::5, 1] = np.nan

    def walk(row, limit, depth):
        node = 0
        for _ in range(depth):
            if t.column[node] >= 0:
                node = 2 * node + 1 + int(row[t.column[node]] > limit[node])
        return node

    for depth in range(5):
        assert t.leaves(rows, True, depth).tolist() == [walk(r, t.bin, depth) for r in rows]
        assert t.leaves(missing, False, depth).tolist() == [walk(r, t.cut, depth) for r in missing]
    assert t.leaves(rows[:0], True, 4).tolist() == []

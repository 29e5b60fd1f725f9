"""Blocked running sums on many distinct keys, NULL groups, and sampling with repeated rows."""

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from tidewatch.operators import metrics as M
from tidewatch.operators import profile as P
from tidewatch.operators import quality as Q
from tidewatch.operators import resample as R
from tidewatch.operators import supervised as S
from tidewatch.plans.ordered import exact_quantiles, hash_rank, running_sum, with_row_id

N = 200_000


@pytest.fixture(scope="module")
def scores(spark):
    rng = np.random.default_rng(3)
    y = rng.integers(0, 2, N)
    s = rng.random(N) + y * 0.2
    pdf = pd.DataFrame({"y": y, "s": s})
    df = spark.createDataFrame(pdf).repartition(8).cache()
    df.count()
    yield df, pdf
    df.unpersist()


@pytest.fixture(params=["true", "false"])
def reuse(spark, request):
    spark.conf.set("spark.sql.exchange.reuse", request.param)
    yield
    spark.conf.unset("spark.sql.exchange.reuse")


def test_roc_auc_and_points(scores, reuse):
    df, pdf = scores
    o = pdf.sort_values("s", ascending=False)
    got = M.roc_points(df, "y", "s").toPandas().sort_values("threshold", ascending=False)
    assert (got["tp"].to_numpy() == o["y"].cumsum().to_numpy()).all()
    assert (got["fp"].to_numpy() == (1 - o["y"]).cumsum().to_numpy()).all()
    rank = pdf["s"].rank()
    p = pdf["y"].sum()
    want = (rank[pdf["y"] == 1].sum() - p * (p + 1) / 2) / (p * (N - p))
    assert M.roc_auc(df, "y", "s").first()["roc_auc"] == pytest.approx(want, rel=1e-12)
    prec = o["y"].cumsum().to_numpy() / np.arange(1, N + 1)
    assert M.average_precision(df, "y", "s").first()["average_precision"] == pytest.approx((prec * o["y"]).sum() / p, rel=1e-9)


def test_quantiles_and_ks(spark, scores, reuse):
    df, pdf = scores
    got = {r["p"]: r["q"] for r in exact_quantiles(df, "s", [0.1, 0.5, 0.9]).collect()}
    for p, q in got.items():
        assert q == pytest.approx(np.quantile(pdf["s"], p), rel=1e-12)
    a, b = df.where("y = 0").select("s"), df.where("y = 1").select("s")
    x, z = (np.sort(pdf.loc[pdf["y"] == k, "s"]) for k in (0, 1))
    both = np.concatenate([x, z])
    want = np.abs(np.searchsorted(x, both, "right") / len(x) - np.searchsorted(z, both, "right") / len(z)).max()
    assert P.ks_two_sample(a, b, ["s"]).first()["ks_stat"] == pytest.approx(want, rel=1e-12)


def test_null_groups_are_kept(spark):
    df = spark.createDataFrame([(None if k % 10 == 0 else k % 3, k) for k in range(1000)], "g int, v int")
    r = running_sum(df, "v", ["v"], ["g"]).toPandas()
    assert len(r) == 1000
    null = r[r["g"].isna()].sort_values("v")
    assert (null["cum_v"].to_numpy() == null["v"].cumsum().to_numpy()).all()
    assert exact_quantiles(df, "v", [0.5], ["g"]).count() == 4
    train, test = S.stratified_split(df, "g", 0.25)
    assert train.count() + test.count() == 1000 and test.where("g is null").count() == 25
    assert S.stratified_folds(df, "g", 3).count() == 1000


def test_repeated_rows_spread_over_blocks_and_samples(spark):
    df = spark.createDataFrame([(0 if k < 10_000 else k,) for k in range(30_000)], "v int")
    ids = with_row_id(df)
    r = hash_rank(ids, F.col("_rid"), blocks=30)
    assert r.select("_rank").distinct().count() == 30_000
    train, test = S.stratified_split(df.withColumn("c", F.lit(1)), "c", 0.1)
    hot = test.where("v = 0").count()
    assert test.count() == 3000 and 850 < hot < 1150
    from tidewatch.operators.anomaly.kmeans import sample_rows
    hot = sample_rows(df, 3000).where("v = 0").count()
    assert 850 < hot < 1150


def test_cardinality_beyond_doubles(spark):
    df = spark.createDataFrame([(2 ** 53,), (2 ** 53 + 1,), (None,)], "v long")
    r = Q.cardinality(df).first()
    assert (r["n_distinct"], r["n_distinct_with_null"], r["is_constant"]) == (2, 3, False)


@pytest.mark.parametrize("metric", R.METRICS)
def test_bootstrap_interval_holds_the_point(spark, metric):
    rng = np.random.default_rng(1)
    y = rng.integers(0, 2, 4000)
    s = np.clip(y * 0.3 + rng.random(4000) * 0.7, 0, 1)
    pred = (s > 0.5).astype(float)
    df = spark.createDataFrame(pd.DataFrame({"y": y, "s": s if metric == "roc_auc" else pred}))
    r = R.bootstrap_ci(df, "y", "s", metric, n_boot=200).first()
    assert r["lower"] < r["point"] < r["upper"] and r["upper"] - r["lower"] < 0.06 and r["n_valid"] == 200
    if metric == "weighted_f1":
        f = [2 * ((y == c) & (pred == c)).sum() / ((y == c).sum() + (pred == c).sum()) * (y == c).mean() for c in (0, 1)]
        assert r["point"] == pytest.approx(sum(f), rel=1e-12)


def test_bootstrap_draws_are_poisson():
    d = R._draws(np.arange(3), np.array([1, 30, 5000]), 20_000, 42)
    for row, lam in zip(d, (1, 30, 5000)):
        assert row.mean() == pytest.approx(lam, rel=0.03) and row.var() == pytest.approx(lam, rel=0.05)

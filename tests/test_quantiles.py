"""Quantiles of many columns by refined histograms against numpy."""

import numpy as np
import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st

from tidewatch.plans.ordered import exact_quantiles, histogram_quantiles

PROBS = [0.0, 0.01, 0.25, 0.5, 0.9, 0.99, 1.0]


def frame(spark, columns):
    return spark.createDataFrame([(c, None if v is None else float(v)) for c, x in columns.items() for v in x], "c string, value double")


def check(spark, columns, **how):
    got = {(r["c"], r["p"]): r["q"] for r in histogram_quantiles(frame(spark, columns), "value", PROBS, "c", **how).collect()}
    for c, x in columns.items():
        clean = np.array([v for v in x if v is not None and not np.isnan(v)], float)
        for p in PROBS:
            if len(clean):
                assert got[c, p] == pytest.approx(np.quantile(clean, p), rel=1e-12, abs=1e-300), (c, p)
            else:
                assert (c, p) not in got


def test_columns_of_all_shapes(spark):
    rnd = np.random.default_rng(0)
    check(spark, {"normal": rnd.normal(size=3000), "wide": np.exp(rnd.normal(scale=40, size=3000)), "ties": rnd.integers(0, 4, 3000),
                  "one": [7.5] * 500, "two": [1.0, 2.0], "single": [3.0], "nulls": [None, np.nan, 1.0, 5.0, None], "none": [None, np.nan],
                  "hot": np.r_[np.zeros(2000), rnd.normal(size=1000)], "tiny": [1e-308, 2e-308, 3e-308, 1.0] * 50}, few=20, bins=16)


def test_infinite_values_and_no_rows(spark):
    x = [-np.inf, *range(50), np.inf, np.inf]
    got = {r["p"]: r["q"] for r in histogram_quantiles(frame(spark, {"c": x}), "value", [0.0, 0.5, 1.0], "c", few=5, bins=8).collect()}
    assert got == {0.0: -np.inf, 0.5: 25.0, 1.0: np.inf}
    assert histogram_quantiles(frame(spark, {"c": [1.0]}).limit(0), "value", [0.5], "c").count() == 0


@settings(max_examples=12, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.lists(st.floats(allow_nan=False, allow_infinity=False, width=32), min_size=1, max_size=60))
def test_any_values(spark, x):
    check(spark, {"c": x}, few=3, bins=4, scans=3)


def test_rows_are_not_shuffled(spark):
    """Of 20,000 distinct values a column, only those in the last bins are counted one by one."""
    x = np.random.default_rng(1).permutation(20_000).astype(float)
    df = frame(spark, {"a": x, "b": x * 2})
    a = sorted(map(tuple, histogram_quantiles(df, "value", [0.3, 0.7], "c").collect()))
    b = sorted((r["c"], r["p"], r["q"]) for r in exact_quantiles(df, "value", [0.3, 0.7], ["c"]).collect())
    assert [r[:2] for r in a] == [r[:2] for r in b] and np.allclose([r[2] for r in a], [r[2] for r in b])

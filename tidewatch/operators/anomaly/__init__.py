"""Unsupervised anomaly detectors.

Models are fitted with MLlib where it has the algorithm (K-means, GMM,
PCA) and with Spark-distributed custom code where it does not (isolation
forest, DBSCAN).  Fitted parameters are small by construction (k
centroids, k Gaussians, d×k loadings, T trees of ≤ 2ψ nodes) and are
shipped to executors inside the scoring UDF closure; scoring is an
Arrow-batched numpy kernel per partition.  Thresholds are exact
distributed quantiles of the scores.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ...plans.ordered import exact_quantiles


def as_vector(df: DataFrame, cols: list[str] | str, out: str = "features") -> DataFrame:
    """Feature vector from numeric columns, or from one array column."""
    if isinstance(cols, str):
        return df.withColumn(out, array_to_vector(F.col(cols).cast("array<double>")))
    arr = F.array(*[F.col(f"`{c}`").cast("double") for c in cols])
    return df.withColumn(out, array_to_vector(arr))


def features_array(col: str = "features") -> Column:
    return vector_to_array(col)


def matrix(series: pd.Series) -> np.ndarray:
    """Stack an Arrow batch of equal-length arrays into an (n, d) matrix."""
    if len(series) == 0:
        return np.zeros((0, 0))
    return np.vstack(series.to_numpy()).astype(np.float64)


def quantile_value(df: DataFrame, col: str, p: float) -> float:
    """One exact quantile as a driver scalar (the threshold of a detector)."""
    r = exact_quantiles(df, col, [p]).first()
    return float(r["q"]) if r and r["q"] is not None else float("nan")


def flag_rate(df: DataFrame, flag: str) -> float:
    return float(df.agg(F.avg(F.col(flag).cast("double"))).first()[0] or 0.0)

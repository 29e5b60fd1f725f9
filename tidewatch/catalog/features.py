"""Feature-engineering queries (statistics are SQL-checked)."""

from __future__ import annotations

from pyspark.ml.functions import vector_to_array
from pyspark.sql import functions as F

from ..operators import features as FE
from ..sources import adapters as A
from . import register
from .quality import NE_NUM

NE = "network_events"
_CAT = ["proto", "service", "state"]


def _union(parts):
    return "\nUNION ALL\n".join(parts)


@register("imputer_fill_values", "I5 I6", A.with_views(_union(
    [f"SELECT '{c}' AS column_name, 'numeric' AS kind, quantile_cont(CAST({c} AS DOUBLE), 0.5) AS median, "
     f"CAST(NULL AS VARCHAR) AS mode FROM network_events WHERE {c} IS NOT NULL" for c in NE_NUM] +
    [f"SELECT '{c}', 'categorical', CAST(NULL AS DOUBLE), (SELECT v FROM (SELECT {c} AS v, COUNT(*) AS n "
     f"FROM network_events WHERE {c} IS NOT NULL GROUP BY 1) g ORDER BY n DESC, v LIMIT 1)" for c in _CAT]), NE))
def q_fill_values(spark, sf):
    return FE.fill_values(A.network_events(spark, sf), NE_NUM, _CAT)


@register("scaler_stats", "I7 I8 T11", A.with_views(_union([
    f"SELECT '{c}' AS column_name, AVG(v) AS mean, CASE WHEN STDDEV_POP(v) > 0 THEN STDDEV_POP(v) ELSE 1.0 END AS std_scale, "
    f"quantile_cont(v, 0.5) AS median, CASE WHEN quantile_cont(v, 0.75) - quantile_cont(v, 0.25) <> 0 "
    f"THEN quantile_cont(v, 0.75) - quantile_cont(v, 0.25) ELSE 1.0 END AS iqr_scale "
    f"FROM (SELECT CAST({c} AS DOUBLE) AS v FROM network_events WHERE {c} IS NOT NULL) t" for c in NE_NUM]), NE))
def q_scaler_stats(spark, sf):
    return FE.scaler_stats(A.network_events(spark, sf), NE_NUM)


@register("class_weights", "J4", A.with_views("""
SELECT attack_cat, n_c, (SELECT COUNT(*) FROM network_events) / ((SELECT COUNT(DISTINCT attack_cat) FROM network_events) * n_c) AS weight
FROM (SELECT attack_cat, COUNT(*) AS n_c FROM network_events GROUP BY attack_cat) g""", NE))
def q_class_weights(spark, sf):
    return FE.class_weights(A.network_events(spark, sf), "attack_cat")


@register("stage1_pos_weight", "J3 T19", A.with_views("""
SELECT n_pos, n_neg, CASE WHEN n_pos > 0 THEN n_neg / n_pos END AS scale_pos_weight FROM (
  SELECT COUNT(*) FILTER (WHERE label = 1) AS n_pos, COUNT(*) FILTER (WHERE label <> 1) AS n_neg
  FROM network_events) t""", NE))
def q_pos_weight(spark, sf):
    return FE.positive_weight(A.network_events(spark, sf), "label")


_SCALED = ["sbytes", "dur", "spkts"]


@register("scaled_means_by_label", "I1 I2 I7 I9 I11", A.with_views(f"""
SELECT label, COUNT(*) AS n,
       {', '.join(f"AVG((CAST({c} AS DOUBLE) - s.m_{c}) / s.s_{c}) AS z_{c}" for c in _SCALED)},
       AVG(CASE WHEN proto = 'tcp' THEN 1.0 ELSE 0.0 END) AS ohe_proto_tcp
FROM network_events,
     (SELECT {', '.join(f"AVG(CAST({c} AS DOUBLE)) AS m_{c}, CASE WHEN STDDEV_POP({c}) > 0 THEN STDDEV_POP({c}) ELSE 1.0 END AS s_{c}" for c in _SCALED)}
      FROM network_events WHERE split = 'train') s
WHERE split = 'test' GROUP BY label""", NE))
def q_scaled_means(spark, sf):
    """Fit the flow preprocessor on the train split, transform the test
    split, and summarise three scaled slots and one one-hot slot."""
    ne = A.network_events(spark, sf)
    num, cat = ["sbytes", "dur", "spkts"], ["proto"]
    model = FE.build_preprocessor(num, cat).fit(ne.where("split = 'train'"))
    out = model.transform(ne.where("split = 'test'"))
    names = FE.feature_names(out)
    arr = vector_to_array("features")
    tcp = names.index("proto_tcp")
    return out.groupBy("label").agg(
        F.count(F.lit(1)).alias("n"),
        *[F.avg(arr[i]).alias(f"z_{c}") for i, c in enumerate(num)],
        F.avg(arr[tcp]).alias("ohe_proto_tcp"))

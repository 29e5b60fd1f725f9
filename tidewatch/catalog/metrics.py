"""Evaluation-metric queries on the ``scored`` view (and events for D9)."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import metrics as M
from ..operators.baselines import evaluation_table
from ..sources import adapters as A
from ..sources.tables import read_table
from . import register

S = "scored"


def _sd(a, b):
    return f"CASE WHEN ({b}) <> 0 THEN CAST({a} AS DOUBLE) / ({b}) ELSE 0.0 END"


_COUNTS = """(SELECT CAST(SUM(CASE WHEN y = 1 AND pred_a = 1 THEN 1 ELSE 0 END) AS BIGINT) AS tp,
        CAST(SUM(CASE WHEN y <> 1 AND pred_a = 1 THEN 1 ELSE 0 END) AS BIGINT) AS fp,
        CAST(SUM(CASE WHEN y = 1 AND pred_a <> 1 THEN 1 ELSE 0 END) AS BIGINT) AS fn,
        CAST(SUM(CASE WHEN y <> 1 AND pred_a <> 1 THEN 1 ELSE 0 END) AS BIGINT) AS tn FROM scored)"""


@register("binary_metrics", "L1 J9", A.with_views(f"""
SELECT tp + fp + fn + tn AS n, tp, fp, fn, tn,
       {_sd('tp + tn', 'tp + fp + fn + tn')} AS accuracy, {_sd('tp', 'tp + fp')} AS precision,
       {_sd('tp', 'tp + fn')} AS recall, {_sd('2 * tp', '2 * tp + fp + fn')} AS f1,
       ({_sd('2 * tp', '2 * tp + fp + fn')} + {_sd('2 * tn', '2 * tn + fn + fp')}) / 2 AS f1_macro,
       {_sd(f"{_sd('2 * tp', '2 * tp + fp + fn')} * (tp + fn) + {_sd('2 * tn', '2 * tn + fn + fp')} * (tn + fp)", 'tp + fp + fn + tn')} AS f1_weighted
FROM {_COUNTS} c""", S))
def q_binary_metrics(spark, sf):
    return M.binary_metrics(A.scored(spark, sf), "y", "pred_a")


@register("confusion_matrix", "L2", A.with_views("""
SELECT t.k AS true_label, p.k AS pred_label, CAST(COALESCE(c.n, 0) AS BIGINT) AS count
FROM (SELECT y AS k FROM scored UNION SELECT pred_a FROM scored) t
CROSS JOIN (SELECT y AS k FROM scored UNION SELECT pred_a FROM scored) p
LEFT JOIN (SELECT y, pred_a, COUNT(*) AS n FROM scored GROUP BY y, pred_a) c ON c.y = t.k AND c.pred_a = p.k""", S))
def q_confusion_matrix(spark, sf):
    return M.confusion_matrix(A.scored(spark, sf), "y", "pred_a")


_CR_CTES = f"""per AS (
  SELECT cls, CAST(SUM(t) AS BIGINT) AS support, SUM(tp) AS tp, SUM(p) AS n_pred FROM (
    SELECT CAST(y AS VARCHAR) AS cls, 1 AS t, CASE WHEN y = pred_a THEN 1 ELSE 0 END AS tp, 0 AS p FROM scored
    UNION ALL SELECT CAST(pred_a AS VARCHAR), 0, 0, 1 FROM scored) e GROUP BY cls),
rows AS (SELECT cls, {_sd('tp', 'n_pred')} AS precision, {_sd('tp', 'support')} AS recall,
                {_sd('2 * tp', 'support + n_pred')} AS f1, support FROM per)"""


@register("class_report", "L3", A.with_views("""
SELECT * FROM rows
UNION ALL SELECT 'macro avg', AVG(precision), AVG(recall), AVG(f1), CAST(SUM(support) AS BIGINT) FROM rows WHERE support > 0
UNION ALL SELECT 'weighted avg', SUM(precision * support) / SUM(support), SUM(recall * support) / SUM(support),
                 SUM(f1 * support) / SUM(support), CAST(SUM(support) AS BIGINT) FROM rows WHERE support > 0""",
    S, extra=_CR_CTES))
def q_class_report(spark, sf):
    return M.class_report(A.scored(spark, sf), "y", "pred_a")


_SUMMARY = f"""counts AS (SELECT tp, fp, fn, tn, tp + fp + fn + tn AS n FROM {_COUNTS} c),
summary AS (SELECT n, {_sd('tp + tn', 'n')} AS accuracy,
  {_sd(f"{_sd('2 * tp', '2 * tp + fp + fn')} * (tp + fn) + {_sd('2 * tn', '2 * tn + fn + fp')} * (tn + fp)", 'n')} AS f1_weighted FROM counts),
averages AS (
  SELECT * FROM rows
  UNION ALL SELECT 'macro avg', AVG(precision), AVG(recall), AVG(f1), CAST(SUM(support) AS BIGINT) FROM rows WHERE support > 0
  UNION ALL SELECT 'weighted avg', SUM(precision * support) / SUM(support), SUM(recall * support) / SUM(support),
                   SUM(f1 * support) / SUM(support), CAST(SUM(support) AS BIGINT) FROM rows WHERE support > 0)"""


@register("scored_evaluation", "J9 L1 L2 L3 L4", A.with_views("""
SELECT 'summary' AS section, 'all' AS item, u.measure, u.value FROM summary, LATERAL (
  SELECT 'n' AS measure, CAST(n AS DOUBLE) AS value UNION ALL SELECT 'accuracy', accuracy UNION ALL SELECT 'f1_weighted', f1_weighted) u
UNION ALL
SELECT 'summary', 'all', 'roc_auc', (SELECT SUM(CASE WHEN a.score > b.score THEN 1.0 WHEN a.score = b.score THEN 0.5 ELSE 0.0 END * a.n * b.n)
    / (SUM(a.n * b.n))
  FROM (SELECT CAST(score AS DOUBLE) AS score, COUNT(*) AS n FROM scored WHERE y = 1 GROUP BY 1) a,
       (SELECT CAST(score AS DOUBLE) AS score, COUNT(*) AS n FROM scored WHERE y <> 1 GROUP BY 1) b)
UNION ALL
SELECT 'confusion', CAST(t.k AS VARCHAR) || '>' || CAST(p.k AS VARCHAR), 'count', CAST(COALESCE(c.n, 0) AS DOUBLE)
FROM (SELECT y AS k FROM scored UNION SELECT pred_a FROM scored) t
CROSS JOIN (SELECT y AS k FROM scored UNION SELECT pred_a FROM scored) p
LEFT JOIN (SELECT y, pred_a, COUNT(*) AS n FROM scored GROUP BY y, pred_a) c ON c.y = t.k AND c.pred_a = p.k
UNION ALL
SELECT 'report', cls, u.measure, u.value FROM averages, LATERAL (
  SELECT 'precision' AS measure, CAST(precision AS DOUBLE) AS value UNION ALL SELECT 'recall', recall UNION ALL SELECT 'f1', f1
  UNION ALL SELECT 'support', CAST(support AS DOUBLE)) u""", S, extra=_CR_CTES + ",\n" + _SUMMARY))
def q_scored_evaluation(spark, sf):
    return evaluation_table(A.scored(spark, sf), "y", "pred_a", "score")


_SC = """(SELECT CAST(score AS DOUBLE) AS s, SUM(CASE WHEN y = 1 THEN 1 ELSE 0 END) AS pos,
        SUM(CASE WHEN y = 1 THEN 0 ELSE 1 END) AS neg FROM scored WHERE score IS NOT NULL GROUP BY 1)"""


@register("roc_auc", "L4 F6", A.with_views(f"""
SELECT CASE WHEN P * N > 0 THEN num / (CAST(P AS DOUBLE) * N) END AS roc_auc,
       CAST(P AS BIGINT) AS n_pos, CAST(N AS BIGINT) AS n_neg FROM (
  SELECT SUM(pos * (COALESCE(below, 0) + neg / 2.0)) AS num, SUM(pos) AS P, SUM(neg) AS N FROM (
    SELECT pos, neg, SUM(neg) OVER (ORDER BY s ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS below
    FROM {_SC} c) r) a""", S))
def q_roc_auc(spark, sf):
    return M.roc_auc(A.scored(spark, sf), "y", "score")


@register("roc_auc_by_split", "L4 F6", A.with_views("""
SELECT split, CASE WHEN P * N > 0 THEN num / (CAST(P AS DOUBLE) * N) END AS roc_auc,
       CAST(P AS BIGINT) AS n_pos, CAST(N AS BIGINT) AS n_neg FROM (
  SELECT split, SUM(pos * (COALESCE(below, 0) + neg / 2.0)) AS num, SUM(pos) AS P, SUM(neg) AS N FROM (
    SELECT split, pos, neg, SUM(neg) OVER (PARTITION BY split ORDER BY s ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS below
    FROM (SELECT split, CAST(score AS DOUBLE) AS s, SUM(CASE WHEN y = 1 THEN 1 ELSE 0 END) AS pos,
                 SUM(CASE WHEN y = 1 THEN 0 ELSE 1 END) AS neg FROM scored WHERE score IS NOT NULL GROUP BY 1, 2) c) r
  GROUP BY split) a""", S))
def q_roc_auc_by_split(spark, sf):
    return M.roc_auc(A.scored(spark, sf), "y", "score", group_cols=["split"])


@register("roc_points", "F4 L4", A.with_views(f"""
SELECT s AS threshold, CAST(cp AS BIGINT) AS tp, CAST(cn AS BIGINT) AS fp,
       {_sd('cp', 'tp_all')} AS tpr, {_sd('cn', 'tn_all')} AS fpr FROM (
  SELECT s, SUM(pos) OVER (ORDER BY s DESC ROWS UNBOUNDED PRECEDING) AS cp,
         SUM(neg) OVER (ORDER BY s DESC ROWS UNBOUNDED PRECEDING) AS cn,
         SUM(pos) OVER () AS tp_all, SUM(neg) OVER () AS tn_all FROM {_SC} c) r""", S))
def q_roc_points(spark, sf):
    return M.roc_points(A.scored(spark, sf), "y", "score")


@register("average_precision", "L6 F5", A.with_views(f"""
SELECT SUM(CASE WHEN tp_all > 0 THEN cp / (cp + cn) * pos / tp_all END) AS average_precision FROM (
  SELECT pos, SUM(pos) OVER (ORDER BY s DESC ROWS UNBOUNDED PRECEDING) AS cp,
         SUM(neg) OVER (ORDER BY s DESC ROWS UNBOUNDED PRECEDING) AS cn, SUM(pos) OVER () AS tp_all
  FROM {_SC} c) r""", S))
def q_average_precision(spark, sf):
    return M.average_precision(A.scored(spark, sf), "y", "score")


@register("adjusted_rand_index", "L8", A.with_views("""
SELECT CASE WHEN (sa + sb) / 2 = sa * sb / (n * (n - 1) / 2) THEN 1.0
            ELSE (idx - sa * sb / (n * (n - 1) / 2)) / ((sa + sb) / 2 - sa * sb / (n * (n - 1) / 2)) END AS ari
FROM s""", S, extra="""cont AS (SELECT pred_a, pred_b, COUNT(*) AS n FROM scored GROUP BY 1, 2),
     s AS (SELECT (SELECT SUM(CAST(n AS DOUBLE) * (n - 1) / 2) FROM (SELECT SUM(n) AS n FROM cont GROUP BY pred_a) a) AS sa,
                  (SELECT SUM(CAST(n AS DOUBLE) * (n - 1) / 2) FROM (SELECT SUM(n) AS n FROM cont GROUP BY pred_b) b) AS sb,
                  (SELECT SUM(CAST(n AS DOUBLE) * (n - 1) / 2) FROM cont) AS idx,
                  (SELECT CAST(SUM(n) AS DOUBLE) FROM cont) AS n)"""))
def q_ari(spark, sf):
    return M.adjusted_rand_index(A.scored(spark, sf), "pred_a", "pred_b")


def _mcnemar_sql(src: str) -> str:
    return f"""
SELECT b, c, p_value, CASE WHEN b > c THEN 'model_a' WHEN c > b THEN 'model_b' ELSE 'tie' END AS favours,
       p_value < 0.05 AS significant FROM (
  SELECT b, c, CASE WHEN b + c = 0 THEN 1.0 ELSE least(1.0, 2 * (
    SELECT SUM(exp(lgamma(b + c + 1) - lgamma(i + 1) - lgamma(b + c - i + 1) - (b + c) * ln(2)))
    FROM range(0, least(b, c) + 1) AS r(i))) END AS p_value
  FROM (SELECT COUNT(*) FILTER (WHERE ra AND NOT rb) AS b, COUNT(*) FILTER (WHERE NOT ra AND rb) AS c
        FROM {src} x) k) t"""


@register("mcnemar", "L10 T32 T33", A.with_views(_mcnemar_sql(
    "(SELECT pred_a = y AS ra, pred_b = y AS rb FROM scored)"), S))
def q_mcnemar(spark, sf):
    return M.mcnemar(A.scored(spark, sf), "y", "pred_a", "pred_b")


@register("mcnemar_paired_models", "D9 L10", _mcnemar_sql("""
(SELECT (a.pred = t.y) AS ra, (b.pred = t.y) AS rb
 FROM (SELECT event_id, CASE WHEN event_type = 'error' THEN 1 ELSE 0 END AS y FROM events) t
 JOIN (SELECT event_id, CASE WHEN value > 100 THEN 1 ELSE 0 END AS pred FROM events) a USING (event_id)
 JOIN (SELECT event_id, CASE WHEN user_id % 2 = 0 THEN 1 ELSE 0 END AS pred FROM events) b USING (event_id))"""))
def q_mcnemar_paired(spark, sf):
    """Predictions of two models stored separately, aligned by an
    equi-join on the record id (co-partitioned sort-merge at scale)."""
    ev = read_table(spark, sf, "events")
    truth = ev.select("event_id", F.when(F.col("event_type") == "error", 1).otherwise(0).alias("y"))
    a = ev.select("event_id", F.when(F.col("value") > 100, 1).otherwise(0).alias("pred_a"))
    b = ev.select("event_id", F.when(F.col("user_id") % 2 == 0, 1).otherwise(0).alias("pred_b"))
    paired = truth.join(a, "event_id").join(b, "event_id")
    return M.mcnemar(paired, "y", "pred_a", "pred_b")


def _grid_sql(select: str, tail: str = "") -> str:
    return A.with_views(f"""
SELECT {select} FROM (
  SELECT i AS step, t AS threshold, tp, fp, {_sd('tp', 'tp + fp')} AS precision, {_sd('tp', 'P')} AS recall,
         {_sd('2 * tp', 'tp + fp + P')} AS f1 FROM (
    SELECT g.i, g.t, CAST(COUNT(*) FILTER (WHERE s.score >= g.t AND s.y = 1) AS BIGINT) AS tp,
           CAST(COUNT(*) FILTER (WHERE s.score >= g.t AND s.y <> 1) AS BIGINT) AS fp,
           COUNT(*) FILTER (WHERE s.y = 1) AS P
    FROM (SELECT i, CASE WHEN i = 59 THEN hi ELSE i * ((hi - lo) / 59.0) + lo END AS t
          FROM range(0, 60) AS r(i),
               (SELECT quantile_cont(score, 0.70) AS lo, quantile_cont(score, 0.995) AS hi FROM scored) q) g
    CROSS JOIN (SELECT score, y FROM scored WHERE score IS NOT NULL) s
    GROUP BY g.i, g.t) c) curve {tail}""", S)


@register("f1_threshold_curve", "K13", _grid_sql("CAST(step AS INTEGER) AS step, threshold, tp, fp, precision, recall, f1"))
def q_f1_curve(spark, sf):
    return M.f1_threshold_curve(A.scored(spark, sf), "y", "score")


@register("best_threshold", "K13 T31", _grid_sql("threshold, f1, precision, recall",
                                                 "ORDER BY f1 DESC, step LIMIT 1"))
def q_best_threshold(spark, sf):
    return M.best_threshold_by_f1(A.scored(spark, sf), "y", "score")

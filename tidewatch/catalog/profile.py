"""Exploratory statistics queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.scalar import round_ratio_sql
from ..operators import profile as P
from ..sources import adapters as A
from . import register
from .quality import NE_NUM

NE = "network_events"


def _union(parts):
    return "\nUNION ALL\n".join(parts)


def _v(c, where=""):
    w = f" AND {where}" if where else ""
    return (f"(SELECT CAST({c} AS DOUBLE) AS v FROM network_events "
            f"WHERE {c} IS NOT NULL AND NOT isnan(CAST({c} AS DOUBLE)){w})")


_SKEW = "CASE WHEN COUNT(v) > 2 AND STDDEV_POP(v) > 0 THEN skewness(v) END"


@register("describe_numeric", "E20 E21", A.with_views(_union([
    f"SELECT '{c}' AS column_name, COUNT(v) AS count, AVG(v) AS mean, STDDEV_SAMP(v) AS std, MIN(v) AS min, "
    f"quantile_cont(v, 0.25) AS p25, quantile_cont(v, 0.5) AS p50, quantile_cont(v, 0.75) AS p75, "
    f"MAX(v) AS max, {_SKEW} AS skew FROM {_v(c)} t" for c in NE_NUM]), NE))
def q_describe_numeric(spark, sf):
    return P.describe(A.network_events(spark, sf), NE_NUM)


@register("skew_table", "E21", A.with_views(_union([
    f"SELECT '{c}' AS column_name, {_SKEW} AS skew FROM {_v(c)} t" for c in NE_NUM]), NE))
def q_skew_table(spark, sf):
    return P.skew_table(A.network_events(spark, sf), NE_NUM)


@register("percentile_summary", "E22 T12", A.with_views(_union([
    f"SELECT '{c}' AS column_name, quantile_cont(v, 0.5) AS p50, quantile_cont(v, 0.9) AS p90, "
    f"quantile_cont(v, 0.95) AS p95, quantile_cont(v, 0.99) AS p99 FROM {_v(c)} t" for c in NE_NUM]), NE))
def q_percentile_summary(spark, sf):
    return P.percentile_summary(A.network_events(spark, sf), NE_NUM)


@register("outlier_share", "E23", A.with_views(_union([
    f"SELECT '{c}' AS column_name, thr AS threshold, n_above, "
    f"{round_ratio_sql('n_above', 'n', 2, 100)} AS pct_above FROM ("
    f"SELECT (SELECT quantile_cont(v, 0.99) FROM {_v(c)} q) AS thr, "
    f"COUNT(*) FILTER (WHERE CAST({c} AS DOUBLE) > (SELECT quantile_cont(v, 0.99) FROM {_v(c)} q2)) AS n_above, "
    f"COUNT(*) AS n FROM network_events) t" for c in NE_NUM]), NE))
def q_outlier_share(spark, sf):
    return P.outlier_share(A.network_events(spark, sf), NE_NUM)


@register("below_p99_sbytes", "C12", A.with_views("""
SELECT label, COUNT(*) AS n, CAST(SUM(sbytes) AS BIGINT) AS sum_sbytes FROM network_events
WHERE sbytes <= (SELECT quantile_cont(CAST(sbytes AS DOUBLE), 0.99) FROM network_events)
GROUP BY label""", NE))
def q_below_p99(spark, sf):
    k = P.keep_below_quantile(A.network_events(spark, sf), "sbytes", 0.99)
    return k.groupBy("label").agg(F.count(F.lit(1)).alias("n"), F.sum("sbytes").alias("sum_sbytes"))


def _corr_sql(x, y):
    return (f"CASE WHEN STDDEV_POP({x}) * STDDEV_POP({y}) > 0 "
            f"THEN COVAR_POP({x}, {y}) / (STDDEV_POP({x}) * STDDEV_POP({y})) END")


_NE_NUM_ALL = NE_NUM


@register("leakage_scan", "E24 E25 T9 T10", A.with_views(f"""
SELECT column_name, round(abs_corr, 4) AS abs_corr, COALESCE(abs_corr > 0.95, false) AS leak_flag FROM (
{_union([f"SELECT '{c}' AS column_name, abs({_corr_sql(f'CAST({c} AS DOUBLE)', 'CAST(label AS DOUBLE)')}) AS abs_corr FROM network_events" for c in _NE_NUM_ALL])}
) t ORDER BY abs_corr DESC NULLS LAST, column_name""", NE))
def q_leakage_scan(spark, sf):
    ne = A.network_events(spark, sf).select(*NE_NUM, "label")
    return P.leakage_scan(ne, "label")


_CORR_COLS = ["dur", "sbytes", "dbytes", "sttl", "dttl", "spkts", "dpkts", "label"]


@register("corr_matrix", "E26", A.with_views(_union([
    f"SELECT '{a}' AS col_a, '{b}' AS col_b, {_corr_sql(f'CAST({a} AS DOUBLE)', f'CAST({b} AS DOUBLE)')} AS corr "
    f"FROM network_events" for a in _CORR_COLS for b in _CORR_COLS]), NE))
def q_corr_matrix(spark, sf):
    return P.corr_matrix(A.network_events(spark, sf), _CORR_COLS)


@register("strong_corr_pairs", "E27 T29", A.with_views(f"""
SELECT col_a, col_b, corr FROM (
{_union([f"SELECT '{a}' AS col_a, '{b}' AS col_b, {_corr_sql(f'CAST({a} AS DOUBLE)', f'CAST({b} AS DOUBLE)')} AS corr FROM network_events" for a in NE_NUM + ['label'] for b in NE_NUM + ['label'] if a != b])}
) t WHERE abs(corr) > 0.6 ORDER BY abs(corr) DESC, col_a, col_b LIMIT 10""", NE))
def q_strong_pairs(spark, sf):
    return P.strong_pairs(A.network_events(spark, sf), NE_NUM + ["label"])


@register("extreme_z_rate", "E28 T11 T30", A.with_views(_union([
    f"SELECT '{c}' AS column_name, AVG(CASE WHEN sd > 0 THEN CAST(abs(v - mu) / sd > 4 AS DOUBLE) ELSE 0.0 END) AS extreme_rate "
    f"FROM (SELECT CAST({c} AS DOUBLE) AS v FROM network_events WHERE {c} IS NOT NULL) t, "
    f"(SELECT AVG(CAST({c} AS DOUBLE)) AS mu, STDDEV_POP(CAST({c} AS DOUBLE)) AS sd FROM network_events) s"
    for c in NE_NUM]), NE))
def q_extreme_z(spark, sf):
    return P.extreme_z_rate(A.network_events(spark, sf), NE_NUM)


@register("event_rarity", "E29", A.with_views("""
SELECT event_id, count, count / SUM(count) OVER () AS frequency, 1.0 / (count / SUM(count) OVER ()) AS rarity
FROM (SELECT event_id, COUNT(*) AS count FROM system_call_events GROUP BY event_id) g""",
    "system_call_events"))
def q_event_rarity(spark, sf):
    return P.event_rarity(A.system_call_events(spark, sf), "event_id")


_KS_COLS = NE_NUM


def _ks_sql():
    parts = []
    for c in _KS_COLS:
        parts.append(f"""SELECT '{c}' AS column_name, MAX(abs(ca / ta - cb / tb)) AS ks_stat,
  CAST(MAX(ta) AS BIGINT) AS n_a, CAST(MAX(tb) AS BIGINT) AS n_b FROM (
  SELECT SUM(na) OVER (ORDER BY v ROWS UNBOUNDED PRECEDING) AS ca, SUM(na) OVER () AS ta,
         SUM(nb) OVER (ORDER BY v ROWS UNBOUNDED PRECEDING) AS cb, SUM(nb) OVER () AS tb
  FROM (SELECT CAST({c} AS DOUBLE) AS v, SUM(CASE WHEN split = 'train' THEN 1 ELSE 0 END) AS na,
               SUM(CASE WHEN split = 'test' THEN 1 ELSE 0 END) AS nb
        FROM network_events WHERE {c} IS NOT NULL GROUP BY 1) g) r""")
    z = "(ks_stat * sqrt(CAST(n_a AS DOUBLE) * n_b / (n_a + n_b)))"
    series = (f"(SELECT SUM(power(-1.0, k - 1) * exp(-2.0 * k * k * {z} * {z})) "
              f"FROM range(1, 101) AS r(k))")
    return (f"SELECT column_name, ks_stat, n_a, n_b, CASE WHEN {z} < 0.2 THEN 1.0 "
            f"ELSE least(1.0, greatest(0.0, 2 * {series})) END AS p_value FROM (\n"
            + _union(parts) + "\n) s ORDER BY ks_stat DESC, column_name LIMIT 10")


@register("ks_two_sample", "E30", A.with_views(_ks_sql(), NE))
def q_ks(spark, sf):
    ne = A.network_events(spark, sf)
    return P.ks_two_sample(ne.where("split = 'train'"), ne.where("split = 'test'"), _KS_COLS, max_cols=20)


@register("crosstab_pct", "E31", A.with_views(f"""
SELECT proto, label, n, {round_ratio_sql('n', 'col_total', 2, 100)} AS pct FROM
  (SELECT proto, label, COUNT(*) AS n FROM network_events GROUP BY proto, label) g
  JOIN (SELECT label, COUNT(*) AS col_total FROM network_events GROUP BY label) t USING (label)""", NE))
def q_crosstab(spark, sf):
    return P.crosstab_pct(A.network_events(spark, sf), "proto", "label")


@register("score_by_class", "E32", A.with_views("""
SELECT label, COUNT(dur) AS n, AVG(dur) AS mean, STDDEV_SAMP(dur) AS std, MIN(dur) AS min, MAX(dur) AS max
FROM network_events GROUP BY label""", NE))
def q_score_by_class(spark, sf):
    return P.score_by_class(A.network_events(spark, sf), "dur", "label")


@register("boxplot_stats", "E33", A.with_views("""
SELECT q.attack_cat, w.n, q1, median, q3, iqr, whisker_lo, whisker_hi, n_outside FROM
 (SELECT attack_cat, quantile_cont(CAST(sbytes AS DOUBLE), 0.25) AS q1, quantile_cont(CAST(sbytes AS DOUBLE), 0.5) AS median,
         quantile_cont(CAST(sbytes AS DOUBLE), 0.75) AS q3,
         quantile_cont(CAST(sbytes AS DOUBLE), 0.75) - quantile_cont(CAST(sbytes AS DOUBLE), 0.25) AS iqr
  FROM network_events WHERE sbytes IS NOT NULL GROUP BY attack_cat) q
 JOIN (SELECT e.attack_cat, COUNT(*) AS n,
         MIN(CASE WHEN sbytes >= q1 - 1.5 * (q3 - q1) THEN CAST(sbytes AS DOUBLE) END) AS whisker_lo,
         MAX(CASE WHEN sbytes <= q3 + 1.5 * (q3 - q1) THEN CAST(sbytes AS DOUBLE) END) AS whisker_hi,
         COUNT(*) FILTER (WHERE sbytes < q1 - 1.5 * (q3 - q1) OR sbytes > q3 + 1.5 * (q3 - q1)) AS n_outside
       FROM network_events e JOIN (SELECT attack_cat, quantile_cont(CAST(sbytes AS DOUBLE), 0.25) AS q1,
                                   quantile_cont(CAST(sbytes AS DOUBLE), 0.75) AS q3
                                   FROM network_events GROUP BY attack_cat) qq USING (attack_cat)
       WHERE sbytes IS NOT NULL GROUP BY e.attack_cat) w ON q.attack_cat = w.attack_cat""", NE))
def q_boxplot(spark, sf):
    return P.boxplot_stats(A.network_events(spark, sf), "sbytes", "attack_cat")


def _hist_sql(expr, where, bins, group=None):
    g = f"{group}, " if group else ""
    grid = (f"(SELECT {group}, bin FROM (SELECT DISTINCT {group} FROM src) c, range(0, {bins}) AS r(bin)) grid"
            if group else f"range(0, {bins}) AS r(bin)")
    return f"""
WITH src AS (SELECT {g}{expr} AS x FROM network_events WHERE {where}),
     mm AS (SELECT MIN(x) AS lo, MAX(x) AS hi FROM src),
     cnt AS (SELECT {g}CAST(CASE WHEN hi = lo THEN 0 ELSE least(floor((x - lo) / ((hi - lo) / {float(bins)})), {bins - 1}) END AS INTEGER) AS bin,
                    COUNT(*) AS count FROM src, mm GROUP BY ALL)
SELECT {g}CAST(bin AS INTEGER) AS bin, lo + bin * ((hi - lo) / {float(bins)}) AS bin_lo,
       CASE WHEN bin = {bins - 1} THEN hi ELSE lo + (bin + 1) * ((hi - lo) / {float(bins)}) END AS bin_hi,
       CAST(COALESCE(count, 0) AS BIGINT) AS count
FROM {grid} CROSS JOIN mm LEFT JOIN cnt USING ({g}bin)"""


def _hist_wrap(body):
    # the view CTEs must precede the histogram CTEs: splice them together
    sql = A.with_views("SELECT 1", NE)
    head = sql[:sql.rindex("\nSELECT 1")]
    return head + "," + body.strip()[len("WITH"):]


@register("histogram_dur", "E34", _hist_wrap(_hist_sql("CAST(dur AS DOUBLE)", "dur IS NOT NULL AND NOT isnan(dur)", 40)))
def q_hist_dur(spark, sf):
    return P.histogram(A.network_events(spark, sf), "dur", bins=40)


@register("histogram_log_sbytes_by_label", "E34 C11 H11", _hist_wrap(_hist_sql(
    "ln(1 + CAST(sbytes AS DOUBLE))", "sbytes IS NOT NULL AND CAST(sbytes AS DOUBLE) > -1", 50, group="label")))
def q_hist_log(spark, sf):
    return P.histogram(A.network_events(spark, sf), "sbytes", bins=50, log1p=True, group="label")

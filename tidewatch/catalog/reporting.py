"""Reporting queries (dashboard, notebooks, SQL views)."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.scalar import round_ratio_sql
from ..operators import reports as R
from ..sources import adapters as A
from ..sources.registry import registry_from_views
from . import register

NE, SC, MR, AL, US = "network_events", "system_call_events", "model_runs", "alerts", "users"


@register("attack_distribution", "E5 F1 H4", A.with_views(f"""
SELECT attack_cat, total, {round_ratio_sql('total', 'SUM(total) OVER ()', 2, 100)} AS pct
FROM (SELECT attack_cat, COUNT(*) AS total FROM network_events WHERE label = 1 GROUP BY attack_cat) g
""", NE))
def q_attack_distribution(spark, sf):
    return R.attack_distribution(A.network_events(spark, sf))


@register("attack_category_counts", "E3 C9", A.with_views("""
SELECT attack_cat, COUNT(*) AS count FROM network_events WHERE label = 1
GROUP BY attack_cat ORDER BY count DESC, attack_cat""", NE))
def q_attack_category_counts(spark, sf):
    return R.attack_category_counts(A.network_events(spark, sf))


@register("label_split", "E4", A.with_views(
    "SELECT label, COUNT(*) AS count FROM network_events GROUP BY label", NE))
def q_label_split(spark, sf):
    return R.label_split(A.network_events(spark, sf))


@register("protocol_breakdown", "E6 H5", A.with_views(f"""
SELECT proto, total_flows, attacks, {round_ratio_sql('attacks', 'total_flows', 1, 100)} AS attack_pct
FROM (SELECT proto, COUNT(*) AS total_flows,
             CAST(SUM(CASE WHEN label = 1 THEN 1 ELSE 0 END) AS BIGINT) AS attacks
      FROM network_events GROUP BY proto) g
ORDER BY total_flows DESC, proto LIMIT 10""", NE))
def q_protocol_breakdown(spark, sf):
    return R.protocol_breakdown(A.network_events(spark, sf))


@register("traffic_by_class", "E7 H5", A.with_views(f"""
SELECT CASE WHEN label = 1 THEN 'Attack' ELSE 'Normal' END AS traffic_type, n_flows,
       {round_ratio_sql('s_sb', 'n_flows', 0)} AS avg_src_bytes,
       {round_ratio_sql('s_db', 'n_flows', 0)} AS avg_dst_bytes,
       avg_duration,
       {round_ratio_sql('s_sp', 'n_flows', 1)} AS avg_src_pkts
FROM (SELECT label, COUNT(*) AS n_flows, SUM(sbytes) AS s_sb, SUM(dbytes) AS s_db,
             AVG(dur) AS avg_duration, SUM(spkts) AS s_sp
      FROM network_events GROUP BY label) g""", NE))
def q_traffic_by_class(spark, sf):
    return R.traffic_by_class(A.network_events(spark, sf))


@register("evil_counts", "E8", A.with_views(
    "SELECT evil, COUNT(*) AS count FROM system_call_events GROUP BY evil", SC))
def q_evil_counts(spark, sf):
    return R.evil_counts(A.system_call_events(spark, sf))


@register("evil_rates", "E8", A.with_views("""
SELECT split, COUNT(*) AS n, AVG(evil) AS evil_rate, AVG(sus) AS sus_rate
FROM system_call_events GROUP BY split""", SC))
def q_evil_rates(spark, sf):
    return R.evil_rates(A.system_call_events(spark, sf))


@register("top_event_ids", "E9 G5", A.with_views("""
SELECT event_id, COUNT(*) AS count FROM system_call_events
GROUP BY event_id ORDER BY count DESC, event_id LIMIT 10""", SC))
def q_top_event_ids(spark, sf):
    return R.top_event_ids(A.system_call_events(spark, sf))


_SEV = ("CASE severity WHEN 'critical' THEN 1 WHEN 'high' THEN 2 WHEN 'medium' THEN 3 "
        "WHEN 'low' THEN 4 ELSE 5 END")
_SEV_NB = "CASE severity WHEN 'critical' THEN 1 WHEN 'high' THEN 2 WHEN 'medium' THEN 3 ELSE 4 END"


@register("alert_summary", "E10 G4 H13", A.with_views(f"""
SELECT severity, status, COUNT(*) AS alert_count, {_SEV} AS priority
FROM alerts GROUP BY severity, status ORDER BY priority, severity, status""", AL))
def q_alert_summary(spark, sf):
    return R.alert_summary(A.alerts(spark, sf))


@register("alert_summary_notebook", "E10 G4 T24", A.with_views(f"""
SELECT severity, status, COUNT(*) AS alert_count, {_SEV_NB} AS priority
FROM alerts GROUP BY severity, status ORDER BY priority, severity, status""", AL))
def q_alert_summary_nb(spark, sf):
    return R.alert_summary(A.alerts(spark, sf), notebook_order=True)


@register("users_by_role", "E11", A.with_views(
    "SELECT role, COUNT(*) AS count FROM users GROUP BY role", US))
def q_users_by_role(spark, sf):
    return R.users_by_role(A.users(spark, sf))


_REGISTRY_SQL = """
dataset_registry AS (
  SELECT 'unsw_nb15' AS name, COUNT(*) AS row_count FROM network_events
  UNION ALL SELECT 'beth' AS name, COUNT(*) AS row_count FROM system_call_events)"""


@register("platform_summary", "E1", A.with_views("""
SELECT (SELECT COUNT(*) FROM dataset_registry) AS datasets_registered,
       (SELECT COUNT(*) FROM network_events) AS network_events_stored,
       (SELECT COUNT(*) FROM system_call_events) AS syscall_events_stored,
       (SELECT COUNT(*) FROM alerts WHERE status = 'open') AS open_alerts,
       (SELECT COUNT(*) FROM model_runs) AS model_runs,
       (SELECT MAX(roc_auc) FROM model_runs) AS best_roc_auc""", NE, SC, AL, MR, extra=_REGISTRY_SQL))
def q_platform_summary(spark, sf):
    ne, sc = A.network_events(spark, sf), A.system_call_events(spark, sf)
    return R.platform_summary(registry_from_views(ne, sc), ne, sc, A.alerts(spark, sf),
                              A.model_runs(spark, sf))


@register("table_counts", "E2", A.with_views("""
SELECT 'users' AS table_name, COUNT(*) AS n FROM users
UNION ALL SELECT 'network_events', COUNT(*) FROM network_events
UNION ALL SELECT 'system_call_events', COUNT(*) FROM system_call_events
UNION ALL SELECT 'model_runs', COUNT(*) FROM model_runs
UNION ALL SELECT 'alerts', COUNT(*) FROM alerts""", US, NE, SC, MR, AL))
def q_table_counts(spark, sf):
    return R.table_counts({
        "users": A.users(spark, sf), "network_events": A.network_events(spark, sf),
        "system_call_events": A.system_call_events(spark, sf),
        "model_runs": A.model_runs(spark, sf), "alerts": A.alerts(spark, sf)})


@register("model_leaderboard", "G1 C22 T22", A.with_views("""
SELECT id, run_name, algorithm, dataset_name, roc_auc, f1_weighted, accuracy, created_at
FROM model_runs ORDER BY roc_auc DESC NULLS LAST, id LIMIT 20""", MR))
def q_model_leaderboard(spark, sf):
    return R.leaderboard(A.model_runs(spark, sf))


@register("recent_alerts", "G2", A.with_views("""
SELECT id, severity, status, attack_code, created_at FROM alerts
ORDER BY created_at DESC, id DESC LIMIT 100""", AL))
def q_recent_alerts(spark, sf):
    return R.recent(A.alerts(spark, sf), ["id", "severity", "status", "attack_code", "created_at"], 100)


@register("recent_runs", "G3 A9", A.with_views("""
SELECT id, run_name, model_type, algorithm, roc_auc, created_at FROM model_runs
ORDER BY created_at DESC, id DESC LIMIT 20""", MR))
def q_recent_runs(spark, sf):
    return R.recent(A.model_runs(spark, sf),
                    ["id", "run_name", "model_type", "algorithm", "roc_auc", "created_at"], 20)


@register("open_alert_queue", "C10 G4 T23", A.with_views(f"""
SELECT id, severity, status, attack_code, confidence, created_at, {_SEV} AS priority
FROM alerts WHERE status = 'open' ORDER BY priority, created_at DESC, id LIMIT 50""", AL))
def q_open_alert_queue(spark, sf):
    return R.alert_queue(A.alerts(spark, sf), status="open", limit=50)


@register("alert_queue_all", "C10 G4 T23", A.with_views(f"""
SELECT id, severity, status, attack_code, confidence, created_at, {_SEV} AS priority
FROM alerts ORDER BY priority, created_at DESC, id""", AL))
def q_alert_queue_all(spark, sf):
    return R.alert_queue(A.alerts(spark, sf))


@register("users_listing", "G6 A9", A.with_views(
    "SELECT id, username, role, is_active FROM users ORDER BY id", US))
def q_users_listing(spark, sf):
    return A.users(spark, sf).select("id", "username", "role", "is_active").orderBy("id")


@register("latest_run_per_algorithm", "F2", A.with_views("""
SELECT algorithm, dataset_name, id, run_name, model_type, roc_auc, f1_weighted, accuracy,
       extra_metrics, created_by, created_at
FROM (SELECT *, row_number() OVER (PARTITION BY algorithm, dataset_name
                                   ORDER BY created_at DESC, id DESC) AS rn FROM model_runs) t
WHERE rn = 1""", MR))
def q_latest_run(spark, sf):
    return R.latest_run_per_algorithm(A.model_runs(spark, sf))


@register("run_ci_bars", "L12 H8 H9 T20", A.with_views("""
SELECT algorithm, dataset_name, run_name, roc_auc, ci_lower, ci_upper,
       ci_lower IS NOT NULL AND ci_upper IS NOT NULL AS has_ci,
       CASE WHEN ci_upper IS NOT NULL AND roc_auc IS NOT NULL THEN greatest(ci_upper - roc_auc, 0.0) END AS err_plus,
       CASE WHEN ci_lower IS NOT NULL AND roc_auc IS NOT NULL THEN greatest(roc_auc - ci_lower, 0.0) END AS err_minus,
       metric_k
FROM (SELECT *,
        TRY_CAST(json_extract_string(extra_metrics, '$.roc_auc_ci.lower') AS DOUBLE) AS ci_lower,
        TRY_CAST(json_extract_string(extra_metrics, '$.roc_auc_ci.upper') AS DOUBLE) AS ci_upper,
        TRY_CAST(json_extract_string(extra_metrics, '$.k') AS DOUBLE) AS metric_k,
        row_number() OVER (PARTITION BY algorithm, dataset_name ORDER BY created_at DESC, id DESC) AS rn
      FROM model_runs) t
WHERE rn = 1""", MR))
def q_run_ci_bars(spark, sf):
    return R.run_ci_bars(A.model_runs(spark, sf))


@register("alerts_with_users", "D3 D6", A.with_views("""
SELECT a.id, a.severity, a.status, a.acknowledged_by, u.username AS acknowledged_by_name,
       u.role AS acknowledged_by_role
FROM alerts a LEFT JOIN users u ON a.acknowledged_by = u.id""", AL, US))
def q_alerts_with_users(spark, sf):
    return R.alerts_with_users(A.alerts(spark, sf), A.users(spark, sf))


@register("runs_with_creator", "D4", A.with_views("""
SELECT r.id, r.run_name, r.created_by, u.username AS creator
FROM model_runs r LEFT JOIN users u ON r.created_by = u.id""", MR, US))
def q_runs_with_creator(spark, sf):
    return R.runs_with_creator(A.model_runs(spark, sf), A.users(spark, sf))


@register("experiment_comparison", "N5 C23", A.with_views("""
SELECT id, algorithm, model_type, f1_weighted, accuracy,
       f1_weighted = (SELECT MAX(f1_weighted) FROM model_runs WHERE dataset_name = 'flows') AS is_best
FROM model_runs WHERE dataset_name = 'flows'""", MR))
def q_experiment_comparison(spark, sf):
    return R.experiment_comparison(A.model_runs(spark, sf), "flows")


@register("attack_share_by_protocol_sql", "A7 E6", A.with_views("""
SELECT proto, COUNT(*) AS n, CAST(SUM(label) AS BIGINT) AS attacks
FROM network_events GROUP BY proto""", NE))
def q_sql_text(spark, sf):
    """Ad-hoc SQL text over registered temp views (the SQL explorer)."""
    A.register_views(spark, sf, ["network_events"])
    return spark.sql("SELECT proto, COUNT(*) AS n, CAST(SUM(label) AS BIGINT) AS attacks "
                     "FROM network_events GROUP BY proto")


@register("prediction_provenance", "D2 D5 B8", A.with_views("""
SELECT r.algorithm, r.dataset_name, s.evil, p.predicted_label, COUNT(*) AS n
FROM (SELECT record_id AS source_record_id, 'system_call_events' AS event_source, sus AS predicted_label,
             (SELECT MAX(id) FROM model_runs) AS model_run_id FROM system_call_events) p
LEFT JOIN model_runs r ON p.model_run_id = r.id
LEFT JOIN system_call_events s ON p.source_record_id = s.record_id
GROUP BY 1, 2, 3, 4""", "system_call_events", "model_runs"))
def q_prediction_provenance(spark, sf):
    sc, mr = A.system_call_events(spark, sf), A.model_runs(spark, sf)
    latest = mr.agg(F.max("id")).scalar()
    preds = sc.select(F.col("record_id").alias("source_record_id"),
                      F.lit("system_call_events").alias("event_source"),
                      F.col("sus").alias("predicted_label"), latest.alias("model_run_id"))
    ctx = R.predictions_with_context(preds, mr, {"system_call_events": (sc.select("record_id", "evil"),
                                                                        "record_id")})
    return ctx.groupBy("algorithm", "dataset_name", "evil", "predicted_label").agg(F.count(F.lit(1)).alias("n"))

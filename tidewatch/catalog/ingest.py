"""Ingest / sink queries.  Raw CSV inputs are written by Spark from the
domain views into the shared scratch folder (``spark.checkpoint.dir``),
then loaded back through the CSV ingesters, so the work grows with the
tables and the oracle is the same aggregate over the view."""

from __future__ import annotations

import os
import uuid

from pyspark.sql import functions as F

from ..session import scratch_path
from ..sources import adapters as A
from ..sources import ingest as G
from ..sources.registry import registry_rows, upsert_registry
from . import register

NE = "network_events"


def _raw_flow_csvs(spark, sf):
    """Flow splits as raw CSV with messy headers (padded, upper-case) and
    an ``id`` column, as the source files come."""
    ne = A.network_events(spark, sf)
    base = scratch_path(spark, f"raw-{uuid.uuid4().hex}")
    paths = {}
    for split in ("train", "test"):
        d = ne.where(F.col("split") == split).drop("split")
        d = d.select(F.monotonically_increasing_id().alias(" ID "),
                     *[F.col(c).alias(f" {c.upper()} ") for c in d.columns])
        p = os.path.join(base, f"flows_{split}.csv")
        d.write.mode("overwrite").option("header", True).csv(p)
        paths[split] = p
    return paths, base


@register("csv_flow_ingest", "A1 A8 B1 C1 C2 H1 H2 H3 T6", A.with_views("""
SELECT split, COUNT(*) AS n_rows, CAST(SUM(sbytes) AS BIGINT) AS sum_sbytes, SUM(dur) AS sum_dur,
       COUNT(DISTINCT attack_cat) AS n_attack_cat, CAST(MAX(length(service)) AS INTEGER) AS max_service_len,
       CAST(SUM(label) AS BIGINT) AS n_attacks
FROM network_events GROUP BY split""", NE))
def q_csv_flow_ingest(spark, sf):
    paths, _ = _raw_flow_csvs(spark, sf)
    raw = G.load_flows(spark, paths["train"], paths["test"])
    flows = G.flow_projection(raw)
    return flows.groupBy("split").agg(
        F.count(F.lit(1)).alias("n_rows"), F.sum("sbytes").alias("sum_sbytes"),
        F.sum("dur").alias("sum_dur"), F.count_distinct("attack_cat").alias("n_attack_cat"),
        F.max(F.length("service")).alias("max_service_len"), F.sum("label").alias("n_attacks"))


@register("partitioned_flow_table", "B1 B3 B4 D1", A.with_views("""
SELECT r.name, r.row_count, r.column_count, f.split, f.n FROM
  (SELECT 'unsw_nb15_train' AS name, COUNT(*) FILTER (WHERE split = 'train') AS row_count, CAST(18 AS BIGINT) AS column_count FROM network_events
   UNION ALL SELECT 'unsw_nb15_test', COUNT(*) FILTER (WHERE split = 'test'), CAST(18 AS BIGINT) FROM network_events) r
  JOIN (SELECT CASE split WHEN 'train' THEN 'unsw_nb15_train' ELSE 'unsw_nb15_test' END AS name, split, COUNT(*) AS n
        FROM network_events GROUP BY split) f USING (name)""", NE))
def q_partitioned_table(spark, sf):
    """Ingest both splits into a split-partitioned Parquet table, upsert
    the registry, and join facts back to their registry row (D1)."""
    paths, base = _raw_flow_csvs(spark, sf)
    table = os.path.join(base, "network_events")
    stored, reg = G.ingest_flows(spark, paths["train"], paths["test"], table, None, truncate=True)
    reg = reg.withColumn("id", F.when(F.col("name") == "unsw_nb15_train", 1).otherwise(2).cast("bigint"))
    facts = stored.groupBy("dataset_id", "split").agg(F.count(F.lit(1)).alias("n"))
    return facts.join(reg, facts.dataset_id == reg.id, "left").select(
        "name", "row_count", "column_count", "split", "n")


@register("registry_upsert", "B4 T3", A.with_views("""
SELECT name, source_file, row_count, column_count, description FROM (
  SELECT 'unsw_nb15' AS name, 'flows.csv' AS source_file, (SELECT COUNT(*) FROM network_events) AS row_count,
         CAST(18 AS BIGINT) AS column_count, 'old' AS description
  UNION ALL SELECT 'beth', 'beth.csv', COUNT(*) FILTER (WHERE split = 'labelled_train'), CAST(12 AS BIGINT), 'old'
  FROM system_call_events
  UNION ALL SELECT 'alerts', 'new.csv', (SELECT COUNT(*) FROM alerts), CAST(7 AS BIGINT), 'new') t""",
    NE, "system_call_events", "alerts"))
def q_registry_upsert(spark, sf):
    ne, sc, al = A.network_events(spark, sf), A.system_call_events(spark, sf), A.alerts(spark, sf)
    current = (registry_rows("unsw_nb15", ne.where("split = 'train'"), "flows.csv", "old")
               .unionByName(registry_rows("beth", sc.where("split = 'labelled_train'"), "beth.csv", "old")))
    incoming = (registry_rows("unsw_nb15", ne, "other.csv", "new")
                .unionByName(registry_rows("alerts", al, "new.csv", "new")))
    return upsert_registry(current, incoming)


@register("erase_subject_runs", "B11 D6", A.with_views("""
SELECT dataset_name, COUNT(*) AS n FROM model_runs
WHERE created_by NOT IN (SELECT id FROM users WHERE role = 'viewer' AND NOT is_active)
GROUP BY dataset_name""", "model_runs", "users"))
def q_erase(spark, sf):
    users = A.users(spark, sf)
    gone = users.where((F.col("role") == "viewer") & ~F.col("is_active")).select(F.col("id").alias("created_by"))
    kept = G.erase_subject(A.model_runs(spark, sf), gone, "created_by", subjects=users, subject_key="id")
    return kept.groupBy("dataset_name").agg(F.count(F.lit(1)).alias("n"))


@register("acknowledge_alerts", "N4 D3", A.with_views("""
SELECT CASE WHEN severity = 'critical' AND status = 'open' THEN 'acknowledged' ELSE status END AS status,
       COUNT(*) AS n, COUNT(acknowledged_by) AS n_with_user,
       COUNT(*) FILTER (WHERE severity = 'critical' AND status = 'open') AS n_acked_now
FROM (SELECT id, severity, status,
             CASE WHEN severity = 'critical' AND status = 'open' THEN id % 1500 + 1 ELSE acknowledged_by END AS acknowledged_by
      FROM alerts) a
GROUP BY 1""", "alerts"))
def q_ack(spark, sf):
    al = A.alerts(spark, sf)
    acks = al.where((F.col("severity") == "critical") & (F.col("status") == "open")).select(
        "id", (F.col("id") % 1500 + 1).alias("acknowledged_by"),
        (F.col("created_at") + F.expr("INTERVAL 1 DAY")).alias("acknowledged_at"))
    out = G.acknowledge(al, acks)
    just = acks.select("id", F.lit(1).alias("_now"))
    o = out.join(just, "id", "left")
    return o.groupBy("status").agg(F.count(F.lit(1)).alias("n"), F.count("acknowledged_by").alias("n_with_user"),
                                   F.count("_now").alias("n_acked_now"))


@register("insert_missing_alerts", "B5 D6", A.with_views("""
SELECT status, COUNT(*) AS n FROM alerts WHERE id NOT IN (SELECT id FROM alerts WHERE status = 'open')
GROUP BY status""", "alerts"))
def q_insert_missing(spark, sf):
    al = A.alerts(spark, sf)
    new = G.insert_missing(al.where("status = 'open'"), al, ["id"])
    return new.groupBy("status").agg(F.count(F.lit(1)).alias("n"))


@register("dataset_summary", "A4 A5 E14", A.with_views("""
SELECT 'flows_train' AS dataset, COUNT(*) AS rows, 18 AS columns, 'label' AS target, 0.0 AS missing_pct, 'ok' AS status
FROM network_events WHERE split = 'train'
UNION ALL SELECT 'flows_test', COUNT(*), 18, 'label', 0.0, 'ok' FROM network_events WHERE split = 'test'
UNION ALL SELECT 'attacks', CAST(NULL AS BIGINT), CAST(NULL AS INTEGER), 'Attack Type', CAST(NULL AS DOUBLE), 'file_missing'""", NE))
def q_dataset_summary(spark, sf):
    paths, base = _raw_flow_csvs(spark, sf)
    return G.dataset_summary(spark, {
        "flows_train": (paths["train"], "label"), "flows_test": (paths["test"], "label"),
        "attacks": (os.path.join(base, "no_such_file.csv"), "Attack Type")})


@register("results_to_runs", "B6 B7 H10 H18")
def q_results_to_runs(spark, sf):
    """A results table aggregated from the runs, persisted as run rows."""
    mr = A.model_runs(spark, sf)
    res = mr.groupBy(F.col("dataset_name").alias("dataset"), "algorithm").agg(
        F.avg("accuracy").alias("accuracy"),
        F.when(F.col("dataset") == "syscalls", F.lit(None)).otherwise(F.avg("roc_auc")).alias("roc_auc"),
        F.avg("f1_weighted").alias("f1_weighted"), F.avg("f1_weighted").alias("recall"))
    res = res.withColumn("accuracy", F.when(F.col("dataset") == "syscalls", F.lit(float("nan")))
                         .otherwise(F.col("accuracy")))
    return G.results_to_runs(res)

"""Data-quality and profiling queries over the flow / syscall / run views."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.scalar import round_ratio_sql
from ..operators import profile as P
from ..operators import quality as Q
from ..sources import adapters as A
from . import register

NE, SC, MR = "network_events", "system_call_events", "model_runs"
NE_NUM = ["dur", "sbytes", "dbytes", "sttl", "dttl", "sloss", "dloss", "spkts", "dpkts",
          "ct_srv_src", "ct_dst_ltm", "ct_src_dport_ltm"]
NE_ALL = ["split", "proto", "service", "state"] + NE_NUM + ["label", "attack_cat"]
MR_ALL = ["id", "run_name", "model_type", "dataset_name", "algorithm", "roc_auc", "f1_weighted",
          "accuracy", "extra_metrics", "created_by", "created_at"]


def _union(parts):
    return "\nUNION ALL\n".join(parts)


def _num(c):
    return f"(SELECT CAST({c} AS DOUBLE) AS v FROM network_events WHERE {c} IS NOT NULL AND NOT isnan(CAST({c} AS DOUBLE)))"


# --- E12 / E13 -------------------------------------------------------------

@register("class_balance_nonnull", "E12 T7", A.with_views(f"""
SELECT attack_cat AS value, count, {round_ratio_sql('count', 'SUM(count) OVER ()', 1, 100)} AS share
FROM (SELECT attack_cat, COUNT(*) AS count FROM network_events WHERE attack_cat IS NOT NULL GROUP BY attack_cat) g
""", NE))
def q_class_balance_nonnull(spark, sf):
    return Q.class_balance(A.network_events(spark, sf), "attack_cat", digits=1, percent=True)


@register("class_balance_withnull", "E13 T7", A.with_views(f"""
SELECT value, count, share FROM (
  SELECT roc_auc AS value, COUNT(*) AS count,
         {round_ratio_sql('COUNT(*)', 'SUM(COUNT(*)) OVER ()', 4)} AS share
  FROM model_runs GROUP BY roc_auc) g
ORDER BY count DESC, value ASC NULLS FIRST LIMIT 10""", MR))
def q_class_balance_withnull(spark, sf):
    return Q.class_balance(A.model_runs(spark, sf), "roc_auc", keep_null=True, top_n=10, digits=4)


# --- E14 / E15 / E16 --------------------------------------------------------

@register("null_profile", "E14", A.with_views(_union([
    f"SELECT '{c}' AS column_name, COUNT(*) - COUNT({c}) AS null_count, "
    f"(COUNT(*) - COUNT({c})) / COUNT(*) AS null_rate FROM model_runs" for c in MR_ALL]), MR))
def q_null_profile(spark, sf):
    return Q.null_profile(A.model_runs(spark, sf))


@register("duplicate_rows", "E15 T8", A.with_views("""
SELECT COUNT(*) AS n_rows, COUNT(*) - (SELECT COUNT(*) FROM (SELECT DISTINCT * FROM network_events) d) AS n_duplicates
FROM network_events""", NE))
def q_duplicate_rows(spark, sf):
    return Q.duplicate_rows(A.network_events(spark, sf))


@register("column_cardinality", "E16 E35 E37 C13 C14", A.with_views(_union([
    f"SELECT '{c}' AS column_name, COUNT(DISTINCT {c}) AS n_distinct, "
    f"COUNT(DISTINCT {c}) + CASE WHEN COUNT(*) > COUNT({c}) THEN 1 ELSE 0 END AS n_distinct_with_null, "
    f"COUNT(DISTINCT {c}) <= 1 AS is_constant, COUNT(DISTINCT {c}) > 50 AS is_high_cardinality "
    f"FROM network_events" for c in NE_ALL]), NE))
def q_column_cardinality(spark, sf):
    return Q.cardinality(A.network_events(spark, sf), NE_ALL)


@register("target_mode", "E17 E38", A.with_views("""
SELECT (SELECT attack_cat FROM g ORDER BY n DESC, attack_cat LIMIT 1) AS mode,
       (SELECT MAX(n) FROM g) AS mode_count, (SELECT COUNT(*) FROM g) AS n_classes,
       (SELECT list(attack_cat ORDER BY attack_cat) FROM g) AS classes""", NE,
    extra="g AS (SELECT attack_cat, COUNT(*) AS n FROM network_events WHERE attack_cat IS NOT NULL GROUP BY attack_cat)"))
def q_target_mode(spark, sf):
    return Q.target_mode(A.network_events(spark, sf), "attack_cat")


@register("quick_profile", "E18 E14 E15 E17", A.with_views(f"""
SELECT 'network_events' AS dataset, (SELECT COUNT(*) FROM network_events) AS n_rows,
       {len(NE_ALL)} AS n_cols, 13 AS n_numeric, 5 AS n_object,
       CAST((SELECT {' + '.join(f'COUNT(*) - COUNT({c})' for c in NE_ALL)} FROM network_events) AS BIGINT) AS missing_cells,
       (SELECT {' + '.join(f'COUNT(*) - COUNT({c})' for c in NE_ALL)} FROM network_events)
         / ((SELECT COUNT(*) FROM network_events) * {len(NE_ALL)}) AS missing_rate,
       (SELECT COUNT(*) FROM network_events) - (SELECT COUNT(*) FROM (SELECT DISTINCT * FROM network_events) d) AS n_duplicates,
       CAST(label AS VARCHAR) AS target_mode, n_classes AS target_unique
FROM (SELECT (SELECT label FROM gl ORDER BY n DESC, label LIMIT 1) AS label,
             (SELECT COUNT(*) FROM gl) AS n_classes) t""", NE,
    extra="gl AS (SELECT label, COUNT(*) AS n FROM network_events WHERE label IS NOT NULL GROUP BY label)"))
def q_quick_profile(spark, sf):
    out = Q.quick_profile(A.network_events(spark, sf), "network_events", "label")
    return out.withColumn("n_cols", F.col("n_cols").cast("int")) \
              .withColumn("n_numeric", F.col("n_numeric").cast("int")) \
              .withColumn("n_object", F.col("n_object").cast("int"))


@register("category_codes", "D13 F7", A.with_views("""
SELECT attack_cat, CAST(code AS BIGINT) AS attack_cat_code, COUNT(*) AS n FROM (
  SELECT e.attack_cat, COALESCE(c.code, -1) AS code FROM network_events e
  LEFT JOIN (SELECT attack_cat, dense_rank() OVER (ORDER BY attack_cat) - 1 AS code
             FROM (SELECT DISTINCT attack_cat FROM network_events WHERE attack_cat IS NOT NULL) d) c
  ON e.attack_cat = c.attack_cat) t
GROUP BY attack_cat, code""", NE))
def q_category_codes(spark, sf):
    ne = A.network_events(spark, sf).select("attack_cat")
    return Q.category_codes(ne, "attack_cat").groupBy("attack_cat", "attack_cat_code") \
        .agg(F.count(F.lit(1)).alias("n"))


@register("unseen_test_classes", "D7", A.with_views("""
SELECT service FROM network_events WHERE split = 'test'
EXCEPT SELECT service FROM network_events WHERE split = 'train'""", NE))
def q_unseen_test_classes(spark, sf):
    ne = A.network_events(spark, sf)
    return Q.unseen_classes(ne.where("split = 'train'"), ne.where("split = 'test'"), "service")


@register("union_splits", "G8", A.with_views("""
SELECT split, COUNT(*) AS n, COUNT(attack_cat) AS n_attack_cat, COUNT(sus) AS n_sus FROM (
  SELECT split, attack_cat, CAST(NULL AS BIGINT) AS sus FROM network_events WHERE split = 'train'
  UNION ALL SELECT 'test' AS split, NULL AS attack_cat, CAST(label AS BIGINT) AS sus
  FROM network_events WHERE split = 'test') u GROUP BY split""", NE))
def q_union_splits(spark, sf):
    ne = A.network_events(spark, sf)
    tr = ne.where("split = 'train'").select("split", "attack_cat")
    te = ne.where("split = 'test'").select(F.col("label").alias("sus"))
    u = Q.union_splits({"train": tr, "test": te})
    return u.groupBy("split").agg(F.count(F.lit(1)).alias("n"), F.count("attack_cat").alias("n_attack_cat"),
                                  F.count("sus").alias("n_sus"))


# --- validation reports (M1–M5) ----------------------------------------------

def _flows_report_sql(split_pred: str, split: str) -> str:
    ds = f"UNSW-NB15 ({split})"
    base = f"(SELECT * FROM network_events WHERE {split_pred})"
    parts = [f"""SELECT '{ds}' AS dataset, 'high_nulls' AS "check", '{c}' AS column_name, 'warning' AS level,
       (COUNT(*) - COUNT({c})) / COUNT(*) AS value, 'many nulls' AS message FROM {base} b
       HAVING (COUNT(*) - COUNT({c})) / COUNT(*) > 0.05""" for c in NE_ALL]
    parts.append(f"""SELECT '{ds}', 'duplicates', NULL, 'warning', CAST(d AS DOUBLE), 'some rows repeat'
       FROM (SELECT (SELECT COUNT(*) FROM {base} b1) - (SELECT COUNT(*) FROM (SELECT DISTINCT * FROM {base} b2) x) AS d) t WHERE d > 0""")
    parts.append(f"""SELECT '{ds}', 'class_imbalance', 'label', 'warning', m, 'the rarest class is under the warning share'
       FROM (SELECT MIN(c) / SUM(c) AS m FROM (SELECT COUNT(*) AS c FROM {base} b GROUP BY label) g) t WHERE m < 0.10""")
    for c in ("proto", "service", "state"):
        parts.append(f"SELECT '{ds}', 'needs_encoding', '{c}', 'warning', NULL, "
                     f"'text column, encode it before fitting'")
    parts.append(f"SELECT '{ds}', 'numeric_cols', NULL, 'stat', 13.0, 'numeric columns'")
    parts.append(f"SELECT '{ds}', 'total_nulls', NULL, 'stat', CAST({' + '.join(f'COUNT(*) - COUNT({c})' for c in NE_ALL)} AS DOUBLE), 'total nulls' FROM {base} b")
    parts.append(f"SELECT '{ds}', 'class_balance', 'label', 'stat', COUNT(*) / CAST(SUM(COUNT(*)) OVER () AS DOUBLE), "
                 f"CAST(label AS VARCHAR) FROM {base} b GROUP BY label")
    return _union(parts)


@register("validate_flows", "M1 E12 E14 E15", A.with_views(_flows_report_sql("split = 'train'", "train"), NE))
def q_validate_flows(spark, sf):
    return Q.validate_flows(A.network_events(spark, sf).where("split = 'train'"), "train")


_SC_ALL = ["split", "record_id", "process_id", "thread_id", "parent_process_id", "user_id",
           "mount_namespace", "event_id", "args_num", "return_value", "sus", "evil"]


@register("validate_syscalls", "M2 E8", A.with_views(_union([
    "SELECT 'BETH' AS dataset, 'evil_rate' AS \"check\", 'evil' AS column_name, 'stat' AS level, "
    "AVG(evil) AS value, 'evil rate' AS message FROM system_call_events",
    "SELECT 'BETH', 'sparse_labels', 'evil', 'warning', AVG(evil), "
    "'positive labels are too rare to learn from' FROM system_call_events HAVING AVG(evil) < 0.05",
    f"SELECT 'BETH', 'total_nulls', NULL, 'stat', CAST({' + '.join(f'COUNT(*) - COUNT({c})' for c in _SC_ALL)} AS DOUBLE), "
    "'total nulls' FROM system_call_events"]), SC))
def q_validate_syscalls(spark, sf):
    return Q.validate_syscalls(A.system_call_events(spark, sf))


@register("validation_status", "M4 M1 M2", A.with_views("""
SELECT 'UNSW-NB15 (train)' AS dataset, true AS passed, CAST(0 AS BIGINT) AS n_errors,
       CAST(3 + (SELECT COUNT(*) FROM (SELECT MIN(c) / SUM(c) AS m FROM (SELECT COUNT(*) AS c FROM network_events WHERE split = 'train' GROUP BY label) g) t WHERE m < 0.10)
         + (SELECT COUNT(*) FROM (SELECT (SELECT COUNT(*) FROM network_events WHERE split = 'train') - (SELECT COUNT(*) FROM (SELECT DISTINCT * FROM network_events WHERE split = 'train') x) AS d) t WHERE d > 0) AS BIGINT) AS n_warnings
UNION ALL
SELECT 'BETH', true, CAST(0 AS BIGINT), CAST(CASE WHEN (SELECT AVG(evil) FROM system_call_events) < 0.05 THEN 1 ELSE 0 END AS BIGINT)""",
    NE, SC))
def q_validation_status(spark, sf):
    ne = A.network_events(spark, sf).where("split = 'train'")
    rep = Q.validate_flows(ne, "train").unionByName(Q.validate_syscalls(A.system_call_events(spark, sf)))
    return Q.report_status(rep)


@register("split_consistency", "G9 G11", A.with_views("""
SELECT (SELECT COUNT(*) FROM network_events WHERE split = 'train') AS train_rows, 18 AS train_cols,
       (SELECT COUNT(*) FROM network_events WHERE split = 'test') AS test_rows, 17 AS test_cols,
       ['label'] AS only_in_train, CAST([] AS VARCHAR[]) AS only_in_test, false AS target_in_both""", NE))
def q_split_consistency(spark, sf):
    ne = A.network_events(spark, sf)
    tr = ne.where("split = 'train'")
    te = ne.where("split = 'test'").drop("label")
    return Q.split_consistency(tr, te, "label")

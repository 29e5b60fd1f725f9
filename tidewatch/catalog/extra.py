"""Remaining operator queries: syscall CSV ingest, projections, input
validity rules, text templates, centroid distances, attack-log
validation, samples, cross-validation and the k-means elbow."""

from __future__ import annotations

import os
import uuid

from pyspark.sql import functions as F

from ..functions.scalar import prob_band
from ..operators import baselines as BL
from ..operators import features as FE
from ..operators import profile as P
from ..operators import quality as Q
from ..operators import supervised as S
from ..operators.anomaly import as_vector
from ..operators.anomaly import kmeans as K
from ..plans.ordered import with_row_id
from ..session import scratch_path
from ..sources import adapters as A
from ..sources import ingest as G
from ..sources.tables import read_table
from . import register
from .models import CHECK_TREES

NE, SC = "network_events", "system_call_events"


@register("syscall_csv_ingest", "A2 A5 B2 C7 C8", A.with_views("""
SELECT split, COUNT(*) AS n, CAST(SUM(event_id) AS BIGINT) AS sum_event_id, CAST(SUM(evil) AS BIGINT) AS n_evil,
       CAST(SUM(return_value) AS BIGINT) AS sum_return_value
FROM system_call_events GROUP BY split""", SC))
def q_syscall_ingest(spark, sf):
    sc = A.system_call_events(spark, sf)
    base = scratch_path(spark, f"beth-{uuid.uuid4().hex}")
    raw_names = {v: k for k, v in G.SYSCALL_RENAME.items()}
    paths = {}
    for variant in ("labelled_train", "labelled_val", "labelled_test"):
        p = os.path.join(base, f"{variant}.csv")
        sc.where(F.col("split") == variant).select(
            *[F.col(c).alias(f" {raw_names[c]} ") for c in raw_names]).write.option("header", True).csv(p)
        paths[variant] = p
    parts = [G.syscall_projection(G.load_syscalls(spark, paths, v), split=v) for v in paths]
    u = parts[0]
    for p in parts[1:]:
        u = u.unionByName(p)
    u = u.na.drop(subset=["evil"])                       # C8: rows without a label are dropped
    u = u.na.drop("any", subset=["event_id", "return_value"])   # C7
    return u.groupBy("split").agg(F.count(F.lit(1)).alias("n"), F.sum("event_id").alias("sum_event_id"),
                                  F.sum("evil").alias("n_evil"), F.sum("return_value").alias("sum_return_value"))


# flow targets, row id and split are never features of the live projection
_LEAKY = ["label", "attack_cat", "id", "split"]


@register("live_feature_means", "C3 C4 C5 C6 C16", A.with_views("""
SELECT proto, COUNT(*) AS n, AVG(dur) AS dur, AVG(sbytes) AS sbytes, AVG(dbytes) AS dbytes,
       AVG(sttl) AS sttl, AVG(dttl) AS dttl, AVG(spkts) AS spkts, AVG(dpkts) AS dpkts
FROM network_events GROUP BY proto""", NE))
def q_live_features(spark, sf):
    ne = A.network_events(spark, sf)
    train, test = ne.where("split = 'train'"), ne.where("split = 'test'")
    common = Q.common_columns(train, test)                               # C4
    present, _missing = Q.split_present(ne.select(*common), FE.LIVE_FEATURE_COLS)   # C5
    live = ne.select(*present)                                           # C3
    live = G.drop_if_present(live, _LEAKY)                               # C16
    num = Q.numeric_columns(live)                                        # C6
    return live.groupBy("proto").agg(F.count(F.lit(1)).alias("n"), *[F.avg(c).alias(c) for c in num])


@register("flow_input_validity", "N2", A.with_views("""
SELECT COUNT(*) AS n,
       COUNT(*) FILTER (WHERE dur < 0 OR sbytes < 0 OR dbytes < 0 OR spkts < 0 OR dpkts < 0) AS n_negative,
       COUNT(*) FILTER (WHERE sttl NOT BETWEEN 0 AND 255 OR dttl NOT BETWEEN 0 AND 255) AS n_bad_ttl,
       COUNT(*) FILTER (WHERE dur < 0 OR sbytes < 0 OR dbytes < 0 OR spkts < 0 OR dpkts < 0
                         OR sttl NOT BETWEEN 0 AND 255 OR dttl NOT BETWEEN 0 AND 255) AS n_quarantined
FROM network_events""", NE))
def q_flow_validity(spark, sf):
    ne = A.network_events(spark, sf)
    neg = (F.col("dur") < 0) | (F.col("sbytes") < 0) | (F.col("dbytes") < 0) | (F.col("spkts") < 0) | \
          (F.col("dpkts") < 0)
    ttl = ~F.col("sttl").between(0, 255) | ~F.col("dttl").between(0, 255)
    return ne.agg(F.count(F.lit(1)).alias("n"), F.count_if(neg).alias("n_negative"),
                  F.count_if(ttl).alias("n_bad_ttl"), F.count_if(neg | ttl).alias("n_quarantined"))


@register("alert_descriptions", "H12 H14 H15 H19", A.with_views("""
SELECT band, COUNT(*) AS n, COUNT(*) FILTER (WHERE contains(lower(description), 'critical')) AS n_critical_text,
       MIN(day) AS first_day, CAST(MAX(length(description)) AS INTEGER) AS max_len
FROM (SELECT CASE WHEN confidence * 100 < 40 THEN 'low' WHEN confidence * 100 < 70 THEN 'medium' ELSE 'high' END AS band,
             printf('%s alert: threat detected with %d%% confidence.', upper(severity),
                    CAST(floor(confidence * 100) AS BIGINT)) AS description,
             CAST(TRY_CAST(strftime(created_at, '%Y-%m-%d') AS DATE) AS DATE) AS day
      FROM alerts) t GROUP BY band""", "alerts"))
def q_alert_text(spark, sf):
    al = A.alerts(spark, sf)
    desc = F.format_string("%s alert: threat detected with %d%% confidence.", F.upper("severity"),
                           F.floor(F.col("confidence") * 100).cast("bigint"))
    day = F.to_date(F.date_format("created_at", "yyyy-MM-dd"), "yyyy-MM-dd")     # H12 parse
    t = al.select(prob_band("confidence").alias("band"), desc.alias("description"), day.alias("day"))
    return t.groupBy("band").agg(
        F.count(F.lit(1)).alias("n"), F.count_if(F.lower("description").contains("critical")).alias("n_critical_text"),
        F.min("day").alias("first_day"), F.max(F.length("description")).alias("max_len"))


_CD = ["sbytes", "dur", "spkts"]


_CD_DIST = f"""d AS (
  SELECT sqrt({' + '.join(f'power((CAST({c} AS DOUBLE) - m_{c}) / s_{c}, 2)' for c in _CD)}) AS dist
  FROM network_events, (SELECT {', '.join(f'AVG(CAST({c} AS DOUBLE)) AS m_{c}, CASE WHEN STDDEV_POP({c}) > 0 THEN STDDEV_POP({c}) ELSE 1.0 END AS s_{c}' for c in _CD)} FROM network_events) s)"""


@register("centroid_distance_percentiles", "I18 H16 E22", A.with_views(
    "\nUNION ALL\n".join(f"SELECT CAST({p} AS DOUBLE) AS p, quantile_cont(dist, {p}) AS q FROM d"
                          for p in (0.5, 0.9, 0.95, 0.99)), NE, extra=_CD_DIST))
def q_centroid(spark, sf):
    return P.centroid_distance(A.network_events(spark, sf), _CD)


def _attack_log(spark, sf):
    """Attack-log relation derived from orders (the driver ships no attack
    CSV): a three-class target and mixed-type features."""
    o = read_table(spark, sf, "orders")
    return o.select(
        F.when(F.col("o_orderstatus") == "O", "TCP").when(F.col("o_orderstatus") == "F", "UDP")
         .otherwise("ICMP").alias("Protocol"),
        (F.col("o_custkey") % 65536).cast("bigint").alias("Destination Port"),
        (F.floor(F.col("o_totalprice")) % 65495 + 40).cast("bigint").alias("Packet Length"),
        (F.col("o_totalprice") / 600000).alias("Anomaly Scores"),
        F.when(F.col("o_orderpriority").isin("1-URGENT", "2-HIGH"), "DDoS")
         .when(F.col("o_orderpriority") == "3-MEDIUM", "Intrusion").otherwise("Malware").alias("Attack Type"))


_ATTACK_SQL = """attack_log AS (
  SELECT CASE WHEN o_orderstatus = 'O' THEN 'TCP' WHEN o_orderstatus = 'F' THEN 'UDP' ELSE 'ICMP' END AS "Protocol",
         CASE WHEN o_orderpriority IN ('1-URGENT', '2-HIGH') THEN 'DDoS'
              WHEN o_orderpriority = '3-MEDIUM' THEN 'Intrusion' ELSE 'Malware' END AS "Attack Type"
  FROM orders)"""


@register("attack_log_validation", "M3 G10 E12", f"""
WITH {_ATTACK_SQL}
SELECT 'Cyber Attacks (Synthetic)' AS dataset, 'total_nulls' AS "check", CAST(NULL AS VARCHAR) AS column_name,
       'stat' AS level, 0.0 AS value, 'total nulls' AS message
UNION ALL
SELECT 'Cyber Attacks (Synthetic)', 'unexpected_classes', 'Attack Type', 'warning', CAST(NULL AS DOUBLE),
       'class set differs from the expected one'
FROM (SELECT list(DISTINCT "Attack Type" ORDER BY "Attack Type") AS k FROM attack_log) t
WHERE k <> ['DDoS', 'Intrusion', 'Malware']
UNION ALL
SELECT 'Cyber Attacks (Synthetic)', 'class_balance', 'Attack Type', 'stat',
       COUNT(*) / CAST(SUM(COUNT(*)) OVER () AS DOUBLE), "Attack Type" FROM attack_log GROUP BY 6""")
def q_attack_validation(spark, sf):
    return Q.validate_attacks(_attack_log(spark, sf))


@register("attack_log_class_share", "M5 E12", f"""
WITH {_ATTACK_SQL}
SELECT "Attack Type" AS value, COUNT(*) AS count,
       floor((2000.0 * COUNT(*) + SUM(COUNT(*)) OVER ()) / (2.0 * SUM(COUNT(*)) OVER ())) / 10.0 AS share
FROM attack_log GROUP BY 1""")
def q_attack_share(spark, sf):
    al = _attack_log(spark, sf)
    return Q.class_balance(al, "Attack Type", digits=1, percent=True)


@register("hash_samples", "C17 C18 C19 A6")
def q_samples(spark, sf):
    ne = A.network_events(spark, sf)
    ne = with_row_id(ne)
    exact = K.sample_rows(ne, 8000, key=F.col("_rid"))                    # C17
    u = (F.xxhash64("_rid", F.lit(7)).cast("double") + 2.0 ** 63) / 2.0 ** 64
    frac = ne.where(u < 0.10)                                             # C18
    fit, val = ne.where(u < 0.75), ne.where(u >= 0.75)                    # C19
    head = G.sample_head(ne, 5000)                                        # A6
    return exact.agg(F.count(F.lit(1)).alias("n")).select(
        F.lit("exact_8000").alias("sample"), "n").unionByName(
        frac.agg(F.count(F.lit(1)).alias("n")).select(F.lit("fraction_10pct").alias("sample"), "n")).unionByName(
        fit.agg(F.count(F.lit(1)).alias("n")).select(F.lit("fit_75").alias("sample"), "n")).unionByName(
        val.agg(F.count(F.lit(1)).alias("n")).select(F.lit("val_25").alias("sample"), "n")).unionByName(
        head.agg(F.count(F.lit(1)).alias("n")).select(F.lit("head_5000").alias("sample"), "n"))


@register("cv_auc", "J7")
def q_cv(spark, sf):
    ne = A.network_events(spark, sf).where("split = 'train'")
    mu, sd = S.cross_val_auc(ne, "label", 3, overrides=CHECK_TREES)
    return spark.createDataFrame([(3, mu, sd)], "folds int, auc_mean double, auc_std double")


@register("kmeans_elbow", "K11 L7")
def q_elbow(spark, sf):
    emb = as_vector(read_table(spark, sf, "embeddings"), "embedding")
    rows = K.elbow(emb, n_init=3)
    return spark.createDataFrame([(r["k"], r["inertia"], r["silhouette"]) for r in rows],
                                 "k int, inertia double, silhouette double")


@register("attack_log_findings", "M5", f"""
WITH {_ATTACK_SQL},
scores AS (SELECT o_totalprice / 600000 AS s, CASE WHEN o_orderpriority IN ('1-URGENT', '2-HIGH') THEN 'DDoS'
                  WHEN o_orderpriority = '3-MEDIUM' THEN 'Intrusion' ELSE 'Malware' END AS k FROM orders),
per AS (SELECT k, AVG(s) AS mean, STDDEV_SAMP(s) AS std, MIN(s) AS min, MAX(s) AS max FROM scores GROUP BY k)
SELECT 'Anomaly Scores' AS area, k AS item, measure, value FROM per UNPIVOT (value FOR measure IN (mean, std, min, max))
UNION ALL SELECT 'Missingness', 'all', 'missing_pct', 0.0
UNION ALL SELECT 'High-cardinality fields', 'all', 'text_columns', 2.0
UNION ALL SELECT 'High-cardinality fields', 'all', 'high_cardinality',
  CAST((SELECT COUNT(DISTINCT "Protocol") FROM attack_log) > 50 AS INTEGER) + CAST((SELECT COUNT(DISTINCT "Attack Type") FROM attack_log) > 50 AS INTEGER)""")
def q_attack_findings(spark, sf):
    return BL.findings(_attack_log(spark, sf), "Attack Type", "Anomaly Scores")


@register("attack_log_feature_sets", "I13 J14")
def q_attack_sets(spark, sf):
    """The named feature sets of the attack log, what each finds here, and a forest on each."""
    al = _attack_log(spark, sf)
    sets = {name: FE.attack_columns(al, name) for name in ("metadata_only", "with_leakage")}
    return BL.feature_set_comparison(al, "Attack Type", sets, models=("rf",), overrides={"rf": CHECK_TREES})


_RECALL = "CAST(json_extract_string(extra_metrics, '$.k') AS DOUBLE)"    # further metrics of a run are JSON; the test data has one


@register("best_recall_run", "N5", A.with_views(f"""
SELECT id, algorithm, model_type, {_RECALL} AS value,
       coalesce({_RECALL} = (SELECT MAX({_RECALL}) FROM model_runs WHERE dataset_name = 'flows' AND model_type = 'supervised'), FALSE) AS is_best
FROM model_runs WHERE dataset_name = 'flows' AND model_type = 'supervised'""", "model_runs"))
def q_best_recall(spark, sf):
    recall = F.get_json_object("extra_metrics", "$.k").cast("double")
    return BL.best_runs(A.model_runs(spark, sf), "flows", recall, "supervised")


@register("binary_baselines", "J12")
def q_binary_baselines(spark, sf):
    ne = A.network_events(spark, sf)
    return BL.binary_suite(ne.where("split = 'train'"), ne.where("split = 'test'"),
                           overrides={"rf": CHECK_TREES, "gbt": {"patience": 10}})


@register("bulk_scores", "N1")
def q_bulk_scores(spark, sf):
    ne = A.network_events(spark, sf)
    model = S.fit_two_stage(ne.where("split = 'train'"), stage1_overrides=CHECK_TREES, stage2_overrides=CHECK_TREES, smote=False)
    return model.bulk_scores(ne.where("split = 'test'"), "v1").select(
        "label", "is_attack", "attack_probability", "attack_type", "confidence", "model_version")

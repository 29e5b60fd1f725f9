"""Column audits and listings: data types, risk columns, label codes, the dataset
registry, the attack-log CSV loader and leakage scans of text targets."""

from __future__ import annotations

import os
import uuid

from pyspark.sql import functions as F

from ..operators import features as FE
from ..operators import profile as P
from ..operators import quality as Q
from ..session import scratch_path
from ..sources import adapters as A
from ..sources import ingest as G
from ..sources import registry as R
from ..sources.tables import read_table
from . import register
from .extra import _ATTACK_SQL, _attack_log
from .profile import _corr_sql

NE, SC = "network_events", "system_call_events"
# Spark's names of the data types that DuckDB names otherwise (fixed values)
_KIND = "CASE column_type WHEN 'BIGINT' THEN 'bigint' WHEN 'INTEGER' THEN 'int' WHEN 'DOUBLE' THEN 'double' WHEN 'VARCHAR' THEN 'string' " \
        "WHEN 'DATE' THEN 'date' WHEN 'TIMESTAMP' THEN 'timestamp_ntz' ELSE lower(column_type) END"


@register("dtype_histogram", "E19", f"""
SELECT {_KIND} AS dtype, COUNT(*) AS n_columns FROM (DESCRIBE SELECT * FROM lineitem) GROUP BY 1""")
def q_dtypes(spark, sf):
    return Q.dtype_histogram(read_table(spark, sf, "lineitem"))


@register("risk_columns", "C15", """
SELECT column_name FROM (DESCRIBE SELECT * FROM events)
WHERE regexp_matches(lower(column_name), 'id|time|timestamp|ip|address|payload|log|signature|alert|warning|user|device|geo|proxy')""")
def q_risk(spark, sf):
    cols = Q.risk_columns(read_table(spark, sf, "events"))
    return spark.createDataFrame([(c,) for c in cols], "column_name string")


@register("registry_listing", "G7 D1", A.with_views("""
SELECT 'beth' AS name, COUNT(*) AS row_count, CAST(12 AS BIGINT) AS column_count FROM system_call_events
UNION ALL SELECT 'unsw_nb15', COUNT(*), CAST(18 AS BIGINT) FROM network_events""", NE, SC))
def q_registry(spark, sf):
    reg = R.registry_from_views(A.network_events(spark, sf).drop("record_id"), A.system_call_events(spark, sf))
    return R.list_registry(reg).select("name", "row_count", "column_count")


@register("label_encoding", "I10", A.with_views("""
SELECT attack_cat, CAST(dense_rank() OVER (ORDER BY attack_cat) - 1 AS DOUBLE) AS label_idx, COUNT(*) AS n
FROM network_events WHERE attack_cat IS NOT NULL GROUP BY attack_cat""", NE))
def q_label_encoding(spark, sf):
    ne = A.network_events(spark, sf).where("attack_cat is not null")
    coded = FE.label_indexer("attack_cat").fit(ne).transform(ne)
    return coded.groupBy("attack_cat", "label_idx").agg(F.count(F.lit(1)).alias("n"))


@register("leakage_columns_dropped", "C16", f"""
WITH {_ATTACK_SQL}
SELECT "Protocol", "Attack Type", COUNT(*) AS n FROM attack_log GROUP BY ALL""")
def q_leakage_dropped(spark, sf):
    """The attack log with two of the leaking columns, which the fixed drop list removes."""
    al = _attack_log(spark, sf).withColumn("Payload Data", F.lit("x")).withColumn("Log Source", F.lit("y"))
    clean = G.drop_if_present(al, Q.ATTACK_LEAKAGE_COLS)
    keys = [c for c in clean.columns if c not in ("Destination Port", "Packet Length", "Anomaly Scores")]
    return clean.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"))


@register("attack_csv_load", "A3", f"""
WITH {_ATTACK_SQL}
SELECT "Protocol", "Attack Type", COUNT(*) AS n FROM attack_log GROUP BY ALL""")
def q_attack_csv(spark, sf):
    """The attack log written as CSV with padded headers, read back by the loader."""
    path = os.path.join(scratch_path(spark, f"attacks-{uuid.uuid4().hex}"), "log")
    al = _attack_log(spark, sf)
    al.select(*[F.col(f"`{c}`").alias(f" {c} ") for c in al.columns]).write.option("header", True).csv(path)
    return G.load_attacks(spark, path).groupBy("Protocol", "Attack Type").agg(F.count(F.lit(1)).alias("n"))


_TEXT_COLS = ("dur", "sbytes", "dbytes", "sttl")


@register("leakage_scan_text_target", "E24", A.with_views(f"""
, coded AS (SELECT *, CASE WHEN attack_cat IS NULL THEN -1 ELSE k END AS code FROM network_events
  LEFT JOIN (SELECT v, CAST(row_number() OVER (ORDER BY v) - 1 AS BIGINT) AS k FROM (SELECT DISTINCT attack_cat AS v FROM network_events
             WHERE attack_cat IS NOT NULL) d) c ON attack_cat = v)
{" UNION ALL ".join(f"SELECT '{c}' AS column_name, round(abs({_corr_sql(f'CAST({c} AS DOUBLE)', 'CAST(code AS DOUBLE)')}), 4) AS abs_corr, COALESCE(abs({_corr_sql(f'CAST({c} AS DOUBLE)', 'CAST(code AS DOUBLE)')}) > 0.95, false) AS leak_flag FROM coded" for c in _TEXT_COLS)}""", NE))
def q_leakage_text(spark, sf):
    ne = A.network_events(spark, sf).select(*_TEXT_COLS, "attack_cat")
    return P.leakage_scan(ne, "attack_cat")


@register("leakage_scan_coerced", "E25", A.with_views(" UNION ALL ".join(
    f"SELECT '{c}' AS column_name, round(abs({_corr_sql(f'CAST({c} AS DOUBLE)', 'CAST(label AS DOUBLE)')}), 4) AS abs_corr, "
    f"COALESCE(abs({_corr_sql(f'CAST({c} AS DOUBLE)', 'CAST(label AS DOUBLE)')}) > 0.95, false) AS leak_flag FROM network_events"
    for c in _TEXT_COLS), NE))
def q_leakage_coerced(spark, sf):
    ne = A.network_events(spark, sf).select(*_TEXT_COLS, F.col("label").cast("string").alias("label"))
    return P.leakage_scan(ne, "label", coerce=True)

"""Domain views over the driver tables.

The data model has seven relations (network flows, system-call events,
scored rows, model runs, alerts, users, login attempts).  The test data
ships TPC-H-style tables instead, so each relation is a deterministic
projection of one of them.  Each view exists twice: as a DataFrame
builder (what the engine runs) and as SQL text (what the DuckDB oracle
runs as a CTE).  Both must produce identical rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .tables import read_table


def _case(col: Column, mapping: dict, default) -> Column:
    expr = None
    for k, v in mapping.items():
        expr = F.when(col == F.lit(k), F.lit(v)) if expr is None else expr.when(col == F.lit(k), F.lit(v))
    return expr.otherwise(F.lit(default))


def _attack_flag() -> Column:
    return F.col("l_discount") > F.lit(0.045)


def network_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Flow facts: lineitem joined to part (FK, every l_partkey matches).

    The part side is left to AQE: it is broadcast while small and
    sort-merge joined once the dimension grows past the threshold.
    """
    li = read_table(spark, sf_dir, "lineitem")
    pa = read_table(spark, sf_dir, "part")
    j = li.join(pa, li.l_partkey == pa.p_partkey, "inner")
    attack = _attack_flag()
    return j.select(
        F.when(F.col("l_linestatus") == "F", "train").otherwise("test").alias("split"),
        _case(F.col("l_returnflag"), {"A": "tcp", "N": "udp"}, "icmp").alias("proto"),
        F.col("p_brand").alias("service"),
        F.col("l_linestatus").alias("state"),
        F.col("l_tax").alias("dur"),
        F.floor("l_extendedprice").cast("bigint").alias("sbytes"),
        F.floor("p_retailprice").cast("bigint").alias("dbytes"),
        (F.col("l_linenumber") * 32).cast("bigint").alias("sttl"),
        F.col("p_size").cast("bigint").alias("dttl"),
        (F.col("l_suppkey") % 10).cast("bigint").alias("sloss"),
        (F.col("l_partkey") % 10).cast("bigint").alias("dloss"),
        F.col("l_quantity").cast("bigint").alias("spkts"),
        (F.col("l_orderkey") % 100).cast("bigint").alias("dpkts"),
        (F.col("l_suppkey") % 50).cast("bigint").alias("ct_srv_src"),
        (F.col("l_partkey") % 50).cast("bigint").alias("ct_dst_ltm"),
        (F.col("l_orderkey") % 50).cast("bigint").alias("ct_src_dport_ltm"),
        F.when(attack, 1).otherwise(0).cast("bigint").alias("label"),
        F.when(attack, F.col("p_type")).otherwise(F.lit("Normal")).alias("attack_cat"),
    )


def system_call_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    ev = read_table(spark, sf_dir, "events")
    eid = F.col("event_id")
    jsonk = F.get_json_object("props", "$.k").cast("bigint")
    return ev.select(
        F.when(eid % 5 < 3, "labelled_train").when(eid % 5 == 3, "labelled_val")
         .otherwise("labelled_test").alias("split"),
        eid.alias("record_id"),
        (F.col("user_id") * 7 + eid % 11).alias("process_id"),
        (eid % 97).alias("thread_id"),
        (F.col("user_id") % 13).alias("parent_process_id"),
        F.col("user_id"),
        (eid % 7).alias("mount_namespace"),
        _case(F.col("event_type"), {"click": 1, "error": 2, "purchase": 3, "signup": 4}, 5)
         .cast("bigint").alias("event_id"),
        (jsonk % 8).cast("bigint").alias("args_num"),
        F.floor("value").cast("bigint").alias("return_value"),
        F.when(F.col("event_type") == "error", 1).otherwise(0).cast("bigint").alias("sus"),
        F.when((F.col("event_type") == "error") & (F.col("value") > 150), 1).otherwise(0)
         .cast("bigint").alias("evil"),
    )


def scored(spark: SparkSession, sf_dir: str) -> DataFrame:
    li = read_table(spark, sf_dir, "lineitem")
    return li.select(
        F.when(_attack_flag(), 1).otherwise(0).cast("bigint").alias("y"),
        (F.floor(F.col("l_extendedprice") / 1050).cast("double") / 100).alias("score"),
        F.when(F.col("l_extendedprice") >= 52500, 1).otherwise(0).cast("bigint").alias("pred_a"),
        F.when(F.col("l_quantity") > 25, 1).otherwise(0).cast("bigint").alias("pred_b"),
        F.col("l_linestatus").alias("split"),
    )


def model_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    ev = read_table(spark, sf_dir, "events")
    eid = F.col("event_id")
    return ev.select(
        eid.alias("id"),
        F.concat(F.lit("run_"), eid.cast("string")).alias("run_name"),
        F.when(eid % 5 < 3, "supervised").otherwise("unsupervised").alias("model_type"),
        _case(eid % 3, {0: "flows", 1: "syscalls"}, "attacks").alias("dataset_name"),
        F.col("event_type").alias("algorithm"),
        F.when(eid % 10 == 9, F.lit(None).cast("double")).otherwise(F.col("value") / 500).alias("roc_auc"),
        (F.col("value") / 1000).alias("f1_weighted"),
        (F.col("value") / 800).alias("accuracy"),
        F.col("props").alias("extra_metrics"),
        F.col("user_id").alias("created_by"),
        F.col("ts").alias("created_at"),
    )


def alerts(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = read_table(spark, sf_dir, "orders")
    return o.select(
        F.col("o_orderkey").alias("id"),
        _case(F.col("o_orderpriority"), {"1-URGENT": "critical", "2-HIGH": "high",
                                         "3-MEDIUM": "medium", "5-LOW": "low"}, "info").alias("severity"),
        _case(F.col("o_orderstatus"), {"O": "open", "P": "acknowledged"}, "resolved").alias("status"),
        (F.col("o_orderkey") % 9).cast("bigint").alias("attack_code"),
        (F.col("o_totalprice") / 1000000).alias("confidence"),
        F.col("o_orderdate").alias("created_at"),
        F.when(F.col("o_orderstatus") == "P", F.col("o_custkey")).alias("acknowledged_by"),
    )


def users(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = read_table(spark, sf_dir, "customer")
    return c.select(
        F.col("c_custkey").alias("id"),
        F.col("c_name").alias("username"),
        _case(F.col("c_mktsegment"), {"BUILDING": "admin", "MACHINERY": "analyst",
                                      "HOUSEHOLD": "data_scientist"}, "viewer").alias("role"),
        (F.col("c_acctbal") > 0).alias("is_active"),
    )


def login_attempts(spark: SparkSession, sf_dir: str) -> DataFrame:
    ev = read_table(spark, sf_dir, "events")
    et = F.col("event_type")
    return ev.select("event_id", "user_id", "ts",
                     ((et != "error") & (et != "click") & (et != "view")).alias("ok"))


VIEWS = {
    "network_events": network_events,
    "system_call_events": system_call_events,
    "scored": scored,
    "model_runs": model_runs,
    "alerts": alerts,
    "users": users,
    "login_attempts": login_attempts,
}


def view(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return VIEWS[name](spark, sf_dir)


def register_views(spark: SparkSession, sf_dir: str, names=None) -> None:
    for n in names or VIEWS:
        VIEWS[n](spark, sf_dir).createOrReplaceTempView(n)


# ---------------------------------------------------------------------------
# The same views as SQL text for the DuckDB oracle (base tables are views
# of the same names there).
# ---------------------------------------------------------------------------

_JSONK = "CAST(json_extract_string(props,'$.k') AS BIGINT)"

VIEW_SQL = {
    "network_events": """
SELECT CASE WHEN l_linestatus = 'F' THEN 'train' ELSE 'test' END AS split,
       CASE l_returnflag WHEN 'A' THEN 'tcp' WHEN 'N' THEN 'udp' ELSE 'icmp' END AS proto,
       p_brand AS service, l_linestatus AS state, l_tax AS dur,
       CAST(floor(l_extendedprice) AS BIGINT) AS sbytes,
       CAST(floor(p_retailprice) AS BIGINT) AS dbytes,
       CAST(l_linenumber * 32 AS BIGINT) AS sttl,
       CAST(p_size AS BIGINT) AS dttl,
       CAST(l_suppkey % 10 AS BIGINT) AS sloss,
       CAST(l_partkey % 10 AS BIGINT) AS dloss,
       CAST(l_quantity AS BIGINT) AS spkts,
       CAST(l_orderkey % 100 AS BIGINT) AS dpkts,
       CAST(l_suppkey % 50 AS BIGINT) AS ct_srv_src,
       CAST(l_partkey % 50 AS BIGINT) AS ct_dst_ltm,
       CAST(l_orderkey % 50 AS BIGINT) AS ct_src_dport_ltm,
       CAST(CASE WHEN l_discount > 0.045 THEN 1 ELSE 0 END AS BIGINT) AS label,
       CASE WHEN l_discount > 0.045 THEN p_type ELSE 'Normal' END AS attack_cat
FROM lineitem JOIN part ON l_partkey = p_partkey""",
    "system_call_events": f"""
SELECT CASE WHEN event_id % 5 < 3 THEN 'labelled_train' WHEN event_id % 5 = 3 THEN 'labelled_val' ELSE 'labelled_test' END AS split,
       event_id AS record_id,
       user_id * 7 + event_id % 11 AS process_id,
       event_id % 97 AS thread_id,
       user_id % 13 AS parent_process_id,
       user_id,
       event_id % 7 AS mount_namespace,
       CAST(CASE event_type WHEN 'click' THEN 1 WHEN 'error' THEN 2 WHEN 'purchase' THEN 3 WHEN 'signup' THEN 4 ELSE 5 END AS BIGINT) AS event_id,
       CAST({_JSONK} % 8 AS BIGINT) AS args_num,
       CAST(floor(value) AS BIGINT) AS return_value,
       CAST(CASE WHEN event_type = 'error' THEN 1 ELSE 0 END AS BIGINT) AS sus,
       CAST(CASE WHEN event_type = 'error' AND value > 150 THEN 1 ELSE 0 END AS BIGINT) AS evil
FROM events""",
    "scored": """
SELECT CAST(CASE WHEN l_discount > 0.045 THEN 1 ELSE 0 END AS BIGINT) AS y,
       CAST(floor(l_extendedprice / 1050) AS DOUBLE) / 100 AS score,
       CAST(CASE WHEN l_extendedprice >= 52500 THEN 1 ELSE 0 END AS BIGINT) AS pred_a,
       CAST(CASE WHEN l_quantity > 25 THEN 1 ELSE 0 END AS BIGINT) AS pred_b,
       l_linestatus AS split
FROM lineitem""",
    "model_runs": """
SELECT event_id AS id,
       concat('run_', CAST(event_id AS VARCHAR)) AS run_name,
       CASE WHEN event_id % 5 < 3 THEN 'supervised' ELSE 'unsupervised' END AS model_type,
       CASE event_id % 3 WHEN 0 THEN 'flows' WHEN 1 THEN 'syscalls' ELSE 'attacks' END AS dataset_name,
       event_type AS algorithm,
       CASE WHEN event_id % 10 = 9 THEN NULL ELSE value / 500 END AS roc_auc,
       value / 1000 AS f1_weighted,
       value / 800 AS accuracy,
       props AS extra_metrics,
       user_id AS created_by,
       ts AS created_at
FROM events""",
    "alerts": """
SELECT o_orderkey AS id,
       CASE o_orderpriority WHEN '1-URGENT' THEN 'critical' WHEN '2-HIGH' THEN 'high' WHEN '3-MEDIUM' THEN 'medium' WHEN '5-LOW' THEN 'low' ELSE 'info' END AS severity,
       CASE o_orderstatus WHEN 'O' THEN 'open' WHEN 'P' THEN 'acknowledged' ELSE 'resolved' END AS status,
       CAST(o_orderkey % 9 AS BIGINT) AS attack_code,
       o_totalprice / 1000000 AS confidence,
       o_orderdate AS created_at,
       CASE WHEN o_orderstatus = 'P' THEN o_custkey END AS acknowledged_by
FROM orders""",
    "users": """
SELECT c_custkey AS id, c_name AS username,
       CASE c_mktsegment WHEN 'BUILDING' THEN 'admin' WHEN 'MACHINERY' THEN 'analyst' WHEN 'HOUSEHOLD' THEN 'data_scientist' ELSE 'viewer' END AS role,
       c_acctbal > 0 AS is_active
FROM customer""",
    "login_attempts": """
SELECT event_id, user_id, ts, event_type <> 'error' AND event_type <> 'click' AND event_type <> 'view' AS ok FROM events""",
}


def with_views(sql: str, *names: str, extra: str = "") -> str:
    """Prefix ``sql`` with CTEs for the named views (oracle side);
    ``extra`` appends further ``name AS (...)`` CTEs after them."""
    ctes = [f"{n} AS ({VIEW_SQL[n].strip()})" for n in names]
    if extra:
        ctes.append(extra.strip())
    return f"WITH {', '.join(ctes)}\n{sql.strip()}"

"""Reporting queries: dashboards, leaderboards and alert queues
(E1–E11, F1–F2, G1–G7, D1–D5, L12, N5).

All functions take DataFrames of the domain relations and return a lazy
DataFrame.  Group-bys use partial (map-side) aggregation, so a category
holding a third of all rows is combined before it is shuffled; windows
only run over already-aggregated rows whose count is bounded by the
number of categories.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.scalar import json_double, round_ratio, severity_rank


def attack_distribution(events: DataFrame) -> DataFrame:
    """E5/F1: attack categories with percent of all attacks (2 dp)."""
    g = events.where(F.col("label") == 1).groupBy("attack_cat").agg(F.count(F.lit(1)).alias("total"))
    # total as a scalar sub-query over the grouped rows (no global window)
    tot = g.agg(F.sum("total")).scalar()
    return g.select("attack_cat", "total", round_ratio(F.col("total"), tot, 2, scale=100).alias("pct"))


def attack_category_counts(events: DataFrame) -> DataFrame:
    """Attack-category counts, descending."""
    return (events.where(F.col("label") == 1).groupBy("attack_cat")
            .agg(F.count(F.lit(1)).alias("count")).orderBy(F.desc("count"), "attack_cat"))


def label_split(events: DataFrame) -> DataFrame:
    """Rows per label."""
    return events.groupBy("label").agg(F.count(F.lit(1)).alias("count"))


def protocol_breakdown(events: DataFrame, top: int = 10) -> DataFrame:
    """Flows and attacks per protocol, attack percent (1 dp), top 10."""
    attacks = F.sum(F.when(F.col("label") == 1, 1).otherwise(0))
    g = events.groupBy("proto").agg(F.count(F.lit(1)).alias("total_flows"), attacks.alias("attacks"))
    return (g.select("proto", "total_flows", "attacks",
                     round_ratio("attacks", "total_flows", 1, scale=100).alias("attack_pct"))
            .orderBy(F.desc("total_flows"), "proto").limit(top))


def traffic_by_class(events: DataFrame) -> DataFrame:
    """Per class n and means of byte/packet/duration columns."""
    return events.groupBy("label").agg(
        F.count(F.lit(1)).alias("n_flows"),
        F.sum("sbytes").alias("sum_sbytes"),
        F.sum("dbytes").alias("sum_dbytes"),
        F.avg("dur").alias("avg_duration"),
        F.sum("spkts").alias("sum_spkts"),
    ).select(
        F.when(F.col("label") == 1, "Attack").otherwise("Normal").alias("traffic_type"),
        "n_flows",
        round_ratio("sum_sbytes", "n_flows", 0).alias("avg_src_bytes"),
        round_ratio("sum_dbytes", "n_flows", 0).alias("avg_dst_bytes"),
        F.col("avg_duration"),
        round_ratio("sum_spkts", "n_flows", 1).alias("avg_src_pkts"),
    )


def evil_counts(syscalls: DataFrame) -> DataFrame:
    """Rows per evil flag."""
    return syscalls.groupBy("evil").agg(F.count(F.lit(1)).alias("count"))


def evil_rates(syscalls: DataFrame) -> DataFrame:
    """Evil and sus rates per split."""
    return syscalls.groupBy("split").agg(
        F.count(F.lit(1)).alias("n"),
        F.avg("evil").alias("evil_rate"),
        F.avg("sus").alias("sus_rate"))


def top_event_ids(syscalls: DataFrame, top: int = 10) -> DataFrame:
    """Most frequent event ids (ties broken by id)."""
    return (syscalls.groupBy("event_id").agg(F.count(F.lit(1)).alias("count"))
            .orderBy(F.desc("count"), "event_id").limit(top))


def alert_summary(alerts: DataFrame, notebook_order: bool = False) -> DataFrame:
    """Alerts per severity × status in priority order."""
    return (alerts.groupBy("severity", "status").agg(F.count(F.lit(1)).alias("alert_count"))
            .withColumn("priority", severity_rank("severity", notebook=notebook_order))
            .orderBy("priority", "severity", "status"))


def users_by_role(users: DataFrame) -> DataFrame:
    """Users per role."""
    return users.groupBy("role").agg(F.count(F.lit(1)).alias("count"))


def platform_summary(registry: DataFrame, events: DataFrame, syscalls: DataFrame,
                     alerts: DataFrame, runs: DataFrame) -> DataFrame:
    """The six platform KPIs in one row.

    Each count is its own one-row aggregate, combined as scalar
    sub-queries (no join of the fact tables).
    """
    spark = events.sparkSession
    one = spark.range(1)
    return one.select(
        registry.agg(F.count(F.lit(1))).scalar().alias("datasets_registered"),
        events.agg(F.count(F.lit(1))).scalar().alias("network_events_stored"),
        syscalls.agg(F.count(F.lit(1))).scalar().alias("syscall_events_stored"),
        alerts.where(F.col("status") == "open").agg(F.count(F.lit(1))).scalar().alias("open_alerts"),
        runs.agg(F.count(F.lit(1))).scalar().alias("model_runs"),
        runs.agg(F.max("roc_auc")).scalar().alias("best_roc_auc"),
    )


def table_counts(tables: dict[str, DataFrame]) -> DataFrame:
    """One row per table with its row count."""
    parts = [df.agg(F.count(F.lit(1)).alias("n")).select(F.lit(name).alias("table_name"), "n")
             for name, df in tables.items()]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def leaderboard(runs: DataFrame, top: int | None = 20) -> DataFrame:
    """G1: runs by AUC descending, NULL AUC last (id breaks ties)."""
    out = (runs.select("id", "run_name", "algorithm", "dataset_name", "roc_auc", "f1_weighted",
                       "accuracy", "created_at")
           .orderBy(F.desc_nulls_last("roc_auc"), "id"))
    return out.limit(top) if top else out


def recent(df: DataFrame, cols: list[str], top: int, ts: str = "created_at") -> DataFrame:
    """Most recent rows (top-k: TakeOrderedAndProject)."""
    return df.select(*cols).orderBy(F.desc(ts), F.desc("id")).limit(top)


def alert_queue(alerts: DataFrame, status: str | None = None, limit: int | None = None,
                notebook_order: bool = False) -> DataFrame:
    """Alerts in priority order, optional status filter (no
    filter ⇒ every status), optional limit."""
    a = alerts if status is None else alerts.where(F.col("status") == status)
    a = a.select("id", "severity", "status", "attack_code", "confidence", "created_at",
                 severity_rank("severity", notebook=notebook_order).alias("priority"))
    a = a.orderBy("priority", F.desc("created_at"), "id")
    return a.limit(limit) if limit else a


def latest_run_per_algorithm(runs: DataFrame) -> DataFrame:
    """last run per (algorithm, dataset_name) by created_at (id breaks ties).

    ``max_by`` over a struct is a partial aggregate: each group is
    combined map-side, so a hot (algorithm, dataset) pair never sits in
    one task the way a ``row_number`` window would put it.
    """
    cols = [c for c in runs.columns if c not in ("algorithm", "dataset_name")]
    key = F.struct("created_at", "id")
    best = runs.groupBy("algorithm", "dataset_name").agg(
        F.max_by(F.struct(*cols), key).alias("r"))
    return best.select("algorithm", "dataset_name", *[F.col(f"r.{c}").alias(c) for c in cols])


def run_ci_bars(runs: DataFrame) -> DataFrame:
    """Latest run per algorithm with AUC CI bounds read from
    the JSON metrics and non-negative error-bar widths."""
    latest = latest_run_per_algorithm(runs)
    lo = json_double("extra_metrics", "$.roc_auc_ci.lower")
    hi = json_double("extra_metrics", "$.roc_auc_ci.upper")
    return latest.select(
        "algorithm", "dataset_name", "run_name", "roc_auc",
        lo.alias("ci_lower"), hi.alias("ci_upper"),
        (lo.isNotNull() & hi.isNotNull()).alias("has_ci"),
        # greatest() skips NULLs, so guard: no bound ⇒ no error bar
        F.when(hi.isNotNull() & F.col("roc_auc").isNotNull(),
               F.greatest(hi - F.col("roc_auc"), F.lit(0.0))).alias("err_plus"),
        F.when(lo.isNotNull() & F.col("roc_auc").isNotNull(),
               F.greatest(F.col("roc_auc") - lo, F.lit(0.0))).alias("err_minus"),
        json_double("extra_metrics", "$.k").alias("metric_k"))


def left_join_known(left: DataFrame, right: DataFrame, key: str, right_key: str) -> DataFrame:
    """``left`` left-joined with ``right`` on ``key`` = ``right_key``.  Rows of a NULL key match nothing and stay out of the
    join: the exchange would send them all to one task."""
    nothing = [F.lit(None).cast(f.dataType).alias(f.name) for f in right.schema]
    joined = left.where(F.col(key).isNotNull()).join(right, F.col(key) == F.col(right_key), "left")
    return joined.unionByName(left.where(F.col(key).isNull()).select("*", *nothing))


def alerts_with_users(alerts: DataFrame, users: DataFrame) -> DataFrame:
    """D3: alerts with the acknowledging user's name (left join; the
    user dimension is left to AQE to broadcast once measured small).
    Most alerts are not acknowledged and need no user."""
    u = users.select(F.col("id").alias("uid"), F.col("username").alias("acknowledged_by_name"),
                     F.col("role").alias("acknowledged_by_role"))
    return (left_join_known(alerts, u, "acknowledged_by", "uid")
            .select("id", "severity", "status", "acknowledged_by", "acknowledged_by_name",
                    "acknowledged_by_role"))


def runs_with_creator(runs: DataFrame, users: DataFrame) -> DataFrame:
    """Model runs with their creator (left join)."""
    u = users.select(F.col("id").alias("uid"), F.col("username").alias("creator"))
    return left_join_known(runs, u, "created_by", "uid").select("id", "run_name", "created_by", "creator")


def experiment_comparison(runs: DataFrame, dataset: str) -> DataFrame:
    """Runs of one dataset with a best-F1 flag (max over the filtered set)."""
    r = runs.where(F.col("dataset_name") == dataset)
    best = r.agg(F.max("f1_weighted")).scalar()
    return r.select("id", "algorithm", "model_type", "f1_weighted", "accuracy",
                    (F.col("f1_weighted") == best).alias("is_best"))


def predictions_with_context(preds: DataFrame, runs: DataFrame, sources: dict[str, tuple[DataFrame, str]]) -> DataFrame:
    """D2 + D5: predictions with their model run (left equi-join) and with
    their source event through the loose key (event_source,
    source_record_id): one equi-join per source, unioned.  Predictions of
    an unknown source keep NULL source columns."""
    r = runs.select(F.col("id").alias("model_run_id"), "algorithm", "dataset_name")
    p = preds.join(r, "model_run_id", "left")
    parts = []
    for name, (src, key) in sources.items():
        s = src.withColumnRenamed(key, "source_record_id")
        parts.append(p.where(F.col("event_source") == name).join(s, "source_record_id", "left"))
    known = list(sources)
    rest = p.where(~F.col("event_source").isin(known) | F.col("event_source").isNull())
    out = parts[0]
    for q in parts[1:]:
        out = out.unionByName(q, allowMissingColumns=True)
    return out.unionByName(rest, allowMissingColumns=True)

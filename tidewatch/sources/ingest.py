"""CSV loaders and table sinks.

Raw files are read with every column as a string (no inference pass
over the data), headers are normalised, and the stored projection is
coerced with the null-tolerant H1–H3 expressions.  Writes are Parquet,
partitioned by ``split``; a job commits all-or-nothing (no half-written
chunks), and ``mode("overwrite")`` with dynamic partition overwrite
replaces exactly the splits being loaded.
"""

from __future__ import annotations

import json
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.utils import AnalysisException

from ..functions.scalar import bounded_str, nan_to_null, severity_from_confidence, to_float, to_int
from .registry import registry_rows, upsert_registry

# Fixed values of the stored schemas (column lists and string bounds).
FLOW_STRING_BOUNDS = {"proto": 20, "service": 20, "state": 20, "attack_cat": 30}
FLOW_FLOAT_COLS = ["dur"]
FLOW_INT_COLS = ["sbytes", "dbytes", "sttl", "dttl", "sloss", "dloss", "spkts", "dpkts",
                 "ct_srv_src", "ct_dst_ltm", "ct_src_dport_ltm", "label"]
FLOW_STORED = ["proto", "service", "state", "dur", "sbytes", "dbytes", "sttl", "dttl", "sloss",
               "dloss", "spkts", "dpkts", "ct_srv_src", "ct_dst_ltm", "ct_src_dport_ltm", "label",
               "attack_cat"]
# raw camelCase syscall header → stored snake_case column
SYSCALL_RENAME = {"processId": "process_id", "threadId": "thread_id",
                  "parentProcessId": "parent_process_id", "userId": "user_id",
                  "mountNamespace": "mount_namespace", "eventId": "event_id", "argsNum": "args_num",
                  "returnValue": "return_value", "evil": "evil"}
SYSCALL_VARIANTS = ("main", "labelled_train", "labelled_val", "labelled_test")


def read_csv_strings(spark: SparkSession, path: str | Sequence[str], multiline: bool = False) -> DataFrame:
    """Header CSV, all columns as strings.  No schema inference (no extra
    pass over the files).  ``multiline`` accepts quoted newlines but makes
    every file a single split, so it is off by default at scale."""
    return (spark.read.option("header", True).option("multiLine", multiline).option("escape", '"')
            .option("inferSchema", False).option("mode", "PERMISSIVE").csv(path))


def normalise_headers(df: DataFrame, lower: bool = True) -> DataFrame:
    """Strip (and lower-case) column names; a UTF-8 BOM is removed too."""
    def clean(c: str) -> str:
        c = c.lstrip("﻿").strip()
        return c.lower() if lower else c
    return df.toDF(*[clean(c) for c in df.columns])


def drop_if_present(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    """Drop columns that exist, ignore the rest."""
    return df.drop(*[c for c in cols if c in df.columns])


def check_paths(spark: SparkSession, paths: dict[str, str]) -> None:
    """A5: report every missing input at once (before any work)."""
    missing = []
    for label, p in paths.items():
        try:
            spark.read.text(p).schema  # resolves the path, reads no rows
        except AnalysisException:
            missing.append(f"{label}: {p}")
    if missing:
        raise FileNotFoundError("missing input files:\n  " + "\n  ".join(missing))


def load_flows(spark: SparkSession, train: str, test: str, drop_id: bool = True) -> DataFrame:
    """A1: both flow splits, headers stripped + lower-cased, ``id``
    dropped, tagged with ``split`` and unioned by name."""
    check_paths(spark, {"flows train": train, "flows test": test})
    parts = []
    for split, p in (("train", train), ("test", test)):
        d = normalise_headers(read_csv_strings(spark, p))
        if drop_id:
            d = drop_if_present(d, ["id"])
        parts.append(d.withColumn("split", F.lit(split)))
    return parts[0].unionByName(parts[1], allowMissingColumns=True)


def load_syscalls(spark: SparkSession, paths: dict[str, str], variant: str = "labelled_train") -> DataFrame:
    """A2: one syscall variant; unknown variant → ValueError."""
    if variant not in SYSCALL_VARIANTS:
        raise ValueError(f"unknown variant {variant!r}; choose one of {SYSCALL_VARIANTS}")
    check_paths(spark, {f"syscalls {variant}": paths[variant]})
    return normalise_headers(read_csv_strings(spark, paths[variant]), lower=False)


def load_attacks(spark: SparkSession, path: str) -> DataFrame:
    """A3: attack log, headers stripped (names keep their spaces)."""
    check_paths(spark, {"attack log": path})
    return normalise_headers(read_csv_strings(spark, path), lower=False)


def dataset_summary(spark: SparkSession, files: dict[str, tuple[str, str]]) -> DataFrame:
    """A4: per file rows, columns, target, mean missing % (2 dp) and
    status; a missing file is a row with status ``file_missing``."""
    rows = None
    for name, (path, target) in files.items():
        try:
            d = normalise_headers(read_csv_strings(spark, path), lower=False)
            cols = d.columns
            miss = sum((F.count_if(F.col(f"`{c}`").isNull()) for c in cols), F.lit(0))
            r = d.agg(F.count(F.lit(1)).alias("n"), miss.alias("m")).select(
                F.lit(name).alias("dataset"), F.col("n").alias("rows"),
                F.lit(len(cols)).alias("columns"), F.lit(target).alias("target"),
                F.round(F.col("m") * 100.0 / (F.col("n") * len(cols)), 2).alias("missing_pct"),
                F.lit("ok").alias("status"))
        except AnalysisException:
            r = spark.createDataFrame([(name, None, None, target, None, "file_missing")],
                                      "dataset string, rows bigint, columns int, target string, "
                                      "missing_pct double, status string")
        rows = r if rows is None else rows.unionByName(r, allowMissingColumns=True)
    return rows


def sample_head(df: DataFrame, n: int = 5000) -> DataFrame:
    """Bounded sample read (first n in file order — undefined order
    across partitions unless the caller sorts)."""
    return df.limit(n)


def flow_projection(raw: DataFrame, dataset_id: Column | None = None,
                    legacy_nan_text: bool = False) -> DataFrame:
    """B1/H1–H3: the 17 stored flow columns from raw string columns:
    strings bounded (missing column → ""), ints via float-truncation,
    floats parsed, unparsable → NULL."""
    cols = []
    for c in FLOW_STORED:
        present = c in raw.columns
        if c in FLOW_STRING_BOUNDS:
            cols.append(bounded_str(c, FLOW_STRING_BOUNDS[c], legacy_nan_text).alias(c) if present
                        else F.lit("").alias(c))
        elif c in FLOW_FLOAT_COLS:
            cols.append(to_float(c).alias(c) if present else F.lit(None).cast("double").alias(c))
        else:
            cols.append(to_int(c).alias(c) if present else F.lit(None).cast("bigint").alias(c))
    extra = [F.col("split")] if "split" in raw.columns else []
    if dataset_id is not None:
        extra.append(dataset_id.alias("dataset_id"))
    return raw.select(*extra, *cols)


def syscall_projection(raw: DataFrame, split: str | None = None) -> DataFrame:
    """B2: camelCase → snake_case, every column int-coerced (H1)."""
    cols = [to_int(src).alias(dst) if src in raw.columns else F.lit(None).cast("bigint").alias(dst)
            for src, dst in SYSCALL_RENAME.items()]
    extra = [F.lit(split).alias("split")] if split else ([F.col("split")] if "split" in raw.columns else [])
    return raw.select(*extra, *cols)


def write_partitioned(df: DataFrame, path: str, mode: str = "append", by: str = "split") -> None:
    """B1–B3 sink: Parquet partitioned by split.  ``overwrite`` is the
    truncate-before-load: the whole table goes, splits that are not loaded
    too.  The mode is an option of this write, not of the session."""
    df.write.mode(mode).option("partitionOverwriteMode", "static").partitionBy(by).parquet(path)


def ingest_flows(spark: SparkSession, train: str, test: str, table_path: str, registry: DataFrame | None,
                 truncate: bool = False) -> tuple[DataFrame, DataFrame]:
    """Load both splits, write the fact table, upsert the
    registry (parsed row counts, real column counts).  Returns the loaded
    frame and the new registry."""
    raw = load_flows(spark, train, test)
    ids = {"train": 1, "test": 2}
    did = F.when(F.col("split") == "train", F.lit(ids["train"])).otherwise(F.lit(ids["test"])).cast("bigint")
    flows = flow_projection(raw, did)
    write_partitioned(flows, table_path, "overwrite" if truncate else "append")
    stored = spark.read.parquet(table_path)
    reg = (registry_rows("unsw_nb15_train", raw.where("split = 'train'"), train,
                         "network flow telemetry (train)")
           .unionByName(registry_rows("unsw_nb15_test", raw.where("split = 'test'"), test,
                                      "network flow telemetry (test)")))
    n_cols = len(read_csv_strings(spark, train).columns)   # header only: the file's real width (T4)
    reg = reg.withColumn("column_count", F.lit(n_cols).cast("bigint"))
    new_reg = reg if registry is None else upsert_registry(registry, reg)
    return stored, new_reg


def insert_missing(target: DataFrame, incoming: DataFrame, key: Sequence[str]) -> DataFrame:
    """Rows of ``incoming`` whose key is not yet in ``target``
    (idempotent load): an anti-join."""
    return incoming.join(target.select(*key).distinct(), list(key), "left_anti")


def run_record(spark: SparkSession, run_name: str, model_type: str, dataset_name: str,
               algorithm: str, hyperparameters: dict, metrics: dict, duration_seconds: float,
               notes: str = "") -> DataFrame:
    """One experiment row; hyper-parameters and extra metrics as JSON."""
    main = {k: metrics.get(k) for k in ("accuracy", "roc_auc", "f1_weighted", "f1_macro", "precision", "recall")}
    extra = {k: v for k, v in metrics.items() if k not in main}
    return spark.createDataFrame(
        [(run_name, model_type, dataset_name, algorithm, json.dumps(hyperparameters),
          *[None if v is None else float(v) for v in main.values()], json.dumps(extra),
          float(duration_seconds), notes)],
        "run_name string, model_type string, dataset_name string, algorithm string, "
        "hyperparameters string, accuracy double, roc_auc double, f1_weighted double, f1_macro double, "
        "precision double, recall double, extra_metrics string, duration_seconds double, notes string"
    ).withColumn("created_at", F.current_timestamp())


def results_to_runs(results: DataFrame) -> DataFrame:
    """A results table (dataset, algorithm, metric columns) to
    ``model_runs`` rows: run_name = "dataset | algorithm", model_type by
    dataset, NaN → NULL, and the unsupervised metrics kept only in JSON
    when both accuracy and AUC are missing (NULL fields omitted)."""
    metric_cols = [c for c in results.columns if c not in ("dataset", "algorithm", "task")]
    clean = {c: nan_to_null(c) for c in metric_cols
             if dict(results.dtypes)[c] in ("double", "float")}
    r = results.withColumns(clean) if clean else results
    unsup = [c for c in metric_cols if c not in ("accuracy", "roc_auc", "f1_weighted")]
    both_missing = F.col("accuracy").isNull() & F.col("roc_auc").isNull()
    return r.select(
        F.concat_ws(" | ", "dataset", "algorithm").alias("run_name"),
        F.when(F.lower("dataset").contains("beth") | F.lower("dataset").contains("syscall"), "unsupervised")
         .otherwise("supervised").alias("model_type"),
        F.col("dataset").alias("dataset_name"), "algorithm", "accuracy", "roc_auc", "f1_weighted",
        F.when(both_missing, F.to_json(F.struct(*[F.col(c) for c in unsup]))).alias("extra_metrics"))


def predictions_rows(scored: DataFrame, model_run_id: int, source: str, record_id: str,
                     true_label: str | None = None) -> DataFrame:
    """Rows of the predictions table from a scored frame."""
    return scored.select(
        F.lit(model_run_id).cast("bigint").alias("model_run_id"), F.lit(source).alias("event_source"),
        F.col(record_id).cast("bigint").alias("source_record_id"),
        F.col("is_attack").cast("int").alias("predicted_label"),
        F.col("attack_type").alias("predicted_class"), F.col("confidence"),
        (F.col(true_label).cast("int") if true_label else F.lit(None).cast("int")).alias("true_label"),
        F.current_timestamp().alias("predicted_at"))


def alerts_from_predictions(preds: DataFrame, source_dataset: str) -> DataFrame:
    """One open alert per flagged prediction, severity by rule."""
    p = preds.where(F.col("predicted_label") == 1)
    return p.select(
        F.concat(F.initcap("predicted_class"), F.lit(" detected")).alias("title"),
        F.format_string("%s detected with %d%% confidence.", F.col("predicted_class"),
                        F.round(F.col("confidence") * 100).cast("int")).alias("description"),
        severity_from_confidence("confidence").alias("severity"), F.lit("open").alias("status"),
        F.lit(source_dataset).alias("source_dataset"), F.col("predicted_class").alias("attack_type"),
        "confidence", "model_run_id", F.col("source_record_id").alias("prediction_source_id"),
        F.col("predicted_at").alias("created_at"))


def erase_subject(table: DataFrame, erase: DataFrame, key: str,
                  subjects: DataFrame | None = None, subject_key: str | None = None) -> DataFrame:
    """Drop every row of the subjects in ``erase``; raises when none
    of the subjects exists — in the subject dimension when given, else in
    ``table`` (checked with a semi-join, not a collect)."""
    if subjects is not None:
        sk = subject_key or key
        probe = erase.select(F.col(key).alias(sk)).join(subjects.select(sk), sk, "left_semi")
    else:
        probe = table.join(erase.select(key), key, "left_semi")
    if probe.isEmpty():
        raise KeyError("no such subject to erase")
    return table.join(erase.select(key).distinct(), key, "left_anti")


def acknowledge(alerts: DataFrame, acks: DataFrame) -> DataFrame:
    """Apply acknowledgements ``(id, acknowledged_by, acknowledged_at)``:
    status → acknowledged, time and user set; unknown ids raise."""
    if acks.join(alerts.select("id"), "id", "left_anti").limit(1).count() > 0:
        raise KeyError("acknowledgement for an unknown alert id")
    a = acks.select("id", F.col("acknowledged_by").alias("_by"), F.col("acknowledged_at").alias("_at"))
    j = alerts.join(a, "id", "left")
    hit = F.col("_by").isNotNull() | F.col("_at").isNotNull()
    out = j.withColumn("status", F.when(hit, F.lit("acknowledged")).otherwise(F.col("status")))
    if "acknowledged_at" in alerts.columns:
        out = out.withColumn("acknowledged_at", F.coalesce("_at", "acknowledged_at"))
    else:
        out = out.withColumn("acknowledged_at", F.col("_at"))
    out = out.withColumn("acknowledged_by", F.coalesce("_by", "acknowledged_by"))
    return out.drop("_by", "_at")

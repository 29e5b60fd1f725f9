"""Data-quality operators: class balance, nulls, duplicates, cardinality,
validation reports and train/test consistency (E12–E18, E35, E38,
M1–M5, G8–G11, C5–C8, C13–C15, D7, D13).

Per-column statistics are computed in ONE aggregate over the table
(every column's expression side by side) and then turned into one row
per column, instead of one pass per column.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DecimalType, FractionalType, IntegralType, NumericType, StringType

from ..functions.scalar import round_ratio

# Fixed values of the reference's data model (column and class sets).
FLOW_TARGETS = ("label", "attack_cat")
FLOW_CATEGORICAL = ("proto", "service", "state")
SYSCALL_TARGET = "evil"
SYSCALL_NUMERIC = ("process_id", "thread_id", "parent_process_id", "user_id", "mount_namespace",
                   "event_id", "args_num", "return_value")
ATTACK_TARGET = "Attack Type"
ATTACK_CLASSES = ("DDoS", "Intrusion", "Malware")
# Column-name keywords that mark a column as a possible leakage / identity risk (fixed values).
RISK_KEYWORDS = ("id", "time", "timestamp", "ip", "address", "payload", "log", "signature", "alert",
                 "warning", "user", "device", "geo", "proxy")
# Attack-log columns that leak the answer or give an unrealistic advantage (fixed values).
ATTACK_LEAKAGE_COLS = ("Payload Data", "Malware Indicators", "Alerts/Warnings", "Attack Signature",
                       "Firewall Logs", "IDS/IPS Alerts", "Geo-location Data", "Proxy Information",
                       "User Information", "Device Information", "Log Source", "Timestamp",
                       "Source IP Address", "Destination IP Address")
# Columns dropped for the expanded-feature experiment (fixed values).
ATTACK_EXPERIMENT_DROP = ("Source IP Address", "Destination IP Address", "Timestamp")


def numeric_columns(df: DataFrame, exclude: Sequence[str] = ()) -> list[str]:
    """Numeric columns (booleans excluded, as numpy does)."""
    return [f.name for f in df.schema.fields
            if isinstance(f.dataType, NumericType) and f.name not in exclude]


def dtype_histogram(df: DataFrame) -> DataFrame:
    """Number of columns per data type, most frequent first."""
    kinds = df.sparkSession.createDataFrame([(t,) for _, t in df.dtypes], "dtype string")
    return kinds.groupBy("dtype").agg(F.count(F.lit(1)).alias("n_columns")).orderBy(F.desc("n_columns"), "dtype")


def string_columns(df: DataFrame, exclude: Sequence[str] = ()) -> list[str]:
    return [f.name for f in df.schema.fields
            if isinstance(f.dataType, StringType) and f.name not in exclude]


def split_present(df: DataFrame, wanted: Sequence[str]) -> tuple[list[str], list[str]]:
    """Wished columns → (present, missing), order kept."""
    have = set(df.columns)
    return [c for c in wanted if c in have], [c for c in wanted if c not in have]


def common_columns(a: DataFrame, b: DataFrame) -> list[str]:
    """C4: columns present in both frames (order of ``a``); error if none."""
    cols = [c for c in a.columns if c in set(b.columns)]
    if not cols:
        raise ValueError("the two frames share no column")
    return cols


def risk_columns(df: DataFrame, keywords: Sequence[str] = RISK_KEYWORDS) -> list[str]:
    """Columns whose lower-cased name contains any keyword."""
    return [c for c in df.columns if any(k in c.lower() for k in keywords)]


def per_column(df: DataFrame, cols: Sequence[str],
               stats: dict[str, Callable[[Column], Column]]) -> DataFrame:
    """One aggregate over ``df`` computing every stat for every column,
    returned as one row per column: (column, stat1, stat2, ...)."""
    aggs = [fn(F.col(f"`{c}`")).alias(f"{i}__{j}")
            for i, c in enumerate(cols) for j, fn in enumerate(stats.values())]
    wide = df.agg(*aggs)
    rows = F.array(*[F.struct(F.lit(c).alias("column_name"),
                              *[F.col(f"{i}__{j}").alias(s) for j, s in enumerate(stats)])
                     for i, c in enumerate(cols)])
    return wide.select(F.inline(rows))


def class_balance(df: DataFrame, col: str, keep_null: bool = False,
                  top_n: int | None = None, digits: int = 4, percent: bool = False) -> DataFrame:
    """E12 (``keep_null=False``: nulls dropped, share of non-null rows) and
    E13 (``keep_null=True``: null is a class).  Share is the exact ratio
    rounded half-up to ``digits`` (×100 when ``percent``)."""
    d = df if keep_null else df.where(F.col(col).isNotNull())
    g = d.groupBy(col).agg(F.count(F.lit(1)).alias("count"))
    # the total is a scalar sub-query over the grouped rows (not a global
    # window: the column may have unboundedly many distinct values)
    tot = g.agg(F.sum("count")).scalar()
    out = g.select(F.col(col).alias("value"), "count",
                   round_ratio(F.col("count"), tot, digits, scale=100 if percent else 1).alias("share"))
    if top_n:
        out = out.orderBy(F.desc("count"), F.asc_nulls_first("value")).limit(top_n)
    return out


def null_profile(df: DataFrame) -> DataFrame:
    """Per column null count and rate (one pass)."""
    n = df.agg(F.count(F.lit(1))).scalar()
    prof = per_column(df, df.columns, {"null_count": lambda c: F.count_if(c.isNull())})
    return prof.select("column_name", "null_count", (F.col("null_count") / n).alias("null_rate"))


def duplicate_rows(df: DataFrame) -> DataFrame:
    """Rows beyond the first copy (nulls compare equal)."""
    total = df.agg(F.count(F.lit(1))).scalar()
    distinct = df.distinct().agg(F.count(F.lit(1))).scalar()
    return df.sparkSession.range(1).select(total.alias("n_rows"), (total - distinct).alias("n_duplicates"))


def cardinality(df: DataFrame, cols: Sequence[str] | None = None,
                high_threshold: int = 50) -> DataFrame:
    """Distinct values per column, with and without
    null, constant / high-cardinality flags.

    Columns are melted into (column, value) pairs — whole numbers as
    bigint, floating ones as doubles (so −0.0 and 0.0 group together, as in
    ``count(DISTINCT)``), the rest as strings — and de-duplicated with one
    map-side combined aggregate, instead of one ``count_distinct``
    expansion per column."""
    cols = list(cols or df.columns)
    whole = [c for c in cols if isinstance(df.schema[c].dataType, IntegralType)]
    num = [c for c in cols if isinstance(df.schema[c].dataType, FractionalType) and not isinstance(df.schema[c].dataType, DecimalType)]
    oth = [c for c in cols if c not in whole and c not in num]
    parts = []
    for group, typ in ((whole, "bigint"), (num, "double"), (oth, "string")):
        if not group:
            continue
        arr = F.array(*[F.struct(F.lit(c).alias("column_name"), F.col(f"`{c}`").cast(typ).alias("v"))
                        for c in group])
        d = df.select(F.inline(arr)).groupBy("column_name", "v").agg(F.lit(1).alias("_x"))
        parts.append(d.groupBy("column_name").agg(F.count("v").alias("n_distinct"),
                                                  F.max(F.col("v").isNull().cast("int")).alias("has_null")))
    prof = reduce(DataFrame.unionByName, parts)
    dn = F.col("n_distinct") + F.coalesce(F.col("has_null"), F.lit(0))
    return prof.select("column_name", "n_distinct", dn.alias("n_distinct_with_null"),
                       (F.col("n_distinct") <= 1).alias("is_constant"),
                       (F.col("n_distinct") > high_threshold).alias("is_high_cardinality"))


def target_mode(df: DataFrame, col: str) -> DataFrame:
    """Most frequent value (smallest among ties), number of
    classes, and the sorted class list."""
    g = df.where(F.col(col).isNotNull()).groupBy(col).agg(F.count(F.lit(1)).alias("n"))
    return g.agg(
        F.min_by(F.col(col), F.struct(-F.col("n"), F.col(col))).alias("mode"),
        F.max("n").alias("mode_count"),
        F.count(F.lit(1)).alias("n_classes"),
        F.sort_array(F.collect_list(F.col(col).cast("string"))).alias("classes"))


def quick_profile(df: DataFrame, name: str, target: str) -> DataFrame:
    """Rows, columns, missing cells, duplicate rows and target stats
    of one dataset in a single row."""
    n = df.agg(F.count(F.lit(1))).scalar()
    nulls = df.agg(sum(F.count_if(F.col(f"`{c}`").isNull()) for c in df.columns)).scalar() \
        if df.columns else F.lit(0)
    distinct = df.distinct().agg(F.count(F.lit(1))).scalar()
    tm = target_mode(df, target)
    return tm.select(
        F.lit(name).alias("dataset"), n.alias("n_rows"), F.lit(len(df.columns)).alias("n_cols"),
        F.lit(len(numeric_columns(df))).alias("n_numeric"), F.lit(len(string_columns(df))).alias("n_object"),
        nulls.alias("missing_cells"), (nulls / (n * F.lit(len(df.columns)))).alias("missing_rate"),
        (n - distinct).alias("n_duplicates"),
        F.col("mode").cast("string").alias("target_mode"), F.col("n_classes").alias("target_unique"))


def category_codes(df: DataFrame, col: str) -> DataFrame:
    """code = position of the value among the sorted distinct
    values (0-based); NULL maps to -1.  Ranks are a blocked running count
    over the distinct values, not a single-task window."""
    from ..plans.ordered import running_sum
    d = df.where(F.col(col).isNotNull()).select(col).distinct().withColumn("_one", F.lit(1))
    r = running_sum(d, col, ["_one"])
    codes = r.select(F.col(col).alias("_v"), (F.col("cum__one") - 1).cast("bigint").alias("code"))
    j = df.join(codes, df[col] == codes["_v"], "left")
    return j.select(*[F.col(f"`{c}`") for c in df.columns],
                    F.coalesce(F.col("code"), F.lit(-1)).cast("bigint").alias(f"{col}_code"))


def unseen_classes(train: DataFrame, test: DataFrame, col: str) -> DataFrame:
    """Classes present in test but not in train (null-safe)."""
    return test.select(col).distinct().subtract(train.select(col).distinct())


def union_splits(frames: dict[str, DataFrame]) -> DataFrame:
    """Bag union matched by name, missing columns filled with NULL,
    tagged with the split name."""
    out = None
    for name, df in frames.items():
        t = df.withColumn("split", F.lit(name)) if "split" not in df.columns else df
        out = t if out is None else out.unionByName(t, allowMissingColumns=True)
    return out


# ---------------------------------------------------------------------------
# Validation reports (M1–M5): one long DataFrame of findings
# (dataset, check, column_name, level, value, message).
# ---------------------------------------------------------------------------

REPORT_SCHEMA = "dataset string, check string, column_name string, level string, value double, message string"


def _finding(dataset, check, column_name, level, value, message) -> Column:
    return F.struct(F.lit(dataset).alias("dataset"), F.lit(check).alias("check"),
                    F.lit(column_name).cast("string").alias("column_name"), F.lit(level).alias("level"),
                    (value if isinstance(value, Column) else F.lit(value)).cast("double").alias("value"),
                    F.lit(message).alias("message"))


def _report(base: DataFrame, candidates: list[tuple[Column, Column]]) -> DataFrame:
    """Keep the findings whose condition holds; base is a one-row frame."""
    arr = F.array(*[F.struct(cond.alias("fire"), f.alias("f")) for cond, f in candidates])
    return (base.select(F.explode(arr).alias("x")).where("x.fire").select("x.f.*"))


def _balance_stats(df: DataFrame, dataset: str, target: str) -> DataFrame:
    """One ``class_balance`` stat per class: its share of the rows, the class as message."""
    g = df.groupBy(F.col(f"`{target}`").alias("c")).agg(F.count(F.lit(1)).alias("k"))
    total = g.agg(F.sum("k")).scalar()
    return g.select(F.lit(dataset).alias("dataset"), F.lit("class_balance").alias("check"),
                    F.lit(target).alias("column_name"), F.lit("stat").alias("level"),
                    (F.col("k") / total).cast("double").alias("value"), F.col("c").cast("string").alias("message"))


def validate_flows(df: DataFrame, split: str = "train", null_warn: float = 0.05,
                   minority_warn: float = 0.10) -> DataFrame:
    """M1: flow validation report."""
    spark = df.sparkSession
    ds = f"UNSW-NB15 ({split})"
    cand: list[tuple[Column, Column]] = []
    for t in FLOW_TARGETS:
        if t not in df.columns:
            cand.append((F.lit(True), _finding(ds, "missing_target", t, "error", None,
                                               "required column is absent")))
    n = F.count(F.lit(1))
    aggs = [n.alias("n")] + [F.count_if(F.col(f"`{c}`").isNull()).alias(f"null_{i}")
                             for i, c in enumerate(df.columns)]
    base = df.agg(*aggs)
    distinct = df.distinct().agg(F.count(F.lit(1))).scalar()
    base = base.withColumn("dups", F.col("n") - distinct)
    if "label" in df.columns:
        lab = df.groupBy("label").agg(F.count(F.lit(1)).alias("c")).agg(
            F.min("c").alias("minc"), F.sum("c").alias("tot"), F.count(F.lit(1)).alias("k"))
        base = base.withColumn("minority", (lab.select(F.col("minc") / F.col("tot")).scalar()))
    for i, c in enumerate(df.columns):
        rate = F.col(f"null_{i}") / F.col("n")
        cand.append((rate > null_warn, _finding(ds, "high_nulls", c, "warning", rate, "many nulls")))
    cand.append((F.col("dups") > 0, _finding(ds, "duplicates", None, "warning", F.col("dups"),
                                             "some rows repeat")))
    if "label" in df.columns:
        cand.append((F.col("minority") < minority_warn,
                     _finding(ds, "class_imbalance", "label", "warning", F.col("minority"),
                              "the rarest class is under the warning share")))
    for c in FLOW_CATEGORICAL:
        if c in df.columns and isinstance(df.schema[c].dataType, StringType):
            cand.append((F.lit(True), _finding(ds, "needs_encoding", c, "warning", None,
                                               "text column, encode it before fitting")))
    total_nulls = sum((F.col(f"null_{i}") for i in range(len(df.columns))), F.lit(0))
    cand.append((F.lit(True), _finding(ds, "numeric_cols", None, "stat",
                                       F.lit(len(numeric_columns(df))), "numeric columns")))
    cand.append((F.lit(True), _finding(ds, "total_nulls", None, "stat", total_nulls, "total nulls")))
    out = _report(base, cand)
    return out.unionByName(_balance_stats(df, ds, "label")) if "label" in df.columns else out


def validate_syscalls(df: DataFrame, sparse_warn: float = 0.05) -> DataFrame:
    """M2: system-call validation report."""
    ds = "BETH"
    cand: list[tuple[Column, Column]] = []
    aggs = [F.count(F.lit(1)).alias("n")] + \
        [F.count_if(F.col(f"`{c}`").isNull()).alias(f"null_{i}") for i, c in enumerate(df.columns)]
    if SYSCALL_TARGET in df.columns:
        aggs.append(F.avg(SYSCALL_TARGET).alias("evil_rate"))
    base = df.agg(*aggs)
    if SYSCALL_TARGET not in df.columns:
        cand.append((F.lit(True), _finding(ds, "missing_target", SYSCALL_TARGET, "error", None,
                                           "target column is absent")))
    else:
        cand.append((F.lit(True), _finding(ds, "evil_rate", SYSCALL_TARGET, "stat",
                                           F.col("evil_rate"), "evil rate")))
        cand.append((F.col("evil_rate") < sparse_warn,
                     _finding(ds, "sparse_labels", SYSCALL_TARGET, "warning", F.col("evil_rate"),
                              "positive labels are too rare to learn from")))
    for c in SYSCALL_NUMERIC:
        if c not in df.columns:
            cand.append((F.lit(True), _finding(ds, "missing_numeric", c, "warning", None,
                                               "numeric column is absent")))
    total_nulls = sum((F.col(f"null_{i}") for i in range(len(df.columns))), F.lit(0))
    cand.append((F.lit(True), _finding(ds, "total_nulls", None, "stat", total_nulls, "total nulls")))
    return _report(base, cand)


def validate_attacks(df: DataFrame, target: str = ATTACK_TARGET,
                     expected: Sequence[str] = ATTACK_CLASSES) -> DataFrame:
    """Attack-log validation (target, class set, balance, nulls)."""
    ds = "Cyber Attacks (Synthetic)"
    cand: list[tuple[Column, Column]] = []
    aggs = [F.count(F.lit(1)).alias("n")] + \
        [F.count_if(F.col(f"`{c}`").isNull()).alias(f"null_{i}") for i, c in enumerate(df.columns)]
    if target in df.columns:      # counted, so that no task holds the classes
        t = F.col(f"`{target}`")
        aggs += [F.count_if(t.isNotNull() & ~t.isin(list(expected))).alias("others"),
                 *(F.count_if(t == x).alias(f"class_{i}") for i, x in enumerate(expected))]
    base = df.agg(*aggs)
    if target not in df.columns:
        cand.append((F.lit(True), _finding(ds, "missing_target", target, "error", None,
                                           "target column is absent")))
    else:
        seen = [F.col(f"class_{i}") > 0 for i in range(len(expected))]
        base = base.withColumn("classes_ok", (F.col("others") == 0) & reduce(lambda a, b: a & b, seen, F.lit(True)))
        cand.append((~F.col("classes_ok"), _finding(ds, "unexpected_classes", target, "warning", None,
                                                    "class set differs from the expected one")))
    total_nulls = sum((F.col(f"null_{i}") for i in range(len(df.columns))), F.lit(0))
    cand.append((F.lit(True), _finding(ds, "total_nulls", None, "stat", total_nulls, "total nulls")))
    out = _report(base, cand)
    return out.unionByName(_balance_stats(df, ds, target)) if target in df.columns else out


def report_status(report: DataFrame) -> DataFrame:
    """M4: passed ⇔ no error finding, per dataset."""
    return report.groupBy("dataset").agg(
        F.coalesce(F.bool_and(F.col("level") != "error"), F.lit(True)).alias("passed"),
        F.count_if(F.col("level") == "error").alias("n_errors"),
        F.count_if(F.col("level") == "warning").alias("n_warnings"))


def split_consistency(train: DataFrame, test: DataFrame, target: str) -> DataFrame:
    """Column-set differences, shapes and target presence (one row)."""
    tr, te = set(train.columns), set(test.columns)
    spark = train.sparkSession
    n_tr = train.agg(F.count(F.lit(1))).scalar()
    n_te = test.agg(F.count(F.lit(1))).scalar()
    return spark.range(1).select(
        n_tr.alias("train_rows"), F.lit(len(train.columns)).alias("train_cols"),
        n_te.alias("test_rows"), F.lit(len(test.columns)).alias("test_cols"),
        F.array(*[F.lit(c) for c in sorted(tr - te)]).cast("array<string>").alias("only_in_train"),
        F.array(*[F.lit(c) for c in sorted(te - tr)]).cast("array<string>").alias("only_in_test"),
        F.lit(target in tr and target in te).alias("target_in_both"))

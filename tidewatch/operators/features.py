"""Feature pipelines.

The preprocessors are ``pyspark.ml`` Pipelines:

    ExactImputeScale → StringIndexer(alphabetAsc, keep) → OneHotEncoder(dropLast)
    → VectorAssembler

``ExactImputeScale`` is our own Estimator because MLlib's ``Imputer``
returns the lower middle element instead of the midpoint median and
rejects strings, and its ``StandardScaler`` uses the sample std and
zeroes constant columns.  Its statistics come from one aggregate plus
the distributed exact-quantile helper; the fitted model is a handful of
literals applied as column expressions (whole-stage codegen).

With ``handleInvalid="keep"`` the indexer sends unseen categories to the
last index, which ``dropLast`` removes: an unknown category encodes as
all zeros, exactly the "ignore unknown" one-hot.
"""

from __future__ import annotations

import json
from collections.abc import Sequence

from pyspark import keyword_only
from pyspark.ml import Estimator, Model, Pipeline, PipelineModel
from pyspark.ml.feature import OneHotEncoder, PCA, StringIndexer, VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.ml.param import Param, Params, TypeConverters
from pyspark.ml.util import DefaultParamsReadable, DefaultParamsWritable
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import NumericType, StringType

from ..plans.ordered import histogram_quantiles

# Fixed values of the reference's preprocessors.
FLOW_CATEGORICAL = ["proto", "service", "state"]
FLOW_TARGETS = ["label", "attack_cat"]
FLOW_ID_COLS = ["id"]
# The ten live flow fields used by the two-stage detector.
LIVE_FEATURE_COLS = ["proto", "service", "state", "dur", "sbytes", "dbytes", "sttl", "dttl",
                     "spkts", "dpkts"]
# System-call identifier columns dropped by the class preprocessor (fixed values, stored
# snake_case names of processId, threadId, parentProcessId, userId, mountNamespace,
# returnValue, argsNum, processName, hostName; trap T27).
SYSCALL_ID_COLS = ["process_id", "thread_id", "parent_process_id", "user_id", "mount_namespace",
                   "return_value", "args_num", "process_name", "host_name"]
SYSCALL_TARGETS = ["evil", "sus"]
# Attack-log feature sets (fixed values: names and columns as in the source CSV).
ATTACK_FEATURE_SETS = {
    "metadata_only": ["Destination Port", "Protocol", "Packet Length", "Packet Type", "Traffic Type",
                      "Anomaly Scores", "Action Taken"],
    "with_leakage": ["Destination Port", "Protocol", "Packet Length", "Packet Type", "Traffic Type",
                     "Anomaly Scores", "Action Taken", "Severity Level", "Malware Indicators"],
}
MISSING_NUMERIC_DEFAULT = 0.0
MISSING_CATEGORY_DEFAULT = "-"


class _ImputeScaleParams(Params):
    numericCols = Param(Params._dummy(), "numericCols", "numeric input columns",
                        typeConverter=TypeConverters.toListString)
    categoricalCols = Param(Params._dummy(), "categoricalCols", "string input columns",
                            typeConverter=TypeConverters.toListString)
    scaler = Param(Params._dummy(), "scaler", "standard | robust | center | none",
                   typeConverter=TypeConverters.toString)
    impute = Param(Params._dummy(), "impute", "fill nulls with median / mode",
                   typeConverter=TypeConverters.toBoolean)
    suffix = Param(Params._dummy(), "suffix", "output column suffix",
                   typeConverter=TypeConverters.toString)

    def __init__(self):
        super().__init__()
        self._setDefault(numericCols=[], categoricalCols=[], scaler="standard", impute=True,
                         suffix="__f")


class ExactImputeScale(Estimator, _ImputeScaleParams, DefaultParamsReadable, DefaultParamsWritable):
    """Exact median / most-frequent imputation and standard
    (population std, constant → scale 1) or robust (median / IQR) scaling."""

    @keyword_only
    def __init__(self, *, numericCols=None, categoricalCols=None, scaler="standard",
                 impute=True, suffix="__f"):
        super().__init__()
        self._set(**self._input_kwargs)

    def _fit(self, df: DataFrame) -> "ExactImputeScaleModel":
        stats = impute_scale_stats(df, self.getOrDefault("numericCols"),
                                   self.getOrDefault("categoricalCols"),
                                   self.getOrDefault("scaler"))
        m = ExactImputeScaleModel(statsJson=json.dumps(stats))
        for p in ("numericCols", "categoricalCols", "scaler", "impute", "suffix"):
            m._set(**{p: self.getOrDefault(p)})
        return m


class ExactImputeScaleModel(Model, _ImputeScaleParams, DefaultParamsReadable, DefaultParamsWritable):
    statsJson = Param(Params._dummy(), "statsJson", "fitted statistics (JSON)",
                      typeConverter=TypeConverters.toString)

    @keyword_only
    def __init__(self, *, statsJson="{}"):
        super().__init__()
        self._set(**self._input_kwargs)

    @property
    def stats(self) -> dict:
        return json.loads(self.getOrDefault("statsJson"))

    def _transform(self, df: DataFrame) -> DataFrame:
        st = self.stats
        sfx = self.getOrDefault("suffix")
        impute = self.getOrDefault("impute")
        cols = {}
        for c in self.getOrDefault("numericCols"):
            x = F.col(f"`{c}`").cast("double")
            fill = st["fill"].get(c)
            if impute and fill is not None:
                x = F.coalesce(F.when(~F.isnan(x), x), F.lit(float(fill)))
            ctr, scl = st["center"].get(c, 0.0), st["scale"].get(c, 1.0)
            cols[c + sfx] = (x - F.lit(float(ctr))) / F.lit(float(scl))
        for c in self.getOrDefault("categoricalCols"):
            x = F.col(f"`{c}`").cast("string")
            fill = st["fill"].get(c)
            if impute and fill is not None:
                x = F.coalesce(x, F.lit(fill))
            cols[c + sfx] = x
        return df.withColumns(cols)


def impute_scale_stats(df: DataFrame, num: Sequence[str], cat: Sequence[str], scaler: str) -> dict:
    """Exact statistics of I5–I8; the driver receives one number per
    column.  As in an impute-then-scale pipeline, the scaling statistics
    are taken over the imputed column (a second pass only when needed)."""
    fill, center, scale = {}, {}, {}
    num, cat = list(num), list(cat)

    def melt(cols, fills=None):
        items = []
        for c in cols:
            x = F.col(f"`{c}`").cast("double")
            x = F.when(~F.isnan(x), x)
            if fills is not None and fills.get(c) is not None:
                x = F.coalesce(x, F.lit(float(fills[c])))
            items.append(F.struct(F.lit(c).alias("column_name"), x.alias("value")))
        return df.select(F.inline(F.array(*items))).where(F.col("value").isNotNull())

    if num:
        probs = [0.25, 0.5, 0.75] if scaler == "robust" else [0.5]
        base = melt(num)
        q = {(r["column_name"], r["p"]): r["q"]
             for r in histogram_quantiles(base, "value", probs, "column_name").collect()}
        fill.update({c: q.get((c, 0.5)) for c in num})
        nulls = df.agg(*[F.count_if(F.col(f"`{c}`").isNull() | F.isnan(F.col(f"`{c}`").cast("double")))
                         .alias(f"n{i}") for i, c in enumerate(num)]).first()
        has_null = any(nulls[f"n{i}"] for i in range(len(num)))
        data = melt(num, fill) if has_null else base
        if has_null and scaler == "robust":
            q = {(r["column_name"], r["p"]): r["q"]
                 for r in histogram_quantiles(data, "value", probs, "column_name").collect()}
        mom = {r["column_name"]: (r["mu"], r["sd"]) for r in data.groupBy("column_name").agg(
            F.avg("value").alias("mu"), F.stddev_pop("value").alias("sd")).collect()}
        for c in num:
            mu, sd = mom.get(c, (None, None))
            if scaler == "standard":
                center[c] = mu if mu is not None else 0.0
                scale[c] = sd if sd else 1.0
            elif scaler == "robust":
                iqr = (q.get((c, 0.75)) or 0.0) - (q.get((c, 0.25)) or 0.0)
                center[c] = q.get((c, 0.5)) if q.get((c, 0.5)) is not None else 0.0
                scale[c] = iqr if iqr else 1.0
            elif scaler == "center":
                center[c] = mu if mu is not None else 0.0
    if cat:
        items = [F.struct(F.lit(c).alias("column_name"), F.col(f"`{c}`").cast("string").alias("v"))
                 for c in cat]
        g = (df.select(F.inline(F.array(*items))).where(F.col("v").isNotNull())
               .groupBy("column_name", "v").count())
        modes = g.groupBy("column_name").agg(
            F.min_by("v", F.struct(-F.col("count"), F.col("v"))).alias("m")).collect()
        fill.update({r["column_name"]: r["m"] for r in modes})
    return {"fill": fill, "center": center, "scale": scale}


def build_preprocessor(numeric: Sequence[str], categorical: Sequence[str], scaler: str = "standard",
                       impute: bool = True, output: str = "features") -> Pipeline:
    """The preprocessing Pipeline (remainder dropped)."""
    sfx = "__f"
    stages = [ExactImputeScale(numericCols=list(numeric), categoricalCols=list(categorical),
                               scaler=scaler, impute=impute, suffix=sfx)]
    vec_inputs = [c + sfx for c in numeric]
    if categorical:
        idx_out = [c + "__idx" for c in categorical]
        ohe_out = [c + "__ohe" for c in categorical]
        stages.append(StringIndexer(inputCols=[c + sfx for c in categorical], outputCols=idx_out,
                                    stringOrderType="alphabetAsc", handleInvalid="keep"))
        # the indexer's "unknown" index is the last slot, which dropLast
        # removes; the encoder itself must not add another one
        stages.append(OneHotEncoder(inputCols=idx_out, outputCols=ohe_out, dropLast=True))
        vec_inputs += ohe_out
    stages.append(VectorAssembler(inputCols=vec_inputs, outputCol=output, handleInvalid="keep"))
    return Pipeline(stages=stages)


def _numeric(df: DataFrame, exclude: Sequence[str]) -> list[str]:
    return [f.name for f in df.schema.fields
            if isinstance(f.dataType, NumericType) and f.name not in set(exclude)]


def flow_columns(df: DataFrame, target: str = "label") -> tuple[list[str], list[str]]:
    """numeric = every numeric column except targets and ids;
    categorical = proto / service / state when present."""
    drop = set(FLOW_TARGETS) | set(FLOW_ID_COLS) | {target}
    num = _numeric(df, drop)
    cat = [c for c in FLOW_CATEGORICAL if c in df.columns]
    return num, cat


def syscall_columns(df: DataFrame, feature_set: str = "class") -> list[str]:
    """``class`` drops the id columns; ``notebook`` keeps exactly
    the ids and counters the notebook used."""
    if feature_set == "class":
        # record_id is the stored row key, not a feature
        return _numeric(df, set(SYSCALL_ID_COLS) | set(SYSCALL_TARGETS) | {"split", "record_id"})
    if feature_set == "notebook":
        wanted = ["process_id", "thread_id", "parent_process_id", "user_id", "mount_namespace",
                  "event_id", "args_num", "return_value"]
        return [c for c in wanted if c in df.columns]
    raise ValueError(f"unknown syscall feature set {feature_set!r}")


def attack_columns(df: DataFrame, feature_set: str = "metadata_only") -> tuple[list[str], list[str]]:
    """Present columns of a named set, split by dtype; errors on an
    unknown set or when none of its columns exist."""
    if feature_set not in ATTACK_FEATURE_SETS:
        raise ValueError(f"unknown feature set {feature_set!r}; choose {sorted(ATTACK_FEATURE_SETS)}")
    present = [c for c in ATTACK_FEATURE_SETS[feature_set] if c in df.columns]
    if not present:
        raise ValueError(f"no column of feature set {feature_set!r} found")
    num = [c for c in present if isinstance(df.schema[c].dataType, NumericType)]
    cat = [c for c in present if isinstance(df.schema[c].dataType, StringType)]
    return num, cat


def with_defaults(df: DataFrame, numeric: Sequence[str], categorical: Sequence[str]) -> DataFrame:
    """Add absent live fields (numeric 0, categorical "-"); explicit
    NULLs are left for the imputer (trap T16)."""
    add = {c: F.lit(MISSING_NUMERIC_DEFAULT) for c in numeric if c not in df.columns}
    add.update({c: F.lit(MISSING_CATEGORY_DEFAULT) for c in categorical if c not in df.columns})
    return df.withColumns(add) if add else df


def feature_names(df: DataFrame, col: str = "features") -> list[str]:
    """I4: names of the assembled slots from the ML attribute metadata."""
    meta = df.schema[col].metadata.get("ml_attr", {})
    attrs = []
    for group in meta.get("attrs", {}).values():
        attrs.extend(group)
    attrs.sort(key=lambda a: a["idx"])
    return [a["name"].replace("__f", "").replace("__ohe", "") for a in attrs]


def label_indexer(col: str, output: str = "label_idx") -> StringIndexer:
    """Sorted label encoding; an unseen label at transform is an error."""
    return StringIndexer(inputCol=col, outputCol=output, stringOrderType="alphabetAsc",
                         handleInvalid="error")


def class_weights(df: DataFrame, y: str) -> DataFrame:
    """Balanced weights n / (k · n_c) per class."""
    g = df.groupBy(y).agg(F.count(F.lit(1)).alias("n_c"))
    n = g.agg(F.sum("n_c")).scalar()
    k = g.agg(F.count(F.lit(1))).scalar()
    return g.select(y, "n_c", (n / (k * F.col("n_c"))).alias("weight"))


def with_class_weight(df: DataFrame, y: str, out: str = "weight") -> DataFrame:
    """J4 as a ``weightCol``; the per-class table is broadcast, else all rows
    are shuffled by their class."""
    w = class_weights(df, y).select(y, F.col("weight").alias(out))
    return df.join(F.broadcast(w), y, "left")


def positive_weight(df: DataFrame, y: str) -> DataFrame:
    """n_neg / n_pos for the boosted stage-1 model (T19: computed, the
    configured constant is ignored)."""
    return df.agg(F.count_if(F.col(y) == 1).alias("n_pos"), F.count_if(F.col(y) != 1).alias("n_neg")) \
             .select("n_pos", "n_neg",
                     F.when(F.col("n_pos") > 0, F.col("n_neg") / F.col("n_pos")).alias("scale_pos_weight"))


def fit_pca(df: DataFrame, cols: Sequence[str], k: int = 2, standardize: bool = True):
    """PCA on centred (optionally standardised) columns.  ML's PCA
    does not centre on transform, so centring is an explicit stage."""
    pre = Pipeline(stages=[
        ExactImputeScale(numericCols=list(cols), scaler="standard" if standardize else "center",
                         impute=True),
        VectorAssembler(inputCols=[c + "__f" for c in cols], outputCol="_x"),
        PCA(k=k, inputCol="_x", outputCol="pca")])
    return pre.fit(df)


def pca_projection(model: PipelineModel, df: DataFrame) -> DataFrame:
    """I16: 2-D coordinates of each row (sign of a component is arbitrary)."""
    out = model.transform(df)
    arr = vector_to_array("pca")
    return out.withColumn("pc1", arr[0]).withColumn("pc2", arr[1])


def pca_spectrum(model: PipelineModel) -> list[tuple[int, float, float]]:
    """(component, explained-variance ratio, cumulative) per component."""
    ev = list(model.stages[-1].explainedVariance.toArray())
    out, acc = [], 0.0
    for i, r in enumerate(ev):
        acc += r
        out.append((i + 1, float(r), float(acc)))
    return out


def fill_values(df: DataFrame, numeric: Sequence[str], categorical: Sequence[str]) -> DataFrame:
    """I5/I6 as a DataFrame: (column_name, kind, median, mode)."""
    from .profile import melt
    out = None
    if numeric:
        q = histogram_quantiles(melt(df, numeric), "value", [0.5], "column_name")
        out = q.select("column_name", F.lit("numeric").alias("kind"), F.col("q").alias("median"),
                       F.lit(None).cast("string").alias("mode"))
    if categorical:
        items = [F.struct(F.lit(c).alias("column_name"), F.col(f"`{c}`").cast("string").alias("v"))
                 for c in categorical]
        g = (df.select(F.inline(F.array(*items))).where(F.col("v").isNotNull())
               .groupBy("column_name", "v").count())
        m = g.groupBy("column_name").agg(F.min_by("v", F.struct(-F.col("count"), F.col("v"))).alias("mode"))
        m = m.select("column_name", F.lit("categorical").alias("kind"),
                     F.lit(None).cast("double").alias("median"), "mode")
        out = m if out is None else out.unionByName(m)
    return out


def scaler_stats(df: DataFrame, numeric: Sequence[str]) -> DataFrame:
    """I7/I8 as a DataFrame: mean, population std (constant → 1),
    median and IQR (constant → 1) per column."""
    from .profile import melt
    from ..plans.ordered import histogram_quantiles_wide
    m = melt(df, numeric).where(F.col("value").isNotNull() & ~F.isnan("value"))
    mom = m.groupBy("column_name").agg(F.avg("value").alias("mean"), F.stddev_pop("value").alias("sd"))
    q = histogram_quantiles_wide(m, "value", {"q1": .25, "median": .5, "q3": .75}, "column_name")
    j = mom.join(q, "column_name")
    iqr = F.col("q3") - F.col("q1")
    return j.select("column_name", "mean",
                    F.when(F.col("sd") > 0, F.col("sd")).otherwise(F.lit(1.0)).alias("std_scale"),
                    "median", F.when(iqr != 0, iqr).otherwise(F.lit(1.0)).alias("iqr_scale"))

"""Evaluation metrics and statistics on scored DataFrames (L1–L11, F4–F6,
K13).

Label, prediction and score ride in the same row, so no metric needs a
join.  Threshold-free metrics (AUC, AP, ROC) first collapse the rows to
distinct scores with (positives, negatives) counts — map-side combined,
so a score value shared by a third of the rows is one row after the
partial aggregate — and then run blocked prefix sums over the distinct
scores (:mod:`tidewatch.plans.ordered`), never a single-task window.
"""

from __future__ import annotations

import math
from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..plans.ordered import exact_quantiles, running_sum


def _c(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def _safe_div(a: Column, b: Column) -> Column:
    """a / b, 0.0 when b == 0 (zero-division → 0, as in the reference)."""
    return F.when(b != 0, a.cast("double") / b).otherwise(F.lit(0.0))


def binary_counts(df: DataFrame, y: str, pred: str, weight: str | None = None) -> DataFrame:
    w = F.col(weight) if weight else F.lit(1)
    yy, pp = F.col(y) == 1, F.col(pred) == 1
    return df.agg(F.sum(F.when(yy & pp, w).otherwise(0)).alias("tp"),
                  F.sum(F.when(~yy & pp, w).otherwise(0)).alias("fp"),
                  F.sum(F.when(yy & ~pp, w).otherwise(0)).alias("fn"),
                  F.sum(F.when(~yy & ~pp, w).otherwise(0)).alias("tn"))


def binary_metrics(df: DataFrame, y: str, pred: str) -> DataFrame:
    """L1: accuracy, precision, recall, F1 of the positive class, and
    macro / weighted F1 over both classes (one aggregate)."""
    c = binary_counts(df, y, pred)
    tp, fp, fn, tn = (F.col(x) for x in ("tp", "fp", "fn", "tn"))
    n = tp + fp + fn + tn
    f1_pos = _safe_div(2 * tp, 2 * tp + fp + fn)
    f1_neg = _safe_div(2 * tn, 2 * tn + fn + fp)
    return c.select(
        n.alias("n"), "tp", "fp", "fn", "tn",
        _safe_div(tp + tn, n).alias("accuracy"),
        _safe_div(tp, tp + fp).alias("precision"),
        _safe_div(tp, tp + fn).alias("recall"),
        f1_pos.alias("f1"),
        ((f1_pos + f1_neg) / 2).alias("f1_macro"),
        _safe_div(f1_pos * (tp + fn) + f1_neg * (tn + fp), n).alias("f1_weighted"))


def confusion_matrix(df: DataFrame, y: str, pred: str) -> DataFrame:
    """L2: counts for every (true, predicted) pair of the sorted label set,
    zero cells kept.  The k×k grid is generated from the collected class
    set (k labels), not by joining tables."""
    counts = df.groupBy(F.col(y).alias("true_label"), F.col(pred).alias("pred_label")) \
               .agg(F.count(F.lit(1)).alias("count"))
    classes = counts.select(F.array_union(F.collect_set("true_label"), F.collect_set("pred_label")).alias("k"))
    grid = classes.select(F.explode("k").alias("true_label"), "k") \
                  .select("true_label", F.explode("k").alias("pred_label"))
    return grid.join(counts, ["true_label", "pred_label"], "left").select(
        "true_label", "pred_label", F.coalesce(F.col("count"), F.lit(0)).cast("bigint").alias("count"))


def class_report(df: DataFrame, y: str, pred: str) -> DataFrame:
    """L3: per-class precision / recall / F1 / support plus macro and
    weighted averages (rows ``macro avg`` / ``weighted avg``)."""
    ev = F.array(F.struct(F.col(y).cast("string").alias("cls"), F.lit(1).alias("t"),
                          (F.col(y) == F.col(pred)).cast("int").alias("tp"), F.lit(0).alias("p")),
                 F.struct(F.col(pred).cast("string").alias("cls"), F.lit(0).alias("t"),
                          F.lit(0).alias("tp"), F.lit(1).alias("p")))
    per = df.select(F.inline(ev)).groupBy("cls").agg(
        F.sum("t").alias("support"), F.sum("tp").alias("tp"), F.sum("p").alias("n_pred"))
    prec = _safe_div(F.col("tp"), F.col("n_pred"))
    rec = _safe_div(F.col("tp"), F.col("support"))
    f1 = _safe_div(2 * F.col("tp"), F.col("support") + F.col("n_pred"))
    rows = per.select("cls", prec.alias("precision"), rec.alias("recall"), f1.alias("f1"),
                      F.col("support").cast("bigint").alias("support"))
    k_rows = rows.where(F.col("support") > 0)
    avg = k_rows.agg(F.avg("precision").alias("precision"), F.avg("recall").alias("recall"),
                     F.avg("f1").alias("f1"), F.sum("support").alias("support"))
    wavg = k_rows.agg((F.sum(F.col("precision") * F.col("support")) / F.sum("support")).alias("precision"),
                      (F.sum(F.col("recall") * F.col("support")) / F.sum("support")).alias("recall"),
                      (F.sum(F.col("f1") * F.col("support")) / F.sum("support")).alias("f1"),
                      F.sum("support").alias("support"))
    return (rows.unionByName(avg.select(F.lit("macro avg").alias("cls"), "*"))
                .unionByName(wavg.select(F.lit("weighted avg").alias("cls"), "*")))


def score_counts(df: DataFrame, y: str, score: str, weight: str | None = None,
                 group_cols: Sequence[str] = ()) -> DataFrame:
    """Distinct scores with positive / negative (weighted) counts."""
    w = F.col(weight) if weight else F.lit(1)
    return (df.where(F.col(score).isNotNull())
              .groupBy(*group_cols, F.col(score).cast("double").alias("s"))
              .agg(F.sum(F.when(F.col(y) == 1, w).otherwise(0)).alias("pos"),
                   F.sum(F.when(F.col(y) == 1, 0).otherwise(w)).alias("neg")))


def auc_from_counts(sc: DataFrame, group_cols: Sequence[str] = ()) -> DataFrame:
    """Exact ROC AUC with tied scores counted half (Mann–Whitney)."""
    g = list(group_cols)
    r = running_sum(sc, "s", ["pos", "neg"], g)
    below = F.col("cum_neg") - F.col("neg")
    part = F.col("pos").cast("double") * (below.cast("double") + F.col("neg").cast("double") / 2)
    a = r.groupBy(*g).agg(F.sum(part).alias("num"), F.first("tot_pos").alias("P"),
                          F.first("tot_neg").alias("N"))
    den = F.col("P").cast("double") * F.col("N").cast("double")
    return a.select(*g, F.when(den > 0, F.col("num") / den).alias("roc_auc"),
                    F.col("P").cast("bigint").alias("n_pos"), F.col("N").cast("bigint").alias("n_neg"))


def roc_auc(df: DataFrame, y: str, score: str, group_cols: Sequence[str] = ()) -> DataFrame:
    """Exact AUC (``BinaryClassificationEvaluator`` bins scores)."""
    return auc_from_counts(score_counts(df, y, score, group_cols=group_cols), group_cols)


def roc_points(df: DataFrame, y: str, score: str) -> DataFrame:
    """One ROC point per distinct score (threshold ≥ score),
    descending threshold order: cumulative TP / FP and their rates."""
    sc = score_counts(df, y, score).withColumn("neg_s", -F.col("s"))
    r = running_sum(sc, "neg_s", ["pos", "neg"])
    return r.select(F.col("s").alias("threshold"), F.col("cum_pos").cast("bigint").alias("tp"),
                    F.col("cum_neg").cast("bigint").alias("fp"),
                    _safe_div(F.col("cum_pos"), F.col("tot_pos")).alias("tpr"),
                    _safe_div(F.col("cum_neg"), F.col("tot_neg")).alias("fpr"))


def average_precision(df: DataFrame, y: str, score: str, group_cols: Sequence[str] = ()) -> DataFrame:
    """Step-wise average precision Σ (R_k − R_{k−1})·P_k over
    distinct thresholds (``areaUnderPR`` is a trapezoid instead)."""
    g = list(group_cols)
    sc = score_counts(df, y, score, group_cols=g).withColumn("neg_s", -F.col("s"))
    r = running_sum(sc, "neg_s", ["pos", "neg"], g)
    prec = F.col("cum_pos") / (F.col("cum_pos") + F.col("cum_neg"))
    term = F.when(F.col("tot_pos") > 0, prec * F.col("pos") / F.col("tot_pos"))
    return r.groupBy(*g).agg(F.sum(term).alias("average_precision"))


def adjusted_rand_index(df: DataFrame, a: str, b: str) -> DataFrame:
    """ARI from the contingency table (pair-counting form)."""
    cont = df.groupBy(a, b).agg(F.count(F.lit(1)).alias("n"))

    def c2(x: Column) -> Column:
        x = x.cast("double")
        return x * (x - 1) / 2
    sa = cont.groupBy(a).agg(F.sum("n").alias("n")).agg(F.sum(c2(F.col("n")))).scalar()
    sb = cont.groupBy(b).agg(F.sum("n").alias("n")).agg(F.sum(c2(F.col("n")))).scalar()
    agg = cont.agg(F.sum(c2(F.col("n"))).alias("idx"), F.sum("n").alias("n"))
    exp_ = sa * sb / c2(F.col("n"))
    mx = (sa + sb) / 2
    return agg.select(F.when(mx == exp_, F.lit(1.0)).otherwise(
        (F.col("idx") - exp_) / (mx - exp_)).alias("ari"))


# ---------------------------------------------------------------------------
# McNemar (L10, D9)
# ---------------------------------------------------------------------------

def _stirling_rest(x: float) -> float:
    """log x! minus its Stirling formula; series for large x, exact below."""
    if x < 16:
        return math.lgamma(x + 1) - ((x + 0.5) * math.log(x) - x + 0.5 * math.log(2 * math.pi)) if x else 0.0
    return (1 / 12 - (1 / 360 - 1 / 1260 / (x * x)) / (x * x)) / x


def binom_two_sided_p(k: int, n: int) -> float:
    """Exact two-sided binomial p (p = .5): min(1, 2·P[X ≤ k]), k ≤ n/2.

    The point probability at k is taken in saddle-point form (Stirling
    rests and the deviance from n/2, which lose no digits for large n);
    the tail below it follows from the ratios j / (n − j + 1) of
    neighbouring probabilities, summed over the stretch that matters.
    """
    k = min(k, n - k)
    if n == 0 or 2 * k == n:
        return 1.0
    if k == 0:
        return min(1.0, 2.0 * math.exp(-n * math.log(2.0)))
    shift = (n - 2 * k) / n                      # k = n/2 (1 − shift)
    deviance = 0.5 * n * ((1 - shift) * math.log1p(-shift) + (1 + shift) * math.log1p(shift))
    log_pmf = (_stirling_rest(n) - _stirling_rest(k) - _stirling_rest(n - k) - deviance
               + 0.5 * math.log(n / (2 * math.pi * k * (n - k))))
    j = np.arange(k, max(0, k - int(12 * math.sqrt(n)) - 50), -1, dtype=np.float64)
    tail = 1.0 + float(np.exp(np.cumsum(np.log(j / (n - j + 1)))).sum())
    return min(1.0, 2.0 * math.exp(log_pmf) * tail)


def _binom_p(k: pd.Series, n: pd.Series) -> pd.Series:
    return pd.Series([binom_two_sided_p(int(a), int(b)) for a, b in zip(k, n)], dtype="float64")


def mcnemar(df: DataFrame, y: str, a: str, b: str) -> DataFrame:
    """Exact McNemar test of two classifiers on the same rows.

    b = A right & B wrong, c = A wrong & B right.  The counts are one
    aggregate; the p-value is computed on those two scalars (a one-row
    Arrow batch).  ``significant`` uses the unrounded p (trap T32); no
    discordant pair ⇒ p = 1, no favourite (trap T33).
    """
    ra, rb = F.col(a) == F.col(y), F.col(b) == F.col(y)
    cnt = df.agg(F.count_if(ra & ~rb).alias("b"), F.count_if(~ra & rb).alias("c"))
    k = F.least("b", "c")
    n = F.col("b") + F.col("c")
    p = F.when(n == 0, F.lit(1.0)).otherwise(F.pandas_udf(_binom_p, "double")(k, n))
    return cnt.select("b", "c", p.alias("p_value"),
                      F.when(F.col("b") > F.col("c"), "model_a").when(F.col("c") > F.col("b"), "model_b")
                       .otherwise("tie").alias("favours"),
                      (p < 0.05).alias("significant"))


# ---------------------------------------------------------------------------
# Threshold selection
# ---------------------------------------------------------------------------

def f1_threshold_curve(df: DataFrame, y: str, score: str, lo_q: float = 0.70,
                       hi_q: float = 0.995, n_steps: int = 60) -> DataFrame:
    """F1 at each of ``n_steps`` thresholds evenly spaced between two
    score quantiles (``score >= t`` is positive).

    Each row is assigned the number of grid thresholds it clears (an
    arithmetic bucket, corrected against the exact grid values), so the
    grid is evaluated with one aggregate over ≤ n_steps + 1 buckets —
    no cross join of rows × thresholds.
    """
    # the two grid ends are scalars: fetch them once and inline them as
    # literals (keeps the bucket expression small and codegen-friendly)
    qs = {r["p"]: r["q"] for r in exact_quantiles(df, score, [lo_q, hi_q]).collect()}
    lo, hi = qs.get(lo_q), qs.get(hi_q)
    if lo is None or hi is None:
        raise ValueError("no scores to threshold")
    step = (hi - lo) / (n_steps - 1)

    def t(i: Column) -> Column:   # numpy.linspace grid value
        return F.when(i == n_steps - 1, F.lit(hi)).otherwise(i.cast("double") * F.lit(step) + F.lit(lo))

    s = F.col(score).cast("double")
    if step > 0:
        est = F.floor((s - F.lit(lo)) / F.lit(step)) + 1
    else:
        est = F.when(s >= F.lit(lo), F.lit(n_steps)).otherwise(F.lit(0))
    d = (df.where(F.col(score).isNotNull())
           .select(s.alias("_s"), F.col(y).alias("_y"),
                   F.least(F.greatest(est, F.lit(0)), F.lit(n_steps)).cast("int").alias("_e")))
    d = d.withColumn("_u", F.when((F.col("_e") < n_steps) & (t(F.col("_e")) <= F.col("_s")),
                                  F.col("_e") + 1).otherwise(F.col("_e")))
    cnt = F.when((F.col("_u") > 0) & (t(F.col("_u") - 1) > F.col("_s")), F.col("_u") - 1).otherwise(F.col("_u"))
    b = d.select(cnt.alias("j"), "_y")
    per = b.groupBy("j").agg(F.count_if(F.col("_y") == 1).alias("pos"),
                             F.count_if(F.col("_y") != 1).alias("neg"))
    # ≤ n_steps+1 bucket rows, so windows over them are bounded
    grid = df.sparkSession.range(n_steps + 1).select(F.col("id").cast("int").alias("j"))
    full = grid.join(per, "j", "left").na.fill(0, ["pos", "neg"])
    w = Window.orderBy("j").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    cum = full.select("j", F.sum("pos").over(w).alias("cpos"), F.sum("neg").over(w).alias("cneg"),
                      F.sum("pos").over(Window.partitionBy()).alias("P"),
                      F.sum("neg").over(Window.partitionBy()).alias("N"))
    # threshold i is cleared by rows in buckets j > i
    out = cum.where(F.col("j") < n_steps).select(
        F.col("j").alias("i"), (F.col("P") - F.col("cpos")).alias("tp"),
        (F.col("N") - F.col("cneg")).alias("fp"), "P")
    tp, fp = F.col("tp"), F.col("fp")
    fn = F.col("P") - tp
    return out.select(F.col("i").alias("step"), t(F.col("i")).alias("threshold"),
                      tp.cast("bigint").alias("tp"), fp.cast("bigint").alias("fp"),
                      _safe_div(tp, tp + fp).alias("precision"), _safe_div(tp, tp + fn).alias("recall"),
                      _safe_div(2 * tp, 2 * tp + fp + fn).alias("f1"))


def best_threshold_by_f1(df: DataFrame, y: str, score: str, **kw) -> DataFrame:
    """The threshold with the highest F1; the lowest threshold wins
    ties (trap T31)."""
    c = f1_threshold_curve(df, y, score, **kw)
    best = c.agg(F.min_by(F.struct("threshold", "f1", "precision", "recall"),
                          F.struct(-F.col("f1"), F.col("step"))).alias("b"))
    return best.select("b.*")


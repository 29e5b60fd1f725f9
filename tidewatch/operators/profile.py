"""Exploratory statistics.

Numeric columns are processed together: a table is "melted" into
(column, value) rows inside the scan's codegen stage and aggregated per
column with map-side combine; quantiles are exact and distributed
(:mod:`tidewatch.plans.ordered`).  Two-pass statistics (z-scores, share
above a percentile, box-plot fences) join the per-column statistics back
— one row per column, so that side is bounded by the schema width.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.scalar import round_ratio
from ..plans.ordered import (exact_quantiles, exact_quantiles_wide, histogram_quantiles,
                             histogram_quantiles_wide, running_sum)


def melt(df: DataFrame, cols: Sequence[str], keep: Sequence[str] = ()) -> DataFrame:
    """(keep..., column_name, value double) with one row per (row, column)."""
    arr = F.array(*[F.struct(F.lit(c).alias("column_name"), F.col(f"`{c}`").cast("double").alias("value"))
                    for c in cols])
    return df.select(*keep, F.inline(arr))


def _skew_corrected(x: Column) -> Column:
    """Bias-corrected sample skewness G1 (pandas / DuckDB ``skewness``)."""
    n = F.count(x).cast("double")
    return F.when((n > 2) & (F.stddev_pop(x) > 0),
                  F.skewness(x) * F.sqrt(n * (n - 1)) / (n - 2))


def describe(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    """Count, mean, sample std, min, quartiles, max and
    bias-corrected skew per column (exact quartiles)."""
    m = melt(df, cols).where(F.col("value").isNotNull() & ~F.isnan("value"))
    mom = m.groupBy("column_name").agg(
        F.count("value").alias("count"), F.avg("value").alias("mean"),
        F.stddev_samp("value").alias("std"), F.min("value").alias("min"),
        F.max("value").alias("max"), _skew_corrected(F.col("value")).alias("skew"))
    q = histogram_quantiles_wide(m, "value", {"p25": .25, "p50": .5, "p75": .75}, "column_name")
    return mom.join(q, "column_name", "left").select(
        "column_name", "count", "mean", "std", "min", "p25", "p50", "p75", "max", "skew")


def skew_table(df: DataFrame, cols: Sequence[str], top: int = 30) -> DataFrame:
    """Columns ranked by |bias-corrected skew|, top 30."""
    m = melt(df, cols).where(F.col("value").isNotNull() & ~F.isnan("value"))
    s = m.groupBy("column_name").agg(_skew_corrected(F.col("value")).alias("skew"))
    return s.orderBy(F.desc_nulls_last(F.abs("skew")), "column_name").limit(top)


def percentile_summary(df: DataFrame, cols: Sequence[str],
                       probs: dict[str, float] | None = None) -> DataFrame:
    """Chosen percentiles per column (default p50/p90/p95/p99)."""
    probs = probs or {"p50": .5, "p90": .9, "p95": .95, "p99": .99}
    return histogram_quantiles_wide(melt(df, cols), "value", probs, "column_name")


def outlier_share(df: DataFrame, cols: Sequence[str], p: float = 0.99) -> DataFrame:
    """Percent of rows above the column's p-quantile (2 dp)."""
    m = melt(df, cols)
    q = histogram_quantiles(m, "value", [p], "column_name").select("column_name", F.col("q").alias("thr"))
    j = m.join(q, "column_name")   # one row per column: broadcast by size
    g = j.groupBy("column_name").agg(F.count_if(F.col("value") > F.col("thr")).alias("n_above"),
                                F.count(F.lit(1)).alias("n"), F.first("thr").alias("threshold"))
    return g.select("column_name", "threshold", "n_above",
                    round_ratio("n_above", "n", 2, scale=100).alias("pct_above"))


def keep_below_quantile(df: DataFrame, col: str, p: float = 0.99) -> DataFrame:
    """Rows whose value is ≤ the column's p-quantile (scalar
    sub-query, no join)."""
    q = exact_quantiles(df, col, [p]).agg(F.first("q")).scalar()
    return df.where(F.col(col) <= q)


def finite_above(df: DataFrame, col: str, lower: float = -1.0) -> DataFrame:
    """C11: finite values strictly greater than ``lower`` (log1p domain)."""
    x = F.col(col)
    return df.where(x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))) & (x > lower))


def pairwise_corr(df: DataFrame, pairs: Sequence[tuple[str, str]], chunk: int = 90) -> dict:
    """Pearson correlation of many column pairs from mean-centred
    co-moment sums (two passes of plain sums, codegen-friendly).

    Pass 1 gets counts and means; pass 2 sums centred products.  Without
    nulls the per-column sums are shared; with nulls each pair is summed
    over its pair-wise complete rows (shift-invariant formula, so the
    global means remain valid shifts).  A constant side gives None
    (trap T9).  Aggregates are chunked to stay within codegen limits; the
    driver only receives O(pairs) scalars.
    """
    cols = sorted({c for p in pairs for c in p})
    x = {c: F.col(f"`{c}`").cast("double") for c in cols}
    pre = df.agg(F.count(F.lit(1)).alias("_n"),
                 *[F.count(x[c]).alias(f"n{i}") for i, c in enumerate(cols)],
                 *[F.avg(x[c]).alias(f"m{i}") for i, c in enumerate(cols)]).first()
    n = pre["_n"]
    mu = {c: (pre[f"m{i}"] or 0.0) for i, c in enumerate(cols)}
    has_null = any(pre[f"n{i}"] != n for i in range(len(cols)))
    d = {c: x[c] - F.lit(mu[c]) for c in cols}

    def run(exprs: list) -> dict:
        out = {}
        for i in range(0, len(exprs), chunk):
            part = exprs[i:i + chunk]
            out.update(df.agg(*part).first().asDict())
        return out

    res = {}
    if not has_null:
        exprs = [F.sum(d[c] * d[c]).alias(f"ss_{i}") for i, c in enumerate(cols)]
        exprs += [F.sum(d[a] * d[b]).alias(f"sp_{k}") for k, (a, b) in enumerate(pairs)]
        v = run(exprs)
        ss = {c: v[f"ss_{i}"] for i, c in enumerate(cols)}
        for k, (a, b) in enumerate(pairs):
            den = (ss[a] or 0.0) * (ss[b] or 0.0)
            res[(a, b)] = v[f"sp_{k}"] / den ** 0.5 if den > 0 else None
        return res
    exprs = []
    for k, (a, b) in enumerate(pairs):
        both = x[a].isNotNull() & x[b].isNotNull()
        da, db = F.when(both, d[a]), F.when(both, d[b])
        exprs += [F.count_if(both).alias(f"n_{k}"), F.sum(da).alias(f"sa_{k}"), F.sum(db).alias(f"sb_{k}"),
                  F.sum(da * da).alias(f"saa_{k}"), F.sum(db * db).alias(f"sbb_{k}"),
                  F.sum(da * db).alias(f"sab_{k}")]
    v = run(exprs)
    for k, (a, b) in enumerate(pairs):
        m = v[f"n_{k}"]
        if not m:
            res[(a, b)] = None
            continue
        sa, sb = v[f"sa_{k}"], v[f"sb_{k}"]
        caa = v[f"saa_{k}"] - sa * sa / m
        cbb = v[f"sbb_{k}"] - sb * sb / m
        cab = v[f"sab_{k}"] - sa * sb / m
        res[(a, b)] = cab / (caa * cbb) ** 0.5 if caa > 0 and cbb > 0 else None
    return res


def leakage_scan(df: DataFrame, target: str, threshold: float = 0.95,
                 top: int | None = None, coerce: bool = False) -> DataFrame:
    """|corr| of every numeric column with the target, 4 decimals; the
    flag compares the unrounded value; NULL (constant) sorts last.

    A text target is replaced by its category codes (position among the
    sorted values, -1 for NULL); with ``coerce`` it is read as numbers
    instead, unreadable values being NULL."""
    from .quality import category_codes, numeric_columns
    cols = numeric_columns(df, exclude=[target])
    d, by = df, target
    if coerce:
        d = df.withColumn(target, F.col(f"`{target}`").try_cast("double"))
    elif df.schema[target].dataType.typeName() == "string":
        d, by = category_codes(df, target), f"{target}_code"
    r = pairwise_corr(d, [(c, by) for c in cols])
    rows = [(c, None if r[(c, by)] is None else abs(r[(c, by)])) for c in cols]
    out = df.sparkSession.createDataFrame(rows, "column_name string, abs_corr double").select(
        "column_name", F.round("abs_corr", 4).alias("abs_corr"),
        F.coalesce(F.col("abs_corr") > threshold, F.lit(False)).alias("leak_flag"))
    out = out.orderBy(F.desc_nulls_last("abs_corr"), "column_name")
    return out.limit(top) if top else out


def corr_matrix(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    """Full Pearson matrix in long form (col_a, col_b, corr), each
    unordered pair computed once."""
    pairs = [(a, b) for i, a in enumerate(cols) for b in cols[i:]]
    r = pairwise_corr(df, pairs)
    rows = []
    for a, b in pairs:
        rows.append((a, b, r[(a, b)]))
        if a != b:
            rows.append((b, a, r[(a, b)]))
    return df.sparkSession.createDataFrame(rows, "col_a string, col_b string, corr double")


def strong_pairs(df: DataFrame, cols: Sequence[str], threshold: float = 0.6, top: int = 10) -> DataFrame:
    """Off-diagonal pairs with |corr| > threshold, both orientations
    kept (trap T29), top 10 by |corr|."""
    m = corr_matrix(df, cols)
    return (m.where((F.col("col_a") != F.col("col_b")) & (F.abs("corr") > threshold))
            .orderBy(F.desc(F.abs("corr")), "col_a", "col_b").limit(top))


def extreme_z_rate(df: DataFrame, cols: Sequence[str], z: float = 4.0) -> DataFrame:
    """Share of rows with |x − mean| / population std > z per column
    (nulls ignored, trap T30)."""
    m = melt(df, cols).where(F.col("value").isNotNull())
    st = m.groupBy("column_name").agg(F.avg("value").alias("mu"), F.stddev_pop("value").alias("sd"))
    j = m.join(st, "column_name")
    zz = F.abs(F.col("value") - F.col("mu")) / F.col("sd")
    return j.groupBy("column_name").agg(
        F.avg(F.when(F.col("sd") > 0, (zz > z).cast("double")).otherwise(F.lit(0.0))).alias("extreme_rate"))


def event_rarity(df: DataFrame, col: str) -> DataFrame:
    """Frequency of each value and rarity = 1 / frequency.  The total
    is a scalar sub-query over the grouped rows (no global window)."""
    g = df.groupBy(col).agg(F.count(F.lit(1)).alias("count"))
    total = g.agg(F.sum("count")).scalar()
    freq = F.col("count") / total
    return g.select(col, "count", freq.alias("frequency"), (F.lit(1.0) / freq).alias("rarity"))


def ks_pvalue(d: Column, n1: Column, n2: Column, terms: int = 100) -> Column:
    """Asymptotic two-sided KS p-value: Kolmogorov survival function
    Q(z) = 2 Σ (−1)^(k−1) exp(−2k²z²), z = d·sqrt(n1·n2/(n1+n2))."""
    zz = d * F.sqrt(n1 * n2 / (n1 + n2))
    series = F.aggregate(F.sequence(F.lit(1), F.lit(terms)), F.lit(0.0),
                         lambda acc, k: acc + F.pow(F.lit(-1.0), k - 1) * F.exp(F.lit(-2.0) * k * k * zz * zz))
    return F.when(zz < 0.2, F.lit(1.0)).otherwise(F.least(F.lit(1.0), F.greatest(F.lit(0.0), 2 * series)))


def ks_two_sample(a: DataFrame, b: DataFrame, cols: Sequence[str], top: int = 10,
                  max_cols: int | None = None) -> DataFrame:
    """Two-sample Kolmogorov–Smirnov statistic per column.

    Both samples are tagged and counted per (column, value); running
    counts over the distinct values (blocked prefix sums) give both ECDFs
    at every jump point; the statistic is the max gap.  ``max_cols`` keeps
    the first so many columns (default: all).
    """
    cols = list(cols)[:max_cols]
    ta = melt(a, cols).where(F.col("value").isNotNull() & ~F.isnan("value")).select(
        "column_name", "value", F.lit(1).alias("ia"), F.lit(0).alias("ib"))
    tb = melt(b, cols).where(F.col("value").isNotNull() & ~F.isnan("value")).select(
        "column_name", "value", F.lit(0).alias("ia"), F.lit(1).alias("ib"))
    c = ta.unionByName(tb).groupBy("column_name", "value").agg(F.sum("ia").alias("na"), F.sum("ib").alias("nb"))
    r = running_sum(c, "value", ["na", "nb"], ["column_name"])
    gap = F.abs(F.col("cum_na") / F.col("tot_na") - F.col("cum_nb") / F.col("tot_nb"))
    s = r.groupBy("column_name").agg(F.max(gap).alias("ks_stat"), F.first("tot_na").alias("n_a"),
                                F.first("tot_nb").alias("n_b"))
    s = s.select("column_name", "ks_stat", "n_a", "n_b",
                 ks_pvalue(F.col("ks_stat"), F.col("n_a").cast("double"),
                           F.col("n_b").cast("double")).alias("p_value"))
    return s.orderBy(F.desc("ks_stat"), "column_name").limit(top)


def crosstab_pct(df: DataFrame, cat: str, target: str) -> DataFrame:
    """Cross-tab normalised by target column, ×100, 2 dp (long form)."""
    g = df.groupBy(cat, target).agg(F.count(F.lit(1)).alias("n"))
    tot = df.groupBy(target).agg(F.count(F.lit(1)).alias("col_total"))
    j = g.join(tot, target)
    return j.select(cat, target, "n", round_ratio("n", "col_total", 2, scale=100).alias("pct"))


def score_by_class(df: DataFrame, score: str, cls: str) -> DataFrame:
    """Per-class mean / sample std / min / max of a score."""
    return df.groupBy(cls).agg(F.count(score).alias("n"), F.avg(score).alias("mean"),
                               F.stddev_samp(score).alias("std"), F.min(score).alias("min"),
                               F.max(score).alias("max"))


def boxplot_stats(df: DataFrame, value: str, cls: str) -> DataFrame:
    """Quartiles, IQR and 1.5·IQR whiskers per class (whisker = most
    extreme value inside the fence), with class rank by frequency."""
    q = exact_quantiles_wide(df, value, {"q1": .25, "median": .5, "q3": .75}, [cls])
    q = q.withColumn("iqr", F.col("q3") - F.col("q1"))
    j = df.select(cls, F.col(value).cast("double").alias("_x")).where(F.col("_x").isNotNull()) \
          .join(q, cls)
    lo_f = F.col("q1") - 1.5 * F.col("iqr")
    hi_f = F.col("q3") + 1.5 * F.col("iqr")
    w = j.groupBy(cls).agg(
        F.count(F.lit(1)).alias("n"),
        F.min(F.when(F.col("_x") >= lo_f, F.col("_x"))).alias("whisker_lo"),
        F.max(F.when(F.col("_x") <= hi_f, F.col("_x"))).alias("whisker_hi"),
        F.count_if((F.col("_x") < lo_f) | (F.col("_x") > hi_f)).alias("n_outside"))
    return q.join(w, cls).select(cls, "n", "q1", "median", "q3", "iqr", "whisker_lo", "whisker_hi",
                                 "n_outside")


def histogram(df: DataFrame, col: str, bins: int = 40, log1p: bool = False,
              group: str | None = None) -> DataFrame:
    """Equal-width histogram between min and max (top edge folded into
    the last bin, numpy convention); empty bins included.  ``log1p``
    applies C11 + H11 first; ``group`` gives per-class histograms on the
    shared edges."""
    x = F.col(col).cast("double")
    d = df.select(*( [group] if group else []), x.alias("_x"))
    if log1p:
        d = finite_above(d, "_x").select(*([group] if group else []), F.log1p("_x").alias("_x"))
    d = d.where(F.col("_x").isNotNull() & ~F.isnan("_x"))
    lo = d.agg(F.min("_x")).scalar()
    hi = d.agg(F.max("_x")).scalar()
    width = (hi - lo) / F.lit(float(bins))
    idx = F.when(hi == lo, F.lit(0)).otherwise(
        F.least(F.floor((F.col("_x") - lo) / width), F.lit(bins - 1))).cast("int")
    keys = [group] if group else []
    counts = d.groupBy(*keys, idx.alias("bin")).agg(F.count(F.lit(1)).alias("count"))
    if group:
        # every (class, bin) cell: generated per distinct class, no join
        grid = d.select(group).distinct().select(
            group, F.explode(F.sequence(F.lit(0), F.lit(bins - 1))).alias("bin"))
    else:
        grid = df.sparkSession.range(bins).select(F.col("id").cast("int").alias("bin"))
    full = grid.join(counts, keys + ["bin"], "left")
    edge_lo = lo + F.col("bin") * width
    edge_hi = F.when(F.col("bin") == bins - 1, hi).otherwise(lo + (F.col("bin") + 1) * width)
    return full.select(*keys, "bin", edge_lo.alias("bin_lo"), edge_hi.alias("bin_hi"),
                       F.coalesce(F.col("count"), F.lit(0)).cast("bigint").alias("count"))


def centroid_distance(df: DataFrame, cols: Sequence[str], probs=(0.5, 0.9, 0.95, 0.99)) -> DataFrame:
    """Distance of each row from the global centroid in
    population-standardised space, summarised by percentiles."""
    st = df.agg(*[F.avg(c).alias(f"m{i}") for i, c in enumerate(cols)],
                *[F.stddev_pop(c).alias(f"s{i}") for i, c in enumerate(cols)])
    row = st.first()  # 2·d scalars: the centroid and scales
    terms = []
    for i, c in enumerate(cols):
        s = row[f"s{i}"] or 1.0
        s = s if s > 0 else 1.0
        terms.append(F.pow((F.col(c) - F.lit(row[f"m{i}"])) / F.lit(s), 2))
    dist = F.sqrt(sum(terms[1:], terms[0]))
    d = df.select(dist.alias("dist"))
    return exact_quantiles(d, "dist", list(probs))


"""Order-dependent computations without funnelling data into one task.

A window without ``partitionBy`` (or partitioned by a hot key) sends a
whole table / group to a single task.  Running sums, ranks and exact
quantiles are therefore computed as a *blocked prefix sum*:

1. rows are range-partitioned on ``(group, order)`` into B blocks
   (``repartitionByRange`` samples the keys, so a group holding a third
   of all rows is split over many blocks);
2. the blocked rows are checkpointed: both branches below read the same
   block bounds, whatever the optimiser does with the range exchange;
3. per-block totals are aggregated (map-side combine, tiny output);
4. block offsets are a window over at most B rows per group;
5. local running sums are a window over one block;
6. offset + local gives the global running sum.

Callers pre-aggregate to distinct order keys first whenever ties matter,
so a heavily repeated value collapses into one row before any shuffle.
"""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark import StorageLevel
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import ensure_checkpoint_dir

_UNB = Window.unboundedPreceding


def _blocks(df: DataFrame) -> int:
    spark = df.sparkSession
    return max(1, int(spark.conf.get("spark.sql.shuffle.partitions", "200")))


def range_blocks(df: DataFrame, order: Sequence[str], blocks: int | None = None) -> DataFrame:
    """Rows with ``_blk``, a block id that is monotone in ``order``.

    Range partitioning samples its bounds each time it runs, so the result
    is checkpointed once; every later read sees the same blocks."""
    ensure_checkpoint_dir(df.sparkSession)
    return (df.repartitionByRange(blocks or _blocks(df), *[F.col(c) for c in order])
            .withColumn("_blk", F.spark_partition_id()).checkpoint())


def with_row_id(df: DataFrame, name: str = "_rid") -> DataFrame:
    """Rows with a stored unique id.

    Sampling by a hash of the content takes all copies of a row or none;
    hashing this id instead treats copies as rows of their own.  The ids
    are checkpointed, so a recomputed task sees the same ones."""
    ensure_checkpoint_dir(df.sparkSession)
    return df.withColumn(name, F.monotonically_increasing_id()).checkpoint()


def spread(df: DataFrame, rows_least: int = 1 << 16, rows_most: int = 1 << 20) -> tuple[DataFrame, int]:
    """(``df`` persisted, its rows).  Input that comes in fewer partitions than there are cores, as files of one row group
    do, is dealt out evenly, but to partitions of no fewer than ``rows_least`` rows; small frames stay as they are."""
    df = df.persist(StorageLevel.MEMORY_AND_DISK)
    rows, parts = df.count(), df.rdd.getNumPartitions()
    want = max(df.sparkSession.sparkContext.defaultParallelism, -(-rows // rows_most))
    if parts >= want or rows <= parts * rows_least:
        return df, rows
    even = df.repartition(min(want, -(-rows // rows_least))).persist(StorageLevel.MEMORY_AND_DISK)
    even.count()
    df.unpersist()
    return even, rows


def running_sum(df: DataFrame, order: str | Sequence[str], sum_cols: Sequence[str],
                group_cols: Sequence[str] = (), blocks: int | None = None,
                block_col: Column | None = None) -> DataFrame:
    """Add ``cum_<c>`` (inclusive running sum in ``order`` within
    ``group_cols``) and ``tot_<c>`` (group total) for every ``c``.

    ``order`` must be unique within a group (aggregate ties first) for
    the running sum to be well defined.  ``block_col`` may supply a block
    id that is monotone in ``order`` (e.g. the top bits of a uniform
    hash); otherwise the blocks come from range partitioning.
    """
    order = [order] if isinstance(order, str) else list(order)
    g = list(group_cols)
    if block_col is None:
        blk = range_blocks(df, g + order, blocks)
    else:
        blk = df.withColumn("_blk", block_col)

    totals = blk.groupBy(*g, "_blk").agg(*[F.sum(c).alias(f"_bt_{c}") for c in sum_cols])
    wo = Window.partitionBy(*g).orderBy("_blk")
    wg = Window.partitionBy(*g)
    offsets = totals.select(
        *g, "_blk",
        *[F.coalesce(F.sum(f"_bt_{c}").over(wo.rowsBetween(_UNB, -1)), F.lit(0)).alias(f"_off_{c}")
          for c in sum_cols],
        *[F.sum(f"_bt_{c}").over(wg).alias(f"tot_{c}") for c in sum_cols])

    wl = Window.partitionBy(*g, "_blk").orderBy(*order).rowsBetween(_UNB, Window.currentRow)
    local = blk.select("*", *[F.sum(c).over(wl).alias(f"_loc_{c}") for c in sum_cols])
    # null-safe on the group: NULL is a group of its own
    keys = offsets.select(*[F.col(c).alias(f"_g_{i}") for i, c in enumerate(g)], F.col("_blk").alias("_b"),
                          *[F.col(c) for c in offsets.columns if c not in g and c != "_blk"])
    on = F.col("_blk") == F.col("_b")
    for i, c in enumerate(g):
        on = on & F.col(c).eqNullSafe(F.col(f"_g_{i}"))
    out = local.join(keys, on)
    return out.select(
        *[F.col(c) for c in df.columns],
        *[(F.col(f"_loc_{c}") + F.col(f"_off_{c}")).alias(f"cum_{c}") for c in sum_cols],
        *[F.col(f"tot_{c}") for c in sum_cols])


def exact_quantiles(df: DataFrame, value: str, probs: Sequence[float],
                    group_cols: Sequence[str] = (), prob_col: str = "p",
                    out_col: str = "q") -> DataFrame:
    """Exact linearly interpolated quantiles (numpy / ``quantile_cont``).

    Nulls and NaN are ignored.  Returns one row per (group, p).  Work is
    O(distinct values): values are first counted, then located by a
    blocked running count; no group is gathered into one task.
    """
    g = list(group_cols)
    v = F.col(value)
    cond = v.isNotNull()
    if dict(df.dtypes)[value] in ("double", "float"):
        cond = cond & ~F.isnan(v)
    counts = df.where(cond).groupBy(*g, v.cast("double").alias("_v")).agg(F.count(F.lit(1)).alias("_n"))
    r = running_sum(counts, "_v", ["_n"], g)
    start = F.col("cum__n") - F.col("_n")
    end = F.col("cum__n")
    n_1 = (F.col("tot__n") - 1).cast("double")
    parr = F.array(*[F.lit(float(p)) for p in probs])

    def hit(p: Column) -> Column:
        pos = p * n_1
        lo, hi = F.floor(pos), F.ceil(pos)
        return ((start <= lo) & (lo < end)) | ((start <= hi) & (hi < end))

    e = r.select(*g, "_v", "tot__n", start.alias("_s"), end.alias("_e"),
                 F.explode(F.filter(parr, hit)).alias(prob_col))
    pos = F.col(prob_col) * (F.col("tot__n") - 1).cast("double")
    lo, hi = F.floor(pos), F.ceil(pos)
    agg = e.groupBy(*g, prob_col).agg(
        F.max(F.when((F.col("_s") <= lo) & (lo < F.col("_e")), F.col("_v"))).alias("_lo"),
        F.max(F.when((F.col("_s") <= hi) & (hi < F.col("_e")), F.col("_v"))).alias("_hi"),
        F.first(pos).alias("_pos"))
    frac = F.col("_pos") - F.floor(F.col("_pos"))
    return agg.select(*g, prob_col,
                      (F.col("_lo") + (F.col("_hi") - F.col("_lo")) * frac).alias(out_col))


def histogram_quantiles(df: DataFrame, value: str, probs: Sequence[float], group_col: str, prob_col: str = "p",
                        out_col: str = "q", bins: int = 1024, scans: int = 4, few: int = 4096) -> DataFrame:
    """:func:`exact_quantiles` for few groups (columns of a table) over many rows, without a shuffle of the rows.

    Each scan counts the values of the stretches that hold a wanted rank into ``bins`` bins, map-side, and keeps of every bin
    its count, least and largest value; the bins that hold the ranks are the next scan's stretches.  A stretch of one
    value is done.  A stretch of at most ``few`` values, or left after ``scans`` scans, or without a finite width, is
    fetched: only its values are shuffled, counted and located by a blocked running count.  The driver gets at most
    ``bins`` rows a stretch, and there are at most 2 · |probs| stretches a group.
    """
    spark, v = df.sparkSession, F.col(value).cast("double")
    rows = df.where(v.isNotNull() & ~F.isnan(v)).select(F.col(group_col).alias("_g"), v.alias("_v"))
    open_, found, size = [], {}, {}
    for r in rows.groupBy("_g").agg(F.count(F.lit(1)).alias("n"), F.min("_v").alias("lo"), F.max("_v").alias("hi")).collect():
        size[r["_g"]] = r["n"]
        wanted = sorted({k for p in probs for k in (math.floor(p * (r["n"] - 1)), math.ceil(p * (r["n"] - 1)))})
        open_.append((r["_g"], r["lo"], r["hi"], 0, r["n"], wanted))
    kind = df.schema[group_col].dataType.simpleString()

    def inside(stretches: list[tuple]) -> DataFrame:
        table = spark.createDataFrame([(g, i, lo, hi, before, wanted) for i, (g, lo, hi, before, _, wanted) in enumerate(stretches)],
                                      f"_g {kind}, _id int, _lo double, _hi double, _before long, _wanted array<long>")
        return (rows.join(F.broadcast(table), rows["_g"].eqNullSafe(table["_g"]))
                .where((F.col("_v") >= F.col("_lo")) & (F.col("_v") <= F.col("_hi"))).drop("_g"))

    fetch = []
    for scan in range(scans + 1):
        split = []
        for s in open_:
            g, lo, hi, _, n, wanted = s
            if lo == hi:
                found.update({(g, k): lo for k in wanted})
            else:
                (fetch if n <= few or scan == scans or not math.isfinite(hi - lo) else split).append(s)
        if not split:
            break
        at = F.least(F.floor((F.col("_v") - F.col("_lo")) / (F.col("_hi") - F.col("_lo")) * bins), F.lit(bins - 1))
        counted = inside(split).groupBy("_id", at.alias("_bin")).agg(
            F.count(F.lit(1)).alias("n"), F.min("_v").alias("lo"), F.max("_v").alias("hi")).collect()
        open_, before = [], {}
        for r in sorted(counted, key=lambda r: (r["_id"], r["_bin"])):
            g, _, _, start, _, wanted = split[r["_id"]]
            first = before.get(r["_id"], start)
            before[r["_id"]] = first + r["n"]
            held = [k for k in wanted if first <= k < first + r["n"]]
            if held:
                open_.append((g, r["lo"], r["hi"], first, r["n"], held))
    small, fetch = [s for s in fetch if s[4] <= few], [s for s in fetch if s[4] > few]
    if small:  # at most ``few`` values a stretch
        first = {}
        counts = inside(small).groupBy("_id", "_v").agg(F.count(F.lit(1)).alias("n")).collect()
        for r in sorted(counts, key=lambda r: (r["_id"], r["_v"])):
            g, _, _, start, _, wanted = small[r["_id"]]
            lo = first.get(r["_id"], start)
            first[r["_id"]] = lo + r["n"]
            found.update({(g, k): r["_v"] for k in wanted if lo <= k < lo + r["n"]})
    if fetch:
        counts = inside(fetch).groupBy("_id", "_before", "_wanted", "_v").agg(F.count(F.lit(1)).alias("_n"))
        run = running_sum(counts, "_v", ["_n"], ["_id", "_before", "_wanted"])
        end = F.col("_before") + F.col("cum__n")
        hit = F.filter("_wanted", lambda k: (k >= end - F.col("_n")) & (k < end))
        for r in run.select("_id", "_v", F.explode(hit).alias("k")).collect():  # a row per wanted rank
            found[fetch[r["_id"]][0], r["k"]] = r["_v"]
    out = []
    for g, n in size.items():
        for p in probs:
            at = p * (n - 1)
            lo, hi = found[g, math.floor(at)], found[g, math.ceil(at)]
            out.append((g, float(p), lo + (hi - lo) * (at - math.floor(at)) if hi != lo else lo))
    return spark.createDataFrame(out, f"{group_col} {kind}, {prob_col} double, {out_col} double")


def histogram_quantiles_wide(df: DataFrame, value: str, probs: dict[str, float], group_col: str) -> DataFrame:
    """:func:`histogram_quantiles` as columns: ``probs`` maps output name → probability."""
    long = histogram_quantiles(df, value, list(dict.fromkeys(probs.values())), group_col)
    return long.groupBy(group_col).agg(*[F.max(F.when(F.col("p") == F.lit(float(p)), F.col("q"))).alias(name) for name, p in probs.items()])


def exact_quantiles_wide(df: DataFrame, value: str, probs: dict[str, float],
                         group_cols: Sequence[str] = ()) -> DataFrame:
    """Quantiles as columns: ``probs`` maps output name → probability."""
    long = exact_quantiles(df, value, list(probs.values()), group_cols)
    g = list(group_cols)
    return long.groupBy(*g).agg(*[
        F.max(F.when(F.col("p") == F.lit(float(p)), F.col("q"))).alias(name)
        for name, p in probs.items()])


def hash_rank(df: DataFrame, key: Column, group_cols: Sequence[str] = (),
              seed: int = 42, blocks: int | None = None) -> DataFrame:
    """Add ``_h`` (seeded 64-bit hash of ``key``) and ``_rank`` (1-based
    position of the row in ``_h`` order within its group).

    Blocks are the top bits of the hash, which is uniform, so the blocks
    are balanced without sampling and a hot group spans all of them.
    """
    b = blocks or _blocks(df)
    d = df.withColumn("_h", F.xxhash64(key, F.lit(seed))).withColumn("_one", F.lit(1))
    # the signed hash mapped monotonically onto [0, b)
    unit = (F.col("_h").cast("double") + F.lit(2.0 ** 63)) / F.lit(2.0 ** 64)
    blk = F.least(F.greatest(F.floor(unit * F.lit(b)), F.lit(0)), F.lit(b - 1)).cast("int")
    r = running_sum(d, ["_h"], ["_one"], group_cols, blocks=b, block_col=blk)
    return (r.withColumnRenamed("cum__one", "_rank").withColumnRenamed("tot__one", "_group_n")
             .drop("_one"))

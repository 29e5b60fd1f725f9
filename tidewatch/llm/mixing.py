"""Mixing sources to target weights by Efraimidis-Spirakis sampling, DataFrame functions only.

Each source gets a target number of words from its weight, at most ``cap`` times its size.  Whole
epochs of a source come first; what is left of the target is filled in the order of the keys
-ln(u) / w, where u is a hash of the document's id and w its quality weight: a weighted sample without
replacement.  The last document taken may be taken in part.

The prefix sums within a source never sort a source in one task.  Documents are range-partitioned by source and
key, by the keys as they are, into ranges of about ``RANGE_ROWS`` documents; ranges are summed with partial aggregates, offsets
come from the sums, and rows are sorted inside one range only.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import materialise, prepare

WORD = r"[^\x20\x09-\x0D]+"
NOT_PLAIN = r"[^a-z\x{80}-\x{10FFFF}\x20\x0A]"
RANGE_ROWS = 1 << 16
SEED = "mix-1"


def quality_weight(text: str | Column) -> Column:
    """Share of small letters, non-ASCII characters, spaces and line ends in the text, 0.05 at least (empty: 0.05)."""
    t = F.coalesce(F.col(text) if isinstance(text, str) else text, F.lit(""))
    return F.greatest(F.lit(0.05), F.length(F.regexp_replace(t, NOT_PLAIN, "")) / F.greatest(F.length(t), F.lit(1)))


def source_targets(per: DataFrame, weights: tuple[int, ...], share: tuple[int, int], cap: int) -> DataFrame:
    """Adds ``target`` to one row per source (``source``, ``source_size``): share of all sizes by weight, at most cap times the
    source's size, the excess reshared.  In the order of cap / weight, a source is held at its cap if the rest, spread
    over the sources from it on, reaches it; one pass over the few rows of the source table."""
    num, den = share
    by_name = Window.orderBy(F.col("source").asc_nulls_last())
    turn = (F.row_number().over(by_name) - 1) % len(weights)
    per = per.withColumn("w", F.element_at(F.array(*map(F.lit, weights)), turn + 1).cast("long"))
    per = per.withColumn("limit", cap * F.col("source_size"))
    before = Window.orderBy(F.col("limit") / F.col("w"), F.col("source").asc_nulls_last()).rowsBetween(Window.unboundedPreceding, -1)
    total = Window.partitionBy(F.lit(0))
    all_w, all_size = F.sum("w").over(total), F.sum("source_size").over(total)
    used = F.coalesce(F.sum("limit").over(before), F.lit(0))
    used_w = F.coalesce(F.sum("w").over(before), F.lit(0))
    per = per.withColumn("held", F.col("limit") * den * (all_w - used_w) <= F.col("w") * (num * all_size - den * used))
    rest = num * all_size - den * F.sum(F.when(F.col("held"), F.col("limit")).otherwise(0)).over(total)
    rest_w = den * F.sum(F.when(F.col("held"), 0).otherwise(F.col("w"))).over(total)
    target = F.when(F.col("held"), F.col("limit").cast("double")).otherwise((F.col("w") * rest).cast("double") / rest_w)
    return per.withColumn("target", target).select("source", "source_size", "target")


def in_ranges(base: DataFrame, range_rows: int) -> DataFrame:
    """The stored rows with ``range``, a number that grows with (source, key, id, tie), over about ``range_rows`` rows each.  A place in
    the stored table ends the order, so that copies of one row are cut too.  Range bounds are sampled, so the result is stored."""
    ranges = max(1, -(-base.count() // range_rows))
    order = [F.col("source").asc_nulls_last(), "key", "id", "tie", "place"]
    return materialise(base.withColumn("place", F.monotonically_increasing_id()).repartitionByRange(ranges, *order)
                       .withColumn("range", F.spark_partition_id()), "ranges")


def mix_sources(spark: SparkSession, docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source",
                weights: tuple[int, ...] = (5, 2, 1), share: tuple[int, int] = (3, 2), cap: int = 2, quality: Column | None = None,
                range_rows: int = RANGE_ROWS) -> DataFrame:
    """One row per row of ``docs``: id, source, size (words of the text, null: 0), source_size, target (of its source), taken
    (words the mix takes, repeats counted; cap times the size at most).

    Sources in code point order, null last as a source of its own, weigh ``weights`` in turn.  Documents of equal id are ordered by
    a hash of the text, so reruns agree and repeated rows take what any one of them in that place would.  Empty texts take
    nothing.  An empty table gives an empty result; other columns are ignored.
    """
    prepare(spark)
    text = F.coalesce(F.col(text_col), F.lit(""))
    weight = quality_weight(text_col) if quality is None else quality
    hexed = F.md5(F.concat(F.lit(SEED), F.coalesce(F.col(id_col).cast("string"), F.lit(""))).cast("binary"))
    u = (F.conv(F.substring(hexed, 1, 12), 16, 10).cast("long") + 1) / F.lit(float((1 << 48) + 1))
    base = materialise(docs.select(
        F.col(id_col).alias("id"), F.col(source_col).alias("source"), F.regexp_count(text, F.lit(WORD)).cast("long").alias("size"),
        weight.alias("weight"), u.alias("u"), F.md5(text.cast("binary")).alias("tie"))
        .select("id", "source", "size", "weight", (-F.log("u") / F.col("weight")).alias("key"), "tie"), "mix")
    per = materialise(source_targets(base.groupBy("source").agg(F.sum("size").alias("source_size")), weights, share, cap), "targets")
    rows = in_ranges(base, range_rows)
    rows = rows.join(per.withColumnRenamed("source", "of"), rows["source"].eqNullSafe(F.col("of"))).drop("of")
    order = Window.partitionBy("source").orderBy("range").rowsBetween(Window.unboundedPreceding, -1)
    sums = rows.groupBy("source", "range").agg(F.sum("size").alias("in_range"))
    sums = sums.withColumn("offset", F.coalesce(F.sum("in_range").over(order), F.lit(0))).select(
        F.col("source").alias("s"), F.col("range").alias("r"), "offset")
    inside = Window.partitionBy("source", "range").orderBy("key", "id", "tie", "place").rowsBetween(Window.unboundedPreceding, -1)
    rows = rows.withColumn("before", F.coalesce(F.sum("size").over(inside), F.lit(0)))
    rows = rows.join(sums, rows["source"].eqNullSafe(F.col("s")) & (F.col("range") == F.col("r")))
    epochs = F.coalesce(F.floor(F.col("target") / F.nullif(F.col("source_size"), F.lit(0))), F.lit(0))
    left = F.floor(F.col("target") - epochs * F.col("source_size"))
    taken = epochs * F.col("size") + F.greatest(F.lit(0), F.least(F.col("size"), left - F.col("before") - F.col("offset")))
    return rows.select(F.col("id").alias(id_col), F.col("source").alias(source_col), "size", "source_size", "target",
                       taken.cast("long").alias("taken"))


SQL = r"""
WITH base AS (
  SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+'))::BIGINT AS size, md5(coalesce(text, '')) AS tie,
    -ln((('0x' || substr(md5('mix-1' || coalesce(doc_id::VARCHAR, '')), 1, 12))::BIGINT + 1) / 281474976710657.0::DOUBLE)
      / greatest(0.05::DOUBLE, length(regexp_replace(coalesce(text, ''), '[^a-z\x{80}-\x{10FFFF}\x20\x0A]', '', 'g'))::DOUBLE
                 / greatest(length(coalesce(text, '')), 1)) AS key
  FROM documents),
per AS (
  SELECT source, sum(size)::BIGINT AS s, [5, 2, 1][1 + (row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3] AS w
  FROM base GROUP BY source),
tot AS (SELECT sum(s) AS s, sum(w) AS w FROM per),
ord AS (
  SELECT per.*, tot.s AS ts, tot.w AS tw, coalesce(sum(2 * per.s) OVER o, 0) AS used, coalesce(sum(per.w) OVER o, 0) AS used_w
  FROM per, tot
  WINDOW o AS (ORDER BY 2 * per.s / per.w::DOUBLE, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
held AS (SELECT *, 2 * s * 2 * (tw - used_w) <= w * (3 * ts - 2 * used) AS held FROM ord),
target AS (
  SELECT source, s, CASE WHEN held THEN (2 * s)::DOUBLE ELSE
    (w * (3 * ts - 2 * sum(CASE WHEN held THEN 2 * s ELSE 0 END) OVER ()))::DOUBLE
      / (2 * sum(CASE WHEN held THEN 0 ELSE w END) OVER ())::DOUBLE END AS target
  FROM held),
run AS (
  SELECT base.*, t.s AS source_size, t.target, floor(t.target / nullif(t.s, 0)) AS epochs,
    coalesce(sum(size) OVER (PARTITION BY base.source ORDER BY key, doc_id, tie ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before
  FROM base JOIN target t ON base.source IS NOT DISTINCT FROM t.source)
SELECT doc_id, size, source_size, target,
  (coalesce(epochs, 0) * size + greatest(0, least(size, floor(target - coalesce(epochs, 0) * source_size) - before)))::BIGINT AS taken
FROM run
"""

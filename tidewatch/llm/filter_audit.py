"""Filter interaction audit: what every order of a set of filters removes, step by step.

A document's failures are a set of filters, its mask.  All that the audit asks of a document is
its part, its mask and its labels, so documents are first counted by these (at most
2^k masks a part and label pair), and the orders are applied to the counts:

* ``failures`` is the mask matrix in min-plus form, 0 where mask m fails filter f, infinite elsewhere;
* ``positions`` holds the inverse permutations: the step at which order o applies filter f;
* their min-plus product ``rank[o, m] = min_f positions[o, f] + failures[m, f]`` is the step at which order o
  removes the documents of mask m, infinite for those that stay.

The ranks then steer weighted scatter counts: a document is removed at its rank, redundant at
every later step whose filter it fails too, and kept until its rank.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence
from itertools import permutations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import materialise, prepare

REPEATED = "repeated"  # the filter that fails a text which a smaller id has too
PARTS_AT_ONCE = 64
MEASURES = ("kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost", "shapley")


def few_words(text: Column, least: int = 200) -> Column:
    return F.size(_words(text)) < least


def repetitive(text: Column, percent: int = 50) -> Column:
    words = _words(text)
    return 100 * F.size(F.array_distinct(words)).cast("long") < percent * F.size(words).cast("long")


def many_capitals(text: Column, percent: int = 2) -> Column:
    capitals = F.length(text) - F.length(F.translate(text, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", ""))
    return 100 * capitals.cast("long") > percent * F.length(text).cast("long")


def has_symbols(text: Column) -> Column:
    return text.rlike(r"[#$%&*|]")


def _words(text: Column) -> Column:
    """Maximal runs of anything but space and the ASCII control spaces."""
    return F.array_remove(F.split(text, r"[ \t-\r]+"), "")


FILTERS: dict[str, Callable[[Column], Column] | str] = {
    "A": few_words, "B": repetitive, "C": many_capitals, "D": has_symbols, "E": REPEATED}


def failure_matrix(k: int) -> np.ndarray:
    """(2^k, k): 0 where the mask has the filter's bit, infinite elsewhere."""
    has = (np.arange(1 << k)[:, None] >> np.arange(k)) & 1
    return np.where(has == 1, 0.0, np.inf)


def position_matrix(orders: np.ndarray) -> np.ndarray:
    """(orders, k): the step, from 1, at which each order applies each filter; the inverse of its permutation."""
    return np.argsort(orders, axis=1) + 1.0


def removal_ranks(failures: np.ndarray, positions: np.ndarray) -> np.ndarray:
    """(orders, masks): min-plus product of both; the step that removes each mask, infinite if none does."""
    rank = np.full((len(positions), len(failures)), np.inf)
    for f in range(failures.shape[1]):
        np.minimum(rank, positions[:, f, None] + failures[None, :, f], out=rank)
    return rank


class Audit:
    """The orders' ranks and the counts they give for weights by mask."""

    def __init__(self, names: Sequence[str], orders: Sequence[Sequence[str]]):
        self.names, self.k = list(names), len(names)
        self.labels = ["".join(o) if all(len(x) == 1 for x in names) else ">".join(o) for o in orders]
        self.orders = np.array([[self.names.index(x) for x in o] for o in orders], np.int64).reshape(-1, self.k)
        failures = failure_matrix(self.k)
        self.fails = failures == 0  # (masks, k)
        self.rank = removal_ranks(failures, position_matrix(self.orders))
        self.stays = np.isinf(self.rank)
        self.alone = self.fails.sum(1) == 1

    def scatter(self, weight: np.ndarray) -> np.ndarray:
        """(parts, orders, k): the weight that each step removes; ``weight`` is (parts, masks)."""
        out = np.zeros((len(weight), len(self.orders), self.k), np.int64)
        o, m = np.nonzero(~self.stays)
        flat = o * self.k + self.rank[o, m].astype(np.int64) - 1
        for p in range(len(weight)):
            np.add.at(out[p].reshape(-1), flat, weight[p, m])
        return out

    def counts(self, every: np.ndarray, good: np.ndarray, toxic: np.ndarray) -> dict[str, np.ndarray]:
        """All measures as (parts, orders, k) arrays, by steps."""
        removed = self.scatter(every)
        total = every.sum(1)
        failing = (every @ self.fails)[:, self.orders]  # of the step's filter, whatever came before
        alone = (every @ (self.fails & self.alone[:, None]))[:, self.orders]
        shapley = np.zeros((len(every), self.k), np.int64)
        for p in range(len(every)):
            np.add.at(shapley[p], self.orders.ravel(), removed[p].ravel())
        return {"kept": total[:, None, None] - removed.cumsum(2), "removed": removed, "redundant": failing - removed,
                "unique_fails": alone, "good_lost": self.scatter(good), "toxic_lost": self.scatter(toxic),
                "shapley": shapley[:, self.orders]}


def filter_audit(spark: SparkSession, docs: DataFrame, labels: DataFrame, filters: dict | None = None,
                 orders: Sequence[Sequence[str]] | None = None, id_col: str = "doc_id", text_col: str = "text",
                 part_col: str = "source") -> DataFrame:
    """One row per part, order of the filters and step: part, filter_order, step, filter and the counts of
    ``MEASURES``; all orders of ``filters`` unless ``orders`` names some.

    ``filters`` maps names to failure conditions (a function from the text column to a boolean column; null
    counts as passed) or to ``REPEATED``: the text is that of a smaller id anywhere in ``docs``.  Null texts are empty
    texts, a null part is the empty string.  Every row counts, repeated rows too: rows of one id and text
    are never smaller than each other, so they pass ``REPEATED`` together; a null id has no order and passes.
    Labels of a document are quality = 1 and toxic = 1 in any of its label rows; without a row, neither.
    Texts are compared by SHA-256.  Empty ``docs`` give no rows.

    The texts are read once.  Rows that agree in id, text, part and mask are counted map-side before they are shuffled, and the least id
    of a text is joined back on (text, id), so that neither a repeated row nor a text that a third of all documents share
    meets in one task.
    """
    prepare(spark)
    filters = FILTERS if filters is None else filters
    names = list(filters)
    audit = Audit(names, list(permutations(names)) if orders is None else orders)
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))

    def bit(name: str, condition: Column) -> Column:
        return F.when(condition, F.lit(1 << names.index(name))).otherwise(F.lit(0))

    mask = F.lit(0)
    for name, condition in filters.items():
        if condition != REPEATED:
            mask = mask + bit(name, condition(F.col("text")))
    seen = materialise(docs.select(F.col(id_col).alias("id"), F.coalesce(F.col(part_col).cast("string"), F.lit("")).alias("part"), text.alias("text"))
                       .select("id", "part", F.unhex(F.sha2("text", 256)).alias("body"), mask.cast("int").alias("mask"))
                       .groupBy("id", "part", "body", "mask").agg(F.count("*").alias("n")), "masks")
    least = seen.groupBy("body").agg(F.min("id").alias("id")).withColumn("first", F.lit(True))
    marked = seen.join(least, ["body", "id"], "left")
    for name, condition in filters.items():
        if condition == REPEATED:
            marked = marked.withColumn("mask", F.col("mask") + bit(name, F.col("first").isNull() & F.col("id").isNotNull()))
    known = (labels.groupBy(F.col(id_col).alias("id"))
             .agg(F.max((F.col("quality") == 1).cast("int")).alias("good"), F.max((F.col("toxic") == 1).cast("int")).alias("toxic")))
    cell = F.struct("mask", *(F.col(c).alias(c) for c in ("n", "good", "toxic")))
    cells = (marked.join(known, "id", "left").groupBy("part", "mask")
             .agg(F.sum("n").alias("n"), F.sum(F.when(F.col("good") == 1, F.col("n")).otherwise(0)).alias("good"),
                  F.sum(F.when(F.col("toxic") == 1, F.col("n")).otherwise(0)).alias("toxic"))
             .groupBy("part").agg(F.collect_list(cell).alias("cells")))  # at most 2^k cells a part

    def apply(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        steps, k = len(audit.orders) * audit.k, audit.k
        order = np.repeat(audit.labels, k)
        step = np.tile(np.arange(1, k + 1, dtype=np.int32), len(audit.orders))
        of = np.array(audit.names)[audit.orders].ravel()
        for pdf in batches:
            for lo in range(0, len(pdf), PARTS_AT_ONCE):
                some = pdf.iloc[lo:lo + PARTS_AT_ONCE]
                weight = np.zeros((3, len(some), 1 << k), np.int64)
                for p, cells in enumerate(some["cells"]):
                    for c in cells:
                        weight[:, p, c["mask"]] = c["n"], c["good"], c["toxic"]
                found = audit.counts(*weight)
                yield pd.DataFrame({"part": np.repeat(some["part"].to_numpy(), steps), "filter_order": np.tile(order, len(some)),
                                    "step": np.tile(step, len(some)), "filter": np.tile(of, len(some)),
                                    **{m: found[m].ravel() for m in MEASURES}})

    return cells.mapInPandas(apply, "part string, filter_order string, step int, filter string, " + ", ".join(f"{m} long" for m in MEASURES))


SQL = r"""
WITH RECURSIVE letters(f, bit) AS (VALUES ('A', 1), ('B', 2), ('C', 4), ('D', 8), ('E', 16)),
orders(filter_order) AS (
  SELECT f FROM letters
  UNION ALL
  SELECT filter_order || f FROM orders, letters WHERE length(filter_order) < 5 AND NOT contains(filter_order, f)),
steps AS (
  SELECT filter_order, CAST(s.step AS INTEGER) AS step, substr(filter_order, CAST(s.step AS INTEGER), 1) AS filter
  FROM orders, generate_series(1, 5) AS s(step) WHERE length(filter_order) = 5),
texts AS (
  SELECT doc_id, coalesce(source, '') AS part, coalesce(text, '') AS text FROM documents),
words AS (
  SELECT doc_id, part, text, regexp_extract_all(text, '[^\x20\x09-\x0D]+') AS w,
         length(regexp_replace(text, '[^A-Z]', '', 'g')) AS capitals, min(doc_id) OVER (PARTITION BY text) AS least
  FROM texts),
known AS (SELECT doc_id, max(CASE WHEN quality = 1 THEN 1 ELSE 0 END) AS good, max(CASE WHEN toxic = 1 THEN 1 ELSE 0 END) AS toxic
          FROM labels GROUP BY doc_id),
masks AS (
  SELECT w.part, coalesce(k.good, 0) AS good, coalesce(k.toxic, 0) AS toxic,
         (CASE WHEN len(w.w) < 200 THEN 1 ELSE 0 END) + (CASE WHEN 100 * len(list_distinct(w.w)) < 50 * len(w.w) THEN 2 ELSE 0 END)
         + (CASE WHEN 100 * w.capitals > 2 * length(w.text) THEN 4 ELSE 0 END)
         + (CASE WHEN regexp_matches(w.text, '[#$%&*|]') THEN 8 ELSE 0 END) + (CASE WHEN w.doc_id > w.least THEN 16 ELSE 0 END) AS mask
  FROM words w LEFT JOIN known k ON w.doc_id = k.doc_id),
cells AS (SELECT part, mask, count(*) AS n, sum(good) AS good, sum(toxic) AS toxic FROM masks GROUP BY part, mask),
ranks AS (
  SELECT c.part, c.mask, c.n, c.good, c.toxic, s.filter_order, s.step, s.filter, (c.mask & l.bit) > 0 AS fails, c.mask = l.bit AS alone,
         min(CASE WHEN (c.mask & l.bit) > 0 THEN s.step ELSE 9 END) OVER (PARTITION BY c.part, c.mask, s.filter_order) AS rank
  FROM cells c, steps s JOIN letters l ON l.f = s.filter),
counted AS (
  SELECT part, filter_order, step, filter,
         sum(CASE WHEN rank > step THEN n ELSE 0 END) AS kept, sum(CASE WHEN rank = step THEN n ELSE 0 END) AS removed,
         sum(CASE WHEN fails AND rank < step THEN n ELSE 0 END) AS redundant, sum(CASE WHEN alone THEN n ELSE 0 END) AS unique_fails,
         sum(CASE WHEN rank = step THEN good ELSE 0 END) AS good_lost, sum(CASE WHEN rank = step THEN toxic ELSE 0 END) AS toxic_lost
  FROM ranks GROUP BY part, filter_order, step, filter)
SELECT part, filter_order, step, CAST(kept AS BIGINT) AS kept, CAST(removed AS BIGINT) AS removed, CAST(redundant AS BIGINT) AS redundant,
       CAST(unique_fails AS BIGINT) AS unique_fails, CAST(good_lost AS BIGINT) AS good_lost, CAST(toxic_lost AS BIGINT) AS toxic_lost,
       CAST(sum(removed) OVER (PARTITION BY part, filter) AS BIGINT) AS shapley
FROM counted
"""

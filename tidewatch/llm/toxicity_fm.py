"""Toxicity by a factorization machine over hashed terms.

Terms are lower-cased words and word beginnings, hashed to 2^20 slots.  Terms whose
presence tells the labels apart in the training sample are kept; over these the
machine learns a weight each and a small vector each, so that the score also has the
inner products of all pairs of present terms: an insult near a group name counts
for more, or less, than the sum of both.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import crc_fold, prepare, utf8
from .hashing import PrefixHash, blocks, byte_runs, join_bytes
from .quality_crf import labelled_sample

BLOCK = 4 << 20
SAMPLE_ROWS = 12000  # labelled documents that the model is fitted on
SLOTS = 1 << 20
BEGIN = (4, 6)  # bytes of the word beginnings that are terms
KEEP_Z = 3.0  # terms are kept from this many standard errors of their log odds on
MIN_DOCS = 5  # and from this many sample documents on

_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_IS_WORD = np.zeros(256, bool)
_IS_WORD[0x30:0x3A] = _IS_WORD[0x61:0x7B] = _IS_WORD[0x80:] = True


def terms(bodies: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """(document number, slot) of every term occurrence, in document order for each kind of term."""
    data, at = join_bytes(bodies)
    data = _LOWER[data]
    start, end = byte_runs(_IS_WORD[data])
    doc = np.searchsorted(at, start, side="right") - 1
    pre = PrefixHash(data)
    docs, slots = [doc], [pre.slices(start, end) % np.uint64(SLOTS)]
    for k, n in enumerate(BEGIN):
        long = end - start > n
        name = pre.slices(start[long], start[long] + n)
        slots.append((name * np.uint64(2 * k + 3) + np.uint64(k + 1)) % np.uint64(SLOTS))
        docs.append(doc[long])
    return np.concatenate(docs), np.concatenate(slots).astype(np.int64)


def present(bodies: list[bytes], column: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Distinct (document, slot) pairs; with ``column`` (slot to model column or -1) only kept terms, as columns."""
    doc, slot = terms(bodies)
    if column is not None:
        slot = column[slot]
        doc, slot = doc[slot >= 0], slot[slot >= 0]
    pair = np.unique(doc * SLOTS + slot)
    return pair // SLOTS, pair % SLOTS


@dataclass
class FactorizationMachine:
    column: np.ndarray  # slot to model column, -1 for terms that are not kept
    bias: float
    weight: np.ndarray
    factor: np.ndarray  # one row per column

    def raw(self, doc: np.ndarray, col: np.ndarray, n: int) -> np.ndarray:
        """bias + sum of weights + sum of inner products of all pairs of present terms."""
        out = self.bias + np.bincount(doc, self.weight[col], minlength=n)
        for f in self.factor.T:
            total = np.bincount(doc, f[col], minlength=n)
            out += 0.5 * (total ** 2 - np.bincount(doc, f[col] ** 2, minlength=n))
        return out

    def score(self, bodies: list[bytes]) -> np.ndarray:
        doc, col = present(bodies, self.column)
        return 1 / (1 + np.exp(-np.clip(self.raw(doc, col, len(bodies)), -30, 30)))


def fit(slots: list[np.ndarray], label: np.ndarray, rank: int = 4, rounds: int = 300, rate: float = 0.1,
        ridge: float = 0.05, seed: int = 7) -> FactorizationMachine:
    """Fitted on documents given as their distinct slots, by Adam on the whole sample."""
    n, size = len(slots), np.array([len(s) for s in slots])
    doc, slot = np.repeat(np.arange(n), size), np.concatenate(slots)
    toxic = max(int(label.sum()), 1)
    clean = max(n - toxic, 1)
    a = np.bincount(slot, label[doc], minlength=SLOTS)
    b = np.bincount(slot, minlength=SLOTS) - a
    z = np.log((a + 0.5) / (toxic - a + 0.5)) - np.log((b + 0.5) / (clean - b + 0.5))
    z /= np.sqrt(1 / (a + 0.5) + 1 / (b + 0.5) + 1 / (toxic - a + 0.5) + 1 / (clean - b + 0.5))
    kept = np.flatnonzero((np.abs(z) >= KEEP_Z) & (a + b >= MIN_DOCS))
    column = np.full(SLOTS, -1, np.int32)
    column[kept] = np.arange(len(kept))
    col = column[slot]
    doc, col = doc[col >= 0], col[col >= 0]
    rng, k = np.random.default_rng(seed), len(kept)
    size = 1 + k + k * rank
    param = np.r_[np.log(toxic / clean), np.zeros(k), rng.normal(0, 0.02, k * rank)]
    m, v = np.zeros(size), np.zeros(size)
    for t in range(1, rounds + 1):
        model = FactorizationMachine(column, param[0], param[1:1 + k], param[1 + k:].reshape(k, rank))
        err = 1 / (1 + np.exp(-np.clip(model.raw(doc, col, n), -30, 30))) - label
        of = err[doc]
        slope = [np.array([err.sum()]), np.bincount(col, of, minlength=k)]
        both = np.empty((k, rank))
        for r in range(rank):
            f = model.factor[:, r]
            total = np.bincount(doc, f[col], minlength=n)
            both[:, r] = np.bincount(col, of * (total[doc] - f[col]), minlength=k)
        slope = np.concatenate([*slope, both.ravel()])
        slope[1:] += ridge * param[1:]
        slope /= n
        m, v = 0.9 * m + 0.1 * slope, 0.999 * v + 0.001 * slope ** 2
        param = param - rate * (m / (1 - 0.9 ** t)) / (np.sqrt(v / (1 - 0.999 ** t)) + 1e-8)
    return FactorizationMachine(column, param[0], param[1:1 + k], param[1 + k:].reshape(k, rank))


def train_toxicity(spark: SparkSession, docs: DataFrame, labels: DataFrame, train, id_col: str = "doc_id", text_col: str = "text",
                   label_col: str = "toxic", sample_rows: int = SAMPLE_ROWS) -> FactorizationMachine | None:
    """Model fitted on the labelled rows that ``train`` (a column over ``id``) selects; None without any.  The distinct
    term slots of the sampled documents travel to the driver."""
    sample = labelled_sample(docs, labels, id_col, text_col, label_col, train, sample_rows)

    def featured(batches):
        for pdf in batches:
            yield pd.DataFrame({"slots": [present([b])[1].astype(np.int32).tobytes() for b in pdf["body"]], "label": pdf["label"]})

    got = sample.mapInPandas(featured, "slots binary, label int").collect()
    if not got:
        return None
    return fit([np.frombuffer(r["slots"], np.int32).astype(np.int64) for r in got], np.array([r["label"] for r in got], np.float64))


def score_toxicity(spark: SparkSession, docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text",
                   label_col: str = "toxic", modulus: int = 4, held: int = 2, threshold: float = 0.3,
                   sample_rows: int = SAMPLE_ROWS) -> DataFrame:
    """One row per row of ``docs``: id, held_out (crc32 of the id as text mod ``modulus`` is ``held``), score in [0, 1],
    predicted (1 if score >= ``threshold``).

    The score depends on the text alone; a null text counts as empty and scores the bias.  Without a labelled
    row to learn from every score is 0.  Repeated rows score alike; other columns are ignored.
    """
    prepare(spark)
    model = train_toxicity(spark, docs, labels, crc_fold("id", modulus) != held, id_col, text_col, label_col, sample_rows)
    sent = spark.sparkContext.broadcast(model)  # 4 MB of slots and the kept terms
    kind = docs.schema[id_col].dataType.simpleString()
    rows = docs.select(F.col(id_col).alias("id"), (crc_fold(id_col, modulus) == held).alias("held_out"), utf8(text_col).alias("body"))

    def scored(batches):
        for pdf in batches:
            bodies, found = list(pdf["body"]), np.zeros(len(pdf))
            if sent.value is not None:
                for lo, hi in blocks(bodies, BLOCK):
                    found[lo:hi] = sent.value.score(bodies[lo:hi])
            yield pdf.drop(columns=["body"]).assign(score=found, predicted=(found >= threshold).astype(np.int32))

    return (rows.mapInPandas(scored, f"id {kind}, held_out boolean, score double, predicted int")
            .withColumnRenamed("id", id_col))

"""Document quality from a linear-chain conditional random field over lines.

Every line of a document is a node with two states, bad and good.  A line is
described by its own features and those of the lines before and after it;
neighbouring states are linked by transition weights.  Training lines
carry the label of their document.  The score of a document is the mean of its lines' good
marginals (forward-backward), weighted by line length, passed through a logistic
calibration fitted on the training documents.
"""

from __future__ import annotations

import zlib
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import crc_fold, kept_schema, kept_struct, prepare, utf8
from .hashing import PrefixHash, blocks, byte_runs, join_bytes

BLOCK = 1 << 20
SAMPLE_ROWS = 6000  # labelled documents that the model is fitted on
SAMPLE_LINES = 2000  # of a longer document, so many lines in a row stand for it in that sample
SAMPLE_TASKS = 32
QUANTILES = (0.04, 0.12, 0.5, 0.88, 0.96)  # bin edges of a feature
BINS = len(QUANTILES) + 1

# byte classes: 0 other, 1 lower, 2 upper, 3 digit, 4 space, 5 sentence marks, 6 bar, 7 exclamation, 8 symbols, 9 non-ASCII
_CLASS = np.zeros(256, np.int64)
_CLASS[97:123], _CLASS[65:91], _CLASS[48:58], _CLASS[0x80:] = 1, 2, 3, 9
for _marks, _k in ((b" \t\r\n\v\f", 4), (b".,;:?'\"()-", 5), (b"|", 6), (b"!", 7), (b"#$%&*+/<=>@[\\]^_`{}~", 8)):
    _CLASS[list(_marks)] = _k
_IS_WORD = np.ones(256, bool)
_IS_WORD[9:14] = _IS_WORD[32] = False


def line_features(bodies: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Feature rows of all lines, their length in bytes, and the end offsets of the documents' lines.
    An empty text is one empty line."""
    data, at = join_bytes(bodies, b"\n")
    stop = np.flatnonzero(data == 10)
    lines = len(stop)
    size = np.diff(np.r_[-1, stop])
    line = np.repeat(np.arange(lines), size)
    count = np.bincount(line * 10 + _CLASS[data], minlength=lines * 10).reshape(lines, 10).astype(np.float64)
    # capitals of two bytes: C3 80..C3 9E
    wide = np.flatnonzero((data[:-1] == 0xC3) & (data[1:] >= 0x80) & (data[1:] <= 0x9E))
    wide_upper = np.bincount(line[wide], minlength=lines)
    start, end = byte_runs(_IS_WORD[data])
    of = line[start]
    name = PrefixHash(data).slices(start, end)
    words = np.bincount(of, minlength=lines).astype(np.float64)
    pair = np.sort((of.astype(np.uint64) << np.uint64(40)) | (name >> np.uint64(24)))
    kinds = np.bincount((pair[np.r_[True, pair[1:] != pair[:-1]][:len(pair)]] >> np.uint64(40)).astype(np.int64), minlength=lines)
    again = np.r_[False, (name[1:] == name[:-1]) & (of[1:] == of[:-1])][:len(of)]
    repeats = np.bincount(of[again], minlength=lines)
    odd_end = np.bincount(of[np.isin(_CLASS[data[end - 1]], (0, 6, 7, 8))], minlength=lines) if len(end) else np.zeros(lines)
    upper = count[:, 2] + wide_upper
    letters = np.maximum(count[:, 1] + count[:, 2] + count[:, 9] / 2, 1)
    body, n = np.maximum(size - 1, 1), np.maximum(words, 1)
    out = np.stack([upper / letters, count[:, 3] / body, count[:, 5] / n, count[:, 6] / n, count[:, 7] / n, count[:, 8] / n,
                    count[:, 0] / body, kinds / n, repeats / n, odd_end / n, (size - 1 - words + 1) / n,
                    np.log1p(words), np.log1p(size - 1)], 1)
    return out.astype(np.float32), np.maximum(size - 1, 1), np.searchsorted(stop, at[1:] - 1) + 1


@dataclass
class QualityModel:
    edges: np.ndarray  # bin edges of each feature
    weight: np.ndarray  # evidence for "good" of the binned features of a line and its neighbours
    trans: np.ndarray  # 2 x 2 transition scores
    slope: float = 1.0
    shift: float = 0.0


def _binned(x: np.ndarray, edges: np.ndarray) -> np.ndarray:
    """Bin number of each feature, offset so that every (feature, bin) has its own column."""
    return np.stack([np.searchsorted(e, x[:, k]) + k * BINS for k, e in enumerate(edges)], 1)


def _columns(x: np.ndarray, edges: np.ndarray, first: np.ndarray) -> np.ndarray:
    """Active columns of each line: own bins, bins of the line before, of the line after; the last column of a part
    stands for no such line.  ``first`` marks first lines of documents."""
    own = _binned(x, edges)
    part = len(edges) * BINS + 1
    last = np.r_[first[1:], True]
    before = np.roll(own, 1, axis=0)
    after = np.roll(own, -1, axis=0)
    before[first], after[last] = part - 1, part - 1
    return np.concatenate((own, before + part, after + 2 * part), 1)


def _project(x, edges, first, weight) -> np.ndarray:
    return weight[_columns(x, edges, first)].sum(1)


def marginals(score: np.ndarray, cut: np.ndarray, trans: np.ndarray):
    """Forward-backward over all documents at once (``cut``: n+1 line offsets).  ``score`` is the evidence for state 1;
    returns its marginal per line, the expected transition counts and the log partition functions."""
    size = np.diff(cut)
    by = np.argsort(-size, kind="stable")
    size, start = size[by], cut[:-1][by]
    fwd = np.zeros((len(score), 2))
    bwd = np.zeros((len(score), 2))
    top = int(size.max(initial=0))
    alive = np.searchsorted(-size, -np.arange(1, top + 1), side="right")  # documents of more than t lines
    for t in range(top):
        at = start[:alive[t]] + t
        if t:
            f = fwd[at - 1]
            for s in (0, 1):
                fwd[at, s] = np.logaddexp(f[:, 0] + trans[0, s], f[:, 1] + trans[1, s])
        fwd[at, 1] += score[at]
    for t in reversed(range(top - 1)):
        at = start[:alive[t + 1]] + t
        b = bwd[at + 1].copy()
        b[:, 1] += score[at + 1]
        for s in (0, 1):
            bwd[at, s] = np.logaddexp(b[:, 0] + trans[s, 0], b[:, 1] + trans[s, 1])
    last = start + size - 1
    log_z = np.logaddexp(fwd[last, 0], fwd[last, 1])
    z = np.repeat(log_z[np.argsort(by, kind="stable")], np.diff(cut))
    good = np.exp(fwd[:, 1] + bwd[:, 1] - z)
    inner = np.ones(len(score), bool)
    inner[cut[1:] - 1] = False
    at = np.flatnonzero(inner)
    pairs = np.zeros((2, 2))
    for s in (0, 1):
        for r in (0, 1):
            pairs[s, r] = np.exp(fwd[at, s] + trans[s, r] + (score[at + 1] if r else 0) + bwd[at + 1, r] - z[at]).sum()
    return good, pairs, log_z


def fit(x: np.ndarray, cut: np.ndarray, length: np.ndarray, label: np.ndarray, rounds: int = 150,
        rate: float = 0.05, ridge: float = 2.0) -> QualityModel:
    """Maximum likelihood by Adam on the whole sample; ``label`` per document (0 or 1)."""
    edges = np.quantile(x, QUANTILES, axis=0).T
    first = np.zeros(len(x), bool)
    first[cut[:-1]] = True
    cols = _columns(x, edges, first)
    dims = 3 * (x.shape[1] * BINS + 1)
    y = np.repeat(label, np.diff(cut)).astype(np.float64)
    seen = np.zeros((2, 2))
    for s in (0, 1):
        seen[s, s] = (np.diff(cut) - 1)[label == s].sum()
    param, m, v = np.zeros(dims + 4), np.zeros(dims + 4), np.zeros(dims + 4)
    for k in range(1, rounds + 1):
        good, pairs, _ = marginals(param[cols].sum(1), cut, param[dims:].reshape(2, 2))
        slope = np.bincount(cols.ravel(), np.repeat(good - y, cols.shape[1]), minlength=dims)
        slope = np.r_[slope, (pairs - seen).ravel()] / len(label) + ridge * param / len(label)
        m, v = 0.9 * m + 0.1 * slope, 0.999 * v + 0.001 * slope ** 2
        param -= rate * (m / (1 - 0.9 ** k)) / (np.sqrt(v / (1 - 0.999 ** k)) + 1e-8)
    model = QualityModel(edges, param[:dims], param[dims:].reshape(2, 2))
    raw = _logit(_weighted(model, x, cut, length))
    a, b = 1.0, 0.0
    for _ in range(100):  # logistic calibration by Newton steps
        p = 1 / (1 + np.exp(-(a * raw + b)))
        w = np.maximum(p * (1 - p), 1e-6)
        g = np.array([((p - label) * raw).sum() + 0.1 * (a - 1), (p - label).sum() + 0.1 * b])
        h = np.array([[(w * raw * raw).sum() + 0.1, (w * raw).sum()], [(w * raw).sum(), w.sum() + 0.1]])
        step = np.linalg.solve(h, g)
        a, b = a - np.clip(step[0], -1, 1), b - np.clip(step[1], -1, 1)
    return QualityModel(edges, model.weight, model.trans, max(float(a), 0.05), float(b))


def _logit(p: np.ndarray) -> np.ndarray:
    p = np.clip(p, 1e-4, 1 - 1e-4)
    return np.log(p / (1 - p))


def _weighted(model: QualityModel, x, cut, length) -> np.ndarray:
    first = np.zeros(len(x), bool)
    first[cut[:-1]] = True
    good, _, _ = marginals(_project(x, model.edges, first, model.weight), cut, model.trans)
    return np.add.reduceat(good * length, cut[:-1]) / np.add.reduceat(length, cut[:-1])


def score(model: QualityModel, bodies: list[bytes]) -> np.ndarray:
    x, length, cut = line_features(bodies)
    return 1 / (1 + np.exp(-(model.slope * _logit(_weighted(model, x, np.r_[0, cut], length)) + model.shift)))


def labelled_sample(docs: DataFrame, labels: DataFrame, id_col: str, text_col: str, label_col: str, train, rows: int) -> DataFrame:
    """(id, body, label) of at most ``rows`` labelled documents, drawn by a hash of the id.  Labels of an id that
    has several are averaged; null ids and labels are left out."""
    key = labels.select(F.col(id_col).alias("id"), F.col(label_col).cast("double").alias("label")).where("id is not null and label is not null")
    key = key.groupBy("id").agg((F.avg("label") >= 0.5).cast("int").alias("label"))
    key = key.where(train).orderBy(F.xxhash64("id"), "id").limit(rows)  # so at most ``rows`` rows are broadcast
    return (docs.select(F.col(id_col).alias("id"), utf8(text_col).alias("body")).join(F.broadcast(key), "id")
            .orderBy(F.xxhash64("id", "body"), "id").limit(rows))


def stretch(body: bytes, lines: int = SAMPLE_LINES) -> bytes:
    """A text of at most ``lines`` lines as it is; of a longer one, so many lines in a row, from a place that its hash draws."""
    cut = body.split(b"\n")
    if len(cut) <= lines:
        return body
    at = zlib.crc32(body) % (len(cut) - lines + 1)
    return b"\n".join(cut[at:at + lines])


def train_quality(spark: SparkSession, docs: DataFrame, labels: DataFrame, train, id_col: str = "doc_id", text_col: str = "text",
                  label_col: str = "quality", sample_rows: int = SAMPLE_ROWS) -> QualityModel | None:
    """Model fitted on the labelled rows that ``train`` (a column over ``id``) selects; None without any.
    Only line features travel to the driver."""
    sample = labelled_sample(docs, labels, id_col, text_col, label_col, train, sample_rows)

    def featured(batches):
        for pdf in batches:
            out = []
            for body, label in zip(pdf["body"], pdf["label"]):
                x, length, _ = line_features([stretch(body)])
                out.append((x.tobytes(), length.astype(np.int64).tobytes(), label))
            yield pd.DataFrame(out, columns=["x", "length", "label"])

    got = sample.repartition(SAMPLE_TASKS).mapInPandas(featured, "x binary, length binary, label int").collect()
    if not got:
        return None
    wide = line_features([b""])[0].shape[1]
    x = np.concatenate([np.frombuffer(r["x"], np.float32).reshape(-1, wide) for r in got])
    length = [np.frombuffer(r["length"], np.int64) for r in got]
    return fit(x, np.r_[0, np.cumsum([len(k) for k in length])], np.concatenate(length), np.array([r["label"] for r in got]))


def score_quality(spark: SparkSession, docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text",
                  label_col: str = "quality", modulus: int = 3, held: int = 1, sample_rows: int = SAMPLE_ROWS,
                  keep: tuple[str, ...] = ()) -> DataFrame:
    """One row per row of ``docs``: id, held_out (crc32 of the id as text mod ``modulus`` is ``held``), score in [0, 1],
    predicted (1 if score >= 0.5), and with ``keep`` a struct kept of the columns it names.

    The score depends on the text alone.  A null text counts as empty, and an empty text is one empty line.  Without a
    labelled row to learn from every score is 0.5.  Repeated rows score alike; other columns are ignored.
    """
    prepare(spark)
    model = train_quality(spark, docs, labels, crc_fold("id", modulus) != held, id_col, text_col, label_col, sample_rows)
    sent = spark.sparkContext.broadcast(model)  # a few hundred numbers
    kind = docs.schema[id_col].dataType.simpleString()
    rows = docs.select(F.col(id_col).alias("id"), (crc_fold(id_col, modulus) == held).alias("held_out"),
                       utf8(text_col).alias("body"), *kept_struct(docs, keep))

    def scored(batches):
        for pdf in batches:
            bodies, found = list(pdf["body"]), np.full(len(pdf), 0.5)
            if sent.value is not None:
                for lo, hi in blocks(bodies, BLOCK):
                    found[lo:hi] = score(sent.value, bodies[lo:hi])
            yield pdf.drop(columns=["body"]).assign(score=found, predicted=(found >= 0.5).astype(np.int32))

    out = rows.mapInPandas(scored, ", ".join([f"id {kind}, held_out boolean", *kept_schema(docs, keep), "score double, predicted int"]))
    return out.select(F.col("id").alias(id_col), "held_out", "score", "predicted", *(["kept"] if keep else []))

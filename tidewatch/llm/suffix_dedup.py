"""Repeated byte strings of a corpus by sparse suffix arrays.

Every byte covered by a ``width``-byte string that starts at two or more
places of the corpus is removed.  The work is split so that equal strings
always meet, whatever shard their documents are in:

1. *Anchors.*  Each ``width``-byte window owns the k-gram of least hash
   inside it.  Equal windows own equal k-grams at equal offsets, so the
   windows of one k-gram value can be judged alone.  Neighbouring windows
   with one anchor form a segment.
2. Segments whose k-gram value occurs once in the corpus are unique.  The
   others are collapsed to distinct segments with a multiplicity.
3. *Shards.*  The distinct segments are dealt to shards by k-gram value.
   Per shard, the texts right of the anchors and the reversed texts left of
   them are cut into 8-byte words and sorted as suffixes by
   Larsson-Sadakane refinement; Kasai's method gives common prefixes.  A
   window is repeated when another segment shares its left part and its
   right part.
4. *Cross-shard merge.*  The segments of a k-gram value that has very many
   different contexts are spread over several shards.  Their windows, each
   once a shard, are exchanged as sorted fingerprint lists, cut by
   fingerprint range, and sorted together; equal neighbours are repeated.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import materialise, prepare, utf8
from .hashing import PrefixHash

GRAM = 32  # bytes of an anchor k-gram
PIECE = 1 << 20  # window starts per numpy block
SHARD_BYTES = 4 << 20  # segment text per suffix-array shard
SPREAD_CLASSES = 4096  # distinct contexts above which a k-gram value is spread over shards

def block_anchors(data: np.ndarray, ends: np.ndarray, width: int, gram: int) -> dict[str, np.ndarray]:
    """Anchor segments of concatenated pieces that end at ``ends``: ``start`` of
    the first window, ``windows`` in the run, ``off`` from start to anchor,
    hash ``h`` of the k-gram and ``fp`` of the whole segment."""
    n = len(data)
    begins = np.concatenate(([0], ends[:-1]))
    ok = np.zeros(n + 1, np.int8)  # +1 / -1 marks of the ranges of window starts
    fits = ends - begins >= width
    np.add.at(ok, begins[fits], 1)
    np.add.at(ok, ends[fits] - width + 1, -1)
    if not fits.any():
        return {k: np.zeros(0, np.int64) for k in ("start", "windows", "off", "h", "fp")}
    pre = PrefixHash(data)
    at = np.arange(n - gram + 1)
    value = pre.slices(at, at + gram)
    packed = (value & ~np.uint64(0xFFFFFF)) | at.astype(np.uint64)  # blocks are < 2^24 bytes
    span, size = width - gram + 1, 1
    least = packed
    while size * 2 <= span:  # sliding minimum by doubling
        least = np.minimum(least[:-size], least[size:])
        size *= 2
    least = np.minimum(least[:len(packed) - span + 1], least[span - size:span - size + len(packed) - span + 1])
    starts = np.flatnonzero(np.cumsum(ok[:n])[:len(least)] > 0)
    anchor = (least[starts] & np.uint64(0xFFFFFF)).astype(np.int64)
    piece = np.searchsorted(ends, starts, side="right")
    first = np.flatnonzero(np.r_[True, (anchor[1:] != anchor[:-1]) | (piece[1:] != piece[:-1])])
    windows = np.diff(np.r_[first, len(starts)])
    start, anchor = starts[first], anchor[first]
    return {"start": start, "windows": windows, "off": anchor - start, "h": value[anchor].view(np.int64),
            "fp": pre.slices(start, start + windows - 1 + width).view(np.int64)}


def _anchor_rows(batches: Iterator[pd.DataFrame], width: int, gram: int) -> Iterator[pd.DataFrame]:
    def flush(parts):
        data = np.frombuffer(b"".join(p[3] for p in parts), np.uint8)
        ends = np.cumsum([len(p[3]) for p in parts])
        a = block_anchors(data, ends, width, gram)
        i = np.searchsorted(ends, a["start"], side="right")
        base = np.array([p[2] for p in parts], np.int64) - np.r_[0, ends[:-1]]
        return pd.DataFrame({"h": a["h"], "fp": a["fp"], "key": np.array([p[0] for p in parts])[i],
                             "size": np.array([p[1] for p in parts], np.int32)[i],
                             "start": (a["start"] + base[i]).astype(np.int32),
                             "windows": a["windows"].astype(np.int16), "off": a["off"].astype(np.int16)})

    for pdf in batches:
        parts, held = [], 0
        for key, size, body in zip(pdf["key"], pdf["size"], pdf["body"]):
            for at in range(0, len(body) - width + 1, PIECE):  # pieces share width-1 bytes, windows none
                parts.append((key, size, at, body[at:at + PIECE + width - 1]))
                held += len(parts[-1][3])
                if held >= PIECE:
                    yield flush(parts)
                    parts, held = [], 0
        if parts:
            yield flush(parts)


# --- per-shard suffix arrays -------------------------------------------------

def suffix_array(rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Larsson-Sadakane suffix sorting of the rows of a word matrix, each closed by
    an end mark.  Returns the order of all suffixes (flat positions of
    the marked text) and the symbols; equal suffixes stay in text order."""
    m, width = rows.shape
    stride = width + 1
    text = np.zeros((m, stride), np.int64)
    text[:, :width] = np.unique(rows, return_inverse=True)[1].reshape(m, width) + 1
    text = text.ravel()
    last = np.repeat(np.arange(m) * stride + width, stride)  # the row's end mark
    order = np.argsort(text, kind="stable")
    key = text[order]
    head = np.r_[True, key[1:] != key[:-1]]
    rank = np.empty(len(text), np.int64)
    rank[order] = np.maximum.accumulate(np.where(head, np.arange(len(text)), 0))
    step, live = 1, np.flatnonzero(~(head & np.r_[head[1:], True]))
    while len(live) and step <= width:
        pos = order[live]  # only groups that are not sorted yet are refined
        key = (rank[pos] << np.int64(32)) | rank[np.minimum(pos + step, last[pos])]
        by = np.argsort(key, kind="stable")
        pos, key = pos[by], key[by]
        order[live] = pos
        head = np.r_[True, key[1:] != key[:-1]]
        rank[pos] = np.maximum.accumulate(np.where(head, live, 0))
        live = live[~(head & np.r_[head[1:], True])]
        step *= 2
    return order, text


def kasai(order: np.ndarray, text: np.ndarray, width: int) -> np.ndarray:
    """Common prefix, in words, of each suffix with the one before it in ``order``.
    Kasai's scan in text order, run for all rows at once."""
    stride = width + 1
    before = np.full(len(text), -1, np.int64)
    before[order[1:]] = order[:-1]
    common = np.zeros(len(text), np.int64)
    row = np.arange(0, len(text), stride)
    size = np.zeros(len(row), np.int64)
    for j in range(width):
        size = np.maximum(size - 1, 0)
        at, prev = row + j, before[row + j]
        size[prev < 0] = 0
        grow = np.flatnonzero(prev >= 0)
        while len(grow):
            a, b = text[at[grow] + size[grow]], text[prev[grow] + size[grow]]
            grow = grow[(a == b) & (a != 0)]
            size[grow] += 1
        common[at] = size
    return common


def sorted_prefixes(rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Order of the byte rows (a multiple of 8 wide) and the common prefix in bytes of each
    row with the one before it in that order."""
    m, n_bytes = rows.shape
    words = np.ascontiguousarray(rows).view(">u8").astype(np.uint64)
    width = words.shape[1]
    order, text = suffix_array(words)
    common = kasai(order, text, width)[order]
    whole = np.flatnonzero(order % (width + 1) == 0)  # suffixes that are whole rows
    by = order[whole] // (width + 1)
    if m < 2:
        return by, np.zeros(m, np.int64)
    shared = np.minimum.reduceat(common[:whole[-1] + 1], whole[:-1] + 1)
    a, b = by[:-1], by[1:]
    col = np.minimum(shared, width - 1)[:, None] * 8 + np.arange(8)
    same = np.cumprod(rows[a[:, None], col] == rows[b[:, None], col], axis=1).sum(1)
    return by, np.r_[0, np.where(shared >= width, n_bytes, shared * 8 + same)]


def _matrix(data: np.ndarray, begin: np.ndarray, size: np.ndarray, width: int, step: int) -> np.ndarray:
    """Rows data[begin], data[begin + step], ... of the given sizes, padded with zeros."""
    j = np.arange(width)
    at = begin[:, None] + step * j
    inside = j < size[:, None]
    return np.where(inside, data[np.where(inside, at, 0)], 0).astype(np.uint8)


def repeated_windows(bodies: list[bytes], off: np.ndarray, windows: np.ndarray, width: int,
                     gram: int) -> np.ndarray:
    """For distinct segments (m of them): a boolean matrix, true at (segment, offset of the anchor
    in the window) where another segment has the same window."""
    m, reach = len(bodies), width - gram + 1
    data = np.frombuffer(b"".join(bodies), np.uint8)
    size = np.array([len(b) for b in bodies])
    begin = np.r_[0, np.cumsum(size)[:-1]]
    pad = lambda n: -(-n // 8) * 8
    r_by, r_common = sorted_prefixes(_matrix(data, begin + off, size - off, pad(width), 1))
    l_by, l_common = sorted_prefixes(_matrix(data, begin + off - 1, off, pad(max(reach - 1, 1)), -1))
    low, hit = off - windows + 1, np.zeros((m, reach), bool)
    right, left = np.empty(m, np.int64), np.empty(m, np.int64)
    for o in range(reach):
        has = (low <= o) & (o <= off)
        if has.sum() < 2:
            continue
        right[r_by] = np.cumsum(r_common < width - o)
        left[l_by] = np.cumsum(l_common < o)
        rows = np.flatnonzero(has)
        key = right[rows] * (m + 1) + left[rows]
        by = np.argsort(key)
        same = key[by][1:] == key[by][:-1]
        hit[rows[by], o] = np.r_[same, False] | np.r_[False, same]
    return hit


def _window_names(bodies: list[bytes], off: np.ndarray, windows: np.ndarray, width: int):
    """Two fingerprints of every window: (segment index, anchor offset, name, second name)."""
    data = np.frombuffer(b"".join(bodies), np.uint8)
    begin = np.r_[0, np.cumsum([len(b) for b in bodies])[:-1]]
    seg = np.repeat(np.arange(len(bodies)), windows)
    first = np.r_[0, np.cumsum(windows)[:-1]]
    p = np.arange(len(seg)) - first[seg]
    start = begin[seg] + p
    twice = PrefixHash(data), PrefixHash(255 - data)
    return seg, off[seg] - p, *(x.slices(start, start + width) for x in twice)


def _runs(hit: np.ndarray, off: np.ndarray) -> list[list[int]]:
    """Flattened [begin, end) runs of repeated window starts relative to the segment."""
    out = []
    for row, o in zip(hit, off):
        edge = np.flatnonzero(np.diff(np.r_[0, row[:o + 1][::-1].astype(np.int8), 0]))
        out.append(edge.tolist())
    return out


def _shard(pdf: pd.DataFrame, width: int, gram: int, ranges: int) -> pd.DataFrame:
    pdf = pdf.drop_duplicates(["h", "fp"])
    bodies = list(pdf["body"])
    off, windows = pdf["off"].to_numpy(np.int64), pdf["windows"].to_numpy(np.int64)
    hit = repeated_windows(bodies, off, windows, width, gram)
    o = np.arange(hit.shape[1])
    many = pdf["n"].to_numpy() > 1
    hit[many] = (o <= off[many, None]) & (o > (off - windows)[many, None])
    out = pd.DataFrame({"band": -1, "h": pdf["h"].to_numpy(), "fp": pdf["fp"].to_numpy(),
                        "runs": _runs(hit, off), "names": None})
    spread = np.flatnonzero(pdf["spread"].to_numpy())
    if len(spread):
        seg, o, a, b = _window_names([bodies[i] for i in spread], off[spread], windows[spread], width)
        band = (a % np.uint64(ranges)).astype(np.int64)
        by = np.lexsort((b, a, band))
        # the suffix arrays have judged what this shard has twice: one of each is enough for the other shards
        by = by[np.r_[True, (a[by][1:] != a[by][:-1]) | (b[by][1:] != b[by][:-1])]]
        h, fp = pdf["h"].to_numpy()[spread], pdf["fp"].to_numpy()[spread]
        cut = np.flatnonzero(np.r_[True, np.diff(band[by]) != 0])
        packs = [np.rec.fromarrays([a[g], b[g], h[seg[g]], fp[seg[g]], o[g].astype(np.int16)], dtype=_NAME).tobytes()
                 for g in np.split(by, cut[1:])]
        out = pd.concat([out, pd.DataFrame({"band": band[by][cut], "h": 0, "fp": 0, "runs": None, "names": packs})])
    return out


_NAME = np.dtype([("a", "u8"), ("b", "u8"), ("h", "i8"), ("fp", "i8"), ("o", "i2")])


def _merge(pdf: pd.DataFrame, width: int, gram: int) -> pd.DataFrame:
    """Cross-shard merge of one fingerprint range: a shard's list has each window once, so windows with an equal
    neighbour in the order of all lists are in several shards.  Each is given once."""
    rows = np.concatenate([np.frombuffer(x, _NAME) for x in pdf["names"]])
    rows = rows[np.lexsort((rows["b"], rows["a"]))]
    same = (rows["a"][1:] == rows["a"][:-1]) & (rows["b"][1:] == rows["b"][:-1])
    rows = rows[np.r_[False, same] | np.r_[same, False]]
    return pd.DataFrame({"h": rows["h"], "fp": rows["fp"], "o": rows["o"].astype(np.int32)})


# --- the operator --------------------------------------------------------------

def repeated_runs(spark: SparkSession, docs: DataFrame, width: int = 200, gram: int = GRAM,
                  shard_bytes: int = SHARD_BYTES, spread_classes: int = SPREAD_CLASSES) -> DataFrame:
    """Runs of repeated windows per document key: (key, size, spans array<struct<start, runs>>),
    for ``docs`` with columns key, size, body."""
    anchors = docs.where(F.col("size") >= width).mapInPandas(
        lambda it: _anchor_rows(it, width, gram),
        "h long, fp long, key long, size int, start int, windows short, off short")
    # stored, so that the join below has an exchange of its own on either side and AQE may split a hot value
    shared = materialise(anchors.groupBy("h").count().where("count > 1").select("h"), "shared")
    found = materialise(anchors.join(shared, "h"), "anchors")
    classes = (found.groupBy("h", "fp").agg(F.count("*").alias("n"),
                                            F.min(F.struct("key", "size", "start", "windows", "off")).alias("at"))
               .select("h", "fp", "n", "at.*"))
    classes = materialise(classes, "classes")
    spread = classes.groupBy("h").count().where(F.col("count") > spread_classes).select("h", F.lit(True).alias("spread"))
    total = classes.agg(F.sum(F.col("windows") + width)).first()[0] or 0
    shards = max(1, -(-int(total) // shard_bytes))
    want = (classes.join(spread, "h", "left").withColumn("spread", F.coalesce("spread", F.lit(False)))
            .withColumn("shard", F.when(F.col("spread"), F.pmod(F.xxhash64("h", "fp"), F.lit(shards)))
                        .otherwise(F.pmod(F.xxhash64("h"), F.lit(shards))))
            .groupBy("key", "size").agg(F.collect_list(F.struct(
                "h", "fp", "n", "start", "windows", "off", "spread", "shard")).alias("want")))

    def cut(batches):
        for pdf in batches:
            rows = [(w["h"], w["fp"], w["n"], w["windows"], w["off"], w["spread"], w["shard"],
                     body[w["start"]:w["start"] + w["windows"] - 1 + width])
                    for body, ws in zip(pdf["body"], pdf["want"]) for w in ws]
            yield pd.DataFrame(rows, columns=["h", "fp", "n", "windows", "off", "spread", "shard", "body"])

    segments = docs.join(want, ["key", "size"]).select("body", "want").mapInPandas(
        cut, "h long, fp long, n long, windows short, off short, spread boolean, shard long, body binary")
    judged = materialise(segments.groupBy("shard").applyInPandas(
        lambda pdf: _shard(pdf, width, gram, shards),
        "band long, h long, fp long, runs array<int>, names binary"), "judged")
    across = (judged.where("band >= 0").groupBy("band")
              .applyInPandas(lambda pdf: _merge(pdf, width, gram), "h long, fp long, o int")
              .join(classes.select("h", "fp", "off"), ["h", "fp"])
              .select("h", "fp", F.array(F.col("off") - F.col("o"), F.col("off") - F.col("o") + 1).alias("runs")))
    local = judged.where("band < 0 and size(runs) > 0").select("h", "fp", "runs")
    return (found.select("h", "fp", "key", "size", "start").join(local.unionByName(across), ["h", "fp"])
            .groupBy("key", "size").agg(F.collect_set(F.struct("start", "runs")).alias("spans")))


def _merged(spans, width: int) -> list[tuple[int, int]]:
    """Removed byte ranges of one document, merged where they touch."""
    got = sorted((s["start"] + s["runs"][k], s["start"] + s["runs"][k + 1] - 1 + width)
                 for s in spans for k in range(0, len(s["runs"]), 2))
    out: list[tuple[int, int]] = []
    for a, b in got:
        if out and a <= out[-1][1]:
            out[-1] = (out[-1][0], max(b, out[-1][1]))
        else:
            out.append((a, b))
    return out


def remove_repeats(spark: SparkSession, docs: DataFrame, id_col: str = "doc_id", text_col: str = "text",
                   width: int = 200, with_kept: bool = True, **tuning) -> DataFrame:
    """One row per row of ``docs``: id, n_bytes, n_removed, n_spans, kept_sha256, the removed
    ``spans`` (array of [start, end) byte offsets) and, with ``with_kept``, the ``kept`` bytes.

    Texts are UTF-8 bytes.  A null text counts as empty; a text under ``width`` bytes
    loses nothing.  Repeated rows are copies of each other, so all their long texts go;
    null ids are kept as they are.  An empty table gives an empty result.
    Columns other than id and text are ignored.
    """
    prepare(spark)
    body = utf8(text_col)
    rows = docs.select(F.col(id_col).alias("id"), body.alias("body"), F.xxhash64(F.col(id_col), body).alias("key"),
                       F.octet_length(body).alias("size"))
    runs = repeated_runs(spark, rows.select("key", "size", "body"), width, **tuning)

    def finish(batches):
        for pdf in batches:
            out = {k: [] for k in ("n_bytes", "n_removed", "n_spans", "kept_sha256", "spans", "kept")}
            for body, spans in zip(pdf["body"], pdf["spans"]):
                cuts = _merged(spans, width) if spans is not None else []
                edge = [0, *(x for c in cuts for x in c), len(body)]
                kept = b"".join(body[a:b] for a, b in zip(edge[::2], edge[1::2]))
                for k, v in zip(out, (len(body), len(body) - len(kept), len(cuts), hashlib.sha256(kept).hexdigest(),
                                      [list(c) for c in cuts], kept if with_kept else None)):
                    out[k].append(v)
            yield pd.DataFrame({"id": pdf["id"], **out})

    kind = docs.schema[id_col].dataType.simpleString()
    return (rows.join(runs, ["key", "size"], "left").select("id", "body", "spans")
            .mapInPandas(finish, f"id {kind}, n_bytes long, n_removed long, n_spans long, kept_sha256 string, "
                                 "spans array<array<long>>, kept binary")
            .withColumnRenamed("id", id_col))

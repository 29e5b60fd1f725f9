"""Near-duplicate vectors by randomised-rotation binary codes.

Unit vectors are rotated (and padded) by a seeded random orthonormal map; the signs are the code, and
the inner product of the vector with its own code is stored as correction factor.  For
a rotated vector q and a stored vector o, <q, code(o)> / factor(o) is an unbiased estimate of their cosine, with an error of
about sqrt(1 - factor^2) / factor / sqrt(bits - 1).  Pairs whose upper confidence bound reaches the threshold are recomputed
exactly, all others are dropped.

Pairs are looked for where codes agree on a whole band of bits; the number of bands follows from the threshold, the
band's bits and the recall asked for, and the bits from the number of vectors, so buckets stay
small.  Equal vectors are one class from the start.  A bucket above ``BUCKET`` members is cut into blocks whose
pairs are dealt to many tasks; a task returns link counts and a spanning forest, never its pairs.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import materialise, prepare
from .graph import components

BUCKET = 4096
SPREAD = 4.0  # half width of the confidence interval in standard errors
RECALL = 0.9999  # chance that a pair right at the threshold shares a band
TASK_ROWS = 8192


def rotation(bits: int, dims: int, seed: int = 11) -> np.ndarray:
    """bits x dims matrix with orthonormal columns."""
    q, r = np.linalg.qr(np.random.default_rng(seed).normal(size=(bits, dims)))
    return q * np.sign(np.diag(r))


def bands_for(rows: int, threshold: float, recall: float = RECALL) -> tuple[int, int]:
    """(bits of a band, number of bands) for groups of up to ``rows`` vectors."""
    width = min(30, max(4, math.ceil(math.log2(max(rows, 1) / 64 + 1))))
    same = (1 - math.acos(threshold) / math.pi) ** width
    return width, max(1, math.ceil(math.log(1 - recall) / math.log(1 - same)))


def unit(x: np.ndarray) -> np.ndarray:
    x = x / np.abs(x).max(axis=1, keepdims=True)
    return x / np.sqrt((x * x).sum(1, keepdims=True))


def encode(x: np.ndarray, turn: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Sign bits (packed) and correction factors of unit vectors."""
    y = x @ turn.T
    return np.packbits(y >= 0, axis=1), np.abs(y).sum(1) / math.sqrt(turn.shape[0])


def bucket_links(x: np.ndarray, code: np.ndarray, factor: np.ndarray, key: np.ndarray, band: int, turn: np.ndarray,
                 threshold: float, side: np.ndarray | None = None, rows: int = 512):
    """Linked pairs of one bucket (i < j) whose first common band is ``band``; with ``side``, only pairs across sides."""
    bits = turn.shape[0]
    signs = np.unpackbits(code, axis=1, count=bits).astype(np.float32) * 2 - 1
    error = SPREAD * np.sqrt(np.maximum(1 - factor ** 2, 0)) / factor / math.sqrt(bits - 1)
    q = (x @ turn.T).astype(np.float32)
    left, right = [], []
    for lo in range(0, len(x), rows):
        estimate = (q[lo:lo + rows] @ signs.T) / (math.sqrt(bits) * factor)
        i, j = np.nonzero(estimate >= threshold - error - 1e-4)
        i += lo
        ok = i < j if side is None else (i < j) & (side[i] != side[j])
        i, j = i[ok], j[ok]
        for a in range(0, len(i), 1 << 16):
            p, r = i[a:a + (1 << 16)], j[a:a + (1 << 16)]
            exact = np.einsum("ij,ij->i", x[p], x[r]) >= threshold
            p, r = p[exact], r[exact]
            first = (key[p] == key[r]).argmax(1) == band
            left.append(p[first])
            right.append(r[first])
    return (np.concatenate(left), np.concatenate(right)) if left else (np.zeros(0, np.int64), np.zeros(0, np.int64))


def forest(n: int, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Least index reachable from each of n nodes by the pairs."""
    root = np.arange(n)
    while len(a):
        low = np.minimum(root[a], root[b])
        np.minimum.at(root, root[a], low)
        np.minimum.at(root, root[b], low)
        while (root[root] != root).any():
            root = root[root]
        live = root[a] != root[b]
        a, b = a[live], b[live]
    return root


def _task(pdf: pd.DataFrame, turn: np.ndarray, threshold: float, bands: int) -> pd.DataFrame:
    out = []
    for (_, band), own in pdf.groupby(["bucket", "band"], sort=False):
        if len(own) < 2:
            continue
        x = unit(np.stack([np.frombuffer(v, "f8") for v in own["x"]]))
        code = np.stack([np.frombuffer(v, np.uint8) for v in own["code"]])
        key = np.stack([np.frombuffer(v, np.int32) for v in own["keys"]])
        side = own["side"].to_numpy()
        i, j = bucket_links(x, code, own["factor"].to_numpy(), key, band, turn, threshold, side if (side != side[0]).any() else None)
        if not len(i):
            continue
        many, n = own["m"].to_numpy(), len(own)
        links = np.bincount(i, many[j], minlength=n) + np.bincount(j, many[i], minlength=n)
        root, cid = forest(n, i, j), own["cid"].to_numpy()
        hit = np.flatnonzero(links)
        out.append(pd.DataFrame({"a": cid[hit], "b": cid[root[hit]], "links": links[hit].astype(np.int64)}))
    return pd.concat(out) if out else pd.DataFrame({"a": [], "b": [], "links": []}, dtype=np.int64)


def near_vectors(spark: SparkSession, vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding",
                 label_col: str = "label", threshold: float = 0.93, recall: float = RECALL, bucket: int = BUCKET) -> DataFrame:
    """One row per row of ``vectors``: id, n_links (other rows linked directly), component_id (least id reachable by links,
    itself included), kept (id = component_id).

    Rows link when their labels are equal and not null, their vectors have the same length, and the cosine is at least
    ``threshold``.  A vector that is null, empty, zero, or holds a null or non-finite component links with nothing.
    Repeated rows link with each other.  Null ids name no component unless there is no other.  An empty table gives an
    empty result; other columns are ignored.
    """
    prepare(spark)
    vector = F.col(vector_col).cast("array<double>")
    odd = F.exists(vector, lambda v: v.isNull() | F.isnan(v) | (F.abs(v) == float("inf")))
    ok = (F.col(label_col).isNotNull() & vector.isNotNull() & ~F.coalesce(odd, F.lit(True))
          & F.coalesce(F.exists(vector, lambda v: v != 0), F.lit(False)))
    rows = vectors.select(F.col(id_col).alias("id"), F.when(ok, F.col(label_col).cast("string")).alias("of"), F.when(ok, vector).alias("x"))
    rows = rows.withColumn("cid", F.when(F.col("x").isNotNull(), F.xxhash64("of", "x")))
    classes = materialise(rows.where("cid is not null").groupBy("cid").agg(
        F.count("*").alias("m"), F.min("id").alias("id"), F.first("of").alias("of"), F.first("x").alias("x")), "vectors")
    groups = classes.groupBy("of", F.size("x").alias("dims")).count().groupBy("dims").agg(F.max("count").alias("most")).collect()
    found = None
    for g in groups:  # one pass per vector length; a table has one as a rule
        width, bands = bands_for(g["most"], threshold, recall)
        bits = -(-max(256, width * bands, g["dims"]) // 64) * 64
        turn = rotation(bits, g["dims"])
        part = _links(spark, classes.where(F.size("x") == g["dims"]), turn, width, bands, threshold, bucket)
        found = part if found is None else found.unionByName(part)
    if found is None:
        return rows.select(F.col("id").alias(id_col), F.lit(0).cast("long").alias("n_links"), F.col("id").alias("component_id"),
                           F.lit(True).alias("kept"))
    found = materialise(found, "links")
    links = found.groupBy(F.col("a").alias("cid")).agg(F.sum("links").alias("links"))
    comp = components(found.where("a <> b").select("a", "b").distinct()).withColumnRenamed("id", "cid")
    named = (classes.select("cid", "m", "id").join(links, "cid", "left").join(comp, "cid", "left")
             .withColumn("comp", F.coalesce("comp", "cid")))
    least = named.groupBy("comp").agg(F.min("id").alias("component_id"))
    named = named.join(least, "comp").select("cid", (F.coalesce("links", F.lit(0)) + F.col("m") - 1).alias("n_links"), "component_id")
    out = rows.select("id", "cid").join(named, "cid", "left")
    comp_id = F.when(F.col("cid").isNull(), F.col("id")).otherwise(F.col("component_id"))
    return out.select(F.col("id").alias(id_col), F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"),
                      comp_id.alias("component_id"), F.coalesce(F.col("id") == comp_id, F.lit(True)).alias("kept"))


def _links(spark, classes: DataFrame, turn: np.ndarray, width: int, bands: int, threshold: float, bucket: int) -> DataFrame:
    """(a, b, links): partial link counts of class a, and b, a member of its component."""
    weights = (1 << np.arange(width)).astype(np.int64)

    def index(batches):
        for pdf in batches:
            if not len(pdf):
                continue
            x = unit(np.stack([np.asarray(v, np.float64) for v in pdf["x"]]))
            code, factor = encode(x, turn)
            bit = np.unpackbits(code, axis=1)[:, :width * bands].reshape(len(x), bands, width)
            yield pd.DataFrame({"cid": pdf["cid"], "of": pdf["of"], "m": pdf["m"], "x": [v.tobytes() for v in x], "factor": factor,
                                "code": [c.tobytes() for c in code], "keys": [k.tobytes() for k in (bit @ weights).astype(np.int32)],
                                "key": (bit @ weights).astype(np.int32).tolist()})

    coded = materialise(classes.select("cid", "of", "m", "x").mapInPandas(
        index, "cid long, of string, m long, x binary, factor double, code binary, keys binary, key array<int>"), "codes")
    placed = (coded.select("cid", "of", F.posexplode("key").alias("band", "k"))
              .withColumn("bucket", F.xxhash64("of", "band", "k")).drop("k", "of"))
    sizes = placed.groupBy("bucket").count().where("count > 1")
    tasks = max(1, math.ceil(coded.count() * bands / TASK_ROWS))
    parts = F.ceil(F.col("count") / F.lit(bucket)).cast("int")
    placed = placed.join(sizes, "bucket").withColumn("parts", parts)
    side = F.when(F.col("parts") > 1, F.pmod(F.xxhash64("cid"), F.col("parts")).cast("int")).otherwise(0)
    placed = placed.withColumn("side", side)
    # a bucket of several blocks: the block pair (p, q) is a task; pairs inside block p are in the task (p, p)
    other = F.explode(F.sequence(F.lit(0), F.col("parts") - 1))
    placed = placed.select("cid", "band", "bucket", "side", "parts", other.alias("other"))
    placed = placed.withColumn("lo", F.least("side", "other")).withColumn("hi", F.greatest("side", "other"))
    placed = placed.withColumn("task", F.when(F.col("parts") > 1, F.xxhash64("bucket", "lo", "hi"))
                               .otherwise(F.pmod(F.col("bucket"), F.lit(tasks))))
    return (placed.select("cid", "band", "bucket", "side", "task")
            .join(coded.select("cid", "m", "x", "factor", "code", "keys"), "cid")
            .groupBy("task").applyInPandas(lambda pdf: _task(pdf, turn, threshold, bands), "a long, b long, links long"))

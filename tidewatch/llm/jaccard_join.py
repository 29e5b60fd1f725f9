"""Jaccard self-join of word shingles by rare-first prefix filtering.

Two sets of sizes m >= n with Jaccard similarity t or more share one of their first
n - ceil(t n) + 1 shingles in any fixed order of all shingles.  The order puts
rare shingles first: the shingles that are frequent in some block of
documents are counted over the whole corpus, and the most frequent of them come last
by count; all others come by hash.  Equal sets are one class from the start.

1. Prefix shingles of every class meet in lists.  In each list, every member is a
   candidate with the list's hub, the member that shares most of its prefix with others.
2. Candidate pairs pass the length and positional filters and share enough of their prefixes;
   each is then verified once, on the whole sets, behind the suffix filter.
3. Lists whose members are still in several components are compared in full
   across components, with the same filters, and what is left is verified.

Members of a list that are in one component already need no more comparison, so a large
group of near copies costs a number of verifications in proportion to its size.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import bound_batches, column, drop, materialise, prepare, utf8
from .graph import components
from .hashing import PrefixHash, blocks, byte_runs, join_bytes, mix

BLOCK = 1 << 20  # bytes of text hashed at once; a longer text stands alone
FREQUENT = 1 << 18  # shingles ordered by their count; the others count as rare
BLOOM_BITS = 1 << 25  # filter of candidate classes sent to the executors; only saves work
GROUP = 256  # sets verified against one partner in one task
TASK_ROWS = 4096
HUB_ROWS = 1 << 15  # list rows of one hub that are compared in one task
SKETCH = 64  # ranges of the shingle order that the suffix filter compares

_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_IS_WORD = np.ones(256, bool)
_IS_WORD[9:14] = _IS_WORD[32] = False
_STEP = np.uint64(0xD6E8FEB86659FD93)


def shingle_sets(bodies: list[bytes], words: int) -> list[np.ndarray]:
    """Sorted distinct hashes of the ``words``-word shingles of each text; a text of fewer words is one shingle."""
    data, at = join_bytes(bodies)
    data = _LOWER[data]
    start, end = byte_runs(_IS_WORD[data])
    name = PrefixHash(data).slices(start, end)
    cut = np.searchsorted(start, at)
    value = np.zeros(max(len(name) - words + 1, 0), np.uint64)
    for k in range(words):
        value = mix(value * _STEP + name[k:k + len(value)] + np.uint64(k + 1))
    out = []
    for lo, hi in zip(cut[:-1], cut[1:]):
        if hi - lo >= words:
            out.append(np.unique(value[lo:hi - words + 1]))
        else:
            one = np.full(1, hi - lo, np.uint64)
            for x in name[lo:hi]:
                one = mix(one * _STEP + x)
            out.append(one[:hi - lo])  # no words: empty
    return out


def set_id(s: np.ndarray) -> int:
    """64-bit name of a set."""
    total = np.array([s.sum(dtype=np.uint64), np.bitwise_xor.reduce(s), len(s)], np.uint64)
    return int(mix(mix(mix(total[:1]) + total[1:2]) + total[2:]).view(np.int64)[0])


def _slot(sid: np.ndarray, row: np.ndarray) -> np.ndarray:
    """Place of (set, row) in the filter of candidate classes."""
    return (mix(sid.view(np.uint64) * _STEP + row.view(np.uint64)) % np.uint64(BLOOM_BITS)).astype(np.int64)


def _sets(batches: Iterator[pd.DataFrame], words: int):
    for pdf in batches:
        bodies = list(pdf["body"])
        for lo, hi in blocks(bodies, BLOCK):
            yield pdf.iloc[lo:hi], shingle_sets(bodies[lo:hi], words)


def _rarity(s: np.ndarray, frequent: tuple[np.ndarray, np.ndarray]) -> np.ndarray:
    """Count of the frequent shingles among ``s``, 0 for the others."""
    if not len(frequent[0]):
        return np.zeros(len(s), np.int64)
    at = np.minimum(np.searchsorted(frequent[0], s), len(frequent[0]) - 1)
    return np.where(frequent[0][at] == s, frequent[1][at], 0)


def prefix_size(n: int, percent: int) -> int:
    return n - -(-percent * n // 100) + 1


def _needed(n, m, percent: int):
    """Least intersection of linked sets of sizes n and m."""
    return -(-percent * (n + m) // (100 + percent))


def _may_link(n: str, m: str, i: str, j: str, percent: int):
    """Length and positional filter as a column: sizes n, m and the places of a shared prefix shingle."""
    n, m, i, j = map(F.col, (n, m, i, j))
    need = F.ceil(percent * (n + m) / F.lit(100 + percent))
    return ((100 * F.least(n, m) >= percent * F.greatest(n, m))
            & (1 + F.least(n - i - 1, m - j - 1) >= need))


def list_pairs(pdf: pd.DataFrame, percent: int) -> pd.DataFrame:
    """Pairs across components that pass the length and positional filters and may share enough of their prefixes, for all lists
    ``g`` of one task.  Members of two components share open lists only.  If they must share c prefix shingles, the first one they
    share, in the order that ``pos`` counts, has c - 1 more open shingles behind it in either set: both filters hold for its list.
    ``rest`` is the number of a member's open shingles from the list's on, each counted once whatever its size bands."""
    pdf = pdf.drop_duplicates(["g", "id"]).sort_values(["g", "n", "id"])
    g, ids, comp = (pdf[c].to_numpy() for c in ("g", "id", "comp"))
    n, pos, rest = (pdf[c].to_numpy(np.int64) for c in ("n", "pos", "rest"))
    left = -(-percent * n // 100) - 1  # beyond the prefix
    begin = np.searchsorted(g, g)  # first member of the list
    found = []
    for k in range(len(ids)):
        lo = begin[k] + np.searchsorted(n[begin[k]:k], -(-percent * n[k] // 100))  # length filter: sizes are sorted
        if lo < k:
            need = _needed(n[lo:k], n[k], percent)
            ok = ((comp[lo:k] != comp[k]) & (np.minimum(n[lo:k] - pos[lo:k], n[k] - pos[k]) >= need)
                  & (np.minimum(rest[lo:k], rest[k]) >= need - np.maximum(left[lo:k], left[k])))
            j = lo + np.flatnonzero(ok)
            if len(j):
                found.append(np.stack((np.minimum(ids[j], ids[k]), np.maximum(ids[j], ids[k])), 1))
    rows = np.unique(np.concatenate(found), axis=0) if found else np.zeros((0, 2), np.int64)
    return pd.DataFrame(rows, columns=["a", "b"])


def _packed(s: np.ndarray) -> bytes:
    """Sorted set as 5-byte values: enough to tell the shingles of two sets apart."""
    return np.sort(s >> np.uint64(24)).astype(">u8").view(np.uint8).reshape(-1, 8)[:, 3:].tobytes()


def _unpacked(b: bytes) -> np.ndarray:
    out = np.zeros((len(b) // 5, 8), np.uint8)
    out[:, 3:] = np.frombuffer(b, np.uint8).reshape(-1, 5)
    return out.view(">u8").ravel().astype(np.int64)


def _ranges(s: np.ndarray) -> np.ndarray:
    return np.bincount(s >> 34, minlength=SKETCH)


def verify_groups(pdf: pd.DataFrame, percent: int) -> pd.DataFrame:
    """Pairs that link, of all groups of one task: a group is a partner ``b`` (its own row has id = b) and sets paired with it."""
    pdf = pdf.drop_duplicates(["b", "salt", "id"]).sort_values(["b", "salt"])
    b, salt, ids, packed = (pdf[c].to_numpy() for c in ("b", "salt", "id", "packed"))
    cut = np.flatnonzero(np.r_[True, (b[1:] != b[:-1]) | (salt[1:] != salt[:-1]), True][:len(b) + 1])
    links = []
    for lo, hi in zip(cut[:-1], cut[1:]):
        own = [k for k in range(lo, hi) if ids[k] == b[k]]
        if not own:
            continue
        base = _unpacked(packed[own[0]])
        ranges = _ranges(base)
        for k in range(lo, hi):
            if ids[k] != b[k]:
                s = _unpacked(packed[k])
                # suffix filter: over ranges of the order, sizes differ by no more than the sets may
                if np.abs(ranges - _ranges(s)).sum() > len(base) + len(s) - 2 * _needed(len(base), len(s), percent):
                    continue
                place = np.minimum(np.searchsorted(base, s), len(base) - 1)
                if (100 + percent) * int((base[place] == s).sum()) >= percent * (len(base) + len(s)):
                    links.append((ids[k], b[k]))
    return pd.DataFrame(np.array(links, np.int64).reshape(-1, 2), columns=["a", "b"])


def _share_prefix(pairs: DataFrame, own: DataFrame, percent: int) -> DataFrame:
    """Pairs that share enough prefix shingles.  Up to the end of the shorter reaching prefix the sets share what their
    prefixes share; beyond it, no more than that set has left."""
    left = own.select(F.col("id").alias("a"), F.col("gs").alias("ga"), F.col("n").alias("na"))
    right = own.select(F.col("id").alias("b"), F.col("gs").alias("gb"), F.col("n").alias("nb"))
    left_over = lambda c: F.ceil(percent * F.col(c) / F.lit(100)) - 1
    least = F.ceil(percent * (F.col("na") + F.col("nb")) / F.lit(100 + percent)) - F.greatest(left_over("na"), left_over("nb"))
    return (pairs.join(left, "a").join(right, "b").where(F.size(F.array_intersect("ga", "gb")) >= least).select("a", "b"))


def _tasks(rows: DataFrame) -> int:
    """Tasks of about ``TASK_ROWS`` rows each."""
    return max(1, -(-rows.count() // TASK_ROWS))


def _verified(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """Links among ``pairs`` (a, b), b being the partner; ``sets`` has (id, packed)."""
    salts = (pairs.groupBy("b").count()
             .select("b", F.ceil(F.col("count") / F.lit(GROUP)).cast("int").alias("salts")))
    members = pairs.join(salts, "b").select(F.col("a").alias("id"), "b",
                                            F.pmod(F.xxhash64("a"), F.col("salts")).cast("int").alias("salt"))
    bases = salts.select(F.col("b").alias("id"), "b", F.explode(F.sequence(F.lit(0), F.col("salts") - 1)).alias("salt"))
    tasks = _tasks(pairs)
    return (members.unionByName(bases).withColumn("task", F.pmod(F.xxhash64("b", "salt"), F.lit(tasks)))
            .join(sets.select("id", "packed"), "id")
            .groupBy("task").applyInPandas(lambda pdf: verify_groups(pdf, percent), "a long, b long"))


def jaccard_components(spark: SparkSession, docs: DataFrame, id_col: str = "doc_id", text_col: str = "text",
                       words: int = 5, percent: int = 75, keep: tuple[str, ...] = ()) -> DataFrame:
    """One row per row of ``docs``: id, n_shingles (size of the set of distinct shingles), component_id (least
    id reachable by links, itself included), component (its number; null without words), and the columns named in ``keep``.

    Two rows link when 100 * intersection >= percent * union of their shingle sets.  A null text or
    a text without words has the empty set and links with nothing; a text of fewer than ``words`` words is one shingle.
    Repeated rows are in one component.  Null ids never name a component unless it has no other id.
    Shingles and sets are compared by 64-bit hashes.  Empty tables give empty results.
    """
    prepare(spark)
    bound_batches(spark)
    body = utf8(text_col)
    rows = docs.select(F.col(id_col).alias("id"), *(F.col(c).alias(f"keep_{c}") for c in keep),
                       body.alias("body"), F.xxhash64(F.col(id_col)).alias("row"))
    kind = docs.schema[id_col].dataType.simpleString()
    kept = [(f"keep_{c}", docs.schema[c].dataType.simpleString()) for c in keep]

    def size_up(batches):
        for pdf, sets in _sets(batches, words):
            out = pdf.drop(columns=["body"]).assign(
                n=[len(s) for s in sets], sid=pd.array([set_id(s) if len(s) else None for s in sets], "Int64"), shingle=None, seen=None)
            yield out
            pool = np.concatenate(sets) if sets else np.zeros(0, np.uint64)
            value, seen = np.unique(pool, return_counts=True)
            often = seen >= 3
            if often.any():
                yield pd.DataFrame({**{c: [None] * int(often.sum()) for c in pdf.columns if c not in ("body", "row")}, "row": 0,
                                    "n": -1, "sid": None, "shingle": value[often].view(np.int64), "seen": seen[often]})

    scan = materialise(rows.mapInPandas(size_up, ", ".join(
        [f"id {kind}", *(f"{c} {t}" for c, t in kept), "row long, n long, sid long, shingle long, seen long"])), "sets")
    top = (scan.where("n < 0").groupBy("shingle").agg(F.sum("seen").alias("seen"))
           .orderBy(F.desc("seen"), "shingle").limit(FREQUENT).toArrow())
    value = top["shingle"].to_numpy().view(np.uint64)
    by = np.argsort(value)
    frequent = spark.sparkContext.broadcast((value[by], top["seen"].to_numpy()[by]))  # 4 MB at most
    rows_of = scan.where("n >= 0")

    def prefixes(batches):
        for pdf, sets in _sets(batches, words):
            parts, done = [], set()
            for s in sets:
                if not len(s) or (sid := set_id(s)) in done:
                    continue
                done.add(sid)
                rare = _rarity(s, frequent.value)
                size = prefix_size(len(s), percent)
                order = np.lexsort((s, rare))[:size]
                often = rare[order] > 0
                own = np.full(len(order), sid)
                parts.append((s[order][~often], own[~often], len(s), np.arange(size)[~often]))
                if often.any():  # lists of frequent shingles are split by size band; linked sizes are in one band or two neighbours
                    band = int(np.log(len(s)) / np.log(100 / percent))
                    for k in (band, band + 1):
                        parts.append((mix(s[order][often] + np.uint64(k + 1)), own[often], len(s), np.arange(size)[often]))
            if parts:
                yield pd.DataFrame({"g": np.concatenate([p[0] for p in parts]).view(np.int64),
                                    "id": np.concatenate([p[1] for p in parts]),
                                    "n": np.concatenate([np.full(len(p[1]), p[2], np.int32) for p in parts]),
                                    "pos": np.concatenate([p[3] for p in parts]).astype(np.int32)})

    each = Window.partitionBy("g")
    lists = materialise(rows.select("body").mapInPandas(prefixes, "g long, id long, n int, pos int")
                        .withColumn("most", F.max("id").over(each)).withColumn("least", F.min("id").over(each))
                        .where("most <> least").select("g", "id", "n", "pos").distinct(), "lists")
    own = materialise(lists.groupBy("id").agg(F.collect_list("g").alias("gs"), F.first("n").alias("n")), "prefixes")
    place = F.struct((-F.size("gs") / F.col("n")).alias("shared"), "id", "n", "pos")
    hubs = materialise(lists.join(own.select("id", "gs"), "id").select("g", place.alias("at")).groupBy("g").agg(F.min("at").alias("at"))
                       .select("g", F.col("at.id").alias("hub"), F.col("at.n").alias("hub_n"), F.col("at.pos").alias("hub_pos")), "hubs")
    tried = materialise(lists.join(hubs, "g").where("id <> hub").where(_may_link("n", "hub_n", "pos", "hub_pos", percent))
                        .select(F.col("id").alias("a"), F.col("hub").alias("b")).distinct(), "pairs")
    first_row = rows_of.where("sid is not null").groupBy("sid").agg(F.min("row").alias("row"))

    def sets_of(pairs: DataFrame) -> DataFrame:
        """(id, packed) of the classes in ``pairs``, from one more pass over the texts.  A bounded bit filter leaves most other
        sets out before they are shuffled; the join drops the rest."""
        ids = pairs.select(F.col("a").alias("sid")).unionByName(pairs.select(F.col("b").alias("sid"))).distinct()
        wanted = materialise(first_row.join(ids, "sid", "left_semi"), "wanted")

        def slots(batches):
            for pdf in batches:
                yield pd.DataFrame({"slot": _slot(pdf["sid"].to_numpy(), pdf["row"].to_numpy())})

        bits = (wanted.mapInPandas(slots, "slot long").groupBy((F.col("slot") / 64).cast("long").alias("word"))
                .agg(F.bit_or(F.expr("shiftleft(1L, cast(slot % 64 as int))")).alias("bits")).toArrow())
        bloom = np.zeros(BLOOM_BITS // 64, np.int64)
        bloom[bits["word"].to_numpy()] = bits["bits"].to_numpy()
        sent = spark.sparkContext.broadcast(bloom.view(np.uint64))

        def candidate_sets(batches):
            for pdf, sets in _sets(batches, words):
                out = [(set_id(s), r, s) for s, r in zip(sets, pdf["row"]) if len(s)]
                slot = _slot(np.array([x[0] for x in out], np.int64), np.array([x[1] for x in out], np.int64)).astype(np.uint64)
                maybe = (sent.value[(slot >> np.uint64(6)).astype(np.int64)] >> (slot & np.uint64(63))) & np.uint64(1) == 1
                out = [x for x, ok in zip(out, maybe) if ok]
                yield pd.DataFrame({"sid": np.array([x[0] for x in out], np.int64), "row": np.array([x[1] for x in out], np.int64),
                                    "packed": [_packed(x[2]) for x in out]})

        sets = rows.select("body", "row").mapInPandas(candidate_sets, "sid long, row long, packed binary")
        # rows of one id and text come once each; the join has dealt them by the same key
        once = sets.join(wanted, ["sid", "row"], "left_semi").groupBy("sid", "row").agg(F.first("packed").alias("packed"))
        out = materialise(once.select(F.col("sid").alias("id"), "packed"), "tokens")
        sent.destroy()
        drop(wanted)
        return out

    def linked(pairs: DataFrame) -> DataFrame:
        """Links among candidate pairs: shared prefixes first, then whole sets."""
        pairs = materialise(_share_prefix(pairs, own, percent), "pairs")
        sets = sets_of(pairs)
        out = materialise(_verified(pairs, sets, percent), "links")
        drop(sets, pairs)
        return out

    links = linked(tried)
    frequent.destroy()
    comp = components(links)
    open_ = lists.join(comp, "id", "left").withColumn("comp", F.coalesce("comp", "id"))
    mixed = open_.groupBy("g").agg(F.min("comp").alias("x"), F.max("comp").alias("y")).where("x <> y").select("g")
    open_ = materialise(open_.join(mixed, "g", "left_semi").join(hubs.select("g", "hub"), "g")
                        .withColumn("rest", F.dense_rank().over(Window.partitionBy("id").orderBy(F.desc("pos")))), "open")
    # lists of one hub have much the same members: together, they name each pair once
    salts = open_.groupBy("hub").count().select("hub", F.ceil(F.col("count") / F.lit(HUB_ROWS)).alias("salts"))
    tasks = _tasks(open_)
    more = (open_.join(salts, "hub").withColumn("task", F.pmod(F.xxhash64("hub", F.pmod("g", "salts")), F.lit(tasks)))
            .groupBy("task").applyInPandas(lambda pdf: list_pairs(pdf, percent), "a long, b long").distinct())
    both = tried.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"))
    more = more.join(both, ["a", "b"], "left_anti")
    extra = linked(more)
    if extra.limit(1).count():
        comp = components(links.unionByName(extra))

    names = (rows_of.where("sid is not null").groupBy("sid").agg(F.min("id").alias("id"))
             .join(comp.withColumnRenamed("id", "sid"), "sid", "left")
             .select("sid", "id", F.coalesce("comp", "sid").alias("comp")))
    least = names.groupBy("comp").agg(F.min("id").alias("component_id"))
    named = names.join(least, "comp").select("sid", "component_id", "comp")
    return (rows_of.join(named, "sid", "left")
            .select(F.col("id").alias(id_col), F.col("n").alias("n_shingles"),
                    F.when(F.col("sid").isNull(), F.col("id")).otherwise(F.col("component_id")).alias("component_id"),
                    F.col("comp").alias("component"), *(F.col(f"keep_{c}").alias(c) for c in keep)))


def one_of_each(spark: SparkSession, docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **how) -> DataFrame:
    """The rows of ``docs`` without near duplicates: of each component the row of the least id stays (null ids last, then by a
    hash of the text).  Rows without words link with nothing and stay; fully repeated rows stay once."""
    prepare(spark)
    key = F.xxhash64(F.col(id_col), utf8(text_col))
    found = materialise(jaccard_components(spark, docs.withColumn("row_key", key), id_col, text_col, keep=("row_key",), **how)
                        .select(F.col(id_col).alias("id"), "component", "row_key"), "groups")
    first = (found.where("component is not null").groupBy("component")
             .agg(F.min(F.struct(F.col("id").isNull(), "id", "row_key")).alias("least")).select("least.row_key"))
    stay = first.unionByName(found.where("component is null").select("row_key")).distinct()
    once = docs.select(F.struct(*map(column, docs.columns)).alias("row"), key.alias("row_key")).groupBy("row_key").agg(F.first("row").alias("row"))
    return once.join(stay, "row_key", "left_semi").select("row.*")

"""Benchmark decontamination with an FM-index per training shard.

A shard is a block of documents.  Its words that occur in the benchmark keep
their number, every stretch of other words becomes one end mark, and the
result is suffix sorted.  The Burrows-Wheeler transform is held in a wavelet
matrix; backward search finds the interval of every benchmark phrase by
rank queries, and sampled suffix positions locate the occurrences.  Nothing
is shuffled: shards are independent, and only the benchmark is sent out, in
parts of a checked size.
"""

from __future__ import annotations

import hashlib
from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import drop, kept_schema, kept_struct, materialise, prepare, utf8
from .hashing import PrefixHash, blocks, byte_runs, join_bytes

SHARD_BYTES = 3 << 20
SAMPLE = 16  # every 16th position of a stretch keeps its text position
PART_WORDS = 1 << 21  # benchmark words sent to the executors at once
PIECE_ITEMS = 1 << 18  # item ids of one batch of results

_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_IS_WORD = np.zeros(256, bool)
_IS_WORD[0x30:0x3A] = _IS_WORD[0x61:0x7B] = _IS_WORD[0x80:] = True


def words_of(bodies: list[bytes]) -> tuple[np.ndarray, ...]:
    """Words of all bodies: document offsets, starts, ends, hashes."""
    data, at = join_bytes(bodies)
    data = _LOWER[data]
    start, end = byte_runs(_IS_WORD[data])
    return at, start, end, PrefixHash(data).slices(start, end)


class Phrases:
    """Distinct windows of the benchmark items of one part."""

    def __init__(self, ids: list[str], bodies: list[bytes], window: int):
        at, start, _, name = words_of(bodies)
        self.vocabulary = np.unique(name)
        symbol = np.searchsorted(self.vocabulary, name).astype(np.int32) + np.int32(1)
        cut = np.searchsorted(start, at)
        size = np.diff(cut)
        item, place = _ragged(np.zeros(len(ids), np.int64), np.where(size, np.maximum(size - window + 1, 1), 0))
        k = np.arange(window)
        inside = place[:, None] + k < size[item][:, None]  # an item of fewer words is one window, padded with zeros
        rows = symbol[np.where(inside, cut[item][:, None] + place[:, None] + k, 0)] * inside if len(item) else np.zeros((0, window), np.int32)
        self.ids = np.array(ids, object)
        self.symbols, which = np.unique(rows, axis=0, return_inverse=True)
        self.length = (self.symbols > 0).sum(1)
        pair = np.unique(which.ravel() * (len(ids) + 1) + item)  # (phrase, owner), each once
        self.owner = pair % (len(ids) + 1)
        self.owner_at = np.searchsorted(pair // (len(ids) + 1), np.arange(len(self.length) + 1))

    def owners(self, phrases: np.ndarray) -> np.ndarray:
        """Items that have any of the phrases."""
        which, at = _ragged(self.owner_at[phrases], np.diff(self.owner_at)[phrases])
        return np.unique(self.owner[at])


def _ragged(first: np.ndarray, size: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For ranges [first, first + size): the index of the range and the value, one row each."""
    which = np.repeat(np.arange(len(size)), size)
    return which, np.arange(len(which)) - np.repeat(np.cumsum(size) - size, size) + first[which]


class FMIndex:
    """FM-index of stretches of symbols 1..top, each closed by an end mark 0.

    End marks compare by position, so suffixes are compared inside their stretch only."""

    def __init__(self, text: np.ndarray, top: int):
        n = len(text)
        marks = np.flatnonzero(text == 0)
        close = np.repeat(marks, np.diff(np.r_[-1, marks]))  # the end mark of each position
        order = np.argsort(text.astype(np.uint16) if top < 1 << 16 else text, kind="stable")
        rank = np.empty(n, np.int64)
        key = text[order]
        head = np.r_[True, key[1:] != key[:-1]]
        head[:len(marks)] = True  # end marks are in text order already
        rank[order] = np.maximum.accumulate(np.where(head, np.arange(n), 0))
        live, step = np.flatnonzero(~(head & np.r_[head[1:], True])), 1
        while len(live):  # Larsson-Sadakane: refine unsorted groups, doubling the depth
            pos = order[live]
            key = (rank[pos] << np.int64(32)) | rank[np.minimum(pos + step, close[pos])]
            by = np.argsort(key, kind="stable")
            pos, key = pos[by], key[by]
            order[live] = pos
            head = np.r_[True, key[1:] != key[:-1]]
            rank[pos] = np.maximum.accumulate(np.where(head, live, 0))
            live = live[~(head & np.r_[head[1:], True])]
            step *= 2
        self.n, self.levels = n, max(1, int(top).bit_length())
        count = np.bincount(text, minlength=top + 2)
        self.smaller = np.r_[0, np.cumsum(count)[:-1]]
        begin = np.r_[0, marks[:-1] + 1]
        offset = np.arange(n) - np.repeat(begin, np.diff(np.r_[-1, marks]))
        sampled = offset[order] % SAMPLE == 0  # the start of each stretch is one of them
        self.sampled = np.r_[0, np.cumsum(sampled)]
        self.positions = order[sampled]
        seq = text[order - 1]  # a start's predecessor is an end mark: walks stop before it
        self.ones, self.zeros = [], []
        for level in reversed(range(self.levels)):
            bit = (seq >> level) & 1 == 1
            self.ones.append(np.r_[0, np.cumsum(bit, dtype=np.int32)])
            self.zeros.append(n - int(self.ones[-1][-1]))
            seq = np.concatenate((seq[~bit], seq[bit]))

    def rank(self, symbol: np.ndarray, row: np.ndarray) -> np.ndarray:
        """Occurrences of each symbol before each row of the transform."""
        low = np.zeros(len(row), np.int64)
        for k in range(self.levels):
            ones, bit = self.ones[k], (symbol >> (self.levels - 1 - k)) & 1 == 1
            low = np.where(bit, self.zeros[k] + ones[low], low - ones[low])
            row = np.where(bit, self.zeros[k] + ones[row], row - ones[row])
        return row - low

    def symbol(self, row: np.ndarray) -> np.ndarray:
        out = np.zeros(len(row), np.int64)
        for k in range(self.levels):
            ones = self.ones[k]
            bit = ones[row + 1] > ones[row]
            out = out * 2 + bit
            row = np.where(bit, self.zeros[k] + ones[row], row - ones[row])
        return out

    def search(self, phrases: Phrases) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Backward search of all phrases at once: (phrase, first row, end row) of those that occur."""
        which = np.arange(len(phrases.length))
        lo, hi = np.zeros(len(which), np.int64), np.full(len(which), self.n)
        for k in reversed(range(phrases.symbols.shape[1])):
            use = phrases.length[which] > k
            c = phrases.symbols[which[use], k]
            lo[use] = self.smaller[c] + self.rank(c, lo[use])
            hi[use] = self.smaller[c] + self.rank(c, hi[use])
            there = lo < hi
            which, lo, hi = which[there], lo[there], hi[there]
        return which, lo, hi

    def locate(self, row: np.ndarray) -> np.ndarray:
        """Text positions of rows: step back to a sampled position."""
        out, steps = np.empty(len(row), np.int64), 0
        todo = np.arange(len(row))
        while len(todo):
            hit = self.sampled[row + 1] > self.sampled[row]
            out[todo[hit]] = self.positions[self.sampled[row[hit]]] + steps
            todo, row = todo[~hit], row[~hit]
            c = self.symbol(row)
            row = self.smaller[c] + self.rank(c, row)
            steps += 1
        return out


def shard_hits(bodies: list[bytes], phrases: Phrases) -> tuple[np.ndarray, list, list, list]:
    """Per document of the shard: number of words, hit word runs, their byte spans, and the phrases it has, each once and sorted."""
    at, start, end, name = words_of(bodies)
    cut = np.searchsorted(start, at)
    n_words, docs = np.diff(cut), len(bodies)
    none = n_words, [[] for _ in range(docs)], [[] for _ in range(docs)], [np.zeros(0, np.int64)] * docs
    if not len(phrases.length) or not len(name):
        return none
    place = np.minimum(np.searchsorted(phrases.vocabulary, name), len(phrases.vocabulary) - 1)
    known = phrases.vocabulary[place] == name
    word = np.flatnonzero(known)
    if not len(word):
        return none
    doc = np.repeat(np.arange(docs), n_words)[word]
    close = np.r_[(word[1:] != word[:-1] + 1) | (doc[1:] != doc[:-1]), True]  # last word of its stretch
    slot = np.arange(len(word)) + np.r_[0, np.cumsum(close)[:-1]]
    text = np.zeros(len(word) + int(close.sum()), np.int64)
    text[slot] = place[word] + 1
    index = FMIndex(text, len(phrases.vocabulary))
    phrase, lo, hi = index.search(phrases)
    which, row = _ragged(lo, hi - lo)
    first = word[np.searchsorted(slot, index.locate(row))]  # number of the first word
    phrase = phrase[which]
    cover = np.zeros(len(name) + 1, np.int64)
    np.add.at(cover, first, 1)
    np.add.at(cover, first + phrases.length[phrase], -1)
    hit = np.cumsum(cover[:-1]) > 0
    doc = np.searchsorted(cut, first, side="right") - 1
    pairs = np.unique(doc * len(phrases.length) + phrase)  # (document, phrase): owners are looked up per document
    doc = pairs // len(phrases.length)
    for d, own in zip(np.unique(doc).tolist(), np.split(pairs % len(phrases.length), np.flatnonzero(np.diff(doc)) + 1)):
        none[3][d] = own
    for d in np.unique(doc).tolist():
        a, b = byte_runs(hit[cut[d]:cut[d + 1]])
        none[1][d] = np.stack((a, b), 1).tolist()
        none[2][d] = np.stack((start[cut[d] + a] - at[d], end[cut[d] + b - 1] - at[d]), 1).tolist()
    return none


def _union(runs: list) -> list:
    out: list = []
    for a, b in sorted(map(tuple, runs)):
        if out and a <= out[-1][1]:
            out[-1][1] = max(b, out[-1][1])
        else:
            out.append([a, b])
    return out


def decontaminate(spark: SparkSession, docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id",
                  text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text",
                  window: int = 10, part_words: int = PART_WORDS, keep: tuple[str, ...] = ()) -> DataFrame:
    """One row per row of ``docs``: id, n_words, n_hit, n_items, items (sorted strings), items_sha256,
    contaminated, ``spans``, the merged [start, end) byte ranges of hit words in the UTF-8 text, and with
    ``keep`` a struct kept of the columns it names.

    Words are runs of letters, digits and non-ASCII characters, A-Z lower-cased.  A null text or a text
    without words has no words and is clean.  Items without words match nothing; items with the same
    text are all reported; items with a null id are left out of ``items`` but their words are hit.
    Empty tables give empty or clean results; other columns are ignored.

    The benchmark goes to the executors in parts of at most about ``part_words`` words, each a pass
    over the documents; a usual benchmark is one part.
    """
    prepare(spark)
    items = benchmark.select(F.col(item_col).cast("string").alias("id"), utf8(item_text_col).alias("body"))
    size = items.agg(F.sum(F.octet_length("body"))).first()[0] or 0
    parts = max(1, -(-int(size) // (part_words * 6)))  # some six bytes a word
    body = utf8(text_col)
    rows = docs.select(F.col(id_col).alias("id"), body.alias("body"), *kept_struct(docs, keep))
    kind = docs.schema[id_col].dataType.simpleString()
    kept = ["kept"] if keep else []
    found_columns = ("n_words long, n_hit long, n_items long, items array<string>, items_sha256 string, contaminated boolean, "
                     "spans array<array<long>>")
    result = ", ".join([f"id {kind}", *kept_schema(docs, keep), found_columns])

    def phrases(part: int):
        own = items.where(F.pmod(F.xxhash64("id", "body"), F.lit(parts)) == part).distinct().collect()
        return spark.sparkContext.broadcast(Phrases([r["id"] for r in own], [bytes(r["body"]) for r in own], window))

    def listed(found):
        """Item count, sorted ids and their digest."""
        found = sorted({x for x in found if x is not None}, key=lambda s: s.encode())
        return len(found), found, hashlib.sha256(",".join(found).encode()).hexdigest()

    def judged(n, runs, spans, items):
        hit = sum(b - a for a, b in runs)
        return (n, hit, *items, hit > 0, spans)

    names = [c.split()[0] for c in found_columns.split(", ")]

    def beside(pdf, out):
        return pd.concat([pdf[["id", *kept]].reset_index(drop=True), pd.DataFrame(out, columns=names)], axis=1)

    def named(df):
        return df.select(F.col("id").alias(id_col), *names, *kept)

    def search(batches, sent, of):
        """Pieces of documents with their hits and ``of`` the ids of their items, asked for once per set of phrases.
        A piece ends where its documents have ``PIECE_ITEMS`` ids, so that an item set which many documents share stays small."""
        part = sent.value
        for pdf in batches:
            bodies = list(pdf["body"])
            for lo, hi in blocks(bodies, SHARD_BYTES):
                n, runs, spans, has = shard_hits(bodies[lo:hi], part)
                known, first, items, held = {}, 0, [], 0
                for k, own in enumerate(has):
                    name = own.tobytes()
                    if name not in known:
                        ids = part.ids[part.owners(own)].tolist()
                        known = known if held else {}
                        known[name] = len(ids), of(ids)
                    held += known[name][0]
                    items.append(known[name][1])
                    if held >= PIECE_ITEMS or k == len(has) - 1:
                        cut = slice(first, k + 1)
                        yield pdf.iloc[lo:hi].iloc[cut], n[cut].tolist(), runs[cut], spans[cut], items
                        first, items, held = k + 1, [], 0

    if parts == 1:
        sent = phrases(0)

        def whole(batches):
            for pdf, *rest in search(batches, sent, listed):
                yield beside(pdf, [judged(*x) for x in zip(*rest)])

        return named(rows.mapInPandas(whole, result))

    keyed = rows.withColumn("key", F.xxhash64("body")).withColumn("size", F.octet_length("body"))

    def partial(part: int) -> DataFrame:
        """Hits of one part, written, so that only one part is on the executors at a time."""
        sent = phrases(part)

        def run(batches):
            for pdf, _, runs, _, found in search(batches, sent, list):
                out = pd.DataFrame({"key": pdf["key"], "size": pdf["size"], "runs": runs, "found": found})
                yield out[[bool(r) for r in runs]]
        hits = keyed.select("key", "size", "body").mapInPandas(run, "key long, size int, runs array<array<long>>, found array<string>")
        out = materialise(hits.distinct(), "hits")
        sent.destroy()
        return out

    hits = [partial(part) for part in range(parts)]
    found = reduce(DataFrame.unionByName, hits)
    found = materialise(found.groupBy("key", "size").agg(*(F.flatten(F.collect_list(c)).alias(c) for c in ("runs", "found"))), "found")
    drop(*hits)

    def finish(batches):
        empty = lambda v: [] if v is None else list(v)
        for pdf in batches:
            n = [len(words_of([b])[1]) for b in pdf["body"]]
            yield beside(pdf, [judged(k, _union(empty(r)), _words_joined(b, _union(empty(r))), listed(empty(f)))
                               for k, b, r, f in zip(n, pdf["body"], pdf["runs"], pdf["found"])])

    return named(keyed.join(found, ["key", "size"], "left").select("id", "body", *kept, "runs", "found").mapInPandas(finish, result))


def _words_joined(body: bytes, runs: list) -> list:
    """Byte spans of word runs."""
    _, start, end, _ = words_of([body])
    return [[int(start[a]), int(end[b - 1])] for a, b in runs]

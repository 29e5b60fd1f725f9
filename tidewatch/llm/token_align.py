"""Cross-tokenizer alignment: which tokens of one tokenizer cover the same bytes as which of another.

Both tokenizers cut the same bytes.  The cumulative byte ends of either id list become the keys of a dictionary from end to index, held
as an array with a place for every byte end; the ends that both have, the intersection of the key sets, sorted, slice both id lists into
groups over equal byte ranges.  All pairs of an A and a B token of a group are links.

An id pair's count is the number of documents that hold it linked.  The counts are made from blocks of documents:
a block counts its own pairs first, the corpus adds up the blocks' counts, and each block gets the totals of
its own pairs back.  What is shuffled is one row per block and distinct pair, not one per link.
"""

from __future__ import annotations

import hashlib
import json
import os
import re
from collections import Counter
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import bound_batches, materialise, prepare

TOKENIZERS = "/opt/tokenizers"
BYTE_BPE, PIECE_BPE = f"{TOKENIZERS}/byte_bpe_50k.json", f"{TOKENIZERS}/piece_bpe_32k.model"
BLOCK = 1 << 20  # characters of a block of documents
# Fixed value: the pattern that cuts a text before the merges of a byte-level vocabulary.
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
# Letters whose Unicode class all versions of the pattern's engines agree on: Latin, Greek, Cyrillic, dashes and quotes, kana, Han.
RARE = re.compile("[^\x00-\u024f\u0391-\u03a1\u03a3-\u03ce\u0400-\u0481\u2010-\u2027\u3041-\u3096\u30a1-\u30fa\u4e00-\u9fa5]")
LARGE = 4096  # links of a slice from which it is expanded by distinct ids
RUN = 1 << 16  # ids whose bytes are compared at once
B_BITS = 32  # an id pair is one 64-bit number: the A id, then the B id
SPACE = "▁"
_WIDTHS = {1: np.uint8, 2: np.uint16, 4: np.uint32, 8: np.int64}


def byte_letters() -> dict[str, int]:
    """The byte of each letter of a byte-level vocabulary: printable Latin-1 letters are their own bytes, the other
    bytes are the letters from 256 on, in order."""
    own = [*range(ord("!"), ord("~") + 1), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    others = [b for b in range(256) if b not in set(own)]
    return {chr(b): b for b in own} | {chr(256 + k): b for k, b in enumerate(others)}


class Spelling:
    """The bytes of every id of a vocabulary, end to end in one array."""

    def __init__(self, table: list[bytes]):
        self.flat = np.frombuffer(b"".join(table), np.uint8)
        self.length = np.array([len(t) for t in table], np.int64)
        self.start = np.cumsum(self.length) - self.length

    def ends(self, ids: np.ndarray) -> np.ndarray:
        """The cumulative byte ends of a list of ids."""
        return np.cumsum(self.length[ids])

    def gives(self, ids: np.ndarray, ends: np.ndarray, body: np.ndarray) -> bool:
        """Whether the joined bytes of the ids, whose ends are given, are ``body``."""
        if not len(ids) or ends[-1] != len(body):
            return False
        for at in range(0, len(ids), RUN):
            run, to = ids[at:at + RUN], ends[at:at + RUN]
            n = self.length[run]
            first = to[0] - n[0]
            places = np.arange(first, to[-1]) + np.repeat(self.start[run] - (to - n), n)
            if not np.array_equal(self.flat[places], body[first:to[-1]]):
                return False
        return True


class ByteLevel:
    """A byte-level BPE file: ids of whole texts, special strings as plain text, and the bytes of every id.

    Texts of common letters only take a faster encoder, which merges by rank of the result and not by list of pairs.  Both give the same
    ids if the ranks go with the ids and every entry is the merge of its own bytes: two neighbours that make up an entry
    were then merged in the order in which the entry itself is, so they are its listed pair.  This is checked.
    """

    def __init__(self, path: str):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")  # Spark runs a task a core
        from tokenizers import Tokenizer
        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.encode_special_tokens = True
        letters = byte_letters()
        entries = [self.tokenizer.id_to_token(i) or "" for i in range(self.tokenizer.get_vocab_size(with_added_tokens=True))]
        self.table = [bytes(letters[c] for c in e) if all(c in letters for c in e) else e.encode() for e in entries]
        self.ranked = self._by_rank(path, entries)

    def _by_rank(self, path: str, entries: list[str]):
        import tiktoken
        with open(path, encoding="utf-8") as f:
            stored = json.load(f)
        model, vocab, added = stored["model"], stored["model"]["vocab"], {t["id"] for t in stored.get("added_tokens", [])}
        pairs = [m if isinstance(m, list) else m.split(" ") for m in model["merges"]]
        rank = [vocab["".join(p)] for p in pairs]
        plain = [i for i in range(len(entries)) if i not in added]
        level = stored.get("pre_tokenizer") or {}
        if (rank != sorted(set(rank)) or stored.get("normalizer") or level.get("type") != "ByteLevel" or level.get("add_prefix_space")
                or not level.get("use_regex", True) or any(len(self.tokenizer.model.tokenize(entries[i])) != 1 for i in plain)):
            return None
        return tiktoken.Encoding("ranks", pat_str=PATTERN, mergeable_ranks={self.table[i]: i for i in plain}, special_tokens={})

    def ids(self, text: str) -> list[int]:
        if self.ranked and not RARE.search(text):
            return self.ranked.encode_ordinary(text)
        return self.tokenizer.encode(text, add_special_tokens=False).ids


class Pieces:
    """A piece model: ids of whole texts, and the bytes of every id."""

    def __init__(self, path: str):
        from sentencepiece import SentencePieceProcessor
        self.model = SentencePieceProcessor(model_file=path)
        self.table = [bytes([int(p[3:5], 16)]) if self.model.is_byte(i) else p.replace(SPACE, " ").encode()
                      for i, p in ((i, self.model.id_to_piece(i)) for i in range(self.model.get_piece_size()))]

    def ids(self, text: str) -> np.ndarray:
        return self.model.encode_as_numpy(text)


class Groups:
    """The ids of one text and the group ends in both lists: group g holds A ids [ends_a[g], ends_a[g + 1]) and B ids
    [ends_b[g], ends_b[g + 1])."""

    def __init__(self, a: np.ndarray, b: np.ndarray, ends_a: np.ndarray, ends_b: np.ndarray):
        self.a, self.b = a, b
        self.ends_a, self.ends_b = (np.concatenate(([0], ends)).astype(np.int64) for ends in (ends_a, ends_b))

    def __len__(self) -> int:
        return len(self.ends_a) - 1

    def slices(self) -> list[tuple[list[int], list[int]]]:
        cut = zip(self.ends_a[:-1], self.ends_a[1:], self.ends_b[:-1], self.ends_b[1:])
        return [(self.a[i:k].tolist(), self.b[j:m].tolist()) for i, k, j, m in cut]

    def links(self) -> tuple[np.ndarray, np.ndarray]:
        """Distinct id pairs linked in any group, sorted, and the links of each: every slice expanded to all its pairs."""
        n, m = np.diff(self.ends_a), np.diff(self.ends_b)
        large = n * m > LARGE
        i, j, n, m = self.ends_a[:-1][~large], self.ends_b[:-1][~large], n[~large], m[~large]
        size = n * m
        at = np.arange(size.sum()) - np.repeat(np.cumsum(size) - size, size)
        width = np.repeat(m, size)
        flat = (self.a[np.repeat(i, size) + at // width] << B_BITS) | self.b[np.repeat(j, size) + at % width]
        pairs, links = np.unique(flat, return_counts=True)
        if not large.any():
            return pairs, links
        found = Counter(dict(zip(pairs.tolist(), links.tolist())))  # long slices by their distinct ids
        for g in np.flatnonzero(large):
            in_b = Counter(self.b[self.ends_b[g]:self.ends_b[g + 1]].tolist())
            for x, p in Counter(self.a[self.ends_a[g]:self.ends_a[g + 1]].tolist()).items():
                for y, q in in_b.items():
                    found[(x << B_BITS) | y] += p * q
        pairs = np.fromiter(found.keys(), np.int64, len(found))
        by = np.argsort(pairs)
        return pairs[by], np.fromiter(found.values(), np.int64, len(found))[by]

    def text(self, names: np.ndarray, a_size: int, b_size: int) -> bytes:
        """``a1,a2|b1;a3|b2,b3``, joined from the decimal names of :func:`names_of` in their places: before an A id stand the A ids
        before it and the B ids of earlier groups, before a B id the B ids before it and the A ids up to its group."""
        n, m = np.diff(self.ends_a), np.diff(self.ends_b)
        order = np.empty(len(self.a) + len(self.b), np.int64)
        last = np.zeros(len(self.a), np.int64)
        last[self.ends_a[1:] - 1] = a_size
        order[np.arange(len(self.a)) + np.repeat(self.ends_b[:-1], n)] = self.a + last
        last = np.zeros(len(self.b), np.int64)
        last[self.ends_b[1:] - 1] = b_size
        order[np.arange(len(self.b)) + np.repeat(self.ends_a[1:], m)] = self.b + last + 2 * a_size
        return names[order].tobytes().translate(None, b"\0")[:-1]


@lru_cache(maxsize=4)
def names_of(a_size: int, b_size: int) -> np.ndarray:
    """Decimal A ids before a comma, before a bar, then B ids before a comma, before a semicolon, filled up with zero bytes."""
    return np.array([b"%d%s" % (i, mark) for size, marks in ((a_size, (b",", b"|")), (b_size, (b",", b";"))) for mark in marks for i in range(size)])


class Encoders:
    """Both tokenizers, and the groups that they give."""

    def __init__(self, a_path: str, b_path: str):
        self.a, self.b = ByteLevel(a_path), Pieces(b_path)
        self.a_size, self.b_size = len(self.a.table), len(self.b.table)
        self.a_bytes, self.b_bytes = Spelling(self.a.table), Spelling(self.b.table)

    def groups(self, text: str) -> Groups | None:
        """The groups of a text; None if it is empty or either list of ids has not the bytes of a space and the text."""
        if not text:
            return None
        body = np.frombuffer((" " + text).encode(), np.uint8)
        a, b = np.asarray(self.a.ids(" " + text), np.int64), np.asarray(self.b.ids(text), np.int64)
        ends_a, ends_b = self.a_bytes.ends(a), self.b_bytes.ends(b)
        if not self.a_bytes.gives(a, ends_a, body) or not self.b_bytes.gives(b, ends_b, body):
            return None
        index_a, index_b = np.zeros((2, len(body) + 1), np.uint32)  # 0: no end here
        index_a[ends_a], index_b[ends_b] = np.arange(1, len(a) + 1), np.arange(1, len(b) + 1)
        common = np.flatnonzero((index_a > 0) & (index_b > 0))
        return Groups(a, b, index_a[common], index_b[common])


@lru_cache(maxsize=4)
def encoders(a_path: str, b_path: str) -> Encoders:
    return Encoders(a_path, b_path)


class Block:
    """Documents under way: their digests, and their links by pair."""

    def __init__(self):
        self.rows, self.pairs, self.links, self.held, self.size = [], [], [], [], 0

    def add(self, key, groups: Groups | None, size: int, sizes: tuple[int, int], with_groups: bool) -> None:
        self.size += size
        if groups is None:
            pairs = links = np.zeros(0, np.int64)
            self.rows.append((key, 0, 0, 0, 0, "", "" if with_groups else None))
        else:
            pairs, links = groups.links()
            text = groups.text(names_of(*sizes), *sizes)
            self.rows.append((key, len(groups.a), len(groups.b), len(groups), int(links.sum()), hashlib.sha256(text).hexdigest(),
                              text.decode() if with_groups else None))
        self.pairs.append(pairs)
        self.links.append(links)
        self.held.append(len(pairs))

    def packed(self, name: str) -> dict:
        """One row: documents as lists; the block's distinct pairs, the documents that hold each, and each document's
        pairs as places among them with their links."""
        flat = np.concatenate(self.pairs) if self.pairs else np.zeros(0, np.int64)
        pairs, place, held_by = np.unique(flat, return_inverse=True, return_counts=True)
        place = place.astype(np.uint16 if len(pairs) < 1 << 16 else np.uint32)
        links = np.concatenate(self.links) if self.links else np.zeros(0, np.int64)
        links = links.astype(next(t for t in (np.uint8, np.uint16, np.uint32, np.int64) if not len(links) or links.max() <= np.iinfo(t).max))
        keys, n_a, n_b, n_groups, n_links, sha, text = (list(x) for x in zip(*self.rows))
        return {"block": name, "keys": keys, "n_a": n_a, "n_b": n_b, "n_groups": n_groups, "n_links": n_links, "sha": sha, "groups": text,
                "held": self.held, "place": place.tobytes(), "wide_place": place.itemsize, "links": links.tobytes(),
                "wide_links": links.itemsize, "pairs": pairs.astype("<i8").tobytes(), "held_by": held_by.astype("<i4").tobytes()}


def _value_sums(row, counts: pd.DataFrame) -> tuple[np.ndarray, np.ndarray]:
    """(best links, sum of counts over links) of every document of a block."""
    places = np.frombuffer(row["place"], _WIDTHS[row["wide_place"]])
    links = np.frombuffer(row["links"], _WIDTHS[row["wide_links"]]).astype(np.int64)
    by = counts.sort_values("pair")
    seen, best = by["seen"].to_numpy(np.int64), by["best"].to_numpy(bool)
    cut = np.r_[0, np.cumsum(np.asarray(row["held"], np.int64))]
    total = lambda x: np.diff(np.r_[0, np.cumsum(x)][cut])
    return total(np.where(best[places], links, 0)), total(seen[places] * links)


def align_tokens(spark: SparkSession, docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", a_path: str = BYTE_BPE,
                 b_path: str = PIECE_BPE, block: int = BLOCK, with_groups: bool = True) -> tuple[DataFrame, DataFrame]:
    """(documents, pairs) of the alignment of byte-level tokenizer A and piece tokenizer B.

    documents, one row per row of ``docs``: id, n_a, n_b, n_groups, n_links, n_best (links whose pair has the highest count of its
    A id, ties included), count_sum (counts over links), groups_sha256, and with ``with_groups`` groups: the ids of every group
    as ``a1,a2|b1;a3|b2,b3``.  pairs: a_id, b_id, documents (that hold the pair linked), best.

    A reads a space and the text, B the text, before which it puts its own space; strings of special tokens are plain text.  A text that is null or
    empty, or that a tokenizer does not give back byte for byte, has no tokens: zeros and an empty digest.  Repeated rows
    are documents of their own.  Null ids stay.  Empty tables give empty results.

    A task holds a block of about ``block`` characters, or one longer text.  The table of one A id's pairs is bounded by
    the vocabulary of B.  Blocks are stored before their names are used, so a rerun task can't rename them.
    """
    prepare(spark)
    bound_batches(spark)
    kind = docs.schema[id_col].dataType.simpleString()
    rows = docs.select(F.col(id_col).cast("string").alias("id"), F.col(text_col).cast("string").alias("text"))

    def encode(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        part, made, now = TaskContext.get().partitionId(), 0, Block()
        of = encoders(a_path, b_path)
        for pdf in batches:
            for key, text in zip(pdf["id"], pdf["text"]):
                text = text or ""
                now.add(key, of.groups(text), len(text), (of.a_size, of.b_size), with_groups)
                if now.size >= block:
                    yield pd.DataFrame([now.packed(f"{part}-{made}")])
                    made, now = made + 1, Block()
        if now.rows:
            yield pd.DataFrame([now.packed(f"{part}-{made}")])

    blocks = materialise(rows.mapInPandas(encode, (
        "block string, keys array<string>, n_a array<long>, n_b array<long>, n_groups array<long>, n_links array<long>, sha array<string>, "
        "groups array<string>, held array<long>, place binary, wide_place int, links binary, wide_links int, pairs binary, held_by binary")), "blocks")

    def unpack(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for name, pairs, held_by in zip(pdf["block"], pdf["pairs"], pdf["held_by"]):
                pair = np.frombuffer(pairs, "<i8")
                yield pd.DataFrame({"block": name, "pair": pair, "held_by": np.frombuffer(held_by, "<i4").astype(np.int64)})

    own = blocks.select("block", "pairs", "held_by").mapInPandas(unpack, "block string, pair long, held_by long")
    counts = own.groupBy("pair").agg(F.sum("held_by").alias("seen"))
    of_a = Window.partitionBy(F.shiftright("pair", B_BITS))
    counts = materialise(counts.withColumn("best", F.col("seen") == F.max("seen").over(of_a)), "pair-counts")
    given = own.select("block", "pair").join(counts, "pair")

    def finish(key, block_rows: pd.DataFrame, totals: pd.DataFrame) -> pd.DataFrame:
        row = block_rows.iloc[0]
        best, total = _value_sums(row, totals)
        return pd.DataFrame({"id": list(row["keys"]), "n_a": row["n_a"], "n_b": row["n_b"], "n_groups": row["n_groups"], "n_links": row["n_links"],
                             "n_best": best, "count_sum": total, "groups_sha256": list(row["sha"]), "groups": list(row["groups"])})

    found = (blocks.drop("pairs", "held_by").groupBy("block").cogroup(given.groupBy("block"))
             .applyInPandas(finish, "id string, n_a long, n_b long, n_groups long, n_links long, n_best long, count_sum long, "
                                    "groups_sha256 string, groups string"))
    out = found.select(F.col("id").cast(kind).alias(id_col), *(c for c in found.columns if c != "id" and (with_groups or c != "groups")))
    pairs = counts.select(F.shiftright("pair", B_BITS).cast("int").alias("a_id"), F.col("pair").bitwiseAND((1 << B_BITS) - 1).cast("int").alias("b_id"),
                          F.col("seen").alias("documents"), "best")
    return out, pairs

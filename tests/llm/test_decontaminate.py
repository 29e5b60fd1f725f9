"""FM-index decontamination against a scan of all windows."""

import hashlib
import random
import re

import numpy as np
import pytest

from tidewatch.llm import decontaminate as D
from tidewatch.llm.decontaminate import FMIndex, decontaminate

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
ASCII = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def words(t):
    return WORD.findall((t or "").translate(ASCII))


def brute(docs, items):
    grams = {}
    for i, t in items:
        w = words(t)
        for p in range(max(1, len(w) - 9) if w else 0):
            grams.setdefault(tuple(w[p:p + 10]), set()).add(i)
    sizes = {len(g) for g in grams}
    out = []
    for i, t in docs:
        w, hit, found = words(t), set(), set()
        for n in sizes:
            for p in range(len(w) - n + 1):
                g = tuple(w[p:p + n])
                if g in grams:
                    hit |= set(range(p, p + n))
                    found |= {str(x) for x in grams[g] if x is not None}
        s = ",".join(sorted(found, key=str.encode))
        out.append((i, len(w), len(hit), len(found), hashlib.sha256(s.encode()).hexdigest(), bool(hit)))
    return sorted(out, key=str)


COLS = ("doc_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated")


def corpus():
    rnd = random.Random(3)
    voc = [f"w{k}é" if k % 3 else f"W{k}" for k in range(25)]
    say = lambda n: rnd.choice([" ", ", ", "\n"]).join(rnd.choice(voc) for _ in range(n))
    items = [(k, say(rnd.randint(11, 40))) for k in range(12)] + [
        (50, "only three Words"), (51, "solo"), (52, ""), (53, None), (None, "no id here"), (54, say(10))]
    items.append((99, items[0][1]))
    docs = [(k, " ".join(x for _ in range(4) for x in (say(rnd.randint(0, 30)), rnd.choice(items[:12])[1][rnd.randint(0, 30):])))
            for k in range(40)]
    docs += [(100, None), (101, ""), (102, "Only; three words solo"), (103, items[1][1].upper()), (None, "no id HERE"),
             (104, "... --"), docs[0], docs[0], (105, "only three"), (106, "a b " * 3000 + items[2][1])]
    return docs, items


@pytest.mark.parametrize("k", [{}, {"part_words": 20}])
def test_against_scan(spark, k):
    docs, items = corpus()
    d = spark.createDataFrame([(i, t, 1, "z") for i, t in docs], "doc_id long, text string, key int, body string")
    b = spark.createDataFrame(items, "item_id long, text string")
    got = decontaminate(spark, d, b, **k)
    assert sorted((tuple(r[c] for c in COLS) for r in got.collect()), key=str) == brute(docs, items)
    for r in got.where("doc_id = 103 or doc_id = 102").collect():
        raw = dict(docs)[r.doc_id].encode()
        assert sum(len(words(raw[a:b].decode())) for a, b in r.spans) == r.n_hit


def test_given_table(spark, sf):
    d, b = (spark.read.parquet(f"{sf}/{t}.parquet") for t in ("documents", "benchmark"))
    got = sorted((tuple(r[c] for c in COLS) for r in decontaminate(spark, d, b).collect()), key=str)
    assert got == brute([(r.doc_id, r.text) for r in d.collect()], [(r.item_id, r.text) for r in b.collect()])


def test_empty(spark):
    d = spark.createDataFrame([], "doc_id long, text string")
    b = spark.createDataFrame([], "item_id long, text string")
    assert decontaminate(spark, d, b).count() == 0
    one = spark.createDataFrame([(1, "x y")], "doc_id long, text string")
    assert [(r.n_words, r.contaminated) for r in decontaminate(spark, one, b).collect()] == [(2, False)]


def test_index_locates_every_position():
    rnd = np.random.default_rng(1)
    text = np.r_[rnd.integers(0, 4, 400), 0]
    index = FMIndex(text, 3)
    assert sorted(index.locate(np.arange(index.n)).tolist()) == list(range(len(text)))


def test_a_window_of_many_items_and_documents(spark, monkeypatch):
    """Owners are looked up once per set of phrases; results come in pieces of a bounded number of item ids."""
    opening = "one two three four five six seven eight nine ten"
    items = [(k, f"{opening} item{k}") for k in range(300)]
    docs = [(k, f"doc {k} begins {opening} and ends {opening}") for k in range(300)] + [(900, f"{opening} item7"), (901, "clean")]
    found = D.Phrases([str(i) for i, _ in items], [t.encode() for _, t in items], 10)
    n, runs, spans, has = D.shard_hits([t.encode() for _, t in docs], found)
    assert [len(h) for h in has] == [1] * 300 + [2, 0] and len(found.owners(has[0])) == 300
    monkeypatch.setattr(D, "PIECE_ITEMS", 1000)
    d, b = spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")
    assert sorted((tuple(r[c] for c in COLS) for r in decontaminate(spark, d, b).collect()), key=str) == brute(docs, items)

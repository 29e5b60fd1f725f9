"""Repeated byte strings against a dictionary of all windows."""

import hashlib
import random
import tracemalloc
from collections import defaultdict

import numpy as np
import pandas as pd
import pytest

from tidewatch.llm.suffix_dedup import _NAME, _merge, _shard, block_anchors, remove_repeats


def brute(rows, width):
    seen = defaultdict(int)
    texts = [(i, (t or "").encode()) for i, t in rows]
    for _, b in texts:
        for p in range(len(b) - width + 1):
            seen[b[p:p + width]] += 1
    out = []
    for i, b in texts:
        gone = bytearray(len(b))
        for p in range(len(b) - width + 1):
            if seen[b[p:p + width]] > 1:
                gone[p:p + width] = b"\1" * width
        kept = bytes(x for x, g in zip(b, gone) if not g)
        spans = sum(1 for k in range(len(b)) if gone[k] and (k == 0 or not gone[k - 1]))
        out.append((i, len(b), sum(gone), spans, hashlib.sha256(kept).hexdigest()))
    return sorted(out, key=str)


def got(spark, rows, **k):
    df = spark.createDataFrame([(i, t, "x") for i, t in rows], "doc_id long, text string, key string")
    return sorted(((r.doc_id, r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256)
                   for r in remove_repeats(spark, df, with_kept=False, **k).collect()), key=str)


def corpus():
    rnd = random.Random(5)
    word = lambda: "".join(rnd.choice("abcdeé") for _ in range(rnd.randint(1, 7)))
    words = [word() for _ in range(400)]
    para = lambda n: " ".join(rnd.choice(words) for _ in range(n))
    shared = [para(60) for _ in range(5)]
    rows = [(k, " ".join(para(rnd.randint(1, 60)) if rnd.random() < 0.5 else rnd.choice(shared)
                         for _ in range(rnd.randint(1, 6)))) for k in range(60)]
    rows += [(100 + k, t[:50] + "Q" + t[50:]) for k, (_, t) in enumerate(rows[:10])]  # near copies
    rows += [rows[3], rows[3], (None, rows[4][1]), (200, None), (201, ""), (202, "a" * 450), (203, "ab" * 300),
             (204, "short"), (205, shared[0][:230]), (206, shared[0][20:215])]
    return rows


@pytest.mark.parametrize("tuning", [{}, {"spread_classes": 1, "shard_bytes": 4000}])
def test_against_all_windows(spark, tuning):
    rows = corpus()
    assert got(spark, rows, **tuning) == brute(rows, 200)


def test_small_width_and_empty(spark):
    rows = corpus()[:20]
    assert got(spark, rows, width=60, gram=16) == brute(rows, 60)
    assert got(spark, []) == []


def test_on_given_table(spark, sf):
    df = spark.read.parquet(f"{sf}/documents.parquet")
    rows = [(r.doc_id, r.text) for r in df.select("doc_id", "text").collect()]
    res = remove_repeats(spark, df)
    assert sorted(((r.doc_id, r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in res.collect()), key=str) \
        == brute(rows, 200)


def test_merge_of_a_window_in_very_many_segments():
    names = [np.array([(7, 9, 1, k, 3)], _NAME).tobytes() for k in range(1500)] + [np.array([(7, 8, 2, 0, 3)], _NAME).tobytes()]
    tracemalloc.start()
    found = _merge(pd.DataFrame({"names": names}), 200, 32)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert sorted(found["fp"]) == list(range(1500)) and set(found["h"]) == {1}
    assert peak < 8 << 20  # all pairs take 75 MB


def test_a_shard_names_each_window_once():
    rnd = random.Random(4)
    say = lambda n: bytes(rnd.randrange(97, 123) for _ in range(n))
    passage, rows = say(120), []
    for _ in range(30):
        body = passage + say(60)
        a = block_anchors(np.frombuffer(body, np.uint8), np.array([len(body)]), 60, 16)
        rows += [(h, fp, 1, w, o, True, body[s:s + w - 1 + 60])
                 for h, fp, s, w, o in zip(a["h"], a["fp"], a["start"], a["windows"], a["off"])]
    pdf = pd.DataFrame(rows, columns=["h", "fp", "n", "windows", "off", "spread", "body"])
    names = np.concatenate([np.frombuffer(x, _NAME) for x in _shard(pdf, 60, 16, 3)["names"] if x is not None])
    windows = {r[6][k:k + 60] for r in rows for k in range(r[3])}
    assert len(names) == len({(x["a"], x["b"]) for x in names}) == len(windows)

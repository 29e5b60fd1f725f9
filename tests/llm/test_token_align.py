"""Operator 13: alignment against a plain scan over both token lists."""

import hashlib
import random
from collections import Counter

import pytest

from tidewatch.llm import token_align as T
from tidewatch.llm.queries import QUERIES

DOCS = "doc_id long, text string, block string, pair long"


@pytest.fixture(scope="module")
def of():
    return T.encoders(T.BYTE_BPE, T.PIECE_BPE)


def whole(of, text):
    return of.a.tokenizer.encode(" " + text, add_special_tokens=False).ids, of.b.model.encode(text)


def plain(of, text):
    """(a, b, groups) by walking both lists; None without tokens."""
    if not text:
        return None
    a, b = whole(of, text)
    body = (" " + text).encode()
    if b"".join(of.a.table[i] for i in a) != body or b"".join(of.b.table[i] for i in b) != body:
        return None
    groups, i, j, x, y, at_a, at_b = [], 0, 0, 0, 0, [], []
    while i < len(a) or j < len(b):
        if x <= y and i < len(a):
            at_a.append(a[i])
            x += len(of.a.table[a[i]])
            i += 1
        else:
            at_b.append(b[j])
            y += len(of.b.table[b[j]])
            j += 1
        if x == y:
            groups.append((at_a, at_b))
            at_a, at_b = [], []
    return a, b, groups


def brute(of, rows):
    seen, docs = Counter(), []
    for key, text in rows:
        p = plain(of, text)
        links = Counter((u, v) for x, y in p[2] for u in x for v in y) if p else Counter()
        seen.update(links.keys())
        docs.append((key, p, links))
    best = {}
    for (u, _), n in seen.items():
        best[u] = max(n, best.get(u, 0))
    out = []
    for key, p, links in docs:
        if p is None:
            out.append((key, 0, 0, 0, 0, 0, 0, ""))
            continue
        text = ";".join(f"{','.join(map(str, x))}|{','.join(map(str, y))}" for x, y in p[2])
        out.append((key, len(p[0]), len(p[1]), len(p[2]), sum(links.values()), sum(n for k, n in links.items() if seen[k] == best[k[0]]),
                    sum(n * seen[k] for k, n in links.items()), hashlib.sha256(text.encode()).hexdigest()))
    return out, seen


COLUMNS = ("doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256")


def order(rows):
    return sorted(rows, key=lambda r: (r[0] is None, r))


def test_edges_against_brute_force(spark, of):
    rows = [(1, None), (2, ""), (3, " "), (4, "hello world"), (4, "hello world"), (None, "hello there"), (5, "<|endoftext|> </s><s> <unk>"),
            (6, "a  b\t\tc\n\n d "), (7, "▁x"), (8, "日本語 café \U0001f600\U0001f600"), (9, "日" * 3000), (10, " " * 5000 + "x"),
            (11, " ".join(f"w{k}" for k in range(40_000))), (12, "'s don't ’s İ ẞ"), (2 ** 60 + 1, "big id")]
    docs = spark.createDataFrame([(*r, "b", 1) for r in rows], DOCS)
    want, seen = brute(of, rows)
    for block in (T.BLOCK, 10):
        found, pairs = T.align_tokens(spark, docs, block=block)
        got = found.collect()
        assert order([tuple(r[c] for c in COLUMNS) for r in got]) == order(want)
        assert {(r["a_id"], r["b_id"]): r["documents"] for r in pairs.collect()} == dict(seen)
    shown = {r["doc_id"]: r["groups"] for r in got}
    assert shown[2] == "" and hashlib.sha256(shown[4].encode()).hexdigest() == next(w[-1] for w in want if w[0] == 4)


def test_empty_table(spark):
    found, pairs = T.align_tokens(spark, spark.createDataFrame([], DOCS))
    assert found.count() == 0 and pairs.count() == 0


def test_whole_query_against_brute_force(spark, sf, of):
    rows = [(r["doc_id"], r["text"]) for r in spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect()]
    got = QUERIES["op13_token_alignment"](spark, sf)
    assert tuple(got.columns) == COLUMNS
    assert order(map(tuple, got.collect())) == order(brute(of, rows)[0])


def test_both_encoders_of_a_agree(of):
    assert of.a.ranked is not None
    draw = random.Random(1)
    letters = [chr(c) for c in range(0xA000) if not T.RARE.search(chr(c))]
    letters += list("  \n\t\r'sdlvrt 1a. ") * (len(letters) // 8)
    for _ in range(3000):
        text = "".join(draw.choice(letters) for _ in range(draw.randint(1, 40)))
        assert of.a.ids(text) == of.a.tokenizer.encode(text, add_special_tokens=False).ids, repr(text)


def test_long_slices_by_distinct_ids():
    import numpy as np
    a, b = np.array([1] * 200 + [2] * 100), np.array([7] * 50 + [8] * 3)
    pairs, links = T.Groups(a, b, [300], [53]).links()
    assert dict(zip(pairs.tolist(), links.tolist())) == {(1 << 32) | 7: 10_000, (1 << 32) | 8: 600, (2 << 32) | 7: 5000, (2 << 32) | 8: 300}


def test_work_beside_the_encoders_stays_small(of):
    import time
    draw = random.Random(2)
    words = ["".join(draw.choice("etaoinshrdlucmfw") for _ in range(draw.randint(1, 9))) for _ in range(5000)]
    texts = [" ".join(draw.choice(words) for _ in range(600)) for _ in range(150)]
    names = T.names_of(of.a_size, of.b_size)

    def seconds(work):
        took = []
        for _ in range(3):
            began = time.process_time()
            for text in texts:
                work(text)
            took.append(time.process_time() - began)
        return min(took)

    def whole_job(text):
        groups = of.groups(text)
        groups.links(), groups.text(names, of.a_size, of.b_size)

    assert seconds(whole_job) < 2.4 * seconds(lambda text: (of.a.ids(" " + text), of.b.ids(text)))


def test_bytes_are_compared_to_the_last(monkeypatch):
    import numpy as np
    monkeypatch.setattr(T, "RUN", 4)
    of = T.Spelling([b"a", b"bcd", b"", b"\x00\xff"])
    ids = np.array([0, 1, 2, 3, 1, 2, 2, 2, 2, 0, 3])
    body = b"abcd\x00\xffbcda\x00\xff"
    check = lambda ids, body: of.gives(ids, of.ends(ids), np.frombuffer(body, np.uint8))
    assert of.ends(ids).tolist() == [1, 4, 4, 6, 9, 9, 9, 9, 9, 10, 12] and check(ids, body)
    assert not any(check(ids, body[:k] + b"?" + body[k + 1:]) for k in range(len(body)))
    assert not check(ids, body[:-1]) and not check(ids, body + b"a") and not check(ids[:0], body)


def test_texts_that_a_tokenizer_does_not_give_back(of, monkeypatch):
    text = "a\x00b  Ünï " * 30
    assert len(of.groups(text)) == len(plain(of, text)[2])
    monkeypatch.setattr(of.b, "ids", lambda t: of.b.model.encode(t)[:-1])
    assert of.groups(text) is None
    monkeypatch.setattr(of.b, "ids", lambda t: of.b.model.encode(t)[::-1])
    assert of.groups(text) is None
    monkeypatch.setattr(of.b, "ids", lambda t: [])
    assert of.groups(text) is None

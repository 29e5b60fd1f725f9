"""Prefix-filtered Jaccard join against all pairs."""

import random
import re

import pytest

from tidewatch.llm.graph import components
from tidewatch.llm.jaccard_join import jaccard_components

WORD = re.compile(r"[^\x20\x09-\x0D]+")
ASCII = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def shingles(t):
    w = WORD.findall((t or "").translate(ASCII))
    return {tuple(w[i:i + 5]) for i in range(max(1, len(w) - 4))} if w else set()


def brute(rows):
    sets = [shingles(t) for _, t in rows]
    root = list(range(len(rows)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i, a in enumerate(sets):
        for j in range(i):
            if a and sets[j]:
                common = len(a & sets[j])
                if 100 * common >= 75 * (len(a) + len(sets[j]) - common):
                    root[find(i)] = find(j)
    least = {}
    for k, (i, _) in enumerate(rows):
        if i is not None:
            least[find(k)] = min(least.get(find(k), i), i)
    return sorted(((i, len(sets[k]), least.get(find(k))) for k, (i, _) in enumerate(rows)), key=str)


def got(spark, rows):
    df = spark.createDataFrame([(i, t, 7) for i, t in rows], "doc_id long, text string, sid int")
    return sorted((tuple(r[:3]) for r in jaccard_components(spark, df).collect()), key=str)


def corpus(seed):
    rnd = random.Random(seed)
    voc = [f"w{k}" for k in range(300)]
    say = lambda n: [rnd.choice(voc) for _ in range(n)]
    line = say(20)
    rows = []
    for k in range(25):
        base = say(rnd.choice([6, 15, 60, 200]))
        rows.append(base)
        for _ in range(rnd.randint(0, 6)):  # chains of copies around the threshold
            c = list(rnd.choice([base, rows[-1]]))
            for _ in range(rnd.randint(0, max(1, len(c) // 25))):
                c[rnd.randrange(len(c))] = rnd.choice(voc)
            rows.append(c + (line if rnd.random() < 0.3 else []))
    return [(1000 - k, " ".join(r)) for k, r in enumerate(rows)]


@pytest.mark.parametrize("seed", [1, 2])
def test_against_all_pairs(spark, seed):
    rows = corpus(seed)
    rows += [rows[0], (5000, rows[0][1].upper()), (None, rows[1][1]), (7, None), (8, ""), (9, " \n"), (10, "one two"),
             (11, "One  TWO"), (12, "one"), (13, " "), (None, "alone in the wide world here"), (14, "x " * 9000)]
    assert got(spark, rows) == brute(rows)


def test_given_table_and_empty(spark, sf):
    df = spark.read.parquet(f"{sf}/documents.parquet")
    assert sorted((tuple(r[:3]) for r in jaccard_components(spark, df).collect()), key=str) == brute(
        [(r.doc_id, r.text) for r in df.collect()])
    assert got(spark, []) == []


def test_components_of_a_chain(spark):
    edges = spark.createDataFrame([(k + 1, k) for k in range(10, 60)] + [(100, 101)], "a long, b long")
    found = dict(map(tuple, components(edges).collect()))
    assert found == {**{k: 10 for k in range(10, 61)}, 100: 100, 101: 100}


def test_pairs_at_the_threshold_whose_common_shingles_are_frequent(spark):
    rnd = random.Random(3)
    say = lambda n: [f"v{rnd.randrange(10 ** 9)}" for _ in range(n)]
    docs = []
    for _ in range(16):
        common, other = say(94), say(70)  # 90 common shingles of 105: exactly 0.75
        docs += [common + say(15), common + say(15)]
        for k in (56, 57):  # hubs of the lists, in one size band with both; they link to neither
            docs += 2 * [common[:52] + other[:k], common[42:] + other[-k:]]
        docs += 10 * [other]
    rows = [(k, " ".join(d)) for k, d in enumerate(docs)]
    df = spark.createDataFrame(rows, "doc_id long, text string").coalesce(1)
    found = sorted((tuple(r[:3]) for r in jaccard_components(spark, df).collect()), key=str)
    assert found == brute(rows)

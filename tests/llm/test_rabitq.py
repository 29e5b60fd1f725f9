"""Near-duplicate vectors against all cosines."""

import numpy as np
import pytest

from tidewatch.llm.rabitq import bands_for, encode, near_vectors, rotation, unit


def brute(rows, t=0.93):
    n, ok = len(rows), []
    for i, v, l in rows:
        good = l is not None and v is not None and len(v) and all(x is not None and np.isfinite(x) for x in v) and any(v)
        ok.append(np.array(v, np.float32).astype(float) if good else None)
    links = [set() for _ in rows]
    for i in range(n):
        for j in range(i):
            a, b = ok[i], ok[j]
            if a is not None and b is not None and rows[i][2] == rows[j][2] and len(a) == len(b):
                if a @ b / np.sqrt((a @ a) * (b @ b)) >= t:
                    links[i].add(j)
                    links[j].add(i)
    out = []
    for i in range(n):
        seen, todo = {i}, [i]
        while todo:
            for j in links[todo.pop()] - seen:
                seen.add(j)
                todo.append(j)
        ids = [rows[j][0] for j in seen if rows[j][0] is not None]
        c = min(ids) if ids else None
        out.append((rows[i][0], len(links[i]), c, c is None or rows[i][0] is None or rows[i][0] == c))
    return sorted(out, key=str)


def run(spark, rows, **k):
    df = spark.createDataFrame([(i, v, l, 1) for i, v, l in rows], "vec_id long, embedding array<float>, label int, m int")
    return sorted(map(tuple, near_vectors(spark, df, **k).collect()), key=str)


@pytest.mark.parametrize("k", [{}, {"bucket": 8}])
def test_against_all_pairs(spark, k):
    rng = np.random.default_rng(4)
    rows = []
    for c in range(30):
        base = rng.normal(size=32)
        for _ in range(rng.integers(1, 14)):
            v = base / np.linalg.norm(base) + rng.normal(size=32) * rng.choice([0.01, 0.05, 0.07])
            rows.append((len(rows) * 3 % 1000, v.tolist(), int(c % 3)))
    rows += [rows[5], rows[5], (None, rows[6][1], rows[6][2]), (2000, None, 1), (2001, [0.0] * 32, 1), (2002, rows[0][1], None),
             (2003, [None] + [1.0] * 31, 0), (2004, [float("nan")] + [1.0] * 31, 0), (2005, [float("inf")] + [1.0] * 31, 0),
             (2006, [1.0, 2.0], 0), (2007, [1.0, 2.1], 0), (2008, [], 0), (2009, [1.0, 2.0], 1)]
    assert run(spark, rows, **k) == brute(rows)


def test_given_table_and_empty(spark, sf):
    df = spark.read.parquet(f"{sf}/embeddings.parquet")
    assert sorted(map(tuple, near_vectors(spark, df).collect()), key=str) == brute(
        [(r.vec_id, r.embedding, r.label) for r in df.collect()])
    assert run(spark, []) == []


def test_estimate_is_unbiased_and_bounded():
    rng = np.random.default_rng(9)
    x = unit(rng.normal(size=(400, 48)))
    turn = rotation(256, 48)
    code, factor = encode(x, turn)
    signs = np.unpackbits(code, axis=1).astype(float) * 2 - 1
    est = (x @ turn.T) @ signs.T / (16 * factor)
    off = ~np.eye(400, dtype=bool)
    error = (est - x @ x.T)[off]
    assert abs(error.mean()) < 0.002
    bound = 4 * np.sqrt(1 - factor ** 2) / factor / np.sqrt(255)
    assert (np.abs(est - x @ x.T) <= bound)[off].mean() > 0.999
    assert bands_for(10 ** 9, 0.93)[0] > bands_for(1000, 0.93)[0]

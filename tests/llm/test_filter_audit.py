"""Operator 11: every order of the filters against a plain loop over documents."""

from itertools import permutations

import numpy as np
import pytest

from tidewatch.llm import filter_audit as A

LABELS = "doc_id long, quality int, toxic int"
DOCS = "doc_id long, text string, source string, part string, n long"


def fails(rows):
    """Failures of every row, by plain Python."""
    least = {}
    for i, t, *_ in rows:
        if i is not None:
            least[t or ""] = min(i, least.get(t or "", i))
    out = []
    for i, t, *_ in rows:
        t = t or ""
        words = [w for w in t.replace("\t", " ").replace("\n", " ").replace("\r", " ").replace("\v", " ").replace("\f", " ").split(" ") if w]
        out.append({f for f, bad in {"A": len(words) < 200, "B": 100 * len(set(words)) < 50 * len(words),
                                     "C": 100 * sum("A" <= c <= "Z" for c in t) > 2 * len(t), "D": any(c in "#$%&*|" for c in t),
                                     "E": i is not None and i > least.get(t, i)}.items() if bad})
    return out


def brute(rows, labels):
    found = {}
    bad = fails(rows)
    for order in permutations("ABCDE"):
        alive = {}
        for (i, _, s, *_), f in zip(rows, bad):
            part = s or ""
            good, toxic = labels.get(i, (0, 0))
            at = next((k for k, x in enumerate(order) if x in f), 9)
            for k, x in enumerate(order):
                c = found.setdefault((part, "".join(order), k + 1), dict.fromkeys(A.MEASURES, 0))
                c["kept"] += at > k
                c["removed"] += at == k
                c["redundant"] += x in f and at < k
                c["unique_fails"] += f == {x}
                c["good_lost"] += at == k and good
                c["toxic_lost"] += at == k and toxic
    total = {}
    for (part, order, step), c in found.items():
        total[part, order[step - 1]] = total.get((part, order[step - 1]), 0) + c["removed"]
    for (part, order, step), c in found.items():
        c["shapley"] = total[part, order[step - 1]]
    return found


def test_every_order_matches_a_plain_loop(spark):
    long = " ".join(f"w{k}" for k in range(250))
    rows = [(1, long, "x", "p", 1), (2, long, "x", "p", 1), (2, long, "x", "p", 1), (3, long + " # A", None, "p", 1), (4, None, "", "p", 1),
            (5, "", "x", "p", 1), (6, "A B C D", "y", "p", 1), (None, long, "y", "p", 1), (7, " ".join(["same"] * 300), "y", None, None),
            (8, "é\t\n a\x1fb", "y", "p", 1), (9, "ok $ " * 200, "x", "p", 1), (10, "x" * 500_000 + " " + long * 40, "y", "p", 1)]
    labels = [(1, 1, 0), (2, 0, 1), (2, 1, None), (5, 1, 1), (99, 1, 1), (None, 1, 1)]
    known = {}
    for i, q, t in labels:
        if i is not None:
            old = known.get(i, (0, 0))
            known[i] = (max(old[0], int(q == 1)), max(old[1], int(t == 1)))
    got = A.filter_audit(spark, spark.createDataFrame(rows, DOCS), spark.createDataFrame(labels, LABELS)).collect()
    want = brute(rows, known)
    assert len(got) == len(want) == 120 * 5 * 3
    for r in got:
        assert {m: r[m] for m in A.MEASURES} == want[r["part"], r["filter_order"], r["step"]], r
        assert r["filter"] == r["filter_order"][r["step"] - 1]


def test_empty_tables(spark):
    none = spark.createDataFrame([], DOCS)
    assert A.filter_audit(spark, none, spark.createDataFrame([], LABELS)).count() == 0
    one = spark.createDataFrame([(1, "a", "s", "p", 1)], DOCS)
    got = A.filter_audit(spark, one, spark.createDataFrame([], LABELS)).where("filter = 'A'").collect()
    assert len(got) == 120 and all(r["removed"] == 1 and r["kept"] == 0 for r in got)


def test_ranks_are_a_min_plus_product():
    audit = A.Audit("ABC", list(permutations("ABC")))
    for o, order in enumerate(audit.orders):
        for m in range(8):
            steps = [k + 1 for k, f in enumerate(order) if m >> f & 1]
            assert audit.rank[o, m] == (min(steps) if steps else np.inf)
    found = audit.counts(np.ones((1, 8), np.int64), np.zeros((1, 8), np.int64), np.zeros((1, 8), np.int64))
    assert (found["kept"][0, :, -1] == 1).all() and (found["removed"].sum(2) == 7).all()


def test_own_filters_and_orders(spark):
    docs = spark.createDataFrame([(k, "x" * k, "s", "p", 1) for k in range(10)], DOCS)
    mine = {"short": lambda t: A.F.length(t) < 5, "odd": lambda t: A.F.length(t) % 2 == 1}
    got = A.filter_audit(spark, docs, spark.createDataFrame([], LABELS), filters=mine, orders=[("odd", "short")]).orderBy("step").collect()
    assert [(r["filter_order"], r["filter"], r["removed"], r["redundant"], r["kept"]) for r in got] == [
        ("odd>short", "odd", 5, 0, 5), ("odd>short", "short", 3, 2, 2)]


@pytest.mark.parametrize("copies", [3000])
def test_a_text_that_most_rows_share(spark, copies):
    rows = [(k, "same text", f"s{k % 3}", "p", 1) for k in range(copies)] + [(0, "same text", "s0", "p", 1)]
    got = A.filter_audit(spark, spark.createDataFrame(rows, DOCS), spark.createDataFrame([], LABELS)).where("filter_order = 'EABCD' and step = 1")
    assert {r["part"]: (r["removed"], r["kept"]) for r in got.collect()} == {"s0": (999, 2), "s1": (1000, 0), "s2": (1000, 0)}

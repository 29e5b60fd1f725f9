"""The lock-out rule: kernel, tables, segmented scan and stream against one loop over a user's attempts."""

import os

import numpy as np
import pandas as pd
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from tidewatch.streaming import lockout as L

MINUTE = 60_000_000


def plain(ts, ok, failed=0, lock=L.NOLOCK):
    out = []
    for t, good in zip(ts, ok):
        if lock != L.NOLOCK and lock > t:
            code = 3
        elif good:
            failed, lock, code = 0, L.NOLOCK, 0
        else:
            failed += 1
            code = 1
            if failed >= 5:
                lock, code = t + 15 * MINUTE, 2
        out.append((code, failed, lock))
    return out, failed, lock


ATTEMPTS = st.lists(st.tuples(st.sampled_from([0, 1, MINUTE, 5 * MINUTE, 15 * MINUTE - 1, 15 * MINUTE, 40 * MINUTE]),
                              st.sampled_from([True, False, False, False])), min_size=1, max_size=40)
STATE = st.tuples(st.integers(0, 8), st.integers(-MINUTE, 15 * MINUTE))


def arrays(attempts):
    return np.cumsum([g for g, _ in attempts]) + 10 ** 15, np.array([ok for _, ok in attempts], bool)


@settings(max_examples=400, deadline=None)
@given(st.lists(st.tuples(ATTEMPTS, STATE), min_size=1, max_size=4))
def test_users_of_a_batch_are_judged_apart(users):
    parts = [arrays(a) for a, _ in users]
    start = np.cumsum([0, *(len(t) for t, _ in parts[:-1])])
    failed = np.array([f for _, (f, _) in users])
    lock = np.array([L.NOLOCK if f < 5 else t[0] + ends for (_, (f, ends)), (t, _) in zip(users, parts)])
    ts, ok = np.concatenate([t for t, _ in parts]), np.concatenate([o for _, o in parts])
    got = list(zip(*(x.tolist() for x in L._Course(ts, ok, start).judge(failed, lock))))
    assert got == [row for k, (t, o) in enumerate(parts) for row in plain(t.tolist(), o.tolist(), int(failed[k]), int(lock[k]))[0]]


@settings(max_examples=400, deadline=None)
@given(st.lists(ATTEMPTS, min_size=1, max_size=4), STATE)
def test_chained_tables_give_the_state_of_one_run(pieces, state):
    ts, ok = arrays([x for p in pieces for x in p])
    failed, lock = state[0], L.NOLOCK if state[0] < 5 else int(ts[0]) + state[1]
    want = plain(ts.tolist(), ok.tolist(), failed, lock)[1:]
    at = 0
    for p in pieces:
        table = L._Course(ts[at:at + len(p)], ok[at:at + len(p)], np.zeros(1, np.int64)).table()
        failed, lock = L.through(table, failed, lock)
        at += len(p)
    assert (failed, lock) == want


def test_a_table_is_as_small_as_its_states():
    ts = np.arange(100_000) * 1000 + 10 ** 15  # a thousand attempts a second, all failures but the last
    ok = np.zeros(len(ts), bool)
    table = L._Course(ts, ok, np.zeros(1, np.int64)).table()
    assert len(table["count"]) <= len(ts) + 7
    ok[:] = True
    assert len(L._Course(ts, ok, np.zeros(1, np.int64)).table()["count"]) <= 7


@pytest.fixture(scope="module")
def attempts():
    """One user makes a third of all attempts, in long unbroken stretches."""
    rnd = np.random.default_rng(5)
    rows, key = [], 0
    for user, n in [(7, 6000), *((100 + u, int(rnd.integers(1, 60))) for u in range(400))]:
        gap = rnd.choice([0, 1_000, 30_000_000, 5 * MINUTE, 20 * MINUTE], n, p=[0.05, 0.35, 0.4, 0.15, 0.05])
        ts = 1_700_000_000_000_000 + np.cumsum(gap)
        for t, ok in zip(ts, rnd.random(n) < 0.2):
            rows.append((key, user, int(t), bool(ok)))
            key += 1
    return rows


def frame(spark, rows):
    df = spark.createDataFrame(rows, "event_id long, user_id long, us long, ok boolean")
    return df.selectExpr("event_id", "user_id", "cast(timestamp_micros(us) as timestamp_ntz) AS ts", "ok", "'x' AS outcome")


def judged(rows):
    users = {}
    for r in rows:
        users.setdefault(r[1], []).append(r)
    out = {}
    for mine in users.values():
        mine.sort(key=lambda r: (r[2], r[0]))
        for r, got in zip(mine, plain([r[2] for r in mine], [bool(r[3]) for r in mine])[0]):
            out[r[0]] = got
    return out


def codes(got):
    names = {n: k for k, n in enumerate(L._OUTCOMES)}
    us = lambda t: L.NOLOCK if t is None else int(pd.Timestamp(t).value // 1000)
    return {r["event_id"]: (names[r["outcome"]], r["failed_attempts"], us(r["locked_until"])) for r in got}


@pytest.mark.parametrize("partition_rows", [300, 1 << 18])
def test_a_hot_user_lies_in_many_partitions(spark, attempts, partition_rows):
    got = L.lockouts_batch(frame(spark, attempts), partition_rows)
    assert codes(got.collect()) == judged(attempts)


def test_nulls_repeats_and_no_rows(spark):
    rows = [(1, 1, 10, False), (1, 1, 10, False), (2, 1, 20, None), (3, 1, 30, False), (4, 1, 40, False), (5, 1, 50, True), (6, None, 60, True), (7, 2, None, False)]
    got = sorted((r["event_id"], r["outcome"], r["failed_attempts"]) for r in L.lockouts_batch(frame(spark, rows)).collect() if r["outcome"])
    assert got == [(1, "failure", 1), (1, "failure", 2), (2, "failure", 3), (3, "failure", 4), (4, "lockout", 5), (5, "locked", 5)]
    rest = [r["event_id"] for r in L.lockouts_batch(frame(spark, rows)).collect() if r["outcome"] is None]
    assert sorted(rest) == [6, 7]
    none = L.lockouts_batch(frame(spark, rows).limit(0))
    assert none.count() == 0 and none.columns == [c.split()[0] for c in L.OUT_SCHEMA.split(", ")]


def test_stream_equals_batch_and_drops_late_attempts(spark, attempts, tmp_path):
    rows = [r for r in attempts if r[1] < 140]
    order = sorted(rows, key=lambda r: (r[2], r[0]))
    cut = [order[k:k + 1500] for k in range(0, len(order), 1500)]
    late = (10 ** 6, 100, 1_600_000_000_000_000, False)  # years behind the watermark
    src = str(tmp_path / "in")
    for k, part in enumerate([*cut, [late]]):
        path = os.path.join(src, f"{k}")
        frame(spark, part).coalesce(1).write.parquet(path)
        os.utime(next(os.path.join(path, f) for f in os.listdir(path) if f.endswith(".parquet")), (k + 1, k + 1))
    stream = (spark.readStream.schema(frame(spark, cut[0]).schema).option("maxFilesPerTrigger", 1).parquet(f"{src}/*"))
    q = (L.lockouts_stream(stream, "1 hour").writeStream.format("parquet").option("path", str(tmp_path / "out"))
         .option("checkpointLocation", str(tmp_path / "ckpt")).outputMode("append").trigger(availableNow=True).start())
    q.awaitTermination()
    got = codes(spark.read.parquet(str(tmp_path / "out")).collect())
    assert got == judged(rows)

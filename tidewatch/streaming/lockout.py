"""S3: account lock-out over a login-attempt stream.

Rule (fixed values of the reference): five failed attempts lock the
account for fifteen minutes; an attempt while locked (locked_until > ts)
is ``locked`` and not counted; a success clears the counter and the
lock; lock expiry does NOT clear the counter, so the next failure locks
again at once.

Kernel: all users of a batch at once, without a loop over attempts.  A
lock is set either by the fifth of five failures in a row or by the first attempt
after a lock, if it fails; so the attempt that sets the next lock is known
for every attempt that may set one, and only the locks themselves are
walked.  What lies in between follows from running counts.

Batch: a segmented scan.  Attempts are range-partitioned by (user, time), so a user
with a third of all attempts lies in many partitions.  A partition judges
all its users but the first, whose earlier attempts may lie in the partitions
before; for that one it tabulates the state at its end for every state at its
beginning.  The tables of a user are chained over the partitions (a
row each), and the deferred attempts are judged from the states found.

Stream: ``transformWithStateInPandas`` keeps (failures, locked_until) per
user as a value state across micro-batches and drops attempts behind the watermark;
events inside a batch are ordered by event time first.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor

MAX_FAILED_ATTEMPTS = 5
LOCKOUT_MINUTES = 15
DELTA = LOCKOUT_MINUTES * 60 * 1_000_000
PARTITION_ROWS = 1 << 18

OUT_SCHEMA = ("event_id long, user_id long, ts timestamp_ntz, ok boolean, outcome string, "
              "failed_attempts long, locked_until timestamp_ntz")

_OUTCOMES = np.array(["success", "failure", "lockout", "locked"], dtype=object)
NOLOCK = np.iinfo(np.int64).min


class _Course:
    """What the attempts of consecutive users say whatever the states they begin in: for every attempt the
    failures in a row up to it, the first attempt that a lock set by it leaves open, and the attempt
    that sets the next lock after one set by it."""

    def __init__(self, ts: np.ndarray, ok: np.ndarray, start: np.ndarray):
        self.ts, self.ok, self.start, self.n = ts, ok, start, len(ts)
        self.stop = np.r_[start[1:], self.n]
        user = np.repeat(np.arange(len(start)), self.stop - start)
        self.first, self.end = start[user], self.stop[user]
        # one time axis on which users lie further apart than a lock lasts
        span = ts[self.stop - 1] - ts[start] + 2 * DELTA
        axis = ts - ts[self.first] + (np.cumsum(span) - span)[user]
        self.after = np.searchsorted(axis, axis + DELTA, "left")
        at = np.arange(self.n)
        self.in_row = at - np.maximum.accumulate(np.where(ok, at, self.first - 1))
        self._fifth = np.flatnonzero(self.in_row >= MAX_FAILED_ATTEMPTS)
        open_ = np.minimum(self.after, self.n - 1)
        self.next = np.where(self.after >= self.end, self.n,
                             np.where(ok[open_], self.from_zero(self.after + 1, self.end), self.after))

    def from_zero(self, at: np.ndarray, end: np.ndarray) -> np.ndarray:
        """The attempt that sets the next lock with no failures counted before ``at``; n if none does before ``end``."""
        where = np.searchsorted(self._fifth, at + MAX_FAILED_ATTEMPTS - 1)
        k = np.r_[self._fifth, self.n][np.minimum(where, len(self._fifth))]
        return np.where(k < end, k, self.n)

    def entry(self, failed: np.ndarray, lock: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Per user: the first attempt that is open, and the one that sets the first lock."""
        opens = self.start.copy()
        for u in np.flatnonzero(lock > self.ts[self.start]):
            opens[u] += np.searchsorted(self.ts[self.start[u]:self.stop[u]], lock[u], "left")
        here = np.minimum(opens, self.n - 1)
        needed = np.maximum(MAX_FAILED_ATTEMPTS - failed, 1)
        last = opens + needed - 1
        # failures go on from the open attempt if the row of failures at ``last`` reaches back to it
        direct = (last < self.stop) & (self.in_row[np.minimum(last, self.n - 1)] >= needed)
        success = np.flatnonzero(self.ok)
        reset = np.r_[success, self.n][np.searchsorted(success, here)]
        event = np.where(direct, last, np.where(reset < self.stop, self.from_zero(reset + 1, self.stop), self.n))
        return opens, np.where(opens < self.stop, event, self.n)

    def judge(self, failed: np.ndarray, lock: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Per attempt: outcome code, failures counted and lock after it, given each user's state before."""
        opens, first = self.entry(failed, lock)
        onward, events = self.next.tolist(), []
        for k in first.tolist():
            while k < self.n:
                events.append(k)
                k = onward[k]
        events = np.array(events, np.int64)
        edge = np.zeros(self.n + 1, np.int64)
        np.add.at(edge, events + 1, 1)
        np.add.at(edge, self.after[events], -1)
        np.add.at(edge, self.start, 1)
        np.add.at(edge, opens, -1)
        locked = np.cumsum(edge[:-1]) > 0
        fail, success = ~self.ok & ~locked, self.ok & ~locked
        at, count = np.arange(self.n), np.cumsum(fail)
        user = np.repeat(np.arange(len(self.start)), self.stop - self.start)
        before = (count - fail)[self.first] - failed[user]
        cleared = np.maximum.accumulate(np.where(success, at, -1))
        counted = count - np.where(cleared >= self.first, count[np.maximum(cleared, 0)], before)
        failure = np.maximum.accumulate(np.where(fail, at, -1))
        until = np.where(failure >= self.first, self.ts[np.maximum(failure, 0)] + DELTA, lock[user])
        until = np.where(counted >= MAX_FAILED_ATTEMPTS, until, NOLOCK)
        code = np.where(locked, 3, np.where(success, 0, np.where(counted >= MAX_FAILED_ATTEMPTS, 2, 1)))
        return code, counted, until

    def table(self) -> dict:
        """For one user: the state after the attempts for every state before them.

        Rows 0 to 4 are for that many failures and no lock.  The rows behind are for five failures or more, by the
        lock's end: row 5 + r for ends beyond ``edges`` of r.  ``reset`` says that ``count`` is the number of failures
        itself; else it is added to the number before, and a ``lock`` of NOLOCK then means that the lock before remains.
        """
        n, after, onward = self.n, self.after.tolist(), self.next.tolist()
        row = int(self.in_row[-1])
        reset, value, lock = [False] * n, [0] * n, [NOLOCK] * n
        ends = (self.ts + DELTA).tolist()
        for k in range(n - 1, -1, -1):  # of a lock set by attempt k
            to = onward[k]
            if to < n:
                direct = to == after[k]
                reset[k], lock[k] = reset[to] or not direct, lock[to]
                value[k] = value[to] if reset[to] else value[to] + (1 if direct else MAX_FAILED_ATTEMPTS)
            elif after[k] >= n:
                lock[k] = ends[k]
            else:
                reset[k], value[k] = True, min(row, n - 1 - after[k])

        def of(event: int, absolute: int | None, otherwise: int) -> tuple:
            """From a lock set by ``event`` with ``absolute`` failures (None: one more than before); without one, ``otherwise``."""
            if event >= n:
                return True, otherwise, NOLOCK
            if reset[event]:
                return True, value[event], lock[event]
            return (False, value[event] + 1, lock[event]) if absolute is None else (True, absolute + value[event], lock[event])

        rows = []
        for f in range(MAX_FAILED_ATTEMPTS):
            _, event = self.entry(np.array([f]), np.array([NOLOCK]))
            rows.append(of(int(event[0]), MAX_FAILED_ATTEMPTS, row if self.ok.any() else f + n))
        window = int(np.searchsorted(self.ts, self.ts[0] + DELTA, "left"))
        zero = self.from_zero(np.arange(window + 1) + 1, np.full(window + 1, n)).tolist()
        edges = []
        for s in range(window + 1):
            if s >= n:
                this = (False, 0, NOLOCK)
            elif self.ok[s]:
                this = of(zero[s], MAX_FAILED_ATTEMPTS, min(row, n - 1 - s))
            else:
                this = of(s, None, 0)
            if s == 0 or this != rows[-1]:
                rows.append(this)
                edges += [int(self.ts[s - 1])] if s else []
        kind, count, until = zip(*rows)
        return {"edges": edges, "reset": list(kind), "count": list(count), "lock": list(until)}


def through(table, failed: int, lock: int) -> tuple[int, int]:
    """The state after a table's attempts from the state before them."""
    row = failed
    if failed >= MAX_FAILED_ATTEMPTS:
        row = MAX_FAILED_ATTEMPTS + int(np.searchsorted(np.asarray(table["edges"], np.int64), lock, "left"))
    count, until = int(table["count"][row]), int(table["lock"][row])
    if table["reset"][row]:
        return count, until
    return failed + count, lock if until == NOLOCK else until


def _us(v) -> int:
    if v is None or pd.isna(v):
        return NOLOCK
    return int(np.datetime64(pd.Timestamp(v).to_datetime64(), "us").astype("int64"))


def _micros(ts: pd.Series) -> np.ndarray:
    return ts.to_numpy(dtype="datetime64[us]").astype("int64")


def _frame(base: pd.DataFrame, code, fails, locks) -> pd.DataFrame:
    out = base[["event_id", "user_id", "ts", "ok"]].reset_index(drop=True)
    out["outcome"] = _OUTCOMES[code]
    out["failed_attempts"] = fails
    out["locked_until"] = pd.Series(locks.astype("datetime64[us]")).where(locks != NOLOCK, pd.NaT)
    return out


def _judged(pdf: pd.DataFrame, failed: int, lock: int) -> tuple[pd.DataFrame, int, int]:
    """Rows sorted by user and time, the first user in the given state; also the last user's state."""
    users = pdf["user_id"].to_numpy()
    start = np.flatnonzero(np.r_[True, users[1:] != users[:-1]])
    before, until = np.zeros(len(start), np.int64), np.full(len(start), NOLOCK)
    before[0], until[0] = failed, lock
    code, fails, locks = _Course(_micros(pdf["ts"]), pdf["ok"].to_numpy(dtype=bool), start).judge(before, until)
    return _frame(pdf, code, fails, locks), int(fails[-1]), int(locks[-1])


def run_machine(pdf: pd.DataFrame, failed: int, locked_until):
    """One user's attempts in any order → outcome rows and final state."""
    out, failed, lock = _judged(pdf.sort_values(["ts", "event_id", "ok"], kind="stable"), failed, _us(locked_until))
    return out, failed, None if lock == NOLOCK else pd.Timestamp(np.datetime64(lock, "us"))


class LockoutProcessor(StatefulProcessor):
    """Value state of a bucket of users: each one's failures and lock, in microseconds.

    A call per user and batch costs some milliseconds whatever it judges; a bucket's users are judged at once."""

    def init(self, handle) -> None:
        self.accounts = handle.getValueState("accounts", "users array<long>, failed array<long>, lock array<long>")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timer_values) -> Iterator[pd.DataFrame]:
        state = {}
        if self.accounts.exists():
            state = {int(u): (int(f), int(t)) for u, f, t in zip(*self.accounts.get())}
        batch = pd.concat(list(rows), ignore_index=True).sort_values(["user_id", "ts", "event_id", "ok"], kind="stable")
        users = batch["user_id"].to_numpy()
        start = np.flatnonzero(np.r_[True, users[1:] != users[:-1]])
        before = [state.get(u, (0, NOLOCK)) for u in users[start].tolist()]
        failed, lock = (np.array(x, np.int64) for x in zip(*before))
        code, fails, locks = _Course(_micros(batch["ts"]), batch["ok"].to_numpy(dtype=bool), start).judge(failed, lock)
        last = np.r_[start[1:], len(users)] - 1
        state |= zip(users[last].tolist(), zip(fails[last].tolist(), locks[last].tolist()))
        failed, lock = (list(x) for x in zip(*state.values()))
        self.accounts.update((list(state), failed, lock))
        yield _frame(batch, code, fails, locks)

    def close(self) -> None:
        pass


BUCKETS = 1 << 12  # of users, whose states are stored together: fixed for the life of a stream's checkpoint
STATE_STORE = "spark.sql.streaming.stateStore.providerClass"
ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def lockouts_stream(attempts: DataFrame, late: str = "1 day") -> DataFrame:
    """Streaming operator: per-user state across micro-batches, kept in :data:`BUCKETS` buckets of users; attempts later than
    ``late`` behind the newest are dropped.  Attempts without a user or a time are no part of the stream."""
    attempts.sparkSession.conf.set(STATE_STORE, ROCKS)  # the store that value states need
    known = attempts.where("user_id is not null and ts is not null").withColumn("ok", F.coalesce("ok", F.lit(False)))
    timed = known.select("event_id", "user_id", "ts", "ok", F.col("ts").cast("timestamp").alias("at"),  # watermarks need an instant
                         F.pmod(F.xxhash64("user_id"), F.lit(BUCKETS)).cast("int").alias("bucket"))
    return timed.withWatermark("at", late).groupBy("bucket").transformWithStateInPandas(
        LockoutProcessor(), OUT_SCHEMA, "Append", "EventTime")


_SCAN = (OUT_SCHEMA + ", part int, kind string, whole boolean, edges array<long>, reset array<boolean>, count array<long>, lock array<long>")
_NOTHING = {"event_id": None, "ts": None, "ok": None, "outcome": None, "failed_attempts": None, "locked_until": None}


def _scan_partition(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Of a sorted partition: the first user's attempts as they are and their table, the other attempts judged, and the last user's state."""
    part, head, first, user, failed, lock = TaskContext.get().partitionId(), [], True, None, 0, NOLOCK

    def rows(frame: pd.DataFrame, kind: str) -> pd.DataFrame:
        for c in ("outcome", "failed_attempts", "locked_until"):
            if c not in frame:
                frame = frame.assign(**{c: None})
        return frame.assign(part=part, kind=kind, whole=None, edges=None, reset=None, count=None, lock=None)

    def tabulated(whole: bool) -> pd.DataFrame:
        ts = np.concatenate([_micros(p["ts"]) for p in head])
        ok = np.concatenate([p["ok"].to_numpy(dtype=bool) for p in head])
        table = _Course(ts, ok, np.zeros(1, np.int64)).table()
        return pd.DataFrame([{**_NOTHING, "user_id": head[0]["user_id"].iloc[0], "part": part, "kind": "head", "whole": whole, **table}])

    for pdf in batches:
        if not len(pdf):
            continue
        users = pdf["user_id"].to_numpy()
        if first:
            own = users == (head[0]["user_id"].iloc[0] if head else users[0])
            if own.any():
                head.append(pdf[own])
                yield rows(pdf[own], "deferred")
            if own.all():
                continue
            first = False
            yield tabulated(False)
            head = []
            pdf, users = pdf[~own], users[~own]
        out, after, until = _judged(pdf, failed if users[0] == user else 0, lock if users[0] == user else NOLOCK)
        user, failed, lock = users[-1], after, until
        yield rows(out, "judged")
    if head:
        yield tabulated(True)
    elif user is not None:
        yield pd.DataFrame([{**_NOTHING, "user_id": user, "part": part, "kind": "tail", "whole": False, "edges": [], "reset": [],
                             "count": [failed], "lock": [lock]}])


def _chain(pdf: pd.DataFrame) -> pd.DataFrame:
    """One user's tables in the order of partitions: the state in which each begins."""
    failed, lock, out = 0, NOLOCK, []
    for r in pdf.sort_values("part").to_dict("records"):
        if r["kind"] == "tail":
            failed, lock = int(r["count"][0]), int(r["lock"][0])
        else:
            out.append((r["part"], failed, lock))
            failed, lock = through(r, failed, lock)
    return pd.DataFrame(out, columns=["part", "failed", "begun"])


def lockouts_batch(attempts: DataFrame, partition_rows: int = PARTITION_ROWS) -> DataFrame:
    """The rule over all attempts, by user, time and event id.

    An attempt whose ``ok`` is null failed.  Attempts without a user or a time are returned without an
    outcome.  Repeated rows are attempts of their own.  A partition has about ``partition_rows`` attempts
    whoever made them; a task holds a batch of them, and of its first user all in the partition.
    """
    attempts = attempts.select("event_id", "user_id", "ts", "ok")
    known = attempts.where("user_id is not null and ts is not null").withColumn("ok", F.coalesce("ok", F.lit(False)))
    rows = known.count()
    n = max(int(attempts.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-rows // partition_rows))
    by = ["user_id", "ts", "event_id", "ok"]
    scan = known.repartitionByRange(n, *by).sortWithinPartitions(*by).mapInPandas(_scan_partition, _SCAN).checkpoint()
    begins = (scan.where("kind in ('head', 'tail')").select("user_id", "part", "kind", "edges", "reset", "count", "lock")
              .groupBy("user_id").applyInPandas(_chain, "part int, failed long, begun long"))

    def judge(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["ts", "event_id", "ok"], kind="stable")
        return _judged(pdf, int(pdf["failed"].iloc[0]), int(pdf["begun"].iloc[0]))[0]

    deferred = (scan.where("kind = 'deferred'").select("part", "event_id", "user_id", "ts", "ok")
                .join(begins, "part").groupBy("part").applyInPandas(judge, OUT_SCHEMA))
    columns = [c.split()[0] for c in OUT_SCHEMA.split(", ")]
    rest = attempts.where("user_id is null or ts is null").select(
        "event_id", "user_id", "ts", "ok", F.lit(None).cast("string").alias("outcome"),
        F.lit(None).cast("long").alias("failed_attempts"), F.lit(None).cast("timestamp_ntz").alias("locked_until"))
    return scan.where("kind = 'judged'").select(columns).unionByName(deferred).unionByName(rest)


ORACLE = """
WITH RECURSIVE attempts AS (
  SELECT event_id, user_id, ts, event_type <> 'error' AND event_type <> 'click' AND event_type <> 'view' AS ok,
         row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS place
  FROM events),
scan(event_id, user_id, ts, ok, place, outcome, failed, lock) AS (
  SELECT event_id, user_id, ts, ok, place, CASE WHEN ok THEN 'success' ELSE 'failure' END, CASE WHEN ok THEN 0 ELSE 1 END, NULL::TIMESTAMP
  FROM attempts WHERE place = 1
  UNION ALL
  SELECT a.event_id, a.user_id, a.ts, a.ok, a.place,
         CASE WHEN s.lock > a.ts THEN 'locked' WHEN a.ok THEN 'success' WHEN s.failed >= 4 THEN 'lockout' ELSE 'failure' END,
         CASE WHEN s.lock > a.ts THEN s.failed WHEN a.ok THEN 0 ELSE s.failed + 1 END,
         CASE WHEN s.lock > a.ts THEN s.lock WHEN a.ok THEN NULL WHEN s.failed >= 4 THEN a.ts + INTERVAL 15 MINUTE ELSE s.lock END
  FROM scan s JOIN attempts a ON a.user_id = s.user_id AND a.place = s.place + 1)
SELECT event_id, user_id, ts, ok, outcome, CAST(failed AS BIGINT) AS failed_attempts, lock AS locked_until FROM scan
"""

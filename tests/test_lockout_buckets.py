"""the stream judges buckets of users, not one user a call."""

import os

from test_lockout import attempts, codes, frame, judged  # noqa: F401
from tidewatch.streaming import lockout as L


def test_users_of_a_bucket_keep_their_own_state(spark, attempts, tmp_path, monkeypatch):  # noqa: F811
    """A call judges a bucket of users; three buckets give what a state per user gives."""
    monkeypatch.setattr(L, "BUCKETS", 3)
    rows = sorted((r for r in attempts if r[1] < 140), key=lambda r: (r[2], r[0]))
    src = str(tmp_path / "in")
    cuts = [rows[k:k + 2000] for k in range(0, len(rows), 2000)]
    for k, part in enumerate(cuts):
        path = os.path.join(src, f"{k}")
        frame(spark, part).coalesce(1).write.parquet(path)
        os.utime(next(os.path.join(path, f) for f in os.listdir(path) if f.endswith(".parquet")), (k + 1, k + 1))
    stream = spark.readStream.schema(frame(spark, cuts[0]).schema).option("maxFilesPerTrigger", 1).parquet(f"{src}/*")
    q = (L.lockouts_stream(stream).writeStream.format("parquet").option("path", str(tmp_path / "out"))
         .option("checkpointLocation", str(tmp_path / "ckpt")).outputMode("append").trigger(availableNow=True).start())
    q.awaitTermination()
    assert {r.numRowsTotal for p in q.recentProgress for r in p.stateOperators} == {3}
    assert codes(spark.read.parquet(str(tmp_path / "out")).collect()) == judged(rows)

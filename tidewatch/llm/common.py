"""Helpers shared by the training-data operators: session set-up, scratch
tables in the shared folder, and small column expressions."""

from __future__ import annotations

import atexit
import contextlib
import re
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewatch.session import ensure_checkpoint_dir, scratch_path, ship_package

_PENDING: list[tuple[SparkSession, str]] = []


ARROW_BYTES = "spark.sql.execution.arrow.maxBytesPerBatch"
BATCH_BYTES = 8 << 20


def prepare(spark: SparkSession) -> None:
    """Shared checkpoint folder and package on the executors; idempotent."""
    ensure_checkpoint_dir(spark)
    ship_package(spark)


def bound_batches(spark: SparkSession) -> None:
    """Arrow batches bounded by bytes, as texts differ in length, unless the session has a lower bound."""
    if int(re.sub(r"\D", "", spark.conf.get(ARROW_BYTES))) not in range(1, BATCH_BYTES + 1):
        spark.conf.set(ARROW_BYTES, str(BATCH_BYTES))


def column(name: str) -> Column:
    """A top-level column whatever characters its name has."""
    return F.col("`" + name.replace("`", "``") + "`")


def kept_struct(docs: DataFrame, keep: tuple[str, ...]) -> list[Column]:
    """Kept columns travel as one struct ``kept``, so that no name of theirs meets one of an operator's; none, no struct."""
    return [F.struct(*(column(c) for c in keep)).alias("kept")] if keep else []


def kept_schema(docs: DataFrame, keep: tuple[str, ...]) -> list[str]:
    """The struct's declaration, for a function that passes it on."""
    quoted = ("`" + c.replace("`", "``") + "`: " + docs.schema[c].dataType.simpleString() for c in keep)
    return [f"kept struct<{', '.join(quoted)}>"] if keep else []


def materialise(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` as Parquet under ``spark.checkpoint.dir`` and read it back.

    Cuts the lineage at a table every executor can read again, so a lost
    executor never forces more than the work since this point.  The
    folder goes with :func:`drop`, or when the driver ends.
    """
    spark = df.sparkSession
    path = scratch_path(spark, f"llm-{name}-{uuid.uuid4().hex}")
    df.write.parquet(path)
    _PENDING.append((spark, path))
    out = spark.read.schema(df.schema).parquet(path)
    out._scratch_path = path
    return out


def drop(*tables: DataFrame) -> None:
    """Delete scratch tables of :func:`materialise` that nothing will read again."""
    for t in tables:
        _delete(t.sparkSession, t._scratch_path)


def _delete(spark: SparkSession, path: str) -> None:
    jvm = spark.sparkContext._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)
    _PENDING[:] = [x for x in _PENDING if x[1] != path]


@atexit.register
def _cleanup() -> None:
    for spark, path in list(_PENDING):
        with contextlib.suppress(Exception):  # the session may be gone already
            _delete(spark, path)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def utf8(col: str | Column) -> Column:
    """Text as UTF-8 bytes; null counts as empty."""
    c = F.col(col) if isinstance(col, str) else col
    return F.coalesce(c.cast("string"), F.lit("")).cast("binary")


def crc_fold(id_col: str, modulus: int) -> Column:
    """``crc32(id as text) mod modulus``; a null id counts as the empty text."""
    return (F.crc32(F.coalesce(F.col(id_col).cast("string"), F.lit("")).cast("binary")) % modulus).cast("int")

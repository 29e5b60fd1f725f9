"""Named queries: each has a Spark builder ``(spark, sf_dir) -> DataFrame``
and, when the result is SQL-expressible, the equivalent DuckDB SQL over
the base tables (used as the correctness oracle)."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession

Builder = Callable[[SparkSession, str], DataFrame]


@dataclass(frozen=True)
class Query:
    name: str
    build: Builder
    sql: str | None
    ops: str  # SURVEY §2 ids covered


REGISTRY: dict[str, Query] = {}


def register(name: str, ops: str, sql: str | None = None):
    def deco(fn: Builder) -> Builder:
        if name in REGISTRY:
            raise ValueError(f"duplicate query {name}")
        REGISTRY[name] = Query(name, fn, sql, ops)
        return fn
    return deco


def load_all() -> dict[str, Query]:
    from . import reporting  # noqa: F401  (registration side effects)
    for mod in ("quality", "profile", "metrics", "features", "models", "ingest", "streams",
                "resampling", "clustering", "extra", "audit"):
        try:
            __import__(f"{__name__}.{mod}")
        except ModuleNotFoundError as e:  # module not written yet
            if e.name != f"{__name__}.{mod}":
                raise
    return REGISTRY

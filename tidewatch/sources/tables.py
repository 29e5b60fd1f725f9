"""Reading the base parquet tables.

Every reader returns a lazy DataFrame; column pruning and filter
pushdown reach the parquet scan because nothing here projects or
materialises eagerly.
"""

from __future__ import annotations

import os

from pyspark.sql import DataFrame, SparkSession

TABLES = ("region nation customer supplier part orders lineitem events documents "
          "embeddings pages benchmark labels conversations").split()


def table_path(sf_dir: str, name: str) -> str:
    return os.path.join(sf_dir, f"{name}.parquet")


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    if name not in TABLES:
        raise ValueError(f"unknown table {name!r}")
    return spark.read.parquet(table_path(sf_dir, name))


def register_tables(spark: SparkSession, sf_dir: str, names=TABLES) -> None:
    """Expose the base tables as temp views for ad-hoc ``spark.sql``."""
    for n in names:
        read_table(spark, sf_dir, n).createOrReplaceTempView(n)
